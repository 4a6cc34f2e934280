"""Quality rules by repetition coverage: characters inside n-grams and lines that a text holds more than once.

Words are numbered within the text and hashed once each; a rolling hash gives all windows of each length in numpy. Windows
with equal hashes are compared word by word, and a text in which two differ is counted by the words themselves, so
the counts are exact. A window of n words can only be repeated where its first n - 1 words are.

Defined results: a null text is empty; every row is judged by itself, so repeated doc_ids keep their rows; a text without
words has all counts 0 and fails. Time and memory grow with the length of the longest text, apart from sorting.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import texts

FEWEST, WINDOW, MOST_REPEATED = 10, 5, 20  # the base rule: words, words of a window, percent of words in repeated ones
# Published thresholds for repetition, in percent of the characters: by n-gram length, and of repeated lines.
COVERAGE = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINES = 20
SYMBOLS = b"#*$%&|<>"
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COVERED = ["line_chars", "dup_line_chars", *[f"dup_chars_{n}" for n in COVERAGE]]


def repeated(hashes: np.ndarray, ids: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Those of the places at, of windows of n words, whose window occurs more than once among them."""
    order = np.argsort(hashes[at])
    place = at[order]
    same = hashes[place[1:]] == hashes[place[:-1]]
    a, b = place[1:][same], place[:-1][same]
    if any((ids[a + k] != ids[b + k]).any() for k in range(n)):
        seen = Counter(ids[p : p + n].tobytes() for p in at)
        return np.array([p for p in at if seen[ids[p : p + n].tobytes()] > 1], np.int64)
    hit = np.zeros(len(ids), bool)
    hit[a] = hit[b] = True
    return np.flatnonzero(hit)


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """The words inside windows of n words at these places."""
    edge = np.zeros(size + 1, np.int64)
    edge[at] += 1
    edge[at + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def measured(text: str) -> tuple[int, ...]:
    """COUNTS, then COVERED."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at the six ASCII white spaces, as the contract has them
    raw = np.frombuffer(data, np.uint8)
    inside = ~SPACE[raw]
    chars = (inside & ((raw & 0xC0) != 0x80)).astype(np.int64)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    start = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]])) if words else np.zeros(0, np.int64)
    length = np.add.reduceat(chars, start) if words else np.zeros(0, np.int64)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))[ids] if words else np.zeros(0, np.uint64)

    n_repeat, chars_in = 0, []
    rolled, at = word, np.arange(len(words))
    for n in range(2, max(COVERAGE) + 1):
        rolled = rolled[:-1] * BASE + word[n - 1 :]
        if n not in COVERAGE:
            continue
        at = at[at < len(rolled)]
        at = repeated(rolled, ids, n, at)
        mask = covered(at, n, len(words))
        chars_in.append(int(length[mask].sum()))
        if n == WINDOW:
            n_repeat = int(mask.sum())

    seen: set[bytes] = set()
    n_lines = line_chars = dup_chars = 0
    for line in data.split(b"\n"):
        if line.strip():
            size = len(line.decode("utf-8", "surrogatepass"))
            line_chars += size
            if line in seen:
                n_lines, dup_chars = n_lines + 1, dup_chars + size
            seen.add(line)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return len(words), int(chars.sum()), symbols, n_lines, n_repeat, line_chars, dup_chars, *chars_in


def verdict(found: tuple[int, ...]) -> tuple[bool, bool]:
    """base_failed, kept."""
    n_words, word_chars, _, _, n_repeat, line_chars, dup_line, *dup = found
    failed = n_words < FEWEST or 100 * n_repeat > MOST_REPEATED * n_words
    over = 100 * dup_line > LINES * line_chars or any(100 * d > most * word_chars for d, most in zip(dup, COVERAGE.values()))
    return failed, not failed and not over


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, COVERED."""
    t = texts(docs)
    names = [*COUNTS, "base_failed", "kept", *COVERED]
    types = [pa.bool_() if c in ("base_failed", "kept") else pa.int64() for c in names]
    schema = T.StructType([t.schema["doc_id"], *[T.StructField(c, T.BooleanType() if k == pa.bool_() else T.LongType()) for c, k in zip(names, types)]])

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column("text"):
                found = measured(text.as_py())
                rows.append((*found[: len(COUNTS)], *verdict(found), *found[len(COUNTS) :]))
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, types)]], ["doc_id", *names])

    return t.mapInArrow(run, schema)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, as they are, judged row by row."""
    at = docs.columns.index("text")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([verdict(measured(x.as_py() or ""))[1] for x in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
