"""Learnt words with eviction, in batch and as a stream."""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from keyloom.functions import keypad

CAPACITY, MOST_USES = 4000, 1000
STORE = "user_id long, word string, uses int"
CHANGES = "user_id long, word array<string>, uses array<int>, at array<long>"


class Last(str):
    """Orders words from the greatest down."""

    __slots__ = ()

    def __lt__(self, other):
        return str.__gt__(self, other)


class Store:
    """Uses of the words of one user. Over capacity the least used word goes; of equals, the greatest: it stands on top of
    the heap of the least number of uses, so no event scans the store. What stands in a heap may be out of date and is
    passed over then. A store may lie elsewhere (read, everything): then only words that are asked for are taken, and all
    of them once something has to go."""

    def __init__(self, capacity: int = CAPACITY, size: int = 0, read: Callable[[str], int] | None = None, everything: Callable[[], Iterable[tuple[str, int]]] = tuple):
        self.capacity, self.size, self.read, self.everything = capacity, size, read, everything
        self.uses: dict[str, int] = {}
        self.touched: dict[str, int] = {}
        self.heaps: dict[int, list[Last]] | None = None
        self.entries = 0

    def get(self, word: str) -> int:
        if word not in self.uses and self.read:
            self.uses[word] = self.read(word)
        return self.uses.get(word, 0)

    def _put(self, word: str, n: int, at: int) -> None:
        if n or self.read:
            self.uses[word] = n
        else:
            self.uses.pop(word, None)
        if self.read:
            self.touched[word] = at
        if n and self.heaps is not None:
            heappush(self.heaps[n], Last(word))
            self.entries += 1

    def learn(self, word: str, at: int = 0) -> None:
        n = self.get(word)
        self._put(word, min(n + 1, MOST_USES), at)
        if not n:
            self.size += 1
            if self.size > self.capacity:
                self._evict(at)

    def forget(self, word: str, at: int = 0) -> bool:
        held = self.get(word) > 0
        if held:
            self._put(word, 0, at)
            self.size -= 1
        return held

    def _evict(self, at: int) -> None:
        if self.heaps is None or self.entries > 4 * self.capacity + 1024:
            if self.heaps is None:
                self.uses = {**dict(self.everything()), **self.uses}
            self.heaps = defaultdict(list)
            for w, n in self.uses.items():
                if n:
                    self.heaps[n].append(Last(w))
            for heap in self.heaps.values():
                heapify(heap)
            self.entries = self.size
        for n in sorted(self.heaps):
            heap = self.heaps[n]
            while heap:
                word = str(heappop(heap))
                self.entries -= 1
                if self.uses.get(word) == n:
                    self.forget(word, at)
                    return
            del self.heaps[n]

    def held(self) -> dict[str, int]:
        return {w: n for w, n in self.uses.items() if n}


def spelled(events: DataFrame) -> DataFrame:
    """events(user_id, at, word, and forget or not): lower case; what no keys spell is refused."""
    forget = F.coalesce("forget", F.lit(False)) if "forget" in events.columns else F.lit(False)
    t = events.select("user_id", "at", F.lower("word").alias("word"), forget.alias("forget"))
    return t.where((F.col("word") != "") & keypad.sequence_of(F.col("word")).isNotNull())


def folded(events: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The store of each user after all their events, in order of at; at the same at, words are learnt before they are
    forgotten, and the lesser first. Users who never had more words than fit are counted by aggregates, however many events
    they have. The others' events, sorted, run through a task each in batches; it holds no more than the store."""
    t = spelled(events)
    learnt = t.where("not forget").groupBy("user_id", "word").agg(F.count("*").alias("n"), F.max("at").alias("latest"))
    crowded = learnt.groupBy("user_id").agg(F.count("*").alias("words")).where(F.col("words") > capacity).select("user_id")
    gone = t.where("forget").groupBy("user_id", "word").agg(F.max("at").alias("gone"))
    # Only words that were ever forgotten need the events after that counted.
    again = t.where("not forget").join(gone, ["user_id", "word"]).where("at > gone").groupBy("user_id", "word").agg(F.count("*").alias("since"))
    few = learnt.join(gone, ["user_id", "word"], "left").join(again, ["user_id", "word"], "left").join(crowded, "user_id", "left_anti")
    n = F.when(F.col("gone").isNull(), F.col("n")).otherwise(F.coalesce("since", F.lit(0)))
    few = few.select("user_id", "word", F.least(n, F.lit(MOST_USES)).cast("int").alias("uses")).where("uses > 0")

    def run(frames):
        user, store = None, None
        for f in frames:
            for u, word, forget in zip(f["user_id"].tolist(), f["word"].tolist(), f["forget"].tolist()):
                if u != user or store is None:
                    if store is not None:
                        yield rows(user, store)
                    user, store = u, Store(capacity)
                store.forget(word) if forget else store.learn(word)
        if store is not None:
            yield rows(user, store)

    def rows(user, store):
        held = store.held()
        return pd.DataFrame({"user_id": user, "word": list(held), "uses": list(held.values())})

    many = t.join(crowded, "user_id", "left_semi").repartition("user_id").sortWithinPartitions("user_id", "at", "forget", "word")
    return few.unionByName(many.select("user_id", "word", "forget").mapInPandas(run, STORE))


class Learner(StatefulProcessor):
    """One user's store as one value of state, as it is bounded by the capacity: a batch reads it once and writes it once,
    however many words it names, since each call to the state costs more than many words. It takes rows of many events and emits
    one, the words that changed, for the same reason: uses is 0 where a word has gone."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity

    def init(self, handle) -> None:
        self.state = handle.getValueState("store", "words array<string>, uses array<int>")

    def handleInputRows(self, key, rows, timerValues):
        # Twelve bytes an event and each word once, to put the events of the batch in order.
        at, named, number = array("q"), array("q"), {}
        for r in rows:
            at.extend(r.at)
            named.extend(2 * number.setdefault(word, len(number)) + forget for word, forget in zip(r.word, r.forget))
        words = list(number)
        place = np.argsort(np.argsort(np.array(words)))
        code = np.frombuffer(named, np.int64)
        order = np.lexsort((place[code >> 1], code & 1, np.frombuffer(at, np.int64)))

        held = self.state.get()
        held = dict(zip(*held)) if held else {}
        store = Store(self.capacity, len(held), lambda word: held.get(word, 0), held.items)
        for k in order.tolist():
            word = words[code[k] >> 1]
            store.forget(word, at[k]) if code[k] & 1 else store.learn(word, at[k])
        for word in store.touched:
            held[word] = store.uses[word]
        held = {word: n for word, n in held.items() if n}
        self.state.update((list(held), list(held.values())))
        if store.touched:
            yield Row(user_id=key[0], word=list(store.touched), uses=[store.uses[word] for word in store.touched], at=list(store.touched.values()))


def streamed(events: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The same as a stream: after each batch, the words whose uses changed. Rows of a later batch count as later."""
    return learnt(spelled(events).select("user_id", F.array(F.struct("at", "word", "forget")).alias("events")), capacity)


def learnt(turns: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """streamed() for rows(user_id, events) that each hold an array of events(at, word, forget)."""
    e = F.transform("events", lambda x: F.struct(x["at"].alias("at"), F.lower(x["word"]).alias("word"), x["forget"].alias("forget")))
    e = F.filter(e, lambda x: F.coalesce(x["word"] != "", F.lit(False)) & keypad.typeable(x["word"]))
    t = turns.select("user_id", F.explode(F.array(e)).alias("e")).where("size(e) > 0").select("user_id", *[F.col("e")[c].alias(c) for c in ("at", "word", "forget")])
    t = t.groupBy("user_id").transformWithState(Learner(capacity), CHANGES, "append", "none")
    return t.select("user_id", F.explode(F.arrays_zip("word", "uses", "at")).alias("x")).select("user_id", "x.*")


def latest(changes: DataFrame) -> DataFrame:
    """The stores that a stream's changes add up to, where later batches held later events."""
    last = changes.groupBy("user_id", "word").agg(F.max_by("uses", "at").alias("uses"))
    return last.where("uses > 0")
