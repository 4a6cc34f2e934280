"""Keypad columns: normalising, sequences, packing, case."""

from __future__ import annotations

import unicodedata
from string import ascii_lowercase, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of each key, marks of each key, the marks of key 1.
KEYS = {"2": "abcąć", "3": "defę", "4": "ghi", "5": "jklł", "6": "mnońó", "7": "pqrsś", "8": "tuv", "9": "wxyzźż"}
SYMBOLS = {"2": ".,;:", "3": "!?'\"", "4": "@#/\\", "5": "$%&*", "6": "()<>", "7": "[]{}", "8": "-_+=", "9": "`~^|"}
MARKS = ".,-'&:/"
LETTERS = "".join(KEYS.values())
DIGITS = "".join(k * len(v) for k, v in KEYS.items())
GRID = {str(d): ((d - 1) // 3, (d - 1) % 3) for d in range(1, 10)} | {"0": (3, 1)}
EN = "a-z0-9.,'&:/ -"
PL = "a-ząćęłńóśźż0-9.,'&:/ -"
# Letters that a language has beside a to z. Those that no key shows are pressed on the key of their base letter.
EXTRA = {"en": "", "pl": "ąćęłńóśźż", "fr": "àâæçèéêëîïôùûüÿœ", "de": "äöüß", "es": "áéíñóúü"}
BASES = {"æ": "a", "œ": "o", "ß": "s"}


ALL_LETTERS = LETTERS + "".join(sorted({c for x in EXTRA.values() for c in x} - set(LETTERS)))
ALL_DIGITS = DIGITS + "".join(DIGITS[LETTERS.index(BASES.get(c) or unicodedata.normalize("NFD", c)[0])] for c in ALL_LETTERS[len(LETTERS) :])


def alphabet_of(language: str) -> str:
    return EN.replace("a-z", f"a-z{EXTRA.get(language, '')}")


def normalise(c: Column, alphabet: str = EN) -> Column:
    c = F.translate(c, " ‘’“”–—", " ''\"\"--")
    c = F.lower(F.replace(c, F.lit("…"), F.lit("...")))
    # Letters one by one: a class of ranges is tested range by range, which is far slower, and all text runs through this one.
    each = alphabet.replace("a-z", ascii_lowercase).replace("0-9", digits)
    c = F.trim(F.regexp_replace(F.regexp_replace(c, f"[^{each}]+", " "), " {2,}", " "))
    return F.regexp_replace(c, "^(?:- *)+", "")


def normalise_in(c: Column, language: Column) -> Column:
    """Each row by the alphabet of its language; that of English where the language is not known."""
    out = None
    for name in EXTRA:
        if EXTRA[name]:
            this = language == name
            out = F.when(this, normalise(c, alphabet_of(name))) if out is None else out.when(this, normalise(c, alphabet_of(name)))
    return out.otherwise(normalise(c))


def typeable_in_any(c: Column) -> Column:
    """Whether sequence_in_any has keys for a word."""
    return F.lower(c).rlike(f"^[{ALL_LETTERS}]*$")


def sequence_in_any(c: Column) -> Column:
    """Keys of a word of any of the languages; null where a letter belongs to none."""
    low = F.lower(c)
    return F.when(low.rlike(f"^[{ALL_LETTERS}]*$"), F.translate(low, ALL_LETTERS, ALL_DIGITS))


def typeable(c: Column) -> Column:
    """Whether sequence_of has keys for a word."""
    return F.lower(c).rlike(f"^[{LETTERS}]*$")


def sequence_of(c: Column) -> Column:
    """Keys of a word; null where a letter is on no key."""
    low = F.lower(c)
    return F.when(low.rlike(f"^[{LETTERS}]*$"), F.translate(low, LETTERS, DIGITS))


def pressed(c: Column) -> Column:
    """Keys of words that are typeable and in lower case, 0 between them."""
    return F.translate(c, ALL_LETTERS + " ", ALL_DIGITS + "0")


def phrase_sequence(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.rlike(f"^[{LETTERS} ]*$"), F.translate(low, LETTERS + " ", DIGITS + "0"))


def packed(c: Column) -> Column:
    """Up to 15 keys as 4-bit numbers 1-8, left-aligned in 60 bits; -1 where a key is not 2-9."""
    shifted = F.rpad(F.translate(F.substring(c, 1, 15), "23456789", "12345678"), 15, "0")
    return F.when(c.rlike("^[2-9]*$"), F.conv(shifted, 16, 10).cast("long")).otherwise(F.lit(-1).cast("long"))


def once(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def repeats_in(c: Column) -> Column:
    """Adjacent equal keys."""
    chars = F.split(c, "")
    return F.size(F.filter(F.sequence(F.lit(2), F.greatest(F.length(c), F.lit(2))), lambda i: (i <= F.length(c)) & (F.get(chars, i - 1) == F.get(chars, i - 2))))


def turned_over(c: Column) -> Column:
    return F.translate(c, "123789", "789123")


def readable(c: Column) -> Column:
    return ~c.rlike(r"(.)\1\1") & (F.regexp_count(c, F.lit(r"(.)\1")) < 3) & c.rlike("[aąeęioóuy]")


def word_after(text: Column, caret: Column) -> Column:
    """Where the caret stands after a jump to the end of the next word: past white space, then past the word."""
    return caret + F.length(F.regexp_extract(F.substring(text, caret + 1, F.length(text)), r"^\s*\S*", 0))


def word_before(text: Column, caret: Column) -> Column:
    """Where it stands after a jump back: over white space, then to the start of the word."""
    return caret - F.length(F.regexp_extract(F.substring(text, F.lit(1), caret), r"\S*\s*$", 0))
