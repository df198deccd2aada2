"""Text as code points: white space, scripts, direction, punctuation, distance."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as Python's str.split() has it. What is up to 0xff is listed one by one, and what is
# beyond has a range around it, so that a letter is told apart by two tests, not by one for each range.
SPACES = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"

# The first range that holds a code point names its script.
SCRIPT_RANGES = (
    (0x0041, 0x024F, "Latn"),
    (0x0370, 0x03FF, "Grek"),
    (0x0400, 0x052F, "Cyrl"),
    (0x0590, 0x05FF, "Hebr"),
    (0x0600, 0x06FF, "Arab"),
    (0x10A0, 0x10FF, "Geor"),
    (0x3040, 0x309F, "Hira"),
    (0x30A0, 0x30FF, "Kana"),
    (0x3400, 0x9FFF, "Hani"),
)

# Punctuation that no space follows, or precedes, besides what Unicode classes as open or close.
OPENING = "([{<«‹“‘「『【〔〈《（［｛"
CLOSING = ")]}>»›”’」』】〕〉》）］｝,.;:!?%‰،؛؟。．，、：；！？٪"


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def composed(text: Column) -> Column:
    """Unicode NFC; only texts beyond ASCII travel to Python."""
    return F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def single_spaced(text: Column) -> Column:
    # Most texts are so already, and looking costs far less than replacing each space by itself.
    other = text.rlike(f"{SPACES}(?:(?<! )|{SPACES})")
    return F.trim(F.when(other, F.regexp_replace(text, f"{SPACES}+", " ")).otherwise(text))


def normalised(text: Column) -> Column:
    return single_spaced(composed(text))


def normalised_lines(lines: Column) -> Column:
    """Each line single-spaced, blank ones dropped (lines are composed already)."""
    return F.filter(F.transform(lines, single_spaced), lambda x: x != "")


def scripts(text: Column) -> Column:
    """The scripts of a text's code points, in the order of the ranges."""
    named = (F.when(text.rlike(f"[\\x{{{a:x}}}-\\x{{{b:x}}}]"), F.lit(name)) for a, b, name in SCRIPT_RANGES)
    return F.array_compact(F.array(*named))


@cache
def _letters_of(*classes: str) -> str:
    """A pattern for one code point of these bidirectional classes.

    An expression tries the ranges of a class one after another, so they are the
    leaves of a tree: each half is looked into only for code points between its ends.
    """
    inside = np.array([unicodedata.bidirectional(chr(c)) in classes for c in range(0x110000)])
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False)).reshape(-1, 2)

    def tree(ranges: list[list[int]]) -> str:
        if len(ranges) <= 4:
            return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b - 1:x}}}" for a, b in ranges) + "]"
        # Parted where the gap is widest among the middle ones, so that what is in neither half is soon found to be.
        middle = range(len(ranges) // 4 or 1, len(ranges) - len(ranges) // 4)
        half = max(middle, key=lambda i: ranges[i][0] - ranges[i - 1][1])
        parts = [ranges[:half], ranges[half:]]
        return "(?:" + "|".join(f"(?=[\\x{{{p[0][0]:x}}}-\\x{{{p[-1][1] - 1:x}}}]){tree(p)}" for p in parts) + ")"

    return tree(edges.tolist())


def direction(text: Column) -> Column:
    """ltr, rtl, neutral or mixed, by the strong bidirectional classes of the text's code points."""
    right, left = text.rlike(_letters_of("R", "AL")), text.rlike("[A-Za-z]") | text.rlike(_letters_of("L"))
    return F.when(right & left, "mixed").when(right, "rtl").when(left, "ltr").otherwise("neutral")


def directions_agree(one: Column, two: Column) -> Column:
    return (one != "mixed") & (two != "mixed") & ((one == "neutral") | (two == "neutral") | (one == two))


def opens(letter: Column) -> Column:
    return F.lit(OPENING).contains(letter) & (letter != "") | letter.rlike(r"[\p{Ps}\p{Pi}]")


def closes(letter: Column) -> Column:
    return F.lit(CLOSING).contains(letter) & (letter != "") | letter.rlike(r"[\p{Pe}\p{Pf}]")


def ink(text: Column) -> Column:
    """Letters that are not white space."""
    return F.length(F.regexp_replace(text, SPACES, ""))


def language_base(language: Column) -> Column:
    return F.lower(F.split_part(language, F.lit("-"), F.lit(1)))


def word_codes(words: Column, known: Column) -> Column:
    """Words as one string of one letter each, so that letter distance is word distance.

    ``known``: the distinct words that both sides may hold. Letters are those
    beyond the first plane, so 1,048,575 words have their own; more are an error.
    """
    code = lambda w: F.when(F.size(known) < 1 << 20, F.array_position(known, w) + 0xFFFF).otherwise(F.raise_error(F.lit("too many words")).cast("long"))
    letter = lambda w: F.decode(F.unhex(F.lpad(F.hex(code(w)), 8, "0")), "UTF-32")
    return F.array_join(F.transform(words, letter), "")


def word_distance(one: Column, two: Column) -> Column:
    """Edits between two arrays of words."""
    known = F.array_distinct(F.concat(one, two))
    return F.levenshtein(word_codes(one, known), word_codes(two, known))
