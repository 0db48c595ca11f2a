"""Token patterns and per-token column expressions (JVM-side, no Python UDF).

The same pattern strings are valid in Java regex (Spark) and RE2 (DuckDB, the oracle), so one
definition serves the library and its SQL checks. Character classes that follow Python's
``str.isdigit`` / ``str.isspace`` are built from a rule over the code space at import time.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------
# Word token: a run of letters, numbers, underscores or apostrophes.
WORD_PATTERN = r"[\p{L}\p{N}_']+"
# Vectoriser-style token: a run of at least two letters, numbers or underscores.
WORD2_PATTERN = r"[\p{L}\p{N}_]{2,}"
# ASCII punctuation (the 32 printable non-alphanumeric ASCII signs).
PUNCT_PATTERN = r"[!-/:-@\[-`{-~]"
# Sub-word joint removed before scoring translations.
# Our own stop list: frequent function words of the four corpus languages (en, fr, de, es).
STOP_WORDS = (
    "the of and to in is on that it as be was for with this are by at from "
    "en la le les de des et un une du die der das und ein zu el los que y"
).split()
# -------------------------------------------------------------------------------------------------


def _ranges_to_class(points: list[int]) -> str:
    """Compact ``\\x{..}`` ranges for a sorted list of code points."""
    parts: list[str] = []
    start = prev = None
    for cp in points:
        if start is None:
            start = prev = cp
        elif cp == prev + 1:
            prev = cp
        else:
            parts.append(_one_range(start, prev))
            start = prev = cp
    if start is not None:
        parts.append(_one_range(start, prev))
    return "".join(parts)


def _one_range(a: int, b: int) -> str:
    return f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}"


@functools.lru_cache(maxsize=None)
def digit_pattern() -> str:
    """Characters for which Python's ``str.isdigit`` is true: decimal digits plus the other
    digit-valued signs (super/subscripts, circled digits, ...), the latter listed by rule."""
    extra = [c for c in range(0x110000)
             if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"]
    return "[\\p{Nd}" + _ranges_to_class(extra) + "]"


@functools.lru_cache(maxsize=None)
def clean_body_pattern() -> str:
    """A letter or a number without digit value (Java-only: class intersection)."""
    extra = [c for c in range(0x110000)
             if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"]
    return "[\\p{L}\\p{Nl}[\\p{No}&&[^" + _ranges_to_class(extra) + "]]]"


@functools.lru_cache(maxsize=None)
def clean_word_pattern() -> str:
    """P1 + P4 + P5 fused into one Java pattern: a maximal run of letters and non-digit numbers
    that touches no other word character, underscore or apostrophe. A run of the P1 pattern
    containing '_', an apostrophe or a digit therefore yields nothing, exactly as dropping that
    whole token would. (Java-only: lookarounds; the SQL twin applies the steps one by one.)"""
    body = clean_body_pattern()
    edge = "[\\p{L}\\p{N}_']"
    return f"(?<!{edge}){body}+(?!{edge})"


@functools.lru_cache(maxsize=None)
def whitespace_token_pattern() -> str:
    """A maximal run of characters for which Python's ``str.isspace`` is false."""
    spaces = [c for c in range(0x110000) if chr(c).isspace()]
    return "[^" + _ranges_to_class(spaces) + "]+"


def extract_all(text: Column, pattern: str) -> Column:
    """All non-overlapping matches of ``pattern`` in order (null text → empty array)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def word_tokens(text: Column) -> Column:
    """word/apostrophe runs, in order."""
    return extract_all(text, WORD_PATTERN)


@functools.lru_cache(maxsize=None)
def whitespace_run_pattern() -> str:
    """A run of characters for which Python's ``str.isspace`` is true."""
    spaces = [c for c in range(0x110000) if chr(c).isspace()]
    return "[" + _ranges_to_class(spaces) + "]+"


def whitespace_tokens(text: Column) -> Column:
    """Python ``str.split()`` semantics; case kept. Implemented as a split on white-space runs
    minus the empty edge pieces (several times faster in Java than extracting the complement)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), whitespace_run_pattern()), "")


def vectorizer_tokens(text: Column) -> Column:
    """Lowercased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD2_PATTERN), F.lit(0))


def has_punct(w: Column) -> Column:
    return w.rlike(PUNCT_PATTERN)


def has_digit(w: Column) -> Column:
    return w.rlike(digit_pattern())


def clean_token_array(text: Column) -> Column:
    """P9 as one array expression: P1 → drop punctuation tokens (P4) → lowercase (P7) →
    drop tokens with a digit (P5) → keep length > 1 (P6). Order of survivors is kept.

    P1, P4 and P5 run as one regex pass (:func:`clean_word_pattern`); lowercasing and the length
    rule follow on the short token array."""
    toks = extract_all(text, clean_word_pattern())
    lowered = F.transform(toks, lambda w: F.lower(w))
    return F.filter(lowered, lambda w: F.length(w) > 1)


def clean_token_array_stepwise(text: Column) -> Column:
    """P9 step by step (reference formulation of :func:`clean_token_array`)."""
    toks = word_tokens(text)
    no_punct = F.filter(toks, lambda w: ~has_punct(w))
    lowered = F.transform(no_punct, lambda w: F.lower(w))
    return F.filter(lowered, lambda w: (~has_digit(w)) & (F.length(w) > 1))


def rejoin(words: Column) -> Column:
    """Cleaned tokens joined by one space ('' for no token)."""
    return F.array_join(words, " ")


def strip_subword_marks(text: Column) -> Column:
    """Remove '@@ ' joints so sub-words merge; a trailing '@@' at the end is removed too."""
    joined = F.regexp_replace(F.concat(F.coalesce(text, F.lit("")), F.lit(" ")), "@@ ", "")
    return F.regexp_replace(joined, " $", "")
