"""Tokenisation operators (P1–P9). All narrow: one select per document, no shuffle. Plans that count words
read them by ``functions/words.py``, which gives the tokens of P2 and P9 a chunk of texts at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _long(df: DataFrame, arr, keys=("doc_id",), word: str = "word") -> DataFrame:
    """Array column → long form ``(keys..., pos, word)`` with 0-based BIGINT positions."""
    ex = df.select(*keys, F.posexplode(arr).alias("pos", word))
    return ex.withColumn("pos", F.col("pos").cast("bigint"))


def tokenize_regex(df: DataFrame, text: str = "text", keys=("doc_id",)) -> DataFrame:
    """word/apostrophe runs in order."""
    return _long(df, T.word_tokens(F.col(text)), keys)


def tokenize_whitespace(df: DataFrame, text: str = "text", keys=("doc_id",)) -> DataFrame:
    """White-space split, case kept."""
    return _long(df, T.whitespace_tokens(F.col(text)), keys)


def tokenize_word2(df: DataFrame, text: str = "text", keys=("doc_id",)) -> DataFrame:
    """Vectoriser tokens (lowercased runs of ≥ 2 word characters)."""
    return _long(df, T.vectorizer_tokens(F.col(text)), keys)


def drop_punct_tokens(tokens: DataFrame, word: str = "word") -> DataFrame:
    """Drop a token if any character is ASCII punctuation."""
    return tokens.where(~T.has_punct(F.col(word)))


def drop_numeric_tokens(tokens: DataFrame, word: str = "word") -> DataFrame:
    """P5: drop a token if any character is a digit (Python ``isdigit`` semantics)."""
    return tokens.where(~T.has_digit(F.col(word)))


def drop_short_tokens(tokens: DataFrame, word: str = "word") -> DataFrame:
    """Keep tokens longer than one code point."""
    return tokens.where(F.length(word) > 1)


def lowercase(tokens: DataFrame, word: str = "word") -> DataFrame:
    """Lowercase each token."""
    return tokens.withColumn(word, F.lower(word))


def clean_token_arrays(df: DataFrame, text: str = "text", keys=("doc_id",),
                       out: str = "words") -> DataFrame:
    """P9 in array form: ``(keys..., words ARRAY<STRING>)``; one narrow stage."""
    return df.select(*keys, T.clean_token_array(F.col(text)).alias(out))


def clean_tokens(df: DataFrame, text: str = "text", keys=("doc_id",)) -> DataFrame:
    """P9 in long form ``(keys..., pos, word)``; pos counts surviving tokens from 0."""
    return _long(df, T.clean_token_array(F.col(text)), keys)


def rejoin_text(df: DataFrame, text: str = "text", keys=("doc_id",)) -> DataFrame:
    """Cleaned tokens joined by one space."""
    return df.select(*keys, T.rejoin(T.clean_token_array(F.col(text))).alias("clean_text"))
