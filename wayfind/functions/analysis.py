"""From text to index words.

A token is a maximal run of ASCII letters, digits, underscores or the Arabic block;
everything else delimits. Tokens are cut first, then lower-cased and stemmed unless they hold an
Arabic letter. All of it is native but the stemmer, which takes whole Arrow columns and stems
each distinct word of a batch once.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .porter2 import stem

TOKEN = "[A-Za-z0-9_\\u0600-\\u06FF]"
ARABIC = "[\\u0600-\\u06E0]"
ODD = "[\\u0600-\\u06E0\\u0130\\u212A]"
BODY_CHARS, OTHER_CHARS, SHOWN_CHARS = 30, 500, 250

# a small default; pass your own list, as stop words are a matter of the collection
STOP_WORDS = frozenset(
    "a b c d e f g h i j k l m n o p q r s t u v w x y z about after all also an and any are as at be because been before being between both but by can could did do does "
    "down during each few for from had has have having he her here hers him his how if in into is it its just me more most my no nor not now of off on once only or other our "
    "ours out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where "
    "which while who whom why will with would you your yours".split()
)


@dataclass(frozen=True)
class Analyzer:
    """How words are made. The index cuts body tokens shorter than titles and queries."""

    stem: bool = True
    body_chars: int = BODY_CHARS
    other_chars: int = OTHER_CHARS
    stop_words: frozenset[str] = STOP_WORDS  # of queries only


def is_arabic(word: Column) -> Column:
    return word.rlike(ARABIC)


def raw_tokens(text: Column) -> Column:
    """All tokens in order, as they stand; no text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{TOKEN}+"), F.lit(0))


def tokens(text: Column, most: int = BODY_CHARS) -> Column:
    """Tokens cut to ``most`` characters and, unless Arabic, in lower case; not stemmed.

    One pattern finds and cuts. Lower case comes after the split: it would turn U+0130 and U+212A
    into ASCII letters. Texts without those and without Arabic, nearly all, are lower-cased whole,
    which changes no delimiter into a letter, and their tokens are not touched one by one.
    """
    text, pattern = F.coalesce(text, F.lit("")), F.lit(f"({TOKEN}{{1,{most}}}){TOKEN}*+")
    each = F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), lambda x: F.when(is_arabic(x), x).otherwise(F.lower(x)))
    return F.when(text.rlike(ODD), each).otherwise(F.regexp_extract_all(F.lower(text), pattern, F.lit(1)))


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_lists(lists: pa.Array) -> pa.Array:
    words = lists.flatten().dictionary_encode()
    stems = pa.array([w if any("\u0600" <= c <= "\u06e0" for c in w) else stem(w) for w in words.dictionary.to_pylist()], pa.string())
    ends = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    return pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), stems.take(words.indices))


@F.arrow_udf(T.StringType())
def stemmed(word: pa.Array) -> pa.Array:
    """Stems of single lower-case words; Arabic ones stay."""
    words = word.dictionary_encode()
    stems = pa.array([None if w is None else w if any("\u0600" <= c <= "\u06e0" for c in w) else stem(w) for w in words.dictionary.to_pylist()], pa.string())
    return stems.take(words.indices)


def words(text: Column, analyzer: Analyzer = Analyzer(), most: int | None = None) -> Column:
    """Index words in order; positions are places in this array, counted from 0."""
    made = tokens(text, analyzer.body_chars if most is None else most)
    return stem_lists(made) if analyzer.stem else made


def query_words(text: Column, analyzer: Analyzer = Analyzer()) -> Column:
    """ASCII words of a query, cut and in lower case; stop words go by case, before that. Not stemmed: a column is stemmed by ``stem_lists``, outside of lambdas."""
    found = F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(*sorted(analyzer.stop_words))) if analyzer.stop_words else found
    return F.transform(kept, lambda w: F.lower(F.substring(w, 1, analyzer.other_chars)))


def with_positions(pages: DataFrame, words_column: str = "words", key: str = "page_id") -> DataFrame:
    """One row for each word of each page: key, position, word."""
    return pages.select(key, F.posexplode_outer(words_column).alias("position", "word")).where("word is not null")


def without_stop_words(df: DataFrame, column: str, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """Drops stop words, by case, from a column of query words."""
    return df.where(~F.col(column).isin(*sorted(stop_words)))
