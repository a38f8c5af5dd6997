"""From what a user types to words and phrases."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import analysis
from ..functions.analysis import Analyzer
from ..functions.porter2 import stem


@dataclass(frozen=True)
class Query:
    words: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]


def query_words(text: str, analyzer: Analyzer = Analyzer()) -> list[str]:
    """ASCII words; stop words go by case, before lower case; so Arabic gives none, and 'The' stays where 'the' goes."""
    found = [w for w in re.split(r"[\s\W]", text, flags=re.ASCII) if w and w not in analyzer.stop_words]
    cut = [w[: analyzer.other_chars].lower() for w in found]
    return [stem(w) for w in cut] if analyzer.stem else cut


def split_quotes(text: str) -> tuple[str, list[str]]:
    """The loose text and the quoted pieces.

    Quotes are set apart by spaces; the text breaks at each space that an even number of
    quotes follows, and a piece that begins and ends with a quote is a phrase. An
    unbalanced quote behind words leaves words; a lone quote is an empty phrase.
    """
    spaced = text.replace('"', ' " ')
    left, pieces, now = spaced.count('"'), [], []
    for c in spaced:
        left -= c == '"'
        if c == " " and left % 2 == 0:
            pieces.append("".join(now))
            now = []
        else:
            now.append(c)
    found = [p for p in (x.strip() for x in [*pieces, "".join(now)]) if p]
    quoted = [p for p in found if p[0] == p[-1] == '"']
    return " ".join(p for p in found if not p[0] == p[-1] == '"'), [p.strip('" ') for p in quoted]


def parsed(text: Column, analyzer: Analyzer = Analyzer()) -> Column:
    """The same as ``parse`` for a column of texts, natively but for stems, which the words don't have yet: a struct of words and phrases.

    Pieces between quotes stand in and out of them in turn, counted from the end of the text; a first
    piece that is neither blank nor behind a quote is loose.
    """
    pieces = F.split(F.coalesce(text, F.lit("")), '"', -1)
    last = F.size(pieces) - 1
    inside = lambda x, i: (F.pmod(last - i, F.lit(2)) == 1) & ((i > 0) | x.rlike(r"^\s*$"))
    words = lambda x: analysis.query_words(x, analyzer)
    loose = F.array_join(F.filter(pieces, lambda x, i: ~inside(x, i)), " ")
    quoted = F.transform(F.filter(F.transform(pieces, lambda x, i: F.struct(inside(x, i).alias("inside"), x.alias("x"))), lambda p: p["inside"]), lambda p: p["x"])
    return F.struct(words(loose).alias("words"), F.transform(quoted, words).alias("phrases"))


def parse(text: str, analyzer: Analyzer = Analyzer()) -> Query:
    loose, quoted = split_quotes(text)
    return Query(tuple(query_words(loose, analyzer)), tuple(tuple(query_words(q, analyzer)) for q in quoted))
