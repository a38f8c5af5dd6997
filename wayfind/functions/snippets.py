"""Snippets: the words around the first hits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HITS, AROUND = 5, 8


def first_hits(positions: Column, most: int = HITS) -> Column:
    return F.slice(F.array_sort(positions), 1, most)


def snippet(tokens: Column, positions: Column, most: int = HITS, around: int = AROUND) -> Column:
    """For each of the first hits, the words from ``around`` before it up to ``around`` behind it, then '... '."""
    n = F.size(tokens)

    def piece(at: Column) -> Column:
        start = F.greatest(F.lit(0), at - around)
        # a hit behind the end, of a page cut since, must not ask for a negative length
        length = F.greatest(F.lit(0), F.least(n, at + around) - start)
        return F.concat(F.array_join(F.slice(tokens, start + 1, length), " "), F.lit("... "))

    return F.array_join(F.transform(first_hits(positions, most), piece), "")
