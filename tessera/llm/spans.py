"""Matches of a pattern as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def find_matches(text: Column, pattern: str, group: int = 0, tests: tuple[str, ...] = ()) -> Column:
    """Leftmost non-overlapping matches in order, as an array of (gap, len, match, ok): code points between
    the last match's end and this one's start, its length, the matched string, and whether its group matches
    all tests. Empty for a text without matches, and for null.

    What lies between two matches comes from a split by the same pattern. Positions are running sums of
    gaps and lengths, which are left to a window over the matches as rows: a fold over the array would
    copy what it has for every match. Only texts with a match pay for more than a search.
    """
    names = ["gap", "match", "inner"]
    arrays = [F.split(text, pattern, -1), *(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in ((0, group) if group else (0,)))]

    def part(x: Column) -> Column:
        ok = F.lit(True)
        for test in tests:
            ok = ok & x["inner" if group else "match"].rlike(test)
        return F.struct(F.length(x["gap"]).cast("long").alias("gap"), F.length(x["match"]).cast("long").alias("len"), x["match"].alias("match"), ok.alias("ok"))

    parts = F.transform(F.arrays_zip(*[a.alias(n) for a, n in zip(arrays, names, strict=False)]), part)
    parts = F.filter(parts, lambda x: x["len"].isNotNull())  # the last gap has no match
    none = F.array().cast("array<struct<gap: bigint, len: bigint, match: string, ok: boolean>>")
    return F.coalesce(F.when(text.rlike(pattern), parts), none)
