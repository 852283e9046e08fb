"""One candidate for every slot of a row so that the chosen vectors add up to the row's totals, if there is exactly one way."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _choose(slots: list[list[tuple[int, ...]]], totals: tuple[int, ...]) -> tuple[list[int] | None, str | None]:
    """(index of the chosen candidate of each slot, code). Equal candidates of a slot are one, the first.

    The reachable sums are carried from slot to slot, each with the number of ways (two stand for many) and one of them;
    sums beyond the totals are left out, so there are never more than the totals' product.
    """
    reached: dict[tuple[int, ...], tuple[int, tuple[int, ...]]] = {(0,) * len(totals): (1, ())}
    for candidates in slots:
        following: dict[tuple[int, ...], tuple[int, tuple[int, ...]]] = {}
        first = {c: i for i, c in reversed(list(enumerate(candidates)))}
        for at, (ways, path) in reached.items():
            for c, i in first.items():
                to = tuple(a + b for a, b in zip(at, c))
                if all(a <= b for a, b in zip(to, totals)):
                    had = following.get(to)
                    following[to] = (min(ways + (had[0] if had else 0), 2), had[1] if had else (*path, i))
        reached = following
    ways, path = reached.get(totals, (0, ()))
    return (list(path), None) if ways == 1 else (None, "AMBIGUOUS" if ways else "NO_COMBINATION")


def unique_choices(rows: DataFrame, key: str, slots: str, totals: str) -> DataFrame:
    """(key, chosen array<int>, code) of rows with slots (array<array<array<int>>>: candidates of non-negative vectors) and totals (array<int>).

    Each row is solved by itself. NO_COMBINATION where nothing adds up, a slot has no candidate, or slots or totals are
    null; AMBIGUOUS where several combinations of different candidates do; a row without slots fits totals of zero.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, s, t in zip(b["key"], b["slots"], b["totals"]):
                known = s is not None and t is not None
                found = _choose([[tuple(int(x) for x in c) for c in slot] for slot in s], tuple(int(x) for x in t)) if known else (None, "NO_COMBINATION")
                out.append((k, *found))
            yield pd.DataFrame(out, columns=["key", "chosen", "code"])

    typed = rows.select(F.col(key).alias("key"), F.col(slots).cast("array<array<array<int>>>").alias("slots"), F.col(totals).cast("array<int>").alias("totals"))
    return typed.mapInPandas(run, f"key {kind}, chosen array<int>, code string").withColumnRenamed("key", key)
