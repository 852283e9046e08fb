"""Items packed into fixed-capacity containers: few-document patterns fitted by non-negative least squares.

Only the histogram of item sizes reaches the driver, which has at most ``capacity`` rows whatever the corpus. There:

1. sizes are binned to units, all patterns of one to four bins that fill a container are enumerated, and their repeat
   counts are fitted to the histogram by non-negative least squares and rounded;
2. items of less than a container's ``PARTS``-th part that are left are too many for patterns of few documents. They are
   packed by the same method into blocks of that part (and blocks of blocks, if need be); the blocks are items like others
   when what is left is fitted again, ``FITS`` times, each time by patterns that leave one unit more;
3. each pattern draws exact sizes from its bins, so the space it leaves is known to the token;
4. what the patterns leave over, and the smallest items (a share of all tokens, kept back for that), is packed by size,
   largest first, into the tightest space that holds it, new containers being opened where none does;
5. all this is done for each of ``GRIDS`` and ``RESERVES``; of the plans whose patterns place ``LEAST_FITTED`` of the
   tokens (of all plans, if none does) the one with the fewest containers stands.

The result is a list of recipes (sizes and how many containers hold them). On the executors every item gets its rank
among the items of its size, counted in buckets so that no size, however frequent, meets in one task, and the rank
finds its container by binary search in the recipes.

Cases: an item larger than the capacity is split into full containers and one remainder, no other item is split; an
item of size zero lies in some container without taking space (container 0 if there is none); null sizes count as
zero; every row is an item of its own; no capacities or an empty table give an empty result; a capacity that is not
between 1 and 2^20 - 1 is refused; other columns play no part.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import small, store

#: (units, most items of a pattern) that are tried.
GRIDS = ((64, 4), (128, 3))
#: A container is divided into so many blocks.
PARTS = 4
#: Most fits of patterns to what is left.
FITS = 4
#: Shares of the tokens, in the smallest items, that are kept back to fill what the patterns leave; all are tried.
RESERVES = (0.03, 0.1)
#: Share of the tokens that patterns are to place.
LEAST_FITTED = 0.8
#: Capacities are below this.
CAPACITIES = 1 << 20
#: Rows of one ranking bucket, about.
BUCKET_ROWS = 200_000


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Lawson-Hanson: minimise |a x - b| over x >= 0."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    slope = a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(slope).max(initial=0.0)))
    for _ in range(rounds):
        if passive.all() or slope[~passive].max() <= tol:
            break
        passive[np.argmax(np.where(passive, -np.inf, slope))] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if not passive.any() or z[passive].min() > 0:
                break
            low = passive & (z <= 0)
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = z
        slope = a.T @ (b - a @ x)
    return x


@dataclass
class Recipe:
    """``count`` containers that each hold ``sizes`` (size -> how many); ``fitted``: so many of their tokens are there by a pattern."""

    sizes: dict[int, int]
    count: int
    fitted: int = 0

    @property
    def used(self) -> int:
        return sum(s * m for s, m in self.sizes.items())


@cache
def patterns(units: int, depth: int) -> list[tuple[int, ...]]:
    """One to ``depth`` bins, largest first, that fill ``units`` exactly."""

    def rest(space: int, largest: int, n: int) -> list[tuple[int, ...]]:
        if n == 1:
            return [(space,)] if space <= largest else []
        out = [(space,)] if space <= largest else []
        for first in range(min(largest, space - 1), -(-space // n) - 1, -1):
            out += [(first, *more) for more in rest(space - first, first, n - 1)]
        return out

    return sorted(rest(units, units, depth), key=lambda p: (len(p), p))


def plan(histogram: dict[int, int], capacity: int, grids: tuple[tuple[int, int], ...] = GRIDS) -> list[Recipe]:
    """Recipes that hold every item of sizes 1 to capacity exactly once."""
    items = {s: n for s, n in histogram.items() if 0 < s <= capacity and n > 0}
    least = LEAST_FITTED * sum(s * n for s, n in items.items())
    plans = [_plan(dict(items), capacity, grid, share) for grid in grids for share in RESERVES]
    return min(plans, key=lambda rs: (sum(r.fitted * r.count for r in rs) < least, sum(r.count for r in rs)))


def _plan(left: dict[int, int], capacity: int, grid: tuple[int, int], share: float) -> list[Recipe]:
    back = _reserve(left, share)
    recipes = _fitted(left, capacity, grid)
    for s, n in back.items():
        left[s] = left.get(s, 0) + n
    return _fill(recipes, left, capacity)


def _reserve(left: dict[int, int], share: float) -> dict[int, int]:
    """Takes the smallest items, up to a share of all tokens, from ``left``."""
    rest, back = int(share * sum(s * n for s, n in left.items())), {}
    for s in sorted(left):
        n = min(left[s], rest // s)
        if not n:
            break
        back[s] = n
        rest -= s * n
        left[s] -= n
        if not left[s]:
            del left[s]
    return back


def _fitted(left: dict[int, int], capacity: int, grid: tuple[int, int]) -> list[Recipe]:
    """Takes from ``left`` what the rounded patterns hold."""
    part = capacity // PARTS
    kinds: dict[int, list[Recipe]] = defaultdict(list)  # what a slot of a size can hold: an item, or a block of that many tokens
    out: list[Recipe] = []

    def fit(slack: int) -> None:
        for s, n in left.items():
            kinds[s].append(Recipe({s: 1}, n))
        left.clear()
        out.extend(_fit_once(kinds, capacity, grid, slack))
        _single_items(kinds, left)

    fit(0)
    small = {s: n for s, n in left.items() if s <= part}
    if part >= 2 * PARTS and small:
        for s in small:
            del left[s]
        for block in _fitted(small, part, grid):
            kinds[block.used].append(block)
        for s, n in small.items():  # what fits in no block stays an item
            left[s] = left.get(s, 0) + n
    for slack in range(FITS):
        fit(slack)
    _single_items(kinds, left)
    for blocks in kinds.values():  # blocks without a place are taken apart
        for block in blocks:
            for s, m in block.sizes.items():
                left[s] = left.get(s, 0) + m * block.count
    return out


def _single_items(kinds: dict[int, list[Recipe]], left: dict[int, int]) -> None:
    """Moves the items from ``kinds`` back to ``left``; blocks stay."""
    for size in list(kinds):
        blocks = []
        for k in kinds[size]:
            if k.fitted:
                blocks.append(k)
            else:
                left[size] = left.get(size, 0) + k.count
        if blocks:
            kinds[size] = blocks
        else:
            del kinds[size]


def _fit_once(kinds: dict[int, list[Recipe]], capacity: int, grid: tuple[int, int], slack: int) -> list[Recipe]:
    """One fit of all patterns to what is there; takes from ``kinds`` what they hold."""
    width = -(-capacity // grid[0])
    units = capacity // width  # so the sizes of a pattern's bins never exceed the capacity
    bins: dict[int, list[int]] = defaultdict(list)
    for s in sorted(kinds):
        bins[-(-s // width)].append(s)
    have = {s: sum(k.count for k in kinds[s]) for s in kinds}
    if units <= slack:
        return []
    usable = [p for p in patterns(units - slack, grid[1]) if all(q in bins for q in p)]
    if not usable:
        return []
    rows = {b: i for i, b in enumerate(sorted(bins))}
    target = np.array([sum(have[s] for s in bins[b]) for b in rows], dtype=float)
    a = np.zeros((len(rows), len(usable)))
    for j, p in enumerate(usable):
        for b in p:
            a[rows[b], j] += 1
    weights = np.sqrt(np.array(sorted(bins), dtype=float))[:, None]  # a large item left over costs more than a small one
    fitted = nnls(a * weights, target * weights[:, 0])
    out: list[Recipe] = []
    for times in (np.floor(fitted + 1e-6), np.ceil(fitted - 1e-6) - np.floor(fitted + 1e-6)):
        for j in np.argsort(-times * 1e6 - fitted, kind="stable"):
            if times[j] >= 1:
                _draw(out, [bins[b] for b in usable[j]], kinds, have, int(times[j]))
    return out


def _draw(out: list[Recipe], slots: list[list[int]], kinds: dict[int, list[Recipe]], have: dict[int, int], times: int) -> None:
    """``times`` containers with one size of each slot, if they last; runs of equal contents stay together."""
    while times > 0:
        chosen: list[int] = []
        for i, sizes in enumerate(slots):
            free = [s for s in sizes if have[s] > chosen.count(s)]
            if not free:
                return
            chosen.append(free[-1] if i % 2 == 0 else free[0])
        picked = [kinds[s][-1] for s in chosen]
        n = min(times, *[k.count // sum(q is k for q in picked) for k in picked])
        if not n:  # too few of one content for all its slots: one container, with whatever contents are next
            n, picked = 1, []
            for s in chosen:
                picked.append(next(k for k in reversed(kinds[s]) if k.count > sum(q is k for q in picked)))
        held: dict[int, int] = defaultdict(int)
        for s, k in zip(chosen, picked):
            k.count -= n
            have[s] -= n
            for size, m in k.sizes.items():
                held[size] += m
        for s in set(chosen):
            kinds[s] = [k for k in kinds[s] if k.count]
            if not kinds[s]:
                del kinds[s]
        out.append(Recipe(dict(held), n, sum(chosen)))
        times -= n


def _fill(recipes: list[Recipe], left: dict[int, int], capacity: int) -> list[Recipe]:
    """Best fit, largest size first, of the rest into open space; containers alike are treated at once."""
    open_by_space: dict[int, list[Recipe]] = defaultdict(list)
    done: list[Recipe] = []
    spaces: list[int] = []

    def add(r: Recipe) -> None:
        space = capacity - r.used
        if space == 0:
            done.append(r)
            return
        if not open_by_space[space]:
            bisect.insort(spaces, space)
        open_by_space[space].append(r)

    for r in recipes:
        add(r)
    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            at = bisect.bisect_left(spaces, s)
            if at == len(spaces):
                each = capacity // s
                if n >= each:
                    add(Recipe({s: each}, n // each))
                if n % each:
                    add(Recipe({s: n % each}, 1))
                n = 0
                break
            space = spaces[at]
            r = open_by_space[space].pop()
            if not open_by_space[space]:
                spaces.pop(at)
            each = min(space // s, n)  # several into one container, as it is the tightest anyway
            k = min(r.count, n // each)
            if k < r.count:
                add(Recipe(r.sizes, r.count - k, r.fitted))
            add(Recipe(r.sizes | {s: r.sizes.get(s, 0) + each}, k, r.fitted))
            n -= each * k
    left.clear()
    return done + [r for rs in open_by_space.values() for r in rs]


@dataclass
class Lookup:
    """Of one pack: sorted starts of (size, rank) ranges and, for each, its first container and items a container."""

    starts: np.ndarray
    base: np.ndarray
    first: np.ndarray
    each: np.ndarray
    containers: int


_RANK_BITS = 40


def lookup(recipes: list[Recipe]) -> Lookup:
    entries, seen, base = [], defaultdict(int), 0
    for r in recipes:
        for s, m in r.sizes.items():
            entries.append(((s << _RANK_BITS) + seen[s], base, seen[s], m))
            seen[s] += r.count * m
        base += r.count
    entries.sort()
    return Lookup(*[np.array([e[i] for e in entries], dtype=np.int64) for i in range(4)], base)


@dataclass
class Fit:
    """How a pack's containers came about."""

    pack_id: int
    capacity: int
    containers: int
    tokens: int
    pattern_tokens: int


def pack(items: DataFrame, key: str, size: str, capacities: list[tuple[int, int]], bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, list[Fit]]:
    """((pack_id, container_id, key, piece, token_from, n_tokens) for every item, its pieces and every (pack_id, capacity), fits)."""
    spark = items.sparkSession
    if key in ("pack_id", "container_id", "piece", "token_from", "n_tokens"):
        raise ValueError(f"the key cannot be named {key}")
    if not capacities:
        return spark.createDataFrame([], f"pack_id bigint, container_id bigint, `{key}` {dict(items.dtypes)[key]}, piece bigint, token_from bigint, n_tokens bigint"), []
    if any(not 0 < c < CAPACITIES for _, c in capacities):
        raise ValueError(f"capacities lie between 1 and {CAPACITIES - 1}")
    options = F.explode(F.array(*[F.struct(F.lit(i).alias("_pack"), F.lit(c).cast("bigint").alias("_cap")) for i, (_, c) in enumerate(capacities)])).alias("_o")
    base = items.select(F.col(key).alias("_key"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("_n"))
    each = base.select("_key", "_n", options).select("_key", "_n", "_o._pack", "_o._cap")
    pieces = each.select("_key", "_n", "_pack", "_cap", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.expr("(_n - 1) div _cap"), F.lit(0)))).alias("_piece"))
    pieces = pieces.withColumn("_size", F.least(F.col("_n") - F.col("_piece") * F.col("_cap"), F.col("_cap")).cast("int")).drop("_n")
    rows = base.count()
    buckets = int(min(max(rows // bucket_rows, 8), 4096))
    pieces = pieces.withColumn("_b", F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"))
    counts = store(pieces.groupBy("_b", "_pack", "_size").agg(F.count(F.lit(1)).alias("_c")), "pack-counts")
    found: list[dict[int, int]] = [defaultdict(int) for _ in capacities]
    for r in counts.df.groupBy("_pack", "_size").agg(F.sum("_c").alias("_c")).collect():  # at most capacity + 1 rows a pack
        found[r["_pack"]][r["_size"]] = r["_c"]
    plans = [plan(found[i], c) for i, (_, c) in enumerate(capacities)]
    fits = [Fit(p, c, sum(r.count for r in rs), sum(r.used * r.count for r in rs), sum(r.fitted * r.count for r in rs)) for (p, c), rs in zip(capacities, plans)]
    tables = [lookup(rs) for rs in plans]
    before = F.sum("_c").over(Window.partitionBy("_pack", "_size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.df.select("_b", "_pack", "_size", F.coalesce(before, F.lit(0)).alias("_off"))
    place = F.row_number().over(Window.partitionBy("_b", "_pack", "_size").orderBy("_key", "_piece")) - 1
    ranked = pieces.repartition("_b").withColumn("_r", place).join(small(offsets), ["_b", "_pack", "_size"]).select("_key", "_pack", "_cap", "_piece", "_size", (F.col("_r") + F.col("_off")).alias("_rank"))
    names = [p for p, _ in capacities]
    key_type = dict(items.dtypes)[key]
    shared = spark.sparkContext.broadcast(tables)  # at most a few recipes for every size below the capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = np.array(names, dtype=np.int64)
        for b in batches:
            which, cap, piece, s, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3, 4, 5))
            container = np.zeros(len(which), dtype=np.int64)
            for p, t in enumerate(shared.value):
                at = np.flatnonzero(which == p)
                container[at] = rank[at] % max(t.containers, 1)  # stands for items without size
                at = at[s[at] > 0]
                if len(at):
                    e = np.searchsorted(t.starts, (s[at] << _RANK_BITS) + rank[at], side="right") - 1
                    container[at] = t.base[e] + (rank[at] - t.first[e]) // t.each[e]
            yield pa.RecordBatch.from_arrays([pa.array(packs[which]), pa.array(container), b.column(0), pa.array(piece), pa.array(piece * cap), pa.array(s)], names=["pack_id", "container_id", key, "piece", "token_from", "n_tokens"])

    return ranked.mapInArrow(run, f"pack_id bigint, container_id bigint, `{key}` {key_type}, piece bigint, token_from bigint, n_tokens bigint"), fits
