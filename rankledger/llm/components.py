"""Groups of directly or indirectly linked records by low-diameter decomposition.

One level: vertices with a single neighbour are hung on it, until the next level. Every other vertex draws a shift from
an exponential distribution (cut off at ``reach``) and would start its own cluster at time ``reach - shift``; clusters
grow one edge per time unit, and a vertex joins the cluster that reaches it first. So every cluster is connected and of
radius at most ``reach``; growth ends as soon as no label changes. The clusters become the vertices of the next level,
joined by the edges between clusters, until no such edge is left; the levels' assignments are composed, the smallest
level first, so that the names are joined once.

A growth step is one join of the edges with the labels and one minimum per vertex, by hash aggregation with map-side
combine: a vertex with a third of all edges is split like any skewed join key, and no component is gathered anywhere.
Links and labels never reach the driver, only whether edges or changes are left.

Cases: rows with a null end link nothing; a link of a record to itself makes the record known and nothing more;
repeated links count once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Stored, store

#: Rate of the exponential shifts and their cut-off: a share of exp(-1.5) of the shifts is cut off, and a level leaves about a third of its edges.
BETA = 0.3
REACH = 5


def vertex_ids(names: DataFrame) -> tuple[Stored, int]:
    """(name, _right, _v) of every distinct name of (name, _right), with a 64-bit hash as id; takes the next seed until no two names share one."""
    seed = 0
    distinct = names.groupBy("name").agg(F.bool_or("_right").alias("_right"))
    while True:
        ids = store(distinct.withColumn("_v", F.xxhash64("name", F.lit(seed))), "cc-names")
        if ids.df.groupBy("_v").count().where("count > 1").isEmpty():
            return ids, seed
        ids.drop()
        seed += 1


def _start(vertex: str, level: int, beta: float, reach: int):
    """The time a vertex starts at; vertices whose shift is cut off start at 0 and a trifle, so that equal times are rare."""
    u = (F.pmod(F.xxhash64(F.col(vertex), F.lit(f"shift-{level}")), F.lit(2**52)).cast("double") + 1) / float(2**52 + 1)
    return F.greatest(F.lit(float(reach)) + F.log(u) / beta, u * 1e-6)


def _hang(edges: DataFrame) -> tuple[Stored, Stored]:
    """Stored (_v, _c) of vertices with one neighbour, hung on it, and the edges between all others.

    Two vertices that only have each other hang on the smaller one. Edges hold both directions.
    """
    degrees = store(edges.groupBy("_a").agg(F.count(F.lit(1)).alias("_n"), F.min("_b").alias("_b")), "cc-degrees")
    inner = degrees.df.where("_n > 1").select("_a")
    held = inner.select(F.col("_a").alias("_b"), F.lit(True).alias("_held"))
    single = degrees.df.where("_n = 1").join(held, "_b", "left")
    hung = store(single.select(F.col("_a").alias("_v"), F.when(F.col("_held"), F.col("_b")).otherwise(F.least("_a", "_b")).alias("_c")), "cc-hung")
    rest = store(edges.join(inner, "_a", "left_semi").join(inner.withColumnRenamed("_a", "_b"), "_b", "left_semi").select("_a", "_b"), "cc-edges")
    degrees.drop()
    return hung, rest


def _grow(edges: DataFrame, level: int, beta: float, reach: int) -> Stored:
    """(_v, _t, _c): the cluster of every vertex that has an edge; edges hold both directions.

    Only vertices whose label got better in the step before make offers in the next one.
    """
    own = edges.select(F.col("_a").alias("_v")).distinct()
    labels = store(own.select("_v", _start("_v", level, beta, reach).alias("_t"), F.col("_v").alias("_c"), F.lit(True).alias("_new")), "cc-labels")
    for step in range(reach):
        senders = labels.df.where(F.col("_new") & (F.col("_t") + 1 <= reach)).select(F.col("_v").alias("_a"), "_t", "_c")
        offers = edges.join(senders, "_a").groupBy(F.col("_b").alias("_v")).agg(F.min("_t").alias("_to"), F.min_by("_c", "_t").alias("_co"))
        better = F.coalesce(F.col("_to") + 1 < F.col("_t"), F.lit(False))
        met = labels.df.select("_v", "_t", "_c").join(offers, "_v", "left")
        grown = store(met.select("_v", F.when(better, F.col("_to") + 1).otherwise(F.col("_t")).alias("_t"), F.when(better, F.col("_co")).otherwise(F.col("_c")).alias("_c"), better.alias("_new")), "cc-labels")
        labels.drop()
        labels = grown
        if step + 1 < reach and labels.df.where("_new").isEmpty():
            break
    return labels


def _then(first: DataFrame, second: DataFrame) -> DataFrame:
    """(_v, _c): first's target, or what second makes of it."""
    return first.join(second.select(F.col("_v").alias("_c"), F.col("_c").alias("_d")), "_c", "left").select("_v", F.coalesce("_d", "_c").alias("_c"))


def components(links: DataFrame, left: str, right: str, beta: float = BETA, reach: int = REACH, distinct: bool = False) -> DataFrame:
    """(name, _c, _right) for every non-null end of a link: ``_c`` is equal exactly for linked records.

    left and right are columns of links; names of both sides are one set, compared exactly; ``_right`` tells whether a
    name occurs on the right side. distinct: links are stored and free of repeats already.
    """
    pairs = links.select(F.col(left).cast("string").alias("l"), F.col(right).cast("string").alias("r")).where("l IS NOT NULL AND r IS NOT NULL")
    stored = None if distinct else store(pairs.distinct(), "cc-pairs")
    pairs = stored.df if stored else pairs
    side = lambda c, is_right: pairs.select(F.col(c).alias("name"), F.lit(is_right).alias("_right"))
    ids, seed = vertex_ids(side("l", False).unionByName(side("r", True)))
    one_way = pairs.select(F.xxhash64("l", F.lit(seed)).alias("_a"), F.xxhash64("r", F.lit(seed)).alias("_b")).where("_a <> _b")
    both = F.explode(F.array(F.struct("_a", "_b"), F.struct(F.col("_b").alias("_a"), F.col("_a").alias("_b")))).alias("_e")
    edges = store(one_way.select(both).select("_e._a", "_e._b").distinct(), "cc-edges")
    if stored:
        stored.drop()
    levels: list[tuple[Stored, Stored]] = []
    while not edges.df.isEmpty():
        hung, rest = _hang(edges.df)
        edges.drop()
        labels = _grow(rest.df, len(levels), beta, reach)
        near = labels.df.select(F.col("_v").alias("_a"), F.col("_c").alias("_ca"))
        far = labels.df.select(F.col("_v").alias("_b"), F.col("_c").alias("_cb"))
        edges = store(rest.df.join(near, "_a").join(far, "_b").where("_ca <> _cb").select(F.col("_ca").alias("_a"), F.col("_cb").alias("_b")).distinct(), "cc-edges")
        rest.drop()
        levels.append((hung, labels))
    edges.drop()
    whole: Stored | None = None
    for hung, labels in reversed(levels):
        inner = _then(labels.df.select("_v", "_c"), whole.df) if whole else labels.df.select("_v", "_c")
        inner = store(inner, "cc-inner")
        following = store(_then(hung.df, inner.df).unionByName(inner.df), "cc-composed")
        for done in (hung, labels, inner, *([whole] if whole else [])):
            done.drop()
        whole = following
    if whole is None:
        return ids.df.select("name", F.col("_v").alias("_c"), "_right")
    return ids.df.join(whole.df, "_v", "left").select("name", F.coalesce("_c", "_v").alias("_c"), "_right")
