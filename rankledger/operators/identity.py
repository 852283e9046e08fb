"""Identity resolution in stages: stable keys, explicit links, exact evidence, mutual unique similarity.

The quadratic loops over components become equi-joins: at 98 % similarity names under 50 characters must be equal, so
only longer names need an edit distance, and they meet on (school, length band) first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canon import numbered
from ..functions.text import similar_98
from ..runtime import store
from .checks import latest


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) by alternating large-star and small-star steps; component is the smallest id.

    Every step is an aggregate over neighbours with map-side combine and shortens paths, so a chain of n vertices takes
    O(log n) rounds. Each round's edges are written, so a lost executor recomputes nothing.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    vertices = store(pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct(), "cc-ids")
    now = store(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    while True:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        step = store(small.distinct(), "cc")
        mark = step.df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        now.drop()
        now = step
        if mark == before:
            break
        before = mark
    return vertices.df.join(now.df.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def exact_groups(people: DataFrame, keys: list[str], person: str) -> DataFrame:
    """(person, root): people that agree on all keys; root is the smallest of them. A group-by, no pairs."""
    roots = people.groupBy(*keys).agg(F.min(person).alias("root"))
    return people.join(roots, keys).select(person, "root")


def similar_pairs(people: DataFrame, block: str, name: str, person: str) -> DataFrame:
    """(left, right) of one block whose different names are at least 98 % alike, left being the smaller id.

    Such names have 49 characters or more, and a shorter one of m characters is at most d = m / 49 edits away from the
    longer one. Cut into d + 1 segments, one of them stands unchanged in the other with at most as many edits before it
    as there are segments before it, and as many behind it as behind, so segment i is looked for at most i places off the
    begin and at most d - i off the end. Segments of (block, m, i) meet as 64-bit hashes, beside which only the hash of
    the row is carried; names are joined to the rows that met, and compared. The joins are sorted by hint: Spark's sizes
    know neither how many rows an explode makes nor how long a name is, and it would broadcast what the driver cannot hold.
    """
    longs = people.where(F.char_length(name) >= 49).select(F.col(person).alias("_id"), F.col(block).alias("_b"), F.col(name).alias("_n")).distinct()
    longs = longs.withColumn("_v", F.xxhash64("_id", "_b", "_n"))
    edits = lambda m: F.floor(m / 49).cast("int")
    begin = lambda i: F.floor(i * F.col("_m") / (edits(F.col("_m")) + 1)).cast("int")
    size, i, d = F.char_length("_n"), F.col("_i"), edits(F.col("_m"))
    segment = lambda at: F.xxhash64("_b", "_m", "_i", F.substring("_n", at + 1, begin(i + 1) - begin(i))).alias("_k")
    indexed = longs.select("_v", "_b", "_n", size.alias("_m")).select("*", F.explode(F.sequence(F.lit(0), d)).alias("_i"))
    indexed = indexed.select(F.col("_v").alias("_l"), segment(begin(i)))
    probes = longs.select("_v", "_b", "_n", F.explode(F.sequence(F.greatest(size - edits(size), F.lit(49)), size)).alias("_m"))
    more = size - F.col("_m")
    probes = probes.where(more <= d).select("*", F.explode(F.sequence(F.lit(0), d)).alias("_i"))
    probes = probes.select("*", F.explode(F.sequence(F.greatest(-i, more - d + i), F.least(i, more + d - i))).alias("_o"))
    probes = probes.select(F.col("_v").alias("_r"), segment(begin(i) + F.col("_o")))
    met = indexed.hint("merge").join(probes, "_k").where("_l <> _r").select(F.least("_l", "_r").alias("_l"), F.greatest("_l", "_r").alias("_r")).distinct()
    side = lambda v, s: longs.select(F.col("_v").alias(v), F.col("_id").alias(f"_{s}id"), F.col("_b").alias(f"_{s}b"), F.col("_n").alias(f"_{s}n")).hint("merge")
    pairs = met.join(side("_l", "l"), "_l").join(side("_r", "r"), "_r").where("_lb = _rb AND _lid <> _rid AND _ln <> _rn").where(similar_98(F.col("_ln"), F.col("_rn")))
    return pairs.select(F.least("_lid", "_rid").alias("left"), F.greatest("_lid", "_rid").alias("right")).distinct()


def similar_across(people: DataFrame, scope: str, name: str, person: str) -> DataFrame:
    """(name, other, scopes): names that are equal or 98 % alike and occur in several scopes; a report without pairs of people.

    Equal names meet by a group-by: the name itself, and its number of scopes. Different ones meet by ``similar_pairs``
    over distinct names, and count if their scopes are not one and the same.
    """
    named = people.groupBy(name).agg(F.min(scope).alias("_lo"), F.max(scope).alias("_hi"), F.count_distinct(scope).alias("_n")).withColumnRenamed(name, "_name")
    equal = named.where("_n > 1").select("_name", F.col("_name").alias("_other"), "_n")
    one = F.lit(0).alias("_b")
    near = similar_pairs(named.select("_name", F.col("_name").alias("_key"), one), "_b", "_name", "_key").toDF("_name", "_other")
    a, b = named.select("_name", F.col("_lo").alias("_alo"), F.col("_hi").alias("_ahi")), named.select(F.col("_name").alias("_other"), F.col("_lo").alias("_blo"), F.col("_hi").alias("_bhi"))
    met = near.join(a.hint("merge"), "_name").join(b.hint("merge"), "_other").where("NOT (_alo = _ahi AND _blo = _bhi AND _alo = _blo)")
    return equal.unionByName(met.select("_name", "_other", F.lit(2).cast("bigint").alias("_n"))).toDF("name", "other", "scopes")


def stable_conflicts(people: DataFrame, key: str, name: str, event: str, entry: str) -> DataFrame:
    """(key, code) of stable keys whose records contradict each other: NAMES_DIFFER, else ENTRIES_DIFFER in one event.

    Minimum and maximum tell that a pair differs, so no pairs are formed.
    """
    keyed = people.where(F.col(key).isNotNull())
    names = keyed.groupBy(key).agg((F.min(name) != F.max(name)).alias("_names"))
    twice = contradictory(keyed, key, event, entry).withColumn("_twice", F.lit(True))
    code = F.when(F.col("_names"), "NAMES_DIFFER").when(F.col("_twice"), "ENTRIES_DIFFER")
    return names.join(twice, key, "left").select(key, code.alias("code")).where("code IS NOT NULL")


#: Keys by which rows of result sets are one source person: within a collected set, within a packet, within a season's evidence.
PERSON_KEYS = {"set": ["result_set_id", "source_entry_id"], "packet": ["snapshot_id", "event_key", "source_entry_id"], "season": ["source_person_key", "edition_id", "event_key"]}


def source_people(results: DataFrame, variant: str, order: list[str]) -> DataFrame:
    """One row a source person by one of PERSON_KEYS: the last in the given order; rows without the key's columns name nobody."""
    keys = PERSON_KEYS[variant]
    return latest(results.where(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])), keys, order)


def evidence_ids(people: DataFrame, order: list[str]) -> DataFrame:
    """``people`` with ``evidence_id``, the place from 1 in the total order of the columns (nulls first)."""
    return numbered(people, order, "evidence_id")


def resolve(people: DataFrame, links: DataFrame, key: str = "source_person_key") -> tuple[DataFrame, DataFrame]:
    """((person, competitor), (code, subject)): all stages in order.

    people: person, source_person_key, provider, name, school, event, entry. links: left_key, right_key.

    1. records of one stable key are one person; contradictions among them are reported (STABLE_ID_CONFLICT);
    2. explicit links join keys; a link that is SELF, DUPLICATE or DANGLING, and one whose component would hold two
       keys of one provider or two entries in one event (CONFLICT), is reported, and its component is not joined;
    3. a name that occurs at several schools, in different components, is reported (AMBIGUOUS) and joins nothing;
    4. components of equal name and school join, unless the whole would contradict itself;
    5. components that are each other's only 98 % match at a school join likewise.
    """
    node = F.coalesce(F.concat(F.lit("k:"), F.col(key)), F.concat(F.lit("p:"), F.col("person").cast("string")))
    rows = store(people.withColumn("_node", node), "resolve-people")
    conflicts = stable_conflicts(rows.df, key, "name", "event", "entry").select(F.lit("STABLE_ID_CONFLICT").alias("code"), F.col(key).alias("subject"))
    wrong = explicit_edge_errors(links, rows.df.where(F.col(key).isNotNull()), key)
    fine = links.join(wrong, ["left_key", "right_key"], "left_anti").select(F.concat(F.lit("k:"), "left_key").alias("a"), F.concat(F.lit("k:"), "right_key").alias("b"))
    joined = store(connected(fine), "resolve-links")
    placed = rows.df.join(joined.df.withColumnRenamed("id", "_node"), "_node", "left").withColumn("_c", F.coalesce("component", "_node")).drop("component")
    several = placed.where(F.col(key).isNotNull()).groupBy("_c", "provider").agg((F.min(key) != F.max(key)).alias("_k")).where("_k").select("_c")
    bad = store(several.unionByName(contradictory(placed, "_c", "event", "entry")).join(joined.df.select(F.col("component").alias("_c")), "_c", "left_semi").distinct(), "resolve-bad")
    placed = store(placed.join(bad.df.withColumn("_bad", F.lit(True)), "_c", "left").withColumn("_c", F.when(F.col("_bad"), F.col("_node")).otherwise(F.col("_c"))).drop("_bad"), "resolve-placed")
    ambiguous = placed.df.groupBy("name").agg((F.min("school") != F.max("school")).alias("_s"), (F.min("_c") != F.max("_c")).alias("_d")).where("_s AND _d")
    exact = store(merge_exact(placed.df, "_c", ["name", "school"], "event", "entry"), "resolve-exact")
    merged = store(placed.df.join(exact.df, "_c").drop("_c").withColumnRenamed("merged", "_c"), "resolve-merged")
    pairs = similar_pairs(merged.df.select("person", "school", "name"), "school", "name", "person")
    at = merged.df.select("person", "_c").distinct()
    edges = pairs.join(at.toDF("left", "a"), "left").join(at.toDF("right", "b"), "right").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    alike = store(mutual_unique(edges, "a", "b"), "resolve-alike")
    both = alike.df.select(F.col("b").alias("_c"), "a").unionByName(alike.df.select(F.col("a").alias("_c"), "a"))
    clash = contradictory(merged.df.join(both, "_c").select("a", "event", "entry"), "a", "event", "entry")
    last = alike.df.join(clash, "a", "left_anti").select(F.col("b").alias("_c"), F.col("a").alias("_to"))
    members = merged.df.join(last, "_c", "left").select("person", F.coalesce("_to", "_c").alias("competitor"))
    codes = [conflicts, wrong.select(F.concat(F.lit("EDGE_"), "code").alias("code"), F.concat_ws("|", "left_key", "right_key").alias("subject")),
             bad.df.select(F.lit("EDGE_CONFLICT").alias("code"), F.col("_c").alias("subject")), ambiguous.select(F.lit("AMBIGUOUS").alias("code"), F.col("name").alias("subject"))]
    return members, reduce(DataFrame.unionByName, codes)


def mutual_unique(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges whose two ends have no other edge."""
    ends = edges.select(F.col(a).alias("_x")).unionByName(edges.select(F.col(b).alias("_x")))
    single = ends.groupBy("_x").count().where("count = 1").select("_x")
    return edges.join(single, edges[a] == single["_x"], "left_semi").join(single, edges[b] == single["_x"], "left_semi")


def contradictory(members: DataFrame, component: str, event: str, entry: str) -> DataFrame:
    """Components with two entries in one event: distinct counts instead of pairs."""
    return members.groupBy(component, event).agg(F.min(entry).alias("_lo"), F.max(entry).alias("_hi")).where("_lo <> _hi").select(component).distinct()


def merge_exact(members: DataFrame, component: str, keys: list[str], event: str, entry: str) -> DataFrame:
    """(component, merged): components with equal evidence join, unless the whole cluster would contradict itself.

    Clusters are components of components; a contradictory one is left apart as a whole.
    """
    evidence = members.select(component, *keys).distinct()
    heads = evidence.groupBy(*keys).agg(F.min(component).alias("_h"))
    clusters = store(connected(evidence.join(heads, keys).select(F.col(component).alias("a"), F.col("_h").alias("b"))), "clusters")
    placed = members.join(clusters.df, members[component] == clusters.df["id"]).select(members[component], F.col("component").alias("_cluster"), event, entry)
    bad = contradictory(placed, "_cluster", event, entry).withColumn("_bad", F.lit(True))
    flags = clusters.df.join(bad, clusters.df["component"] == bad["_cluster"], "left")
    return flags.select(F.col("id").alias(component), F.when(F.coalesce("_bad", F.lit(False)), F.col("id")).otherwise(F.col("component")).alias("merged"))


def competitors(members: DataFrame, component: str, key: str, sort_key: str, display: str) -> DataFrame:
    """One row a component: id from its smallest key, display from the smallest sort key, sorted distinct keys."""
    return members.groupBy(component).agg(
        F.min(key).alias("_seed"), F.min_by(display, F.struct(sort_key, display)).alias("display"), F.array_sort(F.collect_set(key)).alias("keys"), F.count(F.lit(1)).alias("records"),
    ).withColumn("competitor_id", F.concat(F.lit("competitor:"), F.sha2(F.col("_seed").cast("string"), 256))).drop("_seed")


def explicit_edge_errors(edges: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(left_key, right_key, code) of explicit links that are SELF, DUPLICATE or DANGLING; the first code that fits."""
    norm = edges.select("left_key", "right_key", F.least("left_key", "right_key").alias("_a"), F.greatest("left_key", "right_key").alias("_b"))
    twice = norm.groupBy("_a", "_b").count().where("count > 1").select("_a", "_b", F.lit(True).alias("_dup"))
    here = lambda c, name: known.select(F.col(key).alias(c)).distinct().withColumn(name, F.lit(True))
    norm = norm.join(twice, ["_a", "_b"], "left").join(here("left_key", "_l"), "left_key", "left").join(here("right_key", "_r"), "right_key", "left")
    code = F.when(F.col("left_key") == F.col("right_key"), "SELF").when(F.col("_dup"), "DUPLICATE").when(F.col("_l").isNull() | F.col("_r").isNull(), "DANGLING")
    return norm.withColumn("code", code).where("code IS NOT NULL").select("left_key", "right_key", "code").distinct()
