"""References to records that do not exist: direct and inherited orphans over a foreign-key graph.

Definitions (all cases are defined, none raises):

* a null reference is no reference and gives no row; an empty string is a reference like any other;
* a child row without an id is still a row, but cannot be named, so it gives no row;
* repeated child rows (same id) count once, with the earliest arrival; if a repeat carries another reference, the
  kind that comes first in ``deleted, missing, late`` stands;
* ``deleted``: tombstones hold the parent key, whatever the date and whether or not the row is still there;
  ``missing``: the parent table has no such key, compared exactly; ``late``: the child's earliest arrival is before
  the parent's earliest (a null arrival on either side is never late);
* inherited orphans: the parent row exists and isn't deleted, but is itself an orphan (deleted, missing or
  inherited; a late parent does exist, so it passes nothing on). Found to a fixpoint, level by level.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import store

DIRECT_KINDS = ("deleted", "missing", "late")
INHERITED = "inherited"


@dataclass(frozen=True)
class Reference:
    """``child.field`` names a key of ``parent``."""

    child: str
    field: str
    parent: str


def _arrivals(df: DataFrame, key: str, arrival: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(arrival).alias("_born"))


def direct_orphans(tables: dict[str, DataFrame], ref: Reference, tombstones: DataFrame, key: str = "id", arrival: str = "ingested_at") -> DataFrame:
    """Rows (row_id, orphan_kind, first_seen) of ``ref`` whose parent is deleted, missing or late.

    The child side is filtered to cases before it is grouped, so only cases are shuffled a second time: the earliest
    row of a late child is itself late, and the other kinds do not depend on the row.
    """
    child = tables[ref.child].select(F.col(key).alias("row_id"), F.col(ref.field).alias("_ref"), F.col(arrival).alias("_at"))
    child = child.where("_ref IS NOT NULL AND row_id IS NOT NULL")
    gone = tombstones.where(F.col("parent_table") == ref.parent).where("row_id IS NOT NULL").select(F.col("row_id").alias("_key"), F.lit(True).alias("_gone"))
    known = _arrivals(tables[ref.parent], key, arrival).withColumn("_here", F.lit(True))
    parent = known.select("_key", "_born", "_here", F.lit(None).cast("boolean").alias("_gone"))
    parent = parent.unionByName(gone.select("_key", F.lit(None).cast("timestamp_ntz").alias("_born"), F.lit(None).cast("boolean").alias("_here"), "_gone"))
    parent = parent.groupBy("_key").agg(F.min("_born").alias("_born"), F.max("_here").alias("_here"), F.max("_gone").alias("_gone"))
    kind = F.when(F.col("_gone"), 0).when(F.col("_here").isNull(), 1).when(F.col("_at") < F.col("_born"), 2)
    cases = child.join(parent, child["_ref"] == parent["_key"], "left").withColumn("_kind", kind).where("_kind IS NOT NULL")
    out = cases.groupBy("row_id").agg(F.min("_kind").alias("_kind"), F.min("_at").alias("first_seen"))
    names = F.element_at(F.array(*[F.lit(k) for k in DIRECT_KINDS]), F.col("_kind") + 1)
    return out.select("row_id", names.alias("orphan_kind"), "first_seen")


def find_orphans(tables: dict[str, DataFrame], references: list[Reference], tombstones: DataFrame, key: str = "id", arrival: str = "ingested_at") -> DataFrame:
    """Every direct and inherited orphan: child_table, row_id, field_name, orphan_kind, period, depth.

    Depth 0 is direct; depth n is inherited over n references. Each level semi-joins the children of the rows that
    the level before newly orphaned; a foreign-key graph without new rows ends the loop, so cycles end as well.
    """
    found = []
    for ref in references:
        found.append(direct_orphans(tables, ref, tombstones, key, arrival).select(F.lit(ref.child).alias("child_table"), "row_id", F.lit(ref.field).alias("field_name"), "orphan_kind", "first_seen", F.lit(0).alias("depth")))
    total = store(reduce(DataFrame.unionByName, found), "orphans-0")
    parents = {r.parent for r in references}
    levels, depth, fresh = [total], 0, total.df.where(F.col("orphan_kind") != "late")
    while True:
        depth += 1
        fresh_tables = {r["child_table"] for r in fresh.select("child_table").where(F.col("child_table").isin(*parents)).distinct().collect()}
        due = [r for r in references if r.parent in fresh_tables]
        if not due:
            break
        steps = []
        for ref in due:
            lost = fresh.where(F.col("child_table") == ref.parent).select(F.col("row_id").alias("_key")).distinct()
            child = tables[ref.child].select(F.col(key).alias("row_id"), F.col(ref.field).alias("_key"), F.col(arrival).alias("_at")).where("_key IS NOT NULL AND row_id IS NOT NULL")
            hit = child.join(lost, "_key", "left_semi").groupBy("row_id").agg(F.min("_at").alias("first_seen"))
            steps.append(hit.select(F.lit(ref.child).alias("child_table"), "row_id", F.lit(ref.field).alias("field_name"), F.lit(INHERITED).alias("orphan_kind"), "first_seen", F.lit(depth).alias("depth")))
        so_far = reduce(DataFrame.unionByName, [x.df for x in levels]).where(F.col("orphan_kind") != "late").select("child_table", "row_id", "field_name")
        step = store(reduce(DataFrame.unionByName, steps).join(so_far, ["child_table", "row_id", "field_name"], "left_anti"), f"orphans-{depth}")
        if step.df.isEmpty():
            step.drop()
            break
        levels.append(step)
        fresh = step.df
    everything = reduce(DataFrame.unionByName, [x.df for x in levels])
    return everything.select("child_table", "row_id", "field_name", "orphan_kind", month("first_seen").alias("period"), "depth")


def month(column: str) -> Column:
    return F.date_format(F.col(column), "yyyy-MM")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, field, month and kind; direct and inherited side by side."""
    return orphans.groupBy("child_table", "field_name", "period").agg(
        *[F.count_if(F.col("orphan_kind") == k).alias(f"{k}_rows") for k in (*DIRECT_KINDS, INHERITED)],
        F.count_if(F.col("depth") == 0).alias("direct_rows"),
        F.max("depth").cast("bigint").alias("deepest"),
    )
