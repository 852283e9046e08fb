"""Queries of the orphan-reference problem and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.orphans import Reference, find_orphans, orphan_report
from ..runtime import table

#: The four references whose orphans are reported.
REPORTED = [
    Reference("results", "result_set_id", "result_sets"),
    Reference("awards", "snapshot_id", "snapshots"),
    Reference("awards", "edition_id", "editions"),
    Reference("editions", "lineage_id", "lineages"),
]
#: Further references along which orphanhood is passed down.
LINKING = [
    Reference("result_sets", "edition_id", "editions"),
    Reference("result_sets", "snapshot_id", "snapshots"),
    Reference("snapshots", "edition_id", "editions"),
]


def _orphans(spark: SparkSession, sf_dir: str, references: list[Reference]) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in {x for r in references for x in (r.child, r.parent)}}
    return find_orphans(tables, references, table(spark, sf_dir, "tombstones"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir, REPORTED).where("depth = 0").select("child_table", "row_id", "field_name", "orphan_kind", "period")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir, REPORTED + LINKING))


def _direct_sql(child: str, field: str, parent: str) -> str:
    return f"""SELECT '{child}' AS child_table, c.id AS row_id, '{field}' AS field_name,
      CASE WHEN t.row_id IS NOT NULL THEN 'deleted' WHEN p.id IS NULL THEN 'missing' ELSE 'late' END AS orphan_kind,
      strftime(c.born, '%Y-%m') AS period
    FROM (SELECT id, {field} AS ref, min(ingested_at) AS born FROM {child} WHERE {field} IS NOT NULL GROUP BY 1, 2) c
    LEFT JOIN (SELECT id, min(ingested_at) AS born FROM {parent} GROUP BY 1) p ON p.id = c.ref
    LEFT JOIN (SELECT DISTINCT row_id FROM tombstones WHERE parent_table = '{parent}') t ON t.row_id = c.ref
    WHERE t.row_id IS NOT NULL OR p.id IS NULL OR c.born < p.born"""


P6_FOUND_SQL = "\nUNION ALL\n".join(_direct_sql(r.child, r.field, r.parent) for r in REPORTED)


def _report_sql() -> str:
    ctes = [f"d{i} AS ({_direct_sql(r.child, r.field, r.parent)})" for i, r in enumerate(REPORTED + LINKING)]
    direct = " UNION ALL ".join(f"SELECT *, 0 AS depth FROM d{i}" for i in range(len(ctes)))
    links = " UNION ALL ".join(f"SELECT DISTINCT '{r.child}' AS child, '{r.field}' AS field, id, {r.field} AS ref, '{r.parent}' AS parent FROM {r.child} WHERE {r.field} IS NOT NULL" for r in REPORTED + LINKING)
    born = " UNION ALL ".join(f"SELECT '{t}' AS child, id, strftime(min(ingested_at), '%Y-%m') AS period FROM {t} GROUP BY 2" for t in sorted({r.child for r in REPORTED + LINKING}))
    return f"""WITH RECURSIVE {', '.join(ctes)}, direct AS ({direct}), links AS ({links}), born AS ({born}),
    walk AS (
      SELECT child_table, row_id, field_name, 0 AS depth FROM direct WHERE orphan_kind <> 'late'
      UNION
      SELECT l.child, l.id, l.field, w.depth + 1 FROM walk w JOIN links l ON l.parent = w.child_table AND l.ref = w.row_id),
    first AS (SELECT child_table, row_id, field_name, min(depth) AS depth FROM walk GROUP BY 1, 2, 3),
    al AS (SELECT * FROM direct UNION ALL
      SELECT f.child_table, f.row_id, f.field_name, 'inherited', b.period, f.depth FROM first f JOIN born b ON b.child = f.child_table AND b.id = f.row_id WHERE f.depth > 0)
    SELECT child_table, field_name, period,
      CAST(count(*) FILTER (orphan_kind = 'deleted') AS BIGINT) AS deleted_rows, CAST(count(*) FILTER (orphan_kind = 'missing') AS BIGINT) AS missing_rows,
      CAST(count(*) FILTER (orphan_kind = 'late') AS BIGINT) AS late_rows, CAST(count(*) FILTER (orphan_kind = 'inherited') AS BIGINT) AS inherited_rows,
      CAST(count(*) FILTER (depth = 0) AS BIGINT) AS direct_rows, CAST(max(depth) AS BIGINT) AS deepest
    FROM al GROUP BY 1, 2, 3"""


QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
ORACLE = {"p6_found": P6_FOUND_SQL, "p6_report": _report_sql()}
