"""Queries of the surviving-record problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .fusion import Fusion, fuse

GROUP = ["edition_id", "event_id", "event_division"]
FIELDS = ["event_name", "manifest_rule_id"]
# Source classes, most trusted first.
CLASSES = ["structured-official-export", "organizer-json-csv", "organizer-html-pdf", "written-authorized-feed"]


def competing_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result sets that compete, of groups with at least two ids, with their source and instant."""
    sets = table(spark, sf_dir, "result_sets").select("id", "snapshot_id", *GROUP, *FIELDS, "published_at", "explicit_final", "correction").where("id IS NOT NULL")
    rivals = sets.groupBy(*GROUP).agg(F.min("id").alias("_lo"), F.max("id").alias("_hi")).where("_lo <> _hi")
    same = [sets[c].eqNullSafe(rivals[c]) for c in GROUP]
    sets = sets.where("explicit_final = 1 OR correction = 1").join(rivals, same, "left_semi")
    shots = table(spark, sf_dir, "snapshots").groupBy(F.col("id").alias("snapshot_id")).agg(F.min("source_class").alias("source_class"), F.min("descriptor_id").alias("descriptor_id"))
    sets = sets.join(shots, "snapshot_id", "left")
    return sets.withColumn("instant", F.unix_micros(F.expr("try_cast(published_at AS timestamp)")))


def trust_order() -> list:
    rank = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("source_class")), F.lit(0))
    return [F.when(rank > 0, rank).otherwise(len(CLASSES) + 1), 1 - F.coalesce(F.col("explicit_final"), F.lit(0)), -F.coalesce(F.col("instant"), F.lit(-(2**62))), F.col("snapshot_id").isNull(), F.col("snapshot_id")]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated order of trust is total, so it is the operator's precedence and the evidence never decides."""
    best = fuse(competing_sets(spark, sf_dir), GROUP, "id", "descriptor_id", "instant", FIELDS, trust_order())
    return best.select(*GROUP, F.col("surviving_id").alias("result_set_id"), F.coalesce("event_name_from", F.lit("")).alias("name_from_id"), F.coalesce("manifest_rule_id_from", F.lit("")).alias("rule_from_id"))


def p5_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivor and fields by the evidence alone, without any order of trust."""
    best = fuse(competing_sets(spark, sf_dir), GROUP, "id", "descriptor_id", "instant", FIELDS)
    return best.withColumns({f"{f}_posterior": F.round(f"{f}_posterior", 6) for f in FIELDS})


_CLASS = "CASE s.source_class " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CLASSES)) + " ELSE 9 END"
P5_FOUND_SQL = f"""WITH rs AS (SELECT DISTINCT id, snapshot_id, edition_id, event_id, event_division, event_name, manifest_rule_id, published_at, explicit_final, correction FROM result_sets),
  s AS (SELECT id, min(source_class) AS source_class FROM snapshots GROUP BY 1),
  g AS (SELECT edition_id, event_id, event_division FROM rs GROUP BY ALL HAVING count(DISTINCT id) > 1),
  o AS (SELECT rs.*, row_number() OVER (PARTITION BY rs.edition_id, rs.event_id, rs.event_division ORDER BY {_CLASS}, explicit_final DESC,
      TRY_CAST(published_at AS TIMESTAMPTZ) DESC NULLS LAST, snapshot_id NULLS LAST, rs.id) AS n
    FROM rs JOIN g ON rs.edition_id IS NOT DISTINCT FROM g.edition_id AND rs.event_id IS NOT DISTINCT FROM g.event_id AND rs.event_division IS NOT DISTINCT FROM g.event_division
    LEFT JOIN s ON s.id = rs.snapshot_id WHERE explicit_final = 1 OR correction = 1)
  SELECT edition_id, event_id, event_division, min_by(id, n) AS result_set_id,
    coalesce(min_by(id, n) FILTER (regexp_matches(event_name, '\\S')), '') AS name_from_id,
    coalesce(min_by(id, n) FILTER (regexp_matches(manifest_rule_id, '\\S')), '') AS rule_from_id
  FROM o GROUP BY 1, 2, 3"""



def _fused_sql(m: Fusion = Fusion()) -> str:
    """The same model in SQL, its rounds written out one after the other; a round behind the last one changes nothing."""
    lo, hi = m.bounds
    parts = [f"""WITH rs AS (SELECT DISTINCT id, snapshot_id, edition_id, event_id, event_division, event_name, manifest_rule_id, published_at, explicit_final, correction FROM result_sets WHERE id IS NOT NULL),
  sh AS (SELECT id, min(descriptor_id) AS d FROM snapshots GROUP BY 1),
  keyed AS (SELECT rs.*, concat_ws('|', coalesce(edition_id, '~'), coalesce(event_id, '~'), coalesce(event_division, '~')) AS g, coalesce(d, '') AS src, coalesce(epoch_us(TRY_CAST(published_at AS TIMESTAMPTZ)), 4611686018427387904) AS t FROM rs LEFT JOIN sh ON sh.id = snapshot_id),
  o AS MATERIALIZED (SELECT * FROM keyed WHERE (explicit_final = 1 OR correction = 1) AND g IN (SELECT g FROM keyed GROUP BY 1 HAVING count(DISTINCT id) > 1)),
  said AS (SELECT g, src, t, id, 'n' AS f, event_name AS val FROM o UNION ALL SELECT g, src, t, id, 'r', manifest_rule_id FROM o),
  claims AS (SELECT g, f, src, t, val FROM said WHERE regexp_matches(val, '\\S') QUALIFY row_number() OVER (PARTITION BY g, f, src ORDER BY t DESC, id) = 1),
  c AS MATERIALIZED (SELECT *, first_value(src) OVER (PARTITION BY g, f, val ORDER BY t, src) AS orig, first_value(src) OVER w AS lead, first_value(val) OVER w AS lead_val, (SELECT count(DISTINCT x.val) FROM claims x WHERE x.g = claims.g AND x.f = claims.f) AS k
    FROM claims WINDOW w AS (PARTITION BY g, f ORDER BY t, src, val)),
  acc0 AS (SELECT DISTINCT src, CAST({m.first_accuracy} AS DOUBLE) AS acc FROM c), dep0 AS (SELECT '' AS src, '' AS orig, 0e0 AS dep WHERE false), stop0 AS (SELECT false AS s)"""]
    for i in range(1, m.rounds + 2):
        b = i - 1
        parts.append(f"""cell{i} AS (SELECT g, f, val, any_value(k) AS k, sum(ln({m.false_values} * acc / (1 - acc)) * CASE WHEN c.src = c.orig THEN 1 ELSE 1 - {m.copy_share} * coalesce(dep, 0) END) AS s
    FROM c JOIN acc{b} USING (src) LEFT JOIN dep{b} ON dep{b}.src = c.src AND dep{b}.orig = c.orig GROUP BY ALL),
  z{i} AS (SELECT g, f, max(s) AS m, sum(exp(s - mx)) + greatest({m.false_values + 1} - any_value(k), 0) * exp(-max(s)) AS z FROM (SELECT *, max(s) OVER (PARTITION BY g, f) AS mx FROM cell{i}) GROUP BY 1, 2),
  post{i} AS MATERIALIZED (SELECT g, f, val, exp(s - m) / z AS p FROM cell{i} JOIN z{i} USING (g, f))""")
        if i > m.rounds:
            break
        parts.append(f"""judged{i} AS MATERIALIZED (SELECT * FROM c JOIN post{i} USING (g, f, val)),
  new{i} AS (SELECT src, least(greatest((sum(p) + {m.smoothing * m.first_accuracy}) / (count(*) + {m.smoothing}), {lo}), {hi}) AS acc FROM judged{i} GROUP BY 1),
  met{i} AS (SELECT src, orig, sum(kt) AS kt, sum(kf) AS kf, sum(kd) AS kd FROM (SELECT src, orig, p AS kt, 1 - p AS kf, 0 AS kd FROM judged{i} WHERE src <> orig
    UNION ALL SELECT src, lead, 0, 0, 1 FROM judged{i} WHERE src <> lead AND val <> lead_val) GROUP BY 1, 2),
  odds{i} AS (SELECT src, orig, a1 * a2 AS pt, (1 - a1) * (1 - a2) / {m.false_values} AS pf, a2, kt, kf, kd FROM (SELECT met{i}.*, x.acc AS a1, y.acc AS a2 FROM met{i} JOIN new{i} x ON x.src = met{i}.src JOIN new{i} y ON y.src = orig)),
  copy{i} AS (SELECT src, orig, 1 / (1 + exp(-least(greatest(ln({m.copy_prior} / (1 - {m.copy_prior})) + kt * ln((a2 * {m.copy_share} + pt * (1 - {m.copy_share})) / pt)
    + kf * ln(((1 - a2) * {m.copy_share} + pf * (1 - {m.copy_share})) / pf) + kd * ln(1 - {m.copy_share}), -50), 50))) AS dep FROM odds{i}),
  acc{i} AS MATERIALIZED (SELECT src, CASE WHEN (SELECT s FROM stop{b}) THEN o.acc ELSE n.acc END AS acc FROM new{i} n JOIN acc{b} o USING (src)),
  dep{i} AS MATERIALIZED (SELECT * FROM copy{i} WHERE NOT (SELECT s FROM stop{b}) UNION ALL SELECT * FROM dep{b} WHERE (SELECT s FROM stop{b})),
  stop{i} AS MATERIALIZED (SELECT (SELECT s FROM stop{b}) OR coalesce(max(abs(n.acc - o.acc)), 0) <= {m.tolerance} AS s FROM new{i} n JOIN acc{b} o USING (src))""")
    last = m.rounds + 1
    value = lambda f, c: f"min_by({c}, ({f}p IS NULL, -{f}p, {f}v, id)) FILTER ({f}v IS NOT NULL)"
    parts.append(f"""r AS (SELECT o.*, CASE WHEN regexp_matches(event_name, '\\S') THEN event_name END AS nv, CASE WHEN regexp_matches(manifest_rule_id, '\\S') THEN manifest_rule_id END AS rv, n.p AS np, q.p AS rp
    FROM o LEFT JOIN post{last} n ON n.g = o.g AND n.f = 'n' AND n.val = event_name LEFT JOIN post{last} q ON q.g = o.g AND q.f = 'r' AND q.val = manifest_rule_id)
  SELECT edition_id, event_id, event_division, min_by(id, (-(coalesce(np, 0) + coalesce(rp, 0)) / 2, id)) AS surviving_id, count(*) AS records,
    {value('n', 'nv')} AS event_name, {value('n', 'id')} AS event_name_from, round({value('n', 'np')}, 6) AS event_name_posterior,
    {value('r', 'rv')} AS manifest_rule_id, {value('r', 'id')} AS manifest_rule_id_from, round({value('r', 'rp')}, 6) AS manifest_rule_id_posterior FROM r GROUP BY 1, 2, 3""")
    return ",\n  ".join(parts)


QUERIES = {"p5_found": p5_found, "p5_fused": p5_fused}
ORACLE = {"p5_found": P5_FOUND_SQL, "p5_fused": _fused_sql()}
