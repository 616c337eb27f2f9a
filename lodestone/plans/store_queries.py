"""Queries over the stored tables and their incremental maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import incremental
from lodestone.plans import corpus as C
from lodestone.plans.registry import QueryTable, registrar

QUERIES: QueryTable = {}
query = registrar(QUERIES)

_U = f"WITH {C.SQL_UNITS}"


@query(f"{_U} SELECT content_hash, min(unit_id) AS unit_id, count(*) AS copies FROM units GROUP BY content_hash")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return C.units(spark, d).groupBy("content_hash").agg(F.min("unit_id").alias("unit_id"), F.count("*").alias("copies"))


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two states of each source: every third unit of the old has gone, every seventh of the new has changed."""
    u = C.units(spark, d)
    old = u.filter("unit_id % 3 <> 0").select(F.col("source"), "content_hash", "unit_id")
    new = u.filter("unit_id % 4 <> 0").select("source", F.when(F.col("unit_id") % 7 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")).alias("content_hash"), F.col("unit_id").alias("ordinal"))
    return old, new


@query(f"""{_U}, o AS (SELECT source, content_hash, unit_id, row_number() OVER (PARTITION BY source, content_hash ORDER BY unit_id) AS nth FROM units WHERE unit_id % 3 <> 0),
 m AS (SELECT source, content_hash || CASE WHEN unit_id % 7 = 0 THEN 'x' ELSE '' END AS content_hash, unit_id AS ordinal FROM units WHERE unit_id % 4 <> 0), n AS (SELECT *, row_number() OVER (PARTITION BY source, content_hash ORDER BY ordinal) AS nth FROM m)
 SELECT coalesce(o.source, n.source) AS source, coalesce(o.content_hash, n.content_hash) AS content_hash, unit_id, ordinal, CASE WHEN unit_id IS NULL THEN 'added' WHEN ordinal IS NULL THEN 'removed' ELSE 'reused' END AS outcome
 FROM o FULL OUTER JOIN n ON o.source = n.source AND o.content_hash = n.content_hash AND o.nth = n.nth""")
def source_unit_diff(spark: SparkSession, d: str) -> DataFrame:
    return incremental.match_units(*_versions(spark, d))


_SOURCES = "s AS (SELECT locator, md5(string_agg(content_hash, ',' ORDER BY unit_id)) AS content_hash, min(unit_id) AS first FROM units GROUP BY locator)"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    hashes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "content_hash"))), lambda x: x["content_hash"]), ",")
    return C.units(spark, d).groupBy("locator").agg(F.md5(hashes).alias("content_hash"), F.min("unit_id").alias("first"))


@query(f"{_U}, {_SOURCES} SELECT locator, content_hash FROM s WHERE first % 3 = 0")
def unchanged_skip(spark: SparkSession, d: str) -> DataFrame:
    """Sources to parse again: those that the stored table has with another hash, or not at all."""
    now = _sources(spark, d)
    stored = now.select("locator", F.when(F.col("first") % 3 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"))
    return incremental.changed_sources(now, stored).select("locator", "content_hash")


@query(f"{_U}, {_SOURCES} SELECT u.unit_id FROM units u JOIN s USING (locator) WHERE first % 5 <> 0")
def deletion_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Units that stay when sources vanish."""
    present = _sources(spark, d).filter("first % 5 <> 0")
    return incremental.present_sources(C.units(spark, d), present).select("unit_id")


@query(f"{_U} SELECT unit_id, 'routing' AS kind FROM units WHERE unit_id % 2 = 1 UNION ALL SELECT unit_id, 'evidence' FROM units WHERE unit_id % 3 <> 0")
def vector_invalidation(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose text did not change: of each unit the evidence or the routing text may have."""
    u = C.units(spark, d).select("unit_id", "evidence_text", "routing_text")
    new = u.select("unit_id", F.when(F.col("unit_id") % 3 == 0, "changed").otherwise(F.col("evidence_text")).alias("evidence_text"), F.when(F.col("unit_id") % 2 == 0, "changed").otherwise(F.col("routing_text")).alias("routing_text"))
    vectors = u.select("unit_id", F.explode(F.array(F.lit("evidence"), F.lit("routing"))).alias("kind"))
    return incremental.valid_vectors(vectors, u, new)


@query(f"{_U} SELECT unit_id FROM units WHERE unit_id NOT IN (SELECT vec_id FROM embeddings WHERE label % 2 = 1)")
def missing_vectors_anti(spark: SparkSession, d: str) -> DataFrame:
    return incremental.missing_vectors(C.units(spark, d), C.vectors(spark, d).filter("label % 2 = 1"), "evidence", C.MODEL).select("unit_id")


@query("SELECT unit_id, model_version, age FROM (SELECT vec_id AS unit_id, 'm1' AS model_version, CASE WHEN vec_id % 4 = 0 THEN 'new' ELSE 'old' END AS age FROM embeddings UNION ALL SELECT vec_id, 'm2', 'new' FROM embeddings WHERE vec_id % 6 = 0)")
def vector_put(spark: SparkSession, d: str) -> DataFrame:
    v = C.vectors(spark, d).select("unit_id", "kind", "model_version")
    new = v.filter("unit_id % 4 = 0").unionByName(v.filter("unit_id % 6 = 0").withColumn("model_version", F.lit("m2"))).withColumn("age", F.lit("new"))
    return incremental.put_vectors(v.withColumn("age", F.lit("old")), new).select("unit_id", "model_version", "age")


@query("SELECT 'm' || (label % 3) AS model_version, count(*) AS n FROM embeddings GROUP BY ALL")
def vector_models_count(spark: SparkSession, d: str) -> DataFrame:
    return C.vectors(spark, d).groupBy(F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model_version")).agg(F.count("*").alias("n"))


@query(f"""{_U}, {C.SQL_ANCHORS} SELECT 'sources' AS name, count(DISTINCT locator) AS n FROM units UNION ALL SELECT 'units', count(*) FROM units UNION ALL SELECT 'anchors', count(*) FROM (SELECT DISTINCT kind, value FROM ua)
 UNION ALL SELECT 'unit_anchors', count(*) FROM (SELECT DISTINCT * FROM ua) UNION ALL SELECT 'vectors', count(*) FROM embeddings""")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    units = C.units(spark, d)
    anchors = C.unit_anchors(units)
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    parts = [one("sources", units.select("locator").distinct()), one("units", units), one("anchors", anchors.select("kind", "value").distinct()), one("unit_anchors", anchors.distinct()), one("vectors", C.vectors(spark, d))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("SELECT user_id % 50 AS repository, max(event_id) AS run_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS duration FROM events GROUP BY ALL")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each repository's run log."""
    return C.read(spark, d, "events").groupBy((F.col("user_id") % 50).alias("repository")).agg(F.max("event_id").alias("run_id"), F.max_by("event_type", "event_id").alias("status"), F.max_by("value", "event_id").alias("duration"))


@query(f"{_U}, {C.SQL_ANCHORS} SELECT DISTINCT kind, value FROM ua")
def anchor_intern(spark: SparkSession, d: str) -> DataFrame:
    return C.unit_anchors(C.units(spark, d)).select("kind", "value").dropDuplicates(["kind", "value"])
