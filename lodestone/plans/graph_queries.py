"""Queries over the unit-anchor graph, documentation families and version history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.scratch import small, written
from lodestone.operators import graph, history
from lodestone.plans import corpus as C
from lodestone.plans import ranking_queries as R
from lodestone.plans.registry import QueryTable, registrar

QUERIES: QueryTable = {}
query = registrar(QUERIES)

_GRAPH = f"WITH {C.SQL_UNITS}, {C.SQL_ANCHORS}"


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    return C.unit_anchors(C.units(spark, d))


@query(f"{_GRAPH} SELECT unit_id, kind, value, relationship, row_number() OVER (PARTITION BY unit_id ORDER BY kind, value, relationship) AS ordinal FROM (SELECT DISTINCT * FROM ua)")
def anchors_for_unit(spark: SparkSession, d: str) -> DataFrame:
    units = C.units(spark, d)
    out = graph.anchors_of(C.unit_anchors(units), units)
    return out.select("unit_id", "kind", "value", "relationship", F.col("ordinal").cast("long").alias("ordinal"))


@query(f"""{_GRAPH}, p AS (SELECT DISTINCT kind, value, unit_id FROM ua), n AS (SELECT *, row_number() OVER (PARTITION BY kind, value ORDER BY unit_id) AS ordinal, count(*) OVER (PARTITION BY kind, value) AS total FROM p)
 SELECT kind, value, unit_id, ordinal, greatest(total - 10, 0) AS more FROM n WHERE ordinal <= 10""")
def units_for_anchor_page(spark: SparkSession, d: str) -> DataFrame:
    return graph.units_of(_anchors(spark, d), 10).withColumn("ordinal", F.col("ordinal").cast("long"))


@query(f"""{_GRAPH}, home AS (SELECT DISTINCT s.value AS symbol, f.value AS file FROM ua s JOIN ua f ON f.unit_id = s.unit_id WHERE s.kind = 'symbol' AND s.relationship = 'defines' AND f.kind = 'file' AND f.relationship = 'defined_in')
 SELECT DISTINCT symbol, file, t.unit_id FROM home JOIN ua t ON t.kind = 'file' AND t.relationship = 'touched' AND t.value = home.file JOIN units u ON u.unit_id = t.unit_id WHERE u.source_kind = 'agent_session'""")
def symbol_sessions_two_hop(spark: SparkSession, d: str) -> DataFrame:
    units = C.units(spark, d)
    return graph.sessions_of_symbols(written(C.unit_anchors(units)), units)


_EXPANSION = f"{R._FUSED2}, {R.sql_expanded('fused')} SELECT query_id, unit_id, round(score, 6) AS score, rank, expanded FROM expanded"


@query(_EXPANSION)
def anchor_expansion_topk(spark: SparkSession, d: str) -> DataFrame:
    units = C.units(spark, d)
    out = graph.expand(R._lexical(spark, d), written(C.unit_anchors(units)), units, C.questions(spark, d))
    return out.select("query_id", "unit_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "expanded")


@query(f"""{R._FUSED2}, p AS (SELECT query_id, unit_id, rank AS place FROM fused WHERE rank <= 30), {R.sql_covered('p', 'covered')}, {R.sql_siblings('covered', 'single')}
 SELECT query_id, unit_id, place, coverage FROM single""")
def locale_suppression(spark: SparkSession, d: str) -> DataFrame:
    """The first thirty of each question without translations; the best covers most of the question's terms."""
    units = C.units(spark, d)
    pool = R._lexical(spark, d).filter(F.col("rank") <= 30).select("query_id", "unit_id", F.col("rank").cast("long").alias("place"))
    said = F.concat("evidence_text", F.lit("\n"), "routing_text")
    pool = units.join(small(pool), "unit_id").join(C.questions(spark, d), "query_id").select("query_id", "unit_id", "place", T.term_coverage(F.col("text"), said).alias("coverage"))
    return graph.suppress_siblings(written(pool), units)


_SPANS = """ch AS (SELECT 'f' || (l_orderkey % 40) AS path, (l_partkey % 500) + 1 AS line FROM lineitem), sp AS (SELECT 'f' || (o_custkey % 40) AS path, o_orderkey % 450 AS start_line, o_orderkey % 450 + (o_custkey % 60) AS end_line, 's' || (o_orderkey % 977) AS breadcrumb FROM orders)"""


@query(f"""WITH {_SPANS}, c AS (SELECT DISTINCT * FROM ch), s AS (SELECT DISTINCT * FROM sp), m AS (SELECT c.path, c.line, breadcrumb, row_number() OVER (PARTITION BY c.path, c.line ORDER BY end_line - start_line, breadcrumb) AS n FROM c JOIN s ON s.path = c.path AND c.line BETWEEN start_line AND end_line)
 SELECT path, line, breadcrumb FROM m WHERE n = 1""")
def span_alignment_range_join(spark: SparkSession, d: str) -> DataFrame:
    changes = C.read(spark, d, "lineitem").select(F.concat(F.lit("f"), (F.col("l_orderkey") % 40).cast("string")).alias("path"), ((F.col("l_partkey") % 500) + 1).alias("line"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    spans = C.read(spark, d, "orders").select(F.concat(F.lit("f"), (c % 40).cast("string")).alias("path"), (o % 450).alias("start_line"), (o % 450 + c % 60).alias("end_line"), F.concat(F.lit("s"), (o % 977).cast("string")).alias("breadcrumb"))
    return history.align_lines(changes, spans)


_VERSIONS = """o AS (SELECT 'f' || (p_partkey % 10) AS path, 'n' || p_partkey AS name, p_partkey % 17 AS body, p_partkey AS line FROM part WHERE p_partkey % 3 <> 0),
 n AS (SELECT 'f' || (p_partkey % 10) AS path, CASE WHEN p_partkey % 4 = 0 THEN 'n' || p_partkey ELSE 'x' || p_partkey END AS name, p_partkey % 17 AS body, p_partkey AS line FROM part WHERE p_partkey % 5 <> 0)"""


@query(f"""WITH {_VERSIONS}, k AS (SELECT o.path, o.name AS old_name, n.name AS new_name FROM o JOIN n ON n.path = o.path AND n.name = o.name),
 a AS (SELECT path, name, body, row_number() OVER (PARTITION BY path, body ORDER BY line, name) AS nth FROM o WHERE (path, name) NOT IN (SELECT path, old_name FROM k)),
 b AS (SELECT path, name, body, row_number() OVER (PARTITION BY path, body ORDER BY line, name) AS nth FROM n WHERE (path, name) NOT IN (SELECT path, new_name FROM k))
 SELECT path, old_name, new_name, 'modified' AS change FROM k UNION ALL
 SELECT coalesce(a.path, b.path), a.name, b.name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'deleted' ELSE 'renamed' END FROM a FULL OUTER JOIN b ON a.path = b.path AND a.body = b.body AND a.nth = b.nth""")
def rename_bucket_join(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    name = lambda lead: F.concat(F.lit(lead), p.cast("string"))
    side = lambda df, n: df.select(F.concat(F.lit("f"), (p % 10).cast("string")).alias("path"), n.alias("breadcrumb"), (p % 17).alias("body_key"), p.alias("start_line"))
    parts = C.read(spark, d, "part")
    old = side(parts.filter(p % 3 != 0), name("n"))
    new = side(parts.filter(p % 5 != 0), F.when(p % 4 == 0, name("n")).otherwise(name("x")))
    return history.reconcile(old, new)
