"""The retrieval tables as they are derived from the given tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.scratch import small

KINDS = ["code", "markdown", "git_commit", "agent_session", "hindsight_memory"]
CONFIDENCES = ["authoritative", "strong", "supported", "inferred", "unknown"]
MODEL = "m1"


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def pick(values: list[str], n) -> F.Column:
    return F.element_at(T.strings(values), (n + 1).cast("int"))


def units(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = read(spark, d, "documents"), small(read(spark, d, "labels").select("doc_id", "toxic", "quality"))
    i = F.col("doc_id")
    locator = F.concat(F.lit("docs/"), F.col("lang"), F.lit("/guide/"), F.col("source"), F.lit("/"), (i % 8).cast("string"), F.lit(".md"))
    status = F.when(F.col("toxic") == 1, "conflicted").when(F.col("quality") == 0, "superseded").otherwise("active")
    return docs.join(labels, "doc_id", "left").select(
        i.alias("unit_id"), pick(KINDS, i % 5).alias("source_kind"), locator.alias("locator"), F.col("source"), F.col("lang"), F.col("text").alias("evidence_text"),
        F.concat(F.lit("source: document\npath: "), locator, F.lit("\nheading: "), F.substring("text", 1, 60)).alias("routing_text"),
        T.estimate_tokens(F.col("text")).alias("token_count"), F.sha2("text", 256).alias("content_hash"), (F.lit(1_700_000_000) + i * 3600).alias("timestamp"),
        status.alias("status"), F.when(i % 5 == 4, pick(CONFIDENCES, F.floor(i / 5) % 5)).alias("confidence"),
        F.when((i % 5 == 4) & (i % 3 == 0), "candidate_for_removal").alias("scar_state"),
        F.when(i % 5 == 4, F.array(F.concat(F.lit("src/"), F.coalesce(T.first_term(F.col("text")), F.lit("none")), F.lit(".rs")))).alias("scope_paths"),
    )


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark text as a question, whole."""
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def unit_anchors(units_: DataFrame) -> DataFrame:
    i, kind = F.col("unit_id"), F.col("source_kind")
    file = F.concat(F.lit("f"), (F.floor(i / 5) % 25).cast("string"))
    rel = T.choice(kind, {"code": "defined_in", "markdown": "documented_in", "git_commit": "changes", "agent_session": "touched", "hindsight_memory": "applies_to"})
    first = F.coalesce(T.first_term(F.col("evidence_text")), F.lit("none"))
    a = lambda when, k, v, r: F.when(when, F.struct(F.lit(k).alias("kind"), v.alias("value"), r.alias("relationship")))
    every = F.array_compact(F.array(
        a(F.lit(True), "file", file, rel),
        a(F.lit(True), "symbol", first, F.when(kind == "code", "defines").otherwise("mentions")),
        a(kind == "agent_session", "session", F.concat(F.lit("s"), (i % 30).cast("string")), F.lit("part_of")),
        a(kind == "hindsight_memory", "memory", F.concat(F.lit("m"), i.cast("string")), F.lit("self")),
        a((kind == "hindsight_memory") & (i >= 50), "memory", F.concat(F.lit("m"), (i - 50).cast("string")), F.lit("supersedes")),
    ))
    return units_.select("unit_id", F.inline(every))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), F.lit("evidence").alias("kind"), F.lit(MODEL).alias("model_version"), "embedding", "label")


# The same in SQL.


def sql_terms(x: str) -> str:
    return rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def sql_index_terms(x: str) -> str:
    return sql_terms(f"strip_accents({x})")


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SQL_UNITS = f"""units AS (SELECT d.doc_id AS unit_id, {sql_list(KINDS)}[d.doc_id % 5 + 1] AS source_kind,
 'docs/' || lang || '/guide/' || source || '/' || (d.doc_id % 8) || '.md' AS locator, source, lang, text AS evidence_text,
 'source: document' || chr(10) || 'path: docs/' || lang || '/guide/' || source || '/' || (d.doc_id % 8) || '.md' || chr(10) || 'heading: ' || substr(text, 1, 60) AS routing_text,
 greatest(CAST(ceil(length(text) / 4.0) AS BIGINT), 1) AS token_count, sha256(text) AS content_hash, 1700000000 + d.doc_id * 3600 AS timestamp,
 CASE WHEN toxic = 1 THEN 'conflicted' WHEN quality = 0 THEN 'superseded' ELSE 'active' END AS status,
 CASE WHEN d.doc_id % 5 = 4 THEN {sql_list(CONFIDENCES)}[(d.doc_id // 5) % 5 + 1] END AS confidence,
 CASE WHEN d.doc_id % 5 = 4 AND d.doc_id % 3 = 0 THEN 'candidate_for_removal' END AS scar_state,
 CASE WHEN d.doc_id % 5 = 4 THEN ['src/' || coalesce({sql_terms('text')}[1], 'none') || '.rs'] END AS scope_paths
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

SQL_QUESTIONS = "q AS (SELECT item_id AS query_id, text FROM benchmark)"

SQL_ANCHORS = f"""ua AS (
 SELECT unit_id, 'file' AS kind, 'f' || ((unit_id // 5) % 25) AS value, CASE source_kind WHEN 'code' THEN 'defined_in' WHEN 'markdown' THEN 'documented_in' WHEN 'git_commit' THEN 'changes' WHEN 'agent_session' THEN 'touched' ELSE 'applies_to' END AS relationship FROM units
 UNION ALL SELECT unit_id, 'symbol', coalesce({sql_terms('evidence_text')}[1], 'none'), CASE WHEN source_kind = 'code' THEN 'defines' ELSE 'mentions' END FROM units
 UNION ALL SELECT unit_id, 'session', 's' || (unit_id % 30), 'part_of' FROM units WHERE source_kind = 'agent_session'
 UNION ALL SELECT unit_id, 'memory', 'm' || unit_id, 'self' FROM units WHERE source_kind = 'hindsight_memory'
 UNION ALL SELECT unit_id, 'memory', 'm' || (unit_id - 50), 'supersedes' FROM units WHERE source_kind = 'hindsight_memory' AND unit_id >= 50)"""


def sql_bm25(column: str, name: str, where: str = "TRUE") -> str:
    """CTEs that end in ``name`` (query_id, unit_id, score)."""
    return f"""{name}_qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({sql_index_terms('text')}) AS term FROM q) GROUP BY ALL),
 {name}_p AS (SELECT unit_id, term, count(*) AS tf FROM (SELECT unit_id, unnest({sql_index_terms(column)}) AS term FROM units) GROUP BY ALL),
 {name}_dl AS (SELECT unit_id, len({sql_index_terms('evidence_text')}) + len({sql_index_terms('routing_text')}) AS dl FROM units),
 {name}_c AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM {name}_dl),
 {name}_i AS (SELECT term, CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END AS idf FROM (SELECT term, count(*) AS df FROM {name}_p GROUP BY term), {name}_c),
 {name} AS (SELECT query_id, p.unit_id, sum(times * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM {name}_qt JOIN {name}_p p USING (term) JOIN {name}_i USING (term) JOIN {name}_dl d ON d.unit_id = p.unit_id JOIN units u ON u.unit_id = p.unit_id, {name}_c WHERE {where} GROUP BY ALL)"""


def sql_top(source: str, n: int) -> str:
    return f"SELECT * FROM (SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit_id) AS rank FROM {source}) WHERE rank <= {n}"


def sql_facets(asked: str) -> str:
    """CTEs that end in f (query_id, facet, n) in order, from ``asked`` (query_id, text)."""
    tests = []
    for k, (name, single, phrases, _) in enumerate(T.FACETS):
        test = " OR ".join([f"len(list_intersect(tokens, {sql_list(single)})) > 0", *(f"contains(line, ' {p} ')" for p in phrases)])
        tests.append(f"SELECT query_id, '{name}' AS facet, {k} AS n FROM t WHERE {test}")
    return f"""t AS (SELECT query_id, {sql_terms('text')} AS tokens, ' ' || array_to_string({sql_terms('text')}, ' ') || ' ' AS line FROM {asked}),
 f0 AS ({" UNION ALL ".join(tests)}), f AS (SELECT * FROM f0 UNION ALL SELECT query_id, 'current_behavior', 6 FROM t WHERE query_id NOT IN (SELECT query_id FROM f0))"""


#: (facet, place, role) for SQL.
ROLE_ROWS = ", ".join(f"('{name}', {k}, '{r}')" for name, _, _, roles in T.FACETS for k, r in enumerate(roles))


def sql_concepts(asked: str) -> str:
    """CTEs that end in k (query_id, raw, pieces, identifier, n), from ``asked`` (query_id, text)."""
    words = r"string_split_regex(text, '\s+')"
    return rf"""w AS (SELECT query_id, w, n FROM (SELECT query_id, unnest({words}) AS w, generate_subscripts({words}, 1) AS n FROM {asked}) WHERE w <> ''),
 c AS (SELECT query_id, lower(w) AS raw, {sql_terms('w')} AS pieces, regexp_matches(w, '[_.-]') OR regexp_matches(w, '\p{{Ll}}\p{{Lu}}') AS identifier, n FROM w WHERE lower(w) NOT IN ({", ".join(f"'{s}'" for s in T.STOPWORDS)})),
 k AS (SELECT * FROM c WHERE len(pieces) > 0 QUALIFY row_number() OVER (PARTITION BY query_id, raw ORDER BY n) = 1)"""
