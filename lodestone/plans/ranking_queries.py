"""Queries over ranked channels, fusion, priors, filters and admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.scratch import small, written
from lodestone.operators import admission, ranking
from lodestone.plans import corpus as C
from lodestone.plans import packets
from lodestone.plans.registry import QueryTable, registrar

QUERIES: QueryTable = {}
query = registrar(QUERIES)

TOP = 25
TEXTS = ["evidence_text", "routing_text"]


def _channel(spark: SparkSession, d: str, column: str, n: int = TOP, **more) -> DataFrame:
    units = C.units(spark, d)
    return ranking.top(ranking.bm25(units, C.questions(spark, d), [column], TEXTS, n=n, **more), n)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "unit_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _sql_channel(column: str, name: str, where: str = "TRUE", n: int = TOP) -> str:
    return f"{C.sql_bm25(column, name, where)}, {name}_top AS ({C.sql_top(name, n)})"


_BASE = f"WITH {C.SQL_UNITS}, {C.SQL_QUESTIONS}"


@query(f"{_BASE}, {_sql_channel('evidence_text', 'b')} SELECT query_id, unit_id, rank, round(score, 6) AS score FROM b_top")
def bm25_topk_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_channel(spark, d, "evidence_text"))


@query(f"{_BASE}, {_sql_channel('routing_text', 'b')} SELECT query_id, unit_id, rank, round(score, 6) AS score FROM b_top")
def bm25_topk_routing(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_channel(spark, d, "routing_text"))


_VECTOR_TOP = """v AS (SELECT a.vec_id AS query_id, b.vec_id AS unit_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"""


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return C.vectors(spark, d).filter("unit_id % 20 = 0").select(F.col("unit_id").alias("query_id"), "embedding")


@query(f"WITH {_VECTOR_TOP} SELECT query_id, unit_id, rank, round(score, 6) AS score FROM ({C.sql_top('v', 10)})")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _shown(ranking.cosine_top(C.vectors(spark, d), _vector_queries(spark, d), 10))


@query(f"""WITH {_VECTOR_TOP}, t AS ({C.sql_top('v', 11)}), x AS (SELECT t.*, a.label = b.label AS same FROM t JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = unit_id WHERE query_id <> unit_id)
 SELECT a.label, count(DISTINCT query_id) AS queries, round(avg(same::INT), 6) AS precision FROM x JOIN embeddings a ON a.vec_id = query_id GROUP BY a.label""")
def retrieval_recall_bench(spark: SparkSession, d: str) -> DataFrame:
    """How often the nearest vectors have the label of the question's own."""
    labels = C.vectors(spark, d).select("unit_id", "label")
    found = ranking.cosine_top(C.vectors(spark, d), _vector_queries(spark, d), 11).filter("query_id <> unit_id")
    own = labels.select(F.col("unit_id").alias("query_id"), F.col("label").alias("own"))
    rows = found.join(labels, "unit_id").join(own, "query_id")
    return rows.groupBy(F.col("own").alias("label")).agg(F.countDistinct("query_id").alias("queries"), F.round(F.avg((F.col("label") == F.col("own")).cast("int")), 6).alias("precision"))


_FUSED2 = f"""{_BASE}, {_sql_channel('evidence_text', 'b')}, {_sql_channel('routing_text', 'r')},
 ch AS (SELECT query_id, unit_id, rank FROM b_top UNION ALL SELECT query_id, unit_id, rank FROM r_top),
 fs AS (SELECT query_id, unit_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM ch GROUP BY ALL),
 fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, unit_id) AS rank FROM fs)"""


def _lexical_lists(spark: SparkSession, d: str) -> DataFrame:
    """Both lexical channels from one pass over the texts."""
    return ranking.top(ranking.bm25(C.units(spark, d), C.questions(spark, d), TEXTS, TEXTS, n=TOP), TOP, by=("query_id", "channel"))


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    """The fused list, written: it is short and read several times."""
    return written(ranking.fuse(_lexical_lists(spark, d)))


@query(f"{_FUSED2} SELECT query_id, unit_id, rank, round(score, 6) AS score FROM fused")
def rrf_fuse_two_channels(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_lexical(spark, d))


_FUSED4 = f"""{_BASE}, {_sql_channel('evidence_text', 'b')}, {_sql_channel('routing_text', 'r')},
 v AS (SELECT q.query_id, e.vec_id AS unit_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM q JOIN embeddings a ON a.vec_id = q.query_id, embeddings e),
 w AS (SELECT q.query_id, e.vec_id AS unit_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM q JOIN embeddings a ON a.vec_id = q.query_id + 1, embeddings e),
 ch AS (SELECT query_id, unit_id, rank FROM b_top UNION ALL SELECT query_id, unit_id, rank FROM r_top UNION ALL SELECT query_id, unit_id, rank FROM ({C.sql_top('v', TOP)}) UNION ALL SELECT query_id, unit_id, rank FROM ({C.sql_top('w', TOP)})),
 fs AS (SELECT query_id, unit_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM ch GROUP BY ALL)
 SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, unit_id) AS rank, round(score, 6) AS score FROM fs"""


@query(_FUSED4)
def rrf_fuse_four_channels(spark: SparkSession, d: str) -> DataFrame:
    channels = _lexical_lists(spark, d)
    for shift, name in ((0, "evidence_vector"), (1, "routing_vector")):
        ids = small(C.questions(spark, d).select("query_id", (F.col("query_id") + shift).alias("unit_id")))
        asked = written(C.vectors(spark, d).select("unit_id", "embedding").join(ids, "unit_id").select("query_id", "embedding"))
        channels = channels.select("query_id", "unit_id", "rank", "channel").unionByName(ranking.cosine_top(C.vectors(spark, d), asked, TOP).select("query_id", "unit_id", "rank", F.lit(name).alias("channel")))
    return _shown(ranking.fuse(channels))


_PRIORS = f"""{_FUSED2}, pr AS (SELECT f.query_id, f.unit_id, score * CASE confidence WHEN 'authoritative' THEN 1.2::DOUBLE WHEN 'strong' THEN 1.12::DOUBLE WHEN 'supported' THEN 1.05::DOUBLE WHEN 'inferred' THEN 0.92::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN scar_state = 'candidate_for_removal' THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END + CASE WHEN len(list_filter(coalesce(scope_paths, []), lambda p: contains(p, '/') AND length(regexp_replace(string_split(p, '/')[-1], '\\..*$', '')) >= 3 AND contains(lower(q.text), lower(regexp_replace(string_split(p, '/')[-1], '\\..*$', ''))))) > 0 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS score
  FROM fused f JOIN units u USING (unit_id) JOIN q USING (query_id)), prior AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, unit_id) AS rank FROM pr)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return ranking.apply_priors(_lexical(spark, d).join(C.questions(spark, d), "query_id"), C.units(spark, d))


@query(f"{_PRIORS} SELECT query_id, unit_id, rank, round(score, 6) AS score FROM prior")
def confidence_prior_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_ranked(spark, d))


@query(f"{_BASE}, {_sql_channel('evidence_text', 'b', '''(u.source_kind <> 'hindsight_memory' OR u.status = 'active')''', 5)} SELECT query_id, unit_id, rank, round(score, 6) AS score FROM b_top")
def lifecycle_filter_before_limit(spark: SparkSession, d: str) -> DataFrame:
    """Memories out of the default tier are gone before the limit, so the list is still full."""
    seen = (F.col("source_kind") != "hindsight_memory") | (T.tier_of_status(F.col("status")) == "default")
    return _shown(_channel(spark, d, "evidence_text", 5, eligible=seen))


@query(f"{_BASE}, {_sql_channel('evidence_text', 'b', '''NOT (u.source_kind = 'agent_session' AND u.unit_id % 30 < 10)''', 5)} SELECT query_id, unit_id, rank, round(score, 6) AS score FROM b_top")
def exclude_sessions_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Units of excluded sessions leave their places to the next ones."""
    gone = C.unit_anchors(C.units(spark, d)).filter("kind = 'session' and cast(substr(value, 2) as int) < 10").select("unit_id")
    return _shown(_channel(spark, d, "evidence_text", 5, excluded=gone))


_CAND = f"{_FUSED2}, c AS (SELECT query_id, unit_id, rank AS place, token_count FROM fused JOIN units USING (unit_id) WHERE rank <= 30)"
BUDGET = 2000


@query(f"""{_CAND.replace('WITH units', 'WITH RECURSIVE units')}, walk AS (SELECT query_id, CAST(0 AS BIGINT) AS place, CAST(-1 AS BIGINT) AS unit_id, CAST(0 AS BIGINT) AS token_count, CAST(0 AS BIGINT) AS used, false AS took FROM (SELECT DISTINCT query_id FROM c)
  UNION ALL SELECT c.query_id, c.place, c.unit_id, c.token_count, CASE WHEN walk.used + c.token_count <= {BUDGET} THEN walk.used + c.token_count ELSE walk.used END, walk.used + c.token_count <= {BUDGET} FROM walk JOIN c ON c.query_id = walk.query_id AND c.place = walk.place + 1)
 SELECT query_id, unit_id, place, token_count, used FROM walk WHERE took""")
def budget_admission(spark: SparkSession, d: str) -> DataFrame:
    """Units in fused order as long as the budget lasts, skipping what is too long."""
    pool = C.units(spark, d).select("unit_id", "token_count").join(small(_lexical(spark, d).filter(F.col("rank") <= admission.POOL)), "unit_id")
    taken = admission.within_budget(pool.withColumnRenamed("rank", "place"), BUDGET)
    return taken.select("query_id", "unit_id", F.col("place").cast("long").alias("place"), "token_count", "used")


def pool_of(spark: SparkSession, d: str) -> DataFrame:
    """The pool of each question with all that admission looks at."""
    units = C.units(spark, d)
    commit = F.when(F.col("source_kind") == "git_commit", F.concat(F.lit("c"), F.floor(F.col("unit_id") / 10).cast("string")))
    units = units.withColumns({"commit": commit, "path": F.col("locator"), "symbol": F.lit(None).cast("string"), "part": F.lit(0)})
    return packets.pool(_ranked(spark, d), units, written(C.unit_anchors(units)), C.vectors(spark, d), C.questions(spark, d))


def sql_expanded(ranked: str) -> str:
    """CTEs that end in ``expanded`` (query_id, unit_id, score, rank, expanded) from ``ranked`` (query_id, unit_id, score, rank)."""
    return f"""{C.SQL_ANCHORS}, dua AS (SELECT DISTINCT * FROM ua),
 seeds AS (SELECT query_id, unit_id AS seed, source_kind AS seed_kind FROM {ranked} JOIN units USING (unit_id) WHERE rank <= 5),
 paths AS (SELECT query_id, seed, seed_kind, kind, value, relationship, CASE WHEN seed_kind <> 'hindsight_memory' THEN 'any' WHEN kind <> 'memory' THEN 'provenance' WHEN relationship <> 'self' THEN 'lifecycle' END AS family FROM seeds JOIN dua ON dua.unit_id = seed),
 kept AS (SELECT * FROM paths WHERE family IS NOT NULL QUALIFY family = 'any' OR row_number() OVER (PARTITION BY query_id, seed, family ORDER BY kind, value, relationship) <= 2),
 pages AS (SELECT kind, value, unit_id FROM (SELECT DISTINCT kind, value, unit_id FROM ua) QUALIFY row_number() OVER (PARTITION BY kind, value ORDER BY unit_id) <= 10),
 hits AS (SELECT k.query_id, k.kind, k.value, p.unit_id, u.source_kind FROM kept k JOIN pages p ON p.kind = k.kind AND p.value = k.value JOIN units u ON u.unit_id = p.unit_id WHERE p.unit_id <> k.seed),
 asked AS (SELECT query_id, {C.sql_terms('text')} AS asked FROM q), sk AS (SELECT query_id, list(DISTINCT seed_kind) AS kinds FROM seeds GROUP BY query_id),
 sums AS (SELECT h.query_id, h.unit_id, sum(0.02::DOUBLE + CASE WHEN kind = 'symbol' AND len(list_filter(string_split_regex(lower(value), '[^\\p{{L}}\\p{{N}}]+'), lambda s: strlen(s) > 2 AND list_contains(asked, s))) > 0 THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END
   + CASE WHEN NOT list_contains(kinds, source_kind) THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END) AS bonus FROM hits h JOIN asked USING (query_id) JOIN sk USING (query_id) GROUP BY ALL),
 scored AS (SELECT s.query_id, s.unit_id, f.score AS base, coalesce(f.score, 0) + bonus AS total FROM sums s LEFT JOIN {ranked} f ON f.query_id = s.query_id AND f.unit_id = s.unit_id),
 accepted AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(total, 9) DESC, unit_id) <= 6),
 expanded AS (SELECT f.query_id, f.unit_id, f.score, f.rank, t.unit_id IS NOT NULL AS expanded FROM {ranked} f LEFT JOIN accepted t ON t.query_id = f.query_id AND t.unit_id = f.unit_id
  UNION ALL SELECT query_id, unit_id, total, NULL, true FROM accepted WHERE base IS NULL)"""


def sql_covered(pool: str, name: str) -> str:
    """CTEs that end in ``name``: ``pool`` (query_id, unit_id, ...) with coverage, the concepts that match and all, and whether an identifier is held."""
    said = "evidence_text || chr(10) || routing_text"
    return f"""{C.sql_concepts('q')}, {name}_u AS (SELECT p.query_id, p.unit_id, lower({said}) AS low, {C.sql_terms(said)} AS said FROM {pool} p JOIN units USING (unit_id)),
 {name}_h AS (SELECT u.query_id, u.unit_id, k.identifier,
   CASE WHEN regexp_matches(k.raw, '[^\\p{{L}}\\p{{N}}]') THEN contains(low, k.raw) OR len(list_filter(k.pieces, lambda x: NOT list_contains(said, x))) = 0 ELSE list_contains(said, k.raw) END AS hit
  FROM {name}_u u JOIN k ON k.query_id = u.query_id),
 {name}_c AS (SELECT query_id, unit_id, count(CASE WHEN hit THEN 1 END) AS matched, count(*) AS n_concepts, bool_or(hit AND identifier) AS named FROM {name}_h GROUP BY ALL),
 {name}_t AS (SELECT u.query_id, u.unit_id, len(list_filter({C.sql_terms('q.text')}, lambda t: contains(low, t))) AS coverage FROM {name}_u u JOIN q USING (query_id)),
 {name} AS (SELECT p.*, t.coverage, coalesce(matched, 0) AS matched, coalesce(n_concepts, 0) AS n_concepts, coalesce(named, false) AS named FROM {pool} p JOIN {name}_t t ON t.query_id = p.query_id AND t.unit_id = p.unit_id LEFT JOIN {name}_c c ON c.query_id = p.query_id AND c.unit_id = p.unit_id)"""


def sql_siblings(pool: str, name: str) -> str:
    """CTEs that end in ``name``: ``pool`` (query_id, unit_id, place, coverage, ...) without translations of what it holds."""
    shaped = "list_position(list_transform(parts, lambda v: regexp_matches(v, '^[a-z]{2,3}([-_][A-Za-z0-9]+)?$')), true)"
    return f"""{name}_s AS (SELECT p.query_id, p.unit_id, place, coverage, locator, string_split(locator, '/') AS parts FROM {pool} p JOIN units USING (unit_id) WHERE units.source_kind = 'markdown'),
 {name}_f AS (SELECT *, CASE WHEN list_contains(parts, 'docs') AND {shaped} > 0 THEN array_to_string(list_concat(parts[:{shaped} - 1], parts[{shaped} + 1:]), '/') ELSE locator END AS family FROM {name}_s),
 {name}_g AS (SELECT query_id, family, locator, max(coverage) AS coverage, min(place) AS first, locator = family AS lead FROM {name}_f GROUP BY ALL),
 {name}_l AS (SELECT query_id, locator FROM {name}_g QUALIFY row_number() OVER (PARTITION BY query_id, family ORDER BY coverage DESC, lead DESC, first, locator) > 1),
 {name} AS (SELECT * FROM {pool} WHERE (query_id, unit_id) NOT IN (SELECT f.query_id, f.unit_id FROM {name}_f f JOIN {name}_l l ON l.query_id = f.query_id AND l.locator = f.locator))"""


_LIMITS = admission.Limits()
# Attempts in order (lanes 0 required, 1 supporting, 2 fill); a walk carries what is taken, the hashes seen and the lane that is served.
_ADMITTED = f"""{_PRIORS.replace('WITH units', 'WITH RECURSIVE units')}, {sql_expanded('prior')},
 placed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank NULLS LAST, round(score, 9) DESC, unit_id) AS place FROM expanded) WHERE place <= {admission.POOL}),
 {sql_covered('placed', 'covered')}, {sql_siblings('covered', 'single')},
 pool AS MATERIALIZED (SELECT s.query_id, s.unit_id, s.place, u.source_kind, u.locator AS source_id, CASE WHEN u.source_kind = 'git_commit' THEN 'c' || (u.unit_id // 10) END AS commit, u.content_hash, u.token_count,
   CASE u.source_kind WHEN 'code' THEN 'current_truth' WHEN 'git_commit' THEN 'change_origin' WHEN 'agent_session' THEN 'prior_work' WHEN 'hindsight_memory' THEN 'curated_memory' ELSE 'design_rationale' END AS role,
   expanded OR named OR matched >= least(2, n_concepts) AS credible, CAST(e.embedding AS DOUBLE[]) AS v FROM single s JOIN units u USING (unit_id) LEFT JOIN embeddings e ON e.vec_id = s.unit_id),
 near AS (SELECT a.query_id, a.unit_id, list(b.unit_id) AS twins FROM pool a JOIN pool b ON b.query_id = a.query_id AND b.role = a.role AND b.unit_id <> a.unit_id WHERE list_cosine_similarity(a.v, b.v) > {admission.NEAR_DUPLICATE} GROUP BY ALL),
 {C.sql_facets('q')}, wanted AS (SELECT query_id, role, row_number() OVER (PARTITION BY query_id ORDER BY n, k) AS turn FROM (SELECT query_id, role, n, k, lag(role) OVER (PARTITION BY query_id ORDER BY n, k) AS before FROM f JOIN (VALUES {C.ROLE_ROWS}) r(facet, k, role) USING (facet)) WHERE before IS NULL OR before <> role),
 tries AS (SELECT w.query_id, 0 AS lane, w.turn, p.unit_id, p.place FROM wanted w JOIN pool p ON p.query_id = w.query_id AND p.role = w.role
  UNION ALL SELECT p.query_id, 1, o.turn, p.unit_id, p.place FROM pool p JOIN (VALUES {", ".join(f"('{r}', {k})" for k, r in enumerate(T.ROLE_ORDER))}) o(role, turn) ON o.role = p.role WHERE credible AND (p.query_id, p.role) NOT IN (SELECT query_id, role FROM wanted)
  UNION ALL SELECT query_id, 2, place, unit_id, place FROM pool WHERE source_kind <> 'git_commit' OR credible),
 step AS MATERIALIZED (SELECT t.query_id, row_number() OVER (PARTITION BY t.query_id ORDER BY lane, turn, t.place, t.unit_id) AS n, lane, lane * 1000 + turn AS serving, t.unit_id, t.place, p.source_kind, source_id, p.commit, content_hash, token_count, role, coalesce(twins, []) AS twins
  FROM tries t JOIN pool p ON p.query_id = t.query_id AND p.unit_id = t.unit_id LEFT JOIN near x ON x.query_id = t.query_id AND x.unit_id = t.unit_id),
 walk AS (SELECT query_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS spent, -1 AS served, CAST([] AS VARCHAR[]) AS seen,
   CAST([] AS STRUCT(unit_id BIGINT, place BIGINT, tokens BIGINT, role VARCHAR, lane INTEGER, source VARCHAR, commit VARCHAR)[]) AS taken FROM (SELECT DISTINCT query_id FROM pool)
  UNION ALL SELECT query_id, n, CASE WHEN fits THEN spent + token_count ELSE spent END, CASE WHEN fits AND lane < 2 THEN serving ELSE served END, CASE WHEN opened THEN list_append(seen, content_hash) ELSE seen END,
   CASE WHEN fits THEN list_append(taken, {{'unit_id': unit_id, 'place': place, 'tokens': token_count, 'role': role, 'lane': lane, 'source': source_id, 'commit': commit}}) ELSE taken END
  FROM (SELECT *, opened AND spent + token_count <= {_LIMITS.max_tokens} AND NOT list_has_any(list_transform(taken, lambda t: t.unit_id), twins) AS fits
   FROM (SELECT s.*, w.spent, w.served, w.seen, w.taken, (s.lane = 2 OR s.serving <> w.served) AND NOT list_contains(list_transform(w.taken, lambda t: t.unit_id), s.unit_id)
     AND CASE WHEN s.role = 'curated_memory' THEN len(list_filter(w.taken, lambda t: t.role = 'curated_memory')) < {_LIMITS.memory} ELSE s.lane = 0 OR len(list_filter(w.taken, lambda t: t.source = s.source_id)) < {_LIMITS.per_source} END
     AND (s.source_kind <> 'git_commit' OR (len(list_filter(w.taken, lambda t: t.commit = s.commit)) < {_LIMITS.per_commit} AND len(list_filter(w.taken, lambda t: t.commit = s.commit AND t.source = s.source_id)) = 0))
     AND NOT list_contains(w.seen, s.content_hash) AS opened FROM walk w JOIN step s ON s.query_id = w.query_id AND s.n = w.n + 1))),
 ended AS (SELECT query_id, arg_max(taken, n) AS taken FROM walk GROUP BY query_id),
 admitted AS (SELECT query_id, t.unit_id, t.place, t.tokens AS token_count, t.role, ['required', 'supporting', 'fill'][t.lane + 1] AS lane, row_number() OVER (PARTITION BY query_id ORDER BY t.place, t.unit_id) AS position FROM (SELECT query_id, unnest(taken) AS t FROM ended))"""


@query(f"{_ADMITTED} SELECT * FROM admitted")
def full_admission(spark: SparkSession, d: str) -> DataFrame:
    """All lanes, caps, budget and near-duplicate rules."""
    out = admission.admit(pool_of(spark, d).drop("evidence_text", "timestamp"))
    return out.withColumns({"place": F.col("place").cast("long"), "position": F.col("position").cast("long")})


NOW = 1_731_000_000


@query(f"""{_ADMITTED}, shown AS (SELECT a.query_id, a.position, a.token_count, u.source_kind, u.locator, u.evidence_text, greatest({NOW} - u.timestamp, 0) AS age, strftime(make_timestamp(u.timestamp * 1000000), '%Y-%m-%d') AS day FROM admitted a JOIN units u USING (unit_id)),
 items AS (SELECT query_id, sum(token_count) AS token_count, count(*) AS n_items, to_json(list({{'position': position, 'source_kind': source_kind, 'source_locator': locator, 'evidence_text': evidence_text,
  'timestamp': CASE WHEN age < 3600 THEN (age // 60) || 'm ago' WHEN age < 86400 THEN (age // 3600) || 'h ago' WHEN age < 31536000 THEN day || ' (' || (age // 86400) || 'd ago)' ELSE day END}} ORDER BY position)) AS items FROM shown GROUP BY query_id)
 SELECT q.query_id, q.text AS query, CAST(coalesce(token_count, 0) AS BIGINT) AS token_count, coalesce(n_items, 0) AS n_items, CAST(items AS VARCHAR) AS items FROM q LEFT JOIN items USING (query_id)""")
def context_packet(spark: SparkSession, d: str) -> DataFrame:
    """One packet a question: the items as JSON, their number and tokens."""
    return packets.packets(pool_of(spark, d), C.questions(spark, d), NOW).withColumn("items", F.to_json("items"))
