"""Queries over text functions: tokens, questions, concepts, locators, times, chunks, sessions, tool results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking, concepts, sessions
from lodestone.plans import corpus as C
from lodestone.plans.registry import QueryTable, registrar

QUERIES: QueryTable = {}
query = registrar(QUERIES)

WORDS = ["why", "when", "history", "conflict", "instead of", "needs review", "how", "test", "same rule", "not yet confirmed", "legacy", "previous"]


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Each question led by one of the facet words, by its number."""
    return C.questions(spark, d).select("query_id", F.concat(C.pick(WORDS, F.col("query_id") % len(WORDS)), F.lit(" "), F.when(F.col("query_id") % 5 == 0, F.concat(C.pick(WORDS, F.floor(F.col("query_id") / 5) % len(WORDS)), F.lit(" "))).otherwise(""), "text").alias("text"))


_ASKED = f"""{C.SQL_QUESTIONS}, a AS (SELECT query_id, {C.sql_list(WORDS)}[query_id % {len(WORDS)} + 1] || ' ' ||
 CASE WHEN query_id % 5 = 0 THEN {C.sql_list(WORDS)}[(query_id // 5) % {len(WORDS)} + 1] || ' ' ELSE '' END || text AS text FROM q)"""


def _sql_facets() -> str:
    return f"{_ASKED}, {C.sql_facets('a')}"


@query("SELECT doc_id, greatest(CAST(ceil(length(text) / 4.0) AS BIGINT), 1) AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return C.read(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({C.sql_index_terms('text')}) AS term FROM documents) GROUP BY ALL")
def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    return C.read(spark, d, "documents").select("doc_id", F.explode(T.index_terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({C.sql_index_terms('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def term_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return tokenize_terms(spark, d).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"SELECT lang, count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms, round(avg(n), 6) AS mean, CAST(max(n) AS BIGINT) AS longest FROM (SELECT lang, len({C.sql_index_terms('text')}) AS n FROM documents) GROUP BY lang")
def doc_length_stats(spark: SparkSession, d: str) -> DataFrame:
    n = C.read(spark, d, "documents").select("lang", F.size(T.index_terms(F.col("text"))).cast("long").alias("n"))
    return n.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("terms"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("longest"))


@query(f"WITH {_sql_facets()} SELECT query_id, string_agg(facet, ',' ORDER BY n) AS facets FROM f GROUP BY query_id")
def facet_detection(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("query_id", F.array_join(T.facets(F.col("text")), ",").alias("facets"))


@query(f"""WITH {_sql_facets()}, g AS (SELECT query_id, bool_or(facet = 'review_state') AS r, bool_or(facet = 'evolution') AS e, bool_or(facet = 'conflict') AS c FROM f GROUP BY query_id)
 SELECT query_id, CASE WHEN r OR (e AND c) THEN 'default,history,review' WHEN e THEN 'default,history' WHEN c THEN 'default,review' ELSE 'default' END AS tiers FROM g""")
def visibility_tiers(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("query_id", F.array_join(T.visibility(T.facets(F.col("text"))), ",").alias("tiers"))


@query(f"""WITH {_sql_facets()}, r(facet, k, role) AS (VALUES {C.ROLE_ROWS}),
 s AS (SELECT query_id, role, n, k, lag(role) OVER (PARTITION BY query_id ORDER BY n, k) AS before FROM f JOIN r USING (facet))
 SELECT query_id, string_agg(role, ',' ORDER BY n, k) AS roles FROM s WHERE before IS NULL OR before <> role GROUP BY query_id""")
def preferred_role_lanes(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("query_id", F.array_join(T.required_roles(T.facets(F.col("text"))), ",").alias("roles"))


@query(f"""WITH {C.SQL_UNITS} SELECT source_kind, CASE source_kind WHEN 'code' THEN 'current_truth' WHEN 'markdown' THEN 'design_rationale' WHEN 'git_commit' THEN 'change_origin' WHEN 'agent_session' THEN 'prior_work' ELSE 'curated_memory' END AS role,
 CASE status WHEN 'active' THEN 'default' WHEN 'superseded' THEN 'history' ELSE 'review' END AS tier, count(*) AS n FROM units GROUP BY ALL""")
def role_of_kind(spark: SparkSession, d: str) -> DataFrame:
    return C.units(spark, d).select("source_kind", T.role_of_kind(F.col("source_kind")).alias("role"), T.tier_of_status(F.col("status")).alias("tier")).groupBy("source_kind", "role", "tier").agg(F.count("*").alias("n"))


_CONCEPTS = f"""{_ASKED}, odd AS (SELECT query_id, text || ' fooBar snake_case' AS text FROM a), {C.sql_concepts('odd')}"""


def _concepts(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("query_id", T.concepts(F.concat("text", F.lit(" fooBar snake_case"))).alias("concepts"))


@query(f"WITH {_CONCEPTS} SELECT query_id, raw, array_to_string(pieces, ' ') AS pieces, identifier, row_number() OVER (PARTITION BY query_id ORDER BY n) AS position FROM k")
def query_concepts(spark: SparkSession, d: str) -> DataFrame:
    rows = _concepts(spark, d).select("query_id", F.posexplode("concepts").alias("at", "c"))
    return rows.select("query_id", F.col("c.raw").alias("raw"), F.array_join("c.pieces", " ").alias("pieces"), F.col("c.identifier").alias("identifier"), (F.col("at") + 1).cast("long").alias("position"))


@query(f"""WITH {_CONCEPTS}, {C.SQL_UNITS}, t AS MATERIALIZED (SELECT unit_id, lower(evidence_text || chr(10) || routing_text) AS low, {C.sql_terms('evidence_text || chr(10) || routing_text')} AS words FROM units),
 pairs AS (SELECT k.query_id, t.unit_id, k.identifier, count(*) OVER (PARTITION BY k.query_id, t.unit_id) AS total,
  CASE WHEN regexp_matches(k.raw, '[^\\p{{L}}\\p{{N}}]') THEN contains(low, k.raw) OR len(list_filter(k.pieces, lambda p: NOT list_contains(words, p))) = 0 ELSE list_contains(words, k.raw) END AS hit FROM k, t)
 SELECT query_id, unit_id, count(CASE WHEN hit THEN 1 END) AS matched, bool_or(hit AND identifier) OR count(CASE WHEN hit THEN 1 END) >= least(2, max(total)) AS credible FROM pairs GROUP BY ALL HAVING bool_or(hit)""")
def credible_filter(spark: SparkSession, d: str) -> DataFrame:
    """Every unit that holds a concept of a question, for all questions, and whether it holds enough of them."""
    units = C.units(spark, d).select("unit_id", F.concat("evidence_text", F.lit("\n"), "routing_text").alias("text"))
    return concepts.credible_pairs(units, _concepts(spark, d))


@query(f"""WITH {C.SQL_UNITS}, p AS (SELECT unit_id, locator, string_split(locator, '/') AS s FROM units), x AS (SELECT unit_id, locator, s, list_position(list_transform(s, lambda v: regexp_matches(v, '^[a-z]{{2,3}}([-_][A-Za-z0-9]+)?$')), true) AS pos FROM p)
 SELECT unit_id, locator, CASE WHEN list_contains(s, 'docs') AND pos > 0 THEN array_to_string(list_concat(s[:pos - 1], s[pos + 1:]), '/') ELSE locator END AS family FROM x""")
def locale_family(spark: SparkSession, d: str) -> DataFrame:
    return C.units(spark, d).select("unit_id", "locator", T.doc_family(F.col("locator")).alias("family"))


NOW = 1_731_000_000


@query(f"""WITH {C.SQL_UNITS}, a AS (SELECT unit_id, timestamp AS t, greatest({NOW} - timestamp, 0) AS age FROM (SELECT unit_id, CASE unit_id % 4 WHEN 0 THEN {NOW} - unit_id * 7 WHEN 1 THEN {NOW} - unit_id * 400 ELSE timestamp END AS timestamp FROM units))
 SELECT unit_id, CASE WHEN age < 3600 THEN (age // 60) || 'm ago' WHEN age < 86400 THEN (age // 3600) || 'h ago' WHEN age < 31536000 THEN strftime(make_timestamp(t * 1000000), '%Y-%m-%d') || ' (' || (age // 86400) || 'd ago)' ELSE strftime(make_timestamp(t * 1000000), '%Y-%m-%d') END AS shown FROM a""")
def timestamp_render(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("unit_id")
    t = F.when(i % 4 == 0, F.lit(NOW) - i * 7).when(i % 4 == 1, F.lit(NOW) - i * 400).otherwise(F.col("timestamp")).cast("long")
    return C.units(spark, d).select("unit_id", T.render_time(t, F.lit(NOW).cast("long")).alias("shown"))


@query("""WITH e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'not a time at all, no' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.123Z' END AS v FROM events)
 SELECT event_id, CAST(epoch(try_strptime(substr(v, 1, 19), '%Y-%m-%dT%H:%M:%S')) AS BIGINT) AS seconds FROM e""")
def iso_timestamp_parse(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("event_id") % 7 == 0, "not a time at all, no").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123Z")))
    return C.read(spark, d, "events").select("event_id", T.parse_time(v).alias("seconds"))


_TRIM = r"""^[`,.;:()\[\]{}"''<>!?*]+|[`,.;:()\[\]{}"''<>!?*]+$"""


@query(rf"""WITH p AS (SELECT page_id, html || ' see `my_name` and [x](docs/a.md)' AS t FROM pages),
 m AS (SELECT page_id, list_concat(list_filter(regexp_extract_all(t, '`([^`\s]+)`', 1), lambda x: x <> ''), regexp_extract_all(t, '\]\(([^)\s]+)\)', 1), list_filter(string_split_regex(t, '\s+'), lambda x: contains(x, '/') OR contains(x, '::') OR contains(x, '_') OR x LIKE '%.rs' OR x LIKE '%.md')) AS l FROM p),
 c AS (SELECT page_id, list_sort(list_distinct(list_filter(list_transform(l, lambda x: regexp_replace(x, '{_TRIM}', '', 'g')), lambda x: x <> '' AND strlen(x) <= 256)))[1:32] AS l FROM m)
 SELECT page_id, CAST(len(l) AS BIGINT) AS n, array_to_string(l, ' ') AS mentions FROM c""")
def mention_extraction(spark: SparkSession, d: str) -> DataFrame:
    found = C.read(spark, d, "pages").select("page_id", T.mentions(F.concat("html", F.lit(" see `my_name` and [x](docs/a.md)"))).alias("m"))
    return found.select("page_id", F.size("m").cast("long").alias("n"), F.array_join("m", " ").alias("mentions"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, line, n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)),
 r AS (SELECT doc_id, n, CAST(0 AS BIGINT) AS first, CAST(length(line) AS BIGINT) AS chars FROM l WHERE n = 0
  UNION ALL SELECT l.doc_id, l.n, CASE WHEN greatest(ceil((r.chars + 2 + length(l.line)) / 4.0), 1) <= 800 THEN r.first ELSE l.n END, CASE WHEN greatest(ceil((r.chars + 2 + length(l.line)) / 4.0), 1) <= 800 THEN r.chars + 2 + length(l.line) ELSE length(l.line) END FROM r JOIN l ON l.doc_id = r.doc_id AND l.n = r.n + 1)
 SELECT doc_id, first, max(n) AS last, greatest(CAST(ceil(max(chars) / 4.0) AS BIGINT), 1) AS tokens FROM r GROUP BY doc_id, first""")
def prose_packing(spark: SparkSession, d: str) -> DataFrame:
    packed = C.read(spark, d, "documents").select("doc_id", F.inline(chunking.pack_lines(F.split("text", "\n", -1))))
    return packed.select("doc_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "tokens")


@query("""WITH RECURSIVE r AS (SELECT doc_id, text AS rest, CAST(0 AS BIGINT) AS start, CAST(-1 AS BIGINT) AS size FROM documents
  UNION ALL SELECT doc_id, substr(rest, cut + 1), start + greatest(size, 0), cut FROM (SELECT *, CASE WHEN length(rest) <= 3200 THEN length(rest) ELSE CASE WHEN regexp_matches(substr(rest, 1, 3200), '[.\\n]') THEN 3200 - (length(regexp_extract(substr(rest, 1, 3200), '[^.\\n]*$'))) ELSE 3200 END END AS cut FROM r WHERE rest <> '' OR size < 0))
 SELECT doc_id, start, size FROM r WHERE size >= 0""")
def oversize_split(spark: SparkSession, d: str) -> DataFrame:
    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(i, s, e - s) for i, t in zip(f["doc_id"], f["text"], strict=True) for _, s, e in chunking.split_oversized(t or "", 3200)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "size"])

    return C.read(spark, d, "documents").select("doc_id", "text").mapInPandas(run, "doc_id bigint, start bigint, size bigint")


_TURNS = "t AS (SELECT conv_id AS session, turn AS line_no, role, text FROM conversations)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return C.read(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("line_no"), "role", "text")


@query(f"""WITH {_TURNS}, n AS (SELECT *, sum(CASE WHEN role = 'user' AND trim(coalesce(text, '')) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY line_no) AS episode FROM t),
 m AS (SELECT *, max(episode) OVER (PARTITION BY session) AS last FROM n WHERE episode > 0)
 SELECT session, CAST(episode AS BIGINT) AS episode, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_turns, count(CASE WHEN role = 'assistant' THEN 1 END) AS n_assistant,
 sha256(string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' ELSE 'Tool: ' END || coalesce(text, ''), chr(10) ORDER BY line_no)) AS body FROM m WHERE episode > last - 200 GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY session, episode"))
def session_episodes(spark: SparkSession, d: str) -> DataFrame:
    return sessions.episode_units(_turns(spark, d)).withColumn("body", F.sha2("body", 256))


@query("""WITH s AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no, event_type, event_id FROM events),
 m AS (SELECT session, max(line_no) AS upto FROM s WHERE event_type = 'purchase' GROUP BY session) SELECT s.session, line_no, event_id FROM s JOIN m ON s.session = m.session WHERE line_no <= upto""")
def sealed_prefix(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    lines = C.read(spark, d, "events").select(F.col("user_id").alias("session"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("line_no"), "event_type", "event_id")
    return sessions.sealed(lines, F.col("event_type") == "purchase").select("session", "line_no", "event_id")


@query("""WITH e AS (SELECT user_id % 20 AS session, 'r' || user_id AS run_id, event_id AS sequence, CASE WHEN event_id % 11 = 0 THEN 'terminal' WHEN event_id % 3 = 0 THEN 'started' ELSE 'model_completed' END AS kind,
  CASE WHEN event_id % 2 = 0 THEN 'm' || (event_id % 7) END AS model, event_type AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events),
 w AS (SELECT session, run_id, min(sequence) AS start, max(sequence) AS "end", arg_max(model, sequence) FILTER (WHERE model IS NOT NULL) AS model FROM e GROUP BY session, run_id HAVING bool_or(kind = 'terminal') AND bool_or(kind = 'started'))
 SELECT w.session, w.run_id, start, "end", model, key, value FROM w JOIN (SELECT session, run_id, key, CAST(sum(value) AS BIGINT) AS value FROM e GROUP BY session, run_id, key) u ON u.session = w.session AND u.run_id = w.run_id""")
def run_grouping_usage_sum(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    events = C.read(spark, d, "events").select(
        (F.col("user_id") % 20).alias("session"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), i.alias("sequence"),
        F.when(i % 11 == 0, "terminal").when(i % 3 == 0, "started").otherwise("model_completed").alias("kind"), F.when(i % 2 == 0, F.concat(F.lit("m"), (i % 7).cast("string"))).alias("model"),
        F.create_map("event_type", F.get_json_object("props", "$.k").cast("long")).alias("usage"),
    )
    return sessions.runs(events).select("session", "run_id", "start", "end", "model", F.explode("usage").alias("key", "value"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    text = F.when(i % 4 == 0, F.concat(F.lit('{"exitCode": '), (k % 3).cast("string"), F.lit(', "durationMs": '), k.cast("string"), F.lit("}"))).when(i % 4 == 1, F.concat(F.lit('{"passed": '), k.cast("string"), F.lit(', "failed": '), (k % 2).cast("string"), F.lit("}"))).otherwise("plain text")
    return C.read(spark, d, "events").select(F.col("user_id").alias("session"), (F.floor(i / 3)).alias("call_id"), i.alias("line_no"), "event_type", text.alias("text"))


_RESULTS = """r AS (SELECT user_id AS session, event_id // 3 AS call_id, event_id AS line_no, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
 x AS (SELECT *, CASE line_no % 4 WHEN 0 THEN k % 3 END AS exit_code, CASE line_no % 4 WHEN 0 THEN k END AS duration_ms, CASE line_no % 4 WHEN 1 THEN k END AS tests_passed, CASE line_no % 4 WHEN 1 THEN k % 2 END AS tests_failed FROM r)"""
_OUTCOME = "CASE WHEN exit_code = 0 THEN 'passed' WHEN exit_code IS NOT NULL THEN 'failed' WHEN tests_failed > 0 THEN 'failed' WHEN tests_failed = 0 THEN 'passed' ELSE 'finished' END"


@query(f"WITH {_RESULTS} SELECT line_no, {_OUTCOME} AS outcome, exit_code, duration_ms, tests_passed, tests_failed FROM x")
def json_outcome_upgrade(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select("line_no", *sessions.outcome_columns(F.col("text")))


@query(f"""WITH {_RESULTS}, c AS (SELECT DISTINCT session, call_id, 'tool' AS name FROM r UNION ALL SELECT -1, -1, 'lost'),
 y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY session, call_id ORDER BY line_no) = 1)
 SELECT c.session, c.call_id, c.name, CASE WHEN y.session IS NULL THEN 'unknown' ELSE {_OUTCOME} END AS outcome, exit_code, duration_ms, tests_passed, tests_failed FROM c LEFT JOIN y ON y.session = c.session AND y.call_id = c.call_id""")
def tool_result_join(spark: SparkSession, d: str) -> DataFrame:
    results = _results(spark, d)
    calls = results.select("session", "call_id", F.lit("tool").alias("name")).distinct()
    lost = spark.createDataFrame([(-1, -1, "lost")], calls.schema)
    return sessions.outcomes(calls.unionByName(lost), results)


_HASHED = "list_transform(range(10), lambda i: CAST('0x' || substr(sha256(text), 2 * i + 1, 2) AS INTEGER) / 255.0::DOUBLE)"


@query(f"""WITH w AS (SELECT doc_id, text, lower(text) AS t FROM documents), k AS (SELECT doc_id, text, CAST([contains(t,'retry')::INT + contains(t,'backoff')::INT, contains(t,'cache')::INT, contains(t,'database')::INT + contains(t,'sqlite')::INT, contains(t,'history')::INT + contains(t,'commit')::INT,
  contains(t,'auth')::INT + contains(t,'authentication')::INT, contains(t,'token')::INT, contains(t,'session')::INT, contains(t,'markdown')::INT, contains(t,'parser')::INT, contains(t,'route')::INT] AS DOUBLE[]) AS v FROM w),
 r AS (SELECT doc_id, CASE WHEN list_sum(v) > 0 THEN v ELSE {_HASHED} END AS v FROM k)
 SELECT doc_id, i AS dimension, round(v[i] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS value FROM r, (SELECT unnest(range(1, 11)) AS i)""")
def mock_embedding(spark: SparkSession, d: str) -> DataFrame:
    """The vector of every document, a row for each dimension."""
    docs = T.mock_embedding(C.read(spark, d, "documents"), "doc_id", "text").select("doc_id", F.posexplode("vector").alias("at", "value"))
    return docs.select("doc_id", (F.col("at") + 1).cast("long").alias("dimension"), F.round("value", 6).alias("value"))


@query("""WITH p AS (SELECT page_id, 'a/b.' || ['py','MD','txt','bin','rs','JPG','h','markdown'][page_id % 8 + 1] AS path FROM pages)
 SELECT page_id, path, CASE WHEN lower(path) SIMILAR TO '.*\\.(py|rs|h)' THEN 'code' WHEN lower(path) SIMILAR TO '.*\\.(md|markdown)' THEN 'markdown' WHEN lower(path) LIKE '%.txt' THEN 'text' END AS kind FROM p""")
def source_classifier(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("a/b."), C.pick(["py", "MD", "txt", "bin", "rs", "JPG", "h", "markdown"], F.col("page_id") % 8))
    return C.read(spark, d, "pages").select("page_id", path.alias("path")).select("page_id", "path", T.source_kind(F.col("path")).alias("kind"))
