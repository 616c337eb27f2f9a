"""From a batch of questions to their context packets, over any unit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.scratch import small, written
from lodestone.operators import admission, graph, ranking

TEXTS = ["evidence_text", "routing_text"]
TOP = 25


def clamp_tokens(asked: int | None) -> int:
    """The token budget that a caller gets for what they ask."""
    return admission.Limits().max_tokens if asked is None else max(100, min(32_000, asked))


def eligible(units: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, unit_id) of curated memories that a question's tiers show; other units are always eligible."""
    tiers = questions.select("query_id", F.explode(T.visibility(T.facets(F.col("text")))).alias("tier"))
    memories = units.filter("source_kind = 'hindsight_memory'").select("unit_id", T.tier_of_status(F.coalesce("status", F.lit("unknown"))).alias("tier"))
    return tiers.join(memories, "tier").select("query_id", "unit_id")


def channels(units: DataFrame, questions: DataFrame, columns: list[str], excluded: DataFrame | None, top_n: int) -> DataFrame:
    """The lexical channels: hidden memories and excluded units are gone before the limit."""
    tier = F.when(F.col("source_kind") == "hindsight_memory", T.tier_of_status(F.coalesce("status", F.lit("unknown"))))
    tiers = questions.select("query_id", F.explode(T.visibility(T.facets(F.col("text")))).alias("gate"))
    scored = ranking.bm25(units, questions, columns, TEXTS, n=top_n, gate=tier, opened=tiers, excluded=excluded)
    return ranking.top(scored, top_n, by=("query_id", "channel"))


def pool(ranked: DataFrame, units: DataFrame, anchors: DataFrame, vectors: DataFrame | None, questions: DataFrame, memories: DataFrame | None = None, hidden_but: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """The pool of each question with all that admission looks at; ``ranked``: query_id, unit_id, score, rank.

    Of ``memories`` (unit_id) only those in ``hidden_but`` (query_id, unit_id) are reached, and none of ``excluded`` (unit_id).
    ``units`` needs commit, path, symbol and part beside the ranking's columns.  Ranks and pool are written: both are read several times.
    """
    ranked = written(ranked)
    order = written(graph.selection_order(graph.expand(ranked, anchors, units, questions, memories, hidden_but, excluded)).filter(F.col("place") <= admission.POOL))
    asked = questions.select("query_id", F.col("text").alias("question"), T.concepts(F.col("text")).alias("concepts"), T.required_roles(T.facets(F.col("text"))).alias("required"))
    rows = units.join(small(order), "unit_id").join(asked, "query_id")
    # Both texts of a unit answer for it.
    said = F.concat("evidence_text", F.lit("\n"), "routing_text")
    rows = rows.withColumn("coverage", T.term_coverage(F.col("question"), said)).withColumn("credible", T.credible(F.col("concepts"), said, F.col("expanded")))
    rows = written(rows)
    kept = graph.suppress_siblings(rows.select("query_id", "unit_id", "place", "coverage"), units).select("query_id", "unit_id")
    rows = rows.join(kept, ["query_id", "unit_id"], "left_semi")
    near = vectors.select("unit_id", "embedding").join(small(order.select("unit_id").distinct()), "unit_id", "left_semi") if vectors is not None else None
    rows = rows.join(near, "unit_id", "left") if near is not None else rows.withColumn("embedding", F.lit(None).cast("array<double>"))
    return written(rows.select(
        "query_id", "unit_id", "place", "source_kind", T.role_of_kind(F.col("source_kind")).alias("role"), F.col("locator").alias("source_id"), "commit", "path", "symbol", "part",
        "content_hash", "token_count", "credible", "required", "embedding", "evidence_text", "timestamp",
    ))


def packets(pool_rows: DataFrame, questions: DataFrame, now: int, limits: admission.Limits = admission.Limits()) -> DataFrame:
    """One row a question: query, token_count, n_items and the items as an array in selection order."""
    taken = admission.admit(pool_rows.drop("evidence_text", "timestamp"), limits).select("query_id", "unit_id", "position")
    shown = T.render_time(F.col("timestamp"), F.lit(now).cast("long"))
    item = F.struct("position", "source_kind", F.col("source_id").alias("source_locator"), "evidence_text", shown.alias("timestamp"))
    rows = taken.join(pool_rows, ["query_id", "unit_id"])
    done = rows.groupBy("query_id").agg(F.sum("token_count").alias("token_count"), F.count("*").alias("n_items"), F.array_sort(F.collect_list(item)).alias("items"))
    zero = F.lit(0).cast("long")
    return questions.join(done, "query_id", "left").select("query_id", F.col("text").alias("query"), F.coalesce("token_count", zero).alias("token_count"), F.coalesce("n_items", zero).alias("n_items"), "items")
