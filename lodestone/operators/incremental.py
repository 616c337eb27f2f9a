"""Incremental maintenance of the stored tables as set-based differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def changed_sources(candidates: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Sources (locator, content_hash, ...) that are new or whose content has changed; all of them if forced."""
    return candidates if force else candidates.join(stored.select("locator", "content_hash"), ["locator", "content_hash"], "left_anti")


def present_sources(stored: DataFrame, present: DataFrame) -> DataFrame:
    """The stored sources that still exist."""
    return stored.join(present.select("locator").distinct(), "locator", "left_semi")


def match_units(old: DataFrame, new: DataFrame) -> DataFrame:
    """Units of a source matched by content as a multiset, first in first out.

    ``old``: source, content_hash, unit_id. ``new``: source, content_hash, ordinal. Result: source, content_hash,
    unit_id, ordinal, outcome (reused, added or removed).
    """
    nth = lambda by: F.row_number().over(Window.partitionBy("source", "content_hash").orderBy(by))
    a = old.select("source", "content_hash", "unit_id").withColumn("nth", nth("unit_id"))
    b = new.select("source", "content_hash", "ordinal").withColumn("nth", nth("ordinal"))
    outcome = F.when(F.col("unit_id").isNull(), "added").when(F.col("ordinal").isNull(), "removed").otherwise("reused")
    return a.join(b, ["source", "content_hash", "nth"], "full_outer").select("source", "content_hash", "unit_id", "ordinal", outcome.alias("outcome"))


def valid_vectors(vectors: DataFrame, old_units: DataFrame, new_units: DataFrame) -> DataFrame:
    """The vectors whose own text is unchanged; ``*_units``: unit_id, evidence_text, routing_text."""
    pairs = old_units.alias("o").join(new_units.alias("n"), "unit_id")
    stale = pairs.select("unit_id", F.explode(F.array_compact(F.array(F.when(F.col("o.evidence_text") != F.col("n.evidence_text"), F.lit("evidence")), F.when(F.col("o.routing_text") != F.col("n.routing_text"), F.lit("routing"))))).alias("kind"))
    return vectors.join(stale, ["unit_id", "kind"], "left_anti").join(new_units.select("unit_id"), "unit_id", "left_semi")


def missing_vectors(units: DataFrame, vectors: DataFrame, kind: str, model: str) -> DataFrame:
    """Units without a vector of this kind and model."""
    have = vectors.filter((F.col("kind") == kind) & (F.col("model_version") == model)).select("unit_id")
    return units.join(have, "unit_id", "left_anti")


def put_vectors(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables with the newer row for each unit, kind and model."""
    every = stored.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    order = Window.partitionBy("unit_id", "kind", "model_version").orderBy("_age")
    return every.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth", "_age")
