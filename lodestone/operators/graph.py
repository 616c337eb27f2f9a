"""The unit-anchor graph: lookups, pages, sessions of a symbol, and two-hop expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.functions.scratch import BROADCAST_BYTES, size_of, small, written

SEEDS, ACCEPTED, PAGE = 5, 6, 10
HIT, SYMBOL_HIT, OTHER_KIND = 0.02, 0.03, 0.01


def anchors_of(unit_anchors: DataFrame, units: DataFrame) -> DataFrame:
    """The anchors of the given units, numbered in order."""
    order = Window.partitionBy("unit_id").orderBy("kind", "value", "relationship")
    return unit_anchors.join(units.select("unit_id").distinct(), "unit_id", "left_semi").dropDuplicates(["unit_id", "kind", "value", "relationship"]).withColumn("ordinal", F.row_number().over(order))


def first_units(unit_anchors: DataFrame, limit: int) -> DataFrame:
    """For each anchor its first ``limit`` units by id; each task cuts its own part of an anchor before units move."""
    order = Window.partitionBy("kind", "value").orderBy("unit_id")
    return unit_anchors.select("kind", "value", "unit_id").distinct().withColumn("ordinal", F.row_number().over(order)).filter(F.col("ordinal") <= limit)


def units_of(unit_anchors: DataFrame, limit: int) -> DataFrame:
    """For each anchor its first ``limit`` units by id, and how many more it has."""
    total = unit_anchors.select("kind", "value", "unit_id").distinct().groupBy("kind", "value").agg(F.count("*").alias("total"))
    page = first_units(unit_anchors, limit)
    return page.join(total, ["kind", "value"]).select("kind", "value", "unit_id", "ordinal", F.greatest(F.col("total") - limit, F.lit(0).cast("long")).alias("more"))


def sessions_of_symbols(unit_anchors: DataFrame, units: DataFrame) -> DataFrame:
    """(symbol, file, unit_id): session units that touched a file which defines a symbol."""
    defining = unit_anchors.filter("kind = 'symbol' and relationship = 'defines'").select("unit_id", F.col("value").alias("symbol"))
    files = unit_anchors.filter("kind = 'file' and relationship = 'defined_in'").select("unit_id", F.col("value").alias("file"))
    home = written(defining.join(files, "unit_id").select("symbol", "file").distinct())
    touched = unit_anchors.filter("kind = 'file' and relationship = 'touched'").select(F.col("value").alias("file"), "unit_id")
    sessions = units.filter("source_kind = 'agent_session'").select("unit_id")
    # Files are few and their symbols times their sessions many: units are dealt out one by one and meet all symbols of their file,
    # or the symbols of one group after the other where they are too many for a broadcast.  Both sides are distinct, so are the pairs.
    groups = 1 + size_of(home) // BROADCAST_BYTES
    spark = units.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = touched.join(sessions, "unit_id", "left_semi").repartition(tasks, "file", "unit_id").distinct()
    if groups > 1:
        home = home.withColumn("group", F.pmod(F.xxhash64("symbol"), F.lit(groups)))
        dealt = dealt.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    else:
        home = F.broadcast(home)
    return dealt.join(home, ["file", *(["group"] if groups > 1 else [])]).select("symbol", "file", "unit_id")


def expand(fused: DataFrame, unit_anchors: DataFrame, units: DataFrame, queries: DataFrame, memories: DataFrame | None = None, shown: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """(query_id, unit_id, score, rank, expanded): the fused list and the units reached from its first five.

    ``fused`` is a table in files. ``units``: unit_id, source_kind. ``queries``: query_id, text. Of ``memories`` (unit_id) only those in ``shown`` (query_id, unit_id) are candidates.
    Units in ``excluded`` (unit_id) are none, though they count towards an anchor's page.
    """
    # What leads on from the seeds is little, so it is written and goes to where units and anchors are.
    first = small(fused.filter(F.col("rank") <= SEEDS).select("query_id", F.col("unit_id").alias("seed"), F.col("rank").alias("seed_rank")))
    seeds = written(units.select(F.col("unit_id").alias("seed"), F.col("source_kind").alias("seed_kind")).join(first, "seed"))
    own = unit_anchors.select(F.col("unit_id").alias("seed"), "kind", "value", "relationship").join(small(seeds.select("seed").distinct()), "seed", "left_semi").distinct()
    paths = seeds.join(own, "seed")
    memory = F.col("seed_kind") == "hindsight_memory"
    # Of a memory's anchors two lead to its provenance and two along its lifecycle; its own name leads nowhere.
    family = F.when(~memory, F.lit("any")).when(F.col("kind") != "memory", F.lit("provenance")).when(F.col("relationship") != "self", F.lit("lifecycle"))
    paths = paths.withColumn("family", family).filter("family is not null")
    order = Window.partitionBy("query_id", "seed", "family").orderBy("kind", "value", "relationship")
    paths = written(paths.withColumn("nth", F.row_number().over(order)).filter("family = 'any' or nth <= 2"))
    # Pages of the anchors on some path only.
    led = unit_anchors.join(small(paths.select("kind", "value").distinct()), ["kind", "value"], "left_semi")
    pages = first_units(led, PAGE).select("kind", "value", "unit_id")
    reached = written(paths.join(pages, ["kind", "value"]).filter("unit_id <> seed"))
    hits = units.select("unit_id", "source_kind").join(small(reached), "unit_id")
    if excluded is not None:
        hits = hits.join(excluded.select("unit_id").distinct(), "unit_id", "left_anti")
    if memories is not None:
        free = hits.join(memories, "unit_id", "left_anti")
        hits = free.unionByName(hits.join(memories, "unit_id", "left_semi").join(shown, ["query_id", "unit_id"], "left_semi"))
    asked = queries.select("query_id", T.terms(F.col("text")).alias("asked"))
    kinds = seeds.groupBy("query_id").agg(F.collect_set("seed_kind").alias("seed_kinds"))
    named = F.exists(F.split(F.lower("value"), r"[^\p{L}\p{N}]+", -1), lambda s: (F.octet_length(s) > 2) & F.array_contains("asked", s))
    bonus = F.lit(HIT) + F.when((F.col("kind") == "symbol") & named, SYMBOL_HIT).otherwise(0.0) + F.when(~F.array_contains("seed_kinds", F.col("source_kind")), OTHER_KIND).otherwise(0.0)
    sums = hits.join(asked, "query_id").join(kinds, "query_id").groupBy("query_id", "unit_id").agg(F.sum(bonus).alias("bonus"))
    scored = sums.join(fused.select("query_id", "unit_id", F.col("score").alias("base"), "rank"), ["query_id", "unit_id"], "left").withColumn("total", F.coalesce("base", F.lit(0.0)) + F.col("bonus"))
    best = Window.partitionBy("query_id").orderBy(F.round("total", 9).desc(), F.col("unit_id"))
    taken = scored.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= ACCEPTED)
    kept = fused.join(taken.select("query_id", "unit_id", F.lit(True).alias("expanded")), ["query_id", "unit_id"], "left")
    new = taken.filter("base is null").select("query_id", "unit_id", F.col("total").alias("score"), F.lit(None).cast("int").alias("rank"), F.lit(True).alias("expanded"))
    return kept.select("query_id", "unit_id", "score", "rank", F.coalesce("expanded", F.lit(False)).alias("expanded")).unionByName(new)


def selection_order(expanded: DataFrame) -> DataFrame:
    """Numbers the selection: fused units by rank, then what only expansion found by score."""
    order = Window.partitionBy("query_id").orderBy(F.col("rank").asc_nulls_last(), F.round("score", 9).desc(), F.col("unit_id"))
    return expanded.withColumn("place", F.row_number().over(order))


def suppress_siblings(pool: DataFrame, units: DataFrame) -> DataFrame:
    """The pool without translations: of each documentation family one locator stays.

    ``pool``: query_id, unit_id, place, coverage, a table in files. The best is by coverage, then the locator without a locale, then the first place.
    """
    docs = units.filter("source_kind = 'markdown'").select("unit_id", "locator").join(small(pool), "unit_id").withColumn("family", T.doc_family(F.col("locator")))
    sources = docs.groupBy("query_id", "family", "locator").agg(F.max("coverage").alias("coverage"), F.min("place").alias("first"))
    order = Window.partitionBy("query_id", "family").orderBy(F.col("coverage").desc(), (F.col("locator") == F.col("family")).desc(), F.col("first"), F.col("locator"))
    losers = sources.withColumn("nth", F.row_number().over(order)).filter("nth > 1").select("query_id", "locator")
    gone = docs.join(losers, ["query_id", "locator"], "left_semi").select("query_id", "unit_id")
    return pool.join(gone, ["query_id", "unit_id"], "left_anti")
