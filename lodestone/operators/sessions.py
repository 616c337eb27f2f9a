"""Agent-session logs: sealed prefixes, episodes, runs, tool calls and their outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NEWEST = 200


def sealed(lines: DataFrame, is_seal: Column) -> DataFrame:
    """The lines of each session up to its last seal; a session without one has none. Needs session, line_no."""
    seals = lines.filter(is_seal).groupBy("session").agg(F.max("line_no").alias("sealed_to"))
    return lines.join(seals, "session").filter(F.col("line_no") <= F.col("sealed_to")).drop("sealed_to")


def episodes(turns: DataFrame, newest: int = NEWEST) -> DataFrame:
    """Turns with the number of their episode; one starts at each non-empty user turn and the newest ones stay.

    Needs session, line_no, role, text. What comes before the first user turn belongs to no episode.
    """
    starts = (F.col("role") == "user") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    running = Window.partitionBy("session").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = turns.withColumn("episode", F.sum(starts.cast("long")).over(running)).filter("episode > 0")
    last = Window.partitionBy("session")
    return numbered.withColumn("_last", F.max("episode").over(last)).filter(F.col("episode") > F.col("_last") - newest).drop("_last")


def episode_units(turns: DataFrame) -> DataFrame:
    """One row for each episode: its bounds, number of turns by role, and the body text."""
    label = F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Assistant: ").otherwise("Tool: ")
    line = F.struct("line_no", F.concat(label, F.coalesce("text", F.lit(""))).alias("line"))
    grouped = episodes(turns).groupBy("session", "episode").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n_turns"),
        F.count(F.when(F.col("role") == "assistant", 1)).alias("n_assistant"), F.array_sort(F.collect_list(line)).alias("lines"),
    )
    return grouped.withColumn("body", F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).drop("lines")


def runs(events: DataFrame) -> DataFrame:
    """Finished runs of event-sourced sessions: needs session, run_id, sequence, kind, model, usage (map)."""
    sums = events.select("session", "run_id", F.explode("usage").alias("key", "value")).groupBy("session", "run_id", "key").agg(F.sum("value").alias("value"))
    usage = sums.groupBy("session", "run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("usage"))
    whole = events.groupBy("session", "run_id").agg(
        F.min("sequence").alias("start"), F.max("sequence").alias("end"), F.max_by("model", F.when(F.col("model").isNotNull(), F.col("sequence"))).alias("model"),
        F.max((F.col("kind") == "terminal").cast("int")).alias("_done"), F.max((F.col("kind") == "started").cast("int")).alias("_begun"),
    )
    return whole.filter("_done = 1 and _begun = 1").drop("_done", "_begun").join(usage, ["session", "run_id"], "left")


def outcomes(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each tool call with its outcome: the first result of its id decides, a JSON result refines it.

    ``calls``: session, call_id, name. ``results``: session, call_id, line_no, text.
    """
    first = results.groupBy("session", "call_id").agg(F.min_by("text", "line_no").alias("result"))
    return calls.join(first, ["session", "call_id"], "left").select("session", "call_id", "name", *outcome_columns(F.col("result")))


def outcome_columns(result: Column) -> list[Column]:
    """outcome, exit_code, duration_ms, tests_passed and tests_failed from the text of a tool's result."""
    get = lambda *paths: F.coalesce(*(F.get_json_object(result, p).try_cast("long") for p in paths))
    code = get("$.exitCode", "$.exit_code")
    failed = get("$.failed", "$.testsFailed")
    outcome = F.when(result.isNull(), "unknown").when(code == 0, "passed").when(code.isNotNull(), "failed").when(failed > 0, "failed").when(failed == 0, "passed").otherwise("finished")
    return [outcome.alias("outcome"), code.alias("exit_code"), get("$.durationMs", "$.duration_ms").alias("duration_ms"), get("$.testsPassed", "$.passed").alias("tests_passed"), failed.alias("tests_failed")]
