"""Agent-session logs of both formats, and the ledger of curated memories, as DataFrames."""

from __future__ import annotations

import json
import sqlite3
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.operators import chunking, sessions

MAX_BYTES = 32 << 20
_ITEM = "struct<type:string,id:string,text:string,name:string,arguments:string,toolCallId:string,toolName:string>"
_LINE = f"type string, id string, timestamp string, cwd string, message struct<role:string,toolCallId:string,toolName:string,content:array<{_ITEM}>>"


def _lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    whole = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), "value").filter(F.octet_length("value") <= MAX_BYTES)
    return whole.select("file", F.posexplode(F.split("value", "\n", -1)).alias("line_no", "line")).filter("line <> ''")


def read_messages(spark: SparkSession, paths: list[str] | str, root: str) -> DataFrame:
    """(session, line_no, role, text, call_id, name, arguments) of the sealed part of each log that belongs to ``root``.

    A log starts with a header (id, cwd) and is sealed by compaction lines. Lines that are no JSON are ignored. A
    message gives one row for its text and one for each tool call.
    """
    rows = _lines(spark, paths).withColumn("j", F.from_json("line", _LINE)).filter("j.type is not null")
    heads = rows.filter("j.type = 'session'").groupBy("file").agg(F.min_by(F.struct("j.id", "j.cwd"), "line_no").alias("head"))
    own = heads.filter(F.col("head.cwd") == root).select("file", F.col("head.id").alias("session"))
    lines = sessions.sealed(rows.join(own, "file"), F.col("j.type") == "compaction").filter("j.type = 'message'")
    content = F.col("j.message.content")
    texts = F.array_join(F.transform(F.filter(content, lambda c: c["type"] == "text"), lambda c: c["text"]), "\n")
    role = F.col("j.message.role")
    said = lines.select("session", "line_no", role.alias("role"), texts.alias("text"), F.col("j.message.toolCallId").alias("call_id"), F.col("j.message.toolName").alias("name"), F.lit(None).cast("string").alias("arguments"))
    calls = lines.select("session", "line_no", F.explode(F.filter(content, lambda c: c["type"] == "toolCall")).alias("c")).select("session", "line_no", F.lit("toolCall").alias("role"), F.lit(None).cast("string").alias("text"), F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))
    return said.unionByName(calls)


_ENVELOPE = "schema_version int, id string, sequence bigint, recorded_at bigint, durability string, payload_type string, payload struct<kind:string,run_id:string,event:string>, retained_frame string, children array<struct<child_index:bigint,record_json:string>>, retained_marker string"


def read_events(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(session, sequence, kind, run_id, event) of event-sourced logs up to their last durable end.

    Frames hold their records as JSON strings. A log with a record of another version than 1 is rejected whole; a
    torn last line is ignored.
    """
    lines = _lines(spark, paths)
    outer = lines.withColumn("r", F.from_json("line", _ENVELOPE)).filter("r is not null")
    framed = outer.filter("r.retained_frame is not null").select("file", F.explode("r.children").alias("c")).select("file", F.from_json("c.record_json", _ENVELOPE).alias("r"))
    records = outer.filter("r.retained_frame is null and r.retained_marker is null and r.schema_version is not null").select("file", "r").unionByName(framed)
    good = records.groupBy("file").agg(F.max((F.coalesce("r.schema_version", F.lit(-1)) != 1).cast("int")).alias("bad")).filter("bad = 0").select("file")
    rows = records.join(good, "file", "left_semi").select(F.col("file").alias("session"), F.col("r.sequence").alias("line_no"), "r")
    kept = sessions.sealed(rows, (F.col("r.payload_type") == "session.end") & (F.col("r.durability") == "durable"))
    return kept.select("session", F.col("line_no").alias("sequence"), F.col("r.payload.kind").alias("kind"), F.col("r.payload.run_id").alias("run_id"), F.col("r.payload.event").alias("event"))


def indexed_logs(index: str, root: str) -> list[str]:
    """Paths of the valid logs of a workspace from the session index; no index is an empty success."""
    if not Path(index).exists():
        return []
    with sqlite3.connect(f"file:{index}?mode=ro", uri=True) as db:
        rows = db.execute("select session_log_path, workspace_root from sessions where layout = 'session_jsonl' and status = 'valid' order by session_id").fetchall()
    base = Path(index).resolve().parent
    found = [(base / p).resolve() for p, w in rows if w and Path(w).resolve() == Path(root).resolve()]
    return [str(p) for p in found if p.is_relative_to(base) and p.exists()]


def discover(home: str, root: str) -> list[str]:
    """Paths of the session logs of a repository: the folder is named by its path, but the header's cwd decides.

    Different paths can share a folder's name, so a log whose cwd is not this root is foreign; ``read_messages`` drops it.
    """
    folder = Path(home) / ("--" + root.strip("/").replace("/", "-").replace(":", "-") + "--")
    return sorted(f"file://{p}" for p in folder.glob("*.jsonl") if p.is_file() and p.stat().st_size <= MAX_BYTES) if folder.is_dir() else []


def run_units(events: DataFrame) -> DataFrame:
    """Units of finished runs of read_events: prompt, answers, and tool calls with their outcomes, the newest 200 of a session."""
    json = lambda path: F.get_json_object("event", path)
    rows = events.filter("run_id is not null").select(
        "session", "run_id", "sequence", "kind", json("$.prompt").alias("prompt"), json("$.text").alias("text"), json("$.model").alias("model"), json("$.call_id").alias("call_id"), json("$.name").alias("name"), json("$.arguments").alias("arguments"), json("$.result").alias("result"),
        F.from_json(json("$.usage"), "map<string,bigint>").alias("usage"),
    )
    whole = sessions.runs(rows.select("session", "run_id", "sequence", "kind", "model", "usage")).select("session", "run_id", "start", "model")
    calls = rows.filter("kind = 'tool_call'")
    outcome = sessions.outcomes(calls.select("session", "call_id", "name"), rows.filter("kind = 'tool_result'").select("session", "call_id", F.col("sequence").alias("line_no"), F.col("result").alias("text")))
    told = calls.join(outcome.select("session", "call_id", "outcome"), ["session", "call_id"], "left")
    lines = rows.filter("kind = 'started'").select("session", "run_id", "sequence", F.concat(F.lit("User: "), "prompt").alias("line"))
    lines = lines.unionByName(rows.filter("kind = 'model_completed' and text is not null").select("session", "run_id", "sequence", F.concat(F.lit("Assistant: "), "text").alias("line")))
    lines = lines.unionByName(told.select("session", "run_id", "sequence", F.concat(F.lit("Tool: "), tool_reference(F.col("name"), F.col("arguments")), F.lit(" -> "), F.coalesce("outcome", F.lit("unknown"))).alias("line")))
    # A run without a prompt is none.
    prompted = rows.filter("kind = 'started' and trim(coalesce(prompt, '')) <> ''").select("session", "run_id").distinct()
    bodies = lines.filter("line is not null").groupBy("session", "run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "line"))), lambda x: x["line"]), "\n").alias("body"))
    newest = Window.partitionBy("session").orderBy(F.col("start").desc(), "run_id")
    rows = whole.join(prompted, ["session", "run_id"], "left_semi").join(bodies, ["session", "run_id"]).withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= sessions.NEWEST)
    name = F.regexp_extract("session", "([^/]+?)([.]jsonl)?$", 1)
    rows = rows.withColumn("locator", F.concat(F.lit("events:"), name)).withColumn("session", name)
    crumb = F.concat("locator", F.lit(" > run "), "run_id")
    routing = F.concat_ws("\n", F.lit("source: agent_run"), F.concat(F.lit("session: "), "session"), F.concat(F.lit("model: "), "model"))
    return _split(rows.select("locator", "session", "start", crumb.alias("crumb"), "body", routing.alias("routing_text")), "start")


def _split(rows: DataFrame, order: str) -> DataFrame:
    """Units of (locator, session, crumb, body, routing_text): a body that is too long with its crumb in pieces, numbered over the source."""

    @F.pandas_udf("array<string>")
    def pieces(crumb, body):
        import pandas as pd

        whole = lambda c, b: chunking.MAX_TOKENS >= max(1, -(-(len(c) + 2 + len(b)) // 4))
        room = lambda c: max(1, chunking.MAX_TOKENS * 4 - len(c) - 18)
        return pd.Series([[b] if whole(c, b) else [p for p, _, _ in chunking.split_oversized(b, room(c))] for c, b in zip(crumb, body, strict=True)])

    cut = rows.withColumn("pieces", pieces("crumb", "body")).select("*", F.posexplode("pieces").alias("part", "piece"))
    many = F.when(F.size("pieces") > 1, F.concat(F.lit(" (part "), (F.col("part") + 1).cast("string"), F.lit(")"))).otherwise("")
    evidence = F.concat("crumb", many, F.lit("\n\n"), "piece")
    ordinal = F.row_number().over(Window.partitionBy("locator").orderBy(order, "part")).cast("long")
    out = cut.select("locator", "session", ordinal.alias("ordinal"), F.lit("episode").alias("kind"), evidence.alias("evidence_text"), "routing_text")
    return out.withColumns({"token_count": T.estimate_tokens(F.col("evidence_text")), "content_hash": T.content_hash(F.col("locator"), F.col("evidence_text"), F.col("routing_text"))})


def tool_reference(name, arguments):
    """What a tool call is about: a path for file tools, the first line of a command, else the tool's name."""
    get = lambda *keys: F.coalesce(*(F.get_json_object(arguments, f"$.{k}") for k in keys))
    return F.when(name.isin("read", "edit", "write"), F.coalesce(get("path", "file_path"), name)).when(name == "bash", F.substring_index(F.coalesce(get("command"), name), "\n", 1)).otherwise(name)


_RECORD = (
    "struct<id:string,kind:string,status:string,confidence:string,basis:string,domains:array<string>,statement:string,scope:struct<global:boolean,paths:array<string>,symbols:array<string>,concepts:array<string>>,"
    "supersedes:array<string>,contradicts:array<string>,createdAt:string,lastValidatedAt:string,provenance:array<struct<type:string,ref:string>>,constraint:string,removalCondition:string,scarState:string,conflict:struct<targets:array<string>,reason:string>>"
)


def memory_units(ledgers: DataFrame) -> DataFrame:
    """Units of curated memories from ledgers (locator, text): one row a record, with its anchors.

    A ledger of another version than 1 gives nothing; a record without id or statement is skipped.
    """
    parsed = ledgers.select("locator", F.from_json("text", f"version int, records array<{_RECORD}>").alias("l")).filter("l.version = 1")
    r = parsed.select("locator", F.explode("l.records").alias("r")).filter("r.id is not null and r.statement is not null")
    banner = (
        F.when((F.col("r.kind") == "conflict") & (F.col("r.status") == "active"), "ACTIVE CONFLICT").when(F.col("r.status") == "conflicted", "CONFLICTED")
        .when(F.col("r.status") == "unverified", "UNVERIFIED").when(F.col("r.status").isin("superseded", "obsolete", "resolved"), F.upper("r.status")).when(F.col("r.kind") == "scar", "SCAR").otherwise(F.upper("r.kind"))
    )
    none = F.array().cast("array<string>")
    selectors = F.concat(*(F.coalesce(F.col(f"r.scope.{k}"), none) for k in ("paths", "symbols", "concepts")))
    scope = F.when(F.coalesce("r.scope.global", F.lit(False)) | (F.size(selectors) == 0), "Repository-wide").otherwise(F.array_join(selectors, ", "))
    optional = lambda lead, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(lead), F.col(c)))
    evidence = F.concat_ws("\n", banner, "r.statement", optional("Constraint: ", "r.constraint"), optional("Remove when: ", "r.removalCondition"), optional("Conflict: ", "r.conflict.reason"), F.concat(F.lit("Scope: "), scope), optional("Last validated: ", "r.lastValidatedAt"))
    routing = F.concat_ws("\n", F.lit("source: hindsight_memory"), *(optional(f"{k}: ", f"r.{c}") for k, c in (("memory_id", "id"), ("kind", "kind"), ("status", "status"), ("confidence", "confidence"), ("basis", "basis"))), F.concat(F.lit("scope: "), scope))
    anchors = lambda values, kind, rel: F.transform(F.coalesce(values, none), lambda v: F.struct((kind if not isinstance(kind, str) else F.lit(kind)).alias("kind"), v.alias("value"), F.lit(rel).alias("relationship")))
    source = F.transform(
        F.filter(F.coalesce("r.provenance", F.array().cast("array<struct<type:string,ref:string>>")), lambda p: p["type"].isin("source", "decision", "doc", "session", "history")),
        lambda p: F.struct(F.when(p["type"] == "session", "session").when(p["type"] == "history", "commit").otherwise("file").alias("kind"), F.regexp_replace(p["ref"], "^(commit|session|file):", "").alias("value"), F.lit("supported_by").alias("relationship")),
    )
    every = F.concat(
        anchors(F.array("r.id"), "memory", "self"), anchors(F.col("r.supersedes"), "memory", "supersedes"), anchors(F.col("r.contradicts"), "memory", "contradicts"), anchors(F.col("r.conflict.targets"), "memory", "conflict_target"),
        anchors(F.filter(F.coalesce("r.scope.paths", none), T.is_exact_path), "file", "applies_to"), anchors(F.col("r.scope.symbols"), "symbol", "applies_to"), source,
    )
    return r.select(
        "locator", F.lit("memory").alias("kind"), evidence.alias("evidence_text"), routing.alias("routing_text"), T.estimate_tokens(evidence).alias("token_count"), T.content_hash(F.col("r.id"), evidence, routing).alias("content_hash"),
        T.parse_time(F.coalesce("r.lastValidatedAt", "r.createdAt")).alias("timestamp"), F.col("r.status").alias("status"), F.col("r.confidence").alias("confidence"), F.col("r.scarState").alias("scar_state"), F.col("r.scope.paths").alias("scope_paths"), every.alias("anchors"),
    )


def episode_units(messages: DataFrame) -> DataFrame:
    """Units of finished episodes of read_messages: results of tools stay out, their calls and outcomes stay in."""
    calls = messages.filter("role = 'toolCall'")
    results = messages.filter("role = 'toolResult'")
    outcome = sessions.outcomes(calls.select("session", "call_id", "name"), results.select("session", "call_id", "line_no", "text"))
    told = calls.join(outcome.select("session", "call_id", "outcome"), ["session", "call_id"], "left").select("session", "line_no", F.lit("tool").alias("role"), F.concat(tool_reference(F.col("name"), F.col("arguments")), F.lit(" -> "), F.coalesce("outcome", F.lit("unknown"))).alias("text"))
    spoken = messages.filter("role in ('user', 'assistant')").select("session", "line_no", "role", "text")
    # A message's calls stand on its line; number all rows anew so that each has its own place.
    order = Window.partitionBy("session").orderBy("line_no", F.col("role") == "tool", "text")
    turns = spoken.unionByName(told).withColumn("line_no", F.row_number().over(order))
    units = sessions.episode_units(turns)
    locator = F.concat(F.lit("session:"), F.col("session"))
    crumb = F.concat(locator, F.lit(" > episode "), F.col("episode").cast("string"))
    routing = F.concat(F.lit("source: agent_episode\nsession: "), F.col("session"), F.lit("\nepisode: "), F.col("episode").cast("string"), F.lit("\n"))
    return _split(units.select(locator.alias("locator"), "session", "episode", crumb.alias("crumb"), "body", routing.alias("routing_text")), "episode")


def dumps(rows: list[dict]) -> str:
    """JSON Lines, as the logs are written."""
    return "".join(json.dumps(r) + "\n" for r in rows)
