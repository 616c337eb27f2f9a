"""The engine: an incremental index of a repository in snapshots, and batches of questions against it.

A store is a folder of snapshots ``v<N>`` (sources, units, unit_anchors) and the log ``runs``, whose rows are
written last: a run that dies leaves the snapshot before it in force.
"""

from __future__ import annotations

import subprocess
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.functions.scratch import written
from lodestone.operators import graph, incremental, ranking, units
from lodestone.operators.admission import Limits
from lodestone.plans import packets
from lodestone.sources import embedding, files, git, locks, session_logs

#: Another format makes the next run build everything anew.
FORMAT = "2"
#: Parts in which changed sources are built when there is a deadline; it is looked at between them.
SLICES = 8
#: Seconds that ``ensure`` takes if it is not told otherwise.
ENSURE_S = 120.0
_SOURCES = "locator string, source_kind string, content_hash string, modified_at bigint"
_UNITS = "unit_id bigint, locator string, source_kind string, ordinal bigint, kind string, evidence_text string, routing_text string, token_count bigint, content_hash string, timestamp bigint, status string, confidence string, scar_state string, scope_paths array<string>"
_ANCHORS = "unit_id bigint, kind string, value string, relationship string"
_COUNTS = ["changed", "unchanged", "deleted", "added", "reused", "removed", "embedded", "skipped"]
_RUNS = "version bigint, format string, root string, tip string, status string, finished bigint, duration_ms bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS)
_MEMORY = ["timestamp bigint", "status string", "confidence string", "scar_state string", "scope_paths array<string>"]


class Engine:
    """An index in a folder that Spark can reach."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store.rstrip("/")
        #: Sources that were parsed, counted by the tasks.
        self.parsed = spark.sparkContext.accumulator(0)
        self.breaker = embedding.Breaker()

    def runs(self) -> DataFrame:
        """The log of finished runs."""
        from pyspark.errors import AnalysisException

        try:
            found = self.spark.read.schema(_RUNS).parquet(f"{self.store}/runs")
            found.schema  # noqa: B018
            return found
        except AnalysisException:
            return self.spark.createDataFrame([], _RUNS)

    def _last(self):
        """The run whose snapshot is in force."""
        return self.runs().filter("status <> 'error'").orderBy(F.col("version").desc()).first()

    def table(self, name: str) -> DataFrame:
        """A table of the snapshot in force; empty before the first run."""
        kind = {"sources": _SOURCES, "units": _UNITS, "unit_anchors": _ANCHORS, "vectors": embedding.VECTORS}[name]
        last = self._last()
        return self.spark.read.schema(kind).parquet(f"{self.store}/v{last.version}/{name}") if last else self.spark.createDataFrame([], kind)

    def _found(self, at: str, top: str, history: bool, logs: list[str] | None, session_index: str | None, tip: str | None, force: bool, warn: Callable[[str], None]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], str | None]:
        """All present sources, written; what builds the units of some of them; and the newest commit.

        What cannot be discovered now keeps the sources it had: a failed reader never deletes.
        """
        spark, stored = self.spark, self.table("sources")
        found = files.scan(spark, top)
        parts = [found.select("locator", "source_kind", "content_hash", "modified_at")]
        builders: list[Callable[[DataFrame], DataFrame]] = []
        blank = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in _MEMORY}
        names = [c.split()[0] for c in units.UNIT.split(", ")] + list(blank)

        def from_files(changed: DataFrame) -> DataFrame:
            some = found.join(changed, "locator", "left_semi")
            memories = session_logs.memory_units(some.filter("source_kind = 'hindsight_memory'")).withColumn("source_kind", F.lit("hindsight_memory"))
            memories = memories.withColumn("ordinal", F.row_number().over(Window.partitionBy("locator").orderBy("content_hash")).cast("long"))
            return units.build_units(some, self.parsed).withColumns(blank).select(*names).unionByName(memories.select(*names))

        builders.append(from_files)
        newest = tip
        kept = lambda lead: stored.filter(F.col("locator").startswith(lead))
        if history and files.Path(top, ".git").exists():
            try:
                delta = tip if tip and not force and git.is_ancestor(top, tip) else None
                commits = git.commits_since(top, git.MAX_COMMITS, delta)
                newest = commits[0][0] if commits else tip
                log = spark.createDataFrame([(oid, seconds, message) for oid, seconds, message in commits], "oid string, seconds bigint, message string")
                past = kept("git:")
                if not delta and tip:
                    # Abandoned history goes: what the head does not reach any more.
                    past = past.join(git.reachable(spark, top).select(F.concat(F.lit("git:"), F.col("oid")).alias("locator")), "locator", "left_semi")
                here = log.select(F.concat(F.lit("git:"), F.col("oid")).alias("locator"), F.lit("git_commit").alias("source_kind"), F.sha2("oid", 256).alias("content_hash"), F.col("seconds").alias("modified_at"))
                parts += [here, past.join(here, "locator", "left_anti").select(*here.columns)]

                def from_history(changed: DataFrame) -> DataFrame:
                    # At most MAX_COMMITS names; only files of changed commits are read.
                    oids = [r.locator[4:] for r in changed.filter(F.col("locator").startswith("git:")).collect()]
                    spark.dataSource.register(git.GitSource)
                    read = spark.read.format("git_history").option("repo", top).option("what", "files").option("oids", ",".join(oids)).load()
                    return units.git_units(read, log).withColumns(blank).select(*names)

                builders.append(from_history)
            except (OSError, subprocess.CalledProcessError) as error:
                warn(f"history: {error}")
                parts.append(kept("git:").select(*parts[0].columns))
        part_of = F.array(F.struct(F.lit("session").alias("kind"), F.col("session").alias("value"), F.lit("part_of").alias("relationship")))
        for lead, paths, read in (("session:", lambda: logs, lambda p: session_logs.episode_units(session_logs.read_messages(spark, p, top))), ("events:", lambda: session_logs.indexed_logs(session_index, top) if session_index else None, lambda p: session_logs.run_units(session_logs.read_events(spark, p)))):
            try:
                if not (have := paths()):
                    if have is None:
                        parts.append(kept(lead).select(*parts[0].columns))
                    continue
                rows = written(read(have).withColumns({"source_kind": F.lit("agent_session"), "anchors": part_of, **blank}).select(*names))
            except Exception as error:  # any reader's failure
                warn(f"{lead} {error}")
                parts.append(kept(lead).select(*parts[0].columns))
                continue
            sealed_hash = F.sha2(F.array_join(F.array_sort(F.collect_list("content_hash")), ","), 256)
            parts.append(rows.groupBy("locator", "source_kind").agg(sealed_hash.alias("content_hash"), F.lit(None).cast("long").alias("modified_at")))
            builders.append(lambda changed, rows=rows: rows.join(changed, "locator", "left_semi"))
        every = parts[0]
        for x in parts[1:]:
            every = every.unionByName(x)
        every.write.mode("overwrite").parquet(f"{at}/found")

        def build(changed: DataFrame) -> DataFrame:
            out = None
            for b in builders:
                rows = b(changed)
                out = rows if out is None else out.unionByName(rows)
            return out

        return spark.read.schema(_SOURCES).parquet(f"{at}/found"), build, newest

    def index(self, root: str, history: bool = True, logs: list[str] | None = None, force: bool = False, session_index: str | None = None, embed: embedding.Embed | None = None, model: str = "embed", deadline: float | None = None) -> dict:
        """Brings the store up to date: unchanged sources are not parsed and keep their units, equal units keep their ids.

        ``deadline`` (epoch seconds): what is not built by then keeps its old version, nothing is deleted, and the next run goes on.
        """
        lease = locks.Lease(self.spark, self.store, f"index-{uuid.uuid4().hex}")
        if not lease.acquire():
            raise locks.LockedError(self.store)
        began = time.time()
        top = str(files.repository_root(root))
        last = self._last()
        version = max([r.version for r in self.runs().agg(F.max("version").alias("version")).collect() if r.version] or [0]) + 1
        try:
            if last and last.root != top:
                raise ValueError(f"the store belongs to {last.root}")
            out, tip, format_ = self._indexed(top, last, version, history, logs, force, session_index, embed, model, deadline, lease)
        except Exception:
            self._log(version, last.format if last else FORMAT, top, last.tip if last else None, "error", began, {})
            raise
        finally:
            lease.release()
        self._log(version, format_, top, tip, "timeout" if out["timed_out"] else "ok", began, out)
        return out

    def _log(self, version: int, format_: str, top: str, tip: str | None, status: str, began: float, out: dict) -> None:
        now = time.time()
        row = (version, format_, top, tip, status, int(now), int((now - began) * 1000), *(out.get(c, 0) for c in _COUNTS))
        self.spark.createDataFrame([row], _RUNS).write.mode("append").parquet(f"{self.store}/runs")

    def _indexed(self, top: str, last, version: int, history: bool, logs: list[str] | None, force: bool, session_index: str | None, embed: embedding.Embed | None, model: str, deadline: float | None, lease: locks.Lease) -> tuple[dict, str | None, str]:
        spark, at = self.spark, f"{self.store}/v{version}"
        force = force or bool(last and last.format != FORMAT)
        warnings: list[str] = []
        found, build, tip = self._found(at, top, history, logs, session_index, last.tip if last else None, force, warnings.append)
        old_sources, old_units, old_anchors, old_vectors = (self.table(t) for t in ("sources", "units", "unit_anchors", "vectors"))
        changed = incremental.changed_sources(found, old_sources, force).select("locator")
        due = changed.withColumn("slice", F.pmod(F.xxhash64("locator"), F.lit(SLICES)))
        done = 0
        if deadline is None:
            build(changed).write.mode("overwrite").parquet(f"{at}/new_units")
        else:
            build(changed.limit(0)).write.mode("overwrite").parquet(f"{at}/new_units")
            while done < SLICES and time.time() < deadline and lease.renew():
                build(due.filter(F.col("slice") == done).select("locator")).write.mode("append").parquet(f"{at}/new_units")
                done += 1
        timed_out = deadline is not None and done < SLICES
        if timed_out:
            # Sources that were not built keep their old row, or none; sources that are gone stay until a run ends in time.
            changed = due.filter(F.col("slice") < done).select("locator")
            waiting = due.filter(F.col("slice") >= done).select("locator")
            stale = old_sources.join(found.select("locator"), "locator", "left_anti").unionByName(old_sources.join(waiting, "locator", "left_semi"))
            found.join(waiting, "locator", "left_anti").unionByName(stale).write.mode("overwrite").parquet(f"{at}/sources")
        else:
            found.write.mode("overwrite").parquet(f"{at}/sources")
        sources = spark.read.schema(_SOURCES).parquet(f"{at}/sources")
        new = spark.read.parquet(f"{at}/new_units")
        stays = old_units.join(sources.select("locator"), "locator", "left_semi").join(changed, "locator", "left_anti")
        before = old_units.join(changed, "locator", "left_semi").withColumnRenamed("locator", "source")
        matched = incremental.match_units(before, new.withColumnRenamed("locator", "source"))
        ids = matched.filter("outcome <> 'removed'").withColumnRenamed("source", "locator")
        # Kept ids first; new ones follow the largest in the order of sources and places.
        most = old_units.agg(F.coalesce(F.max("unit_id"), F.lit(0))).first()[0]
        fresh = self._numbered(ids.filter("unit_id is null").select("locator", "ordinal", "outcome"), most, f"{at}/new_ids")
        ids = ids.filter("unit_id is not null").select("locator", "ordinal", "unit_id", "outcome").unionByName(fresh)
        placed = new.join(ids, ["locator", "ordinal"])
        rows = placed.join(sources.select("locator", "modified_at"), "locator").withColumn("timestamp", F.coalesce("timestamp", "modified_at"))
        columns = [c.split()[0] for c in _UNITS.split(", ")]
        stays.select(*columns).unionByName(rows.select(*columns)).write.mode("overwrite").parquet(f"{at}/units")
        kept_anchors = old_anchors.join(stays.select("unit_id"), "unit_id", "left_semi")
        own = placed.select("unit_id", F.inline("anchors")).distinct()
        kept_anchors.unionByName(own).write.mode("overwrite").parquet(f"{at}/unit_anchors")
        units_ = spark.read.schema(_UNITS).parquet(f"{at}/units")
        incremental.valid_vectors(old_vectors, old_units, units_).write.mode("overwrite").parquet(f"{at}/vectors")
        embedded = 0
        if embed is not None and not timed_out:
            have = spark.read.schema(embedding.VECTORS).parquet(f"{at}/vectors")
            embedding.backfill(units_, have, embed, model, deadline).write.mode("overwrite").parquet(f"{at}/new_vectors")
            more = spark.read.schema(embedding.VECTORS).parquet(f"{at}/new_vectors")
            embedded = more.count()
            more.write.mode("append").parquet(f"{at}/vectors")
            timed_out = deadline is not None and time.time() >= deadline and bool(have.count() < 2 * units_.count())
        n = {r.outcome: r.n for r in matched.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
        n_changed, n_all = changed.count(), sources.count()
        gone = old_sources.join(sources.select("locator"), "locator", "left_anti")
        removed = n.get("removed", 0) + old_units.join(gone.select("locator"), "locator", "left_semi").count()
        out = {"changed": n_changed, "unchanged": n_all - n_changed, "deleted": gone.count(), "added": n.get("added", 0), "reused": n.get("reused", 0), "removed": removed, "embedded": embedded, "skipped": files.skipped(spark, top).count(), "timed_out": timed_out, "warnings": warnings}
        built_all = deadline is None or done == SLICES
        # The tip and the format move on only when all sources are built.
        return out, tip if built_all else (last.tip if last else None), FORMAT if built_all or not last else last.format

    def ensure(self, root: str, seconds: float = ENSURE_S, **more) -> dict:
        """As ``index`` within so many seconds, with a status: up-to-date, refreshed, timeout, locked or error."""
        try:
            out = self.index(root, deadline=time.time() + seconds, **more)
        except locks.LockedError:
            return {"status": "locked"}
        except Exception as error:  # told, not raised
            return {"status": "error", "error": str(error)}
        if out["timed_out"]:
            return {"status": "timeout", **out}
        return {"status": "refreshed" if out["changed"] or out["deleted"] or out["embedded"] else "up-to-date", **out}

    def query(self, questions: DataFrame, embed: embedding.Embed | None = None, model: str = "embed", excluded_sessions: list[str] | None = None, limits: Limits = Limits(), top_n: int = packets.TOP, evidence_only: bool = False, now: int | None = None, embed_seconds: float | None = None) -> DataFrame:
        """Packets for questions (query_id, text).

        With ``embed`` the store's vectors of ``model`` make two more channels.  If questions cannot be embedded within
        ``embed_seconds``, or could not be three times in a row just before, the lexical channels answer alone and
        ``degraded`` is true.
        """
        table, anchors = self.table("units"), self.table("unit_anchors")
        excluded = None
        if excluded_sessions:
            names = self.spark.createDataFrame([(s,) for s in excluded_sessions], "value string")
            excluded = anchors.filter("kind = 'session'").join(names, "value", "left_semi").select("unit_id")
        lists = packets.channels(table, questions, packets.TEXTS[: 1 if evidence_only else 2], excluded, top_n).select("query_id", "unit_id", "rank", "channel")
        asked = self._asked_vectors(questions, embed, model, embed_seconds) if embed is not None else None
        degraded = embed is not None and asked is None
        vectors = None
        if asked is not None:
            vectors = self.table("vectors").filter(F.col("model_version") == model)
            for kind in ("evidence", "routing")[: 1 if evidence_only else 2]:
                some = vectors.filter(F.col("kind") == kind)
                some = some if excluded is None else some.join(excluded, "unit_id", "left_anti")
                lists = lists.unionByName(self._similar(some, asked, table, questions, top_n).select("query_id", "unit_id", "rank", F.lit(f"{kind}_vector").alias("channel")))
            vectors = vectors.filter("kind = 'evidence'")
        ranked = ranking.apply_priors(ranking.fuse(lists).join(questions, "query_id"), table)
        part = F.regexp_extract("routing_text", "(?m)^part: (\\d+)$", 1).try_cast("int")
        path = F.nullif(F.regexp_extract("routing_text", "(?m)^(?:changed file|path): (.*)$", 1), F.lit(""))
        units_ = table.withColumns({"commit": F.when(F.col("source_kind") == "git_commit", F.col("locator")), "path": path, "symbol": F.regexp_extract("routing_text", "(?m)^(?:changed )?symbol: (.*)$", 1), "part": F.coalesce(part, F.lit(0))})
        # Expansion never leads to a memory that the question's tiers hide, nor to an excluded unit.
        hidden = table.filter("source_kind = 'hindsight_memory'").select("unit_id")
        rows = packets.pool(ranked, units_, anchors, vectors, questions, hidden_but=packets.eligible(table, questions), memories=hidden, excluded=excluded)
        return packets.packets(rows, questions, now or int(time.time()), limits).withColumn("degraded", F.lit(degraded))

    def _asked_vectors(self, questions: DataFrame, embed: embedding.Embed, model: str, seconds: float | None) -> DataFrame | None:
        """(query_id, embedding), or None if the service is too slow; other failures are raised."""
        if not self.breaker.allows():
            return None
        texts = questions.select(F.col("query_id").cast("long").alias("unit_id"), F.lit("question").alias("kind"), "text")
        deadline = None if seconds is None else time.time() + seconds
        found = written(embedding.embedded(texts, embed, model, deadline).select(F.col("unit_id").alias("query_id"), "embedding"))
        if deadline is not None and found.count() < questions.count():
            self.breaker.missed_deadline()
            return None
        self.breaker.succeeded()
        return found

    def _similar(self, vectors: DataFrame, asked: DataFrame, table: DataFrame, questions: DataFrame, top_n: int) -> DataFrame:
        """The most similar units of each question; memories that a question's tiers hide are gone before the limit."""
        memories = table.filter("source_kind = 'hindsight_memory'").select("unit_id", T.tier_of_status(F.coalesce("status", F.lit("unknown"))).alias("tier"))
        best = ranking.cosine_top(vectors.join(memories, "unit_id", "left_anti"), asked, top_n)
        seen = packets.eligible(table, questions).groupBy("unit_id").agg(F.collect_set("query_id").alias("for"))
        mine = ranking.cosine_top(vectors.join(seen, "unit_id", "left_semi"), asked, None).join(packets.eligible(table, questions), ["query_id", "unit_id"], "left_semi")
        return ranking.top(best.drop("rank").unionByName(mine.drop("rank")), top_n)

    def _numbered(self, rows: DataFrame, after: int, path: str) -> DataFrame:
        """``rows`` with unit_id after ``after`` in order of locator and ordinal, numbered range by range and not in one task."""
        rows.repartitionByRange("locator", "ordinal").withColumn("range", F.spark_partition_id()).write.mode("overwrite").parquet(path)
        rows = self.spark.read.parquet(path)
        sizes = rows.groupBy("range").agg(F.count("*").alias("n"))
        # One row a range: their running total is the only sum that needs all of them.
        start = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
        starts = sizes.withColumn("start", F.coalesce(start, F.lit(0)) + after).select("range", "start")
        place = F.row_number().over(Window.partitionBy("range").orderBy("locator", "ordinal"))
        return rows.withColumn("place", place).join(starts, "range").withColumn("unit_id", F.col("place") + F.col("start")).drop("place", "start", "range")

    def status(self) -> dict:
        """Row counts of the snapshot in force and the last run."""
        last = self._last()
        return {"version": last.version if last else 0, **{t: self.table(t).count() for t in ("sources", "units", "unit_anchors", "vectors")}}

    def inspect(self, symbol: str, limit: int = 64) -> DataFrame:
        """The first units that a symbol's anchor leads to, and with each how many more there are."""
        named = self.table("unit_anchors").filter((F.col("kind") == "symbol") & (F.col("value") == symbol))
        page = graph.units_of(named, limit).select("unit_id", "more")
        return self.table("units").join(page, "unit_id").orderBy("unit_id").select("unit_id", "source_kind", "locator", "routing_text", T.estimate_tokens(F.col("evidence_text")).alias("token_count"), "more")

    def sessions(self, symbol: str) -> DataFrame:
        """The session units that touched a file which defines the symbol."""
        found = graph.sessions_of_symbols(self.table("unit_anchors"), self.table("units")).filter(F.col("symbol") == symbol)
        return self.table("units").join(found.select("unit_id", "file"), "unit_id").orderBy("unit_id").select("unit_id", "file", "locator", "evidence_text")
