"""Scanning a repository's files into sources."""

from __future__ import annotations

import os
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources.parsers import EXTENSIONS

SKIPPED_DIRS = ["target", "node_modules", ".venv", "venv", "dist", "build", ".git"]
MAX_BYTES = 10 << 20
LEDGER = ".agents/curation/memory.json"


def repository_root(start: str) -> Path:
    """The nearest folder upwards that holds a ``.git``, else the folder itself."""
    here = Path(start).resolve()
    here = here if here.is_dir() else here.parent
    return next((p for p in (here, *here.parents) if (p / ".git").exists()), here)


def _visible(root: Path) -> list[str] | None:
    """What version control does not ignore, or None outside of it."""
    if not (root / ".git").exists():
        return None
    done = subprocess.run(["git", "-C", str(root), "ls-files", "-co", "--exclude-standard", "-z"], capture_output=True, check=False)
    return [os.fsdecode(x) for x in done.stdout.split(b"\0") if x] if done.returncode == 0 else None


def _unlisted(top: Path) -> list[str]:
    """Sources that Spark's file listing leaves out: it skips names that start with a dot or an underscore."""
    out = []
    for folder, folders, names in os.walk(top):
        folders[:] = [f for f in folders if f not in SKIPPED_DIRS]
        inside = Path(folder).relative_to(top).parts
        for name in names:
            ending = name.rpartition(".")[2].lower()
            wanted = ending in EXTENSIONS or ending in ("md", "markdown", "mdown", "txt") or "/".join((*inside, name)) == LEDGER
            if wanted and any(p.startswith((".", "_")) for p in (*inside, name)):
                out.append(f"file://{Path(folder, name)}")
    return out


def skipped(spark: SparkSession, root: str) -> DataFrame:
    """(locator, reason) of the sources that ``scan`` had to leave out: too large, or no UTF-8."""
    return _judged(spark, root).filter("reason is not null").select("locator", "reason")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(locator, source_kind, text, content_hash, modified_at) of every source below ``root``.

    Ignored, hidden and oversized files are left out, but Markdown counts even if it is ignored or hidden, and
    the ledger of curated memories always counts. What is no valid UTF-8 is skipped, and so are views that
    were generated from a ledger that is itself present. Files that vanish while they are read are left out.
    """
    rows = _judged(spark, root).filter("reason is null")
    return rows.select("locator", "source_kind", F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("content_hash"), "modified_at")


def _judged(spark: SparkSession, root: str) -> DataFrame:
    """Every source with its content and why it is skipped, if it is."""
    top = repository_root(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(f"file://{top}")
    locator = F.expr(f"substr(regexp_replace(path, '^file:/+', '/'), {len(str(top)) + 2})")
    if hidden := _unlisted(top):
        files = files.unionByName(spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(hidden))
    rows = files.select(locator.alias("locator"), "content", "length", F.unix_timestamp("modificationTime").alias("modified_at"))
    parts = F.split("locator", "/", -1)
    rows = rows.filter(~F.exists(parts, lambda p: p.isin(SKIPPED_DIRS)))
    rows = rows.withColumn("source_kind", F.when(F.col("locator") == LEDGER, "hindsight_memory").otherwise(T.source_kind(F.col("locator")))).filter("source_kind is not null")
    always = F.col("source_kind").isin("markdown", "hindsight_memory")
    visible = _visible(top)
    if visible is not None:
        # One name a file: joined, and never held in an expression.
        known = spark.createDataFrame([(v,) for v in visible], "locator string")
        rows = rows.filter(always).unionByName(rows.filter(~always).join(known, "locator", "left_semi"))
    rows = rows.filter(always | ~F.exists(parts, lambda p: p.startswith(".")))
    rows = rows.withColumn("reason", F.when(F.col("length") > MAX_BYTES, "size").when(~F.expr("is_valid_utf8(content)"), "encoding"))
    if (top / LEDGER).exists():
        rows = rows.filter((F.col("locator") == LEDGER) | ~F.col("locator").startswith(".agents/curation/"))
    return rows.select("locator", "source_kind", "content", "modified_at", "reason")
