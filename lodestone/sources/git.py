"""Version history as a Python data source: commits, or the files that commits changed."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lodestone.sources.parsers import EXTENSIONS

MAX_COMMITS = 500
#: Larger files are not parsed to find the symbols of a change.
MAX_ALIGNED_BYTES = 1 << 20
_HEADER = re.compile(r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@.*$")


def git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")


def parse_log(text: str) -> list[tuple[str, int, str]]:
    """(oid, seconds, message) from records that end in \\x1e with fields split by \\x1f; a bad time is 0."""
    out = []
    for record in text.split("\x1e"):
        fields = record.strip("\n").split("\x1f")
        if len(fields) >= 3 and fields[0]:
            out.append((fields[0], int(fields[1]) if fields[1].strip().isdigit() else 0, fields[2].strip()))
    return out


def parse_hunks(patch: str) -> list[tuple[int, int, int, int, str]]:
    """(old_start, old_count, new_start, new_count, text) of each hunk of one file's patch."""
    found = list(_HEADER.finditer(patch))
    ends = [m.start() for m in found[1:]] + [len(patch)]
    return [(int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1), patch[m.start() : end]) for m, end in zip(found, ends, strict=True)]


def changed_lines(hunk: str, side: str = "new") -> list[int]:
    """Numbers of a hunk's lines that were added (new side) or removed (old side)."""
    m = _HEADER.match(hunk)
    old, new, out = int(m[1]), int(m[3]), []
    for line in hunk.split("\n")[1:]:
        mark = line[:1]
        if mark == "+":
            out += [new] if side == "new" else []
            new += 1
        elif mark == "-":
            out += [old] if side == "old" else []
            old += 1
        elif mark == " ":
            old, new = old + 1, new + 1
    return out


def is_ancestor(repo: str, oid: str, of: str = "HEAD") -> bool:
    return subprocess.run(["git", "-C", repo, "merge-base", "--is-ancestor", oid, of], capture_output=True, check=False).returncode == 0


def reachable(spark: SparkSession, repo: str) -> DataFrame:
    """(oid) of every commit that the head reaches."""
    return spark.createDataFrame([(oid,) for oid in git(repo, "rev-list", "HEAD").split()], "oid string")


def commits_since(repo: str, limit: int, tip: str | None) -> list[tuple[str, int, str]]:
    """The newest commits; only those after ``tip`` if it is an ancestor of the head, else all."""
    span = ["HEAD"]
    if tip and is_ancestor(repo, tip):
        span = [f"{tip}..HEAD"]
    return parse_log(git(repo, "log", f"--max-count={limit}", "--format=%H%x1f%ct%x1f%B%x1e", *span))


class BlobReader:
    """Texts of files at revisions from one child process; None for what is missing, binary, or too large to align."""

    def __init__(self, repo: str):
        self._child = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def read(self, revision: str, path: str) -> str | None:
        if "\n" in path:
            return None
        self._child.stdin.write(f"{revision}:{path}\n".encode())
        self._child.stdin.flush()
        head = self._child.stdout.readline().split()
        if len(head) != 3 or not head[2].isdigit():
            return None
        # The content is read whole whatever it is, or the next reply would not start where it is looked for.
        raw = self._child.stdout.read(int(head[2]) + 1)[:-1]
        if head[1] != b"blob" or len(raw) > MAX_ALIGNED_BYTES or b"\0" in raw:
            return None
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return None

    def close(self) -> None:
        self._child.stdin.close()
        self._child.stdout.close()
        self._child.wait()


def changed_files(repo: str, oid: str) -> list[tuple[str, str, str | None, str, str, str | None, str | None]]:
    """(oid, path, old_path, status, patch, before, after) of each file of a commit; texts of code only."""
    names = git(repo, "show", "--format=", "--name-status", "-M", "-z", oid).split("\0")
    files, k = [], 0
    while k < len(names) and names[k].strip():
        status = names[k].strip()[0]
        if status in "RC":
            files.append((status, names[k + 2], names[k + 1]))
            k += 3
        else:
            files.append((status, names[k + 1], None))
            k += 2
    patches = re.split(r"(?m)^(?=diff --git )", git(repo, "show", "--format=", "--patch", "-M", "--unified=3", oid))
    patches = [p for p in patches if p.startswith("diff --git ")]
    if len(patches) != len(files):
        raise ValueError(f"{oid}: {len(files)} files but {len(patches)} patches")
    parent = git(repo, "rev-list", "--parents", "-n", "1", oid).split()[1:2]
    blobs, out = BlobReader(repo), []
    try:
        for (status, path, old), patch in zip(files, patches, strict=True):
            before = after = None
            if any(p.rpartition(".")[2].lower() in EXTENSIONS for p in (path, old or path)):
                before = blobs.read(parent[0], old or path) if parent else None
                after = blobs.read(oid, path) if status != "D" else None
            out.append((oid, path, old, status, patch, before, after))
    finally:
        blobs.close()
    return out


class _Commit(InputPartition):
    def __init__(self, oid: str | None):
        self.oid = oid


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.what = options["repo"], options.get("what", "commits")
        self.limit, self.tip = int(options.get("max", MAX_COMMITS)), options.get("tip")
        self.oids = [x for x in options["oids"].split(",") if x] if "oids" in options else None

    def partitions(self) -> list[InputPartition]:
        if self.what == "commits":
            return [InputPartition(None)]
        oids = self.oids if self.oids is not None else [oid for oid, _, _ in commits_since(self.repo, self.limit, self.tip)]
        return [_Commit(oid) for oid in oids] or [_Commit(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.what == "commits":
            yield from commits_since(self.repo, self.limit, self.tip)
        elif partition.oid is not None:
            yield from changed_files(self.repo, partition.oid)


class GitSource(DataSource):
    """``spark.read.format("git_history").option("repo", ...)``; ``what`` is commits (default) or files; ``tip`` and ``max`` bound it."""

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        if self.options.get("what", "commits") == "commits":
            return "oid string, seconds bigint, message string"
        return "oid string, path string, old_path string, status string, patch string, before string, after string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))
