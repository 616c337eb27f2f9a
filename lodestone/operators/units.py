"""Unit builders: atoms of one source to bounded retrieval units with anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scratch import written
from lodestone.operators import history
from lodestone.operators.chunking import MAX_TOKENS, MERGE_BELOW, split_oversized
from lodestone.sources import parsers

UNIT = "locator string, source_kind string, ordinal bigint, kind string, evidence_text string, routing_text string, token_count bigint, content_hash string, anchors array<struct<kind:string,value:string,relationship:string>>"


#: Hunks of one file of a commit at most.
MAX_HUNKS = 64


def tokens(text: str) -> int:
    return max(1, -(-len(text) // 4))


def _hash(*parts: str) -> str:
    return hashlib.sha256("".join(f"{p}\0" for p in parts).encode()).hexdigest()


def _mentions(text: str) -> list[str]:
    import re

    found = re.findall(r"`([^`\s]+)`", text) + re.findall(r"\]\(([^)\s]+)\)", text)
    found += [t for t in text.split() if "/" in t or "::" in t or "_" in t or t.endswith((".rs", ".md"))]
    trimmed = {re.sub(r"^[`,.;:()\[\]{}\"'<>!?*]+|[`,.;:()\[\]{}\"'<>!?*]+$", "", t) for t in found}
    return sorted(t for t in trimmed if t and len(t.encode()) <= 256)[:32]


def prose_units(atoms: list[parsers.Atom], locator: str) -> list[dict]:
    """Content packed by section up to the token limit; small neighbours with equal routing are merged."""
    content = [a for a in atoms[1:] if a.kind in ("paragraph", "list", "block_quote", "code_block") and any(c.isalnum() for c in a.text)]
    drafts: list[dict] = []

    def routing(crumb: str, text: str) -> str:
        return f"source: document\npath: {locator}\nheading: {crumb}\nmentions: {' '.join(_mentions(text))}"

    def flush(group: list[parsers.Atom]) -> None:
        if group:
            body = "\n\n".join(a.text for a in group)
            drafts.append({"crumb": group[0].breadcrumb, "body": body, "routing": routing(group[0].breadcrumb, body)})

    current: list[parsers.Atom] = []
    section = None
    for a in content:
        if a.parent != section:
            flush(current)
            current, section = [], a.parent
        if tokens(f"{a.breadcrumb}\n\n{a.text}") > MAX_TOKENS:
            flush(current)
            current = []
            for piece, _, _ in split_oversized(a.text, max(1, MAX_TOKENS * 4 - len(a.breadcrumb) - 2)):
                drafts.append({"crumb": a.breadcrumb, "body": piece, "routing": routing(a.breadcrumb, a.text)})
        elif current and tokens(f"{a.breadcrumb}\n\n" + "\n\n".join(x.text for x in [*current, a])) > MAX_TOKENS:
            flush(current)
            current = [a]
        else:
            current.append(a)
    flush(current)
    merged: list[dict] = []
    for d in drafts:
        text = f"{d['crumb']}\n\n{d['body']}"
        if merged and tokens(text) < MERGE_BELOW and tokens(merged[-1]["text"]) + tokens(text) <= MAX_TOKENS and merged[-1]["routing"] == d["routing"]:
            merged[-1]["text"] += f"\n\n{d['body']}"
        else:
            merged.append(d | {"text": text})
    out = []
    for d in merged:
        said = [{"kind": "file" if "/" in m or "." in m else "symbol", "value": m, "relationship": "mentions"} for m in _mentions(d["text"])[:16]]
        out.append({"kind": "prose", "evidence_text": d["text"], "routing_text": d["routing"], "anchors": [{"kind": "file", "value": locator, "relationship": "documented_in"}, *said]})
    return out


def code_units(atoms: list[parsers.Atom], locator: str) -> list[dict]:
    """The imports as one unit, then a unit for each symbol; a symbol with symbols inside shows their signatures only."""
    out = []
    imports = [a for a in atoms if a.kind == "import"]
    if imports:
        text = f"{locator} > imports\n\n" + "\n".join(a.text.strip() for a in imports)
        out.append({"kind": "code", "evidence_text": text, "routing_text": f"source: code\npath: {locator}\nsymbol: {locator} > imports\nkind: imports", "anchors": [{"kind": "file", "value": locator, "relationship": "defined_in"}]})
    for i, a in enumerate(atoms[1:], 1):
        if a.kind == "import":
            continue
        inner = [x for x in atoms if x.parent == i and x.kind != "import"]
        if inner:
            head = a.text.encode()[: max(0, inner[0].start - a.start)].decode("utf-8", "ignore").rstrip()
            body = "\n".join([head, *(f"  {x.signature}" for x in inner)])
        else:
            body = a.text
        lead = f"{a.leading}\n\n" if a.leading else ""
        pieces = split_oversized(body, MAX_TOKENS * 4 - len(a.breadcrumb) - 2) if tokens(body) > MAX_TOKENS else [(body, 0, len(body))]
        for piece, _, _ in pieces:
            routing = f"source: code\npath: {locator}\nsymbol: {a.breadcrumb}\nkind: {a.kind}\nsignature: {a.signature}\nreferences: {' '.join(a.references)}"
            anchors = [{"kind": "file", "value": locator, "relationship": "defined_in"}, {"kind": "symbol", "value": a.name, "relationship": "defines"}]
            out.append({"kind": "code", "evidence_text": f"{lead}{a.breadcrumb}\n\n{piece}", "routing_text": routing, "anchors": anchors})
    return out


def build_units(sources: DataFrame, parsed=None) -> DataFrame:
    """Units of code, Markdown and text sources (locator, source_kind, text); ``parsed`` is an accumulator of sources."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        names = [c.split()[0] for c in UNIT.split(", ")]
        for f in frames:
            rows = []
            if parsed is not None:
                parsed.add(len(f))
            for locator, kind, text in zip(f["locator"], f["source_kind"], f["text"], strict=True):
                if kind == "code":
                    units = code_units(parsers.parse_code(text, locator), locator)
                else:
                    atoms = parsers.parse_markdown(text, locator) if kind == "markdown" else parsers.parse_text(text, locator)
                    units = prose_units(atoms, locator)
                for k, u in enumerate(units):
                    rows.append((locator, kind, k, u["kind"], u["evidence_text"], u["routing_text"], tokens(u["evidence_text"]), _hash(u["kind"], u["evidence_text"], u["routing_text"]), u["anchors"]))
            yield pd.DataFrame(rows, columns=names)

    wanted = sources.filter(F.col("source_kind").isin("code", "markdown", "text"))
    return wanted.select("locator", "source_kind", "text").mapInPandas(run, UNIT)


_SPANS = "oid string, path string, side string, name string, symbol string, start_line int, end_line int, body_key string"
_HUNKS = "oid string, path string, hunk int, text string, side string, lines array<int>, within array<int>, whole boolean"


def _spans(files: DataFrame) -> DataFrame:
    """The symbols of each changed file before and after, with a hash of their bodies that their own names do not change."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            rows = []
            for oid, path, old, before, after in zip(f["oid"], f["path"], f["old_path"], f["before"], f["after"], strict=True):
                for side, text, locator in (("old", before, old or path), ("new", after, path)):
                    if not text:
                        continue
                    lines = text.splitlines()
                    for a in parsers.parse_code(text, locator)[1:]:
                        if a.kind != "import" and a.name:
                            body = "\n".join(lines[a.start_line - 1 : a.end_line]).replace(a.name, "\0")
                            rows.append((oid, path, side, a.name, a.breadcrumb.removeprefix(f"{locator} > "), a.start_line, a.end_line, _hash(str(a.end_line - a.start_line), body)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SPANS.split(", ")])

    return files.select("oid", "path", "old_path", "before", "after").mapInPandas(run, _SPANS).dropDuplicates(["oid", "path", "side", "symbol"])


def _hunks(files: DataFrame) -> DataFrame:
    """Each hunk on both sides: its changed lines, all lines of its range, and whether it covers the file."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        from lodestone.sources.git import changed_lines, parse_hunks

        for f in frames:
            rows = []
            for oid, path, patch, after in zip(f["oid"], f["path"], f["patch"], f["after"], strict=True):
                found = parse_hunks(patch or "")[:MAX_HUNKS]
                total = len((after or "").splitlines())
                # A patch without hunks (a mere renaming, or a binary file) is one piece by itself.
                for k, (old_start, old_n, new_start, new_n, text) in enumerate(found or [(0, 0, 0, 0, patch or "")]):
                    for side, start, n in (("old", old_start, old_n), ("new", new_start, new_n)):
                        lines = changed_lines(text, side) if found else []
                        if side == "old":
                            whole = False
                        elif lines:
                            whole = lines[0] == 1 and lines[-1] >= total
                        else:
                            whole = len(found) <= 1 and start <= 1 and start + n >= total
                        first = max(start, 1)
                        rows.append((oid, path, k, text, side, lines, list(range(first, max(start + n - 1, first) + 1)), whole))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _HUNKS.split(", ")])

    return files.select("oid", "path", "patch", "after").mapInPandas(run, _HUNKS)


def symbol_changes(files: DataFrame) -> DataFrame:
    """(oid, path, symbol, name, old_symbol, change, hunks): which symbols a commit's hunks changed, and how.

    Changed lines go to the smallest symbol around them, or else a hunk to the smallest that its range meets; a hunk
    that covers its file, or that meets no symbol, goes to the file (a null symbol).  Symbols of before and
    after are then matched by name, or by equal bodies.
    """
    spans, hunks = written(_spans(files)), written(_hunks(files))
    key = F.concat_ws("\0", "oid", "side", "path")
    placed = spans.select(key.alias("path"), F.col("symbol").alias("breadcrumb"), "start_line", "end_line")
    open_hunks = hunks.filter(~F.col("whole"))

    def met(column: str) -> DataFrame:
        lines = open_hunks.select("oid", "side", "path", "hunk", F.explode(column).alias("line"))
        found = history.align_lines(lines.select(key.alias("path"), "line").distinct(), placed).withColumnRenamed("path", "key")
        return lines.withColumn("key", key).join(found, ["key", "line"]).select("oid", "side", "path", "hunk", F.col("breadcrumb").alias("symbol"))

    exact = written(met("lines").distinct())
    sizes = spans.select("oid", "side", "path", "symbol", (F.col("end_line") - F.col("start_line")).alias("length"))
    near = met("within").join(exact.select("oid", "side", "path", "hunk").distinct(), ["oid", "side", "path", "hunk"], "left_anti").join(sizes, ["oid", "side", "path", "symbol"])
    near = near.groupBy("oid", "side", "path", "hunk").agg(F.min(F.struct("length", "symbol")).alias("best")).select("oid", "side", "path", "hunk", F.col("best.symbol").alias("symbol"))
    touched = written(exact.unionByName(near))
    groups = touched.groupBy("oid", "side", "path", "symbol").agg(F.array_sort(F.collect_set("hunk")).alias("hunks"))
    both = groups.join(spans, ["oid", "side", "path", "symbol"]).withColumn("file", F.concat_ws("\0", "oid", "path"))
    side = lambda s: both.filter(F.col("side") == s)
    listed = lambda s: side(s).select(F.col("file").alias("path"), F.col("symbol").alias("breadcrumb"), "body_key", "start_line")
    matched = history.reconcile(listed("old"), listed("new")).withColumnRenamed("path", "file")
    new = side("new").select("file", "oid", "path", F.col("symbol").alias("new_name"), "name", "hunks")
    old = side("old").select("file", "oid", "path", F.col("symbol").alias("old_name"), "name", "hunks")
    kept = matched.filter("new_name is not null").join(new, ["file", "new_name"]).select("oid", "path", F.col("new_name").alias("symbol"), "name", F.when(F.col("change") == "renamed", F.col("old_name")).alias("old_symbol"), "change", "hunks")
    gone = matched.filter("new_name is null").join(old, ["file", "old_name"]).select("oid", "path", F.col("old_name").alias("symbol"), "name", F.col("old_name").alias("old_symbol"), "change", "hunks")
    # What no symbol took, on the new side, belongs to the file; a hunk that only took something away may be the old side's.
    served = touched.select("oid", "path", "hunk").distinct()
    rest = hunks.filter("side = 'new'").select("oid", "path", "hunk").join(served, ["oid", "path", "hunk"], "left_anti").unionByName(hunks.filter("side = 'new' and whole").select("oid", "path", "hunk").join(served, ["oid", "path", "hunk"], "left_semi"))
    status = F.when(F.col("status") == "A", "added").when(F.col("status") == "D", "deleted").when(F.col("old_path").isNotNull(), "moved").otherwise("modified")
    whole = rest.groupBy("oid", "path").agg(F.array_sort(F.collect_set("hunk")).alias("hunks")).join(files.select("oid", "path", status.alias("change")), ["oid", "path"])
    none = F.lit(None).cast("string")
    return kept.unionByName(gone).unionByName(whole.select("oid", "path", none.alias("symbol"), none.alias("name"), none.alias("old_symbol"), "change", "hunks"))


def git_units(files: DataFrame, commits: DataFrame) -> DataFrame:
    """A unit for each symbol or file that a commit changed (files and commits as the git source gives them), long ones in parts."""
    files = written(files)
    changes = symbol_changes(files)
    texts = _hunks(files).filter("side = 'new'").select("oid", "path", "hunk", "text")
    rows = changes.withColumn("hunk", F.explode("hunks")).join(texts, ["oid", "path", "hunk"])
    rows = rows.groupBy("oid", "path", "symbol", "name", "old_symbol", "change").agg(F.array_sort(F.collect_list(F.struct("hunk", "text"))).alias("texts"))
    rows = rows.join(files.select("oid", "path", "old_path"), ["oid", "path"]).join(commits.select("oid", "message"), "oid")

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                subject = (r.message or "").split("\n")[0].strip()
                head = f"commit {r.oid[:8]} {subject}\n\n{f'{r.path} > {r.symbol}' if r.symbol else r.path}\n\n"
                room = max(1, MAX_TOKENS * 4 - len(head))
                parts, current = [], ""
                for x in r.texts:
                    for piece, _, _ in split_oversized(x["text"], room):
                        if current and len(current) + 1 + len(piece) > room:
                            parts.append(current)
                            current = ""
                        current = f"{current}\n{piece}" if current else piece
                parts.append(current)
                anchors = [("commit", r.oid, "part_of"), ("file", r.path, "changes")]
                if r.old_path and r.old_path != r.path:
                    anchors.append(("file", r.old_path, "renamed_from"))
                if r.change == "deleted" and r.symbol:
                    anchors.append(("symbol", r.old_symbol, "deleted"))
                elif r.name:
                    anchors.append(("symbol", r.name, "changes"))
                    if r.old_symbol:
                        anchors.append(("symbol", r.old_symbol, "renamed_from"))
                anchors = [{"kind": k, "value": v, "relationship": rel} for k, v, rel in anchors]
                for k, body in enumerate(parts):
                    routing = f"source: git_change\ncommit: {r.oid[:8]}\nmessage: {subject}\nchanged file: {r.path}\nchanged symbol: {r.name or '-'}\nchange: {r.change}" + (f"\npart: {k + 1}" if len(parts) > 1 else "")
                    text = head + body
                    out.append((f"git:{r.oid}", "git_commit", k, "git", text, routing, tokens(text), _hash("git", text, routing), anchors, r.path, r.symbol or "", int(r.texts[0]["hunk"])))
            yield pd.DataFrame(out, columns=[*(c.split()[0] for c in UNIT.split(", ")), "path", "symbol", "first"])

    cut = rows.mapInPandas(run, f"{UNIT}, path string, symbol string, first int")
    # All changes of a commit are one source, whose ordinals must differ.
    order = Window.partitionBy("locator").orderBy("path", "first", "symbol", "ordinal", "content_hash")
    return cut.withColumn("ordinal", F.row_number().over(order).cast("long") - 1).drop("path", "symbol", "first")
