"""The engine on the command line: ``python -m lodestone <verb> --store <folder> ...``; results are JSON on standard output."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from lodestone.engine import ENSURE_S, Engine
from lodestone.operators.admission import Limits
from lodestone.plans import packets
from lodestone.sources.embedding import HttpEmbedder


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lodestone")
    parser.add_argument("--store", required=True, help="folder of the index")
    parser.add_argument("--embedder", help="address of an embedding service")
    parser.add_argument("--model", default="embed", help="version under which vectors are stored")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("index", "ensure"):
        p = verbs.add_parser(verb)
        p.add_argument("path", nargs="?", default=".")
        p.add_argument("--log", action="append", help="session log, any number of times")
        p.add_argument("--session-index")
        if verb == "ensure":
            p.add_argument("--seconds", type=float, default=ENSURE_S)
    p = verbs.add_parser("query")
    p.add_argument("text", nargs="+", help="questions")
    p.add_argument("--tokens", type=int)
    p.add_argument("--top", type=int, default=packets.TOP)
    p.add_argument("--evidence-only", action="store_true")
    p.add_argument("--exclude-session", action="append")
    for verb in ("inspect", "sessions"):
        verbs.add_parser(verb).add_argument("symbol")
    verbs.add_parser("status")
    return parser


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs one verb; the exit code is 1 where its status is an error."""
    a = _parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    engine = Engine(spark, a.store)
    embed = HttpEmbedder(a.embedder) if a.embedder else None
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    if a.verb in ("index", "ensure"):
        more = {"logs": a.log, "session_index": a.session_index, "embed": embed, "model": a.model}
        out = engine.index(a.path, **more) if a.verb == "index" else engine.ensure(a.path, a.seconds, **more)
    elif a.verb == "query":
        questions = spark.createDataFrame(list(enumerate(a.text)), "query_id long, text string")
        out = rows(engine.query(questions, embed, a.model, a.exclude_session, Limits(max_tokens=packets.clamp_tokens(a.tokens)), a.top, a.evidence_only).orderBy("query_id"))
    elif a.verb == "status":
        out = engine.status()
    else:
        out = rows(getattr(engine, a.verb)(a.symbol))
    print(json.dumps(out, indent=2, default=str))
    return int(isinstance(out, dict) and out.get("status") == "error")


if __name__ == "__main__":
    raise SystemExit(main())
