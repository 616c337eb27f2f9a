"""Chunking: packing the lines of a section into units, and splitting what is too long."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TOKENS, MERGE_BELOW = 800, 120


def pack_lines(lines: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """Groups of neighbouring lines, each as long as it may be: array of (first, last, tokens), lines counted from 0.

    A unit is its lines joined by blank lines and holds one line at least, however long.
    """
    item = "struct<first:int,last:int,chars:int>"
    tokens = lambda chars: F.greatest(F.ceil(chars / F.lit(4)).cast("long"), F.lit(1).cast("long"))
    sizes = F.transform(lines, lambda x, i: F.struct(i.cast("int").alias("first"), i.cast("int").alias("last"), F.char_length(x).cast("int").alias("chars")))

    def step(acc, x):
        prev = F.element_at(acc, -1)
        joined = (prev["chars"] + 2 + x["chars"]).cast("int")
        fits = (F.size(acc) > 0) & (tokens(joined) <= max_tokens)
        wider = F.struct(prev["first"].alias("first"), x["last"].alias("last"), joined.alias("chars"))
        return F.when(F.size(acc) == 0, F.array(x)).when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(x)))

    packed = F.aggregate(sizes, F.array().cast(f"array<{item}>"), lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(step(acc, x)))
    return F.transform(packed, lambda u: F.struct(u["first"].alias("first"), u["last"].alias("last"), tokens(u["chars"]).alias("tokens")))


def split_oversized(text: str, max_chars: int) -> list[tuple[str, int, int]]:
    """Pieces (text, start, end) of at most ``max_chars``: cut after the last full stop or newline, else hard."""
    out, start = [], 0
    while len(text) - start > max_chars:
        part = text[start : start + max_chars]
        cut = max(part.rfind("."), part.rfind("\n")) + 1
        end = start + (cut or max_chars)
        out.append((text[start:end], start, end))
        start = end
    out.append((text[start:], start, len(text)))
    return out
