"""Quality classifier: interpolated modified Kneser-Ney over byte n-grams, trained on trusted text.

Counts come from all trusted documents and are summed by hash-partitioned jobs.  The model is one table of
n-grams with their discounted probability and, as contexts, their back-off weight.  It is cut into shards
by the bytes that every lookup of a position shares.  The n-grams of the documents are counted by chunk and
joined with the shards: a task holds one shard, of a bounded size, and streams the counts past it, so the
corpus is read once for a model of any size.  The most frequent n-grams, a bounded number, are scored
before, as heavy keys of the join.  A document's log-probability is the sum over shards.

Texts are in two folds by their hash, and each fold is scored by the model of the other, so that no document is
judged by counts of itself.  A language's threshold is a quantile of the perplexities of all its trusted
documents, plus a slack.

A language without trusted texts in both folds has no two models of its own.  All its documents are scored by
the models of all languages together, one a fold, and so are all trusted documents once more: a language's
threshold is then the quantile of its own trusted documents by these models, or, if it has none, that
of the trusted documents of all languages.

Defined results: a null or empty text has no n-grams, no perplexity and is not kept; a null language
is the language ``""``; without trusted texts in both folds of all languages together there is no
held-out perplexity to compare with, and nothing is rejected; a document with several labels is trusted if one of
them trusts it; ties with the threshold are kept; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.bloom import BlockedBloom, filter_of
from lodestone.llm.common import chunks, mix, plain, release_memory, segments, written

ORDER = 5
#: The share of a language's trusted documents that passes.
QUANTILE = 0.99
#: Perplexity may exceed the quantile by this factor.
SLACK = 1.15
#: N-grams of a shard, about; 24 bytes each in a task's memory.
SHARD_ENTRIES = 500_000
#: The most frequent n-grams that are broadcast with their probabilities at most; 16 bytes each.
HEAD_ENTRIES = 500_000
#: Short n-grams (two bytes or less) of all languages that are broadcast at most; more are dealt to every shard.
SHORT_ENTRIES = 1_000_000
_IS_SHORT = "(n <= 2 and p is not null) or (n <= 1 and weight is not null)"
#: Bytes of text whose n-grams are counted together.
CHUNK = 1 << 20
#: A byte before each text, which no UTF-8 text holds.
START = 0xFF


def _codes(buf: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text, it and the ``order - 1`` before it as a number; texts are led by START bytes."""
    pad = order - 1
    sizes = np.diff(at)
    padded = np.full(len(buf) + pad * len(sizes), START, np.uint8)
    shift = np.repeat(np.arange(1, len(sizes) + 1) * pad, sizes)
    place = np.arange(len(buf)) + shift
    padded[place] = buf
    code = np.zeros(len(buf), np.uint64)
    for k in range(order):
        code |= padded[place - k].astype(np.uint64) << np.uint64(8 * k)
    return code, np.repeat(np.arange(len(sizes)), sizes)


def _lang_ids(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def counts(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, c): occurrences of each n-gram of the highest order in the trusted texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, at in chunks(batches, "text", CHUNK):
            langs = np.array(_lang_ids(batch.column(0)))
            code, text = _codes(buf, at, order)
            for lang in np.unique(langs):
                grams, c = np.unique(code[(langs == lang)[text]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(c)], ["lang", "gram", "c"])
        release_memory()

    found = trusted.select("lang", "text").mapInArrow(run, "lang string, gram bigint, c bigint")
    return found.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def model(top: DataFrame, order: int = ORDER) -> DataFrame:
    """From written ``counts``: (lang, n, gram, p, weight): for each n-gram its discounted probability and its back-off weight as a context.

    A null p is an n-gram that is only a context.  Orders below the highest use continuation counts.
    """
    levels = {order: top}
    for n in range(order - 1, 0, -1):
        mask = (1 << (8 * n)) - 1
        levels[n] = levels[n + 1].select("lang", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("c"))
        if n == order - 1:
            levels[n] = written(levels[n])
    parts = []
    for n, level in levels.items():
        # The discounts of Chen and Goodman from the counts of counts, per language.
        stats = level.groupBy("lang").agg(*(F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)))
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
        d = [F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1.0)))) for k in (1, 2, 3)]
        stats = stats.select("lang", *(x.alias(f"d{k + 1}") for k, x in enumerate(d)))
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = level.join(F.broadcast(stats), "lang").select("lang", "gram", F.shiftrightunsigned("gram", 8).alias("context"), "c", off.alias("off"))
        contexts = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("off").alias("freed"))
        joined = rows.join(contexts, ["lang", "context"])
        parts.append(joined.select("lang", F.lit(n).alias("n"), "gram", ((F.col("c") - F.col("off")) / F.col("total")).alias("p"), F.lit(None).cast("double").alias("weight")))
        parts.append(contexts.select("lang", F.lit(n - 1).alias("n"), F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), (F.col("freed") / F.col("total")).alias("weight")))
    every = parts[0]
    for x in parts[1:]:
        every = every.union(x)
    return every.groupBy("lang", "n", "gram").agg(F.max("p").alias("p"), F.max("weight").alias("weight"))


class Scorer:
    """One shard of the model in sorted arrays."""

    def __init__(self, langs: list[str], lang: np.ndarray, n: np.ndarray, gram: np.ndarray, p: np.ndarray, weight: np.ndarray, order: int):
        """Rows of n-grams: the number of their language, order, code, and p or weight (nan where there is none)."""
        self.order = order
        self.probability, self.weight = ({}, {})
        for table, value in ((self.probability, p), (self.weight, weight)):
            some = np.flatnonzero(~np.isnan(value))
            some = some[np.lexsort((gram[some], n[some], lang[some]))]
            kind = lang[some].astype(np.int64) * 16 + n[some]
            for i, j in zip(*segments(kind), strict=True):
                table[langs[lang[some[i]]], int(n[some[i]])] = (gram[some[i:j]], value[some[i:j]])

    @staticmethod
    def _find(table: dict, key: tuple[str, int], gram: np.ndarray, miss: float) -> np.ndarray:
        if key not in table:
            return np.full(len(gram), miss)
        known, value = table[key]
        at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
        return np.where(known[at] == gram, value[at], miss)

    def log_probability(self, lang: str, codes: np.ndarray) -> np.ndarray:
        """Of the last byte of each code after the others."""
        prob = np.full(len(codes), 1 / 256)
        for n in range(1, self.order + 1):
            gram = codes & np.uint64((1 << (8 * n)) - 1)
            prob = self._find(self.probability, (lang, n), gram, 0.0) + self._find(self.weight, (lang, n - 1), gram >> np.uint64(8), 1.0) * prob
        return np.log2(prob)


def _pack(grams: np.ndarray, docs: np.ndarray, times: np.ndarray) -> bytes:
    """Occurrences of n-grams, sorted by n-gram, in few and well compressible bytes."""
    first, end = segments(grams)
    sizes = (end - first).astype("<u4")
    planes = np.ascontiguousarray(grams[first].astype("<u8").view(np.uint8).reshape(-1, 8).T)
    wide = [np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T) for x in (sizes, docs, times)]
    return b"".join([len(first).to_bytes(4, "little"), len(docs).to_bytes(4, "little"), planes.tobytes(), *(x.tobytes() for x in wide)])


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams, and of each occurrence the number of its n-gram, its document and how often."""
    g, m = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
    flat, at, out = np.frombuffer(raw, np.uint8), 8, []
    for width, size in ((8, g), (4, g), (4, m), (4, m)):
        out.append(np.ascontiguousarray(flat[at : at + width * size].reshape(width, size).T).view(f"<u{width}").ravel())
        at += width * size
    return out[0].astype(np.uint64), np.repeat(np.arange(g), out[1]), out[2].astype(np.int64), out[3].astype(np.float64)


def _shard_of(pair: np.ndarray, shards: int) -> np.ndarray:
    """The shard of the two bytes before the last one."""
    return (mix(pair.astype(np.uint64)) % np.uint64(shards)).astype(np.int32)


_ASKED = "slot int, chunk bigint, doc int, size bigint, value double, lang string, packed binary"
_STORED = "slot int, lang string, n int, gram bigint, p double, weight double"


def _short(table: DataFrame):
    """Broadcast arrays of the short n-grams and contexts, at most 66 thousand a language; None if all languages' are too many."""
    low = table.filter(_IS_SHORT).select("lang", "n", "gram", F.when(F.col("n") <= 2, F.col("p")).alias("p"), F.when(F.col("n") <= 1, F.col("weight")).alias("weight"))
    if low.count() > SHORT_ENTRIES:
        return None
    return table.sparkSession.sparkContext.broadcast(_scorer(low.toArrow().to_batches(), 0))


def _dealt(table: DataFrame, shards: int, short: bool) -> DataFrame:
    """The model's rows by slot (their shard).  Every lookup of a position shares its bytes 1 and 2 but for the short
    n-grams and contexts: these go to all slots if ``short``, or are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gram = np.asarray(b.column(1)).astype(np.int64), np.asarray(b.column(2)).view(np.uint64)
            values = [np.asarray(b.column(i).fill_null(float("nan"))) for i in (3, 4)]
            # The row as an n-gram (looked up by bytes 1 and 2) and as a context (by its bytes 0 and 1, which are those).
            for k, least, pair in ((0, 3, gram >> np.uint64(8)), (1, 2, gram)):
                mine = ~np.isnan(values[k])
                high, low = np.flatnonzero(mine & (n >= least)), np.flatnonzero(mine & (n < least) & short)
                row = np.concatenate((high, np.repeat(low, shards)))
                slot = np.concatenate((_shard_of(pair[high] & np.uint64(0xFFFF), shards), np.tile(np.arange(shards), len(low))))
                none, value = pa.nulls(len(row), pa.float64()), pa.array(values[k][row])
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), b.column(0).take(pa.array(row)), pa.array(n[row].astype(np.int32)), pa.array(gram[row].view(np.int64)), none if k else value, value if k else none], [x.split()[0] for x in _STORED.split(", ")])

    return table.select("lang", "n", "gram", "p", "weight").mapInArrow(run, _STORED)


def _summed(rows: DataFrame, column: str, codes_of: Callable, table: DataFrame, order: int, shard_entries: int, head=None) -> DataFrame:
    """All columns of ``rows`` but ``column`` (which ``codes_of`` turns into n-grams), ``size`` and ``log2``, the sum of log2 probabilities.

    The n-grams of a chunk of rows are counted by row and dealt to the model's shards; a task holds one shard and
    streams all counts past it; what the shards add to a row meets in a sum.  N-grams that ``head`` holds are scored at once.
    """
    spark = rows.sparkSession
    keep = [c for c in rows.columns if c != column]
    shards = max(-(-table.count() // shard_entries), int(spark.conf.get("spark.sql.shuffle.partitions")))
    meta = rows.select(*keep).schema

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        known = head.value if head is not None else {}
        names = ["slot", "chunk", "doc", "size", "value", "lang", "packed"]
        for batch, code, text in codes_of(batches, len(keep)):
            langs = np.array(_lang_ids(batch.column(keep.index("lang"))), dtype=object)
            value = np.zeros(batch.num_rows)
            found: list[tuple[int, str, bytes]] = []
            for lang in sorted(set(langs)):
                some = (langs == lang)[text]
                own = text[some]
                # Each distinct n-gram of the chunk is looked up once.
                distinct, distinct_of = np.unique(code[some], return_inverse=True)
                rest = np.ones(len(distinct), bool)
                if lang in known:
                    grams, logs = known[lang]
                    at = np.minimum(np.searchsorted(grams, distinct), len(grams) - 1)
                    rest = grams[at] != distinct
                    value += np.bincount(own, np.where(rest, 0.0, logs[at])[distinct_of], batch.num_rows)
                tail = np.flatnonzero(rest[distinct_of])
                # Counts by n-gram and row.
                pair, times = np.unique(distinct_of[tail] * np.int64(batch.num_rows) + own[tail], return_counts=True)
                gram, doc = distinct[pair // batch.num_rows], pair % batch.num_rows
                shard = _shard_of(gram >> np.uint64(8) & np.uint64(0xFFFF), shards)
                by = np.argsort(shard, kind="stable")
                for i, j in zip(*segments(shard[by]), strict=True):
                    found.append((int(shard[by[i]]), lang, _pack(gram[by[i:j]], doc[by[i:j]], times[by[i:j]])))
            n = batch.num_rows
            slot = mix(np.arange(n, dtype=np.uint64) + np.uint64(number)) % np.uint64(shards)
            data = [pa.array(slot.astype(np.int32)), pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.bincount(text, minlength=n)), pa.array(value), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([*data, pa.StructArray.from_arrays([batch.column(i) for i in range(len(keep))], keep)], [*names, "meta"])
            m = len(found)
            if m:
                data = [pa.array([x[0] for x in found], pa.int32()), pa.array(np.full(m, number)), *(pa.nulls(m, t) for t in (pa.int32(), pa.int64(), pa.float64())), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.binary())]
                kind = pa.struct([pa.field(f, batch.column(i).type) for i, f in enumerate(keep)])
                yield pa.RecordBatch.from_arrays([*data, pa.nulls(m, kind)], [*names, "meta"])
            number += 1
        release_memory()

    held = f"{_ASKED}, meta {meta.simpleString()}"
    asked = rows.select(*keep, column).mapInArrow(ask, held)
    base = _short(table)
    stored = _dealt(table, shards, base is None)
    none = lambda x: [F.lit(None).cast(x.schema[c].dataType).alias(c) for c in x.columns]
    both = stored.select("slot", F.lit(0).alias("tag"), *(F.col(c) for c in ("n", "gram", "p", "weight")), *(F.col(c) if c == "lang" else x for c, x in zip(asked.columns[1:], none(asked)[1:], strict=True)))
    other = asked.select("slot", F.lit(1).alias("tag"), *none(stored.select("n", "gram", "p", "weight")), *asked.columns[1:])
    dealt = both.union(other).repartition(shards, "slot").sortWithinPartitions("slot", "tag")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk", "doc", "size", "value", "meta"]
        slot, parts, scorer = None, [], None
        for batch in batches:
            slots = np.asarray(batch.column(0))
            tags = np.asarray(batch.column(1))
            for i, j in zip(*segments(slots.astype(np.int64) * 2 + tags), strict=True):
                part = batch.slice(i, j - i)
                if slots[i] != slot:
                    slot, parts, scorer = slots[i], [], None
                if not tags[i]:
                    parts.append(part.select(["lang", "n", "gram", "p", "weight"]))
                    continue
                whole = part.filter(pc.is_null(part.column("packed")))
                if whole.num_rows:
                    yield whole.select(names)
                for chunk, lang, raw in zip(*(part.filter(pc.is_valid(part.column("packed"))).column(c).to_pylist() for c in ("chunk", "lang", "packed")), strict=True):
                    if scorer is None:
                        scorer, parts = _scorer(parts, order, base.value if base is not None else None), []
                    grams, number, doc, times = _unpack(raw)
                    sums = np.bincount(doc, scorer.log_probability(lang, grams)[number] * times)
                    touched = np.unique(doc)
                    m = len(touched)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, chunk)), pa.array(touched.astype(np.int32)), pa.nulls(m, pa.int64()), pa.array(sums[touched]), pa.nulls(m, part.column("meta").type)], names)
        release_memory()

    sums = dealt.mapInArrow(answer, f"chunk bigint, doc int, size bigint, value double, meta {meta.simpleString()}").groupBy("chunk", "doc")
    out = sums.agg(F.sum("value").alias("log2"), F.max("size").alias("size"), F.first("meta", ignorenulls=True).alias("meta"))
    return out.select(*(F.col(f"meta.`{c}`").alias(c) for c in keep), "size", "log2")


def _scorer(parts: list[pa.RecordBatch], order: int, base: Scorer | None = None) -> Scorer:
    """What some rows hold, and the tables of ``base``, which are of other orders."""
    own = _scorer_of(parts, order)
    if base is not None:
        own.probability |= base.probability
        own.weight |= base.weight
    return own


def _scorer_of(parts: list[pa.RecordBatch], order: int) -> Scorer:
    if not parts:
        none = np.zeros(0)
        return Scorer([], none.astype(np.int64), none.astype(np.int64), none.astype(np.uint64), none, none, order)
    rows = pa.Table.from_batches(parts).combine_chunks()
    names = rows.column("lang").combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    p, weight = (np.asarray(rows.column(c).combine_chunks().fill_null(float("nan"))) for c in ("p", "weight"))
    return Scorer(names.dictionary.to_pylist(), np.asarray(names.indices), np.asarray(rows.column("n").combine_chunks()), np.asarray(rows.column("gram").combine_chunks()).view(np.uint64), p, weight, order)


def _head(table: DataFrame, top: DataFrame, order: int, shard_entries: int, head_entries: int):
    """The most frequent n-grams of the highest order with their log2 probabilities, ``head_entries`` at most, broadcast; None if there are none.

    They are most of all text and would be in every chunk's counts.  Only work is saved: results are the same without.
    """
    # Classes of counts, eight to a doubling: as many of the highest as fit.
    level = F.floor(F.log2(F.col("c")) * 8)
    sizes = top.groupBy(level.alias("level")).count().collect()
    least, total = None, 0
    for r in sorted(sizes, key=lambda r: -r["level"]):
        total += r["count"]
        if total > head_entries:
            break
        least = r["level"]
    if least is None:
        return None

    def codes(batches: Iterator[pa.RecordBatch], at: int):
        for b in batches:
            yield b, np.asarray(b.column(at)).view(np.uint64), np.arange(b.num_rows)

    rows = top.filter(level >= least).select("lang", "gram", F.col("gram").alias("code"))
    known = _summed(rows, "code", codes, table, order, shard_entries).select("lang", "gram", "log2").toArrow()
    langs = known.column("lang").combine_chunks().dictionary_encode()
    langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
    index, gram, log2 = np.asarray(langs.indices), np.asarray(known.column("gram")).view(np.uint64), np.asarray(known.column("log2"))
    out = {}
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        some = np.flatnonzero(index == k)
        some = some[np.argsort(gram[some])]
        out[lang] = (gram[some], log2[some])
    return table.sparkSession.sparkContext.broadcast(out)


def perplexities(docs: DataFrame, table: DataFrame, order: int = ORDER, shard_entries: int = SHARD_ENTRIES, head=None) -> DataFrame:
    """All columns of ``docs`` but ``text`` (one of them lang), the number of bytes, and the sum of log2 probabilities.

    ``table`` is a written model.
    """

    def codes(batches: Iterator[pa.RecordBatch], at: int):
        for batch, buf, offsets in chunks(batches, "text", CHUNK):
            yield batch, *_codes(buf, offsets, order)

    return _summed(docs, "text", codes, table, order, shard_entries, head).withColumnRenamed("size", "n_bytes")


def _pruned(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Without most documents that are not trusted, so that the join moves no more text than it must."""
    shared = filter_of(trusted.select(F.xxhash64("doc_id")))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = BlockedBloom(shared.value)
        for b in batches:
            if b.num_rows:
                keep = pa.array(known.might_hold(np.asarray(b.column(b.num_columns - 1)).astype(np.int64)))
                yield b.select(schema.names).filter(keep)

    return docs.withColumn("_hash", F.xxhash64("doc_id")).mapInArrow(run, schema)


def _thresholds(perplexity: DataFrame, quantile: float, slack: float) -> DataFrame:
    """(own, threshold) from (own, perplexity): the least logarithm, in steps of 1e-4, that so many perplexities reach at most, plus the slack.

    Counts by step are few, however many documents there are: perplexities are below e**40.
    """
    step = F.least(F.ceil(F.log("perplexity") * 10_000), F.lit(400_000))
    counts = perplexity.groupBy("own", step.alias("step")).agg(F.count("*").alias("c"))
    by_lang = Window.partitionBy("own")
    reached = counts.withColumn("upto", F.sum("c").over(by_lang.orderBy("step"))).withColumn("all", F.sum("c").over(by_lang))
    return reached.filter(F.col("upto") >= F.col("all") * quantile).groupBy("own").agg(F.round(F.exp(F.min("step") / 10_000) * slack, 6).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, slack: float = SLACK, shard_entries: int = SHARD_ENTRIES, head_entries: int = HEAD_ENTRIES) -> DataFrame:
    """doc_id, perplexity (per byte), threshold and kept for each document."""
    trusted = plain(labels, "doc_id", "quality", "toxic").filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    fold = F.pmod(F.xxhash64("text"), F.lit(2))
    docs = plain(docs, "doc_id", "lang", "text").withColumn("fold", fold)
    # A model is named by fold and language, or by the fold alone if it is of all languages: trusted texts count
    # towards the model of the other fold.
    docs = docs.withColumn("own", F.coalesce("lang", F.lit(""))).drop("lang")
    named = lambda f: F.concat(f.cast("string"), F.lit(":"), F.col("own"))
    some = _pruned(docs, trusted).join(trusted, "doc_id", "left_semi")
    top = written(counts(some.withColumn("lang", named(1 - F.col("fold"))), order))
    names = {r.lang for r in top.select("lang").distinct().collect()}
    whole = [x[2:] for x in names if x[0] == "0" and f"1:{x[2:]}" in names]
    scoped = F.col("own").isin(whole)
    pooled = bool(names) and bool(docs.filter(~scoped).limit(1).count())
    docs = docs.select("doc_id", "own", F.when(scoped, named(F.col("fold"))).otherwise(F.col("fold").cast("string")).alias("lang"), F.lit(False).alias("extra"), "text")
    both = False
    top = top.filter(F.substring("lang", 3, 1 << 30).isin(whole))
    if pooled:
        some = written(some)
        rest = written(counts(some.withColumn("lang", (1 - F.col("fold")).cast("string")), order))
        both = rest.select("lang").distinct().count() == 2
        top = top.union(rest)
        docs = docs.union(some.select("doc_id", "own", F.col("fold").cast("string"), F.lit(True), "text"))
    table = written(model(top, order))
    head = _head(table, top, order, shard_entries, head_entries) if head_entries else None
    scored = perplexities(docs, table, order, shard_entries, head)
    value = F.when(F.col("n_bytes") > 0, F.round(F.pow(F.lit(2.0), -F.col("log2") / F.col("n_bytes")), 6))
    scored = written(scored.select("doc_id", "own", "extra", value.alias("perplexity")))
    # The trusted documents by the models that score the others of their language.
    known = scored.join(trusted, "doc_id", "left_semi").filter(F.col("perplexity").isNotNull() & (F.col("extra") | scoped))
    by_lang = _thresholds(known.filter(F.col("extra") != scoped).select("own", "perplexity"), quantile, slack)
    every = _thresholds(known.filter("extra").select(F.lit("").alias("own"), "perplexity"), quantile, slack).first() if both else None
    if not both:
        by_lang = by_lang.filter(scoped)
    out = scored.filter("not extra").join(F.broadcast(by_lang), "own", "left").withColumn("threshold", F.coalesce("threshold", F.lit(float("inf") if every is None else every.threshold)))
    return out.select("doc_id", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
