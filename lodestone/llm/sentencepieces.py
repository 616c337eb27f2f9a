"""SentencePiece encoding and decoding by a shared-prefix forward pass over sorted words.

Texts are cut into marked words (a run of U+2581 and what follows).  The distinct words of a chunk are
sorted, which is a depth-first walk of their trie: the forward states of a word's prefix are those of
the word before as far as the two agree, and only the rest is computed.

For a unigram model a state is the best score of a prefix and its last piece (Viterbi).  For a BPE model,
which is what the installed vocabulary is, highest sums of scores do not give the model's segmentation;
there the state of a prefix is the last piece of its own encoding.  That piece is unique: it is the one
ending there that is stable by itself and compatible with the state before it.  Both walks share all else.

Defined results: a null or empty text has no pieces; characters outside the vocabulary become byte
pieces; U+2581 in a text reads as a space, as the library does; repeated rows are encoded one by one;
extra columns pass through ``encode``.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import chunks, plain

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Text bytes whose words are sorted together.
SHARE_BYTES = 4 << 20
#: Words remembered between the chunks of a task at most, and pairs of pieces and automaton steps between tasks.
REMEMBER_WORDS = 250_000
REMEMBER_PAIRS = 400_000
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")
_MISSING = -1


def shared_prefixes(words: list[str]) -> Iterator[int]:
    """The length of the prefix that each word shares with the one before it."""
    width, last = 24, ""
    for i in range(0, len(words), 20_000):
        block = [last, *words[i : i + 20_000]]
        # The first characters as numbers, zero beyond a word's end; the rest of longer words is compared by itself.
        head = np.array([w[:width] for w in block], f"U{width}").view(np.uint32).reshape(len(block), width)
        same = np.argmin(np.column_stack((head[1:] == head[:-1], np.zeros(len(block) - 1, bool))), axis=1)
        for before, word, k in zip(block, block[1:], same.tolist(), strict=False):
            most = min(len(before), len(word))
            k = min(k, most)
            if k == width:
                while k < most and before[k] == word[k]:
                    k += 1
            yield k
        last = block[-1]


class Encoder:
    """One model's pieces as an automaton, and the forward pass over words."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], unigram: bool, surface: list[bytes]):
        self.pieces, self.byte_ids, self.unigram, self.surface = pieces, byte_ids, unigram, surface
        self.names = {i: p for p, (i, _) in pieces.items()}
        self.low = min((s for _, s in pieces.values()), default=0.0) - 10.0
        self.sizes = {i: len(p) for i, p in self.names.items()}
        #: For each piece, whether it may follow a piece; a missing character before it (-1) always lets it.
        self.fits: dict[int, dict[int, bool]] = {i: {_MISSING: True} for i in self.names}
        self.n_fits = self.n_steps = 0
        self.words: dict[str, bytes] = {}
        self._automaton()

    @staticmethod
    def load(model: bytes) -> Encoder:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        if norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only models with the identity rule and a marked first word are supported")
        pieces, byte_ids, surface = {}, [0] * 256, []
        for i, p in enumerate(spec.pieces):
            if p.type == 1:
                pieces[p.piece] = (i, p.score)
            if p.type == 6:
                byte_ids[int(p.piece[3:5], 16)] = i
            surface.append(bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() if p.type == 1 else b"")
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece spans two words")
        del sentencepiece
        return Encoder(pieces, byte_ids, spec.trainer_spec.model_type == 1, surface)

    def _automaton(self) -> None:
        """Nodes of the pieces' trie; for each, the stable pieces that end there, longest first."""
        step: list[dict[str, int]] = [{}]
        own = [_MISSING]
        for p, (i, _) in self.pieces.items():
            node = 0
            for c in p:
                nxt = step[node].get(c)
                if nxt is None:
                    nxt = step[node][c] = len(step)
                    step.append({})
                    own.append(_MISSING)
                node = nxt
            own[node] = i
        fail, out = [0] * len(step), [()] * len(step)
        queue = list(step[0].values())
        for node in queue:
            if own[node] >= 0 and (self.unigram or self.bpe(self.names[own[node]]) == [own[node]]):
                out[node] = ((len(self.names[own[node]]), own[node]), *out[fail[node]])
            else:
                out[node] = out[fail[node]]
            for c, child in step[node].items():
                back = fail[node]
                while back and c not in step[back]:
                    back = fail[back]
                fail[child] = step[back].get(c, 0) if step[back].get(c, 0) != child else 0
                queue.append(child)
        self.step, self.fail, self.out = step, fail, out
        #: Steps of the automaton, failures followed, as they come to be known.
        self.goto = [dict(x) for x in step]

    def bpe(self, text: str) -> list[int]:
        """Merges by score, the leftmost of equal ones first, as the definition says; characters outside are missing."""
        parts = list(text)
        while len(parts) > 1:
            best, where = None, -1
            for k in range(len(parts) - 1):
                x = self.pieces.get(parts[k] + parts[k + 1])
                if x is not None and (best is None or x[1] > best):
                    best, where = x[1], k
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return [self.pieces[p][0] if p in self.pieces else _MISSING for p in parts]

    def _pair(self, a: int, b: int) -> bool:
        if self.n_fits >= REMEMBER_PAIRS:
            self.fits, self.n_fits = {i: {_MISSING: True} for i in self.names}, 0
        self.n_fits += 1
        known = self.fits[b][a] = self.bpe(self.names[a] + self.names[b]) == [a, b]
        return known

    def _step(self, node: int, c: str) -> int:
        """Where a character leads that is no edge of the trie."""
        start = node
        while node and c not in self.step[node]:
            node = self.fail[node]
        node = self.step[node].get(c, 0)
        if self.n_steps >= REMEMBER_PAIRS:
            self.goto[:], self.n_steps = [dict(x) for x in self.step], 0
        self.n_steps += 1
        self.goto[start][c] = node
        return node

    def encode_sorted(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each word as little-endian int32, for words in sorted order."""
        return self._viterbi(words) if self.unigram else self._merged(words)

    def _ids(self, word: str, lasts: list[int]) -> bytes:
        """The ids on the way back from the last state."""
        sizes, ids, i = self.sizes, [], len(word)
        while i:
            last = lasts[i]
            if last < 0:
                ids.extend(self.byte_ids[b] for b in reversed(word[i - 1].encode()))
                i -= 1
            else:
                ids.append(last)
                i -= sizes[last]
        ids.reverse()
        return array("i", ids).tobytes()

    def _viterbi(self, words: list[str]) -> Iterator[bytes]:
        out, names, pieces = self.out, self.names, self.pieces
        nodes, lasts, scores = [0], [_MISSING], [0.0]
        for word, k in zip(words, shared_prefixes(words), strict=True):
            del nodes[k + 1 :], lasts[k + 1 :], scores[k + 1 :]
            node = nodes[k]
            for c in word[k:]:
                known = self.goto[node].get(c)
                node = self._step(node, c) if known is None else known
                nodes.append(node)
                # Of equal scores the longest last piece wins; a character without a piece comes last.
                last, score = _MISSING, float("-inf")
                for n, p in out[node]:
                    if (s := scores[-n] + pieces[names[p]][1]) > score:
                        last, score = p, s
                if c not in pieces and (s := scores[-1] + self.low) > score:
                    last, score = _MISSING, s
                lasts.append(last)
                scores.append(score)
            yield self._ids(word, lasts)

    def _merged(self, words: list[str]) -> Iterator[bytes]:
        out = self.out
        nodes, lasts = [0], [_MISSING]
        for word, k in zip(words, shared_prefixes(words), strict=True):
            del nodes[k + 1 :], lasts[k + 1 :]
            node = nodes[k]
            for c in word[k:]:
                known = self.goto[node].get(c)
                node = self._step(node, c) if known is None else known
                nodes.append(node)
                last = _MISSING
                for n, p in out[node]:
                    # Of the state before the piece; the first state is -1 like a missing character.
                    fit = self.fits[p].get(lasts[-n])
                    if self._pair(lasts[-n], p) if fit is None else fit:
                        last = p
                        break
                lasts.append(last)
            yield self._ids(word, lasts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the texts' distinct words are encoded together."""
        cut = [_WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = sorted({w for x in cut for w in x if w not in self.words})
        if len(self.words) + len(new) > REMEMBER_WORDS:
            self.words.clear()
            new = sorted({w for x in cut for w in x})
        self.words.update(zip(new, self.encode_sorted(new), strict=True))
        known = self.words
        return [b"".join([known[w] for w in x]) for x in cut]

    def forget(self) -> None:
        """Words are remembered for a task, not by an idle worker."""
        self.words.clear()

    def spelled(self, ids: bytes) -> bytes:
        """The bytes that some pieces stand for, a marked word's blank included."""
        surface = self.surface
        return b"".join([surface[i] for i in array("i", ids)])

    def decode(self, ids: bytes) -> str:
        out = self.spelled(ids)
        return out[1:].decode("utf-8", "replace") if out[:1] == b" " else out.decode("utf-8", "replace")


_LOADED: dict[bytes, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    name = hashlib.sha256(model).digest()
    if name not in _LOADED:
        _LOADED[name] = Encoder.load(model)
    return _LOADED[name]


def _shared(df: DataFrame, model_path: str):
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _ids_column(ids: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode(docs: DataFrame, model_path: str = MODEL, checked: bool = False) -> DataFrame:
    """All columns of ``docs`` but ``text``, and ``ids`` (an array of int); columns of that name are replaced.

    ``checked`` adds ``round_trip``: whether decoding the ids gives the text back.
    """
    added = ["ids", "round_trip"][: 1 + checked]
    names = [c for c in docs.columns if c.lower() not in ("text", *added)]
    shared = _shared(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(shared.value)
        for batch, _, _ in chunks(batches, "text", SHARE_BYTES):
            texts = [x or "" for x in batch.column(len(names)).to_pylist()]
            ids = model.encode(texts)
            extra = [pa.array([model.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_())] if checked else []
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), _ids_column(ids), *extra], [*names, *added])
        model.forget()

    source = docs.select(*(F.col(f"`{c}`") for c in names), "text")
    kinds = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in names)
    return source.mapInArrow(run, f"{kinds}ids array<int>" + ", round_trip boolean" * checked)


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """All columns but ``ids``, and ``text``; null ids give an empty text."""
    names = [c for c in encoded.columns if c != "ids"]
    shared = _shared(encoded, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(shared.value)
        for batch in batches:
            texts = [model.decode(np.array(x or [], "<i4").tobytes()) for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(texts, pa.string())], [*names, "text"])

    source = encoded.select(*(F.col(f"`{c}`") for c in names), "ids")
    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names)
    return source.mapInArrow(run, f"{kinds}, text string")


def digest(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """One row per document: number of pieces, hash of the ids (little-endian int32), and whether decoding gives the text back."""
    shared = _shared(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(shared.value)
        for batch, _, _ in chunks(batches, "text", SHARE_BYTES):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids = model.encode(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([model.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_())], ["doc_id", "n_pieces", "ids_sha256", "round_trip"])
        model.forget()

    return plain(docs, "doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pieces bigint, ids_sha256 string, round_trip boolean")
