"""Personal data: regular expressions propose spans, validators confirm them, context adjusts the score.

E-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers are the base kinds; IBANs
(mod 97) and social security numbers (accepted only near a telling word) are added.  All searches take
time in proportion to the text, whatever it holds.

Defined results: null and empty texts have no spans; repeated rows are searched one by one; spans of one
kind never overlap, spans of different kinds may; extra columns pass through ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import chunks, plain

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
#: What a validated span of a kind scores by itself, and how much a telling word nearby adds.
PRIOR = {"email": 0.9, "ip": 0.8, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": re.compile(r"(?i)e-?mail|contact|write to"),
    "ip": re.compile(r"(?i)\bip\b|address|host|server"),
    "card": re.compile(r"(?i)card|visa|mastercard|payment|credit"),
    "phone": re.compile(r"(?i)phone|call|tel|mobile|fax"),
    "iban": re.compile(r"(?i)iban|account|bank|konto|cuenta|compte"),
    "ssn": re.compile(r"(?i)\bssn\b|social security"),
}
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3
#: Added spans need this score; base spans are confirmed by their validator alone.
MIN_SCORE = 0.5

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """Whether a string of digits has a right check digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces has right check digits."""
    moved = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # Every match holds an @ right after the longest run of local characters, so each @ is tried once.
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _iban_end(text: str, m: re.Match) -> int | None:
    # The longest prefix that ends at a word's end and passes the check.
    end = m.end()
    while end - m.start() >= 15:
        if mod97(text[m.start() : end].replace(" ", "")):
            return end
        cut = text.rfind(" ", m.start() + 4, end)
        if cut < 0:
            return None
        end = cut
    return None


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then by start; positions in code points."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += (("email", s, e) for s, e in _emails(text))
    numbers = [m for m in _CARD.finditer(text)]
    if numbers or "." in text:
        found += (("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split("."))))
    for m in numbers:
        if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += (("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15)
    if numbers:
        at = 0
        while m := _IBAN.search(text, at):
            # A match may run on into the next IBAN, so the search resumes at the confirmed end.
            at = m.start() + 1
            if (end := _iban_end(text, m)) is not None:
                found.append(("iban", m.start(), end))
                at = end
        found += (("ssn", m.start(), m.end()) for m in _SSN.finditer(text))
    out = []
    for kind, s, e in found:
        near = CONTEXT[kind].search(text[max(0, s - CONTEXT_CHARS) : s]) or CONTEXT[kind].search(text[e : e + CONTEXT_CHARS])
        score = min(1.0, PRIOR[kind] + CONTEXT_BONUS * bool(near))
        if kind in BASE_KINDS or score >= MIN_SCORE:
            out.append((kind, s, e, round(score, 2)))
    return out


def _joined(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch, _, _ in chunks(batches, "text"):
        yield batch, [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def detect(docs: DataFrame) -> DataFrame:
    """One row per document with its spans: kind, start, end, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch, texts in _texts(batches):
            rows = [[{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in find_spans(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return plain(docs, "doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the hash of its base spans, and all spans as a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            counts: list[list[int]] = [[] for _ in BASE_KINDS]
            hashes, spans = [], []
            for t in texts:
                found = find_spans(t)
                base = [x for x in found if x[0] in BASE_KINDS]
                for k, c in zip(BASE_KINDS, counts, strict=True):
                    c.append(sum(x[0] == k for x in base))
                hashes.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return plain(docs, "doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked(text: str) -> str:
    """The text with every span replaced by its kind; overlapping spans are replaced as one."""
    spans = sorted((s, e, k) for k, s, e, _ in find_spans(text))
    out, done, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[done:start], f"[{kind.upper()}]"]
        done, i = end, i + 1
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with personal data masked in ``text``; ``n_chars`` follows. A null stays null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in chunks(batches, "text"):
            texts = [x if x is None else masked(x) for x in batch.column(names.index("text")).to_pylist()]
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if x is None else len(x) for x in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names)

    kinds = {f.name: f for f in docs.schema.fields}
    source = docs.withColumn("n_chars", F.col("n_chars").cast("long")) if "n_chars" in kinds else docs
    return source.mapInArrow(run, source.schema)
