"""Column functions for text: tokens, concepts, facets, mentions, locators and times."""

from __future__ import annotations

import hashlib
import operator
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NOT_ALNUM = r"[^\p{L}\p{N}]+"

# Word lists, facets, roles, tiers and confidences that results depend on.

STOPWORDS = (
    "the a an and or of to in on for with from into over after before between through does do is are was were be been how "
    "what when where which why who find show get all any use using need"
).split()

#: Facet, single tokens, token phrases, preferred roles in order.
FACETS: list[tuple[str, list[str], list[str], list[str]]] = [
    ("rationale", ["why", "rationale"], ["what is the reason", "reasoning behind"], ["curated_memory", "design_rationale"]),
    ("evolution", "when introduced renamed history originally previously legacy retired deprecated".split(), [], ["change_origin", "curated_memory"]),
    ("validation", "test tests tested pass passed passes invoked validated validation".split(), [], ["prior_work", "current_truth"]),
    ("prior_work", "prior previous attempt attempts fix fixes fixed investigated investigation".split(), [], ["prior_work", "curated_memory"]),
    ("conflict", "conflict conflicts contradict contradicts contradicted versus".split(), ["which fix", "instead of"], ["curated_memory", "prior_work"]),
    ("invariant", "invariant invariants across consistent consistently".split(), ["same rule"], ["curated_memory", "current_truth"]),
    ("current_behavior", "current currently how now".split(), [], ["current_truth", "curated_memory"]),
    ("review_state", "unverified uncertain pending imported unconfirmed".split(), ["needs review", "not confirmed", "not yet confirmed"], ["curated_memory"]),
]
ROLES = {
    "code": "current_truth", "markdown": "design_rationale", "text": "design_rationale", "git_commit": "change_origin",
    "agent_session": "prior_work", "hindsight_memory": "curated_memory",
}
#: Supporting roles are visited in this order.
ROLE_ORDER = ["current_truth", "design_rationale", "change_origin", "prior_work", "curated_memory"]
CONFIDENCE = {"authoritative": 1.20, "strong": 1.12, "supported": 1.05, "inferred": 0.92}


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def choice(key: Column, table: dict, default=None) -> Column:
    """A lookup in a small constant table."""
    out = None
    for k, v in table.items():
        out = (F if out is None else out).when(key == k, v)
    return out.otherwise(F.lit(default)) if default is not None else out


def estimate_tokens(text: Column) -> Column:
    """One token for four characters, at least one."""
    return F.greatest(F.ceil(F.char_length(text) / F.lit(4)).cast("long"), F.lit(1).cast("long"))


def split_terms(low: Column) -> Column:
    """The terms of a lower-cased text, with an empty string where it begins or ends with another sign."""
    return F.split(low, _NOT_ALNUM, -1)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), _NOT_ALNUM, -1), lambda t: t != "")


def _folds() -> tuple[str, str]:
    """Lower-case letters that are a basic letter with one diacritic, and those letters."""
    pairs = []
    for code in range(0xC0, 0x2000):
        whole = unicodedata.normalize("NFD", chr(code))
        if len(whole) == 2 and whole[0].isalpha() and unicodedata.combining(whole[1]) and chr(code) == chr(code).lower():
            pairs.append((chr(code), whole[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _folds()


def split_index_terms(text: Column) -> Column:
    """The index terms of a text, with an empty string where it begins or ends with another sign."""
    low = F.lower(text)
    # Few texts need the letter-by-letter pass.
    bare = F.regexp_replace(F.translate(low, _ACCENTED, _PLAIN), "[\u0300-\u036f]", "")
    return split_terms(F.when(low.rlike("[\u00c0-\u1fff]"), bare).otherwise(low))


def index_terms(text: Column) -> Column:
    """Terms as the full-text index has them: without diacritics."""
    return F.filter(split_index_terms(text), lambda t: t != "")


def first_term(text: Column) -> Column:
    """The first term of a text, or null."""
    return F.nullif(F.regexp_extract(F.lower(text), r"[\p{L}\p{N}]+", 0), F.lit(""))


def content_hash(*parts: Column) -> Column:
    """A hash of the parts, each closed by a NUL."""
    return F.sha2(F.concat(*(F.concat(p, F.lit("\0")) for p in parts)), 256)


def facets(text: Column) -> Column:
    """The facets of a question, in fixed order; current_behavior if no other shows."""
    tokens = terms(text)
    line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    hits = []
    for name, single, phrases, _ in FACETS:
        test = F.arrays_overlap(tokens, strings(single))
        for p in phrases:
            test = test | F.contains(line, F.lit(f" {p} "))
        hits.append(F.when(test, F.lit(name)))
    found = F.array_compact(F.array(*hits))
    return F.when(F.size(found) == 0, strings(["current_behavior"])).otherwise(found)


def visibility(found: Column) -> Column:
    """The lifecycle tiers that a question with these facets may see."""
    has = lambda x: F.array_contains(found, x)
    return (
        F.when(has("review_state") | has("evolution") & has("conflict"), strings(["default", "history", "review"]))
        .when(has("evolution"), strings(["default", "history"]))
        .when(has("conflict"), strings(["default", "review"]))
        .otherwise(strings(["default"]))
    )


def tier_of_status(status: Column) -> Column:
    return F.when(status == "active", "default").when(status.isin("superseded", "obsolete", "resolved"), "history").otherwise("review")


def required_roles(found: Column) -> Column:
    """Preferred roles of all facets one after the other, without neighbours that repeat."""
    table = F.create_map(*(x for name, _, _, roles in FACETS for x in (F.lit(name), strings(roles))))
    every = F.flatten(F.transform(found, lambda f: F.element_at(table, f)))
    return F.filter(every, lambda r, i: (i == 0) | (r != F.coalesce(F.get(every, i - 1), F.lit(""))))


def role_of_kind(kind: Column) -> Column:
    return choice(kind, ROLES)


def confidence_multiplier(confidence: Column) -> Column:
    return choice(confidence, CONFIDENCE, 1.0).cast("double")


def concepts(text: Column) -> Column:
    """Distinct concepts of a question: its words as written (lower-cased), their pieces, and whether each is an identifier."""
    raw = F.filter(F.split(text, r"\s+", -1), lambda w: w != "")
    items = F.transform(
        raw,
        lambda w: F.struct(
            F.lower(w).alias("raw"),
            F.filter(F.split(F.lower(w), _NOT_ALNUM, -1), lambda t: t != "").alias("pieces"),
            (w.rlike("[_.-]") | w.rlike(r"\p{Ll}\p{Lu}")).alias("identifier"),
        ),
    )
    items = F.filter(items, lambda c: ~c["raw"].isin(STOPWORDS) & (F.size(c["pieces"]) > 0))
    firsts = F.transform(items, lambda c: c["raw"])
    return F.filter(items, lambda c, i: F.array_position(firsts, c["raw"]) == i + 1)


def compound(raw: Column) -> Column:
    """Whether a concept has other signs than letters and digits."""
    return raw.rlike(_NOT_ALNUM)


def matches(concept: Column, text: Column, words: Column) -> Column:
    """Whether a unit's lower-cased text (with its words) holds a concept."""
    whole = F.array_contains(words, concept["raw"])
    parts = F.contains(text, concept["raw"]) | F.forall(concept["pieces"], lambda p: F.array_contains(words, p))
    return F.when(compound(concept["raw"]), parts).otherwise(whole)


def credible(found: Column, text: Column, expanded: Column) -> Column:
    """Whether a unit answers enough of the concepts to be offered unasked."""
    low = F.lower(text)
    words = terms(text)
    hit = F.filter(found, lambda c: matches(c, low, words))
    return expanded | F.exists(hit, lambda c: c["identifier"]) | (F.size(hit) >= F.least(F.lit(2), F.size(found)))


def doc_family(locator: Column) -> Column:
    """The locator of documentation without its first locale-like segment; other locators are their own family."""
    parts = F.split(locator, "/", -1)
    shaped = F.transform(parts, lambda p: p.rlike("^[a-z]{2,3}([-_][A-Za-z0-9]+)?$"))
    at = F.array_position(shaped, F.lit(True))
    return F.when(F.array_contains(parts, "docs") & (at > 0), F.array_join(F.filter(parts, lambda p, i: i + 1 != at), "/")).otherwise(locator)


def term_coverage(question: Column, text: Column) -> Column:
    """How many terms of a question, repeated ones each, a text holds anywhere."""
    low = F.lower(text)
    return F.size(F.filter(terms(question), lambda t: F.contains(low, t))).cast("long")


def mentions(text: Column) -> Column:
    """At most 32 distinct mentions: back-ticked names, link targets, and tokens that look like paths or symbols."""
    ticked = F.filter(F.regexp_extract_all(text, F.lit("`([^`\\s]+)`"), 1), lambda x: x != "")
    links = F.regexp_extract_all(text, F.lit(r"\]\(([^)\s]+)\)"), 1)
    tokens = F.filter(F.split(text, r"\s+", -1), lambda t: t.contains("/") | t.contains("::") | t.contains("_") | t.endswith(".rs") | t.endswith(".md"))
    every = F.transform(F.concat(ticked, links, tokens), lambda t: F.regexp_replace(t, "^[`,.;:()\\[\\]{}\"'<>!?*]+|[`,.;:()\\[\\]{}\"'<>!?*]+$", ""))
    return F.slice(F.array_sort(F.array_distinct(F.filter(every, lambda t: (t != "") & (F.octet_length(t) <= 256)))), 1, 32)


def prose_anchors(locator: Column, text: Column) -> Column:
    """The file a text documents, and its first 16 mentions as files or symbols."""
    anchor = lambda kind, value, rel: F.struct(kind.alias("kind"), value.alias("value"), F.lit(rel).alias("relationship"))
    said = F.transform(F.slice(mentions(text), 1, 16), lambda m: anchor(F.when(m.contains("/") | m.contains("."), "file").otherwise("symbol"), m, "mentions"))
    return F.concat(F.array(anchor(F.lit("file"), locator, "documented_in")), said)


def is_exact_path(path: Column) -> Column:
    return ~path.rlike(r"[*?\[{!\\]")


def render_time(epoch: Column, now: Column) -> Column:
    """How long ago, in words, and the date from one day on."""
    age = F.greatest(now - epoch, F.lit(0).cast("long"))
    date = F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd")
    whole = lambda n: F.floor(age / n).cast("string")
    return (
        F.when(age < 3600, F.concat(whole(60), F.lit("m ago")))
        .when(age < 86400, F.concat(whole(3600), F.lit("h ago")))
        .when(age < 365 * 86400, F.concat(date, F.lit(" ("), whole(86400), F.lit("d ago)")))
        .otherwise(date)
    )


def parse_time(value: Column) -> Column:
    """Epoch seconds of the first 19 characters of an ISO time; null if they are none."""
    head = F.substring(value, 1, 19)
    return F.when(head.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d$"), F.unix_timestamp(F.try_to_timestamp(F.translate(head, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))))


def source_kind(path: Column) -> Column:
    """The kind of a file by its extension; null for files that are no source."""
    ext = F.lower(F.element_at(F.split(F.element_at(F.split(path, "/", -1), -1), r"\.", -1), -1))
    named = F.element_at(F.split(path, "/", -1), -1).contains(".")
    code = ["rs", "py", "pyi", "ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "go", "java", "c", "h", "cc", "cpp", "cxx", "hpp", "hh", "hxx", "cs", "rb", "php", "sh", "bash", "gd", "tscn", "tres"]
    return F.when(named & ext.isin(code), "code").when(named & ext.isin("md", "markdown", "mdown"), "markdown").when(named & (ext == "txt"), "text")


#: Dimension of each keyword of the stand-in embedder.
KEYWORDS = [("retry", 0), ("backoff", 0), ("cache", 1), ("database", 2), ("sqlite", 2), ("history", 3), ("commit", 3), ("auth", 4), ("authentication", 4), ("token", 5), ("session", 6), ("markdown", 7), ("parser", 8), ("route", 9)]


def mock_embedding(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, vector) for each row: ten dimensions of keyword counts, or of hash bytes for a text without any, of unit length; zeros for null.

    Each text is lower-cased, searched and hashed once, not for every dimension.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = batch.column(2)
            raw = np.zeros((batch.num_rows, 10))
            for word, at in KEYWORDS:
                raw[:, at] += np.asarray(pc.fill_null(pc.match_substring(low, word), False))
            for k in np.flatnonzero((raw.sum(axis=1) == 0) & np.asarray(low.is_valid())):
                raw[k] = np.frombuffer(hashlib.sha256(batch.column(1)[k].as_py().encode()).digest(), np.uint8, 10) / 255.0
            # Dimension by dimension, as a sum in order.
            norm = np.sqrt(reduce(operator.add, (raw[:, d] * raw[:, d] for d in range(10))))
            vector = raw / np.where(norm > 0, norm, 1.0)[:, None]
            ends = pa.array(np.arange(0, 10 * batch.num_rows + 1, 10, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(vector.ravel()))], [key, "vector"])

    return docs.select(key, F.col(text).alias("text"), F.lower(text).alias("low")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, vector array<double>")
