"""Operators that look at one document at a time, against brute force."""

import hashlib
import re
import textwrap
from collections import Counter, defaultdict

import pytest
import sentencepiece

from lodestone.llm import decontam, licenses, pii, quality, queries, sentencepieces, urls
from tests.llm.util import DOCS, SF, corpus, frame, table, words


OTHER = "Quite different words stand in this third line, which makes the page long enough to be kept whole."


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_quality(spark):
    want = []
    for i, t in corpus():
        w, t = words(t), t or ""
        at = defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        rep = {k + j for x in at.values() if len(x) > 1 for k in x for j in range(8)}
        lines = [x for x in t.split("\n") if words(x)]
        dup = len(lines) - len(set(lines))
        want.append((i, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)))
    rows = quality.judge(frame(spark, corpus())).collect()
    same([tuple(r)[:7] for r in rows], want)
    assert not any(r.kept and r.base_failed for r in rows)


def test_quality_filter_keeps_clean_text_and_columns(spark):
    clean = "This is a clean line of prose that says something of use, and it ends well.\nHere is another one of the same kind."
    page = clean + "\nHome | About | News | Contact | Login\nAccept cookies\n" + OTHER
    rows = [(1, clean), (2, page), (3, "Home | About | News | Contact | Login\n" * 5 + clean), (4, "too short.")]
    out = {r.doc_id: r for r in quality.filter_documents(frame(spark, rows)).collect()}
    assert set(out) == {1, 2}
    assert out[1].text == clean and out[1].n_chars == len(clean) and out[1]["_words"] == 2
    assert out[2].text == clean + "\n" + OTHER
    assert quality.judge(spark.createDataFrame([], DOCS)).count() == 0


def base_spans(t):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x or "0") <= 255 for x in m[0].split(".") if len(x) < 9) and all(len(x) < 9 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def test_pii(spark):
    want = []
    for i, t in corpus():
        spans = base_spans(t or "")
        c = Counter(k for k, _, _ in spans)
        want.append((i, c["email"], c["ip"], c["card"], c["phone"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()))
    same([tuple(r)[:6] for r in pii.digest(frame(spark, corpus())).collect()], want)


def test_pii_added_kinds_and_masking(spark):
    text = "IBAN GB82 WEST 1234 5698 7654 32 ok; ssn 123-45-6789; and then, far away from any telling word, there is 123-45-6780 alone. Write to a@b.co."
    kinds = [k for k, _, _, _ in pii.find_spans(text)]
    assert kinds.count("iban") == 1 and kinds.count("ssn") == 1 and kinds.count("email") == 1
    out = pii.redact(frame(spark, [(1, text), (2, None)])).collect()
    got = {r.doc_id: r for r in out}
    assert "[EMAIL]" in got[1].text and "[IBAN]" in got[1].text and got[1].n_chars == len(got[1].text) and got[2].text is None
    assert not pii.mod97("GB82WEST12345698765433") and pii.luhn("4539148803436467")
    assert pii.detect(frame(spark, [(1, text)])).first().spans[0].kind == "email"


def test_pii_spans_of_all_kinds_by_place(spark):
    far = "and nothing that tells what this is stands anywhere near "
    parts = [("", "Mail "), ("email", "a@b.co"), ("", ", ssn "), ("ssn", "123-45-6789"), ("", f"; {far}"), ("", "123-45-6780"), ("", f" {far}IBAN "), ("iban", "GB82 WEST 1234 5698 7654 32"), ("", " "), ("iban", "DE89370400440532013000"),
             ("", f" {far}"), ("iban", "NL91ABNA0417164300"), ("", f" {far}XX00ABCD1234567890123 {far}"), ("card", "4539 1488 0343 6467"), ("", f" {far}"), ("ip", "10.0.0.255"), ("", " or 10.0.0.256, call "), ("phone", "+49 30 123456"), ("", " é "), ("ssn", "987-65-4321"), ("", " social security.")]
    text, want = "", []
    for kind, piece in parts:
        if kind:
            want.append((kind, len(text), len(text) + len(piece)))
        text += piece
    # By kind, then by place.
    order = {k: n for n, k in enumerate(pii.KINDS)}
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(want, key=lambda x: (order[x[0]], x[1])))
    docs = [(1, text), (2, text + "\n" + text), (3, None), (4, "")]
    got = {r.doc_id: r for r in pii.digest(frame(spark, docs)).collect()}
    assert got[1].spans == joined and got[3].spans == got[4].spans == "" and got[2].spans.count(":") == 2 * joined.count(":")
    base = ",".join(x for x in joined.split(",") if x.split(":")[0] in pii.BASE_KINDS)
    assert got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and got[1].n_email == got[1].n_ip == got[1].n_card == got[1].n_phone == 1
    assert pii.digest(spark.createDataFrame([], DOCS)).count() == 0 and pii.redact(spark.createDataFrame([], DOCS)).count() == 0
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0


def brute_hits(docs, items):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for n, (i, t) in enumerate(items):
        w = cut(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add((n, "" if i is None else str(i)))
    sizes = {len(x) for x in windows}
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= x
        ids = sorted(x for _, x in found)
        yield i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [8 << 20, 2000])
def test_decontamination(spark, block):
    items = [(r["item_id"], r["text"]) for r in table("benchmark")]
    items += [(900, "mark"), (901, "A B"), (902, ""), (None, None), (903, "word " * 30), (904, items[0][1]), (None, "emoji nbsp"), (905, "jp " * 3)]
    docs = corpus() + [(500, "pre " + items[1][1].upper() + " post"), (501, " ".join(items[2][1].split()[3:14])), (502, " ".join(items[2][1].split()[:9]))]
    got = decontam.digest(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block).collect()
    same(map(tuple, got), list(brute_hits(docs, items)))


@pytest.mark.parametrize("block", [8 << 20, 4000])
def test_decontamination_of_a_passage_in_many_items(spark, block):
    passage = " ".join(f"shared{k}" for k in range(40))
    items = [(k, f"own{k} words {passage} end{k}") for k in range(120)] + [(7, items_text := f"own7 words {passage} end7"), (500, items_text)]
    docs = [(k, f"doc{k} says {passage} and {passage} more") for k in range(150)] + [(900, "nothing here"), (901, None), (902, " ".join(passage.split()[:9]))]
    got = decontam.digest(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block).collect()
    same(map(tuple, got), list(brute_hits(docs, items)))
    empty = spark.createDataFrame([], DOCS)
    assert decontam.digest(empty, spark.createDataFrame(items, "item_id long, text string"), block).count() == 0
    assert decontam.digest(empty, spark.createDataFrame([], "item_id long, text string"), block).count() == 0


def test_decontamination_filter(spark):
    items = [(r["item_id"], r["text"]) for r in table("benchmark")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.drop_contaminated(frame(spark, [(1, "quite clean"), (2, "x " + items[0][1])]), bench)
    assert [r.doc_id for r in out.collect()] == [1] and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert decontam.drop_contaminated(frame(spark, [(1, "a")]), bench.limit(0)).count() == 1


def test_sentencepiece(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    texts = {i: t or "" for i, t in corpus() if i is not None}
    got = sentencepieces.encode(frame(spark, list(texts.items()))).collect()
    assert all(r.ids == lib.encode(texts[r.doc_id]) for r in got) and len(got) == len(texts)
    back = sentencepieces.decode(sentencepieces.encode(frame(spark, list(texts.items())))).collect()
    assert all(r.text == texts[r.doc_id].replace("▁", " ") for r in back)
    rows = sentencepieces.digest(frame(spark, list(texts.items()))).collect()
    assert all(r.round_trip or "▁" in texts[r.doc_id] for r in rows)


def test_sentencepiece_digest_and_odd_tables(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    rows = [*corpus(), (7001, "x" * 60 + " " + "y" * 61 + " " + "x" * 61), (7002, "Aß" * 40 + " " + "Aß" * 41)]
    got = sentencepieces.digest(frame(spark, rows)).collect()
    want = []
    for i, t in rows:
        ids = lib.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), "▁" not in (t or "")))
    same(map(tuple, got), want)
    assert sentencepieces.digest(spark.createDataFrame([], DOCS)).count() == 0
    clash = spark.createDataFrame([("a b", 1, 2, "r")], "text string, ids int, doc_id int, round_trip string")
    out = sentencepieces.encode(clash, checked=True)
    assert out.columns == ["doc_id", "ids", "round_trip"] and tuple(out.first()) == (2, lib.encode("a b"), True)
    assert sentencepieces.decode(out).first().text == "a b"


def test_unigram_model_of_a_file(spark, tmp_path):
    """A unigram model written by hand, over the DataFrame path, against the library."""
    import random

    from sentencepiece import sentencepiece_model_pb2 as pb

    rng = random.Random(5)
    model = pb.ModelProto()
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback, model.trainer_spec.vocab_size = 1, True, 0
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3), *((f"<0x{b:02X}>", 6) for b in range(256))):
        model.pieces.add(piece=piece, score=0.0, type=kind)
    names = {"▁", *"abcdefghijklmnopqrstuvwxyzABCDE.,\n"}
    for _, t in corpus():
        for w in words(t)[:20]:
            i = rng.randrange(len(w))
            names.add((w[i : i + rng.randint(1, 5)], "▁" + w[: rng.randint(1, 6)])[rng.random() < 0.5].replace("▁▁", "▁"))
    for piece in sorted(p for p in names if "▁" not in p[1:]):
        model.pieces.add(piece=piece, score=-rng.randrange(8, 96) / 8, type=1)  # sums are exact, so that ties are ties
    model.trainer_spec.vocab_size = len(model.pieces)
    path = str(tmp_path / "hand.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {i: t or "" for i, t in corpus() if i is not None}
    got = sentencepieces.encode(frame(spark, list(texts.items())), path, checked=True).collect()
    assert all(r.ids == lib.encode(texts[r.doc_id]) for r in got) and len(got) == len(texts)
    assert all(r.round_trip or "▁" in texts[r.doc_id] for r in got)


def test_unigram_viterbi():
    import random

    rng = random.Random(1)
    pieces = {p: (i, -rng.random() * 10) for i, p in enumerate(["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab"])}
    enc = sentencepieces.Encoder(pieces, [0] * 256, True, [])

    def best(w):
        state = [(0.0, [])]
        for i in range(1, len(w) + 1):
            state.append(max(((state[j][0] + pieces[w[j:i]][1], [*state[j][1], pieces[w[j:i]][0]]) for j in range(i) if w[j:i] in pieces), key=lambda x: x[0]))
        return state[-1][1]

    ws = sorted({"▁" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(200)})
    import numpy as np

    assert [np.frombuffer(x, "<i4").tolist() for x in enc.encode_sorted(ws)] == [best(w) for w in ws]


def test_adjacent_ibans():
    grouped, short = ["GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "BE68 5390 0754 7034"], ["NO9386011117947", "BE68539007547034"]
    for ibans in (grouped, short, [*short, *grouped], ["XX00 AAAA BBBB CCCC", *short]):
        text = "iban " + " ".join(ibans)
        assert [text[b:e] for k, b, e, _ in pii.find_spans(text) if k == "iban"] == [x for x in ibans if x[:2] != "XX"]
        assert not any(x in pii.masked(text) for x in ibans if x[:2] != "XX")


def test_licenses(spark):
    rows = corpus() + [(700 + k, "some words first.\n" + t.replace("\n", " ") + "\nmore words") for k, (_, _, t) in enumerate(licenses.TEMPLATES)] + [(800, licenses.TEMPLATES[0][2])]
    cut = lambda t: set(zip(w := re.sub("[^a-z0-9]+", " ", t.lower()).split(), w[1:], strict=False))
    want = []
    for i, t in rows:
        best, n = None, 0
        score = lambda u: max(((round(2 * len(a & b) / (len(a) + len(b)), 6), name, lic) for name, lic, x in licenses.TEMPLATES if (a := cut(u)) and (b := cut(x)) and 2 * len(a & b) >= 0.8 * (len(a) + len(b)) - 1e-12), default=None)
        for line in (t or "").split("\n"):
            if x := score(line):
                n, best = n + 1, max(best or x, x)
        if x := score(t or ""):
            best = max(best or x, x)
        want.append((i, best and best[2], best and best[1], best and best[0], n))
    same(map(tuple, licenses.scan(frame(spark, rows)).collect()), want)


def test_licenses_wrapped_and_embedded(spark):
    wrap = lambda t: "\n".join("# " + x for x in textwrap.wrap(" ".join(t.split()), 40, break_long_words=False))
    body = "\n".join(f"line {k} of the program does something else" for k in range(60))
    rows = [(k, f"{body}\n{wrap(t)}\n{body}") for k, (_, _, t) in enumerate(licenses.TEMPLATES)]
    rows += [(100 + k, f"{body} {' '.join(t.split())} {body}".replace("\n", " ")) for k, (_, _, t) in enumerate(licenses.TEMPLATES)]
    rows += [(200, f"{body}\n{wrap(licenses.TEMPLATES[0][2][:150])}\n{body}"), (201, f"{body}\n{wrap(dict((n, t) for n, _, t in licenses.TEMPLATES)['mit-full'][:120])}\n{body}")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    for k, (name, license_id, _) in enumerate(licenses.TEMPLATES):
        assert (got[k].license, got[k].template, got[k].dice) == (license_id, name, 1.0)
        assert (got[100 + k].license, got[100 + k].template, got[100 + k].dice, got[100 + k].n_lines) == (license_id, name, 1.0, 0)
    # Less than the threshold of a template is no match of it.
    assert got[200].template == "apache-short" and got[201].license is None


def test_urls(spark):
    odd = ["http://EXAMPLE.com/en/7", "x://a.b.com", "://", "http://com/en/", "http://examplexcom/en/", "http://notexample.net/de/8?x=/en/", None, "nothing", "http://a.example.net:80/de/80#x/", "https://www.theron.example.com/fr/386.html/?utm_source=x#y", "http://u.org?/es/", "http://theron.example.com/fr/386.html?b=1", "http://notlisted.example.com/fr/386.html"]
    rows = [(r["page_id"], r["url"]) for r in table("pages")] + [(9000 + i, u) for i, u in enumerate(odd)] + [(None, odd[0]), (9000, odd[0])]
    def parts(u):
        host = path = own = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0].lower()
            path = re.split("[?#]", rest[len(host) :])[0]
            bare = u.split("#")[0]
            pairs = sorted(x for x in (bare.split("?", 1)[1] if "?" in bare else "").split("&") if x and not re.match("(utm_[^=]*|gclid|fbclid|ref)(=|$)", x))
            own = re.sub(":(80|443)$", "", re.sub("^www[.]", "", host)) + path.rstrip("/") + ("?" + "&".join(pairs) if pairs else "")
        return host, path, own

    # Every third page's URL is listed, with tracking keys and fragments that its canonical form leaves out.
    urls_listed = [u.split("#")[0] + ("&" if "?" in u else "?") + "gclid=7#there" for _, u in rows[: len(table("pages")) : 3]] + ["http://theron.example.com/fr/386.html", None, "no url"]
    listed = {parts(u)[2] for u in urls_listed if parts(u)[0]}
    want = []
    for i, u in rows:
        host, path, own = parts(u)
        fit = [(len(h) + len(p), h + p, v) for v, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fit)[1] if fit else None
        verdict = max(fit)[2] if fit else "block" if host and own in listed else "allow"
        want.append((i, host, path, rule, verdict))
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in rows], "page_id long, url string, html string, key int")
    entries = urls.listing(queries.RULES, spark.createDataFrame([(u,) for u in urls_listed], "url string"))
    same(map(tuple, urls.judge(pages, entries).collect()), want)
    same(map(tuple, urls.judge(pages, entries, 32).collect()), want)  # a filter of one block: all false positives go in the join
    assert urls.judge(pages.limit(0), entries).count() == 0 and urls.judge(pages, entries.limit(0)).filter("verdict = 'block'").count() == 0
    assert sum(x[4] == "block" and x[3] is None for x in want) > 5
    # A host of very many labels: only suffixes as long as some rule's host are built.
    long = "a." * 20_000 + "example.net"
    got = urls.judge(spark.createDataFrame([(1, f"http://{long}/de/8"), (2, f"http://{long}.x/de/8")], "page_id long, url string"), entries).collect()
    assert {r.page_id: (r.rule, r.verdict, len(r.host)) for r in got} == {1: ("example.net/de/8", "block", len(long)), 2: (None, "allow", len(long) + 2)}
    assert SF


def test_rules_of_the_contract(spark):
    want = {("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")}
    assert {(v, h + p) for v, h, p in queries.RULES} == want and len(queries.RULES) == len(want)
    urls_ = ["http://x.com/en/1", "http://www.example.com/en/71", "http://x.net/de/1", "http://example.net/de/7", "http://a.example.net/de/81", "http://x.org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    # Listed pages too: a rule goes before the list.
    got = urls.judge(pages, urls.listing(queries.RULES, pages.select("url"))).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
