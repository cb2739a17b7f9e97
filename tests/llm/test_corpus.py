"""The corpus operators against brute force, and on nulls, empty tables, repeated rows and odd columns."""

import collections
import hashlib
import math
import os
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabsmith.llm import (
    decontaminate, divergence, katz, language, lengths, licences, minhash, pages, pieces, queries, suffix,
)
from tabsmith.llm.graph import components

ODD = ("key", "sig", "band", "part", "batch", "bucket", "word", "words", "text_hash", "kept", "component", "kept_doc", "rank")


def table(spark, texts, lang="en", ids=None):
    """documents with extra columns whose names the operators use themselves."""
    rows = [(i if ids is None else ids[i], t, lang, *([f"x{i}"] * len(ODD))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in ODD))


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{int(r.paretovariate(0.7)) % vocabulary}" for _ in range(n))


def split(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def shingles(text):
    w = split(text)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def edited(text, every, mark):
    return " ".join(f"{mark}{i}" if i % every == every - 1 else w for i, w in enumerate(text.split()))


@pytest.fixture(scope="module")
def texts():
    base = [prose(i, 60 + 20 * i) for i in range(12)]
    near = [edited(base[i], 30 + i, "e") for i in range(6)] + [edited(base[0], 12 + k, f"v{k}") for k in range(6)]
    odd = [None, "", " \n\t ", "one two", "One  TWO", "one two three", base[3], base[3].upper(), "é" * 70 + "ß" * 70, "a" * 350, "#" * 30]
    return base + near + odd + [" ".join(base), "x " + base[1] + " " + base[2], prose(99, 3000)]


def test_components(spark):
    pairs = [(5, 3), (3, 9), (10, 11), (11, 12), (12, 13), (7, 7), (9, 5)] + [(100, i) for i in range(101, 140)]
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {3: 3, 5: 3, 9: 3, 10: 10, 11: 10, 12: 10, 13: 10, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def linked(texts):
    sets = {i: set(shingles(t)) for i, t in enumerate(texts)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("few", [8, 1])
def test_near_duplicates(spark, texts, few, monkeypatch):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(table(spark, texts)).collect()}
    assert got == linked(texts)


def test_near_duplicates_of_a_group_without_centre(spark):
    base = prose(1, 80).split()
    r = random.Random(5)
    group = [" ".join(f"k{k}" if r.random() < 0.035 else w for w in base) for k in range(40)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(table(spark, group)).collect()}
    assert got == linked(group)


def test_least_agreement():
    bounds = minhash.least_agreement(0.75, 1e-6, range(32, 129, 32))
    for n, least in bounds.items():
        tail = lambda m: sum(math.comb(n + 1, k) * 0.75**k * 0.25 ** (n + 1 - k) for k in range(m + 1))  # noqa: B023, E731
        assert tail(least) >= 1e-6 > tail(least - 1)


def removed(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                mark[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        spans = len([x for x in bytes(mark).split(b"\0") if x])
        out[i] = (len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("many", [256, 1])
def test_repeated_strings(spark, texts, many, monkeypatch):
    monkeypatch.setattr(suffix, "MANY", many)
    got = {r[0]: tuple(r)[1:] for r in suffix.removal_report(table(spark, texts)).collect()}
    assert got == removed(texts)


def test_long_texts_are_chunked(monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 500)
    data = np.frombuffer((prose(3, 900) + "é" * 300).encode(), np.uint8)
    covered = collections.Counter()
    for _, _, row, start, count in suffix._segments(data, np.array([0, len(data)])):
        assert not row.any()
        for s, n in zip(start, count, strict=True):
            covered.update(range(s, s + n))
    assert covered == collections.Counter(range(len(data) - 99))


def test_bucket_pointer_refinement():
    r = random.Random(2)
    text = "".join(r.choice("ab") for _ in range(300)) * 3
    body = np.frombuffer(text.encode(), np.uint8)
    at = np.arange(len(body) - 99)
    ids = suffix.refine(body, at)
    groups = collections.defaultdict(set)
    for i, b in zip(at, ids, strict=True):
        groups[text[i : i + 100]].add(b)
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_without_repeats_keeps_columns(spark):
    passage = prose(8, 60)
    docs = table(spark, [passage, "before " + passage + " after", passage, None, "short"]).withColumn("n_chars", F.lit(1).cast("long"))
    got = {r["doc_id"]: r for r in suffix.without_repeats(docs).collect()}
    assert docs.columns == suffix.without_repeats(docs).columns
    assert sorted(got) == [0, 1, 3, 4] and got[1]["text"] == "before  after" and got[1]["n_chars"] == 13
    assert got[3]["text"] is None and got[4]["n_chars"] == 1


def base_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = [False] * len(w)
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            cover[i : i + 8] = [True] * 8
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(cover)


def test_divergence(spark, texts):
    texts = [*texts, "a b\nc d\na b\n\n c", prose(5, 40) + " " + prose(5, 40), "| ".join(prose(7, 200).split())]
    docs = table(spark, texts).unionAll(table(spark, texts[:3], lang=None))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = divergence.quality(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = base_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in names) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert not [r for r in rows if r["doc_id"] == len(texts) - 1][0]["kept"]


def test_js_distance(spark):
    row = spark.createDataFrame([([0.5, 0.25], [0.1, 0.3])], "p array<double>, q array<double>")
    got = row.select(divergence.js_distance(F.col("p"), F.col("q"))).first()[0]
    p, q = [0.25, 0.5, 0.25], [0.6, 0.1, 0.3]
    kl = lambda a, m: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    assert got == pytest.approx(math.sqrt((kl(p, m) + kl(q, m)) / 2))


def test_katz(spark, texts):
    texts = [t for t in texts for _ in range(2)]
    rows = {r["doc_id"]: r for r in katz.fit_and_score(table(spark, texts).repartition(3, "doc_id").sortWithinPartitions("doc_id"))[1].collect()}
    docs = {i: [*split(t), None] for i, t in enumerate(texts)}
    train = {i for i in docs if zlib.crc32(str(i).encode()) % 7 != 2}
    uni, bi, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    for i in train:
        for v, w in zip(["<s>", *docs[i]], docs[i], strict=False):
            uni[w] += 1
            bi[v, w] += 1
            ctx[v] += 1
    n, types = sum(uni.values()), len(uni)
    du, db = (katz.discounts([sum(v == k for v in c.values()) for k in range(1, 7)]) for c in (uni, bi))
    kept = lambda d, c: (d[c] if c <= 5 else 1) * c
    unknown = 1 - sum(kept(du, c) for c in uni.values()) / (n + 1)
    share = lambda w: kept(du, uni[w]) / (n + 1) if w in uni else unknown
    used, below = collections.defaultdict(float), collections.defaultdict(float)
    for (v, w), c in bi.items():
        used[v] += kept(db, c)
        below[v] += share(w)
    alpha = {v: (1 - used[v] / (ctx[v] + 1)) / (1 - below[v]) for v in ctx}

    def p(v, w):
        return kept(db, bi[v, w]) / (ctx[v] + 1) if (v, w) in bi else alpha.get(v, 1.0) * share(w)

    for v in list(ctx)[:20]:
        assert sum(p(v, w) for w in uni) + alpha[v] * unknown == pytest.approx(1)
    assert set(rows) == set(docs)
    for i, ws in docs.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (i not in train, len(ws), n)
        assert r["n_known"] == sum(w in uni for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((uni[w] + 1) / (n + types + 1)) for w in ws))
        assert r["score"] == pytest.approx(sum(math.log10(p(v, w)) for v, w in zip(["<s>", *ws], ws, strict=False)))


def test_pack():
    for a in (np.array([], np.int64), np.arange(300), np.array([2**63, 1], np.uint64), np.array([0.5, -1.5])):
        assert katz.unpack(katz.pack(a))[0].tolist() == a.tolist()


def vocabulary():
    names = ["<unk>", "▁", "a", "b", "ab", "▁a", "▁ab", "▁▁", "aba", "bab", "c"] + [f"<0x{b:02X}>" for b in range(256)]
    normal = [False] + [True] * 10 + [False] * 256
    scores = [0, -5, -3, -3.5, -4, -4.5, -5.5, -6, -5, -5.2, -8] + [0] * 256
    return pieces.Vocabulary(tuple(names), tuple(map(float, scores)), tuple(range(11, 267)), 0, tuple(normal))


def test_viterbi_is_best():
    v = vocabulary()
    e = pieces.Encoder(v)
    known = {p: s for p, s, n in zip(v.pieces, v.scores, v.normal, strict=True) if n}
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("abc▁é\n") for _ in range(r.randint(1, 12)))
        best = [0.0] + [-math.inf] * len(text)
        for j in range(1, len(text) + 1):
            best[j] = best[j - 1] + e.low * len(text[j - 1].encode())
            for i in range(max(0, j - 3), j):
                best[j] = max(best[j], best[i] + known.get(text[i:j], -math.inf))
        ids = e.viterbi(text)
        assert sum(v.scores[i] if v.normal[i] else e.low for i in ids) == pytest.approx(best[-1])
        plain = text.replace("▁", " ")
        assert e.decode(e.encode(plain)) == plain
        whole = e.viterbi("▁" + plain.replace(" ", "▁"))
        assert sum(v.scores[i] if v.normal[i] else e.low for i in e.encode(plain)) == pytest.approx(
            sum(v.scores[i] if v.normal[i] else e.low for i in whole))


def test_pieces_round_trip(spark, texts):
    texts = [*texts, "  two  blanks ", "日本語 😀\n\n x", "\0 nul"]
    docs = table(spark, texts)
    encoded = pieces.encode(docs, vocabulary())
    assert {r["doc_id"]: r["round_trip"] for r in encoded.collect()} == {i: None if t is None else True for i, t in enumerate(texts)}
    assert dict(pieces.decode(encoded, vocabulary()).collect()) == dict(enumerate(texts))


def test_licences(spark):
    own = [
        (0, "MIT License\n\nCopyright (c) 2020 A. Author\n\n" + licences._MIT.replace("\n", " ").upper()),
        (1, "Some prose.\nReleased under the MIT licence!\nMore."), (2, None), (3, ""), (4, "copyright 2001 nobody"),
        (5, licences._ISC + " and more"), (6, "spdx-license-identifier: mit"), (1, "Some prose.\nReleased under the MIT licence!\nMore."),
    ]
    got = licences.scan(spark.createDataFrame(own, "doc_id long, text string"), licences.known_licences(spark))
    rows = sorted((r["doc_id"], r["licence"], r["notices"], r["n_notice_lines"]) for r in got.fillna("-", ["licence"]).collect())
    assert rows == [(0, "MIT", ["MIT"], 1), (1, "-", ["MIT"], 1), (1, "-", ["MIT"], 1), (2, "-", [], 0), (3, "-", [], 0),
                    (4, "-", [], 0), (5, "-", [], 0), (6, "MIT", ["MIT"], 1)]


def test_whole_licences_in_any_wrapping(spark):
    names = ("Apache-2.0", "BSD-3-Clause", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "Unlicense", "CC0-1.0")
    bodies = {n: (licences.TEXTS / f"{n}.txt").read_text() for n in names} | {"MIT": licences._MIT, "ISC": licences._ISC}
    bodies["BSD-2-Clause"] = "".join(bodies["BSD-3-Clause"].partition("3. Neither")[::2]).replace(
        bodies["BSD-3-Clause"].partition("3. Neither")[2].partition("THIS SOFTWARE")[0], "")
    notice = "Copyright (c) 2020-2024 A. Author <a@b.org>. All rights reserved."
    rows = []
    for name, body in bodies.items():
        given = [body, *(textwrap.fill(" ".join(body.split()), w, break_long_words=False, break_on_hyphens=False) for w in (50, 72, 91)), " ".join(body.split())]
        if name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"):
            given += [f"{notice}\n\n{body}", f"{notice} {' '.join(body.split())}", "Copyright Jane Doe\n\n" + body, "Copyright (c) 2001 A\nCopyright (c) 2002 B\n\n" + body]
            title = licences.TITLES[name][2]
            given += [f"{title}\n\n{notice}\n\n{body}", f"{title} {notice} {' '.join(body.split())}"]
        rows += [(name, t) for t in given]
    rows += [("-", licences._MIT.replace("free of charge", "for a fee")), ("-", notice), ("-", "copyright holders be liable")]
    wrapped = licences._MIT.replace("AUTHORS OR COPYRIGHT", "AUTHORS OR\nCOPYRIGHT")
    assert re.search("(?m)^COPYRIGHT HOLDERS BE LIABLE", wrapped)
    rows.append(("MIT", wrapped))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(docs, licences.known_licences(spark)).collect()}
    bad = [(n, t[:60], len(t.split("\n"))) for i, (n, t) in enumerate(rows) if (got[i]["licence"] or "-") != n]
    assert not bad
    assert got[len(rows) - 3]["digest"] is None and got[len(rows) - 2]["digest"] is not None


def test_length_histogram(spark):
    n = [0, 0, 3, 7, 7, 7, 1023, 1024, 5000, 5000, 100_000]
    hist = lengths.length_histogram(spark.createDataFrame([(x,) for x in [*n, None]], "n_tokens long"))
    for r in hist.collect():
        x = r["n_tokens"]
        longer = [v for v in n if v > x]
        assert (r["n_docs"], r["docs_longer"], r["tokens_longer"]) == (n.count(x), len(longer), sum(longer))
        assert r["truncated_total"] == sum(min(v, x) for v in n) and r["tokens_total"] == sum(n) and r["docs_total"] == len(n)
    limits = spark.createDataFrame([(x,) for x in (0, 1, 6, 7, 1023, 2048, 4999, 10**6, None)], "context int")
    for context, total in lengths.truncated_totals(hist, limits).collect():
        assert total == sum(min(v, context) for v in n)


def speech(seed, alphabet, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 7))) for _ in range(n))


def test_language(spark):
    tongues = {"aa": "aaeioklmn", "bb": "bdfgrstuuv", "cc": "éèàxyzwq"}
    rows = [(i, speech(i, a), k) for j, (k, a) in enumerate(tongues.items()) for i in range(60 * j, 60 * j + 60)]
    rows += [(900, None, "aa"), (901, "", None), (902, "12 ## 34", "bb"), (903, "Б" * 300, None), (904, rows[0][1].upper(), None), (904, rows[0][1].upper(), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = collections.defaultdict(list)
    for r in language.language_report(docs).collect():
        got[r["doc_id"]].append(r)
    for i, _, k in rows[:180]:
        assert got[i][0]["lang_pred"] == k and not got[i][0]["rejected"] and 0 <= got[i][0]["score"] <= 1
        assert got[i][0]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    for i in (900, 901, 902):
        assert got[i][0]["lang_pred"] == "und" and got[i][0]["score"] == 0 and got[i][0]["rejected"]
    assert got[903][0]["lang_pred"] in tongues and got[903][0]["rejected"]
    assert [r["lang_pred"] for r in got[904]] == ["aa", "aa"]
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [*range(180), 904, 904]


def test_kneser_ney_sums_to_one():
    import pandas as pd

    grams = collections.Counter()
    for w in "banana bandana cabana ananas".split():
        line = "  " + w + " "
        grams.update(line[i : i + 3] for i in range(len(line) - 2))
    m = language.kneser_ney(pd.DataFrame([("x", g, n) for g, n in grams.items()], columns=["lang", "gram", "n"]), 3)
    chars = sorted({c for g in grams for c in g})
    for context in ("an", "zz", "  ", "na"):
        total = 0.0
        for c in chars:
            line = np.frombuffer((context + c).encode("utf-32-le"), np.uint32)
            total += math.exp(m.word_scores(line, np.array([2]), np.array([0]), 1)[0, 0])
        assert total + m.floor == pytest.approx(1, abs=0.2) and total <= 1 + 1e-9


PAGE = "<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=x>{nav}</a></nav>{body}<footer>{foot}</footer></body></html>"


def test_page_text(spark):
    article = "<div class='ad'>buy</div><article><h1>Head &amp; line</h1><p>One <b>two</b>\n three<br>four<p>Five &lt;x&gt;<div class='comments'>me too</div></article>"
    plain = "<p>shared notice<p>own {i}<p>also shared"
    rows = [(1, "http://a.org/x/1?q", PAGE.format(nav="n1", body=article, foot="f"))]
    rows += [(10 + i, f"https://b.org/p/{i}.html", PAGE.format(nav="n", body=plain.format(i=i), foot="f")) for i in range(4)]
    rows += [(20, None, None), (21, "http://c.org/", ""), (22, "not a url", "<p>text &eacute;&#33; <script>x</script>end"), (1, "http://a.org/x/1?q", rows[0][2])]
    got = collections.defaultdict(list)
    for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got[r["page_id"]].append(r["text"])
    assert got[1] == ["Head & line One two three four Five <x>"] * 2
    assert [got[10 + i] for i in range(4)] == [[f"own {i}"] for i in range(4)]
    assert got[20] == [""] and got[21] == [""] and got[22] == ["text é! end"]


def test_alignment_decides_inside_and_outside_the_article(spark):
    body = "<p>intro {i}<article><p>every page says this<p>long text of the page number {i}</article><p>site line"
    rows = [(i, f"http://a.org/{i}", PAGE.format(nav=f"n{i}", body=body.format(i=i), foot=f"f{i}")) for i in range(3)]
    rows += [(10 + i, f"http://copy.org/{i}", PAGE.format(nav="n", body="<article><p>same<p>text</article><p>site line", foot="f")) for i in range(2)]
    rows += [(20 + i, f"http://near.org/{i}", PAGE.format(nav="n", body=f"<article><p>most of the article<p>v{i}</article><p>site line", foot="f")) for i in range(2)]
    rows += [(30 + i, f"http://plain.org/{i}", PAGE.format(nav="n", body="<p>same<p>text", foot="f")) for i in range(2)]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(3)] == [f"intro {i} long text of the page number {i}" for i in range(3)]
    assert got[10] == got[11] == "same text" and [got[20], got[21]] == ["most of the article v0", "most of the article v1"]
    assert got[30] == got[31] == "same text"


def test_wrappers_of_an_article():
    kept = lambda html: pages.kept_lines(pages.blocks(html), [])
    article = "<article><p>own text<form><p>your name</form><div class='comments'><article>me too</article></div></article>"
    wraps = ["<div class='no-sidebar'>{}</div>", "<div class='page has-sidebar'>{}</div>", "<div id=with_banner>{}</div>", "<form action=x>{}</form>",
             "<div class='sidebar'>{}</div>", "<form><div class='social widget'><span class=ad>buy</span>{}</div></form>"]
    for wrap in wraps:
        assert kept("<nav>n</nav>" + wrap.format(article) + "<footer>f</footer>") == ["own text"], wrap
    assert kept("<div class='no-sidebar'><p>plain</div><div class='site-footer'>f</div><form>search</form>") == ["plain"]
    assert kept("<main><p>own</main><div class='related'><article>other</article></div>") == ["own"]
    assert kept("<aside><article>other</article></aside><div hidden><article>gone</article></div><p>own") == ["own"]


def test_common_lines():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = pages.common_lines(a, b)
        assert len(got) == best[-1][-1] and got == sorted(got)
        rest = iter(b)
        assert all(a[i] in rest for i in got)


def test_contaminated(spark, texts):
    items = [prose(200 + i, n) for i, n in enumerate((16, 30, 59, 5, 3))] + [None, "", " "]
    docs = [*texts, "x " + items[0] + " y", edited(items[2], 25, "q"), items[1].upper() + " " + prose(1, 50), items[3], items[4], "lead " + items[4] + " end",
            " ".join(items[2].split()[:50]), " ".join(items[2].split()[:30])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(table(spark, docs), bench).collect()}
    want = {}
    for d, t in enumerate(docs):
        for k, item in enumerate(items):
            w, own = split(t), collections.Counter(shingles(item))
            n = min(len(split(item)), len(w))
            for at in range(len(w) - n + 1) if n else ():
                have = collections.Counter(shingles(" ".join(w[at : at + n])))
                s = sum((have & own).values()) / sum((have | own).values())
                if s >= 0.75:
                    want[d, k] = max(s, want.get((d, k), 0))
    assert got == pytest.approx(want) and len(want) >= 6
    clean = decontaminate.without_contaminated(table(spark, docs), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [i for i in range(len(docs)) if i not in {d for d, _ in want}]


def test_repeated_rows_and_missing_ids(spark):
    docs = table(spark, [prose(1, 60), prose(1, 60), prose(2, 60), prose(3, 60)], ids=[1, 1, 2, None])
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()) == [(1, 1, True), (1, 1, True), (2, 2, True)]
    assert sorted(tuple(r)[:3] for r in suffix.removal_report(docs).select("doc_id", "n_removed", "n_spans").collect()) == [(1, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert divergence.quality(docs).count() == 4
    assert katz.fit_and_score(docs)[1].count() == 3
    assert pieces.encode(docs, vocabulary()).count() == 4
    assert licences.scan(docs, licences.known_licences(spark)).count() == 4


def test_empty_tables(spark):
    docs = table(spark, [])
    page = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (
        minhash.near_duplicates(docs), suffix.removal_report(docs), suffix.without_repeats(docs), minhash.keep_first(docs),
        divergence.quality(docs), katz.fit_and_score(docs)[1], pieces.encode(docs, vocabulary()),
        licences.scan(docs, licences.known_licences(spark)), pages.main_text(page), decontaminate.contaminated(docs, bench),
        decontaminate.contaminated(table(spark, ["a b c"]), bench), lengths.length_histogram(spark.createDataFrame([], "n_tokens long")),
        language.language_report(docs), language.keep_identified(docs),
    ):
        assert out.count() == 0
    assert language.fit(docs) is None


def test_nothing_to_learn_a_language_from(spark):
    for docs in (table(spark, ["one text", None, ""], lang=None), table(spark, ["123 456", "...", "7"])):
        got = language.language_report(docs).collect()
        assert {(r["lang_pred"], r["score"], r["rejected"]) for r in got} == {("und", 0.0, True)} and len(got) == 3
        assert language.keep_identified(docs).count() == 3


def test_repeated_rows_of_two_languages(spark):
    """Equal rows of different language are each compared with their own language."""
    english, german = ([prose(s, 80, 30 + d) for s in range(d, d + 6)] for d in (0, 400))
    german = [t.replace("w", "u") for t in german]
    rows = [(i, t, "en") for i, t in enumerate(english)] + [(100 + i, t, "de") for i, t in enumerate(german)]
    one = spark.createDataFrame(rows + [(7, english[0], "en"), (8, english[0], "de")], "doc_id long, text string, lang string")
    both = spark.createDataFrame(rows + [(7, english[0], "en"), (7, english[0], "de")], "doc_id long, text string, lang string")
    want = sorted((r["class_distance"], r["word_distance"]) for r in divergence.quality(one).where("doc_id IN (7, 8)").collect())
    assert sorted((r["class_distance"], r["word_distance"]) for r in divergence.quality(both).where("doc_id = 7").collect()) == want
    assert want[0][1] != want[1][1]


def test_sentences_that_two_articles_share_stay():
    """Shared lines inside an article go only where they join the shared head or tail of the page."""
    found = [("menu", False, False), ("Site name", True, False), ("Own title", True, False), ("Shared sentence.", True, False),
             ("Own text that is long enough to count as the article", True, False), ("Follow us", True, False), ("legal", False, False)]
    kept = pages.kept_lines(found, [0, 1, 3, 5, 6])
    assert kept == ["Own title", "Shared sentence.", "Own text that is long enough to count as the article"]
    outside = [("menu", False, False), ("own", False, False), ("shared", False, False), ("own too", False, False)]
    assert pages.kept_lines(outside, [0, 2]) == ["own", "own too"]


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF) or not os.path.exists(queries.PIECES), reason="given tables not present")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert [r["doc_id"] for r in docs.orderBy("doc_id").collect()] == list(range(len(texts)))
    rejected = {r["doc_id"] for r in language.language_report(docs).where("rejected").collect()}
    left = [None if i in rejected else t for i, t in enumerate(texts)]
    first = {i for i, (_, c) in linked(left).items() if c == i and i not in rejected}
    left = [t if i in first else None for i, t in enumerate(left)]
    seen, kept = set(), {}
    for i, t in enumerate(left):
        b = (t or "").encode()
        gone = set()
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone.update(range(p, p + 100))
            seen.add(b[p : p + 100])
        kept[i] = bytes(c for k, c in enumerate(b) if k not in gone).decode("utf-8", "ignore")
    stages = corpus_pipeline.STAGES
    assert [n for n, _ in stages] == ["language_id", "near_duplicates", "repeated_strings", "benchmark_leaks", "tokens"]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    own = spark.createDataFrame([(i, kept[i]) for i in sorted(first) if kept[i]], "doc_id long, text string")
    bad = {r["doc_id"] for r in decontaminate.contaminated(own, bench).collect()}
    assert set(got) == {i for i in first if kept[i]} - bad
    encoder = pieces.Encoder(pieces.read_vocabulary(queries.PIECES))
    assert all(r["round_trip"] and encoder.decode(r["pieces"]) == kept[i] for i, r in got.items())
