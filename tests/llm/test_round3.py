"""Archives, prefix tries and phrases against brute force, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
import zstandard
from pyspark.sql import functions as F

from tabsmith.llm import minhash, phrases, tries, warc
from tabsmith.llm.text import words
from tabsmith.session import scratch_path

# --- archives -----------------------------------------------------------------------------------


def pages(spark, rows, kind="long"):
    """pages with columns whose names the operator uses itself."""
    full = [(*r, "x", "y", 1) for r in rows]
    return spark.createDataFrame(full, f"page_id {kind}, url string, html string, payload string, leader string, payload_key int")


PAGES = [
    (1, "http://a/x y\n", "é" * 600), (2, None, "é" * 600), (3, "http://a/2", "é" * 600), (4, "http://b", "short"), (5, "http://b", "short"),
    (6, "http://c", None), (7, "http://c", ""), (8, "http://d", "z" * 999), (9, "http://d", "z" * 999), (10, "http://d", "z" * 1000),
    (11, "http://d", "z" * 1000), (11, "http://d", "z" * 1000), (12, "http://e", "WARC/1.1\r\n\r\n" * 300), (None, "http://f", "z" * 1000), (13, "u", "q" * 3_000_000),
]


def expected(rows):
    leader = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and i is not None:
            leader[body] = max(i, leader.get(body, i))
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        to = leader.get(body)
        revisit = to is not None and to != i
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


def test_archive_round_trip(spark):
    got = warc.archived(pages(spark, PAGES), scratch_path(spark, "archive"))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(PAGES)


def test_archive_of_text_identifiers(spark):
    rows = [(f"ä <{i}>", "u", "k" * 2000) for i in range(3)]
    got = {r["page_id"]: r["refers_to"] for r in warc.archived(pages(spark, rows, "string"), scratch_path(spark, "archive")).collect()}
    assert got == {"ä <0>": "ä <2>", "ä <1>": "ä <2>", "ä <2>": None}


def test_archive_of_nothing(spark):
    path = scratch_path(spark, "archive")
    assert warc.archived(pages(spark, []), path).count() == 0
    assert warc.read_index(spark, path).count() == 0


def test_bundles_are_seekable(spark):
    """Frames are independent, any tool reads the file, the index finds single records."""
    rows = [(i, f"http://h/{i}", f"{i} " * (50 + i)) for i in range(400)]
    path = scratch_path(spark, "archive")
    warc.write_archive(warc.page_records(pages(spark, rows).repartition(2)), path, frame_bytes=4096, bundle_bytes=8192)
    fs, root = pafs.FileSystem.from_uri(path)
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/bundles"))]
    assert len(files) > 2 and fs.get_file_info(f"{root}/{'_temporary'}").type in (pafs.FileType.NotFound, pafs.FileType.Directory)
    whole = 0
    for file in files:
        frames = warc.Frames(fs, file)
        parts = [frames[i] for i in range(len(frames))]
        with fs.open_input_file(file) as f:
            data = f.read()
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert plain == b"".join(parts) and all(p.startswith(b"WARC/1.1\r\n") for p in parts)
        whole += plain.count(b"WARC/1.1\r\n")
        frames.close()
    assert whole == 400
    index = warc.read_index(spark, path)
    assert index.count() == 400 and index.agg(F.max("frame")).first()[0] > 0
    got = warc.fetch(spark, path, spark.createDataFrame([("7",), ("300",), ("7",), ("nowhere",)], "record_id string")).collect()
    assert {r["record_id"]: r["payload"].decode() for r in got} == {"7": rows[7][2], "300": rows[300][2]} and len(got) == 2
    # a second write appends
    warc.write_archive(warc.page_records(pages(spark, [(999, "u", "new")])), path)
    assert warc.read_archive(spark, path).count() == 401


def test_damaged_frames_are_found(spark, tmp_path):
    path = f"file://{tmp_path}"
    warc.write_archive(warc.page_records(pages(spark, [(1, "u", "some text " * 100)])), path)
    fs, root = pafs.FileSystem.from_uri(path)
    file = fs.get_file_info(pafs.FileSelector(f"{root}/bundles"))[0].path
    frames = warc.Frames(fs, file)
    packed, size, check = frames.entries[0]
    frames.entries[0] = (packed, size, check ^ 1)
    with pytest.raises(ValueError, match="checksum"):
        frames[0]
    record = warc.record_bytes("1", "response", None, "0" * 40, 3, None, b"abc")
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(record, 0)


# --- tries --------------------------------------------------------------------------------------


def conversations(spark, rows):
    full = [(*r, "x", 1) for r in rows]
    return spark.createDataFrame(full, "conv_id long, turn int, role string, text string, pos string, k int")


def turn_key(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0, turn_key(role, text)), turn_key(role, text), len((text or "").encode())))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    nodes = {}
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in who if len(rebuilt[c]) == len(node))))
        leaf = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        nodes[node] = (
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), sum(len(n) == len(node) + 1 for n in below), len(leaf),
            sum((len(members[n]) - 1) * (n[-1][1] if n else 0) for n in below), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(nodes.values(), key=repr)


def trie(df):
    return sorted(map(tuple, tries.prefix_trie(*tries.rebuilt_turns(tries.placed_turns(df))).collect()), key=repr)


def test_trie_against_brute_force(spark):
    r = random.Random(5)
    rows = []
    for c in [*range(-7, 40), 1_000_003, 9_999_999]:
        for t in range(r.randrange(1, 14)):
            text = r.choice(["hi", "é", "what " * 3, None, ""]) if c % 3 else f"s{t}"
            rows.append((c, r.choice([t, t, None, 2]), r.choice(["user", "bot", None]) if c % 3 else "user", text))
    rows += rows[:9] + [(None, 1, "user", "lost")]
    assert trie(conversations(spark, rows)) == brute_trie(rows)


def test_trie_of_copies_and_long_conversations(spark, monkeypatch):
    """A conversation over several stretches, one cut by ranges, and many exact copies."""
    monkeypatch.setattr(tries, "STRETCH_BITS", 2)
    rows = [(c, t, "u", f"t{t}") for c in range(100, 130) for t in range(3)]
    rows += [(c, t, "u", f"long{t % 7}") for c in (205, 206, 211) for t in range(70)]
    assert trie(conversations(spark, rows)) == brute_trie(rows)
    placed = tries.placed_turns(conversations(spark, [(1, t, "u", str(t)) for t in range(3000)]).repartition(7)).collect()
    assert sorted(p["pos"] for p in placed) == list(range(3000))
    assert {p["pos"]: p["turn_id"].hex() for p in placed} == {t: turn_key("u", str(t)) for t in range(3000)}


def test_trie_without_turns(spark):
    assert trie(conversations(spark, [])) == []
    assert trie(conversations(spark, [(None, 1, "u", "x")])) == []
    # the only turn is replaced by the first turns of an absent conversation
    lonely = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    rows = [(lonely, 0, "u", "x")]
    assert trie(conversations(spark, rows)) == brute_trie(rows) == [(lonely, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())]


# --- phrases ------------------------------------------------------------------------------------


def documents(spark, rows):
    full = [(i, t, lang, "x", 1, 2) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, phrase string, a int, n int")


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute_phrases(rows, least=10, inside=50, top=2000):
    grams = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for p in pieces(text):
            for size in (1, 2, 3):
                for i in range(len(p) - size + 1):
                    grams[lang or "und"][tuple(p[i : i + size])] += 1
    out = []
    for lang, f in grams.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        found = []
        for g, a in f.items():
            if len(g) < 2 or a < least:
                continue
            if len(g) == 2 and any(len(h) == 3 and g in (h[:2], h[1:]) and b >= least and 100 * b >= inside * a for h, b in f.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), l, r))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    vocabulary = [*(f"w{i}" for i in range(40)), "ÉTÉ", "Haus", "haus", "a" * 1500, " ", "\x00"]
    rows = []
    for i in range(120):
        text = "".join(r.choice(vocabulary[: 4 + i % 40]) + r.choice([" ", " ", "\t", "  ", ". ", ",", "\n", " ! "]) for _ in range(r.randrange(5, 90)))
        rows.append((r.choice(["en", "en", "de", None]), text))
    return rows + [("en", None), ("en", ""), ("fr", " .,; "), ("xx", "one two three"), rows[0], rows[0]]


def test_phrases_against_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_WORDS", 300)
    want = brute_phrases(corpus)
    assert len(want) > 10 and len(brute_phrases(corpus, 3, 80)) > 100
    assert sorted(map(tuple, phrases.collocations(documents(spark, corpus)).collect())) == want
    assert sorted(map(tuple, phrases.collocations(documents(spark, corpus), 3, 80, 7).collect())) == brute_phrases(corpus, 3, 80, 7)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(documents(spark, [])).count() == 0
    assert phrases.collocations(documents(spark, [("en", None), (None, "a b")])).count() == 0


def test_phrase_scores_beyond_64_bits(spark):
    """Scores of counts whose products need up to 38 digits are exact."""
    big = 10**12 + 7
    known = spark.createDataFrame([("en", "a", 1, big + 3), ("en", "b", 2, big + 11)], "lang string, word string, a long, f long")
    pairs = spark.createDataFrame([(1, 2, big)], "a long, b long, f long")
    triples = spark.createDataFrame([], "a long, b long, c long, f long")
    row = phrases.scored_phrases(known, pairs, triples).first()
    assert row["score"] == 1_000_000 * big * big // ((big + 3) * (big + 11)) and (row["phrase"], row["l"]) == ("a b", big + 3)


def test_keys_shared_by_two_words_are_counted_again(spark, corpus, monkeypatch):
    """With the first hashes all words of a length are one; the check notices and other hashes are taken."""
    real = phrases.letters
    monkeypatch.setattr(phrases, "letters", lambda seed: np.zeros(256, np.uint64) if seed == 1 else real(seed))
    assert sorted(map(tuple, phrases.collocations(documents(spark, corpus)).collect())) == brute_phrases(corpus)


def test_index_extends_both_ways():
    """Intervals of both directions agree with counting, in any order of extensions."""
    r = random.Random(1)
    text = [0]
    for _ in range(60):
        text += [r.randrange(1, 6) for _ in range(r.randrange(1, 9))] + [0]
    index = phrases.Index(np.array(text, np.int32), 6)
    count = lambda p: sum(tuple(text[i : i + len(p)]) == p for i in range(len(text)))
    one = index.single()
    for first in (True, False):
        two = index.extend(one, first)
        for second in (True, False):
            for found in (two, index.extend(two, second)):
                got = {p: n for *p, n in zip(*(c.tolist() for c in found.columns), found.count.tolist()) for p in [tuple(p)]}
                size = len(found.columns)
                want = {p for i in range(len(text)) if 0 not in (p := tuple(text[i : i + size])) and len(p) == size}
                assert got == {p: count(p) for p in want}


def test_long_texts_are_cut_behind_stops(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 50)
    text = ("aa bb cc. " * 30 + "dd " * 100 + "\nee ff").encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    cuts = list(phrases._chunks(data, offsets))
    assert b"".join(text[a:b] for _, _, a, b in cuts) == text
    assert len(cuts) > 3 and all(text[b - 1 : b] in (b".", b"\n") for _, _, _, b in cuts[:-1])


# --- word hashes --------------------------------------------------------------------------------


def test_long_words_that_swap_bytes_differ(spark):
    one, other = "a" + "x" * 1023 + "b" + "y" * 10, "b" + "x" * 1023 + "a" + "y" * 10
    data = np.frombuffer(f"{one} {other} {one}".encode(), np.uint8)
    h = words(data, np.array([0, len(data)]))[0]
    assert h[0] != h[1] and h[0] == h[2]
    df = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1}
