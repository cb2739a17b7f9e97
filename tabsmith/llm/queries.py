"""The registered corpus queries; each applies its operator to its whole table."""

from __future__ import annotations

import os
import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm import (
    decontaminate, divergence, katz, language, lengths, licences, minhash, pages, phrases, pieces, suffix,
    tries, warc,
)
from tabsmith.session import scratch_path

#: The vocabulary file of the piece queries; a path of the driver.
PIECES = os.environ.get("TABSMITH_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: Merge ranks and split pattern of the token counts.
RANKS = os.environ.get("TABSMITH_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_BLANK = "[\\x20\\x09-\\x0D]+"
_LOW = f"translate(COALESCE(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

_MINHASH_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, '{_BLANK}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, UNNEST(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END)) AS g FROM d),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * c >= {minhash.PERCENT} * (na.n + nb.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, low AS component_id, d.doc_id = low AS kept
FROM d JOIN (SELECT x, MIN(y) AS low FROM reach GROUP BY 1) ON x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

_REPEATS_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h, octet_length(encode(COALESCE(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, UNNEST(list_transform(range(0, n - {suffix.LENGTH - 1}), lambda i: md5(substr(h, (2 * i + 1)::BIGINT, {2 * suffix.LENGTH})))) AS s,
             UNNEST(range(0, n - {suffix.LENGTH - 1})) AS i FROM d WHERE n >= {suffix.LENGTH}),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, ROW_NUMBER() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
runs AS (SELECT doc_id, MIN(i) AS lo, MAX(i) + {suffix.LENGTH} AS hi FROM (
           SELECT doc_id, i, SUM(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
             SELECT doc_id, i, CASE WHEN i - LAG(i) OVER (PARTITION BY doc_id ORDER BY i) <= {suffix.LENGTH} THEN 0 ELSE 1 END AS new FROM again))
         GROUP BY doc_id, run),
gaps AS (SELECT doc_id, lo, hi, COALESCE(LAG(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM runs),
cut AS (SELECT d.doc_id, SUM(hi - lo)::BIGINT AS n_removed, COUNT(*) AS n_spans,
               string_agg(substr(h, (2 * since + 1)::BIGINT, (2 * (lo - since))::BIGINT), '' ORDER BY lo) || substr(ANY_VALUE(h), (2 * MAX(hi) + 1)::BIGINT) AS kept
        FROM gaps JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, d.n AS n_bytes, COALESCE(n_removed, 0) AS n_removed, COALESCE(n_spans, 0) AS n_spans,
       sha256(unhex(COALESCE(kept, h))) AS kept_sha256 FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id"""


@query("op1_minhash", _MINHASH_SQL)
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"))


@query("op4_suffix_array", _REPEATS_SQL)
def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_report(load(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(load(spark, sf_dir, "documents"))


@query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(load(spark, sf_dir, "documents"), pieces.read_vocabulary(PIECES))
    return encoded.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", "round_trip")


def _canonical_sql(text: str) -> str:
    """The SQL of ``licences.canonical``."""
    out = f"regexp_replace(lower({text}), '{licences.COPYRIGHT}', '', 'g')"
    out = f"' ' || trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for a, b in licences.EQUIVALENT:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim({out})"


def _licences_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in licences.KNOWN)
    return f"""
WITH known(licence, text) AS (VALUES {rows}),
names AS (SELECT sha256(body) AS digest, MIN(licence) AS licence
          FROM (SELECT licence, {_canonical_sql("text")} AS body FROM known) WHERE body <> '' GROUP BY 1),
d AS (SELECT doc_id, CASE WHEN body <> '' THEN sha256(body) END AS digest
      FROM (SELECT doc_id, {_canonical_sql("text")} AS body FROM documents)),
lines AS (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS spot FROM documents),
hits AS (SELECT doc_id, spot, licence FROM (SELECT doc_id, spot, {_canonical_sql("line")} AS body FROM lines) JOIN names ON sha256(body) = digest),
n AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT licence)), ',') AS notices, COUNT(DISTINCT spot) AS n_notice_lines FROM hits GROUP BY 1)
SELECT d.doc_id, d.digest, names.licence, COALESCE(notices, '') AS notices, COALESCE(n_notice_lines, 0) AS n_notice_lines
FROM d LEFT JOIN names USING (digest) LEFT JOIN n ON n.doc_id = d.doc_id"""


def _divergence_sql() -> str:
    d = divergence
    blank, k = "[\\x20\\x09-\\x0D]+", d.COMMON_WORDS
    names = [n for n, _ in d.CLASSES]
    rest, columns = "rest", []
    for name, members in d.CLASSES:
        left = "translate({}, '{}', '')".format(rest, members.replace("'", "''"))
        columns.append(f"length({rest}) - length({left}) AS class_{name}")
        rest = left
    classes = ["class_lower", "class_blank", *(f"class_{n}" for n in names), "class_other"]
    half = lambda x, m: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / {m}) ELSE 0 END"
    bin_ = lambda p, q: f"({half(p, f'(({p} + {q}) / 2)')} + {half(q, f'(({p} + {q}) / 2)')}) / 2"
    return f"""
WITH docs AS (SELECT doc_id, COALESCE(lang, '*') AS lang, COALESCE(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{blank}'), lambda x: x <> '') AS words,
             regexp_replace(text, '[a-z\\x20\\x09-\\x0D]+', '', 'g') AS rest FROM docs),
win AS (SELECT doc_id, pos, list_slice(words, pos, pos + 7) AS win
        FROM (SELECT doc_id, words, UNNEST(range(1, len(words) - 6)) AS pos FROM w WHERE len(words) > 8)),
rep AS (SELECT doc_id, COUNT(DISTINCT spot) AS n FROM (
          SELECT doc_id, UNNEST(range(pos, pos + 8)) AS spot
          FROM (SELECT *, COUNT(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1) GROUP BY 1),
b0 AS (SELECT doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) AS n_chars, length(rest) AS n_rest,
              length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
              list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
              {", ".join(columns)}, length({rest}) AS class_other FROM w),
b AS (SELECT b0.*, n_chars - word_chars AS class_blank, word_chars - n_rest AS class_lower,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, COALESCE(rep.n, 0) AS n_repeat_words FROM b0 LEFT JOIN rep USING (doc_id)),
totals AS (SELECT lang, GREATEST(SUM(n_chars), 1) AS chars, GREATEST(SUM(n_words), 1) AS words, {", ".join(f"SUM({c}) AS t_{c}" for c in classes)} FROM b GROUP BY 1),
lw AS (SELECT doc_id, lang, UNNEST(list_filter(regexp_split_to_array(lower(text), '{blank}'), lambda x: x <> '')) AS word FROM docs),
top AS (SELECT * FROM (SELECT lang, word, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY COUNT(*) DESC, word) AS place FROM lw GROUP BY 1, 2) WHERE place <= {k}),
own AS (SELECT doc_id, lang, word, COUNT(*) AS n FROM lw JOIN top USING (lang, word) GROUP BY 1, 2, 3),
pq AS (SELECT b.doc_id, COALESCE(own.n, 0) / GREATEST(b.n_words, 1)::DOUBLE AS p, top.n / totals.words::DOUBLE AS q
       FROM b JOIN totals USING (lang) JOIN top USING (lang) LEFT JOIN own ON own.doc_id = b.doc_id AND own.word = top.word),
wd AS (SELECT doc_id, SUM({bin_("p", "q")}) AS s, GREATEST(1 - SUM(p), 0) AS p, GREATEST(1 - SUM(q), 0) AS q FROM pq GROUP BY 1),
cp AS (SELECT doc_id, GREATEST(n_chars, 1)::DOUBLE AS c, b.*, totals.* FROM b JOIN totals USING (lang)),
dist AS (SELECT cp.*, sqrt(GREATEST({" + ".join(bin_(f"({c} / c)", f"(t_{c} / chars)") for c in classes)}, 0)) AS cd,
                sqrt(GREATEST(wd.s + {bin_("wd.p", "wd.q")}, 0)) AS wdist
         FROM cp JOIN wd ON wd.doc_id = cp.doc_id),
v AS (SELECT *, n_words < {d.MIN_BASE_WORDS} OR 100 * n_repeat_words > {d.MAX_REPEAT_PERCENT} * n_words AS base_failed,
             CASE WHEN n_chars >= {d.MIN_CHARS} THEN cd END AS class_distance, CASE WHEN n_words >= {d.MIN_WORDS} THEN wdist END AS word_distance FROM dist)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ROUND(class_distance, 9) AS class_distance,
       ROUND(word_distance, 9) AS word_distance,
       NOT base_failed AND COALESCE(class_distance, 0) <= {d.MAX_CLASS_DISTANCE} AND COALESCE(word_distance, 0) <= {d.MAX_WORD_DISTANCE} AS kept FROM v"""


@query("op2_divergence", _divergence_sql())
def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = divergence.quality(load(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 9) for c in ("class_distance", "word_distance")})


@query("op6_licences", _licences_sql())
def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.scan(load(spark, sf_dir, "documents"), licences.known_licences(spark))
    return out.withColumn("notices", F.array_join("notices", ","))


@query("op7_token_lengths")
def op7_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = lengths.token_counts(load(spark, sf_dir, "documents"), PATTERN, lengths.read_ranks(RANKS))
    return lengths.length_histogram(counts)


def _shingles_sql(words: str) -> str:
    n = decontaminate.SHINGLE
    return (f"CASE WHEN len({words}) < {n} THEN [array_to_string({words}, ' ')] ELSE list_transform(range(1, len({words}) - {n - 2}), "
            f"lambda i: array_to_string(list_slice({words}, i, i + {n - 1}), ' ')) END")


_LEAKS_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, '{_BLANK}'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_filter(regexp_split_to_array({_LOW}, '{_BLANK}'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
ig AS (SELECT item_id, g, COUNT(*) AS c FROM (SELECT item_id, UNNEST({_shingles_sql("w")}) AS g FROM b WHERE len(w) > 0) GROUP BY 1, 2),
im AS (SELECT item_id, SUM(c) AS m FROM ig GROUP BY 1),
dg AS (SELECT DISTINCT doc_id, UNNEST({_shingles_sql("w")}) AS g FROM d WHERE len(w) > 0),
cand AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
         UNION SELECT doc_id, item_id FROM d, b WHERE len(b.w) < {decontaminate.SHINGLE} AND len(b.w) > 0 AND len(d.w) > 0),
win AS (SELECT doc_id, item_id, d.w, LEAST(len(d.w), len(b.w)) AS size, UNNEST(range(1, len(d.w) - LEAST(len(d.w), len(b.w)) + 2)) AS start
        FROM cand JOIN d USING (doc_id) JOIN b USING (item_id)),
part AS (SELECT doc_id, item_id, size, start, list_slice(w, start, start + size - 1) AS x FROM win),
wg AS (SELECT doc_id, item_id, size, start, g, COUNT(*) AS c FROM (SELECT doc_id, item_id, size, start, UNNEST({_shingles_sql("x")}) AS g FROM part) GROUP BY ALL),
sim AS (SELECT wg.doc_id, wg.item_id, size, start, SUM(LEAST(wg.c, COALESCE(ig.c, 0))) AS low, SUM(wg.c) AS own
        FROM wg LEFT JOIN ig ON ig.item_id = wg.item_id AND ig.g = wg.g GROUP BY 1, 2, 3, 4),
ok AS (SELECT doc_id, item_id, size, start, low::DOUBLE / (own + m - low) AS similarity FROM sim JOIN im USING (item_id)
       WHERE 100 * low >= {decontaminate.PERCENT} * (own + m - low))
SELECT doc_id, item_id, similarity, start - 1 AS start_word, size AS n_words
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS k FROM ok) WHERE k = 1"""


@query("op10_decontaminate", _LEAKS_SQL)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op9_page_text")
def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = pages.main_text(load(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query("op3_katz")
def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.fit_and_score(load(spark, sf_dir, "documents"))[1]


_PIECE_END = "[.,;:!?\\x0A-\\x0D]"
_PHRASES_SQL = f"""
WITH p AS (SELECT COALESCE(lang, 'und') AS lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w
           FROM (SELECT lang, UNNEST(regexp_split_to_array({_LOW}, '{_PIECE_END}')) AS piece FROM documents)),
f1 AS (SELECT lang, g, COUNT(*) AS f FROM (SELECT lang, UNNEST(w) AS g FROM p) GROUP BY 1, 2),
total AS (SELECT lang, SUM(f)::BIGINT AS n FROM f1 GROUP BY 1),
f2 AS (SELECT lang, x, y, COUNT(*) AS f FROM (SELECT lang, w[i] AS x, w[i + 1] AS y FROM (SELECT lang, w, UNNEST(range(1, len(w))) AS i FROM p))
       GROUP BY 1, 2, 3),
f3 AS (SELECT lang, x, y, z, COUNT(*) AS f FROM (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, UNNEST(range(1, len(w) - 1)) AS i FROM p))
       GROUP BY 1, 2, 3, 4 HAVING COUNT(*) >= {phrases.MIN_COUNT}),
longer AS (SELECT lang, x, y, MAX(f) AS f FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY 1, 2, 3),
two AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, p.f AS l, q.f AS r
        FROM f2 JOIN f1 p ON p.lang = f2.lang AND p.g = f2.x JOIN f1 q ON q.lang = f2.lang AND q.g = f2.y LEFT JOIN longer ON longer.lang = f2.lang AND longer.x = f2.x AND longer.y = f2.y
        WHERE f2.f >= {phrases.MIN_COUNT} AND NOT 100 * COALESCE(longer.f, 0) >= {phrases.INSIDE_PERCENT} * f2.f),
cut AS (SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z AS phrase, f3.f AS a, p.f AS l1, v.f AS r1, u.f AS l2, q.f AS r2
        FROM f3 JOIN f1 p ON p.lang = f3.lang AND p.g = f3.x JOIN f1 q ON q.lang = f3.lang AND q.g = f3.z
        JOIN f2 u ON u.lang = f3.lang AND u.x = f3.x AND u.y = f3.y JOIN f2 v ON v.lang = f3.lang AND v.x = f3.y AND v.y = f3.z),
cuts AS (SELECT lang, phrase, a, l, r, {phrases.SCALE}::HUGEINT * a * a // (l::HUGEINT * r) AS score, 1 AS k FROM two
         UNION ALL SELECT lang, phrase, a, l1, r1, {phrases.SCALE}::HUGEINT * a * a // (l1::HUGEINT * r1), 1 FROM cut
         UNION ALL SELECT lang, phrase, a, l2, r2, {phrases.SCALE}::HUGEINT * a * a // (l2::HUGEINT * r2), 2 FROM cut),
low AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS pick FROM cuts) WHERE pick = 1),
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM placed JOIN total USING (lang) WHERE rank <= {phrases.TOP}"""


@query("op13_collocations", _PHRASES_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(load(spark, sf_dir, "documents"))


_TRIE_SQL = """
WITH t AS (SELECT conv_id, turn, octet_length(encode(COALESCE(text, '')))::BIGINT AS b,
                  sha256(octet_length(encode(COALESCE(role, '')))::VARCHAR || ':' || COALESCE(role, '') || COALESCE(text, '')) AS d
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'d': d, 'b': b} ORDER BY turn NULLS FIRST, substr(d, 1, 32)) AS own FROM t GROUP BY 1),
c AS (SELECT conv_id, own, conv_id - conv_id % 5 AS base_id, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
        lambda a, x: list_reduce([xor(a, x)] || range(8), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 9 AS h FROM o),
r AS (SELECT c.conv_id, list_concat(list_slice(COALESCE(base.own, []), 1, c.h), list_slice(c.own, c.h + 1, len(c.own))) AS seq
      FROM c LEFT JOIN o base ON base.conv_id = base_id),
s AS (SELECT conv_id, seq, len(seq) AS n, UNNEST(range(0, len(seq) + 1)) AS depth FROM r),
p AS (SELECT conv_id, n, depth, md5(array_to_string(list_transform(list_slice(seq, 1, depth), lambda x: x.d), ',')) AS node,
             CASE WHEN depth > 0 THEN md5(array_to_string(list_transform(list_slice(seq, 1, depth - 1), lambda x: x.d), ',')) END AS parent,
             CASE WHEN depth > 0 THEN seq[depth].b ELSE 0 END AS b FROM s),
g AS (SELECT depth, node, parent, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, ANY_VALUE(b) AS b,
             sha256(COALESCE(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM p GROUP BY 1, 2, 3),
kids AS (SELECT depth - 1 AS depth, parent AS node, COUNT(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT g.*, COALESCE(n_children, 0) AS n_children FROM g LEFT JOIN kids USING (depth, node)),
below AS (SELECT p.depth, p.node, SUM(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, SUM((f.n_convs - 1) * f.b)::BIGINT AS saved_tokens
          FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY 1, 2)
SELECT f.conv_id, f.depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN below USING (depth, node) LEFT JOIN g up ON up.depth = f.depth - 1 AND up.node = f.parent"""


@query("op12_prefix_trie", _TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(*tries.rebuilt_turns(tries.placed_turns(load(spark, sf_dir, "conversations"))))


_WARC_SQL = f"""
WITH r AS (SELECT page_id, encode(COALESCE(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
             CASE WHEN octet_length(payload) >= {warc.MIN_REVISIT_BYTES} THEN MAX(page_id) OVER (PARTITION BY payload) END AS leader FROM r)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> leader THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> leader THEN leader END AS refers_to FROM d"""


@query("op11_warc_bundles", _WARC_SQL)
def op11_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(load(spark, sf_dir, "pages"), scratch_path(spark, "archive"))
