"""Quality rules by distribution divergence, in DataFrame functions only.

Each text has two histograms: its characters by class and its words by the most common words of its
language (with one bin for all others). They are compared with the histograms of the whole language in
the corpus by Jensen-Shannon distance (base 2, so between 0 and 1). Short texts are not compared.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.session import cut_lineage, scratch_path

BLANK = " \t\n\x0b\x0c\r"
PUNCTUATION = ".,;:!?'\"()-"
SYMBOLS = "".join(c for c in string.punctuation if c not in PUNCTUATION)
#: Character classes beside lower case and blanks; the rest is ``other``.
CLASSES = (
    ("upper", string.ascii_uppercase), ("punctuation", PUNCTUATION), ("digit", string.digits), ("symbol", SYMBOLS),
)
COMMON_WORDS = 30
MIN_CHARS, MIN_WORDS = 100, 50
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.38
MIN_BASE_WORDS, MAX_REPEAT_PERCENT = 20, 30
ANY = "*"
MAX_LANGUAGES = 10_000

_BIAS = 8  # words in a repeated window


def _let(value: Column, body) -> Column:
    """``body(value)`` with value computed once: lambdas would otherwise compute it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def repeated_words(found: Column) -> Column:
    """Words of the array inside 8-word windows that occur twice or more in it."""

    def covered(positions: Column) -> Column:
        # each repeated window covers 8 words, less what the next one covers again
        last = F.size(positions)
        reach = F.transform(
            positions,
            lambda p, i: F.when(i + 1 < last, F.least(F.lit(_BIAS), F.get(positions, i + 1) - p)).otherwise(F.lit(_BIAS)),
        )
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def from_sorted(rows: Column) -> Column:
        n = F.size(rows)
        again = F.filter(
            F.transform(
                rows,
                lambda r, i: F.when(
                    F.coalesce(F.get(rows, i - 1)["h"] == r["h"], F.lit(False))
                    | F.coalesce(F.when(i + 1 < n, F.get(rows, i + 1)["h"]) == r["h"], F.lit(False)),
                    r["p"],
                ),
            ),
            lambda p: p.isNotNull(),
        )
        return _let(F.sort_array(again), covered)

    def from_windows(hashes: Column) -> Column:
        rows = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            _let(F.sort_array(rows), from_sorted)
        )

    def from_hashes(h: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(h) - _BIAS), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(_BIAS)])
        )
        return F.when(F.size(h) <= _BIAS, F.lit(0)).otherwise(_let(windows, from_windows))

    return _let(F.transform(found, lambda w: F.xxhash64(w)), from_hashes).cast("long")


_BULK = "[a-z\\x20\\x09-\\x0D]+"  # letters and blanks: most of a text, counted by what is left
_CLASS_NAMES = ("class_lower", "class_blank", *(f"class_{n}" for n, _ in CLASSES), "class_other")


def base_columns(documents: DataFrame) -> DataFrame:
    """doc_id, lang, text_hash, the base counts and the class counts of every row; see ``quality``."""
    text = _text()
    rows = documents.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit(ANY)).alias("lang"), text.alias("text"),
        words(text).alias("words"), F.regexp_replace(text, _BULK, "").alias("rest"),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANK))) > 0)
    rows = rows.select(
        "doc_id", "lang", "words", "rest", F.xxhash64("text").alias("text_hash"), F.length("text").alias("n_chars"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.length("rest").alias("n_rest"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    counts, rest = [], F.col("rest")
    for name, members in CLASSES:
        left = F.translate(rest, members, "")
        counts.append((F.length(rest) - F.length(left)).alias(f"class_{name}"))
        rest = left
    blank = F.col("n_chars") - F.col("word_chars")
    return rows.select(
        "doc_id", "lang", "text_hash", "n_chars", F.size("words").cast("long").alias("n_words"), "word_chars",
        (F.col("n_rest") - F.length(F.translate("rest", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        "n_dup_lines", repeated_words(F.col("words")).alias("n_repeat_words"),
        (F.col("n_chars") - blank - F.col("n_rest")).alias("class_lower"), blank.alias("class_blank"),
        *counts, F.length(rest).alias("class_other"),
    )


def _low_words(documents: DataFrame) -> Column:
    return words(F.lower(_text()))


def references(documents: DataFrame, base: DataFrame, common: int = COMMON_WORDS) -> DataFrame:
    """One row per language: the shares of the character classes, the common words and their shares.

    Every row counts; texts without a language are a language of their own (``*``).
    """
    total = F.greatest(F.sum("n_chars"), F.lit(1))
    sums = base.groupBy("lang").agg(
        F.array(*[F.sum(c) / total for c in _CLASS_NAMES]).alias("classes"), F.greatest(F.sum("n_words"), F.lit(1)).alias("all")
    )
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(ANY)).alias("lang")
    counted = documents.select(lang, F.explode(_low_words(documents)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    # the rank limit is applied inside each task first, so one language with most words is no hot group
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    top = counted.withColumn("place", place).where(F.col("place") <= common).groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("top")
    )
    return sums.join(top, "lang", "left").select(
        "lang", "classes", F.col("top.word").alias("common"), F.transform("top.n", lambda n: n / F.col("all")).alias("share")
    )


def js_distance(own: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares; both are padded with the missing rest."""

    def half(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def bin_(p: Column, q: Column) -> Column:
        p, q = F.coalesce(p, F.lit(0.0)), F.coalesce(q, F.lit(0.0))
        return (half(p, (p + q) / 2) + half(q, (p + q) / 2)) / 2

    def rest(x: Column) -> Column:
        return F.greatest(1 - F.aggregate(x, F.lit(0.0), lambda a, v: a + v), F.lit(0.0))

    bins = F.zip_with(F.concat(F.array(rest(own)), own), F.concat(F.array(rest(reference)), reference), bin_)
    return F.sqrt(F.greatest(F.aggregate(bins, F.lit(0.0), lambda a, v: a + v), F.lit(0.0)))


def quality(documents: DataFrame) -> DataFrame:
    """Quality verdict of every row of ``documents(doc_id, text, lang, ...)``.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, word_distance (null where the text is too short to compare), kept. A row fails the
    base with under 20 words or more than 30 % repeated words; else it is kept when neither distance is
    above its bound. Null text counts as empty; texts of null language are compared with each other.
    Repeated rows give repeated results, each by its own language; a null doc_id is passed on, other columns are ignored.
    """
    spark = documents.sparkSession
    path = scratch_path(spark, "quality-base")
    base_columns(documents).write.parquet(path)
    base = spark.read.parquet(path)
    reference = cut_lineage(references(documents, base))
    if reference.count() > MAX_LANGUAGES:
        raise ValueError("references are broadcast; this table has too many languages")
    k = COMMON_WORDS
    # the empty word ends every text: its count is the number of equal rows
    bins = reference.select("lang", F.posexplode("common").alias("bin", "word")).unionAll(
        reference.select("lang", F.lit(k).alias("bin"), F.lit("").alias("word"))
    ).select(F.xxhash64("lang", "word").alias("key"), "bin")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(ANY)).alias("lang")
    one = documents.select(
        "doc_id", lang, F.xxhash64(_text()).alias("text_hash"), F.explode(F.array_append(_low_words(documents), "")).alias("word")
    ).select("doc_id", "text_hash", "lang", F.xxhash64("lang", "word").alias("key"))
    counts = one.join(F.broadcast(bins), "key").groupBy("doc_id", "text_hash", "lang").agg(
        *[F.count_if(F.col("bin") == i).alias(f"b{i}") for i in range(k)], F.count_if(F.col("bin") == k).alias("copies")
    ).select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("lang").alias("_lang"),
        F.array(*[F.col(f"b{i}") / F.col("copies") for i in range(k)]).alias("found"),
    )
    rows = base.join(counts, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")) & (F.col("lang") == F.col("_lang")))
    rows = rows.join(F.broadcast(reference), "lang")
    chars, total = F.greatest(F.col("n_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    class_distance = js_distance(F.array(*[F.col(c) / chars for c in _CLASS_NAMES]), F.col("classes"))
    word_distance = js_distance(
        F.transform("found", lambda n: n / total), F.coalesce("share", F.array().cast("array<double>"))
    )
    failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (
        F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE
    )
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.when(F.col("n_chars") >= MIN_CHARS, class_distance).alias("class_distance"),
        F.when(F.col("n_words") >= MIN_WORDS, word_distance).alias("word_distance"),
    ).withColumn("kept", ~F.col("base_failed") & near)
