"""Lines are looked up by their first word before they are normalised as a whole."""

import hashlib

from pyspark.sql import functions as F

from tabsmith.llm import licences

ODD = [
    "Licensed under the MIT License.", "  ** Licence: MIT", "noncommercial use", "NonCommercial-use only", "http://x.org", "İstanbul licence", "",
    " \t", "...", "© 2020 A. Name", "Copyright (c) 2019 X. Permission is hereby granted", "(C) 2001 all rights reserved", "copyright owner is",
    "ALL RIGHTS RESERVED", "licence licence licence", "Ünïcode words", "ΑΣ word", "123 go", "Copyright 2020 Foo Licensed under the MIT License.", None,
]


def test_the_head_is_the_first_word_of_the_canonical_text(spark):
    df = spark.createDataFrame([(t,) for t in [*ODD, *[t for _, t in licences.KNOWN], *[t for _, t in licences.whole_texts()]]], "t string")
    rows = df.select("t", licences.head(F.col("t")).alias("head"), licences.canonical(F.col("t")).alias("body")).collect()
    assert [(r["t"], r["head"]) for r in rows] == [(r["t"], None if r["t"] is None else r["body"].split(" ")[0]) for r in rows]


def test_texts_without_signs_hold_no_notice(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    plain = df.where(~licences._signed(F.lower("t")))
    for notice in licences.NOTICES:
        assert plain.where(F.col("t").rlike(notice)).isEmpty()


def test_few_and_many_heads_give_the_same(spark, monkeypatch):
    texts = [f"{a}\n{b}\nx" for a in ODD if a is not None for b in ("SPDX-License-Identifier: MIT", "word", "Licenced under CC BY 4.0")] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = licences.known_licences(spark)
    few = sorted(map(tuple, licences.scan(docs, known).drop("notices").collect()), key=str)
    monkeypatch.setattr(licences, "HEADS", 0)
    assert few == sorted(map(tuple, licences.scan(docs, known).drop("notices").collect()), key=str)
    assert sum(r[-1] for r in few) > len(ODD) and hashlib.sha256(b"").hexdigest() not in {r[1] for r in few}
