"""The operators made of DataFrame functions only: secrets, quality, lines, licenses."""

from __future__ import annotations

import collections

import brute
import pytest
from pyspark.sql import functions as F

from shelfspan.llm import license_rules, quality_llr, secret_owners, site_lines
from shelfspan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_secrets_of_whole_table(spark):
    got = QUERIES["op1_secret_scans"](spark, SF).collect()
    want = {k: brute.base_secrets(t) for k, t in texts(spark).items()}
    assert {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got} == want
    for r in got:
        assert r["n_copied"] + r["n_live"] + r["n_unclear"] == len([s for s in r["spans"].split(",") if s])


def test_secrets_of_odd_texts(spark, documents, sample_texts):
    docs = documents([*enumerate(sample_texts), (None, sample_texts[-1]), (3, " ")], extra=True)
    got = secret_owners.scan(docs).withColumn("sha", F.sha2(secret_owners.span_text(F.col("base")), 256)).collect()
    want = [(k, brute.base_secrets(t)[3]) for k, t in [*enumerate(sample_texts), (None, sample_texts[-1]), (3, " ")]]
    assert collections.Counter((r["doc_id"], r["sha"]) for r in got) == collections.Counter(want)


def test_owners_separate_copied_from_live(spark, documents):
    live, copied, plain = "A1b2C3d4E5f6G7h8I9j0", "Zz9Yy8Xx7Ww6Vv5Uu4Tt", "abcdefabcdefabcdefabcdef"
    rows = [(1, f"token={live}", "own"), (2, f"token={live}", "own"), (7, f"hex {plain}", None)]
    rows += [(k, f"token = {copied}", f"o{k}") for k in (3, 4, 5)] + [(6, f"see {live[::-1]} and {copied[::-1]}", "z"), (8, copied[::-1], "y")]
    got = {r["doc_id"]: [(s["kind"], s["verdict"]) for s in r["spans"]] for r in secret_owners.scan(documents(rows)).collect()}
    assert got == {
        1: [("assign", "live")], 2: [("assign", "live")], 3: [("assign", "copied")], 4: [("assign", "copied")],
        5: [("assign", "copied")], 6: [("owned", "live")], 7: [("hex", "unclear")], 8: [],
    }


def test_quality_counts(spark, documents, sample_texts):
    sample_texts = sample_texts + list(texts(spark).values())
    docs = documents(list(enumerate(sample_texts)), extra=True)
    ratio = quality_llr.Ratio((0.0,) * 64, -0.5)
    got = docs.select("doc_id", quality_llr.verdict(F.col("text"), ratio).alias("q")).select("doc_id", "q.*").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for r in got:
        assert tuple(r[n] for n in names) == brute.quality_counts(sample_texts[r["doc_id"]]), sample_texts[r["doc_id"]]
        assert r["kept"] == (not r["base_failed"])


def test_quality_ratio_tells_junk_from_prose(spark, documents):
    prose = "the house stands near the river and the people of the town walk along it every day in summer " * 1
    clean = [(k, f"{prose} {k} " + prose.replace("river", f"r{k}"), "a") for k in range(40)]
    junk = [(100 + k, " ".join(f"w{k}{j} !!!" for j in range(60)), "a") for k in range(10)]
    docs = documents(clean + junk + [(None, None, None)], extra=True)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)] + [(100, 0, 0), (5, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    ratio = quality_llr.fit(docs, labels, buckets=1024)
    kept = quality_llr.kept(docs, ratio)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & set(range(100, 110)) and not [k for k, t, _ in clean if k not in ids and brute.quality_counts(t)[5] is False]
    assert "Python" not in plan(kept) and "Cartesian" not in plan(kept) and "NestedLoop" not in plan(kept)


def test_quality_ratio_equals_plain_count(spark, documents):
    rows = [(1, "a b a"), (2, "b c"), (3, None)]
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (2, 0, 0)], "doc_id long, quality int, toxic int")
    ratio = quality_llr.fit(documents(rows), labels, buckets=8)
    per = documents(rows).select(F.explode(quality_llr.feature_buckets(F.coalesce("text", F.lit("")), 8)).alias("b"), "doc_id").collect()
    raw, good = collections.Counter(r["b"] for r in per), collections.Counter(r["b"] for r in per if r["doc_id"] == 1)
    import math

    for b in range(8):
        want = math.log((good[b] + 1) / (sum(good.values()) + 8)) - math.log((raw[b] + 1) / (sum(raw.values()) + 8))
        assert ratio.weights[b] == pytest.approx(want)


def test_no_labels_no_documents(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert set(quality_llr.fit(documents([]), labels, buckets=4).weights) == {0.0}
    assert quality_llr.kept(documents([]), quality_llr.Ratio((0.0,), 0)).count() == 0
    assert secret_owners.scan(documents([])).count() == 0
    assert site_lines.drop_furniture(documents([])).count() == 0


def test_lines(documents):
    menu = [(k, f"menu\nown text {k}\n\nmenu", "h") for k in range(9)]
    rows = [*menu, (9, "menu", "h"), (10, None, "h"), (11, "menu\nx", "other"), (12, "menu\ny", None), (3, menu[3][1], "h")]
    docs = documents(rows, extra=True)
    got = site_lines.drop_furniture(docs, ratio=0.5, counts=("n_lines", "n_dropped"))
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    seen = collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect())
    want = collections.Counter((k, f"own text {k}\n", 3, 2) for k in [*range(9), 3])
    want += collections.Counter([(9, "menu", 1, 0), (10, None, 0, 0), (11, "menu\nx", 2, 0), (12, "menu\ny", 2, 0)])
    assert seen == want
    assert "Python" not in plan(got) and "Cartesian" not in plan(got) and "NestedLoop" not in plan(got)


def test_license_base(spark, documents, sample_texts):
    sample_texts = sample_texts + list(texts(spark).values()) + ["apache license version 2 " * 3, "cc by nc " * 900]
    docs = documents(list(enumerate(sample_texts)), extra=True)
    got = docs.select("doc_id", license_rules.scan(F.col("text")).alias("s")).select("doc_id", "s.*").collect()
    for r in got:
        mine = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
        assert mine == brute.base_licenses(sample_texts[r["doc_id"]]), sample_texts[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_license_rules_and_suppression(documents):
    cases = {
        "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and": "mit",
        "licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance": "apache-2",
        "This work is under CC BY-NC-SA 4.0": "cc-by-nc,cc-by-nc-sa",
        "All rights reserved.": "",
        "Copyright 2020. All rights reserved.": "proprietary",
        "a word about permission and licenses": "",
        "released under the BSD 3-Clause License": "bsd-3",
    }
    docs = documents([(k, t) for k, t in enumerate(cases)])
    got = docs.select("doc_id", license_rules.scan(F.col("text")).alias("s")).collect()
    assert {list(cases)[r["doc_id"]]: r["s"]["labels"] for r in got} == cases
    assert len(license_rules.rules()) > 300
