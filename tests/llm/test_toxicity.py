import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity as T


def test_fold():
    assert T.fold("1D10T Ｉｄｉｏｔ іdіоt m0r0n") == "idiot idiot idiot moron"
    assert T.fold("call 555-1234, 10 items") == "call 555-1234, 10 items"
    assert T.fold(None) == ""


def test_fold_hidden_and_spelled_out():
    for text in ("id\u200biot", "id\u200diot", "id\u00adiot", "id\u0301iot", "i.d.i.o.t", "I-D-1-O-T", "i_d_i_o_t", "\ufb01", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d"):
        assert T.fold(text) in ("idiot", "fi"), text
    m = T.Model({"idiot": 1.0, "f\u00fcr": 1.0})
    assert m.folded("\u00efdiot \u00efd\u00ef\u00f6t f\u00fcr \u00fcber") == "idiot idiot f\u00fcr \u00fcber"
    assert T.fold("a.b and x-y, 3.5-4.2, e.g. this") == "a.b and x-y, 3.5-4.2, e.g. this"


def test_held_out_labels_have_no_effect(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert labels.where(T.held_out(F.col("doc_id"))).count() > 50
    one, two = T.fit(docs, labels), T.fit(docs, flipped)
    assert one.weights and (one.weights, one.exceptions, one.curve) == (two.weights, two.exceptions, two.curve)


def test_score_by_plain_arithmetic():
    m = T.Model({"scum": 2.0, "lowe*": 3.0}, curve=(-3.0, 1.0, 0.5, 0.25, 0.125))
    a = m.matcher()
    total, n, kinds = 2.0 + 3.0 + 3.0, 6, 3
    z = -3.0 + math.log1p(total) + 0.5 * math.log1p(100 * total / n) + 0.25 * math.log1p(kinds) + 0.125 * 3.0
    assert math.isclose(m.score(m.features("you Scum, the l0west lowe of", a)), 1 / (1 + math.exp(-z)))


def test_match_edges_and_exceptions():
    m = T.Model({"scum": 2.0, "lowe*": 3.0, "trash": 1.0}, frozenset({"trash can"}))
    a = m.matcher()
    assert [h[0] for h in m.hits("scum scums xscum lowest xlowe lowe! trash", a)] == ["scum", "lowe*", "lowe*", "trash"]
    assert m.features("take the trash can out", a)[0] == 0 and m.features("you trash", a)[0] > 0


def test_plain_count_of_matches():
    m = T.Model({"ab": 1.0, "cd*": 1.0})
    a = m.matcher()
    rng = np.random.default_rng(5)
    for _ in range(200):
        text = "".join(rng.choice(list("abcd  ,"), 60))
        want = sum(w == "ab" or w.startswith("cd") for w in T._EDGE.findall(text))
        assert len(m.hits(text, a)) == want


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(docs, labels)
    rows = T.score(docs, model).join(labels, "doc_id").where("held_out").select("toxic", "predicted").toPandas()
    assert (rows.toxic == rows.predicted).mean() > 0.97
    caught = rows[rows.toxic == 1].predicted.mean()
    assert caught > 0.9 and rows[rows.toxic == 0].predicted.mean() < 0.02
    kept = T.keep_clean(docs.limit(500), model)
    assert kept.columns == docs.columns


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 0), (None, "scum", 0), (3, "x " * 50000 + "scum", 0), (3, "fine", 1)], "doc_id long, text string, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    assert T.fit(docs, none).weights == {}
    got = T.score(docs, T.Model({"scum": 9.0}, curve=(-4.0, 3.0, 0.0, 1.0, 0.0))).toPandas()
    assert len(got) == 5 and got.score.between(0, 1).all() and got[got.doc_id.isna()].predicted.tolist() == [1]
    assert pd.Series(got[got.doc_id == 3].predicted).tolist() == [1, 0]
    assert T.score(docs.limit(0), T.Model()).count() == 0


@pytest.mark.parametrize("text", [None, "", "a b", "x"])
def test_labelled_rows_without_terms(spark, text):
    docs = spark.createDataFrame([(i, text) for i in range(1, 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    assert model.weights == {} and T.score(docs, model).where("score between 0 and 1").count() == 8
