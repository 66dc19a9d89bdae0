import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import licences as L

KNOWN = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "All rights reserved.": "reserved"}


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_finds_the_lines_that_plain_search_finds(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in L.scan(docs, model).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    n = 0
    for r in rows:
        want = {f for line in r.text.split("\n") for t, f in KNOWN.items() if line.strip() == t}
        have = set(filter(None, got[r.doc_id].families.split(",")))
        assert want <= have, (r.doc_id, want, have)
        if not re.search(r"(?i)licen[sc]e|rights reserved", r.text):
            assert not have
        n += len(want)
    assert n > 20


def test_unseen_wordings(spark, model):
    texts = ["This program has been released under the terms of the MIT License.", "you may use it: licensed under the apache license version 2.0 or later", "We renewed the license of the car", "All my rights were taken", "All rights reserved. "]
    rows = [(i, t, 1.0) for i, t in enumerate(texts)]
    got = [r.licence for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string, probability double"), model).orderBy("doc_id").collect()]
    assert got[1:4] == ["apache", "unknown", "unknown"]


WRAPPED = {
    "mit": '''Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.''',
    "bsd": '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:''',
    "gpl": '''This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.''',
}


def test_wrapped_notices(spark, model):
    rows = [(i, f"some words before\n\n{t}\n\nand some after", f) for i, (f, t) in enumerate(WRAPPED.items())]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string, families string"), model).collect()}
    assert {i: got[i].families for i, _, _ in rows} == {i: f for i, _, f in rows}
    assert [h.split(":")[:2] for h in got[0].hits.split(",")] == [["2", "mit"], ["8", "mit"]]


def test_recall_and_precision_inside_long_texts(spark, model):
    rng = random.Random(3)
    plain = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("n_chars > 400").orderBy(F.desc("doc_id")).limit(600).collect() if not re.search(r"(?i)licen[sc]e|rights reserved|public", r.text)]
    rows, truth = [], {}
    for i, body in enumerate(plain):
        text = list(body)
        if i % 2:
            truth[i] = rng.choice(sorted(L.TEMPLATES))
            notice = rng.choice(L.TEMPLATES[truth[i]]).split()
            if len(notice) > 8:
                notice.pop(rng.randrange(len(notice)))
            at = rng.randint(0, len(text))
            text[at:at] = notice
        rows.append((i, "".join(w + ("\n" if rng.random() < 0.08 else " ") for w in text)))
    got = {r.doc_id: set(filter(None, r.families.split(","))) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    hit = sum(f in got[i] for i, f in truth.items())
    false = sum(bool(got[i]) for i in got if i not in truth)
    wrong = sum(len(got[i] - {f}) for i, f in truth.items())
    print(f"notices found {hit} of {len(truth)}, clean texts marked {false} of {len(rows) - len(truth)}, other families {wrong}")
    assert len(truth) > 150 and hit >= 0.9 * len(truth) and false == 0 and wrong <= 0.1 * len(truth)


def test_windows_cover_every_run_of_words():
    rng = random.Random(5)
    for _ in range(100):
        lines = [" ".join("w" for _ in range(rng.choice([0, 1, 7, 60]))) for _ in range(rng.randrange(12))]
        tokens, spans, n = L.windows("\n".join(lines))
        assert all(b - a <= L.WINDOW for a, b, _ in spans) and len(tokens) == sum(len(x.split()) for x in lines)
        at, run = 0, []
        for line in [*lines, ""]:
            if line:
                run.append(len(line.split()))
            elif run:
                size = sum(run)
                for a in range(at, at + max(1, size - 31)):
                    assert any(x <= a and min(a + 32, at + size) <= y for x, y, _ in spans)
                at, run, n = at + size, [], n - 1
        assert n == 0


def test_edges(spark, model):
    rows = [(1, None), (1, None), (None, "All rights reserved."), (2, "\n\n"), (3, "word " * 50000 + "\nReleased under the MIT License.")]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert sorted((r.doc_id or 0, r.licence, r.n_paragraphs) for r in got) == [(0, "reserved", 1), (1, "unknown", 0), (1, "unknown", 0), (2, "unknown", 0), (3, "mit", 1)]
    assert L.scan(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    empty = L.fit(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.families[-1] == "unknown"
