"""The span classifier's inputs and fit, its estimates against plain code, and wrapped license notices."""

from __future__ import annotations

import math
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from helpers import PROSE, SF, awkward  # noqa: E402

from strata.llm import licenses, pii  # noqa: E402
from strata.llm.common import documents  # noqa: E402

SECRET = "24be64439e3e49cf46b2d7c90f3602a3"
OTHER = "99aa64439e3e49cf46b2d7c90f3602bb"


def _spans(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [[(pii.KINDS[s.kind], tuple(s.votes), list(s.cues)) for s in r.found] for r in pii.with_spans(rows, "text", "found").orderBy("doc_id").collect()]


def test_cues_read_the_span_and_its_neighbours(spark):
    texts = [f"the token {SECRET} is here", f"one token {OTHER} is there", f"the digest {SECRET} is here", f"the token {SECRET} was here",
             f"the token {SECRET * 2} is here", f"the token '{SECRET}' is here"]
    got = [next(c for k, _, c in spans if k == "secret") for spans in _spans(spark, texts)]
    differ = [[i for i, (x, y) in enumerate(zip(got[0], g)) if x != y] for g in got]
    # 0 length, 1 classes of characters, 2 different characters, 3 shape, 4 sides, 5 word before, 6 word after
    assert differ[0] == [] and differ[2] == [5] and differ[3] == [6] and differ[4] == [0] and differ[5] == [4]
    assert set(differ[1]) <= {2}
    assert all(0 <= c < pii.CUE_SLOTS for g in got for c in g)


def test_estimates_equal_span_by_span_expectation_maximisation():
    patterns = [(6, (1, 1, 1, 1, 1), 5.0), (6, (1, -1, 0, 1, 1), 3.0), (6, (-1, -1, -1, 1, -1), 4.0), (2, (-1, 1, 0, 1, 1), 2.0), (2, (1, 1, 0, 1, 1), 6.0)]
    spans = [(k, v) for k, v, n in patterns for _ in range(int(n))]
    share = {k: 0.5 for k, _ in spans}
    say = np.full((5, 2, 3), 0.2)
    for i in range(5):
        say[i, 1, 2] = say[i, 0, 0] = 0.6
    for _ in range(50):
        post = []
        for k, v in spans:
            odds = math.log(share[k] / (1 - share[k])) + sum(math.log(say[i, 1, x + 1] / say[i, 0, x + 1]) for i, x in enumerate(v))
            post.append(1 / (1 + math.exp(-min(30.0, max(-30.0, odds)))))
        share = {k: (sum(p for (q, _), p in zip(spans, post) if q == k) + 1) / (sum(q == k for q, _ in spans) + 2) for k in share}
        say = np.full((5, 2, 3), 2.0)
        for i in range(5):
            say[i, 1, 2] = say[i, 0, 0] = 6.0
            for (_, v), p in zip(spans, post):
                say[i, 1, v[i] + 1] += p
                say[i, 0, v[i] + 1] += 1 - p
        say /= say.sum(axis=2, keepdims=True)
    by_span = dict(zip(spans, post))
    assert pii.estimate(patterns) == pytest.approx([by_span[k, v] for k, v, _ in patterns], abs=1e-9)


def test_span_classifier_is_the_optimum_of_its_loss(spark):
    docs = documents(spark, SF)
    model = pii.fit(docs)
    rows = pii.span_counts(docs).collect()
    counts: dict = {}
    for r in rows:
        counts[r.kind, tuple(r.votes)] = counts.get((r.kind, tuple(r.votes)), 0) + r.n
    patterns = sorted((k, v, float(n)) for (k, v), n in counts.items())
    true = {(k, v): p for (k, v, _), p in zip(patterns, pii.estimate(patterns))}
    x = np.zeros((len(rows), pii.INPUTS))
    for i, r in enumerate(rows):
        x[i, r.kind] = 1
        for j, v in enumerate(r.votes):
            if v:
                x[i, len(pii.KINDS) + 2 * j + (v < 0)] = 1
        x[i, len(pii.KINDS) + 2 * len(pii.LABELERS) + np.array(r.cues)] = 1
    n = np.array([r.n for r in rows], float)
    y = np.array([true[r.kind, tuple(r.votes)] for r in rows])
    w, b = np.array(model[:-1]), model[-1]
    residual = n * (1 / (1 + np.exp(-(x @ w + b))) - y) / n.sum()
    assert abs(residual.sum()) < 2e-3 and np.abs(x.T @ residual + 1e-3 * w).max() < 2e-3
    # spans of equal votes differ by what they are and stand beside
    margin: dict = {}
    for r, m in zip(rows, x @ w + b):
        margin.setdefault((r.kind, tuple(r.votes)), set()).add(round(m, 6))
    assert any(len(m) > 1 for m in margin.values())


def test_spans_of_hand_rows(spark):
    texts = [f'Mail ann@ex.org, the api token = "{SECRET}" stays', f"our secret token {OTHER} here", "write to bob@ex.com, +1 (017) 555-7713", PROSE, None, ""] * 20
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(rows).collect()}
    at = texts[0].index(SECRET)
    for d in range(0, len(texts), 6):
        assert got[d] == f"email:5:15,secret:{at}:{at + 32}" and got[d + 1] == "secret:17:49"
        assert got[d + 2] == "email:9:19,phone:21:38" and [got[d + k] for k in (3, 4, 5)] == ["", "", ""]


def test_awkward_rows_keep_their_number(spark):
    docs = awkward(spark)
    docs = docs.union(docs).withColumn("found", F.lit("clash"))
    assert pii.personal_data(docs).count() == docs.count() == pii.redacted(docs).count()


MIT = '''Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:'''
BSD = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:'''
GPL = '''# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.'''


def test_wrapped_notices_are_confirmed_and_prose_is_not(spark):
    wrapped = re.sub(r"((?:\S+ ){8})", r"\1\n", PROSE)
    rows = [(1, f"Intro line.\n{MIT}\n\nMore."), (2, BSD), (3, f"{PROSE}\n\n{GPL}\n{PROSE}"), (4, wrapped), (5, MIT.replace("\n", "\r\n")), (6, None), (7, "")]
    model = licenses.fit(documents(spark, SF))
    got = licenses.license_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert {(r.doc_id, r.paragraph, r.license) for r in got} == {(1, 1, "mit"), (2, 0, "bsd"), (3, 2, "gpl"), (5, 0, "mit")}
    assert all(r.shared_pct >= 80 for r in got)


def test_paragraphs_equal_plain_python(spark):
    texts = ["a b\nc d.\ne f", "A\n\nb", "one,\n  two\nThree\nfour!\nfive", "\n\nx\n", "x\x01\ny\x01z", "q \t\r\n# r", "", "...\nz", 'say\n("so', "1\n2\na", "é\nß\nÉ", "w\n" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.paragraph, " ".join(r.words)) for r in licenses.paragraphs(rows).collect())
    want = []
    for d, t in enumerate(texts):
        runs: list = []
        before = ""
        for n, line in enumerate(t.split("\n")):
            begins = line.lstrip("\t #*/>;-\x01")
            begins = begins[1:] if begins[:1] in ('"', "'", "(") else begins
            on = n > 0 and before.rstrip("\t \r\x01")[-1:] not in ("", ".", "!", "?", ":") and begins[:1].islower()
            if on:
                runs[-1][1].append(line)
            else:
                runs.append((n, [line]))
            before = line
        for n, lines in runs:
            found = re.findall(r"[^\W_]+(?:[.-][^\W_]+)?", " ".join(lines).lower())
            if found:
                want.append((d, n, " ".join(found)))
    assert got == sorted(want)
