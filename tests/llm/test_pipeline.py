"""The pipeline against brute force, stage by stage."""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from helpers import SF, awkward, base_spans, brute_groups  # noqa: E402

import corpus_pipeline  # noqa: E402
from strata.llm import quality  # noqa: E402
from strata.llm.common import documents, written  # noqa: E402


def test_stages_against_brute_force(spark):
    docs = documents(spark, SF)
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-stage")
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count() and set(after) <= set(before)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "quality rules":
            for d, r in before.items():
                j = quality.judge(r.text, quality.LineRules())
                assert (d in after) == j["kept"] and (not j["kept"] or after[d].text == j["clean_text"])
        elif name == "n-gram Jaccard join":
            groups = brute_groups({d: r.text for d, r in before.items()}, 5, 80)
            assert set(after) == {d for d, g in groups.items() if d == g}
        elif name == "benchmark decontamination":
            leaks = {d for d, r in before.items() if any(x in " ".join(re.findall(r"\w+", r.text.lower())) for x in items)}
            assert not leaks & set(after)
        elif name == "personal data":
            assert set(after) == set(before) and not any(base_spans(r.text) for r in after.values())
            for d, r in before.items():
                if not re.search(r"[0-9@]|Mr|Ms|Dr|Prof|Frau|Herr|Señor|Mon|Mad", r.text):
                    assert after[d].text == r.text
        else:
            assert all(0 < r.mix_probability <= 1 for r in after.values()) and docs.columns == [*columns, "mix_probability", "mix_weight", "mix_error"]
        before = after


def test_stages_on_awkward_rows(spark):
    for rows in (awkward(spark), awkward(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            got = stage(spark, rows, SF)
            assert got.columns[:len(rows.columns)] == rows.columns
            got.collect()
