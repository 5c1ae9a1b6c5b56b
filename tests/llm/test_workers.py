"""Python workers that a stage holds at once: each Python operator of a task has a worker of its own, kept afterwards."""

import pytest

import corpus_pipeline
from quern.llm import components, decontaminate, line_dedup, ngram_join, quality_rules, signature_tree
from tests.llm.test_brute_force import SF


def chains(plan) -> tuple[int, int]:
    """Python operators of the stage that a physical plan ends with, one upon the other, and the most of any stage."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return chains(plan.initialPlan())
    below = [chains(plan.children().apply(i)) for i in range(plan.children().size())]
    here, most = max((x for x, _ in below), default=0), max((x for _, x in below), default=0)
    here = 0 if "Exchange" in plan.nodeName() else here + ("InArrow" in plan.nodeName())
    return here, max(here, most)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_one_python_operator_a_stage(spark, monkeypatch, name, stage):
    docs, seen, written = spark.read.parquet(f"{SF}/documents.parquet").limit(60), {}, components.stored

    def noted(df, table):
        seen[table] = max(seen.get(table, 0), chains(df._jdf.queryExecution().executedPlan())[1])
        return written(df, table)

    docs = written(docs, "sixty")
    for m in (components, corpus_pipeline, decontaminate, line_dedup, ngram_join, quality_rules, signature_tree):
        if hasattr(m, "stored"):
            monkeypatch.setattr(m, "stored", noted)
    noted(stage(spark, docs, SF), name)
    assert max(seen.values()) == 1 and [t for t, n in seen.items() if n > 1] == []
