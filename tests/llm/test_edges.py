"""Awkward tables through the operators that keep a document's columns, and through every stage of the pipeline."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowquarry.llm.mixing import DomainModel, MixingPlan, mix, mixing_rates
from flowquarry.llm.toxicity import OrdinalModel, drop_toxic, toxicity
from tests.llm.data import awkward_texts

SMALL = "/root/testdata/sf0.001"
CLASHES = ("_toxicity", "_row", "row", "verdict", "P_TOXIC", "Grade", "_mix", "_chance", "found", "copies", "chances", "_key", "_text", "_kept", "_hash",
           "_digest", "component", "n_shingles", "start")


def documents(spark, rows):
    full = [(k, t, "en", f"src{i % 3}", len(t or ""), *([i] * len(CLASHES))) for i, (k, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES)
    return spark.createDataFrame(full, schema).repartition(3)


def _rows(df, names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def test_toxicity_keeps_other_columns(spark):
    docs = documents(spark, awkward_texts())
    model = OrdinalModel({"alone": 5.0}, (1.0, 2.0, 3.0))
    replaced = {"p_toxic", "grade"}
    rest = [c for c in docs.columns if c.lower() not in replaced]
    found = toxicity(docs, model)
    assert found.columns == [*rest, "p_toxic", "expected_severity", "grade", "is_toxic"]
    assert _rows(found, rest) == _rows(docs, rest)
    left = drop_toxic(docs, model)
    assert left.columns == docs.columns and _rows(left, docs.columns) == _rows(docs.filter("text IS NULL OR NOT text LIKE 'alone%'"), docs.columns)


def test_mixing_keeps_other_columns(spark):
    import numpy as np

    docs = documents(spark, awkward_texts())
    plan = MixingPlan(DomainModel(("a", "b"), np.zeros((1 << 16, 2), np.float32), np.zeros(2)), 1.0, 1.0, 9.0, 0.001)
    rest = [c for c in docs.columns if c.lower() not in ("copies", "chances")]
    found = mixing_rates(docs, plan)
    assert found.columns == [*rest, "n_tokens", "chances", "domain", "rate", "copies"] and _rows(found, rest) == _rows(docs, rest)
    assert _rows(mix(docs, plan), docs.columns) == _rows(docs, docs.columns)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_of_awkward_tables(spark, name, stage):
    docs = documents(spark, awkward_texts() + awkward_texts()[:5])
    found = stage(spark, docs, SMALL)
    if name == "tokens":
        assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert Counter(r.doc_id for r in found.collect()) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    else:
        assert found.schema.simpleString() == docs.schema.simpleString()
        before, after = _rows(docs, docs.columns), _rows(found, docs.columns)
        assert set(after) <= set(before)
        if name == "near_duplicates":
            kept = Counter(r.doc_id for r in found.filter(F.col("doc_id").isin(4, 10, 11, 12, 13, 33)).collect())
            assert kept == {4: 1, 33: 1}
        else:  # none of these texts is toxic or holds a benchmark passage
            assert all(after[r] >= n for r, n in before.items()) and (name == "mixing" or after == before)
    assert stage(spark, documents(spark, []), SMALL).collect() == []
