import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from flowquarry.llm.mixing import fit_domains, mixing_rates, plan_mixture, quality_domains
from flowquarry.llm.queries import ORACLE, QUERIES
from flowquarry.llm.tokenizing import load_tokenizer
from flowquarry.llm.toxicity import fit_toxicity, toxicity
from tests.llm.test_jaccard_join import brute_force as near_brute_force
from tests.llm.test_lines_and_benchmark import _brute_force as benchmark_brute_force
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage was given and returned, each written and read again."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SMALL).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def _texts(df):
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]


def test_columns(steps):
    for before, after in steps[:-1]:
        assert after.schema.simpleString() == before.schema.simpleString()


def test_toxic_documents_go(spark, steps):
    before, after = steps[0]
    scored = toxicity(before, fit_toxicity(before, spark.read.parquet(f"{SMALL}/labels.parquet")))
    assert _texts(after) == _texts(scored.filter(~F.col("is_toxic")))


def test_one_of_each_group_stays(steps):
    before, after = steps[1]
    rows = _texts(before)
    own = [r for r in near_brute_force(rows) if not r[1] or r[0] == r[2]]
    assert [k for k, _ in _texts(after)] == sorted(r[0] for r in own)


def test_benchmark_passages_go(spark, steps):
    before, after = steps[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept, grams = [], {}
    for i, t in items:  # only items that share three words in a row can be hit; the full comparison is slow
        words = t.lower().split()
        for k in range(len(words) - 2):
            grams.setdefault(tuple(words[k:k + 3]), set()).add(i)
    by_id = dict(items)
    for k, t in _texts(before):
        words = (t or "").lower().split()
        near = Counter(i for j in range(len(words) - 2) for i in grams.get(tuple(words[j:j + 3]), ()))
        likely = [(i, by_id[i]) for i, n in near.items() if n >= 4]
        if not benchmark_brute_force([(k, t)], likely)[0]:
            kept.append(k)
    assert [k for k, _ in _texts(after)] == kept and len(kept) < before.count()


def test_mixing_takes_effect(spark, steps):
    before, after = steps[3]
    labels = quality_domains(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
    model = fit_domains(before, labels, F.col("domain"), list(corpus_pipeline.WEIGHTS))
    rates = mixing_rates(before, plan_mixture(before, model, corpus_pipeline.WEIGHTS, size=None, low=1.0))
    expected = Counter({r.doc_id: r.copies for r in rates.collect()})
    assert Counter(k for k, _ in _texts(after)) == expected and min(expected.values()) >= 1 and max(expected.values()) > 1


def test_tokens(steps):
    before, after = steps[4]
    library, at, expected = load_tokenizer("word_bpe_49k.json"), 0, []
    for k, t in sorted(_texts(before), key=lambda r: (r[0], r[1].encode())):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        expected.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in after.orderBy("start").collect()] == expected


def test_run_is_the_stages(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, steps[-1][1].collect()))


def test_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and set(QUERIES) < set(names)
    assert names["pipeline"] is corpus_pipeline.run and "pipeline" not in __spark_entry__.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    assert not compare(QUERIES[name](spark, SMALL), connect(SMALL), ORACLE[name])
