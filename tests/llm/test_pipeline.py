import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from loomgeno.llm import bpe
from loomgeno.llm.common import materialize
from loomgeno.llm.queries import vocabulary
from tests.llm.helpers import odd_docs
from tests.llm.test_bpe import brute as brute_tokens
from tests.llm.test_simhash import brute_groups

tokenizers = pytest.importorskip("tokenizers")


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, [tuple(r) for r in docs.collect()]
    lib = tokenizers.Tokenizer.from_file(vocabulary())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, sf), name)
        rows = [tuple(r) for r in docs.collect()]
        if k < 4:
            assert docs.columns == columns and set(rows) <= set(before), name
        if name == "quality":
            assert len(rows) >= 0.7 * len(before)
        if name == "language":
            assert len(rows) >= 0.97 * len(before)
        if name == "near_duplicates":
            group, least = brute_groups({r[1] for r in before}), {}
            for r in before:
                least[group[r[1]]] = min(r[0], least.get(group[r[1]], r[0]))
            assert sorted(r[0] for r in rows) == sorted(least.values())
        if name == "mix":
            assert max(Counter(rows).values()) <= 2
            words = lambda rs: sum(len(re.findall("[^\x20\x09-\x0d]+", r[1])) for r in rs)
            by = defaultdict(int)
            for r in before:
                by[r[3]] = max(by[r[3]], words([r]))
            assert abs(words(rows) - 1.5 * words(before)) <= sum(by.values())
        if name == "tokens":
            texts = {r[0]: r[1] for r in before}
            assert Counter(rows) == Counter((r[0], *brute_tokens(lib, texts[r[0]])) for r in before)
        before = rows
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == Counter(before)
    assert bpe.transducer(vocabulary()).lookahead > 0


@pytest.mark.parametrize("k", range(5))
def test_odd_and_empty_documents(spark, sf, k):
    df, (_, stage) = odd_docs(spark), corpus_pipeline.STAGES[k]
    out = stage(spark, df, sf)
    assert stage(spark, df.limit(0), sf).collect() == []
    if k < 4:
        assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in df.collect()}
    else:
        assert out.count() == df.count()
