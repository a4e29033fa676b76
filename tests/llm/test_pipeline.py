"""The stages of the pipeline, each against a plain version on its own input."""

import collections

import corpus_pipeline
import numpy as np
from panelmark.llm import pii, quality
from panelmark.llm.common import staged, table
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.conftest import ODD
from tests.llm.test_operators import check_packing


def test_stages(spark, sf, library):
    docs = table(spark, sf, "documents")
    extra = docs.orderBy("doc_id").limit(3)
    docs = docs.unionByName(extra).withColumn("row_key", F.lit("x"))  # repeated rows and a clashing column
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = staged(stage(spark, docs, sf), name)
        if name == "packing":
            assert check_packing(out.withColumnRenamed("doc_id", "id").collect(), before, library) == 0
            break
        assert out.columns == names and dict(out.dtypes) == dict(docs.dtypes)
        after = [(r.doc_id, r.text) for r in out.collect()]
        if name == "quality":
            rules = quality.fit_rules(docs, table(spark, sf, "labels"))
            kept = {(r.id, r.kept) for r in quality.judged(docs, rules, "doc_id", "text").collect()}
            assert collections.Counter(after) == collections.Counter(x for x in before if (x[0], True) in kept)
            assert all(brute.quality(t)[0] >= 50 for _, t in after) and len(after) > 0.6 * len(before)
        elif name == "exact_dedup":
            first = {}
            for i, t in sorted(before):
                first.setdefault(" ".join(brute.WORD.findall(t)) if t == t.strip() else t, i)
            assert sorted(i for i, _ in after) == sorted(first.values())
        elif name == "near_dedup":
            want = brute.near(before, 5, 80)
            assert sorted(i for i, _ in after) == sorted(i for i, (_, c) in want.items() if i == c)
        elif name == "personal_data":
            old = dict(before)
            assert len(after) == len(before)
            for i, text in after:
                spans = brute.personal(old[i])
                assert not brute.personal(text) or not spans
                assert (text == old[i]) == (not spans) or "[" in text
            assert all(r.n_chars == len(r.text) for r in out.collect())
        docs = out


def test_odd_rows_and_empty_tables(spark, sf, odd):
    words = " ".join(f"word{k} and" for k in range(60))
    more = [(20, words), (None, words), (21, words + " more"), (22, "x@y.example " + " ".join(f"other{k} of" for k in range(70)))]
    docs = odd.unionByName(spark.createDataFrame([(*r, 0, True, "n", "s", "x", 1) for r in more], odd.schema))
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = staged(stage(spark, now, sf), name)
        ids = {r.doc_id for r in now.collect()}
        assert ids <= {i for i, _ in [*ODD, *more]}
        if start is docs:
            assert 20 in ids and not ids & {None, 1, 2, 3, 21}


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert rows and all(len(r.ids) == 4 * r.length for r in rows)
    assert np.unique([(r.sequence_id, r.offset) for r in rows], axis=0).shape[0] == len(rows)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "personal_data", "packing"]
    assert pii.KINDS == ["email", "ip", "card", "phone"]
