"""The pipeline on the smallest tables: each stage's rows are what its operator says."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkweir.llm import decontamination, simhash
from sparkweir.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, SF))
        assert docs.columns == columns and 0 < docs.count() <= before.count()
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "secrets":
            assert docs.count() == before.count()
        if name == "near_dedup":
            assert {r.doc_id for r in docs.collect()} == {r.component_id for r in simhash.near_duplicates(before).collect()}
        if name == "decontamination":
            found = decontamination.scan(before, table(spark, SF, "benchmark"))
            clean = found.where(~decontamination.contaminated(decontamination.n_hit(), F.col("n_words")))
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in clean.collect()}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(out) == docs.count() and all(r.round_trip and len(np.frombuffer(bytes(r.ids), "<u4")) == r.n_tokens for r in out)


def test_stages_on_empty_and_null_rows(spark):
    docs = table(spark, SF, "documents")
    odd = docs.limit(3).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("")))
    for some in (odd, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, some, SF).count() <= some.count()


def test_stages_on_null_and_repeated_ids_and_clashing_columns(spark):
    words = " ".join(f"word{i}" for i in range(80))
    rows = [(None, ' '.join(f'other{i}' for i in range(80))), (None, f"second {' '.join(reversed(words.split()))}"), (1, words), (1, words), (2, words), (3, None), (4, "")]
    base = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names = "_score _marks _findings _cleared findings cleared fp component_id score spans items _key _rank".split()
    docs = base.select("*", *[F.lit(f"own {name}").alias(name) for name in names])
    expected = {"toxicity": 7, "near_dedup": 4, "decontamination": 4, "secrets": 4}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == base.columns + names and docs.count() == expected[name]
        assert all(r[x] == f"own {x}" for r in docs.collect() for x in names)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "3", "None", "None"]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == 4 and all(r.round_trip for r in last) and [r.n_tokens for r in last if r.doc_id == 3] == [0]


def test_run_leaves_only_what_its_result_reads(spark):
    import os

    folder = f"{spark.conf.get('spark.checkpoint.dir')}/tables/{spark.sparkContext.applicationId}"
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, SF)
    assert len(set(os.listdir(folder)) - before) == 1 and out.count() > 0


def test_a_cluster_needs_a_shared_folder(spark):
    import types

    from sparkweir.llm import common

    unset = types.SimpleNamespace(get=lambda *_: None)
    context = types.SimpleNamespace(getConf=lambda: unset, master="spark://host:7077", _jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: types.SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(ValueError):
        common.shared_folder(types.SimpleNamespace(conf=unset, sparkContext=context))
