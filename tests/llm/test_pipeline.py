import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lagloom.llm import queries, toxicity
from lagloom.llm.secrets import scan_secrets
from test_near_copies import slow_kept

SF = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert [n for n in names if n.startswith("op") and n.split("_")[0][2:].isdigit()] and "pipeline" in names
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF).cache()
    machine = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").filter(toxicity.crc_mod("doc_id", 5) != 0))
    bad = {r["doc_id"] for r in toxicity.score_toxicity(docs, machine).collect() if r["predicted"]}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(clean) == ids(docs) - bad and clean.columns == docs.columns
    one = stages["near_dedup"](spark, clean, SF).select(*docs.columns).cache()
    want, links = slow_kept([(r["doc_id"], r["text"]) for r in clean.collect()])
    assert links > 5 and ids(one) == want and one.count() == len(want)
    left = stages["decontamination"](spark, one, SF).select(*docs.columns).cache()
    assert ids(left) < ids(one) or ids(left) == ids(one)
    safe = stages["secrets"](spark, left, SF).cache()
    assert ids(safe) == ids(left) and safe.columns == docs.columns
    assert all(r["spans"] == "" for r in scan_secrets(safe).collect())
    packed = stages["packing"](spark, safe, SF)
    assert ids(packed) == ids(safe)
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_odd_rows_pass_through(spark, odd_docs, no_docs, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and clashing columns, by every stage and run()."""
    labels = spark.createDataFrame([(1, 0), (5, 0), (77, 1), (None, None)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no id here but words enough to be looked at"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = odd_docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd_docs.columns, name
        left[name] = sorted((r["doc_id"] or -1) for r in docs.collect())
    assert left["toxicity"] == [-1, 1, 1, 2, 3, 4, 5, 6]
    # Null, empty and blank texts are copies; so are the repeated rows.
    assert left["near_dedup"] == [-1, 1, 2, 4, 5]
    # The row without an id is the benchmark's item.
    assert left["decontamination"] == left["secrets"] == [1, 2, 4, 5]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == {1, 2, 4, 5}
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "length", "ids_crc32").collect()))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0, name
    none = spark.createDataFrame([], labels.schema)
    none.write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    assert dict(corpus_pipeline.STAGES)["toxicity"](spark, odd_docs, str(tmp_path)).count() == odd_docs.count()
