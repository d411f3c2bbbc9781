"""The pipeline stage by stage, against plain versions on the smallest tables."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from test_documents import plain_components, plain_sets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "ngram_join", "secrets", "mixing", "bpe"]
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        after[name] = docs.collect()
        docs = spark.createDataFrame(after[name], docs.schema)
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in after["quality"]}
    assert sum(i in left for i, q in labels.items() if q == 1) >= 0.98 * sum(labels.values())
    rows = sorted(after["quality"], key=lambda r: r.doc_id)
    comp = plain_components(plain_sets([r.text for r in rows]))
    assert {r.doc_id for r in after["ngram_join"]} == {r.doc_id for k, r in enumerate(rows) if comp[k] == k}
    assert [r.doc_id for r in sorted(after["secrets"], key=lambda r: r.doc_id)] == sorted(r.doc_id for r in after["ngram_join"])
    assert not any("AKIA" in r.text and "[secret]" not in r.text for r in after["secrets"])
    assert sorted(map(str, after["mixing"])) == sorted(map(str, after["secrets"]))
    assert len(after["bpe"]) == len(after["mixing"])
    whole = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {(r.doc_id, r.ids_sha256) for r in after["bpe"]}


def test_last_stage_carries_the_order_of_the_mix_and_the_ids(spark, tmp_path):
    import hashlib
    import struct

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = corpus_pipeline.stage_mixing(spark, docs, SF)
    want = [r.doc_id for r in corpus_pipeline.mixing.mix(docs).orderBy("mix_position").collect()]
    mixed.repartitionByRange(4, *[F.array_position(F.lit(want), F.col("doc_id"))]).sortWithinPartitions(F.array_position(F.lit(want), F.col("doc_id"))).write.parquet(f"{tmp_path}/several")
    mixed.write.parquet(f"{tmp_path}/mixed")
    for name in ("mixed", "several"):
        rows = corpus_pipeline.stage_bpe(spark, spark.read.parquet(f"{tmp_path}/{name}"), SF).collect()
        assert [r.doc_id for r in sorted(rows, key=lambda r: (r.mix_file, r.mix_row))] == want
        assert len({r.mix_file for r in rows}) > 1 or name == "mixed"
    for r in rows:
        assert hashlib.sha256(struct.pack(f"<{len(r.ids)}I", *r.ids)).hexdigest() == r.ids_sha256 and len(r.ids) == r.n_tokens


def test_stages_keep_null_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = docs.unionByName(docs.limit(2).withColumns({"text": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("bigint")}))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert out.count() > 0, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
