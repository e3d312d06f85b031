"""The pipeline on planted documents, and every stage on awkward rows."""

import random
import zlib

import corpus_pipeline
import pyarrow as pa
from framelake.llm import common, minhash, pieces

from .rows import documents, empty, near, prose


def corpus(spark, tmp_path):
    rng = random.Random(12)
    clean = [prose(rng, 120) for _ in range(60)]
    toxic = [prose(rng, 60) + " grimble snarkle grimble " + prose(rng, 30) for _ in range(40)]
    copies = [near(rng, clean[0], 2) for _ in range(5)] + [clean[1], clean[1]]
    secret = [prose(rng, 50) + " password=Zx81kQ2mN7vB4cT9 " + prose(rng, 50)]
    texts = [*clean, *toxic, *copies, *secret]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 7}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 100)) for i in range(0, 100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return texts


def test_pipeline_keeps_clean_and_drops_planted(spark, tmp_path):
    texts = corpus(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert ids == set(range(60)) | {107}
    coder = pieces.encoder(pieces.model_path())
    import hashlib

    for r in got:
        if r.doc_id != 107:
            assert r.ids_sha256 == hashlib.sha256(coder.encode(texts[r.doc_id])).hexdigest()
    (masked,) = {r.ids_sha256 for r in got if r.doc_id == 107}
    assert masked == hashlib.sha256(coder.encode(texts[107].replace("Zx81kQ2mN7vB4cT9", "[SECRET]"))).hexdigest()


def test_stages_keep_columns_and_take_awkward_rows(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert {r.k for r in out.collect()} == {"x"}
        assert not stage(spark, empty(spark), str(tmp_path)).collect()
    assert len(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()) == docs.count()


def test_hash_of_fold_is_crc32():
    assert zlib.crc32(b"123") % 5 in range(5) and minhash.BANDS * minhash.ROWS == minhash.REGISTERS


def test_batches_between_spark_and_python_are_small(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")

        def seen(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["bytes", "rows"])

        docs = spark.range(0, 8_000, 1, 1).selectExpr("id AS doc_id", "repeat('lorem ips', 500) AS text")
        pieces.tokenize(docs, "")  # lowers the session's bound before anything runs
        got = docs.mapInArrow(seen, "bytes bigint, rows bigint").collect()
        assert sum(r.rows for r in got) == 8_000 and max(r.bytes for r in got) <= 2 * common.ARROW_BYTES
        assert spark.conf.get(name) == str(common.ARROW_BYTES)
        spark.conf.set(name, "1m")
        pieces.tokenize(docs, "")
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_unused_memory_is_given_back():
    def anonymous():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(x.split()[1]) for x in f if x.startswith("Pss_Anon"))

    blocks = [bytes(5_000) for _ in range(20_000)]  # 100 MB in pieces too small for mappings of their own
    top = bytes(5_000)  # above them, so that freeing alone gives nothing back
    del blocks
    before = anonymous()
    common.release()
    assert anonymous() < before - 50_000 and len(top) == 5_000
