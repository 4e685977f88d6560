"""What a pipeline stage sends to a Python worker at once is bounded by bytes, and cuts change no row."""

import pyarrow as pa
import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    spark.conf.unset(KEY)
    yield
    spark.conf.unset(KEY)


def _largest(docs):
    """Bytes of the largest batch that a worker gets."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch["text"].nbytes])], ["n"])

    return docs.select("text").mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[name for name, _ in corpus_pipeline.STAGES])
def test_batches_are_bounded_by_bytes(spark, unset, stage):
    row = 64 << 10
    docs = spark.range(400).coalesce(1).selectExpr("id as doc_id", f"repeat('x', {row}) as text", "'en' as lang", "'s' as source")
    assert _largest(docs) > 4 * corpus_pipeline.BATCH_BYTES
    stage(spark, docs.limit(0), SF)
    assert _largest(docs) <= corpus_pipeline.BATCH_BYTES + 2 * row


def test_a_setting_of_the_session_stays(spark, unset):
    spark.conf.set(KEY, "1m")
    corpus_pipeline.exact_dedup(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert spark.conf.get(KEY) == "1m"


def test_small_batches_change_no_row(spark, unset):
    def rows():
        out = corpus_pipeline.run(spark, SF)
        return sorted(map(tuple, out.drop("sequence_id", "offset").collect()))

    spark.conf.set(KEY, str(64 << 20))
    whole = rows()
    spark.conf.set(KEY, "4k")
    assert rows() == whole and whole
