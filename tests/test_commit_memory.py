"""What a task of a committed write holds is bounded by bytes, whatever it is sent."""

import pyarrow as pa
import pyarrow.parquet as pq

from recordloom.operators import commit


def test_row_groups_are_bounded_by_bytes(tmp_path):
    long, short = ["x" * (64 << 10)] * 400, [str(i) for i in range(50)]
    batches = [pa.RecordBatch.from_pydict({"content": long, "k": ["a"] * 300 + ["b"] * 100}), *(pa.RecordBatch.from_pydict({"content": [s], "k": ["b"]}) for s in short)]
    writer = commit.CommittedWriter({"path": f"file://{tmp_path}", "base": "data", "note": "n.json", "keys": "k"})
    written = writer.write(iter(batches))
    assert written.rows == 450 and [f.split("/")[1] for f in written.files] == ["k=a", "k=b"]
    found = [pq.ParquetFile(f"{tmp_path}/{f}") for f in written.files]
    assert [t.read()["content"].to_pylist() for t in found] == [long[:300], long[300:] + short]
    groups = [f.metadata.row_group(i).num_rows for f in found for i in range(f.num_row_groups)]
    assert max(groups) * (64 << 10) <= commit.GROUP_BYTES + (64 << 10) * len(short)
    assert found[1].num_row_groups <= 2  # small batches are gathered


def test_few_rows_are_sent_at_once(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    commit.prepare(spark.range(5000).coalesce(1), f"file://{tmp_path}", "t", "stage", "numbers")
    assert spark.conf.get(key) == before
    commit.publish(f"file://{tmp_path}", "t", "stage", ["numbers"])
    assert commit.read_published(spark, f"file://{tmp_path}", "numbers", "id long, transaction_id string").select("id").distinct().count() == 5000
