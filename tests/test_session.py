"""Settings of jobs of several steps."""

import pyarrow as pa
import pytest

from loomwork.session import BATCH_BYTES, CLEANUP, GUESSED, saved, tidy_shuffles


def test_only_counted_tables_are_broadcast(spark, tmp_path):
    rows = saved(spark.range(100).selectExpr("id", "id * 2 AS twice"), f"{tmp_path}/rows")
    spark.conf.set(CLEANUP, "false")
    before = [spark.conf.get(key, None) for key in (BATCH_BYTES, CLEANUP, GUESSED)]
    with pytest.raises(ZeroDivisionError), tidy_shuffles(spark):
        joined = rows.join(rows.withColumnRenamed("twice", "other"), "id")
        assert joined.count() == 100 and "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
        _ = 1 / 0
    assert [spark.conf.get(key, None) for key in (BATCH_BYTES, CLEANUP, GUESSED)] == before


def test_batches_of_long_texts_are_bounded(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    with tidy_shuffles(spark):
        held = spark.range(2_000, numPartitions=1).selectExpr("repeat('x', 10000) AS text").mapInArrow(sizes, "n long").collect()
    assert max(r.n for r in held) < 6 << 20 and sum(r.n for r in held) >= 20_000_000
