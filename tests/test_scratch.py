"""What operators write inside a scratch block is gone after it."""

import os

from framesift.operators.store import materialize, new_folder, scratch


def test_scratch_deletes_what_was_written(spark):
    kept = materialize(spark.range(3).toDF("a"), "kept")
    with scratch(spark):
        outer = new_folder(spark, "outer")
        with scratch(spark):
            inner = materialize(spark.range(5).toDF("a"), "inner")
            files = inner.inputFiles()
            assert inner.count() == 5 and all(os.path.exists(f.removeprefix("file://")) for f in files)
        assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
        spark.range(1).write.parquet(outer)
        assert os.path.exists(outer.removeprefix("file://"))
    assert not os.path.exists(outer.removeprefix("file://")) and kept.count() == 3
