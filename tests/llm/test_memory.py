"""What workers hold between tasks, and how much text they get together."""

import numpy as np
import psutil
import pyarrow as pa
import pytest

import corpus_pipeline
from retail_lake.llm import memory


def test_a_task_gives_back_what_it_no_longer_uses():
    own = psutil.Process()
    memory.give_back()

    def run(batches):
        for batch in batches:
            held = [np.ones(1_000) for _ in range(20_000)]  # 160 MB in pieces that the allocator keeps
            last = held[-1]
            del held
            yield batch.append_column("kept", pa.array(last[: batch.num_rows]))
            del last

    before = own.memory_info().rss
    batch = pa.record_batch({"a": [1, 2]})
    out = list(memory.lean(run)(iter([batch, batch])))
    assert [b.num_rows for b in out] == [2, 2] and out[0].column_names == ["a", "kept"]
    assert own.memory_info().rss - before < 80_000_000


def test_memory_is_given_back_if_a_task_fails_or_is_left_early(monkeypatch):
    done = []
    monkeypatch.setattr(memory, "give_back", lambda: done.append(1))

    def fails(batches):
        yield next(batches)
        raise ValueError

    with pytest.raises(ValueError):
        list(memory.lean(fails)(iter([1, 2])))
    left = memory.lean(lambda batches: batches)(iter([1, 2]))
    next(left)
    left.close()
    assert len(done) == 2


@pytest.mark.parametrize(("before", "after"), [("10000", "2000"), ("0", "2000"), ("500", "500")])
def test_stages_take_texts_in_small_batches(spark, before, after):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    spark.conf.set(name, before)
    try:
        assert dict(corpus_pipeline.STAGES)["packing"](spark, docs, "").count() == 1
        assert spark.conf.get(name) == after
    finally:
        spark.conf.unset(name)
