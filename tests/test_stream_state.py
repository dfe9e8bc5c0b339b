"""The state that a stream of events makes is that of the whole table, however the events are split and ordered."""

import random

import pytest

from tessera.operators import registry as R
from tessera.streaming import ingest, state

SCHEMA = "run_id long, event_no long, status string, score double, n int"


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_batch_view(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = [(rng.randrange(6), n, rng.choice(["pending", "completed", None]), rng.choice([None, n / 3]), rng.choice([None, None, n])) for n in range(60)]
    expected = {tuple(r) for r in R.current(spark.createDataFrame(events, SCHEMA)).select("run_id", "status", "score", "n").collect()}
    rng.shuffle(events)
    events += events[:10]  # some come twice
    previous = spark.conf.get(state.STORE)
    try:
        for at in range(0, len(events), 25):
            spark.createDataFrame(events[at : at + 25], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.source(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
        states = state.newest_values(stream)
        query = states.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
    finally:
        spark.conf.set(state.STORE, previous)
    found = state.current_of(spark.read.parquet(f"{tmp_path}/out")).select("run_id", "status", "score", "n")
    assert {tuple(r) for r in found.collect()} == expected
