from datetime import datetime, timedelta

from quarryframe.streaming import pipelines

T0 = datetime(2025, 1, 1)


def run(stream, spark, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_events_once(spark, tmp_path):
    rows = [("e1", T0), ("e1", T0), ("e2", T0 + timedelta(seconds=1)), (None, T0)]
    spark.createDataFrame(rows, "event_id string, ts timestamp").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("event_id string, ts timestamp").parquet(str(tmp_path / "in"))
    assert sorted(r.event_id for r in run(pipelines.once(s, "event_id", "ts"), spark, "once", "append").collect()) == ["e1", "e2"]


def test_queue_keeps_one_follow_up(spark, tmp_path):
    rows = [("r", k, T0 + timedelta(seconds=n)) for n, k in enumerate(["request", "request", "request", "done", "done"])]
    spark.createDataFrame(rows, "repo_id string, kind string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "q"))
    s = spark.readStream.schema("repo_id string, kind string, at timestamp").parquet(str(tmp_path / "q"))
    last = run(pipelines.queue_states(s), spark, "queue", "update").collect()[-1]
    assert (last.state, last.runs, last.follow_up) == ("idle", 2, False)


def test_changes_per_batch(spark):
    out, held = [], [None]
    keep = lambda df: held.__setitem__(0, spark.createDataFrame(df.collect(), df.schema))
    f = pipelines.changes_per_batch(lambda df, _: out.append(sorted(map(tuple, df.collect()))), lambda: held[0], keep)
    schema = "repo_id string, path string, sha256 string"
    f(spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3")], schema), 0)
    f(spark.createDataFrame([("r", "a", "9"), ("r", "d", "2"), ("r", "e", "5")], schema), 1)
    assert out[1] == [("r", "a", "modify"), ("r", "c", "delete"), ("r", "d", "rename"), ("r", "e", "create")]


def test_every_pair_of_a_hash_is_renamed(spark):
    out, held = [], [None]
    keep = lambda df: held.__setitem__(0, spark.createDataFrame(df.collect(), df.schema))
    f = pipelines.changes_per_batch(lambda df, _: out.append(sorted(map(tuple, df.collect()))), lambda: held[0], keep)
    schema = "repo_id string, path string, sha256 string"
    f(spark.createDataFrame([("r", "a", "1"), ("r", "b", "1"), ("r", "c", "1")], schema), 0)
    f(spark.createDataFrame([("r", "x", "1"), ("r", "y", "1")], schema), 1)
    assert out[1] == [("r", "c", "delete"), ("r", "x", "rename"), ("r", "y", "rename")]
