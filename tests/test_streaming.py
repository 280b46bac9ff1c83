from pyspark.sql import functions as F

from quire.operators import reader
from quire.streaming.reader import kept_notes, notes_stream, recent_stream, toggled_stream, windowed_activity


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i % 3, f"k{(i * 7) % 13}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "user_id long, key string, event_id long").withColumn("ts", F.timestamp_seconds(F.col("event_id") % 50))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = {}

    def keep(batch, _):
        for r in batch.collect():
            last.setdefault(r.user_id, {})
        for user in {r.user_id for r in batch.collect()}:
            last[user] = {(r.key, r.ts, r["rank"]) for r in batch.collect() if r.user_id == user}

    q = recent_stream(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {}
    for r in reader.recent(df, "user_id", "key", "ts", "event_id").collect():
        want.setdefault(r.user_id, set()).add((r.key, r.ts, r["rank"]))
    assert last == want
    out = {}
    q = toggled_stream(stream, "user_id", "key").writeStream.outputMode("complete").foreachBatch(lambda b, _: out.update(x={tuple(r) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert out["x"] == {tuple(r) for r in reader.toggled(df, "user_id", "key").collect()}


def test_windows_equal_batch(spark, tmp_path):
    rows = [(f"k{i % 3}", i * 700) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_activity(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in windowed_activity(df).collect()}
    last = max(r[0] for r in want)
    # A window is given out once the watermark has passed its end.
    assert {r for r in want if r[0] < last} - got <= {r for r in want if (last - r[0]).total_seconds() <= 3600} and got <= want and len(got) > 50


def test_notes_are_saved_when_their_writer_rests(spark, tmp_path):
    """Edits in batches: only what stands when nothing was typed for a while comes out, deletes for blank text, nothing twice."""
    ms = lambda x: F.expr(f"timestamp_millis({x})")
    batches = [
        [(1, "a", "d", 0), (1, "a", "dr", 100), (1, "a", " draft ", 200), (2, "b", "kept", 50), (1, "a", "too early", 150)],
        [(1, "a", "draft two", 400), (3, "c", "  ", 300), (9, "tick", "x", 2_000)],
        [(1, "a", "draft two", 4_000), (2, "b", " ", 4_100), (9, "tick", "xy", 9_000)],
        [(2, "b", "again", 9_500), (9, "tick", "xyz", 20_000)],
        [(9, "tick", "end", 40_000)],
    ]
    rows, n = [], 0
    for i, batch in enumerate(batches):
        numbered = [(u, r, t, at, n + k) for k, (u, r, t, at) in enumerate(batch)]
        n += len(batch)
        rows += numbered
        spark.createDataFrame(numbered, "user_id long, ref string, text string, at long, event_id long").select("user_id", "ref", "text", ms("at").alias("ts"), "event_id").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = []
        for i in range(len(batches)):  # each run goes on from the checkpoint of the one before
            stream = spark.readStream.schema("user_id long, ref string, text string, ts timestamp, event_id long").parquet(str(tmp_path / "in" / "*"))
            if i + 1 < len(batches):
                later = [tmp_path / "in" / f"{j}" for j in range(i + 1, len(batches))]
                for f in later:
                    f.rename(tmp_path / f.name)
            q = notes_stream(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend((r.user_id, r.ref, r.text) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            for j in range(i + 1, len(batches)):
                (tmp_path / f"{j}").rename(tmp_path / "in" / f"{j}")
    finally:
        spark.conf.unset(name)
    assert [x for x in out if x[0] == 1] == [(1, "a", "draft two")]
    assert [x for x in out if x[0] == 2] == [(2, "b", "kept"), (2, "b", None), (2, "b", "again")]
    assert not [x for x in out if x[0] == 3]
    notes = {}
    for u, r, t in out:
        notes.pop((u, r), None)
        if t is not None:
            notes[u, r] = t
    df = spark.createDataFrame(rows, "user_id long, ref string, text string, at long, event_id long").withColumn("ts", ms("at"))
    want = {(r.user_id, r.ref): r.text for r in kept_notes(df).collect()}
    assert {k: v for k, v in notes.items() if k[0] != 9} == {k: v for k, v in want.items() if k[0] != 9} and notes[9, "tick"] == "xyz"
