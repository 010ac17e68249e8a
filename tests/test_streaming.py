from pyspark.sql import functions as F

from quernstone.operators.select import Key
from quernstone.streaming.observations import StreamingSelection, before_cutoff, windowed_counts


def test_files_as_micro_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "ord long, k string")
    later = spark.createDataFrame([(4, "b"), (5, "c")], "ord long, k string")
    for n, part in enumerate((rows, later)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    state = StreamingSelection(spark, [Key("repeat", F.col("k"))], "ord", root=f"file://{tmp_path}/state")
    for n in (0, 1):  # one page arrives after the other; the checkpoint carries the stream's place
        stream = spark.readStream.schema("ord long, k string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/{n}")
        held = len(state.numbers())
        stream.writeStream.foreachBatch(lambda batch, i, held=held: state.process(batch, held + i)).option("checkpointLocation", f"{tmp_path}/c{n}").trigger(availableNow=True).start().awaitTermination()
    want = {1: True, 2: True, 3: False, 4: False, 5: True}
    assert {r.ord: r.accepted for r in state.selected().collect()} == want
    # another process that finds the same state takes up there: a replayed batch changes nothing
    again = StreamingSelection(spark, [Key("repeat", F.col("k"))], "ord", root=f"file://{tmp_path}/state")
    again.process(later, 1)
    assert {r.ord: r.accepted for r in again.selected().collect()} == want
    again.process(spark.createDataFrame([(6, "c"), (7, "d")], "ord long, k string"), 2)
    assert {r.ord: r.accepted for r in again.selected().collect()} == want | {6: False, 7: True}
    few = StreamingSelection(spark, [Key("repeat", F.col("k"))], "ord", quota=2)
    few.process(rows, 0)
    few.process(later, 1)
    assert few.numbers() == [0, 1] and sorted(r.ord for r in few.selected().where("accepted").collect()) == [1, 2]


def test_windows_and_late_rows(spark, tmp_path):
    make = lambda ts: spark.createDataFrame([(t,) for t in ts], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    for n, part in enumerate((make(["2024-01-01 00:01:00", "2024-01-01 00:02:00"]), make(["2024-01-01 01:00:00"]), make(["2024-01-01 00:03:00", "2024-01-01 03:00:00"]))):
        part.coalesce(1).write.parquet(f"{tmp_path}/s/part{n}.parquet")
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/s/*")
    query = windowed_counts(stream, "ts", "10 minutes", "5 minutes").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"{tmp_path}/cs").start()
    query.processAllAvailable()
    query.stop()
    got = {str(r.window_start): r.n for r in spark.table("windows").collect()}
    assert got["2024-01-01 00:00:00"] in (2, 3) and got["2024-01-01 01:00:00"] == 1
    assert before_cutoff(make(["2024-01-01 00:00:00", "2024-01-02 00:00:00"]), "ts", "2024-01-02").count() == 1
