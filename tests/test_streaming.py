"""Incremental counts equal those of the whole."""

from pyspark.sql import functions as F

from cohortlens.streaming import incremental


def test_running_counts(spark, tmp_path):
    rows = [(f"s{i}", ["A", "B"] if i % 2 else ["B", "C"]) for i in range(10)]
    df = spark.createDataFrame(rows, "id string, features array<string>")
    for i in range(2):
        df.where(F.substring("id", 2, 1).cast("int") % 2 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = incremental.to_parquet(incremental.running_joint_counts(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("A", "B", 5), ("B", "C", 5)}
    q = incremental.running_prevalence(stream).writeStream.outputMode("complete").format("memory").queryName("prev").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select * from prev").collect()} == {("A", 5), ("B", 10), ("C", 5)}
