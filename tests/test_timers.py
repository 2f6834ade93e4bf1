"""Jobs with timers: runs by hand, and streams that go on where they stopped."""

import pytest
from pyspark.sql import functions as F

from tessera.streaming import timers as tm


def put(spark, path, k, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.parquet(f"{path}/in/{k}")


def read(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_sweeps(spark, tmp_path):
    path, schema = str(tmp_path), "queue string, at timestamp"
    put(spark, path, 0, [("a", 10), ("a", 20), ("b", 5000), ("a", 9000)], "queue string, at long")
    stream = lambda: tm.sweeps(read(spark, path, schema), ttl=3600, every=600, alert=0)
    first = rows(tm.run(stream(), f"{path}/out"))
    assert first == [("a", 4_200_000, 2, 1, True), ("b", 9_000_000, 1, 0, False)]
    assert rows(tm.run(stream(), f"{path}/out")) == first  # nothing has come: nothing is given again
    put(spark, path, 1, [("a", 20_000), ("b", 100), ("c", 19_999)], "queue string, at long")
    assert rows(tm.run(stream(), f"{path}/out")) == sorted([*first, ("a", 13_200_000, 1, 1, True)])  # b's letter outlived its time before it came


@pytest.mark.parametrize("most", [50, 2])
def test_alerts(spark, tmp_path, most):
    path, schema = str(tmp_path), "document long, at timestamp, text string, source string"
    searches = spark.createDataFrame([(1, True, "ALPHA", "hourly", ""), (2, True, None, "daily", "s"), (3, False, "", "hourly", None)], "search_id long, enabled boolean, query string, frequency string, source string")
    stream = lambda: tm.alerts(read(spark, path, schema).withColumnRenamed("at", "updated_at"), searches, most)
    put(spark, path, 0, [(5, 30, "alpha", "s"), (4, 20, "an Alpha", "t"), (3, 40, "alpha", "t"), (2, 3700, "beta alpha", "t"), (1, 8000, "-", "t")], "document long, at long, text string, source string")
    hourly = [(1, 3_600_000, 3, [4, 5, 3][:most]), (1, 7_200_000, 1, [2])]
    assert rows(tm.run(stream(), f"{path}/out")) == hourly
    put(spark, path, 1, [(9, 7300, "alpha late", "s"), (8, 90_000, "alpha", "s"), (7, 200_000, "end", "t")], "document long, at long, text string, source string")
    got = rows(tm.run(stream(), f"{path}/out"))
    assert (2, 172_800_000, 1, [8]) in got and len([r for r in got if r[0] == 1 and r[1] <= 7_200_000]) == 2
