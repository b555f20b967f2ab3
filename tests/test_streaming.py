from datetime import datetime, timedelta

from lineloom.streaming import feed

DDL = "commit_id string, author_name string, commit_ts timestamp"


def test_feed_counts_each_commit_once(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(f"c{i}", f"a{i % 2}", t0 + timedelta(hours=7 * i)) for i in range(20)]
    for part in (rows[:10] + rows[8:10], rows[10:] + rows[10:12]):
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = feed.windowed_commits(stream, "1 day", "3 days").writeStream.outputMode("append").format("memory").queryName("feed").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.window_start, r.author_name): r.commits for r in spark.table("feed").collect()}
    want: dict = {}
    for _, a, ts in rows:
        key = (datetime(ts.year, ts.month, ts.day), a)
        want[key] = want.get(key, 0) + 1
    assert got and all(want[k] == n for k, n in got.items())
