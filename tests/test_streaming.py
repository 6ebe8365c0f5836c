"""Stream views against the same views of the whole table."""

import pytest

from tidemark.streaming import events as ev

ROWS = "select * from values (1, timestamp '2020-01-01 00:10:00', 7, 'a', 1.0), (2, timestamp '2020-01-01 00:20:00', 7, 'a', 2.0), (3, timestamp '2020-01-01 01:50:00', 7, 'b', 4.0), (4, timestamp '2020-01-01 00:15:00', 8, 'a', 8.0) t(event_id, ts, user_id, event_type, value)"


@pytest.mark.parametrize("view", [ev.windowed_totals, ev.sessions, lambda x: ev.first_versions(x, "event_id")])
def test_a_stream_gives_the_rows_of_the_table(spark, tmp_path, view):
    spark.sql(ROWS).coalesce(1).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    name = f"t{abs(hash(str(tmp_path)))}"
    q = view(stream).writeStream.format("memory").queryName(name).outputMode("append" if "event_id" in view(table).columns else "complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, view(table).collect()))
