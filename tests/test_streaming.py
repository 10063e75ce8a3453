from datetime import datetime, timedelta

from tracequarry.rules.parse import parse_rule
from tracequarry.streaming.hunting import count_in_windows, hunt_stream

RULE = {"name": "Errors", "group": "g", "kind": "json", "level": "low", "status": "stable", "filter": {"condition": "a", "a": {"kind": "error"}}}
SCHEMA = "ts timestamp, kind string, usr string"


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_windows_close_with_the_watermark(spark, tmp_path):
    """Counts of a window come once the watermark has passed it; rows later than that are left out."""
    at = lambda m: datetime(2024, 1, 1, 10) + timedelta(minutes=m)
    folder = tmp_path / "in"
    write(spark, folder, [(at(0), "error", "a"), (at(1), "error", "a"), (at(2), "click", "a"), (at(3), None, "a"), (None, "error", "a")])

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(str(folder))
        counted = count_in_windows(hunt_stream(stream, [parse_rule(RULE)]), "ts", ["usr"], "5 minutes", "10 minutes", least=2)
        counted.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.window_start, r.usr, r.n_hits) for r in spark.read.schema(counted.schema).parquet(str(tmp_path / "out")).collect())

    assert run() == []
    write(spark, folder, [(at(4), "error", "a"), (at(30), "error", "b")])
    assert run() == [(at(0), "a", 3)]
    write(spark, folder, [(at(1), "error", "a"), (at(31), "error", "b"), (at(60), "error", "c")])
    assert run() == [(at(0), "a", 3), (at(30), "b", 2)]
