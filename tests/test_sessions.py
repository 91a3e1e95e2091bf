"""Sessions of a stream as session windows."""

from threatlake.streaming import operators as ST


def test_sessions_need_no_python_and_meet_at_the_gap(spark, tmp_path):
    schema = "seq long, host string, ts timestamp, event_type string, process_name string, pid long, executable string, severity string, score int, summary string, details_json string, fingerprint string"
    row = lambda i, us: f"({i}L, 'h', timestamp_micros({us}L), 'x', 'n{i}', 1L, 'e', 's', {i}, 'm{i}', '{{}}', 'f')"
    beat = "(null, null, timestamp_micros(9000000000L), 'heartbeat', null, null, null, null, null, null, null, null)"
    late = "(null, null, timestamp_micros(99000000000L), 'heartbeat', null, null, null, null, null, null, null, null)"
    names = ", ".join(f.split()[0] for f in schema.split(", "))
    parts = [", ".join([row(1, 0), row(2, 60_000_000), row(3, 120_000_001)]), beat, late]
    for values in parts:
        spark.sql(f"SELECT * FROM VALUES {values} AS t({names})").selectExpr(*[f"CAST({f.split()[0]} AS {f.split()[1]}) AS {f.split()[0]}" for f in schema.split(", ")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = ST.stream_compact(events, 60, "10 seconds")
    assert "InPandas" not in out._jdf.queryExecution().analyzed().toString()
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()
    assert sorted((r.id, r.repeat_count, r.score) for r in got) == [(1, 2, 2), (3, 1, 3)]
