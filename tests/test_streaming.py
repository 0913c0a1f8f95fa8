from tabularium.streaming import events as E


def test_batch_equals_sql(spark, sf, duck, same_rows):
    same_rows(E.windowed_batch(spark, sf), duck, E.ORACLES["event_windows"])


def test_stream_counts_each_event_once(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet").select(*E.SCHEMA.names)
    folder = str(tmp_path / "in")
    table.repartition(3).write.parquet(folder)
    table.limit(20).write.mode("append").parquet(folder)  # delivered again
    query = E.write_available(E.once(E.read_events(spark, folder, 100), "60 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == table.select("event_id").distinct().count()
