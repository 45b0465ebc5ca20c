"""Staged stream inputs have files in proportion to their rows."""

from pyspark.sql import functions as F


def test_staged_stream_files_grow_with_the_rows(spark, tmp_path, monkeypatch):
    from ledgerspark.plans import stream_queries as q

    monkeypatch.setattr(q, "FILE_ROWS", 50, raising=False)
    (spark.range(1000).selectExpr("id AS event_id", "timestamp_ntz '2025-01-01 10:00:00' + make_dt_interval(id % 5) AS ts",
                                  "id % 7 AS user_id", "'click' AS event_type", "1.0D AS value", "'{\"k\":1}' AS props")
     .write.parquet(str(tmp_path / "events.parquet")))
    seen = []
    stream = q.jobs.stream_event_dedupe

    def spy(spark, src, schema, sink, ck, max_files=None):
        files = spark.read.parquet(src).groupBy(F.col("_metadata.file_path")).count().collect()
        seen.append((len(files), max(r["count"] for r in files), max_files))
        return stream(spark, src, schema, sink, ck, max_files)

    monkeypatch.setattr(q.jobs, "stream_event_dedupe", spy)
    out = q.stream_event_corrections(spark, str(tmp_path))
    assert seen == [(seen[0][0], seen[0][1], None), (seen[0][0], seen[0][1], 10)]
    assert seen[0][0] == 30 and seen[0][1] <= 100  # 20 files of events and 10 of corrections, in three micro-batches
    got = {(r.run, r.event_id, r.page == "/corrected") for r in out.collect()}
    assert got == {(run, str(k), k % 5 == 0) for run in ("one batch", "many batches") for k in range(1000)}
    assert out.count() == 2000
