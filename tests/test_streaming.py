"""Streams against their batch twins, in several triggers."""

from swatchwork.sources import adapters as A
from swatchwork.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def test_latest_state_stream(spark, tmp_path):
    jobs = A.jobs(spark, SF)
    src = str(tmp_path / "in")
    for k in range(2):
        jobs.filter(f"event_id % 2 = {k}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(jobs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = J.stream_latest_state(stream, "400 days").writeStream.format("memory").queryName("latest").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {}
    for r in spark.table("latest").collect():
        if r.events > got.get(r.job_id, (0,))[0]:
            got[r.job_id] = (r.events, r.status, r.event_id)
    assert got == {r.job_id: (r.events, r.status, r.event_id) for r in J.latest_state(jobs).collect()}


def test_windowed_counts_stream(spark, tmp_path):
    jobs = A.jobs(spark, SF)
    src = str(tmp_path / "in")
    jobs.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(jobs.schema).parquet(src)
    q = J.windowed_counts(stream, "1 day", "1 day").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert sorted(spark.table("counts").collect()) == sorted(J.windowed_counts(jobs, "1 day").collect())


def test_watch_folder(spark, tmp_path):
    src, point = tmp_path / "drop", str(tmp_path / "state")
    src.mkdir()

    def run(name):
        q = J.watch_folder(spark, str(src)).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{point}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).count()

    (src / "a.png").write_bytes(b"x")
    (src / "b.txt").write_bytes(b"x")
    assert run("first") == 1


def _two_runs(spark, rows, make, tmp_path, name):
    """The earlier half of ``rows`` in one run, the later one in a second run that starts from the
    checkpoint of the first; all rows that both put out."""
    src, sink = str(tmp_path / f"{name}_in"), str(tmp_path / f"{name}_out")
    middle = rows.selectExpr("percentile_approx(ts, 0.5) AS m").first().m
    for half in ("ts <= ", "ts > "):
        rows.filter(f"{half} TIMESTAMP '{middle}'").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(rows.schema).parquet(src)
        q = make(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / f"{name}_at")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
    return spark.read.parquet(sink).collect()


def _timed(spark):
    return A.jobs(spark, SF).selectExpr("event_id", "cast(ts AS timestamp) AS ts", "job_id", "status")


def test_open_jobs_stream(spark, tmp_path):
    jobs = _timed(spark)
    got = {}
    for r in _two_runs(spark, jobs, lambda s: J.stream_open_jobs(s, 60, "400 days"), tmp_path, "open"):
        got[r.job_id] = max(got.get(r.job_id, (-1, "", "")), (r.event_id, r.status, r.kind))
    last = {r.job_id: (r.event_id, r.status, "closed" if r.status in J.TERMINAL else "open") for r in J.latest_state(jobs).collect()}
    assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in last.items()}
    assert {k for k, v in got.items() if v[2] == "open"} == {r.job_id for r in J.open_jobs(jobs).collect()}


def test_stalled_jobs(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, "running"), (2, "2024-01-01 00:00:00", 2, "done"), (3, "2024-03-01 00:00:00", 3, "queued"), (4, "2024-03-01 00:00:00", 4, "queued")]
    jobs = spark.createDataFrame(rows, "event_id long, ts string, job_id long, status string").selectExpr("event_id", "cast(ts AS timestamp) AS ts", "job_id", "status")
    got = _two_runs(spark, jobs, lambda s: J.stream_open_jobs(s, 60, "1 day"), tmp_path, "stalled")
    assert {(r.job_id, r.kind) for r in got} == {(1, "open"), (1, "stalled"), (2, "closed"), (3, "open"), (4, "open")}


def test_versions_stream(spark, tmp_path):
    jobs = _timed(spark)
    got = _two_runs(spark, jobs, lambda s: J.stream_versions(s, 3), tmp_path, "versions")
    last = {}
    for r in got:
        if r.versions is not None and r.seen > last.get(r.job_id, (0,))[0]:
            last[r.job_id] = (r.seen, r.versions)
    want = {}
    for r in sorted(J.keep_versions(jobs, 3).collect()):
        want.setdefault(r.job_id, []).append(r.event_id)
    assert {k: v for k, (_, v) in last.items() if v} == want
    assert sorted((r.job_id, r.failed_id, r.restored_id or -1) for r in got if r.failed_id is not None) == sorted((r.job_id, r.event_id, r.restored_id or -1) for r in J.restored(jobs).collect())


def test_timer_stream(spark, tmp_path):
    clicks = A.table(spark, SF, "events").selectExpr("user_id", "cast(ts AS timestamp) AS ts", "event_id", "event_type")
    got = _two_runs(spark, clicks, lambda s: J.stream_timer_pairs(s, "400 days"), tmp_path, "timer")
    assert sorted(got) == sorted(J.timer_pairs(clicks).collect())


def test_late_events_are_counted_and_versions_expire(spark, tmp_path):
    import datetime

    at = lambda minutes: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)
    make = lambda *rows: spark.createDataFrame([(i, at(m), j, s) for i, m, j, s in rows], "event_id long, ts timestamp, job_id long, status string")

    def feed(name, stream, parts):
        src, late, out = str(tmp_path / f"{name}_in"), 0, str(tmp_path / f"{name}_out")
        for rows in parts:
            rows.coalesce(1).write.mode("append").parquet(src)
            q = stream(spark.readStream.schema(rows.schema).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}_at")).outputMode("append").trigger(availableNow=True).start()
            assert q.awaitTermination(90)
            late += J.late_events(q)
        return late, spark.read.parquet(out).collect()

    late, _ = feed("late", lambda s: J.stream_open_jobs(s, 60, "10 minutes"), [make((1, 0, 1, "queued")), make((2, 600, 2, "queued")), make((3, 5, 1, "running"), (4, 601, 2, "done"))])
    assert late == 1
    # The watermark passes job 7 by more than its expiry before it fails; job 8 keeps its success.
    parts = [make((1, 0, 7, "done")), make((2, 100, 8, "done")), make((3, 101, 7, "failed"), (4, 102, 8, "failed"))]
    _, rows = feed("old", lambda s: J.stream_versions(s, 3, 30, "10 minutes"), parts)
    assert [r.restored_id for r in rows if r.failed_id == 4] == [2]
    assert [r.restored_id for r in rows if r.failed_id == 3] == [None]
