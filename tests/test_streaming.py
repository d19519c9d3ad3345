import datetime as dt
import random
import shutil

from pyspark.sql import functions as F

from tidelens.operators import sessions
from tidelens.streaming import live_state, streams

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "user_id long, event_time timestamp, event_type string, event_id long"


def write(spark, folder, name, rows):
    data = [(u, T0 + dt.timedelta(minutes=m), k, i) for i, u, m, k in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def test_sessions_drop_rows_behind_the_watermark(spark, tmp_path):
    base = str(tmp_path)
    write(spark, base, "f1", [(0, 1, 0, "a"), (1, 1, 10, "checkout_completed"), (2, 2, 5, "a")])
    write(spark, base, "f2", [(3, 1, 200, "a"), (4, 2, 500, "a")])
    write(spark, base, "f2b", [(8, 3, 505, "a")])  # rows are late against the watermark of the batch before
    write(spark, base, "f3", [(5, 2, 20, "late"), (6, 1, 480, "in time"), (7, 3, 900, "end")])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/*")
    got = {(r["user_id"], r["event_count"], r["converted"]) for r in streams.run_available(streams.session_metrics(stream)).collect()}
    assert got == {(1, 2, True), (2, 1, False), (1, 1, False), (3, 1, False)}
    rows = streams.run_available(streams.session_metrics(stream)).groupBy("user_id").count().collect()
    assert {tuple(r) for r in rows} == {(1, 3), (2, 2), (3, 1)}


def test_live_features_equal_final_sessions(spark, tmp_path):
    base = str(tmp_path)
    write(spark, base, "f1", [(0, 1, 0, "homepage_viewed"), (1, 1, 10, "product_added"), (2, 2, 5, "homepage_viewed")])
    write(spark, base, "f2", [(3, 1, 25, "checkout_completed"), (4, 1, 90, "homepage_viewed")])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/*")
    live = streams.run_available(streams.live_session_features(stream))
    last = live.groupBy("user_id", "session_start_us").agg(F.max("events_in_session").alias("n"), F.max("has_checkout_completed").alias("c"))
    got = sorted((r["user_id"], r["n"], r["c"]) for r in last.collect())
    batch = spark.read.schema(SCHEMA).parquet(f"{base}/*").withColumn("platform", F.lit("ios"))
    want = sorted((r["user_id"], r["event_count"], int(r["converted"])) for r in sessions.sessions(batch).collect())
    assert got == want


def test_live_features_are_ordered_whatever_the_size_of_an_arrow_part(spark, tmp_path):
    base = str(tmp_path)
    at = [k * 13 + k // 10 * 40 for k in (i * 37 % 100 for i in range(100))]  # minutes in a mixed order, with gaps of over 30
    write(spark, base, "f1", [(i, 1, m, "a") for i, m in enumerate(at)])
    write(spark, base, "f2", [(200, 1, max(at) + 5, "homepage_viewed"), (201, 1, max(at) + 90, "a"), (202, 2, max(at), "a")])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/*")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = streams.run_available(streams.live_session_features(stream)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    micro = lambda m: int((T0 + dt.timedelta(minutes=m)).timestamp() * 1_000_000)
    want, last = [], None
    for m in [*sorted(at), max(at) + 5, max(at) + 90]:
        if last is None or m - last > 30:
            start, n = m, 0
        n, last = n + 1, m
        want.append((1, micro(start), micro(m), n, float(min(m - start, 120))))
    want.append((2, micro(max(at)), micro(max(at)), 1, 0.0))
    assert sorted(tuple(r[k] for k in ("user_id", "session_start_us", "event_us", "events_in_session", "session_duration_mins")) for r in got) == sorted(want)
    assert len({w[1] for w in want if w[0] == 1}) > 2


def test_state_processor_equals_tables_over_batches_and_a_restart(spark, tmp_path):
    base = str(tmp_path / "in")
    rng = random.Random(21)
    kinds = ["homepage_viewed", "product_page_viewed", "product_added", "checkout_completed", "other"]
    i, now = 0, 0
    for f in range(4):
        rows = []
        for _ in range(60):
            now += rng.choice([0, 1, 4, 20])
            rows.append((i, rng.randrange(5), now - rng.choice([0, 0, 25, 45]), rng.choice(kinds)))
            i += 1
        write(spark, base, f"f{f}", [(n, u, max(0, m), k) for n, u, m, k in rows])

    def rows_of(df):
        return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())

    def stream(pattern):
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(pattern)

    whole = rows_of(streams.run_available(streams.live_session_features(stream(f"{base}/*"))))
    assert rows_of(streams.run_available(live_state.live_session_features(stream(f"{base}/*")))) == whole
    # stopped after two files, and started again with the others
    part, folder = str(tmp_path / "part"), str(tmp_path / "run")
    shutil.copytree(f"{base}/f0", f"{part}/f0")
    shutil.copytree(f"{base}/f1", f"{part}/f1")
    first = rows_of(streams.run_available(live_state.live_session_features(stream(f"{part}/*")), folder))
    shutil.copytree(f"{base}/f2", f"{part}/f2")
    shutil.copytree(f"{base}/f3", f"{part}/f3")
    assert 0 < len(first) < len(whole)
    assert rows_of(streams.run_available(live_state.live_session_features(stream(f"{part}/*")), folder)) == whole
