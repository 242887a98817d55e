"""Filter state of a stream against the batch result."""

import random

import pytest
from pyspark.sql import functions as F

from parafold.operators import series
from parafold.streaming import STATE_STORE, complementary_stream, read_lines, save_batches

SCHEMA = "user_id long, ts timestamp, rate double, measured double"


def line(user, second, rate, measured):
    return f"{user},2024-01-01 {second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d},{rate},{measured}\n"


@pytest.fixture
def state_store(spark):
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stream_equals_batch(spark, tmp_path, state_store):
    """Three batches, a restart from the checkpoint between them, a late row, an idle key that begins anew."""
    rng = random.Random(8)
    rows = sorted(((u, s, round(rng.uniform(-1, 1), 3), round(rng.uniform(-5, 5), 3)) for u in (1, 2, 3) for s in rng.sample(range(600), 60)), key=lambda r: r[1])
    parts = [[r for r in rows if a <= r[1] < b] for a, b in ((0, 200), (200, 400), (400, 600))]
    parts[1].insert(0, (1, 50, 9.0, 9.0))  # later rows of this key were in the batch before
    (tmp_path / "in").mkdir()
    got = {}

    def run():
        stream = complementary_stream(read_lines(spark, str(tmp_path / "in"), SCHEMA), 0.9, "1 hour", 7200.0)
        out = tmp_path / "out"
        job = save_batches(stream, str(tmp_path / "check"), lambda df, n: df.write.mode("overwrite").parquet(str(out / f"batch={n}")))
        job.awaitTermination(120)
        assert job.exception() is None
        return {(r.key, r.micros): (r.angle, r.late) for r in spark.read.parquet(str(out)).collect()}

    for n, part in enumerate(parts):
        (tmp_path / "in" / f"{n}.csv").write_text("".join(line(*r) for r in part))
        got = run()  # each is a new query on the same checkpoint
    table = spark.createDataFrame([(u, s, rate, m) for u, s, rate, m in rows], "user_id long, s long, rate double, measured double")
    w = series.number_rows(table, ["s"], "user_id", "i")
    dt = series.with_lag(w, "i", ["s"], "user_id").withColumn("dt", F.coalesce(F.col("s") - F.col("before_s"), F.lit(0)).cast("double"))
    want = {(r.user_id, r.s): r.angle for r in series.complementary_filter(dt, 0.9, order=["s"]).collect()}
    start = spark.sql("SELECT unix_micros(timestamp '2024-01-01 00:00:00')").first()[0]
    seen = {(k, (m - start) // 1_000_000): v for (k, m), v in got.items()}
    assert seen.pop((1, 50)) == (None, True) or (1, 50) in want
    assert {k: v[0] for k, v in seen.items()} == pytest.approx(want, abs=1e-9) and not any(v[1] for v in seen.values())
    # Beyond the idle time a key is forgotten: its next angle is as measured.
    for n, (second, measured) in enumerate([(30_000, 1.0), (60_000, 4.0)]):
        (tmp_path / "in" / f"later{n}.csv").write_text(line(2, second, 0.5, measured) + line(9, second, 0.0, 0.0))
        got = run()
    assert got[2, start + 60_000 * 1_000_000][0] == 4.0
