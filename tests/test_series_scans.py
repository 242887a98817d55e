"""Numbering, carried values, scans, quantiles and alignment against plain Python."""

import bisect
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from parafold.operators import edits, filters, lookups, ordering, quantiles, reports, segments, sensing, series
from parafold.functions import lines_of
from parafold.sources import write_edited


@pytest.fixture(params=["adaptive", "plain"])
def planned(spark, request):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", str(request.param == "adaptive").lower())
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", before)


def hot_rows(seed=1, n=3000):
    """(k, o, id, v): one key has half of the rows, ties and nulls in all columns."""
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, None, 2, 3]), rng.choice([None, *range(50)]), i, rng.choice([None, None, i])) for i in range(n)]


def in_order(data):
    return sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2]))


def numbers_of(data):
    seen, out = {}, {}
    for k, _, i, _ in in_order(data):
        out[i] = seen.get(k, 0)
        seen[k] = out[i] + 1
    return out


def test_numbers_and_neighbours(planned):
    data = hot_rows()
    rows = planned.createDataFrame(data, "k long, o long, id long, v long").withColumns({"part": F.lit("clash"), "row": F.lit(1), "nth": F.lit(2)})
    numbers = ordering.number_rows(rows.repartition(7), ["o", "id"], "k").cache()
    want = numbers_of(data)
    assert numbers.columns == [*rows.columns, "number"] and {r.id: r.number for r in numbers.collect()} == want
    whole = {i: n for n, (_, _, i, _) in enumerate(sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2])))}
    assert {r.id: r.all for r in ordering.number_rows(rows, ["o", "id"], name="all").collect()} == whole
    last, before, carried, lagged = {}, {}, {}, {}
    for k, _, i, v in in_order(data):
        last[k] = last.get(k) if v is None else v
        carried[i], lagged[i] = last[k], before.get(k)
        before[k] = i
    for block in (4, 4096):
        assert {r.id: r.carried for r in ordering.carry_last(numbers, "number", F.col("v"), "k", block=block).collect()} == carried
        assert {r.id: r.before_id for r in ordering.with_lag(numbers, "number", ["id"], "k", block).collect()} == lagged
    assert ordering.number_rows(rows.limit(0), ["o"], "k").count() == ordering.carry_last(numbers.limit(0), "number", F.col("v"), "k").count() == 0
    with pytest.raises(ValueError):
        ordering.number_rows(rows, ["o"], name="ID")


@pytest.mark.parametrize("cached", [False, True])
def test_long_table(planned, cached):
    """Every row of a long table has its own number, whatever is evaluated twice."""
    body = planned.range(100_000).select(((F.col("id") * 7919) % 100_003).alias("o"), F.array(F.col("id").cast("string")).alias("cells"))
    out = reports.table_rows(["id"], body, "o")
    out = out.cache() if cached else out
    got = out.where("row > 0").join(body.select("o", F.col("cells")[0].alias("text")), "text")
    order = {o: n + 1 for n, o in enumerate(sorted(r.o for r in body.collect()))}
    pairs = [(r.o, r.row) for r in got.collect()]
    assert len(pairs) == 100_000 and all(order[o] == n for o, n in pairs)


def test_one_key_over_all_tasks(spark):
    rows = spark.range(200_000).select("id", F.lit(5).alias("k"), F.hash("id").alias("o"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would go to one task
    try:
        got = ordering.number_rows(rows, ["o", "id"], "k").withColumn("task", F.spark_partition_id())
        assert got.groupBy("task").count().where("count > 60000").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.agg(F.countDistinct("number"), F.min("number"), F.max("number")).first() == (200_000, 0, 199_999)


def readings():
    rng = random.Random(2)
    return [(u, i, rng.gauss(0, 1) if rng.random() > 0.03 or i == 0 else None, 0.1 + 0.01 * (i % 3)) for u, n in ((1, 1500), (None, 300), (2, 1), (3, 40)) for i in range(n)]


def same(got, want):
    return got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)


@pytest.mark.parametrize("block", [4, 256])
def test_filters_by_loop(spark, block):
    data = readings()
    rows = spark.createDataFrame(data, "user_id long, ts long, value double, dt double").withColumns({"event_id": F.col("ts"), "g": F.lit("clash"), "i": F.lit(1), "z": F.lit(2)})
    b0, b1, b2, a1, a2 = filters.butterworth(2.0, 50.0)
    state, first, low, kalman = {}, {}, {}, {}
    for u, i, x, dt in data:
        s = state.setdefault(u, {})
        if x is not None:
            s["f"] = 0.7 * s["f"] + 0.3 * x if "f" in s else x
            x1, x2, y1, y2 = s.get("l", (x, x, x, x))
            y = b0 * x + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            s["l"] = x, x1, y, y1
        first[u, i], low[u, i] = (None, None) if x is None else (s["f"], s["l"][2])
        inn = None
        if "k" not in s:
            m, p = np.array([x, 0.0]), np.eye(2)
        else:
            m, p = s["k"]
            f = np.array([[1, dt], [0, 1]])
            m, p = f @ m, f @ p @ f.T + 0.09 * np.array([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2]])
            if x is not None:  # the covariance in Joseph's form
                inn, gain = x - m[0], p[:, 0] / (p[0, 0] + 0.5)
                keep = np.eye(2) - np.outer(gain, [1, 0])
                m, p = m + gain * inn, keep @ p @ keep.T + 0.5 * np.outer(gain, gain)
        s["k"] = m, p
        kalman[u, i] = m[0], m[1], p[0, 0], inn
    get = lambda df, c: {(r.user_id, r.ts): r[c] for r in df.collect()}
    assert same(get(filters.first_order_filter(rows, 0.3, block=block), "smoothed"), first)
    assert same(get(filters.low_pass(rows, 2.0, 50.0, block=block), "smoothed"), low)
    run = filters.height_kalman(rows, 0.3, 0.5, F.col("dt"), block=block)
    assert run.columns == [*rows.columns, "height", "velocity", "height_var", "innovation"]
    run = run.cache()
    for n, c in enumerate(("height", "velocity", "height_var", "innovation")):
        assert same(get(run, c), {k: v[n] for k, v in kalman.items()})
    assert filters.low_pass(rows.limit(0), 2.0, 50.0).count() == 0


def test_noise_sweep_flags(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(1, i, float(i * i) + rng.gauss(0, 1)) for i in range(200)], "user_id long, ts long, value double").withColumn("event_id", F.col("ts"))
    got = {r.factor: (r.n, r.diverged) for r in filters.noise_sweep(rows, [1e-6, 100.0], 1.0, 1.0, F.lit(1.0), 50.0).collect()}
    assert got == {1e-6: (199, True), 100.0: (199, False)}
    with pytest.raises(ValueError):
        filters.low_pass(rows, 30.0, 50.0)


def test_noise_sweep_numbers_each_row_once(spark, monkeypatch):
    """As many rows are numbered as there are, whatever the number of factors; each run is that of its factor alone, with null readings and keys."""
    rng, asked = random.Random(6), []
    table = [(None if i % 3 == 0 else i % 2, i, None if rng.random() < 0.2 else rng.gauss(0, 3)) for i in range(150)]
    rows = spark.createDataFrame(table, "user_id long, ts long, value double").withColumn("event_id", F.col("ts"))
    number_rows = filters.number_rows
    monkeypatch.setattr(filters, "number_rows", lambda own, *rest: asked.append(own.count()) or number_rows(own, *rest))
    factors = [0.1, 1.0, 30.0]
    got = {(r.user_id, r.factor): (r.n, r.rms_innovation) for r in filters.noise_sweep(rows, factors, 0.5, 0.8, F.lit(0.3), 5.0, block=4).collect()}
    assert asked == [150] and len(got) == 9
    for f in factors:
        one = filters.height_kalman(rows, 0.5, 0.8, F.lit(0.3), block=4, factor=F.lit(f)).groupBy("user_id").agg(F.count("innovation").alias("n"), F.sqrt(F.avg(F.col("innovation") * F.col("innovation"))).alias("rms"))
        for r in one.collect():
            assert got[r.user_id, f] == (r.n, r.rms and pytest.approx(r.rms, rel=1e-12))


@pytest.mark.parametrize("field", [(), ("mx", "my", "mz")])
def test_mahony_by_rows(spark, field):
    """A key longer than a batch, a null reading, nulls of the field, readings of no length."""
    rng = random.Random(6)
    names = ["gx", "gy", "gz", "ax", "ay", "az", "dt", "mx", "my", "mz"]
    data = [(u, i, *[rng.gauss(0, 0.3) for _ in range(3)], rng.gauss(0, 0.1), rng.gauss(0, 0.1), 1.0, 0.02, 0.4, rng.gauss(0, 0.1), None if i % 9 == 0 else -0.3) for u in (1, None, 2) for i in range(300 if u == 1 else 20)]
    data += [(2, 20, 0.1, 0.1, 0.1, 0.0, 0.0, 0.0, 0.02, 0.0, 0.0, 0.0), (2, 21, None, 0.1, 0.1, 0.0, 0.0, 1.0, 0.02, 0.1, 0.0, 0.0), (2, 22, 0.1, 0.1, 0.1, 0.0, 0.0, 1.0, 0.02, 0.1, 0.0, 0.0)]
    rows = spark.createDataFrame(data, "user_id long, ts long, " + ", ".join(f"{n} double" for n in names)).withColumns({"event_id": F.col("ts"), "row": F.lit("clash")})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {(r.user_id, r.ts): tuple(r)[-7:] for r in filters.mahony(rows.repartition(5), names[:3], names[3:6], "dt", field).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    state = {}
    for u, i, *v in data:
        q, bias = state.get(u, ((1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0)))
        if None in v[:7]:
            assert got[u, i] == (None,) * 7
            continue
        seen = tuple(v[7:]) if field and None not in v[7:] else None
        state[u] = q, bias = filters.mahony_step(q, bias, tuple(v[:3]), tuple(v[3:6]), seen, v[6], 1.0, 0.1)
        assert got[u, i] == (*q, *bias) and math.isclose(sum(x * x for x in q), 1, abs_tol=1e-12)


def test_mahony_finds_level_and_bias(spark):
    """At rest, tilted, with a biased gyro: the predicted gravity becomes the measured one and the bias is found."""
    tilt = (math.sin(0.4), 0.0, math.cos(0.4))
    q, bias = (1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0)
    for _ in range(20_000):
        q, bias = filters.mahony_step(q, bias, (0.05, -0.02, 0.0), tilt, None, 0.02, 1.0, 0.1)
    assert filters._turn(q, (0.0, 0.0, 1.0)) == pytest.approx(tilt, abs=1e-3) and bias[:2] == pytest.approx((0.05, -0.02), abs=2e-2)


@pytest.mark.parametrize("few,buckets", [(4096, 1024), (3, 4)])
def test_exact_quantiles(spark, few, buckets):
    rng = random.Random(7)
    groups = {1: [rng.gauss(0, 1) for _ in range(400)], 2: [5.0] * 300 + [1e300, -1e300, 7.0], None: [2.0**-i for i in range(200)], 3: [1.0], 4: []}
    data = [(k, v) for k, vs in groups.items() for v in vs] + [(4, None), (1, None), (1, math.nan), (2, math.inf)]
    rows = spark.createDataFrame(data, "k long, v double").withColumn("g", F.lit("clash"))
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {r.k: (r.n, [r[f"q{i}"] for i in range(5)]) for r in quantiles.exact_quantiles(rows, "k", "v", shares, few, buckets).collect()}
    assert got.pop(4) == (0, [None] * 5)
    for k, (n, q) in got.items():
        assert n == len(groups[k]) and q == pytest.approx(np.quantile(groups[k], shares).tolist(), rel=1e-12, abs=1e-300)
        assert q[2] == pytest.approx(statistics.median(groups[k]), rel=1e-12)
    assert quantiles.exact_quantiles(rows.limit(0), None, "v", [0.5]).count() == 0


def test_alignment_by_bisection(spark):
    rng = random.Random(9)
    left = [(rng.choice([1, 1, 1, 2, None, 7]), rng.randint(0, 400), i) for i in range(500)]
    right = [(rng.choice([1, 1, 2, None]), rng.randint(0, 400), rng.randint(0, 9), "w") for _ in range(300)]
    a = spark.createDataFrame(left, "k long, t long, id long").withColumns({"_side": F.lit("mine"), "v": F.lit("x"), "side": F.lit(3)})
    b = spark.createDataFrame(right, "k long, t long, v long, w string")
    points = {}
    for k, t, v, w in right:
        points.setdefault(k, {})[t] = max(points.get(k, {}).get(t, (-1, "")), (v, w))
    last, near = {}, {}
    for k, t, i in left:
        own = points.get(k, {})
        times = sorted(own)
        n = bisect.bisect_right(times, t)
        back, ahead = (times[n - 1] if n else None), next((x for x in times if x >= t), None)
        last[i] = own[back] if back is not None else (None, None)
        pick = ahead if back is None or (ahead is not None and ahead - t < t - back) else back
        near[i] = own[pick] if pick is not None else (None, None)
    for block in (8, 4096):
        out = segments.align_last(a, b, "k", "t", ["v", "w"], block)
        assert out.columns == [*a.columns, "last_v", "last_w"] and {r.id: (r.last_v, r.last_w) for r in out.collect()} == last
        assert {r.id: (r.nearest_v, r.nearest_w) for r in segments.align_nearest(a, b, "k", "t", ["v", "w"], block=block).collect()} == near
    assert all(r.nearest_v is None for r in segments.align_nearest(a, b.withColumn("t", F.col("t") + 10_000), "k", "t", ["v"], 5).collect())


def test_zero_velocity_runs(spark):
    """Rest, movement, rest: runs by brute force over windows, over several blocks."""
    rng = random.Random(11)
    data = [(u, i, 9.8 + (rng.gauss(0, 2) if 40 <= i % 100 < 70 else rng.gauss(0, 0.01)), 0.01 if i != 20 else None) for u in (1, None) for i in range(300)]
    rows = spark.createDataFrame(data, "user_id long, ts long, a double, w double").withColumn("event_id", F.col("ts"))
    got = sorted(((r.user_id, r.first, r.last, r.n) for r in segments.zero_velocity_segments(rows, ["a"], ["w"], 5, 0.05, 0.1, 3, block=16).collect()), key=repr)
    want = []
    for u in (1, None):
        own = [(a, w) for k, _, a, w in data if k == u]
        calm = [i >= 4 and None not in [w for _, w in own[i - 4 : i + 1]] and statistics.pstdev([a for a, _ in own[i - 4 : i + 1]]) <= 0.05 for i in range(300)]
        start = None
        for i, c in enumerate([*calm, False]):
            if c and start is None:
                start = i
            if not c and start is not None:
                if i - start >= 3:
                    want.append((u, start, i - 1, i - start))
                start = None
    assert got == sorted(want, key=repr) and len(want) >= 6


def test_windows_and_lengths(spark):
    data = [(u, i, float((i * 7) % 5) if i % 11 else None) for u in (1, None) for i in range(50 if u else 6)]
    rows = spark.createDataFrame(data, "user_id long, ts long, value double").withColumn("event_id", F.col("ts"))
    got = {(r.user_id, r.window): (r.begins, r["values"]) for r in series.sliding_windows(rows, 8, 3).collect()}
    own = {u: [v for k, _, v in data if k == u] for u in (1, None)}
    assert got == {(u, b // 3): (b, own[u][b : b + 8]) for u in own for b in range(0, len(own[u]) - 7, 3)}
    gaps = {r.user_id: r.length for r in series.track_length(rows, "user_id", ["ts"], "ts", "ts").collect()}
    assert gaps == pytest.approx({1: 49 * math.sqrt(2), None: 5 * math.sqrt(2)})
    wide = {r.user_id for r in series.sliding_windows(rows, 2, 5).collect()}
    assert wide == {1, None}


def test_nearest_beyond_reach(spark):
    rng = random.Random(12)
    track = [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(60)] + [(None, 1.0)]
    points = [(i, rng.uniform(-50, 60), rng.uniform(-50, 60)) for i in range(80)] + [(100, None, 1.0), (101, track[0][0], track[0][1])]
    a, b = spark.createDataFrame(points, "id long, x double, y double").withColumn("cx", F.lit("clash")), spark.createDataFrame(track, "x double, y double")
    got = {r.id: r.distance for r in sensing.nearest_error(a, b, 0.5).collect()}
    want = {i: None if x is None else min(math.hypot(x - u, y - v) for u, v in track if u is not None) for i, x, y in points}
    assert got.keys() == want.keys() and got[100] is None and all(got[i] == pytest.approx(want[i]) for i in want if i != 100)
    assert {r.distance for r in sensing.nearest_error(a, b.limit(0), 0.5).collect()} == {None}
    known = [d for d in want.values() if d is not None]
    one = sensing.nearest_error_summary(sensing.nearest_error(a, b, 0.5)).first()
    assert one.n == len(known) and (one.median, one.p95) == pytest.approx(tuple(np.quantile(known, [0.5, 0.95])))


def test_coverage_and_gates(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 0.0, 1.0), (0.0, 0.0, -1.0), (1.0, -0.1, 0.0), (0.0, 0.0, 0.0), (None, 1.0, 1.0)], "x double, y double, z double")
    got = sensing.coverage(rows, around=4, bands=2).first()
    assert (got.cells, got.occupied, got.least, got.most) == (8, 3, 0, 2) and got.score == 3 / 8
    assert sensing.coverage(rows.limit(0)).first().occupied == 0
    gates = spark.createDataFrame([(0.2, 1.0), (0.5, 1.0), (5.0, 1.0), (None, 1.0), (0.1, 0.0), (0.1, None)], "i double, h double")
    assert [r.s for r in gates.select(sensing.gated_sigma(F.col("i"), F.col("h"), 0.1).alias("s")).collect()] == [0.1, pytest.approx(0.5 / 3), None, None, None, None]
    sentence = "$GPRMC,123519,A,4807.038,N,01131.000,E,022.4,084.4,230394,003.1,W*6A"
    fix = spark.createDataFrame([(sentence,), (sentence[:-1] + "B",), (None,)], "s string").select(sensing.parse_rmc(F.col("s")).alias("f")).collect()
    assert (fix[0].f.valid, round(fix[0].f.lat, 4), round(fix[0].f.lon, 4), round(fix[0].f.speed, 3), fix[0].f.course) == (True, 48.1173, 11.5167, 11.524, 84.4) and fix[1].f is None and fix[2].f is None


PARAGRAPHS = "doc_id long, idx int, text string"


def test_names_that_clash(spark):
    rows = spark.createDataFrame([(1, 0, "S" + "a" * 120), (1, 1, "S" + "a" * 120), (1, 2, "E"), (None, 0, "S"), (2, 0, None)], PARAGRAPHS)
    extra = rows.withColumns({c: F.lit(c) for c in ("_n", "_key", "_r", "_at", "_sub", "row", "g", "at", "sub", "plain", "free", "last", "place", "item", "new")})
    for edit in (edits.drop_repeats, lambda r: edits.delete_range(r, "S", "E"), lambda r: edits.insert_after(r, "S", ["n"]), lambda r: edits.append_rows(r, ["n"])):
        plain, wide = edit(rows), edit(extra)
        assert wide.columns == extra.columns
        assert sorted(map(repr, wide.select(*rows.columns).collect())) == sorted(map(repr, plain.collect()))
        assert {r._at for r in wide.where("text <> 'n'").collect()} == {"_at"}
    fixes = spark.createDataFrame([(1, 1, 1.0, 2.0, 3.0)], "k long, o long, lat double, lon double, alt double").withColumns({"key__": F.lit("x"), "origin__": F.lit("y"), "fix": F.lit("z")})
    assert sensing.local_enu(fixes, "k", "o").select("key__", "origin__", "fix", "up").first() == ("x", "y", "z", 0.0)


def test_templates_keep_braces(spark):
    keyed = spark.createDataFrame([("e", "{g} x"), ("g", "2"), ("n", None)], "key string, value string")
    fill = lambda t, keys: reports.fill_template(keyed, t, keys).first().text
    assert fill("{e} and {g}", {"e": "e", "g": "g"}) == "{g} x and 2"
    assert fill("<{n}> {other} {} {g}{g}", {"n": "n", "g": "g"}) == "<> {other} {} 22"
    with pytest.raises(Exception, match="no such key"):
        fill("{z}", {"z": "zz"})


def test_runs_lines_and_lists(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "old"), (2, 3, None)], PARAGRAPHS)
    got = {(r.doc_id, r.idx): (r.text, r.style, r.runs) for r in edits.append_paragraphs(rows, ["Note: x", "other"], "Body", "Note:").collect()}
    assert got == {
        (1, 0): ("old", None, [("old", False)]), (1, 1): ("Note: x", "Body", [("Note:", True), (" x", False)]), (1, 2): ("other", "Body", [("other", False)]),
        (2, 3): (None, None, None), (2, 4): ("Note: x", "Body", [("Note:", True), (" x", False)]), (2, 5): ("other", "Body", [("other", False)]),
    }
    texts = ["a\r\nb\rc\x0bd\x0ce\x1cf\x85g h i", "\n\na\n\nb\n", "", "\n", "a\r", "x", "a\r\n"]
    lines = [r.x for r in spark.createDataFrame(list(enumerate(texts)), "n long, t string").orderBy("n").select(lines_of(F.col("t")).alias("x")).collect()]
    assert lines == [t.strip("\n").splitlines() for t in texts]
    many = spark.createDataFrame([(1, i, f"t{i}") for i in range(300)] + [(1, 300, None), (None, 1, "b"), (None, 1, "a")], PARAGRAPHS)
    assert {r.doc_id: r.text for r in lookups.ordered_concat(many.repartition(4), block=7).collect()} == {1: "\n".join(f"t{i}" for i in range(300)), None: "a\nb"}
    ties = spark.createDataFrame([("k", 1, "b"), ("k", 1, "a"), (None, 2, "c")], "k string, o long, v string")
    assert [tuple(r) for r in lookups.last_wins(ties, ["k"], "o", ["v"]).collect()] == [("k", "b")]
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    rows.write.parquet(source)
    for text in ("one", "two"):  # written twice: the copy is replaced, the source stays
        write_edited(edits.replace_first(spark.read.parquet(source), "old", text), source, target)
    assert {r.text for r in spark.read.parquet(target).collect()} == {"two", None} and {r.text for r in spark.read.parquet(source).collect()} == {"old", None}
    cells = spark.createDataFrame([(1, 0, "needle"), (1, 0, "x"), (1, 1, "y"), (2, 0, None)], "doc_id long, table_idx int, text string")
    lines = {(r.section, r.name): r.n for r in reports.report(rows, ["needle", "no"], ["old"], ["o"], cells).collect()}
    assert lines == {("paragraphs", ""): 2, ("headings", ""): 1, ("keyword", "old"): 1, ("found", "needle"): 1, ("found", "no"): 0, ("tables", ""): 3}
