"""Defined results for nulls, blanks, ties and missing things."""

import pytest
from pyspark.sql import functions as F

from parafold.functions import after_prefix, count_inside, format_3dp, lines_of, strip
from parafold.operators import edits, lookups, reports, sensing, series
from parafold.sources import first_existing, paragraphs, read_csv_strings, read_json_document, write_edited
from parafold.streaming import read_lines, save_batches, summarise

ROWS = "doc_id long, idx int, text string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_strip_takes_all_white_space(spark):
    assert one(spark, strip(F.lit("　\t a b  \n"))) == "a b"


def test_text_functions(spark):
    assert one(spark, count_inside(F.lit("AaaA"), "aa")) == 2
    assert one(spark, format_3dp(F.lit("1.5"))) == "1.500" and one(spark, format_3dp(F.lit("n/a"))) == "n/a"
    assert one(spark, after_prefix(F.lit("ab c"), "ab")) == " c" and one(spark, after_prefix(F.lit("x"), "ab")) == "x"
    assert one(spark, lines_of(F.lit("\na\nb\n"))) == ["a", "b"]


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿item,value\na,"x ""y""\nz"\nb,\n', encoding="utf-8")
    assert [tuple(r) for r in read_csv_strings(spark, str(tmp_path / "t.csv")).collect()] == [("a", 'x "y"\nz'), ("b", "")]
    (tmp_path / "t.json").write_text('{\n"a": {"b": 1.5}\n}')
    assert read_json_document(spark, str(tmp_path / "t.json")).select("a.b").first()[0] == 1.5
    assert first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "t.csv")]).endswith("t.csv")
    with pytest.raises(FileNotFoundError):
        first_existing(spark, [str(tmp_path / "no")])
    with pytest.raises(ValueError):
        write_edited(spark.range(1), "/a/", "/a")


@pytest.mark.parametrize(
    "texts,left",
    [
        (["S1", "x", "S2", "y", "E", "z"], ["S1", "x", "E", "z"]),
        (["E", "S", "x"], ["E", "S", "x"]),
        (["S", "x"], ["S", "x"]),
        (["S", "E", "S", "E"], ["E", "S", "E"]),
    ],
)
def test_delete_range(spark, texts, left):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], ROWS)
    got = edits.delete_range(rows, "S", "E").orderBy("idx").collect()
    assert [r.text for r in got] == left


def test_repeats_by_length(spark):
    rows = spark.createDataFrame([(1, 0, "a" * 99), (1, 1, "a" * 99), (1, 2, "b" * 100), (1, 3, " " + "b" * 100), (2, 0, "b" * 100), (1, 4, None), (1, 5, "")], ROWS)
    got = sorted((r.doc_id, r.idx) for r in edits.drop_repeats(rows).collect())
    assert got == [(1, 0), (1, 1), (1, 2), (1, 4), (1, 5), (2, 0)]


def test_first_rule_wins_and_null_stays(spark):
    rows = spark.createDataFrame([(1, 0, "abc"), (1, 1, None), (1, 2, "x")], ROWS)
    got = edits.rewrite_by_prefix(rows, [("a", "1"), ("ab", "2")]).orderBy("idx").collect()
    assert [r.text for r in got] == ["1", None, "x"]


def test_insert_and_append_keep_columns(spark):
    rows = spark.createDataFrame([(1, 0, "a", "s"), (1, 1, "b", "s")], ROWS + ", style string")
    got = edits.insert_after(rows, "a", ["n"]).orderBy("idx").collect()
    assert [(r.idx, r.text, r.style) for r in got] == [(0, "a", "s"), (1, "n", None), (2, "b", "s")]
    assert [r.text for r in edits.append_rows(rows, ["n"]).orderBy("idx").collect()] == ["a", "b", "n"]


def test_missing_things_fail(spark):
    rows = spark.createDataFrame([(1, 0, "a")], ROWS)
    with pytest.raises(Exception, match="no paragraph"):
        edits.first_match(rows, "zz", required=True).collect()
    with pytest.raises(Exception, match="no such key"):
        lookups.lookup(rows, {"doc_id": 9}, "text").collect()


def test_empty_tables(spark):
    rows = spark.createDataFrame([], ROWS)
    assert lookups.keyword_frequency(rows, ["a"]).collect()[0].n == 0
    assert [r.term for r in lookups.required_terms_missing(rows, ["a"]).collect()] == ["a"]
    assert edits.delete_range(rows, "S", "E").count() == edits.insert_after(rows, "S", ["n"]).count() == 0
    assert paragraphs(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("alpha", [0.0, 0.05, 0.5, 0.98, 0.9999, 1.0])
@pytest.mark.parametrize("block", [4, 256])
def test_complementary_filter_by_rows(spark, alpha, block):
    data = [(u, i, float(i % 7), float(i % 5), 0.1) for u in (1, 2, None) for i in range(700 if u == 1 else 9)]
    rows = spark.createDataFrame(data, "user_id long, ts long, rate double, measured double, dt double").withColumns({"event_id": F.col("ts"), "_i": F.lit("clash"), "_x": F.lit("clash")})
    angle, want = {}, {}
    for u, i, rate, measured, dt in data:
        angle[u] = alpha * (angle[u] + rate * dt) + (1 - alpha) * measured if u in angle else measured
        want[u, i] = angle[u]
    out = series.complementary_filter(rows, alpha, block)
    assert out.columns == [*rows.columns, "angle"]
    got = {(r.user_id, r.ts): r.angle for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert series.complementary_filter(rows.limit(0), alpha, block).count() == 0


def test_complementary_filter_alpha(spark):
    with pytest.raises(ValueError):
        series.complementary_filter(spark.range(1), 1.5)


def test_interpolate(spark):
    left = spark.createDataFrame([(1, t) for t in (-1, 0, 5, 10, 15, 20, 21)] + [(2, 5), (None, 5)], "k long, t long")
    right = spark.createDataFrame([(1, 0, 0.0), (1, 10, 10.0), (1, 10, 4.0), (1, 20, 0.0), (1, 17, None)], "k long, t long, v double")
    got = {(r.k, r.t): r.interpolated for r in series.interpolate(left, right, "k", "t", "v").collect()}
    assert got == {(1, -1): None, (1, 0): 0.0, (1, 5): 5.0, (1, 10): 10.0, (1, 15): 5.0, (1, 20): 0.0, (1, 21): None, (2, 5): None, (None, 5): None}


@pytest.mark.parametrize("x", [0.0005, 0.0015, 1.0005, 2.0625, 0.0625, 1e-9, -1e-9, -2.0005, 123456.0625, 0.9995, 0.99949999, 999999999.9995, 1 / 3, 5e11 + 0.0005])
def test_three_decimals_as_printf(spark, x):
    assert one(spark, format_3dp(F.lit(repr(x)))) == f"{x:.3f}"


def test_inverse_fit(spark):
    rows = spark.createDataFrame([(2.0 * x + 0.1 * y + 1, y - 0.5, 3.0 * z + 0.2 * x) for x, y, z in [(1.0, 2.0, 3.0), (0.0, 0.0, 0.0)]], "x double, y double, z double")
    names = [f"m_{a}_{p}" for a in "xyz" for p in "xyz"] + [f"b_{a}" for a in "xyz"]
    fit = spark.createDataFrame([(2.0, 0.1, 0.0, 0.0, 1.0, 0.0, 0.2, 0.0, 3.0, 1.0, -0.5, 0.0)], ", ".join(f"{n} double" for n in names))
    got = [tuple(r)[3:] for r in sensing.apply_inverse_fit(rows, fit).collect()]
    assert got == [pytest.approx((1.0, 2.0, 3.0)), pytest.approx((0.0, 0.0, 0.0))]
    singular = fit.selectExpr("0.0 AS m_x_x", *[f"0.0 AS {n}" for n in names[1:9]], *names[9:])
    assert [r.true_x for r in sensing.apply_inverse_fit(rows, singular).collect()] == [None, None]


def test_ellipsoid(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    p = rng.normal(size=(300, 3))
    p /= np.linalg.norm(p, axis=1)[:, None]
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    points = (p * [3.0, 2.0, 1.0]) @ turn + [10.0, -4.0, 0.5]
    rows = spark.createDataFrame([tuple(map(float, q)) for q in points] + [(None, 1.0, 1.0)], "x double, y double, z double")
    centre, radii = sensing.ellipsoid_fit(rows)
    assert centre == pytest.approx([10.0, -4.0, 0.5], abs=1e-6) and radii == pytest.approx([3.0, 2.0, 1.0], abs=1e-6)
    with pytest.raises(ValueError):
        sensing.ellipsoid_fit(rows.limit(5))


def test_distance_law_and_condition(spark):
    assert one(spark, sensing.distance_law(5, 15)) == pytest.approx(27) and one(spark, sensing.distance_law(F.lit(0.0), 1)) is None
    import numpy as np

    p = np.random.default_rng(1).normal(size=(60, 3))
    p /= np.linalg.norm(p, axis=1)[:, None]
    design = np.stack([p[:, 0] ** 2, p[:, 1] ** 2, p[:, 2] ** 2, 2 * p[:, 0] * p[:, 1], 2 * p[:, 0] * p[:, 2], 2 * p[:, 1] * p[:, 2], *(2 * p).T, np.ones(60)], axis=1)
    values = np.linalg.svd(design / np.linalg.norm(design, axis=0), compute_uv=False)
    rows = spark.createDataFrame([tuple(map(float, q)) for q in p], "x double, y double, z double")
    assert sensing.fit_condition(rows) == pytest.approx(values[0] / values[-2], rel=1e-6)
    cap = rows.selectExpr("0.1 * x AS x", "0.1 * y AS y", "sqrt(1 - 0.01 * (x * x + y * y)) AS z")
    assert sensing.fit_condition(cap) > 10 * sensing.fit_condition(rows)


def test_gga(spark):
    good = "$GPGGA,123519,4807.038,N,01131.000,E,1,08,0.9,545.4,M,46.9,M,,*47"
    rows = spark.createDataFrame([(good,), (good.replace("*47", "*48"),), ("$GPRMC,1*00",), (None,), ("",)], "s string")
    got = [r.f for r in rows.select(sensing.parse_gga(F.col("s")).alias("f")).collect()]
    assert (round(got[0].lat, 4), round(got[0].lon, 4), got[0].quality, got[0].satellites, got[0].hdop, got[0].altitude) == (48.1173, 11.5167, 1, 8, 0.9, 545.4)
    assert got[1:] == [None] * 4


def test_tables_and_templates(spark):
    body = spark.createDataFrame([(2, ["c", "d"]), (1, ["a"]), (3, [])], "o long, cells array<string>")
    got = sorted((r.row, r.col, r.text) for r in reports.table_rows(["x", "y"], body, "o").collect())
    assert got == [(0, 0, "x"), (0, 1, "y"), (1, 0, "a"), (1, 1, ""), (2, 0, "c"), (2, 1, "d"), (3, 0, ""), (3, 1, "")]
    with pytest.raises(Exception, match="more than 1 cells"):
        reports.table_rows(["x"], body, "o").collect()
    assert reports.table_rows(["x"], body.limit(0), "o").count() == 1
    keyed = spark.createDataFrame([("a", "1")], "key string, value string")
    assert reports.fill_template(keyed, "is {v}", {"v": "a"}).first().text == "is 1"
    with pytest.raises(Exception, match="no such key"):
        reports.fill_template(keyed, "is {v}", {"v": "b"}).collect()
    with pytest.raises(Exception, match="more than 1 values"):
        reports.listed(body, "o", "o", most=1).collect()
    neither = spark.createDataFrame([("a", 1)], "other string, n long")
    assert reports.item_map(neither, "n").count() == 0 and not reports.has_keys(neither, ["item"])


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, 0, "ab", "f", 1.0), (1, 1, "ac", "f", 3.0)], ROWS + ", first string, _median double").withColumn("key__", F.lit("k"))
    out = edits.replace_first(rows, "a", "new")
    assert out.columns == rows.columns and [r.text for r in out.orderBy("idx").collect()] == ["new", "ac"]
    gate = series.mad_gate(rows, "doc_id", "_median")
    assert gate.columns == [*rows.columns, "inlier"] and gate.count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("2024-01-01 00:00:01,1.0\n2024-01-01 00:00:02,3.0\nbroken,2\n")
    (tmp_path / "in" / "b.csv").write_text("2024-01-01 01:00:00,9.0\n")
    stream = summarise(read_lines(spark, str(tmp_path / "in"), "ts timestamp, value double"), "ts", "value")
    job = save_batches(stream, str(tmp_path / "check"), lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={n}")))
    job.awaitTermination(120)
    assert job.exception() is None
    # The first window is closed by the watermark that the later row moves on.
    got = [(r.n, r.mean, r.low, r.high) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [(2, 2.0, 1.0, 3.0)]
