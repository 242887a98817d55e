"""Queries of reports, calibration and navigation over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import is_heading, lines_of
from ..operators import edits, reports, sensing, series
from ..sources import flat_text_rows
from .queries import KEYS, TERMS, P, _docs, _events, _paragraphs, query

# What the queries are given.
CENTRE, MATRIX = [0.1, -0.2, 0.05], [[1.1, 0.02, 0.0], [0.02, 0.9, 0.01], [0.0, 0.01, 1.05]]
HEADER = ["status", "order", "remark"]
MAD = """m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), s AS (SELECT e.event_type, med, median(abs(value - med)) AS mad FROM events e JOIN m USING (event_type) GROUP BY 1, 2)"""


def _turns(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(6)])


def _nations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet")


@query(P + """ SELECT doc_id, 0 AS part, idx AS table_idx, 0 AS row_idx, 0 AS col_idx, text FROM p
UNION ALL SELECT conv_id, 1, 0, CAST(turn AS INT), 0, role FROM conversations UNION ALL SELECT conv_id, 1, 0, CAST(turn AS INT), 1, text FROM conversations""")
def paragraphs_then_cells(spark, sf_dir):
    cells = _turns(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("table_idx"), F.col("turn").cast("int").alias("row_idx"), F.posexplode(F.array("role", "text")).alias("col_idx", "text"))
    return flat_text_rows(_paragraphs(spark, sf_dir), cells).select("doc_id", "part", "idx.*", "text")


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' AND contains(text, 'er.')")
def styled_headings_with_text(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("style", F.when(F.col("role") == "assistant", "Heading 1").otherwise("Normal"))
    return rows.where(is_heading(F.col("style"), F.col("text"))).where(F.contains("text", F.lit("er."))).select("conv_id", "turn", "text")


@query(P + """ SELECT 'paragraphs' AS section, 0 AS ord, '' AS name, count(*) AS n FROM q
UNION ALL SELECT 'headings', 0, '', count(*) FILTER (t <> '' AND (starts_with(t, 'The') OR starts_with(t, 'In'))) FROM q
UNION ALL SELECT 'keyword', k.ord, k.key, CAST(sum((length(lower(text)) - length(replace(lower(text), lower(k.key), ''))) / length(k.key)) AS BIGINT) FROM q, (VALUES """ + ", ".join(f"({i}, '{k}')" for i, k in enumerate(KEYS)) + """) k(ord, key) GROUP BY k.ord, k.key
UNION ALL SELECT 'found', k.ord, k.term, CAST(max(CAST(contains(text, k.term) AS INT)) AS BIGINT) FROM q, (VALUES """ + ", ".join(f"({i}, '{t}')" for i, t in enumerate(TERMS)) + ") k(ord, term) GROUP BY k.ord, k.term")
def report_lines(spark, sf_dir):
    return reports.report(_paragraphs(spark, sf_dir), TERMS, KEYS, ["The", "In"])


@query("SELECT n_name AS key, '{\"model\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS value FROM nation")
def model_rows(spark, sf_dir):
    return reports.item_map(_nations(spark, sf_dir).withColumnRenamed("n_name", "model"), "n_nationkey")


@query("SELECT role AS key, arg_max(text, conv_id * 100000 + turn) AS value FROM conversations GROUP BY role")
def item_values(spark, sf_dir):
    rows = _turns(spark, sf_dir).select(F.col("role").alias("item"), F.col("text").alias("value"), (F.col("conv_id") * 100000 + F.col("turn")).alias("place"))
    return reports.item_map(rows, "place")


@query("SELECT 'English ' || count(*) FILTER (lang = 'en') || ', German ' || count(*) FILTER (lang = 'de') || '.' AS text FROM documents")
def filled_template(spark, sf_dir):
    counts = _docs(spark, sf_dir).groupBy(F.col("lang").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    return reports.fill_template(counts, "English {e}, German {g}.", {"e": "en", "g": "de"})


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r, o_orderstatus, o_orderkey FROM orders)
SELECT CAST(0 AS BIGINT) AS "row", CAST(c AS INT) AS col, t AS text FROM (VALUES (0, 'status'), (1, 'order'), (2, 'remark')) h(c, t)
UNION ALL SELECT r, 0, o_orderstatus FROM n UNION ALL SELECT r, 1, CAST(o_orderkey AS VARCHAR) FROM n UNION ALL SELECT r, 2, '' FROM n""")
def appended_table(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    body = orders.select(F.struct("o_totalprice", "o_orderkey").alias("place"), F.array("o_orderstatus", F.col("o_orderkey").cast("string")).alias("cells"))
    return reports.table_rows(HEADER, body, "place")


@query(P + " SELECT doc_id, string_agg(text, '|' ORDER BY idx) AS headings FROM q WHERE t <> '' AND (starts_with(t, 'The') OR starts_with(t, 'In')) GROUP BY doc_id")
def heading_lists(spark, sf_dir):
    heads = _paragraphs(spark, sf_dir).where(is_heading(F.lit(None).cast("string"), F.col("text"), ["The", "In"]))
    return reports.listed(heads, "text", "idx", "doc_id").select("doc_id", F.array_join("values", "|").alias("headings"))


@query(f"WITH {MAD} SELECT e.event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events e JOIN s USING (event_type) WHERE abs(value - med) <= greatest(3.5 * mad, 0.08 * med) GROUP BY 1")
def gated_mean(spark, sf_dir):
    return series.gated_mean(_events(spark, sf_dir), "event_type", "value").withColumn("mean", F.round("mean", 6))


@query("SELECT event_type, round(median(value), 6) AS base FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 50 GROUP BY 1")
def pressure_baseline(spark, sf_dir):
    return sensing.pressure_baseline(_events(spark, sf_dir), "event_type", "event_id", "value", 50).withColumn("base", F.round("base", 6))


@query("SELECT event_id, event_id % 3 > 0 AND event_id % 9 >= 4 AND value / 20 <= 5.0 AS usable FROM events")
def usable_fixes(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", sensing.usable_fix(F.col("event_id") % 3, F.col("event_id") % 9, F.col("value") / 20).alias("usable"))


@query("""WITH f AS (SELECT event_id, event_type, 40 + value / 1000 AS lat, value / 500 - 70 AS lon, value AS alt FROM events),
o AS (SELECT event_type, arg_min(lat, event_id) AS a, arg_min(lon, event_id) AS b, arg_min(alt, event_id) AS c FROM f GROUP BY 1),
w AS (SELECT f.*, a, b, c, 1 - 6.69437999014e-3 * pow(sin(radians(a)), 2) AS w FROM f JOIN o USING (event_type))
SELECT event_id, round(radians(lon - b) * (6378137.0 / sqrt(w) + c) * cos(radians(a)), 4) AS east, round(radians(lat - a) * (6378137.0 * (1 - 6.69437999014e-3) / pow(w, 1.5) + c), 4) AS north, round(alt - c, 4) AS up FROM w""")
def local_enu(spark, sf_dir):
    fixes = _events(spark, sf_dir).select("event_id", "event_type", (40 + F.col("value") / 1000).alias("lat"), (F.col("value") / 500 - 70).alias("lon"), F.col("value").alias("alt"))
    return sensing.local_enu(fixes, "event_type", "event_id").select("event_id", *[F.round(c, 4).alias(c) for c in ("east", "north", "up")])


@query("""SELECT event_id, CASE WHEN event_id % 10 > 0 THEN round(event_id % 80 + (event_id % 59 + 0.25) / 60, 9) END AS lat, CASE WHEN event_id % 10 > 0 THEN round(-(event_id % 170 + (event_id % 59 + 0.25) / 60), 9) END AS lon,
CASE WHEN event_id % 10 > 0 THEN CAST(event_id % 12 AS INT) END AS satellites FROM events""")
def nmea_fixes(spark, sf_dir):
    n = F.col("event_id")
    two = lambda c, width: F.lpad(c.cast("string"), width, "0")
    body = F.concat_ws(",", F.lit("GPGGA"), F.lit("120000.00"), F.concat(two(n % 80, 2), two(n % 59, 2), F.lit(".25")), F.lit("N"), F.concat(two(n % 170, 3), two(n % 59, 2), F.lit(".25")), F.lit("W"), F.lit("1"), (n % 12).cast("string"), F.lit("0.9"), F.lit("12.5"), F.lit("M"))
    sums = F.aggregate(F.transform(F.split(body, ""), lambda c: F.ascii(c)), F.lit(0), lambda a, b: a.bitwiseXOR(b))
    # One sentence of ten has a wrong checksum.
    sentence = F.concat(F.lit("$"), body, F.lit("*"), F.lpad(F.hex(sums.bitwiseXOR(F.when(n % 10 == 0, 1).otherwise(0))), 2, "0"))
    fix = _events(spark, sf_dir).select("event_id", sensing.parse_gga(sentence).alias("fix"))
    return fix.select("event_id", F.round("fix.lat", 9).alias("lat"), F.round("fix.lon", 9).alias("lon"), "fix.satellites")


_M = ", ".join(f"{r[0]} * (e0 - 0.1) + {r[1]} * (e1 + 0.2) + {r[2]} * (e2 - 0.05) AS m{a}" for a, r in zip("xyz", MATRIX, strict=True))


@query(f"""WITH v AS (SELECT vec_id, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}' for i in range(6))} FROM embeddings), c AS (SELECT *, {_M} FROM v),
r AS (SELECT *, atan2(e4, e5) AS roll FROM c), t AS (SELECT *, atan2(-e3, e4 * sin(roll) + e5 * cos(roll)) AS pitch FROM r),
h AS (SELECT vec_id, degrees(atan2(mz * sin(roll) - my * cos(roll), mx * cos(pitch) + my * sin(pitch) * sin(roll) + mz * sin(pitch) * cos(roll))) AS h FROM t)
SELECT vec_id, round(CASE WHEN h < 0 THEN h + 360 ELSE h END, 6) AS heading FROM h""")
def corrected_heading(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    field = sensing.iron_corrected([v.e0, v.e1, v.e2], CENTRE, MATRIX)
    return v.select("vec_id", *[f.alias(a) for a, f in zip("xyz", field, strict=True)], "e3", "e4", "e5").select("vec_id", F.round(sensing.tilt_heading([F.col("e3"), F.col("e4"), F.col("e5")], [F.col("x"), F.col("y"), F.col("z")]), 6).alias("heading"))


@query("SELECT event_type, round(regr_slope(value, event_id / 1000), 6) AS slope, round(regr_intercept(value, event_id / 1000), 6) AS intercept FROM events GROUP BY 1")
def temperature_line(spark, sf_dir):
    fit = sensing.linear_fit(_events(spark, sf_dir).withColumn("x", F.col("event_id") / 1000), "x", "value", "event_type")
    return fit.select("event_type", *[F.round(c, 6).alias(c) for c in ("slope", "intercept")])


@query("""WITH s AS (SELECT """ + ", ".join(f"sum(pow(x, {k})) AS s{k}" for k in range(5)) + ", " + ", ".join(f"sum(pow(x, {k}) * y) AS t{k}" for k in range(3)) + """ FROM (SELECT (event_id % 100) / 100 AS x, value AS y FROM events)),
d AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det FROM s)
SELECT round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det, 4) AS c0, round((s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / det, 4) AS c1,
round((s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / det, 4) AS c2 FROM d""")
def temperature_curve(spark, sf_dir):
    fit = sensing.quadratic_fit(_events(spark, sf_dir).withColumn("x", (F.col("event_id") % 100) / 100), "x", "value")
    return fit.select(*[F.round(c, 4).alias(c) for c in fit.columns])


@query("""SELECT event_type, round(stddev_samp(value), 6) AS std, round(sqrt(avg(pow(value - (value * 0.9 + 1), 2))), 6) AS rmse,
round(10 * log10(avg(pow(value * 0.9 + 1, 2)) / avg(pow(value - (value * 0.9 + 1), 2))), 6) AS snr_db FROM events GROUP BY 1""")
def noise_metrics(spark, sf_dir):
    out = sensing.noise_metrics(_events(spark, sf_dir).withColumn("truth", F.col("value") * 0.9 + 1), "event_type", "value", "truth")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("std", "rmse", "snr_db")])


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
n AS (SELECT p.vec_id, min(sqrt(pow(p.x - t.x, 2) + pow(p.y - t.y, 2))) AS d FROM v p, v t WHERE p.label % 2 = 1 AND t.label % 2 = 0 GROUP BY 1)
SELECT vec_id, round(d, 9) AS distance FROM n""")
def nearest_error(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("vec_id", "label", F.col("e0").alias("x"), F.col("e1").alias("y"))
    out = sensing.nearest_error(v.where("label % 2 = 1"), v.where("label % 2 = 0"), 0.05, key="vec_id")
    return out.select("vec_id", F.round("distance", 9).alias("distance"))


@query("""WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'), v AS (SELECT user_id, epoch_us(ts) AS t, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2),
p AS (SELECT a.*, v.t AS t0, v.value AS v0 FROM a ASOF LEFT JOIN v ON a.user_id = v.user_id AND a.t >= v.t), b AS (SELECT p.*, v.t AS t1, v.value AS v1 FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t <= v.t)
SELECT event_id, round(v0 + CASE WHEN t1 = t0 THEN 0.0 ELSE (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS interpolated FROM b""")
def interpolated_values(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    out = series.interpolate(rows.where("event_type = 'click'").select("event_id", "user_id", "t"), rows.where("event_type = 'view'"), "user_id", "t", "value")
    return out.select("event_id", F.round("interpolated", 6).alias("interpolated"))


@query("SELECT event_id, round(pow(15 / (value + 5), 3), 6) AS weaker FROM events")
def distance_law(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.round(sensing.distance_law(F.col("value") + 5, 15.0), 6).alias("weaker"))


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
n AS (SELECT p.vec_id, min(sqrt(pow(p.x - t.x, 2) + pow(p.y - t.y, 2))) AS d FROM v p, v t WHERE p.label % 2 = 1 AND t.label % 2 = 0 GROUP BY 1)
SELECT count(*) AS n, round(median(d), 9) AS median, round(quantile_cont(d, 0.95), 9) AS p95 FROM n""")
def nearest_summary(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("vec_id", "label", F.col("e0").alias("x"), F.col("e1").alias("y"))
    out = sensing.nearest_error_summary(sensing.nearest_error(v.where("label % 2 = 1"), v.where("label % 2 = 0"), 0.02, key="vec_id"))
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("median", "p95")])


@query("""WITH v AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
d AS (SELECT *, sqrt(x * x + y * y + z * z) AS s, atan2(y, x) / (2 * pi()) AS t FROM v),
c AS (SELECT least(floor((z / s + 1) / 2 * 6), 5) * 12 + least(floor((t - floor(t)) * 12), 11) AS cell, count(*) AS n FROM d WHERE s > 0 GROUP BY 1)
SELECT CAST(72 AS BIGINT) AS cells, count(*) AS occupied, round(count(*) / 72, 9) AS score, CAST(CASE WHEN count(*) = 72 THEN min(n) ELSE 0 END AS BIGINT) AS least, max(n) AS most FROM c""")
def coverage_score(spark, sf_dir):
    v = _vectors(spark, sf_dir).select(*[F.col(f"e{i}").alias(a) for i, a in enumerate("xyz")])
    return sensing.coverage(v).withColumn("score", F.round("score", 9))


@query("""SELECT event_id, CASE WHEN abs(value - 10) <= 3 * 0.1 * (event_id % 20) AND event_id % 20 > 0 THEN round(0.1 * (event_id % 20), 9)
WHEN abs(value - 10) <= 10 * 0.1 * (event_id % 20) AND event_id % 20 > 0 THEN round(abs(value - 10) / 3, 9) END AS sigma FROM events""")
def gated_sigmas(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.round(sensing.gated_sigma(F.col("value") - 10, F.col("event_id") % 20, 0.1), 9).alias("sigma"))


@query("SELECT event_type, round(sqrt(avg(d * d)), 6) AS jitter FROM (SELECT event_type, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS d FROM events) GROUP BY 1")
def jitter(spark, sf_dir):
    return sensing.jitter(_events(spark, sf_dir), "event_type", "value", ["ts", "event_id"]).withColumn("jitter", F.round("jitter", 6))


@query("""SELECT event_id, event_id % 3 > 0 AS valid, round(-(event_id % 80 + (event_id % 59 + 0.25) / 60), 9) AS lat, round(event_id % 170 + (event_id % 59 + 0.25) / 60, 9) AS lon, round((event_id % 12) * 1852 / 3600, 9) AS speed FROM events""")
def nmea_courses(spark, sf_dir):
    n = F.col("event_id")
    two = lambda c, width: F.lpad(c.cast("string"), width, "0")
    body = F.concat_ws(",", F.lit("GNRMC"), F.lit("120000.00"), F.when(n % 3 > 0, "A").otherwise("V"), F.concat(two(n % 80, 2), two(n % 59, 2), F.lit(".25")), F.lit("S"), F.concat(two(n % 170, 3), two(n % 59, 2), F.lit(".25")), F.lit("E"), (n % 12).cast("string"), F.lit("84.4"), F.lit("010124"))
    sums = F.aggregate(F.transform(F.split(body, ""), lambda c: F.ascii(c)), F.lit(0), lambda a, b: a.bitwiseXOR(b))
    fix = _events(spark, sf_dir).select("event_id", sensing.parse_rmc(F.concat(F.lit("$"), body, F.lit("*"), F.lpad(F.hex(sums), 2, "0"))).alias("fix"))
    return fix.select("event_id", "fix.valid", *[F.round(f"fix.{c}", 9).alias(c) for c in ("lat", "lon", "speed")])


@query("""SELECT conv_id AS doc_id, turn AS idx, text, '[' || text || '|false]' AS runs FROM conversations UNION ALL
SELECT conv_id, max(turn) + 1, 'Note: checked', '[Note:|true][ checked|false]' FROM conversations GROUP BY conv_id UNION ALL SELECT conv_id, max(turn) + 2, 'unmarked', '[unmarked|false]' FROM conversations GROUP BY conv_id""")
def appended_paragraphs(spark, sf_dir):
    rows = _turns(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "text")
    out = edits.append_paragraphs(rows, ["Note: checked", "unmarked"], "Body", "Note:")
    shown = F.array_join(F.transform("runs", lambda r: F.concat(F.lit("["), r["text"], F.lit("|"), r["bold"].cast("string"), F.lit("]"))), "")
    return out.select("doc_id", "idx", "text", shown.alias("runs"))


@query(P + """ SELECT 'paragraphs' AS section, 0 AS ord, '' AS name, count(*) AS n FROM q
UNION ALL SELECT 'headings', 0, '', count(*) FILTER (t <> '' AND starts_with(t, 'The')) FROM q
UNION ALL SELECT 'tables', 0, '', count(DISTINCT (conv_id, role)) FROM conversations
UNION ALL SELECT 'found', k.ord, k.term, CAST(max(CAST(contains(text, k.term) AS INT)) AS BIGINT) FROM (SELECT text FROM q UNION ALL SELECT text FROM conversations), (VALUES """ + ", ".join(f"({i}, '{t}')" for i, t in enumerate(TERMS)) + ") k(ord, term) GROUP BY k.ord, k.term")
def report_with_tables(spark, sf_dir):
    cells = _turns(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.col("role").alias("table_idx"), "text")
    return reports.report(_paragraphs(spark, sf_dir), TERMS, [], ["The"], cells)


@query("SELECT doc_id, CAST(len(string_split(trim(text, chr(10)), chr(10))) AS INT) AS n FROM documents WHERE text <> '' AND NOT regexp_matches(text, '[\\x0B\\x0C\\x0D\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]')")
def line_counts(spark, sf_dir):
    docs = _docs(spark, sf_dir).where((F.col("text") != "") & ~F.col("text").rlike(r"[\x0B\x0C\x0D\x1C-\x1E\x85\u2028\u2029]"))
    return docs.select("doc_id", F.size(lines_of(F.col("text"))).alias("n"))
