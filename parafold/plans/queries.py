"""Queries of the general operators over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import after_prefix, format_3dp, is_heading, strip
from ..operators import edits, lookups, series
from ..operators.ordering import number_rows
from ..operators.quantiles import exact_quantiles
from ..sources import paragraphs

# What the queries look for.
KEYS = ["the", "of", "ing", "tion", "und", "que", "In", "zz"]
TERMS = ["the", "und der", "no such term", "Zu und", "que la", "another missing term"]
RULES = [("The", "[begins with The]"), ("In", "[begins with In]"), ("T", "[begins with T]")]
START, END = "The", "In"
NEW = ["first new line", "second new line"]
SIZES = [1, 2, 4, 8]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(_docs(spark, sf_dir).select("doc_id", "text"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


P = """WITH p AS (SELECT doc_id, CAST(i - 1 AS INT) AS idx, string_split(text, chr(10))[i] AS text
  FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)),
q AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM p)"""
N = "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"


@query(P + " SELECT doc_id, idx, text FROM q WHERE t <> '' AND (t LIKE 'The%' OR t LIKE 'In%')")
def heading_filter(spark, sf_dir):
    rows = _paragraphs(spark, sf_dir)
    return rows.where(is_heading(F.lit(None).cast("string"), F.col("text"), ["The", "In"]))


@query("SELECT k.ord, k.key, CAST(sum((length(lower(text)) - length(replace(lower(text), lower(k.key), ''))) / length(k.key)) AS BIGINT) AS n FROM documents, (VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(KEYS)) + ") k(ord, key) GROUP BY ALL")
def keyword_frequency(spark, sf_dir):
    return lookups.keyword_frequency(_docs(spark, sf_dir), KEYS)


@query("SELECT k.ord, k.term FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(TERMS)) + ") k(ord, term) WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(text, k.term))")
def required_terms_missing(spark, sf_dir):
    return lookups.required_terms_missing(_docs(spark, sf_dir), TERMS)


@query(P + " SELECT doc_id, idx, CASE " + " ".join(f"WHEN starts_with(t, '{p}') THEN '{r}'" for p, r in RULES) + " ELSE text END AS text FROM q")
def prefix_rule_rewrite(spark, sf_dir):
    return edits.rewrite_by_prefix(_paragraphs(spark, sf_dir), RULES)


@query(P + " SELECT doc_id, idx, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY idx) AS n FROM q) WHERE length(t) < 100 OR starts_with(t, 'The') OR n = 1")
def dedupe_long_paragraphs(spark, sf_dir):
    return edits.drop_repeats(_paragraphs(spark, sf_dir), exempt=["The"])


@query(P + f""", m AS (SELECT *, max(CASE WHEN starts_with(t, '{START}') THEN idx END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM q),
r AS (SELECT doc_id, min(idx) AS e, arg_min(s, idx) AS s FROM m WHERE starts_with(t, '{END}') AND s IS NOT NULL GROUP BY doc_id)
SELECT q.doc_id, q.idx, q.text FROM q LEFT JOIN r ON q.doc_id = r.doc_id WHERE r.e IS NULL OR NOT (q.idx >= r.s AND q.idx < r.e)""")
def delete_marker_range(spark, sf_dir):
    return edits.delete_range(_paragraphs(spark, sf_dir), START, END)


@query(P + " SELECT doc_id, idx, text FROM q WHERE NOT (starts_with(t, 'The') OR starts_with(t, 'De'))")
def delete_by_prefix(spark, sf_dir):
    return edits.delete_by_prefix(_paragraphs(spark, sf_dir), ["The", "De"])


@query(P + " SELECT doc_id, min(idx) AS first FROM q WHERE starts_with(t, 'The') GROUP BY doc_id")
def first_match(spark, sf_dir):
    return edits.first_match(_paragraphs(spark, sf_dir), "The")


@query(P + ", f AS (SELECT doc_id, min(idx) AS first FROM q WHERE starts_with(t, 'The') GROUP BY doc_id) SELECT q.doc_id, q.idx, CASE WHEN q.idx = f.first THEN 'replaced' ELSE q.text END AS text FROM q LEFT JOIN f ON q.doc_id = f.doc_id")
def replace_first(spark, sf_dir):
    return edits.replace_first(_paragraphs(spark, sf_dir), "The", "replaced")


@query(P + f""", f AS (SELECT doc_id, min(idx) AS first FROM q WHERE starts_with(t, 'The') GROUP BY doc_id),
u AS (SELECT doc_id, idx AS a, -1 AS s, text FROM q UNION ALL SELECT doc_id, first, 0, '{NEW[0]}' FROM f UNION ALL SELECT doc_id, first, 1, '{NEW[1]}' FROM f)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a, s) - 1 AS INT) AS idx, text FROM u""")
def insert_after_anchor(spark, sf_dir):
    return edits.insert_after(_paragraphs(spark, sf_dir), "The", NEW)


@query(P + f", l AS (SELECT doc_id, max(idx) AS m FROM q GROUP BY doc_id) SELECT doc_id, idx, text FROM q UNION ALL SELECT doc_id, m + 1, '{NEW[0]}' FROM l UNION ALL SELECT doc_id, m + 2, '{NEW[1]}' FROM l")
def append_rows(spark, sf_dir):
    return edits.append_rows(_paragraphs(spark, sf_dir), NEW)


@query(P + " SELECT count(*) AS n_paragraphs, count(*) FILTER (t = '') AS n_blank, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM q")
def paragraph_counts(spark, sf_dir):
    return _paragraphs(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_paragraphs"), F.count(F.when(strip("text") == "", 1)).alias("n_blank"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def ordered_concat(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return lookups.ordered_concat(turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "text"))


@query("WITH t AS (SELECT 'Q' || i AS term FROM range(1, 21) r(i) UNION ALL SELECT DISTINCT lang FROM documents) SELECT term, count(d.doc_id) AS n FROM t LEFT JOIN documents d ON contains(d.text, term) OR d.lang = term GROUP BY term")
def range_and_union(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    made = docs.sparkSession.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(20))).alias("i")).select(F.concat(F.lit("Q"), F.col("i")).alias("term"))
    terms = made.unionAll(docs.where("lang IS NOT NULL").select(F.col("lang").alias("term")).distinct())
    # Terms are few, and each text is held against them once, without a join of rows.
    names = sorted(r["term"] for r in terms.collect())
    hits = docs.agg(*[F.count_if(F.contains("text", F.lit(t)) | (F.col("lang") == t)).alias(f"c{i}") for i, t in enumerate(names)])
    return hits.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"c{i}").alias("n")) for i, t in enumerate(names)])).alias("x")).select("x.*")


@query("SELECT event_type AS item, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def pivot_last_wins(spark, sf_dir):
    return lookups.last_wins(_events(spark, sf_dir).withColumnRenamed("event_type", "item"), ["item"], "event_id", ["value"])


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def composite_key_last_wins(spark, sf_dir):
    return lookups.last_wins(_events(spark, sf_dir), ["user_id", "event_type"], "event_id", ["value"])


@query("SELECT arg_max(value, event_id) AS value FROM events WHERE event_type = 'error'")
def point_lookup(spark, sf_dir):
    return lookups.lookup(pivot_last_wins(spark, sf_dir), {"item": "error"}, "value")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT event_id, printf('%.3f', value) AS shown, printf('%.3f', abs(value) * 600.0) AS drift FROM events")
def format_three_decimals(spark, sf_dir):
    value = F.col("value")
    return _events(spark, sf_dir).select("event_id", format_3dp(value.cast("string")).alias("shown"), format_3dp((F.abs(value) * 600.0).cast("string")).alias("drift"))


@query(P + " SELECT doc_id, idx, CASE WHEN starts_with(text, 'The ') THEN substr(text, 5) ELSE text END AS rest, substr(t, 1, 90) AS shown FROM q")
def split_prefix(spark, sf_dir):
    rows = _paragraphs(spark, sf_dir)
    return rows.select("doc_id", "idx", after_prefix(F.col("text"), "The ").alias("rest"), F.substring(strip("text"), 1, 90).alias("shown"))


_ALLAN = N + """, b AS (SELECT user_id, m, i // m AS b, avg(value) AS mean FROM n, (VALUES """ + ", ".join(f"({m})" for m in SIZES) + """) s(m) GROUP BY ALL HAVING count(value) = m),
d AS (SELECT *, mean - lag(mean) OVER (PARTITION BY user_id, m ORDER BY b) AS d FROM b),
c AS (SELECT user_id, m, m / 50.0 AS tau, sqrt(0.5 * avg(d * d)) AS adev FROM d GROUP BY user_id, m)"""


@query(_ALLAN + " SELECT user_id, m, CAST(tau AS DOUBLE) AS tau, round(adev, 6) AS adev FROM c")
def allan_deviation(spark, sf_dir):
    return series.allan_deviation(_events(spark, sf_dir), SIZES, 50.0).withColumn("adev", F.round("adev", 6))


@query(_ALLAN + " SELECT user_id, CAST(arg_min(tau, adev) AS DOUBLE) AS tau, round(min(adev), 6) AS adev FROM c WHERE adev IS NOT NULL GROUP BY user_id")
def allan_minimum(spark, sf_dir):
    return series.allan_minimum(series.allan_deviation(_events(spark, sf_dir), SIZES, 50.0)).withColumn("adev", F.round("adev", 6))


@query("""WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), s AS (SELECT e.event_type, med, median(abs(value - med)) AS mad FROM events e JOIN m USING (event_type) GROUP BY 1, 2)
SELECT e.event_id, abs(value - med) <= greatest(3.5 * mad, 0.08 * med) AS inlier FROM events e JOIN s USING (event_type)""")
def mad_gate(spark, sf_dir):
    return series.mad_gate(_events(spark, sf_dir), "event_type", "value").select("event_id", "inlier")


_POSES = "CASE vec_id % 6 WHEN 0 THEN '+x' WHEN 1 THEN '-x' WHEN 2 THEN '+y' WHEN 3 THEN '-y' WHEN 4 THEN '+z' ELSE '-z' END"


@query(f"""WITH p AS (SELECT {_POSES} AS pose, avg(CAST(embedding[1] AS DOUBLE)) AS x, avg(CAST(embedding[2] AS DOUBLE)) AS y, avg(CAST(embedding[3] AS DOUBLE)) AS z FROM embeddings GROUP BY 1)
SELECT """ + ", ".join(f"round((max(CASE WHEN pose = '+{p}' THEN {a} END) - max(CASE WHEN pose = '-{p}' THEN {a} END)) / 2, 6) AS m_{a}_{p}" for a in "xyz" for p in "xyz") + ", " + ", ".join(f"round(avg({a}), 6) AS b_{a}" for a in "xyz") + " FROM p")
def six_pose_fit(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.expr(_POSES).alias("pose"), *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")])
    fit = series.six_pose_fit(v.groupBy("pose").agg(*[F.avg(a).alias(a) for a in "xyz"]))
    return fit.select(*[F.round(c, 6).alias(c) for c in fit.columns])


@query("SELECT event_id, round(44330.0 * (1 - pow((1000 + value / 100) / 1013.25, 0.190294957)), 6) AS altitude FROM events")
def barometric_altitude(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.round(series.barometric_altitude(1000 + F.col("value") / 100, F.lit(1013.25)), 6).alias("altitude"))


@query(N + """ SELECT a.event_id, round(sum(CASE WHEN b.i = 0 THEN b.value ELSE 0.98 * 0.001 * b.value + 0.02 * b.value END * pow(0.98, a.i - b.i)), 6) AS angle
FROM n a JOIN n b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.event_id""")
def complementary_filter(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", "user_id", "ts", F.col("value").alias("rate"), F.col("value").alias("measured"), F.lit(0.001).alias("dt"))
    return series.complementary_filter(rows, block=32).select("event_id", F.round("angle", 6).alias("angle"))


@query("SELECT round(stddev_pop(CASE WHEN event_type = 'click' THEN value END) / stddev_pop(CASE WHEN event_type = 'view' THEN value END), 9) AS ratio FROM events")
def segment_ratio(spark, sf_dir):
    return series.segment_ratio(_events(spark, sf_dir), "event_type", "click", "view").select(F.round("ratio", 9).alias("ratio"))


@query("""WITH m AS (SELECT """ + ", ".join(f"avg(CASE WHEN label % 2 = 1 THEN CAST(embedding[{i}] AS DOUBLE) END) AS on{a}, avg(CASE WHEN label % 2 <> 1 THEN CAST(embedding[{i}] AS DOUBLE) END) AS off{a}" for i, a in enumerate("xyz", 1)) + """ FROM embeddings),
s AS (SELECT *, sqrt((onx-offx)**2 + (ony-offy)**2 + (onz-offz)**2) AS v, sqrt(offx**2 + offy**2 + offz**2) AS f FROM m)
SELECT round(onx-offx, 9) AS dx, round(ony-offy, 9) AS dy, round(onz-offz, 9) AS dz, round(v, 9) AS vector_shift, round(100*v/f, 6) AS percent_of_field FROM s""")
def mean_vector_shift(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("label") % 2 == 1).alias("on"), *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")])
    out = series.mean_vector_shift(v, "on", "xyz")
    return out.select(*[F.round(c, 6 if c == "percent_of_field" else 9).alias(c) for c in out.columns])


@query("SELECT event_type, count(*) AS n_rows, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) AS seconds, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round((count(*) - 1) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS hz FROM events GROUP BY 1")
def capture_summary(spark, sf_dir):
    out = series.capture_summary(_events(spark, sf_dir), "event_type")
    places = {"seconds": 3, "mean": 6, "std": 6, "hz": 9}
    return out.select("event_type", "n_rows", *[F.round(c, n).alias(c) for c, n in places.items()])


@query(N + ", d AS (SELECT user_id, sqrt((value - lag(value) OVER w) ** 2 + (i - lag(i) OVER w) ** 2) AS d FROM n WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, round(coalesce(sum(d), 0.0), 6) AS length FROM d GROUP BY 1")
def track_length(spark, sf_dir):
    rows = number_rows(_events(spark, sf_dir), ["ts", "event_id"], "user_id", "i").withColumn("y", F.col("i").cast("double"))
    return series.track_length(rows, "user_id", ["ts", "event_id"], "value", "y").withColumn("length", F.round("length", 6))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def innovation_quantiles(spark, sf_dir):
    q = exact_quantiles(_events(spark, sf_dir), "event_type", "value", [0.5, 0.95])
    return q.select("event_type", F.round("q0", 6).alias("median"), F.round("q1", 6).alias("p95"))


@query("""SELECT a.event_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'click') a
ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def align_last(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return series.align_last(rows.where("event_type = 'click'"), rows.where("event_type = 'view'"), "user_id", "ts", ["value"]).select("event_id", "last_value")


@query(N + ", w AS (SELECT user_id, i, list(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS v FROM n) SELECT user_id, CAST(i // 4 AS BIGINT) AS window, round(list_sum(v), 6) AS total FROM w WHERE i % 4 = 0 AND len(v) = 8")
def sliding_windows(spark, sf_dir):
    out = series.sliding_windows(_events(spark, sf_dir), 8, 4)
    return out.select("user_id", F.col("window").cast("long").alias("window"), F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT user_id, event_type, round(stddev_samp(value), 6) AS std FROM events GROUP BY 1, 2")
def phase_spread(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.round(F.stddev_samp("value"), 6).alias("std"))


@query("SELECT event_id, round(value / 131 - avg(value / 131) OVER (PARTITION BY event_type), 9) AS unbiased, round(value / 16384, 9) AS g, round(value * sqrt(60), 9) AS per_root_hour FROM events")
def scaled_units(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", "event_type", "value", series.scaled(F.col("value"), 131).alias("rate"))
    out = series.without_mean(rows, "event_type", "rate")
    return out.select("event_id", F.round("unbiased", 9).alias("unbiased"), F.round(series.scaled(F.col("value"), 16384), 9).alias("g"), F.round(F.col("value") * F.sqrt(F.lit(60.0)), 9).alias("per_root_hour"))
