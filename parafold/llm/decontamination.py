"""Benchmark decontamination: SimHash of item-sized windows, DataFrame functions only.

Words are lower-cased runs of letters, digits and signs beyond ASCII.  A
shingle is five consecutive words and weighs as many as they have characters.
A window of an item's size can only be similar to the item if they share a
shingle, so windows are taken where a document has a shingle of the benchmark,
and only so that the shingle stands where it stands in the item: other windows
that overlap these are not compared, even if they are similar enough.  Each window and item gets a 64-bit weighted SimHash.  The index
cuts it into ``BLOCKS`` blocks and lists every value that is up to ``FLIPS`` bits
away too: two fingerprints at a distance below ``(FLIPS + 1) * BLOCKS`` have a
block that differs in so many bits at most, so all items of the window's size
within ``RADIUS`` are found.  Those whose weights allow it are verified by the weighted Jaccard similarity of the multisets of shingles.

Defined results.  A null or empty text has no match.  An item, or a document,
of fewer than five words has no shingle and matches nothing.  Of several items
with the same words each is reported, and of several with the same id each by
itself; items that repeat id and words are one.  Rows that repeat id and text are one
document.  Null ids are matched and reported as null.
"""

from __future__ import annotations

from itertools import combinations, pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from .textsql import let, row_key, words_sql

WORDS, THRESHOLD = 5, 0.8
#: Blocks of the multi-index; each is searched up to so many bits away.
BLOCKS, FLIPS = 7, 2
RADIUS = (FLIPS + 1) * BLOCKS - 1
#: Shingles of the benchmark up to which their table (24 bytes each) is broadcast.
BROADCAST_GRAMS = 2_000_000


def grams_sql(hashes: str, words: int = WORDS) -> str:
    """Hashes of all shingles of an array of word hashes."""
    items = ", ".join(f"hw[i + {k}]" for k in range(words))
    return let(hashes, "hw", f"if(size(hw) < {words}, array(), transform(sequence(0, size(hw) - {words}), i -> xxhash64({items})))")


def shingles_sql(words: str, size: int = WORDS) -> str:
    """Hash ``g`` and weight ``w`` of all shingles of an array of words."""
    hashes = ", ".join(f"xxhash64(ws[i + {k}])" for k in range(size))
    length = " + ".join(f"length(ws[i + {k}])" for k in range(size))
    return let(words, "ws", f"if(size(ws) < {size}, array(), transform(sequence(0, size(ws) - {size}), i -> named_struct('g', xxhash64({hashes}), 'w', cast({length} as bigint))))")


def simhash_sql(shingles: str) -> str:
    """Weighted SimHash of an array of (g, w)."""
    vote = "aggregate(sh, 0L, (s, x) -> s + if((shiftright(x.g, b) & 1L) = 1L, x.w, -x.w))"
    return let(shingles, "sh", f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if({vote} > 0, shiftleft(1L, b), 0L))")


def index_items(benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """item (a key), item_id, n_words, shingles and fingerprint of each item that has a shingle.

    The key holds once the table is written.
    """
    items = benchmark.select("item_id", F.expr(words_sql("text")).alias("words")).where(F.size("words") >= words).distinct()
    items = items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.size("words").alias("n_words"), F.expr(shingles_sql("words", words)).alias("shingles"))
    return items.withColumn("fingerprint", F.expr(simhash_sql("shingles")))


def block_keys(fingerprint: str, flips: bool) -> Column:
    """A key of each block of the fingerprint, and of the values up to ``FLIPS`` bits away."""
    edges = [64 * b // BLOCKS for b in range(BLOCKS + 1)]
    keys = []
    for b, (low, high) in enumerate(pairwise(edges)):
        own = f"{b << 32}L + (shiftrightunsigned({fingerprint}, {low}) & {(1 << (high - low)) - 1}L)"
        near = [sum(1 << k for k in chosen) for n in range(FLIPS + 1) for chosen in combinations(range(high - low), n)] if flips else [0]
        keys.append(f"transform(array({', '.join(f'{x}L' for x in near)}), f -> ({own}) ^ f)")
    return F.expr(f"flatten(array({', '.join(keys)}))")


def find_leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, row_key, item_id, start (word), n_words, similarity of each window like an item."""
    work = Scratch(docs.sparkSession, "leaks")
    items = work.save(index_items(benchmark, words), "items")
    shared = items.select("n_words", F.posexplode(F.col("shingles.g")).alias("place", "g")).distinct()
    shared = work.save(shared, "grams")
    if shared.count() <= BROADCAST_GRAMS:
        shared = F.broadcast(shared)
    texts = docs.select("doc_id", "text", row_key().alias("row_key"))
    # The windows: where a shingle of an item stands, as far as the text goes.
    # The length of the text is not carried along with each shingle.
    hashes = f"transform({words_sql('text')}, w -> xxhash64(w))"
    grams = texts.select("row_key", F.posexplode(F.expr(grams_sql(hashes, words))).alias("at", "g"))
    windows = grams.join(shared, "g").select("row_key", F.greatest(F.col("at") - F.col("place"), F.lit(0)).alias("start"), "n_words").distinct()
    per_row = work.save(windows.groupBy("row_key").agg(F.collect_list(F.struct("start", "n_words")).alias("windows")), "windows")
    cut = texts.join(per_row.hint("shuffle_hash"), "row_key").dropDuplicates(["row_key"])
    sliced = let(words_sql("text"), "ws", "transform(windows, x -> named_struct('start', x.start, 'n_words', x.n_words, 'words', slice(ws, x.start + 1, x.n_words)))")
    cut = cut.select("doc_id", "row_key", F.explode(F.expr(sliced)).alias("x")).select("doc_id", "row_key", "x.*")
    cut = cut.select("doc_id", "row_key", "start", "n_words", F.expr(shingles_sql("words", words)).alias("shingles"))
    cut = work.save(cut.withColumn("fingerprint", F.expr(simhash_sql("shingles"))), "cut")
    # Candidates within the radius, by the blocks of the index.
    weight = "aggregate(shingles, 0L, (s, x) -> s + x.w)"
    prints = items.select("item", "n_words", F.col("fingerprint").alias("item_print"), F.expr(weight).alias("item_weight"))
    index = prints.select("item", "n_words", "item_print", "item_weight", F.explode(block_keys("item_print", True)).alias("k"))
    probes = cut.select("row_key", "start", "n_words", "fingerprint", F.expr(weight).alias("weight"), F.explode(block_keys("fingerprint", False)).alias("k"))
    near = probes.join(index, ["k", "n_words"]).where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    # A similarity is not above the ratio of the weights.
    near = near.where(F.least("weight", "item_weight") >= F.greatest("weight", "item_weight") * (threshold - 1e-9))
    near = work.save(near.select("row_key", "start", "n_words", "item").distinct(), "near")
    # Weighted Jaccard similarity of the multisets.
    own = items.select("item", F.explode("shingles").alias("s")).groupBy("item", "s.g", "s.w").agg(F.count(F.lit(1)).alias("n_item"))
    total = items.select("item", "item_id", F.expr(weight).alias("item_weight"))
    weights = cut.select("doc_id", "row_key", "start", "n_words", F.expr(weight).alias("weight"))
    place = ["row_key", "start", "n_words"]
    tf = cut.select(*place, F.explode("shingles").alias("s")).groupBy(*place, "s.g").agg(F.count(F.lit(1)).alias("n"))
    common = tf.join(near, place).join(own, ["item", "g"]).groupBy(*place, "item").agg(F.sum(F.col("w") * F.least("n", "n_item")).alias("common"))
    found = common.join(weights, place).join(total, "item")
    found = found.withColumn("similarity", F.col("common") / (F.col("weight") + F.col("item_weight") - F.col("common")))
    found = found.where(F.col("similarity") >= threshold).select("doc_id", "row_key", "item_id", "start", "n_words", "similarity")
    found = work.save(found, "found")
    work.drop("cut", "windows", "near")
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any window like a benchmark item.

    Rows that repeat id and text are dropped or kept together; a null or empty
    text is kept, and so is everything where the benchmark is empty.
    """
    leaked = find_leaks(docs, benchmark).select("row_key").distinct()
    rows = docs.select(F.struct("*").alias("row"), row_key().alias("row_key"))
    return rows.join(leaked, "row_key", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row_key")
