"""Conversation prefix trie by prefix-doubling naming.

Turns get dense names by their role and text.  A block of ``2**k`` turns that
begins at a multiple of its size is named by the pair of names of its halves, so
that as many join rounds as the longest conversation has binary digits name all
blocks, and equal blocks have equal names.  A prefix of d turns is cut by the
binary digits of d into such blocks; prefixes of one length with the same block
names are one node.  Nodes are known by depth and least member, and what a node
sums over its subtree is summed from members: each turn of a conversation adds
what it and the later turns have, and no turn ever meets its ancestors.

Text is read once, to be named; all that follows moves numbers.  Groups are
pre-aggregated sums, and the joins that take names back to turns are plain joins
of written tables, which Spark splits where a name is frequent.  The ids that
end at a node are joined to strings of a bounded range of ids, and a task hashes
these strings one after another.

Defined results.  Turns are ordered by turn, null first, then by role, then by a
SHA-256 of role and text; repeated rows are turns of their own.  A null role or
text is empty.  Rows without a conv_id belong to no conversation.  A remainder
of a negative conv_id is negative, as in SQL.  An empty table gives an empty
result.  Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordering import number_rows
from ..scratch import Scratch

#: Conversations take their first turns from one whose id is a multiple of this,
FAMILY = 5
#: and so many of them as a checksum of the id leaves by this.
HEADS = 9
#: Turns of a block of suffix sums, and binary digits of the ids of one string.
BLOCK, ID_BITS = 4096, 12
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def dense_names(keys: DataFrame, work: Scratch, label: str) -> DataFrame:
    """The distinct rows of ``keys`` with ``name``: 0, 1, ... without gaps."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    found = work.save(keys.distinct().select("*", F.spark_partition_id().alias("part"), at.alias("nth")), label)
    offsets, total = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in found.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((part, total))
        total += n
    table = F.broadcast(keys.sparkSession.createDataFrame(offsets, "part int, before long"))  # a row for each partition
    return found.join(table, "part").select(*keys.columns, (F.col("before") + F.col("nth")).alias("name"))


def named_turns(conversations: DataFrame, work: Scratch) -> DataFrame:
    """(conv_id, pos, name, bytes) of every turn, in the order of its conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    known = conversations.where(F.col("conv_id").isNotNull())
    turns = known.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), mark.alias("mark"), F.octet_length(text).cast("long").alias("bytes"))
    placed = work.save(number_rows(turns, ["turn", "role", "mark"], "conv_id", "pos").select("conv_id", "pos", "mark", "bytes"), "placed")
    names = dense_names(placed.select("mark"), work, "marks")
    named = work.save(placed.join(names, "mark").select("conv_id", "pos", "name", "bytes"), "named")
    work.drop("placed", "marks")
    return named


def rebuilt_turns(named: DataFrame, work: Scratch, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns of all conversations after their first turns are exchanged, and (conv_id, n) with how many there are."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = named.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    front = named.where(F.col("pos") < heads - 1)
    given = front.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("given"))
    convs = work.save(convs.join(given, "base", "left").select("conv_id", "base", "h", (F.col("h") - F.least("h", F.coalesce("given", F.lit(0)))).alias("short")), "convs")
    first = front.withColumnRenamed("conv_id", "base").join(convs, "base").where("pos < h").select("conv_id", "pos", "name", "bytes")
    own = named.join(convs, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("short")).alias("pos"), "name", "bytes")
    turns = work.save(first.unionByName(own), "rebuilt")
    sizes = convs.select("conv_id").join(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conv_id", "left")
    sizes = work.save(sizes.select("conv_id", F.coalesce("n", F.lit(0)).alias("n")), "sizes")
    work.drop("named", "convs")
    return turns, sizes


def block_names(turns: DataFrame, longest: int, work: Scratch) -> DataFrame:
    """(conv_id, level, idx, name): dense names of the blocks of ``2**level`` turns that begin at idx times their size."""
    level = turns.select("conv_id", F.col("pos").alias("idx"), "name")
    every = level.select("conv_id", F.lit(0).alias("level"), "idx", "name")
    for k in range(1, longest.bit_length()):
        half = lambda odd: F.max(F.when(F.col("idx") % 2 == odd, F.col("name")))
        pairs = level.groupBy("conv_id", F.shiftright("idx", 1).alias("idx")).agg(half(0).alias("l"), half(1).alias("r")).where("r IS NOT NULL")
        pairs = work.save(pairs, f"pairs_{k}")
        level = work.save(pairs.join(dense_names(pairs.select("l", "r"), work, f"names_{k}"), ["l", "r"]).select("conv_id", "idx", "name"), f"level_{k}")
        work.drop(f"pairs_{k}", f"names_{k}")
        every = every.unionByName(level.select("conv_id", F.lit(k).alias("level"), "idx", "name"))
    return every


def prefix_rows(turns: DataFrame, sizes: DataFrame, blocks: DataFrame, longest: int, work: Scratch) -> DataFrame:
    """(conv_id, d, ends, bytes, names): every prefix by the names of the blocks that the digits of d cut it into."""
    last = sizes.select("conv_id", (F.col("n") - 1).alias("pos"), F.lit(True).alias("ends"))
    marked = turns.join(last, ["conv_id", "pos"], "left").select("conv_id", (F.col("pos") + 1).alias("d"), "bytes", F.coalesce("ends", F.lit(False)).alias("ends"))
    digits = f"filter(sequence(0, {max(1, longest).bit_length() - 1}), k -> (shiftright(d, k) & 1) = 1)"
    cut = marked.select("*", F.explode(F.expr(digits)).alias("level"))
    cut = cut.withColumn("idx", F.expr("shiftleft(shiftright(d, level + 1), 1)"))
    parts = F.array_sort(F.collect_list(F.struct("level", "name")))  # as many as d has digits
    joined = cut.join(blocks, ["conv_id", "level", "idx"]).groupBy("conv_id", "d").agg(F.max("bytes").alias("bytes"), F.max("ends").alias("ends"), F.transform(parts, lambda x: x["name"]).alias("names"))
    return work.save(joined, "prefixes")


def suffix_sums(rows: DataFrame, values: list[str], work: Scratch, block: int = BLOCK) -> DataFrame:
    """``rows`` (conv_id, d, ...) with ``after_<value>``: its sum over this and all deeper rows of the conversation."""
    own = rows.withColumn("b", F.floor(F.col("d") / block))
    w = W.partitionBy("conv_id", "b").orderBy(F.col("d").desc()).rowsBetween(W.unboundedPreceding, 0)
    later = W.partitionBy("conv_id").orderBy(F.col("b").desc()).rowsBetween(W.unboundedPreceding, -1)
    blocks = own.groupBy("conv_id", "b").agg(*[F.sum(v).alias(v) for v in values])
    deeper = blocks.select("conv_id", "b", *[F.sum(v).over(later).alias(f"deeper_{v}") for v in values]).where(F.col(f"deeper_{values[0]}").isNotNull())
    deeper = work.save(deeper, "deeper")  # only what has more than one block
    joined = own.select("*", *[F.sum(v).over(w).alias(f"after_{v}") for v in values]).join(deeper, ["conv_id", "b"], "left")
    total = [(F.col(f"after_{v}") + F.coalesce(f"deeper_{v}", F.lit(0))).alias(f"after_{v}") for v in values]
    return joined.select(*[c for c in own.columns if c != "b"], *total)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each node of rows sorted by node and chunk; a node may go on in the next batch."""
    node, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([state.hexdigest()])], names=["d", "m", "ends_sha256"])

    for batch in batches:
        for d, m, ids in zip(*(batch.column(c).to_pylist() for c in ("d", "m", "ids")), strict=True):
            if (d, m) != node:
                if node:
                    yield done()
                node, state = (d, m), hashlib.sha256(ids.encode())
            else:
                state.update(b",")
                state.update(ids.encode())
    if node:
        yield done()


def ends_hashes(ends: DataFrame, id_bits: int = ID_BITS) -> DataFrame:
    """(d, m, ends_sha256) of the (d, m, conv_id) that end at a node: ids in numeric order, joined by commas."""
    near = ends.groupBy("d", "m", F.shiftright("conv_id", id_bits).alias("chunk"))
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))  # at most 2**id_bits ids
    chunks = near.agg(F.array_join(ids, ",").alias("ids"))
    return chunks.repartition("d", "m").sortWithinPartitions("d", "m", "chunk").select("d", "m", "ids").mapInArrow(_hashed, "d long, m long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, block: int = BLOCK, id_bits: int = ID_BITS) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    work = Scratch(spark, "prefix-trie")
    turns, sizes = rebuilt_turns(named_turns(conversations, work), work, family, heads)
    whole = sizes.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("m"), F.coalesce(F.max("n"), F.lit(0)).alias("longest")).first()
    blocks = block_names(turns, whole["longest"], work)
    prefixes = prefix_rows(turns, sizes, blocks, whole["longest"], work)
    work.drop("rebuilt", *[f"level_{k}" for k in range(1, whole["longest"].bit_length())])
    groups = prefixes.groupBy("d", "names").agg(F.min("conv_id").alias("m"), F.count(F.lit(1)).alias("n_convs"), F.count_if("ends").alias("n_ends"))
    groups = work.save(groups, "groups")
    # A turn adds its bytes unless it is the least member's; a childless node is counted there.
    least = F.col("conv_id") == F.col("m")
    rows = prefixes.join(groups, ["d", "names"]).select(
        "conv_id", "d", "m", "n_convs", "ends", F.when(least, 0).otherwise(F.col("bytes")).alias("saved"), F.when(least & (F.col("n_ends") == F.col("n_convs")), 1).otherwise(0).cast("long").alias("leaf")
    )
    rows = work.save(rows, "rows")
    work.drop("prefixes", "groups")
    sums = rows.agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves")).first()
    inner = suffix_sums(rows, ["saved", "leaf"], work, block).groupBy("d", "m").agg(F.max("n_convs").alias("n_convs"), F.sum("after_leaf").alias("n_leaves"), F.sum("after_saved").alias("saved_tokens"))
    above = rows.select((F.col("d") + 1).alias("d"), F.col("conv_id").alias("m"), F.col("m").alias("parent"))
    inner = inner.join(above, ["d", "m"], "left").withColumn("parent", F.when(F.col("d") == 1, F.lit(whole["m"])).otherwise(F.col("parent")))
    inner = work.save(inner, "inner")
    one = [(0, whole["m"], whole["n_convs"], sums["leaves"] or 1, sums["saved"], None)] if whole["n_convs"] else []
    root = spark.createDataFrame(one, "d long, m long, n_convs long, n_leaves long, saved_tokens long, parent long")
    nodes = inner.unionByName(root)
    children = inner.groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("m")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = rows.where("ends").select("d", "m", "conv_id").unionByName(sizes.where("n = 0").select(F.lit(0).cast("long").alias("d"), F.lit(whole["m"]).cast("long").alias("m"), "conv_id"))
    out = nodes.join(children, ["d", "m"], "left").join(ends_hashes(ends, id_bits), ["d", "m"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("m").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), zero("n_convs"), zero("n_children"), zero("n_leaves"), zero("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_HASH)).alias("ends_sha256")
    )


#: CRC-32 of a decimal number, digit by digit and bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295)"

OP12_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text) AS mark FROM t),
o AS (SELECT conv_id, mark, CAST(strlen(text) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, mark) - 1 AS pos FROM k),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % {FAMILY} AS base, {_CRC} % {HEADS} AS h FROM o),
u AS (SELECT c.conv_id, 0 AS part, o.pos, o.mark, o.bytes FROM c JOIN o ON o.conv_id = c.base AND o.pos < c.h UNION ALL SELECT c.conv_id, 1, o.pos, o.mark, o.bytes FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos >= c.h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, mark, bytes FROM u),
p AS (SELECT conv_id, d, bytes, sha256(string_agg(mark, '') OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c),
q AS (SELECT *, max(d) OVER (PARTITION BY conv_id) AS n, lag(node) OVER (PARTITION BY conv_id ORDER BY d) AS parent FROM p),
g AS (SELECT d, node, max(parent) AS parent, min(conv_id) AS m, count(*) AS n_convs, max(bytes) AS bytes, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = n), '') AS ends FROM q GROUP BY d, node),
e AS (SELECT d - 1 AS d, parent AS node, count(*) AS n FROM g WHERE d > 0 GROUP BY 1, 2),
b AS (SELECT DISTINCT x.d, x.node, y.d AS low_d, y.node AS low FROM q x JOIN q y ON x.conv_id = y.conv_id AND y.d >= x.d),
w AS (SELECT b.d, b.node, count(*) FILTER (WHERE e.n IS NULL) AS n_leaves, sum((l.n_convs - 1) * l.bytes) AS saved FROM b JOIN g l ON l.d = b.low_d AND l.node = b.low LEFT JOIN e ON e.d = b.low_d AND e.node = b.low GROUP BY 1, 2)
SELECT g.m AS conv_id, CAST(g.d AS BIGINT) AS depth, f.m AS parent_conv_id, g.n_convs, CAST(coalesce(e.n, 0) AS BIGINT) AS n_children, w.n_leaves, CAST(w.saved AS BIGINT) AS saved_tokens, sha256(g.ends) AS ends_sha256
FROM g JOIN w ON w.d = g.d AND w.node = g.node LEFT JOIN e ON e.d = g.d AND e.node = g.node LEFT JOIN g f ON f.d = g.d - 1 AND f.node = g.parent"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
