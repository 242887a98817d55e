"""Fuzzy line dedup by SimHash and pigeonhole blocks, DataFrame functions only.

A line is normalised to its lower-cased words without signs, one blank between
them.  Equal normalised lines are one class.  The SimHash of a class has
``BLOCKS`` blocks of 16 bits.  Each distinct word of ``LETTERS`` letters or more (of
a line with fewer than ``FEW_WORDS`` such words, each word) is dealt to one block and
votes on the bits of that block alone, so that a changed word touches two blocks at
most and, by the pigeonhole principle, two lines that differ in fewer words than
there are blocks have untouched ones.  From each block on, as many blocks as hold
``LEAST_WORDS`` of these words (two blocks at least) are a key; classes with a common key are
candidates.  Those whose prints agree in ``AGREE`` blocks (two lines that fill
most of their blocks differ in the others by chance, where the key was all that
they share) are linked if their edit similarity is ``SIMILARITY`` or more.

Candidates of a bucket are first compared with its least class, and what these
links connect is one group.  Only pairs across groups are compared after that, and
all of them: every class outside the largest group of its bucket meets all members,
in tiles of a bounded number of classes.  A pair goes on to be verified if its
lengths, blocks and pairs of letters leave it possible: an edit takes two pairs of
letters from a line at most, so that a line with more than twice the allowed edits
of pairs that the other does not have is not alike.  So a bucket of copies costs a
comparison for each member; one of n unlike lines n * n / 2 tests of a few longs
where rows meet, and rows and edit distances only for what passes these.
Of a connected group the occurrence of the least (doc_id, line) stays; null ids
come last.

Defined results.  Lines without a word always stay.  A null or empty text has
no lines.  Rows that repeat both id and text are one document and get the same
result.  ``dedup_lines`` drops documents that had words and have none left.
Columns of ``docs`` can have any names; they are carried along in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Scratch
from .components import components
from .textsql import BREAK_IN_LINE, let, row_key, words_sql

SIMILARITY = 0.8
#: Blocks of a print, and words that the blocks of a key hold at least.
BLOCKS, LEAST_WORDS = 10, 4
#: Blocks that candidates agree in, if both fill ``FILLED`` blocks at least.
AGREE, FILLED = 3, 8
#: Letters of the words that vote, for the shortest words are in most lines; where
#: there are fewer words of that length than ``FEW_WORDS`` all vote.
LETTERS, FEW_WORDS = 4, 3
#: Blocks of a key: the first of these that holds enough words, else all.
SPANS = (2, 3, 4, 6)
#: Bits of a word's hash that vote; all are below bit 58, which the block is taken from.
VOTES = [b for k in range(0, 64, 8) for b in (k, k + 1)]
#: Longs of the map of a line's pairs of letters.
MAP = 16
#: Members outside the largest group of a bucket that meet all members in one task.
TILE = 1024
#: Edits that are tried before all that the similarity allows.
FEW_EDITS = (32, 128, 512, 2048, 8192)


def line_table(docs: DataFrame) -> DataFrame:
    """One row per line with a word: where it is, its class and its normal form."""
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), BREAK_IN_LINE, " ")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), row_key().alias("row_key"), F.posexplode(F.split(plain, "\n")).alias("pos", "line"))
    rows = rows.select(F.struct("doc", "pos", "row_key").alias("at"), F.trim("line").alias("norm")).where("norm != ''")
    return rows.select("at", F.xxhash64("norm").alias("k1"), F.xxhash64(F.lit("line"), "norm").alias("k2"), "norm")


def _counted(words: DataFrame, width: int) -> DataFrame:
    """k1 with the SimHash bits ``p`` and the number of words ``n`` of each block.

    A long holds ``64 / width`` counters; a line has fewer distinct words than
    ``1 << width - 2``.
    """
    lanes = 64 // width
    ones = sum(1 << width * i for i in range(lanes))
    most = (1 << width - 2) - 1
    shifts = [v for v in VOTES if v < width]
    words = words.select("k1", "h", F.expr(f"cast(shiftrightunsigned(shiftrightunsigned(h, 58) * {BLOCKS}, 6) as int)").alias("b"))
    sums = [F.expr(f"sum(if(b = {b}, shiftrightunsigned(h, {s}) & {ones}L, 0L))").alias(f"c{b}_{s}") for b in range(BLOCKS) for s in shifts]
    sizes = [F.expr(f"sum(if(b div {lanes} = {i}, shiftleft(1L, b % {lanes} * {width}), 0L))").alias(f"n{i}") for i in range(-(-BLOCKS // lanes))]
    counted = words.groupBy("k1").agg(*sizes, *sums)
    n = [F.expr(f"shiftrightunsigned(n{b // lanes}, {b % lanes * width}) & {(1 << width) - 1}L").alias(f"m{b}") for b in range(BLOCKS)]
    counted = counted.select("k1", *n, *[f"c{b}_{s}" for b in range(BLOCKS) for s in shifts])

    def bits(b: int) -> str:
        # A counter of more than half of the words reaches bit ``width - 2``.
        each = (f"shiftleft(shiftrightunsigned((c{b}_{s} + ({most} - m{b} div 2) * {ones}L) & {ones << width - 2}L, {width - 2}), {s})" for s in shifts)
        return " | ".join(each)

    return counted.select("k1", *[F.col(f"m{b}").alias(f"n{b}") for b in range(BLOCKS)], *[F.expr(bits(b)).alias(f"p{b}") for b in range(BLOCKS)])


def _keys() -> Column:
    """A key from each block on: its place, how many blocks it has, their bits and words."""
    total = " + ".join(f"n{b}" for b in range(BLOCKS))
    need = f"least({LEAST_WORDS}, greatest(2, {total} - 1))"
    keys = []
    for i in range(BLOCKS):
        whens = []
        for span in [*SPANS, BLOCKS]:
            own = [(i + k) % BLOCKS for k in range(span)]
            held = " + ".join(f"n{b}" for b in own)
            key = f"xxhash64({i}, {span}, {held}, {', '.join(f'p{b}' for b in own)})"
            whens.append(f"when {held} >= {need} then {key}" if span < BLOCKS else f"else {key}")
        keys.append(f"case {' '.join(whens)} end")
    return F.expr(f"array({', '.join(keys)})")


def class_keys(classes: DataFrame) -> DataFrame:
    """(k1, keys, blocks) of each class; ``blocks`` has a hash of each block, 0 where it is empty."""
    distinct = "array_distinct(split(norm, ' '))"
    longer = let(distinct, "ws", let(f"filter(ws, w -> length(w) >= {LETTERS})", "ls", f"if(size(ls) < {FEW_WORDS}, ws, ls)"))
    blocks = F.array(*[F.expr(f"if(n{b} = 0, 0, hash(n{b}, p{b}))") for b in range(BLOCKS)]).alias("blocks")

    def keyed(rows: DataFrame, width: int) -> DataFrame:
        rows = rows.select("k1", F.explode(F.expr(longer)).alias("w")).select("k1", F.xxhash64("w").alias("h"))
        return _counted(rows, width).select("k1", _keys().alias("keys"), blocks)

    # Counters of 16 bits hold the words of all but the longest lines, which are rare.
    long = F.length("norm") > 2 * ((1 << 14) - 2)
    if classes.where(long).isEmpty():
        return keyed(classes, 16)
    return keyed(classes.where(~long), 16).unionByName(keyed(classes.where(long), 32))


def _agreeing(u: str, v: str) -> str:
    """Whether prints agree in ``AGREE`` blocks, or one fills too few to ask for that."""
    same = " + ".join(f"int({u}[{b}] = {v}[{b}] and {u}[{b}] != 0)" for b in range(BLOCKS))
    few = " or ".join(" + ".join(f"int({c}[{b}] != 0)" for b in range(BLOCKS)) + f" < {FILLED}" for c in (u, v))
    return f"({same} >= {AGREE} or {few})"


def _verified(pairs: DataFrame, norms: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) between classes of the pairs (a, b) of k1 that are alike."""
    left = norms.select(F.col("k1").alias("a"), F.col("k2").alias("a2"), F.col("norm").alias("x"), F.col("blocks").alias("u"))
    right = norms.select(F.col("k1").alias("b"), F.col("k2").alias("b2"), F.col("norm").alias("y"), F.col("blocks").alias("v"))
    both = pairs.join(left, "a").join(right, "b").where(F.expr(_agreeing("u", "v"))).drop("u", "v")
    most = f"cast(floor({1 - similarity} * greatest(length(x), length(y)) + 1e-9) as int)"
    both = both.where(F.expr(f"abs(length(x) - length(y)) <= {most}"))
    both = both.select("a", "a2", "b", "b2", F.expr(most).alias("most"), F.split("x", " ").alias("x"), F.split("y", " ").alias("y"))
    # Words at both ends that are the same are no edits.
    same = "least(size({0}), size({1}), array_position(zip_with({0}, {1}, (v, w) -> v <=> w), false) - 1)"
    both = both.withColumn("head", F.expr(f"if(x = y, size(x), {same.format('x', 'y')})"))
    both = both.withColumn("x", F.expr("slice(x, cast(head as int) + 1, size(x))")).withColumn("y", F.expr("slice(y, cast(head as int) + 1, size(y))"))
    both = both.withColumn("tail", F.expr(f"if(size(x) = 0 or size(y) = 0, 0, {same.format('reverse(x)', 'reverse(y)')})"))
    both = both.withColumn("x", F.expr("slice(x, 1, size(x) - cast(tail as int))")).withColumn("y", F.expr("slice(y, 1, size(y) - cast(tail as int))"))
    # Words changed in place are not more edits than their letters.
    places = "aggregate(zip_with(x, y, (v, w) -> if(v <=> w, 0, if(v is null or w is null, coalesce(length(v), length(w)) + 1, greatest(length(v), length(w))))), 0, (s, n) -> s + n)"
    # Where nothing is left of one line, a blank goes with the words of the other.
    own = "concat(array_join({0}, ' '), if(size({0}) > 0 and (size(x) = 0 or size(y) = 0), ' ', ''))"
    both = both.select("a", "a2", "b", "b2", "most", F.expr(f"{places} <= most").alias("sure"), *[F.expr(own.format(c)).alias(c) for c in "xy"])
    edits = ["sure", *(f"most > {n} AND abs(length(x) - length(y)) <= {n} AND levenshtein(x, y, {n}) >= 0" for n in FEW_EDITS), "levenshtein(x, y, most) >= 0"]
    both = both.where(F.expr(" OR ".join(edits)))
    return both.select(F.struct(F.col("a").alias("k1"), F.col("a2").alias("k2")).alias("a"), F.struct(F.col("b").alias("k1"), F.col("b2").alias("k2")).alias("b"))


def _sketched(members: DataFrame, norms: DataFrame) -> DataFrame:
    """``members`` with the length, the blocks and the map of pairs of letters of each line."""
    # A pair of letters sets one of 64 * MAP bits.
    pairs = f"transform(slice(c, 1, size(c) - 1), (x, i) -> pmod(hash(x, c[i + 1]), {64 * MAP}))"
    bits = let("split(norm, '')", "c", f"array_distinct({pairs})")
    longs = let(bits, "bs", f"transform(sequence(0, {MAP - 1}), w -> aggregate(filter(bs, b -> b div 64 = w), 0L, (s, b) -> s | shiftleft(1L, b % 64)))")
    own = norms.join(members.select("k1").distinct(), "k1", "left_semi")
    return members.join(own.select("k1", F.length("norm").alias("letters"), "blocks", F.expr(longs).alias("grams")), "k1")


def _mixed(members: DataFrame) -> DataFrame:
    """Members (key, k1, label) of the buckets with more than one label, the largest label and the number of ``tiles`` of the others."""
    sizes = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
    tiles = F.ceil((F.col("n") - F.col("most.n")) / TILE).cast("int").alias("tiles")
    return members.join(sizes.where("groups > 1").select("key", tiles, F.col("most.label").alias("largest")), "key")


def _across(mixed: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) across labels of each bucket that length, blocks and maps leave possible.

    A tile of the members outside the largest group meets all members; what can't
    be alike is left out where they meet.
    """
    sides = ["key", "k1", "label", "letters", "blocks", "grams"]
    every = mixed.select(*sides, "largest", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    own = mixed.where("label != largest").select("key", *[F.col(c).alias(f"own_{c}") for c in sides[1:]], F.expr("pmod(hash(k1), tiles)").alias("tile"))
    most = f"floor({1 - similarity} * greatest(letters, own_letters) + 1e-9)"
    # An edit takes two pairs of letters from a line at most.
    lost = [" + ".join(f"bit_count({x}[{i}] & ~{y}[{i}])" for i in range(MAP)) for x, y in (("grams", "own_grams"), ("own_grams", "grams"))]
    # Two members outside the largest group meet twice.
    tests = ["label != own_label", "(label = largest or k1 < own_k1)", f"abs(letters - own_letters) <= {most}", _agreeing("blocks", "own_blocks"), *(f"{x} <= 2 * {most}" for x in lost)]
    met = every.join(own, ["key", "tile"]).where(F.expr(" and ".join(tests)))
    # One that all members meet is ``a``: edit distances are taken where ``b`` is.
    once = met.groupBy(F.least("k1", "own_k1").alias("x"), F.greatest("k1", "own_k1").alias("y")).agg(F.min("own_k1").alias("a"))
    return once.select("a", F.expr("if(a = x, y, x)").alias("b"))


def _joined(roots: DataFrame, edges: DataFrame, work: Scratch) -> DataFrame:
    """(node, root) of groups that ``edges`` connect further."""
    known = [roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab"]
    between = edges.join(known[0], "a", "left").join(known[1], "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    more = work.save(components(between, work, "later"), "joined")
    every = roots.unionByName(more.select("node", F.col("node").alias("root"))).distinct()
    return every.join(more.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))


def linked_classes(classes: DataFrame, work: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of each class (k1, k2) that has a link."""
    keys = work.save(class_keys(classes), "keys")
    keyed = keys.select("k1", F.explode(F.array_distinct("keys")).alias("key"))
    buckets = keyed.repartition("key").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("k1").alias("low")).where("n > 1")
    buckets = work.save(buckets, "buckets")
    members = work.save(keyed.join(buckets, "key").where("k1 != low"), "members_0")
    pairs = work.save(members.select(F.col("low").alias("a"), F.col("k1").alias("b")).distinct(), "pairs_0")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct()
    norms = classes.select("k1", "k2", "norm").join(keys.select("k1", "blocks").join(wanted, "k1", "left_semi"), "k1")
    norms = work.save(norms, "norms")
    work.drop("keys")
    links = work.save(_verified(pairs, norms, similarity), "links")
    work.drop("buckets", "pairs_0")
    # The least class of each bucket was compared with all others there.  What is
    # connected by now needs no more comparison.
    roots = work.save(components(links, work, "linked"), "roots")
    labels = roots.groupBy(F.col("node.k1").alias("k1")).agg(F.min("root.k1").alias("label"))
    members = members.where("n > 2").select("key", "k1").join(labels, "k1", "left").select("key", "k1", F.coalesce("label", "k1").alias("label"))
    mixed = work.save(_mixed(members), "mixed")
    work.drop("members_0", "links")
    mixed = work.save(_sketched(mixed, norms), "sketched")
    later = work.save(_verified(_across(mixed, similarity), norms, similarity), "later_links")
    if not later.isEmpty():
        roots = work.save(_joined(roots, later, work), "roots_of_all")
    work.drop("norms", "mixed", "sketched", "later_links")
    return roots


def line_groups(docs: DataFrame, work: Scratch, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The table of lines, and (k1, k2, stays) of each class with two lines or links; ``stays`` is where the line is that stays."""
    texts = work.save(line_table(docs), "normal")
    classes = texts.groupBy("k1", "k2").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n_lines"), F.first("norm").alias("norm"))
    classes = work.save(classes, "classes")
    # From here on the places of lines do without what is in them.
    texts = work.save(texts.select("k1", "k2", "at"), "texts")
    work.drop("normal")
    roots = linked_classes(classes, work, similarity)
    node = F.struct("k1", "k2")
    own = classes.select("k1", "k2", "at", "n_lines", node.alias("node")).join(roots, "node", "left").where("n_lines > 1 OR root IS NOT NULL")
    own = work.save(own.select("k1", "k2", "at", "root"), "grouped")
    first = own.where("root IS NOT NULL").groupBy("root").agg(F.min("at").alias("stays"))
    joined = own.where("root IS NOT NULL").join(first, "root").select("k1", "k2", "stays")
    groups = work.save(joined.unionByName(own.where("root IS NULL").select("k1", "k2", F.col("at").alias("stays"))), "groups")
    work.drop("classes", "grouped")
    return texts, groups


def doubled_lines(docs: DataFrame, work: Scratch, **options) -> DataFrame:
    """(row_key, gone): the numbers of the lines of each document that do not stay."""
    lines, groups = line_groups(docs, work, **options)
    # Written before it is grouped, so that the join of a line that is
    # everywhere can be split over tasks.
    gone = work.save(lines.join(groups, ["k1", "k2"]).where("at != stays").select("at.row_key", "at.pos"), "gone")
    work.drop("texts", "groups")
    return gone.groupBy("row_key").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def kept_lines(docs: DataFrame, **options) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``lines``: n_lines, n_removed, kept text."""
    work = Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"), row_key().alias("row_key"))
    gone = doubled_lines(docs.select("doc_id", "text"), work, **options)
    joined = rows.join(gone.hint("shuffle_hash"), "row_key", "left")
    left = let("split(text, '\\n')", "ls", "array_join(filter(ls, (l, i) -> not array_contains(gone, i)), '\\n')")
    counted = F.struct(
        F.when(F.length(F.coalesce("text", F.lit(""))) > 0, F.size(F.split("text", "\n"))).otherwise(0).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.expr(left)).alias("kept"),
    )
    return joined.select("row", counted.alias("lines"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the lines that stay; documents that lost all words go."""
    rows = kept_lines(docs, **options).where(f"lines.n_removed = 0 OR size({words_sql('lines.kept')}) > 0")
    new = {"text": F.col("lines.kept"), "n_chars": F.length("lines.kept").cast("long")}
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return kept_lines(docs).select("row.doc_id", "lines.n_lines", "lines.n_removed", F.sha2(F.coalesce("lines.kept", F.lit("")), 256).alias("kept_sha256"))
