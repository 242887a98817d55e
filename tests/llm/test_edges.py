"""Nulls, blanks, repeated rows, empty tables and clashing names."""

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parafold.llm import chunks, decontamination, jaccard, katz, lines, packing, pii, quality, substrings, toxicity, warc
from parafold.scratch import Scratch

EXTRA = "verdict lines row_key class_id shared row key _leaked k1 at gone score toxic kind chunk part".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ROWS = [
    (1, None), (2, ""), (3, "  \n\t"), (4, ITEM + "\nlast line of it"), (4, ITEM + "\nlast line of it"), (None, "no id here but some words in it and more of them\n" + ITEM), (5, "x"), (6, "word " * 30000), (7, "ünï 😀 code"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", "s", 0, *EXTRA) for d, t in ROWS], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, None), (None, 1, 1), (6, None, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, "short"), (4, "")], "item_id long, text string")


def test_quality(docs, labels):
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 4, 4]
    assert quality.keep_good(docs.limit(0), labels.limit(0)).count() == 0


def test_lines(docs):
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id or 0), (r.text or "")[:20]) for r in out.collect())
    # Both rows that repeat id 4 stay; the row without an id loses the line of 4.
    assert got == [(0, "no id here but some "), (1, ""), (2, ""), (3, "  \n\t"), (4, ITEM[:20]), (4, ITEM[:20]), (5, "x"), (6, ("word " * 5)[:20]), (7, "ünï 😀 code")]
    assert all(r.n_chars == len(r.text) for r in out.where("text is not null").collect())
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_near_copies(docs):
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_near_copies_of_one_id(spark):
    """Rows of one id with different texts are documents of their own."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(4, text, "a"), (4, "another text " + text[::-1], "b"), (3, text + " end", "c"), (4, text, "d"), (None, "no id", "e"), (None, "no id", "e")]
    out = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, class_id string")).collect()
    assert sorted((r.doc_id or 0, r.text[:7]) for r in out) == [(0, "no id"), (3, text[:7]), (4, "another")]


def test_recall_out_of_reach():
    with pytest.raises(ValueError):
        jaccard.choose_bands(0.01, 0.9999)


def test_toxicity_of_edges(docs, labels):
    found = docs.select("doc_id", toxicity.score(docs, toxicity.learn(docs, labels)).alias("s")).collect()
    assert len(found) == len(ROWS) and all(0 <= r.s <= 1 for r in found)
    assert len({r.s for r in found if r.doc_id in (1, 2, 3)}) == 1
    assert len({r.s for r in found if r.doc_id == 4}) == 1
    for none in (labels.limit(0), labels.where("toxic = 1")):
        assert toxicity.learn(docs, none) is None and {r.s for r in docs.select(toxicity.score(docs, None).alias("s")).collect()} == {0.0}
    assert docs.limit(0).select(toxicity.score(docs, toxicity.learn(docs, labels))).count() == 0


def test_katz_of_edges(docs):
    out = katz.score_by_katz(docs, F.col("doc_id") == 7).collect()
    got = sorted(((r.doc_id or 0), r.n_tokens, r.held_out) for r in out)
    assert got == sorted([(1, 1, False), (2, 1, False), (3, 1, False), (4, 19, False), (4, 19, False), (0, 27, False), (5, 2, False), (6, 30001, False), (7, 4, True)])
    assert all(r.score < 0 for r in out)


def test_substrings_of_edges(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:60]) + "\n" + " ".join(words[60:])), (3, None), (4, ""), (5, " ".join(words[:49])), (6, "word " * 30000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, chunk string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(docs).collect()}
    assert got == {1: (120, 0), 2: (120, 120), 3: (0, 0), 4: (0, 0), 5: (49, 0), 6: (30000, 0)}
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_substrings_of_odd_ids(spark):
    """A null id keeps all and takes nothing; rows of one id take nothing from each other."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (3, text), (3, text), (7, text + " end"), (7, text + " end"), (None, text), (2, "short text")]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed) for r in got) == [(-1, 60, 0), (-1, 60, 0), (2, 2, 0), (3, 60, 0), (3, 60, 0), (7, 61, 60), (7, 61, 60)]
    assert {r.kept for r in got if r.doc_id == 7} == {"end"}


def test_warc_of_odd_ids(spark):
    """A null page id is the smallest; a payload of null ids alone has no revisits; repeated rows are archived one by one."""
    rows = [(None, "http://a.b/x", "<p>one</p>"), (4, "http://a.b/x", "<p>one</p>"), (None, "http://c.d", "<p>two</p>"), (None, "http://c.d", "<p>two</p>"), (9, "http://e.f", "<p>three</p>"), (9, "http://e.f", "<p>three</p>"), (8, "http://e.f", "<p>three</p>")]
    got = warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    kinds = [(r.payload_bytes, -1 if r.page_id is None else r.page_id, r.record_type, r.refers_to) for r in got]
    key = lambda r: (*r[:3], r[3] or 0)
    want = [(10, -1, "revisit", 4), (10, 4, "response", None), *[(10, -1, "response", None)] * 2, *[(12, 9, "response", None)] * 2, (12, 8, "revisit", 9)]
    assert sorted(kinds, key=key) == sorted(want, key=key)


def test_warc_of_edges(spark):
    rows = [(1, "http://a.b/x", None), (2, None, ""), (3, "http://a.b/x", "<p>ü</p>"), (4, "http://c.d", "<p>ü</p>"), (5, "http://c.d", "x" * 300000)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_and_read(pages).collect()}
    assert got == {1: (0, "revisit", 2), 2: (0, "response", None), 3: (9, "revisit", 4), 4: (9, "response", None), 5: (300000, "response", None)}
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_packing_plans():
    """No more sequences than best fit, all pieces placed; the search finds what best fit misses."""
    import random
    from collections import Counter

    rng = random.Random(1)
    for _ in range(40):
        counts = Counter(rng.randint(1, 100) for _ in range(rng.randint(1, 60)))
        plan = packing.plan_fillings(counts, 100, 20_000)
        assert all(sum(f) <= 100 for f, _ in plan) and sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(counts, 100))
        placed = Counter()
        for f, n in plan:
            for s in f:
                placed[s] += n
        assert placed == counts
    hard = Counter({44: 2, 24: 2, 22: 2, 21: 2, 17: 2, 8: 2, 6: 4})
    assert sum(n for _, n in packing.plan_fillings(hard, 100)) == 3


def test_leaks(docs, benchmark):
    out = decontamination.drop_leaks(docs, benchmark)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 5, 6, 7]
    found = decontamination.find_leaks(docs, benchmark)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(4, 1), (None, 1)}
    assert decontamination.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontamination.find_leaks(docs.limit(0), benchmark).count() == 0


def test_personal_data(docs):
    out = pii.find_personal_data(docs).collect()
    assert len(out) == len(ROWS) and not any(r.spans for r in out)
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_packing_of_edges(spark, docs):
    out = corpus_pipeline.packing(spark, docs, "")
    whole = out.groupBy("doc_id", "start").agg(F.count("*").alias("n"))
    assert {r.doc_id for r in whole.collect()} == {None, 1, 2, 3, 4, 5, 6, 7}
    assert corpus_pipeline.packing(spark, docs.limit(0), "").count() == 0


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    used = rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert 0 < used <= 2048 and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_copies", "decontamination", "packing"]


def test_pipeline_of_known_cases(spark, tmp_path):
    """Each stage takes what it is for, and leaves the rest."""
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
    clean = {i: [[word() for _ in range(20)] for _ in range(3)] for i in range(30)}
    text = lambda lines: "\n".join(" ".join(x) for x in lines)
    docs = {i: text(x) for i, x in clean.items()}
    docs[100] = docs[1]  # all lines are those of 1
    docs[101] = text([clean[2][0], [*clean[2][1][:9], "other", *clean[2][1][10:]], clean[2][2]])  # a word changed
    flat = sum(clean[3], [])
    docs[102] = text([flat[:10], flat[10:30], flat[30:50], flat[50:]])  # other lines, the same words
    item = [word() for _ in range(30)]
    docs[103] = text([[*(word() for _ in range(15)), *item, *(word() for _ in range(15))]])
    docs[104] = "too short"
    docs[105] = "the same again " * 30
    docs[106] = text([clean[4][0], *([word() for _ in range(20)] for _ in range(2))])  # one line of 4, two of its own
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left, want = frame, set(docs)
    for (_, stage), gone in zip(corpus_pipeline.STAGES[:-1], [{104, 105}, {100, 101}, {102}, {103}], strict=True):
        left = stage(spark, left, str(tmp_path))
        want -= gone
        kept = {r.doc_id: r.text for r in left.collect()}
        assert set(kept) == want and left.columns == frame.columns
    assert all(kept[d] == docs[d] for d in want - {106}) and kept[106] == "\n".join(docs[106].split("\n")[1:])
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want


def test_tokens_that_48_bits_confuse():
    """Keys of single tokens keep all bits, so that two that agree in the first 48 are counted apart."""
    import numpy as np

    def unmixed(y):
        for shift, factor in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9), (30, None)):
            x = y
            for _ in range(64 // shift):
                x = y ^ (x >> shift)
            y = x * pow(factor, -1, 1 << 64) % (1 << 64) if factor else x
        return y

    near = [k for k in (unmixed(0xABCDEF012345 << 16 | low) for low in range(64)) if k % 8 == 3][:2]
    keys = np.array(near, np.uint64)
    assert len(set(katz.Asked(keys, 8).keys.tolist())) == 1
    asked = katz.Asked(keys, 8, katz.TOKEN_BITS)
    rows = asked.rows(0, np.array([5, 7])[np.argsort(asked.inverse)])
    table = pa.Table.from_batches([chunks.blob_batch(rows)])
    answers = {r["part"]: r["blob"] for r in katz._answer_counts(table).to_pylist() if r["chunk"] == 0}
    assert asked.read(answers, np.int64, np.int8)[0][asked.inverse].tolist() == [5, 7]


def test_template_lines_meet_by_their_parts(spark, monkeypatch):
    """Lines of one template with long random tokens are compared about as often as there are lines; a letter changed in a token is found."""
    import random

    rng, asked = random.Random(3), []
    verified = lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))

    def run(n):
        tokens = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(n)]
        docs = [(i, f"see the old log for it at {t} now") for i, t in enumerate([*tokens, tokens[0][:30] + "0" + tokens[0][31:]])]
        asked.clear()
        kept = lines.kept_lines(spark.createDataFrame(docs, "doc_id long, text string"))
        return {r.row.doc_id for r in kept.where("lines.n_removed > 0").collect()}, sum(asked)

    for n in (150, 300):
        gone, pairs = run(n)
        assert gone == {n} and pairs < 15 * n


def test_lines_changed_in_every_word_meet_in_large_buckets(spark, monkeypatch):
    """In a large bucket all pairs across groups are compared, also where no word is the same; tiles change nothing."""
    import random

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    spoil = lambda w: w[:4] + "0" + w[5:]  # noqa: E731  a letter of nine, so that neither end of the word is left
    plain = [[word(9) for _ in range(9)] for _ in range(12)]
    rows = [" ".join(ws) for ws in plain] + [" ".join(map(spoil, ws)) for ws in plain] + ["a", "", "日本 x"]
    norms = spark.createDataFrame([(i, -i, r, [7] * lines.BLOCKS) for i, r in enumerate(rows)], "k1 long, k2 long, norm string, blocks array<int>")
    members = norms.selectExpr("1L AS key", "k1", "k1 AS label")
    want = {(i, i + 12) for i in range(12)}
    for tile in (lines.TILE, 5):
        monkeypatch.setattr(lines, "TILE", tile)
        pairs = lines._across(lines._sketched(lines._mixed(members), norms), lines.SIMILARITY)
        got = [tuple(sorted((r.a, r.b))) for r in pairs.collect()]
        assert len(got) == len(set(got)) and want <= set(got) and len(got) < len(rows)
    alike = lines._verified(pairs, norms, lines.SIMILARITY).collect()
    assert {tuple(sorted((r.a.k1, r.b.k1))) for r in alike} == want


def test_components_stop_at_stars(spark):
    """Chains, hubs and stars that are stars from the start; each node has the least of its own."""
    from parafold.llm.components import components
    from parafold.scratch import Scratch

    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (10, 12), (13, 10), (20, 20), (None, 3), (30, 31), (32, 31)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {(n, 1) for n in range(1, 6)} | {(n, 10) for n in range(10, 14)} | {(n, 30) for n in (30, 31, 32)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_dropping_tables_collects_the_drivers_garbage(spark):
    """What the driver no longer holds is gone once a table is dropped, not when its heap is full."""
    import gc
    import time

    from parafold.scratch import Scratch

    work = Scratch(spark, "test")
    work.save(spark.range(3), "three")
    jvm = spark.sparkContext._jvm
    held = jvm.java.lang.Object()
    weak = jvm.java.lang.ref.WeakReference(held)
    del held
    gc.collect()
    time.sleep(3)  # Py4J tells the JVM in a thread of its own
    work.drop("three")
    assert weak.get() is None
