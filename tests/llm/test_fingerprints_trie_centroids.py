"""Fingerprints, prefix trie and clustering against plain Python and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from parafold.llm import centroids, fingerprints, prefix_trie
from parafold.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_centroid_clustering"])
def test_by_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


# ------------------------------------------------------------------ fingerprints

MASK, STEP = (1 << 64) - 1, 0x9E3779B97F4A7C15


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def plain_simhash(text):
    keys = [xxhash.xxh3_64_intdigest(w) for w in re.findall(r"[^\x20\x09-\x0d]+", text)]
    terms = Counter(mixed((k + 1) & MASK) >> 16 for k in keys)
    terms += Counter(mixed((mixed((a + 1) & MASK) * STEP + b + 2) & MASK) >> 16 for a, b in zip(keys, keys[1:], strict=False))
    votes = [0] * 256
    for term, n in terms.items():
        weight = min(1 + int(math.log2(n)), 15)
        bits = b"".join(mixed((term + (i + 1) * STEP) & MASK).to_bytes(8, "little") for i in range(4))
        for b in range(256):
            votes[b] += weight if bits[b // 8] >> (7 - b % 8) & 1 else -weight
    return sum(1 << (255 - b) for b in range(256) if votes[b] > 0).to_bytes(32, "big")


def apart(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_simhash_of_odd_texts():
    texts = ["", " \n", "one", "one two", "a " * 70_000, "日本 語 x\x0b", "z" * 100_000] + ["w%d x" % (i % 7) for i in range(50)]
    got = fingerprints.simhash(pa.array(texts, pa.large_string()))
    assert [g.tobytes() for g in got] == [plain_simhash(t) for t in texts]


def test_fingerprints(spark):
    """Whole rows against a plain version: nulls, blanks, repeated rows and ids, long texts, clashing names."""
    rng = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "é" * 7), (3, rows[3][1]), (7, "another text of id 7"), (503, rows[3][1]), (None, "no id"), (None, None), (504, "long " * 30_000)]
    table = spark.createDataFrame([(i, t, "clash", 1, True) for i, t in rows], "doc_id long, text string, fingerprint string, part int, first boolean")
    got = [r.asDict() for r in fingerprints.fingerprint_edits(table.repartition(5)).collect()]
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    for i in texts:  # the order among rows of one id is by a hash; their number is what counts
        if len(texts[i]) == 1:
            (r,) = (r for r in got if r["doc_id"] == i)
            assert r["n_chars"] == len(texts[i][0]) and bytes(r["fingerprint"]) == plain_simhash(texts[i][0])
    order = sorted((i for i in texts if i is not None), reverse=True)
    for i, after in zip(order, [*order[1:], None], strict=True):
        if len(texts[i]) == 1 and after is not None and len(texts[after]) == 1:
            a, b = texts[i][0], texts[after][0]
            new = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
            (r,) = (r for r in got if r["doc_id"] == i)
            assert bytes(r["edited_sha256"]) == hashlib.sha256(new.encode()).digest() and bytes(r["edited_fingerprint"]) == plain_simhash(new)
            assert r["near_edited"] == 1 - apart(plain_simhash(a).hex(), plain_simhash(new).hex()) / 256
            assert r["near_next"] == 1 - apart(plain_simhash(a).hex(), plain_simhash(b).hex()) / 256
    assert fingerprints.fingerprint_edits(table.limit(0)).count() == 0
    (alone,) = fingerprints.fingerprint_edits(table.where("doc_id = 502")).collect()
    assert alone["near_next"] == 1.0 and bytes(alone["edited_sha256"]) == hashlib.sha256(("é" * 7).encode()).digest()


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_neighbours_by_brute_force(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(256) for _ in range(12)]
    marks = {b for b in base} | {b ^ sum(1 << x for x in rng.sample(range(256), rng.randint(0, 12))) for b in base for _ in range(15)}
    marks = sorted(m.to_bytes(32, "big") for m in marks)
    table = spark.createDataFrame([(bytearray(m),) for m in marks] * 2 + [(None,)], "fingerprint binary")
    asked = spark.createDataFrame([(bytearray(m),) for m in marks[::5]] + [(bytearray(32),)], "fingerprint binary")
    got = sorted((bytes(r["query"]), bytes(r["found"]), r["distance"]) for r in fingerprints.neighbours(table, asked, radius).collect())
    far = lambda a, b: apart(a.hex(), b.hex())
    assert got == sorted((q, m, far(q, m)) for q in marks[::5] for m in marks if far(q, m) <= radius)


def test_neighbours_send_no_table_whole(spark):
    """Block tables of few queries are shuffled too, so that little and much data have one plan."""
    marks = spark.range(100).selectExpr("unhex(sha2(string(id), 256)) AS fingerprint")
    plan = fingerprints.neighbours(marks, marks.limit(2))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_fingerprint_query(spark):
    got = QUERIES["op11_fingerprints"](spark, DIR).collect()
    docs = pq.read_table(f"{DIR}/documents.parquet").to_pandas()
    assert sorted(r.doc_id for r in got) == sorted(docs.doc_id)
    assert all(r.n_near == sum(apart(r.fingerprint, o.fingerprint) <= fingerprints.RADIUS for o in got) for r in got if r.doc_id % 50 == 0)
    assert all(r.n_near is None for r in got if r.doc_id % 50)
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.97


# ------------------------------------------------------------------- prefix trie


def plain_trie(rows, family=5, heads=9):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, role, mark, text))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % heads
        rebuilt[c] = turns.get(c - c % family, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, x in rebuilt.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(node))
        children = sum(len(n) == len(node) + 1 for n in below)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of_trie(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_trie_by_plain_version(spark):
    """Random conversations, a long one, many copies, null turns and texts, ties, repeated rows, absent bases, turnless ones."""
    rng = random.Random(3)
    rows = []
    for c in range(0, 90):
        if c % 5 or rng.random() < 0.7:
            rows += [(c, None if rng.random() < 0.1 else t, rng.choice(["user", "bot", None]), rng.choice(["a", "b", "", None, "é"])) for t in range(rng.randint(1, 7))]
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1150) for t in range(9)]
    rows += [(2000, t, "user", "same" if t < 30 else str(t)) for t in range(50)] + [(2001, t, "user", "same") for t in range(40)]
    rows += [(31, 2, "user", "a")] * 3 + [(None, 1, "user", "nobody"), (-7, 0, "user", "a")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATIONS + ", pos int, name string")
    want = plain_trie([r for r in rows if r[0] is None or r[0] >= 0])
    kept = table.where("conv_id IS NULL OR conv_id >= 0")
    assert rows_of_trie(prefix_trie.prefix_trie(kept.repartition(6), block=4, id_bits=3)) == want
    assert any(r[1] == 0 and r[6] > 0 for r in want) and sum(r[3] > 100 for r in want) >= 9


def test_trie_of_little(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie.prefix_trie(empty).count() == 0
    lone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    rows = [(lone, 0, "user", "gone")]  # its first turns come from a conversation that is not there
    assert rows_of_trie(prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS))) == plain_trie(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


# --------------------------------------------------------------------- centroids


def plain_clusters(rows, k, rounds):
    kept = [(i, [math.floor(256 * float(np.float32(v))) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    seeds = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)[:k]
    at = [x for _, x in seeds]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    for step in range(rounds + 1):
        mine = [min((far(x, c), n) for n, c in enumerate(at)) for _, x in kept]
        if step < rounds:
            for n in range(len(at)):
                own = [x for (_, x), (_, m) in zip(kept, mine, strict=True) if m == n]
                if own:
                    at[n] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    spread = Counter()
    for d, n in mine:
        spread[n] += d
    mark = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, n, d, spread[n], sum(spread.values()), mark[n]) for (i, _), (d, n) in zip(kept, mine, strict=True)), key=repr)


@pytest.mark.parametrize("k,kind", [(40, "spread"), (6, "grid"), (9, "copies"), (1, "spread"), (40, "few")])
def test_clusters_by_plain_version(spark, k, kind):
    """Ties on a grid, many copies, empty clusters, fewer vectors than centroids, vectors that are left out."""
    rng = np.random.default_rng(k)
    n = {"few": 7}.get(kind, 260)
    if kind == "grid":
        x = rng.integers(-1, 2, (n, 64)) * (np.arange(64) < 3) / 2
    elif kind == "copies":
        x = np.repeat(rng.normal(size=(5, 64)), n // 5, axis=0)
    else:
        x = rng.normal(size=(8, 64))[rng.integers(0, 8, n)] + 0.1 * rng.normal(size=(n, 64))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [rows[0], (None, rows[1][1]), (900, None), (901, [1.0] * 63), (902, [None, *[1.0] * 63]), (903, [math.nan, *[1.0] * 63]), (904, [math.inf, *[1.0] * 63]), (905, [])]
    table = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, cluster int, vector string")
    got = sorted((tuple(r) for r in centroids.cluster(table.repartition(3), k).collect()), key=repr)
    assert got == plain_clusters(rows, k, 5)


def test_clusters_of_nothing(spark):
    table = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert centroids.cluster(table).count() == centroids.cluster(table.limit(0)).count() == 0
    big = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(big).collect()


def test_search_looks_at_fewer():
    """Bounds and balls leave most distances out, and never change a cluster."""
    rng = np.random.default_rng(1)
    middle = rng.integers(-4000, 4000, (40, 64)).astype(float)
    x = middle[rng.integers(0, 40, 3000)] + rng.integers(-300, 300, (3000, 64))
    at, moved = x[:40].copy(), np.zeros(40)
    a, upper, lower = np.full(3000, -1), np.full(3000, np.inf), np.zeros(3000)
    looks = []
    for _ in range(6):
        a, upper, lower, looked = centroids.search(x, a, upper, lower, centroids.Centroids(at, moved))
        assert (a == ((x[:, None, :] - at[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
        new = np.array([np.floor(x[a == n].mean(axis=0)) if (a == n).any() else at[n] for n in range(40)])
        moved, at = np.sqrt(((new - at) ** 2).sum(axis=1)), new
        looks.append(looked)
    assert looks[0] == 120_000 and sum(looks[1:]) < 0.35 * 5 * 120_000


# ----------------------------------------------------------- units of the packing


def test_units_that_one_hash_confuses(spark):
    """A word of the Thue-Morse kind and its complement have equal polynomial hashes modulo 2**64, and ids of their own."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from parafold.llm.packing import encoder, pack

    word = [bin(i).count("1") % 2 for i in range(2048)]
    texts = ["".join("ab"[b] for b in word), "".join("ba"[b] for b in word), "one two, one two", ""]
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, at = encoder(path).encode(pa.array(texts, pa.large_string()))
    whole = Tokenizer.from_file(path)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids_crc32 for r in pack(rows, path).collect() if r.piece == 0}
    assert got[0] != got[1]


# ------------------------------------------------------------ matches of one text


def test_places_of_many_matches(spark):
    """Places of a text's matches, over many chunks; twice the matches take about twice the time, not four times."""
    import time

    from pyspark.sql import functions as F

    from parafold.llm.pii import matches_sql

    def places(n):
        text = "".join(f"é{i % 90 + 10} " for i in range(n))
        rows = spark.createDataFrame([(text,), ("",), ("none",)], "text string").coalesce(1)
        began = time.time()
        got = [[(x.start, x.m, x.before[-1:], x.after[:1]) for x in r.x] for r in rows.select(F.expr(matches_sql("text", "[0-9]+")).alias("x")).collect()]
        want = [(m.start(), m[0], text[m.start() - 1], text[m.end() : m.end() + 1]) for m in re.finditer("[0-9]+", text)]
        assert got == [want, [], []]
        return time.time() - began

    for n in (1, 63, 64, 65, 200):
        places(n)
    small, large = min(places(8_000) for _ in range(2)), places(32_000)
    assert large < 10 * small
