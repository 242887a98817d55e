"""The operators on whole tables against plain Python, on the smallest tables."""

import binascii
import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parafold.llm import decontamination, jaccard, katz, lines, packing, pii, quality, substrings, toxicity, warc
from parafold.scratch import Scratch

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def crc(doc_id):
    return binascii.crc32(str(doc_id).encode())


@pytest.mark.parametrize("name,query,sql", [("op7", warc.op7_warc, warc.OP7_SQL), ("op8", substrings.op8_substring_dedup, substrings.OP8_SQL)])
def test_against_sql(spark, name, query, sql):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in query(spark, DIR).select(*columns).collect())


def test_toxicity(spark, texts):
    rows = toxicity.op1_toxicity(spark, DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_toxicity_held_out(spark):
    """Documents whose labels were not learned from, told apart by invented insults with endings of their own."""
    import random

    rng = random.Random(7)
    part = lambda: rng.choice("re th an in er on at en nd ti es or te of ed is it al ar st".split())
    word = lambda: "".join(part() for _ in range(rng.randint(1, 4)))
    docs = []
    for i in range(600):
        words = [word() for _ in range(60)]
        for _ in range(4 if i % 6 == 0 else 0):
            words[rng.randrange(60)] = "scumz" + part()
        docs.append((i, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.learn(frame.where("doc_id % 3 != 1 AND doc_id < 300 OR doc_id >= 300 AND doc_id % 2 = 0"), labels)
    held = frame.where("doc_id < 300 AND doc_id % 3 = 1 OR doc_id >= 300 AND doc_id % 2 = 1 OR doc_id IN (0, 12)")
    got = {r.doc_id: r.s for r in held.select("doc_id", toxicity.score(held, model).alias("s")).collect()}
    clean = [s for d, s in got.items() if d % 6]
    assert min(got[0], got[12]) > 0.7 and sum(s < 0.5 for s in clean) >= 0.97 * len(clean)


def test_toxicity_probabilities(spark):
    """Differences of words against plain recursion over dictionaries; all signs together have probability one."""
    texts = ["bad baad bald", "bad dab", "good bald old", "old gold", "bold old good god", "a", "bad bad add", "do"]
    toxic = [1, 1, 0, 0, 0, 0, 1, 0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"))
    own = [Counter(), Counter()]
    for t, x in zip(texts, toxic, strict=True):
        for w in set(t.split()):
            w = f"^{w}^"
            for i in range(1, len(w)):
                own[1 - x][w[max(0, i - toxicity.ORDER) : i + 1]] += 1
    levels = [[Counter({g: n for g, n in c.items() if len(g) == k + 1}) for c in own] for k in range(toxicity.ORDER + 1)]
    for k in range(toxicity.ORDER - 1, -1, -1):
        for low, high in zip(levels[k], levels[k + 1], strict=True):
            low.update(g[1:] for g in list(high))
    off = [[toxicity.discount(np.array([c[g] for g in levels[k][0] | levels[k][1]])) for c in levels[k]] for k in range(toxicity.ORDER + 1)]
    signs = {g for c in levels[0] for g in c}

    def p(context, sign):
        if not context:
            n = [sum(c.values()) for c in levels[0]]
            return [(levels[0][0][sign] + levels[0][1][sign] + 1) / (sum(n) + len(signs) + 1)] * 2
        lower, k = p(context[1:], sign), len(context)
        kept, rest = [], []
        for c, d in zip(levels[k], off[k], strict=True):
            seen = {g: n for g, n in c.items() if g[:-1] == context}
            kept.append({g[-1]: max(n - d, 0) for g, n in seen.items()})
            rest.append(1 - sum(kept[-1].values()) / sum(seen.values()) if seen else 1.0)
        out = []
        for own_, low in zip(kept, lower, strict=True):
            total = sum(own_.values())
            out.append((1 - max(rest)) * (own_.get(sign, 0) / total if total else low) + max(rest) * low)
        return out

    words = ["bad", "gold", "baad", "zebra", "badgood", "x"]
    want = []
    for w in words:
        w = f"^{w}^"
        ps = [p(w[max(0, i - toxicity.ORDER) : i], w[i]) for i in range(1, len(w))]
        want.append(sum(math.log(a) - math.log(b) for a, b in ps))
    assert model.differences(words) == pytest.approx(want, abs=1e-4)
    for context in ["", "^", "^b", "ba", "^ba", "zz", "old"]:
        for one in zip(*(p(context, s) for s in [*signs, "?"]), strict=True):
            assert sum(one) == pytest.approx(1)


def test_toxicity_of_a_sample_keeps_the_share_of_all_labels(spark):
    """Words say nothing here, so that a mean score is the share of toxic labels, one ninth."""
    import random

    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("red green blue black white".split()) + str(rng.randrange(30)) for _ in range(20))) for i in range(1350)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(1350)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, sample_rows=100)
    mean = docs.select(toxicity.score(docs, model).alias("s")).agg({"s": "avg"}).first()[0]
    assert 0.05 < mean < 0.2


def test_toxicity_counts_rare_words_of_a_large_sample(spark):
    many = " ".join(f"{i}" for i in range(100_000, 310_000))
    docs = spark.createDataFrame([(i, many) for i in range(4)] + [(4 + i, f"qxqzqx w{i}") for i in range(4)], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "concat(text, ' x', doc_id) as text")  # texts differ
    model = toxicity.learn(docs, docs.selectExpr("doc_id", "int(doc_id >= 4) as toxic"))
    n, kinds = model.grams[5].get(toxicity.Spelling(["qxqzqx"]).keys(5)[1]), model.grams[0].values.sum()
    assert (n[:, 0] > 0).all() and not n[:, 1].any() and kinds > 0


def test_quality_counts(spark, texts):
    for r in quality.op2_quality_rules(spark, DIR).collect():
        text = texts[r.doc_id]
        words = WORD.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and not (r.base_failed and r.kept)


def _tokens(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text)] + ["\n"]


def test_katz_base_and_model(spark, texts):
    rows = katz.op3_katz_backoff(spark, DIR).collect()
    counts = Counter(t for d, x in texts.items() if crc(d) % 7 != 2 for t in _tokens(x))
    total, distinct = sum(counts.values()), len(counts)
    for r in rows:
        own = _tokens(texts[r.doc_id])
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(t in counts for t in own), total, crc(r.doc_id) % 7 == 2)
        assert r.base_score == pytest.approx(base, abs=1e-4)
    seen = [r for r in rows if not r.held_out]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)


class PlainKatz:
    """Katz backoff over dictionaries, recursive, for one corpus of token lists."""

    def __init__(self, corpus, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for tokens in corpus:
            padded = ["<s>"] * (order - 1) + tokens
            for i in range(order - 1, len(padded)):
                for k in range(1, order + 1):
                    self.counts[k][tuple(padded[i - k + 1 : i + 1])] += 1
        of = [np.array([sum(n == r for n in c.values()) for r in range(1, katz.LARGEST + 2)]) for c in self.counts]
        self.one = katz.Unigrams(sum(self.counts[1].values()), len(self.counts[1]), of[1])
        self.ratios = [None, None, *(katz.discounts(o) for o in of[2:])]
        self.after = defaultdict(list)
        for k in range(2, order + 1):
            for gram in self.counts[k]:
                self.after[gram[:-1]].append(gram[-1])

    def share(self, n, k):
        return n * (self.ratios[k][n] if n < len(self.ratios[k]) else 1.0)

    def p(self, word, context):
        if not context:
            return float(self.one.p(np.array([self.counts[1][word,]]))[0])
        k = len(context) + 1
        seen = [self.counts[k][*context, w] for w in self.after[context]]
        if not seen:
            return self.p(word, context[1:])
        lost = sum(n - self.share(n, k) for n in seen)
        below = sum(seen) if lost > 0 else sum(seen) + 1
        if n := self.counts[k][*context, word]:
            return self.share(n, k) / below
        rest = 1 - sum(self.p(w, context[1:]) for w in self.after[context])
        return (lost if lost > 0 else 1) / below / rest * self.p(word, context[1:])


KATZ = ["a b c a b", "A b a b c d", "c d c d e a", "", "a", None, "b c a b c\ta  b", "e e e e e a b c", "a b c d e", "unseen words b c", "d a unseen", "a b c a b"]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_against_recursion(spark, order):
    rows = [(None if i == 4 else i, t, "x", "y") for i, t in enumerate(KATZ)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, chunk string")
    held = [9, 10]
    model = PlainKatz([_tokens(t or "") for i, t in enumerate(KATZ) if i not in held], order)
    got = {r.doc_id: r for r in katz.score_by_katz(docs, F.col("doc_id").isin(held), order).collect()}
    assert len(got) == len(KATZ)
    for i, t in enumerate(KATZ):
        tokens = ["<s>"] * (order - 1) + _tokens(t or "")
        want = sum(math.log10(model.p(tokens[j], tuple(tokens[j - order + 1 : j]))) for j in range(order - 1, len(tokens)))
        assert got[None if i == 4 else i].score == pytest.approx(want, abs=1e-9) and got[None if i == 4 else i].held_out == (i in held)
    # After each context, seen or not, the probabilities of all tokens and the unknown one are one.
    contexts = {(), *(c for c in model.after if len(c) < order), ("unseen",) * (order - 1)}
    for c in contexts:
        assert sum(model.p(w, c) for (w,) in model.counts[1]) + model.p("never", c) == pytest.approx(1)
    assert katz.score_by_katz(docs.limit(0), F.lit(False), order).count() == 0


def test_katz_sums_to_one():
    of = np.array([50, 20, 10, 5, 3, 2])
    u = katz.Unigrams(50 + 40 + 30 + 20 + 15 + 12, 90, of)
    assert sum(of[r - 1] * u.p(np.array([r]))[0] for r in range(1, 7)) + u.unknown == pytest.approx(1)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_table(spark, texts):
    for r in pii.op4_personal_data(spark, DIR).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in want) for k in BASE)


def test_personal_data_added(spark):
    """Disguised data is added; what the check of its kind refuses never is."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))

    def card():
        while True:
            digits = "4" + "".join(str(rng.randrange(10)) for _ in range(15))
            if _luhn(digits):
                return digits

    octets = lambda sep: sep.join(["10", *(str(rng.randrange(256)) for _ in range(3))])
    docs, want = [], set()
    for i in range(300):
        docs.append((i, f"{word()} mail {word()}.{word()}@{word()}.com and ip {octets('.')} or card {card()} call +1 (523) 555-1{i:03d}. {word()}"))
    for i in range(300, 600):
        c = card()
        hidden = [f"{word()} [at] {word()} [dot] com", octets("[.]"), ".".join(c[k : k + 4] for k in range(0, 16, 4)), f"(523) 555-1{i:03d}"]
        docs.append((i, f"{word()} mail {hidden[0]} and ip {hidden[1]} or card {hidden[2]} call {hidden[3]} {word()}"))
        want |= {(i, k, docs[i][1].index(h)) for k, h in enumerate(hidden)}
    for i in range(600, 900):
        docs.append((i, f"order no 12.{i}.7.999 version 1.2.3.{i} serial 4111 1111 1111 {i:04d} ref 4111.1111.1111.{i:04d} id 300[.]1[.]2[.]3"))
    text = dict(docs)
    added = {(r.doc_id, s.kind, s.start, s.stop) for r in pii.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect() for s in r.spans if not s.base}
    found = {a[:3] for a in added}
    assert len(found & want) >= 0.95 * len(want)
    for d, kind, start, stop in added:
        digits = re.sub("[^0-9]", "", text[d][start:stop])
        assert (d, kind, start) in want or kind == 2 and _luhn(digits)


HARD = [
    "a@b.c+d@e.f g@h.i.j..k l@m n@o.p-", "..a@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.1.1 1.2.3", "4111 1111 1111 1111-4111-1111-1111-1111",
    "4111111111111111 x4111111111111112", "+1 (523) 555-1055. +1234567890123456 +1 2 +49.30.1234567-", "é😀 +1 (523) 555-1055 é a@b.co 😀 8.8.8.8", "", None, "9" * 50 + "@" * 50 + "." * 50, "+" * 30 + "1-" * 30,
]


def test_personal_data_hard_texts(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for r in pii.find_personal_data(docs).collect():
        sure = [f"{pii.KINDS[s.kind]}:{s.start}:{s.stop}" for s in r.sure]
        assert sorted(sure) == sorted(base_spans(HARD[r.doc_id] or "")), HARD[r.doc_id]


def test_estimate_tells_reliable_votes():
    p = pii.estimate({(0, "1,1,1"): 50, (0, "0,0,1"): 40, (0, "0,0,0"): 30, (0, "1,1,0"): 5, (0, "-1,1,1"): 5})
    assert p[0, "1,1,1"] > 0.9 > 0.1 > p[0, "0,0,0"] and p[0, "-1,1,1"] > 0.5


def _jaccard_sets(text):
    words = WORD.findall(text)
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()


def test_jaccard_join(spark, texts):
    rows = {r.doc_id: r for r in jaccard.op5_jaccard_join(spark, DIR).collect()}
    sets = {d: _jaccard_sets(t) for d, t in texts.items()}
    distinct = defaultdict(list)
    for d, s in sorted(sets.items()):
        distinct[s if s else d].append(d)
    first = {d: ds[0] for ds in distinct.values() for d in ds}
    links, root = Counter(), {d: d for d in texts}

    def find(x):
        return x if root[x] == x else find(root[x])

    reps = [ds[0] for ds in distinct.values() if sets[ds[0]]]
    for i, a in enumerate(reps):
        for b in reps[:i]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    for d, r in rows.items():
        assert (r.copy_of, r.n_links, r.class_id) == (first[d], links[first[d]], find(first[d]))


def _normal(line):
    return " ".join(w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", line.lower()) if w)


def _keys(norm):
    """Keys of a line: from each block on, blocks that hold enough longer words."""
    words = list(dict.fromkeys(norm.split(" ")))
    longer = [w for w in words if len(w) >= lines.LETTERS]
    return _print(longer if len(longer) >= lines.FEW_WORDS else words)


def _print(words):
    """Keys and blocks of the words that vote."""
    blocks = [[] for _ in range(lines.BLOCKS)]
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        blocks[(h >> 58) * lines.BLOCKS >> 6].append(h)
    bits = [sum(1 << b for b in lines.VOTES if 2 * sum(h >> b & 1 for h in own) > len(own)) for own in blocks]
    sizes = list(map(len, blocks))
    need = min(lines.LEAST_WORDS, max(2, sum(sizes) - 1))
    keys = set()
    for i in range(lines.BLOCKS):
        for span in (*lines.SPANS, lines.BLOCKS):
            own = [(i + k) % lines.BLOCKS for k in range(span)]
            held = sum(sizes[b] for b in own)
            if held >= need or span == lines.BLOCKS:
                keys.add((i, span, held, *(bits[b] for b in own)))
                break
    return keys, [(n, p) for n, p in zip(sizes, bits, strict=True)]


def _meet(a, b):
    """Two lines have a common key, and enough common blocks if they fill most of them."""
    same = sum(x == y and x[0] > 0 for x, y in zip(a[1], b[1], strict=True))
    filled = min(sum(n > 0 for n, _ in x[1]) for x in (a, b))
    return a[0] & b[0] and (same >= lines.AGREE or filled < lines.FILLED)


def _edits(a, b):
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def removed_lines(texts):
    """(doc_id, n_removed) by comparing all pairs of lines that share a key."""
    where = defaultdict(list)
    for d, t in texts.items():
        for i, line in enumerate(t.split("\n")):
            if n := _normal(line):
                where[n].append((d, i))
    first = {n: min(w) for n, w in where.items()}
    keys = {n: _keys(n) for n in where}
    root = {n: n for n in where}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = list(where)
    for i, a in enumerate(names):
        for b in names[:i]:
            if _meet(keys[a], keys[b]) and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and _edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
                x, y = sorted((find(a), find(b)), key=lambda n: first[n])
                root[y] = x
    stays = {}
    for n in names:
        stays[find(n)] = min(stays.get(find(n), (1 << 70, 0)), first[n])
    gone = Counter()
    for n, w in where.items():
        gone.update(d for d, i in w if (d, i) != stays[find(n)])
    return gone


def test_line_dedup(spark, texts):
    want = removed_lines(texts)
    rows = lines.op6_line_dedup(spark, DIR).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {d: want[d] for d in texts}


def test_line_dedup_recall(spark):
    """Of all pairs of lines that are alike by edit similarity alone, nine in ten are in one group; no group has others."""
    con = duckdb.connect()
    con.execute(rf"""CREATE TABLE l AS SELECT DISTINCT trim(n) AS n FROM (SELECT unnest(string_split(regexp_replace(lower(text), '[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), chr(10))) AS n FROM '{DIR}/documents.parquet')
        WHERE trim(n) != '' AND length(n) <= 500""")
    pairs = con.execute("""SELECT a.n, b.n FROM l a JOIN l b ON length(b.n) BETWEEN length(a.n) AND 1.25 * length(a.n) AND (length(a.n) < length(b.n) OR a.n < b.n)
        WHERE levenshtein(a.n, b.n) <= 0.2 * length(b.n) + 1e-9""").fetchall()
    classes = spark.createDataFrame([(n,) for (n,) in con.execute("SELECT n FROM l").fetchall()], "norm string").selectExpr("xxhash64(norm) AS k1", "xxhash64('line', norm) AS k2", "norm")
    roots = lines.linked_classes(classes, Scratch(spark, "test"))
    root = {r.norm: r.root for r in classes.join(roots, F.struct("k1", "k2") == roots["node"]).collect()}
    assert len(pairs) > 20 and sum(a in root and root[a] == root.get(b) for a, b in pairs) >= 0.9 * len(pairs)
    known = defaultdict(set)
    for a, b in pairs:
        known[a].add(b), known[b].add(a)
    assert all(any(root.get(b) == r for b in known[a]) for a, r in root.items())


def test_line_dedup_of_many_near_lines(spark):
    """Large buckets, with groups that only some of their members connect."""
    base = [f"word{i}" for i in range(60)]
    docs = {i: " ".join([*base[:i], f"other{i}", *base[i + 1 :]]) + "\nsame line here" for i in range(12)} | {100 + i: " ".join([*base, f"end{i}"]) for i in range(150)}
    # Lines with the same words at one end that are not alike otherwise.
    docs |= {300 + 2 * i + k: " ".join([*base[:12], *(f"x{i}y{j}" for j in range(25)), f"last{k}"]) for i in range(20) for k in range(2)}
    want = removed_lines(docs)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.row.doc_id: r.lines.n_removed for r in lines.kept_lines(frame).collect()}
    assert got == {d: want[d] for d in docs} and sum(want.values()) > 150


def test_line_dedup_keys(spark):
    """Keys of lines of each width of counters: common ones are those of the plain form."""
    rows = [" ".join(f"w{i * (k + 1)}long" for i in range(n)) for n in (1, 3, 9, 60, 63, 64, 900, 17000) for k in (0, 0.5)]
    rows = list(dict.fromkeys(r.replace(".0", "") for r in rows)) + [" ".join(["w0long", "the", *(f"w{i}long" for i in range(2, 9))])]
    table = spark.createDataFrame(list(enumerate(rows)), "k1 long, norm string")
    got = {r.k1: set(r["keys"]) for r in lines.class_keys(table).collect()}
    plain = [_keys(r)[0] for r in rows]
    for i in range(len(rows)):
        for j in range(i + 1):
            assert len(got[i] & got[j]) == len(plain[i] & plain[j])


def test_line_dedup_repeated_rows(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100)))] * 700, "doc_id long, text string")
    near = docs.selectExpr("doc_id + 1 AS doc_id", "concat(text, ' w0') AS text").limit(1).union(docs)
    assert {(r.row.doc_id, r.lines.n_removed) for r in lines.kept_lines(near).collect()} == {(1, 0), (2, 1)}


def test_decontamination(spark, texts):
    items = {r.item_id: _normal(r.text).split(" ") for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}

    def weights(words):
        return Counter(g for i in range(len(words) - 4) for g in [tuple(words[i : i + 5])] for _ in range(len("".join(g))))

    want = set()
    for d, t in texts.items():
        words = [w for line in t.split("\n") for w in _normal(line).split(" ") if w]
        for item, own in items.items():
            grams, mine = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}, weights(own)
            hits = [i for i in range(len(words) - 4) if tuple(words[i : i + 5]) in grams]
            for s in {s for i in hits for s in range(max(0, i - len(own) + 5), i + 1)}:
                window = words[s : s + len(own)]
                x = weights(window)
                if sum((x & mine).values()) >= 0.8 * sum((x | mine).values()):
                    want.add((d, item))
    assert {(r.doc_id, r.item_id) for r in decontamination.op9_decontamination(spark, DIR).collect()} == want and want


def test_decontamination_near_the_threshold(spark):
    """Windows that just pass, a word of 52 changed, are all found."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    weights = lambda ws: Counter({tuple(ws[i : i + 5]): len("".join(ws[i : i + 5])) for i in range(len(ws) - 4)})
    items, docs, want = [], [], set()
    for i in range(600):
        words = [word() for _ in range(52)]
        other = list(words)
        other[rng.randrange(10, 42)] = word()
        a, b = weights(words), weights(other)
        items.append((i, " ".join(words)))
        docs.append((i, " ".join(other)))
        if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
            want.add((i, i))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 300 and {(r.doc_id, r.item_id) for r in decontamination.find_leaks(*frames).collect()} == want


def test_decontamination_item_ids(spark):
    """Null ids of items are reported; items of the same id stay apart."""
    texts = [" ".join(f"{c}{i}" for i in range(20)) for c in "abc"]
    items = spark.createDataFrame([(None, texts[0]), (1, texts[1]), (1, texts[2]), (1, texts[2])], "item_id long, text string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = decontamination.find_leaks(docs, items).where("start = 0").collect()
    assert sorted((r.doc_id, r.item_id or 0, r.similarity) for r in got) == [(0, 0, 1.0), (1, 1, 1.0), (2, 1, 1.0)]


def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.op10_packing(spark, DIR).collect()
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], np.uint32) for d, t in texts.items()}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == binascii.crc32(ids[r.doc_id][r.start : r.start + r.length].astype("<u4").tobytes())
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length))
    for d, own in pieces.items():
        at = 0
        for n, (piece, start, length) in enumerate(sorted(own)):
            assert (piece, start) == (n, at) and (n == 0 or length == 2048)
            at += length
        assert at == len(ids[d])
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.02 * math.ceil(sum(map(len, ids.values())) / 2048) + 1
