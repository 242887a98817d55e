"""The learned rules and verdicts of quality against plain versions."""

import math
import re

import numpy as np
import pandas as pd
import pytest

from parafold.llm import quality

DIR = "/root/testdata/sf0.01"


def plain_counts(text):
    """The counts of a text, word by word and sign by sign."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in pd.Series(windows, dtype=object).value_counts().items() if n > 1}
    repeated = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    signs = lambda own: sum(c in own for c in text or "")
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": signs("#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated), "n_lines": len(lines), "n_distinct": len(set(words)), "n_digits": signs("0123456789"),
        "n_upper": signs("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_stops": signs(".!?"), "n_short": sum(len(w.encode()) <= 1 for w in words), "n_chars": len(text or ""),
    }


def plain_features(c):
    return {name: float(eval(re.sub(r"cast\((\w+) as double\)", r"\1", sql), {"greatest": max}, c)) for name, sql in quality.FEATURES.items()}


def plain_rules(x, bad, part):
    """Sequential covering that tries every threshold by looking at all rows."""
    rules, left = [], set(range(len(bad)))

    def holds(rule, i):
        return all((x[f][i] >= t) if above else (x[f][i] < t) for f, above, t in rule)

    def worth(rule):
        hit = [i for i in left if part[i] == 0 and holds(rule, i)]
        p = sum(bad[i] for i in hit)
        return (2 * p - len(hit)) / len(hit) if hit else -1.0

    while len(rules) < quality.MAX_RULES:
        rule, rows = [], [i for i in left if part[i] != 0]
        while len(rule) < quality.MAX_CONDITIONS and sum(bad[i] for i in rows) >= quality.MIN_COVER and not all(bad[i] for i in rows):
            base, best = math.log2(sum(bad[i] for i in rows) / len(rows)), (1e-9, None)
            for f in x:
                values = sorted({x[f][i] for i in rows})
                for above in (True, False):
                    for low, high in zip(values, values[1:], strict=False):
                        t = (low + high) / 2
                        hit = [i for i in rows if (x[f][i] >= t) == above]
                        p = sum(bad[i] for i in hit)
                        gain = p * (math.log2(p / len(hit)) - base) if p else -math.inf
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, above, t))
            if best[1] is None:
                break
            rule.append(best[1])
            rows = [i for i in rows if holds(best[1:], i)]
        if not rule:
            break
        rule = max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (worth(r), -len(r)))
        hit = [i for i in left if holds(rule, i)]
        p = sum(bad[i] for i in hit)
        if p < quality.MIN_COVER or p < quality.MIN_PRECISION * len(hit) or worth(rule) < 2 * quality.MIN_PRECISION - 1:
            break
        rules.append(rule)
        left -= set(hit)
    return rules


@pytest.mark.parametrize("seed", range(6))
def test_rules_by_plain_covering(seed):
    rng = np.random.default_rng(seed)
    n = 160
    x = {f: np.round(rng.random(n), 2) for f in "abc"}
    bad = (x["a"] > 0.7) | ((x["b"] < 0.3) & (x["c"] > 0.5)) | (rng.random(n) < 0.02 * seed)
    part = np.arange(n) % 3
    got = quality.learn_rules(x, bad, part)
    want = plain_rules({f: v.tolist() for f, v in x.items()}, bad.tolist(), part.tolist())
    assert want or seed
    assert [[(c.feature, c.above, pytest.approx(c.threshold)) for c in r] for r in got.rules] == [[tuple(c) for c in r] for r in want]


def test_kept_by_plain_version(spark):
    docs, labels = (pd.read_parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    counts = {i: plain_counts(t) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    features = {i: plain_features(c) for i, c in counts.items()}
    known = labels[labels.quality.notna()].groupby("doc_id").quality.min()
    ids = sorted(i for i in known.index if i in features)
    bad = np.array([known[i] == 0 for i in ids])
    part = pd.util.hash_array(np.array(ids)) % 3
    rules = quality.learn_rules({f: np.array([features[i][f] for i in ids]) for f in quality.FEATURES}, bad, part).rules
    assert rules
    got = {r["doc_id"]: r for r in quality.op2_quality_rules(spark, DIR).collect()}
    assert set(got) == set(counts)
    for i, c in counts.items():
        failed = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
        rule = next((k for k, r in enumerate(rules, 1) if all((features[i][x.feature] >= x.threshold) == x.above for x in r)), 0)
        assert [got[i][n] for n in quality.COUNTS[:5]] == [c[n] for n in quality.COUNTS[:5]]
        assert (got[i]["base_failed"], got[i]["rule"], got[i]["kept"]) == (failed, rule, not failed and rule == 0), i
