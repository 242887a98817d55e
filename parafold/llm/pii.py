"""Personal data by weak supervision, DataFrame functions only.

Candidates are all matches of the base patterns, also those that their checks
refuse, and of looser patterns.  Labelers (patterns, gazetteers, context) vote
for or against each candidate, or abstain.  How often each combination of
votes occurs is counted over all candidates; there are at most 3**6 for each
kind.  Expectation-maximisation over these counts estimates each labeler's
reliability and each combination's probability.  A naive Bayes classifier of
features of the span and what is beside it is then trained on those
probabilities, over all candidates of its kind that pass its check (parts of an
address, Luhn, number of digits), and decides on those that the base does not
have.  What the check refuses tells of the labelers, but is never added.  Base
spans always stay.

Kinds: email, ip, card, phone; spans are in code points, end exclusive.

Defined results.  A null or empty text has no spans.  Rows are judged one by
one, so that repeated rows give equal results.  An added span that overlaps a
base span of its kind, or an earlier added one, is left out.  Without
candidates nothing is learned and nothing is added.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from .textsql import let

KINDS = ("email", "ip", "card", "phone")
#: Probability from which the classifier adds a span.
THRESHOLD = 0.9
#: Expectation-maximisation ends when no probability moves by more than ``STILL``, or after ``ROUNDS``.
ROUNDS, STILL = 500, 1e-7
#: Code points on each side that context labelers see.
CONTEXT = 32

# The base patterns.  They match what the plain forms match; possessive
# quantifiers and look-behind only save the search of what cannot match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Matches of a text whose places are added up together.
CHUNK = 64
# Looser patterns, for what the base does not find.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?(?:\[at\]|\(at\)|\{at\}|＠) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}| dot ) ?[A-Za-z0-9-]{1,63}+)+| at [A-Za-z0-9-]{1,63}+(?: dot [A-Za-z0-9-]{1,63}+)+)",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}+(?:[._/ –][ ]?[0-9]{4,6}+){2,3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
# Texts without a match of these have no candidate.
NEEDED = {"email": r"@|\[at\]|\(at\)|\{at\}| dot |＠", "ip": "[0-9][.\\[(]", "card": "[0-9]", "phone": "[0-9]"}

# Gazetteers of endings, issuers and cue words.
ENDINGS = "com org net edu gov int mil info biz io co de fr es it nl uk us eu ch at be pl se"
CUES = {
    "email": "mail email e-mail contact write reach correo courriel",
    "ip": "ip host server address from login client addr",
    "card": "card visa mastercard amex credit payment pay karte carte tarjeta",
    "phone": "phone tel call mobile fax cell telefon telephone contact whatsapp",
}
AGAINST = "version isbn issn doi sku order invoice serial section chapter build token id no"

_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:[^0-9]+0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches_sql(text: str, pattern: str) -> str:
    """(start, m, before, after) of all matches: they are what stands between the split pieces.

    Places are sums of the lengths before.  They are added up within chunks of
    ``CHUNK`` matches that begin at the sums of earlier chunks, so that no array
    grows match by match with the text.
    """
    p = _quote(pattern)
    one = f"named_struct('start', s.at + length(ps[s.i]), 'm', ms[s.i], 'before', right(ps[s.i], {CONTEXT}), 'after', left(ps[s.i + 1], 2))"
    step = f"named_struct('at', s.at + l, 'i', s.i + 1, 'out', concat(s.out, array({one})))"
    zero = f"named_struct('at', o, 'i', k * {CHUNK}, 'out', cast(array() as array<struct<start:int,m:string,before:string,after:string>>))"
    found = f"flatten(transform(os, (o, k) -> aggregate(slice(ls, k * {CHUNK} + 1, {CHUNK}), {zero}, (s, l) -> {step}).out))"
    added = "aggregate({}, 0, (a, b) -> a + b)"
    found = let(f"transform(cs, (c, k) -> {added.format('slice(cs, 1, k)')})", "os", found)
    found = let(f"transform(sequence(0, (size(ls) - 1) div {CHUNK}), k -> {added.format(f'slice(ls, cast(k as int) * {CHUNK} + 1, {CHUNK})')})", "cs", found)
    found = let("transform(ms, (m, i) -> length(ps[i]) + length(m))", "ls", found)
    return let(f"split({text}, {p}, -1)", "ps", let(f"regexp_extract_all({text}, {p}, 0)", "ms", found))


def _passes(kind: str) -> str:
    """SQL: the match ``x.m`` passes the check of its kind."""
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": f"x.m rlike {_quote(_OCTETS)}",
        "card": f"length({digits}) between 13 and 19 and luhn_check({digits})",
        "phone": f"length({digits}) between 9 and 15",
    }[kind]


def _vote(yes: str, no: str = "false") -> str:
    return f"case when {yes} then 1 when {no} then 0 else -1 end"


def _words(words: str) -> str:
    return _quote(r"(?i)(?<![a-z])(?:" + "|".join(words.split()) + r")(?![a-z])")


def _votes(kind: str, base: bool) -> list[str]:
    """SQL of the six labelers' votes on ``x``: 1 for, 0 against, -1 abstains."""
    glued = "x.before rlike '[A-Za-z0-9_@=\"]$' or x.after rlike '^[A-Za-z0-9_@=\"]'"
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    shape = {
        "email": _vote("x.m rlike '(?i)\\\\.[a-z]{2,24}$'", "x.m rlike '[0-9]$'"),
        "ip": _vote("x.m rlike '^[1-9][0-9]{0,2}(?:[^0-9]+[0-9]{1,3}){3}$'", "x.m rlike '(^|[^0-9])0[0-9]'"),
        "card": _vote("x.m rlike '^[0-9]{4}([ -]?)[0-9]{4}\\\\1[0-9]{4}\\\\1[0-9]{4}$|^[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}$'", f"length({digits}) not between 13 and 19"),
        "phone": _vote("x.m rlike '^(?:[+]|00)[1-9][0-9]{0,2}[ .-]?[(]?[0-9]{2,4}[)]?(?:[ .-][0-9]{2,4}){2,3}$|^[(]?[0-9]{3}[)]?[ .-][0-9]{3}[ .-][0-9]{4}$'", f"length({digits}) not between 9 and 15"),
    }[kind]
    listed = {
        "email": _vote(f"x.m rlike {_quote('(?i)[. \\])}](?:' + '|'.join(ENDINGS.split()) + ')$')}", "x.m rlike '(?i)example[.]|localhost|noreply'"),
        "ip": _vote("x.m rlike '^(?:10|172|192)[^0-9]'", "x.m rlike '^(?:0|127|255)[^0-9]'"),
        "card": _vote("x.m rlike '^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)'", "x.m rlike '^[0179]'"),
        "phone": _vote("x.m rlike '^(?:[+]|00)(?:1|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1-6]|9[0-8])'", f"{digits} rlike '^(.)\\\\1+$'"),
    }[kind]
    near = _vote(f"right(x.before, 20) rlike {_words(CUES[kind])}")
    against = _vote("false", f"right(x.before, 12) rlike {_words(AGAINST)}")
    return [_vote(_passes(kind) if base else "false", f"not ({_passes(kind)})"), shape, listed, near, against, _vote("x.before rlike '(^|[\\\\s(:,])$' and (x.after = '' or x.after rlike '^[\\\\s).,;:!?]')", glued)]


def _features(kind: str, base: bool) -> list[str]:
    """SQL of features of ``x`` for the classifier, as short strings."""
    return [
        f"'{kind}{'' if base else '?'}'",
        "cast(least(length(x.m), 40) div 4 as string)",
        "cast(least(length(regexp_replace(x.m, '[^0-9]', '')), 24) as string)",
        "cast(least(size(split(x.m, '[^A-Za-z0-9]+', -1)), 9) as string)",
        "coalesce(left(regexp_replace(x.m, '[A-Za-z0-9]', ''), 1), '')",
        "case when x.before = '' then '^' when x.before rlike '[A-Za-z]$' then 'a' when x.before rlike '[0-9]$' then '0' when x.before rlike '\\\\s$' then ' ' else right(x.before, 1) end",
        "case when x.after = '' then '^' when x.after rlike '^[A-Za-z]' then 'a' when x.after rlike '^[0-9]' then '0' when x.after rlike '^\\\\s' then ' ' else left(x.after, 1) end",
        f"cast({_passes(kind)} as string)",
    ]


def candidates_sql(kind: str, base: bool, text: str = "text") -> str:
    pattern = (BASE if base else LOOSE)[kind]
    passes = _passes(kind) if base else "false"
    one = f"named_struct('kind', {KINDS.index(kind)}, 'start', x.start, 'stop', x.start + length(x.m), 'base', {passes}, 'passes', {_passes(kind)}, 'votes', concat_ws(',', {', '.join(f'cast({v} as string)' for v in _votes(kind, base))}), 'features', array({', '.join(_features(kind, base))}))"
    return f"transform({matches_sql(text, pattern)}, x -> {one})"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found): all candidates of each row's text, by kind and start."""
    empty = "cast(array() as array<struct<kind:int,start:int,stop:int,base:boolean,passes:boolean,votes:string,features:array<string>>>)"
    each = [f"if(text rlike {_quote(NEEDED[k])}, {candidates_sql(k, base)}, {empty})" for k in KINDS for base in (True, False)]
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.expr(f"concat({', '.join(each)})").alias("found"))


def estimate(counts: dict[tuple[int, str], int], rounds: int = ROUNDS) -> dict[tuple[int, str], float]:
    """Probability of each (kind, votes), by expectation-maximisation.

    Each kind has a share of true candidates and each labeler a rate of votes
    for among true and among false ones; abstaining tells nothing.  It begins
    with the share of votes for.  What the first labeler, the check of the kind,
    refuses is false for certain: it tells of the rates, not of the share.
    """
    out = {}
    for kind in range(len(KINDS)):
        rows = [([int(v) for v in votes.split(",")], n, (k, votes)) for (k, votes), n in sorted(counts.items()) if k == kind]
        if not rows:
            continue
        sure = [1e-6 if votes[0] == 0 else 1.0 for votes, _, _ in rows]
        p = [(sum(v == 1 for v in votes) + 0.5) / (sum(v >= 0 for v in votes) + 1) for votes, _, _ in rows]
        p = [x * y for x, y in zip(p, sure, strict=True)]
        for _ in range(rounds):
            open_ = [(q, n) for q, most, (_, n, _) in zip(p, sure, rows, strict=True) if most == 1]
            share = (sum(q * n for q, n in open_) + 1) / (sum(n for _, n in open_) + 2)
            rates = []
            for i in range(len(rows[0][0])):
                sums = [[4.0, 1.0], [1.0, 4.0]]  # for and against, of true and of false: labelers are better than chance
                for q, (votes, n, _) in zip(p, rows, strict=True):
                    if votes[i] >= 0:
                        sums[0][1 - votes[i]] += q * n
                        sums[1][1 - votes[i]] += (1 - q) * n
                rates.append([s[0] / sum(s) for s in sums])
            before, p = p, []
            for (votes, _, _), most in zip(rows, sure, strict=True):
                odds = math.log(share / (1 - share))
                for v, (yes, no) in zip(votes, rates, strict=True):
                    if v >= 0:
                        odds += math.log(yes / no) if v else math.log((1 - yes) / (1 - no))
                p.append(most / (1 + math.exp(-max(-40.0, min(40.0, odds)))))
            if max(abs(x - y) for x, y in zip(before, p, strict=True)) < STILL:
                break
        out |= {key: q for q, (_, _, key) in zip(p, rows, strict=True)}
    return out


def train(found: DataFrame) -> str:
    """SQL of the log odds of a candidate ``c``, by the classifier of its kind.

    What is collected has a bound: combinations of votes of a kind, and values
    of eight features of a few dozen values each.
    """
    spans = found.select(F.explode("found").alias("c")).select("c.*")
    counts = {(r.kind, r.votes): r.n for r in spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return "-99D"
    p = estimate(counts)
    known = F.expr("map(" + ", ".join(f"'{k}:{v}', {q!r}D" for (k, v), q in sorted(p.items())) + ")")
    weighted = spans.where("passes").select("kind", F.posexplode("features").alias("f", "value"), known[F.concat_ws(":", "kind", "votes")].alias("p"))
    sums = weighted.groupBy("kind", "f", "value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    total = {k: [sum((q, 1 - q)[i] * counts[key] for key, q in p.items() if key[0] == k and not key[1].startswith("0")) for i in (0, 1)] for k in range(len(KINDS))}
    of: dict[tuple[int, int], list[str]] = defaultdict(list)
    for r in sorted(sums, key=lambda r: (r.kind, r.f, r.value)):
        yes, no = total[r.kind]
        odds = math.log((r.yes + 0.5) / (yes + 1)) - math.log((r.no + 0.5) / (no + 1))
        of[r.kind, r.f] += [_quote(r.value), f"{round(odds, 9)!r}D"]
    each = []
    for kind in sorted({k for k, _ in of}):
        prior = math.log((total[kind][0] + 1) / (total[kind][1] + 1))
        parts = [f"{round(prior, 9)!r}D", *(f"coalesce(element_at(map({', '.join(v)}), c.features[{f}]), 0D)" for (k, f), v in of.items() if k == kind)]
        each.append(f"when c.kind = {kind} then {' + '.join(parts)}")
    return f"(case {' '.join(each)} else -99D end)"


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans): base spans and those that the classifier adds, by kind and start.

    A span is (kind, start, stop, base); kind is a number in ``KINDS``.
    """
    work = Scratch(docs.sparkSession, "pii")
    found = work.save(candidates(docs), "found")
    odds = train(found)
    added = f"filter(found, c -> not c.base and c.passes and {odds} >= {math.log(threshold / (1 - threshold))!r}D)"
    plain = "transform({}, c -> named_struct('kind', c.kind, 'start', c.start, 'stop', c.stop, 'base', c.base))"
    split_up = found.select("doc_id", F.expr(plain.format("filter(found, c -> c.base)")).alias("sure"), F.expr(plain.format(added)).alias("added"))
    # Of added spans in order, those that overlap nothing that is taken.
    taken = "aggregate(array_sort(added), sure, (t, c) -> if(exists(t, o -> o.kind = c.kind and o.start < c.stop and c.start < o.stop), t, concat(t, array(c))))"
    return split_up.select("doc_id", "sure", F.expr(f"array_sort({taken})").alias("spans"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_personal_data(docs)
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"

    def joined(spans: str) -> str:
        return f"array_join(transform({spans}, c -> concat({names}[c.kind], ':', c.start, ':', c.stop)), ',')"

    counts = [F.expr(f"cast(size(filter(sure, c -> c.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.expr(joined("array_sort(sure)")), 256).alias("base_sha256"), F.expr(joined("spans")).alias("spans"))
