import hashlib
import random
import re

from pyspark.sql import functions as F

from plyforge.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base(text):
    out = []
    for kind, expression in BASE.items():
        for m in re.finditer(expression, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans_of(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].base == base(t), (t[:200] if t else t)
        assert set(got[i].base.split(",")) <= set(got[i].spans.split(","))


def test_base_spans_match_python(spark):
    rng = random.Random(2)
    parts = ["a@b.c", "x.y@mail.example.com", "a@b", "@", "1.2.3.4", "256.1.1.1", "001.002.003.0255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111",
             "41111111111111111", "4111  1111", "+1 (017) 555-7713", "+12", "+1.2.3.4.5.6.7.8", "5", " ", "\n", "-", ".", "é", "😀", "+", "%", "foo", "b.c_d@e.f", "0", "9807915762804490"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(400)] + [None, "", "7" * 30_000, "a" * 60_000, "1 " * 20_000, "a.b@" * 5_000, "+1 " * 9_000]
    check(spark, texts)


def test_bootstrap_finds_unseen_identifiers_and_leaves_others(spark):
    texts = [f"please dial +1 555 000 {1000 + k} today" for k in range(12)] + ["please dial 5550009999 today", "order 5550009999x of 12 parts", "the year 1999 was fine"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans_of(docs).collect()}
    assert got[12].base == "" and got[12].spans == "phone:12:22"
    assert got[13].spans == "" and got[14].spans == ""
    assert all(got[k].spans == got[k].base != "" for k in range(12))


def test_rows_stay(spark):
    docs = spark.createDataFrame([(None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c"), (2, None)], "doc_id long, text string").withColumn("rid", F.lit("x"))
    assert sorted((r.doc_id or -1, r.n_email) for r in pii.spans_of(docs).collect()) == [(-1, 1), (1, 1), (1, 1), (2, 0)]
    assert pii.spans_of(docs.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_identifiers_of_several_tokens_and_labels_with_digits(spark):
    texts = [f"please dial +1 555 000 {1000 + k} today" for k in range(12)] + ["please dial 555 0100 1234 today", "all of 12 34 parts"]
    texts += [f"my tel1: +1 555 001 {1000 + k} now" for k in range(12)] + ["my tel1: 5550007777 now", "4 my tel1: 5550008888 now 7"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.spans_of(docs).collect()}
    assert [got[k] for k in (12, 13, 26, 27)] == ["phone:12:25", "", "phone:9:19", "phone:11:21"]


def test_many_matches_in_one_text(spark):
    docs = spark.createDataFrame([(1, "1.2.3.4 " * 40_000), (2, "+1 555 000 1234, " * 5_000), (3, "a@b.c;" * 5_000), (4, "12 " * 20_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_ip, r.n_phone, r.n_email) for r in pii.spans_of(docs).collect()}
    assert got == {1: (40_000, 0, 0), 2: (0, 5_000, 0), 3: (0, 0, 5_000), 4: (0, 0, 0)}


def test_contexts_only_of_what_counts(spark):
    """Matches that fail their kind's test, and tokens that can't be free, have no context worked out."""
    docs = spark.createDataFrame([(1, "see 999.1.1.1 or 1.2.3.4 and +12 then x@y.z at 4111 1111 1111 1112 or 77")], "doc_id long, text string")
    (row,) = pii.matched(docs).collect()
    ok = {(f.kind, f.m) for f in row.found if f.ok}
    assert ok == {(1, "x@y.z"), (2, "1.2.3.4"), (5, "999.1.1.1"), (5, "+12"), (5, "4111"), (5, "1111"), (5, "1112"), (5, "77"), (6, "4111 1111 1111 1112")}
    assert all((f.w1, f.w2, f.w3) == (None, None, None) for f in row.found if not f.ok)


def plain_bootstrap(edges, support, confident, sure, rounds):
    """edges: set of (pattern, kind, instance)."""
    nodes = {}
    for pattern, kind, instance in edges:
        nodes.setdefault(pattern, []).append((kind, instance))
    score, before = {}, None
    for _ in range(rounds):
        trust = {}
        for pattern, around in nodes.items():
            for of in (1, 2, 3, 4):
                if sum(k == of for k, _ in around) >= support:
                    total = sum(1.0 if k == of else score.get((i, of), 0.0) if k == 5 else 0.0 for k, i in around)
                    if total / (len(around) + pii.PRIOR) >= confident:
                        trust[pattern, of] = total / (len(around) + pii.PRIOR)
        if not trust:
            return {}
        if set(trust) == before:
            break
        before, miss = set(trust), {}
        for (pattern, of), t in trust.items():
            for k, i in nodes[pattern]:
                if k == 5:
                    miss[i, of] = miss.get((i, of), 1.0) * (1 - min(t, 0.999))
        score = {k: 1 - m for k, m in miss.items()}
    out = {}
    for (i, of), s in score.items():
        if s >= sure and (i not in out or (s, -of) > out[i]):
            out[i] = (s, -of)
    return {i: -of for i, (_, of) in out.items()}


def test_bootstrap_against_a_plain_one_on_random_graphs(spark):
    rng = random.Random(13)
    found = 0
    for n in range(6):
        edges = set()
        for p in range(40):
            of = rng.choice([1, 4])
            good = rng.choice([0.99, 0.9, 0.5])
            for _ in range(rng.randrange(1, 40)):
                kind = 5 if rng.random() < 0.3 else of if rng.random() < good else 5 - of
                edges.add((f"p{p}", kind, f"{'t' if kind == 5 else kind}{rng.randrange(60)}"))
        how = {"support": rng.choice([2, 3]), "confident": rng.choice([0.6, 0.7, 0.8]), "sure": rng.choice([0.7, 0.9]), "rounds": rng.choice([1, 2, 5])}
        df = spark.createDataFrame([(p, k, i, 1) for p, k, i in edges], "pattern string, kind int, instance string, n long")
        got = pii.sure_instances(df, **how)
        want = plain_bootstrap(edges, **how)
        assert ({} if got is None else {r.instance: r.of for r in got.collect()}) == want, (n, how)
        found += len(want)
    assert found > 20


def test_weak_patterns_together_discover_nothing(spark):
    """Eight words that stand before five phones and nine other tokens each, and a number that stands behind all eight."""
    texts = [f"word{w} +1 555 {w}00 {1000 + k}" for w in range(8) for k in range(5)]
    texts += [f"word{w} {w}{k}{k}7" for w in range(8) for k in range(9)] + [f"word{w} 12345678" for w in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.base, r.spans) for r in pii.spans_of(docs).collect()}
    assert all(b == s for b, s in got.values()) and sum(b != "" for b, _ in got.values()) == 40


def test_words_too_long_for_a_context_are_no_patterns(spark):
    long = "w" * 80
    row = lambda text: [(f.w1, f.w2, f.w3) for r in pii.matched(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect() for f in r.found if f.kind == 1 and f.ok][0]
    assert row(f"{long} a@b.c next") == (None, None, "next") and row(f"one two a@b.c {long}") == ("two", "one two", None)
    assert row(f"{long} call a@b.c {'x ' * 90}") == ("call", None, "x") and row("a@b.c") == (None, None, None)
