import random
import re

from plyforge.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_base_phrases_and_templates(spark):
    rng = random.Random(3)
    parts = ["MIT", "mit", "License", "license", "Apache", "general", "public", "GNU", "licensed", "under", "the", "İ", "é", ";", "2.0", "version", "all", "rights", "reserved", "x1"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(500)] + [None, "", "mit license " * 20_000, licenses.TEMPLATES[0][1], "Copyright. " + licenses.TEMPLATES[4][1].upper()]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)], "doc_id long, text string, score double"), spans=True).collect()}
    for k, t in enumerate(texts):
        w, starts, labels = WORD.findall((t or "").translate(LOW)), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            starts += found
            labels |= {label} if found else set()
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[len(texts) - 2].labels == "mit" and got[len(texts) - 1].labels == "gpl" and got[len(texts) - 1].score == 1.0
    assert licenses.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chain_skips_words():
    words = licenses.TEMPLATES[3][1].split()
    text = " ".join([*words[:3], "well", *words[3:]])
    n, starts, base, labels, score, spans = licenses.Scanner().scan(text)
    assert "apache" in labels and score == len(words_of(words)) / licenses.FULL


def words_of(words):
    return licenses.words_of(" ".join(words))


def test_score_weighs_what_stands_there():
    scan = licenses.Scanner().scan
    score = lambda text: scan(text)[4]
    notice = licenses.NOTICES[0][1]
    half = " ".join(notice.split()[: len(notice.split()) // 2])
    assert score(notice) == 1.0 and 0.4 < score(half) < 0.6
    named = [score(x) for x in ("this file is under the MIT License", "all rights reserved", "we discuss the apache license war at length")]
    assert all(0 < x <= 0.25 for x in named)
    # A phrase that no notice has around it is a base label and scores nothing.
    n, starts, base, labels, value, _ = licenses.Scanner(templates=(("x", "one two three"),)).scan("the mit license and the mit license")
    assert (len(starts), base, labels, value) == (2, ["mit"], ["mit"], 0.0)


def best_cover(found, most_gap):
    """The most words that a chain of matches covers, by all pairs."""
    found = sorted(found)
    best = []
    for i, (at, of, size) in enumerate(found):
        before = [best[j] for j, (a, o, n) in enumerate(found[:i]) if a + n <= at and o + n <= of and at - (a + n) <= most_gap]
        best.append(size + max(before, default=0))
    return max(best)


def test_chains_against_all_pairs():
    rng = random.Random(12)
    scanner = licenses.Scanner(phrases=(), templates=(("t", " ".join(f"w{i}" for i in range(40))),), most_gap=4)
    for _ in range(400):
        found = []
        for _ in range(rng.randrange(1, 14)):
            of = rng.randrange(40)
            found.append((rng.randrange(70), of, rng.randrange(1, min(9, 41 - of))))
        covered, first, last = scanner._chain(found, 0)
        assert covered == best_cover(found, 4) <= last - first + 1


def test_spans_are_disjoint_and_enough():
    """Of texts with pieces of one template in any order, spans do not overlap, and the best chain is found where no whole one is."""
    rng = random.Random(15)
    words = [f"w{i}" for i in range(12)]
    scanner = licenses.Scanner(phrases=(), templates=(("t", " ".join(words)),), most_gap=3)
    for _ in range(300):
        text = []
        for _ in range(rng.randrange(1, 6)):
            a = rng.randrange(11)
            text += words[a : rng.randrange(a + 2, 14)] + ["x"] * rng.randrange(3)
        spans = scanner.scan(" ".join(text))[5]
        assert all(b < c for (_, _, b, _), (_, c, _, _) in zip(spans, spans[1:]))
        assert len(spans) == 1 or all(cover >= scanner.cover for *_, cover in spans)
        whole = [i for i in range(len(text)) if text[i : i + 12] == words]
        assert {a for _, a, b, c in spans if c == 1 and b - a == 11} == set(whole)


def test_templates_within_longer_ones_and_repeated_ones():
    scan = licenses.Scanner(templates=licenses.NOTICES).scan
    short, full = licenses.TEMPLATES[3][1], licenses.TEMPLATES[2][1]
    *_, score, spans = scan(short + ". The code is here")
    assert score == 8 / licenses.FULL and ("apache", 0, 7, 1.0) in spans
    n, *_, spans = scan(f"{full} x y {full} z {' '.join(full.split()[4:])}")
    whole, m = len(licenses.words_of(full)), len(licenses.words_of(" ".join(full.split()[4:])))
    got = sorted(x for x in spans if x[2] - x[1] > 20)
    assert [(a, b) for _, a, b, _ in got] == [(0, whole - 1), (whole + 2, 2 * whole + 1), (2 * whole + 3, 2 * whole + 2 + m)] and got[2][3] == m / whole
    assert len([x for x in spans if x[2] - x[1] == 7 and x[3] == 1.0]) == 2
    # Inner templates that begin later than the longer run around them, against a search for them at every place.
    own = licenses.Scanner(phrases=(("b c", "p"),), templates=(("long", "a b c d e f"), ("in", "c d e"), ("end", "e f")))
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.choice("abcdefx") if rng.random() < 0.2 else "abcdef"[k % 6] for k in range(rng.randrange(30))]
        spans = own.scan(" ".join(words))[5]
        for label, t in (("p", "b c"), ("long", "a b c d e f"), ("in", "c d e"), ("end", "e f")):
            p = t.split()
            assert [i for i in range(len(words)) if words[i : i + len(p)] == p] == [a for x, a, b, c in spans if x == label and c == 1.0 and b - a + 1 == len(p)], (words, label, spans)


def test_matching_statistics_against_every_suffix():
    rng = random.Random(6)
    sequences = [[rng.randrange(1, 5) for _ in range(rng.randrange(1, 25))] for _ in range(6)]
    sam = licenses.Automaton(sequences)
    inside = {tuple(s[a:b]) for s in sequences for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    for _ in range(60):
        text, state, length = [rng.randrange(0, 6) for _ in range(40)], 0, 0
        for i, word in enumerate(text):
            state, length = sam.step(state, length, word)
            assert length == max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in inside), default=0)


def test_whole_licences_are_spans():
    scan = licenses.Scanner().scan
    for label, text in licenses.WHOLE:
        words = text.split()
        n, _, _, labels, score, spans = scan("some code " + " ".join(words) + " more code")
        assert label in labels.split(",") if isinstance(labels, str) else label in labels
        longest = max(spans, key=lambda x: x[2] - x[1])
        assert score == 1.0 and longest[0] == label and longest[3] == 1.0 and longest[2] - longest[1] + 1 == len(licenses.words_of(text))
        # A few words changed: still a span of the whole licence, covered to more than nine tenths.
        for at in (10, len(words) // 2, len(words) - 5):
            words[at] = "changedword"
        found = [x for x in scan(" ".join(words))[5] if x[0] == label and x[2] - x[1] > 0.9 * n * 0.9 and 0.9 < x[3] < 1]
        assert found, label
