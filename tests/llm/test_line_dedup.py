import random

from plyforge.llm import line_dedup as ld


def brute(rows, size=3):
    first, gone = {}, {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    for k in order:
        i, t = rows[k]
        lines = (t or "").split("\n")
        for s in range(len(lines) - size + 1):
            window = tuple(lines[s : s + size])
            if all(not x.strip() for x in window):
                continue
            if first.setdefault(window, (i, s)) != (i, s):
                gone.setdefault(k, set()).update(range(s, s + size))
    return [["\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone.get(k, ())), len(gone.get(k, ()))] for k, (_, t) in enumerate(rows)]


def test_matches_brute_force(spark):
    rng = random.Random(6)
    line = lambda: rng.choice(["the and", "of that", "", " ", "x", "same line", f"l{rng.randrange(40)}"])
    rows = [(k, "\n".join(line() for _ in range(rng.choice([0, 1, 2, 3, 12, 40])))) for k in range(150)] + [(200, None), (None, "a\nb\nc\nd"), (300, "a\nb\nc\nd\na\nb\nc")]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, _starts string").repartition(4)
    import hashlib

    expected = sorted((i or -1, n, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (t, n) in zip(rows, brute(rows), strict=True))
    assert sorted((r.doc_id or -1, r.n_removed, r.text_sha256) for r in ld.digests(frame).collect()) == expected
    cleaned = ld.without_repeats(frame)
    assert cleaned.columns == frame.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in cleaned.collect()) == sorted((i or -1, t) for (i, _), (t, _) in zip(rows, brute(rows), strict=True))
    assert ld.digests(frame.limit(0)).count() == 0


def test_rows_without_ids_of_their_own(spark):
    import hashlib

    rng = random.Random(7)
    rows = [(rng.choice([None, 1, 1, 2]), "\n".join(rng.choice(["x", "y", "", f"l{rng.randrange(12)}"]) for _ in range(rng.choice([2, 3, 9, 20])))) for _ in range(60)]
    rows += [(None, "only here 1\nonly here 2\nonly here 3\nonly here 4"), (None, "s\nt\nu"), (None, "s\nt\nu"), (5, "p\nq\nr"), (5, "p\nq\nr"), (5, "p\nq\nr"), (5, None)]
    first, expected = {}, {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k)):
        lines, gone = (rows[k][1] or "").split("\n"), set()
        for s in range(len(lines) - 2):
            window = tuple(lines[s : s + 3])
            if any(x.strip() for x in window) and first.setdefault(window, (k, s)) != (k, s):
                gone.update(range(s, s + 3))
        expected[k] = (rows[k][0] or -1, "\n".join(x for n, x in enumerate(lines) if n not in gone), len(gone))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.text_sha256, r.n_removed) for r in ld.digests(frame).collect()) == sorted((i, hashlib.sha256(t.encode()).hexdigest(), n) for i, t, n in expected.values())
    assert sorted((r.doc_id or -1, r.text or "") for r in ld.without_repeats(frame).collect()) == sorted((i, t) for i, t, _ in expected.values())
