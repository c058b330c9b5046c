"""Statistics of a log whose files come out of order, over several batches, against plain Python."""

import random

from plyforge.streaming import logs


def log(spark, tmp_path, rng, files):
    """Rows of 12 steps over many files: every step's rows come late in some of them, with ties and nulls."""
    rows = [(i, f"2024-01-{1 + (i * 7) % 28:02d} 00:00:00", i % 5, rng.choice("xyz"), rng.choice([None, 0.5, 1.25, 3.0, rng.random()]), "{}") for i in range(64 * 12)]
    rows += [(64 * 12 + i, "2023-01-01 00:00:00", 0, "x", None, "{}") for i in range(3)]
    rng.shuffle(rows)
    for k in range(files):
        part = rows[k::files]
        spark.createDataFrame(part, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    return rows


def test_late_rows_count_in_every_step(spark, tmp_path):
    rng = random.Random(6)
    rows = log(spark, tmp_path, rng, 7)
    want = {}
    for step in range(13):
        mine = [(r[4], r[0], r[3]) for r in rows if r[0] // 64 == step]
        told = [x for x in mine if x[0] is not None]
        best = min(told, key=lambda x: (-x[0], x[1]), default=None)
        worst = min(told, key=lambda x: (x[0], x[1]), default=None)
        want[step] = (len(mine), len(told), round(sum(x[0] for x in told) / len(told), 4) if told else None, best and (best[1], best[2], best[0]), None if worst is None or worst[1] == best[1] else (worst[1], worst[2], worst[0]))
    for files, compact in ((None, 8), (1, 2), (2, 100), (1, 1), (1, 3)):
        out = logs.step_rows(spark, str(tmp_path), files, compact).collect()
        tup = lambda x: None if x is None else (x.event_id, x.event_type, x.value)
        assert {r.step: (r.n, r.judged, None if r.mean is None else round(r.mean, 4), tup(r.best), tup(r.worst)) for r in out} == want, (files, compact)
    assert {r.step: r.n for r in logs.step_count(spark, str(tmp_path)).collect()} == {k: v[0] for k, v in want.items()}


def test_batches_that_run_again_replace_themselves(spark, tmp_path):
    from pyspark.sql import functions as F

    parts = logs.Partials(spark, ["k"], {"n": F.count(F.lit(1))}, {"n": F.sum("n")}, str(tmp_path / "p"), compact=2)
    batch = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    for number, rows in ((0, (1, 1, 2)), (1, (2,)), (1, (2,)), (2, (3,)), (2, (3,)), (3, (1,)), (3, (1,)), (4, (9,))):
        parts.take(batch(*rows), number)
    live, gone = parts._living()
    assert {r.k: r.n for r in parts._merged(live).collect()} == {1: 3, 2: 2, 3: 1, 9: 1}
    # What the first compaction took in is deleted; the second one's parts are still there.
    assert len(live) == 2 and all("-000000000" not in p for p in gone)
