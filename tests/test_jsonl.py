"""Files of JSON lines with blank and broken lines, cut into many splits, against plain Python."""

import json
import random

from plyforge.sources import jsonl


def files(tmp_path, rng):
    """Lines of all files in order, as written."""
    out = []
    for k in range(4):
        lines = []
        for _ in range(rng.choice([0, 5, 60, 120])):
            fen = f"p{rng.randrange(60)} é"
            lines.append(rng.choice([
                "", "   ", "{broken", '{"fen": "cut', '["a"]', "12", '"text"', json.dumps({"fen": fen}, ensure_ascii=False), json.dumps({"metadata": {"fen": fen}, "fen": "other"}, ensure_ascii=False),
                json.dumps({"metadata": {"fen": ""}, "fen": fen}), json.dumps({"metadata": {}, "fen": fen}), json.dumps({"fen": ""}), json.dumps({"x": 1}), json.dumps({"metadata": "no object", "fen": fen}),
                json.dumps({"fen": fen, "sf15_terms": [1, rng.random()], "eval_score": rng.randrange(9)}), json.dumps({"fen": fen, "eval_score": 1.5}), "  " + json.dumps({"fen": fen}) + " \t",
            ]))
        (tmp_path / f"part-{k}.jsonl").write_text("".join(x + "\n" for x in lines))
        out += lines
    return out


def firsts(lines, most=None):
    seen = {}
    for line in lines:
        if most and len(seen) >= most:
            break
        try:
            rec = json.loads(line.strip())
            fen = rec.get("metadata", {}).get("fen", "") or rec.get("fen", "")
        except Exception:
            continue
        if fen and fen not in seen:
            seen[fen] = rec["eval_score"] if "sf15_terms" in rec and "eval_score" in rec else None
    return list(seen.items())


def test_first_and_last_positions(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for seed in range(3):
            folder = tmp_path / str(seed)
            folder.mkdir()
            lines = files(folder, random.Random(seed))
            got = lambda df: [(r.fen, r.score) for r in sorted(df.collect(), key=lambda r: (r["at"].file, r["at"].block, r["at"].no))]
            for most in (None, 3, 25, 500):
                assert got(jsonl.first_seen(spark, str(folder), most)) == firsts(lines, most), (seed, most)
            sizes = [len(x.encode()) + 1 for x in lines]
            for bytes_ in (50, 1000, 4000, sum(sizes), sum(sizes) + 1):
                tail = [x for i, x in enumerate(lines) if sum(sizes[i:]) < bytes_ or sum(sizes) <= bytes_]
                assert got(jsonl.last_seen(spark, str(folder), 10, bytes_)) == firsts(tail, 10), (seed, bytes_)
            bad = [r.value for r in jsonl.broken(spark, str(folder)).collect()]
            no_object = {"{broken", '{"fen": "cut', '["a"]', "12", '"text"'}
            assert sorted(bad) == sorted(x for x in lines if x in no_object or "no object" in x)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_no_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n\n")
    assert jsonl.first_seen(spark, str(tmp_path), 5).collect() == [] == jsonl.last_seen(spark, str(tmp_path), 5).collect()
