"""Queries over whole texts, against plain Python."""

import random

from plyforge.plans import load


def contexts(turns: list[str], k: int, budget: int = 1500) -> tuple[str, str]:
    def taken(lines):
        out, chars = [], 0
        for line in lines:
            if chars >= budget:
                break
            out.append(line)
            chars += len(line) + 1
        return out

    before, after = "\n".join(turns[:k]).split("\n") if k else [], "\n".join(turns[k + 1 :]).split("\n") if k + 1 < len(turns) else []
    return "\n".join(reversed(taken(reversed(before)))).strip(), "\n".join(taken(after)).strip()


def test_contexts_are_whole_lines(spark, tmp_path):
    rng = random.Random(5)
    said = {c: ["\n".join("é" * rng.choice([0, 3, 70, 400, 2000]) + str(rng.random()) * rng.randrange(2) for _ in range(rng.randrange(1, 9))) for _ in range(n)] for c, n in enumerate([1, 2, 9, 40])}
    said[9] = ["a\n" * 1600, "x", "", "b" * 1499, "c", "d" * 1498, "e"]
    rows = [(c, k, "user", t) for c, turns in said.items() for k, t in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): (r.text_before, r.text_after) for r in load.all_queries()["x05_diagram_contexts"](spark, str(tmp_path)).collect()}
    assert got == {(c, k): contexts(said[c], k) for c, k, *_ in rows}


def test_splitter_reads_whole_texts(spark, tmp_path):
    rng = random.Random(8)
    rows = [(c, k, ("user", "assistant", "system")[(c + k) % 3], "".join(rng.choice("ab é<\n") for _ in range(rng.choice([0, 1, 9, 30, 700])))) for c in range(6) for k in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    said = {}
    for r in load.all_queries()["t04_think_splitter"](spark, str(tmp_path)).collect():
        said[r.conv_id, r.kind] = said.get((r.conv_id, r.kind), "") + r.text
    expected = {}
    for c, _, _, text in rows:
        for kind, part in (("think", text[: len(text) // 2]), ("token", text[len(text) // 2 :])):
            expected[c, kind] = expected.get((c, kind), "") + part
    assert {k: sorted(v) for k, v in said.items()} == {k: sorted(v) for k, v in expected.items() if v}
