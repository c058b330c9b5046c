import hashlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from plyforge.llm import chat

TEXT = st.one_of(st.text(max_size=30), st.lists(st.sampled_from([*chat.CONTROL, "\\", "[", "<", "ROLE]", "é", "x", "\n"]), max_size=8).map("".join))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXT), TEXT), min_size=1, max_size=6))
def test_escape_and_assembly_go_back(turns):
    roles, texts = pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string())
    out, ends, text_from, text_to = chat.assembled(roles, texts)
    whole = out.tobytes().decode()
    assert chat.read_back(whole) == turns
    assert [chat.unescaped(out[a:b].tobytes().decode()) for a, b in zip(text_from, text_to, strict=True)] == [t for _, t in turns]
    for e in chat.escaped(texts).to_pylist():
        assert not any(mark in e for mark in chat.CONTROL)


def test_long_texts_in_steps(monkeypatch):
    monkeypatch.setattr(chat, "STEP", 7)
    turns = [("user", "é" * 50 + "[INST]"), ("assistant", ""), ("", "日本" * 9), ("assistant", "x</s>" * 20), ("user", "")]
    out, ends, text_from, text_to = chat.assembled(*(pa.array(x, pa.string()) for x in zip(*turns, strict=True)))
    whole = out.tobytes()
    assert chat.read_back(whole.decode()) == turns
    places = np.concatenate([[0], ends, text_from, text_to, [len(whole)]])
    assert chat.points_at(out, places).tolist() == [len(whole[:p].decode()) for p in places.tolist()]
    assert chat.points_at(out[:0], np.array([0])).tolist() == [0]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "répons\\e </s>"), (1, 0, "user", "[INST] hi"), (1, 2, None, None), (None, 0, "user", "lost"), (2, None, "assistant", ""), (2, 0, "user", "q"), (2, 0, "user", "q"), (-7, 0, "user", "a")]
    rows += [(3, k, "assistant" if k % 2 else "user", f"turn {k} " * 50) for k in range(400)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string")
    for part_bytes in (200, 1 << 20):
        got = {r.conv_id: r for r in chat.digests(chat.formatted(frame, part_bytes)).collect()}
        for conv in {r[0] for r in rows}:
            turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
            said = "".join(t for *_, role, t in turns if role == "assistant")
            r = got[conv]
            assert r.n_turns == len(turns) and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
            assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in turns).encode()).hexdigest()
    assert chat.digests(chat.formatted(frame.limit(0))).count() == 0
