"""The scorer graph against plain Python over random completions, and cases by hand."""

import random
import re

import pytest
from plyforge.operators import rewards
from pyspark.sql import functions as F

WORDS = ["Nf3", "Nc6", "e4", "e5", "Rd1+", "O-O", "x", "pin", "opinion", "because", "as", "castle", "half-open", "Passed", "pawn", "passed pawn", "active", "limit", "king danger", "\n", "|", "(a b)", "→", "<|m|>"]


def lines_of(text):
    out = []
    form = re.compile(r"<line>\s*LINE\s+\d+\s*:\s*(.+?)\|\s*eval\s*:\s*(.+?)\s*</line>|LINE\s+\d+\s*:\s*(.+?)\|\s*eval\s*:\s*(.+?)(?:\n|$)|(?:PLAYED|LINE\s+\d+)\s*:\s*(.+?)\|\s*eval\s*:\s*(.+?)(?:\n|$)", re.I | re.S)
    for m in form.finditer(text):
        body, label = [g for g in m.groups() if g is not None]
        body = re.sub(r"<\|[^|>]*\|>", "", re.sub(r"\([^)]*\)", "", body.strip()))
        moves = [w for w in re.split(r"[→\s]+", body) if re.fullmatch(r"[A-Za-z][A-Za-z0-9\-+#=!?]+", w)]
        if moves:
            out.append((moves, label.strip().lower()))
    return out


def thought_of(text):
    m = re.search(r"<think>(.*?)</think>|^(.*?)</think>", text, re.S)
    return (m[1] or m[2] or "").strip() if m else ""


def comment_of(text):
    m = re.search(r"<comment>(.*?)</comment>", text, re.S)
    if m:
        return m[1].strip()
    return re.sub("</?think>", "", text.rsplit("</line>", 1)[1].strip()).strip() if "</line>" in text else ""


def terms_of(prompt):
    m = re.search(r"## Engine Key Lines\n\n(.*?)(?=\n\n##|\Z)", prompt, re.S)
    out = {}
    for line in m[1].split("\n") if m else []:
        for san, inside, _ in re.findall(r"(\S+)\s+(?:\[([^\]]+)\]|\(([^)]+)\))", line):
            san = re.sub(r"<\|[^|>]*\|>", "", san)
            found = []
            for t, s, v in re.findall(r"(mobility|king safety|threats|material|pawns|bishops|rooks|queens|space|passed(?:\s+pawns)?|initiative|imbalance)\s*([+−\-])\s*(\d+\.?\d*)", inside, re.I):
                t = "material" if t.lower() == "imbalance" else "passed" if t.lower().startswith("passed") else t.lower()
                if float(v) >= 0.1:
                    found.append((t, float(v) if s == "+" else -float(v)))
            if san and found:
                out[san] = found
    return out


def scores_of(prompt, text, legality):
    lines, thought, comment, terms = lines_of(text), thought_of(text), comment_of(text), terms_of(prompt)
    low, out = comment.lower(), {"format": 1.0 if lines else -1.0}
    seen = set(re.findall(r"\b(?:[NBRQK][a-h1-8x+#=]?\w*|[a-h][1-8x]\w*|O-O(?:-O)?)\b", thought))
    out["think"] = 2 * (0.4 + 0.3 * (len(seen) >= 2) + 0.3 * (len(thought) >= 50)) - 1 if thought else -1.0
    each = []
    for san, found in terms.items():
        term, delta = max(found, key=lambda x: abs(x[1]))
        about = " ".join(x for x in thought.lower().split("\n") if san.lower() in x)
        good, bad = (any(w in about for w in words) for words in rewards.VOCABULARY[term])
        each.append(-0.5 if not good and not bad else 0.0 if good and bad else 1.0 if good == (delta > 0) else -1.0)
    out["terms"] = 0.0 if not each else sum(each) / len(each) if thought else -1.0
    n = sum(c in low for c in set(rewards.CONCEPTS))
    out["tone"] = [-1.0, 0.0, 0.5, 1.0][min(n, 3)] if comment else 0.0
    known = {m for moves, _ in lines for m in moves}
    said = [m for m in re.findall(r"[A-Za-z][A-Za-z0-9\-+#=!?]+", comment) if m in known]
    pairs = {p for moves, _ in lines for p in zip(moves, moves[1:])}
    ground = 0.0 if not lines else -1.0 if not said else 1.0 if len(said) == 1 else 2 * sum(p in pairs for p in zip(said, said[1:])) / (len(said) - 1) - 1
    concept = bool(set(low.split()) & set(rewards.CONCEPTS)) or any(" " in c and c in low for c in rewards.CONCEPTS)
    out["educational"] = 2 * (0.4 * (ground + 1) / 2 + 0.4 * concept + 0.2 * bool(re.search(rewards.CAUSAL, low))) - 1 if comment else 0.0
    out["combined"] = sum(w * out[k] for k, w in rewards.COMBINED.items()) - (legality < 0)
    out["training"] = sum(w * (out | {"legality": legality})[k] for k, w in rewards.TRAINING.items())
    return out


SCORES = ("format", "think", "terms", "tone", "educational", "combined", "training")


def test_against_plain_python(spark):
    rng = random.Random(11)

    def noise(k=6):
        return " ".join(rng.choices(WORDS, k=rng.randrange(k)))

    rows = []
    for i in range(400):
        annotated = " → ".join(f"{rng.choice(WORDS[:6])} [{rng.choice(list(rewards.VOCABULARY) + ['imbalance', 'Passed Pawns'])} {rng.choice('+-−')}{rng.choice(['0.05', '0.1', '.4', '0.30', '2'])}; space +0.2{rng.randrange(9)}]" for _ in range(rng.randrange(4)))
        prompt = rng.choice(["", "## Engine Key Lines\n\n"]) + f"{noise()}\nLine 1: {annotated} {noise()}\nLine 2: {annotated[:40]}" + rng.choice(["", "\n\n## Next\nNf3 [rooks +0.9]"])
        parts = [f"<think>{noise(20)}\n{noise(20)}</think>", f"{noise()}</think>", f"<line>LINE {i}: {noise(9)} | eval: {noise(3)} </line>", f"LINE 2 : {noise(9)}| eval : equal\n", f"PLAYED: {noise(9)} |eval: GOOD {noise(3)}", f"<comment>{noise(20)}</comment>", f"</line>{noise(20)}", noise(30)]
        rows.append((prompt, "".join(rng.sample(parts, rng.randrange(len(parts) + 1))), rng.choice([-1.0, -0.2, 0.0, 0.6])))
    df = spark.createDataFrame(rows, "prompt string, completion string, legality double")
    got = rewards.scored(df, "lines", *SCORES).collect()
    for r, (prompt, text, legality) in zip(got, rows, strict=True):
        assert [(x.moves, x.label) for x in r.lines] == lines_of(text), text
        want = scores_of(prompt, text, legality)
        assert {k: round(r[k], 9) for k in SCORES} == {k: round(want[k], 9) for k in SCORES}, (prompt, text)
    for k in SCORES:  # every score tells rows apart
        assert len({round(r[k], 3) for r in got}) > (1 if k == "format" else 2)


@pytest.mark.parametrize(("comment", "want"), [("an opinion", False), ("a pin", True), ("the passed pawns", True), ("half-open files", True), ("forks", False)])
def test_single_concepts_are_words(spark, comment, want):
    assert spark.range(1).select(rewards.names_concept(F.lit(comment)).alias("x")).first().x is want


def test_a_move_that_comes_again_keeps_its_place(spark):
    prompt = "## Engine Key Lines\n\nLine 1: a4 [space +0.2] → b4 [rooks -0.2] → a4 [queens +0.3; space -0.5]\nb4 (none) c4 [space +0.01]"
    got = spark.range(1).select(rewards.last_wins(rewards.annotated(rewards.section(F.lit(prompt)))).alias("x")).first().x
    assert [(m.san, [(t.term, t.delta) for t in m.terms]) for m in got] == [("a4", [("queens", 0.3), ("space", -0.5)]), ("b4", [("rooks", -0.2)])]


def test_graph_is_one_scan_and_shares_nodes(spark):
    df = spark.createDataFrame([("", "LINE 1: a4 | eval: equal", 0.0)], "prompt string, completion string, legality double")
    plan = rewards.scored(df, "combined", "training")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan.replace("PythonRDD", "").replace("applySchemaToPythonRDD", "")
    # The forms of a line are looked for once (the pattern stands in an expression of extract-all), however many scores need them.
    assert plan.count("regexp_extract_all(completion") <= 2
    with pytest.raises(ValueError, match="no node and no column"):
        rewards.scored(df.drop("legality"), "combined")
