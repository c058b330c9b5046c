"""Rewards of coaching completions as a graph of expressions: what several scorers share is a column, worked out once a row.

A node is a function of other nodes, all Columns. ``scored`` puts the nodes that the wanted scores need into layers, a projection
each, so a table of completions of any size is one scan without a shuffle, a join or a Python worker.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.operators.text import MOVES, _plain, stripped
from plyforge.plans.registry import register
from plyforge.sources.positions import quoted

# -- fixed values: forms of a printed line, of a move and of an annotation, vocabularies, weights --

#: A blank, in Java's and RE2's words alike.
S = r"[ \t-\r]"
LINE = (
    rf"(?is)<line>{S}*LINE{S}+\d+{S}*:{S}*(.+?)\|{S}*eval{S}*:{S}*(.+?){S}*</line>"
    rf"|LINE{S}+\d+{S}*:{S}*(.+?)\|{S}*eval{S}*:{S}*(.+?)(?:\n|$)"
    rf"|(?:PLAYED|LINE{S}+\d+){S}*:{S}*(.+?)\|{S}*eval{S}*:{S}*(.+?)(?:\n|$)"
)
ANNOTATION, SENTINEL = r"\([^)]*\)", r"<\|[^|>]*\|>"
MOVE = r"[A-Za-z][A-Za-z0-9\-+#=!?]+"
THINK = r"(?s)<think>(.*?)</think>|^(.*?)</think>"
COMMENT = r"(?s)<comment>(.*?)</comment>"
KEY_LINES = "## Engine Key Lines\n\n"
#: A move with what stands in brackets or parentheses behind it, on one line.
ANNOTATED = r"([^ \t-\r]+)[ \t\x0B-\r]+(?:\[([^\]\n]+)\]|\([^)\n]+\))"
TERM = r"(?i)(mobility|king safety|threats|material|pawns|bishops|rooks|queens|space|passed(?:[ \t-\r]+pawns)?|initiative|imbalance)[ \t-\r]*([+−\-])[ \t-\r]*(\d+\.?\d*)"
LEAST_DELTA = 0.10
#: Words for a term that got better, and for one that got worse.
VOCABULARY = {
    "mobility": (
        ("mobility", "active", "activity", "maneuver", "maneuvering", "flexible", "freedom", "improves piece", "piece activity", "coordinate", "coordination"),
        ("restrict", "restricted", "passive", "limit", "limited", "cramped", "immobile"),
    ),
    "king safety": (
        ("king safety", "king shelter", "shelter", "tuck", "tucked", "safe", "castle", "castles", "castling", "protect king", "king cover", "cover"),
        ("king danger", "exposed king", "weakens king", "weaken king", "king weakness", "attack king", "open king", "king cover", "unsafe king"),
    ),
    "threats": (
        ("threat", "threats", "counterplay", "attack", "attacking", "pressure", "tactical", "dangerous", "initiative", "fork", "pin", "skewer"),
        ("allows threat", "allows attack", "permits", "allows tactical", "opponent threat"),
    ),
    "material": (
        ("material", "winning material", "gains material", "up material", "capture", "wins piece", "wins pawn"),
        ("loses material", "down material", "sacrifice", "gives up", "loses piece"),
    ),
    "pawns": (
        ("pawn structure", "pawn majority", "passed pawn", "pawn chain", "pawn advance", "strong pawn"),
        ("weak pawn", "isolated pawn", "doubled pawn", "backward pawn", "pawn weakness"),
    ),
    "bishops": (("bishop pair", "good bishop", "active bishop", "open diagonal", "diagonal"), ("bad bishop", "buried bishop", "buries bishop", "restricted bishop")),
    "rooks": (("open file", "rook activity", "rook on seventh", "seventh rank", "connected rooks", "rook lift"), ("passive rook", "closed file", "inactive rook")),
    "queens": (("queen activity", "active queen", "centralise queen", "queen pressure"), ("misplace queen", "misplaces queen", "poor queen", "passive queen")),
    "space": (
        ("central space", "space advantage", "territory", "gain space", "gains space", "gain central", "more space", "spatial"),
        ("cede space", "concede space", "cramped", "restricted space", "restricts space", "less space"),
    ),
    "passed": (("passed pawn", "passer", "advancing pawn", "queening", "promote"), ("stop passer", "blockade", "blockaded")),
    "initiative": (("initiative", "tempo", "lead development", "active", "pressure"), ("lose initiative", "passive", "reactive")),
}
#: Concepts that a coaching comment may name.
CONCEPTS = (
    "fork", "pin", "skewer", "discovery", "discovered attack", "double attack", "deflection", "decoy", "overloaded", "overloading", "interference", "zwischenzug",
    "in-between move", "zugzwang", "stalemate", "sacrifice", "exchange sacrifice", "combination", "tactics", "tactical", "mating net", "checkmate", "back rank",
    "trapped", "hanging", "tempo", "initiative", "outpost", "centre", "center", "central", "space", "development", "develop", "king safety", "pawn structure",
    "pawn chain", "isolated pawn", "doubled pawn", "backward pawn", "passed pawn", "pawn majority", "open file", "half-open", "semi-open", "open diagonal", "diagonal",
    "battery", "rook on seventh", "seventh rank", "connected rooks", "rook lift", "fianchetto", "bishop pair", "bad bishop", "good bishop", "knight outpost",
    "strong square", "weak square", "weakness", "structural weakness", "prophylaxis", "restriction", "coordination", "activity", "piece activity", "pressure",
    "attack", "counterattack", "defend", "defense", "counterplay", "compensation", "material", "material imbalance", "exchange", "strategic", "positional",
    "endgame", "middlegame", "opening", "mobility", "threats", "bishops", "rooks", "queens", "castling", "castle", "promotion", "en passant", "check", "recapture",
)
#: Words that give a reason.
CAUSAL = r"\b(because|since|as\b|so that|which means|allowing|preventing|in order to|this (?:gives|creates|opens|loses|wins|allows)|enabling|leads to)\b"
#: Parts of the combined rewards. Legality is a gate in the first (a whole point off where it is negative) and a part of the second.
COMBINED = {"format": 0.10, "think": 0.15, "terms": 0.50, "tone": 0.15, "educational": 0.10}
TRAINING = {"format": 0.10, "think": 0.15, "legality": 1.0, "terms": 0.35, "tone": 0.20, "educational": 0.20}

# -- nodes --


def lines(completion: Column) -> Column:
    """Printed lines with at least one move: array of (moves, label)."""
    group = lambda m, *ks: F.concat(*(F.regexp_extract(m, LINE, k) for k in ks))  # noqa: E731  one alternative matches
    bare = lambda body: F.regexp_replace(F.regexp_replace(stripped(body), ANNOTATION, ""), SENTINEL, "")
    moves = lambda body: F.filter(F.split(bare(body), r"[→ \t-\r]+"), lambda w: w.rlike(f"^(?:{MOVE})\\z"))
    parsed = F.transform(F.regexp_extract_all(completion, F.lit(LINE), F.lit(0)), lambda m: F.struct(moves(group(m, 1, 3, 5)).alias("moves"), F.lower(stripped(group(m, 2, 4, 6))).alias("label")))
    return F.filter(parsed, lambda x: F.size(x["moves"]) > 0)


def think(completion: Column) -> Column:
    return stripped(F.concat(F.regexp_extract(completion, THINK, 1), F.regexp_extract(completion, THINK, 2)))


def comment(completion: Column) -> Column:
    after = stripped(F.regexp_replace(stripped(F.substring_index(completion, "</line>", -1)), "</?think>", ""))
    return F.when(completion.rlike(COMMENT), stripped(F.regexp_extract(completion, COMMENT, 1))).when(completion.contains("</line>"), after).otherwise("")


def section(prompt: Column) -> Column:
    """The section of key lines of a prompt; null without one."""
    found = F.regexp_extract(prompt, rf"(?s){KEY_LINES}(.*?)(?=\n\n##|\z)", 1)
    return F.when(prompt.contains(KEY_LINES), found)


def annotated(section: Column) -> Column:
    """Moves with their notable terms, array of (san, terms: array of (term, delta)); of a move that comes again, the last, where it first stood."""
    names = lambda b, k: F.regexp_extract_all(b, F.lit(TERM), F.lit(k))
    canonical = lambda t: F.when(t == "imbalance", "material").when(t.startswith("passed"), "passed").otherwise(t)
    delta = lambda s, v: F.when(s == "+", 1.0).otherwise(-1.0) * v.cast("double")
    each = lambda b: F.transform(F.arrays_zip(names(b, 1).alias("t"), names(b, 2).alias("s"), names(b, 3).alias("v")), lambda x: F.struct(canonical(F.lower(x["t"])).alias("term"), delta(x["s"], x["v"]).alias("delta")))
    pairs = F.arrays_zip(F.regexp_extract_all(section, F.lit(ANNOTATED), F.lit(1)).alias("san"), F.regexp_extract_all(section, F.lit(ANNOTATED), F.lit(2)).alias("b"))
    found = F.transform(pairs, lambda x: F.struct(F.regexp_replace(x["san"], SENTINEL, "").alias("san"), F.filter(each(x["b"]), lambda t: F.abs(t["delta"]) >= LEAST_DELTA).alias("terms")))
    return F.coalesce(F.filter(found, lambda x: (x["san"] != "") & (F.size(x["terms"]) > 0)), F.array().cast("array<struct<san:string,terms:array<struct<term:string,delta:double>>>>"))


def last_wins(annotated: Column) -> Column:
    """The map of ``annotated`` as an array: a fold in which a move that is already there takes the new terms in its old place."""
    put = lambda acc, x: F.when(F.exists(acc, lambda y: y["san"] == x["san"]), F.transform(acc, lambda y: F.when(y["san"] == x["san"], x).otherwise(y))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(annotated, F.array().cast("array<struct<san:string,terms:array<struct<term:string,delta:double>>>>"), put)


def _vocabulary(side: int) -> Column:
    return F.create_map(*(x for term, words in VOCABULARY.items() for x in (F.lit(term), F.array(*map(F.lit, words[side])))))


def interpretation(think_lines: Column, move: Column) -> Column:
    """1, -1, 0 or -0.5: the lines of the thinking that name the move frame its largest term rightly, wrongly, both ways or not at all."""
    top = F.aggregate(move["terms"], F.get(move["terms"], F.lit(0)), lambda best, t: F.when(F.abs(t["delta"]) > F.abs(best["delta"]), t).otherwise(best))
    context = F.array_join(F.filter(think_lines, lambda line: line.contains(F.lower(move["san"]))), " ")
    has = lambda side: F.exists(F.element_at(_vocabulary(side), top["term"]), lambda w: context.contains(w))
    gain, good, bad = top["delta"] > 0, has(0), has(1)
    right, wrong = (good & gain) | (bad & ~gain), (bad & gain) | (good & ~gain)
    return F.when(~good & ~bad, -0.5).when(right & ~wrong, 1.0).when(wrong & ~right, -1.0).otherwise(0.0)


def term_scores(think: Column, moves: Column) -> Column:
    """(san, score) of every annotated move."""
    think_lines = F.split(F.lower(think), "\n")
    return F.transform(moves, lambda m: F.struct(m["san"].alias("san"), interpretation(think_lines, m).alias("score")))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def reward_format(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, 1.0).otherwise(-1.0)


def reward_think(think: Column) -> Column:
    moves = F.size(F.array_distinct(F.regexp_extract_all(think, F.lit(MOVES), F.lit(0))))
    raw = 0.4 + F.when(moves >= 2, 0.3).otherwise(0.0) + F.when(F.length(think) >= 50, 0.3).otherwise(0.0)
    return F.when(think == "", -1.0).otherwise(2.0 * raw - 1.0)


def reward_terms(think: Column, moves: Column, term_scores: Column) -> Column:
    return F.when(F.size(moves) == 0, 0.0).when(think == "", -1.0).otherwise(mean(F.transform(term_scores, lambda x: x["score"])))


def reward_tone(comment: Column) -> Column:
    n = F.size(F.filter(F.array(*map(F.lit, CONCEPTS)), lambda w: F.lower(comment).contains(w)))
    return F.when(comment == "", 0.0).when(n == 0, -1.0).when(n == 1, 0.0).when(n == 2, 0.5).otherwise(1.0)


def grounding(comment: Column, lines: Column) -> Column:
    """Share of neighbouring moves of the comment that are neighbours in a line, on [-1, 1]; 0 without lines, -1 without moves, 1 of one move."""
    known = F.flatten(F.transform(lines, lambda x: x["moves"]))
    said = F.filter(F.regexp_extract_all(comment, F.lit(MOVE), F.lit(0)), lambda m: F.array_contains(known, m))
    pairs = lambda ms: F.zip_with(F.slice(ms, F.lit(1), F.greatest(F.size(ms) - 1, F.lit(0))), F.slice(ms, F.lit(2), F.greatest(F.size(ms) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    printed = F.flatten(F.transform(lines, lambda x: pairs(x["moves"])))
    hits = F.size(F.filter(pairs(said), lambda p: F.array_contains(printed, p)))
    return F.when(F.size(lines) == 0, 0.0).when(F.size(said) == 0, -1.0).when(F.size(said) == 1, 1.0).otherwise(2.0 * hits / (F.size(said) - 1) - 1.0)


def names_concept(comment: Column) -> Column:
    """A concept of one word as a word, one of several words anywhere."""
    low = F.lower(comment)
    return F.arrays_overlap(F.split(low, f"{S}+"), F.array(*(F.lit(c) for c in CONCEPTS))) | F.exists(F.array(*(F.lit(c) for c in CONCEPTS if " " in c)), lambda c: low.contains(c))


def reward_educational(comment: Column, grounding: Column, names_concept: Column) -> Column:
    raw = 0.4 * ((grounding + 1.0) / 2.0) + 0.4 * names_concept.cast("double") + 0.2 * F.lower(comment).rlike(CAUSAL).cast("double")
    return F.when(comment == "", 0.0).otherwise(2.0 * raw - 1.0)


def weighted(weights: dict[str, float], gate: bool = False):
    def node(**parts: Column) -> Column:
        total = reduce(lambda a, b: a + b, (parts[k] * w for k, w in weights.items()))
        return total + F.when(parts["legality"] < 0, -1.0).otherwise(0.0) if gate else total

    return node, (*weights, *(["legality"] if gate else []))


#: Name of a node: function and the nodes it takes. ``prompt``, ``completion`` and ``legality`` are columns of the input.
NODES: dict[str, tuple[Callable[..., Column], tuple[str, ...]]] = {
    "lines": (lines, ("completion",)), "thought": (think, ("completion",)), "comment": (comment, ("completion",)),
    "section": (section, ("prompt",)), "annotated": (annotated, ("section",)), "moves": (last_wins, ("annotated",)),
    "term_scores": (term_scores, ("thought", "moves")), "grounding": (grounding, ("comment", "lines")), "names_concept": (names_concept, ("comment",)),
    "format": (reward_format, ("lines",)), "think": (reward_think, ("thought",)), "terms": (reward_terms, ("thought", "moves", "term_scores")),
    "tone": (reward_tone, ("comment",)), "educational": (reward_educational, ("comment", "grounding", "names_concept")),
    "combined": weighted(COMBINED, gate=True), "training": weighted(TRAINING),
}


def scored(df: DataFrame, *wanted: str, nodes=None) -> DataFrame:
    """``df`` (which has the inputs that the nodes need) with the columns ``wanted``; in-between ones are worked out once and dropped."""
    nodes = NODES if nodes is None else nodes
    level: dict[str, int] = {}

    def depth(name: str) -> int:
        if name not in nodes:
            if name not in df.columns:
                raise ValueError(f"no node and no column {name}")
            return 0
        if name not in level:
            level[name] = 0  # a node that comes to itself again has no depth of its own
            level[name] = 1 + max(map(depth, nodes[name][1]))
        return level[name]

    for name in wanted:
        depth(name)
    held = lambda name: F.col(f"_node_{name}") if name in nodes else F.col(f"`{name}`")
    out = df
    for k in range(1, max(level.values(), default=0) + 1):
        made = {}
        for name in (n for n, d in level.items() if d == k):
            of, needs = nodes[name]
            is_sum = of.__name__ == "node"
            made[f"_node_{name}"] = of(**{n: held(n) for n in needs}) if is_sum else of(*map(held, needs))
        out = out.withColumns(made)
    return out.select(*(f"`{c}`" for c in df.columns), *(held(n).alias(n) for n in wanted))


# -- queries: prompts and completions in forms that the scorers must tell apart, around the whole text of a turn --

PROMPTS = (
    "FEN: 8/8/8/8/8/8/8/8 w - - 0 1\nMove: e4\n{t}",
    "Move: Nd5\n\n## Engine Key Lines\n\nPLAYED LINE: Nd5 [mobility +0.{a}; king safety −0.{b}] → Kh7 (no notable term changes) → <|move|>Nd5 [threats -0.{b}; Rooks + 1]\nLine 1: Nf3 [passed pawns +0.{b}; imbalance -0.{a}] → Bc4 [space +0.05]\n\n## Question\n\nLine 9: a1 [rooks +0.90] {t}",
    "## Engine Key Lines\n\n{t}\nLine 2: Kh7 [king safety −0.{a}; Mobility +0.{b}] → a1 [rooks +0.2]\nLine 3: [x]\nb2\n [queens -3]",
    "## Engine Key Lines\n\nLine 1: e4 (quiet) → e5 [nothing here] → Nc6 [initiative+.5; initiative - 0.{b}.]\n\n## More [x] {t}",
    "## Engine Key Lines\n{t} Nd5 [mobility +0.50]",
    "## Engine Key Lines\n\nLine 1: Bc4 [bishops +0.{a}; pawns -0.{a}; space +0.{b}] → Rd1 [material -0.{b}]  → Bc4 [king safety +0.0{a}]\n\n##",
)
COMPLETIONS = (
    "<think>Nd5 improves piece activity and freedom\nKh7 leaves an exposed king\n{t}</think>\n<line>LINE 1: Nf3 (develops) → Nc6 → Bc4 | eval: equal</line>\n<comment>Nf3 Nc6 and Bc4: {t} because the pin wins</comment>",
    "nd5 would restrict us, active or passive {t}</think>\nLINE 1: e4 → e5 <|b|> → Nf3 | eval: Good for white\nPLAYED : d4 → d5 | eval: good for black \n</line> e4 e5 d5 Nf3, an opinion as such. {t}",
    "Before <think>Kh7 keeps the king cover. Bc4 is a good bishop on a diagonal and a bad bishop too\nNc6 lose initiative, Nf3 a passer\n{t}</think>played: O-O → O-O-O | eval: equal",
    "{t}\nLINE 1 : d4 → d5 (a (nested) one) | eval: winning\nfor black",
    "<line> LINE 2: Rd1 Rd1+ x | eval : good </line><line>LINE 3: 1. → 2. | eval: none</line> Rd1 Rd1+ Rd1 half-open castle {t} </line> <think>",
    "<comment> </comment></line>This gives nothing. {t}",
    "LINE 1: a | eval: equal\n{t}",
    "<think></think>{t}",
    "<think>short Rd1 gives up material, wins pawn; Bc4 king danger\n{t}</think></line> {t} as a pin",
    "{t}",
)
NUMBERS = "lpad(((conv_id * 7 + turn * 13) % 100)::INTEGER::VARCHAR, 2, '0')", "lpad(((conv_id * 31 + turn) % 100)::INTEGER::VARCHAR, 2, '0')"
_sql_pick = lambda forms, place: f"[{', '.join(quoted(f) for f in forms)}][(({place}) % {len(forms)})::INTEGER + 1]"
JUDGED_SQL = (
    f"SELECT conv_id, turn, replace(replace(replace({_sql_pick(PROMPTS, 'conv_id + turn')}, '{{a}}', {NUMBERS[0]}), '{{b}}', {NUMBERS[1]}), '{{t}}', coalesce(text, '')) AS prompt, "
    f"replace({_sql_pick(COMPLETIONS, 'conv_id * 3 + turn * 7')}, '{{t}}', coalesce(text, '')) AS completion, ((conv_id + turn * 2) % 5) / 2.0::DOUBLE - 1 AS legality FROM conversations"
)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, prompt, completion, legality (as a rules kernel gives it)."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    c, k = F.col("conv_id"), F.col("turn")
    pick = lambda forms, place: F.get(F.array(*map(F.lit, forms)), (place % len(forms)).cast("int"))
    number = lambda n: F.lpad((n % 100).cast("int").cast("string"), 2, "0")
    prompt = F.replace(F.replace(F.replace(pick(PROMPTS, c + k), F.lit("{a}"), number(c * 7 + k * 13)), F.lit("{b}"), number(c * 31 + k)), F.lit("{t}"), F.col("t"))
    return rows.select("conv_id", "turn", prompt.alias("prompt"), F.replace(pick(COMPLETIONS, c * 3 + k * 7), F.lit("{t}"), F.col("t")).alias("completion"), ((c + k * 2) % 5 / 2.0 - 1).alias("legality"))


_strip = lambda x: rf"regexp_replace(regexp_replace({x}, '^{S}+', ''), '{S}+$', '')"
_any_of = lambda words, text: f"len(list_filter([{', '.join(map(quoted, words))}], lambda w: contains({text}, w))) > 0"
_case = lambda side: "CASE term " + " ".join(f"WHEN '{t}' THEN [{', '.join(map(quoted, w[side]))}]" for t, w in VOCABULARY.items()) + " END"
_sql_line = LINE.replace("'", "''")
_groups = lambda *ks: " || ".join(f"coalesce(regexp_extract(m, '{_sql_line}', {k}), '')" for k in ks)
#: The same in steps of SQL: lines and terms as rows, folds as aggregates.
STEPS_SQL = rf"""
WITH judged AS ({JUDGED_SQL}),
texts AS (
  SELECT conv_id, turn, prompt, completion, legality, lower(comment) AS low, comment, thought FROM (
    SELECT *, {_strip(f"regexp_extract(completion, '{THINK}', 1) || regexp_extract(completion, '{THINK}', 2)")} AS thought,
      CASE WHEN regexp_matches(completion, '{COMMENT}') THEN {_strip(f"regexp_extract(completion, '{COMMENT}', 1)")}
        WHEN contains(completion, '</line>') THEN {_strip(f"regexp_replace({_strip("string_split(completion, '</line>')[-1]")}, '</?think>', '', 'g')")} ELSE '' END AS comment
    FROM judged)),
line_rows AS (
  SELECT conv_id, turn, i, moves, label FROM (
    SELECT conv_id, turn, i, lower({_strip("label")}) AS label,
      list_filter(regexp_split_to_array(regexp_replace(regexp_replace({_strip("body")}, '{ANNOTATION}', '', 'g'), '{SENTINEL}', '', 'g'), '[→ \t-\r]+'), lambda w: regexp_full_match(w, '{MOVE}')) AS moves
    FROM (SELECT conv_id, turn, i, {_groups(1, 3, 5)} AS body, {_groups(2, 4, 6)} AS label FROM (
      SELECT conv_id, turn, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (SELECT conv_id, turn, regexp_extract_all(completion, '{_sql_line}') AS ms FROM judged))))
  WHERE len(moves) > 0),
line_sums AS (
  SELECT conv_id, turn, count(*) AS n_lines, flatten(list(moves ORDER BY i)) AS known,
    flatten(list(list_transform(range(1, len(moves)), lambda j: moves[j] || ' ' || moves[j + 1]) ORDER BY i)) AS printed,
    string_agg(array_to_string(moves, ' ') || '=' || label, '|' ORDER BY i) AS shown
  FROM line_rows GROUP BY conv_id, turn),
sections AS (
  SELECT conv_id, turn, CASE WHEN strpos(rest, chr(10) || chr(10) || '##') > 0 THEN left(rest, strpos(rest, chr(10) || chr(10) || '##') - 1) ELSE rest END AS part
  FROM (SELECT conv_id, turn, substr(prompt, strpos(prompt, {quoted(KEY_LINES)}) + {len(KEY_LINES)}) AS rest FROM judged WHERE contains(prompt, {quoted(KEY_LINES)}))),
move_rows AS (
  SELECT conv_id, turn, unnest(range(1, len(sans) + 1)) AS i, sans, brackets FROM (
    SELECT conv_id, turn, regexp_extract_all(part, '{ANNOTATED}', 1) AS sans, regexp_extract_all(part, '{ANNOTATED}', 2) AS brackets FROM sections)),
term_rows AS (
  SELECT conv_id, turn, i, san, unnest(range(1, len(ts) + 1)) AS k, ts, ss, vs FROM (
    SELECT conv_id, turn, i, regexp_replace(sans[i], '{SENTINEL}', '', 'g') AS san, regexp_extract_all(coalesce(brackets[i], ''), '{TERM}', 1) AS ts,
      regexp_extract_all(coalesce(brackets[i], ''), '{TERM}', 2) AS ss, regexp_extract_all(coalesce(brackets[i], ''), '{TERM}', 3) AS vs FROM move_rows)),
deltas AS (
  SELECT conv_id, turn, i, san, k, CASE WHEN t = 'imbalance' THEN 'material' WHEN starts_with(t, 'passed') THEN 'passed' ELSE t END AS term, delta
  FROM (SELECT *, lower(ts[k]) AS t, CASE WHEN ss[k] = '+' THEN 1.0 ELSE -1.0 END * vs[k]::DOUBLE AS delta FROM term_rows)
  WHERE abs(delta) >= {LEAST_DELTA} AND san <> ''),
last_rows AS (
  SELECT *, min(i) OVER (PARTITION BY conv_id, turn, san) AS place FROM deltas
  QUALIFY i = max(i) OVER (PARTITION BY conv_id, turn, san)),
tops AS (
  SELECT conv_id, turn, san, place, term, delta, thought FROM last_rows JOIN texts USING (conv_id, turn)
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn, san ORDER BY abs(delta) DESC, k) = 1),
framed AS (
  SELECT *, len(list_filter({_case(0)}, lambda w: contains(context, w))) > 0 AS good, len(list_filter({_case(1)}, lambda w: contains(context, w))) > 0 AS bad
  FROM (SELECT *, array_to_string(list_filter(string_split(lower(thought), chr(10)), lambda l: contains(l, lower(san))), ' ') AS context FROM tops)),
move_scores AS (
  SELECT conv_id, turn, san, place, CASE WHEN NOT good AND NOT bad THEN -0.5 WHEN good AND bad THEN 0.0 WHEN good = (delta > 0) THEN 1.0 ELSE -1.0 END::DOUBLE AS score FROM framed),
term_sums AS (
  SELECT conv_id, turn, sum(score) / count(*) AS score, string_agg(san || ':' || CASE score WHEN 1 THEN '+' WHEN -1 THEN '-' WHEN 0 THEN '0' ELSE '?' END, ',' ORDER BY place) AS shown FROM move_scores GROUP BY conv_id, turn),
said_rows AS (
  SELECT conv_id, turn, low, comment, thought, legality, n_lines, printed, l.shown AS lines_shown,
    list_filter(regexp_extract_all(comment, '{MOVE}'), lambda m: list_contains(coalesce(known, []), m)) AS said
  FROM texts LEFT JOIN line_sums l USING (conv_id, turn)),
parts AS (
  SELECT s.conv_id, s.turn, legality, comment, coalesce(lines_shown, '') AS lines_shown, coalesce(t.shown, '') AS terms_shown,
    CASE WHEN n_lines > 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS format,
    CASE WHEN thought = '' THEN -1.0 ELSE 2.0 * (0.4 + CASE WHEN len(list_distinct(regexp_extract_all({_plain("thought")}, '{MOVES[4:]}'))) >= 2 THEN 0.3 ELSE 0 END + CASE WHEN length(thought) >= 50 THEN 0.3 ELSE 0 END) - 1 END::DOUBLE AS think,
    CASE WHEN t.score IS NULL THEN 0.0 WHEN thought = '' THEN -1.0 ELSE t.score END::DOUBLE AS terms,
    CASE WHEN comment = '' THEN 0.0 ELSE [-1.0, 0.0, 0.5, 1.0][least(len(list_filter([{', '.join(map(quoted, CONCEPTS))}], lambda w: contains(low, w))), 3) + 1] END::DOUBLE AS tone,
    CASE WHEN coalesce(n_lines, 0) = 0 THEN 0.0 WHEN len(said) = 0 THEN -1.0 WHEN len(said) = 1 THEN 1.0
      ELSE 2.0 * len(list_filter(range(1, len(said)), lambda j: list_contains(printed, said[j] || ' ' || said[j + 1]))) / (len(said) - 1) - 1 END::DOUBLE AS grounding,
    {_any_of([c for c in CONCEPTS if ' ' in c], 'low')} OR len(list_intersect(regexp_split_to_array(low, '{S}+'), [{', '.join(map(quoted, CONCEPTS))}])) > 0 AS concept,
    regexp_matches(low, '{CAUSAL}') AS causal
  FROM said_rows s LEFT JOIN term_sums t USING (conv_id, turn)),
scores AS (
  SELECT *, CASE WHEN comment = '' THEN 0.0 ELSE 2 * (0.4 * (grounding + 1) / 2 + 0.4 * concept::INTEGER + 0.2 * causal::INTEGER) - 1 END::DOUBLE AS educational FROM parts)
"""


def score_query(key: str, sql: str, *wanted: str, shown: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def query(spark, sf_dir):
        out = scored(judged(spark, sf_dir), *wanted).drop("prompt", "completion", "legality")
        return out if shown is None else shown(out)

    register(key, f"{STEPS_SQL} SELECT conv_id, turn, {sql} FROM scores")(query)


_mark = lambda c: F.when(c == 1, "+").when(c == -1, "-").when(c == 0, "0").otherwise("?")
score_query("r01_parse_lines", "lines_shown AS lines", "lines", shown=lambda df: df.withColumn("lines", F.array_join(F.transform("lines", lambda x: F.concat(F.array_join(x["moves"], " "), F.lit("="), x["label"])), "|")))
score_query("r03_reward_format", "format AS reward", "format", shown=lambda df: df.withColumnRenamed("format", "reward"))
score_query("r04_reward_think", "think AS reward", "think", shown=lambda df: df.withColumnRenamed("think", "reward"))
score_query("r07_interpretation", "terms_shown AS scores", "term_scores", shown=lambda df: df.select("conv_id", "turn", F.array_join(F.transform("term_scores", lambda x: F.concat(x["san"], F.lit(":"), _mark(x["score"]))), ",").alias("scores")))
score_query("r08_reward_terms", "terms AS reward", "terms", shown=lambda df: df.withColumnRenamed("terms", "reward"))
score_query("r09_comment", "comment", "comment")
score_query("r10_reward_tone", "tone AS reward", "tone", shown=lambda df: df.withColumnRenamed("tone", "reward"))
score_query("r11_grounded_pairs", "grounding AS score", "grounding", shown=lambda df: df.withColumnRenamed("grounding", "score"))
score_query("r12_reward_educational", "grounding, educational AS reward", "grounding", "educational", shown=lambda df: df.withColumnRenamed("educational", "reward"))
_sum_sql = lambda weights: " + ".join(f"{w} * {k}" for k, w in weights.items())
score_query("r13_combined_reward", f"{_sum_sql(COMBINED)} + CASE WHEN legality < 0 THEN -1.0 ELSE 0.0 END AS reward", "combined", shown=lambda df: df.withColumnRenamed("combined", "reward"))
score_query("r14_training_reward", f"{_sum_sql(TRAINING)} AS reward", "training", shown=lambda df: df.withColumnRenamed("training", "reward"))


@register("r06_prompt_terms", f"""{STEPS_SQL} SELECT conv_id, turn, coalesce(terms, '') AS terms FROM judged LEFT JOIN (
  SELECT conv_id, turn, string_agg(san || '[' || t || ']', ',' ORDER BY place) AS terms FROM (
    SELECT conv_id, turn, san, place, string_agg(term || ':' || printf('%+.2f', delta), ';' ORDER BY k) AS t FROM last_rows GROUP BY conv_id, turn, san, place)
  GROUP BY conv_id, turn) USING (conv_id, turn)""")  # fmt: skip
def prompt_terms(spark, sf_dir):
    """Notable terms of every move of a prompt's key lines; of a move that comes again, the last."""
    term = lambda t: F.concat(t["term"], F.lit(":"), F.format_string("%+.2f", t["delta"]))
    move = lambda m: F.concat(m["san"], F.lit("["), F.array_join(F.transform(m["terms"], term), ";"), F.lit("]"))
    return scored(judged(spark, sf_dir), "moves").select("conv_id", "turn", F.array_join(F.transform("moves", move), ",").alias("terms"))


@register("x09_key_lines", rf"""{STEPS_SQL} SELECT conv_id, turn, coalesce(key_lines, '') AS key_lines FROM judged LEFT JOIN (
  SELECT conv_id, turn, string_agg(array_to_string(sans, ' '), '|' ORDER BY i) AS key_lines FROM (
    SELECT conv_id, turn, i, list_filter(list_transform(string_split(regexp_extract(l, '^(?:PLAYED LINE|Line \d+):{S}*([^\n]*)', 1), '→'),
      lambda x: {_strip(rf"regexp_replace(replace(x, '<|move|>', ''), '{S}*\[.*?\]', '', 'g')")}), lambda x: x <> '') AS sans
    FROM (SELECT conv_id, turn, {_strip("unnest(ls)")} AS l, generate_subscripts(ls, 1) AS i FROM (SELECT conv_id, turn, string_split(part, chr(10)) AS ls FROM sections)))
  WHERE len(sans) > 0 GROUP BY conv_id, turn) USING (conv_id, turn)""")  # fmt: skip
def key_lines(spark, sf_dir):
    """The moves of the printed lines of a prompt's key lines section, annotations and move marks taken out."""
    head = rf"^(?:PLAYED LINE|Line \d+):{S}*([^\n]*)"
    bare = lambda m: stripped(F.regexp_replace(F.replace(m, F.lit("<|move|>"), F.lit("")), rf"{S}*\[.*?\]", ""))
    sans = lambda line: F.filter(F.transform(F.split(F.regexp_extract(stripped(line), head, 1), "→"), bare), lambda m: m != "")
    found = F.filter(F.transform(F.split(F.coalesce("section", F.lit("")), "\n"), sans), lambda x: F.size(x) > 0)
    return scored(judged(spark, sf_dir), "section").select("conv_id", "turn", F.array_join(F.transform(found, lambda x: F.array_join(x, " ")), "|").alias("key_lines"))
