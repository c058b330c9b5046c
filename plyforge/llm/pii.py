"""Personal data by patterns, and by bootstrapped contexts, in DataFrame functions only.

Base spans come from four expressions (below). They are the seeds of the bootstrap: the words around them become lexical
patterns (the word before, the two words before, the word after), tokens with digits or an @ that no expression takes, and
runs of digit tokens between single blanks, are further instances, and patterns and instances score each other over the graph of who stands next to whom:

- a pattern's trust in a kind is the sum of its different instances' scores over their number and a prior weight of no score;
  it needs SUPPORT different seeds of the kind. Seeds score 1 for their kind and 0 for others, open instances what they have;
- an instance's score is the noisy-or of its confident patterns, those of trust CONFIDENT or more. Patterns of less trust say
  nothing, however many of them there are;
- an instance is sure at SURE: one very good pattern, or several different confident ones.

Words of a context lie whole within CONTEXT_CHARS characters of the instance; what does not is no pattern.

New scores make further patterns confident, or fewer, so this goes on for ROUNDS rounds, or until the confident patterns stay as they
are; without any, nothing is discovered. Sure instances that have the digits or signs of the kind become spans of it; of a token and
a run around it, the run. Base spans stay as they are, and nothing is added over them.

The expressions are linear in the text: possessive where what follows cannot match inside, and tried only where a longest
run begins. Handling of odd input: a null text counts as empty; texts without spans give empty strings; repeated rows and
null ids keep a row each; an empty table gives an empty result; other columns are ignored. Offsets are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.llm import common

KINDS = ("email", "ip", "card", "phone")
#: In the order of KINDS. Each finds the leftmost, longest matches of its kind; `valid` drops what fails after.
EXPRESSIONS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"(?<![0-9])(?<![0-9][ -])(?=[0-9](?:[ -]?[0-9]){15})[0-9]++(?:[ -][0-9]++)*+",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
#: A text without this has no match of the kind.
SIGNS = ("@", ".", None, "+")
#: Whole tokens with a digit or an @: what the bootstrap may discover.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Tokens of digits and their signs, two or more between single blanks.
RUN = r"(?<!\S)[(+]*+[0-9][0-9().+-]*+(?: [(]*+[0-9][0-9().+-]*+)++[^\s\w]*+"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"

#: Patterns below CONFIDENT say nothing: many of them together must not make an instance sure.
SUPPORT, PRIOR, CONFIDENT, SURE, ROUNDS = 3, 1.0, 0.8, 0.95, 4
CONTEXT_CHARS = 64
#: So many matches of a kind with what is between them have more than CONTEXT_CHARS characters; a few mostly have, too.
BACK, NEAR = CONTEXT_CHARS // 2 + 1, 8


def _found(text: Column, kind: int, expression: str, sign: str | None) -> tuple[Column, Column]:
    """(matches, the text between them)."""
    none = F.array().cast("array<string>")
    matches = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    return (matches if sign is None else F.when(F.instr(text, sign) > 0, matches).otherwise(none)), F.split(text, expression, -1)


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _context(before: Column, after: Column) -> Column:
    """(w1, w2, w3): word before, two words before, word after, lower-cased; null where there is none within CONTEXT_CHARS
    characters: a word that is cut there is none."""
    n = F.lit(CONTEXT_CHARS)
    last = F.right(before, n)
    # The first word of what was cut off is not whole, unless a blank stands before it.
    cut = (F.length(before) > n) & ~last.rlike(r"^\s")
    words = F.filter(F.split(F.lower(last), r"\s+"), lambda w: w != "")
    whole = F.when(cut, F.slice(words, 2, CONTEXT_CHARS)).otherwise(words)
    next_ = F.lower(F.left(after, n))
    then = F.when(F.length(after) > n, F.regexp_extract(next_, r"^\s*(\S+)\s", 1)).otherwise(F.regexp_extract(next_, r"^\s*(\S+)", 1))
    at = lambda ws, k: F.get(ws, F.size(ws) - k)
    return _let(whole, lambda ws: F.struct(at(ws, 1).alias("w1"), F.when(F.size(ws) > 1, F.concat_ws(" ", at(ws, 2), at(ws, 1))).alias("w2"), F.nullif(then, F.lit("")).alias("w3")))


def _valid(kind: int, m: Column, cut: Column) -> Column:
    """What the expression of a kind can't tell."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == 2:
        return m.rlike(IP)
    if kind == 3:
        return F.when(n.between(16, 19), _luhn(digits)).otherwise(False)
    if kind == 4:
        return n.between(8, 15)
    # A run that ends within a token is none; a token that is an address or has an e-mail in it is never free.
    return ~cut if kind == 6 else ~(m.rlike(IP) | m.rlike(EXPRESSIONS[0])) if kind == 5 else F.lit(True)


def matched(docs: DataFrame) -> DataFrame:
    """rid, doc_id, found: all matches of a text with the characters before each (since the last of its kind); those that pass
    their kind's test are ``ok`` and have a context."""
    kinds = list(zip(range(1, 7), (*EXPRESSIONS, TOKEN, RUN), (*SIGNS, None, None), strict=True))
    df = docs.withColumn("rid", F.monotonically_increasing_id())
    df = df.withColumns({f"m{k}": _found(F.col("text"), k, e, s)[0] for k, e, s in kinds})
    df = df.withColumns({f"g{k}": F.when(F.size(f"m{k}") > 0, F.split("text", e, -1)) for k, e, _ in kinds})
    none = F.lit(None).cast("struct<w1:string,w2:string,w3:string>")

    def rows(k: int) -> Column:
        matches, gaps = F.col(f"m{k}"), F.col(f"g{k}")

        def sides(i: Column, most: int) -> Column:
            """The text before and after match ``i``, through ``most`` matches beside it."""
            low = F.greatest(i - most, F.lit(0))
            had = F.zip_with(F.slice(gaps, low + 1, i - low), F.slice(matches, low + 1, i - low), lambda g, x: F.concat(g, x))
            on = F.zip_with(F.slice(matches, i + 2, F.lit(most)), F.slice(gaps, i + 3, F.lit(most)), lambda x, g: F.concat(F.coalesce(x, F.lit("")), F.coalesce(g, F.lit(""))))
            return F.struct(F.concat(F.array_join(had, ""), F.get(gaps, i)).alias("before"), F.concat(F.get(gaps, i + 1), F.array_join(on, "")).alias("after"))

        def words(i: Column) -> Column:
            gap, after = F.get(gaps, i), F.get(gaps, i + 1)
            long = lambda c: F.length(c) > CONTEXT_CHARS
            # Where the gaps are short, the context goes on through the matches beside them, few of them if they suffice.
            far = _let(sides(i, NEAR), lambda x: F.when((long(x["before"]) | (i <= NEAR)) & (long(x["after"]) | (i + 1 + NEAR >= F.size(matches))), x).otherwise(sides(i, BACK)))
            return _let(F.when(long(gap) & long(after), F.struct(gap.alias("before"), after.alias("after"))).otherwise(far), lambda x: _context(x["before"], x["after"]))

        def one(m: Column, i: Column) -> Column:
            ok = _valid(k, m, F.get(gaps, i + 1).rlike(r"^\S"))
            fact = lambda x: F.struct(F.lit(k).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("skip"), m.alias("m"), x["w1"].alias("w1"), x["w2"].alias("w2"), x["w3"].alias("w3"), x.isNotNull().alias("ok"))
            return _let(F.when(ok, words(i)).otherwise(none), fact)

        return F.transform(matches, one)

    return df.select("rid", "doc_id", F.concat(*(rows(k) for k, _, _ in kinds)).alias("found"))


def _luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, less 9 from 10 on; the sum ends in 0."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def placed(found: DataFrame) -> DataFrame:
    """rid, kind, start, end, m, w1, w2, w3: a row per match that passes its kind's test, and per token or run (kind 5)."""
    rows = found.where(F.size("found") > 0).select("rid", F.explode("found").alias("f")).select("rid", "f.*")
    upto = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("skip") + F.length("m")).over(upto)).withColumn("start", F.col("end") - F.length("m"))
    return rows.where("ok").select("rid", F.least("kind", F.lit(5)).alias("kind"), "start", "end", "m", "w1", "w2", "w3")


def _free_tokens(spans: DataFrame) -> DataFrame:
    """Tokens (kind 5) that no base span touches: in order of start, the furthest end of base spans is not beyond the token's
    start, and the next base span does not start before its end."""
    order = Window.partitionBy("rid").orderBy("start", "kind")
    # A frame that only grows is summed up once; one that shrinks would be summed anew for every row.
    back = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    base_end = F.max(F.when(F.col("kind") < 5, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    base_next = F.min(F.when(F.col("kind") < 5, F.col("start"))).over(back)
    marked = spans.withColumn("before", base_end).withColumn("next", base_next)
    return marked.where((F.col("kind") == 5) & (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))).drop("before", "next")


def _fits(kind: Column, m: Column) -> Column:
    """A discovered token has what its kind can't be without."""
    n = F.length(F.regexp_replace(m, "[^0-9]", ""))
    return F.when(kind == 1, m.contains("@")).when(kind == 2, (n >= 4) & (F.length(F.regexp_replace(m, "[^.:]", "")) >= 2)).when(kind == 3, n >= 12).when(kind == 4, n >= 7).otherwise(False)


def edges_of(instances: DataFrame) -> DataFrame:
    """pattern, kind, instance: which words stand next to which instances, each once."""
    sides = F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("words")) for side in ("w1", "w2", "w3")))
    edges = instances.select("kind", F.lower("m").alias("instance"), F.explode(sides).alias("p")).where("p.words is not null")
    return edges.groupBy(F.concat_ws(":", "p.side", "p.words").alias("pattern"), "kind", "instance").agg(F.count(F.lit(1)).alias("n"))


def sure_instances(edges: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT, sure: float = SURE, rounds: int = ROUNDS) -> DataFrame | None:
    """instance, of: open instances (kind 5) that are sure of a kind, by the largest score, then the first kind; None if there is none."""
    #: Patterns that enough different seeds support, per kind; others can't be confident in any round.
    seeds = edges.where("kind < 5").groupBy("pattern", F.col("kind").alias("of")).agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= support)
    # What seeds add to a pattern's trust is the same in every round; open instances are the part that moves.
    counts = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    fixed = common.saved(seeds.join(counts, "pattern"), "pii-seeds")
    graph = common.saved(edges.where("kind = 5").select("pattern", "instance").join(fixed.select("pattern", "of"), "pattern"), "pii-graph")
    trust = lambda more: ((F.col("seeds") + more) / (F.col("n") + F.lit(PRIOR))).alias("trust")
    patterns, scores, seen = fixed.select("pattern", "of", trust(F.lit(0.0))), None, None
    for _ in range(rounds):
        patterns = common.saved(patterns.where(F.col("trust") >= confident), "pii-patterns")
        now = patterns.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("pattern", "of")).alias("which")).first()
        if now.n == 0:
            return None
        if now == seen:
            break
        seen = now
        pointed = graph.join(patterns, ["pattern", "of"])
        scores = common.saved(pointed.groupBy("instance", "of").agg((1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999)))))).alias("score")), "pii-scores")
        more = graph.join(scores, ["instance", "of"]).groupBy("pattern", "of").agg(F.sum("score").alias("more"))
        patterns = fixed.join(more, ["pattern", "of"], "left").select("pattern", "of", trust(F.coalesce("more", F.lit(0.0))))
    best = scores.where(F.col("score") >= sure)
    return None if best.isEmpty() else best.groupBy("instance").agg(F.max_by("of", F.struct("score", -F.col("of"))).alias("of"))


def discovered(spans: DataFrame, **bootstrap) -> DataFrame | None:
    """rid, kind, start, end of tokens that confident patterns point at; None if there is none."""
    tokens = _free_tokens(spans)
    edges = common.saved(edges_of(spans.where("kind < 5").unionByName(tokens)), "pii-edges")
    best = sure_instances(edges, **bootstrap)
    if best is None:
        return None
    hits = tokens.join(best, F.lower(tokens["m"]) == best["instance"]).where(_fits(F.col("of"), F.col("m")))
    trimmed_left = F.length("m") - F.length(F.regexp_replace("m", r"^[\"'(\[<{=:,;]+", ""))
    trimmed_right = F.length("m") - F.length(F.regexp_replace("m", r"[\"')\]>},;:.!?]+$", ""))
    out = hits.select("rid", F.col("of").alias("kind"), (F.col("start") + trimmed_left).alias("start"), (F.col("end") - trimmed_right).alias("end")).where("start < end")
    sooner = F.max("end").over(Window.partitionBy("rid").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("sooner", sooner).where("sooner is null or sooner < end").drop("sooner")


def joined_spans(spans: DataFrame, name: str) -> DataFrame:
    """rid, and the spans of a row as text, by kind and start."""
    item = F.struct("kind", "start", "end")
    text = F.transform(F.array_sort(F.collect_list(item)), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    counts = [F.count_if(F.col("kind") == k + 1).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return spans.groupBy("rid").agg(F.array_join(text, ",").alias(name), *counts)


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bootstrap) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base, spans (both as text), a row per row of ``docs``."""
    found = common.saved(matched(common.id_text(docs, id_col, text_col)), "pii-found")
    spans = common.saved(placed(found), "pii-spans")
    base = spans.where("kind < 5").select("rid", "kind", "start", "end")
    more = discovered(spans, **bootstrap)
    out = found.select("rid", "doc_id").join(joined_spans(base, "base"), "rid", "left")
    if more is None:
        out = out.withColumn("spans", F.col("base"))
    else:
        out = out.join(joined_spans(base.unionByName(more), "spans").select("rid", "spans"), "rid", "left")
    zero = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *zero, F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans_of(common.documents(spark, sf_dir))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
