"""Operators over token ids: windows with the boards that lie whole in them, labels of replies, padding of batches.

All of them are functions of arrays, so a row a text, and nothing is shuffled but the lengths of batches. ``pieces`` cuts a text into
special tokens, runs of letters and digits, and single other characters, which make up the text again; ``ids_of`` numbers them by a
hash, special tokens by their fixed numbers. Ids of any other tokenizer do as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge.operators.records import on, table
from plyforge.plans.registry import register

#: Special tokens and their ids, and the mark of what is not learnt (fixed values).
SPECIAL = {"<|im_start|>": 151644, "<|im_end|>": 151645, "<|vision_pad|>": 151654}
BOARD, IGNORED = "<|vision_pad|>", -100
PIECE = r"(?s)<\|[a-z_]+\|>|[A-Za-z0-9]+|[^A-Za-z0-9]"
#: Ids of other pieces lie below this.
VOCABULARY = 151_643


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def id_of(piece: Column) -> Column:
    out = (F.conv(F.substring(F.md5(piece), 1, 8), 16, 10).cast("long") % VOCABULARY).cast("int")
    for name, number in SPECIAL.items():
        out = F.when(piece == name, number).otherwise(out)
    return out


def ids_of(text: Column) -> Column:
    return F.transform(pieces(text), id_of)


SQL_ID = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SPECIAL.items()) + f" ELSE ('0x' || substr(md5({{0}}), 1, 8))::BIGINT % {VOCABULARY} END"

# -- windows of tokens, with boards --


def places(values: Column, of) -> Column:
    """Places (from 0) of the values for which ``of(value)`` holds, ascending."""
    return F.filter(F.transform(values, lambda x, i: F.when(of(x), i)), lambda i: i.isNotNull())


def windows(tokens: Column, marks: Column, fens: Column, size: int, overlap: int, marks_a_board: int) -> Column:
    """Windows of ``size`` tokens, each ``size - overlap`` after the last, as (start, tokens, fens).

    ``marks`` are the places of board marks, ``marks_a_board`` of which stand for one of ``fens``, in order. A window has as many boards
    as whole ones fit its marks, from the first that the marks before it leave; one that is cut off counts nowhere. A text that fits one window
    is one, with all its boards. The first window that reaches beyond the end is the last one.
    """
    n, step = F.size(tokens), size - overlap
    # A window begins at k * step if the one before it ended within the text, and it begins before its end.
    last = F.least(F.floor((n - 1) / step), F.greatest(F.floor((n - size) / step) + 1, F.lit(0))).cast("int")

    def window(k: Column) -> Column:
        start = k * step
        before = F.size(F.filter(marks, lambda p: p < start))
        within = F.size(F.filter(marks, lambda p: (p >= start) & (p < start + size)))
        whole = F.floor(within / marks_a_board).cast("int")
        return F.struct(start.alias("start"), F.slice(tokens, start + 1, F.lit(size)).alias("tokens"), F.slice(fens, (F.floor(before / marks_a_board) + 1).cast("int"), whole).alias("fens"))

    one = F.array(F.struct(F.lit(0).alias("start"), tokens.alias("tokens"), fens.alias("fens")))
    return F.when(n == 0, F.array().cast("array<struct<start:int,tokens:array<string>,fens:array<string>>>")).when(n <= size, one).otherwise(F.transform(F.sequence(F.lit(0), last), window))


WINDOW, OVERLAP, MARKS = 256, 32, 65
# Of the sentences of a text, every third is followed by a board: its marks, which stand for position <n>.
_BOARD = f"{BOARD * MARKS}"
_SQL_BOARDS = f"list_transform(string_split(text, '. '), lambda s, i: s || CASE WHEN i = len(string_split(text, '. ')) THEN '' WHEN i % 3 = 0 THEN '. {_BOARD}' ELSE '. ' END)"


@register("w11_token_windows", rf"""
WITH texts AS (SELECT doc_id, array_to_string({_SQL_BOARDS}, '') AS t, list_transform(range(1, (len(string_split(text, '. ')) - 1) // 3 + 1), lambda k: 'position ' || k) AS fens FROM documents),
tokens AS (SELECT doc_id, regexp_extract_all(t, '{PIECE}') AS ts, fens FROM texts),
rows_ AS (SELECT doc_id, unnest(ts) AS x, generate_subscripts(ts, 1) - 1 AS pos, len(ts) AS n FROM tokens),
summed AS (SELECT *, sum((x = '{BOARD}')::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - (x = '{BOARD}')::INTEGER AS before FROM rows_),
starts AS (
  SELECT doc_id, s AS start, n FROM (SELECT DISTINCT doc_id, n FROM rows_), LATERAL (SELECT unnest(range(0, n, {WINDOW - OVERLAP})) AS s)
  WHERE s = 0 OR s - {WINDOW - OVERLAP} + {WINDOW} <= n AND n > {WINDOW}),
made AS (
  SELECT s.doc_id, s.start, any_value(s.n) AS n, string_agg(r.x, '' ORDER BY r.pos) AS text, count(*) AS n_tokens, min(r.before) AS before, count(*) FILTER (r.x = '{BOARD}') AS within
  FROM starts s JOIN summed r ON r.doc_id = s.doc_id AND r.pos >= s.start AND r.pos < s.start + {WINDOW} GROUP BY s.doc_id, s.start)
SELECT doc_id, start::INTEGER AS start, n_tokens::INTEGER AS n_tokens, md5(text) AS text_md5,
  array_to_string(CASE WHEN n <= {WINDOW} THEN fens ELSE fens[(before // {MARKS} + 1)::BIGINT : (before // {MARKS} + within // {MARKS})::BIGINT] END, ',') AS fens
FROM made JOIN tokens USING (doc_id) WHERE n <= {WINDOW} OR trim(text, E' \t\n\r\f' || chr(11)) <> ''""")  # fmt: skip
def token_windows(spark, sf_dir):
    """Windows of a text with boards, those of blanks alone left out."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    # Cutting takes far longer over a text than a shuffle of it: a table in fewer splits than cores is dealt out first.
    cores = spark.sparkContext.defaultParallelism
    docs = docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs
    docs = docs.select("doc_id", F.split("text", r"\. ", -1).alias("s"))
    n = F.size("s")
    said = F.transform("s", lambda s, i: F.concat(s, F.when(i + 1 == n, "").when((i + 1) % 3 == 0, f". {_BOARD}").otherwise(". ")))
    fens = F.transform(F.slice(F.sequence(F.lit(0), n), 2, F.floor((n - 1) / 3).cast("int")), lambda k: F.concat(F.lit("position "), k.cast("string")))
    rows = docs.select("doc_id", pieces(F.array_join(said, "")).alias("tokens"), fens.alias("fens")).withColumn("marks", places(F.col("tokens"), lambda x: x == BOARD))
    # Windows are cut out before they become rows, so that no row carries the whole text.
    made = rows.select("doc_id", (F.size("tokens") <= WINDOW).alias("one"), F.explode(windows(F.col("tokens"), F.col("marks"), F.col("fens"), WINDOW, OVERLAP, MARKS)).alias("w"))
    text = F.array_join("w.tokens", "")
    return made.where(F.col("one") | text.rlike(r"[^ \t-\r]")).select("doc_id", "w.start", F.size("w.tokens").alias("n_tokens"), F.md5(text).alias("text_md5"), F.array_join("w.fens", ",").alias("fens"))


# -- labels of replies --


def reply_spans(ids: Column, template: Column, end: int) -> Column:
    """(first, last) of what follows each occurrence of the ids ``template``, up to the next end mark or the end; disjoint, ascending."""
    n, length = F.size(ids), F.size(template)
    at = F.filter(F.transform(ids, lambda x, i: F.when((x == F.get(template, F.lit(0))) & (F.slice(ids, i + 1, length) == template), i)), lambda i: i.isNotNull())
    ends = places(ids, lambda x: x == end)

    def put(spans: Column, i: Column) -> Column:
        first = i + length
        stop = F.coalesce(F.get(F.filter(ends, lambda e: e >= first), F.lit(0)), n - 1)
        # A template inside a reply begins no other one.
        inside = F.coalesce(F.get(spans, F.size(spans) - 1)["last"] >= i, F.lit(False))
        return F.when(inside, spans).otherwise(F.concat(spans, F.array(F.struct(first.alias("first"), stop.alias("last")))))

    return F.aggregate(at, F.array().cast("array<struct<first:int,last:int>>"), put)


def reply_labels(ids: Column, spans: Column) -> Column:
    """The ids inside the spans, IGNORED elsewhere."""
    stop = lambda k: F.when(k == 0, -1).otherwise(F.get(spans, k - 1)["last"])
    none = lambda n: F.array_repeat(F.lit(IGNORED), n)
    parts = F.transform(spans, lambda s, k: F.concat(none(s["first"] - stop(k) - 1), F.slice(ids, s["first"] + 1, s["last"] - s["first"] + 1)))
    return F.concat(F.flatten(parts), none(F.size(ids) - 1 - stop(F.size(spans))))


TURNS = 4
_CHAT = "'<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10)"


@register("x13_reply_labels", f"""
WITH chats AS (SELECT conv_id, turn, string_agg({_CHAT}, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {TURNS - 1} PRECEDING AND CURRENT ROW) AS t FROM conversations),
tokens AS (SELECT conv_id, turn, list_transform(regexp_extract_all(t, '{PIECE}'), lambda x: {SQL_ID.format('x')}) AS ids FROM chats),
rows_ AS (SELECT conv_id, turn, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM tokens),
marked AS (
  SELECT *, lag(id, 1) OVER w = {SQL_ID.format("'assistant'")} AND lag(id, 2) OVER w = {SPECIAL['<|im_start|>']} AND id = {SQL_ID.format('chr(10)')} AS head, id = {SPECIAL['<|im_end|>']} AS tail
  FROM rows_ WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)),
held AS (
  SELECT *, max(CASE WHEN head THEN pos END) OVER w AS begun, max(CASE WHEN tail THEN pos END) OVER w AS ended
  FROM marked WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, list(CASE WHEN begun > coalesce(ended, 0) THEN id ELSE {IGNORED} END ORDER BY pos)::INTEGER[] AS labels FROM held GROUP BY conv_id, turn""")  # fmt: skip
def reply_label_rows(spark, sf_dir):
    """Of each turn with the few before it, as the chat template writes them, the labels by search of the template's ids."""
    said = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1 - TURNS, 0)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.collect_list(said).over(before), "").alias("t")).select("conv_id", "turn", ids_of(F.col("t")).alias("ids"))
    rows = rows.withColumn("spans", reply_spans(F.col("ids"), ids_of(F.lit("<|im_start|>assistant\n")), SPECIAL["<|im_end|>"]))
    return rows.select("conv_id", "turn", reply_labels(F.col("ids"), F.col("spans")).alias("labels"))


# -- padding --


def padded(df: DataFrame, batch: str, ids: str = "ids", pad: int = 0, **others: int) -> DataFrame:
    """``df`` with ``ids`` and the arrays named in ``others`` filled up to the longest of each batch, and a column ``mask``.

    Lengths alone are summed up, before they are shuffled; a batch of any number of rows is one row of theirs.
    """
    longest = df.groupBy(F.col(batch).alias("_batch")).agg(F.max(F.size(ids)).alias("_most"))
    rows = df.join(longest, F.col(batch).eqNullSafe(F.col("_batch")))
    fill = lambda c, x: F.concat(c, F.array_repeat(F.lit(x), F.col("_most") - F.size(c)))
    mask = fill(F.transform(ids, lambda _: F.lit(1)), 0)
    return rows.withColumns({"mask": mask, ids: fill(F.col(ids), pad)} | {c: fill(F.col(c), x) for c, x in others.items()}).drop("_batch", "_most")


@on("conversations", "x12_pad_mask", f"""
WITH coded AS (SELECT conv_id, turn, conv_id // 8 AS batch, list_transform(regexp_extract_all(coalesce(text, ''), '{PIECE}'), lambda x: {SQL_ID.format('x')}) AS ids FROM conversations),
sized AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS most FROM coded)
SELECT conv_id, turn, list_transform(range(0, most), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END)::INTEGER[] AS mask,
  md5(array_to_string(list_transform(range(0, most), lambda i: CASE WHEN i < len(ids) THEN ids[i + 1] ELSE 0 END), ' ')) AS ids_md5,
  list_transform(range(0, most), lambda i: CASE WHEN i < len(ids) AND i > 0 THEN ids[i + 1] ELSE {IGNORED} END)::INTEGER[] AS labels FROM sized""")  # fmt: skip
def pad_mask(df):
    """Batches of eight conversations, filled up to their longest turn; the first token of a turn is not learnt."""
    rows = df.select("conv_id", "turn", F.expr("conv_id div 8").alias("batch"), ids_of(F.coalesce("text", F.lit(""))).alias("ids"))
    rows = rows.withColumn("labels", F.transform("ids", lambda x, i: F.when(i > 0, x).otherwise(IGNORED)))
    out = padded(rows, "batch", labels=IGNORED)
    return out.select("conv_id", "turn", "mask", F.md5(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_md5"), "labels")
