"""Operators on sets of records: scans, exclusion, sessions, curricula, splits, samples, metrics.

The queries stand on the driver's tables: ``events`` in the order of event_id is a stream of move evaluations (value: score,
user_id: shard, event_type: side and end of game), ``orders`` and ``lineitem`` are puzzles and questions, ``labels`` are gold
and predicted classes, ``conversations`` are chats. All randomness is a hash of the key, so results repeat at any partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.plans.registry import register
from plyforge.sources import jsonl
from plyforge.streaming.logs import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on(name: str, key: str, oracle: str):
    """Register ``fn(df)`` over table ``name`` as query ``key``."""

    def put(fn):
        register(key, oracle)(lambda spark, sf_dir: fn(table(spark, sf_dir, name)))
        return fn

    return put


def bucket(key: Column, salt: str, n: int) -> Column:
    """A number below n that depends on the key alone."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{salt}"))), 1, 8), 16, 10).cast("long") % n


def sql_bucket(key: str, salt: str, n: int) -> str:
    return f"('0x' || substr(md5({key} || ':{salt}'), 1, 8))::BIGINT % {n}"


def text_key() -> Column:
    """The digest that stands for column ``text``; null for null."""
    return F.unhex(F.sha2("text", 256))


# -- scans --

#: Positions of a scan at most.
MOST_FENS, TAIL_FENS = 120, 40


@register("s01_first_seen_scan", jsonl.oracle("FROM lines", MOST_FENS))
def first_seen(spark, sf_dir):
    """The first positions of files of JSON lines, in their order, with the score of the record that has each first."""
    return jsonl.numbered(jsonl.first_seen(spark, jsonl.written(spark, sf_dir, shared_dir(spark)), MOST_FENS))


_REST = "sum(strlen(value) + 1) OVER (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING)"


@register("s02_tail_scan", jsonl.oracle(f"SELECT * FROM (SELECT *, {_REST} AS rest FROM lines) WHERE rest < {TAIL_FENS * jsonl.LINE_BYTES * jsonl.TAIL}", TAIL_FENS))
def tail_scan(spark, sf_dir):
    """The same of the files' tail."""
    return jsonl.numbered(jsonl.last_seen(spark, jsonl.written(spark, sf_dir, shared_dir(spark)), TAIL_FENS))


@on("events", "s03_predicate_scan", "SELECT event_id FROM events WHERE value > 90 AND user_id NOT IN (SELECT user_id FROM events WHERE value < 0.5) ORDER BY event_id LIMIT 100")
def predicate_scan(df):
    excluded = df.where("value < 0.5").select("user_id").distinct()
    return df.where("value > 90").join(excluded, "user_id", "left_anti").select("event_id").orderBy("event_id").limit(100)


@on("events", "s04_stride_shard", "SELECT event_id % 4 AS shard, event_type, min(event_id) AS ord FROM events GROUP BY 1, 2")
def stride_shard(df):
    return df.groupBy((F.col("event_id") % 4).alias("shard"), "event_type").agg(F.min("event_id").alias("ord"))


@register("s06_multi_source", "SELECT 0 AS source_ord, count(*) AS n FROM (SELECT DISTINCT text FROM benchmark) UNION ALL SELECT 1, count(*) FROM (SELECT DISTINCT text FROM documents WHERE text NOT IN (SELECT text FROM benchmark))")
def multi_source(spark, sf_dir):
    """Texts by the first source that has them; texts are compared by a digest of 256 bits, so that no text is shuffled."""
    both = table(spark, sf_dir, "benchmark").select(F.lit(0).alias("source_ord"), text_key().alias("key")).unionByName(table(spark, sf_dir, "documents").select(F.lit(1).alias("source_ord"), text_key().alias("key")))
    return both.groupBy("key").agg(F.min("source_ord").alias("source_ord")).groupBy("source_ord").agg(F.count(F.lit(1)).alias("n"))


@on("events", "s08_resumable_stride", "SELECT event_id, user_id FROM events WHERE event_id >= 300 AND event_id % 6 = 2")
def resumable(df, resume=300, stride=6, slot=2):
    return df.where((F.col("event_id") >= resume) & (F.pmod("event_id", F.lit(stride)) == slot)).select("event_id", "user_id")


_PGN = "CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN 'no game' ELSE '[Event \"' || o_orderkey || '\"] 1. e4 *' END"


@on("orders", "s10_archives_newest_first", f"SELECT o_custkey, month, o_orderkey FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY month DESC) AS age FROM (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y/%m') AS month, {_PGN} AS pgn FROM orders)) WHERE age <= 3 AND pgn LIKE '[Event%'")
def archives(df, months=3):
    """Games of each player's last ``months`` monthly archives; games whose PGN is empty or can't be read are passed over."""
    games = df.select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy/MM").alias("month"), F.expr(_PGN).alias("pgn"))
    # The archives are few a player (one a month); the games stay a row each.
    listed = games.select("o_custkey", "month").distinct().withColumn("age", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("month")))).where(F.col("age") <= months)
    return games.where(F.col("pgn").startswith("[Event")).join(listed, ["o_custkey", "month"], "left_semi").select("o_custkey", "month", "o_orderkey")


@on("events", "s11_cache_last_wins", "SELECT user_id AS key, arg_max(event_type, event_id) AS comment FROM events WHERE event_type <> '' GROUP BY user_id")
def last_wins(df):
    return df.where("event_type <> ''").groupBy(F.col("user_id").alias("key")).agg(F.max_by("event_type", "event_id").alias("comment"))


@on("events", "s12_pair_cache", "SELECT user_id || '_' || event_type AS key, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def pair_cache(df):
    return df.groupBy(F.concat_ws("_", F.col("user_id").cast("string"), "event_type").alias("key")).agg(F.max_by("value", "event_id").alias("value"))


@on("events", "s15_deepest_per_line", "SELECT user_id, event_id % 3 + 1 AS multipv, arg_max(value, (event_id // 3 % 20) * 1000000 - event_id) AS score FROM events GROUP BY 1, 2")
def deepest(df):
    """The deepest line of each multipv; of equal depths the first."""
    depth = F.expr("(event_id div 3 % 20) * 1000000 - event_id")
    return df.groupBy("user_id", (F.col("event_id") % 3 + 1).alias("multipv")).agg(F.max_by("value", depth).alias("score"))


@on("events", "s18_group_by_step", "SELECT event_id // 100 AS step, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1")
def by_step(df):
    return df.groupBy(F.expr("event_id div 100").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@on("events", "s19_newest_first", "SELECT event_id, ts FROM events ORDER BY event_id DESC")
def newest(df):
    return df.select("event_id", "ts").orderBy(F.desc("event_id"))


@register("s20_benchmark_configs", "SELECT 'bench' AS config, item_id AS task_id FROM benchmark UNION ALL SELECT 'pages', page_id FROM pages ORDER BY task_id, config")
def configs(spark, sf_dir):
    """The configurations as one table, in the order of task ids."""
    both = table(spark, sf_dir, "benchmark").select(F.lit("bench").alias("config"), F.col("item_id").alias("task_id")).unionByName(table(spark, sf_dir, "pages").select(F.lit("pages").alias("config"), F.col("page_id").alias("task_id")))
    return both.orderBy("task_id", "config")


@on("part", "s21_theme_sample", f"SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), 'STEEL') ORDER BY {sql_bucket('p_partkey', 'mate', 1 << 30)}, p_partkey LIMIT 40")
def theme_sample(df):
    return df.where(F.array_contains(F.split("p_type", " "), "STEEL")).orderBy(bucket(F.col("p_partkey"), "mate", 1 << 30), "p_partkey").limit(40).select("p_partkey")


@on("conversations", "s22_first_turns", "SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS question, arg_min(text, turn) FILTER (role = 'assistant') AS answer FROM conversations GROUP BY conv_id")
def first_turns(df):
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    return df.groupBy("conv_id").agg(first("user").alias("question"), first("assistant").alias("answer"))


@on("conversations", "s23_chat_records", "SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS messages FROM conversations GROUP BY conv_id HAVING count(*) > 0")
def chat_records(df):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n"))))
    return df.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda m: F.concat(m["role"], F.lit(":"), m["n"].cast("string"))), "|").alias("messages"))


# -- filters and projections --


@on("part", "f01_range_filter", "SELECT p_partkey FROM part WHERE coalesce(p_size, 0) BETWEEN 10 AND 30 AND coalesce(p_retailprice, 0) >= 1000")
def range_filter(df):
    return df.where(F.coalesce("p_size", F.lit(0)).between(10, 30) & (F.coalesce("p_retailprice", F.lit(0.0)) >= 1000)).select("p_partkey")


@on("events", "f02_ply_window", "SELECT event_id, ply FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ply FROM events) WHERE ply BETWEEN 4 AND 12")
def ply_window(df):
    return df.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("ply")).where("ply between 4 and 12")


@on("events", "f03_terminal_rows", "SELECT event_id FROM (SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NOT NULL")
def not_after_terminal(df):
    return df.withColumn("before", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))).where("before is not null").select("event_id")


@on("part", "f05_theme_member", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), 'BRASS')")
def theme_member(df):
    return df.where(F.array_contains(F.split("p_type", " "), "BRASS")).select("p_partkey")


@on("documents", "f07_required_fields", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND text <> '' AND len(string_split(text, ' ')) > 3 AND lang IS NOT NULL")
def required(df):
    return df.where("text is not null and text <> '' and size(split(text, ' ')) > 3 and lang is not null").select("doc_id")


@on("events", "f08_task_filter", "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def task_filter(df):
    return df.where(F.col("event_type").isin("click", "view")).select("event_id")


@register("f10_require_comment", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def require_comment(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("quality is not null"), "doc_id").select("doc_id", "quality")


@on("conversations", "f11_non_empty", "SELECT conv_id, turn FROM conversations WHERE text <> '' AND role <> ''")
def non_empty(df):
    return df.where("text <> '' and role <> ''").select("conv_id", "turn")


@on("conversations", "f13_strip_think", r"SELECT conv_id, turn, regexp_replace('<think>' || role || '</think>' || text, '(?s)<think>.*?</think>', '', 'g') AS text FROM conversations WHERE role = 'assistant'")
def strip_think(df):
    wrapped = F.concat(F.lit("<think>"), "role", F.lit("</think>"), "text")
    return df.where("role = 'assistant'").select("conv_id", "turn", F.regexp_replace(wrapped, r"(?s)<think>.*?</think>", "").alias("text"))


@on("conversations", "f14_drop_last_assistant", "SELECT conv_id, turn FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE NOT (turn = last AND role = 'assistant')")
def drop_last_assistant(df):
    return df.withColumn("last", F.max("turn").over(Window.partitionBy("conv_id"))).where("not (turn = last and role = 'assistant')").select("conv_id", "turn")


@on("conversations", "f15_replace_system", "SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'You are a chess coach.' ELSE text END AS text FROM conversations")
def replace_system(df):
    return df.select("conv_id", "turn", F.when(F.col("role") == "system", "You are a chess coach.").otherwise(F.col("text")).alias("text"))


@on("documents", "f16_needs_marker", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(License|rights)')")
def needs_marker(df):
    return df.where(F.col("text").rlike("(License|rights)")).select("doc_id")


# -- joins and exclusion --


@register("j01_contamination_guard", "SELECT doc_id FROM (SELECT min(doc_id) AS doc_id, text FROM documents WHERE text NOT IN (SELECT text FROM benchmark) GROUP BY text) ORDER BY doc_id LIMIT 200")
def contamination_guard(spark, sf_dir):
    seen = table(spark, sf_dir, "benchmark").select(text_key().alias("key"))
    return table(spark, sf_dir, "documents").select("doc_id", text_key().alias("key")).join(seen, "key", "left_anti").groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id").orderBy("doc_id").limit(200)


@register("j02_metadata_lookup", "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def metadata_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@register("j03_hashed_key_join", "SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON md5('llm19:' || c.c_custkey || ':' || c.c_nationkey % 5) = md5('llm19:' || o.o_custkey || ':' || 3)")
def hashed_key_join(spark, sf_dir):
    key = lambda a, b: F.md5(F.concat_ws(":", F.lit("llm19"), a.cast("string"), b.cast("string")))
    left = table(spark, sf_dir, "customer").select("c_custkey", key(F.col("c_custkey"), F.col("c_nationkey") % 5).alias("k"))
    return left.join(table(spark, sf_dir, "orders").select("o_orderkey", key(F.col("o_custkey"), F.lit(3)).alias("k")), "k").select("c_custkey", "o_orderkey")


@register("j04_concat_key_join", "SELECT s.s_suppkey, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey || '_x' = n.n_nationkey || '_x'")
def concat_key_join(spark, sf_dir):
    key = lambda c: F.concat_ws("_", F.col(c).cast("string"), F.lit("x"))
    return table(spark, sf_dir, "supplier").withColumn("k", key("s_nationkey")).join(table(spark, sf_dir, "nation").withColumn("k", key("n_nationkey")), "k").select("s_suppkey", "n_name")


#: Pools in their order: a key that has an event with a value below the bound may go there.
POOLS = {"rare": 0.5, "low": 5.0, "middle": 20.0, "wide": 60.0}
#: Keys with an event of this value or more are in the base set, which no pool takes from; keys of a pool at most.
BASE, CAP = 250.0, 15


def chained(keys: DataFrame, key: str, pools: list[str], cap: int) -> DataFrame:
    """(key, pool): each pool takes, in the order of its column (null: not fit), the first ``cap`` keys that no pool before it took.

    A round a pool: a key that a full pool turns away stands in line for the next. What is taken is at most ``cap`` rows a pool,
    which makes it fit to be broadcast.
    """
    taken = None
    for name in pools:
        fit = keys.where(F.col(name).isNotNull())
        left = fit if taken is None else fit.join(F.broadcast(taken.select(key)), key, "left_anti")
        # The first rows of an order: every task keeps as many, and no more, before they meet.
        mine = left.orderBy(name, key).limit(cap).select(key, F.lit(name).alias("pool"))
        taken = mine if taken is None else taken.unionByName(mine)
    return taken


_FIT = ", ".join(f"min(event_id) FILTER (value < {bound}) AS {name}" for name, bound in POOLS.items())
_BEFORE = lambda name: "".join(f" AND user_id NOT IN (SELECT user_id FROM pool_{b})" for b in list(POOLS)[: list(POOLS).index(name)])


@on("events", "j05_chained_pools", f"WITH keys AS (SELECT user_id, {_FIT} FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING coalesce(max(value), 0) < {BASE}), " + ", ".join(f"pool_{n} AS (SELECT user_id, '{n}' AS pool FROM keys WHERE {n} IS NOT NULL{_BEFORE(n)} ORDER BY {n}, user_id LIMIT {CAP})" for n in POOLS) + " " + " UNION ALL ".join(f"FROM pool_{n}" for n in POOLS))
def chained_pools(df):
    """Users in pools by the first event that fits each, those of the base set left out."""
    fits = [F.min(F.when(F.col("value") < bound, F.col("event_id"))).alias(name) for name, bound in POOLS.items()]
    keys = df.where("user_id is not null").groupBy("user_id").agg(*fits, F.coalesce(F.max("value"), F.lit(0.0)).alias("most")).where(F.col("most") < BASE)
    return chained(keys, "user_id", list(POOLS), CAP)


@on("events", "j06_row_pairs", "SELECT event_id, lead(event_id) OVER w AS next_id, lead(value) OVER w - value AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def row_pairs(df):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return df.select("event_id", F.lead("event_id").over(w).alias("next_id"), (F.lead("value").over(w) - F.col("value")).alias("delta"))


@on("lineitem", "j07_first_match", "SELECT l_orderkey, min(l_linenumber) FILTER (l_returnflag = 'R') AS line FROM lineitem GROUP BY l_orderkey")
def first_match(df):
    return df.groupBy("l_orderkey").agg(F.min(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("line"))


@on("labels", "j09_verdicts", "SELECT doc_id, quality = toxic AS verdict FROM labels")
def verdicts(df):
    return df.select("doc_id", (F.col("quality") == F.col("toxic")).alias("verdict"))


# -- aggregation --


@on("events", "a01_count_per_task", f"""
WITH tasks(task) AS (VALUES ('click'), ('view'), ('purchase'), ('none_such')), splits(split) AS (VALUES ('train'), ('eval')),
n AS (SELECT event_type AS task, CASE WHEN {sql_bucket('event_id', 'split', 100)} < 5 THEN 'eval' ELSE 'train' END AS split, count(*) AS n FROM events GROUP BY 1, 2)
SELECT task, split, coalesce(n, 0) AS n FROM tasks CROSS JOIN splits LEFT JOIN n USING (task, split)""")
def count_per_task(df):
    spark = df.sparkSession
    cells = spark.createDataFrame([(t, s) for t in ("click", "view", "purchase", "none_such") for s in ("train", "eval")], "task string, split string")
    n = df.groupBy(F.col("event_type").alias("task"), F.when(bucket(F.col("event_id"), "split", 100) < 5, "eval").otherwise("train").alias("split")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(n, ["task", "split"], "left").select("task", "split", F.coalesce("n", F.lit(0)).alias("n"))


@on("events", "a02_task_share", "SELECT event_type, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS percent FROM events GROUP BY event_type")
def task_share(df):
    n = df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


ROLLED = "FROM labels JOIN documents USING (doc_id)"


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id").withColumn("exact", (F.col("quality") == 1).cast("int"))


@register("a03_accuracy_rollup", f"SELECT lang AS task_group, avg(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS accuracy, count(*) AS n {ROLLED} GROUP BY ROLLUP (lang)")
def accuracy_rollup(spark, sf_dir):
    return _labelled(spark, sf_dir).rollup("lang").agg(F.avg("exact").alias("accuracy"), F.count(F.lit(1)).alias("n")).withColumnRenamed("lang", "task_group")


@register("a04_accuracy_tiers", f"SELECT lang, source, avg(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS accuracy {ROLLED} GROUP BY GROUPING SETS ((lang, source), (source), ())")
def accuracy_tiers(spark, sf_dir):
    return _labelled(spark, sf_dir).groupingSets([["lang", "source"], ["source"], []], "lang", "source").agg(F.avg("exact").alias("accuracy"))


@on("documents", "a05_tokens_truncated", "SELECT lang, avg(n_chars) AS mean_tokens, count(*) FILTER (n_chars >= 0.98 * 4000) AS truncated FROM documents GROUP BY lang")
def tokens_truncated(df, most=4000):
    return df.groupBy("lang").agg(F.avg("n_chars").alias("mean_tokens"), F.count_if(F.col("n_chars") >= 0.98 * most).alias("truncated"))


@on("events", "a06_rollout_summary", "SELECT event_id // 64 AS step, count(*) FILTER (value >= 80) AS correct, count(*) FILTER (value < 80 AND event_type <> 'view') AS wrong, count(*) FILTER (event_type = 'view' AND value < 80) AS no_format, avg(value) AS reward FROM events GROUP BY 1")
def rollout_summary(df):
    good = F.col("value") >= 80
    return df.groupBy(F.expr("event_id div 64").alias("step")).agg(F.count_if(good).alias("correct"), F.count_if(~good & (F.col("event_type") != "view")).alias("wrong"), F.count_if(~good & (F.col("event_type") == "view")).alias("no_format"), F.avg("value").alias("reward"))


@on("events", "a07_best_worst", """
SELECT step, best, CASE WHEN worst <> best THEN worst END AS worst FROM (
  SELECT event_id // 64 AS step, (array_agg(event_id ORDER BY value DESC, event_id))[1] AS best, (array_agg(event_id ORDER BY value, event_id))[1] AS worst FROM events WHERE value IS NOT NULL GROUP BY 1)""")
def best_worst(df):
    rows = df.where("value is not null").groupBy(F.expr("event_id div 64").alias("step"))
    rows = rows.agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"), F.min_by("event_id", F.struct("value", "event_id")).alias("worst"))
    return rows.withColumn("worst", F.when(F.col("worst") != F.col("best"), F.col("worst")))


@on("lineitem", "a08_histogram", "SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(df):
    return df.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@on("lineitem", "a09_mean_line_score", "SELECT l_orderkey, avg(2.0 * (l_quantity / 50.0) - 1) AS score FROM lineitem GROUP BY 1")
def mean_line_score(df):
    return df.groupBy("l_orderkey").agg(F.avg(2.0 * (F.col("l_quantity") / 50.0) - 1).alias("score"))


@on("events", "a10_weighted_mean", """
WITH w AS (SELECT event_id, [CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 2 END] AS x FROM events)
SELECT event_id, CASE WHEN x[1] IS NULL AND x[2] IS NULL THEN 0 ELSE (coalesce(0.3 * x[1], 0) + coalesce(0.7 * x[2], 0)) / (CASE WHEN x[1] IS NULL THEN 0 ELSE 0.3 END + CASE WHEN x[2] IS NULL THEN 0 ELSE 0.7 END) END AS score FROM w""")
def weighted_mean(df):
    """Mean over the parts that are given, their weights renormalised; 0 if none is."""
    a, b = F.when(F.col("event_id") % 3 != 0, F.col("value")), F.when(F.col("event_id") % 5 != 0, F.col("value") / 2)
    total = F.coalesce(0.3 * a, F.lit(0.0)) + F.coalesce(0.7 * b, F.lit(0.0))
    weight = F.when(a.isNull(), 0.0).otherwise(0.3) + F.when(b.isNull(), 0.0).otherwise(0.7)
    return df.select("event_id", F.when(a.isNull() & b.isNull(), 0.0).otherwise(total / F.nullif(weight, F.lit(0.0))).alias("score"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> ''))"


@on("conversations", "a11_group_jaccard", f"""
WITH s AS (SELECT conv_id, turn // 4 AS part, turn, {_WORDS} AS t FROM conversations)
SELECT a.conv_id, a.part, sum(CASE WHEN len(a.t) + len(b.t) = 0 THEN 1000000000 ELSE round(1e9 * (len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t)))))::BIGINT END)::DOUBLE / count(*) / 1e9 AS jaccard
FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.part = b.part AND a.turn < b.turn GROUP BY 1, 2""")
def group_jaccard(df, size=4):
    """Mean pairwise Jaccard of the words of the ``size`` completions of a group; groups of one have none."""
    sets = df.select("conv_id", F.expr(f"turn div {size}").alias("part"), F.struct("turn", words(F.col("text")).alias("t")).alias("x"))
    groups = sets.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("x")).alias("xs")).where(F.size("xs") > 1)
    return groups.select("conv_id", "part", mean_jaccard(F.transform("xs", lambda x: x["t"])).alias("jaccard"))


def words(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def mean_jaccard(sets: Column) -> Column:
    """Of an array of sets of words, two at least: the mean over all pairs; two empty sets are alike."""
    # Summed in whole billionths, so that the order of the sum does not show.
    part = lambda a, b: F.when(F.size(a) + F.size(b) == 0, F.lit(1000000000).cast("long")).otherwise(F.round(F.lit(1e9) * (F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))).cast("long"))
    total = F.aggregate(F.transform(sets, lambda a, i: F.aggregate(F.slice(sets, i + 2, F.size(sets)), F.lit(0).cast("long"), lambda acc, b: acc + part(a, b))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return total.cast("double") / (F.size(sets) * (F.size(sets) - 1) / 2) / 1e9


@on("lineitem", "a12_spread", "SELECT l_orderkey, CASE WHEN count(*) < 2 THEN 0 ELSE max(l_quantity) - min(l_quantity) END AS spread FROM lineitem GROUP BY 1")
def spread(df):
    return df.groupBy("l_orderkey").agg(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.max("l_quantity") - F.min("l_quantity")).alias("spread"))


@on("labels", "a13_confusion", "SELECT quality, toxic, count(*) AS n, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY quality) AS share FROM labels GROUP BY 1, 2")
def confusion(df):
    n = df.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("quality")))


@on("embeddings", "a14_class_weights", "WITH c AS (SELECT label, 1.0 / greatest(count(*), 1) AS w FROM embeddings GROUP BY 1) SELECT label, w / avg(w) OVER () AS weight FROM c")
def class_weights(df):
    w = df.groupBy("label").agg((1.0 / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("w"))
    return w.select("label", (F.col("w") / F.avg("w").over(Window.partitionBy(F.lit(0)))).alias("weight"))


@on("nation", "a15_grouped_lists", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def grouped_lists(df):
    return df.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@on("lineitem", "a16_side_sums", "SELECT l_orderkey, sum(CASE l_returnflag WHEN 'R' THEN 5 WHEN 'A' THEN 3 ELSE 1 END)::BIGINT AS material FROM lineitem GROUP BY 1")
def side_sums(df):
    return df.groupBy("l_orderkey").agg(F.sum(F.expr("CASE l_returnflag WHEN 'R' THEN 5 WHEN 'A' THEN 3 ELSE 1 END")).alias("material"))


#: Vectors of a batch.
BATCH = 2048


@on("embeddings", "a17_top1_retrieval", f"""
WITH e AS (SELECT vec_id, vec_id // {BATCH} AS batch, label, embedding FROM embeddings),
s AS (SELECT a.vec_id, b.label = a.label AS same, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rn FROM e a JOIN e b ON a.batch = b.batch AND a.vec_id <> b.vec_id)
SELECT avg(CASE WHEN same THEN 1.0 ELSE 0.0 END) AS top1, count(*) AS n FROM s WHERE rn = 1""")
def top1_retrieval(df):
    """Share of vectors whose nearest neighbour in their batch has the same label."""
    best = nearest(df.withColumn("batch", F.expr(f"vec_id div {BATCH}")), "batch")
    return best.agg(F.avg((F.col("label") == F.col("o_label")).cast("double")).alias("top1"), F.count(F.lit(1)).alias("n"))


#: Columns of a block of the matrix of similarities, of which a batch holds one at a time.
BLOCK = 512


def nearest(df: DataFrame, batch: str) -> DataFrame:
    """vec_id, label, o_id, o_label: of each vector the other one of its batch with the largest cosine (to 9 places; then the least id).

    A batch is as large as a model's batch, a few thousand rows at most. It is multiplied block by block, and each row keeps
    the best that it has met, so that no pair becomes a row. A vector without another one has no row.
    """

    def of_batch(table):
        import numpy as np
        import pyarrow as pa

        ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        order = np.argsort(ids, kind="stable")
        x = np.array(table.column("e").to_pylist(), dtype=np.float64)[order]
        ids, labels = ids[order], labels[order]
        with np.errstate(invalid="ignore", divide="ignore"):
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
        best, at = np.full(len(x), -np.inf), np.zeros(len(x), np.int64)
        for start in range(0, len(x), BLOCK):
            block = np.nan_to_num(np.round(x @ x[start : start + BLOCK].T, 9), nan=-2.0)
            own = np.arange(start, min(start + BLOCK, len(x)))
            block[own, own - start] = -np.inf
            here = block.argmax(1)
            value = block[np.arange(len(x)), here]
            better = value > best
            best[better], at[better] = value[better], start + here[better]
        found = best > -np.inf
        return pa.table({"vec_id": ids[found], "label": labels[found], "o_id": ids[at[found]], "o_label": labels[at[found]]})

    rows = df.where("embedding is not null and vec_id is not null and label is not null").select("vec_id", batch, F.col("label").cast("int").alias("label"), F.expr("transform(embedding, x -> cast(x as double))").alias("e"))
    return rows.groupBy(batch).applyInArrow(of_batch, "vec_id long, label int, o_id long, o_label int")


_TOKENS = "list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w)::INTEGER)"


@on("conversations", "a18_masked_accuracy", f"""
SELECT conv_id, turn, len(list_filter(range(2, n + 1), lambda i: i % 3 <> 0 AND (i + turn) % 4 <> 0))::DOUBLE / greatest(len(list_filter(range(2, n + 1), lambda i: i % 3 <> 0)), 1) AS accuracy FROM (SELECT conv_id, turn, len({_TOKENS}) AS n FROM conversations)""")
def masked_accuracy(df):
    """Of tokens, labels (a third of them masked by -100) and predictions (a quarter of them wrong), the accuracy of each turn."""
    ids = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w))
    labels = F.transform(ids, lambda x, i: F.when((i + 1) % 3 == 0, -100).otherwise(x))
    # What is predicted at a place is the token after it.
    predicted = F.transform(ids, lambda x, i: F.when((i + 2 + F.col("turn")) % 4 == 0, -1).otherwise(F.coalesce(F.get(ids, i + 1), F.lit(-2))))
    return df.select("conv_id", "turn", token_accuracy(predicted, labels).alias("accuracy"))


def token_accuracy(predicted: Column, labels: Column) -> Column:
    """The share of places whose prediction is the next label, of those where the next label is not masked; 0 of none."""
    n = F.size(labels) - 1
    pairs = F.zip_with(F.slice(predicted, 1, F.greatest(n, F.lit(0))), F.slice(labels, 2, F.greatest(n, F.lit(0))), lambda p, l: F.struct(p.alias("p"), l.alias("l")))
    seen = F.filter(pairs, lambda x: x["l"] != -100)
    return F.size(F.filter(seen, lambda x: x["p"] == x["l"])) / F.greatest(F.size(seen), F.lit(1))


@on("labels", "a19_lift", "SELECT avg(quality) FILTER (toxic = 1) - avg(quality) FILTER (toxic = 0) AS lift FROM labels")
def lift(df):
    return df.agg((F.avg(F.when(F.col("toxic") == 1, F.col("quality"))) - F.avg(F.when(F.col("toxic") == 0, F.col("quality")))).alias("lift"))


@on("labels", "a20_claim_counts", "SELECT count(*) FILTER (quality = 1) AS verified, count(*) FILTER (quality = 0) AS failed FROM labels")
def claim_counts(df):
    return df.agg(F.count_if(F.col("quality") == 1).alias("verified"), F.count_if(F.col("quality") == 0).alias("failed"))


@on("conversations", "a21_distinct_moves", "SELECT conv_id, turn, len(list_distinct(regexp_extract_all(text, '[a-h][a-h]'))) >= 2 AS enough FROM conversations")
def distinct_moves(df):
    return df.select("conv_id", "turn", (F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-h][a-h]"), F.lit(0)))) >= 2).alias("enough"))


# -- ordered operators --

GAMES = "SELECT *, CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w = event_type THEN 1 ELSE 0 END AS boundary FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"


def boundaries(df):
    """A game starts where the side does not flip; shards (user_id) are independent streams."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return df.withColumn("boundary", F.when(before.isNull() | (before == F.col("event_type")), 1).otherwise(0))


def games(df):
    return boundaries(df).withColumn("game", F.sum("boundary").over(Window.partitionBy("user_id").orderBy("event_id")))


@on("events", "w01_boundary_flag", f"SELECT event_id, boundary FROM ({GAMES})")
def boundary_flag(df):
    return boundaries(df).select("event_id", "boundary")


@on("events", "w02_sessions", f"SELECT event_id, sum(boundary) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS game FROM ({GAMES})")
def sessions(df):
    return games(df).select("event_id", "game")


@on("events", "w03_ply_counter", f"SELECT event_id, row_number() OVER (PARTITION BY user_id, game ORDER BY event_id) - CASE WHEN game = 1 THEN 0 ELSE 1 END AS ply FROM (SELECT *, sum(boundary) OVER (PARTITION BY user_id ORDER BY event_id) AS game FROM ({GAMES}))")
def ply_counter(df):
    """Plies of the first game of a shard count from 1, of later games from 0."""
    rn = F.row_number().over(Window.partitionBy("user_id", "game").orderBy("event_id"))
    return games(df).select("event_id", (rn - F.when(F.col("game") == 1, 0).otherwise(1)).alias("ply"))


@on("events", "w04_scaled_delta", """
SELECT event_id, round(tanh(greatest(-2000, least(2000, CASE WHEN event_id % 2 = 0 THEN nxt - value ELSE value - nxt END * 10)) / 600), 6) AS label
FROM (SELECT *, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) WHERE nxt IS NOT NULL""")
def scaled_delta(df):
    """Change of the score for the mover, clamped to 2000 and squashed by tanh(x / 600)."""
    nxt = F.lead("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = df.withColumn("nxt", nxt).where("nxt is not null")
    diff = F.when(F.col("event_id") % 2 == 0, F.col("nxt") - F.col("value")).otherwise(F.col("value") - F.col("nxt")) * 10
    return rows.select("event_id", F.round(F.tanh(F.greatest(F.lit(-2000.0), F.least(F.lit(2000.0), diff)) / 600), 6).alias("label"))


@on("events", "w05_static_interleave", "SELECT event_id, rn // 4 > (rn - 1) // 4 AS static FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)")
def static_interleave(df, period=4):
    """After every ``period``-th row of a shard a static row is due."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return df.withColumn("rn", rn).select("event_id", F.expr(f"rn div {period} > (rn - 1) div {period}").alias("static"))


@on("events", "w06_limit_with_static", """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
both_ AS (SELECT user_id, event_id, rn, 0 AS static FROM r UNION ALL SELECT user_id, event_id, rn, 1 FROM r WHERE rn % 4 = 0)
SELECT user_id, event_id, static FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn, static) AS k FROM both_) WHERE k <= 7""")
def limit_with_static(df, period=4, limit=7):
    rows = df.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("rn"))
    kinds = F.when(F.col("rn") % period == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    both = rows.withColumn("static", F.explode(kinds))
    return both.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("rn", "static"))).where(F.col("k") <= limit).select("user_id", "event_id", "static")


@on("documents", "w07_first_n", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 20")
def first_n(df, n=20):
    return df.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where(F.col("rn") <= n).select("lang", "doc_id")


@on("events", "w08_best_per_step", "SELECT step, event_id, rank() OVER (PARTITION BY step ORDER BY value DESC) AS place FROM (SELECT *, event_id // 64 AS step FROM events)")
def best_per_step(df):
    rows = df.withColumn("step", F.expr("event_id div 64"))
    return rows.select("step", "event_id", F.rank().over(Window.partitionBy("step").orderBy(F.desc("value"))).alias("place"))


@on("lineitem", "w09_chained_diff", "SELECT l_orderkey, l_linenumber, round(l_quantity - lag(l_quantity, 1, 0) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity), 2) AS diff FROM lineitem")
def chained_diff(df):
    before = F.lag("l_quantity", 1, 0.0).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_quantity"))
    return df.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") - before, 2).alias("diff"))


@on("conversations", "w10_char_budget", "SELECT conv_id, turn FROM (SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM conversations) WHERE used < 600")
def char_budget(df, budget=600):
    """Turns are taken until the budget is reached; the last one may go over."""
    used = F.sum(F.length("text") + 1).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("used", F.coalesce(used, F.lit(0))).where(F.col("used") < budget).select("conv_id", "turn")


@on("lineitem", "w12_adaptive_breadth", """
WITH s AS (SELECT l_orderkey, 10 * (max(l_quantity) - min(l_quantity)) AS spread FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN spread >= 200 THEN 6 WHEN spread >= 100 THEN 6 WHEN spread >= 50 THEN 5 ELSE 4 END AS depth, CASE WHEN spread >= 200 THEN 5 WHEN spread >= 100 THEN 4 WHEN spread >= 50 THEN 3 ELSE 2 END AS breadth FROM s""")
def adaptive_breadth(df):
    s = df.groupBy("l_orderkey").agg((10 * (F.max("l_quantity") - F.min("l_quantity"))).alias("s"))
    step = lambda *v: F.when(F.col("s") >= 200, v[0]).when(F.col("s") >= 100, v[1]).when(F.col("s") >= 50, v[2]).otherwise(v[3])
    return s.select("l_orderkey", step(6, 6, 5, 4).alias("depth"), step(5, 4, 3, 2).alias("breadth"))


# -- order, samples, splits --


@on("lineitem", "l01_curriculum_sort", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem ORDER BY l_linenumber, l_quantity, l_extendedprice, l_orderkey")
def curriculum_sort(df):
    """All rows by (moves, depth, rating), ties by key: a range-partitioned sort."""
    return df.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").orderBy("l_linenumber", "l_quantity", "l_extendedprice", "l_orderkey")


@on("events", "l08_bernoulli_split", f"""
WITH n AS (SELECT count(*) AS n FROM events)
SELECT event_id, {sql_bucket('event_id', 'bern', 1000000)} < 1000000 * least(0.5, greatest(0.001, 300.0 / (n + 300))) AS is_eval FROM events, n""")
def bernoulli_split(df, target=300):
    n = df.agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(0.5), F.greatest(F.lit(0.001), F.lit(float(target)) / (F.col("n") + target)))
    return df.select("event_id").join(F.broadcast(n)).select("event_id", (bucket(F.col("event_id"), "bern", 1_000_000) < 1_000_000 * share).alias("is_eval"))  # one row


def ranked(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with rn, the row number within the group, and n, the group's size, for groups of any size.

    Rows are dealt by range and written, so that each part knows its own; a part's row numbers start after the rows of the
    same group in the parts before it. No group meets in one task; the counts have a row per part and group.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    dealt = df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    dealt.write.parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)
    counts = rows.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_at"), before.alias("_before"), F.sum("_n").over(group).alias("n"))
    local = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.col("_part") == F.col("_at"))
    return local.join(offsets, same).select(*df.columns, (F.col("_rn") + F.col("_before")).alias("rn"), "n")


def by_draw(df: DataFrame, key: str, salt: str, by: list[str]) -> DataFrame:
    """``ranked`` in the order of a hash of the key."""
    return ranked(df.withColumn("draw", bucket(F.col(key), salt, 1 << 30)), by, ["draw", key])


@on("supplier", "l07_shuffle", f"SELECT s_suppkey, {sql_bucket('s_suppkey', 'shuf', 1 << 30)} AS draw FROM supplier ORDER BY draw, s_suppkey")
def shuffled(df):
    """All rows in the order of a hash of their key: a range-partitioned sort, no row numbers."""
    return df.select("s_suppkey", bucket(F.col("s_suppkey"), "shuf", 1 << 30).alias("draw")).orderBy("draw", "s_suppkey")


@on("documents", "l09_head_split", f"SELECT lang, doc_id, rn <= greatest(1, cast(floor(n * 0.1) AS INTEGER)) AS is_eval FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {sql_bucket('doc_id', 'head', 1 << 30)}, doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)")
def head_split(df, share=0.1):
    rows = by_draw(df.select("lang", "doc_id"), "doc_id", "head", ["lang"])
    return rows.select("lang", "doc_id", (F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * share))).alias("is_eval"))


@on("benchmark", "l10_fixed_eval", f"SELECT item_id, rn <= 10 AS is_eval FROM (SELECT item_id, row_number() OVER (ORDER BY {sql_bucket('item_id', 'fix', 1 << 30)}, item_id) AS rn FROM benchmark)")
def fixed_eval(df, n=10):
    """The first ``n`` by hash are the eval set; a top-n of n rows, which the rest is compared with."""
    top = df.select("item_id").orderBy(bucket(F.col("item_id"), "fix", 1 << 30), "item_id").limit(n).withColumn("is_eval", F.lit(True))
    return df.select("item_id").join(F.broadcast(top), "item_id", "left").select("item_id", F.coalesce("is_eval", F.lit(False)).alias("is_eval"))


@on("documents", "l11_stratified_eval", f"""
WITH r AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS nb, count(*) OVER () AS n, row_number() OVER (PARTITION BY lang ORDER BY {sql_bucket('doc_id', 'strat', 1 << 30)}, doc_id) AS rn FROM documents)
SELECT doc_id, lang FROM r WHERE rn <= greatest(1, round_even(100.0 * nb / n, 0))""")
def stratified_eval(df, size=100):
    rows = by_draw(df.select("doc_id", "lang"), "doc_id", "strat", ["lang"])
    total = df.agg(F.count(F.lit(1)).alias("total"))
    quota = F.greatest(F.lit(1), F.bround(float(size) * F.col("n") / F.col("total"), 0))
    return rows.join(F.broadcast(total)).where(F.col("rn") <= quota).select("doc_id", "lang")  # one row


@on("labels", "l12_none_trimming", f"""
WITH r AS (SELECT doc_id, quality, toxic, count(*) FILTER (toxic = 1) OVER (PARTITION BY quality) AS pos, row_number() OVER (PARTITION BY quality, toxic ORDER BY {sql_bucket('doc_id', 'none', 1 << 30)}, doc_id) AS rn FROM labels)
SELECT doc_id, quality, toxic FROM r WHERE toxic = 1 OR rn <= cast(floor(pos * 0.3 / 0.7) AS INTEGER)""")
def none_trimming(df):
    """All positives of a task, and at most 3 negatives for 7 of them."""
    rows = by_draw(df, "doc_id", "none", ["quality", "toxic"])
    positives = df.where("toxic = 1").groupBy(F.col("quality").alias("of")).agg(F.count(F.lit(1)).alias("pos"))
    rows = rows.join(positives, F.col("quality").eqNullSafe(F.col("of")), "left")
    return rows.where((F.col("toxic") == 1) | (F.col("rn") <= F.floor(F.coalesce("pos", F.lit(0)) * 0.3 / 0.7))).select("doc_id", "quality", "toxic")


@on("documents", "l13_stride_sample", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE rn % greatest(1, n // 8) = 0 AND rn // greatest(1, n // 8) < 8")
def stride_sample(df, k=8):
    rows = ranked(df.select("lang", "doc_id"), ["lang"], ["doc_id"])
    return rows.where(F.expr(f"(rn - 1) % greatest(1, n div {k}) = 0 and (rn - 1) div greatest(1, n div {k}) < {k}")).select("lang", "doc_id")


@on("events", "l14_rank_shard", "SELECT event_id FROM events WHERE event_id % 8 = 3")
def rank_shard(df, rank=3, world=8):
    return df.where(F.pmod("event_id", F.lit(world)) == rank).select("event_id")


@on("region", "l15_worker_quota", "SELECT r_regionkey, 1003 // 5 + CASE WHEN r_regionkey < 1003 % 5 THEN 1 ELSE 0 END AS quota FROM region")
def worker_quota(df, total=1003, workers=5):
    return df.select("r_regionkey", F.expr(f"{total} div {workers} + case when r_regionkey < {total} % {workers} then 1 else 0 end").alias("quota"))


@on("region", "l16_active_tasks", "SELECT r_name, r_regionkey AS weight FROM region WHERE r_regionkey > 0")
def active_tasks(df):
    return df.where("r_regionkey > 0").select("r_name", F.col("r_regionkey").alias("weight"))


@on("orders", "l17_task_pool", f"SELECT o_orderkey, CASE WHEN {sql_bucket('o_orderkey', 'pool', 100)} < 85 THEN 'medium' ELSE 'easy' END AS pool, {sql_bucket('o_orderkey', 'task', 12)} AS task FROM orders")
def task_pool(df):
    key = F.col("o_orderkey")
    return df.select("o_orderkey", F.when(bucket(key, "pool", 100) < 85, "medium").otherwise("easy").alias("pool"), bucket(key, "task", 12).alias("task"))


@on("labels", "l18_negative_sampling", f"SELECT doc_id FROM labels WHERE toxic = 1 OR {sql_bucket('doc_id', 'skip', 100)} >= 80")
def negative_sampling(df, skip=80):
    return df.where((F.col("toxic") == 1) | (bucket(F.col("doc_id"), "skip", 100) >= skip)).select("doc_id")


# -- sets --


@register("u01_exclude_union", "SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def exclude_union(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@register("u02_combined", "SELECT 'easy' AS tier, item_id AS id FROM benchmark UNION ALL SELECT 'medium', vec_id FROM embeddings")
def combined(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.lit("easy").alias("tier"), F.col("item_id").alias("id")).unionAll(table(spark, sf_dir, "embeddings").select(F.lit("medium"), "vec_id"))


@on("part", "u03_set_equality", "SELECT p_partkey, list_sort(list_distinct(string_split(p_type, ' '))) = list_sort(list_distinct(string_split(p_type || ' ' || p_type, ' '))) AS same FROM part")
def set_equality(df):
    canon = lambda c: F.array_sort(F.array_distinct(F.split(c, " ")))
    return df.select("p_partkey", (canon(F.col("p_type")) == canon(F.concat_ws(" ", "p_type", "p_type"))).alias("same"))


@on("part", "u04_jaccard", "SELECT p_partkey, len(list_intersect(list_distinct(string_split(p_name, ' ')), list_distinct(string_split(p_type, ' '))))::DOUBLE / len(list_distinct(list_concat(string_split(p_name, ' '), string_split(p_type, ' ')))) AS jaccard FROM part")
def jaccard(df):
    a, b = F.split("p_name", " "), F.split("p_type", " ")
    return df.select("p_partkey", (F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).alias("jaccard"))


@on("benchmark", "u05_line_credit", "SELECT item_id, len(list_intersect(string_split(text, chr(10)), string_split(left(text, 80), chr(10))))::DOUBLE / len(list_distinct(string_split(text, chr(10)))) AS credit FROM benchmark")
def line_credit(df):
    a, b = F.split("text", "\n"), F.split(F.left("text", F.lit(80)), "\n")
    return df.select("item_id", (F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a))).alias("credit"))


@register("u06_train_rest", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def train_rest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
