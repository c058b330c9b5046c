"""Interaction of filters: what each of five filters removes under every order in which they may be applied.

A direct relational replay. Every document has flags for its failures; the flags meet the 120 orders, which are broadcast, the
five steps of an order are exploded, the first failing step of a document says where it goes, and conditional sums by part,
order and step count it, combined on the map side. Documents of a part with the same flags and labels take the same way
through every order, so they are combined before they meet the orders and carry their number as a weight: the product has
rows by distinct (part, flags, labels), not by documents.

Filters, as failures (fixed values): A under 50 words, B fewer than 65 distinct words in 100, C more than 5 letters A-Z in 100
code points, D a character of ``#$%&*|``, E a text that also has a smaller doc_id. Texts are compared by SHA-256. A group of
equal texts is combined by part and labels before its rows meet, so that a group of any size is a few rows.

Handling of odd input: a null text counts as empty, a null part as the empty string; a row without a doc_id neither fails E nor
makes others fail, and has no labels; rows that share a doc_id do not precede each other; a doc_id with several labels has
quality or toxic if one of them says so, a null label says nothing; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.llm import common

FILTERS = "ABCDE"
#: Thresholds of the filters (fixed values of the contract).
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 50, 65, 5, "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def own_failures(text: Column) -> Column:
    """Bits of the filters that look at the text alone."""
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    fails = {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SIGNS),
    }
    return reduce(lambda a, b: a + b, (F.when(c, bit(k)).otherwise(0) for k, c in fails.items()))


def flags(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, mask (bits of failed filters), good, toxic, n: how many documents share them."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), own_failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("sha"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    alike = ["sha", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy(*alike, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = by_id.groupBy(*alike).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"))
    groups = common.saved(groups, "audit-groups")
    least = groups.groupBy("sha").agg(F.min("first.doc_id").alias("least"))
    firsts = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0) + F.col("nameless")
    split = groups.join(least, "sha").withColumn("firsts", firsts)
    both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("firsts").alias("n")), F.struct((F.col("mask") + bit("E")).alias("mask"), (F.col("n") - F.col("firsts")).alias("n"))))
    return split.select("part", "good", "toxic", both.alias("x")).where("x.n > 0").groupBy("part", F.col("x.mask").alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def orders(spark: SparkSession) -> DataFrame:
    """filter_order and the bits of its five steps: 120 rows."""
    rows = [("".join(p), [bit(x) for x in p]) for p in permutations(FILTERS)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>")


def replayed(counted: DataFrame) -> DataFrame:
    """The audit of ``flags``: a row per part, order and step."""
    spark = counted.sparkSession
    fails = lambda k: F.col("mask").bitwiseAND(F.col("bits")[k]) != 0
    first = F.coalesce(*(F.when(fails(k), k + 1) for k in range(len(FILTERS))), F.lit(len(FILTERS) + 1))
    met = counted.crossJoin(F.broadcast(orders(spark))).withColumn("first", first)
    steps = met.select("part", "mask", "good", "toxic", "n", "filter_order", "first", F.posexplode("bits").alias("at", "bit")).withColumn("step", F.col("at") + 1)
    here, failing = F.col("first") == F.col("step"), F.col("mask").bitwiseAND(F.col("bit")) != 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    sums = steps.groupBy("part", "filter_order", "step").agg(
        total(F.col("first") > F.col("step")).alias("kept"), total(here).alias("removed"), total(failing & (F.col("first") < F.col("step"))).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(here & F.col("good")).alias("good_lost"), total(here & F.col("toxic")).alias("toxic_lost"),
    )
    of_filter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return sums.withColumn("shapley", F.sum("removed").over(of_filter))


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return replayed(flags(docs, labels, part_col, id_col, text_col))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
words AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM texts),
failed AS (
  SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f FROM words),
rows_ AS (SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM failed LEFT JOIN marks USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i),
orders_ AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS ids
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, ids FROM orders_),
masks AS (SELECT part, f, good, toxic, count(*) AS n FROM rows_ GROUP BY ALL),
met AS (
  SELECT part, filter_order, step, n, good, toxic, f[ids[step]] AS failing,
    list_bool_or(list_transform(ids[1:step - 1], lambda i: f[i])) AS gone,
    f[ids[step]] AND len(list_filter(f, lambda x: x)) = 1 AS alone
  FROM masks, steps),
sums AS (
  SELECT part, filter_order, step,
    coalesce(sum(n) FILTER (NOT failing AND NOT coalesce(gone, false)), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (failing AND NOT coalesce(gone, false)), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (failing AND coalesce(gone, false)), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (failing AND NOT coalesce(gone, false) AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (failing AND NOT coalesce(gone, false) AND toxic), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY part, filter_order, step)
SELECT *, sum(removed) OVER (PARTITION BY part, substr(filter_order, step::INTEGER, 1))::BIGINT AS shapley FROM sums
"""
