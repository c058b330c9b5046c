"""Structured Streaming over logs and event streams; each query runs what is there to its end (availableNow) and stops.

Statistics of steps are partial aggregates of each batch in a table, which is compacted as it grows and put together when it is
read, so a row counts however late it comes. Duplicates and event-time windows forget by a watermark: a row that comes later than that is
dropped, or taken for new. Pairs and splitters keep one small row a shard or conversation. Checkpoints lie in the shared folder, and a query
that is started again goes on where its checkpoint stands.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plyforge.plans.registry import register

#: Files of a micro-batch where a shard's rows of a batch are sorted in memory.
FILES = 64
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
TURNS = "conv_id long, turn long, role string, text string"


def shared_dir(spark: SparkSession) -> str:
    """A new folder in that of spark.checkpoint.dir; without the setting one of this machine, which only a local session may use."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines see")
        found = tempfile.mkdtemp(prefix="plyforge-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/streams/{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf_dir: str, name: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A pattern, because the source takes a plain path for a folder, and a table may be a single file.
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")


def appended(df: DataFrame, path: str | None = None) -> DataFrame:
    """Run an append-mode stream to the end of its input; a path given again goes on from its checkpoint."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def updated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Run an aggregation in update mode to the end of its input; the last row of each key.

    Each batch lies in a folder of its own number, so that a batch that runs again replaces itself.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    schema = df.withColumn("batch_", F.lit(0).cast("long")).schema
    spark.createDataFrame([], schema).write.parquet(f"{path}/out/empty")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/out/{number:09d}")

    df.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in df.columns if c not in keys]
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/out")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_").alias("last_")).select(*keys, "last_.*")


def timed(df: DataFrame, late: str = "1 day") -> DataFrame:
    """``df`` with ``ts`` as event time; rows that come later than ``late`` are not waited for."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


@register("t01_follow_log", "SELECT DISTINCT event_id // 64 AS step FROM events")
def follow_log(spark, sf_dir):
    """Every step of a growing log once; a step is remembered as long as its lines may still come, a day of event time."""
    steps = timed(stream(spark, sf_dir, "events", EVENTS)).select("ts", F.expr("event_id div 64").alias("step")).dropDuplicatesWithinWatermark(["step"])
    return appended(steps.select("step"))


#: Batches whose partial aggregates lie apart before they become one table.
COMPACT = 8


class Partials:
    """Aggregates of a stream without state in Spark: a table of partial ones a batch, compacted every COMPACT batches.

    ``parts`` make a batch's partial columns, ``merges`` put partial columns of the same name together. A batch that runs again
    replaces its own folder, and a compaction reads only folders that stay until it is whole, so an interrupted stream goes on right.
    """

    def __init__(self, spark: SparkSession, keys: list[str], parts: dict, merges: dict, path: str | None = None, compact: int = COMPACT):
        self.spark, self.keys, self.parts, self.merges, self.compact = spark, keys, parts, merges, compact
        self.path, self.schema = path or shared_dir(spark), None

    def _folders(self) -> list[tuple[int, bool, str]]:
        """(batch, compacted, path) of the whole tables that count: the last compaction and what came after it, earlier ones last."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/parts")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        whole = lambda f: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))
        names = [(f.getPath().getName(), f.getPath()) for f in fs.listStatus(at)]
        return sorted((int(n.split("-")[1]), n.startswith("all"), f.toString()) for n, f in names if n[:4] in ("all-", "one-") and whole(f))

    def _living(self, upto: int | None = None, but: int | None = None) -> tuple[list[str], list[str]]:
        """Paths to read, and paths that a compaction (not that of batch ``but``) has taken the place of."""
        found = [f for f in self._folders() if (upto is None or f[0] <= upto) and f[:2] != (but, True)]
        last = max((n for n, all_, _ in found if all_), default=-1)
        live = [p for n, all_, p in found if (n == last and all_) or (n > last and not all_)]
        return live, [p for _, _, p in found if p not in live]

    def _merged(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths).groupBy(*self.keys).agg(*(c.alias(n) for n, c in self.merges.items()))

    def take(self, batch: DataFrame, number: int) -> None:
        made = batch.groupBy(*self.keys).agg(*(c.alias(n) for n, c in self.parts.items()))
        self.schema = made.schema
        made.write.mode("overwrite").parquet(f"{self.path}/parts/one-{number:09d}")
        if number % self.compact == self.compact - 1:
            self._merged(self._living(number, but=number)[0]).write.mode("overwrite").parquet(f"{self.path}/parts/all-{number:09d}")
            # What the compaction before this one had taken in is of no more use.
            for old in self._living(number - self.compact)[1]:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(old)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def run(self, rows: DataFrame) -> DataFrame:
        """Take in all that is there, and the merged aggregates of all batches."""
        self.schema = rows.groupBy(*self.keys).agg(*(c.alias(n) for n, c in self.parts.items())).schema
        rows.writeStream.option("checkpointLocation", f"{self.path}/checkpoint").foreachBatch(self.take).trigger(availableNow=True).start().awaitTermination()
        live, _ = self._living()
        return self._merged(live) if live else self.spark.createDataFrame([], self.schema)


def steps(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    return stream(spark, sf_dir, "events", EVENTS, files).withColumn("step", F.expr("event_id div 64"))


@register("t02_step_count", "SELECT event_id // 64 AS step, count(*) AS n FROM events GROUP BY 1")
def step_count(spark, sf_dir):
    return Partials(spark, ["step"], {"n": F.count(F.lit(1))}, {"n": F.sum("n")}).run(steps(spark, sf_dir)).select("step", "n")


def step_rows(spark: SparkSession, sf_dir: str, files: int | None = None, compact: int = COMPACT) -> DataFrame:
    """step, n, judged, mean, best and worst (rows: event_id, event_type, value; the worst is null where it is the best).

    Of rows that tie, the one of the least event_id is the best, and the worst. Values are summed as decimals, so that the mean does not
    depend on the order in which a stream comes.
    """
    row = F.struct("event_id", "event_type", "value")
    # A value and, turned round, an id: null values make no row.
    up, down = F.when(F.col("value").isNotNull(), F.struct("value", -F.col("event_id"))), F.when(F.col("value").isNotNull(), F.struct("value", "event_id"))
    parts = {"n": F.count(F.lit(1)), "judged": F.count("value"), "total": F.sum(F.col("value").cast("decimal(18, 6)")), "best": F.max_by(row, up), "worst": F.min_by(row, down)}
    best = F.max_by("best", F.when(F.col("best").isNotNull(), F.struct("best.value", -F.col("best.event_id"))))
    worst = F.min_by("worst", F.when(F.col("worst").isNotNull(), F.struct("worst.value", "worst.event_id")))
    merges = {"n": F.sum("n"), "judged": F.sum("judged"), "total": F.sum("total").cast("decimal(28, 6)"), "best": best, "worst": worst}
    out = Partials(spark, ["step"], parts, merges, compact=compact).run(steps(spark, sf_dir, files))
    differs = F.col("worst.event_id") != F.col("best.event_id")
    return out.select("step", "n", "judged", (F.col("total").cast("double") / F.nullif("judged", F.lit(0))).alias("mean"), "best", F.when(differs, F.col("worst")).alias("worst"))


@register("t03_step_stats", """
SELECT step, count(*) AS n, count(value) AS judged, sum(value::DECIMAL(18, 6))::DOUBLE / nullif(count(value), 0) AS mean,
  any_value(event_id) FILTER (up = 1) AS best_id, any_value(event_type) FILTER (up = 1) AS best_type, max(value) AS best, CASE WHEN any_value(event_id) FILTER (down = 1) <> any_value(event_id) FILTER (up = 1) THEN any_value(event_id) FILTER (down = 1) END AS worst_id,
  CASE WHEN any_value(event_id) FILTER (down = 1) <> any_value(event_id) FILTER (up = 1) THEN min(value) END AS worst
FROM (SELECT *, event_id // 64 AS step, row_number() OVER (PARTITION BY event_id // 64 ORDER BY value DESC NULLS LAST, event_id) AS up, row_number() OVER (PARTITION BY event_id // 64 ORDER BY value NULLS LAST, event_id) AS down FROM events)
GROUP BY step""")
def step_stats(spark, sf_dir):
    """Best and worst rows of each step of a log."""
    return step_rows(spark, sf_dir).select("step", "n", "judged", "mean", F.col("best.event_id").alias("best_id"), F.col("best.event_type").alias("best_type"), F.col("best.value").alias("best"), F.col("worst.event_id").alias("worst_id"), F.col("worst.value").alias("worst"))


OPEN, CLOSE = "<think>", "</think>"


def split_chunks(chunks: list[str], thinking: bool, held: str) -> tuple[list[tuple[str, str]], bool, str]:
    """(events as (kind, text), whether inside of thinking, held back text that may begin a tag)."""
    out = []
    for chunk in chunks:
        text = held + chunk
        held = ""
        while text:
            tag = CLOSE if thinking else OPEN
            at = text.find(tag)
            if at >= 0:
                if at:
                    out.append(("think" if thinking else "token", text[:at]))
                text, thinking = text[at + len(tag) :], not thinking
                continue
            keep = max((k for k in range(1, len(tag)) if text.endswith(tag[:k])), default=0)
            if len(text) > keep:
                out.append(("think" if thinking else "token", text[: len(text) - keep]))
            held, text = text[len(text) - keep :] if keep else "", ""
    return out, thinking, held


def _split(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    thinking, held = state.get if state.exists else (False, "")
    rows = pd.concat(list(frames)).sort_values("turn")
    out, thinking, held = split_chunks([c for chunks in rows["chunks"] for c in chunks], thinking, held)
    state.update((thinking, held))
    yield pd.DataFrame({"conv_id": [key[0]] * len(out), "kind": [k for k, _ in out], "text": [t for _, t in out]})


@register("t04_think_splitter")
def think_splitter(spark, sf_dir):
    """Chunks of a reply, tags cut anywhere, to think and token events; the state of a conversation is a flag and a few letters.

    Every turn is a reply: the first half of its text is thought, the second said.
    """
    said = stream(spark, sf_dir, "conversations", TURNS, files_per_trigger=FILES)
    text, half = F.coalesce("text", F.lit("")), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    reply = F.concat(F.lit(OPEN), F.substring(text, F.lit(1), half), F.lit(CLOSE), F.substring(text, half + 1, F.length(text)))
    rows = said.select("conv_id", "turn", reply.alias("reply"), (5 + F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(60))).cast("int").alias("size"))
    chunks = rows.select("conv_id", "turn", F.transform(F.sequence(F.lit(1), F.length("reply"), F.col("size")), lambda i: F.substring("reply", i, F.col("size"))).alias("chunks"))
    return appended(chunks.groupBy("conv_id").applyInPandasWithState(_split, "conv_id long, kind string, text string", "thinking boolean, held string", "append", GroupStateTimeout.NoTimeout))


@register("t05_resumable_reader", "SELECT event_id FROM events WHERE event_id % 4 = 1")
def resumable_reader(spark, sf_dir):
    """A shard's reader, stopped and started again on the same checkpoint: nothing is read twice."""
    path = shared_dir(spark)
    rows = lambda: stream(spark, sf_dir, "events", EVENTS, files_per_trigger=1).where("event_id % 4 = 1").select("event_id")
    appended(rows(), path)
    return appended(rows(), path)


def _pairs(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before_id, before = state.get if state.exists else (None, None)
    rows = pd.concat(list(frames)).sort_values("event_id")
    out = []
    for event_id, value in zip(rows["event_id"].tolist(), rows["value"].tolist(), strict=True):
        if before_id is not None:
            out.append((before_id, event_id, value - before))
        before_id, before = event_id, value
    state.update((before_id, before))
    yield pd.DataFrame(out, columns=["event_id", "next_id", "delta"])


@register("t06_triple_stream", "SELECT event_id, next_id, delta FROM (SELECT event_id, lead(event_id) OVER w AS next_id, lead(value) OVER w - value AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE next_id IS NOT NULL")
def triple_stream(spark, sf_dir):
    """Each row of a shard with the next one; the state of a shard is its last row."""
    rows = stream(spark, sf_dir, "events", EVENTS, files_per_trigger=FILES).select("user_id", "event_id", "value")
    return appended(rows.groupBy("user_id").applyInPandasWithState(_pairs, "event_id long, next_id long, delta double", "event_id long, value double", "append", GroupStateTimeout.NoTimeout))


@register("t08_distinct_before_work", "SELECT DISTINCT event_type, upper(event_type) AS worked FROM events")
def distinct_before_work(spark, sf_dir):
    """Equal keys are dropped before the costly step, not after; one that comes again later than the watermark is dropped by the reader."""
    rows = timed(stream(spark, sf_dir, "events", EVENTS)).select("ts", "event_type").dropDuplicatesWithinWatermark(["event_type"])
    return appended(rows.select("event_type", F.upper("event_type").alias("worked"))).distinct()


@register("s05_stream_shards", "SELECT event_id, user_id FROM events WHERE user_id % 3 = 0")
def stream_shards(spark, sf_dir):
    return appended(stream(spark, sf_dir, "events", EVENTS).where("user_id % 3 = 0").select("event_id", "user_id"))


@register("k06_append_log", "SELECT event_id AS step, event_type AS predicted, value AS reward FROM events WHERE value > 50")
def append_log(spark, sf_dir):
    return appended(stream(spark, sf_dir, "events", EVENTS).where("value > 50").select(F.col("event_id").alias("step"), F.col("event_type").alias("predicted"), F.col("value").alias("reward")))


@register("ext_event_time_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_time_windows(spark, sf_dir):
    """An extension: tumbling windows by event time with a watermark."""
    rows = timed(stream(spark, sf_dir, "events", EVENTS), "2 hours")
    n = rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return updated(n, ["window", "event_type"]).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
