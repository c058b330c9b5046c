"""What the operators of this package share: the folder all machines see, word hashes, a filter of fixed size."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: Bytes of a row group: a writer holds one in memory, and tables with texts are written by tasks that need it for their workers.
ROW_GROUP = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this machine only in a local session that names none (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines see")
        found = tempfile.mkdtemp(prefix="plyforge-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, whatever else the input has: ``doc_id`` as long and ``text``, null text as empty."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever its case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """The batch in runs of rows whose ``column`` holds about ``most`` bytes at a time, one row at least."""
    values = batch.column(column)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


_held: tuple[str, object] = ("", None)
_libc = ctypes.CDLL(None)
#: mallopt's number for the size from which an allocation is a mapping of its own, which goes back when it is freed.
_MMAP_THRESHOLD, _OWN_MAPPING = -3, 1 << 20


def release() -> None:
    """Give back what the allocators of this process hold free: workers live on between tasks, and idle ones shall be small."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.mallopt(_MMAP_THRESHOLD, _OWN_MAPPING)
        _libc.malloc_trim(0)


def task(operator: str, drop=None):
    """Decorates a function over batches. When a task of another operator begins in the worker process, what this one keeps
    from task to task is let go by ``drop``; free memory goes back before and after each task.
    """

    def wrap(run):
        @wraps(run)
        def inner(batches):
            _enter(operator, drop)
            try:
                yield from run(batches)
            finally:
                release()

        return inner

    return wrap


def _enter(operator: str, drop) -> None:
    global _held
    if _held[0] != operator:
        if _held[1] is not None:
            _held[1]()
            gc.collect()
        _held = (operator, drop)
    release()


class WordHashes:
    """64-bit hashes of words (bytes), remembered for up to ``most`` words."""

    def __init__(self, most: int = 300_000):
        self.most, self.known = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            digest = xxhash.xxh3_64_intdigest
            for w in set(words):
                if w not in known:
                    known[w] = digest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` word hashes, in order; of the whole sequence as one where it is shorter; none of no words."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out = mixed(out * M1 + words[i : len(words) - n + 1 + i])
    return mixed(out + np.uint64(n))


def scrambled(rows: np.ndarray) -> np.ndarray:
    """Numbers of rows for a key filter, which numbers of few different bits would crowd."""
    return mixed(rows.astype(np.uint64)).view(np.int64)


def with_found(docs: DataFrame, row: str, found: DataFrame) -> DataFrame:
    """``docs`` left joined by its number ``row`` to the column ``row`` of ``found``, a written table of a row per number.

    Rows that have nothing in ``found`` are told by a filter and are not shuffled.
    """
    (column,) = [f for f in found.schema.fields if f.name != "row"]

    @task("with_found")
    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(scrambled(batch.column("row").to_numpy()))], names=["key"])

    bits = min(30, max(16, (8 * found.count()).bit_length()))
    wanted = docs.sparkSession.sparkContext.broadcast(KeyFilter.of(found.select("row").mapInArrow(keys, "key long"), "key", bits))

    def chosen(want: bool):
        @task("with_found")
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(wanted.value.hits(scrambled(batch.column(row).to_numpy())) == want))

        return run

    maybe = docs.mapInArrow(chosen(True), docs.schema).join(found.select(F.col("row").alias(row), column.name), row, "left")
    return docs.mapInArrow(chosen(False), docs.schema).withColumn(column.name, F.lit(None).cast(column.dataType)).unionByName(maybe)


class KeyFilter:
    """A bit per hashed key in a table of fixed size (2**bits bits), so that it may be broadcast at any input size.

    It never misses a key that was put in. When keys crowd it, it lets more rows through and the exact join behind it
    does more work; the result stays the same.
    """

    def __init__(self, table: bytes, bits: int):
        self.table, self.bits = table, bits

    @staticmethod
    def of(keys: DataFrame, column: str, bits: int = 24) -> "KeyFilter":
        """From a long column (ids or hashes); one row per filled 64-bit word (2**(bits-6) at most) comes to the driver."""
        at = F.expr(f"(`{column}` ^ shiftrightunsigned(`{column}`, {bits}) ^ shiftrightunsigned(`{column}`, {2 * bits})) & {(1 << bits) - 1}L")
        words = keys.select(at.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask"))
        table = np.zeros(1 << (bits - 6), np.int64)
        got = words.toArrow()
        table[got.column("word").to_numpy()] = got.column("mask").to_numpy()
        return KeyFilter(table.view(np.uint8).tobytes(), bits)

    def hits(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        bit = (keys ^ (keys >> np.uint64(self.bits)) ^ (keys >> np.uint64(2 * self.bits))) & np.uint64((1 << self.bits) - 1)
        table = np.frombuffer(self.table, np.uint64)
        return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
