"""Benchmark decontamination with SimHash over item-sized windows and a multi-index of Hamming blocks.

For every benchmark item, each window of a document of as many words as the item (the whole document where it is shorter)
that holds a shingle of an item is fingerprinted: SimHash over its shingles of SHINGLE words, rolled over the windows by
running sums. (A window without any has similarity 0.) It is a candidate where its fingerprint lies within RADIUS bits of
the item's. A fingerprint of 128 bits is cut into BLOCKS blocks; within the radius, some block differs in at most
RADIUS // BLOCKS bits, so a table per block that lists items under every value within so many flips misses none of them.
Candidates are verified by the exact weighted similarity of their shingles (sum of least over sum of largest
multiplicities), LEAST or more.

RADIUS follows from LEAST: at weighted similarity s the share of common shingles is c = 2 s / (1 + s), a bit differs with
probability arccos(c) / pi, and so 19.4 of 128 bits do on average at 0.8, with a deviation of 4.1. Of windows just at the
threshold 31 bits keep 998 in 1000, of closer ones nearly all (the tests measure it); of random fingerprints one in 10**8 passes.

Words are lower-cased runs of letters and digits (bytes from 128 on count as letters). Handling of odd input: null texts
and items count as empty and match nothing; an item below SHINGLE words has its whole sequence as one shingle; equal items
each report; repeated rows report each; a null doc_id reports null; empty tables give empty results; other columns are
ignored, or kept by ``without_contaminated``. Ties of similarity go to the first window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm import common
from plyforge.llm.toxicity import words_of

SHINGLE, LEAST = 5, 0.8
BITS, BLOCKS, RADIUS = 128, 16, 31
#: Items that travel with a task at once; more items go in further scans over the same rows.
MOST_ITEMS = 20_000
TABLE_BITS = 22

_FLIPS = [sum(1 << b for b in range(8) if x >> b & 1) for x in range(256) if bin(x).count("1") <= RADIUS // BLOCKS]


def signs(grams: np.ndarray) -> np.ndarray:
    """Of each shingle hash, BITS signs."""
    words = np.stack([common.mixed(grams + np.uint64(11 + 12 * k)) for k in range(BITS // 64)], axis=1)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def fingerprint(grams: np.ndarray) -> int:
    """SimHash of shingle hashes, each occurrence weighing 1."""
    return int.from_bytes(np.packbits(signs(grams).sum(0) > 0).tobytes(), "big")


def rolled(grams: np.ndarray, starts: list[int], width: int) -> list[int]:
    """Fingerprints of the windows of ``width`` shingles at ascending ``starts``, by running sums over each stretch of them."""
    out, at = [], 0
    while at < len(starts):
        to = at + 1
        while to < len(starts) and starts[to] - starts[to - 1] <= width and starts[to] - starts[at] < 4096:
            to += 1
        first, last = starts[at], starts[to - 1] + width
        sums = np.vstack([np.zeros((1, BITS), np.int32), np.cumsum(signs(grams[first:last]), 0, dtype=np.int32)])
        where = np.array(starts[at:to]) - first
        marks = np.packbits(sums[where + width] - sums[where] > 0, axis=1)
        out += [int.from_bytes(m.tobytes(), "big") for m in marks]
        at = to
    return out


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of least over sum of largest multiplicities."""
    if not len(a) or not len(b):
        return 0.0
    values, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(back[: len(a)], minlength=len(values)), np.bincount(back[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Items:
    """An index of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], shingle: int = SHINGLE, least: float = LEAST):
        hashes = common.WordHashes()
        self.shingle, self.least = shingle, least
        found = [(i, hashes(words_of(t or ""))) for i, t in items]
        found = [(i, w) for i, w in found if len(w)]
        self.ids, self.words = [i for i, _ in found], [w for _, w in found]
        self.grams = [common.ngram_hashes(w, shingle) for w in self.words]
        self.prints = [fingerprint(g) for g in self.grams]
        #: Items by length in words; their shingles by shingle size (short items have sizes of their own).
        self.by_size: dict[int, list[int]] = {}
        self.tables: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}
        for k, w in enumerate(self.words):
            self.by_size.setdefault(len(w), []).append(k)
            n = min(shingle, len(w))
            table, where = self.tables.setdefault(n, (np.zeros(1 << TABLE_BITS, bool), {}))
            table[(self.grams[k] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
            for g in set(self.grams[k].tolist()):
                where.setdefault(g, []).append(k)
        #: Per length and block: items under every value of the block within reach.
        self.multi: dict[int, list[dict[int, list[int]]]] = {}
        for size, members in self.by_size.items():
            self.multi[size] = [{} for _ in range(BLOCKS)]
            for k in members:
                for b, table in enumerate(self.multi[size]):
                    value = self.prints[k] >> 8 * b & 255
                    for flip in _FLIPS:
                        table.setdefault(value ^ flip, []).append(k)

    def near(self, size: int, mark: int) -> list[tuple[int, int]]:
        """(item, distance) of the items of ``size`` words within RADIUS of a fingerprint."""
        could = {k for b, table in enumerate(self.multi[size]) for k in table.get(mark >> 8 * b & 255, ())}
        return [(k, d) for k in sorted(could) if (d := (self.prints[k] ^ mark).bit_count()) <= RADIUS]

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, first word, distance, similarity) of the best window of each item that a document contains."""
        n, out = len(words), {}
        #: Per length of items, the windows that hold a shingle of one of them.
        starts: dict[int, set[int]] = {}
        grams_of: dict[int, np.ndarray] = {}
        for size, (table, where) in self.tables.items():
            grams = grams_of[size] = common.ngram_hashes(words, size) if n >= size else words[:0]
            for at in np.flatnonzero(table[(grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]).tolist():
                for length in {len(self.words[k]) for k in where.get(int(grams[at]), ())}:
                    window = min(length, n)
                    width = max(1, window - size + 1)
                    starts.setdefault(length, set()).update(range(max(0, at - width + 1), min(at, n - window) + 1))
        for length, found in starts.items():
            window = min(length, n)
            size = min(self.shingle, window)
            grams = grams_of.get(size)
            if grams is None:
                grams = common.ngram_hashes(words, size)
            width, found = window - size + 1, sorted(found)
            for at, mark in zip(found, rolled(grams, found, width), strict=True):
                for k, distance in self.near(length, mark):
                    similarity = weighted_similarity(grams[at : at + width], self.grams[k])
                    if similarity >= self.least and (k not in out or similarity > out[k][2]):
                        out[k] = (at, distance, similarity)
        return [(self.ids[k], *found) for k, found in sorted(out.items())]


def item_blocks(benchmark: DataFrame, most: int = MOST_ITEMS):
    """The items in blocks of about ``most``, one after another: each comes to the driver, is indexed there and broadcast,
    and is let go before the next one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    blocks = items.count() // most + 1
    for b in range(blocks):
        yield [(r["item_id"], r["text"]) for r in items.where(F.expr(f"pmod(xxhash64(item_id, text), {blocks}) = {b}")).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST, most: int = MOST_ITEMS) -> DataFrame:
    """doc_id, item_id, first_word, distance, similarity: each document and item it contains, with the best window."""
    spark = docs.sparkSession
    texts = common.id_text(docs, id_col, text_col)
    schema, out = "doc_id long, item_id long, first_word long, distance long, similarity double", None
    for block in item_blocks(benchmark, most):
        index = spark.sparkContext.broadcast(Items(block, shingle, least))

        @common.task("decontaminate")
        def run(batches, index=index):
            items, hashes = index.value, common.WordHashes()
            for batch in batches:
                for part in common.slices(batch, "text"):
                    rows = [(i, *m) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for m in items.matches(hashes(words_of(t)))]
                    columns = list(zip(*rows, strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "first_word", "distance", "similarity"])

        made = texts.mapInArrow(run, schema)
        out = made if out is None else out.unionByName(made)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST, most: int = MOST_ITEMS) -> DataFrame:
    """``docs`` that contain no item, all columns kept; nothing is shuffled."""
    spark = docs.sparkSession
    for block in item_blocks(benchmark, most):
        index = spark.sparkContext.broadcast(Items(block, shingle, least))

        @common.task("decontaminate")
        def run(batches, index=index):
            items, hashes = index.value, common.WordHashes()
            for batch in batches:
                for part in common.slices(batch, text_col):
                    yield part.filter(pa.array([not items.matches(hashes(words_of(t or ""))) for t in part.column(text_col).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
