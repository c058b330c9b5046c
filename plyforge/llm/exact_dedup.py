"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every task cuts its rows into blocks. A block sorts the distinct 48-bit fingerprints of its texts, deals them to owners
   by range, and sends each owner one Golomb-Rice coded list. Copies inside a block are pre-aggregated: a block sends a
   fingerprint once, however many copies it has.
2. An owner decodes its lists, finds the fingerprints that more than one block sent or one block holds twice, and answers
   each block with a bitmap over the list it sent.
3. Rows under a set bit are suspects. Only their texts are shuffled, and grouped by their bytes, so that a collision of
   fingerprints never joins two texts.

Handling of odd input: a null text counts as empty; empty texts equal each other; a null doc_id sorts below every number;
of rows that tie for the largest doc_id exactly one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm import common

FP_BITS = 48
#: Rows of a block; an owner's share of all documents; fingerprints of a list at least, on average, of a full block. The last
#: bounds the owners by the size of a block, so that lists grow with the rows and not with their square; beyond
#: BLOCK_ROWS / LIST_ROWS * OWNER_ROWS rows (4 * 10**9) it is the share of an owner that grows, 8 bytes a fingerprint.
BLOCK_ROWS, OWNER_ROWS, LEAST_OWNERS, LIST_ROWS = 1 << 17, 1 << 20, 64, 32

BLOCKS = "block long, owner int, n int, shift int, unary binary, rests binary, twice binary, ids array<long>, rank array<int>, shas binary"


def golomb(values: np.ndarray, shift: int) -> tuple[bytes, bytes]:
    """Rice code (a Golomb code with divisor 2**shift) of ascending integers: their gaps' quotients in unary, and remainders."""
    gaps = np.diff(values, prepend=0)
    ends = np.cumsum((gaps >> shift) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    rests = ((gaps[:, None] >> np.arange(shift)[::-1]) & 1).astype(np.uint8)
    return np.packbits(unary).tobytes(), np.packbits(rests).tobytes()


def ungolomb(unary: bytes, rests: bytes, n: int, shift: int) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    high = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rests, np.uint8))[: n * shift].reshape(n, shift).astype(np.int64)
    return np.cumsum((high << shift) + bits @ (1 << np.arange(shift, dtype=np.int64)[::-1]))


def best_shift(n: int, span: int) -> int:
    """log2 of the mean gap, with which a Rice code of random values is within a few hundredths of a bit of the best."""
    return max(1, int(np.log2(max(2, span / max(1, n)))))


def fingerprints(texts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts)) >> np.uint64(64 - FP_BITS)


def owner_of(fps: np.ndarray, owners: int) -> np.ndarray:
    return (fps.astype(np.int64) >> 24) * owners >> (FP_BITS - 24)


def low_of(owner: int, owners: int) -> int:
    """The least fingerprint that ``owner`` may get."""
    return -(-(owner << (FP_BITS - 24)) // owners) << 24


def texts_of(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _blocks(owners: int, block_rows: int):
    @common.task("exact_dedup")
    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        ids, fps, shas = [], [], []

        def flush():
            nonlocal ids, fps, shas, made
            block = (task << 24) | made
            made += 1
            all_ids = np.array(ids, dtype=object)
            fp = np.concatenate(fps).astype(np.int64)
            sha = np.frombuffer(b"".join(shas), np.uint8).reshape(-1, 32)
            order = np.argsort(fp, kind="stable")
            fp, all_ids, sha = fp[order], all_ids[order], sha[order]
            own = owner_of(fp, owners)
            cut = np.flatnonzero(np.diff(own, prepend=-1, append=owners + 1))
            rows = {k: [] for k in ("block", "owner", "n", "shift", "unary", "rests", "twice", "ids", "rank", "shas")}
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                low = low_of(int(own[a]), owners)
                distinct, rank, count = np.unique(fp[a:b], return_inverse=True, return_counts=True)
                shift = best_shift(len(distinct), (1 << FP_BITS) // owners)
                unary, rests = golomb(distinct - low, shift)
                for k, v in zip(rows, (block, int(own[a]), len(distinct), shift, unary, rests, np.packbits(count > 1).tobytes(), list(all_ids[a:b]), rank.astype(np.int32), sha[a:b].tobytes()), strict=True):
                    rows[k].append(v)
            ids, fps, shas = [], [], []
            return pa.RecordBatch.from_arrays([pa.array(rows["block"], pa.int64()), pa.array(rows["owner"], pa.int32()), pa.array(rows["n"], pa.int32()), pa.array(rows["shift"], pa.int32()), *(pa.array(rows[k], pa.binary()) for k in ("unary", "rests", "twice")), pa.array(rows["ids"], pa.list_(pa.int64())), pa.array(rows["rank"], pa.list_(pa.int32())), pa.array(rows["shas"], pa.binary())], names=list(rows))

        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = texts_of(part.column("text"))
                ids += part.column("doc_id").to_pylist()
                fps.append(fingerprints(texts))
                shas += [hashlib.sha256(t).digest() for t in texts]
                if len(ids) >= block_rows:
                    yield flush()
        if ids:
            yield flush()

    return run


def _answers(owners: int):
    """One owner's lists to one bitmap per list. The lists of an owner hold about OWNER_ROWS fingerprints in all."""

    def run(key, table):
        low = low_of(key[0].as_py(), owners)
        lists = [ungolomb(u, r, n, s) + low for u, r, n, s in zip(*(table.column(c).to_pylist() for c in ("unary", "rests", "n", "shift")), strict=True)]
        twice = [np.unpackbits(np.frombuffer(t, np.uint8))[: len(x)] for t, x in zip(table.column("twice").to_pylist(), lists, strict=True)]
        values, back, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        again = count > 1
        again[back[np.concatenate(twice) == 1]] = True
        hits, at, bitmaps = again[back], 0, []
        for x in lists:
            bitmaps.append(np.packbits(hits[at : at + len(x)]).tobytes())
            at += len(x)
        return pa.table({"block": table.column("block"), "owner": table.column("owner"), "bitmap": pa.array(bitmaps, pa.binary())})

    return run


MARKS = "uid long, doc_id long, fp long, sha binary, suspect boolean"


def _marks(owners: int):
    """Bitmaps back to rows. uid: the row's block and place, a key even where doc_id repeats or is null."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("block", "owner", "n", "shift", "unary", "rests", "bitmap")}
                ids = batch.column("ids")[i].values
                rank = batch.column("rank")[i].values.to_numpy()
                fps = ungolomb(row["unary"], row["rests"], row["n"], row["shift"]) + low_of(row["owner"], owners)
                hit = np.unpackbits(np.frombuffer(row["bitmap"], np.uint8))[rank] == 1
                shas = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(rank), [None, pa.py_buffer(batch.column("shas")[i].as_py())]).cast(pa.binary())
                order = np.arange(len(rank), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(_uid(row["block"], row["owner"], order)), ids, pa.array(fps[rank]), shas, pa.array(hit)], names=["uid", "doc_id", "fp", "sha", "suspect"])

    return run


def _uid(block: int, owner: int, order: np.ndarray) -> np.ndarray:
    """A 63-bit hash of (block, owner, place); ties of (doc_id, uid) would need equal ids and equal hashes."""
    seed = np.uint64((block * 1_000_003 + owner * 7_919) & (2**64 - 1))
    return (common.mixed(order.astype(np.uint64) + common.mixed(np.array([seed], np.uint64))) >> np.uint64(1)).astype(np.int64)


def owners_for(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    return max(LEAST_OWNERS, min(rows // OWNER_ROWS + 1, block_rows // LIST_ROWS))


def marked(texts: DataFrame, block_rows: int = BLOCK_ROWS, owners: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with uid, doc_id, fp, sha, suspect; byte-verified classes of suspects with fp, sha, keep, group_size)."""
    spark = texts.sparkSession
    owners = owners or owners_for(texts.count(), block_rows)
    sent = common.saved(texts.mapInArrow(_blocks(owners, block_rows), BLOCKS), "dedup-blocks")
    lists = sent.select("block", "owner", "n", "shift", "unary", "rests", "twice")
    bitmaps = lists.groupBy("owner").applyInArrow(_answers(owners), "block long, owner int, bitmap binary")
    marks = common.saved(sent.drop("twice").join(bitmaps, ["block", "owner"]).mapInArrow(_marks(owners), MARKS), "dedup-marks")

    wanted = spark.sparkContext.broadcast(common.KeyFilter.of(marks.where("suspect").select("fp").distinct(), "fp"))

    def suspects(batches):
        for batch in batches:
            for part in common.slices(batch, "text"):
                fps = fingerprints(texts_of(part.column("text")))
                keep = wanted.value.hits(fps)
                if keep.any():
                    keep = pa.array(keep)
                    yield pa.RecordBatch.from_arrays([pa.array(fps.astype(np.int64)).filter(keep), part.column("text").filter(keep)], names=["fp", "text"])

    fp_dup = marks.where("suspect").select("fp").distinct()
    by_bytes = texts.mapInArrow(suspects, "fp long, text string").groupBy("fp", "text").agg(F.count(F.lit(1)).alias("group_size"))
    by_bytes = by_bytes.join(fp_dup, "fp", "left_semi")
    sizes = by_bytes.select("fp", F.unhex(F.sha2("text", 256)).alias("sha"), "group_size")
    keepers = marks.where("suspect").groupBy("fp", "sha").agg(F.max(F.struct("doc_id", "uid")).alias("keep"), F.count(F.lit(1)).alias("seen"))
    # Byte groups and digests must agree row for row; a broken digest would stop the job here, not pass unseen.
    agreed = keepers.join(sizes, ["fp", "sha"]).select("fp", "sha", "keep", F.when(F.col("seen") == F.col("group_size"), F.col("group_size")).otherwise(F.raise_error(F.lit("equal digests of different texts"))).cast("long").alias("group_size"))
    return marks, common.saved(agreed, "dedup-classes")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """A row per row of ``docs``: doc_id, keep_id (largest doc_id of equal texts), group_size, kept, text_sha256."""
    marks, classes = marked(common.id_text(docs, id_col, text_col), **how)
    alone = marks.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    found = marks.where("suspect").join(classes, ["fp", "sha"]).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("keep.uid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return alone.unionByName(found)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of the largest doc_id of each group of equal texts, all columns kept.

    Rows are named by doc_id and digest of the text. Of rows that agree in both exactly one stays.
    """
    made = decisions(docs, id_col, text_col)
    id_, sha = common.fresh("_id", docs), common.fresh("_sha", docs)
    by_name = made.groupBy(F.col("doc_id").alias(id_), F.unhex("text_sha256").alias(sha)).agg(F.max("kept").alias("any"), F.count(F.lit(1)).alias("n"))
    named = docs.withColumn(sha, F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256)))
    same = lambda other: F.col(f"`{id_col}`").cast("long").eqNullSafe(other[id_]) & (named[sha] == other[sha])
    gone = by_name.where("not any")
    out = named.join(gone, same(gone), "left_anti")
    many = common.saved(by_name.where("any and n > 1").select(id_, sha), "dedup-repeated")
    if not many.isEmpty():
        # Each repeated row once; partial aggregates keep a hot one from meeting in one task.
        twice = out.join(many, same(many), "left_semi")
        first = twice.groupBy(F.col(f"`{id_col}`").alias(id_), sha).agg(F.first(F.struct(*(f"`{c}`" for c in docs.columns))).alias("row")).select("row.*", sha)
        out = out.join(many, same(many), "left_anti").unionByName(first)
    return out.drop(sha)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(common.documents(spark, sf_dir))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
