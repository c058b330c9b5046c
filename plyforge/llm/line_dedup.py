"""Line dedup by overlapping three-line windows.

Every three consecutive lines are a window. A window that stands more than once in the corpus keeps its first occurrence
(in the document of the least doc_id, there at the first line); the lines that later occurrences cover, merged where they
overlap, are removed. Lines end at ``\\n`` and are compared as they are; a window of blank lines only is none.

The corpus is summed up by window hash (128 bits, partial sums before the shuffle); a second scan ships only windows that a
filter of fixed size takes for repeated ones, and the removed places, not the texts of untouched documents, meet by row.
Rows are numbered in a table written first, so that all scans know a row by the same number.

Handling of odd input: a null text counts as empty; texts of fewer than three lines have no windows and stay; rows that
share a doc_id, or have none, are documents of their own in the order of their numbers, null before all others; an empty table gives an empty result; other columns
are ignored, or kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm import common

LINES = 3
#: Stands for a null doc_id.
NO_ID = -(2**63)
#: The column with the numbers of rows.
ROW = "_row"


def windows(text: str, size: int = LINES) -> np.ndarray:
    """(n - size + 1, 2) hashes of the windows of a text; both 0 where all lines are blank."""
    lines = text.split("\n")
    n = len(lines) - size + 1
    if n < 1:
        return np.zeros((0, 2), np.uint64)
    one = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), ">u8").astype(np.uint64).reshape(-1, 2)
    out = one[:n].copy()
    for i in range(1, size):
        out = common.mixed(out * common.M1 + one[i : n + i])
    blank = np.fromiter((not x or x.isspace() for x in lines), bool, len(lines))
    if blank.any():
        none = blank[:n].copy()
        for i in range(1, size):
            none &= blank[i : n + i]
        out[none] = 0
    return out


def _counted(size: int):
    @common.task("line_dedup")
    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "text"):
                ids = part.column("doc_id").fill_null(NO_ID).to_numpy()
                found = [windows(t, size) for t in part.column("text").to_pylist()]
                sizes = [len(f) for f in found]
                doc, row = np.repeat(ids, sizes), np.repeat(part.column(ROW).to_numpy(), sizes)
                keys = np.concatenate(found) if found else np.zeros((0, 2), np.uint64)
                real = keys.any(1)
                keys, doc, row = keys[real], doc[real], row[real]
                order = np.lexsort((row, doc, keys[:, 1], keys[:, 0]))
                keys, doc, row = keys[order], doc[order], row[order]
                new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.zeros(0, bool)
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at, 0].view(np.int64) if len(at) else np.zeros(0, np.int64)), pa.array(keys[at, 1].copy().view(np.int64) if len(at) else np.zeros(0, np.int64)), pa.array(doc[at]), pa.array(row[at]), pa.array(np.diff(np.append(at, len(keys))))], names=["h1", "h2", "first_doc", "first_row", "n"])

    return run


def _placed(wanted, size: int):
    """Places of the windows that may be repeated: per row and window, all its starts."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "text"):
                rows, h1, h2, places = [], [], [], []
                for row, text in zip(part.column(ROW).to_pylist(), part.column("text").to_pylist(), strict=True):
                    keys = windows(text, size)
                    at = np.flatnonzero(wanted.value.hits(keys[:, 0]) & keys.any(1))
                    if len(at):
                        by: dict[tuple[int, int], list[int]] = {}
                        for i, a, b in zip(at.tolist(), keys[at, 0].view(np.int64).tolist(), keys[at, 1].copy().view(np.int64).tolist(), strict=True):
                            by.setdefault((a, b), []).append(i)
                        rows += [row] * len(by)
                        h1 += [a for a, _ in by]
                        h2 += [b for _, b in by]
                        places += by.values()
                yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(rows, pa.int64()), pa.array(places, pa.list_(pa.int32()))], names=["h1", "h2", "row", "places"])

    return run


def removals(docs: DataFrame, size: int = LINES, id_col: str = "doc_id", text_col: str = "text", row_col: str = ROW) -> DataFrame:
    """(row, starts): per row of ``docs``, which has numbers of rows, the first lines of the windows to be removed."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.col(f"`{row_col}`").alias(ROW))
    counts = texts.mapInArrow(_counted(size), "h1 long, h2 long, first_doc long, first_row long, n long").groupBy("h1", "h2").agg(F.min(F.struct("first_doc", "first_row")).alias("first"), F.sum("n").alias("n"))
    repeated = common.saved(counts.where("n > 1").select("h1", "h2", "first.first_row"), "windows")
    wanted = spark.sparkContext.broadcast(common.KeyFilter.of(repeated, "h1"))
    placed = texts.mapInArrow(_placed(wanted, size), "h1 long, h2 long, row long, places array<int>")
    later = placed.join(repeated, ["h1", "h2"]).select("row", F.when(F.col("row") == F.col("first_row"), F.slice("places", 2, F.greatest(F.size("places") - 1, F.lit(0)))).otherwise(F.col("places")).alias("places"))
    return later.where(F.size("places") > 0).groupBy("row").agg(F.array_sort(F.flatten(F.collect_set("places"))).alias("starts"))


def cleaned(text: str, starts: list[int], size: int = LINES) -> tuple[str, list[tuple[int, int]], int]:
    """(the text without the covered lines, the merged runs as first and last line, number of lines)."""
    lines = text.split("\n")
    gone: list[tuple[int, int]] = []
    for s in starts:
        if gone and s <= gone[-1][1] + 1:
            gone[-1] = (gone[-1][0], max(gone[-1][1], s + size - 1))
        else:
            gone.append((s, s + size - 1))
    kept, at = [], 0
    for a, b in gone:
        kept += lines[at:a]
        at = b + 1
    return "\n".join(kept + lines[at:]), gone, len(lines)


def _scrambled(rows: np.ndarray) -> np.ndarray:
    """Numbers of rows for a key filter, which numbers of few different bits would crowd."""
    return common.mixed(rows.astype(np.uint64)).view(np.int64)


def _keys(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_scrambled(batch.column("row").to_numpy()))], names=["key"])


def _with_starts(docs: DataFrame, size: int, id_col: str, text_col: str, starts: str) -> DataFrame:
    """``docs`` with a column ``starts``; only rows that may have removals are shuffled."""
    spark, row = docs.sparkSession, common.fresh(ROW, docs)
    docs = common.saved(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = common.saved(removals(docs, size, id_col, text_col, row), "removals")
    wanted = spark.sparkContext.broadcast(common.KeyFilter.of(found.select("row").mapInArrow(_keys, "key long"), "key"))

    def chosen(want: bool):
        def run(batches):
            for batch in batches:
                hits = wanted.value.hits(_scrambled(batch.column(row).to_numpy()))
                yield batch.filter(pa.array(hits == want))

        return run

    maybe = docs.mapInArrow(chosen(True), docs.schema).join(found.select(F.col("row").alias(row), F.col("starts").alias(starts)), row, "left")
    return docs.mapInArrow(chosen(False), docs.schema).withColumn(starts, F.lit(None).cast("array<int>")).unionByName(maybe).drop(row)


def without_repeats(docs: DataFrame, size: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the texts that stay, all columns kept. Null texts stay null."""
    starts = common.fresh("_starts", docs)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [t if t is None or not s else cleaned(t, s, size)[0] for t, s in zip(batch.column(at).to_pylist(), batch.column(starts).to_pylist(), strict=True)]
            batch = batch.set_column(at, text_col, pa.array(texts, pa.string()))
            yield batch.select([n for n in batch.schema.names if n != starts])

    return _with_starts(docs, size, id_col, text_col, starts).mapInArrow(run, docs.schema)


def digests(docs: DataFrame, size: int = LINES) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (runs as first-last, comma-joined), text_sha256 of what stays."""

    def run(batches):
        for batch in batches:
            made = [cleaned(t, s or [], size) for t, s in zip(batch.column("text").to_pylist(), batch.column("_starts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([m[2] for m in made], pa.int64()), pa.array([sum(b - a + 1 for a, b in m[1]) for m in made], pa.int64()), pa.array([",".join(f"{a}-{b}" for a, b in m[1]) for m in made]), pa.array([hashlib.sha256(m[0].encode()).hexdigest() for m in made])], names=["doc_id", "n_lines", "n_removed", "removed", "text_sha256"])

    return _with_starts(common.id_text(docs), size, "doc_id", "text", "_starts").mapInArrow(run, "doc_id long, n_lines long, n_removed long, removed string, text_sha256 string")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))


ORACLE = r"""
WITH rows_ AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
wins AS (
  SELECT doc_id, pos, line AS l1, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3, lead(pos, 2) OVER w AS final
  FROM rows_ WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, pos) AS rn FROM wins
    WHERE final IS NOT NULL AND NOT (trim(l1) = '' AND trim(l2) = '' AND trim(l3) = ''))
  WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)),
runs AS (
  SELECT doc_id, min(pos) AS a, max(pos) AS b
  FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM gone) GROUP BY doc_id, run),
ranges AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS removed, sum(b - a + 1) AS n FROM runs GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS text
  FROM rows_ l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT doc_id, n_lines, coalesce(r.n, 0)::BIGINT AS n_removed, coalesce(r.removed, '') AS removed, sha256(coalesce(k.text, '')) AS text_sha256
FROM kept k LEFT JOIN ranges r USING (doc_id)
"""
