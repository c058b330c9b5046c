"""Near-duplicates by an inverted join of MinHash signature coordinates, confirmed on full shingle sets.

1. Every text becomes its set of word shingles and a signature of K minima. Equal sets are one class from here on.
2. Every class posts its id under (coordinate, value) pairs. Two signatures that agree in T of K places must share one of
   the K - T + 1 pairs that come first in any order common to all, so each class posts only that prefix, rarest pairs
   first; how rare a pair is comes from a count table of fixed size, filled from all signatures.
3. Under one pair, classes are tied where one-byte sketches of their signatures agree in T places (a list of more than
   BLOCK classes is tied as a whole, through the pair), and tied groups are gathered by connected components.
4. A group is cut into blocks of bounded size. In a block, collisions are counted by posting lists: of a class, the
   K - T + 1 shortest lists are merged, which finds all that can reach T, and the T - 1 longest are skipped; only for what
   the merge found are they looked into. Classes with T matches are confirmed by the exact intersection of their sets,
   unless a chain of confirmed links has joined them already. Where a group has more than one block, classes left outside
   the group's largest component meet every other block in a second pass, so no link is lost.

Ties under a pair (3) are counted in the same way, over sketches; lists of up to SMALL classes outright.

T is K * threshold less ``SIGMAS`` standard deviations of a binomial count: a linked pair misses it once in 10 million.

Handling of odd input: a null text counts as empty; a text without words has no shingles, and is alone; with fewer words
than a shingle has, the whole sequence is the one shingle; rows that repeat a doc_id count as one document each for
themselves and share the least id; a null doc_id is kept, alone; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.llm import common
from plyforge.llm.components import components

K, SIGMAS = 96, 5.2
#: A coordinate holds the identity of its least shingle in so many bytes; chance agreements grow as documents / 256**BYTES.
BYTES = 6
COUNT_BITS, BLOCK, HUBS, MEET, SMALL = 23, 2048, 32, 64, 24
#: Tasks whose counts are summed in one task.
ADDENDS = 512

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(1, 1 << 32, K, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _rng.integers(0, 1 << 32, K, dtype=np.uint64).astype(np.uint32)[:, None]


def least_matches(threshold: float) -> int:
    return max(1, math.floor(K * threshold - SIGMAS * math.sqrt(K * threshold * (1 - threshold))))


def shingles(text: str, n: int, words: common.WordHashes) -> np.ndarray:
    """Hashes of the distinct shingles, ascending. bytes.lower() and split() know A-Z and the blanks of ASCII only."""
    return np.unique(common.ngram_hashes(words(text.encode().lower().split()), n))


def signature(found: np.ndarray) -> np.ndarray:
    """K values below 256**BYTES: of the least shingle under each of K orders."""
    low = (found >> np.uint64(32)).astype(np.uint32) ^ found.astype(np.uint32)
    least, out, rows = np.full(K, 0xFFFFFFFF, np.uint32), np.full(K, found[0], np.uint64), np.arange(K)
    for at in range(0, len(low), 2048):
        ranks = _A * low[at : at + 2048] + _B
        best = ranks.argmin(1)
        value = ranks[rows, best]
        less = value < least
        least[less], out[less] = value[less], found[at + best[less]]
    return out & np.uint64((1 << 8 * BYTES) - 1)


def packed(sig: np.ndarray) -> bytes:
    return sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def _stack(column: pa.Array) -> np.ndarray:
    """Packed signatures to a row each."""
    out = np.zeros((len(column) * K, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BYTES)
    return out.view("<u8").reshape(-1, K)


def pair_hashes(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit key of each (coordinate, value)."""
    return common.mixed(sigs << np.uint64(8) | np.arange(K, dtype=np.uint64))


def _signed(n: int):
    @common.task("minhash")
    def run(batches):
        words = common.WordHashes()
        for batch in batches:
            for part in common.slices(batch, "text"):
                sizes, sigs, digests = [], [], []
                for text in part.column("text").to_pylist():
                    found = shingles(text, n, words)
                    sizes.append(len(found))
                    sigs.append(packed(signature(found)) if len(found) else None)
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "digest", "sig"])

    return run


@common.task("minhash")
def _cells(batches):
    """Partial counts of the table's cells."""
    table = np.zeros(1 << COUNT_BITS, np.int64)
    for batch in batches:
        for part in common.slices(batch, "sig"):
            table += np.bincount((pair_hashes(_stack(part.column("sig"))) >> np.uint64(64 - COUNT_BITS)).ravel().astype(np.int64), minlength=1 << COUNT_BITS)
    # Rows of 4096 cells: they meet by number, those of ADDENDS tasks first.
    part = TaskContext.get().partitionId() // ADDENDS
    for row in range(len(table) >> 12):
        cells = table[row << 12 : (row + 1) << 12]
        if cells.any():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([part], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["row", "part", "cells"])


def _added(table: pa.Table) -> np.ndarray:
    cells = np.zeros(1 << 12, np.int64)
    for x in table.column("cells"):
        cells += np.frombuffer(x.as_buffer(), np.int64)
    return cells


def _summed_part(key, table):
    return pa.table({"row": [key[0].as_py()], "cells": [_added(table).tobytes()]}, schema=pa.schema([("row", pa.int32()), ("cells", pa.binary())]))


def _summed(key, table):
    # Counts above 65534 are equal in the order, which goes by key then: it only has to be the same for all.
    return pa.table({"row": [key[0].as_py()], "cells": [np.minimum(_added(table), 65_534).astype(np.uint16).tobytes()]}, schema=pa.schema([("row", pa.int32()), ("cells", pa.binary())]))


def pair_counts(sigs: DataFrame) -> np.ndarray:
    """The count table: 2**COUNT_BITS cells of two bytes, at any input size."""
    tasks = sigs.mapInArrow(_cells, "row int, part int, cells binary")
    parts = tasks.groupBy("row", "part").applyInArrow(_summed_part, "row int, cells binary")
    got = parts.groupBy("row").applyInArrow(_summed, "row int, cells binary").toArrow()
    table = np.zeros(1 << COUNT_BITS, np.uint16)
    for row, cells in zip(got.column("row").to_pylist(), got.column("cells").to_pylist(), strict=True):
        table[row << 12 : (row + 1) << 12] = np.frombuffer(cells, np.uint16)
    return table


def _posted(counts, prefix: int, shared=None):
    """Postings of the prefix, rarest first; with ``shared``, only those it knows, each with the class's sketch."""

    @common.task("minhash")
    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "sig"):
                sigs = _stack(part.column("sig"))
                keys = pair_hashes(sigs)
                seen = counts.value[(keys >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                # The common order: by count, then by key.
                order = np.lexsort((keys, seen), axis=1)[:, :prefix]
                keys = np.take_along_axis(keys, order, 1)
                row, col = np.nonzero(np.ones(keys.shape, bool) if shared is None else shared.value.hits(keys))
                columns = [pa.array(keys[row, col].view(np.int64)), part.column("rep").take(pa.array(row))]
                if shared is not None:
                    sketches = np.ascontiguousarray(sigs.astype(np.uint8))
                    columns.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(K), len(sketches), [None, pa.py_buffer(sketches)]).cast(pa.binary()).take(pa.array(row)))
                yield pa.RecordBatch.from_arrays(columns, names=["pair", "rep", "sketch"][: len(columns)])

    return run


def _tied(least: int):
    """Ties within the lists of pairs (rows sorted by pair and salt): classes whose sketches agree in ``least`` places or more.

    A list that is dealt over several salts is not compared here; its classes are all tied to the pair itself (a node
    below 0), so that nothing is lost between its parts.
    """

    def ties(pair: int, salts: int, reps: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int]]:
        if salts > 1:
            return [(r, -(pair >> 1 & (1 << 62) - 1) - (1 << 62)) for r in reps.tolist()]
        if len(reps) == 1:
            return []
        forest = Forest(len(reps))
        if len(reps) <= SMALL:
            for x in range(1, len(reps)):
                for y in np.flatnonzero((sketches[:x] == sketches[x]).sum(1) >= least).tolist():
                    forest.join(x, y)
        else:
            lists = Postings(sketches, least)
            for x in range(1, len(reps)):
                for y in lists.matches(x, lists.earlier(x))[0].tolist():
                    forest.join(x, y)
        return [(int(reps[x]), int(reps[root])) for x in range(len(reps)) if (root := forest.root(x)) != x]

    @common.task("minhash")
    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in _and_none(batches):
            if batch is not None and batch.num_rows:
                held.append(batch)
            if not held:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            pairs, salt = table.column("pair").to_numpy(), table.column("salt").to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (salt[1:] != salt[:-1])]))
            # The last list may go on in the next batch.
            end = len(pairs) if batch is None else int(cut[-1])
            if not end:
                continue
            reps, salts = table.column("rep").to_numpy(), table.column("salts").to_numpy()
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, K)
            out = [t for a, b in zip(cut, np.append(cut[1:], len(pairs))) if a < end for t in ties(int(pairs[a]), int(salts[a]), reps[a:b], sketches[a:b])]
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in out], pa.int64()), pa.array([t[1] for t in out], pa.int64())], names=["a", "b"])
            held = table.slice(end).to_batches() if end < len(pairs) else []

    return run


def _and_none(batches):
    yield from batches
    yield None


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class Postings:
    """Posting lists of a block's (coordinate, value) pairs: merged where they are short, skipped where they are long."""

    def __init__(self, sigs: np.ndarray, least: int):
        self.sigs, self.least, self.n = sigs, least, len(sigs)
        # The members of each list are a stretch of a column's order by value; ascending, as the sort is stable.
        self.order = np.argsort(sigs, axis=0, kind="stable")
        ranked = np.take_along_axis(sigs, self.order, 0)
        new = np.ones(sigs.shape, bool)
        new[1:] = ranked[1:] != ranked[:-1]
        begin = np.maximum.accumulate(np.where(new, np.arange(self.n)[:, None], 0), 0)
        last = np.ones(sigs.shape, bool)
        last[:-1] = new[1:]
        end = np.minimum.accumulate(np.where(last, np.arange(1, self.n + 1)[:, None], self.n)[::-1], 0)[::-1]
        #: Of each class and coordinate, where its list begins and ends.
        self.begin, self.end = np.empty_like(begin), np.empty_like(end)
        np.put_along_axis(self.begin, self.order, begin, 0)
        np.put_along_axis(self.end, self.order, end, 0)

    def earlier(self, x: int) -> np.ndarray:
        return np.arange(self.n) < x

    def matches(self, x: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(classes among ``wanted`` that agree with class x in ``least`` places or more, in how many)."""
        sizes = self.end[x] - self.begin[x]
        by_size = np.argsort(sizes, kind="stable")
        prefix, skipped = by_size[: K - self.least + 1], by_size[K - self.least + 1 :]
        found = np.concatenate([self.order[self.begin[x, c] : self.end[x, c], c] for c in prefix.tolist()])
        hits = np.bincount(found, minlength=self.n)
        near = np.flatnonzero((hits > 0) & wanted)
        hits = hits[near] + (self.sigs[near[:, None], skipped] == self.sigs[x, skipped]).sum(1)
        able = hits >= self.least
        return near[able], hits[able]


def confirmed(sigs: np.ndarray, sets: list[np.ndarray], share: tuple[int, int], least: int, only: np.ndarray | None = None) -> list[int]:
    """The block's components: of each class, the smallest index it is linked to.

    share: (100, 85) for 100 * intersection >= 85 * union. only: look for links of these indices (to all) only.
    """
    n = len(sets)
    forest = Forest(n)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    member = np.zeros(len(values), bool)
    left, right = share
    if n == 1:
        return [0]
    lists = Postings(sigs, least)
    for x in range(n) if only is None else only.tolist():
        near, hits = lists.matches(x, lists.earlier(x) if only is None else np.arange(n) != x)
        if not len(near):
            continue
        # Most matches first: one confirmed link to a component settles all its members.
        near = near[np.argsort(-hits, kind="stable")]
        mine, marked = flat[starts[x] : starts[x + 1]], False
        done: set[int] = set()
        for y in near.tolist():
            root = forest.root(y)
            if root in done or root == forest.root(x):
                continue
            if left * min(sizes[x], sizes[y]) < right * max(sizes[x], sizes[y]):
                continue
            if not marked:
                member[mine] = marked = True
            both = int(np.count_nonzero(member[flat[starts[y] : starts[y + 1]]]))
            if left * both >= right * (sizes[x] + sizes[y] - both):
                forest.join(x, y)
        if marked:
            member[mine] = False
    return [forest.root(i) for i in range(n)]


def _confirm_block(share, least, single):
    def run(key, table):
        reps = table.column("rep").to_numpy()
        order = np.argsort(reps, kind="stable")
        reps = reps[order]
        sets = [np.frombuffer(x, np.uint64) for x in table.column("items").take(pa.array(order)).to_pylist()]
        sigs = np.vstack([signature(s) for s in sets])
        only = None
        if not single:
            only = np.flatnonzero(table.column("odd").take(pa.array(order)).to_numpy(zero_copy_only=False))
        roots = confirmed(sigs, sets, share, least, only)
        return pa.table({"rep": pa.array(reps), "root": pa.array(reps[roots])})

    return run


def _items(wanted, n: int):
    """Shingle sets of the documents that the filter lets through."""

    @common.task("minhash")
    def run(batches):
        words = common.WordHashes()
        for batch in batches:
            hit = pa.array(wanted.value.hits(batch.column("doc_id").fill_null(-1).to_numpy()))
            batch = batch.filter(hit)
            for part in common.slices(batch, "text"):
                made = [shingles(t, n, words).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([xxhash.xxh3_128_digest(m) for m in made], pa.binary()), pa.array(made, pa.binary())], names=["doc_id", "digest", "items"])

    return run


def _across_blocks(items: DataFrame, share, least: int) -> DataFrame:
    """(node, root) over groups of several blocks (rep, root, blocks, block, items).

    First each block by itself. Then HUBS members of each block's largest piece meet those of up to MEET blocks, which
    joins the pieces of one large cluster. What is then outside its group's largest piece meets every block.
    """
    schema, once = "rep long, root long", _confirm_block(share, least, True)
    links = common.saved(items.groupBy("root", "block").applyInArrow(once, schema), "links")
    edges = links.select(F.col("rep").alias("a"), F.col("root").alias("b"))

    where = items.select("rep", F.col("root").alias("grp"), "block")
    part = links.withColumnRenamed("root", "piece").join(where, "rep")
    main = part.groupBy("grp", "block", "piece").agg(F.count(F.lit(1)).alias("n")).groupBy("grp", "block").agg(F.max_by("piece", F.struct("n", "piece")).alias("piece"))
    order = Window.partitionBy("grp", "block").orderBy(F.xxhash64("rep"), "rep")
    hubs = part.join(main, ["grp", "block", "piece"]).withColumn("at", F.row_number().over(order)).where(F.col("at") <= HUBS).select("rep")
    met = items.join(hubs, "rep").withColumn("meet", F.expr(f"block div {MEET}")).groupBy("root", "meet").applyInArrow(once, schema)
    edges = common.saved(edges.unionByName(met.select(F.col("rep").alias("a"), F.col("root").alias("b"))), "block-links")

    joined = components(edges)
    part = part.join(joined, F.col("rep") == F.col("node"), "left").select("rep", "grp", "block", F.coalesce(joined["root"], F.col("rep")).alias("piece"))
    main = part.groupBy("grp", "piece").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.max_by("piece", F.struct("n", "piece")).alias("main"))
    odd = common.saved(part.join(main, "grp").where("piece <> main").select("rep", F.lit(True).alias("odd")), "odd")
    if odd.isEmpty():
        return components(edges)
    # Meetings (block i of odd classes, block j of all): every odd class goes to all of its row of meetings.
    marked = items.join(odd, "rep", "left").select("rep", "root", "blocks", "block", "items", F.coalesce("odd", F.lit(False)).alias("odd"))
    guests = marked.where("odd").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("rep", "root", F.col("block").alias("mine"), "other", "items", "odd")
    rows = marked.where("odd").select("root", F.col("block").alias("mine")).distinct()
    hosts = marked.where("not odd").join(rows, "root").select("rep", "root", "mine", F.col("block").alias("other"), "items", "odd")
    # Odd classes of the other block come as hosts as well, unless they are among the guests already (mine = other).
    odd_hosts = marked.where("odd").join(rows, "root").where("mine <> block").select("rep", "root", "mine", F.col("block").alias("other"), "items", F.lit(False).alias("odd"))
    more = guests.unionByName(hosts).unionByName(odd_hosts).groupBy("root", "mine", "other").applyInArrow(_confirm_block(share, least, False), schema)
    return components(edges.unionByName(more.select(F.col("rep").alias("a"), F.col("root").alias("b"))))


def linked(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per row of ``docs``.

    Documents are linked where 100 * |A & B| >= percent * |A | B| on their sets of ``n``-word shingles; component_id is the
    least doc_id that links reach.
    """
    spark = docs.sparkSession
    texts = common.id_text(docs, id_col, text_col)
    least = least_matches(percent / 100)
    signed = common.saved(texts.mapInArrow(_signed(n), "doc_id long, n_shingles long, digest binary, sig binary"), "signed")

    usable = signed.where("n_shingles > 0 and doc_id is not null")
    # Equal sets have equal signatures, so any of them stands for the class.
    classes = common.saved(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")

    counts = spark.sparkContext.broadcast(pair_counts(classes.select("sig")))
    posted = classes.select("rep", "sig").mapInArrow(_posted(counts, K - least + 1), "pair long, rep long")
    pairs = common.saved(posted.groupBy("pair").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "shared-pairs")
    shared = spark.sparkContext.broadcast(common.KeyFilter.of(pairs, "pair", 26))
    rows = classes.select("rep", "sig").mapInArrow(_posted(counts, K - least + 1, shared), "pair long, rep long, sketch binary")
    hot = pairs.where(f"many > {block}").select("pair", F.expr(f"cast(ceil(many / {block}) as int)").alias("salts"))
    rows = rows.join(hot, "pair", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.expr("cast(pmod(xxhash64(rep), salts) as int)"))
    ties = rows.repartition("pair", "salt").sortWithinPartitions("pair", "salt").mapInArrow(_tied(least), "a long, b long")
    groups = components(ties)
    roots = groups.select("root").distinct()
    # Pairs stand as nodes below 0 that are no class; a class's own id may be below 0 as well.
    members = groups.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct().join(classes.select(F.col("rep").alias("node")), "node", "left_semi")
    size = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = members.join(size, "root").select(F.col("node").alias("rep"), "root", F.expr(f"cast(ceil(size / {block}) as int)").alias("blocks"))
    members = common.saved(members.withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)")), "members")

    own = members.join(classes.select("rep", "digest"), "rep").select(F.col("rep").alias("doc_id"), "digest", "root", "blocks", "block")

    def items_of(where: str) -> DataFrame:
        wanted = spark.sparkContext.broadcast(common.KeyFilter.of(members.where(where).select("rep"), "rep"))
        made = texts.mapInArrow(_items(wanted, n), "doc_id long, digest binary, items binary")
        # A repeated doc_id may hold other texts: the class's own is the one with its digest.
        made = made.join(own.where(where), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
        return made.select(F.col("doc_id").alias("rep"), "root", "blocks", "block", "items")

    share = (100, percent)
    found = items_of("blocks = 1").groupBy("root", "block").applyInArrow(_confirm_block(share, least, True), "rep long, root long").select(F.col("rep").alias("node"), F.col("root").alias("found"))
    many = members.where("blocks > 1")
    if not many.isEmpty():
        items = common.saved(items_of("blocks > 1"), "items")
        found = found.unionByName(_across_blocks(items, share, least).select("node", F.col("root").alias("found")))
    moved = classes.select("digest", "rep").join(found.where("node <> found"), F.col("rep") == F.col("node"), "left")
    # Written first: a plain join of two tables is one that adaptive execution can split where a class has very many copies.
    moved = common.saved(moved.select("digest", F.coalesce("found", "rep").alias("component")), "class-components")
    rows = signed.drop("sig")
    linked_rows = rows.where("digest is not null").join(moved, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    out = linked_rows.unionByName(rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose group has a smaller doc_id, all columns kept. Rows with a null doc_id stay."""
    made = linked(docs, n, percent, id_col, text_col)
    own = common.fresh("_gone", docs)
    gone = made.groupBy("doc_id").agg(F.max("kept").alias("any")).where("not any").select(F.col("doc_id").alias(own))
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(own), "left_anti")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(common.documents(spark, sf_dir), n=3, percent=85)


ORACLE = r"""
WITH RECURSIVE
words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (na + nb - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, r.seen FROM reach r JOIN edges e ON e.a = r.doc_id WHERE r.seen < e.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.seen) AS component_id, s.doc_id = min(r.seen) AS kept
FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, len(s.s)
"""
