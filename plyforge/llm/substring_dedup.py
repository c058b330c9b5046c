"""Substring dedup by automata of repeated phrases.

A window is SIZE consecutive words of a document. Of windows with the same words the first one stays (by doc_id, then by start);
every word that a later one covers goes. All windows are judged on the input.

1. Anchors. The anchor of a window is the least of the hashes of its runs of ANCHOR words (the leftmost, of equal ones): equal
   windows have equal anchors at equal places, so a window can only recur where its anchor does. One run of words is the
   anchor of several windows in a row, so there are far fewer anchors than windows. A first scan counts them.
2. Segments. A second scan cuts out the words around each occurrence of an anchor that stands more than once (a filter that
   never misses one picks them). A slice of a task sends each distinct segment once, with how often it stands there and where
   it stands first; the list of its occurrences stays behind in the written table. So no passage, however common, is
   more than one row a slice. An anchor with more than a stated number of occurrences (words that go before or behind many different
   ones) would bring too many segments to one place: its windows travel one by one, dealt out by all their words.
3. Automata. Segments meet by anchor. They come in order of their keys, and shards of about SHARD_BYTES of them confirm which
   passages recur there (whole segments where all of an anchor's are alike, single windows where they differ), compile those into an
   Aho-Corasick automaton over numbers of words, and stream all segments of the shard through it. Numbers stand for whole
   words, so a match is one of all bytes. The answer to a segment is which of its windows recur, and which of those stand first in the
   whole corpus.
4. Answers go back to the lists of occurrences, those to their rows, and rows without any never move.

The memory of a task is bounded by a slice of texts (or one text), or by a shard and the segments of one key. The filter of
anchors has up to 2**30 bits, sized by their number; where it is crowded, more segments travel and the result stays the same.

Handling of odd input: a null text has no words; texts of fewer words than a window stay; rows that share a doc_id, or have
none, are documents of their own in the order of their numbers, which are then given and written first, null before all others; an empty table gives an empty result;
other columns are ignored, or kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm import common

SIZE, ANCHOR = 20, 10
#: Stands for a null doc_id.
NO_ID = -(2**63)
ROW = "_row"
#: Bytes of segments that share an automaton; bytes of texts in a slice of a task.
SHARD_BYTES, SLICE_BYTES = 1 << 20, 4 << 20
#: Occurrences from which an anchor's windows travel one by one, at least, and how many anchors may be such.
HOT, MOST_HOT = 1000, 1 << 16


def runs_of(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` word hashes, from runs of powers of two."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, words, 1
    while True:
        if n & size:
            if out is None:
                out, done = power, size
            else:
                count = len(words) - done - size + 1
                out = common.mixed(out[:count] * common.M1 + power[done : done + count])
                done += size
        if done == n:
            return common.mixed(out + np.uint64(n))
        power = common.mixed(power[:-size] * common.M1 + power[size:])
        size *= 2


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """Places of the leftmost least of every ``n`` consecutive values."""
    best, at, have = values, np.arange(len(values)), 1
    while have < n:
        step = min(have, n - have)
        take = best[step:] < best[:-step]
        best, at = np.where(take, best[step:], best[:-step]), np.where(take, at[step:], at[:-step])
        have += step
    return at


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (strings, null for none) one after another, and how many each text has."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))  # splits at \x20 and \x09-\x0D
    words, real = pc.list_flatten(split), None
    counts = pc.list_value_length(split).to_numpy().astype(np.int64)
    empty = np.flatnonzero(pc.binary_length(words).to_numpy() == 0)  # before a first blank and after a last one
    if len(empty):
        counts -= np.bincount(np.searchsorted(np.cumsum(counts), empty, "right"), minlength=len(counts))
        real = np.ones(len(words), bool)
        real[empty] = False
        words = words.filter(pa.array(real))
    return words, counts


class Slice:
    """Words of a few texts in one row, their anchors, and the runs of windows that share one."""

    def __init__(self, texts: pa.Array, size: int, anchor: int):
        self.words, self.counts = split_words(texts)
        self.ends = np.cumsum(self.counts)
        self.grams, self.hashed = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at = self.low = self.high = np.zeros(0, np.int64)
        if len(self.words) < size:
            return
        coded = self.words.dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
        self.hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[coded.indices.to_numpy()]
        self.grams = runs_of(self.hashed, anchor)
        chosen = least_of(self.grams, size - anchor + 1)
        room = np.repeat(self.ends, self.counts)[: len(chosen)]
        starts = np.flatnonzero(np.arange(len(chosen)) + size <= room)
        if not len(starts):
            return
        chosen = chosen[starts]
        new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)])
        first = np.flatnonzero(new)
        self.at, self.low, self.high = chosen[first], starts[first], starts[np.append(first[1:], len(starts)) - 1]

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words with single spaces between them, and the place of each in that (one more at the end)."""
        offsets, data = self.words.buffers()[1:]
        bounds = np.frombuffer(offsets, np.int64)[self.words.offset : self.words.offset + len(self.words) + 1]
        size = np.diff(bounds)
        whole = np.full(int(bounds[-1] - bounds[0]) + len(size), 32, np.uint8)
        whole[np.arange(int(bounds[-1] - bounds[0])) + np.repeat(np.arange(len(size)), size)] = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        return whole.tobytes(), np.concatenate([[0], np.cumsum(size + 1)])

    def anchors(self) -> np.ndarray:
        return self.grams[self.at]


def _counted(size: int, anchor: int):
    @common.task("substring_dedup")
    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                keys, n = np.unique(Slice(part.column("text"), size, anchor).anchors(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return run


SEGMENTS = "seg long, key long, text binary, n long, first_doc long, first_row long, first_start int, rows array<long>, starts array<int>"


def _segments(wanted, size: int, anchor: int):
    """Distinct segments of a slice. ``wanted``: a filter of repeated anchors, and the sorted hot ones."""

    @common.task("substring_dedup")
    def run(batches):
        repeated, hot = wanted.value
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                s = Slice(part.column("text"), size, anchor)
                keys = s.anchors()
                on = np.flatnonzero(repeated.hits(keys)) if len(keys) else np.zeros(0, np.int64)
                keys, low, high = keys[on], s.low[on], s.high[on]
                many = np.isin(keys, hot)
                # Windows of hot anchors one by one.
                width = np.where(many, high - low + 1, 1)
                each = np.repeat(np.arange(len(low)), width)
                step = np.arange(len(each)) - np.repeat(np.cumsum(width) - width, width)
                low, high, keys, many = low[each] + step, np.where(many[each], low[each] + step, high[each]), keys[each], many[each]
                if many.any():
                    keys = keys.copy()
                    keys[many] = common.mixed(runs_of(s.hashed, size)[low[many]] + common.M2)
                doc = np.searchsorted(s.ends, low, "right")
                ids, rows = part.column("doc_id").fill_null(NO_ID).to_numpy()[doc], part.column(ROW).to_numpy()[doc]
                start = low - (s.ends - s.counts)[doc]
                # In the order of the corpus, so that the first of a list is the first in the slice.
                order = np.lexsort((start, rows, ids))
                found: dict[bytes, int] = {}
                if not len(order):
                    continue
                words, place = s.joined()
                texts, firsts, of = [], [], np.zeros(len(order), np.int64)
                for k, (a, b) in enumerate(zip(place[low[order]].tolist(), (place[high[order] + size] - 1).tolist(), strict=True)):
                    text = words[a:b]
                    number = found.setdefault(text, len(texts))
                    if number == len(texts):
                        texts.append(text)
                        firsts.append(k)
                    of[k] = number
                text_keys = keys[order[firsts]]
                by = np.argsort(of, kind="stable")
                n = np.bincount(of, minlength=len(texts))
                cuts = np.concatenate([[0], np.cumsum(n)])
                listed = order[by]
                first = listed[cuts[:-1]]
                offsets = pa.array(cuts.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((task << 33) + made + np.arange(len(texts))), pa.array(text_keys.view(np.int64)), pa.array(texts, pa.binary()), pa.array(n.astype(np.int64)),
                        pa.array(ids[first]), pa.array(rows[first]), pa.array(start[first].astype(np.int32)),
                        pa.ListArray.from_arrays(offsets, pa.array(rows[listed])), pa.ListArray.from_arrays(offsets, pa.array(start[listed].astype(np.int32))),
                    ],
                    names=["seg", "key", "text", "n", "first_doc", "first_row", "first_start", "rows", "starts"],
                )
                made += len(texts)

    return run


def recurring(ids: np.ndarray, starts: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Starts of one window of each sequence of numbers whose windows weigh two or more in all."""
    h = runs_of(common.mixed(ids.astype(np.uint64) + common.M3), size)[starts]
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    seen = np.lib.stride_tricks.sliding_window_view(ids, size)
    own = starts[first[back]]
    for at in range(0, len(starts), 1 << 16):  # hashes only sort; windows that differ from their group's first are grouped by themselves
        if (seen[starts[at : at + (1 << 16)]] != seen[own[at : at + (1 << 16)]]).any():
            _, first, back = np.unique(seen[starts], axis=0, return_index=True, return_inverse=True)
            back = back.ravel()
            break
    return starts[first[np.bincount(back, weights=weights) >= 2]]


def letters(ids: np.ndarray) -> tuple[str, int]:
    """Numbers as letters, and how many letters each has: digits of base 64, each place with letters of its own, so that a
    match begins with a number. The library looks through a node's branches one by one: a letter a word would give it
    as many branches as there are words.
    """
    digits = max(1, -(-int(ids.max(initial=0)).bit_length() // 6))
    out = np.empty((len(ids), digits), np.uint8 if digits <= 4 else np.uint32)
    for place in range(digits):
        out[:, place] = ((ids >> (6 * (digits - 1 - place))) & 63) + 64 * place
    return (out.tobytes().decode("latin-1") if digits <= 4 else out.tobytes().decode("utf-32-le")), digits


def answers(shard: pa.Table, size: int) -> pa.RecordBatch | None:
    """(seg, recurs, firsts): bits of the windows of a segment that recur, and of those that are the first in the corpus."""
    coded = shard.column("text").combine_chunks().dictionary_encode()
    of = coded.indices.to_numpy().astype(np.int64)  # the text of each segment; equal ones of several slices are one
    n = shard.column("n").to_numpy()
    weight = np.bincount(of, weights=n, minlength=len(coded.dictionary)).astype(np.int64)
    doc, row, start = (shard.column(c).to_numpy() for c in ("first_doc", "first_row", "first_start"))
    order = np.lexsort((start, row, doc))
    _, leader = np.unique(of[order], return_index=True)
    leader = order[leader]  # the first segment of each text
    words, length = split_words(coded.dictionary.cast(pa.string()))
    begin = np.cumsum(length + 1) - (length + 1)
    # Words by number, and a number that no word has between texts.
    numbers = np.zeros(int(length.sum()) + len(length), np.int64)
    numbers[np.arange(len(words)) + np.repeat(np.arange(len(length)), length)] = words.dictionary_encode().indices.to_numpy() + 1
    width = length - size + 1
    key = shard.column("key").to_numpy()[leader]
    _, place, alike = np.unique(key, return_inverse=True, return_counts=True)
    alone = alike[place] == 1  # no other text has the key, and so none of its windows
    mixed = np.flatnonzero(~alone)
    text = np.repeat(mixed, width[mixed])
    starts = np.arange(len(text)) - np.repeat(np.cumsum(width[mixed]) - width[mixed], width[mixed]) + begin[text]
    passages = np.flatnonzero(alone & (weight >= 2))
    patterns = recurring(numbers, starts, weight[text], size) if len(starts) else starts
    starts, sizes = np.concatenate([begin[passages], patterns]), np.concatenate([length[passages], np.full(len(patterns), size)])
    if not len(starts):
        return None
    automaton, (whole, digits) = ahocorasick.Automaton(ahocorasick.STORE_INTS), letters(numbers)
    for i, (a, b) in enumerate(zip((starts * digits).tolist(), ((starts + sizes) * digits).tolist(), strict=True)):
        automaton.add_word(whole[a:b], i)
    automaton.make_automaton()
    hits = np.fromiter((x for hit in automaton.iter(whole) for x in hit), np.int64).reshape(-1, 2)
    sizes = sizes[hits[:, 1]]
    at = (hits[:, 0] + 1) // digits - sizes
    # The windows of a passage, each a pattern of its own.
    each = np.repeat(np.arange(len(at)), sizes - size + 1)
    within = np.arange(len(each)) - np.repeat(np.cumsum(sizes - size + 1) - (sizes - size + 1), sizes - size + 1)
    at, pattern = at[each] + within, hits[each, 1] * (int(length.max()) + 1) + within
    text = np.searchsorted(begin, at, "right") - 1
    offset = at - begin[text]
    who = leader[text]
    order = np.lexsort((start[who] + offset, row[who], doc[who]))
    _, first = np.unique(pattern[order], return_index=True)
    first = order[first]
    bits = np.int64(1) << offset
    recurs, firsts = np.zeros(len(length), np.int64), np.zeros(len(of), np.int64)
    np.bitwise_or.at(recurs, text, bits)
    np.bitwise_or.at(firsts, who[first], bits[first])
    recurs = recurs[of]
    say = np.flatnonzero((recurs != 0) & ((n > 1) | (recurs != firsts)))
    return pa.RecordBatch.from_arrays([pa.array(shard.column("seg").to_numpy()[say]), pa.array(recurs[say]), pa.array(firsts[say])], names=["seg", "recurs", "firsts"])


def _answered(size: int, shard_bytes: int):
    """Segments in the order of their keys to shards of whole keys, and to answers."""

    @common.task("substring_dedup")
    def run(batches):
        held, held_bytes = [], 0
        for batch in batches:
            keys = batch.column("key").to_numpy()
            sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
            ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
            at = 0
            if held and held[-1].num_rows and held[-1].column("key")[-1].as_py() != keys[0] and held_bytes >= shard_bytes:
                if (made := answers(pa.Table.from_batches(held), size)) is not None:
                    yield made
                held, held_bytes = [], 0
            for end in ends[:-1].tolist():  # the last key may go on in the next batch
                if held_bytes + int(sizes[end - 1] - (sizes[at - 1] if at else 0)) >= shard_bytes:
                    held.append(batch.slice(at, end - at))
                    if (made := answers(pa.Table.from_batches(held), size)) is not None:
                        yield made
                    held, held_bytes, at = [], 0, end
            held.append(batch.slice(at))
            held_bytes += int(sizes[-1] - (sizes[at - 1] if at else 0)) if len(sizes) else 0
        if held and (made := answers(pa.Table.from_batches(held), size)) is not None:
            yield made

    return run


def removals(rows: DataFrame, size: int = SIZE, anchor: int = ANCHOR, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(row, gone): per row of ``rows`` (doc_id, text, row number), the windows to be removed, as (start << size) + bits.

    Bit k of an entry stands for the window that begins k words after its start.
    """
    spark = rows.sparkSession
    counts = rows.mapInArrow(_counted(size, anchor), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    repeated = common.saved(counts, "anchors")
    found = repeated.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    # Anchors with n / MOST_HOT occurrences or more are MOST_HOT at most.
    most = max(hot, found.n // MOST_HOT + 1)
    hots = np.sort(repeated.where(F.col("n") > most).select("key").toArrow().column("key").to_numpy().view(np.uint64))
    wanted = spark.sparkContext.broadcast((common.KeyFilter.of(repeated, "key", min(30, max(16, (8 * found.keys).bit_length()))), hots))
    segments = common.saved(rows.mapInArrow(_segments(wanted, size, anchor), SEGMENTS), "segments", "zstd")
    met = segments.drop("rows", "starts").repartition("key").sortWithinPartitions("key")
    answered = met.mapInArrow(_answered(size, shard_bytes), "seg long, recurs long, firsts long")
    listed = segments.select("seg", "rows", "starts").join(answered, "seg")
    # The first occurrence in a slice is spared where it is the first in the corpus.
    each = F.transform(F.arrays_zip("rows", "starts"), lambda x, i: F.struct(x["rows"].alias("row"), F.shiftleft(x["starts"].cast("long"), size).bitwiseOR(F.when(i == 0, F.col("recurs").bitwiseAND(F.bitwise_not("firsts"))).otherwise(F.col("recurs"))).alias("gone")))
    return listed.select(F.explode(each).alias("x")).where(F.expr(f"x.gone % {1 << size} <> 0")).groupBy("x.row").agg(F.collect_list("x.gone").alias("gone"))


def kept(text: str | None, gone: list[int] | None, size: int = SIZE) -> tuple[list[bytes], int]:
    """(words that stay, number of words)."""
    words = (text or "").encode().split()
    if not gone:
        return words, len(words)
    entries = np.array(gone, np.int64)
    starts = np.concatenate([(entries[(entries >> k) & 1 == 1] >> size) + k for k in range(size)])
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    covered = np.cumsum(change[:-1]) > 0
    return [w for w, c in zip(words, covered.tolist(), strict=True) if not c], len(words)


def _with_gone(docs: DataFrame, id_col: str, text_col: str, gone: str, **how) -> DataFrame:
    """``docs`` with a column of windows to be removed; only rows that have some are shuffled."""
    row, id_ = common.fresh(ROW, docs), F.col(f"`{id_col}`").cast("long")
    told = docs.select(id_.alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).first()
    # Ids that tell rows apart are numbers of rows; others get some, which a written table keeps.
    docs = docs.withColumn(row, id_) if told.n == told.ids else common.saved(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    rows = docs.select(id_.alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{row}`").alias(ROW))
    found = common.saved(removals(rows, **how), "removals")
    return common.with_found(docs, row, found.select("row", F.col("gone").alias(gone))).drop(row)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the words that stay, joined by single spaces; texts that lose none, and null ones, stay as they are."""
    gone, size = common.fresh("_gone", docs), how.get("size", SIZE)

    @common.task("substring_dedup")
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [t if t is None or not g else b" ".join(kept(t, g, size)[0]).decode() for t, g in zip(batch.column(at).to_pylist(), batch.column(gone).to_pylist(), strict=True)]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.select([n for n in batch.schema.names if n != gone])

    return _with_gone(docs, id_col, text_col, gone, **how).mapInArrow(run, docs.schema)


def digests(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by single spaces)."""
    size = how.get("size", SIZE)

    @common.task("substring_dedup")
    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                made = [kept(t, g, size) for t, g in zip(part.column("text").to_pylist(), part.column("_gone").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array([n - len(w) for w, n in made], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in made])], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_gone(common.id_text(docs), "doc_id", "text", "_gone", **how).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts),
windows AS (
  SELECT doc_id, pos, word, string_agg(word, ' ') OVER f AS win, count(*) OVER f AS n
  FROM words WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
later AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS again FROM windows WHERE n = 20),
marked AS (
  SELECT w.doc_id, w.pos, w.word, coalesce(bool_or(again) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM windows w LEFT JOIN later l ON l.doc_id = w.doc_id AND l.pos = w.pos),
made AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS t
  FROM marked GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN made USING (doc_id)
"""
