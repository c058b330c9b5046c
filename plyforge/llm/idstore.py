"""A content-addressed store of token ids.

A document's ids, with the end id, are cut where a rolling hash over the last WINDOW ids has LOW_BITS zero bits (so that
equal passages cut alike wherever they stand), not below LEAST and not above MOST ids a chunk. Layout under a path:

- ``store/kind=chunk``: address (16 bytes of BLAKE2b over the payload) and payload, each address once: ids as little-endian
  integers of ``width`` bytes.
- ``store/kind=recipe`` and, dealt to parts in ascending order of doc_id, ``recipes``: doc_id, n_tokens, the addresses and
  sizes of its chunks, the root of the Merkle tree over its addresses, its part, and ``start``, the number of ids before it.
- ``manifest``: per part its range of doc_ids, its documents, its ids and the ids before it, the width of an id in bytes, and
  the root of the Merkle tree over its documents' roots, sizes and starts in ascending order.

Reading back checks the documents of every part against its root, every document's recipe against the document's root, every
payload against its address, and sizes against recipes; what does not match is an error.

Handling of odd input: a null text counts as empty and gives the end id alone; rows with equal or null doc_id stay, each
with a recipe, nulls first; an empty table makes an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.llm import common

WINDOW, LOW_BITS, LEAST, MOST = 8, 8, 64, 2048
KNOWN, KNOWN_CHUNKS = 1_000_000, 300_000
#: Stretches that the library gets as one text; the letter by which byte-level vocabularies write a space.
JOINED, SPACE = 100, "\u0120"

_STORE = "kind string, key long, address binary, payload binary, doc_id long, uid long, n_tokens long, recipe binary, sizes binary, root binary"


class Stretches:
    """Ids of texts by a byte-level BPE tokenizer of the tokenizers library.

    Every byte-level pre-tokenizer of this family begins a new piece at a single space between two characters that are no
    blanks, so the ids of a text are those of its stretches between such spaces in a row. The library encodes each distinct
    stretch that is not remembered once, some of them joined to one text; as the letter for a space begins the first token
    of a stretch and no other one, tokens with that letter show where the next stretch begins. Stretches with more spaces,
    those at the begin of a text and those that end in a blank are encoded one by one. Texts that contain an added token
    of the tokenizer go to the library whole, which finds it before anything is cut. So do all texts where the tokenizer's file
    names another pre-tokenizer, a normalizer or a prefix space, of which none of this is known.
    """

    def __init__(self, path: str):
        # A worker is one core's share: the library's own threads would only add memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuttable = _cuttable(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.type = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith(SPACE) for i in range(size)])
        #: Stretches remembered, how often each was met, and the place of its ids in ``ids``.
        self.known, self.uses = pa.array([], pa.large_binary()), np.zeros(0, np.int64)
        self.at, self.ids = np.zeros(1, np.int64), np.zeros(0, self.type)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, fresh: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the stretches, their ids one after another in it, and the number of ids of each."""
        bounds, data = _bounds(fresh)
        last = data[bounds[1:] - 1]
        regular = (data[bounds[:-1]] == 32) & (pc.count_substring(fresh, " ").to_numpy() == 1) & ~_BLANK[last]
        for i in np.flatnonzero(regular & (last >= 128)).tolist():
            regular[i] = not fresh[i].as_py().decode()[-1].isspace()
        own = np.flatnonzero(regular)
        bounds, data = _bounds(fresh.filter(pa.array(regular)))
        groups = np.append(np.arange(0, len(own), JOINED), len(own))
        cut = bounds[groups].tolist()
        ids, n = self._flat([data[i:j].tobytes().decode() for i, j in zip(cut, cut[1:])])
        # A group is cut by its tokens that begin with a space if it has as many of them as stretches.
        members = np.diff(groups)
        begins = self.begins[ids]
        sure = (np.add.reduceat(begins, np.cumsum(n) - n, dtype=np.int64) if len(n) else n) == members
        known, begins, ids = np.repeat(sure, members), begins[np.repeat(sure, n)], ids[np.repeat(sure, n)]
        others = np.concatenate([np.flatnonzero(~regular), own[~known]])
        more, sizes = self._flat([s.decode() for s in fresh.take(pa.array(others)).to_pylist()])
        return np.concatenate([own[known], others]), np.concatenate([ids, more]), np.concatenate([np.diff(np.flatnonzero(begins), append=len(ids)), sizes])

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and the number of ids of each."""
        coded = self._encoded(texts)
        n = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), self.type, int(n.sum())), n

    def _shrink(self) -> None:
        """Keep the stretches that were met most often, half of the table."""
        keep = np.sort(np.argpartition(self.uses, -KNOWN // 2)[-KNOWN // 2 :])
        sizes = np.diff(self.at)[keep]
        self.ids = self.ids[_runs(self.at[keep], sizes)]
        self.known, self.uses, self.at = self.known.take(pa.array(keep)), self.uses[keep] // 2, np.concatenate([[0], np.cumsum(sizes)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (strings, none null) one after another, and where each text's ids end."""
        if len(self.known) > KNOWN:
            self._shrink()
        special = np.full(len(texts), not self.cuttable)
        for token in self.added:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        bounds, data = _bounds(texts)
        data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
        cut = np.sort(np.concatenate([bounds, _spaces(data)]), kind="stable")
        cut = cut[np.diff(cut, prepend=-1) > 0]
        # Each text's first stretch; of texts with added tokens no stretch is looked up.
        first = np.searchsorted(cut, bounds)
        wanted = ~np.repeat(special, np.diff(first))
        stretches = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(data)])
        if special.any():
            stretches = stretches.filter(pa.array(wanted))
        coded = stretches.dictionary_encode()
        distinct, place = coded.dictionary, coded.indices.to_numpy()
        found = pc.index_in(distinct, self.known)
        missed = found.is_null().to_numpy(zero_copy_only=False)
        row = found.fill_null(0).to_numpy().astype(np.int64)
        if missed.any():
            fresh = distinct.filter(pa.array(missed))
            order, ids, sizes = self._new(fresh)
            row[np.flatnonzero(missed)[order]] = len(self.known) + np.arange(len(fresh))
            self.known, self.uses = pa.concat_arrays([self.known, fresh.take(pa.array(order))]), np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])
            self.ids, self.at = np.concatenate([self.ids, ids]), np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.uses[row] += np.bincount(place, minlength=len(distinct))
        rows = row[place]
        sizes = (self.at[1:] - self.at[:-1])[rows]
        ids = self.ids[_runs(self.at[rows], sizes)]
        total = np.zeros(len(cut), np.int64)
        total[1:][wanted] = sizes
        counts = np.diff(np.cumsum(total)[first])
        if special.any():
            whole = np.flatnonzero(special).tolist()
            made = {i: np.array(x, self.type) for i, x in zip(whole, self._encoded([texts[i].as_py() for i in whole]), strict=True)}
            parts = np.split(ids, np.cumsum(counts)[:-1])
            parts = [made.get(i, p) for i, p in enumerate(parts)]
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, np.cumsum(counts)


def _cuttable(path: str) -> bool:
    """Whether the tokenizer cuts texts by the byte-level expression alone, before it merges anything."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    before = told.get("pre_tokenizer") or {}
    return told.get("normalizer") is None and told["model"].get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then the same of the next one."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of strings."""
    texts = texts.cast(pa.large_binary())
    offsets, data = texts.buffers()[1:]
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return bounds, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


#: ASCII blanks; first bytes of the blanks beyond ASCII, which have two bytes (after 0xC2) or three.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_HEADS = np.zeros(256, bool)
_HEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _spaces(data: np.ndarray) -> np.ndarray:
    """Places of spaces that stand for certain between two characters that are no blanks; others join their stretches."""
    at = np.flatnonzero(data == 32)
    at = at[(at > 2) & (at < len(data) - 1)]
    after, before = data[at + 1], data[at - 1]
    # A character before that ends in 0x80 to 0xBF may be a blank if its first byte is one of theirs.
    odd = _BLANK[after] | _HEADS[after] | _BLANK[before] | (before >= 128) & (_HEADS[data[at - 2]] | _HEADS[data[at - 3]])
    return at[~odd]


#: A random number for the low bits of an id, and the factors of a place in the window.
_GEAR = (common.mixed(np.arange(1, (1 << 16) + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_FACTORS = [np.uint32(pow(0x9E3779B1, k, 1 << 32)) for k in range(WINDOW)]


def cuts(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Of each document (ends[i] is where i ends in ``ids``), the ends of its chunks, relative to its start."""
    values = _GEAR[ids & 0xFFFF]
    rolled = np.zeros(len(ids), np.uint32)
    for back in range(min(WINDOW, len(ids))):
        rolled[back:] += values[: len(values) - back] * _FACTORS[back]
    marks = np.flatnonzero(rolled >> np.uint32(32 - LOW_BITS) == 0) + 1
    starts = np.concatenate([[0], ends[:-1]])
    # The window must lie within the document.
    lows, highs = np.searchsorted(marks, starts + WINDOW, "left"), np.searchsorted(marks, ends, "left")
    out = []
    for start, end, a, b in zip(starts.tolist(), ends.tolist(), lows.tolist(), highs.tolist(), strict=True):
        at, mine = 0, []
        for mark in [m - start for m in marks[a:b].tolist()] + [end - start]:
            while mark - at > MOST:
                at += MOST
                mine.append(at)
            if mark - at >= LEAST or mark == end - start and mark > at:
                at = mark
                mine.append(at)
        out.append(mine)
    return out


def address(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle(nodes: list[bytes]) -> bytes:
    """The root over leaves, pairwise; an odd last node goes up as it is."""
    if not nodes:
        return address(b"")
    while len(nodes) > 1:
        nodes = [address(b"\1" + b"".join(nodes[i : i + 2])) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0]


def _key(address_: bytes) -> int:
    return int.from_bytes(address_[:8], "little", signed=True)


_opened: dict[str, Stretches] = {}


def _forget() -> None:
    _opened.clear()


def _cut_up(path: str, end_id: int):
    @common.task("idstore", _forget)
    def run(batches):
        # One per worker process: stretches stay known from task to task.
        if path not in _opened:
            _opened[path] = Stretches(path)
        encode = _opened[path]
        width = encode.type.itemsize
        task, row, seen = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            for part in common.slices(batch, "text"):
                ids, ends = encode(part.column("text"))
                ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
                coded, chunks, docs = ids.tobytes(), [], []
                uids = common.mixed(np.uint64(task << 40) | np.arange(row, row + len(ends), dtype=np.uint64)).view(np.int64)
                row += len(ends)
                for doc_id, uid, start, end, cut in zip(part.column("doc_id").to_pylist(), uids.tolist(), [0, *ends.tolist()], ends.tolist(), cuts(ids, ends), strict=False):
                    payloads = [coded[(start + a) * width : (start + b) * width] for a, b in zip([0, *cut], cut)]
                    addresses = list(map(address, payloads))
                    for a, p in zip(addresses, payloads, strict=True):
                        if a not in seen:
                            seen.add(a)
                            chunks.append((a, p))
                    sizes = struct.pack(f"<{len(cut)}i", *[len(p) // width for p in payloads])
                    docs.append((doc_id, uid, end - start, b"".join(addresses), sizes, merkle(addresses)))
                if len(seen) > KNOWN_CHUNKS:
                    seen.clear()
                c, d = len(chunks), len(docs)
                columns = [
                    pa.array(["chunk"] * c + ["recipe"] * d), pa.array([_key(a) for a, _ in chunks] + [x[1] for x in docs], pa.int64()),
                    pa.array([a for a, _ in chunks] + [None] * d, pa.binary()), pa.array([p for _, p in chunks] + [None] * d, pa.binary()),
                    *(pa.array([None] * c + [x[i] for x in docs], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "key", "address", "payload", "doc_id", "uid", "n_tokens", "recipe", "sizes", "root"])

    return run


def _once(batches):
    """Each chunk once: rows of one address follow each other."""
    last = None
    for batch in batches:
        at = batch.column("address")
        same = pc.equal(at, pa.concat_arrays([pa.array([last], pa.binary()), at.slice(0, len(at) - 1)])) if len(at) else pa.array([], pa.bool_())
        last = at[-1].as_py() if len(at) else last
        yield batch.filter(pc.invert(pc.fill_null(same, False)))


class Tree:
    """The root of the tree that ``merkle`` makes, from leaves that come one by one, in the memory of its height."""

    def __init__(self):
        self.open: list[bytes | None] = []

    def add(self, node: bytes) -> None:
        for level, left in enumerate(self.open):
            if left is None:
                self.open[level] = node
                return
            node, self.open[level] = address(b"\1" + left + node), None
        self.open.append(node)

    def root(self) -> bytes:
        node = None
        for left in self.open:
            if left is not None:
                node = left if node is None else address(b"\1" + left + node)
        return address(b"") if node is None else node


def _leaf(root: bytes, n_tokens: int, within: int) -> bytes:
    return address(b"\0" + root + struct.pack("<qq", n_tokens, within))


_PARTED = "kind string, part int, doc_id long, uid long, within long, n_tokens long, recipe binary, sizes binary, root binary, first_doc long, last_doc long, docs long"


def _parted(batches):
    """The recipes of a part with the ids of the part before each, and at the end a row about the part."""
    part, tree, within, docs, ends = TaskContext.get().partitionId(), Tree(), 0, 0, []
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        after = within + np.cumsum(n)
        for root, size, end in zip(batch.column("root").to_pylist(), n.tolist(), after.tolist(), strict=True):
            tree.add(_leaf(root, size, end - size))
        rows = batch.num_rows
        if rows:
            within, docs = int(after[-1]), docs + rows
            ends = [*ends[:1], batch.column("doc_id")[0].as_py(), batch.column("doc_id")[-1].as_py()]
            none = pa.nulls(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(["recipe"] * rows), pa.array(np.full(rows, part, np.int32)), batch.column("doc_id"), batch.column("uid"), pa.array(after - n), *(batch.column(c) for c in ("n_tokens", "recipe", "sizes", "root")), none, none, none], names=[f.split()[0] for f in _PARTED.split(", ")])
    if docs:
        row = ["part", part, None, None, None, within, None, None, tree.root(), ends[0], ends[-1], docs]
        types = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in _PARTED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[f.split()[0] for f in _PARTED.split(", ")])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write the store under ``path``, which every machine must see."""
    spark = docs.sparkSession
    texts = common.id_text(docs, id_col, text_col)
    made = texts.mapInArrow(_cut_up(tokenizer, end_id), _STORE)
    # Rows of one key meet in one partition and, sorted, follow each other.
    met = made.repartition("key").sortWithinPartitions("key", "address")
    met.mapInArrow(_once, _STORE).drop("key").write.partitionBy("kind").option("parquet.enable.dictionary", "false").parquet(f"{path}/store")

    found = _store(spark, path).where("kind = 'recipe'").select("doc_id", "uid", "n_tokens", "recipe", "sizes", "root")
    found.repartitionByRange("doc_id", "uid").sortWithinPartitions("doc_id", "uid").mapInArrow(_parted, _PARTED).write.partitionBy("kind").parquet(f"{path}/parted")
    parted = spark.read.schema(_PARTED.removeprefix("kind string, ") + ", kind string").parquet(f"{path}/parted")
    # As many rows as parts.
    parts = parted.where("kind = 'part'").select("part", "first_doc", "last_doc", "docs", F.col("n_tokens").alias("ids"), "root")
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts.withColumn("before", before).withColumn("width", F.lit(_width(tokenizer))).write.parquet(f"{path}/manifest")
    with_start = parted.where("kind = 'recipe'").join(manifest(spark, path).select("part", "before"), "part")
    with_start.select("part", "doc_id", "uid", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "recipe", "sizes", "root").write.parquet(f"{path}/recipes")


def _width(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, first_doc long, last_doc long, docs long, ids long, root binary, before long, width int").parquet(f"{path}/manifest")


def width_of(spark: SparkSession, path: str) -> int:
    """Bytes of an id, as the manifest has it; 2 of a store without documents."""
    return (manifest(spark, path).agg(F.max("width")).first()[0]) or 2


def _roots(batches):
    """(part, docs, ids, root) of parts whose documents follow each other."""
    part, tree, docs, ids = None, Tree(), 0, 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([docs], pa.int64()), pa.array([ids], pa.int64()), pa.array([tree.root()], pa.binary())], names=["part", "found_docs", "found_ids", "found_root"])
    for batch in batches:
        for p, root, n, start, before in zip(*(batch.column(c).to_pylist() for c in ("part", "root", "n_tokens", "start", "before")), strict=True):
            if p != part:
                if docs:
                    yield made()
                part, tree, docs, ids = p, Tree(), 0, 0
            tree.add(_leaf(root, n, start - (before or 0)))
            docs, ids = docs + 1, ids + n
    if docs:
        yield made()


def check_parts(spark: SparkSession, path: str) -> None:
    """Every part of the manifest has the documents of its root, in their order and at their places, and no part stands outside it."""
    told = manifest(spark, path)
    rows = recipes(spark, path).select("part", "doc_id", "uid", "root", "n_tokens", "start").join(told.select("part", "before"), "part", "left")
    found = rows.repartition("part").sortWithinPartitions("part", "doc_id", "uid").mapInArrow(_roots, "part int, found_docs long, found_ids long, found_root binary")
    same = F.col("root").eqNullSafe(F.col("found_root")) & F.col("ids").eqNullSafe(F.col("found_ids")) & F.col("docs").eqNullSafe(F.col("found_docs"))
    bad = told.join(found, "part", "full").where(~same).select("part").first()
    if bad is not None:
        raise ValueError(f"part {bad.part} does not match its Merkle root")


def _store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("address binary, payload binary, doc_id long, uid long, n_tokens long, recipe binary, sizes binary, root binary, kind string").parquet(f"{path}/store")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return _store(spark, path).where("kind = 'chunk'").select("address", "payload")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, doc_id long, uid long, start long, n_tokens long, recipe binary, sizes binary, root binary").parquet(f"{path}/recipes")


def _references(batches):
    """A row per chunk of each document, with the number of ids after it; roots are checked here."""
    for batch in batches:
        uids, ats, sizes, afters = [], [], [], []
        for uid, recipe, size, root in zip(*(batch.column(c).to_pylist() for c in ("uid", "recipe", "sizes", "root")), strict=True):
            addresses = [recipe[i : i + 16] for i in range(0, len(recipe), 16)]
            if merkle(addresses) != root:
                raise ValueError(f"a recipe does not match its Merkle root (uid {uid})")
            n = np.frombuffer(size, "<i4").astype(np.int64)
            uids += [uid] * len(n)
            ats += addresses
            sizes.append(n)
            afters.append(n.sum() - np.cumsum(n))
        yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(ats, pa.binary()), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(afters))], names=["uid", "address", "size", "after"])


def _facts(width: int):
    """CRC-32 and length of each payload, in ids of 4 bytes; payloads are checked against their addresses."""
    import zlib

    def run(batches):
        for batch in batches:
            payloads, at = batch.column("payload").to_pylist(), batch.column("address").to_pylist()
            if any(address(p) != a for p, a in zip(payloads, at, strict=True)):
                raise ValueError("a chunk does not match its address")
            crcs = [zlib.crc32(np.frombuffer(p, f"<u{width}").astype("<u4").tobytes()) for p in payloads]
            yield pa.RecordBatch.from_arrays([batch.column("address"), pa.array(crcs, pa.int64()), pa.array([len(p) // width for p in payloads], pa.int64())], names=["address", "crc", "n"])

    return run


def _sound(batches):
    for batch in batches:
        if any(address(p) != a for p, a in zip(batch.column("payload").to_pylist(), batch.column("address").to_pylist(), strict=True)):
            raise ValueError("a chunk does not match its address")
        yield batch


_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the CRC-32 polynomial, bits reflected."""
    out, b = np.zeros_like(a), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return out


def crc_before(crcs: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What blocks with these CRCs add (by xor) to the CRC of a stream in which ``after`` bytes follow them."""
    out, power, left = crcs.astype(np.uint32), np.array([1 << 23], np.uint32), after.astype(np.uint64)  # x**8
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        out[odd] = _times(out[odd], np.broadcast_to(power, out[odd].shape))
        power, left = _times(power, power), left >> np.uint64(1)
    return out


def _shares(batches):
    for batch in batches:
        crc, n = batch.column("crc"), batch.column("n")
        if crc.null_count or (n.to_numpy() != batch.column("size").to_numpy()).any():
            raise ValueError("a chunk is missing or not as long as its recipe says")
        share = crc_before(crc.to_numpy().astype(np.uint32), batch.column("after").to_numpy() * 4)
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(share.astype(np.int64)), n], names=["uid", "share", "n"])


def verified(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read from the store.

    Payloads are read once, where they lie: the CRC of a document is put together from its chunks' CRCs, so that only
    addresses travel, and a chunk that a third of all documents share is hashed once.
    """
    check_parts(spark, path)
    found = recipes(spark, path)
    refs = found.select("uid", "recipe", "sizes", "root").mapInArrow(_references, "uid long, address binary, size long, after long")
    facts = chunks(spark, path).mapInArrow(_facts(width_of(spark, path)), "address binary, crc long, n long")
    shares = refs.join(facts, "address", "left").mapInArrow(_shares, "uid long, share long, n long")
    docs = shares.groupBy("uid").agg(F.bit_xor("share").alias("ids_crc32"), F.sum("n").alias("n"))
    return found.select("doc_id", "uid", "start", "n_tokens").join(docs, "uid").select("doc_id", "start", F.col("n").alias("n_tokens"), "ids_crc32")


def reconstructed(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_le (little-endian, ``width_of`` bytes each): documents put together again, checked like ``verified``."""
    check_parts(spark, path)
    refs = recipes(spark, path).select("uid", "recipe", "sizes", "root").mapInArrow(_references, "uid long, address binary, size long, after long")
    parts = refs.join(chunks(spark, path).mapInArrow(_sound, "address binary, payload binary"), "address", "left").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct((-F.col("after")).alias("at"), F.hex(F.coalesce("payload", F.raise_error(F.lit("a chunk is missing")).cast("binary"))).alias("payload")))).alias("parts"))
    whole = parts.select("uid", F.unhex(F.array_join(F.col("parts.payload"), "")).alias("ids_le"))
    return recipes(spark, path).join(whole, "uid").select("doc_id", "start", "n_tokens", "ids_le")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.new_path(spark, "idstore")
    write(common.documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return verified(spark, path)
