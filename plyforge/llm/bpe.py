"""Byte-level BPE encoding and decoding with DuckDB recursive queries, one database per task.

Encoding. A text is cut by the vocabulary's pattern; the pieces a task has not seen before become token-position rows. A
recursive query joins each pair of neighbours with the merge table (every way to put two tokens together to a third,
under the rank of the third), contracts the leftmost pair of least rank of each piece, and goes on until no piece has a
pair left. Decoding joins ids with the vocabulary and concatenates in order, by ordered aggregation.

Pieces of more than LONG_PIECE bytes (unbroken runs of letters, digits, signs or blanks) take as many rounds as they have
merges, each over all their rows; the same merges are done on them with a heap instead, in O(n log n).

Handling of odd input: a null text counts as empty and gives no ids; repeated rows are encoded each; an empty table gives
an empty result; other columns are ignored. Texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import tempfile

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from plyforge.llm import common

LONG_PIECE = 256
#: Pieces that a worker remembers, ids of a decoding query, pieces of an encoding query.
KNOWN_PIECES, DECODE_IDS, ENCODE_PIECES = 700_000, 200_000, 30_000

ENCODE = """
WITH RECURSIVE state(step, piece, pos, tok) AS (
  SELECT 0, piece, pos, tok FROM pieces
  UNION ALL
  (WITH pairs AS (
     SELECT step, piece, pos, tok,
            lead(tok) OVER (PARTITION BY piece ORDER BY pos) AS after,
            lag(pos) OVER (PARTITION BY piece ORDER BY pos) AS before
     FROM state),
   least AS (
     SELECT piece, min(made::BIGINT << 32 | pos) AS best
     FROM pairs JOIN merges ON pair = (tok::BIGINT << 32 | after) GROUP BY piece)
  SELECT step + 1, piece, pos, CASE WHEN pos = (best & 4294967295) THEN (best >> 32)::INTEGER ELSE tok END
  FROM pairs JOIN least USING (piece)
  WHERE before IS DISTINCT FROM (best & 4294967295))
)
SELECT piece, list(tok ORDER BY pos) AS ids
FROM state JOIN (SELECT piece, max(step) AS step FROM state GROUP BY piece) USING (piece, step)
GROUP BY piece
"""

DECODE = """
SELECT doc, string_agg(chars, '' ORDER BY pos) AS chars FROM tokens JOIN vocabulary USING (id) GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Bpe:
    """One vocabulary with its merge table in a database of this process."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        pairs, made = [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    made.append(rank)
        self.merges = dict(zip(pairs, made, strict=True))
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.byte_ids = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": False, "temp_directory": os.path.join(tempfile.gettempdir(), f"bpe-{os.getpid()}")})
        self.db.register("_merges", pa.table({"pair": pa.array(pairs, pa.int64()), "made": pa.array(made, pa.int32())}))
        self.db.register("_vocabulary", pa.table({"id": pa.array(list(self.bytes_of), pa.int32()), "chars": pa.array([t.decode("latin-1") for t in self.bytes_of.values()], pa.string())}))
        self.db.execute("CREATE TABLE merges AS FROM _merges")
        self.db.execute("CREATE TABLE vocabulary AS FROM _vocabulary")
        self.type = np.uint16 if max(self.bytes_of) < 1 << 16 else np.int32
        self.decimal = list(map(str, range(max(self.bytes_of) + 1)))
        self.known: dict[str, bytes] = {}

    def _sql_pieces(self, pieces: list[str]) -> None:
        coded = [p.encode() for p in pieces]
        n = np.fromiter(map(len, coded), np.int64, len(coded))
        tok = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        if len(tok) and tok.min() < 0:
            raise ValueError("the vocabulary lacks single bytes that occur in the text")
        pos = np.arange(len(tok)) - np.repeat(np.cumsum(n) - n, n)
        self.db.register("pieces", pa.table({"piece": pa.array(np.repeat(np.arange(len(n), dtype=np.int32), n)), "pos": pa.array(pos.astype(np.int32)), "tok": pa.array(tok)}))
        got = self.db.sql(ENCODE).to_arrow_table()
        self.db.unregister("pieces")
        ids = got.column("ids").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        flat, cut = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
        flat, width = memoryview(flat.astype(self.type).tobytes()), np.dtype(self.type).itemsize
        for piece, a, b in zip(got.column("piece").to_pylist(), (cut[:-1] * width).tolist(), (cut[1:] * width).tolist(), strict=True):
            self.known[pieces[piece]] = bytes(flat[a:b])

    def _heap_piece(self, piece: str) -> np.ndarray:
        """The same contractions by a heap of (rank, place) over a linked list."""
        tok = self.byte_ids[np.frombuffer(piece.encode(), np.uint8)].tolist()
        n = len(tok)
        left, right, live = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        rank = lambda i: self.merges.get(tok[i] << 32 | tok[right[i]]) if right[i] < n else None
        heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not live[i] or rank(i) != r:
                continue
            j = right[i]
            tok[i], live[j], right[i] = r, False, right[j]
            if right[j] < n:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and (made := rank(k)) is not None:
                    heapq.heappush(heap, (made, k))
        return np.array([t for t, ok in zip(tok, live, strict=True) if ok], np.int32)

    def learn(self, pieces: set[str]) -> None:
        """Encode what is not known yet."""
        new = list(pieces)
        short = [p for p in new if len(p) <= LONG_PIECE // 4 or len(p.encode()) <= LONG_PIECE]
        for p in set(new).difference(short):
            self.known[p] = self._heap_piece(p).astype(self.type).tobytes()
        for at in range(0, len(short), ENCODE_PIECES):
            self._sql_pieces(short[at : at + ENCODE_PIECES])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        cut = [self.split(t) for t in texts]
        new: set[str] = set()
        for pieces in cut:
            new.update(set(pieces).difference(self.known))
        self.learn(new)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), self.type) for pieces in cut]

    def decimal_text(self, ids: np.ndarray) -> str:
        return " ".join(map(self.decimal.__getitem__, ids.tolist()))

    def decode(self, docs: list[np.ndarray]) -> list[bytes]:
        """The bytes of each document's ids, by ordered aggregation over about DECODE_IDS ids at a time."""
        out: list[list[bytes]] = [[] for _ in docs]
        part, size = [], 0
        for d, ids in enumerate(docs):
            for at in range(0, len(ids), DECODE_IDS):
                part.append((d, ids[at : at + DECODE_IDS]))
                size += len(part[-1][1])
                if size >= DECODE_IDS:
                    self._decode(part, out)
                    part, size = [], 0
        if part:
            self._decode(part, out)
        return [b"".join(x) for x in out]

    def _decode(self, part, out) -> None:
        n = np.array([len(ids) for _, ids in part])
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.db.register("tokens", pa.table({"doc": np.repeat(np.arange(len(part), dtype=np.int32), n), "pos": pos.astype(np.int32), "id": np.concatenate([ids for _, ids in part]).astype(np.int32)}))
        got = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("tokens")
        chars = got.column("chars").to_pylist()
        for k in np.argsort(got.column("doc").to_numpy()).tolist():
            out[part[got.column("doc")[k].as_py()][0]].append(chars[k].encode("latin-1"))


_open: dict[tuple[str, str], Bpe] = {}


def _forget() -> None:
    _open.clear()


def opened(path: str, pattern: str) -> Bpe:
    """One per worker process and vocabulary: pieces stay known from task to task."""
    if (path, pattern) not in _open:
        _open[path, pattern] = Bpe(path, pattern)
    return _open[path, pattern]


def run_encode(path: str, pattern: str, finish):
    @common.task("bpe", _forget)
    def run(batches):
        bpe = opened(path, pattern)
        for batch in batches:
            for part in common.slices(batch, "text"):
                coded = bpe.encode(part.column("text").to_pylist())
                yield finish(bpe, part.column("doc_id"), coded, bpe.decode(coded))

    return run


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, and the bytes that the ids decode to, one row per row of ``docs``."""

    def finish(bpe, doc_ids, coded, decoded):
        n = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.concatenate(coded).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat, pa.int32()))
        return pa.RecordBatch.from_arrays([doc_ids, ids, pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return common.id_text(docs, id_col, text_col).mapInArrow(run_encode(path, pattern, finish), "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and if asked for ids, one row per row of ``docs``."""
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def finish(bpe, doc_ids, coded, decoded):
        columns = [doc_ids, pa.array(list(map(len, coded)), pa.int64()), pa.array([sha(bpe.decimal_text(ids).encode()) for ids in coded], pa.string()), pa.array([sha(b) for b in decoded], pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))])
            columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(coded).astype(np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return common.id_text(docs, id_col, text_col).mapInArrow(run_encode(path, pattern, finish), schema)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
