"""Chat formatting by columnar byte assembly.

A batch of turns becomes one Arrow string column: the lengths of all segments (header, role, separator, text, footer) give
cumulative offsets, the offsets give the place of every byte, and headers and contents are scattered into one buffer
allocated once. The loss mask (assistant texts) comes from the same offsets.

Template. A turn of an assistant is ``<s>role[ROLE]text</s>``, any other ``[INST]role[ROLE]text[/INST]``. In roles and texts
a backslash is doubled, and a control string gets a backslash after its first character, so that none stays whole; taking
``\\x`` for ``x`` gives the text back.

Long conversations come in parts of about PART_BYTES; rows stream in order of (conversation, turn), so no conversation is
held whole, however long. A single text takes a few times its bytes; formatted, it must stay below 2 GB, as any value of a row. One conversation is one text, and its digest a hash in order, so its rows pass through one task. Handling of odd input: a null role or text counts as empty; rows that repeat a turn stay, ordered by role and
text; a null conv_id is a conversation of its own; null turns come first; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm import common

#: The template's control strings (fixed values).
CONTROL = ("[INST]", "[/INST]", "[ROLE]", "<s>", "</s>")
OPEN, CLOSE, OPEN_REPLY, CLOSE_REPLY, SEP = b"[INST]", b"[/INST]", b"<s>", b"</s>", b"[ROLE]"
PART_BYTES = 4 << 20
#: Bytes that are placed or counted at a time, with two or three numbers each.
STEP = 1 << 20
FORMATTED = "conv_id long, part long, n_turns long, text string, loss_from array<int>, loss_to array<int>"

_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"(\[INST\]|<s>)(.*?)\[ROLE\](.*?)(?:\[/INST\]|</s>)", re.S)


def escaped(column: pa.Array) -> pa.Array:
    column = pc.replace_substring(column, "\\", "\\\\")
    for mark in CONTROL:
        column = pc.replace_substring(column, mark, mark[0] + "\\" + mark[1:])
    return column


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _scatter(out: np.ndarray, starts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy segment i of ``data`` to ``out`` at starts[i]: one index per byte, STEP bytes at a time, source order kept."""
    shift = starts - offsets[:-1]
    for a in range(0, len(data), STEP):
        b = min(a + STEP, len(data))
        first, last = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
        lengths = np.diff(np.clip(offsets[first : last + 1], a, b))
        out[np.arange(a, b) + np.repeat(shift[first:last], lengths)] = data[a:b]


def points_at(out: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Code points before each of the byte places: bytes that don't continue a character, counted STEP bytes at a time."""
    order = np.argsort(places, kind="stable")
    ranked, found, before = places[order], np.zeros(len(places), np.int64), 0
    for a in range(0, max(1, len(out)), STEP):
        counts = np.concatenate([[0], np.cumsum((out[a : a + STEP] & 0xC0) != 0x80)])
        low, high = np.searchsorted(ranked, a, "left"), np.searchsorted(ranked, a + STEP, "left")
        found[order[low:high]] = before + counts[np.minimum(ranked[low:high] - a, len(counts) - 1)]
        before += int(counts[-1])
    rest = np.searchsorted(ranked, max(1, -(-len(out) // STEP)) * STEP, "left")
    found[order[rest:]] = before
    return found


def assembled(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, ends of turns, starts and ends of texts), all in bytes."""
    reply = pc.equal(roles, "assistant").to_numpy(zero_copy_only=False).astype(bool)
    (role, role_at), (text, text_at) = _bytes(escaped(roles)), _bytes(escaped(texts))
    head = np.where(reply, len(OPEN_REPLY), len(OPEN))
    foot = np.where(reply, len(CLOSE_REPLY), len(CLOSE))
    role_n, text_n = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(head + role_n + len(SEP) + text_n + foot)
    starts = np.concatenate([[0], ends[:-1]])
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for chosen, mark in ((reply, OPEN_REPLY), (~reply, OPEN)):
        out[starts[chosen][:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    _scatter(out, starts + head, role, role_at)
    sep = starts + head + role_n
    out[sep[:, None] + np.arange(len(SEP))] = np.frombuffer(SEP, np.uint8)
    text_from = sep + len(SEP)
    _scatter(out, text_from, text, text_at)
    text_to = text_from + text_n
    for chosen, mark in ((reply, CLOSE_REPLY), (~reply, CLOSE)):
        out[text_to[chosen][:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    return out, ends, text_from, text_to


def _format(part_bytes: int):
    def run(batches):
        last, part = (), 0
        for batch in batches:
            for rows in common.slices(batch, "text", part_bytes):
                ids = rows.column("conv_id")
                key = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, ids.fill_null(0).to_numpy()), ids.is_null().to_numpy(zero_copy_only=False)
                new = np.concatenate([[True], (np.diff(key[0]) != 0) | (np.diff(key[1].astype(np.int8)) != 0)])
                first = np.flatnonzero(new)
                stop = np.concatenate([first[1:], [len(ids)]])
                out, ends, text_from, text_to = assembled(rows.column("role"), rows.column("text"))
                begin = np.concatenate([[0], ends])[first]
                offsets = np.concatenate([begin, ends[-1:]]).astype(np.int32)
                strings = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(out))
                reply = np.flatnonzero(pc.equal(rows.column("role"), "assistant").to_numpy(zero_copy_only=False))
                conv = np.searchsorted(first, reply, "right") - 1
                base = points_at(out, begin)[conv]
                cut = np.searchsorted(conv, np.arange(len(first) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array((points_at(out, x[reply]) - base).astype(np.int32))) for x in (text_from, text_to)]
                parts = []
                for i in first.tolist():
                    now = (ids[i].as_py(),)
                    part = part + 1 if now == last else 0
                    last = now
                    parts.append(part)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(parts, pa.int64()), pa.array(stop - first, pa.int64()), strings, *lists], names=["conv_id", "part", "n_turns", "text", "loss_from", "loss_to"])

    return run


def turns(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))


def formatted(conversations: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """conv_id, part, n_turns, text, loss_from, loss_to: the parts of each conversation, joined in order, are its text.

    loss_from and loss_to are the spans of assistant texts, in code points of the part, end exclusive.
    """
    ordered = turns(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_format(part_bytes), FORMATTED)


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in formatted text."""
    return [(unescaped(m[2]), unescaped(m[3])) for m in _TURN.finditer(text)]


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches):
    """Parts in order to a row per conversation; hashes go on from part to part."""
    now, state = None, None

    def row():
        return [now[0], state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["length"]]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        rows = []
        ids, texts, spans_from, spans_to = (batch.column(c) for c in ("conv_id", "text", "loss_from", "loss_to"))
        for i in range(batch.num_rows):
            if now != (ids[i].as_py(),):
                if now is not None:
                    rows.append(row())
                now, state = (ids[i].as_py(),), {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "length": 0}
            text = texts[i].as_py()
            for role, said in read_back(text):
                state["turns"] += 1
                state["all"].update(f"{role}\n{said}\n".encode())
            for a, b in zip(spans_from[i].as_py(), spans_to[i].as_py(), strict=True):
                said = unescaped(text[a:b])
                state["chars"] += len(said)
                state["loss"].update(said.encode())
            state["length"] += len(text)
        if rows:
            yield out(rows)
    if now is not None:
        yield out([row()])


def digests(written: DataFrame) -> DataFrame:
    """What the formatted table says, read back: a row per conversation."""
    return written.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_digest, DIGESTS)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(common.saved(formatted(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")).unionByName(own)), "chat"))


_ESC = "x"
for _a, _b in (("\\", "\\\\"), *((m, m[0] + "\\" + m[1:]) for m in CONTROL)):
    _ESC = f"replace({_ESC}, '{_a}', '{_b}')"

ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
coded AS (
  SELECT *, length({_ESC.replace("(x,", "(role,")}) + length({_ESC.replace("(x,", "(text,")}) AS inner_chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(inner_chars + CASE WHEN role = 'assistant' THEN 13 ELSE 19 END)::BIGINT AS formatted_chars
FROM coded GROUP BY conv_id
"""
