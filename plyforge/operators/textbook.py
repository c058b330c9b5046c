"""Boards printed in books: two ways of drawing them, read back as FEN; marks, sections and sentinels of book texts.

A drawing is a border, eight ranks of eight cells and what belongs to it (labels, a caption). ``STYLES`` says how each is
drawn; one scanner reads all of them, line by line, as a drawing ends where its lines end. A block that does not hold eight
whole ranks stays in the text as it is.

Null texts give no boards and stay null; texts of any length are read line by line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions.dialect import DUCK, SPARK, Dialect
from plyforge.operators.features import decoded, picked
from plyforge.operators.moves import per_row
from plyforge.plans.registry import register
from plyforge.sources.positions import POSITIONS_SQL, positions

#: What a cell holds in either way of drawing (fixed values).
CARET = {"^P": "P", "^Kt": "N", "^N": "N", "^B": "B", "^R": "R", "^Q": "Q", "^K": "K", "#P": "p", "#Kt": "n", "#N": "n", "#B": "b", "#R": "r", "#Q": "q", "#K": "k"}
STARRED = {c: c for c in "PNBRQK"} | {f"{c}*": c.lower() for c in "PNBRQK"}


@dataclass(frozen=True)
class Style:
    border: re.Pattern
    between: re.Pattern
    rank: re.Pattern
    cells: dict[str, str]
    #: Lines that belong to the drawing after its border, and where its caption stands.
    after: re.Pattern
    caption: re.Pattern
    caption_above: bool
    opening: re.Pattern | None = None


STYLES = (
    Style(re.compile(r"\s*\+?-{30,}\+?\s*"), re.compile(r"\s*\|-+\|.*"), re.compile(r"\s*\d\s*\|(.*)\|\s*"), CARET, re.compile(r"\s+[A-Ha-h](\s+[A-Ha-h]){7}\s*|\s*"), re.compile(r"(?i)diag(?:ram)?\.?\s*\d+\.?"), False),
    Style(re.compile(r"\s*\+(?:---\+){8}\s*"), re.compile(r"\s*\+(?:---\+){8}\s*"), re.compile(r"\s*\|(.*)\|\s*"), STARRED, re.compile(r"\s*WHITE\.\s*"), re.compile(r"(?i)(No\.|Diagram)\s*(\d+)"), True, re.compile(r"\s*BLACK\.\s*")),
)


@dataclass(frozen=True)
class Board:
    fen: str
    caption: str
    #: Lines of the text from ``first`` to before ``last`` are the drawing.
    first: int
    last: int


def rank_text(cells: list[str], known: dict[str, str]) -> str | None:
    """Eight cells as a rank of a FEN; what is not a piece is an empty square."""
    if len(cells) != 8:
        return None
    row = "".join(known.get(c.strip(), ".") for c in cells)
    return re.sub(r"\.+", lambda m: str(len(m[0])), row)


def _read(lines: list[str], at: int, style: Style) -> Board | None:
    """The drawing whose border is line ``at``."""
    ranks, i = [], at + 1
    while i < len(lines) and len(ranks) < 8:
        if (m := style.rank.fullmatch(lines[i])) and (rank := rank_text(m[1].split("|"), style.cells)) is not None:
            ranks.append(rank)
        elif not style.between.fullmatch(lines[i]) and not style.border.fullmatch(lines[i]):
            break
        i += 1
    if len(ranks) < 8:
        return None
    if i < len(lines) and style.border.fullmatch(lines[i]):
        i += 1
    while i < len(lines) and style.after.fullmatch(lines[i]):
        i += 1
    first, caption = at, ""
    if style.opening:
        k = at - 1
        while k >= 0 and not lines[k].strip():
            k -= 1
        if k < 0 or not style.opening.fullmatch(lines[k]):
            return None
        first = k
    if style.caption_above:
        # Four lines back at most, over blank ones and the opening.
        for k in range(at - 1, max(at - 5, -1), -1):
            if m := style.caption.search(lines[k]):
                caption = f"{'No.' if m[1].lower() == 'no.' else 'Diagram'} {m[2]}"
                break
            if lines[k].strip() and not style.opening.fullmatch(lines[k]):
                break
    elif i < len(lines) and (m := style.caption.search(lines[i])):
        caption, i = m[0].strip(), i + 1
    return Board(f"{'/'.join(ranks)} w - - 0 1", caption, first, i)


def boards(text: str) -> list[Board]:
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        found = next((b for s in STYLES if s.border.fullmatch(lines[i]) and (b := _read(lines, i, s))), None)
        if found:
            out.append(found)
        i = found.last if found else i + 1
    return out


def mark(board: Board) -> str:
    return f"[Position{f' ({board.caption})' if board.caption else ''}: {board.fen}]"


def marked(text: str) -> str:
    """The text with a mark in place of each drawing."""
    lines, out, at = text.split("\n"), [], 0
    for b in boards(text):
        out += [*lines[at : b.first], mark(b)]
        at = b.last
    return "\n".join(out + lines[at:])


MARKED = re.compile(r"\[Position(?:\s*\(([^)]*)\))?: (.+)\]")


def diagrams(text: str, budget: int = 1500) -> list[tuple[str, str, str, str]]:
    """(fen, caption, text before, text after) of each mark: whole lines, nearest first, until they hold ``budget`` characters."""
    lines = marked(text).split("\n")

    def near(order) -> list[str]:
        size, out = 0, []
        for line in order:
            if size >= budget:
                break
            out.append(line)
            size += len(line) + 1
        return out

    found = ((i, m) for i, line in enumerate(lines) if (m := MARKED.fullmatch(line)))
    return [(m[2].strip(), m[1] or "", "\n".join(near(reversed(lines[:i]))[::-1]).strip(), "\n".join(near(lines[i + 1 :])).strip()) for i, m in found]


# -- drawings of the test positions, in both dialects --


def _cell(d: Dialect, style: int) -> str:
    piece = d.at("(r * 8 + f)")
    if style:
        return f"CASE WHEN {piece} = '.' THEN '   ' WHEN upper({piece}) = {piece} THEN ' ' || {piece} || ' ' ELSE ' ' || upper({piece}) || '*' END"
    token = f"CASE WHEN upper({piece}) = {piece} THEN '^' ELSE '#' END || CASE upper({piece}) WHEN 'N' THEN 'Kt' ELSE upper({piece}) END"
    return f"CASE WHEN {piece} = '.' THEN '    ' ELSE rpad(' ' || {token}, 4, ' ') END"


def drawn(d: Dialect, style: int, ranks: str = "8") -> str:
    """The board ``b`` as a drawing of ``ranks`` ranks."""
    border = "+" + "---+" * 8 if style else "     +" + "-" * 39 + "+"
    between = border if style else "     |" + "-" * 39 + "|"
    row = d.join(d.map(d.seq(0, 8), "f", _cell(d, style)), "|")
    number = "'|'" if style else "'   ' || cast(r + 1 as string) || ' |'"
    rows = d.join(d.map(d.reverse(d.seq(f"8 - {ranks}", "8")), "r", f"{number} || {row} || '|'"), f"\\n{between}\\n" if d.spark else f"\n{between}\n")
    newline = "'\\n'" if d.spark else "chr(10)"
    return f"'{border}' || {newline} || {rows} || {newline} || '{border}'"


def page(d: Dialect) -> str:
    """A text with a drawing: either way by the key's parity, a seventh of them without their last rank."""
    nl = "'\\n'" if d.spark else "chr(10)"
    ranks = "(CASE WHEN pos_id % 7 = 3 THEN 7 ELSE 8 END)"
    no = "cast(pos_id as string)"
    starred = f"'No. ' || {no} || '.' || {nl} || {nl} || 'BLACK.' || {nl} || {drawn(d, 1, ranks)} || {nl} || 'WHITE.'"
    caret = f"{drawn(d, 0, ranks)} || {nl} || '       A   B   C   D   E   F   G   H' || {nl} || {nl} || 'Diag. ' || {no} || '.'"
    return f"'White to play, as in game ' || {no} || '.' || {nl} || CASE WHEN pos_id % 2 = 0 THEN {starred} ELSE {caret} END || {nl} || 'The move is easily found.'"


_READ = "placement || ' w - - 0 1'"
_WHOLE = "pos_id % 7 <> 3"
_MARK = f"'[Position (' || CASE WHEN pos_id % 2 = 0 THEN 'No. ' || pos_id ELSE 'Diag. ' || pos_id || '.' END || '): ' || {_READ} || ']'"
_BEFORE = "'White to play, as in game ' || pos_id || '.'"
_ABOVE = f"{_BEFORE} || CASE WHEN pos_id % 2 = 0 THEN chr(10) || 'No. ' || pos_id || '.' || chr(10) ELSE '' END"
_DUCK = DUCK.decoded(f"({POSITIONS_SQL})")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos_id, text: a page a position."""
    return decoded(positions(spark, sf_dir)).selectExpr("pos_id", f"{page(SPARK)} AS text")


def page_query(key: str, outputs: str, sql: str, explode: str | None = None):
    def put(fn):
        def run(spark, sf_dir):
            rows = per_row(pages(spark, sf_dir), ["text"], outputs, fn).drop("text")
            return rows.select("pos_id", F.explode(explode).alias("x")).select("pos_id", "x.*") if explode else rows

        register(key, sql)(run)
        return fn

    return put


def _first(text: str, style: int) -> tuple[str | None, str | None]:
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if STYLES[style].border.fullmatch(line) and (b := _read(lines, i, STYLES[style])):
            return b.fen, b.caption
    return None, None


@page_query("x01_board_plain", "fen_read string, caption string", f"SELECT pos_id, CASE WHEN pos_id % 2 = 1 AND {_WHOLE} THEN {_READ} END AS fen_read, CASE WHEN pos_id % 2 = 1 AND {_WHOLE} THEN 'Diag. ' || pos_id || '.' END AS caption FROM {_DUCK}")
def board_plain(text):
    """Boards of numbered ranks with carets and hashes; nothing where a page has none."""
    return _first(text, 0)


@page_query("x02_board_ruled", "fen_read string, caption string", f"SELECT pos_id, CASE WHEN pos_id % 2 = 0 AND {_WHOLE} THEN {_READ} END AS fen_read, CASE WHEN pos_id % 2 = 0 AND {_WHOLE} THEN 'No. ' || pos_id END AS caption FROM {_DUCK}")
def board_ruled(text):
    """Boards in a ruled grid with starred pieces; the caption stands up to four lines above."""
    return _first(text, 1)


@page_query("x04_boards_replaced", "marked string", f"SELECT pos_id, CASE WHEN {_WHOLE} THEN {_ABOVE} || chr(10) || {_MARK} || chr(10) || 'The move is easily found.' ELSE {page(DUCK)} END AS marked FROM {_DUCK}")
def boards_replaced(text):
    return (marked(text),)


@page_query("x05_diagrams", "d array<struct<fen_read: string, caption: string, text_before: string, text_after: string>>", f"SELECT pos_id, {_READ} AS fen_read, CASE WHEN pos_id % 2 = 0 THEN 'No. ' || pos_id ELSE 'Diag. ' || pos_id || '.' END AS caption, rtrim({_ABOVE}, chr(10)) AS text_before, 'The move is easily found.' AS text_after FROM {_DUCK} WHERE {_WHOLE}", explode="d")
def page_diagrams(text):
    return ([dict(zip(("fen_read", "caption", "text_before", "text_after"), d, strict=True)) for d in diagrams(text)],)


def placement(rows: str) -> str:
    """SQL of eight ranks joined by slashes, dots for empty squares, as a FEN's placement: runs of dots become their length."""
    for n in range(8, 0, -1):
        rows = f"replace({rows}, '{'.' * n}', '{n}')"
    return rows


@register("x03_ranks_to_fen", f"SELECT pos_id, {_READ} AS fen_read FROM {_DUCK}")
def ranks_to_fen(spark, sf_dir):
    """Eight ranks, the last one first, and the tail of a FEN that a drawing cannot know."""
    rows = " || '/' || ".join(f"substr(b, {r * 8 + 1}, 8)" for r in range(7, -1, -1))
    return decoded(positions(spark, sf_dir)).selectExpr("pos_id", f"{placement(rows)} || ' w - - 0 1' AS fen_read")


#: A position's mark in a text, and a mark without a position that is taken out (fixed values).
POSITION = r"\[Position(?:[^\]]*?):\s*([^\]]+)\]"
SENTINEL, TIMES = "<|vision_pad|>", 65
_RUN = SENTINEL * TIMES


def sentinels(text, times: int = TIMES):
    """(text, positions): each mark becomes ``times`` sentinels, and its FEN is listed; marks of lost diagrams go."""
    fens = F.transform(F.regexp_extract_all(text, F.lit(POSITION), F.lit(1)), lambda x: F.trim(x))
    return F.regexp_replace(F.regexp_replace(text, POSITION, SENTINEL.replace("|", r"|") * times), r"(?i)\[pgndiagram\]", ""), fens


_TWO = "'A [Position: ' || fen || '] b [PGNDiagram] c [Position (No. ' || pos_id || '): ' || fen || ' ] d ' || {0}"


@register("x06_sentinels", f"SELECT pos_id, 'A {_RUN} b  c {_RUN} d ' || pos_id AS text, [fen, fen] AS fens FROM ({POSITIONS_SQL})")
def with_sentinels(spark, sf_dir):
    rows = positions(spark, sf_dir).withColumn("t", F.expr(_TWO.format("cast(pos_id as string)")))
    text, fens = sentinels(F.col("t"))
    return rows.select("pos_id", text.alias("text"), fens.alias("fens"))


def sections(text):
    """A text cut before each heading of two or three hashes; the whole text where it has none."""
    return F.split(text, r"(?m)(?=^#{2,3} )")


@register("x07_sections", "SELECT conv_id, s.i - 1 AS k, s.t AS section FROM (SELECT conv_id, unnest(list_transform(range(1, n + 1), lambda i: {'i': i, 't': CASE WHEN i < n THEN t[i] || chr(10) ELSE t[i] END})) AS s FROM (SELECT conv_id, count(*) AS n, list(CASE WHEN turn % 2 = 0 THEN '## ' ELSE '### ' END || role || chr(10) || coalesce(text, '') ORDER BY turn) AS t FROM conversations GROUP BY conv_id))")
def conversation_sections(spark, sf_dir):
    """Conversations written as one text with a heading a turn, and cut into sections again."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    head = F.concat(F.when(F.col("turn") % 2 == 0, "## ").otherwise("### "), "role", F.lit("\n"), F.coalesce("text", F.lit("")))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", head.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return whole.select("conv_id", F.posexplode(F.filter(sections(F.col("text")), lambda x: x != "")).alias("k", "section")).select("conv_id", F.col("k").cast("long").alias("k"), "section")
