"""Expressions over boards as text, in the words of Spark SQL or of DuckDB.

A board is a string ``b`` of 64 characters in square order (a1, b1, ... h8), a dot where a square is empty. All features of
a position are expressions over it: no rows are exploded and nothing is shuffled.
"""

from __future__ import annotations


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def seq(self, a, b) -> str:
        """a, a+1, ... b-1 (at least one element)."""
        return f"sequence({a}, {b} - 1)" if self.spark else f"range({a}, {b})"

    def _fn(self, ours: str, theirs: str, array: str, var: str, body: str) -> str:
        return f"{ours}({array}, {var} -> {body})" if self.spark else f"{theirs}({array}, lambda {var}: {body})"

    def filter(self, array, var, body):
        return self._fn("filter", "list_filter", array, var, body)

    def map(self, array, var, body):
        return self._fn("transform", "list_transform", array, var, body)

    def any(self, array, var, body):
        return f"{self.size(self.filter(array, var, body))} > 0" if not self.spark else f"exists({array}, {var} -> {body})"

    def size(self, array):
        return f"size({array})" if self.spark else f"len({array})"

    def join(self, array, sep):
        return f"array_join({array}, '{sep}')" if self.spark else f"array_to_string({array}, '{sep}')"

    def sort(self, array):
        return f"array_sort({array})" if self.spark else f"list_sort({array})"

    def array(self, *items):
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def get(self, array, i):
        """Element i from 0; null beyond the end."""
        return f"get({array}, {i})" if self.spark else f"({array})[{i} + 1]"

    def split(self, text, sep):
        return f"split({text}, '{sep}')" if self.spark else f"string_split({text}, '{sep}')"

    def reverse(self, array):
        return f"reverse({array})" if self.spark else f"list_reverse({array})"

    def concat(self, *arrays):
        return f"concat({', '.join(arrays)})" if self.spark else f"list_concat({', '.join(arrays)})" if len(arrays) == 2 else f"list_concat({arrays[0]}, {self.concat(*arrays[1:])})"

    def sum(self, array):
        return f"aggregate({array}, 0, (acc, x) -> acc + x)" if self.spark else f"coalesce(list_sum({array}), 0)::INTEGER"

    def div(self, a, b):
        return f"cast({a} div {b} as int)" if self.spark else f"({a} // {b})::INTEGER"

    def int(self, x):
        return f"cast({x} as int)"

    def round_even(self, x, digits=0):
        return f"bround({x}, {digits})" if self.spark else f"round_even({x}, {digits})"

    # -- boards --

    def at(self, square) -> str:
        return f"substr(b, {square} + 1, 1)"

    def file(self, s) -> str:
        return f"({s} % 8)"

    def rank(self, s) -> str:
        return self.div(s, 8)

    def name(self, s) -> str:
        return f"(substr('abcdefgh', {s} % 8 + 1, 1) || cast({self.div(s, 8)} + 1 as string))"

    def where(self, pieces: str, var: str = "s") -> str:
        """Squares that hold one of the letters, ascending; those of pawns are columns of the decoded table."""
        return {"P": "wp", "p": "bp"}.get(pieces) or self._where(pieces, var)

    def _where(self, pieces: str, var: str = "s") -> str:
        if self.spark and len(pieces) == 1:
            # Most pieces stand once or twice on a board; only the others are worth a look at every square.
            first = f"instr(b, '{pieces}')"
            return f"CASE {self.count(pieces)} WHEN 0 THEN array() WHEN 1 THEN array({first} - 1) WHEN 2 THEN array({first} - 1, locate('{pieces}', b, {first} + 1) - 1) ELSE {self._searched(pieces, var)} END"
        return self._searched(pieces, var)

    def _searched(self, pieces: str, var: str) -> str:
        return self.filter(self.seq(0, 64), var, f"instr('{pieces}', {self.at(var)}) > 0")

    def count(self, piece: str) -> str:
        return f"(64 - length(replace(b, '{piece}', '')))"

    def piece_name(self, letter: str) -> str:
        names = " ".join(f"WHEN '{p}' THEN '{n}'" for p, n in zip("pnbrqk", ("pawn", "knight", "bishop", "rook", "queen", "king"), strict=True))
        return f"CASE lower({letter}) {names} END"

    def colour(self, letter: str) -> str:
        return f"CASE WHEN {letter} = '.' THEN 'none' WHEN upper({letter}) = {letter} THEN 'white' ELSE 'black' END"

    def value(self, letter: str) -> str:
        return f"CASE lower({letter}) WHEN 'p' THEN 1 WHEN 'n' THEN 3 WHEN 'b' THEN 3 WHEN 'r' THEN 5 WHEN 'q' THEN 9 ELSE 0 END"

    def material(self, white: bool) -> str:
        c = str.upper if white else str.lower
        return "(" + " + ".join(f"{v} * {self.count(c(p))}" for p, v in zip("pnbrq", (1, 3, 3, 5, 9), strict=True)) + ")"

    def decoded(self, source: str) -> str:
        """A table expression with the fields of the FEN, the board ``b`` and the squares of pawns."""
        return f"""(
 SELECT *, {self._where("P")} AS wp, {self._where("p")} AS bp FROM {self.board(source)})"""

    def board(self, source: str) -> str:
        """A table expression with the fields of the FEN and the board ``b``."""
        rows = "placement"
        for n in range(8, 0, -1):
            rows = f"replace({rows}, '{n}', '{'.' * n}')"
        fields = self.split("fen", " ")
        part = lambda i: self.get("f", i)
        return f"""(
  SELECT *, {self.join(self.reverse(self.split(rows, '/')), '')} AS b FROM (
    SELECT *, {part(0)} AS placement, {part(1)} AS turn, coalesce({part(2)}, '-') AS castling, coalesce({part(3)}, '-') AS ep,
           cast(coalesce({part(4)}, '0') as int) AS halfmove, cast(coalesce({part(5)}, '1') as int) AS fullmove
    FROM (SELECT *, {fields} AS f FROM {source})))"""


SPARK, DUCK = Dialect(True), Dialect(False)
