"""Sum-of-squares online packing of documents into fixed windows of token ids.

Each task packs its own rows as they come. A document's full windows leave at once; its rest joins the open window of
the level (fill) h at which the sum of squared level counts becomes least, found over a level array. Windows that are
still open at the end of a partition are cut again and refilled in order, and the last ones are cut at powers of two,
at which sequences need no padding.

Defined results: a null or empty text is the end id alone; very long texts are whole, cut into full windows;
of equally good levels the lowest is taken; repeated rows, and rows with one id, are packed one by one; an empty table gives no rows; extra columns are not touched. Sequence ids are unique over the whole result (partition number in the high bits).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from genosieve.llm import bpe

WINDOW, END_ID = 2048, 1
_NAMES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Levels:
    """Open windows by fill, and the choice among them."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list] = [[] for _ in range(window)]  # by fill, the windows' pieces

    def place(self, size: int) -> int:
        """The level at which a piece of 1 to ``window`` - 1 ids goes; 0 is a new window. Ties: the fullest level."""
        top, n = self.window - size, self.count
        levels = np.flatnonzero(n[1 : top + 1])[::-1] + 1  # those with an open window, the fullest first
        if not len(levels):
            return 0
        # moving one window from h to h + size changes the sum of squares by 2 * (n[h + size] - n[h] + 1)
        twice = 2 * (n[levels + size] - n[levels]) + 2
        if levels[0] == top:
            twice[0] = 1 - 2 * n[top]  # a full window is no longer counted
        best = int(np.argmin(twice))
        return int(levels[best]) if twice[best] <= 2 * n[size] + 1 else 0  # a new window takes none away

    def add(self, piece: tuple, size: int) -> list | None:
        """Places a piece; returns the window if it is now full."""
        h = self.place(size)
        if h:
            pieces = self.open[h].pop()
            self.count[h] -= 1
        else:
            pieces = []
        pieces.append(piece)
        if h + size == self.window:
            return pieces
        self.open[h + size].append(pieces)
        self.count[h + size] += 1
        return None

    def rest(self) -> Iterator[list]:
        """Open windows, fullest first."""
        for level in reversed(self.open):
            yield from level


def _powers(n: int) -> Iterator[int]:
    for bit in reversed(range(n.bit_length())):
        if n >> bit & 1:
            yield 1 << bit


def pack_rows(docs: Iterator[tuple[object, np.ndarray]], first_sequence: int = 0, window: int = WINDOW) -> Iterator[tuple]:
    """(id, ids as unsigned 32-bit numbers) -> (id, start, length, crc32, doc_tokens, sequence_id, offset) in any order of documents."""
    levels, seq = Levels(window), first_sequence

    def sequence(pieces: list) -> Iterator[tuple]:
        nonlocal seq
        at = 0
        for key, start, ids, total in pieces:
            n = len(ids)
            yield key, start, n, zlib.crc32(ids), total, seq, at
            at += n
        seq += 1

    for key, ids in docs:
        total = len(ids)
        whole = total // window * window
        for start in range(0, whole, window):
            yield from sequence([(key, start, ids[start : start + window], total)])
        if total > whole and (full := levels.add((key, whole, ids[whole:].copy(), total), total - whole)):  # a copy, so that its batch can go
            yield from sequence(full)
    left = [p for w in levels.rest() for p in w]
    rest = sum(len(p[2]) for p in left)
    sizes = [window] * (rest // window) + list(_powers(rest % window))
    at, used = 0, 0  # piece, ids of it that are placed
    for size in sizes:
        pieces, room = [], size
        while room:
            key, start, ids, total = left[at]
            n = min(room, len(ids) - used)
            pieces.append((key, start + used, ids[used : used + n], total))
            used, room = used + n, room - n
            if used == len(ids):
                at, used = at + 1, 0
        yield from sequence(pieces)


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, end_id: int = END_ID, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. No shuffle."""
    path = tokenizer_path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[id_col, *_NAMES])

        rows, key_type = [], pa_type
        for row in pack_rows(bpe.encoded(batches, path, end_id), TaskContext.get().partitionId() << 40, window):
            rows.append(row)
            if len(rows) == 10_000:
                yield flush()
                rows = []
        if rows:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    pa_type = to_arrow_type(kind)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, " + ", ".join(f"{n} bigint" for n in _NAMES))
