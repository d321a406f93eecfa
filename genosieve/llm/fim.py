"""Fill-in-the-middle: documents cut in three and put together again with the middle last.

Cuts are drawn in units of a text (lines, or single code points) and made in its UTF-8 bytes. A text's exception index
holds its multibyte characters alone: their byte positions, code-point positions and running excess bytes. A binary search
over it turns a code-point cut into a byte cut and back; what lies between the exceptions is arithmetic, so a text
without any needs no index at all.

Draws are a hash of a seed and the document's id, so they do not depend on partitions, retries or order.

Defined results: a null text counts as empty; an empty text, a text that holds one of the marks, and a document that the
rate leaves out are ``plain``: they stay as they are and have no cuts. A null id draws as an empty one. Texts of any length
are cut whole; repeated rows are cut alike; columns of the input that are not named are not touched; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

MARKS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
#: Texts cut at once: so many bytes, or one text.
BATCH_BYTES = 8 << 20
_NAMES = ("n", "form", "prefix_chars", "middle_chars", "output")


class ExceptionIndex:
    """Multibyte characters of UTF-8 bytes: ``byte`` and ``char`` are their positions, ``excess`` the bytes that they and all
    before them have beyond one."""

    def __init__(self, data: np.ndarray):
        self.byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.byte]
        self.excess = np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0).astype(np.int64))
        self.char = self.byte - np.concatenate([[0], self.excess[:-1]]) if len(lead) else self.byte

    def _before(self, positions: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Excess bytes of the exceptions that lie before each cut."""
        at = np.searchsorted(positions, cuts, side="left")
        return np.where(at > 0, self.excess[at - 1], 0) if len(self.excess) else np.zeros_like(cuts)

    def to_bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Byte positions of code-point positions."""
        return cuts + self._before(self.char, cuts)

    def to_chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code-point positions of byte positions, which stand between characters."""
        return cuts - self._before(self.byte, cuts)


def cut(data: np.ndarray, first: int, second: int, unit: str = "line") -> tuple[int, tuple[int, int], tuple[int, int]]:
    """(units n, byte cuts, code-point cuts): the lesser and the greater of ``first`` and ``second`` modulo n + 1 units."""
    index = ExceptionIndex(data)
    if unit == "char":
        n = len(data) - int(index.excess[-1] if len(index.excess) else 0)
        chars = np.sort(np.array([first % (n + 1), second % (n + 1)], np.int64))
        places = index.to_bytes(chars)
    else:  # lines: up to and with a line feed, and what follows the last one
        ends = np.flatnonzero(data == 10) + 1
        if len(data) and (not len(ends) or ends[-1] < len(data)):
            ends = np.append(ends, len(data))
        n = len(ends)
        places = np.concatenate([[0], ends])[np.sort([first % (n + 1), second % (n + 1)])]
        chars = index.to_chars(places)
    return n, tuple(places.tolist()), tuple(chars.tolist())


def draws(id_col: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _rows(batch: pa.RecordBatch, unit: str, rate: int, spm_rate: int) -> Iterator[tuple]:
    """(n, form, prefix characters, middle characters, output) of the batch's texts; columns text and four draws."""
    text = pc.fill_null(batch.column(1), "")
    held = pc.equal(text, "")
    for mark in MARKS:
        held = pc.or_(held, pc.match_substring(text, mark))
    p, s, m = (x.encode() for x in MARKS)
    raw = text.cast(pa.binary())
    for value, plain, h1, h2, h3, h4 in zip(raw, held.to_pylist(), *(batch.column(i).to_pylist() for i in range(2, 6))):
        t = value.as_py()
        n, (a, b), (ca, cb) = cut(np.frombuffer(t, np.uint8), h1, h2, unit)
        if plain or h3 % 100 >= rate:
            yield n, "plain", None, None, t
        elif h4 % 100 < spm_rate:
            yield n, "spm", ca, cb - ca, b"".join((s, t[b:], p, t[:a], m, t[a:b]))
        else:
            yield n, "psm", ca, cb - ca, b"".join((p, t[:a], s, t[b:], m, t[a:b]))


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, unit: str = "line", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row; no shuffle.

    ``rate`` per cent of the documents are cut, ``spm_rate`` per cent of those with the suffix first. ``unit`` is ``line`` or
    ``char``.
    """
    if unit not in ("line", "char"):
        raise ValueError("unit is line or char")
    kind = docs.schema[id_col].dataType
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + BATCH_BYTES, side="right")))
                part = batch.slice(at, to - at)
                cols = list(zip(*_rows(part, unit, rate, spm_rate)))
                made = [pa.array(c, t) for c, t in zip(cols, types[1:])]
                made[-1] = made[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=[id_col, *_NAMES])
                at = to

    cols = docs.select(id_col, F.col(f"`{text_col}`"), *(h.alias(f"h{i}") for i, h in enumerate(draws(id_col, seed))))
    return cols.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The exact text of an output. Its parts hold no mark, so the first of each mark is the one that was put in."""
    out, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    p, s, m = MARKS
    before, middle = F.substring_index(out, m, 1), F.substring_index(out, m, -1)  # a mark stands once
    psm = F.concat(F.substring_index(F.substring_index(before, s, 1), p, -1), middle, F.substring_index(before, s, -1))
    spm = F.concat(F.substring_index(before, p, -1), middle, F.substring_index(F.substring_index(before, p, 1), s, -1))
    return F.when(form == "plain", out).when(form == "psm", psm).when(form == "spm", spm)
