"""Byte-level BPE ids of whole texts, remembered by chunk.

A byte-level pre-tokenizer always breaks before a single space that stands between two non-space characters, so a text
cut there gives the same ids as the whole text. Chunks recur far more often than texts: a column of texts is cut and
numbered by Arrow, each distinct chunk goes through the tokenizers library once per worker (as long as the bounded memory
lasts), and the ids are gathered by the chunks' numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of chunks and their ids that a Python worker remembers; beyond that, those not met since the last time go.
MEMORY = 48 << 20
#: Texts encoded at once: so many bytes, or one text.
BATCH_BYTES = 3 << 20
#: Before a chunk that no space precedes, and the chunk that stands for the end of a text. Texts that hold one of these
#: control characters go through the library whole.
_BARE, _STOP = "\x01", "\x02"
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A word of letters alone is one pre-token; punctuation between it and a space is another.
_WORD, _ENDED = r"^\x01?\pL+$", r"(\pL)([\pP\pS]+) "
_ENCODERS: dict[tuple, "ChunkEncoder"] = {}


def _alphabet() -> dict[int, str]:
    """Byte -> character of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows at 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places first, first + 1, … of every span, one span after another."""
    stops = np.cumsum(count, dtype=np.int64)
    at = np.repeat((first - (stops - count)).astype(np.int32), count)
    at += np.arange(len(at), dtype=np.int32)
    return at


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, each text's followed by the end id if there is one."""

    def __init__(self, path: str, end_id: int | None = None):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = Tokenizer.from_file(path)  # the same model over single words in its byte alphabet
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.alphabet = _alphabet()
        self.letters = {b: c for b, c in self.alphabet.items() if b not in (10, 13)}
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.end = np.array([] if end_id is None else [end_id], "<u4")
        self.known = pa.array(["\n", _STOP])  # chunks, and where their ids are in the store
        self.first, self.count = np.array([0, 1]), np.array([1, len(self.end)], np.int32)
        self.store = np.concatenate([np.array([self.newline], "<u4"), self.end])
        self.met, self.bad = np.ones(2, bool), np.zeros(2, bool)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Nulls count as empty texts, which have no ids of their own."""
        ids, ends = self.column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids end)."""
        self._forget()
        texts = pc.fill_null(texts, "")
        marks = pc.equal(texts, "")
        for x in (_BARE, _STOP, *self.special):
            marks = pc.or_(marks, pc.match_substring(texts, x))
        careful = marks.to_numpy(zero_copy_only=False)
        plain = pc.if_else(marks, "", texts) if careful.any() else texts
        # cut at every space, around every line feed and before punctuation that ends a word; where a chunk then touches
        # more white space, its text is cut again with care
        plain = pc.binary_join_element_wise(_BARE, pc.replace_substring(plain, "\n", " \n " + _BARE), " " + _STOP, "")
        cut = pc.split_pattern(pc.replace_substring_regex(plain, _ENDED, r"\1 " + _BARE + r"\2 "), " ")
        bounds, at = cut.offsets.to_numpy(), self._places(cut.values)
        if self.bad[at].any():
            careful[np.searchsorted(bounds, np.flatnonzero(self.bad[at]), side="right") - 1] = True
        n = self.count[at]
        ids, ends = self.store[_spans(self.first[at], n)], np.cumsum(n, dtype=np.int64)[bounds[1:] - 1]
        if not careful.any():
            return ids, ends
        mended = np.flatnonzero(careful)
        parts, last, sizes = [], 0, np.diff(ends, prepend=0)
        for i, own in zip(mended.tolist(), self._with_care(texts.take(pa.array(mended)).to_pylist())):
            parts += [ids[last : ends[i] - sizes[i]], own, self.end]
            last, sizes[i] = ends[i], len(own) + len(self.end)
        return np.concatenate([*parts, ids[last:]]), np.cumsum(sizes)

    def _with_care(self, texts: list[str]) -> list[np.ndarray]:
        """Texts cut only at single spaces between two other characters."""
        cut = [_CUT.split(_BARE + t) if t and _BARE not in t and _STOP not in t else [] for t in texts]
        at = self._places(pa.array([w for c in cut for w in c], pa.string()))
        out, i = [], 0
        for t, c in zip(texts, cut):
            own = at[i : i + len(c)]
            i += len(c)
            if c and not self.bad[own].any():
                out.append(self.store[_spans(self.first[own], self.count[own])])
            else:
                out += self._library([t])
        return out

    def _library(self, chunks: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _places(self, chunks: pa.Array) -> np.ndarray:
        """Places of chunks among the known ones, new ones learnt."""
        numbered = pa.concat_arrays([self.known, chunks]).dictionary_encode()
        old = len(self.known)
        if len(numbered.dictionary) > old:
            self._learn(numbered.dictionary.slice(old))
        at = numbered.indices.slice(old).to_numpy()
        self.met[at] = True
        return at

    def _learn(self, chunks: pa.Array) -> None:
        """Adds distinct new chunks. Words of letters go through the model in its byte alphabet, all in a row; others go
        through the library one by one; chunks that begin or end with white space are marked, and have no ids."""
        body = pc.utf8_ltrim(chunks, _BARE)
        bad = pc.or_(pc.equal(body, ""), pc.not_equal(pc.utf8_trim_whitespace(body), body)).to_numpy(zero_copy_only=False)
        word = pc.match_substring_regex(chunks, _WORD).to_numpy(zero_copy_only=False)
        count = np.zeros(len(chunks), np.int32)
        pools, order = [self.store], []
        if word.any():
            mapped = "\n".join(chunks.filter(pa.array(word)).to_pylist()).replace(_BARE, "\r").encode().decode("latin-1").translate(self.letters)
            gap, stop = self.alphabet[32], self.alphabet[10]
            text = ("\n" + mapped).replace("\n", f" {stop} {gap}").replace(gap + "\r", "") + f" {stop}"
            ids = np.asarray(self.model.encode_batch_fast([text[3:]], add_special_tokens=False)[0].ids, "<u4")
            breaks = ids == self.newline
            count[word] = np.diff(np.flatnonzero(breaks), prepend=-1) - 1
            pools.append(ids[~breaks])
            order.append(np.flatnonzero(word))
        rest = ~word & ~bad
        if rest.any():
            found = self._library([w[1:] if w[0] == _BARE else " " + w for w in chunks.filter(pa.array(rest)).to_pylist()])
            count[rest] = list(map(len, found))
            pools += found
            order.append(np.flatnonzero(rest))
        first = np.zeros(len(chunks), np.int64)
        at = np.concatenate(order) if order else np.zeros(0, np.int64)
        first[at] = np.cumsum(count[at]) - count[at] + len(self.store)
        self.known = pa.concat_arrays([self.known, chunks])
        self.first, self.count, self.store = np.concatenate([self.first, first]), np.concatenate([self.count, count]), np.concatenate(pools)
        self.bad, self.met = np.concatenate([self.bad, bad]), np.concatenate([self.met, np.ones(len(bad), bool)])

    def _forget(self) -> None:
        if self.known.nbytes + self.store.nbytes + 14 * len(self.count) < MEMORY:
            return
        if self.met[2:].mean() > 0.5:
            self.met[:] = False
        self.met[:2] = True  # the line feed and the end
        kept = pa.array(self.met)
        self.known, n = self.known.filter(kept), self.count[self.met]
        self.store = self.store[_spans(self.first[self.met], n)]
        self.first, self.count = np.cumsum(n, dtype=np.int64) - n, n
        self.bad, self.met = self.bad[self.met], np.zeros(len(n), bool)


def encoder(path: str, end_id: int | None = None) -> ChunkEncoder:
    """One per worker process and file; tasks that reuse the worker reuse what it remembers."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = ChunkEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[object, np.ndarray]]:
    """(id, its text's ids with the end id) of (id, text) batches, a bounded number of bytes at a time."""
    enc = encoder(path, end_id)
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        reach, at = np.cumsum(size), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + BATCH_BYTES, side="right")))
            part = batch.slice(at, to - at)
            ids, ends = enc.column(part.column(1))
            start = 0
            for key, stop in zip(part.column(0).to_pylist(), ends.tolist()):
                yield key, ids[start:stop]
                start = stop
            at = to
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
