"""Alignment of two tokenizers' tokens over the same bytes.

Tokenizer A is a byte-level BPE of the tokenizers library and reads a space and the text; B is a SentencePiece model that
adds the space itself. Their spans (A's character offsets, B's byte spans of the library's proto) give coarse token ends;
where a span is not as long as the token's decoded bytes, as within a multibyte character, among byte-fallback tokens and
around trimmed spaces, ends are refined from the decoded bytes. Ends that both have cut a text into groups; tokens whose byte
ranges overlap are links.

Neither tokenizer joins a character and the space after it, so both end before every single space that stands between
two other characters. A text is cut there, and each distinct chunk is tokenized and aligned once per worker, while a memory of
bounded bytes lasts. Each document is written with its distinct linked id pairs and how often it has them; these are summed over
the corpus, per task and then per pair, and looked up again, in arrays of the worker as long as ``max_pairs`` bounds their
number, else by joining each document's pairs.

Defined results: a text that is null or empty, or for which either tokenizer's bytes are not the space and the text (such as
one with U+2581), has no tokens: zeros and empty groups, and adds nothing to the counts. Texts of any length are whole;
repeated rows count as often as they stand there; null ids are kept; columns that are not named are not touched; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from genosieve.llm.bpe import _alphabet, _spans, default_path
from genosieve.llm.common import filesystem, shared_root, written
from genosieve.llm.fim import ExceptionIndex

#: Bytes of chunks and their alignments that a worker remembers; beyond that, those not met since the last time go.
MEMORY = 96 << 20
#: Bytes of texts aligned at once, or one text; and of new chunks tokenized at once.
BATCH_BYTES, JOINED_BYTES = 2 << 20, 1 << 18
#: Links of one task whose pairs are summed before they go to the shuffle.
PENDING = 2_000_000
#: Pairs that a worker may hold as arrays: 20 bytes each. Beyond, documents' pairs are joined.
MAX_PAIRS = 4_000_000
#: A pair with more than one in so many links is joined without a shuffle.
HOT_SHARE = 1000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_MARK = "\u2581"
_ALIGNERS: dict[tuple, "Aligner"] = {}


def byte_ends(starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ends of tokens in bytes, from coarse byte spans and the tokens' decoded lengths.

    A span that starts where the one before it ended and is as long as the token's bytes gives the end; any other is
    refined: the token ends its decoded length after the one before."""
    exact = (starts == np.concatenate([[0], ends[:-1]])) & (ends - starts == sizes)
    if exact.all():
        return ends
    reach = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(exact, np.arange(len(ends)), -1))  # the exact token before each one
    return np.where(last < 0, reach, ends[last] - reach[last] + reach)


class Chunks:
    """Alignments of chunks: tokens and groups of each, its groups as text, and its links (a << 32 | b) as a part of one array."""

    def __init__(self, n_a: np.ndarray, n_b: np.ndarray, n_groups: np.ndarray, n_links: np.ndarray, bad: np.ndarray, links: np.ndarray, groups: pa.Array):
        self.n_a, self.n_b, self.n_groups, self.n_links, self.bad, self.links, self.groups = n_a, n_b, n_groups, n_links, bad, links, groups
        self.first = np.cumsum(n_links) - n_links

    @classmethod
    def joined(cls, parts: list["Chunks"]) -> "Chunks":
        flat = [np.concatenate([getattr(p, k) for p in parts]) for k in ("n_a", "n_b", "n_groups", "n_links", "bad", "links")]
        return cls(*flat, pa.concat_arrays([p.groups for p in parts]))

    def take(self, at: np.ndarray) -> "Chunks":
        links = self.links[_spans(self.first[at], self.n_links[at])]
        return Chunks(self.n_a[at], self.n_b[at], self.n_groups[at], self.n_links[at], self.bad[at], links, self.groups.take(pa.array(at)))

    @property
    def nbytes(self) -> int:
        return self.links.nbytes + self.groups.nbytes + 40 * len(self.n_a)


NOTHING = Chunks(*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, bool), np.zeros(0, np.int64), pa.array([], pa.string()))
_BAD = Chunks(*(np.zeros(1, np.int64) for _ in range(4)), np.ones(1, bool), np.zeros(0, np.int64), pa.array([""], pa.string()))


def _lists(values: pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


class Aligner:
    """Both tokenizers of a worker and the chunks that it remembers."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        back = {c: b for b, c in _alphabet().items()}
        tokens = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.a_bytes[i] = bytes(back[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.b_bytes = [
            bytes.fromhex(byte.fullmatch(p)[1]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]
        ]
        self.sizes = [np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes)]
        self.known, self.chunks, self.met = pa.array([], pa.string()), NOTHING, np.zeros(0, bool)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the chunks of all texts among the known ones, where each text's chunks end, whether it has tokens)."""
        self._forget()
        empty = pc.fill_null(pc.equal(texts, ""), True).to_numpy(zero_copy_only=False)
        texts = pc.fill_null(texts, "")
        cut = pc.split_pattern(texts, " ")
        pieces, ends = cut.values, cut.offsets.to_numpy()[1:].astype(np.int64)
        odd = pc.not_equal(pc.utf8_trim_whitespace(pieces), pieces).to_numpy(zero_copy_only=False) | (pc.binary_length(pieces).to_numpy() == 0)
        careful = np.flatnonzero(np.add.reduceat(np.append(odd, False).astype(np.int64), np.concatenate([[0], ends[:-1]])) > 0) if len(ends) else ends
        if len(careful):  # spaces beside white space: cut by the rule itself
            sizes, parts, last = np.diff(ends, prepend=0), [], 0
            for i in careful.tolist():
                own = [] if empty[i] else _CUT.split(texts[i].as_py())
                parts += [pieces.slice(last, ends[i] - sizes[i] - last), pa.array(own, pa.string())]
                last, sizes[i] = ends[i], len(own)
            pieces, ends = pa.concat_arrays([*parts, pieces.slice(last)]), np.cumsum(sizes)
        at = self._places(pieces)
        wrong = np.concatenate([[0], np.cumsum(self.chunks.bad[at])])
        return at, ends, ~empty & (wrong[ends] == wrong[np.concatenate([[0], ends[:-1]])])

    def _places(self, pieces: pa.Array) -> np.ndarray:
        numbered = pa.concat_arrays([self.known, pieces]).dictionary_encode()
        old = len(self.known)
        new = numbered.dictionary.slice(old)
        if len(new):
            found = self._learn(new)
            self.known, self.chunks = pa.concat_arrays([self.known, new]), Chunks.joined([self.chunks, found])
            self.met = np.concatenate([self.met, np.ones(len(new), bool)])
        at = numbered.indices.slice(old).to_numpy()
        self.met[at] = True
        return at

    def _forget(self) -> None:
        if self.known.nbytes + self.chunks.nbytes < MEMORY:
            return
        if self.met.mean() > 0.5:
            self.met[:] = False
        kept = np.flatnonzero(self.met)
        self.known, self.chunks = self.known.take(pa.array(kept)), self.chunks.take(kept)
        self.met = np.zeros(len(kept), bool)

    def _learn(self, new: pa.Array) -> Chunks:
        """Alignments of new chunks, many at once: a line feed, which is a token of its own, parts them."""
        alone = pc.or_(pc.not_equal(pc.utf8_trim_whitespace(new), new), pc.match_substring(new, _MARK)).to_numpy(zero_copy_only=False)
        alone |= pc.binary_length(new).to_numpy() == 0
        parts, order = [], []
        plain = np.flatnonzero(~alone)
        reach = np.cumsum(pc.binary_length(new).to_numpy().astype(np.int64)[plain] + 2)
        at = 0
        while at < len(plain):
            to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + JOINED_BYTES, side="right")))
            some = plain[at:to]
            parts.append(self._align(new.take(pa.array(some)).to_pylist()))
            order.append(some)
            at = to
        for i in np.flatnonzero(alone).tolist():
            parts.append(self._align([new[i].as_py()]))
            order.append(np.array([i]))
        found = Chunks.joined(parts)
        back = np.empty(len(new), np.int64)
        back[np.concatenate(order)] = np.arange(len(new))
        return found.take(back)

    def _align(self, chunks: list[str]) -> Chunks:
        text = " " + "\n ".join(chunks)
        data = np.frombuffer(text.encode(), np.uint8)
        encoding, proto = self.a.encode(text, add_special_tokens=False), self.b.encode(text[1:], return_type="proto")
        a, b = np.array(encoding.ids, np.int64), np.array([p.id for p in proto.pieces], np.int64)
        same = all(len(x) == len(data) and (np.frombuffer(x, np.uint8) == data).all() for x in (b"".join(map(self.a_bytes.__getitem__, a.tolist())), b"".join(map(self.b_bytes.__getitem__, b.tolist()))))
        if same:
            spans = ExceptionIndex(data).to_bytes(np.array(encoding.offsets, np.int64).reshape(-1))
            a_ends = byte_ends(spans[::2], spans[1::2], self.sizes[0][a])
            stops = np.array([p.end for p in proto.pieces], np.int64) + 1  # the proto does not count the space before the text
            starts = np.array([p.begin for p in proto.pieces], np.int64) + 1
            starts[0] = 0
            b_ends = byte_ends(starts, stops, self.sizes[1][b])
            size = np.array([len(c.encode()) for c in chunks], np.int64) + 1
            stop = np.cumsum(size + 1) - 1  # ends of the chunks; a line feed follows all but the last
            met = [e[np.minimum(np.searchsorted(e, stop), len(e) - 1)] == stop for e in (a_ends, b_ends)]
            feed = [e[np.minimum(np.searchsorted(e, stop[:-1] + 1), len(e) - 1)] == stop[:-1] + 1 for e in (a_ends, b_ends)]
            if all(x.all() for x in (*met, *feed)):
                return self._cut(a, b, a_ends, b_ends, stop)
        if len(chunks) == 1:
            return _BAD
        half = len(chunks) // 2  # some chunk's bytes differ
        return Chunks.joined([self._align(chunks[:half]), self._align(chunks[half:])])

    def _cut(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, stop: np.ndarray) -> Chunks:
        """Chunks from their tokens, each chunk's last token ending at its stop and a line feed after all but the last."""
        feeds = stop[:-1] + 1
        a_kept, b_kept = ~np.isin(a_ends, feeds), ~np.isin(b_ends, feeds)
        a, b, a_ends, b_ends = a[a_kept], b[b_kept], a_ends[a_kept], b_ends[b_kept]
        ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        groups = ends[1:][ends[1:] == ends[:-1]]  # ends of both
        ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])]  # between two of them lies one link
        links = a[np.searchsorted(a_ends, ends)] << 32 | b[np.searchsorted(b_ends, ends)]
        count = [np.diff(np.searchsorted(e, stop, side="right"), prepend=0) for e in (a_ends, b_ends, groups, ends)]
        sides = [pc.binary_join(_lists(pc.cast(pa.array(x), pa.string()), np.searchsorted(e, groups, side="right")), ",") for x, e in ((a, a_ends), (b, b_ends))]
        texts = pc.binary_join(_lists(pc.binary_join_element_wise(*sides, "|"), np.cumsum(count[2])), ";")
        return Chunks(*count, np.zeros(len(stop), bool), links, texts)


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process and files; tasks that reuse the worker reuse what it remembers."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    reach, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + BATCH_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def tokenized(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, groups, pairs, times) of every document: its distinct linked id pairs in
    order, as 64-bit numbers, and how many links hold each, as 32-bit ones."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for part in _parts(batch, 1):
                at, ends, good = own.column(part.column(1))
                size = np.where(good, np.diff(ends, prepend=0), 0)
                at = at[np.repeat(good, np.diff(ends, prepend=0))]
                c, ends = own.chunks, np.cumsum(size)
                sums = [pa.array(_sums(x[at], size)) for x in (c.n_a, c.n_b, c.n_groups, c.n_links)]
                groups = pc.binary_join(_lists(c.groups.take(pa.array(at)), ends), ";")
                digest = [hashlib.sha256(g.as_buffer()).hexdigest() if ok else "" for g, ok in zip(groups, good.tolist())]
                links, stop = c.links[_spans(c.first[at], c.n_links[at])], np.cumsum(_sums(c.n_links[at], size)).tolist()
                found = [np.unique(links[i:j], return_counts=True) for i, j in zip([0, *stop[:-1]], stop)]
                pairs, times = (pa.array([f[k].astype(t).tobytes() for f in found], pa.binary()) for k, t in enumerate(("<i8", "<i4")))
                shown = groups if with_groups else pa.array([""] * len(size), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *sums, pa.array(digest, pa.string()), shown, pairs, times], names=[id_col, *_NAMES, "pairs", "times"])

    schema = f"`{id_col}` {kind.simpleString()}, " + ", ".join(f"{n} bigint" for n in _NAMES[:4]) + ", groups_sha256 string, groups string, pairs binary, times binary"
    return docs.select(id_col, F.col(f"`{text_col}`")).mapInArrow(run, schema)


def _numbers(column: pa.Array, kind: str) -> np.ndarray:
    """The numbers of all values of a binary column in a row."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def link_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold an id pair, over all documents, and whether no pair of its B id has more.

    Tasks send sums; a pair's rows are as many as tasks send, whatever its frequency."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size = [], 0
        for batch in batches:
            pending.append((_numbers(batch.column(0), "<i8"), _numbers(batch.column(1), "<i4")))
            size += len(pending[-1][0])
            if size > PENDING:
                yield _summed(pending)
                pending, size = [], 0
        if pending:
            yield _summed(pending)

    total = rows.select("pairs", "times").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    total = total.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    top = total.groupBy("b").agg(F.max("n").alias("top"))
    return total.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _summed(pending: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    pair, at = np.unique(np.concatenate([p for p, _ in pending]), return_inverse=True)
    n = np.zeros(len(pair), np.int64)
    np.add.at(n, at, np.concatenate([t for _, t in pending]))
    return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])


def _sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of ``count`` values in a row each."""
    reach = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(count)
    return reach[ends] - reach[ends - count]


class Lookup:
    """Counts by pair as sorted arrays, of bounded number."""

    def __init__(self, path: str):
        fs, p = filesystem(path)
        t = pq.read_table(p, filesystem=fs, columns=["pair", "n", "best"])
        order = np.argsort(t["pair"].to_numpy())
        self.pair, self.n, self.best = t["pair"].to_numpy()[order], t["n"].to_numpy()[order], t["best"].to_numpy()[order]

    def values(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether no pair of its B id has more, count) of pairs that are all known."""
        at = np.searchsorted(self.pair, pairs)
        return self.best[at], self.n[at]


_LOOKUPS: dict[str, Lookup] = {}
_NAMES = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups")
_RESULT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")


def _valued(rows: DataFrame, lookup: str, id_col: str) -> DataFrame:
    """Documents with n_best and count_sum from a table of counts that each worker holds."""
    kind = rows.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if lookup not in _LOOKUPS:
            _LOOKUPS.clear()
            _LOOKUPS[lookup] = Lookup(lookup)
        for batch in batches:
            pairs, times = _numbers(batch.column("pairs"), "<i8"), _numbers(batch.column("times"), "<i4").astype(np.int64)
            count = pc.binary_length(batch.column("pairs")).to_numpy() // 8
            best, n = _LOOKUPS[lookup].values(pairs)
            sums = {"n_best": pa.array(_sums(np.where(best, times, 0), count)), "count_sum": pa.array(_sums(times * n, count))}
            yield pa.RecordBatch.from_arrays([sums[k] if k in sums else batch.column(k) for k in (id_col, *_RESULT)], names=[id_col, *_RESULT])

    schema = f"`{id_col}` {kind.simpleString()}, " + ", ".join(f"{n} bigint" for n in _RESULT[:6]) + ", groups_sha256 string, groups string"
    return rows.mapInArrow(run, schema)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, max_pairs: int = MAX_PAIRS, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups) of every row; ``groups`` is empty unless asked for."""
    a_path, b_path = a_path or default_path(), b_path or piece_path()
    spark = docs.sparkSession
    rows = written(tokenized(docs, a_path, b_path, id_col, text_col, with_groups).withColumn("#row", F.monotonically_increasing_id()), "aligned")
    path = f"{shared_root(spark).rstrip('/')}/links-{uuid.uuid4().hex}"
    link_counts(rows).write.parquet(path)
    counts = spark.read.schema("pair bigint, n bigint, best boolean").parquet(path)
    if counts.count() <= max_pairs:
        return _valued(rows.drop("#row"), path, id_col)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = pc.binary_length(batch.column(1)).to_numpy() // 8
            row = np.repeat(batch.column(0).to_numpy(), count)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(_numbers(batch.column(1), "<i8")), pa.array(_numbers(batch.column(2), "<i4").astype(np.int64))], names=["row", "pair", "times"])

    hot = counts.where(F.col("n") * HOT_SHARE > F.lit(counts.agg(F.sum("n")).first()[0]))  # fewer than HOT_SHARE pairs, whatever the corpus
    links = rows.select("#row", "pairs", "times").mapInArrow(listed, "`row` bigint, pair bigint, times bigint").join(F.broadcast(hot), "pair", "left")
    found = links.where("n is not null").unionByName(links.where("n is null").select("row", "pair", "times").join(counts, "pair"))
    sums = found.groupBy(F.col("row").alias("#row")).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.join(sums, "#row", "left").na.fill(0, ["n_best", "count_sum"]).select(id_col, *_RESULT)
