"""SentencePiece encoding and decoding by a forward pass over a trie of distinct marked words.

A batch's distinct words, with their marks for spaces, are sorted, which makes their list a trie in depth-first order:
each word keeps the forward states of the prefix that it shares with the word before. For a unigram model the state of a
prefix is its best score; for a BPE model, whose result is not the best sum of scores, it is the one last piece whose
merges are valid after the piece before it, which gives exactly the library's result. Words are remembered per worker.

Defined results: null and empty texts have no ids; characters without a piece fall back to bytes, else to the unknown
id; texts of any length are whole; repeated rows, and rows with one id, are encoded alike;
of equally good pieces the first merge counts, as in the library; an empty table gives no rows; extra columns are not touched.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

MARK = "▁"
#: Distinct words, and pairs of pieces, that a Python worker remembers before it starts afresh.
MEMORY = 700_000
#: Longer words are encoded each time and never remembered, so that text without spaces takes no memory.
LONGEST = 64
#: Before a word that no space precedes. A lone surrogate, so no text holds it.
_BARE = "\ud800"
_UNITS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
_ODD = re.compile(r"[ \n] | \n|^[ \n]|[ \n]$|\n\n|" + MARK)


class Vocabulary:
    """Pieces of a model: id and score of those that text can match, byte pieces, and the kind of model."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], byte_ids: list[int] | None, unknown: int, bpe: bool):
        self.scores, self.ids, self.byte_ids, self.unknown, self.bpe = scores, ids, byte_ids, unknown, bpe
        self.longest = max(map(len, scores), default=1)
        # lengths of pieces by their last three letters, longest first: few ends of a word need to be looked up
        lengths: dict[str, set[int]] = {}
        for p in scores:
            if len(p) >= 3:
                lengths.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {end: (*sorted(n, reverse=True), 2, 1) for end, n in lengths.items()}

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(map(model.is_byte, range(n))) else None
        with open(path, "rb") as f:
            from sentencepiece import sentencepiece_model_pb2 as pb

            proto = pb.ModelProto.FromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        if any(MARK in model.id_to_piece(i).lstrip(MARK) for i in plain):
            raise ValueError("a piece of this model spans words")
        return cls({model.id_to_piece(i): model.get_score(i) for i in plain}, {model.id_to_piece(i): i for i in plain}, byte_ids, model.unk_id(), proto.trainer_spec.model_type == 2)

    def ids_of(self, piece: str) -> list[int]:
        if (i := self.ids.get(piece)) is not None:
            return [i]
        return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]


def merge(text: str, scores: dict[str, float]) -> list[str]:
    """Pieces of a short string by best merges first, leftmost of equals; for pairs of pieces only."""
    parts = list(text)
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = scores.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if at < 0:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class TrieEncoder:
    """Encodes sorted words with shared forward states."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.valid: dict[str, bool] = {}
        self.known: dict[str, bytes] = {}
        self.data = {p: np.array([i], "<u4").tobytes() for p, i in vocabulary.ids.items()}

    def _follows(self, before: str, piece: str) -> bool:
        """Whether merging leaves exactly these two pieces (the first may be empty)."""
        ok = merge(before + piece, self.v.scores) == ([before, piece] if before else [piece])
        if len(self.valid) >= MEMORY:
            self.valid.clear()
        self.valid[before + _BARE + piece] = ok
        return ok

    def sorted_words(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, pieces) of words in ascending order, in one depth-first walk."""
        scores, longest, bpe = self.v.scores, self.v.longest, self.v.bpe
        lengths, valid, short = self.v.lengths, self.valid, (2, 1)
        lowest = min(scores.values(), default=0.0) - 10
        last = [""]  # last[i]: last piece of the first i letters; only the part shared with the next word is kept
        score = [0.0]
        before = ""
        for word in words:
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            del last[same + 1 :], score[same + 1 :]
            for i in range(same + 1, len(word) + 1):
                if bpe:
                    for n in lengths.get(word[i - 3 : i] if i > 2 else "", short):
                        if n > i:
                            continue
                        piece = word[i - n : i]
                        if n == 1 or piece in scores:
                            ok = valid.get(last[i - n] + _BARE + piece)
                            if ok or ok is None and self._follows(last[i - n], piece):
                                last.append(piece)
                                break
                    else:
                        raise ValueError(f"no piece ends at letter {i} of {word[:50]!r}")
                    continue
                best, chosen = score[i - 1] + lowest, word[i - 1 : i]
                for start in range(max(0, i - longest), i):
                    s = scores.get(word[start:i])
                    if s is not None and score[start] + s > best:
                        best, chosen = score[start] + s, word[start:i]
                last.append(chosen)
                score.append(best)
            before, at, pieces = word, len(word), []
            while at:
                pieces.append(last[at])
                at -= len(last[at])
            yield word, pieces[::-1]

    def _bytes(self, piece: str) -> bytes:
        return np.array(self.v.ids_of(piece), "<u4").tobytes()

    @staticmethod
    def cut(text: str | None) -> list[str]:
        """Words of a whole text. A word stands for itself after a space; other words are told by their first sign."""
        if not text:
            return []
        if not _ODD.search(text):
            return text.replace("\n", " \n " + _BARE).split(" ")
        out = []
        for u in _UNITS.findall(MARK + text.replace(" ", MARK)):
            out.append(u if u == "\n" or u[:2] == MARK * 2 or u == MARK else u[1:] if u[0] == MARK else _BARE + u)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """ids of whole texts as little-endian unsigned 32-bit bytes."""
        cut = [self.cut(t) for t in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = set().union(*cut)
        if new:
            marked = {(w[1:] if w[0] == _BARE else w if w[0] in f"{MARK}\n" else MARK + w): w for w in new}
            data = self.data
            for word, pieces in self.sorted_words(sorted(marked)):
                self.known[marked[word]] = b"".join([data.get(p) or self._bytes(p) for p in pieces])
        get = self.known.__getitem__
        found = [b"".join(map(get, c)) for c in cut]
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
        return found


class Decoder:
    """Text of ids: byte pieces are joined before they are read, marks become spaces, the first one goes."""

    def __init__(self, vocabulary: Vocabulary):
        self.text = {i: p.replace(MARK, " ").encode() for p, i in vocabulary.ids.items()}
        self.text |= {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids or [])} | {vocabulary.unknown: " ⁇ ".encode()}

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.text.get, np.frombuffer(ids, "<u4").tolist()))
        return data.decode("utf-8", "replace").removeprefix(" ")


_ENCODERS: dict[str, tuple[TrieEncoder, Decoder]] = {}


def codec(path: str) -> tuple[TrieEncoder, Decoder]:
    if path not in _ENCODERS:
        v = Vocabulary.load(path)
        _ENCODERS[path] = TrieEncoder(v), Decoder(v)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model_path: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, ids) of whole texts; no shuffle."""
    path, kind = model_path or default_path(), docs.schema[id_col].dataType
    pa_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = enc.encode(part.column(1).to_pylist())
                ends = np.cumsum([0] + [len(x) // 4 for x in found], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa_kind), ids], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model_path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_crc32, text) from (id, ids); no shuffle."""
    path, kind = model_path or default_path(), encoded.schema[id_col].dataType
    pa_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, dec = codec(path)
        for batch in batches:
            ids = [np.asarray(x.values if x.is_valid else [], "<u4").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa_kind), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64()), pa.array(map(dec.decode, ids), pa.string())], names=[id_col, "n_tokens", "ids_crc32", "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n_tokens bigint, ids_crc32 bigint, text string")
