"""Toxicity by a support vector machine over a gapped-subsequence string kernel with Nyström landmarks.

A token meets a landmark in all common subsequences of three letters, discounted by the length they span; letters that
were inserted or left out lower the value without hiding the insult. A sentence's value for a landmark is the largest of
its tokens', the Nyström map whitens the values, and a linear machine with squared hinge loss separates labelled
sentences. A document scores as its worst sentence, made a probability by a logistic fit on whole labelled documents.

Labels mark documents, so sentences of toxic documents count as toxic where they hold a token that marks such documents.

Defined results: null or empty texts have no sentences and get the base rate; repeated rows score alike; with no usable
labels every score is 0; an empty table gives no rows; rows with one id are scored one by one; extra columns are not touched; tokens of any length are scored in overlapping pieces.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bound of the training sample: at most so many labelled documents of each label.
MAX_TOXIC, MAX_CLEAN = 1000, 1500
#: Longer documents (in bytes) are scored but not taken for training, so that the sample's bytes are bounded, too.
MAX_SAMPLE_BYTES = 128 << 10
MAX_LANDMARKS, BACKGROUND = 56, 16
THRESHOLD = 0.3
#: Share of a landmark's letters that a token must have to meet it at all.
NEAR = 0.8
MARK_SHARE, MARK_ODDS = 0.01, 8
DECAY = 0.6
#: Longest piece of a token; longer tokens are cut into pieces that overlap by half.
PIECE = 24
#: Distinct tokens that a Python worker remembers before it starts afresh.
MEMORY = 400_000
LONGEST = 64
_SINGLES = re.compile(r"(?<!\S)\w(?:[ .\-_*]\w){3,}(?!\S)")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_STOP = (".", "!", "?")


def _codes(words: list[str]) -> np.ndarray:
    """(n, longest) code points, 0 beyond a word's end."""
    longest = max(map(len, words), default=1) or 1
    return np.array(words, f"U{longest}").view(np.uint32).reshape(len(words), longest)


def _bound(words: list[str]) -> list[str]:
    """Words with marks at both ends, so that beginnings and endings count as letters do."""
    return [f"^{w}$" for w in words]


def _kernel(s: np.ndarray, t: np.ndarray, decay: float) -> np.ndarray:
    """Three-letter gapped-subsequence kernel of rows s (n, a) with columns t (m, b), or of aligned rows if t is (n, 1, b)."""
    if t.ndim == 2:
        t = t[None]
    n, m, b = len(s), t.shape[1], t.shape[2]
    d, d2 = np.float32(decay), np.float32(decay * decay)
    # of all columns before j: one[j], two[j] are the discounted counts of one and two matched letters so far
    one = np.zeros((b + 1, n, m), np.float32)
    two = np.zeros((b + 1, n, m), np.float32)
    total = np.zeros((n, m), np.float32)
    for x in range(s.shape[1]):
        c = s[:, x, None]
        live = c != 0
        if not live.any():
            break
        row1 = np.zeros((n, m), np.float32)
        row2 = np.zeros((n, m), np.float32)
        for j in range(b):
            hit = ((t[:, :, j] == c) & live).astype(np.float32) * d2
            total += hit * two[j]  # two[j], one[j]: still of the letters before x
            row2 = d * row2 + hit * one[j]
            row1 = d * row1 + hit
            if j:
                two[j] = d * two[j] + held2
                one[j] = d * one[j] + held1
            held1, held2 = row1.copy(), row2.copy()
        two[b] = d * two[b] + held2
        one[b] = d * one[b] + held1
    return total


def _gate(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(n, m): whether a word has at least NEAR of a landmark's letters, in any order and place."""
    # a letter's first, second, ... occurrence is one column each, so that a product counts what both have
    letters = [(c, i) for c in np.unique(t[t != 0]) for i in range(int((t == c).sum(axis=1).max()))]
    count = {c: ((s == c).sum(axis=1), (t == c).sum(axis=1)) for c, _ in letters}
    has = np.stack([count[c][0] > i for c, i in letters], 1).astype(np.float32)
    wants = np.stack([count[c][1] > i for c, i in letters], 0).astype(np.float32)
    return has @ wants >= NEAR * (t != 0).sum(axis=1) - 1e-4


def kernel(words: list[str], landmarks: list[str], decay: float = DECAY) -> np.ndarray:
    """Normalised values (words x landmarks) in 0 to 1. A word with fewer than NEAR of a landmark's letters gets 0, and so
    do words under three letters."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if not words or not landmarks:
        return out
    words, landmarks = _bound(words), _bound(landmarks)
    t = _codes(landmarks)
    own_t = _kernel(t, t[:, None, :], decay)[:, 0]
    order = np.argsort([len(w) for w in words], kind="stable")
    for at in range(0, len(order), 4096):
        part = order[at : at + 4096]
        s = _codes([words[i] for i in part])
        row, col = np.nonzero(_gate(s, t))
        if len(row):
            some, where = np.unique(row, return_inverse=True)
            own = _kernel(s[some], s[some][:, None, :], decay)[where, 0]
            value = _kernel(s[row], t[col][:, None, :], decay)[:, 0]
            out[part[row], col] = value / np.sqrt(np.maximum(own * own_t[col], 1e-12))
    return out


def tokens(text: str | None) -> list[str]:
    """Lower-cased tokens; letters spelt out one by one also come joined, in place of their run."""
    t = (text or "").lower()
    if _SINGLES.search(t):
        t = _SINGLES.sub(lambda m: re.sub(r"[\W_]", "", m[0]), t)
    return t.split()


def _pieces(token: str) -> list[str]:
    w = _EDGE.sub("", token)
    return [w] if len(w) <= PIECE else [w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)]


@dataclass
class Model:
    """Landmarks and weights; ``weights`` act on raw sentence values (the Nyström map is folded in)."""

    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(4))
    offset: float = -50.0  # no labels: every score is 0
    decay: float = DECAY

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.slopes + self.offset, -50, 50)))


class Scorer:
    """Scores texts; remembers the values of tokens it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}  # token -> 2 * row of its values (0: meets no landmark) + whether it ends a sentence
        self.rows = [np.zeros((1, len(self.model.landmarks)), np.float32)]
        self.size = 1

    @property
    def values(self) -> np.ndarray:
        if len(self.rows) > 1:
            self.rows = [np.concatenate(self.rows)]
        return self.rows[0]

    def learn(self, texts: list[list[str]]) -> None:
        new = set().union(*texts).difference(self.number)
        if len(self.number) + len(new) > MEMORY:
            self.forget()
            new = set().union(*texts)
        if not new:
            return
        new = sorted(new)
        parts = [_pieces(w) for w in new]
        flat = list(dict.fromkeys(p for ps in parts for p in ps))
        where = {p: i for i, p in enumerate(flat)}
        k = kernel(flat, self.model.landmarks, self.model.decay)
        hot = k.any(axis=1)
        for w, ps in zip(new, parts):
            row = 0
            if found := [i for p in ps if hot[i := where[p]]]:
                row = self.size
                self.size += 1
                self.rows.append(k[found].max(axis=0)[None])
            self.number[w] = 2 * row + w.endswith(_STOP)

    def drop_long(self, texts: list[list[str]]) -> None:
        """Forgets tokens above LONGEST letters, so that text without spaces takes no memory."""
        for w in {w for t in texts for w in t if len(w) > LONGEST}:
            self.number.pop(w, None)

    def sentences(self, text: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Of one tokenised text that :meth:`learn` has seen: the values of the sentences that meet a landmark, their
        numbers in the text, and the number of all sentences. Other sentences' values are 0."""
        at = np.fromiter(map(self.number.__getitem__, text), np.int64, len(text))
        if not len(at):
            return np.zeros((0, len(self.model.landmarks)), np.float32), at, 0
        number = np.concatenate([[0], np.cumsum(at[:-1] & 1)])
        hot = np.flatnonzero(at > 1)
        if not len(hot):
            return np.zeros((0, len(self.model.landmarks)), np.float32), hot, int(number[-1]) + 1
        found, start = np.unique(number[hot], return_index=True)
        return np.maximum.reduceat(self.values[at[hot] >> 1], start, axis=0), found, int(number[-1]) + 1

    def features(self, texts: list[str | None]) -> np.ndarray:
        """(n, 4): the three worst sentences' decisions (the bias where no more sentences meet a landmark) and the
        logarithm of the number of sentences, since long texts meet landmarks by chance."""
        out = np.full((len(texts), 4), self.model.bias)
        for at in range(0, len(texts), 256):
            cut = [tokens(t) for t in texts[at : at + 256]]
            self.learn(cut)
            for i, c in enumerate(cut, at):
                values, _, count = self.sentences(c)
                out[i, 3] = np.log1p(count)
                if len(values):
                    best = np.sort(values @ self.model.weights)[::-1][:3]
                    out[i, : len(best)] += np.maximum(best, 0) if len(values) < count else best
            self.drop_long(cut)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.model.probability(self.features(texts))


def _family(words: list[str]) -> int:
    """The least hash of the text's 3-word shingles: near copies mostly share it."""
    return min((zlib.crc32(" ".join(x).encode("utf-8", "surrogatepass")) for x in zip(words, words[1:], words[2:])), default=0)


def _marks(docs: list[set[str]], toxic: np.ndarray, family: list[int], most: int) -> list[str]:
    """Tokens that mark toxic documents: found in MARK_SHARE of the toxic families at least, and there MARK_ODDS times as
    often as in clean ones. Families, not documents, are counted, so that many copies of one text prove nothing."""
    seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for y in (True, False):
        by: dict[int, set[str]] = {}
        for d, t, f in zip(docs, toxic, family):
            if bool(t) == y:
                by.setdefault(f, set()).update(d)
        for words in by.values():
            seen[y].update(words)
        seen[y][""] = len(by)  # the number of families
    n, m = seen[True].pop(""), max(1, seen[False].pop(""))
    good = [(k, w) for w, k in seen[True].items() if k >= max(3, MARK_SHARE * n) and k * m >= MARK_ODDS * n * seen[False][w]]
    return [w for k, w in sorted(good, key=lambda x: (-x[0], x[1]))[:most]]


def _hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton's method on the active rows."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-4
    for _ in range(rounds):
        on = y * (x1 @ w) < 1
        a = x1[on] * weight[on, None]
        new = np.linalg.solve(ridge + cost * a.T @ x1[on], cost * a.T @ y[on])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic fit with smoothed targets."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2)
    target, x = np.where(y, hi, lo), np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - target) + 1e-2 * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), g)
    return w[:-1], float(w[-1])


def _spread(words: list[str], most: int, apart: float) -> list[str]:
    """The first words that are less alike than ``apart`` to those before them."""
    words = words[: 20 * most]
    k = kernel(words, words)
    out: list[int] = []
    for i in range(len(words)):
        if len(out) < most and (not out or k[i, out].max() < apart):
            out.append(i)
    return [words[i] for i in out]


def fit(texts: list[str | None], toxic: list[int]) -> Model:
    """Trains on labelled documents (a bounded sample, see MAX_TOXIC and MAX_CLEAN)."""
    rows = sorted({(t or "", int(y)) for t, y in zip(texts, toxic)})  # copies count once
    y = np.array([r[1] for r in rows], bool)
    if not y.any() or y.all():
        return Model()
    cut = [tokens(r[0]) for r in rows]
    words = [{p for w in c for p in _pieces(w) if len(p) >= 3} for c in cut]
    marks = _marks(words, y, [_family(c) for c in cut], 20 * MAX_LANDMARKS)
    if not marks:
        return Model(offset=float(np.log(y.mean() / (1 - y.mean()))))
    bad = _spread(marks, MAX_LANDMARKS, 0.75)
    # clean words that look most like the marks, the commonest first
    seen = Counter(w for d, t in zip(words, y) if not t for w in d)
    clean = [w for w in seen if seen[w] >= 3 and w not in set(marks)]
    alike = kernel(clean, bad).max(axis=1) if clean else np.zeros(0)
    near = sorted((i for i in range(len(clean)) if alike[i] > 0.5), key=lambda i: (-seen[clean[i]], clean[i]))
    model = Model(landmarks=bad + _spread([clean[i] for i in near], BACKGROUND, 0.95))
    model.weights = np.zeros(len(model.landmarks))
    scorer, pos, neg, marked = Scorer(model), [], [np.zeros((1, len(model.landmarks)), np.float32)], set(marks)
    for at in range(0, len(cut), 256):
        scorer.learn(cut[at : at + 256])
        for c, t in zip(cut[at : at + 256], y[at : at + 256]):
            v, number, _ = scorer.sentences(c)
            if t and len(v):
                ends = np.cumsum([w.endswith(_STOP) for w in c])
                hit = {int(ends[i - 1]) if i else 0 for i, w in enumerate(c) if not marked.isdisjoint(_pieces(w))}
                pos.append(v[np.isin(number, list(hit))])
            elif not t:
                neg.append(v)
    # the same insults with one letter inserted or one left out
    alter = [w[:at] + x + w[at:] for w in bad for at in range(1, len(w)) for x in "x*"] + [w[:at] + w[at + 1 :] for w in bad if len(w) > 6 for at in range(1, len(w) - 1)]
    known = set(seen)
    xp, xn = np.concatenate([*pos, kernel([w for w in alter if w not in known], model.landmarks)]), np.concatenate(neg)
    hard = np.argsort(-xn[:, : len(bad)].max(axis=1), kind="stable")  # the hardest sentences, and a spread of the others
    xn = xn[np.concatenate([hard[:6000], hard[6000 :: max(1, len(hard) // 4000)]])]
    k = kernel(model.landmarks, model.landmarks).astype(float)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T  # K^(-1/2)
    x, sign = np.concatenate([xp, xn]).astype(float) @ root, np.concatenate([np.ones(len(xp)), -np.ones(len(xn))])
    share = np.where(sign > 0, 0.5 / len(xp), 0.5 / len(xn)) * len(x)
    w, model.bias = _hinge(x, sign, share, 1.0)
    model.weights = root @ w
    # every tenth toxic document comes again with a letter inserted in its insults
    veiled = [" ".join(w[: len(w) // 2] + "*" + w[len(w) // 2 :] if not marked.isdisjoint(_pieces(w)) else w for w in c) for c in [c for c, t in zip(cut, y) if t][::10]]
    model.slopes, model.offset = _logistic(scorer.features([r[0] for r in rows] + veiled), np.concatenate([y, np.ones(len(veiled), bool)]))
    return model


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on at most MAX_TOXIC + MAX_CLEAN labelled documents, those with the least hash of their id per label, never
    on held-out ones, of MAX_SAMPLE_BYTES at most. That bounded sample is all that reaches the driver."""
    use = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    usable = docs.where(F.coalesce(F.octet_length(text_col), F.lit(0)) <= MAX_SAMPLE_BYTES).select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("t"))
    use = use.join(usable.select(id_col).distinct(), id_col, "left_semi")
    parts = [use.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(most) for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    chosen = parts[0].unionByName(parts[1])
    # chosen has at most MAX_TOXIC + MAX_CLEAN rows; of rows that share an id the least text counts
    rows = usable.join(F.broadcast(chosen), id_col).groupBy(id_col).agg(F.min("t").alias("t"), F.first("y").alias("y")).collect()
    return fit([r.t for r in rows], [r.y for r in rows])


_LAST: list[Scorer] = []


def _scorer(model: Model) -> Scorer:
    """The worker's scorer of this model, kept between tasks."""
    if not _LAST or _LAST[0].model.landmarks != model.landmarks or not np.array_equal(_LAST[0].model.weights, model.weights):
        _LAST[:] = [Scorer(model)]
    return _LAST[0]


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) per row, whole texts, no shuffle."""
    spark: SparkSession = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    pa_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                p = scorer.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa_kind), pa.array(p)], names=[id_col, "score"])

    scored = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, score double")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, scored where they are read: no join back."""
    model = train(docs, labels, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value)
        at = names.index(text_col)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield part.filter(pa.array(scorer.scores(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
