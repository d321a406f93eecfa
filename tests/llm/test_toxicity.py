import zlib
from itertools import combinations

import numpy as np

from genosieve.llm import toxicity as T


def brute_kernel(s, t):
    out = 0.0
    for a in combinations(range(len(s)), 3):
        for b in combinations(range(len(t)), 3):
            if all(s[x] == t[y] for x, y in zip(a, b)):
                out += T.DECAY ** (a[2] - a[0] + 1 + b[2] - b[0] + 1)
    return out


def test_kernel(monkeypatch):
    monkeypatch.setattr(T, "NEAR", 0.0)
    words, marks = ["idiot", "idi*ot", "thetion", "", "a", "aaaa", "mooron"], ["idiot", "moron", "aab"]
    k = T.kernel(words, marks)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            a, b = f"^{w}$", f"^{m}$"
            assert abs(k[i, j] - brute_kernel(a, b) / max(brute_kernel(a, a) * brute_kernel(b, b), 1e-12) ** 0.5) < 1e-4


def test_gate_only_drops_far_words(monkeypatch):
    words, marks = ["idiot", "xdiot", "thing", "worthles", "other"], ["idiot", "worthless"]
    gated = T.kernel(words, marks)
    monkeypatch.setattr(T, "NEAR", 0.0)
    full = T.kernel(words, marks)
    assert ((gated == 0) | (np.abs(gated - full) < 1e-6)).all() and gated[0, 0] > 0.99 and gated[3, 1] > 0.5


def test_learns_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = T.score(docs, T.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert scored and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in scored)
    y, s = np.array([r.toxic for r in scored]), np.array([r.score for r in scored])
    rank = np.argsort(np.argsort(s)) + 1
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.9 and ((s >= 0.3) & (y == 1)).sum() > 0.75 * (y == 1).sum() and ((s >= 0.3) & (y == 0)).sum() < 0.03 * (y == 0).sum()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored)


def small_model():
    rng = np.random.default_rng(1)
    filler = ["the", "of", "tion", "thing", "there", "reading", "ones", "other", "market", "water"]
    clean = [" ".join(rng.choice(filler, 30)) + f" c{i}. fine." for i in range(120)]
    toxic = [" ".join(rng.choice(filler, 20)) + f" you {w} t{i}. fine." for i, w in enumerate(["idiot", "moron", "scumbag"] * 20)]
    return T.fit(clean + toxic, [0] * 120 + [1] * 60)


def test_inserted_letters_are_tolerated():
    scorer = T.Scorer(small_model())
    s = scorer.scores(["you are an idiot", "you are an i d i o t", "an idi*ot", "a fine market of water", "", None, "the scumm-bag there"])
    assert s[0] > 0.3 and s[1] > 0.3 and s[3] < 0.3 and s[4] < 0.3 and s[5] == s[4]
    top = scorer.features(["an idi*ot", "the scumm-bag there", "a fine market of water"])[:, 0]
    assert min(top[:2]) > top[2] + 0.3  # letters put in lower the value, but do not hide the word


def test_odd_rows(spark, odd, none):
    model = small_model()
    rows = T.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert T.score(none, model).count() == 0
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score < 1e-9 for r in T.score(odd, T.train(odd, no_labels)).collect()} == {True}
    odd_labels = spark.createDataFrame([(1, None), (None, 1), (1, 0), (99, 1)], "doc_id long, toxic int")
    kept = T.keep_clean(odd, odd_labels)
    assert kept.count() == odd.count() and kept.columns == odd.columns


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "MEMORY", 40)
    scorer, fresh = T.Scorer(small_model()), None
    for k in range(10):
        text = " ".join(f"w{k}{i}" for i in range(15)) + " idiot."
        fresh = T.Scorer(scorer.model)
        assert np.allclose(scorer.scores([text]), fresh.scores([text])) and len(scorer.number) <= 40
