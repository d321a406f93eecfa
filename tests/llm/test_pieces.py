import itertools

import numpy as np
import sentencepiece
from hypothesis import given, settings, strategies as st

from genosieve.llm import pieces as P

MODEL = sentencepiece.SentencePieceProcessor(model_file=P.default_path())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "hello", "ing", " ", "  ", "\n", "\t", "▁", "é", "日", "\r", "();", "￼", "0x1F", "aaaa"]), max_size=30))
def test_equals_the_library(parts):
    enc, dec = P.codec(P.default_path())
    for text in ("".join(parts), " ".join(parts)):
        want = MODEL.encode(text)
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == want
        assert dec.decode(np.array(want, "<u4").tobytes()) == MODEL.decode(want)


def test_whole_table(documents):
    encoded = P.encode(documents)
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    back = {r.doc_id: r.text for r in P.decode(encoded).collect()}
    for r in documents.collect():
        assert ids[r.doc_id] == MODEL.encode(r.text) and back[r.doc_id] == r.text


def test_odd_rows(odd, none):
    rows = P.decode(P.encode(odd)).collect()
    assert sorted((r.text for r in rows)) == sorted(r.text or "" for r in odd.collect())
    assert P.encode(none).count() == 0 and P.decode(P.encode(none)).count() == 0


def test_unigram_takes_the_best_sum():
    scores = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -1.0, "aba": -6.0, "▁": -1.0, "▁a": -1.5}
    enc = P.TrieEncoder(P.Vocabulary(scores, {p: i for i, p in enumerate(scores)}, None, 99, bpe=False))
    words = sorted("▁" + "".join(w) for n in range(1, 6) for w in itertools.product("abz", repeat=n))

    def best(word):
        if not word:
            return 0.0, []
        found = []
        for n in range(1, 4):
            p = word[:n]
            s = scores.get(p, min(scores.values()) - 10 if n == 1 else None)
            if s is not None and n <= len(word):
                rest = best(word[n:])
                found.append((s + rest[0], [p] + rest[1]))
        return max(found, key=lambda x: x[0])

    for word, found in enc.sorted_words(words):
        low = min(scores.values()) - 10
        assert "".join(found) == word and abs(sum(scores.get(p, low) for p in found) - best(word)[0]) < 1e-9
