"""Mixture inference against a plain twin: words, languages and sets one by one, in Python's floats."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from bitvane.llm._words import Block
from bitvane.llm.lang_id import UND, MixtureModel

WORDS = {
    "aa": "ata kata tanaka rata naka kana tarana akata".split(),
    "bb": "sche isch schen nicht dersch ischen lichsch schine".split(),
    "cc": "oulou loupou moulo poulo oulem lemou moupe loulou".split(),
}


def plain_shares(model: MixtureModel, text: str) -> list[float]:
    """The penalised choice over the sets of the k likeliest languages, k from one to all."""
    block = Block([text])
    like = model._likelihoods(block).tolist()
    langs, n = len(model.langs), len(like)

    def em(allowed: list[int]) -> tuple[list[float], float]:
        share = [1 / len(allowed) if i in allowed else 0.0 for i in range(langs)]
        for _ in range(model.rounds):
            total = [0.0] * langs
            for word in like:
                s = sum(share[i] * word[i] for i in range(langs)) + 1e-30
                for i in range(langs):
                    total[i] += share[i] * word[i] / s
            share = [t / n for t in total]
        return share, sum(math.log(sum(share[i] * word[i] for i in range(langs)) + 1e-30) for word in like)

    full, _ = em(list(range(langs)))
    order = sorted(range(langs), key=lambda i: -full[i])
    best, won = None, None
    for k in range(1, langs + 1):
        share, ll = em(order[:k])
        worth = ll - model.penalty * (k - 1) * math.log(n + 1)
        if best is None or worth > best:
            best, won = worth, share
    return won


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    texts = [(" ".join(r.choices(words, k=40)), lang) for lang, words in WORDS.items() for _ in range(30)]
    return MixtureModel().fit([t for t, _ in texts], [lang for _, lang in texts])


def test_mixtures_equal_the_plain_twin(model):
    r = random.Random(2)
    for _ in range(60):
        parts = r.sample(sorted(WORDS), r.choice((1, 1, 2, 3)))
        text = " ".join(w for lang in parts for w in r.choices(WORDS[lang], k=r.choice((1, 3, 12, 40))))
        want = plain_shares(model, text)
        got = model.shares(Block([text]))[0]
        assert np.allclose(got, want, atol=2e-3), (text, got, want)
        langs, scores, sets = model.predict([text])
        assert want[model.langs.index(langs[0])] >= max(want) - 2e-3 and abs(scores[0] - max(want)) < 2e-3
        assert set(sets[0]) == {x for x, s in zip(model.langs, want) if s > 0}


def test_texts_side_by_side_are_as_each_alone(model):
    texts = [" ".join(WORDS["aa"]), "", None, " ".join(WORDS["aa"] + WORDS["cc"] * 3), "123 !!", " ".join(WORDS["bb"] * 9)]
    langs, scores, _ = model.predict(texts)
    alone = [model.predict([t]) for t in texts]
    assert langs == [a[0][0] for a in alone] and np.allclose(scores, [a[1][0] for a in alone])
    assert [langs[i] for i in (1, 2, 4)] == [UND] * 3 and langs[0] == "aa" and langs[5] == "bb"
