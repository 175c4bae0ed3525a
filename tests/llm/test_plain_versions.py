"""The classifier chain against plain sums and its folds' promise; licence alignment against a plain longest common subsequence."""

import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import licenses, toxicity


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        bad, mean = rng.random() < 0.3, rng.random() < 0.2
        words = {f"plain{rng.randrange(40)}" for _ in range(12)} | ({f"badword{rng.randrange(3)}"} if bad else set()) | ({f"meanword{rng.randrange(3)}"} if mean else set())
        texts.append(" ".join(sorted(words)))
        labels.append((int(bad), int(bad and mean)))
    return texts, np.array(labels), [i % toxicity.FOLDS for i in range(n)]


def plain_score(chain, text):
    """A column at a time, by dictionaries and sums."""
    features = toxicity.expand(toxicity.terms(text)) & chain.index.keys()
    before, out = [], []
    for model in chain.models:
        z = model.bias + sum(model.words[chain.index[f]] for f in features) + sum(w * b for w, b in zip(model.before, before, strict=True))
        p = 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))
        out.append(p)
        q = min(max(p, 1e-3), 1 - 1e-3)
        before.append(math.log(q / (1 - q)))
    return out


def test_probabilities_equal_plain_sums():
    texts, labels, folds = corpus()
    chain = toxicity.train(texts, labels, ["bad", "worse"], folds)
    more = [*texts[:50], "", "BADWORD1 badword2 unknown", "plain1 " * 5000 + "meanword2"]
    assert np.allclose(chain.score([toxicity.terms(t) for t in more]), [plain_score(chain, t) for t in more], atol=1e-9)
    assert chain.models[1].before.shape == (1,), "the second model reads the first one's probability"
    held = chain.score([toxicity.terms(t) for t in texts])[:, -1] >= chain.threshold
    assert (held == (labels[:, -1] == 1)).mean() > 0.9


def test_probabilities_of_the_chain_are_out_of_fold():
    """A fold's probabilities in training don't depend on that fold's own outcomes."""
    texts, labels, folds = corpus()
    other = labels.copy()
    mine = np.array(folds) == 3
    other[mine] = 1 - other[mine]
    a, b = (toxicity.train(texts, y, ["bad", "worse"], folds).out_of_fold for y in (labels, other))
    assert np.allclose(a[mine, 0], b[mine, 0]) and not np.allclose(a[~mine, 0], b[~mine, 0])


def test_a_model_is_near_the_least_loss():
    """No small step from the weights that fit() finds lowers the penalised loss, worked out plainly, by over three hundredths; it stops early."""
    texts, labels, folds = corpus(200)
    chain = toxicity.train(texts, labels, ["bad", "worse"], folds)
    sets = [toxicity.expand(toxicity.terms(t)) & chain.index.keys() for t in texts]
    model, y = chain.models[0], labels[:, 0]

    def loss(weights, bias):
        total = 0.0
        for features, outcome in zip(sets, y, strict=True):
            z = bias + sum(weights[chain.index[f]] for f in features)
            total += math.log1p(math.exp(-abs(z))) + max(z, 0) - z * outcome
        return total + toxicity.L2 / 2 * float(weights @ weights)

    best = loss(model.words, model.bias)
    for at in np.flatnonzero(model.words):
        for step in (-0.05, 0.05):
            moved = model.words.copy()
            moved[at] += step
            assert loss(moved, model.bias) > 0.97 * best
    assert min(loss(model.words, model.bias + d) for d in (-0.05, 0.05)) > 0.97 * best


def plain_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=9), st.lists(st.integers(1, 5), max_size=14))
def test_alignment_finds_the_most_words_in_order(template, words):
    got = licenses.align(np.array(template), np.array(words, np.int64), 20, 0)
    n = plain_subsequence(template, words)
    assert (got[0] if got else 0) == n
    if got:
        assert plain_subsequence(template, words[got[1] : got[2] + 1]) == n, "the span holds them all"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 5, 17, 23, 99]), max_size=60))
def test_winnowing_loses_no_passage(grams):
    """Of any WINNOW neighbouring grams that templates have, one is chosen; and never one that no template has."""
    grams = np.array(grams, np.int64)
    chosen = set(licenses._winnowed(grams).tolist())
    assert all(grams[p] > 0 for p in chosen)
    for i in range(len(grams) - licenses.WINNOW + 1):
        if (grams[i : i + licenses.WINNOW] > 0).all():
            assert chosen & set(range(i, i + licenses.WINNOW))
