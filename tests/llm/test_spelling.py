"""The tables of the spelling model and the search for pairs, against the plain model."""

import numpy as np

from logweir.llm import perplexity, word_model


def _model(counts):
    """The orders of a model of these counts, as Spark makes them."""
    levels = []
    grams, n = np.array(sorted(counts)), np.array([counts[g] for g in sorted(counts)], np.float64)
    for order in range(perplexity.ORDER, 0, -1):
        levels.append((grams, n))
        grams, n = np.unique(grams % perplexity.SYMBOLS ** (order - 1), return_counts=True)
        n = n.astype(np.float64)
    rng, model = np.random.default_rng(2), []
    for grams, n in reversed(levels):
        heads = np.unique(grams // perplexity.SYMBOLS)
        model.append((grams, -rng.random(len(grams)), heads, -rng.random(len(heads)), n))
    return model


def test_the_tables_give_what_a_search_gives():
    rng = np.random.default_rng(4)
    some = rng.integers(0, perplexity.SYMBOLS**perplexity.ORDER, 3000)
    model = _model(dict(zip(some.tolist(), rng.integers(1, 5, 3000).tolist())))
    asked = np.concatenate([some, rng.integers(0, perplexity.SYMBOLS**perplexity.ORDER, 3000), np.sort(some) + 1])
    asked = asked[asked < perplexity.SYMBOLS**perplexity.ORDER]
    spelling = perplexity.Spelling(model)
    assert (spelling.logp(asked) == perplexity._logp(model, asked, perplexity.ORDER)).all()
    own = np.full(len(asked), 2)
    for gram, got in zip(asked.tolist(), spelling.logp(asked, own=own).tolist()):  # no more than its own two: not seen
        held = dict(zip(model[3][0].tolist(), zip(model[3][1], model[3][4])))
        if held.get(gram, (0, 0))[1] > 2:
            assert got == held[gram][0]
        else:
            back = dict(zip(model[3][2].tolist(), model[3][3])).get(gram // 40, 0.0)
            assert got == back + perplexity._logp(model, np.array([gram % 40**3]), 3)[0]


def test_each_pair_of_a_text_is_searched_for_once(monkeypatch):
    k = np.arange(1, 9)
    common = word_model.Common(k, np.full(8, 10), np.full(8, -2.0), np.full(8, 80))
    common.set_pairs(np.array([1, 9, 20]), np.array([5, 4, 3]), np.array([0, 0.5, 0.75, 0.9]))
    asked, find = [], word_model._find
    monkeypatch.setattr(word_model, "_find", lambda held, wanted: asked.append(wanted) or find(held, wanted))
    at = np.array([0, 1, 0, 1, 2, 4, 0, 1])
    common.score(k, at, np.bincount(at, minlength=8))
    assert asked[-1].tolist() == sorted(set((at[:-1] * 8 + at[1:]).tolist()))
