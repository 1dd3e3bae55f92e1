"""The word model against a plain version, and the verdicts on texts that a model of spelling can't tell."""

import math
from collections import Counter

import numpy as np
import pytest

from logweir.llm import perplexity, word_model

ROWS = "doc_id long, text string, lang string, n_words string, row string, word_ppl string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], ROWS)


def sentences(rng, stock, n):
    weights = 1 / np.arange(1, len(stock) + 1)
    return " ".join(rng.choice(stock, n, p=weights / weights.sum()))


def made(rng, parts, n):
    return sorted({"".join(rng.choice(parts, 3)) for _ in range(3 * n)})[:n]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(8)
    stock = {"en": made(rng, ["the", "ing", "on", "ed", "re", "st"], 150), "de": made(rng, ["sch", "ung", "ein", "ver", "lich", "keit"], 150)}
    rows = [(i, sentences(rng, stock[lang], int(rng.integers(20, 90))), lang) for i, lang in enumerate(["en", "en", "de"] * 25)]
    rows += [(75, rows[0][1], "en"), (75, rows[0][1], "en"), (None, rows[1][1], "en"), (77, "", "en"), (78, None, "de"), (79, " \n\t", None),
             (80, rows[3][1], None), (81, "only here", None), (82, "one", "fr"), (83, "ab " * 20_000, "en"), (84, "ed\nthe é 日本", "en")]
    return rows


def discounts(counts):
    seen = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
    if not all(seen):
        return [0.0, 0.5, 0.75, 0.9]
    y = seen[0] / (seen[0] + 2 * seen[1])
    raw = [k - (k + 1) * y * seen[k] / seen[k - 1] for k in (1, 2, 3)]
    return [0.0] + [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True)]


def plain(rows, share):
    """Row number -> word_ppl, from dictionaries of words."""
    split = [[(lang or "", w) for w in (text or "").encode().split()] for _, text, lang in rows]
    n, texts, pairs = Counter(), Counter(), Counter()
    for own in split:
        n.update(own)
        texts.update(set(own))
    total, cont = Counter(), Counter()
    for (lang, _w), c in n.items():
        total[lang] += c
    for (lang, _w), c in texts.items():
        cont[lang] += c
    cut = {lang: discounts([c for (own, _), c in texts.items() if own == lang]) for lang in total}
    unseen = {lang: sum(cut[lang][min(c, 3)] for (own, _), c in texts.items() if own == lang)
              / cont[lang] / sum(1 for own, _ in texts if own == lang) for lang in total}

    def low(w):
        c = texts[w] - 1
        return unseen[w[0]] + (max(c - cut[w[0]][min(c, 3)], 0) / cont[w[0]] if c else 0)

    frequent = {w for w in n if texts[w] > 1 and n[w] >= share * total[w[0]]}
    for own in split:
        pairs.update((a, b) for a, b in zip(own, own[1:], strict=False) if a in frequent and b in frequent)
    off = discounts(pairs.values())
    back = {}
    for a in frequent:
        held = sum(c - off[min(c, 3)] for (h, _), c in pairs.items() if h == a and c > 1)
        back[a] = max(1 - held / n[a], 1e-6)
    out = []
    for own in split:
        mine = Counter((a, b) for a, b in zip(own, own[1:], strict=False))
        logs = []
        for i, w in enumerate(own):
            p = low(w)
            if i and own[i - 1] in frequent:
                p *= back[own[i - 1]]
                pair = (own[i - 1], w)
                c = pairs[pair] - mine[pair] if pairs[pair] > 1 else 0
                if c > 0:
                    p += (c - off[min(c, 3)]) / n[own[i - 1]]
            logs.append(math.log(p))
        out.append(-sum(logs) / len(logs) if logs else None)
    return out


@pytest.mark.parametrize("common", [5e-7, 0.001])
def test_word_perplexity_equals_a_plain_version(spark, corpus, monkeypatch, common):
    monkeypatch.setattr(word_model, "COMMON", common)
    monkeypatch.setattr(word_model, "FREQUENT", 0.03)
    got = perplexity.quality(table(spark, corpus)).select("doc_id", "n_words", "word_ppl").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)
    got = sorted(((r["doc_id"], r["word_ppl"]) for r in got), key=key)
    want = sorted(((doc_id, p) for (doc_id, *_), p in zip(corpus, plain(corpus, 0.03), strict=True)), key=key)
    assert [i for i, _ in got] == [i for i, _ in want]
    for (_, a), (_, b) in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-9) if b is not None else a is None


def test_the_lower_order_is_a_distribution(spark, corpus):
    rows = [{"word_lang": "en", "k": i, "n": c, "texts": c} for i, c in enumerate([1] * 9 + [2] * 5 + [3] * 3 + [4] * 2 + [9])]
    words = spark.createDataFrame(rows, "word_lang string, k long, n long, texts long")
    stats = word_model.with_unseen(word_model.languages(words)).first()
    off = discounts([r["texts"] for r in rows])
    seen = sum((r["texts"] - off[min(r["texts"], 3)]) / stats["continuations"] for r in rows)
    assert seen + math.exp(stats["unseen"]) * stats["kinds"] == pytest.approx(1)


def test_words_of_no_order_and_of_another_language_go(spark):
    rng = np.random.default_rng(4)
    parts = ["the", "ing", "on", "ed", "re", "st", "and", "er"]
    # Both languages are spelled alike, so only their words tell them apart.
    stock = made(rng, parts, 400)
    rng.shuffle(stock)
    one, two = stock[:200], stock[200:]
    rows = [(i, sentences(rng, one, 150), "en") for i in range(150)] + [(200 + i, sentences(rng, two, 150), "fr") for i in range(150)]
    rows += [(1000 + i, sentences(rng, two, 150), "en") for i in range(10)]
    rows += [(2000 + i, " ".join(rng.choice(one[60:], 150)), "en") for i in range(10)]
    got = {r["doc_id"]: r["kept"] for r in perplexity.quality(table(spark, rows)).collect()}
    assert not any(kept for i, kept in got.items() if i >= 1000)
    assert sum(kept for i, kept in got.items() if i < 1000) >= 290


def test_no_rows(spark):
    assert perplexity.quality(table(spark, [(1, "a", "en")]).limit(0)).count() == 0
    got = perplexity.quality(table(spark, [(1, None, None), (2, "", "en")])).collect()
    assert [(r["n_words"], r["word_ppl"], r["kept"]) for r in got] == [(0, None, False)] * 2


@pytest.mark.parametrize("travel", [1, 25])
def test_pairs_that_do_not_travel_count_all_the_same(spark, corpus, monkeypatch, travel):
    monkeypatch.setattr(word_model, "FREQUENT", 0.03)
    monkeypatch.setattr(word_model, "PAIRS", travel)
    got = perplexity.quality(table(spark, corpus)).select("doc_id", "word_ppl").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)
    got = sorted(((r["doc_id"], r["word_ppl"]) for r in got), key=key)
    want = sorted(((doc_id, p) for (doc_id, *_), p in zip(corpus, plain(corpus, 0.03), strict=True)), key=key)
    assert [i for i, _ in got] == [i for i, _ in want]
    for (_, a), (_, b) in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-9) if b is not None else a is None
