"""Sentences and the places where they start, against a plain reading of the same rules."""

import random
import re

import numpy as np

from logweir.llm import spans


def plain(text):
    for m in spans._SENTENCE.finditer(text):
        raw = [(w.start(), w.group().lower()) for w in re.finditer(r"\S+", m.group())]
        places = spans.cuts([w for _, w in raw]) if len(raw) > spans.LONGEST else [0]
        for i, j in zip(places, [*places[1:], len(raw)]):
            yield m.start() + raw[i][0], [w for _, w in raw[i:j]]


def test_sentences_start_where_their_words_do():
    rng = random.Random(3)
    for turn in range(600):
        stock = ["Foo", "bar", "ODOΣ", "Σ", "İstanbul", "a", "ß", "日本", "K̇", "\x1c", "ǅ"][turn % 3 // 2 * 5:]
        stock = [w for w in stock if turn % 2 or not {"İ", "Σ"} & set(w)]
        gaps = [" "] * 60 + [". ", "\n", " ."] + ["  ", "\t", " ", "。", "? \n", "... "] * (turn % 4)
        text = "".join(rng.choice(stock) + rng.choice(gaps) for _ in range(rng.choice([0, 1, 5, 60, 300])))
        wanted = list(plain(text))
        assert spans.sentences(text) == wanted
        assert spans.sentence_starts(text) == [at for at, _ in wanted]
        assert spans._without(text, None) == (text, len(wanted), 0)


def test_cuts_are_the_words_of_least_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 16, 17, 18, 60, 300):
        own = [f"w{k}" for k in rng.integers(0, 9, n)]
        got = spans.cuts(own)
        assert got == sorted(set(got)) and got[0] == 0 and np.diff([*got, n]).max(initial=0) <= max(spans.NEAR, 16)


def test_runs_come_in_order_and_once():
    for counts in ([], [1], [9], [3, 3, 3, 3], [1] * 30, [8, 1, 8, 1, 1, 1]):
        first, last = spans.runs(counts)
        pairs = list(zip(first.tolist(), last.tolist()))
        assert pairs == sorted(set(pairs)) and all(b > a and sum(counts[a:b + 1]) >= spans.WORDS for a, b in pairs)
