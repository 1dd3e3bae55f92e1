"""A modified Kneser-Ney model of words, two in a row, for each language, counted by Spark over whole texts.

A word is the 64-bit hash of its bytes and its language. The lower order counts every word of the corpus by its
continuations, here the number of texts that it occurs in, so that a text's repetitions earn nothing; it grows with the
corpus and is met by a join. The higher order holds all pairs of frequent words. What is common (at most 1 / COMMON words,
PAIRS pairs) lies in sorted arrays of hashes that travel to the tasks, which score it on the spot; only rarer words and
pairs are sent to the joins, so no key of them is hot. A text is scored without its own counts.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import arrow_map, kept, rows_of
from logweir.llm.common import words as words_of
from logweir.operators.joins import is_small

#: A word travels to the tasks where it makes up this share of all words: two million words at most, and the same part of
#: the words is left for the join at every size. Scores do not depend on it, but for FREQUENT.
COMMON = 5e-7
#: A word begins or ends a pair where it makes up this share of its language's words, and travels.
FREQUENT = 1e-4
#: Pairs that travel, the commonest; all others are joined, so scores do not depend on it.
PAIRS = 1 << 20
#: Hashes that a task holds before it sums them and sends them on.
HELD = 1 << 22


def hashes(text: str | None, lang: str) -> np.ndarray:
    """The hash of every word of a text, in order; the same word of two languages is two words."""
    return hashed(words_of(text), lang)


def hashed(own: list[bytes], lang: str) -> np.ndarray:
    seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), seed=1))
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)) ^ seed).view(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word_lang, k, n, texts): how often a word occurs, and in how many texts; each task sums its own first."""
    schema = pa.schema([("word_lang", pa.string()), ("k", pa.int64()), ("n", pa.int64()), ("texts", pa.int64())])

    def summed(lang: str, held: list) -> Iterator[pa.RecordBatch]:
        k, at = np.unique(np.concatenate([a for a, _ in held]), return_inverse=True)
        n = np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)
        texts = np.bincount(at)
        for i in range(0, len(k), 50_000):
            part = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k[part])), pa.array(k[part]), pa.array(n[part]),
                                              pa.array(texts[part])], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0
        for text, lang in rows_of(batches, "text", "lang"):
            own, n = np.unique(hashes(text, lang), return_counts=True)
            if len(own):
                held.setdefault(lang, []).append((own, n))
                size += len(own)
            if size >= HELD:
                for name, parts in held.items():
                    yield from summed(name, parts)
                held, size = {}, 0
        for name, parts in held.items():
            yield from summed(name, parts)

    found = arrow_map(docs.select("text", "lang"), count, "word_lang string, k long, n long, texts long")
    return found.groupBy("word_lang", "k").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def _discount(value: Column, seen: dict[int, Column]) -> Column:
    """Chen and Goodman's discount of a count, from the counts of counts; fixed ones where these give none."""
    y = seen[1] / (seen[1] + 2 * seen[2])
    usual = {k: F.greatest(F.least(k - (k + 1) * y * seen[k + 1] / seen[k], F.lit(k - 0.05)), F.lit(0.05)) for k in (1, 2, 3)}
    whole = (seen[1] > 0) & (seen[2] > 0) & (seen[3] > 0) & (seen[4] > 0)
    picked = [F.when(whole, usual[k]).otherwise(F.lit(fixed)) for k, fixed in ((1, 0.5), (2, 0.75), (3, 0.9))]
    return F.when(value <= 0, F.lit(0.0)).when(value == 1, picked[0]).when(value == 2, picked[1]).otherwise(picked[2])


def languages(words: DataFrame) -> DataFrame:
    """One row a language: its words, its kinds of words, its continuations and their counts of counts."""
    return words.groupBy("word_lang").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("texts").alias("continuations"),
        *[F.count_if(F.col("texts") == k).alias(f"seen{k}") for k in (1, 2, 3, 4)])


def lower_order(words: DataFrame, stats: DataFrame) -> DataFrame:
    """(word_lang, k, n, total, logp) of the words of two texts and more: the logarithm of the lower order's
    probability, with one text less than there are. A word of no other text has ``unseen`` of its language."""
    seen = {k: F.col(f"seen{k}") for k in (1, 2, 3, 4)}
    joined = words.where("texts > 1").join(F.broadcast(stats) if is_small(stats) else stats, "word_lang")
    others = F.col("texts") - 1
    p = (others - _discount(others, seen)) / F.col("continuations") + F.exp("unseen")
    return joined.select("word_lang", "k", "n", "total", F.log(p).alias("logp"))


def with_unseen(stats: DataFrame) -> DataFrame:
    """The languages with ``unseen``, the logarithm of an unseen word's probability: what the discounts take,
    over the kinds of words."""
    seen = {k: F.col(f"seen{k}") for k in (1, 2, 3, 4)}
    taken = sum((_discount(F.lit(k), seen) * F.col(f"seen{k}") for k in (1, 2)), F.lit(0.0))
    taken = taken + _discount(F.lit(3), seen) * (F.col("kinds") - F.col("seen1") - F.col("seen2"))
    return stats.withColumn("unseen", F.log(taken / F.col("continuations") / F.col("kinds")))


class Common:
    """The common words and pairs in sorted arrays: what a task scores without a join."""

    def __init__(self, k: np.ndarray, n: np.ndarray, logp: np.ndarray, total: np.ndarray):
        order = np.argsort(k)
        self.k, self.n, self.logp = k[order], n[order], logp[order]
        frequent = np.flatnonzero(self.n >= FREQUENT * total[order])
        self.place = np.full(len(k), -1, np.int64)  # of a word among the frequent ones
        self.place[frequent] = np.arange(len(frequent))
        self.frequent, self.heads = self.k[frequent], self.n[frequent].astype(np.float64)
        self.pairs, self.pair_n, self.discounts = np.empty(0, np.int64), np.empty(0, np.int64), np.array([0, 0.5, 0.75, 0.9])
        self.back = np.zeros(len(frequent))
        self.after = self.logp[frequent]
        self.whole = True  # no pair is left for the join

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of frequent words that stand side by side, and where their second word stands."""
        both = np.flatnonzero((numbers[:-1] >= 0) & (numbers[1:] >= 0))
        return numbers[both] * len(self.heads) + numbers[both + 1], both + 1

    def set_pairs(self, pairs: np.ndarray, n: np.ndarray, discounts: np.ndarray, others: pa.Table | None = None) -> None:
        """The pairs that travel; of the ``others`` the counts of each head: all, pairs found twice, and found oftener."""
        order = np.argsort(pairs)
        self.pairs, self.pair_n, self.discounts = pairs[order], n[order], discounts
        head = self.pairs // max(len(self.heads), 1)
        held = np.bincount(head, self.pair_n - discounts[np.minimum(self.pair_n, 3)], minlength=len(self.heads))
        if others is not None:
            at, total, twice, more = (others.column(c).to_numpy() for c in ("head", "total", "twice", "more"))
            held[at] += total - discounts[2] * twice - discounts[3] * more
            self.whole = False
        # What the pairs of a head leave over is the weight of the lower order after it.
        self.back = np.log(np.maximum(1 - held / np.maximum(self.heads, 1), 1e-6))

    def score(self, kinds: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The log-probability of a text's words as far as it is known here, the hashes and counts of the words whose
        lower order is still to be added, and the pairs and their counts whose higher order is; the text is its kinds of
        words, which of them stands at each place, and how often each does."""
        place, there = _find(self.k, kinds)
        none = np.empty(0, np.int64)
        if not len(self.k):
            return 0.0, kinds, n, none, none
        logp = np.where(there, self.logp[place], 0.0)[at]
        numbers = np.where(there, self.place[place], -1)[at]
        after = np.flatnonzero(numbers[:-1] >= 0)
        logp[after + 1] += self.back[numbers[after]]
        pairs, where = self.joined(numbers)
        # Searched for once each and in their order, pairs are found sooner.
        pairs, which, often = np.unique(pairs, return_inverse=True, return_counts=True)
        spot, known = _find(self.pairs, pairs)
        if known.any():
            others = np.zeros(len(pairs), np.int64)
            others[known] = self.pair_n[spot[known]] - often[known]
            others = others[which]
            seen = others > 0
            count, where = others[seen], where[seen]
            head = self.heads[numbers[where - 1]]
            high = (count - self.discounts[np.minimum(count, 3)]) / head
            logp[where] = np.log(high + np.exp(logp[where]))
        left = (none, none) if self.whole else (pairs[~known], often[~known])
        return float(logp.sum()), kinds[~there], n[~there], *left

    def based(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often the first word of each pair stands, and the log-probability of the second without the pair."""
        head, second = np.divmod(pairs, max(len(self.heads), 1))
        return self.heads[head], self.back[head] + self.after[second]


def _find(held: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(held):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
    return place, held[place] == wanted


def pair_counts(docs: DataFrame, model: Common) -> DataFrame:
    """(pair, n) of the frequent words that stand side by side, over every text; each task sums its own first."""
    sent = docs.sparkSession.sparkContext.broadcast(model.frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def summed() -> Iterator[pa.RecordBatch]:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(pair), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(pair[i:i + 50_000]), pa.array(n[i:i + 50_000])], names=["pair", "n"])

        for text, lang in rows_of(batches, "text", "lang"):
            number, there = _find(sent.value, hashes(text, lang))
            both = np.flatnonzero(there[:-1] & there[1:])
            held.append(number[both] * len(sent.value) + number[both + 1])
            size += len(both)
            if size >= HELD:
                yield from summed()
                held, size = [], 0
        if size:
            yield from summed()

    return arrow_map(docs.select("text", "lang"), count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def common_model(docs: DataFrame, low: DataFrame, stats: DataFrame, folder: str) -> tuple[Common, DataFrame | None]:
    """The arrays that travel, and a table of the pairs that do not (none if all do).

    At most 1 / COMMON words and PAIRS pairs come to the driver, and a row for each frequent word, whatever the corpus.
    A pair found once has no other text than its own, so it is not in the model.
    """
    every = stats.agg(F.sum("total")).first()[0] or 0  # of one row a language
    top = low.where(F.col("n") >= COMMON * every).select("k", "n", "logp", "total").toArrow()
    model = Common(*(top.column(c).to_numpy() for c in ("k", "n", "logp", "total")))
    spark = docs.sparkSession
    counted = kept(pair_counts(docs, model), folder, "pairs")
    seen = {k: F.lit(v) for k, v in zip((1, 2, 3, 4), counted.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first(), strict=True)}
    discounts = spark.range(1).select(*[_discount(F.lit(k), seen) for k in (0, 1, 2, 3)]).first()
    several = counted.where("n > 1")
    found = several.orderBy(F.desc("n"), "pair").limit(PAIRS).toArrow()
    pairs, n = (found.column(c).to_numpy() for c in ("pair", "n"))
    discounts = np.array(discounts, np.float64)
    if len(pairs) < PAIRS:
        model.set_pairs(pairs, n, discounts)
        return model, None
    last, least = int(pairs[-1]), int(n[-1])
    rest = several.where((F.col("n") < least) | ((F.col("n") == least) & (F.col("pair") > last)))
    heads = rest.groupBy(F.floor(F.col("pair") / len(model.heads)).alias("head")).agg(
        F.sum("n").alias("total"), F.count_if(F.col("n") == 2).alias("twice"), F.count_if(F.col("n") > 2).alias("more"))
    model.set_pairs(pairs, n, discounts, heads.toArrow())
    return model, kept(_based(rest, model), folder, "rest")


def _based(rest: DataFrame, model: Common) -> DataFrame:
    """(pair, n, head, base): pairs with what their score is made of, see :meth:`Common.based`."""
    sent = rest.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, base = sent.value.based(batch.column("pair").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("pair"), batch.column("n"), pa.array(head), pa.array(base)],
                                             names=["pair", "n", "head", "base"])

    return rest.select("pair", "n").mapInArrow(task, "pair long, n long, head double, base double")


class WordModel:
    """The model of a table of texts: ``common`` goes to the tasks, ``lower`` and ``stats`` are joined."""

    def __init__(self, docs: DataFrame, folder: str):
        """``docs`` has ``text`` and ``lang``, the latter not null; tables are written below ``folder``."""
        words = kept(word_counts(docs), folder, "words")
        self.stats = kept(with_unseen(languages(words)), folder, "languages")
        self.lower = kept(lower_order(words, self.stats), folder, "lower")
        self.common, self.rest = common_model(docs, self.lower, self.stats, folder)

    def finished(self, scored: DataFrame) -> DataFrame:
        """``scored`` with ``word_ppl``, the mean negative log-probability a word in nats (null without words), for its
        columns known, rare, times, pairs and pair_times, which it loses. Rows have ``row``, a key, and ``lang`` and
        ``n_words``.

        A hash holds the language of its word, so rare words are joined on it alone; so does a pair's number.
        """
        asked = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select(
            "row", F.col("w.rare").alias("k"), F.col("w.times").alias("times"))
        found = asked.join(self.lower.select("k", "logp"), "k").groupBy(F.col("row").alias("of")).agg(
            F.sum(F.col("times") * F.col("logp")).alias("added"), F.sum("times").alias("found"))
        sent = F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x)
        rows = scored.withColumn("sent", sent).drop("rare", "times", "pairs", "pair_times").join(
            found, F.col("row") == F.col("of"), "left")
        gained = F.lit(0.0)
        if self.rest is not None:
            rows = rows.join(self._gains(scored), F.col("row") == F.col("paired"), "left").drop("paired")
            gained = F.coalesce("gained", F.lit(0.0))
        unseen = self.stats.select("word_lang", "unseen")
        rows = rows.join(F.broadcast(unseen) if is_small(unseen) else unseen, F.col("lang") == F.col("word_lang"), "left")
        absent = F.col("sent") - F.coalesce("found", F.lit(0))
        total = F.col("known") + gained + F.coalesce("added", F.lit(0.0)) + F.when(absent > 0, absent * F.col("unseen")).otherwise(0.0)
        return rows.withColumn("word_ppl", F.when(F.col("n_words") > 0, -total / F.col("n_words"))).drop(
            "known", "sent", "of", "added", "found", "word_lang", "unseen", "gained")

    def _gains(self, scored: DataFrame) -> DataFrame:
        """(paired, gained): what the pairs that did not travel add to the score of each row, its own counts left out."""
        asked = scored.select("row", F.explode(F.arrays_zip("pairs", "pair_times")).alias("p")).select(
            F.col("row").alias("paired"), F.col("p.pairs").alias("pair"), F.col("p.pair_times").alias("often"))
        others = F.col("n") - F.col("often")
        kinds = [F.lit(float(d)) for d in self.common.discounts]
        taken = F.when(others == 1, kinds[1]).when(others == 2, kinds[2]).otherwise(kinds[3])
        gain = F.log((others - taken) / F.col("head") + F.exp("base")) - F.col("base")
        return asked.join(self.rest, "pair").where(others > 0).groupBy("paired").agg(
            F.sum(F.col("often") * gain).alias("gained"))
