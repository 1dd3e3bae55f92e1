"""Quality rules with perplexity under modified Kneser-Ney models, counted by Spark over the whole corpus.

One model is of words, two in a row, for each language (``word_model``); it grows with the corpus. The other is of
spelling: 40 classes of characters, four in a row, for all languages, at most 40 + 40^2 + 40^3 + 40^4 entries however
large the corpus is. Its sorted arrays hold the packed symbols of each n-gram, a hash without collisions, with the
logarithms of probability and back-off weight beside them. A document stays if it lies in its language's band under both.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import arrow_map, batches_of, kept, rows_of, work_folder
from logweir.llm.common import words as words_of
from logweir.llm.word_model import WordModel, hashed
from logweir.operators.joins import is_small

ORDER, SYMBOLS = 4, 40
#: Rules before the model: too few words, or too many words in windows of three that repeat.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A language's band reaches from its median log-perplexity this many robust standard deviations to either
#: side (the usual bound of outliers), and at least this far, in nats a symbol.
REACH, LEAST_REACH = 3.5, 0.05
#: The same least reach in nats a word, and how many times as far a band of words goes down as up: copies of
#: a text make its words likelier, which is no fault of the text.
LEAST_WORD_REACH, WORD_BELOW = 1.0, 2.0
#: Standard deviations of a normal spread in its median absolute deviation.
DEVIATION = 1.4826
#: Log-perplexities are counted in steps of this size to find the medians.
STEP = 0.005

# Fixed values of the base rules.
MARKS, GAPS = b"#*$%&|<>", b" \t\n\v\f\r"


def _classes() -> np.ndarray:
    """Symbol of each code point below 2^16: space, line end, a-z without case or accents, digits, marks."""
    import unicodedata

    table = np.empty(1 << 16, np.uint8)
    for cp in range(1 << 16):
        c = chr(cp)
        base = unicodedata.normalize("NFKD", c)[0].lower() if cp < 0x250 else c
        if c == "\n":
            table[cp] = 1
        elif c.isspace() or cp < 32:
            table[cp] = 0
        elif "a" <= base[0] <= "z":
            table[cp] = 2 + ord(base[0]) - 97
        elif c.isdigit():
            table[cp] = 28
        elif cp < 128 or not c.isalpha():
            table[cp] = {".": 29, ",": 30, "!": 31, "?": 31, "|": 32, "-": 33}.get(c, 34)
        else:
            table[cp] = 35 + (cp >> 7) % 5
    return table


class Symbols:
    """Texts as packed n-grams of symbols."""

    def __init__(self):
        self.table = _classes()

    def of(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return np.concatenate([np.zeros(ORDER - 1, np.int32), self.table[np.minimum(points, (1 << 16) - 1)].astype(np.int32)])

    @staticmethod
    def grams(symbols: np.ndarray, order: int = ORDER) -> np.ndarray:
        out = symbols[: len(symbols) - order + 1].copy()
        for k in range(1, order):
            out = out * SYMBOLS + symbols[k: len(symbols) - order + 1 + k]
        return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) over every character of every text; each task sums its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, total = Symbols(), np.zeros(SYMBOLS**ORDER, np.int64)
        for (text,) in rows_of(batches, "text"):
            if text:
                found = Symbols.grams(symbols.of(text))
                if len(found) > 100_000:
                    total += np.bincount(found, minlength=len(total))
                else:
                    np.add.at(total, found, 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 50_000):
            part = at[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["gram", "n"])

    counted = arrow_map(docs.select("text"), count, "gram int, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def _lower(df: DataFrame, order: int) -> DataFrame:
    """Counts of the next shorter n-grams: by how many different symbols each is preceded."""
    return df.groupBy((F.col("gram") % SYMBOLS ** (order - 1)).cast("int").alias("gram")).agg(F.count(F.lit(1)).alias("n"))


def kneser_ney(counts: DataFrame) -> list[tuple]:
    """For each order the sorted n-grams with their log-probabilities, and the sorted contexts with their
    log back-off weights.

    Spark makes the counts of each order; the highest has occurrences, lower ones have the number of
    symbols that precede. The discounts of one, two and three or more come from the counts of counts. At most
    2.6 million counts come to the driver, whatever the corpus.
    """
    grouped, levels = counts, []
    for order in range(ORDER, 0, -1):
        batch = grouped.orderBy("gram").toArrow()
        levels.append((batch.column("gram").to_numpy().astype(np.int64), batch.column("n").to_numpy().astype(np.float64)))
        grouped = _lower(grouped, order) if order > 1 else None
    model: list[tuple] = []
    for order, (grams, n) in enumerate(reversed(levels), 1):
        taken = _discounts(n)[np.minimum(n, 3).astype(int)]
        heads, at = np.unique(grams // SYMBOLS, return_inverse=True)
        total, weight = np.bincount(at, n), np.bincount(at, taken)
        weight = weight / np.maximum(total, 1)
        lower = np.exp(_logp(model, grams % SYMBOLS ** (order - 1), order - 1))
        p = (n - taken) / total[at] + weight[at] * lower
        model.append((grams, np.log(p), heads, np.log(weight), n))
    return model


def _discounts(n: np.ndarray) -> np.ndarray:
    """Chen and Goodman's three discounts; where the counts of counts give none, fixed ones."""
    n1, n2, n3, n4 = (float((n == k).sum()) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    found = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(found, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.9])


def _find(held: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted number in a sorted array, and whether it is there."""
    if not len(held):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
    return place, held[place] == wanted


def _logp(model: list[tuple], grams: np.ndarray, order: int) -> np.ndarray:
    """Log-probability of the last symbol of each n-gram after the others. An n-gram that was not seen has the weight
    of its context times the probability in the shorter one."""
    if order == 0:
        return np.full(len(grams), -np.log(SYMBOLS))
    held, logp, heads, weights, _ = model[order - 1]
    place, known = _find(held, grams)
    out = np.empty(len(grams))
    out[known] = logp[place[known]]
    rest = grams[~known]
    if len(rest):
        at, found = _find(heads, rest // SYMBOLS)
        back = np.zeros(len(rest))
        back[found] = weights[at[found]]
        out[~known] = back + _logp(model, rest % SYMBOLS ** (order - 1), order - 1)
    return out


class Spelling:
    """The model with the place of every possible n-gram and the weight of every context, so that none is searched for."""

    def __init__(self, model: list[tuple]):
        self.orders = []
        for order, (grams, logp, heads, weights, counts) in enumerate(model, 1):
            held, back = np.full(SYMBOLS**order, -1, np.int32), np.zeros(SYMBOLS ** (order - 1))
            held[grams] = np.arange(len(grams))
            back[heads] = weights
            self.orders.append((held, logp, back, counts) if len(grams) else (held, np.zeros(1), back, np.zeros(1)))

    def logp(self, grams: np.ndarray, order: int = ORDER, own: np.ndarray | None = None) -> np.ndarray:
        """The same as :func:`_logp`, but that an n-gram seen no oftener than its ``own`` count in the text in
        question counts as one that was not seen."""
        if order == 0:
            return np.full(len(grams), -np.log(SYMBOLS))
        held, logp, back, counts = self.orders[order - 1]
        place = held[grams]
        unknown = place < 0 if own is None else (place < 0) | (counts[place] <= own)
        out = logp[place]
        rest = grams[unknown]
        if len(rest):
            out[unknown] = back[rest // SYMBOLS] + self.logp(rest % SYMBOLS ** (order - 1), order - 1)
        return out


def log_perplexity(model: list | Spelling, symbols: np.ndarray) -> float | None:
    """Mean negative log-probability a symbol; none for an empty text."""
    grams = Symbols.grams(symbols)
    if not len(grams):
        return None
    own, n = np.unique(grams, return_counts=True)
    model = model if isinstance(model, Spelling) else Spelling(model)
    return float(-(model.logp(own, ORDER, n) * n).sum() / len(grams))


def base_counts(text: str | None, own: list[bytes] | None = None, at: np.ndarray | None = None) -> tuple[int, int, int, int, int]:
    """Words, their code points, marks, lines that repeat and words in repeated windows of three; the text's words
    and their numbers may be given."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8")
    own = raw.split() if own is None else own
    gaps = len(raw) - len(raw.translate(None, GAPS))
    marks = len(raw) - len(raw.translate(None, MARKS))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()] if b"\n" in raw else []
    if at is None:
        number: dict[bytes, int] = {}
        at = np.array([number.setdefault(w, len(number)) for w in own], np.int64)
    return len(own), len(text) - gaps, marks, len(lines) - len(set(lines)), repeated_words(at)


def repeated_words(ids: np.ndarray) -> int:
    """Words, given by their numbers, that lie in a window of three words found twice or more in the text."""
    if len(ids) < 4:
        return 0
    kinds = int(ids.max()) + 1
    pairs = ids[:-1] * kinds + ids[1:]
    if kinds >= 1 << 21:  # three numbers would not fit 64 bits
        _, pairs = np.unique(pairs, return_inverse=True)
    windows = pairs[:-1] * kinds + ids[2:]
    ranked = np.sort(windows)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    often = _find(twice, windows)[1]
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k: len(ids) - 2 + k] |= often
    return int(inside.sum())


def quality(docs: DataFrame, reach: float = REACH) -> DataFrame:
    """Every document with its counts, ``base_failed``, ``log_ppl`` (a symbol), ``word_ppl`` (a word) and ``kept``.

    The models are counted over all texts, each text is scored under them without its own counts, and a language's
    bands come from the median and the median absolute deviation of its documents that pass the base rules; what lies
    above one (noise, words in no order of that language, another language) or below it (repetition) is rejected. A
    null language is a language. A null or empty text has no words and fails the base rules. Rows stay as they are,
    repeated ones too; no rows give no rows.
    """
    folder = work_folder(docs.sparkSession, "quality")
    own = docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    words = WordModel(own, folder)
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((kneser_ney(kept(gram_counts(own), folder, "grams")), words.common))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()),
                        ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
                        ("n_repeat_words", pa.int64()), ("log_ppl", pa.float64()), ("known", pa.float64()),
                        ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())),
                        ("pairs", pa.list_(pa.int64())), ("pair_times", pa.list_(pa.int32()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        symbols, (model, common) = Symbols(), sent.value
        spelling = Spelling(model)
        first = TaskContext.get().partitionId() << 40

        def rows():
            for at, (doc_id, text, lang) in enumerate(rows_of(batches, "doc_id", "text", "lang")):
                own = words_of(text)
                kinds, numbers, n = np.unique(hashed(own, lang), return_inverse=True, return_counts=True)
                yield (first + at, doc_id, lang, *base_counts(text, own, numbers), log_perplexity(spelling, symbols.of(text or "")),
                       *common.score(kinds, numbers, n))

        yield from batches_of(rows(), schema, at_most=500)

    scored = kept(arrow_map(own, score, "row long, doc_id long, lang string, n_words long, word_chars long, n_symbols long, "
                            "n_dup_lines long, n_repeat_words long, log_ppl double, known double, rare array<long>, "
                            "times array<int>, pairs array<long>, pair_times array<int>"), folder, "scored")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scored = kept(words.finished(scored).withColumn("base_failed", failed), folder, "finished")
    good = scored.where("NOT base_failed")
    limits = kept(bands(good, reach).withColumnRenamed("lang", "band_lang").join(
        bands(good, reach, "word_ppl", LEAST_WORD_REACH, WORD_BELOW).select(
            F.col("lang").alias("word_lang"), F.col("low").alias("word_low"), F.col("high").alias("word_high")),
        F.col("band_lang") == F.col("word_lang")), folder, "bands")
    # One row a language: a language of most documents is not gathered in one task.
    joined = scored.join(F.broadcast(limits) if is_small(limits) else limits, F.col("lang") == F.col("band_lang"), "left")
    inside = F.col("log_ppl").between(F.col("low"), F.col("high")) & F.col("word_ppl").between(F.col("word_low"), F.col("word_high"))
    return joined.select(*[c for c in scored.columns if c not in ("lang", "row")], F.when(F.col("base_failed"), False).otherwise(
        F.coalesce(inside, F.lit(False))).alias("kept"))


def bands(scored: DataFrame, reach: float = REACH, value: str = "log_ppl", least: float = LEAST_REACH, below: float = 1.0) -> DataFrame:
    """(lang, low, high) from the median and the median absolute deviation of each language's log-perplexities in
    the column ``value``; a band reaches ``least`` at least, and ``below`` times as far down as up.

    Neither can be carried off by less than half of the documents. Copies of a text have one log-perplexity and
    count once, so that a large group of them does not shrink the band to itself. All is read off a histogram,
    which is exact to a step, the same in every run, and has a few thousand rows a language at most.
    """
    bins = scored.where(F.col(value).isNotNull()).select("lang", value).distinct().groupBy(
        "lang", F.floor(F.col(value) / STEP).cast("double").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    middle = bins.groupBy(F.col("lang").alias("of")).agg(F.percentile("bin", F.lit(0.5), F.col("n")).alias("mid"))
    off = bins.join(middle, F.col("lang") == F.col("of")).groupBy("lang", "mid").agg(
        F.percentile(F.abs(F.col("bin") - F.col("mid")), F.lit(0.5), F.col("n")).alias("mad"))
    far = F.greatest(F.lit(reach * DEVIATION * STEP) * F.col("mad"), F.lit(least))
    centre = (F.col("mid") + 0.5) * STEP
    return off.select("lang", (centre - below * far).alias("low"), (centre + far).alias("high"))
