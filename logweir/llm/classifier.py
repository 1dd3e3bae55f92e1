"""A quality classifier: random-indexing word vectors, pooled per document, under a small network.

A word falls into one of BUCKETS rows by its letters, and its shape (case, last sign, whether it repeats the
word before) into one of a few more. Each row has a sparse random index vector; the vector of a row is its
own index vector and the sum of those beside it over the whole corpus. The table has a fixed size, so it
may travel to every task.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.llm.common import arrow_map, kept, rows_of, work_folder

#: Rows for words, rows for shapes, components of a vector, entries of an index vector.
BUCKETS, SHAPES, SIZE, ENTRIES = 1 << 13, 64, 24, 4
ROWS = BUCKETS + SHAPES
#: At most so many labelled documents teach the network; those with the smallest hash of their id.
LABELLED = 20_000
HIDDEN, EPOCHS, SEED = 24, 300, 7
#: Documents with crc32(doc_id) mod FOLDS = 0 are held out; those with 1 set the temperature.
FOLDS = 5
THRESHOLD = 0.3


_LAST_SIGN = {ord(c): k for k, group in enumerate((".", ",", "!?", "|", "*#$%&<>", ";:)\"'", "0123456789"), 1) for c in group}


class Words:
    """Rows of the words of a text; what a word gives is kept in a bounded table."""

    def __init__(self, most: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def _row(self, word: bytes) -> int:
        core = word.strip(b".,;:!?()*#$%&|\"'<>")
        case = 0 if word.islower() else 1 if core[:1].isupper() and core[1:].islower() else 2 if word.isupper() else 3
        row = (zlib.crc32(core.lower()) & (BUCKETS - 1)) * SHAPES + 2 * (case * 8 + _LAST_SIGN.get(word[-1], 0))
        self.known[word] = row
        return row

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The word row and the shape row of each word."""
        raw = text.encode("utf-8", "surrogatepass").split() if text else []
        if len(self.known) > self.most:
            self.known.clear()
        known, new = self.known, self._row
        packed = np.array([known[w] if w in known else new(w) for w in raw], np.int64)
        word, shape = packed // SHAPES, packed % SHAPES
        shape[1:] += word[1:] == word[:-1]
        return word, shape + BUCKETS


def index_vectors() -> np.ndarray:
    """A few entries of plus and minus one in each row."""
    rng = np.random.default_rng(SEED)
    table = np.zeros((ROWS, SIZE), np.float32)
    for row in table:
        row[rng.choice(SIZE, ENTRIES, replace=False)] = rng.choice((-1, 1), ENTRIES)
    return table


def word_vectors(docs: DataFrame, folder: str) -> np.ndarray:
    """The table of vectors: sums over every word of every text, by tasks and then by row. A word stands
    beside its shape and the word after it. ROWS rows come to the driver, however large the corpus is."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, index = Words(), index_vectors()
        total = np.zeros((ROWS, SIZE), np.float64)
        held, size = [], 0

        def settle():
            both = np.concatenate(held)
            own, n = np.unique(np.concatenate([both, both % ROWS * ROWS + both // ROWS]), return_counts=True)
            for k in range(SIZE):
                total[:, k] += np.bincount(own // ROWS, n * index[own % ROWS, k], ROWS)

        for (text,) in rows_of(batches, "text"):
            word, shape = words.of(text)
            held += [word * ROWS + shape, word[:-1] * ROWS + word[1:]]
            size += len(word)
            if size > 1_000_000:
                settle()
                held, size = [], 0
        if size:
            settle()
        at = np.flatnonzero(np.abs(total).sum(1))
        if len(at):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * SIZE + 1, SIZE, np.int32)), pa.array(np.rint(total[at]).astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), lists], names=["word", "sums"])

    parts = arrow_map(docs.select("text"), gather, "word int, sums array<long>")
    summed = parts.groupBy("word").agg(*[F.sum(F.element_at("sums", k + 1)).alias(f"s{k}") for k in range(SIZE)])
    table = np.zeros((ROWS, SIZE), np.float32)
    for row in kept(summed, folder, "words").collect():
        table[row["word"]] = row[1:]
    length = np.sqrt((table * table).sum(1, keepdims=True))
    context = np.divide(table, length, out=np.zeros_like(table), where=length > 0)
    return context + index_vectors() / np.float32(ENTRIES**0.5)


def features(texts: list[str | None], words: Words, table: np.ndarray) -> np.ndarray:
    """The mean vector of each text's words beside that of its shapes; zeros for a text without words."""
    out = np.zeros((len(texts), 2 * SIZE), np.float64)
    for i, text in enumerate(texts):
        word, shape = words.of(text)
        if len(word):
            out[i, :SIZE], out[i, SIZE:] = table[word].mean(0), table[shape].mean(0)
    return out


class Network:
    """Two layers of numpy: tanh, then a logistic unit whose logit a temperature divides."""

    def __init__(self, x: np.ndarray, y: np.ndarray, check_x: np.ndarray, check_y: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = self._scaled(x)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.w = [rng.normal(0, 1 / x.shape[1] ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, 1 / HIDDEN**0.5, (HIDDEN, 1)), np.array([np.log(rate / (1 - rate))])]
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for turn in range(1, EPOCHS + 1):
            hidden = np.tanh(x @ self.w[0] + self.w[1])
            gap = (_logistic(hidden @ self.w[2] + self.w[3]) - y[:, None]) / len(y)
            back = (gap @ self.w[2].T) * (1 - hidden * hidden)
            steps = [x.T @ back + 1e-4 * self.w[0], back.sum(0), hidden.T @ gap + 1e-4 * self.w[2], gap.sum(0)]
            for k, g in enumerate(steps):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.w[k] -= 0.02 * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)
        self.temperature = 1.0
        if len(check_y):
            logits, tried = self._logits(check_x), np.geomspace(0.25, 8, 61)
            self.temperature = float(min(tried, key=lambda t: _loss(logits / t, check_y)))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh(self._scaled(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3])[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self._logits(x) / self.temperature)

    @classmethod
    def of(cls, state: dict) -> "Network":
        """A network from the plain arrays of another, in which form it travels."""
        own = cls.__new__(cls)
        own.__dict__.update(state)
        return own


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(_logistic(logits), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray) -> Network | float:
    """The network, or the share of good documents where labels are missing or all alike.

    Labels of held-out documents are left out before anything else; LABELLED bounds the labels in use, and
    so what is broadcast and what comes to the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("double").alias("label")).where(
        F.col("label").isin(0.0, 1.0) & (_fold(F.col("label_id")) != 0)).dropDuplicates(["label_id"])
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(LABELLED)
    named = docs.select(F.col("doc_id").cast("long").alias("own_id"), "text").join(
        F.broadcast(known), F.col("own_id") == F.col("label_id")).select("own_id", "label", "text")
    sent = docs.sparkSession.sparkContext.broadcast(vectors)  # ROWS x SIZE numbers

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            found = features(batch.column(2).to_pylist(), words, sent.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, 2 * SIZE, np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["own_id", "label", "features"])

    rows = arrow_map(named, pool, "own_id long, label double, features array<double>")
    rows = rows.orderBy("own_id", "features").limit(2 * LABELLED).withColumn("fold", _fold(F.col("own_id"))).collect()
    x = np.array([r["features"] for r in rows], np.float64).reshape(len(rows), 2 * SIZE)
    y, check = np.array([r["label"] for r in rows]), np.array([r["fold"] == 1 for r in rows], bool)
    if len(set(y[~check])) < 2:
        return float(y.mean()) if len(y) else 0.5
    return Network(x[~check], y[~check], x[check], y[check])


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row``, every document as it was, and its ``quality_score``."""
    vectors = word_vectors(docs, work_folder(docs.sparkSession, "classifier"))
    trained = train(docs, labels, vectors)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, trained if isinstance(trained, float) else vars(trained)))
    own = docs.select(F.struct("*").alias("row"), "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, state = sent.value
        network = Network.of(state) if isinstance(state, dict) else None
        words = Words()
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                x = features(part.column(1).to_pylist(), words, table)
                found = network.score(x) if network else np.full(len(x), state)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["row", "quality_score"])

    return arrow_map(own, score, T.StructType([own.schema["row"], T.StructField("quality_score", T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Word vectors come from all texts, labels only from rows that are not held out; an empty or null text has
    zero features and a score like any other. Rows that share an id are scored each; a null id isn't held
    out. Labels of unknown documents, null labels and labels other than 0 and 1 are passed over.
    """
    doc_id = F.col("row.doc_id").cast("long")
    return scored(docs, labels).select(doc_id.alias("doc_id"), F.coalesce(_fold(doc_id) == 0, F.lit(False)).alias("held_out"),
                                       F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, in their own columns."""
    return scored(docs, labels).where(F.col("quality_score") >= THRESHOLD).select("row.*")
