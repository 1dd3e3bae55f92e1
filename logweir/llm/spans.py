"""Removing passages that repeat: hashed runs of consecutive sentences, joined over all documents."""

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.llm.common import arrow_map, rows_of

#: A run holds at least two sentences and eight words, and no sentence that could be left out at either end.
SENTENCES, WORDS = 2, 8
#: A longer sentence is cut into pieces, which count as sentences, before the words of least hash in any
#: ``NEAR`` words in a row: so by its words alone, at any offset, and into at most ``NEAR`` words a piece.
LONGEST, NEAR = 25, 16
#: Runs that a task compares among themselves before it sends them on.
GATHERED = 1_000_000

#: A sentence ends at closing punctuation before white space, or at the end of its line.
_SENTENCE = re.compile(r"\S[^\n.!?。！？]*(?:[.!?。！？]+(?!\s|$)[^\n.!?。！？]*)*[.!?。！？]*", re.MULTILINE)
_WORD = re.compile(r"\S+")
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)
_LAST = (1 << 63) - 1  # stands for a null id


def sentences(text: str, longest: int = LONGEST) -> list[tuple[int, list[str]]]:
    """(start, words in lower case) of each sentence of a text."""
    found = []
    lower = _lowered(text)
    for m in _SENTENCE.finditer(text):
        start, end = m.span()
        own = m.group().lower().split() if lower is None else lower[start:end].split()
        if len(own) <= longest:
            found.append((start, own))
        else:
            places, starts, raw = _pieces(text, lower, start, end)
            found += [(at, raw[i:j]) for at, i, j in zip(starts, places, [*places[1:], len(raw)], strict=True)]
    return found


def sentence_starts(text: str, longest: int = LONGEST) -> list[int]:
    """Where each of the :func:`sentences` of a text starts; words are looked at in those alone that may be too long."""
    found = []
    lower = _lowered(text)
    for m in _SENTENCE.finditer(text):
        start, end = m.span()
        # Two characters a word and one more at the end: so short a sentence has no more words.
        if end - start < 2 * longest or len(m.group().split()) <= longest:
            found.append(start)
        else:
            found += _pieces(text, lower, start, end)[1]
    return found


def _lowered(text: str) -> str | None:
    """The text in lower case, if that changes each character by itself alone into one other."""
    return None if "\u0130" in text or "\u03a3" in text else text.lower()


def _pieces(text: str, lower: str | None, start: int, end: int) -> tuple[list[int], list[int], list[str]]:
    """The first word of each piece of a long sentence, where it starts in the text, and the words in lower case."""
    raw = [w.lower() for w in text[start:end].split()] if lower is None else lower[start:end].split()
    places = cuts(raw)
    ends = list(accumulate(map(len, raw), initial=start))
    if lower is not None and len(lower[start:end].rstrip()) == ends[-1] - start + len(raw) - 1:  # one space between any two
        return places, [ends[i] + i for i in places], raw
    starts = [w.start() for w in _WORD.finditer(text, start, end)]
    return places, [starts[i] for i in places], raw


def cuts(own: list[str]) -> list[int]:
    """First words of the pieces of a sentence: its first, and the last word of least hash in each window of
    ``NEAR``. Two sentences that share a passage are cut alike in it, but for ``NEAR`` words at its ends."""
    if len(own) <= NEAR:
        return [0]
    # A word's hash goes with those of the two before it, since a common word alone would cut too often.
    single = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    hashes = single * _BASES[0]
    hashes[1:] += single[:-1] * _BASES[1]
    hashes[2:] += single[:-2]
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    back, n = hashes[::-1].copy(), len(own) - NEAR + 1
    windows = np.ndarray((n, NEAR), np.uint64, back, 0, (8, 8))
    least = (len(own) - 1 - np.arange(n) - windows.argmin(axis=1))[::-1]  # never falls, as windows go on
    first = np.empty(n, bool)
    first[0], first[1:] = least[0] > 0, least[1:] != least[:-1]
    return [0, *least[first].tolist()]


def runs(counts: list[int], least: int = SENTENCES, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of every run: from each sentence the shortest forward and the shortest back
    that has enough sentences and words. A repeated passage is covered to both its ends by such runs."""
    n = len(counts)
    ends = np.concatenate([[0], np.cumsum(counts)])
    here = np.arange(n)
    last = np.maximum(here + least - 1, np.searchsorted(ends, ends[:-1] + words) - 1)
    first = np.minimum(here - least + 1, np.searchsorted(ends, ends[1:] - words, "right") - 1)
    forward, back = last < n, first >= 0
    pairs = np.unique(np.concatenate([here[forward] * n + last[forward], first[back] * n + here[back]]))
    return np.divmod(pairs, max(n, 1))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def run_hashes(units: list[list[str]], first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run, from differences of a running polynomial over the sentences' hashes."""
    raw = b"".join([xxhash.xxh3_128_digest(" ".join(u)) for u in units])
    own = np.frombuffer(raw, "<u8").reshape(-1, 2)
    out = []
    for k in (0, 1):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(own[:, k] * _powers(len(units), _BASES[k])[:-1], dtype=np.uint64)])
        whole = (sums[last + 1] - sums[first]) * _powers(len(units), _INVERSES[k])[first]
        whole ^= whole >> np.uint64(29)
        out.append((whole * np.uint64(0xBF58476D1CE4E5B9) + (last - first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _keys(docs: DataFrame) -> list[Column]:
    """A document's id, a few bits of its text, which keep rows that share an id apart, and its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("doc"),
            F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFF)).alias("mark"), text.alias("text")]


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc, mark, run) of every run that occurs earlier, in this document or one with a smaller id.

    A task settles the runs it meets more than once by itself and sends on only the first of equal runs, so
    of a run in any number of documents each task has one row in the shuffle. A run is its first sentence
    and its length in one number.
    """
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("known", pa.bool_())])

    def settle(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, at = (np.concatenate(p) for p in parts)
        order = np.lexsort((at, doc, h2, h1))
        h1, h2, doc, at = h1[order], h2[order], doc[order], at[order]
        known = np.zeros(len(h1), bool)
        known[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        # A settled row needs no company: it goes anywhere.
        h1 = np.where(known, (doc.astype(np.uint64) * _BASES[0] + at.astype(np.uint64) * _BASES[1]).view(np.int64), h1)
        for i in range(0, len(h1), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i:i + 50_000]) for c in (h1, h2, doc, at, known)], schema=schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], []]
        count = 0
        for doc, mark, text in rows_of(batches, "doc", "mark", "text"):
            units = [u for _, u in sentences(text)]
            if len(units) < SENTENCES:
                continue
            first, last = runs([len(u) for u in units])
            if not len(first):
                continue
            h1, h2 = run_hashes(units, first, last)
            at = (np.int64(mark) << 40) | (first.astype(np.int64) << 8) | (last - first).astype(np.int64)
            for part, own in zip(held, (h1, h2, np.full(len(first), doc, np.int64), at), strict=True):
                part.append(own)
            count += len(first)
            if count >= GATHERED:
                yield from settle(held)
                held, count = [[], [], [], []], 0
        if count:
            yield from settle(held)

    rows = arrow_map(docs.select(*_keys(docs)), hashed, "h1 long, h2 long, doc long, at long, known boolean")
    same = Window.partitionBy("h1", "h2").orderBy("doc", "at")
    later = rows.withColumn("nth", F.row_number().over(same)).where("known OR nth > 1")
    return later.select("doc", F.shiftright("at", 40).alias("mark"), F.col("at").bitwiseAND(F.lit((1 << 40) - 1)).alias("run"))


def cleaned(docs: DataFrame) -> DataFrame:
    """``row``, every document as it was, with ``clean``, its text without repeated sentences, and the numbers
    of its sentences and of those that went."""
    gone = repeated_runs(docs).groupBy("doc", "mark").agg(F.collect_set("run").alias("runs"))
    own = docs.select(F.struct("*").alias("row"), *(k.alias(n) for k, n in zip(_keys(docs), ("own", "own_mark", "old"), strict=True)))
    found = own.join(gone, (F.col("own") == F.col("doc")) & (F.col("own_mark") == F.col("mark")), "left").select("row", "old", "runs")
    out = T.StructType([found.schema["row"], T.StructField("clean", T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts, counts, removed = [], [], []
                for text, gone in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    text, all_of_it, lost = _without(text, gone)
                    texts.append(text)
                    counts.append(all_of_it)
                    removed.append(lost)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())],
                    names=["row", "clean", "n_sentences", "n_removed"])

    return found.mapInArrow(cut, out)


def _without(text: str, gone: list[int] | None) -> tuple[str, int, int]:
    starts = sentence_starts(text)
    if not gone:
        return text, len(starts), 0
    removed = np.zeros(len(starts), bool)
    for run in gone:
        removed[run >> 8:(run >> 8) + (run & 255) + 1] = True
    if removed.any():
        bounds = [0, *starts[1:], len(text)]
        text = "".join([text[bounds[i]:bounds[i + 1]] for i in range(len(starts)) if not removed[i]]).rstrip()
    return text, len(starts), int(removed.sum())


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, the text without repeated sentences, its sentences and how many of them went.

    A sentence goes if any run that holds it occurs earlier; the order of documents is that of their ids,
    null last. Other text stays as it is, but for white space left at its end. Rows equal in id and text are
    one document. A null text is empty; texts of one sentence, and tables without rows, stay as they are.
    """
    return cleaned(docs).select("row.doc_id", F.col("clean").alias("text"), "n_sentences", "n_removed")


def rewritten(docs: DataFrame) -> DataFrame:
    """Documents in their own columns with the cleaned text, and ``n_chars``, where there is such a column,
    to match. A document that lost every sentence goes; a text with nothing removed is left alone, null too."""
    found = cleaned(docs).where("n_removed = 0 OR n_removed < n_sentences")
    changed = F.col("n_removed") > 0
    new = {"text": F.col("clean"), "n_chars": F.length("clean")}
    return found.select(*[
        (F.when(changed, new[f.name].cast(f.dataType)).otherwise(F.col(f"row.`{f.name}`")) if f.name in new else F.col(f"row.`{f.name}`")).alias(f.name)
        for f in docs.schema])
