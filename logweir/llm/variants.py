"""Spelling variants: words that differ by one code point, found in a trie of letter-group counts.

A word is a vector: its length, then how many of its code points fall into each letter group. The words' vectors form a
trie, one level a count. A replaced code point takes one from a group and adds one to another, an inserted one adds one:
so a word's neighbours lie on paths with a surplus of at most one and a deficit of at most one in all. The top of the trie
is descended by joins, level by level, until a node holds a bounded number of words; below it a task walks the node's own
trie depth first, spending what is left of the budget, and verifies the words of the leaves it comes to.
"""

import hashlib
import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import arrow_map, kept, partitions_for, work_folder
from logweir.operators.joins import is_small

RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a text in ISO-8859-1 with its letters in lower case and everything else a space.
_LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 0xC0 else 32 for i in range(256))
#: Different words that a task adds up before it hands them on.
HELD = 400_000
#: Words have this many code points and occurrences at least; one run in this many loses a code point.
LENGTH, OCCURRENCES, DAMAGED = 6, 5, 199
#: A form occurs this many times as often as the word.
TIMES = 5
#: Letter groups, and after how many levels (the length is the first) the joins look at the trie's nodes.
GROUPS, STEPS = 16, (1, 3, 5, 8, 12, 17)
#: Words of a node that one task walks, words that look for neighbours there at a time, and words of a leaf.
NODE, ASKING, LEAF = 1 << 14, 1 << 15, 64
#: Candidates that are verified together, and the longest words that are verified as rows of code points.
PAIRS, WIDE = 1 << 17, 256
_ROWS = "path long, word string, n long, surplus int, deficit int"


def counted_words(docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES, damaged: int = DAMAGED) -> DataFrame:
    """(word, n) of the words that occur often enough. A task adds up its words, HELD of them at a time, before the
    counts are shuffled, so a word that holds a third of all occurrences is a row a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[bytes, int] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if not text:
                        continue
                    seed = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                    # Code points beyond U+00FF are no letters, so that one byte holds each of the others.
                    runs = text.encode("latin-1", "replace").translate(_LETTERS).split()
                    for run, n in Counter([r for r in runs if len(r) >= length]).items():
                        mark = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
                        if mark % damaged == 0:
                            at = mark % len(run)
                            run = run[:at] + run[at + 1:]
                            if len(run) < length:
                                continue
                        totals[run] = totals.get(run, 0) + n
                    if len(totals) > HELD:
                        yield from _counts(totals)
                        totals.clear()
        yield from _counts(totals)

    words = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), task, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _counts(totals: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    words, counts = list(totals), list(totals.values())
    for start in range(0, len(words), 1 << 14):
        texts = pa.array([w.decode("latin-1") for w in words[start:start + (1 << 14)]], pa.string())
        yield pa.RecordBatch.from_arrays([texts, pa.array(counts[start:start + (1 << 14)], pa.int64())], names=["word", "n"])


def letter_groups(words: DataFrame, groups: int = GROUPS) -> dict[str, int]:
    """The group of every letter: each next frequent letter goes to the group with the fewest letters so far.

    Only the totals of single letters come to the driver, at most 90 rows."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''")
    totals = [(r["n"], r["letter"]) for r in letters.groupBy("letter").agg(F.count("*").alias("n")).collect()]
    heap, place = [(0, g) for g in range(groups)], {}
    for n, letter in sorted(totals, key=lambda x: (-x[0], x[1])):
        held, group = heapq.heappop(heap)
        place[letter] = group
        heapq.heappush(heap, (held + n, group))
    return place


class Vectors:
    """Vectors of words, and the numbers of trie nodes: counts times fixed odd numbers, modulo 2^64."""

    def __init__(self, place: dict[str, int], groups: int = GROUPS):
        self.groups, self.lookup = groups, np.zeros(0x100, np.int64)
        for letter, group in place.items():
            self.lookup[ord(letter)] = group
        odd = [int.from_bytes(hashlib.sha256(f"level {i}".encode()).digest()[:8], "big") | 1 for i in range(groups + 1)]
        self.odd = np.array(odd, np.uint64)

    def of(self, words: list[str]) -> np.ndarray:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        cells = np.repeat(np.arange(len(words)) * self.groups, sizes) + self.lookup[points]
        counts = np.bincount(cells, minlength=len(words) * self.groups).reshape(len(words), self.groups)
        return np.concatenate([sizes[:, None], counts], 1).astype(np.int32)

    def step(self, vectors: np.ndarray, low: int, high: int) -> np.ndarray:
        """What the levels from ``low`` to ``high`` add to a node's number."""
        return (vectors[:, low:high].astype(np.uint64) * self.odd[low:high]).sum(1, dtype=np.uint64)


def _moves(vectors: np.ndarray, own: np.ndarray, surplus: np.ndarray, deficit: np.ndarray, low: int, high: int, odd: np.ndarray):
    """Rows, node numbers and budgets after the levels from ``low`` to ``high``, for every way to spend the budget there.

    The surplus is spent before the deficit: the other way round the pair is found by its other word.
    """
    every = np.arange(len(own))
    yield every, own, surplus, deficit
    spent = every[(surplus == 0) & (deficit > 0)]
    for down in range(low, high):
        poor = spent[vectors[spent, down] > 0]
        yield poor, own[poor] - odd[down], surplus[poor], deficit[poor] - 1
    rich = every[surplus > 0]
    for up in range(low, high):
        yield rich, own[rich] + odd[up], surplus[rich] - 1, deficit[rich]
        for down in range(up + 1, high):
            both = rich[(deficit[rich] > 0) & (vectors[rich, down] > 0)]
            yield both, own[both] + odd[up] - odd[down], surplus[both] - 1, deficit[both] - 1


def _rows(paths: np.ndarray, words, n, surplus: np.ndarray, deficit: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(paths.view(np.int64)), words, n, pa.array(surplus.astype(np.int32)), pa.array(deficit.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ROWS.split(", ")])


def _deeper(rows: DataFrame, vectors: Vectors, low: int, high: int, search: bool) -> DataFrame:
    """Rows at nodes ``low`` levels deep taken to the nodes ``high`` levels deep: a word to its own, a search to all in reach."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                found = vectors.of(batch.column(1).to_pylist())
                own = batch.column(0).to_numpy().view(np.uint64) + vectors.step(found, low, high)
                surplus, deficit = batch.column(3).to_numpy(), batch.column(4).to_numpy()
                moves = _moves(found, own, surplus, deficit, low, high, vectors.odd) if search else [(np.arange(len(own)), own, surplus, deficit)]
                for at, paths, up, down in moves:
                    if len(at):
                        yield _rows(paths, batch.column(1).take(pa.array(at)), batch.column(2).take(pa.array(at)), up, down)

    return arrow_map(rows, task, _ROWS)


def _starts(words: DataFrame, vectors: Vectors, search: bool) -> DataFrame:
    """Rows at the nodes of the first level, the length: a word's own, or those a search goes to. A search looks for words
    of its length, replacing, and of one more, inserting; so each pair is found from one side."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.fromiter(map(len, batch.column(0).to_pylist()), np.uint64, batch.num_rows)
            for more, up, down in ((0, 1, 1), (1, 1, 0)) if search else ((0, 0, 0),):
                ones = np.ones(batch.num_rows, np.int32)
                yield _rows((size + np.uint64(more)) * vectors.odd[0], batch.column(0), batch.column(1), up * ones, down * ones)

    return arrow_map(words.select("word", "n"), task, _ROWS)


def differ_by_one(a: str, b: str) -> bool:
    """``b`` has one code point replaced or, being longer by one, one inserted."""
    if len(a) == len(b):
        at = next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), None)
        return at is not None and a[at + 1:] == b[at + 1:]
    at = next((i for i, (x, y) in enumerate(zip(a, b[:-1], strict=True)) if x != y), len(a))
    return a[at:] == b[at + 1:]


def _letters(words: list[str], width: int) -> np.ndarray:
    """One row of code points for each word of at most ``width``; all are below 256."""
    return np.array([w.encode("latin-1") for w in words], f"S{width}").view(np.uint8).reshape(len(words), width)


def _verified(a: np.ndarray, sizes: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``b`` are the row of ``a`` with one code point replaced, or one inserted."""
    width = b.shape[1]
    differ = a != b
    replaced = (sizes == width) & (differ.sum(1) == 1)
    at = differ.argmax(1)
    if width == 1:
        return replaced
    tail = a[:, :-1] != b[:, 1:]  # of a shorter word, the rest after an inserted code point
    last = np.where(tail.any(1), width - 2 - tail[:, ::-1].argmax(1), -1)
    return replaced | ((sizes == width - 1) & (last < at))  # the word's own end differs at the latest


class Trie:
    """The trie of one node's words, all of one length, walked depth first by many searches at once."""

    def __init__(self, words: list[str], numbers: list[int], vectors: np.ndarray, level: int, leaf: int = LEAF):
        order = np.lexsort(vectors.T[::-1])
        self.vectors, self.level, self.leaf = vectors[order], level, leaf
        self.words, self.numbers = [words[i] for i in order], [numbers[i] for i in order]
        self.width = len(self.words[0])
        self.letters = _letters(self.words, self.width) if self.width <= WIDE else None

    def search(self, asked: list[str], own: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of searches and of words that are verified pairs, each pair from one of its words."""
        narrow = self.letters is not None
        letters, sizes = (_letters(asked, self.width), np.fromiter(map(len, asked), np.int64, len(asked))) if narrow else (None, None)
        held, size = [], 0
        for pair in self._candidates(asked, own, surplus, deficit):
            held.append(pair)
            size += len(pair[0])
            if size >= PAIRS:
                yield self._kept(asked, own, held, letters, sizes)
                held, size = [], 0
        if held:
            yield self._kept(asked, own, held, letters, sizes)

    def _kept(self, asked, own, held, letters, sizes) -> tuple[np.ndarray, np.ndarray]:
        i, k = (np.concatenate(x) for x in zip(*held, strict=True))
        if letters is None:
            good = np.array([differ_by_one(asked[x], self.words[y]) for x, y in zip(i.tolist(), k.tolist(), strict=True)], bool)
        else:
            good = _verified(letters[i], sizes[i], self.letters[k])
        i, k = i[good], k[good]
        change = self.vectors[k, 1:] - own[i, 1:]
        first = change[np.arange(len(i)), (change != 0).argmax(1)]
        equal = np.array([asked[x] < self.words[y] for x, y in zip(i.tolist(), k.tolist(), strict=True)], bool)
        good = (first > 0) | ((first == 0) & equal)
        return i[good], k[good]

    def _candidates(self, asked, own, surplus, deficit) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        depth = self.vectors.shape[1]
        kind = np.float32 if self.width <= WIDE else np.float64  # exact for the squares of such counts
        words, searches = self.vectors.astype(kind), own.astype(kind)
        stack = [(0, len(self.words), self.level, np.arange(len(asked)), surplus, deficit)]
        while stack:
            low, high, level, at, up, down = stack.pop()
            if high - low <= self.leaf:
                # What is left to spend is at most one of each and their difference is given, so the squares tell.
                rest = words[low:high, level:]
                for start in range(0, len(at), 1 << 14):
                    part = slice(start, start + (1 << 14))
                    theirs = searches[at[part], level:]
                    apart = (rest * rest).sum(1)[:, None] + (theirs * theirs).sum(1)[None] - 2 * (rest @ theirs.T)
                    place, i = np.nonzero(apart <= (up[part] + down[part])[None])
                    yield at[part][i], place + low
                continue
            if level == depth:
                yield self._crowd(asked, low, high, at)
                continue
            column = self.vectors[low:high, level]
            edges = np.flatnonzero(np.diff(column, prepend=column[0] - 1, append=column[-1] + 1))
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                change = column[start] - own[at, level]
                fits = (change == 0) | ((change == 1) & (up > 0)) | ((change == -1) & (down > 0) & (up == 0))
                if fits.any():
                    here = change[fits]
                    stack.append((low + start, low + end, level + 1, at[fits], up[fits] - (here == 1), down[fits] - (here == -1)))

    def _crowd(self, asked, low, high, at) -> tuple[np.ndarray, np.ndarray]:
        """Many words with one vector: met by the word with a place left out, so that not all pairs are compared."""
        holes: dict[tuple, list[int]] = {}
        for place in range(low, high):
            word = self.words[place]
            for i in range(len(word)):
                holes.setdefault((i, word[:i] + word[i + 1:]), []).append(place)
        pairs = []
        for i in at.tolist():
            word, met = asked[i], set()
            for k in range(len(word) + 1):
                met.update(holes.get((k, word), ()))  # one inserted
                met.update(holes.get((k, word[:k] + word[k + 1:]), ()) if k < len(word) else ())  # one replaced
            pairs += [(i, place) for place in met]
        found = np.array(pairs, np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]


def _searched(rows: DataFrame, vectors: Vectors, level: int) -> DataFrame:
    """Pairs (a, a_n, b, b_n) from rows in the order of node and part, a part's words before its searches."""
    schema = pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, words, numbers, trie = None, [], [], None
        for whole in batches:
            for start in range(0, whole.num_rows, 8192):
                batch = whole.slice(start, 8192)
                marks = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in (0, 1, 2)], 1)
                edges = np.flatnonzero(np.concatenate([[True], (np.diff(marks, axis=0) != 0).any(1), [True]]))
                for low, high in zip(edges[:-1], edges[1:], strict=True):
                    run = batch.slice(low, high - low)
                    mark = (int(marks[low, 0]), int(marks[low, 1]))
                    if mark != node:
                        node, words, numbers, trie = mark, [], [], None
                    texts, counts = run.column(3).to_pylist(), run.column(4).to_pylist()
                    if marks[low, 2] == 0:
                        words += texts
                        numbers += counts
                        continue
                    if not words:
                        continue
                    trie = trie or Trie(words, numbers, vectors.of(words), level)
                    for i, k in trie.search(texts, vectors.of(texts), run.column(5).to_numpy(), run.column(6).to_numpy()):
                        if len(i):
                            pairs = zip(i.tolist(), k.tolist(), strict=True)
                            found = zip(*((texts[x], counts[x], trie.words[y], trie.numbers[y]) for x, y in pairs), strict=True)
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema, strict=True)], schema=schema)

    return arrow_map(rows, task, "a string, a_n long, b string, b_n long")


def near_pairs(words: DataFrame, folder: str, groups: int = GROUPS, steps: tuple = STEPS, node: int = NODE, asking: int = ASKING) -> DataFrame:
    """(a, a_n, b, b_n): every two words that differ by one code point, once.

    On each step the words and the searches still under way go some levels down, and the sizes of the nodes decide: a node
    of at most ``node`` words is walked by tasks, in as many parts as ``asking`` searches each make, the others are left
    for the next step. After the last step a node has only words of one vector, which are dealt out in blocks.
    """
    vectors = Vectors(letter_groups(words, groups), groups)
    left, asked = _starts(words, vectors, False), _starts(words, vectors, True)
    levels = [s for s in steps if s <= groups] + [groups + 1]
    found = None
    for turn, level in enumerate(levels):
        if turn:
            left, asked = (_deeper(x, vectors, levels[turn - 1], level, s) for x, s in ((left, False), (asked, True)))
        left = kept(left, folder, f"words{turn}")
        sizes = kept(left.groupBy("path").agg(F.count("*").alias("words")), folder, f"nodes{turn}")
        asked = kept(_at_nodes(asked, sizes.select("path")), folder, f"asked{turn}")
        last = level == levels[-1]
        small = sizes if last else sizes.where(F.col("words") <= node)
        demand = asked.groupBy("path").agg(F.count("*").alias("searches"))
        cut = kept(small.join(demand, "path").select(
            "path", F.ceil(F.col("words") / node).alias("blocks"), F.ceil(F.col("searches") / asking).alias("parts")), folder, f"cut{turn}")
        pick = lambda name: F.pmod(F.xxhash64("word"), F.col(name))
        spread = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
        own = _at_nodes(left, cut).withColumn("x", spread("parts")).withColumn("part", pick("blocks") * F.col("parts") + F.col("x"))
        theirs = _at_nodes(asked, cut).withColumn("x", spread("blocks")).withColumn("part", F.col("x") * F.col("parts") + pick("parts"))
        rows = own.withColumn("kind", F.lit(0)).unionByName(theirs.withColumn("kind", F.lit(1))).select(
            "path", "part", "kind", "word", "n", "surplus", "deficit")
        dealt = rows.repartition(partitions_for(words), "path", "part").sortWithinPartitions("path", "part", "kind")
        pairs = kept(_searched(dealt, vectors, level), folder, f"pairs{turn}")
        found = pairs if found is None else found.unionByName(pairs)
        if last or not sizes.where(F.col("words") > node).limit(1).count():
            return found
        open_nodes = sizes.where(F.col("words") > node).select("path")
        left, asked = _at_nodes(left, open_nodes), _at_nodes(asked, open_nodes)
    return found


def _at_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows at the given nodes. Near the top of the trie nodes are few and hold many rows, so they travel to the rows;
    where they are many, none of them is large."""
    return rows.join(F.broadcast(nodes) if is_small(nodes) else nodes, "path")


def roots(words: DataFrame, folder: str) -> DataFrame:
    """(word, root) of the words with a form: forms are followed twice as far in each round. A form occurs at least
    TIMES as often as its word, so chains are as short as the logarithm of the largest count."""
    linked = kept(words.where("form IS NOT NULL").select("word", F.col("form").alias("root")), folder, "root0")
    turn = 0
    while True:
        turn += 1
        ahead = linked.select(F.col("word").alias("root"), F.col("root").alias("after"))
        step = kept(linked.join(ahead, "root", "left").select(
            "word", F.coalesce("after", "root").alias("root"), F.col("after").isNotNull().alias("moved")), folder, f"root{turn}")
        linked = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return linked


def spelling_variants(
    docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES, damaged: int = DAMAGED, times: int = TIMES, **search,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least ``length`` code points and ``occurrences``.

    A null or empty text has no words; a document without an id damages its runs as if the id were empty; repeated rows
    count each. Ties between forms go to the smallest word in code-point order. No documents, or none with such words,
    give no rows. Other columns of ``docs`` play no part. Long texts are read whole and may hold words of any length.
    """
    folder = work_folder(docs.sparkSession, "variants")
    words = kept(counted_words(docs, length, occurrences, damaged), folder, "counted")
    pairs = near_pairs(words, folder, **search)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    fits = -F.col("best.less") >= times * F.col("n")
    formed = kept(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), folder, "formed")
    return formed.join(roots(formed, folder), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def duckdb_sql() -> str:
    """The same words and forms as DuckDB SQL: the checksum bit by bit, neighbours by a place left out."""
    run = f"{RUN.replace('u00C0', 'x{C0}').replace('u00FF', 'x{FF}')}{{{LENGTH},}}"
    octets = "flatten(list_transform(string_split(name, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))"
    bits = ("CASE WHEN {0} % 2 = 1 THEN xor({0} // 2, 3988292384) ELSE {0} // 2 END")
    step = "c"
    return f"""
WITH RECURSIVE z AS (
  SELECT i AS byte, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) x(i)
  UNION ALL SELECT byte, {bits.format(step)}, k + 1 FROM z WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM z WHERE k = 8),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '{run}')), '{UPPER}', '{LOWER}') AS run
      FROM documents),
g AS (SELECT run, id || ':' || run AS name, count(*) AS m FROM d GROUP BY ALL),
h AS (SELECT run, m, xor(list_reduce({octets}, lambda a, b: xor(a // 256, t[CAST(xor(a, b) % 256 AS INT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
      FROM g, crc),
w AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, m FROM h),
v AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM w WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(m) >= {OCCURRENCES}),
o AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
e AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS hole FROM o),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM e a JOIN e b ON a.i = b.i AND a.hole = b.hole AND a.word <> b.word
      UNION SELECT e.word, v.word, v.n FROM e JOIN v ON v.word = e.hole
      UNION SELECT v.word, e.word, e.n FROM e JOIN v ON v.word = e.hole),
b AS (SELECT word, count(*) AS n_near, min({{'less': -near_n, 'near': encode(near)}}) AS best FROM p GROUP BY word),
f AS (SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= {TIMES} * v.n THEN decode(best.near) END AS form,
             CASE WHEN -best.less >= {TIMES} * v.n THEN -best.less END AS form_n FROM v LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT r.word, f.form, r.k + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, form, arg_max(r.root, r.k) AS root, f.n, n_near, form_n FROM f JOIN r USING (word) GROUP BY ALL
"""
