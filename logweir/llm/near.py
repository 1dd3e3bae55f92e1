"""Near-duplicates by fast similarity sketches, banding and exact verification of every link.

A sketch has COORDINATES bins. In round i every shingle falls into one bin, with a value that is larger
than any of an earlier round; after as many rounds as there are bins, rounds fill one bin each, so no bin
stays empty. A bin keeps its least value. Equal bins happen with the probability of the sets' similarity.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import arrow_map, batches_of, kept, rows_of, work_folder

#: Words of a shingle, and the least similarity of a link in hundredths.
WIDTH, PERCENT = 5, 80
#: Bins of a sketch and rows of a band: a pair at 0.8 shares none of the 32 bands once in 20 million times.
COORDINATES, ROWS = 128, 4
#: Pairs whose sketches agree in a share of the bins this far below the threshold are not compared further
#: (more than four standard deviations of the estimate).
MARGIN = 0.16
#: Members of a bucket that one task compares with as many others.
BLOCK = 512
#: Closest others of each member that are verified first, before all the rest.
FIRST = 4

_LAST = (1 << 63) - 1  # stands for a null id
_G = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes; fewer words than a shingle has are one shingle."""
    own = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not own:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    take = min(width, len(own))
    count = len(own) - take + 1
    out = np.full(count, take, np.uint64)
    for k in range(take):
        out = mixed(out * _G + hashes[k:k + count])
    return np.unique(out)


def sketch(items: np.ndarray, bins: int = COORDINATES) -> np.ndarray:
    """The least value in each bin."""
    out = np.full(bins, ~np.uint64(0), np.uint64)
    step = max(1, min(bins, 1024 // len(items)))
    low = 0
    while low < 2 * bins and (out == ~np.uint64(0)).any():
        turns = np.arange(low, min(2 * bins, low + step), dtype=np.uint64)[:, None]
        found = mixed((items + turns * _G) ^ (turns << np.uint64(17)))
        bin_of = np.where(turns < bins, found & np.uint64(bins - 1), turns - np.uint64(bins)).astype(np.int64)
        value = (turns << np.uint64(55)) | (found >> np.uint64(9))
        np.minimum.at(out, bin_of.ravel(), value.ravel())
        low += step
    return out


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of a sketch, different from band to band."""
    bands = values.reshape(-1, rows)
    out = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for k in range(rows):
        out = mixed(out * _G + bands[:, k])
    return out.view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc, a mark of the text, n_shingles, d1 and d2 (a digest of the set), its bands and the low bytes of its sketch."""
    schema = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
                        ("bands", pa.list_(pa.int64())), ("low", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc, mark, text in rows_of(batches, "doc", "mark", "text"):
                items = shingles(text, width)
                if not len(items):
                    yield doc, mark, 0, None, None, None, None
                    continue
                d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(items.tobytes()), np.int64).tolist()
                own = sketch(items)
                yield doc, mark, len(items), d1, d2, band_keys(own), own.astype(np.uint8).tobytes()

        yield from batches_of(rows(), schema)

    own = docs.select(F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("doc"), F.xxhash64("text").alias("mark"), "text")
    return arrow_map(own, make, "doc long, mark long, n_shingles long, d1 long, d2 long, bands array<long>, low binary")


def _candidates(group: pa.Table, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Members of one block of a bucket with those of the other that are in other, larger components, close
    by their sketches and in no earlier bucket with them; a pair comes up once, from its smaller component."""
    v, root, own, bucket, p, q = (group.column(n).to_numpy() for n in ("v", "root", "own", "b", "p", "q"))
    bands = np.array(group.column("bands").to_pylist(), np.int64)
    low = np.frombuffer(b"".join(group.column("low").to_pylist()), np.uint8).reshape(len(v), -1)
    at = int(np.flatnonzero(bands[0] == bucket[0])[0])
    names, which, count = np.unique(root, return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, count))] = np.arange(len(names))
    rank = rank[which]
    for i in range(len(v)):
        rest = np.flatnonzero((rank > rank[i]) & (own != own[i] if p[0] != q[0] else True))
        near = (low[rest] == low[i]).mean(1) if len(rest) else np.empty(0)
        good = near >= least
        if good.any():
            good &= ~(bands[rest, :at] == bands[i, :at]).any(1)
            if good.any():
                yield i, rest[good], near[good]


def contract(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the least node that edges lead to.

    Each round hangs every node below its least neighbour, halves the paths until all are flat, and goes on
    with the edges between roots. Only counts come to the driver; tables are written in the shared folder.
    """
    left = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), folder, f"{name}-edges")
    roots, turn = None, 0
    while not left.isEmpty():
        hung = kept(left.groupBy("a").agg(F.min("b").alias("p")), folder, f"{name}-{turn}-0")
        step = 1
        while True:
            up = hung.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            flat = kept(hung.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")),
                        folder, f"{name}-{turn}-{step}")
            hung, step = flat.select("a", "p"), step + 1
            if flat.where("moved").isEmpty():
                break
        if roots is None:
            roots = hung.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            moved = roots.join(hung, F.col("root") == F.col("a"), "left").select("node", F.coalesce("p", "root").alias("root"))
            fresh = hung.join(roots, F.col("a") == F.col("node"), "left_anti").select(F.col("a").alias("node"), F.col("p").alias("root"))
            roots = moved.unionByName(fresh)
        roots = kept(roots, folder, f"{name}-{turn}-roots")
        ends = left.join(hung.withColumnRenamed("p", "pa"), "a").select("b", F.col("pa").alias("a"))
        ends = ends.join(hung.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b", "left").select("a", F.coalesce("pb", "b").alias("b"))
        left = kept(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), folder, f"{name}-{turn}-left")
        turn += 1
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


class Near:
    """The steps of one run; tables go to its work folder."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs, width, percent
        self.folder = work_folder(docs.sparkSession, "near")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return kept(df, self.folder, name)

    def members(self) -> DataFrame:
        """(b, v, centre) of the classes of equal sets in every bucket that has more than one."""
        rows = self.classes.select("v", F.explode("bands").alias("b"))
        heads = rows.groupBy("b").agg(F.min("v").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
        return rows.join(heads, "b").select("b", "v", "centre", "n")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        width, percent = self.width, self.percent
        texts = self.texts.select(F.col("v").alias("a"), F.col("text").alias("text_a"))
        others = self.texts.select(F.col("v").alias("b"), F.col("text").alias("text_b"))
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}

            def items(v: int, text: str) -> np.ndarray:
                if v not in held:
                    if len(held) > 256:
                        held.clear()
                    held[v] = shingles(text, width)
                return held[v]

            def rows():
                for a, b, text_a, text_b in rows_of(batches, "a", "b", "text_a", "text_b"):
                    one, two = items(a, text_a), items(b, text_b)
                    if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
                        continue
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if 100 * both >= percent * (len(one) + len(two) - both):
                        yield a, b

            yield from batches_of(rows(), schema)

        joined = pairs.select("a", "b").join(texts, "a").join(others, "b").select("a", "b", "text_a", "text_b")
        return self.keep(arrow_map(joined, check, "a long, b long"), name)

    def open_rows(self, roots: DataFrame) -> DataFrame:
        """Members of the buckets that still hold unlike components, for each block that they are compared in."""
        placed = self.buckets.join(roots, F.col("v") == F.col("node"), "left").select("b", "v", F.coalesce("root", "v").alias("root"))
        unlike = placed.groupBy("b").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("n")).where("r1 <> r2")
        rows = placed.join(unlike.select("b", "n"), "b").join(self.classes.select("v", "bands", "low"), "v")
        blocks = F.ceil(F.col("n") / BLOCK)
        rows = rows.withColumn("own", F.pmod(F.xxhash64("v"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        return rows.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))

    def closest(self, roots: DataFrame) -> DataFrame:
        """For every member of an open bucket the few members of other components whose sketches are closest."""
        least, schema = self.percent / 100 - MARGIN, pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def compare(group: pa.Table) -> pa.Table:
            v, out = group.column("v").to_numpy(), []
            for i, found, near in _candidates(group, least):
                for j in found[np.argsort(-near, kind="stable")[:FIRST]]:
                    out.append((min(v[i], v[j]), max(v[i], v[j])))
            columns = list(zip(*out, strict=True)) if out else [[]] * 2
            return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        pairs = self.open_rows(roots).groupBy("b", "p", "q").applyInArrow(compare, "a long, b long").distinct()
        return self.verified(self.keep(pairs, "closest"), "closest-verified")

    def settled(self, roots: DataFrame) -> DataFrame:
        """Links between the components that open buckets still hold: every pair with close sketches is
        compared on its full sets, where it is; a pair that found links join already needs no more."""
        least, width, percent = self.percent / 100 - MARGIN, self.width, self.percent
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def compare(group: pa.Table) -> pa.Table:
            v, roots_of = group.column("v").to_numpy(), group.column("root").to_numpy()
            asked = [(i, found) for i, found, _ in _candidates(group, least)]
            needed = np.unique(np.concatenate([np.append(found, i) for i, found in asked])) if asked else []
            texts, sets = group.column("text"), {}
            for i in needed:
                sets[i] = shingles(texts[int(i)].as_py(), width)
            top: dict[int, int] = {}

            def head(r: int) -> int:
                while r in top:
                    r = top[r]
                return r

            out = []
            if asked:
                items = np.concatenate([sets[i] for i in needed])
                who = np.repeat(np.asarray(needed), [len(sets[i]) for i in needed])
                order = np.argsort(items, kind="stable")
                items, who = items[order], who[order]
                sizes = np.zeros(len(v), np.int64)
                sizes[needed] = [len(sets[i]) for i in needed]
            for i, found in asked:
                low, high = np.searchsorted(items, sets[i], "left"), np.searchsorted(items, sets[i], "right")
                spans = high - low
                at = np.arange(spans.sum()) + np.repeat(low - (np.cumsum(spans) - spans), spans)
                both = np.bincount(who[at], minlength=len(v))[found]
                for j in found[100 * both >= percent * (sizes[i] + sizes[found] - both)]:
                    one, two = head(int(roots_of[i])), head(int(roots_of[j]))
                    if one != two:
                        top[max(one, two)] = min(one, two)
                        out.append((v[i], v[j]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 2
            return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        rows = self.open_rows(roots).join(self.texts, "v")
        return self.keep(rows.groupBy("b", "p", "q").applyInArrow(compare, "a long, b long"), "settled")

    def run(self) -> DataFrame:
        every = self.keep(sketches(self.docs, self.width), "sketches")
        full = every.where("n_shingles > 0")
        least = full.groupBy("d1", "d2").agg(F.min(F.struct("doc", "bands", "low")).alias("least"))
        self.classes = self.keep(least.select(
            F.monotonically_increasing_id().alias("v"), "d1", "d2", F.col("least.doc").alias("doc"),
            F.col("least.bands").alias("bands"), F.col("least.low").alias("low")), "classes")
        self.buckets = self.keep(self.members(), "buckets")
        stars = self.buckets.where("v <> centre").groupBy("v", "centre").agg(F.count(F.lit(1)).alias("shared"))
        best = stars.groupBy("v").agg(F.max(F.struct("shared", -F.col("centre"))).alias("best"))
        best = self.keep(best.select(F.col("v").alias("a"), (-F.col("best.col2")).alias("b")), "stars")
        active = self.classes.join(self.buckets.select("v").distinct(), "v").select("v", "doc", "d1", "d2")
        self.texts = self.keep(self._texts(active), "texts")
        roots = contract(self.verified(best, "stars-verified"), self.folder, "round-0")
        for turn, step in enumerate((self.closest, self.settled), 1):
            links = step(roots)
            here = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(
                roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
            up = contract(here.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), self.folder, f"round-{turn}")
            joined = roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
            known = joined.select("node", F.coalesce("top", "root").alias("root"))
            fresh = up.join(roots.select("node"), "node", "left_anti")
            roots = self.keep(known.unionByName(fresh), f"roots-{turn}")
        return self._result(every, roots)

    def _texts(self, active: DataFrame) -> DataFrame:
        """Text of each active class, from the document that stands for it (and not another with its id)."""
        width = self.width

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for v, d1, d2, text, alike in rows_of(batches, "v", "d1", "d2", "text", "alike"):
                    if alike == 1 or np.frombuffer(xxhash.xxh3_128_digest(shingles(text, width).tobytes()), np.int64).tolist() == [d1, d2]:
                        yield v, text

            yield from batches_of(rows(), pa.schema([("v", pa.int64()), ("text", pa.string())]))

        shared = self.docs.groupBy(F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("doc")).agg(F.count(F.lit(1)).alias("alike"))
        wanted = active.join(shared, "doc")
        docs = self.docs.select(F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("doc"), "text")
        found = arrow_map(wanted.join(docs, "doc").select("v", "d1", "d2", "text", "alike"), own, "v long, text string")
        return found.dropDuplicates(["v"])

    def _result(self, every: DataFrame, roots: DataFrame) -> DataFrame:
        placed = self.classes.join(roots, F.col("v") == F.col("node"), "left").select("d1", "d2", "doc", F.coalesce("root", "v").alias("root"))
        firsts = placed.groupBy("root").agg(F.min("doc").alias("component"))
        named = placed.join(firsts, "root").select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), "component")
        rows = every.join(named, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")), "left")
        component = F.coalesce("component", "doc")
        return rows.select("mark", F.nullif("doc", F.lit(_LAST)).alias("doc_id"), "n_shingles",
                           F.nullif(component, F.lit(_LAST)).alias("component_id"), (F.col("doc") == component).alias("kept"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links lead to) and whether that is its own.

    Documents with equal sets are one class from the start. Classes that share a band of their sketches meet:
    first each with the least of its buckets that shares most bands, then, in buckets that still hold unlike
    components, with the few closest, and last with every other. All links are confirmed on the full sets. Texts without words are
    linked with nothing. A null id comes last and stays null; rows with equal ids are separate documents,
    but kept alike.
    """
    return Near(docs, width, percent).run().drop("mark")


def representatives(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that with the least id, in the columns of ``docs``; of rows equal in
    id and text one stays."""
    good = Near(docs, width, percent).run().where("kept").select("doc_id", "mark").distinct()
    good = good.select(F.coalesce("doc_id", F.lit(_LAST)).alias("good_id"), F.col("mark").alias("good_mark"))
    own = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("own_id"), F.xxhash64("text").alias("own_mark"))
    found = own.join(good, (F.col("own_id") == F.col("good_id")) & (F.col("own_mark") == F.col("good_mark")))
    nth = F.row_number().over(Window.partitionBy("own_id", "own_mark").orderBy("good_mark"))
    return found.withColumn("nth", nth).where("nth = 1").select("row.*")
