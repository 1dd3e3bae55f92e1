"""Spelling variants, centroid clusters and licence scans against plain versions on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from logweir.llm import centroids, licences, variants

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())] + [
    T.StructField(c, T.StringType()) for c in ("word", "n", "path", "words", "own", "label", "spans", "template")])


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *"abcdefgh") for i, t in rows], DOCS)


# Spelling variants

def plain_variants(rows, length=6, occurrences=5, damaged=199, times=5):
    lower = str.maketrans(variants.UPPER, variants.LOWER)
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damaged == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= length and c >= occurrences}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))

    met = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(met[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: f if f and n[f] >= times * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n[w], len(met[w]), n.get(form[w])) for w in n)


def found(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


@pytest.fixture(scope="module")
def spelled():
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcdeéßñ÷"), int(rng.integers(6, 9)))) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(base[:25], 40))) for i in range(30)]
    for i in range(30, 90):  # words one letter off, at several distances from the common ones
        word = list(rng.choice(base[:25]))
        for _ in range(int(rng.integers(1, 3))):
            at = int(rng.integers(0, len(word)))
            word[at:at + int(rng.integers(0, 2))] = list(rng.choice(list("abcdeÿ"), int(rng.integers(0, 2))))
        rows.append((i, (" " + "".join(word)) * 6))
    twins = ["listen", "silent", "enlist", "tinsel", "inlets", "listex", "lisxen"]
    rows += [(90, " ".join(twins * 5)), (91, None), (92, ""), (None, "Straße STRASSE straße " * 5), (None, "Straße STRASSE straße " * 5),
             (93, "中文词语abcdef" * 6), (94, ("x" * 700 + " ") * 5), (95, ("x" * 699 + " ") * 25), (95, ("x" * 300 + "y" + "x" * 399 + " ") * 6),
             (96, "\x85ABCDEF\xa0abcdef aBcDeF×abcdefg " * 4)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"node": 3, "asking": 7}, {"node": 10, "asking": 1 << 10, "steps": (1, 17)}])
def test_variants_equal_a_plain_version(spark, spelled, settings):
    assert found(variants.spelling_variants(docs(spark, spelled), damaged=7, **settings)) == plain_variants(spelled, damaged=7)


def test_variants_follow_forms_to_the_last(spark):
    rows = [(1, "abcdefg " * 5 + "abcdef " * 25 + "abcdeff " * 125 + "abcdxf " * 125 + "zzzzzzzzz " * 5)]
    got = {r[0]: r[1:3] for r in found(variants.spelling_variants(docs(spark, rows), damaged=10**9))}
    assert got["abcdefg"] == ("abcdeff", "abcdeff") and got["abcdef"] == ("abcdeff", "abcdeff")
    assert got["zzzzzzzzz"] == ("", "zzzzzzzzz") and got["abcdxf"] == ("", "abcdxf")
    chain = [(1, "aaaaaa " * 625 + "aaaaab " * 125 + "aaaabb " * 25 + "aaabbb " * 5)]
    assert {r[0]: r[2] for r in found(variants.spelling_variants(docs(spark, chain), damaged=10**9))} == dict.fromkeys(
        ("aaaaaa", "aaaaab", "aaaabb", "aaabbb"), "aaaaaa")


def test_variants_of_nothing(spark):
    assert found(variants.spelling_variants(docs(spark, []))) == []
    assert found(variants.spelling_variants(docs(spark, [(1, None), (2, "short of it")]))) == []


def test_one_difference():
    words = ["abcdef", "abcdeg", "bacdef", "abcde", "abcdeff", "xabcdef", "abcdef"]
    for a in words:
        for b in words:
            if len(b) - len(a) in (0, 1):
                want = plain_variants([(1, (a + " ") * 5 + (b + " ") * 5)], length=1, damaged=10**9)
                assert variants.differ_by_one(a, b) == (a != b and want[0][4] == 1)


def test_crowded_leaves_meet_all_neighbours():
    words = sorted({"".join(p) for p in __import__("itertools").permutations("aabbcd")})
    place = {c: i % 2 for i, c in enumerate("abcd")}
    vectors = variants.Vectors(place, 2)
    own = vectors.of(words)
    trie = variants.Trie(words, [1] * len(words), own, 1, leaf=1)
    asked = np.ones(len(words), np.int32)
    got = sorted((words[i], trie.words[k]) for a, b in trie.search(words, own, asked, asked) for i, k in zip(a, b, strict=True))
    assert got == [(a, b) for a in words for b in words if a < b and variants.differ_by_one(a, b)]
    more = [w + "e" for w in words] + words
    place["e"] = 1
    wide = variants.Vectors(place, 2)
    bigger = [w + "e" for w in words]
    trie = variants.Trie(bigger, [1] * len(bigger), wide.of(bigger), 1, leaf=1)
    got = sorted((words[i], trie.words[k]) for a, b in trie.search(words, wide.of(words), asked, 0 * asked) for i, k in zip(a, b, strict=True))
    assert got == sorted((a, b) for a in words for b in bigger if variants.differ_by_one(a, b)) and len(more) == 2 * len(words)


# Centroid clusters

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("cluster", T.StringType()), T.StructField("parts", T.StringType()), T.StructField("rows", T.StringType())])


def plain_clusters(rows, k=16, rounds=3, size=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    if not kept:
        return []
    hashed = lambda i: (i is None, "" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centres = [v for _, v in sorted(kept, key=lambda r: (hashed(r[0]), r[1]))[:k]]

    def assign():
        squares = [[sum((x - y) ** 2 for x, y in zip(v, c, strict=True)) for c in centres] for _, v in kept]
        return [(s.index(min(s)), min(s)) for s in squares]

    for _ in range(rounds):
        at = assign()
        for c in range(len(centres)):
            own = [v for (_, v), (a, _) in zip(kept, at, strict=True) if a == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    whole = sum(d for _, d in at)
    return sorted(((-1 if i is None else i), a, d, sum(e for b, e in at if b == a), whole,
                   hashlib.sha256(",".join(map(str, centres[a])).encode()).hexdigest()) for (i, _), (a, d) in zip(kept, at, strict=True))


def clusters(df):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], *r[1:]) for r in df.collect())


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], VECTORS)


def test_clusters_equal_a_plain_version(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 1, (6, 64))
    rows = [(i, [float(np.float32(x)) for x in middles[i % 6] + rng.normal(0, 0.3, 64)]) for i in range(150)]
    rows += [(200, rows[3][1]), (200, rows[3][1]), (None, rows[4][1]), (201, None), (202, [1.0]), (203, []), (204, [None] + [0.0] * 63),
             (205, [float("nan")] * 64), (206, [float("inf")] * 64), (207, [0.0] * 64), (208, [-1e-9] * 64), (209, [3e4] * 64)]
    assert clusters(centroids.clustered(vectors(spark, rows))) == plain_clusters(rows)


def test_clusters_of_few_equal_or_no_vectors(spark):
    assert clusters(centroids.clustered(vectors(spark, []))) == []
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert clusters(centroids.clustered(vectors(spark, few))) == plain_clusters(few)
    same = [(i, [0.5] * 64) for i in range(40)]  # ties all go to the smallest number, the other clusters are empty
    got = clusters(centroids.clustered(vectors(spark, same)))
    assert got == plain_clusters(same) and {r[1] for r in got} == {0}


def test_huge_components_are_an_error(spark):
    with pytest.raises(Exception, match="is not below"):
        centroids.clustered(vectors(spark, [(1, [1e30] * 64)])).collect()


def test_loosening_holds_and_is_less_than_the_drift():
    rng = np.random.default_rng(2)
    shares = []
    for _ in range(60):
        size = int(rng.integers(2, 6))
        old = rng.normal(size=(5, size)) * 5
        new, radius = old + rng.normal(size=(5, size)) * rng.choice([0, 0.1, 1, 5]), rng.random(5) * 6
        lost, drift = centroids.loosening(old, new, radius), np.linalg.norm(new - old, axis=1)
        assert (lost <= drift[None] * (1 + 1e-9)).all()
        shares.append((lost.sum() + 1e-12) / (5 * drift.sum() + 1e-12))
        for i in range(5):
            x = rng.normal(size=(300, size))
            x = old[i] + x / np.linalg.norm(x, axis=1)[:, None] * radius[i] * rng.random(300)[:, None] ** (1 / size)
            for j in range(5):
                assert (np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)).max() <= lost[i, j] + 1e-9
    assert np.mean(shares) < 0.8


def test_bounds_spare_vectors_the_full_scan(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 2, (16, 64))
    rows = [(i, [float(x) for x in middles[i % 16] + rng.normal(0, 0.05, 64)]) for i in range(800)]
    _, _, measured = centroids.cluster_vectors(vectors(spark, rows))
    assert measured[0] == 800 and measured[-1] < 800


# Licence scans

PLAIN_WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return PLAIN_WORDS.findall((text or "").translate(str.maketrans(licences.UPPER, licences.LOWER)))


def base(text):
    words, places, labels = plain_words(text), [], set()
    for phrase, label in licences.PHRASES.items():
        parts = phrase.split()
        at = [i for i in range(len(words) - len(parts) + 1) if words[i:i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


GPL = "This work is licensed under the GNU General Public License, version 3."
MIT = next(t for label, needs, t in licences.TEMPLATES if needs == "permission granted charge")


@pytest.fixture(scope="module")
def licensed():
    rng = np.random.default_rng(4)
    filler = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 500, n))
    cut = MIT.split()
    rows = [(1, filler(50) + " " + GPL), (2, "Released under the MIT License. Released under the MIT License."), (3, None), (4, ""),
            (5, filler(30) + " " + " ".join(cut[:20] + ["really"] + cut[20:40] + cut[41:]) + " " + filler(20)), (6, "cc by nc cc by nc"),
            (7, "cc-by-nc-4.0; Apache License, Version 2.0; Ünder the mit license"), (8, "GNU GENERAL PUBLIC LICENSE, version 2 " + filler(5)),
            (9, GPL.replace("3", "2")), (10, " ".join(cut[:12])), (11, (GPL + " ") * 300), (12, filler(20000)), (None, GPL), (None, GPL),
            (13, GPL), (13, GPL), (13, "no licence"), (14, "all rights reserved"), (15, "under the"), (16, " ".join(cut[::-1])),
            (17, "This work is licensed under the GNU General Public License"), (18, "中文 under the MIT license中文")]
    return rows


def test_licence_base_counts_equal_a_plain_version(spark, licensed):
    got = licences.scan(docs(spark, licensed)).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    shown = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=key)
    assert shown == sorted(((i, *base(t)) for i, t in licensed), key=key)


def test_licence_labels_and_spans(spark, licensed):
    got = {r["doc_id"]: r for r in licences.scan(docs(spark, [r for r in licensed if r[0] not in (None, 13)])).collect()}
    assert got[1]["labels"] == "gpl-3" and got[1]["score"] == 1.0
    span = got[1]["spans"][0]
    assert (span["first_word"], span["last_word"], span["label"]) == (50, 61, "gpl-3")
    assert got[2]["labels"] == "mit" and got[2]["n_base"] == 2 and got[2]["score"] == 1.0
    assert got[3]["labels"] == "" and got[3]["score"] == 0.0 and got[3]["spans"] is None and got[3]["n_words"] == 0
    assert got[5]["labels"] == "mit" and 0.85 < got[5]["score"] < 1 and len(got[5]["spans"]) == 1  # diagonals merged over two changes
    assert got[7]["labels"] == "apache-2,cc-by-nc" and got[9]["labels"] == "gpl-2"
    assert got[10]["labels"] == "" and got[12]["labels"] == "" and got[16]["labels"] == ""
    assert got[11]["labels"] == "gpl-3" and len(got[11]["spans"]) == 300
    assert got[14]["labels"] == "all-rights-reserved" and got[17]["labels"] == ""  # no version is told


def test_equal_rows_have_equal_results_and_nothing_gives_nothing(spark, licensed):
    got = [tuple(r) for r in licences.scan(docs(spark, [r for r in licensed if r[0] in (None, 13)])).drop("spans").collect()]
    assert len(got) == 5 and len(set(got)) == 3
    assert licences.scan(docs(spark, [])).collect() == []


def test_licence_scan_equals_its_sql(spark, licensed):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", licensed)
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    want = sorted(con.sql(licences.duckdb_sql()).fetchall(), key=key)
    assert sorted(map(tuple, licences.scan(docs(spark, licensed)).drop("spans").collect()), key=key) == want


def test_licence_scan_runs_no_python_in_tasks(spark, licensed):
    plan = licences.scan(docs(spark, licensed[:2]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_raw_words_are_the_words_before_lowering(spark):
    text = " ".join(f"{chr(c)}a{chr(c)}B" for c in [*range(0x300), 0x3A3, 0x2028, 0x212A, 0x4E2D, 0xFFFD, 0x10000, 0x10FFFF])
    frame = docs(spark, [(1, text), (2, None)])
    got = frame.select(licences.raw_words(frame.text), licences.words_of(frame.text)).collect()
    raw, low = got[0]
    assert low == plain_words(text) == [plain_words(w)[0] for w in raw] and tuple(got[1]) == ([], [])
    frame = docs(spark, list(enumerate(raw)))
    assert [r[0] for r in frame.orderBy("doc_id").select(licences.lowered(frame.text)).collect()] == low


def test_phrases_of_any_length_stand_where_a_plain_version_finds_them(spark):
    phrases = {"mit": "one", "by nc": "two", "a a a a": "four", "a a a": "three", "foo-bar baz qux": "never", "Under the mit": "never",
               "ünder the mit": "four", "of kind k": "kind", "a  b c": "never"}
    rows = [(1, "A a a a a, b mit BY-NC mit"), (2, "foo bar baz qux under the MIT a b c"), (3, "ünder the mit Ünder the mit"), (4, None),
            (5, "of kind \u212a of KIND K kind k"), (6, "a a"), (6, "a a a"), (6, "a a a"), (None, "a a b a a a")]
    got = licences.scan(docs(spark, rows), phrases, licences.TEMPLATES[:1]).collect()
    want = []
    for i, text in rows:
        words = plain_words(text)
        at = [(k, x) for p, x in phrases.items() for k in range(len(words)) if words[k:k + len(p.split(" "))] == p.split(" ")]
        places = [k for k, _ in at]
        want.append((i, len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["labels"] == r["base_labels"] and r["spans"] is None for r in got)


def test_whole_texts_are_not_lowered_and_runs_of_other_lengths_are_left_out(spark, licensed):
    frame = docs(spark, licensed)
    plan = licences.scan(frame)._jdf.queryExecution().executedPlan().toString()
    assert "translate(coalesce(text" not in plan and not re.search(r"coalesce\(text#\d+, \), \[\^", plan) and "LeftSemi" in plan
    known = licences.template_table(spark, licences.TEMPLATES[:1])
    shapes = licences._grams(known.select("template", "words"), "tpos")
    dealt = licences._grams(frame.select("doc_id", licences.raw_words(frame.text).alias("words")), "pos", shapes)
    kept = dealt.where("doc_id IN (2, 12)").collect()
    assert {tuple(len(r[f"g{i}"]) for i in range(3)) for r in kept} <= {(8, 5, 3), (5, 3, 3), (3, 3, 7)} and len(kept) == 6
