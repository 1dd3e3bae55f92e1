"""Each operator against a plain version on small tables that hold nulls, repeats, ties and odd names."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from logweir.llm import classifier, main_text, mixing, near, perplexity, pieces, spans, token_files, topk, warc
from logweir.llm.queries import tokenizer_file

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()),
    T.StructField("row", T.StringType()), T.StructField("taken", T.StringType())])


def docs(spark, rows):
    full = [(i, t, lang, source, None if t is None else len(t), "x", "y", "z") for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCS)


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        text = ". ".join(" ".join(words(rng, int(rng.integers(3, 14)))) for _ in range(int(rng.integers(2, 9)))) + "."
        rows.append((i, text, ("en", "de", None)[i % 3], ("a", "b", "ß", None)[i % 4]))
    shared = ". ".join(" ".join(words(rng, 12)) for _ in range(5)) + "."
    for i in range(60, 80):
        rows.append((i, rows[i - 60][1] + "\n" + shared + "\n" + rows[i - 50][1], "en", "a"))
    for i in range(80, 95):
        own = rows[5][1].split(" ") + words(np.random.default_rng(9), 30)
        own[i % len(own)] = f"changed{i}"
        rows.append((i, " ".join(own), "en", "hot"))
    rows += [(95, rows[7][1], "en", "b"), (96, rows[7][1].upper(), "en", "b"), (97, "", "en", "b"), (98, None, None, None),
             (99, "one", "en", "b"), (100, "one", "en", "b"), (100, "one", "en", "b"), (101, " \n\t ", "en", "b"),
             (None, rows[3][1], "en", "a"), (102, "long " * 3000, "en", "c"), (103, "é 日本   x y z", "fr", "c")]
    return rows


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Main text

def test_main_text_of_a_page():
    page = """<html><head><title>No</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></ul></nav>
      <div class="side sidebar"><p>Not this one, it is beside the text.</p></div><article><h1>A &amp; B</h1><p>One
      <script>var a = "</p>";</script>two&nbsp;three<br>four<p>Five <a href='a>b'>six</a> seven</p><!-- <p>gone</p> -->
      <section id="comments"><p>Reader was here and he liked it all of the time.</p></section><form>Mail <input></form>
      </article><footer><p>All of the rights are reserved by the owner of it.</p></footer>"""
    assert main_text.main_text(page) == "A & B\nOne two three four\nFive six seven"


def test_main_text_without_an_article_element():
    text = "It was the best of times and it was the worst of times, and so he had to go to the house with the cat."
    page = f"<ul><li><a href=a>Home</a><li><a href=b>All the news</a></ul><h1>Head</h1><p>{text}</p><p>Short one.</p><p>{text}</p><p><a href=c>terms of it</a></p>"
    assert main_text.main_text(page) == f"Head\n{text}\nShort one.\n{text}"


def test_a_story_beside_a_teaser_article():
    text = "It was the best of times and it was the worst of times, and so he had to go to the house with the cat."
    for teaser in ("<article><a href=t>Another story</a></article>", "<div class='post-date'>2 May</div>",
                   "<article><h3>Another story</h3><p><a href=t>Read about it in the other place</a></p></article>"):
        page = f"<ul><li><a href=a>Home</a></ul><h1>Head</h1><div><p>{text}</p><p>Short one.</p><p>{text}</p></div>{teaser}"
        assert f"Head\n{text}\nShort one.\n{text}" in main_text.main_text(page)
    advert = "Buy cheap premium watches online today! Huge discount vouchers, free shipping worldwide, order now " * 3
    assert main_text.main_text(f"<article><p>{text}</p><p>{advert}</p><p>{text}</p><p>End.</p></article>") == f"{text}\n{text}\nEnd."
    foreign = "Lorem dolor amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua enim minim"
    assert main_text.main_text(f"<p>Menu</p><article><h1>Lorem</h1><p>{foreign}</p></article><p>Menu</p>") == f"Lorem\n{foreign}"


@pytest.mark.parametrize("page", ["", None, "<!--", "<p", "<script>", "<!-- a --", "<a href=\"", "</div></div>", "<p>" * 500])
def test_broken_pages(page):
    assert main_text.main_text(page) == ""


def test_open_blocks_take_the_nearer_label():
    assert main_text.settled([1, 0, 0, -1], 1) == [1, 1, -1, -1]
    assert main_text.settled([1, 0, -1], 1) == [1, 1, -1]
    assert main_text.settled([0, 0], -1) == [-1, -1]
    assert main_text.settled([], 1) == []


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>x  y</p>"), (1, "u", "<article><p>x  y</p>"), (None, None, None), (2, "", "")],
                                  "page_id long, url string, html string")
    assert sorted(map(tuple, main_text.extract(pages).collect()), key=repr) == sorted(
        [(1, "u", "x y", 3), (1, "u", "x y", 3), (None, None, "", 0), (2, "", "", 0)], key=repr)
    assert main_text.extract(pages.limit(0)).count() == 0


STORY = "The cat and the dog are in the house with all of us and it is a good day. " * 4


def test_marked_article_loses_no_unlinked_block():
    chinese = "这是一个很长的段落，讲述了许多事情。" * 15
    english = "The story of the town is told by its people and it was a good one for all of them in the end."
    page = f"<article><p>{chinese}</p><p>{english}</p><p>Kort</p><ul><li>Zwz qrt | brst plk | {'zrk mlp ' * 40}</ul><p>{chinese}</p></article>"
    lines = main_text.main_text(page).split("\n")
    assert lines[0] == chinese and lines[1:3] == [english, "Kort"] and len(lines) == 5


def test_links_count_through_the_blocks_they_hold():
    card = "<a href=x><div>Read the story of the year that was on the list for all of us to see here now</div><p>Teaser</p></a>"
    assert main_text.main_text(f"<article><p>{STORY}</p>{card}<p>{STORY}!</p></article>") == f"{STORY.strip()}\n{STORY}!"
    unclosed = f"<article><div><a href=x>Begin</div><p>{STORY}</p></article>"
    assert STORY.strip() in main_text.main_text(unclosed)


def test_unnamed_notice_beside_a_marked_article():
    notice = "We use cookies to give you the best of the site and to see what you do on it, as it is in the law of the land and the sea. " * 2
    assert main_text.main_text(f"<article><p>{STORY}</p></article><div>{notice}</div>") == STORY.strip()
    teaser = f"<article><p>Short teaser</p></article><div><p>{STORY}</p><p>{STORY}?</p></div>"  # the article is not the page's text
    assert main_text.main_text(teaser).split("\n")[-2:] == [STORY.strip(), f"{STORY}?"]


def test_page_in_a_language_without_stop_words():
    chinese = "这是一个很长的段落，讲述了许多事情。" * 15
    page = f"<body><div><a href=a>首页</a> <a href=b>新闻</a></div><div><p>{chinese}</p><p>{chinese}</p></div></body>"
    assert main_text.main_text(page) == f"{chinese}\n{chinese}"


# Repeated spans

def plain_repeats(rows):
    """Every run kept as its words, documents in order of id."""
    order = sorted({(math.inf if i is None else i, t or "") for i, t, *_ in rows})
    first, gone = {}, {}
    for n, (_, text) in enumerate(order):
        units = [u for _, u in spans.sentences(text)]
        for a, b in zip(*map(list, spans.runs([len(u) for u in units])), strict=True) if units else ():
            key = tuple(map(tuple, units[a:b + 1]))
            if first.setdefault(key, (n, a)) != (n, a):
                gone.setdefault(n, set()).update(range(a, b + 1))
    return {(None if i == math.inf else i, t): gone.get(n, set()) for n, (i, t) in enumerate(order)}


def test_repeats_equal_a_plain_version(spark, corpus):
    got = {}
    for row in spans.cleaned(docs(spark, corpus).repartition(5)).collect():
        got[row["row"]["doc_id"], row["row"]["text"] or ""] = (row["clean"], row["n_removed"])
    want = plain_repeats(corpus)
    assert {k: v[1] for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert sum(map(len, want.values())) > 50
    for (i, text), gone in want.items():
        assert (got[i, text][0] == text) == (not gone)


def test_runs_cover_a_repeated_passage_to_its_ends():
    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = rng.integers(1, 26, int(rng.integers(2, 20))).tolist()
        if sum(counts) < 50:
            continue
        first, last = spans.runs(counts)
        covered = {k for a, b in zip(first, last, strict=True) for k in range(a, b + 1)}
        assert covered == set(range(len(counts)))
        assert all(b > a and sum(counts[a:b + 1]) >= spans.WORDS for a, b in zip(first, last, strict=True))


def test_sentences_lose_no_word():
    for text in ["a. b! c?\nd", "x", "", "...", "a.b c. d\n\n e", "no end " * 40, "! ? .", "é. 日本。 z"]:
        assert [w for _, u in spans.sentences(text) for w in u] == text.lower().split()


def test_a_repeat_inside_long_sentences_goes_at_any_offset(spark):
    rng = np.random.default_rng(11)
    rows, longest = [], 0
    for i in range(40):
        own = words(rng, 60)
        rows.append((i, " ".join(words(rng, 40) + own + words(rng, 40)), "en", "a"))
        rows.append((100 + i, " ".join(words(rng, 30 + i) + own + words(rng, 35)), "en", "a"))
    clean = {r["row"]["doc_id"]: r["clean"].split() for r in spans.cleaned(docs(spark, rows)).collect()}
    for i, text, *_ in rows:
        own, left = text.split(), clean[i]
        if i < 100:
            assert left == own
        else:  # brute force: of the 60 words in common only those near the ends stay, and no other word goes
            head, tail = own[:i - 70], own[i - 10:]
            assert left[:len(head)] == head and left[-len(tail):] == tail
            assert len(left) - len(head) - len(tail) <= 2 * spans.NEAR + 2
            longest = max(longest, len(left) - len(head) - len(tail))
    assert 0 < longest
    own = words(rng, 200)
    at = [*spans.cuts(own), 200]
    assert at[0] == 0 and 0 < min(np.diff(at)) and max(np.diff(at)) <= spans.NEAR


def test_rewritten_keeps_columns(spark, corpus):
    table = docs(spark, corpus)
    out = spans.rewritten(table)
    assert out.columns == table.columns and dict(out.dtypes) == dict(table.dtypes)
    rows = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert (98, None) in rows and (97, "") in rows and not any(k[0] == 95 for k in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values() if r["text"] is not None)
    assert spans.rewritten(table.limit(0)).count() == 0


# Archives

def test_archives(spark):
    long, other = "<p>" + "x" * 200, "<p>" + "é" * 60
    rows = [(5, "u5", long), (3, "u3", long), (9, None, long), (3, "u3", long), (1, "u", other), (2, "u", "short"), (4, "u", "short"),
            (6, "a\nb", None), (7, "u", ""), (None, "n", long), (10, "u", "z" * 100), (11, "u", "z" * 100), (12, "u", "z" * 99), (13, "u", "z" * 99)]
    pages = spark.createDataFrame([(*r, "payload", "mark") for r in rows], "page_id long, url string, html string, payload string, mark string")
    got = warc.archived(spark, pages).drop("archive", "at", "url").collect()
    count = {}
    for r in got:
        count[tuple(r)] = count.get(tuple(r), 0) + 1
    want = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        same = sorted(p for p, _, h in rows if p is not None and (h or "").encode() == raw)
        revisit = len(raw) >= 100 and len([1 for *_, h in rows if (h or "").encode() == raw]) > 1 and page != same[0]
        key = (page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", same[0] if revisit else None)
        want[key] = want.get(key, 0) + 1
    twin = (3, 203, hashlib.sha256(long.encode()).hexdigest(), "response", None)
    assert want[twin] == 2  # of two equal rows the second is a revisit of the first
    want[twin] = 1
    want[(*twin[:3], "revisit", 3)] = 1
    assert count == want
    assert warc.archived(spark, pages.limit(0)).count() == 0


def test_an_archive_is_read_record_by_record(tmp_path):
    rows = [(i, "u", b"<p>hello of the archive %d " % i * 40, "00", None, False) for i in range(50)]
    raw = b"".join(warc._archive(iter([(*r[:3], hashlib.sha256(r[2]).hexdigest(), None, False) for r in rows]), 6, 1 << 20, 1 << 12))
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_MAGIC and int.from_bytes(raw[4:8], "little") > 0
    path = tmp_path / "a"
    path.write_bytes(raw)
    with open(path, "rb") as stream:
        found = [warc.parse_record(r) for _, r in warc.frames(stream)]
    assert [f[0] for f in found] == list(range(50)) and found[3][2] == len(rows[3][2])
    with open(path, "r+b") as stream:
        stream.seek(len(raw) - 20)
        stream.write(b"\0\0\0\0")
    with open(path, "rb") as stream, pytest.raises(Exception):
        list(warc.frames(stream))


def test_every_archive_has_a_dictionary(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>page {i} of the archive</p>" * (i % 7)) for i in range(60)], "page_id long, url string, html string")
    for rows in (60, 3):
        made = warc.write_archives(spark, pages.where(f"page_id < {rows}").repartition(20), f"{tmp_path}/{rows}")
        for path, records, _ in made.collect():
            with open(path, "rb") as file:
                magic, size = int.from_bytes(file.read(4), "little"), int.from_bytes(file.read(4), "little")
            assert magic == warc.DICTIONARY_MAGIC and (size > 0 or records == 0)
        assert warc.read_archives(made).count() == rows


# SentencePiece

def test_parity_and_round_trip(spark, corpus):
    import sentencepiece

    raw = tokenizer_file("piece_bpe_32k.model")
    odd = [(200, " lead", "", ""), (201, "trail  ", "", ""), (202, "a  b   c\n\n d", "", ""), (203, "<s> </s> <0x0A> 😀", "", ""), (204, " ", "", "")]
    table = docs(spark, [*corpus, *odd])
    own = sentencepiece.SentencePieceProcessor(model_proto=raw)
    back = pieces.decode_ids(pieces.encode_texts(table, raw), raw).collect()
    texts = {}
    for i, t, *_ in [*corpus, *odd]:
        texts.setdefault(i, t or "")
    for r in back:
        assert list(r["ids"]) == own.encode(texts[r["doc_id"]]) and r["parity"] and r["text"] == texts[r["doc_id"]]
    assert len(back) == len(corpus) + len(odd)
    assert all(r["restored"] for r in pieces.round_trip(table, raw).collect())
    assert pieces.round_trip(table.limit(0), raw).count() == 0


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += bytes([number << 3 | 2]) + _varint(len(value)) + value
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + np.float32(value).tobytes()
        else:
            out += _varint(number << 3) + _varint(value)
    return out


def _varint(value):
    out = b""
    while value > 127:
        out, value = out + bytes([value & 127 | 128]), value >> 7
    return out + bytes([value])


def test_unigram_models_are_rebuilt_too():
    import sentencepiece

    entries = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    entries += [("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.1, 1), ("c", -4.3, 1), ("ab", -4.5, 1), ("▁ab", -5.0, 1), ("bc", -4.2, 1), ("▁a", -6.5, 1)]
    raw = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, k)))) for p, s, k in entries)
    raw += _message((2, _message((3, 1), (35, 1))), (3, _message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    coder, own = pieces.Pieces(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ["abc ab", "a", "", "cab  abz é", "bcbcabc"]
    ids, same = coder.encode(texts)
    assert [x.tolist() for x in ids] == own.encode(texts) and all(same)


# Mixing

def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    held, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in held]
        level = (1.5 * total - 2 * sum(sizes[s] for s in held)) / max(1, sum(weight[s] for s in free))
        more = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not more:
            return {s: 2 * sizes[s] if s in held else level * weight[s] for s in order}
        held |= more


def test_mix(spark, corpus):
    got = [tuple(r) for r in mixing.mix_words(docs(spark, corpus)).collect()]
    assert sorted(((r[0], r[2]) for r in got), key=repr) == sorted(((i, len(plain_words(t))) for i, t, *_ in corpus), key=repr)
    sizes = {}
    for _, t, _, source in corpus:
        sizes[source] = sizes.get(source, 0) + len(plain_words(t))
    goals = plain_targets(sizes)
    for source, whole in sizes.items():
        rows = [r for r in got if r[1] == source]
        assert {r[3] for r in rows} == {whole} and rows[0][4] == pytest.approx(goals[source])
        assert sum(r[5] for r in rows) == math.floor(rows[0][4] + 1e-9)
        assert all(0 <= r[5] <= 2 * r[2] for r in rows)
    assert sum(goals.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = [tuple(r) for r in mixing.mix_words(docs(spark, corpus).repartition(7)).collect()]
    assert sorted(again, key=repr) == sorted(got, key=repr)
    assert mixing.mix_words(docs(spark, corpus).limit(0)).count() == 0


def test_mixed_texts(spark, corpus):
    table = docs(spark, corpus).where("doc_id <> 100")
    taken = {(r["doc_id"]): r["taken"] for r in mixing.mix_words(table).collect()}
    rows = mixing.mixed_texts(table)
    assert rows.columns == table.columns and dict(rows.dtypes) == dict(table.dtypes)
    got = {}
    for r in rows.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(plain_words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert got == {i: n for i, n in taken.items() if n}


# Perplexity

def test_base_counts(corpus):
    for text in [t for _, t, *_ in corpus] + ["a b\na b\n\n \nx", "#a $ % <b> | & *", "a a a a", "x y z x y z q", "日本 é"]:
        own = plain_words(text)
        lines = [line for line in (text or "").split("\n") if plain_words(line)]
        windows = [tuple(own[i:i + 3]) for i in range(len(own) - 2)]
        inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(own) < 500 else None
        got = perplexity.base_counts(text)
        assert got[:4] == (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)))
        assert inside is None or got[4] == len(inside)


def test_the_model_is_a_distribution(spark, corpus):
    table = docs(spark, corpus)
    model = perplexity.kneser_ney(perplexity.gram_counts(table))
    symbols = perplexity.Symbols()
    counts = {}
    for _, text, *_ in corpus:
        for g in perplexity.Symbols.grams(symbols.of(text)).tolist() if text else ():
            counts[g] = counts.get(g, 0) + 1
    assert dict(map(tuple, perplexity.gram_counts(table).collect())) == counts
    for context in [0, 5, 40 * 40 * 3 + 7, *[g // 40 for g in list(counts)[:20]]]:
        p = np.exp(perplexity._logp(model, context * 40 + np.arange(40), perplexity.ORDER))
        assert p.sum() == pytest.approx(1, abs=1e-6) and (p > 0).all()


def test_noise_goes_and_clean_text_stays(spark):
    rng = np.random.default_rng(5)
    stock = [" ".join("".join(rng.choice(["the", "ing", "on", "ed", "re"], 2)) for _ in range(8)) for _ in range(400)]
    rows = [(i, ". ".join(stock[int(k)] for k in rng.integers(0, 400, 12)), "en", "a") for i in range(200)]
    noise = "".join(chr(c) for c in rng.integers(97, 123, 600))
    rows += [(900, " ".join(noise[i:i + 5] for i in range(0, 600, 5)), "en", "a"), (901, "few words", "en", "a"), (902, None, None, None),
             (903, "same three words " * 40, "en", "a")]
    got = {r["doc_id"]: r for r in perplexity.quality(docs(spark, rows)).collect()}
    assert all(got[i]["kept"] for i in range(200))
    assert not got[900]["base_failed"] and not got[900]["kept"]
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (901, 902, 903))
    assert perplexity.quality(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("percent", [1, 10, 30])
def test_noise_does_not_widen_its_band(spark, percent):
    rng = np.random.default_rng(6)
    stock = [" ".join("".join(rng.choice(["the", "ing", "on", "ed", "re"], 2)) for _ in range(8)) for _ in range(400)]
    rows = [(i, ". ".join(stock[int(k)] for k in rng.integers(0, 400, 12)), "en", "a") for i in range(200)]
    bad = 200 * percent // (100 - percent)
    for i in range(1000, 1000 + max(1, bad)):
        noise = "".join(chr(c) for c in rng.integers(97, 123, 600))
        rows.append((i, " ".join(noise[k:k + 5] for k in range(0, 600, 5)), "en", "a"))
    got = {r["doc_id"]: r["kept"] for r in perplexity.quality(docs(spark, rows)).collect()}
    assert not any(kept for i, kept in got.items() if i >= 1000)
    assert sum(kept for i, kept in got.items() if i < 1000) >= 195


# Token files

def test_token_files(spark, corpus):
    from tokenizers import Tokenizer

    raw = tokenizer_file("word_bpe_49k.json")
    own = Tokenizer.from_str(raw.decode())
    odd = [(300, "<|endoftext|> it's I'LL x́ ﬁ İ ΣΑΣ 12½", "", ""), (-5, "minus", "", "")]
    rows = sorted([*corpus, *odd], key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(map(tuple, token_files.token_table(spark, docs(spark, [*corpus, *odd]), raw).collect()), key=lambda r: r[1])
    at = 0
    for (i, text, *_), r in zip(rows, got, strict=True):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        assert r == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.token_table(spark, docs(spark, corpus).limit(0), raw).count() == 0


# Classifier

def test_held_out_accuracy(spark):
    rng = np.random.default_rng(2)
    stock = [f"{a}{b}" for a in "the on re ing ed st".split() for b in "ha er is on at ti".split()]
    rows = []
    for i in range(400):
        own = rng.choice(stock, 60).tolist()
        rows.append((i, " ".join(own if i % 4 else [w.upper() + "!!" for w in own]), "en", "a"))
    rows += [(900, "", "en", "a"), (901, None, None, None), (None, "one two", "en", "a")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(5000, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = classifier.quality_scores(docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    out = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert len(out) > 50 and np.mean([r["predicted"] == int(r["doc_id"] % 4 > 0) for r in out]) > 0.95
    table = docs(spark, rows)
    assert classifier.accepted(table, labels).columns == table.columns
    assert classifier.quality_scores(table.limit(0), labels).count() == 0
    assert {r["score"] for r in classifier.quality_scores(table, labels.limit(0)).collect()} == {0.5}


# Near-duplicates

def plain_components(rows, width, percent):
    sets = []
    for _, text, *_ in rows:
        own = plain_words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append(frozenset(tuple(own[i:i + width]) for i in range(max(1, len(own) - width + 1))) if own else frozenset())
    ids = [math.inf if r[0] is None else r[0] for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(rows)):
        least[top(i)] = min(least.get(top(i), math.inf), ids[i])
    plain = lambda x: None if x == math.inf else x
    return sorted(((plain(ids[i]), len(sets[i]), plain(least[top(i)]), ids[i] == least[top(i)]) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize("width", [4, 5])
def test_components_equal_all_pairs(spark, corpus, width):
    got = sorted((tuple(r) for r in near.near_duplicates(docs(spark, corpus), width).collect()), key=repr)
    assert got == plain_components(corpus, width, 80)
    assert len({r[2] for r in got}) < len(corpus) - 4


def test_chains_of_links_are_followed(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base, rows = words(rng, 200), []
    for i in range(40):
        base = list(base)
        base[5 * i % 200] = f"new{i}"
        base[(5 * i + 100) % 200] = f"other{i}"
        rows.append((100 - i, " ".join(base), "en", "a"))
    monkeypatch.setattr(near, "BLOCK", 8)
    got = sorted((tuple(r) for r in near.near_duplicates(docs(spark, rows), 4).collect()), key=repr)
    assert got == plain_components(rows, 4, 80)


def test_representatives(spark, corpus):
    table = docs(spark, corpus)
    out = near.representatives(table)
    assert out.columns == table.columns
    ids = sorted((r["doc_id"] for r in out.collect()), key=repr)
    want = {r[0] for r in plain_components(corpus, 5, 80) if r[3]}
    assert ids == sorted(want, key=repr)
    assert near.representatives(table.limit(0)).count() == 0


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 100, 4000):
        items = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        assert (near.sketch(items) != ~np.uint64(0)).all()
    errors = []
    for k in range(30):
        items = rng.integers(0, 1 << 62, 400).astype(np.uint64)
        errors.append((near.sketch(np.unique(items[:360])) == near.sketch(np.unique(items[40:]))).mean() - 320 / 400)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


# Top k

def test_top_k(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 0.2, 24).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(30)] + [(600, None), (700, []), (800, [float("nan")] * 24), (900, [float("inf")] + [0.0] * 23),
             (1000, [None] + [0.1] * 23), (1001, [0.5] * 7), (1100, [0.25] * 7), (None, [0.1] * 24), (7, rows[7][1]), (1200, [1e300] * 24)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(table.repartition(3)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, [math.floor(1024.0 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    most = (1 << 63) - 1
    for q, v in [g for g in good if g[0] % 100 == 0]:
        found = sorted((-max(-most - 1, min(most, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in good if i != q and len(w) == len(v))[:10]
        if q != 1200 and found and found[0][1] != 1200 and 1200 not in [i for _, i in found]:
            assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(found, 1)]
        else:
            assert [i for _, i, _ in sorted(got[q])] == [i for _, i in found]
    assert set(got) == {q for q, v in good if q % 100 == 0 and any(i != q and len(w) == len(v) for i, w in good)}
    assert topk.top_k(table.limit(0)).count() == 0


def test_bounds_are_never_below_the_score():
    rng = np.random.default_rng(10)
    q, v = topk.quantised(rng.normal(0, 1, (20, 37))), topk.quantised(rng.normal(0, 1, (50, 37)))
    exact, last = q @ v.T, np.inf
    for parts in topk.LEVELS:
        most = topk.bound(topk.segments(q, parts), topk.segments(v, parts))
        assert (most >= exact - 1e-3).all() and most.mean() <= last
        last = most.mean()
