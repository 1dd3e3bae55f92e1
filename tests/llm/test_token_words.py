"""The encoder that goes word by word, against the library on whole texts."""

import random

from logweir.llm.queries import tokenizer_file
from logweir.llm.word_ids import WordIds


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    raw = tokenizer_file("word_bpe_49k.json")
    rng = random.Random(7)
    bits = ["Foo", "bar", "it's", "'S", "''", "don't'", "x1", "12", "...", "Été", "ñ", "İ", "ΣΣ", "Ÿ", "ſ", "é", "日本",
            "<|", "<|endoftext|>", "\x07", "\x7f", "$$", "(", " ", " ", "\x85", "ß", "Straße.", "µ", "ª", "ŉ"]
    texts = [None, ""] + ["".join(rng.choice(bits) + rng.choice(["", "", " ", "\n", "\t "]) for _ in range(rng.randrange(40))) for _ in range(400)]
    encoder, library = WordIds(raw, known=300), Tokenizer.from_str(raw.decode("utf-8"))
    for _ in range(2):  # the second time from the table of known words
        for low in range(0, len(texts), 50):
            part = texts[low:low + 50]
            ids, sizes = encoder.encode(part, 2)
            at = 0
            for text, size in zip(part, sizes.tolist(), strict=True):
                assert ids[at:at + size].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2], text
                at += size


def test_letters_and_marks_after_them_need_no_pattern():
    encoder = WordIds(tokenizer_file("word_bpe_49k.json"))
    asked, split = [], encoder.split
    encoder.split = lambda word: asked.append(word) or split(word)
    encoder.encode(["Plain words, and (others) that don't. Été!"], 2)
    assert sorted(asked) == ["(others)", "don't."]
