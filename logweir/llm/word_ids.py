"""Ids of texts from a tokenizer that never joins across white space, with bounded tables of known words."""

import os
from array import array
from collections import defaultdict
from itertools import chain, count, islice
from string import punctuation as MARKS

import numpy as np

#: The tables of known words and pieces are emptied when they have so many; others are encoded again.
KNOWN = 800_000


class WordIds:
    """Encodes word by word. Words are cut at 20 and 09-0D only, where no token and no normal form reaches
    across, so the ids of a text are the ids of its words one after the other.

    A new word goes through the library's whole encoder. Where it has only Latin letters below U+0130,
    whose normal form and lower case are plain, it is split here and only its new pieces go to the
    library's merge model, which saves most of the time: words differ in case and punctuation, pieces don't.
    """

    def __init__(self, tokenizer: bytes, known: int = KNOWN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer.decode("utf-8"))
        self.merge = self.tokenizer.model.tokenize
        self.size, self.known = self.tokenizer.get_vocab_size(), known
        steps = (json.loads(tokenizer).get("pre_tokenizer") or {}).get("pretokenizers") or []
        norms = [n["type"] for n in (json.loads(tokenizer).get("normalizer") or {}).get("normalizers") or []]
        plain = norms == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["invert"]
        self.split = regex.compile(steps[0]["pattern"]["Regex"]).findall if plain else None
        # Its runs of letters and of marks are pieces, but for the endings after an apostrophe.
        self.usual = plain and steps[0]["pattern"]["Regex"] == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.simple = regex.compile(r"[!-\x7e\xa1-į]+").fullmatch  # no white space, no marks that combine
        letters = sorted(pre_tokenizers.ByteLevel.alphabet())
        direct = [b for b in range(256) if chr(b) in letters and (33 <= b <= 126 or b >= 161)]
        rest = iter(c for c in letters if ord(c) >= 256)
        self.shown = {b: chr(b) if b in direct else next(rest) for b in range(256)}
        self.clear()

    def clear(self) -> None:
        # A word that is looked up for the first time gets the next number. Ids are held as bytes, which the
        # collector of cycles does not walk.
        self.places: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.pieces: dict[str, bytes] = {}
        self.starts, self.flat = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def _piece(self, piece: str) -> bytes:
        # Printable ASCII stands for itself.
        shown = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(self.shown)
        ids = self.pieces[piece] = array("I", [t.id for t in self.merge(shown)]).tobytes()
        return ids

    def _ids(self, new: list[bytes]) -> list[bytes]:
        found: list[bytes] = []
        whole = []
        known, piece_of, split, simple, usual = self.pieces.get, self._piece, self.split, self.simple, self.usual
        text = b"\n".join(new).decode("utf-8")  # no word has a line end
        for word, lower in zip(text.split("\n"), text.lower().split("\n"), strict=True):
            if split and word.isalpha() and (word.isascii() or max(word) < "\u0130"):  # letters alone are one piece
                found.append(known(lower) or piece_of(lower))
            elif split and "<|" not in word and (word.isprintable() if word.isascii() else simple(word)):
                if usual and (core := lower.rstrip(MARKS)).isalpha():  # and so are the marks after them
                    rest = lower[len(core):]
                    found.append((known(core) or piece_of(core)) + (known(rest) or piece_of(rest)))
                else:
                    found.append(b"".join([known(p) or piece_of(p) for p in split(lower)]))
            else:
                whole.append((len(found), word))
                found.append(b"")
        for (i, _), e in zip(whole, self.tokenizer.encode_batch_fast([w for _, w in whole], add_special_tokens=False), strict=True):
            found[i] = array("I", e.ids).tobytes()
        return found

    def _learn(self, new: list[bytes]) -> None:
        ids = self._ids(new)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), np.uint32)])

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, each text closed with ``end_id``, and the number for each text."""
        if len(self.places) > self.known or len(self.pieces) > self.known:
            self.clear()
        cut = [t.encode("utf-8").split() if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        places = self.places
        before = len(places)
        use = np.fromiter(map(places.__getitem__, flat), np.int64, len(flat))
        if len(places) > before:
            self._learn(list(islice(reversed(places), len(places) - before))[::-1])
        ids, ends = gather(self.starts, self.flat, use)
        bounds = np.concatenate([[0], np.cumsum([len(words) for words in cut])])
        at = np.concatenate([[0], ends])[bounds]  # ids before each text
        return np.insert(ids, at[1:], end_id), np.diff(at) + 1


def gather(starts: np.ndarray, flat: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[starts[u]:starts[u + 1]]`` for every u one after the other, and where each ends."""
    low = starts[use]
    sizes = starts[use + 1] - low
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(low - (ends - sizes), sizes)
    return flat[at], ends
