"""Token ids of whole texts by a public tokenizer file, a word at a time with a bounded cache in each worker."""

from __future__ import annotations

import os
from array import array
from itertools import chain

CACHE_WORDS = 800_000
_encoders: dict[str, Encoder] = {}


class Encoder:
    """ids(texts): each text's ids, little-endian unsigned 32-bit.

    The tokenizer's pre-tokens never cross white space, so a text's ids are its words' ids end to end. Words repeat;
    their ids are kept, up to `limit` words, after which the cache starts anew. A text that spells a special token is
    encoded whole, as there the tokenizer looks across white space.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit = limit
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def parts(word: bytes) -> tuple[str, str]:
        """A word as a stem that many words share, and a final comma or stop.

        A comma or stop after a letter is a pre-token of its own. A-Z may be lower-cased early where nothing can compose
        with them: in ASCII, or where all characters are letters.
        """
        stem, tail = word.decode(), ""
        if len(stem) > 1 and stem[-1] in ".," and stem[-2].isalpha():
            stem, tail = stem[:-1], stem[-1]
        if stem.isascii() or stem.isalpha():
            stem = stem.encode().lower().decode()
        return stem, tail

    def learn_stems(self, stems: list[str], step: int = 1000) -> None:
        for i in range(0, len(stems), step):
            part = stems[i : i + step]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, starts = found.ids, [o[0] for o in found.offsets]
            at, limit = 0, 0
            for stem in part:
                limit += len(stem) + 1
                to = at
                while to < len(starts) and starts[to] < limit:
                    to += 1
                self.stems[stem] = array("I", ids[at:to]).tobytes()
                at = to

    def learn(self, words: set[bytes]) -> None:
        if len(self.words) + len(words) > self.limit:
            self.words.clear()
            self.stems.clear()
        parts = {w: self.parts(w) for w in words}
        need = {stem for stem, _ in parts.values()} | {tail for _, tail in parts.values() if tail}
        self.learn_stems([s for s in need if s not in self.stems])
        for word, (stem, tail) in parts.items():
            self.words[word] = self.stems[stem] + (self.stems[tail] if tail else b"")

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out, at = [b""] * len(texts), []
        split = []
        for i, text in enumerate(texts):
            if text and any(s in text for s in self.special):
                out[i] = self.whole(text)
            elif text:
                at.append(i)
                split.append(text.encode().split())
        new = set(chain.from_iterable(split)).difference(self.words)
        if len(self.words) + len(new) > self.limit:
            new = set(chain.from_iterable(split))
        if new:
            self.learn(new)
        get = self.words.__getitem__
        for i, words in zip(at, split, strict=True):
            out[i] = b"".join(map(get, words))
        return out


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
