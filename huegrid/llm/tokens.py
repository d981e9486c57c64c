"""Encoding with a public tokenizer file, remembering the ids of chunks of text.

The pre-tokenizer of the word-level file never joins text across ASCII white
space, and its normalizer works on each side of it alone, so the ids of a text
are the ids of its chunks in turn.  Texts below U+0300 hold no combining marks;
a chunk of theirs is lower-cased and cut by the file's own split pattern, whose
matches are encoded alone.  Each distinct chunk is encoded once for as long as
the bounded memory holds it.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import regex

#: Chunks in each of the two generations that a worker remembers: the older one goes when the younger one is full.
REMEMBERED = 300_000

_encoders: dict[str, "Encoder"] = {}


class Memory(dict):
    """Ids of chunks, learnt at first sight; an older generation stands behind it."""

    def __init__(self, learn: Callable[[bytes], bytes]):
        self.learn, self.older = learn, {}

    def __missing__(self, chunk: bytes) -> bytes:
        got = self.older.get(chunk)
        if got is None:
            got = self.learn(chunk)
        self[chunk] = got
        return got

    def turned(self) -> "Memory":
        """A young one with this as the older generation, once this is full."""
        if len(self) <= REMEMBERED:
            return self
        young = Memory(self.learn)
        young.older, self.older = self, {}
        return young


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Only for tokenizer files that lower-case, drop white space and split by one pattern; others raise."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        normal = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if normal != ["NFC", "Replace", "Lowercase"] or (split["type"], split["behavior"], split["invert"]) != ("Split", "Removed", True) or level["type"] != "ByteLevel":
            raise ValueError(f"{path}: not a tokenizer whose pieces can be encoded alone")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.marks = regex.compile("|".join(regex.escape(x["content"]) for x in spec["added_tokens"])).search
        self.high = regex.compile("[\u0300-\U0010ffff]").search
        self.tokenizer = Tokenizer.from_file(path)
        self.low, self.any = Memory(self._low), Memory(self._any)
        self.width, self.code = (np.uint16, "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else (np.uint32, "I")
        # the byte-level alphabet: printable bytes stand for themselves, the others for U+0100 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        self.alphabet = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}

    def _low(self, chunk: bytes) -> bytes:
        """The ids of a lower-cased chunk below U+0300: of its matches of the split pattern, which are chunks too, or of the one that it is."""
        text = chunk.decode()
        if not text.isalpha():
            matches = self.pieces(text)
            if len(matches) != 1:
                return b"".join([self.low[p.encode()] for p in matches])
            text = matches[0]
        if not (text.isascii() and text.isprintable()):  # else the byte-level alphabet is the same
            text = text.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()

    def _any(self, chunk: bytes) -> bytes:
        return array(self.code, self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None, end: int | None = None) -> np.ndarray:
        """Ids of the whole text (null: empty) without special tokens, then end if given."""
        text = text or ""
        if text.isascii() and "<" not in text or not self.high(text) and not self.marks(text):
            self.low = known = self.low.turned()
            chunks = text.lower().encode().split()
        else:
            self.any = known = self.any.turned()
            chunks = text.encode().split()
        ids = b"".join(map(known.__getitem__, chunks))
        return np.frombuffer(ids if end is None else ids + self.width(end).tobytes(), self.width)


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
