"""Whole texts to token ids with a public tokenizer file, for use inside tasks."""

from __future__ import annotations

import json
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words, and pieces of words, whose ids a Python worker remembers; beyond that it starts over.
REMEMBERED_WORDS, REMEMBERED_PIECES = 500_000, 500_000

#: Words of these characters only are cut into pieces here; their lower case is one character each.
_plain = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+")
#: The pieces of the word-end vocabulary's own pre-tokenizer, on lower-cased plain words.
_piece = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017e]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u012f\u0131-\u017e]+")
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_encoders: dict[int, "WordEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes for 256, 257, ..."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


_letters = _byte_letters()


class WordEncoder:
    """Texts to little-endian 32-bit ids, remembering each word between ASCII white space.

    Only for tokenizers whose pre-tokenizer drops white space and whose normalizer works on each
    character or on NFC, so that a text's ids are those of its words one after another.
    """

    def __init__(self, model_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model_json)
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.cuts_words = json.dumps(_PATTERN) in model_json and '"Lowercase"' in model_json

    def _cut(self, word: bytes) -> list[str] | None:
        """A word's pieces, which the tokenizer's model encodes one by one; None if the word isn't plain."""
        text = word.decode()
        if self.cuts_words and _plain.fullmatch(text) and "<|" not in text:
            return _piece.findall(text.lower())
        return None

    def _learn(self, words: list[bytes]) -> None:
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        cuts = {w: self._cut(w) for w in words if w not in self.known}
        if len(self.pieces) > REMEMBERED_PIECES:
            self.pieces.clear()
        pieces, tokenize = self.pieces, self.tokenizer.model.tokenize
        for word, cut in cuts.items():
            if cut is None:
                self.known[word] = array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
                continue
            for p in cut:
                if p not in pieces:
                    letters = p if p.isascii() else p.encode().decode("latin-1").translate(_letters)
                    pieces[p] = array("I", [t.id for t in tokenize(letters)]).tobytes()
            self.known[word] = b"".join([pieces[p] for p in cut])

    def encode_many(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as bytes; a null text has none."""
        split = [(t or b"").split() for t in texts]
        out = []
        for words in split:
            try:
                out.append(b"".join(map(self.known.__getitem__, words)))
            except KeyError:
                rest = split[len(out) : len(out) + 200]
                self._learn([w for ws in rest for w in ws])
                out.append(b"".join([self.known[w] if w in self.known else self._one(w) for w in words]))
        return out

    def _one(self, word: bytes) -> bytes:
        self._learn([word])
        return self.known[word]


def encoder(model) -> WordEncoder:
    """The worker's encoder for a broadcast tokenizer file."""
    key = hash(model.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(model.value)
    return _encoders[key]


def read_tokenizer(spark, path: str | None):
    """Broadcast a tokenizer file (a few MB; more than 64 MB is refused)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if len(text) > 64_000_000:
        raise ValueError("a tokenizer file of more than 64 MB is not broadcast")
    return spark.sparkContext.broadcast(text)
