"""Token ids from a tokenizers JSON file, with a bounded memory of words already encoded.

The word-ended BPE file cuts texts at white space before merging, so the ids of a text are those of its words
in order. A worker keeps the ids of recent words and asks the library only for the others.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterable
from functools import lru_cache

import regex

#: How the word-ended BPE file normalises and cuts text. Other files are encoded text by text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]

_CUT = regex.compile(WORD_PATTERN)
#: Words of these characters are the same in any Unicode version, composed, and free of inner white space.
_PLAIN = regex.compile(r"[!-~À-ɏ]{1,64}")


#: Byte-level BPE writes a byte as one printable character: itself where it prints, else the next one from 256 on.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTS)}


class _Memo(dict):
    """A dict that makes what it lacks and forgets everything when full."""

    def __init__(self, make, limit: int) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class WordIds:
    """Encodes texts to little-endian unsigned 32-bit ids, without special tokens added."""

    def __init__(self, path: str, memory: int = 500_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._tokenizer = Tokenizer.from_file(path)
        self._whole = not self._cuts_at_space(spec)
        self._model = self._tokenizer.model
        self._pieces = _Memo(self._piece, memory)
        self._words = _Memo(self._word, memory)
        self.size = self._tokenizer.get_vocab_size()

    @staticmethod
    def _cuts_at_space(spec: dict) -> bool:
        normal = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        added = spec.get("added_tokens", [])
        return (
            normal == WORD_NORMALIZERS
            and (cuts[0].get("pattern") or {}).get("Regex") == WORD_PATTERN
            and all(x["content"].startswith("<|") and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in added)
        )

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array("I", [token.id for token in self._model.tokenize(piece)]).tobytes()

    def _word(self, word: str) -> bytes:
        stem, mark = (word[:-1], word[-1]) if word[-1:] in (",", ".") else (word, "")
        if stem.isalpha() and stem.isascii() and len(stem) <= 64:
            return self._piece(stem.lower()) + (self._pieces[mark] if mark else b"")
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self._pieces.__getitem__, _CUT.findall(word.lower())))
        return self._library(word)

    def _library(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        if self._whole:
            return [self._library(text) for text in texts]
        known = self._words.__getitem__
        return [b"".join(map(known, text.replace("\n", " ").split(" "))) for text in texts]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """The encoder of a worker process."""
    return WordIds(path)
