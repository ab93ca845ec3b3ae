"""Token ids of whole texts by a public tokenizer, with a bounded cache.

A text of plain Latin-1 is split into pieces as the tokenizer's own pattern does, and every piece goes through the
library's BPE model, once while the cache holds it. The tokenizer drops white space, so other texts are taken word by
word: those with letters beyond Latin-1 or special tokens go through the whole library. So do whole texts with one of
the rare separators on which Python and the library may differ, and all texts of a tokenizer file of another kind.
"""

from __future__ import annotations

import json
import os
import re
from array import array

#: When the cache of a Python worker has so many pieces it becomes the older one, in which a second look finds them:
#: pieces in use stay, and both together take some 110 MB.
CACHE_PIECES = 300_000
#: Separators to Python's str.split beyond tab, newlines, form feeds and space.
_RARE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028-\u2029\u202f\u205f\u3000\ufeff]")

# The tokenizer file's normalizer and pre-tokenizer that the short way stands for, on Latin-1 text.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = ["NFC", "Replace", "Lowercase"]
_PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-\xff]+")
_L, _N = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself where printable, else the next code point from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    """Pieces' ids; a missing piece is taken from the older cache or made."""

    def __init__(self, make, older: dict[str, bytes]) -> None:
        self.make, self.older = make, older

    def __missing__(self, piece: str) -> bytes:
        got = self[piece] = self.older.get(piece) or self.make(piece)
        return got


class Encoder:
    """ids(texts) -> one bytes of little-endian unsigned ids per text, of `width` bytes each; None counts as empty."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Bytes of an id: two if all ids of the file fit.
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code, self.cache = "H" if self.width == 2 else "I", _Cache(self._piece, {})
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        normal = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        split = next((x["pattern"]["Regex"] for x in (made.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"), None)
        #: Whether words may be taken alone, and plain ones by the model alone: so if the file is of the kind known here.
        self.known = normal == _NORMAL and split == _SPLIT and made["model"]["type"] == "BPE"
        self.special = re.compile("|".join(re.escape(x["content"]) for x in made.get("added_tokens", [])) or "(?!)")

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per worker process: kept over its tasks."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _library(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [x.id for x in self.model.tokenize(letters)]).tobytes()

    def _pieces(self, text: str | None) -> list[str] | None:
        """The tokenizer's pieces of a plain text; None for another."""
        if not text:
            return []
        return _PIECES.findall(text.lower()) if self.known and _PLAIN.fullmatch(text) and not self.special.search(text) else None

    def _other(self, text: str) -> bytes:
        if not self.known or _RARE.search(text):
            return self._library(text)
        return b"".join([self._library(w) if (p := self._pieces(w)) is None else b"".join(map(self._piece, p)) for w in text.split()])

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > CACHE_PIECES:
            self.cache = _Cache(self._piece, dict(self.cache))
        get = self.cache.__getitem__
        return [self._other(t) if (p := self._pieces(t)) is None else b"".join(map(get, p)) for t in texts]
