"""Token ids of whole texts by the tokenizers library, with a cache of pieces between blanks.

A byte-pair tokenizer works on pre-tokens that never reach across certain blanks. A text cut at such
blanks gives the same ids as the whole text, and most pieces come again and again, so each distinct piece is
encoded once. A piece of plain Latin letters, digits and signs is split into pre-tokens here and goes to the
library's model; any other piece goes through the whole tokenizer, and so does a text that the rule for cutting
does not cover.
"""

from __future__ import annotations

import gc
import importlib
import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

#: Pieces that a worker remembers at most: as many of late, and as many before them; and half as many pre-tokens.
CACHE = 1_000_000
#: The pattern of byte-level pre-tokens, and characters on which all Unicode versions and rules agree
#: (without those that open a special token's string).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile("[\n -;=-Z\\^-~\xa1-\xac\xae-\xff]*")

#: A blank that another white space or the end follows, and the places before the other blanks.
_UNEVEN, _LONE = re.compile(r" (?:\s|$)"), re.compile(r"(?= \S)")


def tokenizer_path(name: str) -> str:
    """A tokenizer file's place: an existing path as it is, else by the installed collection of public tokenizers."""
    if os.path.exists(name):
        return name
    return importlib.import_module("public_tokenizers").path(name)


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for the letters from 256 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _cutting(spec: dict) -> tuple[str, str]:
    """Where texts may be cut ('before' a lone blank, 'at' any blank or line end, or 'never') and the pre-tokens' pattern."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "before", BYTE_LEVEL
    if pre.get("type") == "Sequence" and [p.get("type") for p in pre["pretokenizers"]] == ["Split", "ByteLevel"]:
        split, level = pre["pretokenizers"]
        steps = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        pattern = split["pattern"].get("Regex", " ")
        if split.get("invert") and split.get("behavior") == "Removed" and not any(ch in pattern for ch in " \n") and not level.get("use_regex") and not level.get("add_prefix_space") and steps == ["NFC", "Replace", "Lowercase"]:
            return "at", pattern
    return "never", ""


@lru_cache(4)
def encoder(name: str, end: int | None = None, cache: int = CACHE) -> PieceEncoder:
    """This process's encoder: what it remembers serves every task of a worker."""
    gc.set_threshold(100_000, 50, 50)  # hardly any of the many small objects is in a cycle
    return PieceEncoder(name, end, cache)


class PieceEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned integers of self.width bytes; end is appended where given.

    Strings of special tokens inside a text are encoded as the library does by default.
    """

    def __init__(self, name: str, end: int | None = None, cache: int = CACHE):
        self._cache = cache
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        with open(path, encoding="utf-8") as f:
            self._cut, pattern = _cutting(json.load(f))
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._split = regex.compile(pattern).findall
        self._letters = byte_letters()
        self.width = 2 if self._tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self._end = b"" if end is None else np.array([end], self.dtype).tobytes()
        self._bytes = [k.to_bytes(self.width, "little") for k in range(self._tokenizer.get_vocab_size(with_added_tokens=True))]
        # by piece; and by piece without the blank that it begins with
        self._late, self._after = _Remembered(self._encode, {}), _Remembered(self._spaced, {})
        self._tokens: dict[str, bytes] = {}

    def _token(self, token: str) -> bytes:
        got = self._tokens.get(token)
        if got is None:
            if len(self._tokens) >= self._cache // 2:
                self._tokens.clear()
            ids = self._model.tokenize(token.encode().decode("latin-1").translate(self._letters))
            got = self._tokens[token] = b"".join([self._bytes[t.id] for t in ids])
        return got

    def _encode(self, piece: str) -> bytes:
        if self._cut == "at":
            piece = piece.lower() if PLAIN.fullmatch(piece) else piece
        # a word with stops after it is its own pre-token, and so are the stops
        word = piece.rstrip(".,")
        core = word[1:] if word[:1] == " " else word
        if self._cut != "never" and core.isalpha() and core.isascii() and len(piece) <= 1000:
            return self._token(word) + self._token(piece[len(word) :]) if len(word) < len(piece) else self._token(word)
        if self._cut == "never" or len(piece) > 1000 or not PLAIN.fullmatch(piece):
            return np.array(self._tokenizer.encode(piece, add_special_tokens=False).ids, self.dtype).tobytes()
        return b"".join(map(self._token, self._split(piece)))

    def _spaced(self, piece: str) -> bytes:
        return self._encode(" " + piece)

    def _pieces(self, text: str) -> bytes:
        """Ids of a text that may be cut before a blank: of its head, and of what follows each blank."""
        if _UNEVEN.search(text):
            return b"".join(map(self._late.__getitem__, _LONE.split(text)))
        head, *rest = text.split(" ")
        return self._late[head] + b"".join(map(self._after.__getitem__, rest))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self._late) + len(self._after) > self._cache:
            self._late, self._after = self._late.followed(), self._after.followed()
        end = self._end
        if self._cut == "before":
            return [self._pieces(t) + end for t in texts]
        get = self._late.__getitem__
        if self._cut == "at":
            return [b"".join(map(get, t.replace("\n", " ").split(" "))) + end for t in texts]
        return [self._encode(t) + end for t in texts]


class _Remembered(dict):
    """Encoded pieces; one that is missing is taken from those before or encoded."""

    def __init__(self, encode: Callable[[str], bytes], before: dict[str, bytes]):
        super().__init__()
        self._encode, self._before = encode, before

    def followed(self) -> _Remembered:
        """An empty one before which this one was; what was before this one is forgotten."""
        self._before = {}
        return _Remembered(self._encode, self)

    def __missing__(self, piece: str) -> bytes:
        got = dict.get(self._before, piece)
        if got is None:
            got = self._encode(piece)
        if len(piece) <= 64:  # long ones hardly come again
            self[piece] = got
        return got
