"""Exact encoding by pieces, with a bounded worker cache.

A piece is a run of white space with the run of other characters after it (or
white space alone, at the end). Neither of the supported pre-tokenizers makes a
token of characters of two pieces, and their normalizers act within a piece, so
a text's ids are those of its pieces, end to end. Special strings hold no white
space and so lie within a piece as well.

White space here is what Python and the tokenizers' patterns both hold for it:
U+001C to U+001F, which only Python counts, are ordinary characters.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

LONGEST = 64  # characters of a piece that is kept in the cache
PIECE = re.compile("[^\\S\x1c-\x1f]*[\\S\x1c-\x1f]+|[^\\S\x1c-\x1f]+")
ODD = re.compile("[\x1c-\x1f]")
RARE = "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # white space but blank and line end
WORD = re.compile("[\\S\x1c-\x1f]+")
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?")  # letters that normalizers leave single letters

_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, without truncation and padding, once per worker."""
    if path not in _LOADED:
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]


def public_path(name: str) -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def id_type(path: str) -> np.dtype:
    """Two bytes an id where the vocabulary allows it."""
    return np.dtype("<u2") if tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")


def drops_space(path: str) -> bool:
    """Whether white space only separates words, as with word-end vocabularies."""
    t = tokenizer(path)
    return not t.encode(" \n ", add_special_tokens=False).ids and t.encode("a b", add_special_tokens=False).ids == t.encode("a", add_special_tokens=False).ids + t.encode("b", add_special_tokens=False).ids


class Cache:
    """Two generations of at most `limit` entries: what is used stays, the rest goes."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.young, self.old = {}, self.young
        self.young[key] = value


def _key(piece: str) -> str | tuple[str]:
    """The word alone for a blank and a word; a line end and a word stay; all else goes in a tuple."""
    if len(piece) > 1 and piece[0] in " \n" and not piece[1].isspace():
        return piece[1:] if piece[0] == " " else piece
    return (piece,)


class PieceEncoder:
    """Texts to the ids of their pieces, as bytes of the vocabulary's id type, or with `lengths` to their numbers of ids.

    fixed: pieces whose values are known beforehand. Pieces that are neither
    there nor in the cache go to the tokenizers library, many in one text where
    its ids can be told apart afterwards: by the bytes that each token stands for
    in byte-level vocabularies, by word ends for plain Latin words in the others.
    """

    def __init__(self, path: str, lengths: bool = False, limit: int = 200_000, fixed: dict | None = None):
        self.path, self.lengths, self.fixed = path, lengths, fixed or {}
        self.kind, self.words = id_type(path), drops_space(path)
        self.cache = Cache(limit)
        t = tokenizer(path)
        names = t.get_vocab(with_added_tokens=True)
        added = {x.content for x in t.get_added_tokens_decoder().values()}
        self.weight = np.zeros(max(names.values()) + 1, dtype=np.int64)
        for name, i in names.items():
            self.weight[i] = name.endswith("</w>") if self.words else len(name.encode() if name in added else name)

        self.stops = dict(zip(".,", self.encoded([".", ","]), strict=True))

    def split(self, text: str) -> list[str]:
        """The pieces of a text."""
        if not self.words:
            return PIECE.findall(text)
        return WORD.findall(text) if ODD.search(text) else text.split()

    def keys(self, text: str) -> list:
        """What the pieces of a text are kept by: themselves, but a blank and a word by the word alone.

        Where a text has single blanks and line ends only, cutting before each is
        the same as the pattern, and much quicker.
        """
        if self.words:
            return self.split(text)
        if not text or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0].isspace() or text[-1].isspace() or any(c in text for c in RARE):
            return list(map(_key, PIECE.findall(text)))
        out: list = text.replace("\n", " \n").split(" ")
        out[0] = (out[0],)
        return out

    def _piece(self, key) -> str:
        if self.words:
            return key
        return key[0] if type(key) is tuple else key if key[0] == "\n" else " " + key

    def _value(self, ids: np.ndarray):
        return len(ids) if self.lengths else ids.tobytes()

    def _weights(self, pieces: list[str]) -> list[int]:
        """What the tokens of each piece weigh together; 0 where that is not certain."""
        if self.words:
            return [PLAIN.fullmatch(p) and 1 + (p[-1] in ".,") or 0 for p in pieces]
        return [len(p.encode()) if p[0] in " \n" and not p.isspace() else 0 for p in pieces]

    def encoded(self, pieces: list[str]) -> list:
        """Values of pieces by the library."""
        t, out = tokenizer(self.path), [None] * len(pieces)
        weights = self._weights(pieces)
        together = [i for i, w in enumerate(weights) if w]
        alone = [i for i, w in enumerate(weights) if not w]
        if together:
            joined = (" " if self.words else "").join([pieces[i] for i in together])
            ids = np.array(t.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=self.kind)
            run = np.cumsum(self.weight[ids])
            ends = np.searchsorted(run, np.cumsum([weights[i] for i in together])) + 1
            if ends[-1] != len(ids):
                raise AssertionError(f"ids of pieces can't be told apart: {joined[:200]!r}")
            at = 0
            for i, end in zip(together, ends.tolist(), strict=True):
                out[i] = self._value(ids[at:end])
                at = end
        if alone:
            for i, e in zip(alone, t.encode_batch_fast([pieces[i] for i in alone], add_special_tokens=False), strict=True):
                out[i] = self._value(np.array(e.ids, dtype=self.kind))
        return out

    def _fill(self, new: dict) -> None:
        """Values for the keys that have none: a plain word with a stop has the word's ids and then the stop's."""
        miss = {p: None for p, x in new.items() if x is None}
        stopped = [p for p in miss if type(p) is str and p[-1] in ".," and PLAIN.fullmatch(p)]
        stems = {}
        for p in stopped:
            del miss[p]
            stem = p[:-1]
            for held in (self.cache.young, self.cache.old, new, self.fixed):
                if (x := held.get(stem)) is not None:
                    stems[stem] = x
                    break
            else:
                miss[stem] = None
        if miss:
            for p, x in zip(miss, self.encoded(list(map(self._piece, miss))), strict=True):
                miss[p] = x
                if len(p if type(p) is str else p[0]) <= LONGEST:
                    self.cache.put(p, x)
                if p in new:
                    new[p] = x
        for p in stopped:
            x = stems.get(p[:-1])
            new[p] = x = (miss[p[:-1]] if x is None else x) + self.stops[p[-1]]
            if len(p) <= LONGEST:
                self.cache.put(p, x)

    def records(self, text: str) -> list:
        """The value of each piece of a text."""
        return self._values(self.keys(text))

    def values(self, pieces: list[str]) -> list:
        """The value of each of some pieces."""
        return self._values(pieces if self.words else list(map(_key, pieces)))

    def _values(self, pieces: list) -> list:
        """Values by key."""
        known = self.cache.young.get
        out = list(map(self.fixed.get if self.fixed else known, pieces))
        if None in out:
            gaps = [i for i, x in enumerate(out) if x is None]
            if self.fixed:
                for i in gaps:
                    out[i] = known(pieces[i])
                gaps = [i for i in gaps if out[i] is None]
            new = dict.fromkeys([pieces[i] for i in gaps])
            old = self.cache.old.get
            for p in new:
                if (x := old(p)) is not None:
                    new[p] = x
                    self.cache.put(p, x)
            self._fill(new)
            for i in gaps:
                out[i] = new[pieces[i]]
        return out


_ENCODERS: dict[tuple, PieceEncoder] = {}


def worker_encoder(key: tuple, build: Callable[[], PieceEncoder]) -> PieceEncoder:
    """One encoder per worker process and key; it lives on between tasks."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = build()
    return _ENCODERS[key]
