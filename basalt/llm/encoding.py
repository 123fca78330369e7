"""Vocabulary encoding with the tokenizers library: distinct pieces are encoded once per worker and looked up after that.

A text is cut into the pieces that the tokenizer's own pre-tokenizer would make; the merges never cross a piece, so the
ids of a text are its pieces' ids in order. Texts with characters outside a plainly listed range, where two regular
expression engines or two Unicode versions might disagree on letters, digits or white space, go to the library whole.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from itertools import chain, count, islice
from operator import itemgetter

import numpy as np

from .common import KEPT

# Letters, digits and white space up to U+017F, as the tokenizers' patterns class them.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
DIGITS = "0-9²³¹¼-¾"
SPACES = " \\t\\n\\x0b\\x0c\\r\\xa0"
#: A character outside this range sends its text to the library whole.
UNLISTED = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa0-įı-ňŊ-ž‐-‧‰-⁞€]")
#: The pieces of the byte-level vocabulary: public_tokenizers.PATTERN over the listed range.
BYTE_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{SPACES}{LETTERS}{DIGITS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: The pieces of the word vocabulary, which lower-cases first, drops white space and takes digits one by one.
WORD_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{SPACES}{LETTERS}{DIGITS}]+")


class PieceEncoder:
    """Ids of whole texts. pieces: how the tokenizer cuts a listed text; lower: whether it lower-cases first.

    Beyond `remember` distinct pieces the table starts anew with the half of them that came up most often. A null text has no ids.
    """

    def __init__(self, path: str, remember: int = 800_000, chars: int = 1_500_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            words = json.load(f).get("normalizer") is not None
        #: The same vocabulary for pieces: they are cut and lower-cased already, so only bytes are left to map.
        self.bare = Tokenizer.from_file(path)
        self.bare.encode_special_tokens = True
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bare.model._resize_cache(0)  # every piece comes once
        self.pieces, self.lower = (WORD_PIECES, True) if words else (BYTE_PIECES, False)
        self.remember, self.chars = remember, chars
        self.known = self.used = 0
        self.size = self.start = self.uses = self.pool = np.zeros(0, np.int32)
        self._forget()

    def _forget(self) -> None:
        """Start anew, with the pieces that came up again since the last time."""
        names = list(self.code) if self.known else []
        keep = np.flatnonzero(self.uses[: self.known] > 1) if self.known else np.zeros(0, np.int64)
        if len(keep) > self.remember // 2:
            keep = keep[np.argsort(-self.uses[keep], kind="stable")[: self.remember // 2]]
        sizes = self.size[keep].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        pool = self.pool[np.repeat(self.start[keep] - ends + sizes, sizes) + np.arange(total)]
        self.code: defaultdict[str, int] = defaultdict(count(len(keep)).__next__)
        self.code.update((names[k], i) for i, k in enumerate(keep.tolist()))
        room = 1 << max(12, len(keep).bit_length())
        self.size, self.start, self.uses = np.zeros(room, np.int32), np.zeros(room, np.int64), np.zeros(room, np.int32)
        self.size[: len(keep)], self.start[: len(keep)] = sizes, ends - sizes
        self.pool = np.concatenate((pool, np.zeros(1 << 14, np.int32)))
        self.known, self.used = len(keep), total

    def _learn(self) -> None:
        """Encode the pieces met for the first time, in one call."""
        fresh = list(islice(reversed(self.code), len(self.code) - self.known))[::-1]
        if not fresh:
            return
        got = self.bare.encode(fresh, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(got.ids, np.int32)
        sizes = np.bincount(np.array(got.word_ids, np.int64), minlength=len(fresh)).astype(np.int32)
        while self.known + len(fresh) > len(self.size):
            self.size, self.start, self.uses = (np.concatenate((x, np.zeros_like(x))) for x in (self.size, self.start, self.uses))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        at = slice(self.known, self.known + len(fresh))
        self.size[at] = sizes
        self.start[at] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + len(ids)] = ids
        self.known, self.used = at.stop, self.used + len(ids)

    def _listed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.code) > self.remember:
            self._forget()
        found = [self.pieces.findall(t.lower() if self.lower else t) for t in texts]
        n = np.fromiter(map(len, found), np.int64, len(found))
        looked = (itemgetter(*x)(self.code) if len(x) > 1 else (self.code[x[0]],) for x in found if x)
        codes = np.fromiter(chain.from_iterable(looked), np.int64, int(n.sum()))
        del found
        self._learn()
        self.uses += np.bincount(codes, minlength=len(self.uses)).astype(np.int32)
        sizes = self.size[codes].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.start[codes] - ends + sizes, sizes) + np.arange(total)]
        upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n)))]
        return ids, np.diff(upto)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array of ids a text."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        held: list[int] = []
        weight = 0

        def flush() -> None:
            nonlocal weight
            ids, sizes = self._listed([texts[i] for i in held])
            for i, part in zip(held, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                out[i] = part
            held.clear()
            weight = 0

        for i, t in enumerate(texts):
            if not t:
                continue
            if UNLISTED.search(t):
                out[i] = self._whole(t)
                continue
            held.append(i)
            weight += len(t)
            if weight >= self.chars:
                flush()
        if held:
            flush()
        return out


_encoders: dict[str, PieceEncoder] = {}
KEPT.append(_encoders)


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder of a vocabulary file, which must be at the same path on every machine."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
