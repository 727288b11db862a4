"""Whole-text encoding with a public byte-level BPE vocabulary, one dictionary lookup per word.

The pre-tokenizer of a byte-level BPE never joins a visible character to the white
space after it, nor an ASCII or Latin-1 letter or digit to common punctuation after
it. Cutting there and encoding the parts alone therefore gives the ids of the whole
text. Each distinct part is encoded once a worker and then looked up. Texts with
white space beyond space, tab, line feed and carriage return, for which that cut
does not hold, are encoded whole. Special strings of the vocabulary inside a text get
their own id, as the tokenizer gives it; a text with them is cut there first.
"""

from __future__ import annotations

import array
import functools
import re

import numpy as np

from .common import WORKER_CACHES

_PART = re.compile(r"[ \n\t\r]*[A-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-\xff]+(?=[ \n\t\r,.!?;:$%*&#|]|\Z)|[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+\Z")
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
_LATIN = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_SPACES = frozenset(" \n\t\r")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """Texts to ids as little-endian bytes of ``dtype``; ``end`` follows each text."""

    #: Parts kept at most, unless told otherwise.
    CAPACITY = 400_000
    #: Longer parts are not kept.
    LONGEST = 64

    def __init__(self, path: str, dtype: str = "<u4", end: int = 0, capacity: int | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder().values()
        #: Special strings at which the tokenizer cuts texts; plain if it does so wherever they stand.
        self.special = re.compile("(" + "|".join(re.escape(t.content) for t in sorted(special, key=lambda t: -len(t.content))) + ")") if special else None
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in special)
        self.dtype = np.dtype(dtype)
        if self.tokenizer.get_vocab_size() - 1 > np.iinfo(self.dtype).max:
            raise ValueError(f"{self.dtype} cannot hold the ids of this vocabulary")
        self.end = np.array([end], self.dtype).tobytes()
        vocabulary = self.tokenizer.get_vocab()
        # bytes as the vocabulary writes them: printable ones as they are, the others from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.typecode = {2: "H", 4: "I"}.get(self.dtype.itemsize, "")
        #: A token is written with one character for each byte.
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)
        #: Parts kept, in two generations: when the younger is half of that, it takes the older one's place, so that
        #: parts in use stay and memory is bounded. Results do not depend on it.
        self.capacity = capacity or self.CAPACITY
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 512):
            out += [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts[i : i + 512], add_special_tokens=False)]
        return out

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that start with white space and end without: joined, encoded at once, and cut apart by byte lengths."""
        out: list[bytes] = []
        for i in range(0, len(parts), 4096):
            some = parts[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.int64)
            upto = np.cumsum(self.n_bytes[ids])
            ends = np.cumsum([len(p.encode()) for p in some])
            cuts = np.searchsorted(upto, ends) + 1
            if not len(upto) or cuts[-1] != len(ids) or (upto[cuts - 1] != ends).any():
                out += self._encode(some)
                continue
            data, at = ids.astype(self.dtype).tobytes(), 0
            for cut in (cuts * self.dtype.itemsize).tolist():
                out.append(data[at:cut])
                at = cut
        return out

    def _encode_words(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that are one space and letters: one pre-token each, so the model alone is asked."""
        tokenize, table, code, width = self.tokenizer.model.tokenize, self.letters, self.typecode, self.dtype.itemsize
        return [array.array(code, [t.id for t in tokenize(p.encode().decode("latin-1").translate(table))]).tobytes() for p in parts] if width in (2, 4) else self._encode_parts(parts)

    def _parts(self, text: str) -> list[str]:
        if _ODD_SPACE.search(text):
            return [text]
        if self.special is None or not self.special.search(text):
            return _PART.findall(text)
        if not self.plain:
            return [text]
        pieces = self.special.split(text)  # every second one is a special string
        return [p for i, piece in enumerate(pieces) for p in ([piece] if i % 2 else _PART.findall(piece))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        parts = [self._parts(t) if t else [""] for t in texts]
        if len(self.known) > self.capacity // 2:
            self.older, self.known = self.known, {}
        get = self.known.get
        found = [list(map(get, ps)) for ps in parts]
        gaps = [[i for i, v in enumerate(vs) if v is None] if None in vs else () for vs in found]
        missing = {ps[i] for ps, g in zip(parts, gaps, strict=True) for i in g}
        again = {p: self.older[p] for p in missing & self.older.keys()}
        missing = list(missing - again.keys())
        single = [p for p in missing if p[0:1] == " " and p[1:].isalpha() and _LATIN.fullmatch(p, 1)]
        fresh = again
        fresh.update(zip(single, self._encode_words(single), strict=True))
        others = [p for p in missing if p not in fresh]
        spaced = [p for p in others if p[0:1] in _SPACES and p[-1] not in " \n\t\r" and len(p) <= self.LONGEST]
        fresh.update(zip(spaced, self._encode_parts(spaced), strict=True))
        others = [p for p in others if p not in fresh]
        fresh.update(zip(others, self._encode(others), strict=True))
        for ps, vs, g in zip(parts, found, gaps, strict=True):
            for i in g:
                vs[i] = fresh[ps[i]]
        self.known.update((k, v) for k, v in fresh.items() if len(k) <= self.LONGEST)
        return [b"".join(vs) + self.end for vs in found]


@functools.cache
def encoder(path: str, dtype: str = "<u4", end: int = 0, capacity: int | None = None) -> Encoder:
    """One encoder for all tasks of a worker process, so that what one task has looked up serves the next."""
    return Encoder(path, dtype, end, capacity)


WORKER_CACHES["ids"] = encoder.cache_clear


def chunks(rows: list, sizes: list[int], most: int = 1_000_000):
    """Runs of ``rows`` whose sizes sum to about ``most``, so that a batch of long texts stays small."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield rows[start:i]
            start, total = i, 0
        total += n
    if start < len(rows):
        yield rows[start:]
