"""Tokenizer front end that encodes each distinct white-space-delimited chunk once a worker.

Pre-tokenizers of both vocabularies used here never join text across a single space or a lone
newline, so a text is the concatenation of its chunks' ids. Texts with other white-space runs,
with the chunk mark itself or with a special token of the vocabulary are encoded whole by the library, called
as it is, with add_special_tokens=False. ``tests/llm`` compares both ways.
"""

from __future__ import annotations

import itertools
import os
import re
from array import array
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa

#: Entries kept between batches in one Python worker; later words are encoded batch by batch.
CACHE_WORDS = 1_000_000
_MARK = "\x01"
#: Signs that can form a pre-token of their own after a word of letters.
_TAIL = ".,;:!?|&$%#*"
_DECODERS: dict[str, ByteDecoder] = {}
_LOADED: dict[tuple[str, bool], ChunkEncoder] = {}


class ChunkEncoder:
    def __init__(self, path: str, plain: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = plain
        special = [] if plain else [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")
        self.vocab = self.lib.get_vocab_size()
        self.type = "H" if self.vocab <= 0x10000 else "I"
        self.dtype = np.dtype("<u2" if self.type == "H" else "<u4")
        self.spaced = self._ids(" a") != self._ids("a")  # does a leading space change ids?
        self.lowers = not self.spaced and self._ids("A") == self._ids("a")
        self.tails: dict[str, bytes] = {}
        self.closing: dict[str, bool] = {}
        self.cache: dict[str, bytes | None] = {"": None, " ": None}
        if self.spaced:
            self.cache["\n"] = self._bytes(self._ids("\n"))

    def _ids(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.type, ids).tobytes()

    def _closes(self, sign: str) -> bool:
        """Whether a word that ends with this sign ends before a closing one, by the library: its normalizer can end a letter with a
        mark, which joins what follows."""
        if sign not in self.closing:
            got, alone = self.lib.encode(sign + ".", add_special_tokens=False), self._ids(".")
            self.closing[sign] = got.ids[-len(alone) :] == alone and got.word_ids.count(got.word_ids[-1]) == len(alone) < len(got.ids)
        return self.closing[sign]

    def _lower(self, text: str) -> str:
        """A text in lower case where the library would make the same of it, so that words in capitals are no words of their own: it
        composes first and then lowers sign by sign, which a final sigma or a composition in lower case alone would show."""
        low = text.lower()
        if text.isascii() or ("Σ" not in text and is_normalized("NFC", text) and is_normalized("NFC", low)):
            return low
        return text

    def _chunks(self, text: str) -> list[str]:
        if _MARK in text or self.special.search(text):
            return [""]
        if self.spaced:
            return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split(_MARK)
        return text.replace("\n", " ").split(" ")

    def _learn(self, chunks: set[str]) -> None:
        """Add ids of new chunks: words in joined calls, closing punctuation apart where the library parts it."""
        lead = 1 if self.spaced else 0
        tails: list[tuple[str, str, str]] = []
        words: dict[str, None] = {}
        odd = []
        for c in chunks:
            w = c.rstrip(_TAIL)
            body = w[1:] if lead and w[:1] == " " else "" if lead else w
            if body.isalpha() and (len(w) == len(c) or self._closes(w[-1])):
                words[w] = None
                if len(w) < len(c):
                    tails.append((c, w, c[len(w) :]))
            else:
                odd.append(c)
        new = list(words.keys() - self.cache.keys())
        for at in range(0, len(new), 4000):
            some = new[at : at + 4000]
            got = self.lib.encode("".join(some) if lead else " ".join(some), add_special_tokens=False)
            of = np.array(got.word_ids, np.int64)
            ids = np.array(got.ids, self.dtype).tobytes()
            cuts = [0, *((np.flatnonzero(np.diff(of)) + 1) * self.dtype.itemsize).tolist(), len(ids)]
            if len(cuts) == len(some) + 1:
                self.cache.update((c, ids[x:y]) for c, x, y in zip(some, cuts, cuts[1:], strict=False))
            else:
                self.cache.update((c, self._bytes(self._ids(c))) for c in some)
        for tail in {t for _, _, t in tails}:
            self.tails.setdefault(tail, self._bytes(self._ids(tail)))
        self.cache.update((c, self.cache[w] + self.tails[t]) for c, w, t in tails)
        plain = [c for c in odd if len(c.split()) == 1 and c == " " * (c[0] == " ") + c.strip()]
        self.cache.update(dict.fromkeys(set(odd).difference(plain)))  # irregular: None
        for c, got in zip(plain, self.lib.encode_batch(plain, add_special_tokens=False), strict=True):
            self.cache[c] = self._bytes(got.ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, as unsigned little-endian arrays."""
        parts = [self._chunks(self._lower(t) if self.lowers else t) for t in texts]
        new = set().union(*parts).difference(self.cache)
        before = len(self.cache)
        if new:
            self._learn(new)
        out, get = [], self.cache.get
        for t, chunks in zip(texts, parts, strict=True):
            try:
                out.append(np.frombuffer(b"".join(map(get, chunks)), self.dtype))
            except TypeError:  # an irregular chunk
                out.append(np.asarray(self._ids(t), self.dtype))
        if len(self.cache) > CACHE_WORDS:
            for c in list(itertools.islice(reversed(self.cache), len(self.cache) - max(before, CACHE_WORDS))):
                del self.cache[c]
        return out


def encoder(path: str, plain: bool = False) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file; ``plain``: special tokens inside texts are text like any other."""
    if (path, plain) not in _LOADED:
        _LOADED[path, plain] = ChunkEncoder(path, plain)
    return _LOADED[path, plain]


def forget() -> None:
    """Let go of encoders and decoders: Spark hands a worker on to the next steps, where a million words would stay beside theirs."""
    if _LOADED or _DECODERS:
        _LOADED.clear()
        _DECODERS.clear()
        pa.default_memory_pool().release_unused()


class ByteDecoder:
    """Texts of ids of a byte-level vocabulary: every id stands for the same bytes wherever it is."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet: these stand for themselves
        others = [b for b in range(256) if b not in set(printable)]
        signs = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        special = {i: t.content.encode() for i, t in lib.get_added_tokens_decoder().items()}
        tokens = [lib.id_to_token(i) or "" for i in range(lib.get_vocab_size())]
        self.of = [special[i] if i in special else bytes(signs[c] for c in t) for i, t in enumerate(tokens)]

    def text(self, ids) -> str:
        return b"".join(map(self.of.__getitem__, ids)).decode()


def decoder(path: str) -> ByteDecoder:
    """The worker's decoder for a byte-level vocabulary file."""
    if path not in _DECODERS:
        _DECODERS[path] = ByteDecoder(path)
    return _DECODERS[path]
