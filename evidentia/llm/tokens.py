"""Whole-text encoding with a public tokenizer, one lookup for each chunk of text.

A chunk never shares a token with its neighbours: the byte-level and the word-end tokenizers both cut
before white space that follows other text, and between a run of letters and an ASCII character that
is none (a combining mark, not being ASCII, stays with its letter). Chunks are encoded by the tokenizers library, once per
worker and chunk while it is remembered: two generations of a bounded memory, the older one dropped
when the younger is full.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT = 400_000  # chunks that a worker remembers,
KEPT_WORDS = 800_000  # or words, where white space is dropped,
KEPT_BYTES = 1 << 25  # and bytes of them
_LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++(?![\x80-\xff])"  # ASCII and Latin-1
_BYTE_CHUNKS = re.compile(rb"\x20?[A-Za-z]++(?![\x80-\xff])|[\x20\x09-\x0d]*" + _LETTERS + rb"|[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
_WORD_CHUNKS = re.compile(rb"[A-Za-z]++(?![\x80-\xff])|" + _LETTERS + rb"|[^\x20\x09-\x0d]+")
_ONE = re.compile(rb"\x20?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
_KINDS = bytes(1 if chr(b).isalpha() else 7 if b in b" \t\n\v\f\r" else 2 for b in range(128)) + bytes([7]) * 128  # letters, other ASCII, the rest
BATCH = 128  # texts that are encoded together
_LOADED: dict[str, Encoder] = {}


def _byte_alphabet() -> dict[int, str]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class _Known(dict):
    """Ids of what was looked up; a missing entry comes from the generation before or from the tokenizer."""

    def __init__(self, encoder: Encoder, old: dict[bytes, bytes]) -> None:
        self.encoder, self.old, self.held = encoder, old, 0

    def __missing__(self, part: bytes) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.encoder.fresh(part)
        self[part] = ids
        self.held += len(part)
        return ids


class Encoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = name if os.path.sep in name else public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        # white space is dropped by word-end tokenizers, and belongs to what follows it in byte-level ones
        self.chunks = (_WORD_CHUNKS if self._drops_space() else _BYTE_CHUNKS).findall
        self.alphabet = _byte_alphabet()
        probes = [b"word", b" Word", "é".encode(), " Größe".encode(), b"antidisestablishment", b" ing"]
        self.lower = self._drops_space()
        self.direct = all(self._by_model(p) == self.tokenizer.encode(p.decode(), add_special_tokens=False).ids for p in probes if not (self.lower and p[:1] == b" "))
        self.known = _Known(self, {})
        self.folds = self.lower and len({tuple(self.tokenizer.encode(t, add_special_tokens=False).ids) for t in ("word don't", "Word DON'T")}) == 1
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _drops_space(self) -> bool:
        ids = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("a b", "a  b\n", "a\tb")]
        return ids[0] == ids[1] == ids[2]

    def _by_model(self, chunk: bytes) -> list[int]:
        """Ids of a chunk that the tokenizer's preparation would leave whole: straight from its model."""
        if self.lower:
            chunk = chunk.decode().lower().encode()
        word = chunk.decode().replace(" ", self.alphabet[32]) if chunk.isascii() else chunk.decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.tokenize(word)]

    def _ids(self, chunk: bytes) -> list[int]:
        if self.direct:
            if chunk[:1] == b" " and chunk[1:].isalpha() and not self.lower:  # the most frequent kinds, all ASCII
                return [t.id for t in self.tokenize(self.alphabet[32] + chunk[1:].decode())]
            if self.lower and chunk.isalpha():
                return [t.id for t in self.tokenize(chunk.decode().lower())]
            if _ONE.fullmatch(chunk):
                return self._by_model(chunk)
        return self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids

    def fresh(self, part: bytes) -> bytes:
        """Ids of a chunk; where white space is dropped, of a word, which is cut into chunks."""
        if self.folds and part.isalpha():  # ASCII letters: one chunk
            low = part.lower()
            if low != part:
                return self.known[low]
        elif self.lower:
            chunks = self.chunks(part)
            if len(chunks) != 1 or chunks[0] != part:
                return b"".join(map(self.known.__getitem__, chunks))
        ids = self._ids(part)
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; where white space is dropped, whole words are remembered, and cut into chunks only when they are new."""
        if len(self.known) > (KEPT_WORDS if self.lower else KEPT) or self.known.held > KEPT_BYTES:
            self.known.old = {}
            self.known = _Known(self, self.known)
        look = self.known.__getitem__
        raw = ((t or "").encode("utf-8", "replace") for t in texts)
        if self.lower:
            return self._by_word(list(raw))
        return [b"".join(map(look, self.chunks(r))) for r in raw]


    def _by_word(self, raw: list[bytes]) -> list[bytes]:
        """Ids of each text from those of its words; each distinct word of the texts is looked up once.

        Letters are parted from a following ASCII character that is none, as chunks are, and ASCII is lower-cased
        unless a combining mark (U+0300 on) might make one character of a small letter only; added tokens stay whole.
        """
        flat, ends = b"\n".join([*raw, b""]), np.cumsum([0, *(len(r) + 1 for r in raw)])
        if not any(t in flat for t in self.added):
            if self.folds and b"\xcc" not in flat and b"\xcd" not in flat:
                flat = flat.lower()
            kind = np.frombuffer(flat.translate(_KINDS), np.uint8)
            at = np.flatnonzero(kind[:-1] * 2 == kind[1:]) + 1
            flat, ends = np.insert(np.frombuffer(flat, np.uint8), at, 32), ends + np.searchsorted(at, ends)
        words = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(raw), pa.py_buffer(ends), pa.py_buffer(flat)))
        found = words.values.dictionary_encode()
        ids = list(map(self.known.__getitem__, found.dictionary.view(pa.large_binary()).to_pylist()))
        n = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        pool, start, word = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(n) - n, found.indices.to_numpy()
        own = n.take(word)
        ends = np.concatenate([[0], np.cumsum(own)])
        at = np.repeat(start.take(word) - ends[:-1], own)
        at += np.arange(len(at))
        out, cut = pool.take(at).tobytes(), (4 * ends.take(words.offsets.to_numpy())).tolist()
        return [out[i:j] for i, j in zip(cut, cut[1:])]


def encoder(name: str) -> Encoder:
    if name not in _LOADED:
        _LOADED[name] = Encoder(name)
    return _LOADED[name]
