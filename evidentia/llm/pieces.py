"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

A text is marked (a leading space, spaces as part of what follows) and cut where no piece can reach
across: before spaces that follow other text, and around line ends. The distinct marked words of a
batch are sorted, so that they form a trie read depth-first: the forward scores and back pointers of the
prefix that a word shares with the one before it are kept, and only the rest is worked out. A prefix's
forward score is the best, over the pieces that may end it, of the score before the piece plus the
piece's own; ties go to the longer piece. A unigram model lets every piece follow every other. A byte-pair
model's ids are those that its merges produce, so there a step also costs infinitely much where merging
the two pieces together would not give them back, and a piece that its own merges don't reach costs as
much; one predecessor alone then has a finite score at each position, so the search for it stops there.
Either way the ids are the library's own. Characters that no piece has fall back to their bytes, at the
library's penalty below the least score. A model without bytes, or one that prepares texts otherwise
than by a leading space, is refused.

Decoding joins the pieces' bytes and takes the leading space off. U+2581 in a text is the model's own
sign for a space and comes back as one; everything else is returned as it was. Null and empty texts have no
ids and decode to an empty text; repeated rows are encoded alike; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
KEPT = 400_000  # words that a worker remembers,
KEPT_BYTES = 1 << 25  # and bytes of them
PAIRS = 1_000_000
_WORDS = re.compile(rb"\x20*[^\x20\n]+|\x20+|\n")
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
_LOADED: dict[str, Pieces] = {}


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if raw[at - 1] < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        if tag & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if tag & 7 == 2 else ((8, at) if tag & 7 == 1 else (4, at))
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def _unigram(model: bytes) -> bool:
    """Whether the model is a unigram one: field 3 (model_type) of field 2 (trainer_spec), 1 where absent; 2 is byte-pair."""
    kind = 1
    for number, value in _fields(model):
        if number == 2 and isinstance(value, bytes):
            kind = next((v for n, v in _fields(value) if n == 3), 1)
    if kind not in (1, 2):
        raise ValueError("only unigram and byte-pair models")
    return kind == 1


class Pieces:
    def __init__(self, name: str) -> None:
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=name if os.path.sep in name else public_tokenizers.path(name))
        self.unigram = _unigram(sp.serialized_model_proto())
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes = [0] * 256
        self.raw: list[bytes] = []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                piece = piece.replace("▁", " ")
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
                self.raw.append(piece.encode())
        if any(" " in p.lstrip(" ") or "\n" in p for p in self.ids):
            raise ValueError("pieces of this model reach across words")
        self.lengths = self._lengths()
        self.reached: dict[str, bool] = {}
        self.floor = min(self.score.values()) - 10.0  # the library's penalty for an unknown character
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0
        probes = ["", "a", "  a  b ", "ﬁ Å\t\n", "\n\n", "\x01"]
        if not any(self.bytes) or self.encode(probes) != [struct.pack(f"<{len(x)}I", *x) for x in sp.encode(probes)]:
            raise ValueError("this model prepares texts in another way")

    def _lengths(self) -> dict[str, tuple[int, ...]]:
        """Lengths, from the longest on, that a piece may have whose last three characters are the key; any other end has no piece longer than two."""
        found: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                found.setdefault(p[-3:], {1, 2}).add(len(p))
        return {k: tuple(sorted(v, reverse=True)) for k, v in found.items()}

    def merged(self, text: str) -> list[str]:
        """Symbols after all merges: the best-scoring adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, left: str, right: str) -> bool:
        key = left, right
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self.merged(left + right) == [left, right]
        return ok

    def words(self, distinct: list[str]) -> Iterator[list[str]]:
        """Pieces of each word; the words must be sorted."""
        score, follows, unigram, whole = self.score, self.follows, self.unigram, self.whole
        lengths, short, pairs, reached = self.lengths.get, (2, 1), self.pairs, self.reached
        last, forward, word = [""], [0.0], ""  # of the first i characters: the last piece, the best score
        for new in distinct:
            shared = 0
            for a, b in zip(word, new):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], forward[shared + 1 :]
            word = new
            for i in range(shared + 1, len(word) + 1):
                best, by = None, ""
                for n in lengths(word[i - 3 : i], short) if i > 2 else short:
                    j = i - n
                    if j < 0:
                        continue
                    piece = word[j:i]
                    own = score.get(piece)
                    if own is None:
                        if n > 1:
                            continue
                        own = self.floor
                    if not unigram:
                        if j:
                            ok = pairs.get((last[j], piece))
                            if not (follows(last[j], piece) if ok is None else ok):
                                continue
                        if n > 1:
                            ok = reached.get(piece)
                            if not (whole(piece) if ok is None else ok):
                                continue
                    total = float(np.float32(forward[j] + own)) if unigram else forward[j] + own  # the library adds in 32 bits
                    if best is None or total > best:
                        best, by = total, piece
                        if not unigram:
                            break
                if best is None:
                    raise AssertionError("no segmentation")
                last.append(by)
                forward.append(best)
            out, i = [], len(word)
            while i:
                out.append(last[i])
                i -= len(last[i])
            out.reverse()
            yield out

    def whole(self, piece: str) -> bool:
        """Whether merging a piece's characters gives the piece: some pieces can't be reached."""
        ok = self.reached.get(piece)
        if ok is None:
            ok = self.reached[piece] = self.merged(piece) == [piece]
        return ok

    def _pack(self, pieces: list[str]) -> bytes:
        out = list(map(self.ids.get, pieces))
        if None in out:
            out = [x for p, i in zip(pieces, out) for x in ([i] if i is not None else [self.bytes[b] for b in p.encode("utf-8", "replace")])]
        return _PACK[len(out)](*out) if len(out) < len(_PACK) else struct.pack(f"<{len(out)}I", *out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = [_WORDS.findall(b" " + t.replace("▁", " ").encode("utf-8", "replace")) if t else [] for t in texts]
        seen = set().union(*parts)
        if len(self.known) > KEPT or self.held > KEPT_BYTES:
            self.known, self.old, self.held = {}, self.known, 0
        known, old, new = self.known, self.old, []
        for w in seen:
            if w not in known:
                if w in old:
                    known[w] = old[w]
                else:
                    new.append(w.decode())
        new.sort()
        for w, pieces in zip(new, self.words(new)):
            known[w.encode()] = self._pack(pieces)
            self.held += len(w)
        return [b"".join(map(known.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def pieces(name: str = MODEL) -> Pieces:
    if name not in _LOADED:
        _LOADED[name] = Pieces(name)
    return _LOADED[name]


def encode_column(docs: DataFrame, text: str = "text", key: str = "doc_id", model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids = own.encode(b.column(1)[at : at + 256].to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + 256], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_column(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, text) of (doc_id, n_tokens, ids)."""
    crc = F.crc32("ids").alias("ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([own.decode(x) for x in part.column(3).to_pylist()], pa.string())], ["doc_id", "n_tokens", "ids_crc32", "text"])

    return encoded.select("doc_id", "n_tokens", crc, "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, text string")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_chars, decoded_sha256), the latter two from the decoded text."""
    found = decode_column(encode_column(docs))
    return found.select("doc_id", "n_tokens", "ids_crc32", F.length("text").cast("long").alias("decoded_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
