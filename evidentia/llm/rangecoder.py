"""Token-ID files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A file's records hold whole documents; a record's ids are cut into blocks of BLOCK ids. Within a block
nothing is known at first. An id goes by its rank of first appearance in the block; the new ids
themselves, places in the record's alphabet, stand in that order ahead of the coded words, in as many bits
as the alphabet takes. Each id begins with one decision: it is the id that last followed the two
ids before it (order 2), the one that last followed the id before it (order 1), one that the block has
not had, or one that it has had. The decision is coded under a mixture of three adaptive distributions,
one for the block (order 0) and one for each prediction, chosen by how well that prediction did of
late; the mixture's weights follow whichever predicts best. An id that the block has had goes on by the
size class of its rank (order 0, adaptive) and the rank's lower bits. Distributions and weights learn
from all ids since the last time, at first after 8 ids, at last after LEARN; predictions learn from every id.
All arithmetic is on whole numbers, quotients being taken of numbers under 2 ** 53, so any machine
decodes what another wrote.

Blocks are lanes: numpy steps through all blocks of a group at once, so the interpreter's cost is
shared by up to LANES blocks. A distribution of four outcomes is one whole number of cumulative
frequencies in fields of 12 bits. The coder keeps 48 bits of low; carries are added to the words before
them at the end. Every block carries its number of ids, its coded size and the crc32 of its ids, and can
be decoded alone.

Record layout (little-endian): magic ``EVTK``, version u8, documents u32, documents without an id u32
(they come first), blocks u32, alphabet u32; the alphabet's ids (u32 each, ascending); per document id
i64 and count u32; per block ids u32, words u32, crc32 u32; the blocks' 16-bit words. A block's words: the
number of its new ids, those (filled up to a multiple of 16 of them; most significant bit first), the
coder's words.

Null and empty texts have the end id alone. Documents without an id come first; documents of one id go
by a hash of their texts, then by the texts, and equal rows are written as often as they stand there.
Extra columns are ignored; an empty table gives no record.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.tokens import encoder

BLOCK = 2048
LANES = 4096
RECORD = 1 << 19  # ids after which a record is closed, at the end of a document
TOKENIZER = "word_bpe_49k.json"
MAGIC, VERSION = b"EVTK", 4

TABLE = 1 << 9  # contexts of either order that a block remembers
HIT2, HIT1, NEW, SEEN = range(4)
SIZES = 12  # size classes of ranks; one more stands for what is no rank
CLASS = np.array([x.bit_length() for x in range(BLOCK)], np.uint8)  # of a rank; its bits under the highest follow
REST = np.array([max(x - 1, 0) for x in range(SIZES)] + [0])
SPAN = 1 << REST
STATES = 18  # of both predictions: none, without credit, with credit; and whether they agree
LEARN = 192
LIMIT = 400  # a distribution's counts are halved beyond
FIELD, BITS, SIZE_BITS = 12, 11, 7  # of a cumulative frequency; of a decision's and of a size class's range
WEIGHT, SHARE = 512, 480  # sum of the weights, what is shared by merit


class _Model:
    """State of all lanes; the first ``n`` of them are at work."""

    def __init__(self, lanes: int, find: bool = False) -> None:
        lane = np.arange(lanes)
        self.pred = np.zeros(2 * lanes * TABLE, np.uint16)  # (rank + 1) << 1 | whether it was right the last time; 0: none
        self.base = np.stack([lane * TABLE, (lane + lanes) * TABLE])
        self.lane, self.lanes = lane, lanes
        self.rank1, self.rank2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.counts = [np.ones((*of, 4, lanes), np.int32) for of in ((1, 1, 1), (2, 3, 1), (2, 1, 3))]
        self.dist = [np.full(x.shape, 1024, np.int32) for x in self.counts]
        self.merit = np.full((3, lanes), SHARE // 3, np.int64)
        self.size_counts = np.ones((SIZES, lanes), np.int32)
        self.mixed = np.empty((2, 3, 3, lanes), np.int64)
        self.sizes = np.full((SIZES + 1, lanes), 1 << SIZE_BITS + 8, np.int64)  # of each class: its cumulative frequency, its frequency << 8
        self.class_of = np.full((lanes + 1) << SIZE_BITS, SIZES, np.uint8) if find else None
        self.steps, self.due, self.log, self.size_log = 0, 8, [], []
        self._mix(lanes)

    def look(self, n: int) -> np.ndarray:
        """Cumulative frequencies of the next decision."""
        one = self.rank1[:n]
        at = np.empty((2, n), np.int64)
        np.bitwise_and(one, TABLE - 1, out=at[0])
        np.multiply(one, 421, out=at[1])
        at[1] += self.rank2[:n]
        at[1] &= TABLE - 1
        at += self.base[:, :n]
        self.at = at
        self.p = p = self.pred.take(at)
        self.id = p >> 1  # 0 without a prediction
        self.known = p & 1
        know = np.minimum(p, 1)
        know += self.known
        joint = know[0] * np.uint16(3)
        joint += know[1]
        joint += (self.id[0] == self.id[1]) * np.uint16(9)
        self.where = joint * np.int64(self.lanes)
        self.where += self.lane[:n]
        return self.mixed.take(self.where)

    def learn(self, outcome: np.ndarray, ranks: np.ndarray, size: np.ndarray) -> None:
        """What came: outcomes, ranks, and the places of size classes in ``sizes``."""
        # a prediction that was right, or that takes the place of one without credit, or that loses its credit
        n = len(ranks)
        coded = ranks.astype(np.uint16)
        coded += np.uint16(1)
        right = self.id == coded
        coded <<= 1
        new = self.p
        new -= np.uint16(1)
        new -= coded
        new *= self.known
        new += coded
        new += right
        self.pred[self.at] = new
        self.rank2[:n] = self.rank1[:n]
        self.rank1[:n] = ranks
        outcome *= STATES * self.lanes
        outcome += self.where
        self.log.append(outcome)
        self.size_log.append(size)
        self.steps += 1
        if self.steps == self.due:
            self._count(n)
            self._mix(n)
            self.log, self.size_log = [], []
            self.due += min(self.due, LEARN)

    def _count(self, n: int) -> None:
        lanes = self.lanes
        found = np.bincount(np.concatenate(self.log), minlength=4 * STATES * lanes).astype(np.int32).reshape(4, 2, 3, 3, lanes)[..., :n]
        one, two = found.sum(axis=3, keepdims=True, dtype=np.int32), found.sum(axis=2, keepdims=True, dtype=np.int32)
        did = [x.transpose(1, 2, 3, 0, 4) for x in (one.sum(axis=(1, 2), keepdims=True, dtype=np.int32), one, two)]
        parts = np.stack([(x * d[..., :n]).sum(axis=(0, 1, 2, 3)) for x, d in zip(did, self.dist)]).astype(np.int64) + 1
        parts *= parts
        self.merit[:, :n] += (_quotient(parts * SHARE, parts.sum(axis=0)) - self.merit[:, :n]) >> 1
        for c, x in zip(self.counts, did):
            own = c[..., :n]
            own += x
            own >>= own.sum(axis=3, keepdims=True) > LIMIT
        self.size_counts[:, :n] += np.bincount(np.concatenate(self.size_log), minlength=(SIZES + 1) * lanes).reshape(SIZES + 1, lanes)[:SIZES, :n].astype(np.int32)

    def _mix(self, n: int) -> None:
        weight = (self.merit[:, :n] + (WEIGHT - SHARE) // 4).astype(np.int32)
        weight[0] = WEIGHT - weight[1] - weight[2]
        parts = []
        for c, d, w in zip(self.counts, self.dist, weight):
            own = c[..., :n]
            d[..., :n] = np.floor((own * 4096.0) / own.sum(axis=3, keepdims=True))
            parts.append(np.cumsum(d[:, :, :, :3, :n] * w, axis=3, dtype=np.int32))
        packed = self.mixed[..., :n]
        packed[:] = 3 | 1 << BITS + FIELD
        for k in (2, 1, 0):
            cum = parts[1][:, :, :, k] + parts[0][:, :, :, k] + parts[2][:, :, :, k]
            cum >>= 10
            cum *= (1 << BITS) - 4
            cum >>= BITS
            packed += cum
            packed <<= FIELD
            if k:
                packed += k
        count = self.size_counts[:, :n]
        f = 1 + _quotient(count * float((1 << SIZE_BITS) - SIZES), count.sum(axis=0))
        f[f.argmax(axis=0), self.lane[:n]] += (1 << SIZE_BITS) - f.sum(axis=0)
        self.sizes[:SIZES, :n] = f.cumsum(axis=0) - f + (f << 8)
        if self.class_of is not None:
            self.class_of[: n << SIZE_BITS] = np.repeat(np.tile(np.arange(SIZES, dtype=np.uint8), n), f.T.reshape(-1))


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of whole numbers from 0 under 2 ** 53."""
    return np.floor(a / b).astype(np.int64)


def _ranks(ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id its rank of first appearance, and whether it is new; place has room for every id."""
    at = np.arange(len(ids))
    place[ids[::-1]] = at[::-1]  # the first place is written last
    first = place[ids]
    fresh = first == at
    return (fresh.cumsum() - 1)[first], fresh


# An id takes BITS for its decision and at most SIZE_BITS + 10 for a rank: from TOP bits of range at least, some remain.
TOP, WORD = 32, 16
_LEAST, _FULL = 1 << TOP, (1 << TOP + WORD) - 1
PACKED = 256  # blocks whose new ids are packed together


def _lengths(sizes: np.ndarray) -> list[int]:
    """Lanes at work at each step; sizes descend."""
    return (len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), "right")).tolist()


def _padded(n: int) -> int:
    return -(-n // 16) * 16


def _pack(new: list[np.ndarray], bits: int) -> list[bytes]:
    """Heads of blocks: the number of their new ids and those, 16 in as many words as an id has bits."""
    out = []
    for k in range(0, len(new), PACKED):
        part = new[k : k + PACKED]
        ends = np.cumsum([_padded(len(x)) for x in part]).tolist()
        flat = np.zeros(ends[-1], np.int64)
        for x, end in zip(part, ends):
            start = end - _padded(len(x))
            flat[start : start + len(x)] = x
        flat = np.ascontiguousarray(flat.reshape(-1, 16).T)
        words = np.zeros((bits + 2, flat.shape[1]), np.int64)
        for j in range(16):
            at, over = divmod(j * bits, 16)
            x = flat[j] << 48 - over - bits
            words[at] |= x >> 32
            words[at + 1] |= x >> 16 & 65535
            words[at + 2] |= x & 65535
        raw = words[:bits].T.astype("<u2").tobytes()
        out += [struct.pack("<H", len(x)) + raw[(end - _padded(len(x))) * bits // 8 : end * bits // 8] for x, end in zip(part, ends)]
    return out


def _unpack(coded: list[bytes], bits: int) -> list[tuple[np.ndarray, bytes]]:
    """New ids and the coder's words of each block."""
    out = []
    for k in range(0, len(coded), PACKED):
        part = coded[k : k + PACKED]
        n = [min(struct.unpack_from("<H", x)[0], BLOCK) if len(x) > 1 else 0 for x in part]
        heads = [2 + _padded(m) * bits // 8 for m in n]
        raw = np.frombuffer(b"".join(x[2:end].ljust(end - 2, b"\0") for x, end in zip(part, heads)), "<u2").reshape(-1, bits).T
        words = np.zeros((bits + 2, raw.shape[1]), np.int64)
        words[:bits] = raw
        flat = np.empty((raw.shape[1], 16), np.int64)
        for j in range(16):
            at, over = divmod(j * bits, 16)
            flat[:, j] = (words[at] << 32 | words[at + 1] << 16 | words[at + 2]) >> 48 - over - bits & (1 << bits) - 1
        flat, at = flat.reshape(-1), 0
        for x, m, end in zip(part, n, heads):
            out.append((flat[at : at + m], x[end:]))
            at += _padded(m)
    return out


def encode_blocks(blocks: list[np.ndarray], alphabet: int) -> list[bytes]:
    """Coded words of each block of ids under ``alphabet``."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order])
    if not len(sizes) or not sizes[0]:
        return [b""] * len(blocks)
    lanes, steps, bits = len(order), int(sizes[0]), max(1, (alphabet - 1).bit_length())
    rank_of, kind_of = np.zeros((lanes, steps), np.int16), np.zeros((lanes, steps), np.uint8)
    new, place = [], np.empty(min(alphabet, 1 << 22), np.int64)
    for k, i in enumerate(order):
        own = blocks[i] if alphabet <= len(place) else np.unique(blocks[i], return_inverse=True)[1]
        rank, fresh = _ranks(own, place)
        rank_of[k, : sizes[k]], kind_of[k, : sizes[k]] = rank, SEEN - fresh
        new.append(blocks[i][fresh])
    heads = _pack(new, bits)
    rank_of, kind_of = np.ascontiguousarray(rank_of.T), np.ascontiguousarray(kind_of.T)
    model = _Model(lanes)
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, _FULL, np.int64)
    words, put = [], []  # a row for each step, and whether a lane puts out its word there

    def settle(n: int, short: np.ndarray) -> None:
        """Move words out of the lanes whose range is short: each lane by itself, so that a block is coded alike in any company."""
        lo, r = low[:n], rng[:n]
        word, mask = np.zeros(lanes, np.int32), np.zeros(lanes, bool)
        out = lo >> TOP
        word[:n], mask[:n] = out, short
        words.append(word)
        put.append(mask)
        out *= short
        out <<= TOP
        lo -= out
        move = short * np.int64(WORD)
        lo <<= move
        r <<= move

    for t, n in enumerate(_lengths(sizes)):
        rank = rank_of[t, :n].astype(np.int64)
        cum = model.look(n)
        hit = model.id == (rank + 1).astype(np.uint16)
        kind = kind_of[t, :n]
        kind *= ~hit[0]
        kind += hit[0]
        kind *= ~hit[1]  # HIT2 is 0, HIT1 is 1
        outcome = kind.astype(np.int64)
        size = CLASS.take(rank)
        size -= np.uint8(SIZES)
        size *= kind == SEEN
        size += np.uint8(SIZES)
        size = size.astype(np.int64)
        cum >>= outcome * FIELD
        a = cum & (1 << FIELD) - 1
        cum >>= FIELD
        cum &= (1 << FIELD) - 1
        cum -= a
        lo, r = low[:n], rng[:n]
        r >>= BITS
        a *= r
        lo += a
        r *= cum
        rest = REST.take(size)
        size *= lanes
        size += model.lane[:n]
        own = model.sizes.take(size)
        r >>= SIZE_BITS
        lo += (own & 255) * r
        own >>= 8
        r *= own
        r >>= rest
        rank_low = rank & (1 << rest) - 1
        rank_low *= r
        lo += rank_low
        short = r < _LEAST
        while short.any():
            settle(n, short)
            short = r < _LEAST
        model.learn(outcome, rank, size)
    for _ in range(3):
        settle(lanes, np.ones(lanes, bool))
    carry, rows = np.zeros(lanes, np.int32), np.empty((len(words), lanes), "<u2")
    for k in range(len(words) - 1, -1, -1):  # carries, from the last word to the first
        word = words[k]
        word += carry
        rows[k] = word
        word >>= WORD
        word -= carry
        word *= put[k]
        carry += word
    put = np.ascontiguousarray(np.array(put).T)
    ends = np.cumsum(put.sum(axis=1)).tolist()
    plain = np.ascontiguousarray(rows.T)[put].tobytes()
    out, start = [b""] * len(blocks), 0
    for i, head, end in zip(order, heads, ends):
        out[i] = head + plain[2 * start : 2 * end]
        start = end
    return out


def decode_blocks(coded: list[bytes], sizes: list[int], alphabet: int | list[int]) -> list[np.ndarray]:
    """Ids of each block; ``alphabet`` is one size or each block's."""
    order = sorted(range(len(coded)), key=lambda i: -sizes[i])
    size_of = np.array([sizes[i] for i in order])
    if not len(size_of) or not size_of[0]:
        return [np.empty(0, np.int32)] * len(coded)
    lanes, most = len(order), (np.broadcast_to(np.array(alphabet), len(coded))[order] - 1).tolist()
    parts: list = [None] * lanes
    width_of = [max(1, x.bit_length()) for x in most]
    for bits in sorted(set(width_of)):
        own = [k for k in range(lanes) if width_of[k] == bits]
        for k, x in zip(own, _unpack([coded[order[k]] for k in own], bits)):
            parts[k] = x
    width = max(3, max(len(x) // 2 for _, x in parts)) + 1
    words = np.zeros((lanes, width), np.uint16)
    for k, (_, x) in enumerate(parts):
        words[k, : len(x) // 2] = np.frombuffer(x[: len(x) // 2 * 2], "<u2")
    flat = np.ascontiguousarray(words.T).reshape(-1)
    start = words[:, :3].astype(np.float64)
    code = (start[:, 0] * 65536 + start[:, 1]) * 65536 + start[:, 2]  # whole numbers under 2 ** 48, as is the range
    model = _Model(lanes, find=True)
    lane = np.arange(lanes)
    rng, at = np.full(lanes, float(_FULL)), lane + 3 * lanes
    last = lane + (width - 1) * lanes
    no_class = lanes << SIZE_BITS
    own_class = (lane << SIZE_BITS) - no_class
    came = np.empty((4, lanes), np.int64)  # what each outcome would mean
    rank_of = np.zeros((int(size_of[0]), lanes), np.int16)
    known = np.zeros(lanes, np.int64)
    span = SPAN.astype(np.float64)
    for t, n in enumerate(_lengths(size_of)):
        cum = model.look(n)
        c, r = code[:n], rng[:n]
        r *= 1 / (1 << BITS)
        np.floor(r, out=r)
        place = (c / r).astype(np.int64)  # only a damaged block leaves a range; its checksum tells
        outcome = (place >= (cum >> FIELD & (1 << FIELD) - 1)).astype(np.int64)
        outcome += place >= (cum >> 2 * FIELD & (1 << FIELD) - 1)
        outcome += place >= (cum >> 3 * FIELD & (1 << FIELD) - 1)
        cum >>= outcome * FIELD
        a = cum & (1 << FIELD) - 1
        cum >>= FIELD
        cum &= (1 << FIELD) - 1
        cum -= a
        c -= a * r
        r *= cum
        seen = outcome == SEEN
        r *= 1 / (1 << SIZE_BITS)
        np.floor(r, out=r)
        place = (c / r).astype(np.int64)
        np.minimum(place, (1 << SIZE_BITS) - 1, out=place)
        np.maximum(place, 0, out=place)
        place += own_class[:n]
        place *= seen
        place += no_class
        size = model.class_of.take(place).astype(np.int64)
        reach = span.take(size)
        rank = reach - (size == 0)
        size *= lanes
        size += model.lane[:n]
        own = model.sizes.take(size)
        c -= (own & 255) * r
        own >>= 8
        r *= own
        r /= reach
        np.floor(r, out=r)
        np.maximum(r, 1, out=r)
        below = np.floor(c / r)
        reach -= 1
        np.minimum(below, reach, out=below)
        np.maximum(below, 0, out=below)
        rank += below
        below *= r
        c -= below
        came[HIT2, :n], came[HIT1, :n], came[NEW, :n], came[SEEN, :n] = model.id[1], model.id[0], known[:n], rank
        found = outcome * lanes
        found += lane[:n]
        found = came.take(found)
        found -= outcome < NEW
        np.maximum(found, 0, out=found)
        known[:n] += outcome == NEW
        rank_of[t, :n] = found
        short = r < _LEAST
        while short.any():
            word = flat.take(at[:n]) * short
            move = short * 65535.0
            move += 1
            r *= move
            c *= move
            c += word
            at[:n] += short * lanes
            np.minimum(at[:n], last[:n], out=at[:n])
            short = r < _LEAST
        model.learn(outcome, found, size)
    out: list = [None] * len(coded)
    rank_of = np.ascontiguousarray(rank_of.T)
    for k, i in enumerate(order):
        new = np.minimum(parts[k][0], most[k]) if len(parts[k][0]) else np.zeros(1, np.int64)
        out[i] = new.take(rank_of[k, : size_of[k]], mode="clip").astype(np.int32)
    return out


def _parts(items: list) -> list[list]:
    """About LANES items each, evenly."""
    n = max(1, round(len(items) / LANES))
    size = max(1, -(-len(items) // n))
    return [items[i : i + size] for i in range(0, len(items), size)]


def _alphabet(plain: list[np.ndarray]) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """The ids that occur, ascending, and what gives an id's place among them."""
    most = max((int(p.max()) for p in plain if len(p)), default=0)
    if most >= 1 << 22:
        known = np.unique(np.concatenate([np.unique(p) for p in plain]))
        return known, lambda p: np.searchsorted(known, p)
    occurs = np.zeros(most + 1, bool)
    for p in plain:
        occurs[p] = True
    return np.flatnonzero(occurs).astype("<u4"), (np.cumsum(occurs, dtype=np.int32) - 1).take


def write_records(records: list[tuple[list[int | None], list[bytes]]]) -> list[bytes]:
    """Records (document ids, those without first; their little-endian u32 ids) as bytes; all blocks are coded together."""
    plain = [np.frombuffer(b"".join(parts), "<u4") for _, parts in records]
    known, place = _alphabet(plain)
    blocks, at = [], []
    for p in plain:
        dense = place(p).astype(np.int32)
        at.append((len(blocks), len(blocks) + -(-len(p) // BLOCK)))
        blocks += [dense[i : i + BLOCK] for i in range(0, len(p), BLOCK)]
    coded = []
    for part in _parts(blocks):
        coded += encode_blocks(part, len(known))
    out = []
    for (docs, parts), p, (lo, hi) in zip(records, plain, at):
        head = MAGIC + struct.pack("<BIIII", VERSION, len(docs), docs.count(None), hi - lo, len(known))
        head += known.astype("<u4").tobytes() + b"".join(struct.pack("<qI", d or 0, len(x) // 4) for d, x in zip(docs, parts))
        head += b"".join(struct.pack("<III", len(blocks[k]), len(coded[k]) // 2, zlib.crc32(p[(k - lo) * BLOCK : (k - lo + 1) * BLOCK].tobytes())) for k in range(lo, hi))
        out.append(head + b"".join(coded[lo:hi]))
    return out


def read_records(records: list[bytes]) -> list[tuple[list[int | None], list[bytes]]]:
    """The inverse; raises ValueError where a checksum or the layout is wrong."""
    parsed = []
    for r in records:
        if r[:4] != MAGIC or r[4] != VERSION:
            raise ValueError("not a record of this format")
        n_docs, n_none, n_blocks, n_known = struct.unpack_from("<IIII", r, 5)
        at = 21
        known = np.frombuffer(r, "<u4", n_known, at)
        at += 4 * n_known
        docs = np.frombuffer(r, np.dtype([("id", "<i8"), ("n", "<u4")]), n_docs, at)
        at += 12 * n_docs
        blocks = np.frombuffer(r, np.dtype([("n", "<u4"), ("words", "<u4"), ("crc", "<u4")]), n_blocks, at)
        at += 12 * n_blocks
        ends = at + np.cumsum(blocks["words"].astype(np.int64) * 2)
        coded = [r[e - 2 * w : e] for e, w in zip(ends.tolist(), blocks["words"].tolist())]
        parsed.append((known, docs, blocks, coded, n_none))
    dense: list = []
    todo = [(k, c, int(n), len(p[0])) for k, p in enumerate(parsed) for c, n in zip(p[3], p[2]["n"])]
    for part in _parts(todo):
        dense += zip([x[0] for x in part], decode_blocks([x[1] for x in part], [x[2] for x in part], [x[3] for x in part]))
    by: list[list] = [[] for _ in parsed]
    for k, ids in dense:
        by[k].append(parsed[k][0][ids])
    out = []
    for k, (_, docs, blocks, _, n_none) in enumerate(parsed):
        ids = by[k]
        for x, crc in zip(ids, blocks["crc"].tolist()):
            if zlib.crc32(x.tobytes()) != crc:
                raise ValueError("a block's checksum is wrong")
        flat = b"".join(x.tobytes() for x in ids)
        ends = np.cumsum(docs["n"].astype(np.int64)) * 4
        out.append(([None] * n_none + docs["id"].tolist()[n_none:], [flat[e - 4 * n : e] for e, n in zip(ends.tolist(), docs["n"].tolist())]))
    return out


GROUP = 16  # records coded together: LANES blocks or a few more
TOGETHER = 1 << 22  # bytes of texts that are tokenized together, or one longer text


def _cuts(texts: pa.Array) -> list[tuple[int, int]]:
    """Bounds of runs of rows with about TOGETHER bytes of text."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = np.flatnonzero(np.diff(ends // TOGETHER, prepend=-1)).tolist()
    return list(zip(first, [*first[1:], len(texts)]))


def encode_column(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER, end_id: int = 1) -> DataFrame:
    """(part, seq, first_id, n_ids, record): records in ascending order of id within and across parts.

    Rows of docs are dealt by ranges of the id and a hash of the text, so that rows of one id can be dealt
    out too, and sorted; rows without an id come first. There are as many parts as the table has input
    partitions, at least the session's shuffle partitions.
    """
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    own = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    own = own.repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, part = encoder(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        seq, held, ids, size = 0, [], ([], []), 0

        def out() -> pa.RecordBatch:
            nonlocal seq, held
            n_ids = [sum(map(len, p)) // 4 for _, p in held]
            b = pa.RecordBatch.from_arrays([pa.array([part] * len(held), pa.int32()), pa.array(range(seq, seq + len(held)), pa.int32()), pa.array([d[0] for d, _ in held], pa.int64()), pa.array(n_ids, pa.int64()), pa.array(write_records(held), pa.binary())], ["part", "seq", "first_id", "n_ids", "record"])
            seq, held = seq + len(held), []
            return b

        for b in batches:
            for at, stop in _cuts(b.column(1)):
                keys = b.column(0)[at:stop].to_pylist()
                for doc, x in zip(keys, enc.encode(b.column(1)[at:stop].to_pylist())):
                    ids[0].append(doc)
                    ids[1].append(x + end)
                    size += len(x) // 4 + 1
                    if size >= RECORD:
                        held.append(ids)
                        ids, size = ([], []), 0
                        if len(held) >= GROUP:
                            yield out()
        if ids[0]:
            held.append(ids)
        if held:
            yield out()

    return own.mapInArrow(run, "part int, seq int, first_id long, n_ids long, record binary")


def decode_column(records: DataFrame) -> DataFrame:
    """(part, seq, pos, doc_id, before, ids): documents of each record; before counts the record's ids ahead of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, GROUP):
                part, seq = (b.column(i)[at : at + GROUP].to_pylist() for i in (0, 1))
                for p, s, (docs, ids) in zip(part, seq, read_records(b.column(4)[at : at + GROUP].to_pylist())):
                    n = np.array([len(x) // 4 for x in ids], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(docs), pa.int32()), pa.array([s] * len(docs), pa.int32()), pa.array(range(len(docs)), pa.int32()), pa.array(docs, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(ids, pa.binary())], ["part", "seq", "pos", "doc_id", "before", "ids"])

    return records.select("part", "seq", "first_id", "n_ids", "record").mapInArrow(run, "part int, seq int, pos int, doc_id long, before long, ids binary")


def starts(records: DataFrame) -> DataFrame:
    """(part, seq, ahead): ids ahead of each record in the whole file. One row per record, of half a million ids or more but for each part's last."""
    from pyspark.sql import Window

    totals = records.groupBy("part").agg(F.sum("n_ids").alias("n"))
    by_part = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("of_part"))  # one row per part
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return records.select("part", "seq", inside.alias("inside")).join(F.broadcast(by_part), "part").select("part", "seq", (F.col("inside") + F.col("of_part")).alias("ahead"))


def digest(records: DataFrame) -> DataFrame:
    """The contract's columns from written records."""
    docs = decode_column(records).select("part", "seq", "doc_id", "before", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return docs.join(starts(records), ["part", "seq"]).select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
