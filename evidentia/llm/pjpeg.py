"""Progressive JPEG media columns.

``encode_payload`` stores bytes losslessly in a progressive JPEG (4:2:0): byte k of a 64-byte unit is
coefficient k of a block in zigzag order, as a value of size category 8. A DC scan, spectral bands
of AC coefficients at a point transform of one bit, and successive-approximation scans for the last
bit follow. ``decode`` reads progressive JPEGs: it accumulates all scans into coefficient arrays,
inverse-transforms in numpy (whole-number arithmetic, so results don't depend on the machine),
upsamples chroma and gives a full-resolution RGB tensor. ``payload_of`` reads the stored bytes back
from the coefficients.

Parts of a scan whose length is known ahead are decoded in bulk: bands whose Huffman table has a
single code, and the correction bits of end-of-band runs. Anything else goes symbol by symbol.

Null texts count as empty; an empty text has one unit of zeros. Equal texts give equal values. Rows
keep their ids, repeated or not; extra columns are ignored; a null or broken image gives null tensors.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64
WIDE = 32  # MCUs in a row, until the height would not fit
_MARK = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _zigzag() -> np.ndarray:
    """Natural index (row * 8 + column) of each zigzag position."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in order])


ZIGZAG = _zigzag()
SHIFT = 16


def _basis() -> np.ndarray:
    """(64 zigzag coefficients, 64 pixels) of the inverse transform, as whole numbers times 2**SHIFT."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.where(u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    return np.rint(np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[ZIGZAG] * 2**SHIFT)


BASIS = _basis()


# ---- writing ----


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(cls: int, slot: int, codes: dict[int, int]) -> bytes:
    """DHT of symbols with the given code lengths, in canonical order."""
    by = sorted(codes, key=lambda s: (codes[s], s))
    return _segment(0xC4, bytes([cls << 4 | slot]) + bytes(sum(codes[s] == n for s in by) for n in range(1, 17)) + bytes(by))


def _scan(parts: list[tuple[int, int, int]], ss: int, se: int, ah: int, al: int, bits: np.ndarray, packed: bool = False) -> bytes:
    """parts: (component, DC table, AC table); bits: 0 or 1 each, or whole bytes if packed."""
    head = bytes([len(parts)]) + b"".join(bytes([c, d << 4 | a]) for c, d, a in parts) + bytes([ss, se, ah << 4 | al])
    if not packed:
        if len(bits) % 8:
            bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
        bits = np.packbits(bits)
    return _segment(0xDA, head) + bits.tobytes().replace(b"\xff", b"\xff\x00")


def _fields(values: np.ndarray, widths: np.ndarray, most: int) -> np.ndarray:
    """Bits of values, most significant first, each in its own width."""
    at = np.arange(most)
    shift = widths[:, None] - 1 - at[None, :]
    return ((values[:, None] >> np.maximum(shift, 0)) & 1).astype(np.uint8)[shift >= 0]


_SIZE = np.array([x.bit_length() for x in range(512)])
DC_CODES = {s: 4 for s in range(9)}  # sizes 0 to 8, four bits each
FIRST_CODES = {7: 1}  # no run, seven bits: every coefficient of a payload
REFINE_CODES = {r << 4: 4 for r in range(15)}  # end-of-band runs of up to 32767 blocks


@lru_cache(maxsize=64)
def _mcu_blocks(my: int, mx: int, v: int, h: int) -> np.ndarray:
    """(MCU, v * h): a component's blocks (raster) in the order of the MCUs."""
    return np.arange(my * v * mx * h).reshape(my, v, mx, h).transpose(0, 2, 1, 3).reshape(my * mx, -1)


@lru_cache(maxsize=1)
def _payload_tables() -> bytes:
    return _table(0, 0, DC_CODES) + _table(1, 0, FIRST_CODES) + _table(1, 1, REFINE_CODES)


def encode_payload(payload: bytes, note: bytes = b"") -> bytes:
    """A progressive JPEG that holds payload, whose size must be a positive multiple of UNIT."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload's size must be a positive multiple of 64")
    n = len(payload) // UNIT
    mcus = -(-n // 6)
    cols = min(mcus, WIDE if mcus <= WIDE * 4000 else int(mcus**0.5) + 1)
    rows = -(-mcus // cols)
    m = rows * cols
    data = np.zeros((6 * m, UNIT), np.uint8)
    data[:n] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    planes = (data[: 4 * m], data[4 * m : 5 * m], data[5 * m :])
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload)) + note), _segment(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_payload_tables())
    # DC: value b if the byte's top bit is set, else b - 255; coded as differences after the point transform
    dc = [p[:, 0].astype(np.int64) for p in planes]
    dc = [np.where(d >= 128, d, d - 255) for d in dc]
    mixed = np.concatenate([dc[0][_mcu_blocks(rows, cols, 2, 2)], dc[1][:, None], dc[2][:, None]], axis=1)
    high = mixed >> 1
    diff = high.copy()
    diff[:, 1:4] -= high[:, :3]
    diff[1:, 0] -= high[:-1, 3]
    diff[1:, 4:] -= high[:-1, 4:]
    diff = diff.reshape(-1)
    size = _SIZE[np.abs(diff)]
    value = np.where(diff < 0, diff + (1 << size) - 1, diff)
    every = [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
    out.append(_scan(every, 0, 0, 0, 1, _fields(size << size | value, size + 4, 12)))
    # AC, first passes: one code bit (0) and seven value bits are together the byte's upper bits
    for c, lo, hi in ((0, 1, 5), (0, 6, 63), (1, 1, 63), (2, 1, 63)):
        out.append(_scan([(c + 1, 0, 0)], lo, hi, 0, 1, planes[c][:, lo : hi + 1] >> 1, packed=True))
    out.append(_scan(every, 0, 0, 1, 0, (mixed & 1).astype(np.uint8).reshape(-1)))
    for c in range(3):
        p = planes[c][:, 1:]
        last = (p ^ (p >> 7) ^ 1) & 1
        bits = []
        for at in range(0, len(last), 32767):
            part = last[at : at + 32767]
            r = len(part).bit_length() - 1
            bits += [_fields(np.array([r << r | (len(part) - (1 << r))]), np.array([4 + r]), 4 + r), part.reshape(-1)]
        out.append(_scan([(c + 1, 0, 1)], 1, 63, 1, 0, np.concatenate(bits)))
    return b"".join(out) + b"\xff\xd9"


# ---- reading ----


class _Huffman:
    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.symbol = np.zeros(1 << 16, np.int32)
        self.length = np.zeros(1 << 16, np.int32)  # 0: no such code
        code, at = 0, 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                a = code << (16 - n)
                self.symbol[a : a + (1 << (16 - n))] = symbols[at]
                self.length[a : a + (1 << (16 - n))] = n
                code, at = code + 1, at + 1
            code <<= 1
        self.only = (symbols[0], [n for n, c in enumerate(counts, 1) if c][0]) if len(symbols) == 1 else None
        self._lists = None

    def lists(self) -> tuple[list, list]:
        if self._lists is None:
            self._lists = self.symbol.tolist(), self.length.tolist()
        return self._lists


_HUFFMAN: dict[bytes, _Huffman] = {}


def _huffman(counts: bytes, symbols: bytes) -> _Huffman:
    key = counts + symbols
    if key not in _HUFFMAN:
        if len(_HUFFMAN) > 64:
            _HUFFMAN.clear()
        _HUFFMAN[key] = _Huffman(counts, symbols)
    return _HUFFMAN[key]


class _Bits:
    """Entropy-coded data between two restart markers."""

    def __init__(self, data: bytes) -> None:
        self.data = data.replace(b"\xff\x00", b"\xff")
        self.pos = 0
        self._array = None

    @property
    def array(self) -> np.ndarray:
        if self._array is None:
            self._array = np.unpackbits(np.frombuffer(self.data, np.uint8))
        return self._array

    def read(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.pos >> 3, (self.pos + n + 7) >> 3
        v = int.from_bytes(self.data[a:b].ljust(b - a, b"\0"), "big")
        v = (v >> ((b << 3) - self.pos - n)) & ((1 << n) - 1)
        self.pos += n
        return v

    def symbol(self, table: _Huffman) -> int:
        symbols, lengths = table.lists()
        a = self.pos >> 3
        w = (int.from_bytes(self.data[a : a + 3].ljust(3, b"\0"), "big") >> (8 - (self.pos & 7))) & 0xFFFF
        if not lengths[w]:
            raise ValueError("no such Huffman code")
        if self.pos > len(self.data) * 8:
            raise ValueError("the scan ends early")
        self.pos += lengths[w]
        return symbols[w]

    def bulk(self, n: int) -> np.ndarray:
        got = self.array[self.pos : self.pos + n]
        if len(got) < n:
            raise ValueError("the scan ends early")
        self.pos += n
        return got


def _extend(v: int, s: int) -> int:
    return v if not s or v >> (s - 1) else v - (1 << s) + 1


def _dc_first(bits: _Bits, plan: list[tuple[int, _Huffman, np.ndarray]], coef: list[np.ndarray], n_mcus: int, al: int) -> None:
    """plan: for each block of an MCU its component, table and the block's index per MCU."""
    last = [0] * len(coef)
    tables = [p[1].lists() for p in plan]
    found = [[] for _ in plan]
    big = bits.data + b"\0\0\0\0"
    pos, of = bits.pos, int.from_bytes
    steps = [(p[0], *t, f.append) for p, t, f in zip(plan, tables, found)]
    for _ in range(n_mcus):
        for c, symbols, lengths, put in steps:
            a = pos >> 3
            w = of(big[a : a + 5], "big") << (pos & 7)
            k = (w >> 24) & 0xFFFF
            n = lengths[k]
            if not n:
                raise ValueError("no such Huffman code")
            s = symbols[k]
            if s:
                v = (w >> (40 - n - s)) & ((1 << s) - 1)
                last[c] += v if v >> (s - 1) else v - (1 << s) + 1
            pos += n + s
            put(last[c])
    if pos > len(bits.data) * 8:
        raise ValueError("the scan ends early")
    bits.pos = pos
    for p, f in zip(plan, found):
        coef[p[0]][p[2], 0] = np.array(f, np.int32) << al


@lru_cache(maxsize=64)
def _values(s: int, al: int) -> np.ndarray:
    """Coefficients of the codes of one size."""
    v = np.arange(1 << s)
    return (np.where(v >> (s - 1), v, v - (1 << s) + 1) << al).astype(np.int16)


def _span(ids: np.ndarray) -> slice | np.ndarray:
    """ids, as a slice if they follow one another: the blocks of a whole number of MCUs do."""
    return slice(int(ids[0]), int(ids[-1]) + 1) if len(ids) and ids[-1] - ids[0] + 1 == len(ids) else ids


def _ac_first(bits: _Bits, table: _Huffman, block: np.ndarray, ids: np.ndarray, ss: int, se: int, al: int) -> None:
    width = se - ss + 1
    if table.only and table.only[0] >> 4 == 0 and table.only[0] & 15:
        s, n = table.only
        total = len(ids) * width
        if n + s == 8 and bits.pos % 8 == 0:
            v = np.frombuffer(bits.data, np.uint8, total, bits.pos // 8) & ((1 << s) - 1)
            bits.pos += 8 * total
        else:
            raw = bits.bulk(total * (n + s)).reshape(-1, n + s)[:, n:]
            v = raw.astype(np.int32) @ (1 << np.arange(s - 1, -1, -1)).astype(np.int32)
        v = _values(s, al)[v] if s < 12 else np.where(v >> (s - 1), v, v - (1 << s) + 1) << al
        block[_span(ids), ss : se + 1] = v.reshape(-1, width)
        return
    run = 0
    for i in ids.tolist():
        if run:
            run -= 1
            continue
        k = ss
        while k <= se:
            rs = bits.symbol(table)
            r, s = rs >> 4, rs & 15
            if s:
                k += r
                if k > se:
                    raise ValueError("a run leaves the band")
                block[i, k] = _extend(bits.read(s), s) * (1 << al)
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + bits.read(r) - 1
                break


def _ac_refine(bits: _Bits, table: _Huffman, block: np.ndarray, ids: np.ndarray, ss: int, se: int, al: int) -> None:
    one, at = 1 << al, 0

    def correct(rows: np.ndarray, lo: int) -> None:
        """One bit for each coefficient of these blocks, from lo on, that isn't zero yet."""
        if not len(rows):
            return
        rows = _span(rows)
        part = block[rows, lo : se + 1]
        there = part != 0
        if there.all():
            got = bits.bulk(part.size).reshape(part.shape).astype(np.int16)
            block[rows, lo : se + 1] = part + np.where(part > 0, got, -got) * one
            return
        got = bits.bulk(int(there.sum())).astype(np.int16)
        part[there] += np.where(part[there] > 0, got, -got) * one
        block[rows, lo : se + 1] = part

    while at < len(ids):
        i, k = ids[at], ss
        run = 0
        while k <= se:
            rs = bits.symbol(table)
            r, s = rs >> 4, rs & 15
            new = 0
            if s:
                new = one if bits.read(1) else -one
            elif r < 15:
                run = (1 << r) + bits.read(r)
                break
            while k <= se:
                v = block[i, k]
                if v:
                    if bits.read(1):
                        block[i, k] = v + (one if v > 0 else -one)
                elif r == 0:
                    if new:
                        block[i, k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
        if run:
            correct(ids[at : at + 1], k)
            correct(ids[at + 1 : at + run], ss)
            at += run
        else:
            at += 1


class Picture:
    """Coefficients (zigzag) and layout of a decoded file."""

    def __init__(self, height: int, width: int, parts: list[dict], quant: dict[int, np.ndarray], comment: bytes) -> None:
        self.height, self.width, self.parts, self.quant, self.comment = height, width, parts, quant, comment

    def rgb(self) -> np.ndarray:
        """(height, width, 3) bytes."""
        h_max, v_max = max(p["h"] for p in self.parts), max(p["v"] for p in self.parts)
        planes = []
        for p in self.parts:
            x = p["coef"].astype(np.float64) @ (BASIS * self.quant[p["q"]][:, None])
            x *= 2.0**-SHIFT
            x += 128.5
            np.floor(x, out=x)
            np.clip(x, 0, 255, out=x)
            x = x.astype(np.uint8).reshape(p["rows"], p["cols"], 8, 8).transpose(0, 2, 1, 3).reshape(p["rows"] * 8, p["cols"] * 8)
            planes.append((x, v_max // p["v"], h_max // p["h"]))
        grown = lambda x, fv, fh: np.repeat(np.repeat(x, fh, axis=1), fv, axis=0)[: self.height, : self.width]
        y = grown(*planes[0]).astype(np.int16)
        out = np.empty((self.height, self.width, 3), np.uint8)
        if len(planes) == 1:
            out[:] = y[:, :, None]
            return out
        (cb, *fb), (cr, *fr) = planes[1:]
        cb, cr, half = cb.astype(np.int32) - 128, cr.astype(np.int32) - 128, 1 << 15
        add = lambda x, f: grown(((x + half) >> 16).astype(np.int16), *f)  # noqa: E731  the usual conversion in 16-bit fixed point
        for k, x in enumerate((add(91881 * cr, fr), add(-22554 * cb, fb) + add(-46802 * cr, fr), add(116130 * cb, fb))):
            x += y
            np.clip(x, 0, 255, out=x)
            out[:, :, k] = x
        return out


def decode(data: bytes) -> Picture:
    """Accumulate all scans of a progressive JPEG (Huffman, 8 bits, 1 or 3 components)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    quant, tables, parts, comment, restart = {}, {}, [], b"", 0
    height = width = 0
    at = 2
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xFE:
            comment = body
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(n)]
            h_max, v_max = max(p["h"] for p in parts), max(p["v"] for p in parts)
            mx, my = -(-width // (8 * h_max)), -(-height // (8 * v_max))
            for p in parts:
                p |= {"cols": mx * p["h"], "rows": my * p["v"], "own_cols": -(-(-(-width * p["h"] // h_max)) // 8), "own_rows": -(-(-(-height * p["v"] // v_max)) // 8)}
                p["coef"] = np.zeros((p["rows"] * p["cols"], 64), np.int16)
        elif 0xC0 <= kind <= 0xCF:
            raise ValueError("only progressive Huffman frames are read")
        elif kind == 0xDA:
            n = body[0]
            own = [(next(k for k, p in enumerate(parts) if p["id"] == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            ss, se, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            found = _MARK.search(data, at)
            if not found:
                raise ValueError("the file ends early")
            coded, at = data[at : found.start()], found.start()
            if n > 1:
                plan, total = [], mx * my
                for k, t in own:
                    p = parts[k]
                    grid = _mcu_blocks(my, mx, p["v"], p["h"])
                    plan += [(k, tables.get(t >> 4), grid[:, j]) for j in range(grid.shape[1])]
            else:
                k, t = own[0]
                p = parts[k]
                ids = (np.arange(p["own_rows"])[:, None] * p["cols"] + np.arange(p["own_cols"])[None, :]).reshape(-1)
                plan, total = [(k, tables.get(t >> 4), ids)], len(ids)
            pieces = _RESTART.split(coded) if restart else [coded]
            for j, piece in enumerate(pieces):
                lo, hi = (j * restart, min(total, (j + 1) * restart)) if restart else (0, total)
                bits = _Bits(piece)
                if ss == 0 and ah == 0:
                    _dc_first(bits, [(k, t, g[lo:hi]) for k, t, g in plan], [p["coef"] for p in parts], hi - lo, al)
                elif ss == 0:
                    got = bits.bulk((hi - lo) * len(plan)).reshape(-1, len(plan)).astype(np.int16)
                    for c, (k, _, g) in enumerate(plan):
                        parts[k]["coef"][g[lo:hi], 0] |= got[:, c] << al
                else:
                    k, t = own[0]
                    (_ac_refine if ah else _ac_first)(bits, tables[0x10 | (t & 15)], parts[k]["coef"], plan[0][2][lo:hi], ss, se, al)
    return Picture(height, width, parts, quant, comment)


def payload_of(picture: Picture) -> bytes:
    """The bytes that encode_payload stored."""
    n = struct.unpack_from(">Q", picture.comment)[0]
    v = np.concatenate([p["coef"] for p in picture.parts])[: n // UNIT]
    return np.where(v > 0, v, v + 255).astype(np.uint8).tobytes()


# ---- columns ----


def unit_payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % UNIT if raw else UNIT)


def encode_column(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                own = [unit_payload(t) for t in b.column(1)[at : at + 500].to_pylist()]
                media = [encode_payload(p) for _, p in own]
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + 500], pa.array([n for n, _ in own], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode_column(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """(doc_id, height, width, rgb): full-resolution RGB tensors, row by row; null where an image can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                out = []
                for m in b.column(1)[at : at + 100].to_pylist():
                    try:
                        out.append(decode(m).rgb() if m is not None else None)
                    except (ValueError, IndexError, KeyError, struct.error):
                        out.append(None)
                shape = lambda i: pa.array([None if x is None else x.shape[i] for x in out], pa.int32())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + 100], shape(0), shape(1), pa.array([None if x is None else x.tobytes() for x in out], pa.binary())], ["doc_id", "height", "width", "rgb"])

    return media.select(F.col(key).cast("long").alias("doc_id"), F.col(column).alias("media")).mapInArrow(run, "doc_id long, height int, width int, rgb binary")


def digest(media: DataFrame) -> DataFrame:
    """The contract's columns, all from the stored bytes but n_bytes."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(2).to_pylist():
                picture = decode(m)
                payload, rgb = payload_of(picture), picture.rgb()
                mean = "-".join(f"{x / rgb[:, :, 0].size:.3f}" for x in rgb.sum(axis=(0, 1), dtype=np.int64).tolist())
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), f"{rgb.shape[0]}x{rgb.shape[1]}:{mean}:{zlib.crc32(rgb):08x}"))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
