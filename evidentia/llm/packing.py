"""Vector bin packing of token sequences by a dot-product heuristic, for instruction data.

A document is an optional prompt and a text. Its ids are the prompt's, the text's and an end id. The
prompt's tokens, and the first ``context`` tokens of the text, only condition what follows: they bear no
loss. A sequence has three limits at once: tokens, segments and loss-bearing tokens. A document too
large for one sequence is cut into pieces that fill sequences of their own, up to the first limit met;
what remains is an item with three demands. Items of a pool are placed one after another: among those
that fit all three limits, the one whose demand has the largest dot product with the open sequence's
free capacity. When none fits and at least CUT_FROM tokens are free under both limits, the item of the
largest product is cut to fill them. Pools are per task and bounded (POOL items), so packing needs no
shuffle and its memory doesn't grow with the input.

Null and empty texts have the end id alone (after their prompt's ids, if any). Ties go to the item that
came first. Repeated rows are packed as often as they stand there; extra columns are ignored; an empty
table gives no sequences.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.tokens import BATCH, encoder

SIZE = 1024
SEGMENTS = 64
LOSS = 1020
CONTEXT = 16  # tokens at a text's start that bear no loss
POOL = 8192
CUT_FROM = 32
TOKENIZER = "byte_bpe_50k.json"


def place(tokens: np.ndarray, quiet: np.ndarray, limits: tuple[int, int, int], cut_from: int | None = CUT_FROM) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, from, length) that together hold every item once, in any number of parts.

    ``quiet`` of an item's tokens, its first ones, bear no loss. Items must fit an empty sequence.
    """
    cap = np.array(limits, np.int64)
    tokens, quiet = tokens.astype(np.int64), np.minimum(quiet, tokens).astype(np.int64)
    need = np.stack([tokens, np.ones(len(tokens), np.int64), tokens - quiet])
    if need.size and (need > cap[:, None]).any():
        raise ValueError("an item exceeds a limit")
    begun = np.zeros(len(tokens), np.int64)
    there = need[0] > 0
    # demands and capacities count as shares of the limits; times the square of the limits' common multiple, products are whole and ties are exact
    common = math.lcm(*limits)
    weight = np.array([(common // c) ** 2 if common**2 < 1 << 60 else 1 / c**2 for c in limits])
    out: list[list[tuple[int, int, int]]] = []
    left, free, own = int(there.sum()), cap.copy(), []
    item = np.arange(len(tokens))  # of each place of the arrays; items that are placed leave them when they are half of all
    while left:
        if 2 * left < len(item):
            need, quiet, begun, item = need[:, there], quiet[there], begun[there], item[there]
            there = np.ones(left, bool)
        want = free * weight
        product = want[0] * need[0] + want[1] * need[1] + want[2] * need[2]
        product[~there] = -1
        fits = (need[0] <= free[0]) & (need[2] <= free[2]) if free[1] >= 1 else np.zeros(len(need[0]), bool)
        inside = np.where(fits, product, -1)
        i = int(inside.argmax())
        if inside[i] >= 0:
            own.append((int(item[i]), int(begun[i]), int(need[0, i])))
            free -= need[:, i]
            there[i] = False
            left -= 1
            continue
        if own and cut_from is not None and free[1] >= 1:
            i = int(product.argmax())
            room = int(min(free[0], quiet[i] + free[2]))
            if room >= cut_from:
                own.append((int(item[i]), int(begun[i]), room))
                begun[i] += room
                quiet[i] = max(0, quiet[i] - room)
                need[0, i] -= room
                need[2, i] = need[0, i] - quiet[i]
        out.append(own)
        free, own = cap.copy(), []
    if own:
        out.append(own)
    return out


_KINDS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "loss_tokens": pa.int64(), "ids": pa.binary()}


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER, end_id: int = 0, limits: tuple[int, int, int] = (SIZE, SEGMENTS, LOSS), prompt: str | None = None, context: int = CONTEXT, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens[, ids]); ``prompt`` names a text column that goes ahead of the text."""
    size, most = limits[0], limits[2]
    if min(limits) < 1:
        raise ValueError("a limit leaves no room")
    kinds = _KINDS if with_ids else {k: v for k, v in _KINDS.items() if k != "ids"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        next_id = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        pool: list[tuple] = []  # (doc_id, start, ids, doc_tokens, how many of the document's first tokens bear no loss)

        def piece(doc, start, ids, total, quiet, sequence, offset) -> None:
            n = len(ids) // 4
            rows.append((doc, start, n, zlib.crc32(ids), total, sequence, offset, n - min(n, max(0, quiet - start)), ids))

        def settle() -> None:
            nonlocal next_id
            n = np.array([len(p[2]) // 4 for p in pool], np.int64)
            rest = np.array([max(0, p[4] - p[1]) for p in pool], np.int64)
            for sequence in place(n, rest, limits):
                offset = 0
                for i, a, length in sequence:
                    doc, start, ids, total, quiet = pool[i]
                    piece(doc, start + a, ids[4 * a : 4 * (a + length)], total, quiet, next_id, offset)
                    offset += length
                next_id += 1
            pool.clear()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))
            rows.clear()
            return b

        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                keys = b.column(0)[at : at + BATCH].to_pylist()
                ahead = [b""] * len(keys) if prompt is None else enc.encode(b.column(2)[at : at + BATCH].to_pylist())
                for doc, before, ids in zip(keys, ahead, enc.encode(b.column(1)[at : at + BATCH].to_pylist())):
                    quiet = len(before) // 4 + min(context, len(ids) // 4)
                    ids = before + ids + end
                    total, start = len(ids) // 4, 0
                    while total - start >= (full := min(size, max(0, quiet - start) + most)):
                        piece(doc, start, ids[4 * start : 4 * (start + full)], total, quiet, next_id, 0)
                        next_id += 1
                        start += full
                    if start < total:
                        pool.append((doc, start, ids[4 * start :], total, quiet))
                        if len(pool) >= POOL:
                            settle()
                if len(rows) >= 4096:
                    yield out()
        settle()
        if rows:
            yield out()

    names = {pa.int64(): "long", pa.binary(): "binary"}
    asked = [F.col(f"`{c}`").cast("string").alias(n) for c, n in ((text, "text"), (prompt, "prompt")) if c is not None]
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), *asked).mapInArrow(run, ", ".join(f"`{k}` {names[t]}" for k, t in kinds.items()))
