"""SimHash near-dedup by deletion-variant signatures.

A document's words (A-Z lower-cased, split at ASCII white space) give 3-word shingles, repeats
included; a fingerprint bit is set if it is set in over half of the shingles' XXH64 (seed 42) values.
Two fingerprints link when they differ in at most three bits.

Candidates: with three differing bits over two 32-bit segments, one segment differs in at most one
bit. Every fingerprint is indexed under 2 x 32 signatures "segment s with bit j deleted"; equal
signatures are brought together and verified against the full distance. A pair is accepted under
signature (s, j) only if the segment differs exactly in j, or if the segments are equal and j is 0,
so each bucket adds new links alone. Only distinct fingerprints are indexed; copies follow theirs.

A bucket of a few fingerprints is compared directly. A larger one is dealt anew under second-level
signatures: the other segment is cut into two halves of 16 bits, one of which differs in at most
one bit (three differing bits at most are left for it), and each fingerprint goes to 2 x 16 refined
buckets. Such a bucket fixes 31 + 15 bits and so holds at most 2**18 fingerprints. Every bucket
reports a spanning forest of its links, never all pairs; components stay the same.

Nulls and empty texts: no word, fingerprint zero, linked like any other. Fewer than three words:
one shingle of all of them. The nodes are fingerprints, so rows need no id to be linked: a component's
id is the smallest doc_id among all its rows, null only if none of them has one. Rows that share a
doc_id are rows of their own: each has its own fingerprint and that fingerprint's component. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import forget, stored, stored_at, unused

DIRECT = 256  # fingerprints that a first-level bucket compares directly
BLOCK = 2048  # rows compared at once in a bucket


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= 3:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], dtype="<u8")
    else:
        lens = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lens + 1) - 1
        starts = ends - lens
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:-2].tolist(), ends[2:].tolist())), dtype="<u8", count=n - 2)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """The columns of docs and, last, each row's fingerprint as a signed long under ``name``, which must be free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(b.num_columns - 1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], [*b.schema.names[:-1], name])

    rows = docs.select("*", F.col(f"`{text}`").cast("string").alias(name))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows.mapInArrow(run, f"{ddl}, `{name}` long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _forest(fp: np.ndarray, fits) -> list[tuple[int, int]]:
    """Spanning forest over the links between distinct fingerprints: fits(xor matrix) marks links."""
    n, label, edges = len(fp), np.arange(len(fp)), []
    for i0 in range(0, n, BLOCK):
        for j0 in range(i0, n, BLOCK):
            ok = fits(fp[i0 : i0 + BLOCK, None] ^ fp[None, j0 : j0 + BLOCK])
            for i in range(ok.shape[0]):
                js = np.nonzero(ok[i])[0] + j0
                js = js[js > i0 + i]
                if len(js):
                    mine = label[i0 + i]
                    theirs, at = np.unique(label[js], return_index=True)
                    for t, a in zip(theirs.tolist(), at.tolist()):
                        if t != mine:
                            edges.append((i0 + i, int(js[a])))
                            label[label == t] = mine
    return edges


def _expand(fp: np.ndarray, shift: int, width: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (n, width) of one segment with bit j deleted (cleared); j and the segment's number are mixed in."""
    seg = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    j = np.arange(width, dtype=np.uint64)
    cleared = seg[:, None] & ~(np.uint64(1) << j)[None, :]
    return cleared, (j + np.uint64(salt))[None, :]


def _first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        signed = b.column(0).to_numpy(zero_copy_only=False)
        fp = signed.view(np.uint64)
        keys = []
        for s in (0, 1):
            cleared, tag = _expand(fp, 32 * s, 32, 32 * s)
            keys.append((cleared | (tag << np.uint64(32))).view(np.int64))
        key = np.concatenate(keys, axis=1).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(signed, 64))], ["sig", "fp"])


def _accepts(sig: int):
    """Links that the bucket of this signature owns, from xor values."""
    tag = (sig >> 32) & 63
    s, j = tag // 32, tag % 32
    mask, bit = np.uint64(0xFFFFFFFF << (32 * s)), np.uint64(1 << (32 * s + j))

    def fits(x: np.ndarray) -> np.ndarray:
        part = x & mask
        own = (part == bit) | (part == 0) if j == 0 else part == bit
        return own & (_popcount(x) <= 3) & (x != 0)

    return fits


def _bucket_links(sig: np.ndarray, fp: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the buckets that begin at ``first``; rows of a bucket stand together."""
    a_out, b_out = [], []
    pairs = first[size == 2]  # by far the most frequent size, done at once
    x = fp[pairs] ^ fp[pairs + 1]
    tag = (sig[pairs] >> 32) & 63
    s, j = (tag // 32).astype(np.uint64), (tag % 32).astype(np.uint64)
    part = (x >> (s * np.uint64(32))) & np.uint64(0xFFFFFFFF)
    ok = ((part == (np.uint64(1) << j)) | ((part == 0) & (j == 0))) & (_popcount(x) <= 3) & (x != 0)
    a_out.append(fp[pairs][ok])
    b_out.append(fp[pairs + 1][ok])
    for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        own = fp[at : at + n]
        if edges := _forest(own, _accepts(int(sig[at]))):
            e = np.array(edges)
            a_out.append(own[e[:, 0]])
            b_out.append(own[e[:, 1]])
    return np.concatenate(a_out), np.concatenate(b_out)


LINK, LARGE = 0, 1


def _out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "a", "b"])


def _direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, fp) sorted by sig: links of buckets up to DIRECT rows; rows of larger ones pass on, never gathered."""
    sig0, fp0, passing = np.empty(0, np.int64), np.empty(0, np.uint64), None
    for b in batches:
        sig, fp = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if passing is not None:
            n = int(np.searchsorted(sig, passing, "right"))
            if n:
                yield _out(LARGE, sig[:n], fp[:n])
            sig, fp = sig[n:], fp[n:]
            if not len(sig):
                continue
            passing = None
        sig, fp = np.concatenate([sig0, sig]), np.concatenate([fp0, fp])
        sig0, fp0 = np.empty(0, np.int64), np.empty(0, np.uint64)
        if not len(sig):
            continue
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        size = np.diff(np.r_[first, len(sig)])
        for at, n in zip(first[size > DIRECT].tolist(), size[size > DIRECT].tolist()):
            yield _out(LARGE, sig[at : at + n], fp[at : at + n])
        if size[-1] > DIRECT:
            passing = sig[-1]
        else:
            sig0, fp0 = sig[first[-1] :], fp[first[-1] :]
        keep = (size <= DIRECT) & (np.arange(len(size)) < len(size) - 1) & (size > 1)
        yield _out(LINK, *_bucket_links(sig, fp, first[keep], size[keep]))
    if len(sig0) > 1:
        yield _out(LINK, *_bucket_links(sig0, fp0, np.array([0]), np.array([len(sig0)])))


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, refined, fp) sorted by both: links of each refined bucket, of at most 2**18 fingerprints."""
    rest = [np.empty(0, np.int64)] * 3
    for b in batches:
        now = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, b.columns)]
        if not len(now[0]):
            continue
        new = (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])
        first = np.flatnonzero(np.r_[True, new])
        size = np.diff(np.r_[first, len(now[0])])
        rest = [x[first[-1] :] for x in now]
        keep = (size > 1) & (np.arange(len(size)) < len(size) - 1)
        yield _out(LINK, *_bucket_links(now[0], now[2].view(np.uint64), first[keep], size[keep]))
    if len(rest[0]) > 1:
        yield _out(LINK, *_bucket_links(rest[0], rest[2].view(np.uint64), np.array([0]), np.array([len(rest[0])])))


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large buckets under second-level signatures of their other segment."""
    for b in batches:
        sig, signed = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        fp = signed.view(np.uint64)
        other = np.where(((sig >> 32) & 63) < 32, fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))
        keys = []
        for s in (0, 1):
            cleared, tag = _expand(other, 16 * s, 16, 16 * s)
            keys.append((cleared | (tag << np.uint64(16))).view(np.int64))
        refined = np.concatenate(keys, axis=1).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sig, 32)), pa.array(refined), pa.array(np.repeat(signed, 32))], ["sig", "refined", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that leave the same components as all links."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = fps.select("fp").distinct().mapInArrow(_first_level, "sig long, fp long")
    found = stored(signed.repartition(n, "sig").sortWithinPartitions("sig").mapInArrow(_direct, "kind int, a long, b long"), "buckets")
    large = found.where(F.col("kind") == LARGE).select("a", "b").mapInArrow(_refine, "sig long, refined long, fp long")
    deep = large.repartition(n, "sig", "refined").sortWithinPartitions("sig", "refined").mapInArrow(_refined, "kind int, a long, b long")
    return found.where(F.col("kind") == LINK).unionByName(deep).select("a", "b").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable. nodes: node; edges: u, v (node ids).

    Alternates the large-star and small-star steps until the edges no longer change; every round is
    a group by and a join-free rewrite written to the shared folder, in place of the round before.
    """
    spark = edges.sparkSession
    both, path = stored_at(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    signature = None
    while True:
        # large star: every neighbour that is larger than the node points at the smallest neighbour
        sym = both.select("u", "v").unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: all smaller neighbours of a node, and the node, point at the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before = path
        both, path = stored_at(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(spark, before)
        now = both.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == signature:
            break
        signature = now
    label = both.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(label, nodes["node"] == label["u"], "left").select("node", F.coalesce("component", "node").alias("component"))


def groups(fps: DataFrame) -> DataFrame:
    """(fp, component) of every distinct fingerprint in column fp; a component is named by its smallest (signed) fingerprint."""
    distinct = stored(fps.select("fp").distinct(), "distinct-fingerprints")
    pairs = links(distinct).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return components(distinct.select(F.col("fp").alias("node")), pairs).select(F.col("node").alias("fp"), "component")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    own = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    own = stored(with_fingerprint(own).select("doc_id", "fp"), "fingerprints")
    least = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    of_fp = stored(groups(own).join(least, "fp"), "components")
    smallest = of_fp.groupBy("component").agg(F.min("least").alias("component_id"))
    return own.join(of_fp.join(smallest, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The columns of docs, one row of each component: that of the smallest id (none last), then of the smallest fingerprint.

    Rows that share both are near copies under one id, and one of them stays. Rows of other components stay
    whatever their id, so different texts under one id, or under none, are not lost.
    """
    fp, id_ = unused(docs.columns, "fp"), F.col(f"`{key}`").cast("long")
    rows = stored(with_fingerprint(docs, text, fp), "fingerprinted")
    bare = rows.select(id_.alias("id"), F.col(fp).alias("fp"))
    each = bare.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least"))
    best = groups(bare).join(each, "fp").groupBy("component").agg(F.min(F.struct("least", "fp")).alias("best"))
    best_id, best_fp = unused(docs.columns, "best_id"), unused(docs.columns, "best_fp")
    best = best.select(F.col("best.least.id").alias(best_id), F.col("best.fp").alias(best_fp))
    kept = rows.join(best, (F.col(fp) == F.col(best_fp)) & id_.eqNullSafe(F.col(best_id)), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.groupBy(F.col(fp), id_).agg(F.min_by(whole, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("row")).select("row.*")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
