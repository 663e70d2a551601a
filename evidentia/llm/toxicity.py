"""Toxicity: a convolutional text classifier in numpy.

Words (``\\w+`` of the lower-cased text) and their beginnings are hashed, and a word's embedding is the
sum of theirs, so that inflected forms share. Filters of several widths slide over the whole text,
each filter's maximum feeds a logistic output. Only features seen in several training texts have an
embedding, so an unseen word is neutral. Thresholds are calibrated by language on rows held back from
fitting: a text's language is guessed from its own frequent words (learned from the training rows'
lang), and the language's threshold shifts the logit so that 0.5 is the boundary everywhere. Labels,
lang, source and ids are never inputs of a score.

Fitting uses a bounded, documented sample of labelled rows (``max_rows``, and MAX_BYTES of text), chosen
by a hash of the id; sampled texts are learned from whole. A text's words are held only while they are counted and numbered;
scoring covers every row and every word. Null and empty texts have no words and get the score of an
empty text. Repeated rows score alike; a row is returned for each input row; extra columns are
ignored. With no positive or no negative label to learn from, every score is the label's base rate.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import fold, hash_sample, stored, unused

BUCKETS = 1 << 20
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
MAX_ROWS = 4000
MAX_BYTES = 1 << 25  # of the texts that are learned from: these go to the driver
PREFIXES = (4, 5, 6, 7, 8)  # beginnings of a word that count beside it
MIN_TEXTS = 2  # training texts that a feature must stand in to get an embedding
GAP = max(WIDTHS) - 1
WORDS = re.compile(r"\w+")
CACHED = 400_000
STEP = 1 << 16  # words that pass through the filters at once


def _buckets(word: str) -> list[int]:
    """Hashed features of a word: itself and its longer beginnings, so that inflected forms share."""
    forms = [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in forms]


class _Vocabulary(dict):
    """Word to row of ``table``, the sums of its features' embeddings (row 0 is zero)."""

    def __init__(self, rows: dict[int, int], emb: np.ndarray) -> None:
        self.rows, self.emb = rows, emb
        self.table = np.zeros((CACHED + 1, emb.shape[1]), np.float32)
        self.used = 0

    def __missing__(self, word: str) -> int:
        own = [r for r in map(self.rows.get, _buckets(word)) if r]
        row = 0
        if own:
            self.used += 1
            row = self.used
            self.table[row] = self.emb[own].sum(axis=0)
        self[word] = row
        return row

    def make_room(self, n: int) -> None:
        """Forgets everything when n more words might not fit."""
        if len(self) + n > CACHED:
            self.clear()
            self.used = 0


class Classifier:
    """rows: bucket to embedding row; shift: language to logit of its threshold."""

    def __init__(self, rows: dict[int, int], emb: np.ndarray, filters: list[np.ndarray], out: np.ndarray, bias: float, langs: list[str], lang_words: dict[str, int], shift: np.ndarray) -> None:
        self.rows, self.emb, self.filters, self.out, self.bias = rows, emb, filters, out, bias
        self.langs, self.lang_words, self.shift = langs, lang_words, shift

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "vocab"}

    def ids(self, words: list[str]) -> np.ndarray:
        look = self.vocab.__getitem__
        return np.fromiter(map(look, words), np.int32, len(words))

    def language(self, words: list[str]) -> int:
        """The language whose frequent words come up most; the last entry means no evidence."""
        seen = Counter(map(self.lang_words.get, words))
        seen.pop(None, None)
        return min(seen, key=lambda k: (-seen[k], k)) if seen else len(self.langs)

    def pooled(self, docs: list[np.ndarray]) -> np.ndarray:
        """Maximum of each filter over each document; documents stand between gaps of zero rows."""
        sizes = np.array([len(d) for d in docs], np.int64)
        starts = np.cumsum(sizes + GAP) - sizes
        flat = np.zeros(int(sizes.sum()) + GAP * (len(docs) + 1), np.int32)
        for s, d in zip(starts.tolist(), docs):
            flat[s : s + len(d)] = d
        out = np.full((len(docs), len(self.filters) * FILTERS), -np.inf, np.float32)
        # a document's span of windows: those that touch one of its words or gaps
        lo, hi = starts - GAP, starts + np.maximum(sizes, 1)
        for at in range(0, len(flat) - GAP, STEP):
            end = min(at + STEP, len(flat) - GAP)
            x = self.vocab.table[flat[at : end + GAP]]
            first, last = np.searchsorted(hi, at, "right"), np.searchsorted(lo, end, "left")
            if first >= last:
                continue
            a = np.maximum(lo[first:last], at) - at
            for k, w in enumerate(self.filters):
                width = w.shape[0]
                z = x[: end - at] @ w[0]
                for i in range(1, width):
                    z += x[i : i + end - at] @ w[i]
                part = np.maximum.reduceat(z, a, axis=0)
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                out[first:last, cols] = np.maximum(out[first:last, cols], part)
        return np.maximum(out, 0)

    def logits(self, texts: Iterable[str | None]) -> np.ndarray:
        if "vocab" not in self.__dict__:
            self.vocab = _Vocabulary(self.rows, self.emb)
        out, n, some = [np.empty(0)], 0, []
        for t in texts:  # as many texts at once as surely have room in the vocabulary; no others' words are held
            words = WORDS.findall((t or "").lower())
            if some and n + len(words) > CACHED // 4:
                out.append(self._logits(some, n))
                n, some = 0, []
            n += len(words)
            some.append(words)
        if some:
            out.append(self._logits(some, n))
        return np.concatenate(out)

    def _logits(self, words: list[list[str]], n: int) -> np.ndarray:
        """Of texts with n words together; one text alone may have more than fit and gets a table of its own."""
        if n > CACHED:
            self.vocab = _Vocabulary(self.rows, self.emb)
            self.vocab.table = np.zeros((len(set(words[0])) + 1, self.emb.shape[1]), np.float32)
        else:
            self.vocab.make_room(n)
        out = self.pooled([self.ids(w) for w in words]) @ self.out + self.bias
        if n > CACHED:
            del self.vocab
            self.vocab = _Vocabulary(self.rows, self.emb)
        return out - self.shift[[self.language(w) for w in words]]


def fit(texts: list[str], labels: list[int], langs: list[str | None], epochs: int = 5, rate: float = 0.15, seed: int = 7) -> Classifier:
    """Adagrad on the logistic loss, gradients through the arg-max windows of each filter."""
    rng = np.random.default_rng(seed)
    names = sorted({x for x in langs if x is not None})
    own, total = {x: Counter() for x in names}, Counter()
    number: dict[str, int] = {}
    docs, forms = [], array("i", [-1] * (1 + len(PREFIXES)))  # of a word: its buckets, -1 for a form that it lacks; number 0 is the gap
    texts_of = np.zeros(BUCKETS, np.int32)
    for t, lang in zip(texts, langs):  # a text's words are dropped when they are counted and numbered
        words = WORDS.findall((t or "").lower())
        if lang is not None:
            own[lang].update(words)
            total.update(words)
        for w in dict.fromkeys(words):
            if w not in number:
                number[w] = len(number) + 1
                found = _buckets(w)
                forms.extend(found + [-1] * (1 + len(PREFIXES) - len(found)))
        docs.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        width = 1 + len(PREFIXES)
        hashed = np.unique(np.concatenate([forms[i * width : (i + 1) * width] for i in np.unique(docs[-1]).tolist()])) if words else np.empty(0, np.int32)
        texts_of[hashed[hashed >= 0]] += 1
    lang_words = {}
    for k, x in enumerate(names):
        for w, n in own[x].most_common(100):
            if n > 0.8 * total[w]:
                lang_words[w] = k
    del own, total, number
    kept = np.flatnonzero(texts_of >= MIN_TEXTS)
    rows = dict(zip(kept.tolist(), range(1, len(kept) + 1)))
    row_of = np.zeros(BUCKETS + 1, np.int32)  # its last entry is -1's
    row_of[kept] = np.arange(1, len(kept) + 1)
    feats = row_of[np.frombuffer(forms, np.int32).reshape(-1, 1 + len(PREFIXES))]  # a word's embedding rows; row 0 of either is the gap
    del forms, texts_of, row_of
    emb = np.zeros((len(rows) + 1, DIM), np.float32)
    filters = [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    out = rng.normal(0, 0.5, len(WIDTHS) * FILTERS).astype(np.float32)
    y = np.array(labels, np.float32)
    share = float(y.mean()) if len(y) else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3)
    model = Classifier(rows, emb, filters, out, float(np.log(share / (1 - share))), names, lang_words, np.zeros(len(names) + 1))
    if not len(y) or y.min() == y.max():
        model.out = np.zeros_like(out)
        return model
    emb[1:] = rng.normal(0, 0.05, (len(rows), DIM))
    val = np.arange(len(y)) % 5 == 4
    train = np.flatnonzero(~val)
    g_emb, g_out, g_bias, g_fil = np.full_like(emb, 1e-6), np.full_like(out, 1e-6), 1e-6, [np.full_like(f, 1e-6) for f in filters]
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), 32):
            batch = train[at : at + 32]
            flat = np.zeros(sum(len(docs[i]) for i in batch) + GAP * (len(batch) + 1), np.int32)
            spans, s = [], GAP
            for i in batch:
                flat[s : s + len(docs[i])] = docs[i]
                spans.append((s - GAP, s + max(1, len(docs[i]))))
                s += len(docs[i]) + GAP
            x, n = emb[feats[flat]].sum(axis=1), len(flat) - GAP
            peak = np.empty((len(batch), len(out)), np.int64)
            top = np.empty((len(batch), len(out)), np.float32)
            for k, f in enumerate(filters):
                z = sum(x[i : i + n] @ f[i] for i in range(f.shape[0]))
                for b, (lo, hi) in enumerate(spans):
                    arg = z[lo:hi].argmax(axis=0) + lo
                    peak[b, k * FILTERS : (k + 1) * FILTERS] = arg
                    top[b, k * FILTERS : (k + 1) * FILTERS] = z[arg, np.arange(FILTERS)]
            act = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ model.out + model.bias, -30, 30)))
            e = (p - y[batch]) * weight[batch] / len(batch)
            d_act = np.outer(e, model.out) * (top > 0)
            grad = e @ act + 1e-4 * model.out
            g_out += grad**2
            model.out -= rate * grad / np.sqrt(g_out)
            g = float(e.sum())
            g_bias += g * g
            model.bias -= rate * g / g_bias**0.5
            d_x = np.zeros_like(x)
            for k, f in enumerate(filters):
                d, at_w = d_act[:, k * FILTERS : (k + 1) * FILTERS], peak[:, k * FILTERS : (k + 1) * FILTERS]
                for i in range(f.shape[0]):
                    rows_x = x[at_w + i]  # batch, filter, dim
                    grad = np.einsum("bf,bfd->df", d, rows_x)
                    np.add.at(d_x, (at_w + i).reshape(-1), (d[:, :, None] * f[i].T[None]).reshape(-1, DIM))
                    g_fil[k][i] += grad**2
                    f[i] -= rate * grad / np.sqrt(g_fil[k][i])
            hit = np.flatnonzero(np.abs(d_x).sum(axis=1))
            ids, where = np.unique(feats[flat[hit]], return_inverse=True)
            grad = np.zeros((len(ids), DIM), np.float32)
            np.add.at(grad, where.reshape(-1), np.repeat(d_x[hit], feats.shape[1], axis=0))
            grad[ids == 0] = 0
            g_emb[ids] += grad**2
            emb[ids] -= rate * grad / np.sqrt(g_emb[ids])
    # words that never moved a filter are as neutral as unseen ones
    emb[g_emb.max(axis=1) <= 2e-6] = 0
    emb[0] = 0
    kept = np.flatnonzero(np.abs(emb).sum(axis=1))
    renumber = {int(old): new + 1 for new, old in enumerate(kept)}
    model.rows = {b: renumber[r] for b, r in rows.items() if r in renumber}
    model.emb = np.concatenate([np.zeros((1, DIM), np.float32), emb[kept]])
    held = np.flatnonzero(val)
    raw = model.logits([texts[i] for i in held])
    lang = np.array([model.language(WORDS.findall((texts[i] or "").lower())) for i in held])
    for k in range(len(names) + 1):
        mine = lang == k
        if (y[held][mine] == 1).sum() >= 5 and (y[held][mine] == 0).sum() >= 5:
            model.shift[k] = _threshold(raw[mine], y[held][mine])
        elif len(held):
            model.shift[k] = _threshold(raw, y[held])
    return model


def _threshold(logit: np.ndarray, y: np.ndarray) -> float:
    """The logit of the best F1, in the middle of the gap that it lies in."""
    if not (y == 1).any():
        return 0.0
    order = np.argsort(-logit, kind="stable")
    hit = np.cumsum(y[order] == 1)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + (y == 1).sum())
    at = int(f1.argmax())
    here = logit[order[at]]
    return float((here + (logit[order[at + 1]] if at + 1 < len(y) else here - 2)) / 2)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", where: Column | None = None, max_rows: int = MAX_ROWS) -> Classifier:
    """Fit on at most about ``max_rows`` labelled rows of ``docs``, half of them of either label where there are so many."""
    rows = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    if where is not None:
        rows = rows.where(where)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    chosen = None
    for y, n in sorted(sizes.items()):
        part = hash_sample(rows.where(F.col("label") == y), "doc_id", max_rows // 2, n)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return fit([], [], [])
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), lang.alias("lang"))
    # of rows that share an id the least text is learned from, so that the model is the same in every run
    rows = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "label")).alias("row")).select("doc_id", "row.*")
    rows = stored(rows, "labelled")
    sizes = [tuple(r) for r in rows.select("doc_id", "label", F.coalesce(F.octet_length("text"), F.lit(0))).collect()]
    if sum(n for _, _, n in sizes) > MAX_BYTES:
        rows = rows.where(F.col("doc_id").isin(_within(sizes, MAX_BYTES)))
    got = sorted(rows.toArrow().to_pylist(), key=lambda r: r["doc_id"])
    return fit([r["text"] for r in got], [r["label"] for r in got], [r["lang"] for r in got])


def _within(sizes: list[tuple], most: int) -> list:
    """Ids of (id, label, bytes) that have room in ``most`` bytes, a like share for each label; by a hash of the id, one that has no room is passed over. Of each label one at least, the shortest."""
    labels = {y for _, y, _ in sizes}
    out = []
    for y in sorted(labels):
        own = sorted((zlib.crc32(str(k).encode()), str(k), n, k) for k, z, n in sizes if z == y)
        room, kept = most // len(labels), []
        for *_, n, k in own:
            if n <= room:
                room -= n
                kept.append(k)
        out += kept or [min(own, key=lambda x: x[2])[3]]
    return out


def added(columns: list[str]) -> tuple[str, str]:
    """Names of the columns that ``score`` adds to a table of these columns."""
    return unused(columns, "tox_score"), unused(columns, "tox_predicted")


def score(docs: DataFrame, model: Classifier, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (``keep``, else all) with tox_score (double, 0 to 1) and tox_predicted (int); underscores are appended to a name that is taken."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns if keep is None else keep
    names = [*columns, *added(columns)]
    docs = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").cast("string").alias(unused(columns, "__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            texts = b.column(b.num_columns - 1)
            s = own.logits(t for at in range(0, len(texts), 32) for t in texts[at : at + 32].to_pylist())
            p = 1 / (1 + np.exp(-np.clip(s.astype(np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names)

    kinds = [f.dataType.simpleString() for f in docs.schema.fields[:-1]] + ["double", "int"]
    return docs.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, where=fold(F.col("doc_id"), 5) != 0)
    found = score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"))
