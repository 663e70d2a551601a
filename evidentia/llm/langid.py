"""Language ID: a bidirectional gated recurrent network over UTF-8 bytes, in numpy.

A text's bytes are cut into windows of WINDOW bytes, all of them, the last one padded. In either
direction a gated recurrent unit (gates by a piecewise linear sigmoid) runs through the window; both
states together label every byte with probabilities of the languages, and a document's probability is
the mean over its bytes. Training is by backpropagation through time over windows drawn from at most
about ``max_rows`` labelled documents, chosen by a hash of id and text; every text is labelled whole.

A null text, and one without any letter, is ``und`` with score 0. Ties go to the language that sorts
first. Repeated rows are labelled alike; extra columns are ignored. Without any labelled document
every text is ``und``; with one language alone it is that language with score 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import fold, unused

WINDOW = 64
HIDDEN = 8
PAD = 256
LANES = 4096
MAX_ROWS = 2000
MAX_LANGS = 256  # most frequent languages that are learned: a column of free text would else make a class of each value
MAX_CHARS = 200_000  # of one sampled text, in fitting alone
UNKNOWN = "und"


class BiGRU:
    """Parameters of both directions: wg, wc (byte to gate and candidate input), ug, uc, bc, v; and the output's bias."""

    def __init__(self, langs: list[str], p: dict[str, np.ndarray]) -> None:
        self.langs, self.p = langs, p

    @classmethod
    def new(cls, langs: list[str], seed: int) -> BiGRU:
        rng, p, h = np.random.default_rng(seed), {}, HIDDEN
        for d in "fb":
            p |= {f"wg{d}": rng.normal(0, 0.1, (257, 2 * h)), f"wc{d}": rng.normal(0, 0.5, (257, h)), f"ug{d}": rng.normal(0, 0.1, (h, 2 * h)), f"uc{d}": rng.normal(0, 0.3, (h, h)), f"bc{d}": np.zeros(h), f"v{d}": rng.normal(0, 0.3, (h, len(langs)))}
            p[f"wg{d}"] += 0.4  # gates start a little below the middle of their range
        p["b"] = np.zeros(len(langs))
        return cls(langs, {k: x.astype(np.float32) for k, x in p.items()})

    def logits(self, ids: np.ndarray) -> np.ndarray:
        """(window, lanes, languages) of ids (window, lanes)."""
        p, h = self.p, HIDDEN
        n, lanes = ids.shape
        out = np.empty((n, lanes, len(self.langs)), np.float32)
        out[:] = p["b"]
        gate, mix = np.empty((lanes, 2 * h), np.float32), np.empty((lanes, 2 * h), np.float32)
        cand, part, label = np.empty((lanes, h), np.float32), np.empty((lanes, h), np.float32), np.empty((lanes, len(self.langs)), np.float32)
        for d, order in (("f", range(n)), ("b", range(n - 1, -1, -1))):
            wg, wc, ug, uc, bc, v = (p[k + d] for k in ("wg", "wc", "ug", "uc", "bc", "v"))
            state = np.zeros((lanes, h), np.float32)
            for t in order:
                np.take(wg, ids[t], axis=0, out=gate, mode="clip")
                np.take(wc, ids[t], axis=0, out=cand, mode="clip")
                np.matmul(state, ug, out=mix)
                gate += mix
                np.clip(gate, 0, 1, out=gate)
                np.matmul(state, uc, out=part)
                part += bc
                part *= gate[:, h:]
                cand += part
                np.tanh(cand, out=cand)
                cand -= state
                cand *= gate[:, :h]
                state += cand
                np.matmul(state, v, out=label)
                out[t] += label
        return out

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        z = self.logits(ids)
        z -= z.max(axis=2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=2, keepdims=True)
        return z

    def label(self, text: str) -> list[str]:
        """The language of every byte of one text."""
        ids, sizes = _windows([text])
        best = self.probabilities(ids).argmax(axis=2).T.reshape(-1)
        return [self.langs[i] for i in best[: sizes[0]]]

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """(documents, languages): mean probabilities over each document's bytes; zeros without bytes."""
        ids, sizes = _windows(texts)
        per = -(-sizes // WINDOW)
        total = np.zeros((ids.shape[1], len(self.langs)), np.float64)
        for at in range(0, ids.shape[1], LANES):
            own = ids[:, at : at + LANES]
            prob = self.probabilities(np.ascontiguousarray(own))
            short = np.flatnonzero((own[-1] == PAD))
            if len(short):
                masked = prob[:, short]
                masked[own[:, short] == PAD] = 0
                prob[:, short] = masked
            total[at : at + LANES] = prob.sum(axis=0)
        out = np.zeros((len(texts), len(self.langs)))
        np.add.at(out, np.repeat(np.arange(len(texts)), per), total)
        return out / np.maximum(sizes, 1)[:, None]


def _windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(WINDOW, windows) byte ids of all texts, PAD after each text's end; and the texts' sizes."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    per = -(-sizes // WINDOW)
    flat = np.full(int(per.sum()) * WINDOW, PAD, np.uint16)
    at = np.cumsum(per) - per
    for r, a in zip(raw, (at * WINDOW).tolist()):
        flat[a : a + len(r)] = np.frombuffer(r, np.uint8)
    return np.ascontiguousarray(flat.reshape(-1, WINDOW).T), sizes


def _step(model: BiGRU, ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of one batch: ids (window, lanes), y and weight by lane."""
    p, h, (n, lanes) = model.p, HIDDEN, ids.shape
    kept: dict[str, list] = {"f": [], "b": []}
    logits = np.zeros((n, lanes, len(model.langs)), np.float32) + p["b"]
    for d, order in (("f", range(n)), ("b", range(n - 1, -1, -1))):
        state = np.zeros((lanes, h), np.float32)
        for t in order:
            raw = p["wg" + d][ids[t]] + state @ p["ug" + d]
            gate = np.clip(raw, 0, 1)
            part = state @ p["uc" + d] + p["bc" + d]
            cand = np.tanh(p["wc" + d][ids[t]] + gate[:, h:] * part)
            new = state + gate[:, :h] * (cand - state)
            kept[d].append((t, state, raw, gate, part, cand, new))
            state = new
            logits[t] += state @ p["v" + d]
    logits -= logits.max(axis=2, keepdims=True)
    e = np.exp(logits)
    e /= e.sum(axis=2, keepdims=True)
    w = (ids != PAD) * weight[None, :]
    w = (w / max(w.sum(), 1e-9)).astype(np.float32)
    loss = float(-(np.log(e[:, np.arange(lanes), y] + 1e-9) * w).sum())
    e[:, np.arange(lanes), y] -= 1
    e *= w[:, :, None]
    grad = {k: np.zeros_like(x) for k, x in p.items()}
    grad["b"] = e.sum(axis=(0, 1))
    for d in "fb":
        back = np.zeros((lanes, h), np.float32)
        for t, state, raw, gate, part, cand, new in reversed(kept[d]):
            grad["v" + d] += new.T @ e[t]
            back = back + e[t] @ p["v" + d].T
            z, r = gate[:, :h], gate[:, h:]
            d_cand = back * z * (1 - cand * cand)
            d_part = d_cand * r
            d_gate = np.concatenate([back * (cand - state), d_cand * part], axis=1) * ((raw > 0) & (raw < 1))
            np.add.at(grad["wg" + d], ids[t], d_gate)
            np.add.at(grad["wc" + d], ids[t], d_cand)
            grad["ug" + d] += state.T @ d_gate
            grad["uc" + d] += state.T @ d_part
            grad["bc" + d] += d_part.sum(axis=0)
            back = back * (1 - z) + d_gate @ p["ug" + d].T + d_part @ p["uc" + d].T
    return loss, grad


def fit(texts: list[str], langs: list[str], steps: int = 160, batch: int = 256, rate: float = 0.02, seed: int = 11) -> BiGRU:
    """Adam over random windows; languages weigh alike."""
    names = sorted(set(langs))
    model = BiGRU.new(names or [UNKNOWN], seed)
    ids, sizes = _windows(texts)
    per = -(-sizes // WINDOW)
    y = np.repeat(np.array([names.index(x) for x in langs], np.int64), per)
    if len(names) < 2 or not len(y):
        return model
    rng = np.random.default_rng(seed)
    share = np.bincount(y, minlength=len(names)) / len(y)
    weight = 1 / np.maximum(share, 1e-9)[y]
    m = {k: np.zeros_like(x) for k, x in model.p.items()}
    s = {k: np.zeros_like(x) for k, x in model.p.items()}
    for step in range(1, steps + 1):
        own = rng.integers(0, len(y), batch)
        _, grad = _step(model, ids[:, own], y[own], weight[own])
        norm = float(np.sqrt(sum((g * g).sum() for g in grad.values())))
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            model.p[k] = (model.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", where: Column | None = None, max_rows: int = MAX_ROWS, max_langs: int = MAX_LANGS) -> BiGRU:
    """Fit on about ``max_rows`` documents of known language at most, shared evenly among the ``max_langs`` most frequent languages.

    The sample goes by a hash of id and text, so that many rows of one id are sampled like others; of each
    sampled text at most MAX_CHARS characters are learned from, a third each from its
    start, middle and end; ``predict`` reads whole texts.
    """
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where("lang is not null and text is not null")
    if where is not None:
        rows = rows.where(where)
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not sizes:
        return fit([], [])
    rate = [(r["lang"], int(min(1_000_000, 1_000_000 * max_rows / len(sizes) / r["count"] + 1))) for r in sizes]
    rates = docs.sparkSession.createDataFrame(rate, "lang string, rate int")
    chosen = rows.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(17)), F.lit(1_000_000)) < F.col("rate"))
    third = MAX_CHARS // 3
    part = F.when(F.length("text") <= MAX_CHARS, F.col("text")).otherwise(F.concat(*[F.substr("text", at, F.lit(third)) for at in (F.lit(1), (F.length("text") / 2).cast("int"), F.length("text") - third)]))
    got = chosen.select("doc_id", part.alias("text"), "lang").toArrow().to_pylist()
    got = sorted((str(r["doc_id"]), r["text"], r["lang"]) for r in got if any(c.isalpha() for c in r["text"]))
    return fit([r[1] for r in got], [r[2] for r in got])


def added(columns: list[str]) -> tuple[str, str]:
    """Names of the columns that ``predict`` adds to a table of these columns."""
    return unused(columns, "lang_pred"), unused(columns, "lang_score")


def predict(docs: DataFrame, model: BiGRU, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (``keep``, else all) with lang_pred and lang_score (double); underscores are appended to a name that is taken."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns if keep is None else keep
    lang, score = added(columns)
    docs = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").cast("string").alias(unused(columns, "__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            names, scores = [], []
            for at in range(0, b.num_rows, 256):
                texts = b.column(b.num_columns - 1)[at : at + 256].to_pylist()
                prob = own.documents(texts)
                for t, q in zip(texts, prob):
                    lettered = t is not None and any(map(str.isalpha, t))
                    best = int(q.argmax())
                    names.append(own.langs[best] if lettered else UNKNOWN)
                    scores.append(min(1.0, max(0.0, float(q[best]))) if lettered and names[-1] != UNKNOWN else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*columns, lang, score])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(run, f"{ddl}, `{lang}` string, `{score}` double" if ddl else f"`{lang}` string, `{score}` double")


def contract(docs: DataFrame) -> DataFrame:
    model = train(docs, where=fold(F.col("doc_id"), 4) != 2)
    found = predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
