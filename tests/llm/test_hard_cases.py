"""Hard cases of the ten operators: repeated and missing ids, clashing names, very long values, limits that bind, naive recomputations."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import langid, lines, packing, pieces, pjpeg, rangecoder, simhash, topk, toxicity, urlfilter
from evidentia.llm.common import unused
from tests.llm.test_ops import brute_components, brute_fingerprint, text, tongue


def at_distance(r, x, n):
    return x ^ sum(1 << k for k in r.sample(range(64), n))


# ---- 1: token files ----


def test_token_files_with_missing_and_repeated_ids(spark):
    d = spark.createDataFrame([(5, "stone"), (None, "river"), (5, "light"), (None, None), (-3, ""), (2**62, "garden")], "doc_id long, text string")
    enc = rangecoder.encoder(rangecoder.TOKENIZER).tokenizer
    size = lambda t: len(enc.encode(t or "", add_special_tokens=False).ids) + 1
    found = rangecoder.digest(rangecoder.encode_column(d)).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, None, -3, 5, 5, 2**62]
    assert Counter(r.n_tokens for r in found) == Counter(size(t) for t in ("stone", "river", "light", None, "", "garden"))
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found]])[:-1].tolist()


# ---- 2: media ----


def naive_planes(coefficients, tables):
    """Inverse transform of one 8 x 8 block by its definition."""
    out = np.zeros((8, 8))
    c = lambda k: math.sqrt(0.5) if k == 0 else 1.0
    block = (coefficients * tables).reshape(8, 8)
    for y in range(8):
        for x in range(8):
            out[y, x] = sum(c(u) * c(v) / 4 * block[v, u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for v in range(8) for u in range(8))
    return out


def test_media_payload_is_the_texts_own(spark):
    texts = ["", None, "short", "é" * 33, "x" * 64, "long line " * 3000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in pjpeg.digest(pjpeg.encode_column(d)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        assert (found[i].n_bytes, found[i].payload_bytes) == (len(raw), len(payload))
        assert found[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and found[i].tail_crc32 == zlib.crc32(payload[-64:])


# ---- 3: packing ----


def words_of(n):
    """A text of exactly n tokens under the packing tokenizer."""
    return " ".join(["stone"] + ["river"] * (n - 1))


@pytest.mark.parametrize(("limits", "sizes", "prompts", "closes"), [((32, 8, 32), [12] * 30, [0] * 30, 0), ((1000, 4, 1000), [5] * 40, [0] * 40, 1), ((64, 16, 16), [3] * 40, [4] * 40, 2)])
def test_each_limit_closes_sequences(spark, limits, sizes, prompts, closes):
    rows = [(i, words_of(n), words_of(p) if p else None) for i, (n, p) in enumerate(zip(sizes, prompts))]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, prompt string").coalesce(1), limits=limits, prompt="prompt", context=0).collect()
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append(r)
    use = [(sum(r.length for r in s), len(s), sum(r.loss_tokens for r in s)) for s in by.values()]
    assert all(u <= limit for own in use for u, limit in zip(own, limits))
    full = [own for own in use if own[closes] >= limits[closes] - (0 if closes else max(sizes))]
    assert len(full) >= len(use) - 1 and all(own[k] < limits[k] for own in use for k in range(3) if k != closes)
    assert sum(r.loss_tokens for r in found) == sum(sizes) + len(sizes)  # every text token and end id, no prompt token


def test_placement_is_the_dot_product_rule():
    """One placement after another against a plain loop over all items."""
    r = np.random.default_rng(5)
    for limits in ((100, 6, 80), (50, 3, 50)):
        tokens = r.integers(1, 45, 60)
        quiet = np.minimum(r.integers(0, 30, 60), tokens)
        got = packing.place(tokens, quiet, limits, cut_from=8)
        items = {i: [0, int(t), int(q)] for i, (t, q) in enumerate(zip(tokens, quiet))}
        want, own, free = [], [], list(limits)
        while items:
            need = {i: (t, 1, t - q) for i, (_, t, q) in items.items()}
            worth = {i: sum(Fraction(n * f, c * c) for n, c, f in zip(x, limits, free)) for i, x in need.items()}
            fit = [i for i, x in need.items() if all(a <= b for a, b in zip(x, free))]
            if fit:
                i = max(fit, key=lambda i: (worth[i], -i))
                own.append((i, items[i][0], items[i][1]))
                free = [f - x for f, x in zip(free, need[i])]
                del items[i]
                continue
            if own and free[1] >= 1:
                i = max(items, key=lambda i: (worth[i], -i))
                room = min(free[0], items[i][2] + free[2])
                if room >= 8:
                    own.append((i, items[i][0], room))
                    items[i] = [items[i][0] + room, items[i][1] - room, max(0, items[i][2] - room)]
            want.append(own)
            own, free = [], list(limits)
        assert got == want + [own] * bool(own)


# ---- 4 and 6: classifiers, recomputed naively ----


def test_toxicity_scores_are_a_plain_convolution(monkeypatch):
    r = random.Random(3)
    texts = [tongue(r, r.choice(["en", "de"]), r.randint(0, 40)) + " vile fool" * (i % 3 == 0) for i in range(200)]
    model = toxicity.fit(texts, [int(i % 3 == 0) for i in range(200)], ["en" if i % 2 else "de" for i in range(200)])
    sample = texts[:40] + ["", None, "unseen words only", "vile", "fool " * 900]

    def naive(t):
        words = re.findall(r"\w+", (t or "").lower())
        vec = [np.zeros(toxicity.DIM)] * toxicity.GAP
        for w in words:
            forms = [w] + [w[:n] + "*" for n in toxicity.PREFIXES if len(w) > n]
            rows = [model.rows.get(zlib.crc32(f.encode()) % toxicity.BUCKETS, 0) for f in forms]
            vec.append(sum((model.emb[k].astype(float) for k in rows if k), np.zeros(toxicity.DIM)))
        vec += [np.zeros(toxicity.DIM)] * (toxicity.GAP + (not words))
        pooled = []
        for f in model.filters:
            width = f.shape[0]
            spans = range(len(vec) - toxicity.GAP)
            pooled += [max(0.0, max(sum(float(vec[s + k] @ f[k, :, c]) for k in range(width)) for s in spans)) for c in range(f.shape[2])]
        return float(np.array(pooled) @ model.out + model.bias - model.shift[model.language(words)])

    got = model.logits(sample)
    assert np.allclose(got, [naive(t) for t in sample], atol=1e-3)
    step, cached = toxicity.STEP, toxicity.CACHED
    monkeypatch.setattr(toxicity, "STEP", 7)  # texts that reach over many steps
    assert np.allclose(model.logits(sample), got, atol=1e-3) and step > 7
    monkeypatch.setattr(toxicity, "CACHED", 50)  # a text of more words than the vocabulary holds
    model.__dict__.pop("vocab", None)
    assert np.allclose(model.logits(sample), got, atol=1e-3) and cached > 50


def test_language_probabilities_are_a_plain_recurrence():
    model = langid.BiGRU.new(["de", "en", "fr"], 5)
    p, h = {k: x.astype(float) for k, x in model.p.items()}, langid.HIDDEN
    texts = ["a", "der Fluß " * 30, "x" * 64, "le chat " * 8, "", None, "z" * 65]

    def naive(t):
        raw, total = (t or "").encode(), np.zeros(3)
        for at in range(0, len(raw), langid.WINDOW):
            ids = list(raw[at : at + langid.WINDOW])
            n = len(ids)
            ids += [langid.PAD] * (langid.WINDOW - n)
            z = np.zeros((langid.WINDOW, 3)) + p["b"]
            for d, order in (("f", range(langid.WINDOW)), ("b", reversed(range(langid.WINDOW)))):
                state = np.zeros(h)
                for i in order:
                    gate = np.clip(p["wg" + d][ids[i]] + state @ p["ug" + d], 0, 1)
                    cand = np.tanh(p["wc" + d][ids[i]] + gate[h:] * (state @ p["uc" + d] + p["bc" + d]))
                    state = state + gate[:h] * (cand - state)
                    z[i] += state @ p["v" + d]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            total += (e / e.sum(axis=1, keepdims=True))[:n].sum(axis=0)
        return total / max(1, len(raw))

    assert np.allclose(model.documents(texts), [naive(t) for t in texts], atol=1e-4)


def test_classifiers_on_dirty_tables(spark):
    r = random.Random(4)
    rows = [(7 if i % 2 else i, tongue(r, "en" if i % 3 else "de", 20), "en" if i % 3 else "de") for i in range(300)]
    rows += [(1000 + i, "junk words", f"value {i}") for i in range(400)]  # a column of free text is no set of classes
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(d, max_rows=100, max_langs=2)
    assert model.langs == ["de", "en"]
    clash = d.withColumn("lang_pred", F.lit("mine")).withColumn("Lang_Score", F.lit(9)).withColumn("tox_score", F.lit("s")).withColumn("tox_predicted", F.lit(5)).withColumn("__text", F.lit(0))
    found = langid.predict(clash, model)
    assert found.columns == [*clash.columns, "lang_pred_", "lang_score_"] and found.where("lang_pred = 'mine' and lang_pred_ in ('de', 'en')").count() == 700
    labels = d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).distinct()
    scorer = toxicity.train(d, labels)
    again = toxicity.train(d.repartition(7), labels)
    assert (scorer.emb == again.emb).all() and scorer.bias == again.bias
    found = toxicity.score(clash, scorer)
    assert found.columns[-2:] == ["tox_score_", "tox_predicted_"] and found.where("tox_predicted = 5 and tox_predicted_ in (0, 1)").count() == 700
    assert unused(["a", "A_"], "a") == "a__"


# ---- 5: lines ----


def test_lines_with_clashing_names_and_repeated_ids(spark):
    boiler = "please read the terms of this site"
    rows = [(i // 2, f"{boiler}\n{'abcdefghij'[i]} line of this row alone", "u") for i in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_lines string").withColumn("__doc", F.lit(1)).withColumn("__n", F.lit(2)).withColumn("__gone", F.lit(3)).withColumn("__drop", F.lit(4)).withColumn("N_Dropped", F.lit(5))
    found = lines.dedup(d)
    assert found.columns == [*d.columns, "n_lines_", "n_dropped_"]
    got = found.collect()
    assert all((r["__doc"], r["__n"], r["__gone"], r["__drop"], r["N_Dropped"], r["n_lines"], r["n_lines_"]) == (1, 2, 3, 4, 5, "u", 2) for r in got)
    assert all(r["n_dropped_"] == int(r.doc_id != 0) for r in got) and len(got) == 10


# ---- 7: pieces ----


def as_unigram(model: bytes) -> bytes:
    """The same vocabulary with field 3 (model_type) of field 2 (trainer_spec) set to 1, and scores like logarithms of probabilities."""
    out = b""

    def varint(n):
        raw = b""
        while n > 127:
            raw, n = raw + bytes([n & 127 | 128]), n >> 7
        return raw + bytes([n])

    for number, value in pieces._fields(model):
        if number == 2:
            spec, last = b"", 0
            raw = value
            while last < len(raw):
                tag, nxt = pieces._varint(raw, last)
                if tag & 7 == 0:
                    v, end = pieces._varint(raw, nxt)
                    spec += varint(tag) + varint(1 if tag >> 3 == 3 else v)
                else:
                    size, begin = pieces._varint(raw, nxt) if tag & 7 == 2 else ((8, nxt) if tag & 7 == 1 else (4, nxt))
                    end = begin + size
                    spec += raw[last:end]
                last = end
            value = spec
        if number == 1 and len(value) > 5 and value[-7:-6] == b"\x15" or number == 1 and value[-5:-4] == b"\x15":
            at = len(value) - (6 if value[-7:-6] == b"\x15" else 4)  # the score, with or without a type behind it
            score = max(struct.unpack_from("<f", value, at)[0], -30000.0) / 1000 - 1
            value = value[:at] + struct.pack("<f", score) + value[at + 4 :]
        out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def test_unigram_model_is_a_viterbi_search(tmp_path):
    import public_tokenizers
    import sentencepiece

    path = f"{tmp_path}/unigram.model"
    with open(public_tokenizers.path(pieces.MODEL), "rb") as f, open(path, "wb") as g:
        g.write(as_unigram(f.read()))
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.pieces(path)
    assert own.unigram and not pieces.pieces().unigram
    r = random.Random(6)
    texts = ["", "the market river", "a\n\nb  c", "日本語 x", "😀"] + ["".join(r.choices(list("aeinrst  \nÉß中1.,"), k=r.randint(1, 40))) for _ in range(300)]
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(t), t

    def best(word):
        """The best sum over all segmentations."""
        if not word:
            return 0.0
        return max(best(word[:-n]) + own.score.get(word[-n:], own.floor) for n in range(1, len(word) + 1) if n == 1 or word[-n:] in own.score)

    words = sorted({"".join(r.choices("aeinrst", k=r.randint(1, 9))) for _ in range(80)} | {"in", "inside", "insider"})
    for w, found in zip(words, own.words(words)):
        assert "".join(found) == w and abs(sum(own.score.get(p, own.floor) for p in found) - best(w)) < 1e-3 * abs(best(w))


# ---- 8: addresses ----


def test_very_long_address(spark):
    urls = ["http://h.example/" + "ab/" * 40000, "http://" + "h" * 100000, None, "x" * 200000]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    urlfilter.judge(rows.limit(1)).collect()
    began = time.time()
    found = {r.page_id: r for r in urlfilter.judge(rows).collect()}
    assert time.time() - began < 8
    bias, w = urlfilter.weights()
    for r in found.values():
        assert r.logit == bias + sum(w[i] for i in urlfilter._features_py(r.host, r.path) if r.host or r.path)
    odd = spark.createDataFrame([(1, "http://é😀.example/中\n文?"), (1, "http://é😀.example/中\n文?")], "page_id long, url string")
    found = urlfilter.judge(odd).collect()
    assert len(found) == 2 and all(r.logit == bias + sum(w[i] for i in urlfilter._features_py(r.host, r.path)) for r in found)


# ---- 9: SimHash ----


def test_links_through_rows_without_an_id(spark, monkeypatch):
    r = random.Random(11)
    base = [r.getrandbits(64) for _ in range(30)]
    rows = []
    for b in base:  # chains a - b - c whose middle often has no id, or one that stands elsewhere too
        mid = at_distance(r, b, 3)
        rows += [(r.randrange(1000), b), (r.choice([None, 7, r.randrange(1000)]), mid), (r.choice([None, r.randrange(1000)]), at_distance(r, mid, 3))]
    rows += [(None, base[0]), (None, 0), (1, 7), (None, 63)]
    d = spark.createDataFrame([(i, i_ - 2**64 if i_ >= 2**63 else i_) for i, i_ in rows], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "with_fingerprint", lambda docs, *_: docs.select("doc_id", F.col("text").cast("long").alias("fp")))
    found = simhash.near_duplicates(d.select("doc_id", F.col("fp").cast("string").alias("text"))).collect()
    label = brute_components([(n, fp) for n, (_, fp) in enumerate(rows)])
    ids = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        ids[label[n]].append(i)
    want = Counter((i, fp, min((x for x in ids[label[n]] if x is not None), default=None)) for n, (i, fp) in enumerate(rows))
    assert Counter((x.doc_id, x.fp % 2**64, x.component_id) for x in found) == want


def test_one_row_of_each_group_stays(spark):
    r = random.Random(12)
    long = [text(r, 60) for _ in range(5)]
    rows = [(1, long[0]), (1, long[1]), (2, long[0]), (None, long[2]), (None, long[2]), (None, long[3]), (3, long[3]), (4, None), (5, ""), (6, long[4])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("best_id", F.lit(1)).withColumn("component", F.lit(2))
    found = simhash.one_of_each(d)
    assert found.columns == d.columns
    got = Counter((x.doc_id, x.text) for x in found.collect())
    assert len({brute_fingerprint(t) for t in long}) == 5
    assert got == Counter([(1, long[0]), (1, long[1]), (None, long[2]), (3, long[3]), (4, None), (6, long[4])])
    assert simhash.one_of_each(d.limit(0)).count() == 0


# ---- 10: top-k ----


def test_topk_of_repeated_rows_and_ids(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(0, 1, 6)]) for i in range(60)]
    rows += [(0, rows[0][1]), (0, [3.0] * 6), (5, rows[5][1]), (100, [1.0] * 6), (100, [1.0] * 6), (200, [0.0] * 6), (300, [1.0, 2.0]), (300, [2.0, 1.0]), (None, [9.0] * 6)]
    monkeypatch.setattr(topk, "GROUP", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "CHUNK", 4)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = topk.top_k(d, d.where("vec_id % 100 = 0"), 10).collect()
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None]
    want = Counter()
    for n, (i, q) in enumerate(good):
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(good) if m != n and len(v) == len(q))[:10]
            want.update((i, k, j, -s) for k, (s, j) in enumerate(scores, 1))
    assert Counter((x.query_id, x.rank, x.vec_id, x.score) for x in found) == want
    others = topk.top_k(d, d.where("vec_id = 200"), 3, own=False).collect()  # zero scores tie: the smallest ids
    assert sorted((x.rank, x.vec_id) for x in others) == [(1, 0), (2, 0), (3, 0)]


# ---- the pipeline's stages ----


def test_stages_on_hard_tables(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    r = random.Random(5)
    rows = [(1, "the garden and the river of stone " + text(r, 40), "en", "a", 1), (1, "another text of the silent market " + text(r, 40), "en", "a", 2), (None, "the bread and the winter light " + text(r, 40), None, None, None)]
    rows += [(None, None, None, None, None), (4, "", "en", None, 0), (1, rows[0][1], "en", "a", 1), (9, "the window of the number " + "bread and copper " * 20000, "en", "b", 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("lang_pred", "lang_score", "tox_score", "tox_predicted", "n_lines", "n_dropped", "fp", "best_fp", "__text", "component"):
        d = d.withColumn(c, F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, d, sf)
        assert kept.columns == d.columns and kept.where("lang_pred <> 'mine' or n_dropped <> 'mine'").count() == 0, name
        assert stage(spark, d.limit(0), sf).count() == 0, name
    texts = {x.text for x in corpus_pipeline.near_dedup(spark, d, sf).collect()}
    assert {rows[0][1], rows[1][1], rows[2][1], rows[6][1]} <= texts
    packed = corpus_pipeline.pack(spark, d, sf)
    assert packed.where("start = 0").count() == len(rows) and corpus_pipeline.pack(spark, d.limit(0), sf).count() == 0


def test_toxicity_learns_from_bounded_bytes_in_bounded_memory(spark, monkeypatch):
    import tracemalloc

    seen = []
    real = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda t, y, x: seen.append((t, y)) or real(t, y, x))
    monkeypatch.setattr(toxicity, "MAX_BYTES", 6000)
    rows = [(i, ("you idiot " if i % 3 == 0 else "fine day ") * (5000 if i in (4, 9) else 10)) for i in range(200)]
    d = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    (texts, y), known = seen[0], {t for _, t in rows}
    assert sum(map(len, texts)) <= 6000 and min(Counter(y)[0], Counter(y)[1]) >= 25 and set(texts) <= known  # whole ones
    found = toxicity.score(d, model).collect()
    assert len(found) == 200 and all(r.tox_predicted == int(r.doc_id % 3 == 0) for r in found)
    assert sorted(toxicity._within([("a", 0, 9), ("b", 1, 99), ("c", 1, 98)], 10)) == ["a", "c"]  # none fits: the shortest
    # words are numbered text by text, not held beside one another
    monkeypatch.setattr(toxicity, "CACHED", 10_000)
    texts = [" ".join(f"w{(i * j) % 997}" for j in range(2000)) for i in range(1, 121)]
    tracemalloc.start()
    real(texts, [i % 2 for i in range(120)], ["en"] * 120, epochs=0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 14e6, peak


def test_sentencepiece_tries_only_lengths_that_pieces_have():
    import public_tokenizers
    import sentencepiece

    class Counted(dict):
        tried = 0

        def get(self, key):
            self.tried += 1
            return super().get(key)

    own = pieces.Pieces(pieces.MODEL)
    assert all(len(p) < 3 or len(p) in own.lengths[p[-3:]] for p in own.ids)
    rng = random.Random(5)
    syllables = ["th", "ing", "er", "einsch", "ó", "ß", "tion", "qu", "ña", "&", "7", "x", "ꙮ"]
    texts = [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 6))) for _ in range(40)) for _ in range(50)]
    own.score = Counted(own.score)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    assert own.encode(texts) == [struct.pack(f"<{len(x)}I", *x) for x in library.encode(texts)]
    marked = {w for t in texts for w in re.findall(" [^ ]+", " " + t)}
    assert own.score.tried < 4 * sum(map(len, marked)), own.score.tried / sum(map(len, marked))


def test_tokenizer_looks_each_chunk_up_once(monkeypatch):
    from evidentia.llm import tokens

    rng = random.Random(6)
    words = ["".join(rng.choices(["th", "ing", "É", "ß", "er", "Qu", "7", ","], k=rng.randint(1, 6))) for _ in range(400)]
    texts = [None, "", "  a  b\n\n c \n\t d  x's don't 12  ", *("".join(w + rng.choice([" ", " ", "\n", "  "]) for w in rng.choices(words, k=60)) for _ in range(300))]
    monkeypatch.setattr(tokens, "KEPT", 150)  # so that older generations are asked, and words forgotten
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = tokens.Encoder(name)
        asked = []
        real = own.fresh
        monkeypatch.setattr(own, "fresh", lambda c: asked.append(c) or real(c), raising=False)
        ids = [x for at in range(0, len(texts), 20) for x in own.encode(texts[at : at + 20])]
        assert ids == [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in own.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert asked and len(own.known) < 2000


def test_placing_forgets_what_is_placed(monkeypatch):
    rng = np.random.default_rng(8)
    tokens = rng.integers(1, 1024, 600)
    quiet = np.minimum(tokens, rng.integers(0, 40, 600))
    sizes = []
    real = np.where
    monkeypatch.setattr(packing.np, "where", lambda c, *a: sizes.append(len(c)) or real(c, *a))
    found = packing.place(tokens, quiet, (1024, 64, 1020))
    monkeypatch.undo()
    held = defaultdict(list)
    for own in found:
        assert sum(n for _, _, n in own) <= 1024 and len(own) <= 64
        for i, at, n in own:
            held[i].append((at, n))
    for i, n in enumerate(tokens.tolist()):
        at = 0
        for a, k in sorted(held[i]):
            assert a == at
            at += k
        assert at == n
    assert sum(sizes) < 0.8 * 600 * len(sizes)  # the pool's arrays grow shorter


def test_words_are_tokenized_once_in_any_case():
    from evidentia.llm import tokens

    own = tokens.Encoder(rangecoder.TOKENIZER)
    called, ids_of = [], own._ids
    own._ids = lambda chunk: called.append(chunk) or ids_of(chunk)
    texts = ["Lantern lantern LANTERN, x", None, "", " \n ", "lantern\x0blantern\x0cé É a b\x1cc  don't", "Lantern. lantern!"]
    expected = [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [list(np.frombuffer(x, "<u4")) for x in own.encode(texts)] == expected
    assert sum(c.lower() == b"lantern" for c in called) == 1 and len(called) == len(set(called))
    called.clear()
    own.encode(["Lantern? (LANTERN) lantern7", "q1 q2 q3 q4"])  # letters are parted from what follows them
    assert b"lantern" not in called and own.known.keys() >= {b"q", b"7", b"4"} and b"q4" not in own.known
    r = random.Random(8)
    odd = ["H\u0331", "h\u0331", "W\u030a.", "<|endoftext|>", "<|EndOfText|>", "don'T", "X'S", "é", "É.", "\u212a", "\u0130", "x1Y", "aΣ.Σb", "日本,A", " ", "\n", "\x1c", "\u00a0", "A", "b", "!", "\ud800", "ẖ"]
    texts = ["".join(r.choices(odd, k=r.randint(0, 7))) for _ in range(1500)]
    for k in (1, 40):
        found = [list(np.frombuffer(x, "<u4")) for at in range(0, len(texts), k) for x in own.encode(texts[at : at + k])]
        assert found == [own.tokenizer.encode(t.encode("utf-8", "replace").decode(), add_special_tokens=False).ids for t in texts]


def test_coder_learns_from_many_ids_at_a_time(monkeypatch):
    mixed, own = [], rangecoder._Model._mix
    monkeypatch.setattr(rangecoder._Model, "_mix", lambda self, n: mixed.append(n) or own(self, n))
    rng = np.random.default_rng(5)
    for bits in (1, 7, 15, 16, 17, 30):
        alphabet = 1 << bits
        blocks = [(rng.integers(0, alphabet, n) if k % 2 else np.arange(n) * 7 % min(alphabet, 30)).astype(np.int32) for k, n in enumerate([rangecoder.BLOCK, rangecoder.BLOCK, 1, 17, 300])]
        mixed.clear()
        coded = rangecoder.encode_blocks(blocks, alphabet)
        assert len(mixed) <= 5 + rangecoder.BLOCK // 100
        assert all((a == b).all() for a, b in zip(rangecoder.decode_blocks(coded, [len(b) for b in blocks], alphabet), blocks))
        assert [rangecoder.encode_blocks([b], alphabet)[0] for b in blocks] == coded
        assert len(coded[0]) < rangecoder.BLOCK / 6
