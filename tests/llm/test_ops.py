"""The ten operators against brute force, round trips and held-out accuracy, with edge cases."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evidentia.llm import langid, lines, packing, pieces, pjpeg, rangecoder, simhash, topk, toxicity, urlfilter
from evidentia.llm.tokens import encoder

WORDS = "the of and river stone light winter garden market number silent window bread copper morning paper train engine".split()
ODD = ["", " ", "  b", "a", "a\n\nb", "x" * 5000, "日本語 テスト 漢字", "😀 x😀y", "\t a\t", "x     y      z", "é ́.", "it's we'll 'tis", "a\xa0 b\xa0\xa0 c", "100 2,000.5 x1y2", "İSTANBUL ΣΑΣ", "…. ÷×a÷b"]


def text(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    base = [text(r, r.randint(1, 120)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base + ODD + [None, base[0], base[0], base[1] + " end", base[2]])]
    rows.append((3, base[3]))  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def clash(df):
    """Extra columns whose names an operator might use itself."""
    return df.withColumn("fp", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("media", F.lit("m")).withColumn("label", F.lit(0))


# ---- 1: token files ----


def test_token_files(spark, docs, empty):
    found = rangecoder.digest(rangecoder.encode_column(clash(docs))).collect()
    enc = encoder(rangecoder.TOKENIZER).tokenizer
    want, start = [], 0
    for i, t in sorted((r.doc_id, r.text or "") for r in docs.collect()):
        ids = enc.encode(t, add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in found) == want
    assert rangecoder.encode_column(empty).count() == 0


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for sizes, alphabet in (([5, 1, 0, rangecoder.BLOCK, 100], 50), ([1], 1), ([rangecoder.BLOCK] * 2, 49408), ([rangecoder.BLOCK, 700], 1 << 30)):
        blocks = [rng.integers(0, alphabet, n).astype(np.int32) for n in sizes]
        back = rangecoder.decode_blocks(rangecoder.encode_blocks(blocks, alphabet), sizes, alphabet)
        assert all((a == b).all() for a, b in zip(blocks, back))
    # a block is coded alike in any company
    skewed = [np.minimum(rng.geometric(0.02, 2000), 9999).astype(np.int32) for _ in range(40)]
    coded = rangecoder.encode_blocks(skewed, 10000)
    assert all((rangecoder.decode_blocks([c], [2000], 10000)[0] == b).all() and rangecoder.encode_blocks([b], 10000) == [c] for c, b in zip(coded, skewed))
    ids = np.tile(np.arange(50, dtype="<u4"), 100).tobytes()
    record = rangecoder.write_records([([7], [ids])])[0]
    assert rangecoder.read_records([record]) == [([7], [ids])] and len(record) < len(ids) / 8
    with pytest.raises(ValueError):
        rangecoder.read_records([record[:-40] + bytes(x ^ 85 for x in record[-40:])])
    many = np.arange(70000, dtype="<u4").tobytes()  # more ids than 16 bits tell apart
    assert rangecoder.read_records(rangecoder.write_records([([1], [many])])) == [([1], [many])]


def test_chunked_encoding_is_the_librarys():
    r = random.Random(5)
    alphabet = list("aZé'.,;-  \n\t1٣ßÿ÷×́\xa0“”中İσΣ<|>")
    texts = ODD + ["<|endoftext|> a <|endoftext|>b"] + ["".join(r.choices(alphabet, k=r.randint(1, 40))) for _ in range(400)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = encoder(name)
        assert e.direct
        for t, ids in zip(texts, e.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, (name, t)


# ---- 2: media ----


def test_media(docs, empty):
    found = {(r.doc_id, r.media_sha256): r for r in pjpeg.digest(pjpeg.encode_column(clash(docs))).collect()}
    by_text = defaultdict(set)
    for d in docs.collect():
        n, payload = pjpeg.unit_payload(d.text)
        own = [r for (i, _), r in found.items() if i == d.doc_id and r.n_bytes == n]
        assert own and own[0].payload_bytes == len(payload) and own[0].tail_crc32 == zlib.crc32(payload[-64:])
        by_text[d.text or ""].add((own[0].media_sha256, own[0].feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert pjpeg.digest(pjpeg.encode_column(empty)).count() == 0


def test_jpeg_payload_and_general_scans():
    r = np.random.default_rng(2)
    for n in (1, 5, 6, 7, 400):
        payload = r.integers(0, 256, 64 * n).astype(np.uint8).tobytes()
        assert pjpeg.payload_of(pjpeg.decode(pjpeg.encode_payload(payload))) == payload
    # a plain grey picture with DC alone, and one AC band with runs, refined later
    block = [np.zeros((1, 64), np.int16)]
    bits = pjpeg._Bits(b"\x00" * 8)
    table = pjpeg._huffman(bytes([0, 4] + [0] * 14), bytes([0x00, 0x01, 0x11, 0xF0]))  # 2-bit codes
    coded = "01" + "1" + "10" + "0" + "00"  # k=1: +1; one zero, k=3: -1; end of band
    bits = pjpeg._Bits(int(coded.ljust(16, "0"), 2).to_bytes(2, "big"))
    pjpeg._ac_first(bits, table, block[0], np.array([0]), 1, 63, 1)
    assert block[0][0, 1] == 2 and block[0][0, 3] == -2 and np.count_nonzero(block[0]) == 2
    # refinement: a new coefficient after one zero of history, then corrections in the end-of-band run
    coded = "01" + "1" + "1" + "00" + "1"  # first 1-symbol: sign +, correction of k=1 passed over, lands on k=2; then EOB and k=3's bit
    bits = pjpeg._Bits(int(coded.ljust(16, "0"), 2).to_bytes(2, "big"))
    pjpeg._ac_refine(bits, table, block[0], np.array([0]), 1, 63, 0)
    assert block[0][0, 1] == 3 and block[0][0, 2] == 1 and block[0][0, 3] == -3
    with pytest.raises(ValueError):
        pjpeg.decode(b"no picture")


def test_tensors(spark, docs):
    found = pjpeg.decode_column(pjpeg.encode_column(docs.limit(5))).collect()
    assert all(len(r.rgb) == r.height * r.width * 3 for r in found)
    bad = spark.createDataFrame([(1, b"x"), (2, None)], "doc_id long, media binary")
    assert all(r.rgb is None for r in pjpeg.decode_column(bad).collect())


# ---- 3: packing ----


def test_packing(docs, empty):
    rows = packing.pack(clash(docs), with_ids=True).collect()
    enc = encoder(packing.TOKENIZER).tokenizer
    pieces_of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces_of[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    want = Counter()
    for d in docs.collect():
        want[(d.doc_id, len(enc.encode(d.text or "", add_special_tokens=False).ids) + 1)] += 1
    got = Counter((i, p.doc_tokens) for i, ps in pieces_of.items() for p in ps if p.start == 0)
    assert got == want and sum(r.length for r in rows) == sum(n * c for (_, n), c in want.items())
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and zlib.crc32(r.ids) == r.ids_crc32
            at += r.length
        assert at <= 1024 and len(own) <= packing.SEGMENTS
    assert packing.pack(empty).count() == 0


def test_vector_limits():
    r = np.random.default_rng(4)
    n = r.integers(1, 100, 300)
    quiet = np.maximum(n - 60, (n * r.random(300)).astype(np.int64))
    out = packing.place(n, quiet, (100, 4, 60), cut_from=None)
    assert sorted(i for s in out for i, _, _ in s) == list(range(300))
    for s in out:
        assert sum(k for _, _, k in s) <= 100 and len(s) <= 4 and sum(n[i] - quiet[i] for i, _, _ in s) <= 60


# ---- 4 and 6: classifiers ----

TONGUES = {"en": "the and of tion ing er re", "de": "der die und ung keit ein ich", "fr": "le la des eau oi ère que"}


def tongue(r: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(r.choices(TONGUES[lang].split(), k=r.randint(1, 2))) for _ in range(n))


def test_toxicity(spark):
    r = random.Random(8)
    rows = []
    for i in range(700):
        lang, bad = r.choice(list(TONGUES)), i % 4 == 0
        w = tongue(r, lang, r.randint(5, 80)).split()
        for _ in range(3 * bad):
            w.insert(r.randrange(len(w) + 1), r.choice(["vile", "rotten", "fool"]))
        rows.append((i, " ".join(w), lang, int(bad)))
    rows += [(700, None, None, 0), (701, "", "en", 0), (702, "a " * 30000, "en", 0), (1, rows[1][1], rows[1][2], rows[1][3])]
    d = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(x[0], x[3]) for x in rows] + [(9999, 1), (5, None)], "doc_id long, toxic int")
    found = toxicity.contract(d, labels).collect()
    truth = {x[0]: x[3] for x in rows}
    assert len(found) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in found)
    held = [x for x in found if x.held_out and x.doc_id < 700]
    assert sum(x.predicted == truth[x.doc_id] for x in held) / len(held) > 0.95
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in found)
    none = toxicity.contract(d.limit(3), labels.limit(0)).collect()
    assert len(none) == 3 and toxicity.contract(d.limit(0), labels).count() == 0


def test_language(spark):
    r = random.Random(9)
    rows = [(i, tongue(r, lang, r.randint(8, 60)), lang) for i, lang in enumerate(r.choices(list(TONGUES), k=500))]
    rows += [(500, None, "en"), (501, "", "de"), (502, "12 34 !?", "fr"), (503, "the and " * 9000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x"))
    found = {x.doc_id: x for x in langid.contract(d).collect()}
    assert [found[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and found[503].lang_pred == "en"
    held = [i for i in range(500) if found[i].held_out]
    assert sum(found[i].lang_pred == rows[i][2] for i in held) / len(held) > 0.95
    model = langid.fit([x[1] for x in rows[:300]], [x[2] for x in rows[:300]], steps=60)
    assert len(model.label("der die und é")) == len("der die und é".encode())
    assert langid.contract(d.limit(0)).count() == 0 and {x.lang_pred for x in langid.contract(d.limit(4).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_gradients():
    model = langid.BiGRU.new(["a", "b"], 1)
    model.p = {k: x.astype(np.float64) for k, x in model.p.items()}
    rng = np.random.default_rng(0)
    ids, y, w = rng.integers(0, 256, (5, 3)), np.array([0, 1, 1]), np.ones(3)
    _, grad = langid._step(model, ids, y, w)
    for name in ("ucf", "vb", "ugb", "bcf"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        eps, keep = 1e-3, model.p[name][at]
        model.p[name][at] = keep + eps
        up = langid._step(model, ids, y, w)[0]
        model.p[name][at] = keep - eps
        down = langid._step(model, ids, y, w)[0]
        model.p[name][at] = keep
        assert abs((up - down) / (2 * eps) - grad[name][at]) < 1e-3 + 0.02 * abs(grad[name][at])


# ---- 5: lines ----


def brute_lines(rows):
    import re

    occurrences = []
    for i, t in rows:
        for no, line in enumerate(t.split("\n") if t is not None else ()):
            w = [x for x in re.split("[ \t\r\f\x0b]+", re.sub("[0-9]+", "<*>", line)) if x]
            if len(w) >= 5:
                occurrences.append((i, no, tuple(w)))
    leaves, drop = defaultdict(list), set()
    for o in occurrences:
        leaves[(len(o[2]), o[2][:3])].append(o)
    for own in leaves.values():
        if len({o[0] for o in own}) < 3:
            continue
        ids = defaultdict(set)
        for i, _, w in own:
            ids[w].add(i)
        support = Counter()
        for w, s in ids.items():
            for p, x in enumerate(w):
                support[p, x] += len(s)
        templates = defaultdict(list)
        for i, no, w in own:
            constant = tuple((p, x) for p, x in enumerate(w) if support[p, x] >= 3)
            if len(constant) >= 0.75 * len(w):
                templates[constant].append((i, no))
        for found in templates.values():
            if len({i for i, _ in found}) >= 3:
                drop |= set(found) - {min(found)}
    return {i: None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in drop) for i, t in rows}


def test_lines(spark, empty):
    r = random.Random(6)
    common = ["terms of use apply to page 12 today", "all rights reserved by the river company"]
    rows = []
    for i in range(60):
        own = [text(r, r.randint(1, 9)) for _ in range(5)]
        if i % 3:
            own.insert(2, common[0].replace("12", str(i)))
        if i % 4 == 0:
            own.append(common[1])
        if i % 5 == 0:
            own.append(f"user {r.choice(['ann', 'bob', 'cyd'])} of the silent market logged in again today")
        rows.append((i, "\n".join(own)))
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, rows[0][1]), (64, rows[0][1]), (65, common[0] + "\n" + "w " * 20000)]
    found = lines.dedup(clash(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want = brute_lines(rows)
    assert {x.doc_id: x.text for x in found} == want and sum(x.n_dropped for x in found) > 50
    assert all(x.fp == "x" for x in found) and lines.dedup(empty).count() == 0


def test_lines_of_frequent_field_values(spark):
    """A template's fields stay variable as the corpus grows; only its first line is kept."""
    names, cities = [f"name{chr(97 + i)}" for i in range(20)], [f"city{chr(97 + i)}" for i in range(20)]
    for n in (20, 100, 400):
        rows = [(i, f"Posted today by {names[i % 20]} from {cities[(7 * i + i // 20) % 20]} office desk\nown{chr(97 + i % 26)} line") for i in range(n)]
        # beside it, in the same leaf, a rarer template with constants of its own
        rows += [(n + i, f"Posted today by staff {cities[i]} late shift team") for i in range(4)]
        found = {x.doc_id: x.n_dropped for x in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert found == {i: int(i not in (0, n)) for i in range(n + 4)}, n


def test_lines_in_two_documents_and_short_ones(spark, tmp_path):
    from evidentia.llm import entries

    rows = ["All rights reserved.\nthe silent river winds past 12 old mills\nPage 1", "own words\nthe silent river winds past 7 old mills\nAll  rights reserved.", "Page 2\nAll rights reserved.\nAll rights reserved.", "Page 3\nnothing that comes again in here", "Page 2", None, "\n"]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {x.doc_id: (x.text, x.n_dropped) for x in entries.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert found == {0: (rows[0], 0), 1: ("own words", 2), 2: ("Page 2", 2), 3: (rows[3], 0), 4: ("", 1), 5: (None, 0), 6: ("\n", 0)}


# ---- 7: pieces ----


def test_pieces(docs, empty):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    r = random.Random(2)
    texts = ODD + ["".join(r.choices(list("abcdefgh  \nÉß中1.,"), k=r.randint(1, 60))) for _ in range(300)]
    own = pieces.pieces()
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(t) and own.decode(ids) == t
    found = {(x.doc_id, x.n_tokens) for x in pieces.digest(clash(docs)).collect()}
    assert found == {(d.doc_id, len(sp.encode(d.text or ""))) for d in docs.collect()} and pieces.digest(empty).count() == 0


# ---- 8: addresses ----


def test_urls(spark):
    urls = ["https://A.Example.NET/en/1?x#y", "http://example.net/de", "https://m.example.com/de/9", "https://x.org/fr/1", "https://notexample.com/de/", "no scheme", None, "://", "http://h?/q", "http://net/", "ftp://a.netx/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    found = {r.page_id: r for r in urlfilter.judge(rows).collect()}
    assert [found[i].rule for i in range(len(urls))] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None, None, "net/", None]
    assert (found[0].host, found[0].path) == ("a.example.net", "/en/1") and (found[8].host, found[8].path) == ("h", "")
    bias, w = urlfilter.weights()
    for r in found.values():
        logit = bias + sum(w[i] for i in urlfilter._features_py(r.host, r.path))
        assert r.logit == logit and (r.rule or r.verdict == ("block" if logit >= 0 else "allow"))
    assert all((bias + sum(w[i] for i in urlfilter._features_py(h, p)) >= 0) == bool(y) for h, p, y in urlfilter.LABELLED if "?" not in p)


# ---- 9: SimHash ----


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """pairs: (doc_id, fingerprint)."""
    parent = {i: i for i, _ in pairs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in pairs:
        for j, b in pairs:
            if (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in pairs}


def test_simhash(docs, empty):
    found = simhash.digest(simhash.near_duplicates(clash(docs))).collect()
    pairs = [(d.doc_id, brute_fingerprint(d.text)) for d in docs.collect()]
    assert Counter((r.doc_id, int(r.fingerprint, 16)) for r in found) == Counter(pairs)
    want = brute_components(pairs)
    assert all(want[r.doc_id] == r.component_id for r in found)
    assert simhash.digest(simhash.near_duplicates(empty)).count() == 0


def test_simhash_links_in_large_buckets(spark, monkeypatch):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(40)]
    fps += [(base[0] & (2**32 - 1)) | r.getrandbits(32) << 32 for _ in range(900)]  # one half in common
    fps = list(dict.fromkeys(fps))
    rows = spark.createDataFrame([(i, x - 2**64 if x >= 2**63 else x) for i, x in enumerate(fps)], "node long, fp long")
    pairs = simhash.links(rows).collect()
    u = lambda x: x % 2**64
    assert all(0 < (u(p.a) ^ u(p.b)).bit_count() <= 3 for p in pairs)
    at = {x: i for i, x in enumerate(fps)}
    edges = spark.createDataFrame([(at[u(p.a)], at[u(p.b)]) for p in pairs], "u long, v long")
    got = {r.node: r.component for r in simhash.components(rows.select("node"), edges).collect()}
    assert got == brute_components(list(enumerate(fps)))


def test_rows_without_an_id(spark):
    d = spark.createDataFrame([(None, "the and of river", "en"), (None, None, None), (1, "the and of stone", "en"), (2, "der die und ich", "de")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert pjpeg.digest(pjpeg.encode_column(d)).count() == packing.pack(d).count() == lines.dedup(d).count() == pieces.digest(d).count() == 4
    assert toxicity.contract(d, labels).where("held_out is not null").count() == langid.contract(d).where("held_out is not null").count() == 4
    assert simhash.digest(simhash.near_duplicates(d)).where("fingerprint is not null").count() == 4
    assert rangecoder.digest(rangecoder.encode_column(d)).count() == 4


# ---- 10: top-k ----


def test_topk(spark):
    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in r.normal(0, 1, 8)]) for i in range(400)]
    rows += [(400, rows[0][1]), (500, rows[1][1]), (600, [float("nan")] * 8), (700, None), (800, [None] + [1.0] * 7), (401, [0.0] * 8), (402, [1.0, 2.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    found = defaultdict(list)
    for x in topk.top_k(d, d.where("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        found[x.query_id].append((x.rank, x.vec_id, x.score))
    good = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in good if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:10]
        assert found[q] == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert set(found) == {i for i in good if i % 100 == 0}
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [3e12, 1.0])], "vec_id long, embedding array<double>")
    assert [(x.vec_id, x.score) for x in topk.top_k(huge, huge.where("vec_id = 0"), 10).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, 2**63 - 1)]
    few = d.where("vec_id < 3 or vec_id = 400")
    assert len([x for x in topk.top_k(few, few.where("vec_id = 400"), 10).collect()]) == 3 and topk.top_k(d.limit(0), d.limit(0)).count() == 0
