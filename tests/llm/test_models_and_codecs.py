"""Tokens, packing, WebP, the classifier and language models; held-out accuracy and exact round trips."""

import hashlib
import random
import sys
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from casewright.llm import bpe_trees, language_id, packing, quality_classifier, queries, tokens, webp
from casewright.llm.common import BATCH_BYTES, fold, table

SF = "/root/testdata/sf0.01"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "it's DON'T we'll x²y ½ A.B!?", "<|endoftext|> Straße ÀÉ ǅ İx", "日本語 ’ café", "a\u0085b c\x1cd", "ΣΑΣ", " \n\t ", "<|startoftext|>a", "é combining", "x" * 300, "'tis 'S 'RE"]


def noise(rng, n):
    return "".join(rng.choice(rng.choice(["abcdefghij", " ab\n\t", "a", "there", "! '.s", "12 ", "é—x", "  \n"])) for _ in range(n))


def test_encoders_equal_the_library():
    rng, word, byte = random.Random(1), tokens.word_bpe(WORD), tokens.byte_bpe(BYTE)
    for t in ODD + [noise(rng, 200) for _ in range(150)]:
        assert word.encode(t).tolist() == word.slow.encode(t, add_special_tokens=False).ids
        ids = byte.slow.encode(t, add_special_tokens=False).ids
        assert byte.encode(t) == ids and byte.decode(ids) == byte.slow.decode(ids, skip_special_tokens=False)


def test_word_encoder_equals_the_library_for_every_fast_letter():
    word = tokens.word_bpe(WORD)
    for c in map(chr, range(0x250)):
        for t in (c, f"a{c}b", f"{c * 3} {c.upper()}{c.lower()}x"):
            assert word.encode(t).tolist() == word.slow.encode(t, add_special_tokens=False).ids, t
    junk = [f"{k}zq" * 40 for k in range(50)]
    before = len(word.words)
    assert [word.encode(t).tolist() for t in junk] == [word.slow.encode(t, add_special_tokens=False).ids for t in junk]
    assert len(word.words) - before <= 20  # long words aren't held


def test_trees_equal_the_library():
    rng, byte = random.Random(2), tokens.byte_bpe(BYTE)
    params = bpe_trees.TreeParams(long_chars=64, piece_chars=16)
    for k in range(300):
        t = noise(rng, 300) if k % 2 else "".join(rng.choice(["abcdefghij", "a", " ", "!?", "123"][k // 2 % 5]) for _ in range(300))
        assert bpe_trees.encode_split(t, byte, params) == byte.slow.encode(t, add_special_tokens=False).ids


HARD = ["foo\n\n" + "a" * 20_000, "x" * 5000 + "\n\n" + "b" * 20_000, "a" * 20_000 + "\n\n" + "z" * 20_000, "- - \n\n" * 10 + "=" * 20_000, "\n" * 20_000 + "a", " " * 9000 + "  x", "'" * 9000 + "s", "日" * 9000 + " " * 5000 + "é" * 5000]


def test_trees_of_long_runs_equal_the_library():
    rng, byte = random.Random(6), tokens.byte_bpe(BYTE)
    blank = lambda: rng.choice([" ", "\n", "\n\n", " \n\t", "\u3000"]) * rng.randint(1, 3000)
    run = lambda: rng.choice(["a", "=", "7", "é", "ab'", "'ll", "😀"]) * rng.randint(1200, 12_000)
    for t in HARD + ["".join(blank() + run() for _ in range(rng.randint(1, 3))) for _ in range(12)]:
        assert bpe_trees.encode_split(t, byte) == byte.slow.encode(t, add_special_tokens=False).ids


def test_trees_of_tiny_leaves_equal_the_library():
    rng, byte = random.Random(7), tokens.byte_bpe(BYTE)
    kinds = ["abcdefghij", "a", " ", "!?", "123", "'", "\n \t", "é日—", "'s 't're've'll", "😀", "lrevsdtm'", " \u00a0\u3000"]
    for _ in range(600):
        t = "".join("".join(rng.choice(k) for _ in range(rng.choice([1, 2, 3, 5, 20, 80]))) for k in rng.choices(kinds, k=rng.randint(1, 12)))
        params = bpe_trees.TreeParams(long_chars=64, piece_chars=rng.choice([1, 2, 3, 5, 8, 16, 33]), first_window=rng.choice([1, 4]), first_chars=rng.choice([1, 2, 8, 64]))
        assert bpe_trees.encode_split(t, byte, params) == byte.slow.encode(t, add_special_tokens=False).ids, (t, params)


def test_long_documents_take_the_tree(monkeypatch):
    """Each long text of ``documents`` is joined from leaves, and joins inside pre-tokens occur."""
    byte = tokens.byte_bpe(BYTE)
    counts = {"nodes": 0, "runs": 0}
    for name in ("join_nodes", "join_runs"):
        real = getattr(bpe_trees, name)
        monkeypatch.setattr(bpe_trees, name, lambda *a, _real=real, _key=name[5:]: (counts.__setitem__(_key, counts[_key] + 1), _real(*a))[1])
    texts = [t for t in pd.read_parquet("/root/testdata/sf0.1/documents.parquet")["text"] if t and len(t) > bpe_trees.TreeParams().long_chars][:25]
    for t in texts:
        before = counts["nodes"]
        assert bpe_trees.encode_split(t, byte) == byte.slow.encode(t, add_special_tokens=False).ids
        assert counts["nodes"] - before == -(-len(t) // bpe_trees.TreeParams().piece_chars) - 1 >= 4
    assert len(texts) == 25 and counts["runs"] > 25


def test_tree_query_rows(spark):
    long = "abc" * 9000 + " " + "word and more " * 4000
    df = spark.createDataFrame([(1, long, 0), (1, long, 0), (2, None, 0), (None, "", 0), (3, "x <|endoftext|> y", 0)], "doc_id bigint, text string, ids int")
    got = bpe_trees.encode(df, BYTE).collect()
    byte = tokens.byte_bpe(BYTE)
    want = {1: long, 2: "", None: "", 3: "x <|endoftext|> y"}
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "3", "None"]
    for r in got:
        assert np.frombuffer(bytes(r.ids), dtype="<u4").tolist() == byte.slow.encode(want[r.doc_id], add_special_tokens=False).ids and r.decoded == want[r.doc_id]


def test_trees_take_texts_in_small_batches(spark):
    """The operator bounds its session's Arrow batches, so that a task's texts don't reach Python as one."""

    def weigh(batches):
        for b in batches:
            yield pd.DataFrame({"n_chars": [int(b["text"].str.len().sum())]})

    docs = spark.range(3000).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 600).alias("text"))
    spark.conf.unset(BATCH_BYTES)
    try:
        assert bpe_trees.encode(docs, BYTE).where(F.octet_length("ids") > 0).count() == 3000
        sent = [r.n_chars for r in docs.mapInPandas(weigh, "n_chars bigint").collect()]
        assert sum(sent) == 9_000_000 and max(sent) < 3_000_000
        spark.conf.set(BATCH_BYTES, "1m")  # a bound of the session's own stays
        bpe_trees.encode(docs, BYTE)
        assert spark.conf.get(BATCH_BYTES) == "1m"
    finally:
        spark.conf.unset(BATCH_BYTES)


def test_cuts_are_optimal():
    rng = random.Random(4)
    params = packing.PackParams(size=16)
    for _ in range(200):
        bounds = [0]
        while len(bounds) < 12:
            bounds.append(bounds[-1] + rng.randint(1, 8))
        costs = [rng.choice([0, 1, 4]) for _ in bounds]
        best = {0: 0.0}
        for j in range(1, len(bounds)):
            best[j] = min(best[i] + 16 - (bounds[j] - bounds[i]) + costs[j] for i in best if bounds[j] - bounds[i] <= 16)
        cuts = packing.choose_cuts(bounds, costs, params)
        steps = list(zip([0, *cuts], cuts))
        assert cuts[-1] == bounds[-1] and all(b - a <= 16 for a, b in steps)
        assert sum(16 - (b - a) + costs[bounds.index(b)] for a, b in steps) == best[len(bounds) - 1]


def test_packing_holds_each_token_once(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (None, "a b")], "doc_id bigint, text string"))
    got = packing.pack(docs, WORD, with_ids=True).toPandas()
    texts = {None if pd.isna(r.doc_id) else r.doc_id: r.text for r in docs.collect()}
    word = tokens.word_bpe(WORD)
    for doc, rows in got.groupby(got["doc_id"].fillna(-9)):
        rows = rows.sort_values("start")
        text = texts[None if doc == -9 else doc]
        want = [*(word.slow.encode(text, add_special_tokens=False).ids if text else []), 1]
        assert np.concatenate(rows["ids"].tolist()).tolist() == want and (rows["doc_tokens"] == len(want)).all()
        assert rows["start"].tolist() == np.cumsum([0, *rows["length"]])[:-1].tolist()
        assert all(zlib.crc32(np.array(i, dtype="<u4").tobytes()) == c for i, c in zip(rows["ids"], rows["ids_crc32"]))
    seqs = got.sort_values("offset").groupby("sequence_id")
    assert all(s["offset"].tolist() == np.cumsum([0, *s["length"]])[:-1].tolist() for _, s in seqs)
    sizes = got.groupby("sequence_id")["length"].sum()
    assert sizes.max() <= 2048 and (2048 - sizes).sum() < 0.03 * sizes.sum()
    assert packing.pack(docs.where("1 = 0"), WORD).count() == 0


class BitWriter(webp.Writer):
    def bytes(self):
        return self.value.to_bytes((self.size + 7) // 8, "little")


def coded(w, pixels, width, cache_bits=0, refs=(), main=True):
    """An entropy-coded image: literals, back-references {position: (length, distance code)}, and the cache where it holds a pixel."""
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    symbols, at, cache, refs = [], 0, {}, dict(refs)
    slot = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
    while at < len(pixels):
        if at in refs:
            n, d = refs[at]
            symbols.append(("ref", n, d))
            for p in pixels[at : at + n]:
                cache[slot(p)] = p
            at += n
            continue
        p = pixels[at]
        symbols.append(("cache", slot(p)) if cache_bits and cache.get(slot(p)) == p else ("pixel", p))
        cache[slot(p)] = p
        at += 1
    prefix = lambda v: (v - 1, 0, 0) if v <= 4 else ((n := (v - 1).bit_length() - 1) * 2 + (v - 1 >> n - 1 & 1), v - 1 & (1 << n - 1) - 1, n - 1)
    uses = [[], [], [], [], []]
    for s in symbols:
        if s[0] == "pixel":
            for k, sh in enumerate((8, 16, 0, 24)):
                uses[k].append(s[1] >> sh & 255)
        elif s[0] == "ref":
            uses[0].append(256 + prefix(s[1])[0]), uses[4].append(prefix(s[2])[0])
        else:
            uses[0].append(280 + s[1])
    codes = []
    for used, size in zip(uses, [280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]):
        counts = {s: used.count(s) for s in set(used)} or {0: 1}
        lengths = webp.code_lengths(counts, 15) if len(counts) > 1 else dict.fromkeys(counts, 0)
        if len(counts) == 1 and next(iter(counts)) > 255:
            lengths = {next(iter(counts)): 1, 0: 1}
        webp.write_code(w, lengths, size)
        codes.append((webp.reversed_codes(lengths) if len(lengths) > 1 else {}, lengths))
    put = lambda k, s: w.put(codes[k][0].get(s, 0), codes[k][1][s] if codes[k][0] else 0)
    for s in symbols:
        if s[0] == "pixel":
            for k, sh in enumerate((8, 16, 0, 24)):
                put(k, s[1] >> sh & 255)
        elif s[0] == "ref":
            c, extra, n = prefix(s[1])
            put(0, 256 + c), w.put(extra, n)
            c, extra, n = prefix(s[2])
            put(4, c), w.put(extra, n)
        else:
            put(0, 280 + s[1])


def start(width, height):
    w = BitWriter()
    w.put(0x2F, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)
    return w


def picture(seed, n, colours=None):
    rng = np.random.default_rng(seed)
    return (rng.choice(colours, n) if colours is not None else rng.integers(0, 1 << 32, n)).astype(np.uint32).tolist()


def from_bits(*fields):
    return np.packbits([int(b) for b in "".join(fields)], bitorder="little").tobytes()


def test_webp_golden_file():
    """The lossless test image of a well-known feature check: one transparent pixel behind a palette."""
    import base64

    (image,) = webp.decode_images(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert image.tolist() == [[0]]


def test_webp_golden_back_reference():
    """Bits written down by hand, lowest first: four pixels, of which three repeat the first."""
    data = from_bits(
        "11110100", "11000000000000", "00000000000000", "0", "000",  # signature 0x2f, width 4, height 1, no alpha hint, version 0
        "0", "0", "0",  # no transform, cache or entropy image
        "0", "0000", "010", "010", "000", "100",  # green: lengths of the length codes 17, 18, 0 and 1 are 2, 2, 0 and 1
        "1", "000", "11",  # five codes follow: 1 is "0", 17 is "10", 18 is "11"
        "10", "001", "0", "11", "1111111", "11", "1010011", "0",  # 7 zeros, symbol 7, 138 and 112 zeros, symbol 258
        "1000", "1000", "10111111111", "1001",  # red 0, blue 0, alpha 255, distance code 2 (the pixel before)
        "0", "1",  # green 7, then length prefix 2: three pixels
    )
    assert webp.decode_vp8l(data).tolist() == [[0xFF000700] * 4]


def test_webp_golden_predictions():
    """The 14 predictions worked out by hand for neighbours of known channels (blue, green, red, alpha)."""
    left, top, right, corner = (np.array(c, dtype=np.int32) for c in ([10, 200, 7, 255], [20, 250, 8, 255], [30, 0, 9, 254], [40, 100, 200, 255]))
    want = {
        0: [0, 0, 0, 255],
        1: [10, 200, 7, 255],
        2: [20, 250, 8, 255],
        3: [30, 0, 9, 254],
        4: [40, 100, 200, 255],
        5: [20, 175, 8, 254],
        6: [25, 150, 103, 255],
        7: [15, 225, 7, 255],
        8: [30, 175, 104, 255],
        9: [25, 125, 8, 254],
        10: [25, 137, 55, 254],
        11: [20, 250, 8, 255],
        12: [0, 255, 0, 255],
        13: [3, 255, 0, 255],
    }
    for mode, channels in want.items():
        assert webp._predict(mode, left, top, right, corner).tolist() == channels, mode


def test_webp_golden_distances():
    assert webp.NEAR[:20] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3)]
    assert webp.NEAR[34:40] == [(0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0)] and webp.NEAR[-3:] == [(-7, 7), (8, 6), (8, 7)] and len(webp.NEAR) == 120


def transforms(media):
    bits = webp.Bits(media[20:])
    bits.read(40)
    return bits.read(2) if bits.read(1) else None


def test_webp_encoder_takes_what_pays(monkeypatch):
    rng = np.random.default_rng(8)
    noise = rng.integers(0, 256, 64 * 200, dtype=np.uint8)
    slope = (np.arange(64 * 700) * 3 // 7 % 256).astype(np.uint8) + rng.integers(0, 3, 64 * 700, dtype=np.uint8)
    for samples, kind, most in [(noise, None, 1.02), (slope, webp.PREDICTOR, 0.5), (noise % 2, webp.PALETTE, 0.15), (noise % 4, webp.PALETTE, 0.27), (noise % 13, webp.PALETTE, 0.5), (noise[:64] * 0, webp.PALETTE, 1)]:
        media = webp.encode_image(samples)
        assert transforms(media) == kind and len(media) < most * len(samples) + 40
        assert (webp.load(media) == samples).all()
    copies = []
    real = webp._far
    monkeypatch.setattr(webp, "_far", lambda *a: (copies.append(a), real(*a))[1])
    webp._near_codes.cache_clear()
    text = np.frombuffer((b"some prose that comes again, " + bytes(range(33, 127))) * 30 + bytes(94), dtype=np.uint8)
    text = text[: len(text) // 64 * 64]
    media = webp.encode_image(text)
    copies.clear()
    assert (webp.load(media) == text).all() and len(copies) >= 1 and len(media) < 0.15 * len(text)


def test_webp_fields_are_packed_by_words():
    rng = np.random.default_rng(5)
    for n in [0, 1, 2, 3, 40, 41, 700]:
        for most in [1, 8, 19, 32]:
            sizes = rng.integers(0, most, n)
            fields = rng.integers(0, 1 << 31, n) & ((1 << sizes) - 1)
            one_by_one = webp.Writer()
            for f, k in zip(fields.tolist(), sizes.tolist()):
                one_by_one.put(f, k)
            assert webp._packed(fields, sizes) == (one_by_one.value, one_by_one.size)


def test_webp_encoder_holds_no_array_of_all_bits():
    """Nothing of the encoder's work grows with the bits of an image, but with its symbols (of what numpy allocates)."""
    rng = np.random.default_rng(11)
    samples = rng.integers(0, 256, webp.WIDTH * webp.MAX_ROWS, dtype=np.uint8)
    tracemalloc.start()
    try:
        media = webp.encode_image(samples)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (webp.load(media) == samples).all() and peak < 100 * len(samples)


def test_webp_files_stay_as_they_were():
    """Stored forms by their digest, from the code that wrote every bit by itself."""
    rng = np.random.default_rng(6)
    texts = [t for t in pd.read_parquet(f"{SF}/documents.parquet")["text"].dropna()][:200]
    odd = [b"", b"a", b"ab" * 500, bytes(range(256)) * 9, rng.integers(0, 256, 99_999, dtype=np.uint8).tobytes(), (np.arange(70_000) * 3 // 7 % 256).astype(np.uint8).tobytes(), b"x" * (1 << 20) + b"y"]
    whole = hashlib.sha256(b"".join(webp.store(webp.padded(raw)) for raw in [*odd, *(t.encode() for t in texts)]))
    assert whole.hexdigest() == "11736070d30308b8c689ee5861ad228364e522f6c0218cc071492e72bef96c7a"


def test_webp_work_of_a_document():
    """What doesn't depend on the machine: calls for a stored and loaded document (before: 1707), and memory of a long one's loading (before: 21 MB)."""
    texts = [t for t in pd.read_parquet(f"{SF}/documents.parquet")["text"].dropna()][:200]
    payloads = [webp.padded(t.encode()) for t in texts]
    for p in payloads:
        assert webp.load(webp.store(p)).tobytes() == p
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    before = sys.getprofile()
    sys.setprofile(count)
    try:
        for p in payloads:
            webp.load(webp.store(p))
    finally:
        sys.setprofile(before)
    assert calls < 1400 * len(payloads)
    long = webp.padded("\n".join(texts * 3).encode()[:300_000])
    media = webp.store(long)
    tracemalloc.start()
    try:
        back = webp.load(media)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert back.tobytes() == long and len(media) > 4 * webp.CHUNK and peak < 8_000_000


def test_webp_repeats_are_true():
    rng = np.random.default_rng(3)
    for _ in range(60):
        samples = np.concatenate([rng.integers(0, rng.choice([2, 5, 60]), rng.integers(1, 90), dtype=np.uint8)] * int(rng.integers(1, 5)) + [np.zeros(64, np.uint8)])
        end = 0
        for at, n, far in zip(*webp.find_repeats(samples)):
            assert at >= end and far <= at and n >= 8 and all(samples[at + k] == samples[at + k - far] for k in range(n))
            end = at + n
        assert end <= len(samples)


def test_webp_documents_use_back_references(spark):
    texts = [t for t in pd.read_parquet(f"{SF}/documents.parquet")["text"].dropna()][:60]
    rows = [webp.find_repeats(np.frombuffer(webp.padded(t.encode()), dtype=np.uint8))[0] for t in texts]
    sizes = [len(webp.store(webp.padded(t.encode()))) for t in texts]
    assert sum(len(r) for r in rows) > 1000 and sum(sizes) < 0.55 * sum(len(t.encode()) for t in texts)


def test_webp_back_references_and_cache():
    base = picture(1, 20, [0xFF102030, 0xFF00FF00, 0x80FFFFFF])
    pixels = base + base[:5] + [base[4]] * 40 + picture(2, 15)
    for cache_bits in (0, 3):
        w = start(10, 8)
        w.put(0, 1)
        coded(w, pixels, 10, cache_bits, {20: (5, 140), 25: (40, 2)})
        assert webp.decode_vp8l(w.bytes()).reshape(-1).tolist() == pixels


def test_webp_codes_of_unlike_sizes():
    """Distance and channel codes longer than green's, a green code of one symbol, and references across what is looked up at once."""
    rng = np.random.default_rng(12)
    pixels = rng.choice([0xFF000100, 0xFF000200], 300).tolist()
    refs, at = {}, len(pixels)
    for k in range(400):
        far, n = int(rng.integers(1, min(at, 1 << 2 + k % 14))), int(rng.integers(1, 40))
        refs[at] = (n, far + 120)
        for _ in range(n):
            pixels.append(pixels[-far])
        at += n
        own = rng.choice([0xFF000100, 0xFF000200], 200).tolist()
        pixels += own
        at += len(own)
    pixels += [0xFF000100] * (-len(pixels) % 50)
    w = start(50, len(pixels) // 50)
    w.put(0, 1)
    coded(w, pixels, 50, refs=refs)
    assert len(w.bytes()) > 2 * webp.CHUNK and webp.decode_vp8l(w.bytes()).reshape(-1).tolist() == pixels
    for cache_bits in (0, 2):
        reds = [int(r) << 16 | 0xFF000700 for r in rng.integers(0, 256, 4000)]
        reds[2000:2030] = reds[1000:1030]
        w = start(50, 80)
        w.put(0, 1)
        coded(w, reds, 50, cache_bits, {2000: (30, 1000 + 120)})
        assert webp.decode_vp8l(w.bytes()).reshape(-1).tolist() == reds


def test_webp_length_codes_must_be_complete():
    for lengths in ({1: 1, 2: 2}, {1: 1, 2: 1, 3: 1}, {}):
        with pytest.raises(ValueError):
            webp._small_table(lengths)
    assert webp._small_table({5: 3}) == [(5, 0)] and webp._small_table({4: 1, 2: 2, 3: 2}) == [(4, 1), (2, 2), (4, 1), (3, 2)]


def test_webp_transforms():
    width, height = 9, 7
    target = np.array(picture(7, width * height), dtype=np.uint32).reshape(height, width)
    channels = lambda p: np.array([p >> s & 255 for s in (0, 8, 16, 24)], dtype=np.int32)
    word = lambda c: int(sum(int(v & 255) << s for v, s in zip(c, (0, 8, 16, 24))))
    for mode in range(14):
        residual = []
        for y in range(height):
            for x in range(width):
                at = lambda dy, dx: channels(int(target[y + dy, x + dx]) if x + dx < width else int(target[y, 0]))
                guess = np.array([0, 0, 0, 255]) if x == y == 0 else at(0, -1) if y == 0 else at(-1, 0) if x == 0 else webp._predict(mode, at(0, -1), at(-1, 0), at(-1, 1), at(-1, -1))
                residual.append(word(channels(int(target[y, x])) - guess))
        w = start(width, height)
        w.put(1, 1), w.put(webp.PREDICTOR, 2), w.put(0, 3)
        coded(w, [0xFF000000 | mode << 8] * 6, 3, main=False)
        w.put(0, 1)
        coded(w, residual, width)
        assert (webp.decode_vp8l(w.bytes()) == target).all(), mode
    w = start(width, height)
    w.put(1, 1), w.put(webp.SUBTRACT_GREEN, 2), w.put(0, 1)
    coded(w, [word(channels(p) - channels(p)[1] * np.array([1, 0, 1, 0])) for p in target.reshape(-1).tolist()], width)
    assert (webp.decode_vp8l(w.bytes()) == target).all()
    w = start(width, height)
    w.put(1, 1), w.put(webp.CROSS_COLOR, 2), w.put(0, 3)
    to_red, green_to_blue, red_to_blue = 37, -90, 14
    coded(w, [word([to_red, green_to_blue & 255, red_to_blue, 255])] * 6, 3, main=False)
    w.put(0, 1)
    signed = lambda v: (int(v) + 128) % 256 - 128
    moved = [word([c[0] - (green_to_blue * signed(c[1]) >> 5) - (red_to_blue * signed(c[2]) >> 5), c[1], c[2] - (to_red * signed(c[1]) >> 5), c[3]]) for c in map(channels, target.reshape(-1).tolist())]
    coded(w, moved, width)
    assert (webp.decode_vp8l(w.bytes()) == target).all()


@pytest.mark.parametrize("colours", [2, 4, 11, 40])
def test_webp_palette(colours):
    width, height = 13, 5
    palette = picture(colours, colours)
    index = np.random.default_rng(colours).integers(0, colours, (height, width))
    channels = np.array([[p >> s & 255 for s in (0, 8, 16, 24)] for p in palette])
    steps = np.diff(channels, axis=0, prepend=0) & 255
    w = start(width, height)
    w.put(1, 1), w.put(webp.PALETTE, 2), w.put(colours - 1, 8)
    coded(w, [int(sum(int(v) << s for v, s in zip(c, (0, 8, 16, 24)))) for c in steps], colours, main=False)
    w.put(0, 1)
    shift = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    packed = []
    for row in index:
        for x in range(0, width, 1 << shift):
            packed.append(0xFF000000 | sum(int(v) << k * (8 >> shift) for k, v in enumerate(row[x : x + (1 << shift)])) << 8)
    coded(w, packed, (width + (1 << shift) - 1) >> shift)
    assert (webp.decode_vp8l(w.bytes()) == np.array(palette, dtype=np.uint32)[index]).all()


def test_webp_store(spark):
    rng = np.random.default_rng(0)
    for raw in [b"", b"a" * 64, b"ab" * 40, bytes(range(256)), rng.integers(0, 256, 3 << 20, dtype=np.uint8).tobytes()]:
        assert webp.load(webp.store(webp.padded(raw))).tobytes() == webp.padded(raw)
    with pytest.raises(ValueError):
        webp.load(webp.store(webp.padded(b"some text"))[:-8] + b"\0" * 4)
    df = spark.createDataFrame([(1, "abc", "x"), (2, None, "x"), (2, "", "x")], "doc_id bigint, text string, feature string")
    rows = {(r.doc_id, r.n_bytes): r for r in webp.media_columns(df).collect()}
    assert rows[(2, 0)].payload_bytes == 64 and rows[(1, 3)].tail_crc32 == zlib.crc32(webp.padded(b"abc"))
    assert webp.media_columns(df.where("1 = 0")).count() == 0


def test_classifier_held_out(spark):
    got = queries.op6_quality_classifier(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert len(good) > 20 and (good.predicted == 1).mean() > 0.95 and got[got.quality == 1].score.mean() > bad.score.mean()


def test_classifier_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "good text here", 1.0), (None, "x", 1.0)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(3, 1), (3, 1), (1, None), (None, 1)], "doc_id bigint, label int")
    model = quality_classifier.learn(docs, labels)
    assert [r.score for r in quality_classifier.score(docs, model).collect()] == [1.0] * 4
    assert quality_classifier.score(docs.where("1 = 0"), model).count() == 0


def test_classifier_equals_a_plain_version():
    """Sizes by a plain zstandard loop, the curve by plain gradient ascent of the same penalised likelihood."""
    import zstandard

    rng = random.Random(3)
    words = [["".join(rng.choice(x) for _ in range(rng.randint(3, 8))) for _ in range(300)] for x in ("abcdefghilmnorstu", "defghijkmnopqrt")]
    texts = [[" ".join(rng.choice(words[rng.random() < p]) for _ in range(rng.randint(5, 400))) for _ in range(80)] for p in (0.3, 0.7)]
    model = quality_classifier.fit_model(*texts, prior=0.8)
    packers = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(zstandard.train_dictionary(65_536, [t.encode() for t in x[::2]]).as_bytes()), write_content_size=False) for x in texts]

    def difference(t):
        good, bad = ([len(p.compress(t.encode()[k : k + 1024])) for k in range(0, len(t.encode()), 1024)] for p in packers)
        return (sum(bad) - sum(good)) / (sum(bad) + sum(good))

    x = np.array([difference(t) for k in (0, 1) for t in texts[k][1::2]])
    y = np.repeat([1.0, 0.0], 40)
    weight = np.where(y == 1, 0.8 / 40, 0.2 / 40) * 80
    z, a, b = x / x.std(), 0.0, 0.0
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(a * z + b)))
        a, b = a + 0.01 * ((weight * (y - p) * z).sum() - 0.1 * a), b + 0.01 * (weight * (y - p)).sum()
    asked = [texts[0][0], texts[1][3], "short", "", None, texts[0][1] * 30]
    want = [1 / (1 + np.exp(-(a * difference(t) / x.std() + b))) if t else 0.8 for t in asked]
    assert np.allclose(model.score(asked), want, atol=1e-4)


def test_classifier_judges_all_of_a_long_text():
    rng = random.Random(12)
    words = [["".join(rng.choice(x) for _ in range(rng.randint(3, 8))) for _ in range(2000)] for x in ("abcdefghilmnorstu", "defghijkqvwxyz")]
    prose = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    model = quality_classifier.fit_model(*[[prose(k, rng.randint(60, 300)) for _ in range(200)] for k in (0, 1)], prior=0.85)
    good, bad = prose(0, 40_000), prose(1, 40_000)
    short = model.score([bad[:1500], bad, good, good[:1500] + bad, bad[:1500] + good])
    assert short[0] < 0.1 and short[1] < 0.1 and short[2] > 0.9 and short[3] < 0.1 and short[4] > 0.9
    assert model.differences([bad])[0] < 0.5 * model.differences([bad[:1024]])[0] < 0


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    got = queries.op8_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95 and got.score.between(0, 1).all()
    assert docs.where(fold(F.col("doc_id"), 4) == 2).count() == len(got)


def test_language_odd_rows(spark):
    known = spark.createDataFrame([(k, ("aba cab bac " if k % 2 else "xyx zyx yzz ") * 30, "ab" if k % 2 else "xy") for k in range(40)] + [(None, "aba", "q"), (50, None, "q"), (51, "zz", None), (52, "y" * 30_000, "q")], "doc_id bigint, text string, lang string")
    model = language_id.learn(known)
    assert model.langs == ["ab", "xy"]
    asked = spark.createDataFrame([(1, None, "l", 9.0), (1, "", "l", 9.0), (None, "12 !?", "l", 9.0), (2, "bac cab", "l", 9.0), (2, "bac cab", "l", 9.0), (3, "zyx " * 100_000, "l", 9.0)], "doc_id bigint, text string, lang_pred string, score double")
    got = [(r.doc_id, r.lang_pred, round(r.score, 3)) for r in language_id.identify(asked, model).collect()]
    assert got == [(1, "und", 0), (1, "und", 0), (None, "und", 0), (2, "ab", 1), (2, "ab", 1), (3, "xy", 1)]
    assert language_id.identify(asked.where("1 = 0"), model).count() == 0
    nothing = language_id.learn(known.where("1 = 0"))
    assert {r.lang_pred for r in language_id.identify(asked, nothing).collect()} == {"und"}
    for few in (language_id.PpmParams(most_langs=1), language_id.PpmParams(most_bytes=1000)):
        with pytest.raises(ValueError):
            language_id.learn(known, few)


def test_code_lengths_are_exact():
    samples = {"a": [b"abracadabra", b"abra"], "b": [b"banana bandana"]}
    model = language_id.PpmModel(samples, language_id.PpmParams(max_order=2, chunk_bytes=8))

    def cost(texts, context, byte, order):
        if order < 0:
            return 8.0
        seen = [t[i] for t in texts for i in range(order, len(t)) if t[i - order : i] == context[len(context) - order :]]
        if not seen:
            return cost(texts, context, byte, order - 1)
        n, q = len(seen), len(set(seen))
        return -np.log2(seen.count(byte) / (n + q)) if byte in seen else -np.log2(q / (n + q)) + cost(texts, context, byte, order - 1)

    asked = [b"abracadabra banana", b"zz", b"a", b"cabbage" * 5]
    want = [[sum(cost(samples[x], t[:i], t[i], min(i, 2)) for i in range(len(t))) for x in "ab"] for t in asked]
    assert np.allclose(model.code_lengths(asked), want, rtol=1e-5)
    assert model.predict([None, "", "123 !", "banana"])[0] == ["und", "und", "und", "b"]
    assert language_id.PpmModel({}).predict(["text"])[0] == ["und"]
