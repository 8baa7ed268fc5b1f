"""Lexical search, token files and source divergence against brute force and on awkward rows."""

import math
import random
import re
import tempfile
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from casewright.llm import divergence, lexical_search, token_files

BYTE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, query bigint, rank string, grp int"
WORDS = "a b c d e Fog fog FÖG fög naïve x1 2024 the The tHe of and zz".split()


def texts(rng, n):
    return [" ".join(rng.choices(WORDS, [40 / (k + 1) for k in range(len(WORDS))], k=rng.choice([0, 1, 3, 8, 30, 200]))) for _ in range(n)]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_search(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n, total = sum(x[2] > 0 for x in held), sum(x[2] for x in held)
    df = Counter(t for x in held for t in x[1])
    out = []
    for item, text in items:
        found = []
        for doc, counts, size in held:
            score = 0
            for t in set(terms(text)) & set(counts):
                m = 100 - 90 + (90 * size * n) // total
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if gone else doc, -score) for r, (score, gone, doc) in enumerate(sorted(found)[:k])]
    return Counter(out)


@pytest.mark.parametrize("seed", [1])
def test_search_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = [(k, t) for k, t in enumerate(texts(rng, 150))] + [(5, "fog fog the"), (5, "fog fog the"), (None, "zz zz zz"), (2**60 + 1, "x1 x1 2024"), (901, None), (902, ""), (903, "... \x7f!")]
    items = [(k, t) for k, t in enumerate(texts(rng, 12))] + [(3, "fog"), (None, "zz x1"), (77, None), (78, "???"), (79, "unknown words")]
    frame = spark.createDataFrame([(*d, 1, "r", 2) for d in docs], DOCS).repartition(3)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    for params in (lexical_search.SearchParams(), lexical_search.SearchParams(block_docs=7, query_block=4), lexical_search.SearchParams(block_postings=40, most_terms=1), lexical_search.SearchParams(k=3, block_docs=20)):
        got = lexical_search.rank_documents(frame, asked, params=params)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, got.collect())) == brute_search(docs, items, params.k)


def test_search_probes_no_more_than_needed(spark):
    """A term that all documents hold is non-essential once rarer ones have set the score to beat: its postings are only probed."""
    docs = spark.createDataFrame([(k, "the " * 3 + ("rare " * 4 if k % 40 == 0 else f"w{k}")) for k in range(800)], "doc_id bigint, text string").coalesce(1)
    index = lexical_search.build_index(docs, ["rare", "the"]).collect()
    shard = lexical_search.Shard(index[0], 800, 4000)
    rare, common = shard.postings("rare", lexical_search.weight(800, 20)), shard.postings("the", 5)
    seen = []
    shard.known = {"rare": rare, "the": common}

    class Watched(np.ndarray):
        def __setitem__(self, key, value):
            seen.append(len(np.atleast_1d(key)))
            super().__setitem__(key, value)

    shard.sums = shard.sums.view(Watched)
    found, scores = lexical_search.max_score(shard, [("the", 5), ("rare", lexical_search.weight(800, 20))], 10, 0)
    assert set(found.tolist()) >= set(range(0, 400, 40)) and max(seen) == 20  # never the 800 postings of the common term


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "fog")], "item_id bigint, text string")
    assert lexical_search.rank_documents(none, some).collect() == []
    assert lexical_search.rank_documents(spark.createDataFrame([(1, "fog")], "doc_id bigint, text string"), some.limit(0)).collect() == []


def library():
    t = Tokenizer.from_file(BYTE)
    t.no_truncation()
    t.no_padding()
    return t


def test_pieces_give_the_library_s_ids():
    lib, rng = library(), random.Random(4)
    encoder = token_files.PieceEncoder(token_files.byte_bpe(BYTE), token_files.FileParams(piece_chars=64, cached_words=50))
    letters = [chr(c) for c in range(0x250)] + ["'s", "'ll", " ", "  ", "\n", "\r\n", "\t ", "word", " word", "42", "—", "€", "漢字", "<|endoftext|>", " ", "😀", "\x1c", "\xa0"]
    cases = [f"a{c}b {c}{c} 1{c}'s" for c in letters] + ["".join(rng.choices(letters[32:], k=rng.choice([1, 20, 300]))) for _ in range(300)]
    cases += [" ".join(rng.choices(WORDS + ["don't", "\n\nx", "!?"], k=400)) for _ in range(20)] + ["x" * 500, "漢" * 300, "", "a\n \n b " * 60]
    for text in cases:
        ids = np.frombuffer(b"".join(encoder.encode(text)), dtype=encoder.kind).tolist()
        assert ids == lib.encode(text, add_special_tokens=False).ids, text[:80]
    assert len(encoder.words) <= 50 and max(map(len, encoder.pieces("word and " * 100))) < 80


def test_token_files_round_trip(spark):
    lib, rng = library(), random.Random(7)
    rows = [(k, t) for k, t in zip(rng.sample(range(-50, 5000), 300), texts(rng, 300))] + [(2**60 + 1, "big"), (None, "no id"), (None, None), (7000, None), (7001, ""), (7002, "😀 漢字 <|endoftext|>")]
    rows += [(6000, "same")] * 40 + [(6000, "other"), (8000, "long words " * 20_000)]
    frame = spark.createDataFrame([(*r, 1, "r", 2) for r in rows], DOCS).repartition(5)
    folder = tempfile.mkdtemp(prefix="spark-") + "/files"
    params = token_files.FileParams(read_docs=37, read_tokens=100, piece_chars=10_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts
    try:
        index = token_files.write_tokens(frame, folder, BYTE, params=params)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.n_docs for r in index.collect()) == len(rows) and index.count() > 1
    got = sorted(token_files.read_tokens(spark, folder, params).collect(), key=lambda r: r.start)
    want = defaultdict(Counter)
    for doc, text in rows:
        want[doc][tuple(lib.encode(text or "", add_special_tokens=False).ids + [2])] += 1
    found, place = defaultdict(Counter), 0
    for r in got:
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert r.start == place and r.n_tokens == len(ids)
        place += len(ids)
        found[r.doc_id][tuple(ids.tolist())] += 1
    assert found == want
    order = [(r.doc_id is None, r.doc_id or 0) for r in got]
    assert order == sorted(order)  # ascending ids, null ones last
    files = token_files.TokenFiles.open(spark, folder)
    whole = np.concatenate([np.frombuffer(r.ids, dtype="<u4") for r in got])
    assert len(files) == len(rows) and all(files[k].tolist() == np.frombuffer(got[k].ids, dtype="<u4").tolist() for k in range(len(rows)))
    assert all(files.window(a, n).tolist() == whole[a : a + n].tolist() for a, n in ((0, 10), (5, len(whole)), (len(whole) - 3, 9), (len(whole) // 2, 2000)))
    with pytest.raises(IndexError):
        files[len(rows)]


def test_token_files_of_nothing(spark):
    folder = tempfile.mkdtemp(prefix="spark-") + "/files"
    assert token_files.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), folder, BYTE).count() == 0
    assert token_files.read_tokens(spark, folder).collect() == [] and len(token_files.TokenFiles.open(spark, folder)) == 0


def brute_divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        of = [d for d in docs if d[0] == lang]
        df = Counter(t for d in of for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= least]
        counts = {s: Counter(t for d in of if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in of}}
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + (10**9 * (c[t] + 2)) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            term = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -value, r + 1) for part, items in (("pair", pair), ("term", term)) for r, (value, item) in enumerate(items)]
    return Counter(out)


@pytest.mark.parametrize("seed", [1])
def test_divergence_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    sources = [f"s{k}" for k in range(9)] + [None, "", "Ä"]
    rows = [(t, rng.choice(["en", "en", "de", None]), rng.choice(sources)) for t in texts(rng, 400)]
    rows += [(" ".join(rng.choices([f"w{chr(97 + k)}" for k in range(26)], k=40)), "en", rng.choice(sources[:4])) for _ in range(60)]
    rows += [(None, "en", "empty"), ("1 2 3", "xx", "alone"), (None, "yy", "p"), ("", "yy", "q"), ("same words", "de", "s1"), ("same words", "de", "s1")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, grp int, term string").repartition(3)
    for params in (divergence.DivergenceParams(), divergence.DivergenceParams(light_groups=2, tile_groups=4, tile_terms=3, tile_counts=2, pending=50, held=40, least_docs=4), divergence.DivergenceParams(light_groups=0, tile_groups=2), divergence.DivergenceParams(light_groups=1000, tile_groups=5, held=30)):
        got = divergence.divergence(frame, params=params)
        assert Counter(map(tuple, got.collect())) == brute_divergence(rows, params.least_docs, params.top_terms)


def test_divergence_of_nothing_and_of_large_counts(spark):
    none = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.divergence(none).collect() == []
    from pyspark.sql import functions as F

    big = [(0, 0, 0), (5, 5, 1), (10**14, 4 * 10**15, 10**6), (10**12 - 2, 10**12, 1)]
    got = spark.createDataFrame(big, "n bigint, kept bigint, terms bigint").select(divergence.share(F.col("n"), F.col("kept"), F.col("terms"))).collect()
    assert [r[0] for r in got] == [1] + [1 + 10**9 * (n + 2) // (kept + 2 * terms) for n, kept, terms in big[1:]]
