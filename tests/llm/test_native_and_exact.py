"""WARC, quality rules, line dedup, Jaccard join and URL filters against brute force and on awkward rows."""

import base64
import gzip
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import jaccard_join, line_dedup, quality_rules, queries, url_filter, warc

DOCS = "doc_id bigint, text string, source string, kept string"


def record(n, body=b"x", headers=b""):
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:%d>\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, headers, len(body), body)


def test_salvage_plain():
    good = [record(k, b"body %d" % k) for k in range(4)]
    data = good[0] + good[1][:-9] + good[2] + b"noise WARC/1.1\r\nbroken" + good[3]
    found = list(warc.salvage(data))
    kept = [f.headers["warc-record-id"] for f in found if isinstance(f, warc.Record)]
    assert kept == ["<urn:record:0>", "<urn:record:2>", "<urn:record:3>"]
    gaps = [f for f in found if isinstance(f, warc.Gap)]
    assert len(gaps) == 2 and sum(f.end - f.start for f in found) == len(data)


def test_salvage_digest_and_empty():
    digest = base64.b32encode(hashlib.sha1(b"good").digest())
    bad = record(1, b"evil", b"WARC-Payload-Digest: sha1:" + digest + b"\r\n")
    found = list(warc.salvage(bad + record(2)))
    assert found[0].reason == "payload digest differs" and found[1].headers["warc-record-id"] == "<urn:record:2>"
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"junk")) == [warc.Gap(0, 4, "no version line")]


def test_salvage_gzip_members():
    parts = [bytearray(gzip.compress(record(k, b"body %d" % k * 20))) for k in range(3)]
    parts[1][30] ^= 255
    found = list(warc.salvage(bytes(b"".join(parts))))
    assert [isinstance(f, warc.Record) for f in found] == [True, False, True]
    assert (found[1].start, found[1].end) == (len(parts[0]), len(parts[0]) + len(parts[1]))


def ids_of(data):
    return [f.headers["warc-record-id"][12:-1] if isinstance(f, warc.Record) else None for f in warc.salvage(data)]


def test_salvage_mixed_whole_and_cut_members():
    rng = random.Random(0)
    body = lambda k: bytes(rng.randrange(256) for _ in range(400)) + b"%d" % k
    good = [record(k, body(k)) for k in range(6)]
    pack = gzip.compress
    assert ids_of(good[0] + pack(good[1]) + b"junk" + good[2] + pack(good[3])) == ["0", "1", None, "2", "3"]
    # an archive that was compressed as a whole, with a damaged record inside
    whole = pack(good[0] + good[1][:-9] + good[2])
    found = list(warc.salvage(whole))
    assert ids_of(whole) == ["0", None, "2"] and found[2].start == 0 and found[2].inner == len(good[0]) + len(good[1]) - 9
    assert ids_of(pack(good[0] + good[1]) + pack(good[2])) == ["0", "1", "2"]
    # a last member that was cut short still yields what unpacks, and the rest is a gap
    both = pack(good[3] + good[4])
    assert ids_of(pack(good[0]) + both[: len(both) * 3 // 4]) == ["0", "3", None]
    torn = bytearray(pack(good[1]))
    torn[-6] ^= 1  # the member's check sum
    assert ids_of(bytes(torn) + pack(good[2]))[-1] == "2"
    assert ids_of(pack(b"")) == [None] and ids_of(pack(b"no record")) == [None]


def test_archives_are_bounded(spark, tmp_path):
    pages = spark.range(200).selectExpr("id as page_id", "'u' as url", "repeat('x', 1000) || id as html")
    warc.write_archives(pages.coalesce(1), str(tmp_path / "w"), archive_bytes=20_000)
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("*.txt")]
    assert len(sizes) > 5 and max(sizes) < 40_000
    rows = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(rows) == 200 and all(r.kind == "record" and r.inner == 0 for r in rows)


def test_archives_of_skewed_payloads_are_bounded(spark, tmp_path):
    """A few very large pages among many small ones: the mean says nothing of the files that they come into."""
    pages = spark.range(3000).selectExpr("id as page_id", "if(id % 7 = 0, null, repeat('u', int(id % 90))) as url", "case when id % 500 = 0 then repeat(char(65 + id / 500), 300000) when id % 11 = 0 then null else 'small ' || id end as html")
    warc.write_archives(pages.orderBy("html").coalesce(1), str(tmp_path / "w"), archive_bytes=1_000_000)
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("*.txt")]
    assert max(sizes) <= 1_000_000 + 302_000 and len(sizes) < 20
    rows = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert len(rows) == 3000 and sum(len(r.payload or b"") for r in rows.values()) > 1_800_000
    assert warc.read_archives(spark, str(tmp_path / "w")).where("kind = 'gap'").isEmpty()


def test_salvage_is_linear(spark):
    """Every record is damaged: each failed check is followed by a search for the next mark alone."""
    import time

    digest = base64.b32encode(hashlib.sha1(b"other").digest())
    bad = b"".join(record(k, b"x" * 900, b"WARC-Payload-Digest: sha1:" + digest + b"\r\n") for k in range(16_000))
    began = time.process_time()
    found = list(warc.salvage(bad))
    assert len(found) == 1 and (found[0].start, found[0].end) == (0, len(bad)) and time.process_time() - began < 2
    bomb = gzip.compress(b"z" * (1 << 24))  # unpacks to much more than it is, and holds no record
    began = time.process_time()
    found = list(warc.salvage(bomb * 50 + record(1)))
    assert isinstance(found[-1], warc.Record) and time.process_time() - began < 2
    marks = b"\x1f\x8b\x08" * 20_000 + record(2)
    assert [type(f) for f in warc.salvage(marks)] == [warc.Gap, warc.Record]


def test_a_gap_fails_the_query(spark, tmp_path, monkeypatch):
    spark.range(3).selectExpr("id as page_id", "'u' as url", "'body' || id as html").write.parquet(str(tmp_path / "pages.parquet"))
    write = warc.write_archives

    def damaged(pages, path, *rest):
        write(pages, path, *rest)
        for f in (tmp_path.__class__(path)).glob("*.txt"):
            f.write_bytes(f.read_bytes().replace(b"body1", b"bodyX"))
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)

    monkeypatch.setattr(warc, "write_archives", damaged)
    with pytest.raises(Exception, match="gap in"):
        queries.op1_warc_salvage(spark, str(tmp_path)).collect()


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, None), (4, "u", ""), (5, "u", "é"), (None, "u", "q"), (2, "again", "same")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, payload string")
    got = sorted((r.record_id or "", r.record_type, r.refers_to or "", r.payload_bytes) for r in warc.round_trip(pages).collect())
    assert got == [("", "response", "", 1), ("1", "revisit", "2", 4), ("2", "response", "", 4), ("2", "response", "", 4), ("3", "revisit", "4", 0), ("4", "response", "", 0), ("5", "response", "", 2)]
    assert warc.round_trip(pages.where("1 = 0")).count() == 0


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    texts = [None, "", "a", "a b c a b c a b", "x\nx\n\n y\nx", "é# * \t a|b", "w " * 3000, " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(60))]
    rows = [(k if k != 2 else None, t, None if k == 3 else "h", "z") for k, t in enumerate(texts)]
    out = quality_rules.quality_rules(spark.createDataFrame(rows, DOCS), keep=["doc_id", "text"]).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(spark.createDataFrame([], DOCS)).count() == 0


def test_hosts_are_shrunk(spark):
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(k, "bad" if k % 10 else good, "worst", "") for k in range(100)] + [(1000 + k, good, f"h{k % 5}", "") for k in range(200)] + [(2000, "bad", "small", "")]
    df = quality_rules.measure(spark.createDataFrame(rows, DOCS))
    verdicts = {r.host: r for r in quality_rules.host_verdicts(df).collect()}
    assert verdicts["worst"].host_rejected and not verdicts["h1"].host_rejected
    assert verdicts["small"].host_rate < 1.0


def test_a_bad_host_among_documents_goes_whole(spark):
    """The sources of ``documents`` differ by chance alone, and none goes. With most failing documents moved to a host, that one does."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    plain = quality_rules.quality_rules(docs, keep=["doc_id"])
    assert plain.where("not kept and not base_failed").isEmpty()
    failed = plain.where("rule_failed").select("doc_id", F.lit(True).alias("bad"))
    # "farm" has these and every 40th of the others
    moved = docs.join(failed, "doc_id", "left").withColumn("source", F.when(F.col("bad") | (F.col("doc_id") % 40 == 0), "farm").otherwise(F.col("source")))
    rows = quality_rules.quality_rules(moved.select("doc_id", "text", "source"), keep=["doc_id", "source"]).collect()
    gone = [r for r in rows if not r.kept and not r.base_failed]
    assert len(gone) >= 20 and {r.source for r in gone} == {"farm"}
    assert all(r.kept for r in rows if r.source != "farm")


def test_quality_rules_of_very_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{k % 40_000}" for k in range(60_000))
    df = spark.createDataFrame([(1, long, "h", 7, 8, "x")], "doc_id bigint, text string, source string, n_words int, host_rate int, host string")
    got = quality_rules.quality_rules(df).first()
    assert (got.n_words, got.n_repeat_words, got.host, got.kept) == (60_000, 40_000, "x", False)


SHORT_RUNS = line_dedup.DedupParams(min_run_words=8)


def test_line_dedup(spark):
    a, b = "one two three four five six seven eight.", "nine ten eleven twelve thirteen fourteen fifteen sixteen."
    texts = [f"{a} {b}\nshort", f"Intro that is different here now okay then. {a}\nshort", f"{a.upper()}   {b}\ntail words are not the same", None, "", "short\nshort", f"{a} {b}\nshort"]
    df = spark.createDataFrame([(k if k != 6 else None, t, "s", "x") for k, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, params=SHORT_RUNS).collect()}
    assert got[0].text == texts[0] and got[0].removed == []
    assert got[1].text == "Intro that is different here now okay then. \nshort"
    assert got[2].text == "tail words are not the same" and [(s.start, s.kept_in) for s in got[2].removed] == [(0, 0)]
    assert got[3].text is None and got[4].text == "" and got[5].text == "short\nshort"
    assert got[None].text == "short"
    twice = df.where("doc_id = 0").unionByName(df.where("doc_id = 0"))
    assert [r.text for r in line_dedup.dedup_lines(twice, params=SHORT_RUNS).collect()] == [texts[0]] * 2
    assert line_dedup.dedup_lines(df.where("1 = 0")).count() == 0


def test_short_sentences_go_as_a_passage(spark):
    short = [f"w{k}a w{k}b w{k}c w{k}d w{k}e w{k}f w{k}g. " for k in range(12)]
    long = "this one sentence has more than eight words in it. "
    verse = "".join(f"v{k} x{k}\n" for k in range(7))
    han = [chr(0x4E00 + 40 * k) + "".join(chr(0x5000 + 40 * k + i) for i in range(5)) + "。" for k in range(12)]
    passage = "".join(short)
    pairs = [
        (f"first start here. {passage}and its end", f"other start. {passage}of another kind", "other start. of another kind"),
        (f"aa bb. {long}Tail it is. zz", f"cc dd. {long}Tail it is. yy", "cc dd. yy"),
        (f"one head\n{verse}one foot", f"second top\n\n{verse}second bottom", "second top\n\nsecond bottom"),
        ("甲乙丙。" + "".join(han) + "丁", "戊己。" + "".join(han) + "庚", "戊己。庚"),
        ("Yes. No. Yes. No. Yes. No. Yes. No.", "Well. Yes. No. Maybe. Yes.", "Well. Yes. No. Maybe. Yes."),
        ("Buy it. " * 5 + "end", "Nothing of it here", "Nothing of it here"),
    ]
    texts = [t for a, b, _ in pairs for t in (a, b)]
    df = spark.createDataFrame([(k, t, "s", "x") for k, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, params=SHORT_RUNS).collect()}
    assert [got[2 * k].text for k in range(len(pairs))] == [a for a, _, _ in pairs]
    assert [got[2 * k + 1].text for k in range(len(pairs))] == [c for _, _, c in pairs]
    for k, r in got.items():  # the spans lie apart and in order, and what is left lies between them
        ends = [0, *(s.start + s.length for s in r.removed)]
        assert all(s.start >= e for s, e in zip(r.removed, ends))
        assert r.text == "".join(c for i, c in enumerate(texts[k]) if not any(s.start <= i < s.start + s.length for s in r.removed))
    lone = spark.createDataFrame([(k, f"{'abc'[k]} tail here.\nthis one common line has ten words and it stays whole", "s", "x") for k in range(3)], DOCS)
    assert all(r.removed == [] for r in line_dedup.dedup_lines(lone).collect())
    old = {r.doc_id: r for r in line_dedup.dedup_lines(df, params=line_dedup.DedupParams(min_run_words=8, passages=False)).collect()}
    assert old[1].text == texts[1]


def test_very_common_digests_are_joined_apart(spark):
    found = spark.createDataFrame([(1 if k % 3 == 0 else k, k) for k in range(300)], "h1 bigint, place bigint")
    counts = found.groupBy("h1").count().withColumnRenamed("count", "n")
    rows = {(r.h1, r.place, r.n) for r in line_dedup.join_counted(found, counts, ["h1"], 300, share=10).collect()}
    assert rows == {(1, k, 101) if k % 3 == 0 or k == 1 else (k, k, 1) for k in range(300)}
    plan = line_dedup.join_counted(found, counts, ["h1"], 300)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "LeftAnti" in plan


def test_groups_equal_brute_force():
    rng = random.Random(5)
    for _ in range(500):
        parts = [(0, 0, rng.choice([0, 1, 2, 3, 5, 7, 8, 20])) for _ in range(rng.randint(0, 12))]
        full = [k for k, p in enumerate(parts) if p[2]]
        size = lambda a, b: sum(p[2] for p in parts[a : b + 1])
        want = {(a, next(b for b in full if b >= a and size(a, b) >= 8)) for a in full if parts[a][2] < 8 and size(a, len(parts)) >= 8}
        ends = {b for _, b in want}
        want |= {(max(a for a in full if a <= b and size(a, b) >= 8), b) for b in full if parts[b][2] < 8 and size(0, b) >= 8 and b not in ends}
        assert line_dedup.groups(parts, 8, 8) == want


def test_the_form_without_sql_is_the_pipeline_s(spark, tmp_path):
    """Whole results of the registered default form: what it leaves and removes add up to the texts, and it takes all that the plainer rule takes."""
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    both = {n: {r.doc_id: r for r in getattr(queries, n)(spark, str(tmp_path)).collect()} for n in ("op4_line_dedup", "passage_dedup")}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    for found in both.values():
        assert found.keys() == texts.keys()
        for doc, r in found.items():
            assert (r.chars_left or 0) + r.chars_removed == len(texts[doc] or "")
            left, at = "", 0
            for span in filter(None, r.removed_spans.split(",")):
                start, length, kept_in = map(int, span.split(":"))
                assert start >= at and kept_in in texts
                left, at = left + texts[doc][at:start], start + length
            assert texts[doc] is None or hashlib.md5((left + texts[doc][at:]).encode()).hexdigest() == r.text_md5
    assert sum(r.chars_removed for r in both["passage_dedup"].values()) >= sum(r.chars_removed for r in both["op4_line_dedup"].values()) > 0


def test_line_dedup_of_odd_blanks_long_texts_and_columns(spark):
    line = "one\u00a0two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    other = line.replace("\u00a0", " ")
    filler = "\n".join(f"line {k} of a very long text with its own number {k * k}" for k in range(30_000))
    df = spark.createDataFrame([(1, line, 5, "r"), (2, other, 6, "r"), (3, f"{filler}\n{line}", 7, "r")], "doc_id bigint, text string, n_units int, removed string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[2].text == other and got[2].n_units == 6 and got[3].text == f"{filler}\n" and got[3].removed[0].kept_in == 1


def brute_components(rows):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: grams(t) for i, t in rows}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            lo, hi = sorted((label[a], label[b]))
            label = {k: lo if v == hi else v for k, v in label.items()}
    return {(i, len(sets[i]), label[i]) for i in sets}


def test_jaccard_join_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    rows, n = [], 0
    passage = [f"p{k}" for k in range(70)]
    for size in [1, 2, 4, 5, 6, 8, 9, 12, 15, 20, 33, 60, 90, 150]:
        for _ in range(3):
            base = [f"w{rng.randrange(50_000)}" for _ in range(size)]
            for _ in range(7):
                w = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                    w[rng.randrange(len(w))] = f"e{rng.randrange(999)}"
                if rng.random() < 0.3:
                    w = w[: max(1, len(w) - rng.randrange(1 + size // 8))]
                rows.append((n, " ".join(w)))
                n += 1
    for _ in range(40):  # a common passage that links nothing
        rows.append((n, " ".join(passage + [f"q{rng.randrange(99999)}" for _ in range(70)])))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "Same WORDS here"), (n + 4, "same words\there ")]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id bigint, text string, component_id int, fp int")
    for params in (jaccard_join.JoinParams(), jaccard_join.JoinParams(split_members=4)):
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, params=params).collect()}
        assert got == brute_components(rows)


def test_blocks_hold_each_pair_once(spark):
    rows = spark.createDataFrame([(k, 1000 * k + i, i) for k, n in ((1, 3), (2, 10), (3, 95)) for i in range(n)], "key bigint, fp bigint, label bigint")
    cells = jaccard_join.blocks(rows, jaccard_join.JoinParams(split_members=10))
    assert cells.groupBy("key").count().agg({"count": "max"}).first()[0] < 25
    met = cells.alias("x").join(cells.alias("y"), "key").where("x.fp < y.fp and x.side != y.side").selectExpr("x.fp as a", "y.fp as b").collect()
    want = {(1000 * k + i, 1000 * k + j) for k, n in ((1, 3), (2, 10), (3, 95)) for j in range(n) for i in range(j)}
    assert len(met) == len(want) and {tuple(r) for r in met} == want


def test_every_level_finds_its_pairs():
    """Pigeonhole, set by set: linked sets share a key whatever their levels."""
    rng = np.random.default_rng(5)
    for n in [1, 2, 3, 5, 8, 9, 10, 13, 20, 40, 100]:
        for _ in range(300 if n < 20 else 60):
            a = rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64)
            change = int(rng.integers(0, max(1, n // 9) + 1))
            b = np.concatenate([a[change:], rng.integers(0, 2**63, int(rng.integers(0, change + 1)), dtype=np.int64).view(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            if jaccard_join.jaccard_at_least(a, b, 80):
                key, owner = jaccard_join.signatures([a, b])
                assert set(key[owner == 0]) & set(key[owner == 1])


def test_sets_are_told_apart_by_more_than_sums_of_powers():
    """The Thue-Morse word and its complement collide under every polynomial modulo 2 ** 64."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    texts = [word, word.translate(str.maketrans("ab", "ba")), "A b\tc", "a B c", "a b c d e f", "", "a b c d e a b c d e a", "b a c d e"]
    split = [jaccard_join.split_words(t) for t in texts]
    sets, digests = jaccard_join.shingle_sets(split), jaccard_join.text_digests(split)
    assert sets[0][0] != sets[1][0] and (digests[0] != digests[1]).all() and (digests[2] == digests[3]).all()
    assert [len(s) for s in sets] == [1, 1, 1, 1, 2, 0, 5, 1] and not digests[5].any() and sets[7][0] not in sets[6]
    assert [len(jaccard_join.word_shingles(w, 5)) for w in split] == [len(s) for s in sets]


def test_links_are_verified_on_the_shingles(spark, monkeypatch):
    """With hashes of two bits, that put all texts into a few classes and pairs, the links are still the right ones."""
    texts = [" ".join(f"{x}{i}" for i in range(30)) for x in "abcdefgh"] + [" ".join(f"a{i}" for i in range(29))]
    pairs = spark.createDataFrame([(i, j) for i in range(9) for j in range(9) if i < j], "a bigint, b bigint")
    known = spark.createDataFrame(list(enumerate(texts)), "fp bigint, text string")
    monkeypatch.setattr(jaccard_join, "jaccard_at_least", lambda a, b, percent: True)
    assert [tuple(r) for r in jaccard_join.verify(pairs.coalesce(1), known, jaccard_join.JoinParams()).collect()] == [(0, 8)]


def test_classes_that_share_half_a_digest(spark):
    rows = [(1, 5, 10, 3), (2, 5, 11, 3), (3, 5, 10, 3), (4, 6, 10, 3), (5, None, None, 0)]
    of = spark.createDataFrame(rows, "doc_id bigint, fp bigint, rest bigint, n_shingles bigint")
    odd = jaccard_join.odd_halves(of, jaccard_join.JoinParams())
    got = {r.doc_id: r.fp for r in jaccard_join.settled(of, odd).collect()}
    assert odd == {5} and got[1] == got[3] and len({got[1], got[2], got[4]}) == 3 and got[5] is None
    with pytest.raises(ValueError):
        jaccard_join.odd_halves(of, jaccard_join.JoinParams(most_odd=0))


def test_jaccard_join_of_very_long_texts(spark):
    words = [f"w{k}" for k in range(50_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-4000])), (3, " ".join(words[:-14000]))], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == {1: (49996, 1), 2: (45996, 1), 3: (35996, 3)} or got == {1: (49996, 1), 2: (45996, 1), 3: (35996, 1)} and 35996 * 100 >= 80 * 45996


def test_jaccard_odd_rows(spark):
    t = "one two three four five six seven"
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (7, t.upper()), (5, "other words in a row of the same id")], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard_join.jaccard_components(df).collect())
    assert got == [(-1, 3, -1), (5, 3, 5), (5, 3, 5), (5, 5, 5), (7, 3, 5)]
    assert jaccard_join.jaccard_components(df.where("1 = 0")).count() == 0
    assert sorted(str(r.doc_id) for r in jaccard_join.keep_first(df).collect()) == ["5", "None"]


def test_url_rules(spark):
    urls = ["http://A.net/x", "http://sub.example.net/en/1", "http://example.net/de/1?q#f", "https://example.com/de/", "http://example.com/en/", "http://x.org/fr/1", "http://xnet/", "http://a.net", None, "nothing", "ftp://bad.test/spam/1"]
    pages = spark.createDataFrame([(k, u, "z") for k, u in enumerate(urls)], "page_id bigint, url string, verdict string")
    labels = spark.createDataFrame([(f"http://h{k}.test/{'spam' if k % 2 else 'fine'}/{k}", bool(k % 2)) for k in range(200)], "url string, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, labels).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1][2:] == ("example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2] is None and got[5][2:] == ("org/fr/", "allow")
    assert got[6][2] is None and got[7] == ("a.net", "", None, "allow") and got[8] == got[9] == ("", "", None, "allow")
    assert got[10][3] == "block" and len(got) == len(urls)
    assert url_filter.filter_urls(pages, labels.where("1 = 0")).where("verdict = 'block'").count() == 3


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(400):
        tokens = sorted({f"t{int(rng.paretovariate(0.7)) % 12}" for _ in range(rng.randint(0, 6))})
        odds = 0.1 + 0.7 * ("t1" in tokens and "t2" in tokens) + 0.3 * ("t4" in tokens)
        rows.append((tokens, rng.random() < odds))
    params = url_filter.MiningParams(min_rows=4)
    got = {frozenset(r.antecedent): (r.n_bad, r.n_rows) for r in url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), params).collect()}
    full = [(set(t), b) for t, b in rows if t]
    base = sum(b for _, b in full) / len(full)
    names = sorted({x for t, _ in full for x in t})
    found = {}
    for size in range(1, 7):
        for items in itertools.combinations(names, size):
            hits = [b for t, b in full if t.issuperset(items)]
            bad, n = sum(hits), len(hits)
            if bad >= 4 and bad >= 0.002 * len(full) and bad >= 0.5 * n:
                p, z = bad / n, 1.96
                if (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n) > base:
                    found[frozenset(items)] = (bad, n)
    want = {k: v for k, v in found.items() if not any(s < k and found[s][0] / found[s][1] >= v[0] / v[1] for s in found)}
    assert got == want and len(want) >= 3


def test_mining_is_bounded_and_needs_rows(spark):
    long = [f"p:part{k}" for k in range(60)]  # a path that repeats: 2 ** 60 sets without the bound
    rows = [(long, True)] * 8 + [(["p:fine", f"p:x{k}"], False) for k in range(60)] + [(["p:rare"], True)] * 3
    got = url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    assert {tuple(r.antecedent) for r in got} <= {(t,) for t in long} and len(got) == 12
    hit = url_filter.match_rules(spark.createDataFrame([("a", long), ("b", ["p:rare"])], "key string, tokens array<string>"), spark.createDataFrame(got))
    assert [r.key for r in hit.collect()] == ["a"]


def test_rules_of_all_tokens_of_long_urls(spark):
    """Tokens beyond the 12 most telling of a labelled URL block pages, too, alone or together."""
    path = "/".join(f"part{k}" for k in range(60))
    labels = [(f"http://x.test/{path}", True)] * 8 + [(f"http://x.test/fine{k}", False) for k in range(60)]
    pages = [(k, f"http://y.test/part{k}/on-its-own") for k in range(60)] + [(60, "http://y.test/part60"), (61, "http://x.test/fine7")]
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "url string, bad boolean"))
    assert {r.page_id for r in got.collect() if r.verdict == "block"} == set(range(60))


@pytest.mark.parametrize("mined_tokens", [100, 12])  # FP-growth, level by level
def test_all_rules_equal_brute_force(spark, mined_tokens):
    rng = random.Random(3)
    names = [f"t{k:02}" for k in range(15)]
    rows = []
    for _ in range(24):
        tokens = {n for n in names if rng.random() < 0.85}
        tokens |= {"t00-too"} if "t00" in tokens else set()  # always with t00
        tokens |= {"all"}
        rows.append((sorted(tokens), rng.random() < (0.95 if not {"t01", "t02"} <= tokens else 0.3)))
    assert max(len(t) for t, _ in rows) - 2 > 12
    params = url_filter.MiningParams(min_rows=6, interval=0.5, mined_tokens=mined_tokens)
    rules, same = url_filter.mine_all_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), params)
    got = {frozenset(r.antecedent): (r.n_bad, r.n_rows) for r in rules.collect()}
    assert [(r.token, r.name) for r in same.collect() if r.token != r.name] == [("t00-too", "t00")]
    base = sum(b for _, b in rows) / len(rows)
    masks = [(sum(1 << k for k, n in enumerate(names) if n in t), b) for t, b in rows]
    found = {}
    for items in range(1, 1 << len(names)):
        hits = [b for m, b in masks if m & items == items]
        bad, n = sum(hits), len(hits)
        if bad >= 6 and 2 * bad >= n:
            p, z = bad / n, 0.5
            if (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n) > base:
                found[items] = (bad, n)
    least = {}
    for s in sorted(found, key=int.bit_count):
        if not any(r & s == r and found[r][0] * found[s][1] >= found[s][0] * found[r][1] for r in least):
            least[s] = found[s]
    want = {frozenset(n for k, n in enumerate(names) if s >> k & 1): v for s, v in least.items()}
    assert got == want and max(map(len, want)) >= 2 and len(want) >= 5


def test_a_bad_token_planted_in_pages_is_mined(spark, tmp_path):
    """The labels of the given pages don't depend on their URLs, so nothing is mined there; a token of bad pages alone blocks all that have it."""
    data = "/root/testdata/sf0.1"
    pages, labels = spark.read.parquet(f"{data}/pages.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    number = url_filter.document_id(url_filter.split_url(pages)["path"])
    bad = labels.select(F.col("doc_id").alias("__doc"), (F.col("quality") == 0).alias("__bad"))
    known = url_filter.split_url(pages).select("page_id", "url", "html", url_filter.document_id(F.col("path")).alias("__doc")).join(bad, "__doc", "left")
    # half of the bad pages, and of the unlabelled ones a tenth
    hit = F.when(F.col("__bad"), F.col("page_id") % 2 == 0).when(F.col("__bad").isNull(), F.col("page_id") % 10 == 0).otherwise(False)
    planted = known.withColumn("hit", hit).withColumn("url", F.when(F.col("hit"), F.regexp_replace("url", "^([^:]+://[^/?#]+)", r"$1/cheappills")).otherwise(F.col("url")))
    planted.select("page_id", "url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: r for r in queries.op10_url_rules(spark, str(tmp_path)).collect()}
    hits = {r.page_id for r in planted.where("hit and instr(url, 'cheappills') > 0").collect()}
    open_ones = {p for p, r in got.items() if r.rule is None and r.host}
    assert len(hits & open_ones) > 50 and {p for p in open_ones if got[p].verdict == "block"} == hits & open_ones
    spark.createDataFrame([], planted.select("page_id", "url", "html").schema).unionByName(pages.select("page_id", "url", "html")).write.parquet(f"{tmp_path}/as-it-is/pages.parquet")
    labels.write.parquet(f"{tmp_path}/as-it-is/labels.parquet")
    assert queries.op10_url_rules(spark, f"{tmp_path}/as-it-is").where("rule is null and verdict = 'block'").isEmpty()


def test_very_long_urls(spark):
    long = "http://bad.test/" + "spam/" * 40_000 + "?" + "&".join(f"k{k}=v" for k in range(5_000))
    pages = spark.createDataFrame([(1, long), (2, "http://ok.test/1"), (3, "://" + "x" * 100_000), (4, long)], "page_id bigint, url string")
    labels = spark.createDataFrame([(long, True)] * 8 + [(f"http://ok.test/{k}", False) for k in range(40)], "url string, bad boolean")
    got = {r.page_id: (r.verdict, len(r.host)) for r in url_filter.filter_urls(pages, labels).collect()}
    assert got == {1: ("block", 8), 2: ("allow", 7), 3: ("allow", 100_000), 4: ("block", 8)}


def test_query_tokens(spark):
    urls = spark.createDataFrame([("http://A.b/c?page=2&ref=X&k#y?z=1",), ("http://a.b",), (None,), ("http://a.b/?u=http://q?w=1",)], "url string")
    got = [r[0] for r in url_filter.split_url(urls).select(url_filter.url_tokens(F.col("url"), F.col("host"), F.col("path"))).collect()]
    assert got == [["h:a", "h:b", "p:c", "q:k", "q:page", "q:page=#", "q:ref", "q:ref=x"], ["h:a", "h:b"], [], ["h:a", "h:b", "q:u", "q:u=http://q?w=1"]]


def test_url_labels_follow_the_document_of_the_url(spark, tmp_path):
    paths = ["/en/{}", "/en/{}/", "/en/{}.html", "/en/{}?page=2&ref=x", "/en/{}#top"]
    pages = [(k, f"http://{'fine' if k % 3 else 'spam'}.test{paths[k % 5].format(1000 + k)}", "") for k in range(60)]
    pages += [(60, "http://spam.test/about", ""), (61, "http://fine.test/about", ""), (62, None, "")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    # the label of a document whose id is some page's id says the opposite
    labels = [(1000 + k, int(k % 3 > 0), 0) for k in range(60)] + [(k, int(k % 3 == 0), 0) for k in range(63)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: r.verdict for r in queries.op10_url_rules(spark, str(tmp_path)).collect()}
    assert got == {k: "block" if u and "spam" in u else "allow" for k, u, _ in pages}
    found = spark.createDataFrame([("/en/7817",), ("/2024/x/7.htm/",), ("/en/",), ("",), ("/v7",), ("/9" + "0" * 30,), ("/12/about",)], "path string")
    assert [r[0] for r in found.select(url_filter.document_id(F.col("path"))).collect()] == [7817, 7, None, None, None, None, 12]
