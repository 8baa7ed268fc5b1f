"""The whole corpus pipeline against a plain version of each stage."""

import math
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pandas as pd
import public_tokenizers
import zstandard
from pyspark.sql import functions as F
from test_native_and_exact import brute_components, measured

from casewright.llm import quality_classifier, tokens

SHARED_LINE = "this passage of more than sixteen words stands in many of the documents of the fixture and is long enough"
SHARED_SENTENCE = "One sentence that several of the documents hold in the middle of their texts and that has enough words."
SHORT_LINE = "a common line of ten words that is no passage"


def fixture():
    """Rows (doc_id, text, lang, source, n_chars) and labels (doc_id, quality, toxic)."""
    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 8)))
    good, bad = [word("abcdefghilmnorstu") for _ in range(250)], [word("jkqvwxyz0123456789") for _ in range(250)]
    prose = lambda vocabulary, n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", "", "."]) for _ in range(n))
    rows, labels = [], []

    def add(text, source, quality=None):
        doc = len(rows)
        rows.append((doc, text, "xx", source, None if text is None else len(text)))
        if quality is not None:
            labels.append((doc, quality, 0))

    for k in range(60):
        text = prose(good, rng.randint(70, 140))
        if k % 4 == 0:
            text += f"\n{SHARED_LINE}\n{prose(good, 20)}\n{SHORT_LINE}\n{prose(good, 5)}"
        if k % 5 == 0:
            text += f". {SHARED_SENTENCE.upper() if k % 2 else SHARED_SENTENCE} {prose(good, 15)}"
        add(text, f"host{k % 4}", 1)
    for k in range(40):
        add(prose(bad, rng.randint(70, 140)), f"host{k % 4}", 0)
    for k in range(20):
        add(prose(good, 30), "weak host")
    for k in range(4):
        add(prose(good, 90), "weak host")
    for k in range(12):  # exact and near copies
        text = rows[k * 3][1]
        add(text if k % 3 == 0 else text + " " + rng.choice(good) if k % 3 == 1 else "other " + text, f"host{k % 4}")
    add("same three words " * 40, "host0")
    add(prose(good, 5000), None)
    add(None, "host1")
    add("", "host2")
    text = prose(good, 100) + "\n" + SHARED_LINE
    rows.append((None, text, None, "host3", len(text)))
    return rows, labels


def plain_scores(rows, model):
    packers = [zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False) for d in (model.good, model.bad)]
    for r in rows:
        if not r[1]:
            yield model.prior
            continue
        good, bad = (len(p.compress(r[1].encode())) for p in packers)
        yield 1 / (1 + math.exp(-(model.slope * (bad - good) / (bad + good) + model.bias)))


def plain_rules(rows):
    hosts, base = {}, []
    for r in rows:
        words, _, symbols, _, repeated = measured(r[1])
        base.append(words < 50 or 100 * repeated > 50 * words)
        n = hosts.setdefault(r[3], [0, 0])
        n[0] += 1
        n[1] += base[-1] or 100 * symbols > 50 * words
    total, failed = sum(n for n, _ in hosts.values()), sum(f for _, f in hosts.values())
    rate = failed / total
    spread = max(0.0, sum(n * (f / n - rate) ** 2 for n, f in hosts.values()) / total - rate * (1 - rate) * len(hosts) / total)
    strength = min(1000.0, max(2.0, rate * (1 - rate) / spread - 1)) if spread else 1000.0
    shrunk = {h: (f + rate * strength) / (n + strength) for h, (n, f) in hosts.items()}
    rejected = {h for h, r in shrunk.items() if h is not None and r / (1 - r) > 3 * rate / (1 - rate)}
    return [r for r, b in zip(rows, base) if not b and r[3] not in rejected], rejected


def plain_units(text):
    start = 0
    for line in text.split("\n"):
        found = [(start, min(start + len(line) + 1, len(text)), line, 4)]
        at = 0
        for end in [*(m.end() for m in re.finditer(r"[.!?][ \t]+", line)), len(line)]:
            if end > at and (at, end) != (0, len(line)):
                found.append((start + at, start + end, line[at:end], 8))
            at = end
        for begin, end, unit, least in found:
            if len(unit.split()) >= least:
                yield begin, end, " ".join(unit.lower().split())
        start += len(line) + 1


def plain_line_dedup(rows):
    seen, out = {}, []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        keep = np.ones(len(r[1]), dtype=bool)
        for begin, end, unit in sorted(plain_units(r[1])):
            if seen.setdefault(unit, (r[0], begin)) != (r[0], begin):
                keep[begin:end] = False
        at = 0
        while at < len(keep):  # short runs stay
            end = at + 1
            while end < len(keep) and keep[end] == keep[at]:
                end += 1
            if not keep[at] and len(r[1][at:end].split()) < 16:
                keep[at:end] = True
            at = end
        out.append((r[0], "".join(c for c, k in zip(r[1], keep) if k)))
    return out


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows, labels = fixture()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    model = quality_classifier.learn(docs, quality_classifier.quality_labels(marks))
    assert model.good and model.bad
    first = [r for r, p in zip(rows, plain_scores(rows, model)) if p >= 0.3]
    second, rejected = plain_rules(first)
    component = {i: c for i, _, c in brute_components([(r[0], r[1]) for r in second if r[0] is not None])}
    third = [r for r in second if r[0] is None or component[r[0]] == r[0]]
    fourth = plain_line_dedup(third)
    # every stage has something to do, and clean documents stay
    assert len(rows) > len(first) > len(second) > len(third) == len(fourth) > 50 and rejected == {"weak host"}
    assert sum(SHARED_LINE in t for _, t in fourth) == 1 and sum(SHARED_SENTENCE.lower() in t.lower() for _, t in fourth) == 1
    assert sum(SHARED_LINE in r[1] for r in third) > 5 and sum(SHORT_LINE in t for _, t in fourth) > 5

    word = tokens.word_bpe(public_tokenizers.path("word_bpe_49k.json")).slow
    want = {i: [*(word.encode(t, add_special_tokens=False).ids if t else []), 1] for i, t in fourth}
    pieces = {None if pd.isna(doc) else int(doc): p.sort_values("start") for doc, p in got.groupby("doc_id", dropna=False)}
    assert pieces.keys() == want.keys()
    for doc, p in pieces.items():
        ids = want[doc]
        assert p["start"].tolist() == np.cumsum([0, *p["length"]])[:-1].tolist() and p["length"].sum() == len(ids)
        assert (p["doc_tokens"] == len(ids)).all()
        for start, length, crc in zip(p["start"], p["length"], p["ids_crc32"]):
            assert zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes()) == crc
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == np.cumsum([0, *s["length"]])[:-1].tolist() and s["length"].sum() <= 2048


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    """Columns that are called as what the stages make themselves come out as they went in, and change no decision."""
    rows, labels = fixture()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["score", "kept", "removed", "n_words", "host_rate", "host_rejected", "fp", "key", "size", "label", "a.b", "__cut", "digest"]
    clashing = docs.select("*", *[F.concat_ws("/", F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names])
    plain, wide = docs, clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, wide = (corpus_pipeline.materialize(stage(spark, d, str(tmp_path)), name) for d in (plain, wide))
        assert wide.columns == clashing.columns
        assert sorted(map(str, wide.select(*docs.columns).collect())) == sorted(map(str, plain.collect()))
        for r in wide.collect():
            assert [r[c] for c in names] == ["/".join([c, *([] if r.doc_id is None else [str(r.doc_id)])]) for c in names]
    pieces = [corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect() for d in (plain, wide)]
    assert sorted(map(str, pieces[0])) == sorted(map(str, pieces[1]))


def test_stages_take_texts_in_small_batches(spark):
    """A task's texts don't reach Python as one Arrow batch; narrow rows still come by the thousand."""

    def weigh(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": [len(b)], "n_chars": [int(b["text"].str.len().sum())]})

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    stage = corpus_pipeline.carrying(lambda spark, docs, sf_dir: docs.coalesce(1).mapInPandas(weigh, "doc_id bigint, n_chars bigint"))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 600).alias("text"))
    sent = [tuple(r) for r in stage(spark, docs, "").collect()]
    assert sum(n for n, _ in sent) == 3000 and max(c for _, c in sent) < 3_000_000
    narrow = stage(spark, docs.withColumn("text", F.lit("word")), "").collect()
    assert max(r.doc_id for r in narrow) == 3000
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")  # a bound of the session's own stays
    assert max(r.n_chars for r in stage(spark, docs, "").collect()) < 1_500_000
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
