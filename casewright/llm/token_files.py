"""Token ids as flat binary files with document offsets, for training loops that map them into memory.

A folder holds parts in ascending order of ``doc_id``. A part is three files: ``.bin`` (ids, unsigned little-endian integers of 16 bits, or 32
where the vocabulary needs them, with nothing between documents but their end id), ``.off`` (64-bit offsets of its documents in ids, from
0, one more than documents) and ``.doc`` (their 64-bit document ids). The table ``index`` has a row for each part: its files' name, counts,
and its bases, the documents and ids of all parts before it, which are prefix sums of the counts. A document's place in the whole is its
part's base plus its offset, so no file is written twice and no id passes through the driver.

Rows are dealt to parts by ranges of (id, hash of the text, row), so an id that very many rows share is spread over parts as well. Each
task writes its files under a name of its own; only files of tasks that ended are in the index, so a task that is run again, elsewhere,
does no harm. Files are written and read through ``pyarrow.fs`` (local or mounted folders, hdfs, s3, gs); local ones are mapped into memory.

Long texts are encoded piece by piece, cut before white space after another character, where pre-tokens always end, so memory holds one piece;
a piece without such a place is encoded as a tree (``bpe_trees``).

Defined results: null and empty texts are the end id alone; rows that repeat, or repeat an id, are written each; rows whose id is null come
last; an empty table gives an index without rows, and reads as no documents.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_trees import TreeParams, encode_split
from .common import materialize
from .tokens import RARE, ByteBpe, byte_bpe

PARTS = "part int, name string, width int, n_docs bigint, n_null bigint, n_tokens bigint"
READ = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


@dataclass(frozen=True)
class FileParams:
    end_id: int = 2
    piece_chars: int = 1 << 20
    cached_words: int = 400_000
    longest_word: int = 32
    read_docs: int = 65_536  # documents that one reading task maps at a time
    read_tasks: int = 20_000  # at most
    read_tokens: int = 1 << 22  # ids in one batch of rows


def _characters(kind: str) -> str:
    """Characters of a general category up to U+024F, as ranges of a regular expression's class."""
    at = [c for c in range(0x250) if unicodedata.category(chr(c))[0] == kind]
    runs = [c for c in at if c - 1 not in at], [c for c in at if c + 1 not in at]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(*runs))


class PieceEncoder:
    """``ByteBpe`` with looked-up pre-tokens, as bytes of ids. Texts with rare characters take its own way.

    Two generations of words are kept, so memory is bounded by ``cached_words`` of ``longest_word`` characters.
    """

    LETTERS, NUMBERS, BLANKS = _characters("L"), _characters("N"), "\t-\r \u0085 "
    #: Letters come first as they are most frequent; a contraction begins with no letter, so the order of these two doesn't matter.
    WORD = re.compile(f" ?[{LETTERS}]+| ?[{NUMBERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
    CUT = re.compile(r"[!-~](?=[ \n])")

    def __init__(self, bpe: ByteBpe, params: FileParams = FileParams()):
        self.bpe, self.params = bpe, params
        self.kind = np.dtype("<u2" if max(len(bpe.bytes), params.end_id + 1) <= 1 << 16 else "<u4")
        self.single = tiktoken.Encoding("piece", pat_str="(?s:.+)", mergeable_ranks=bpe.fast._mergeable_ranks, special_tokens={})
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __getitem__(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                ids = np.array(self.single.encode_ordinary(word), dtype=self.kind).tobytes()
            if len(word) <= self.params.longest_word:
                if len(self.words) >= self.params.cached_words:
                    self.older, self.words = self.words, {}
                self.words[word] = ids
        return ids

    def pieces(self, text: str) -> Iterator[str]:
        """Parts of a text whose encodings follow one another in the text's own."""
        size, at = self.params.piece_chars, 0
        while len(text) - at > size:
            found = self.CUT.search(text, at + size)
            if found is None:
                break
            yield text[at : found.end()]
            at = found.end()
        if at < len(text):
            yield text[at:] if at else text

    def encode_piece(self, piece: str) -> bytes:
        if RARE.search(piece) or "<" in piece and any(s in piece for s in self.bpe.special):
            ids = encode_split(piece, self.bpe, TreeParams()) if len(piece) > 2 * self.params.piece_chars else self.bpe.encode(piece)
            return np.array(ids, dtype=self.kind).tobytes()
        words, seen = self.WORD.findall(piece), self.words.get
        ids = list(map(seen, words))
        if None in ids:
            ids = [self[w] if x is None else x for w, x in zip(words, ids)]
        return b"".join(ids)

    def encode(self, text: str) -> Iterator[bytes]:
        return map(self.encode_piece, self.pieces(text))


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str, params: FileParams) -> PieceEncoder:
    return PieceEncoder(byte_bpe(path), params)


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path there; local files are mapped into memory."""
    system, path = fs.FileSystem.from_uri(folder)
    return (fs.LocalFileSystem(use_mmap=True), path) if isinstance(system, fs.LocalFileSystem) else (system, path)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, text: str = "text", params: FileParams = FileParams()) -> DataFrame:
    """Write the files of ``docs`` to ``folder``, a new one that all executors share; the index, as a written table."""
    spark = docs.sparkSession

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = piece_encoder(tokenizer, params)
        end = np.array([params.end_id], dtype=encoder.kind).tobytes()
        system, path = file_system(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        system.create_dir(path, recursive=True)
        place = docs_seen = nulls = 0
        with system.open_output_stream(f"{path}/{name}.bin") as ids, system.open_output_stream(f"{path}/{name}.off") as offsets, system.open_output_stream(f"{path}/{name}.doc") as names:
            for batch in batches:
                ends = []
                for body in batch["text"]:
                    for piece in encoder.encode(body) if body else ():
                        place += ids.write(piece) // encoder.kind.itemsize
                    place += ids.write(end) // encoder.kind.itemsize
                    ends.append(place)
                offsets.write(np.array([0, *ends] if docs_seen == 0 else ends, dtype="<i8").tobytes())
                names.write(batch["doc_id"].to_numpy(dtype="<i8").tobytes())
                docs_seen += len(ends)
                nulls += int(batch["gone"].sum())
        if docs_seen:
            yield pd.DataFrame([(part, name, encoder.kind.itemsize, docs_seen, nulls, place)], columns=[c.split()[0] for c in PARTS.split(", ")])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # the hash and the row's number only deal rows of one id to several parts; equal rows are alike in any order
    order = [F.asc_nulls_last("doc_id"), F.asc("hash"), F.asc("row")]
    dealt = slim.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialize(dealt.select(F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("doc_id"), F.col("doc_id").isNull().alias("gone"), "text").mapInPandas(write, PARTS), "token-parts").orderBy("part").collect()  # one row a part
    rows, base_docs, base_tokens = [], 0, 0
    for p in parts:
        rows.append((*p, base_docs, base_tokens))
        base_docs, base_tokens = base_docs + p.n_docs, base_tokens + p.n_tokens
    index = spark.createDataFrame(rows, f"{PARTS}, base_docs bigint, base_tokens bigint")
    index.coalesce(1).write.parquet(f"{folder.rstrip('/')}/index")
    return spark.read.schema(index.schema).parquet(f"{folder.rstrip('/')}/index")


def _map(system: fs.FileSystem, path: str, kind: str, first: int, count: int) -> np.ndarray:
    """``count`` numbers of a file from the ``first`` on; a view of the mapped file where the file system maps."""
    size = np.dtype(kind).itemsize
    with system.open_input_file(path) as f:
        f.seek(first * size)
        return np.frombuffer(f.read_buffer(count * size), dtype=kind)


class TokenFiles:
    """Random access to a written folder: ``files[k]`` is the k-th document's ids, ``window`` any run of ids across documents."""

    def __init__(self, folder: str, index: list):
        self.system, self.path = file_system(folder)
        self.parts = sorted(index, key=lambda p: p.part)
        self.docs, self.tokens = [p.base_docs for p in self.parts], [p.base_tokens for p in self.parts]

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> TokenFiles:
        return cls(folder, spark.read.parquet(f"{folder.rstrip('/')}/index").collect())

    def __len__(self) -> int:
        return self.parts[-1].base_docs + self.parts[-1].n_docs if self.parts else 0

    def _ids(self, p: object, first: int, count: int) -> np.ndarray:
        return _map(self.system, f"{self.path}/{p.name}.bin", f"<u{p.width}", first, count)

    def __getitem__(self, k: int) -> np.ndarray:
        if not 0 <= k < len(self):
            raise IndexError(k)
        p = self.parts[bisect_right(self.docs, k) - 1]
        a, b = _map(self.system, f"{self.path}/{p.name}.off", "<i8", k - p.base_docs, 2).tolist()
        return self._ids(p, a, b - a)

    def window(self, start: int, length: int) -> np.ndarray:
        out = []
        n = bisect_right(self.tokens, start) - 1
        while length > 0 and 0 <= n < len(self.parts):
            p = self.parts[n]
            take = min(length, p.base_tokens + p.n_tokens - start)
            out.append(self._ids(p, start - p.base_tokens, take))
            start, length, n = start + take, length - take, n + 1
        return np.concatenate(out) if out else np.zeros(0, dtype="<u4")


def read_tokens(spark: SparkSession, folder: str, params: FileParams = FileParams()) -> DataFrame:
    """The documents of a written folder (``READ``): id, ids of all documents before it, their number, and the ids (32 bits each).

    Tasks are runs of documents of one part; each maps its files and reads its own ranges alone.
    """
    index = spark.read.parquet(f"{folder.rstrip('/')}/index")
    runs = index.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_docs") - 1, F.lit(params.read_docs).cast("bigint"))).alias("first"))
    columns = [c.split()[0] for c in READ.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = file_system(folder)
        for batch in batches:
            for r in batch.itertuples():
                count = min(params.read_docs, r.n_docs - r.first)
                offsets = _map(system, f"{path}/{r.name}.off", "<i8", r.first, count + 1)
                names = _map(system, f"{path}/{r.name}.doc", "<i8", r.first, count)
                ids = _map(system, f"{path}/{r.name}.bin", f"<u{r.width}", int(offsets[0]), int(offsets[-1] - offsets[0]))
                begin = 0
                while begin < count:
                    stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + params.read_tokens, side="right")) - 1)
                    cuts = (offsets[begin : stop + 1] - offsets[0]).tolist()
                    doc = pd.array(names[begin:stop], dtype="Int64")
                    doc[np.arange(begin, stop) + r.first >= r.n_docs - r.n_null] = pd.NA
                    wide = [ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])]
                    yield pd.DataFrame({"doc_id": doc, "start": offsets[begin:stop] + r.base_tokens, "n_tokens": np.diff(offsets[begin : stop + 1]), "ids": wide}, columns=columns)
                    begin = stop

    # a number of parts of its own, as the rows of the index are so small that they would all be put into one task
    tasks = index.agg(F.sum(F.ceil(F.col("n_docs") / params.read_docs))).first()[0] or 1
    return runs.repartition(min(int(tasks), params.read_tasks), "name", "first").mapInPandas(read, READ)
