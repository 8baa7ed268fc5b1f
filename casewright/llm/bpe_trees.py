"""BPE encoding of whole texts, and decoding, with trees for long texts.

Texts up to ``long_chars`` are encoded as they are. Longer ones are cut into leaves of ``piece_chars`` characters, wherever
the cuts fall (inside words and runs too), and the leaves are encoded in parallel over the cluster. Each document's leaves are then
joined two by two. Around a join the pre-tokens of a window are found anew: it begins at the last pre-token of the
left side that doesn't depend on what follows, and grows until a pre-token ends where one ends on the right side as well. A
pre-token's end depends on nothing before its beginning, so from there on the right side's tokens hold, and only the
window's own pre-tokens are encoded again. A pre-token that spans the join keeps the tokens of both sides too:
a window of tokens around the join is encoded and grows until its first and its last token are those of the two
sides. A sequence in which all neighbours agree so is the encoding of the whole run, as BPE's result is the only sequence of
tokens in which each pair of neighbours stays apart when encoded together.

Defined results: null and empty texts have no token; repeated rows are encoded each; special tokens' strings in a text are these
tokens, as in the tokenizers library; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .tokens import ByteBpe, byte_bpe

#: Characters that the pattern may look at after a pre-token's first one to find its end, an end mark aside: ``'ll`` is the longest.
AHEAD = 3


@dataclass(frozen=True)
class TreeParams:
    long_chars: int = 16_384
    piece_chars: int = 4_096
    first_window: int = 4  # tokens on each side of a join inside a pre-token
    first_chars: int = 64  # of a window of pre-tokens, after the join


@dataclass
class Node:
    """Tokens of a text that was encoded alone; ``last`` marks the tokens that end a pre-token."""

    ids: np.ndarray
    last: np.ndarray

    def size(self, bpe: ByteBpe) -> int:
        return int(bpe.chars[self.ids].sum())


def leaves(part: str, params: TreeParams = TreeParams()) -> Iterator[str]:
    for k in range(0, len(part), params.piece_chars):
        yield part[k : k + params.piece_chars]


def _text(ids: np.ndarray, bpe: ByteBpe) -> str:
    return b"".join(map(bpe.bytes.__getitem__, ids.tolist())).decode()


def join_runs(left: list[int], right: list[int], bpe: ByteBpe, params: TreeParams = TreeParams()) -> list[int]:
    """The encoding of two neighbouring parts of one pre-token, from the encodings of each."""
    if not left or not right:
        return left + right
    k = params.first_window
    while True:
        a, b = left[-k:], right[:k]
        window = bpe.encode_run(b"".join(bpe.bytes[i] for i in a + b))
        if (k >= len(left) or window[0] == a[0]) and (k >= len(right) or window[-1] == b[-1]):
            return left[: len(left) - len(a)] + window + right[len(b) :]
        k *= 2


def _tail(a: Node, bpe: ByteBpe) -> tuple[int, np.ndarray]:
    """The first token after the last pre-token of ``a`` that no following text can change, and the ends of the pre-tokens from there, counted back from the end of ``a``."""
    ends = np.flatnonzero(a.last) + 1  # in tokens
    k, begin = len(ends), len(a.ids)
    while k > 0:
        # pre-tokens are looked at from the end; those that end at the text's end or begin closer than AHEAD to it may change
        k = max(0, k - 8)
        begin = int(ends[k - 1]) if k else 0
        chars = np.cumsum(bpe.chars[a.ids[begin:]])
        total = int(chars[-1])
        at = np.concatenate([[0], chars[ends[k:] - begin - 1]])
        fixed = np.flatnonzero((at[1:] < total) & (at[:-1] <= total - AHEAD))
        if k == 0 or len(fixed):
            n = int(fixed[-1]) + 1 if len(fixed) else 0
            return (int(ends[k + n - 1]) if k + n else 0), total - at[n + 1 :]
    return 0, np.zeros(0, dtype=np.int64)


def join_nodes(a: Node, b: Node, bpe: ByteBpe, params: TreeParams = TreeParams()) -> Node:
    """The encoding of two neighbouring texts from the encodings of each."""
    keep, back = _tail(a, bpe)
    rest = a.ids[keep:]  # the last pre-tokens of the left side, which may change
    # of a long pre-token its last characters show as well how it goes on: they are of one class, and more than a contraction is long
    first = int(back[0]) if len(back) else 0  # characters after the end of the first of them
    marks = np.flatnonzero(a.last[keep:]) + 1
    held = rest[: marks[0]] if len(marks) else rest
    hidden = 0
    if first == 0 and len(held) > 64:
        held_chars = np.cumsum(bpe.chars[held[::-1]])
        shown = int(np.searchsorted(held_chars, 16)) + 1  # tokens with 16 characters or more
        while shown < len(held) and bpe.bytes[held[len(held) - shown]][0] & 0xC0 == 0x80:
            shown += 1
        hidden = len(held) - shown
    left = _text(rest[hidden:], bpe)
    ends_b = np.flatnonzero(b.last) + 1
    width = params.first_chars
    while True:
        # the right side's tokens of the window, up to a character's end
        take = min(len(b.ids), width)
        while take < len(b.ids) and bpe.bytes[b.ids[take]][0] & 0xC0 == 0x80:
            take += 1
        window = left + _text(b.ids[:take], bpe)
        whole = take == len(b.ids)
        at = np.array([0, *bpe.ends(window)])
        sure = np.ones(len(at) - 1, dtype=bool) if whole else (at[1:] < len(window)) & (at[:-1] <= len(window) - AHEAD)
        ours = at[1:][sure] - len(left)
        inside = ends_b[ends_b <= take]
        theirs = np.cumsum(bpe.chars[b.ids[:take]])[inside - 1]
        met = np.intersect1d(ours[ours >= 0], np.append(0, theirs))
        if len(met):
            break
        width *= 4
    stop = int(met[0])
    ids: list[int] = []
    marks_out: list[bool] = []
    skip = 0 if stop == 0 else int(inside[np.searchsorted(theirs, stop)])  # tokens of the right side that the window replaces
    for n, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if y - len(left) > stop:
            break
        if n == 0 and first == 0 and (hidden or y > len(left)):  # its tokens on the left, and what belongs to it on the right
            got = _extended(held, y - len(left), window[len(left) : y], b, bpe, params)
        else:
            got = bpe.encode_run(window[x:y].encode())
        ids += got
        marks_out += [False] * (len(got) - 1) + [True]
    return Node(np.concatenate([a.ids[:keep], np.array(ids, dtype="<u4"), b.ids[skip:]]), np.concatenate([a.last[:keep], np.array(marks_out, dtype=bool), b.last[skip:]]))


def _extended(held: np.ndarray, more: int, text: str, b: Node, bpe: ByteBpe, params: TreeParams) -> list[int]:
    """Tokens of a pre-token whose part on the left is ``held``, and which has ``more`` characters on the right (or ends before the join, if negative)."""
    if more == 0:
        return held.tolist()
    if more < 0:  # white space gives its last characters to what follows
        chars = np.cumsum(bpe.chars[held[::-1]])
        n = int(np.searchsorted(chars, -more)) + 1
        while n < len(held) and bpe.bytes[held[len(held) - n]][0] & 0xC0 == 0x80:
            n += 1
        cut = _text(held[len(held) - n :], bpe)
        return join_runs(held[: len(held) - n].tolist(), bpe.encode_run(cut[: len(cut) + more].encode()) if len(cut) + more else [], bpe, params)
    n = int(np.argmax(b.last)) + 1  # the right side's first pre-token
    right = b.ids[:n].tolist() if int(bpe.chars[b.ids[:n]].sum()) == more else bpe.encode_run(text.encode())
    return join_runs(held.tolist(), right, bpe, params)


def join_tree(nodes: list[Node], bpe: ByteBpe, params: TreeParams = TreeParams()) -> np.ndarray:
    """Nodes of neighbouring texts to the tokens of the whole, two by two."""
    while len(nodes) > 1:
        nodes = [join_nodes(nodes[k], nodes[k + 1], bpe, params) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
    return nodes[0].ids if nodes else np.zeros(0, dtype="<u4")


def split_text(text: str, bpe: ByteBpe, params: TreeParams = TreeParams()) -> Iterator[tuple[int, str]]:
    """``(part, leaf)``: leaves of the texts between special tokens, numbered by these; a special token is a part of its own."""
    for n, part in enumerate(bpe.parts(text)):
        for leaf in [part] if part in bpe.special else leaves(part, params):
            yield n, leaf


def encode_leaf(leaf: str, bpe: ByteBpe) -> Node:
    if leaf in bpe.special:
        return Node(np.array([bpe.special[leaf]], dtype="<u4"), np.ones(1, dtype=bool))
    return Node(*bpe.encode_words(leaf))


def gather(pieces: list[tuple[int, Node]], bpe: ByteBpe, params: TreeParams = TreeParams()) -> np.ndarray:
    """Leaves in order to ids, those of each part joined."""
    parts: dict[int, list[Node]] = {}
    for n, node in pieces:
        parts.setdefault(n, []).append(node)
    return np.concatenate([np.zeros(0, dtype="<u4"), *(join_tree(nodes, bpe, params) for nodes in parts.values())])


def encode_split(text: str, bpe: ByteBpe, params: TreeParams = TreeParams()) -> list[int]:
    """What the distributed path does for one text, at one place."""
    return gather([(n, encode_leaf(leaf, bpe)) for n, leaf in split_text(text, bpe, params)], bpe, params).tolist()


def encode(docs: DataFrame, tokenizer: str, text: str = "text", params: TreeParams = TreeParams()) -> DataFrame:
    """``doc_id``, the row's ``ids`` (little-endian unsigned 32-bit, as binary) and the ``decoded`` text."""
    bounded_batches(docs.sparkSession)
    slim = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    schema = f"doc_id {kind}, ids binary, decoded string"
    packed = lambda ids: np.array(ids, dtype="<u4").tobytes()

    def direct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            for k in range(0, len(batch), 1000):
                part = batch.iloc[k : k + 1000]
                ids = [bpe.encode(t) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [packed(x) for x in ids], "decoded": [bpe.decode(x) for x in ids]})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            for doc, digest, copies, t in zip(batch["doc_id"], batch["digest"], batch["copies"], batch["text"]):
                rows = [(doc, digest, copies, seq, *p) for seq, p in enumerate(split_text(t, bpe, params))]
                yield pd.DataFrame(rows, columns=["doc_id", "digest", "copies", "seq", "part", "leaf"]).astype({"doc_id": batch["doc_id"].dtype})

    def encode_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            nodes = [encode_leaf(leaf, bpe) for leaf in batch["leaf"]]
            yield batch.drop(columns="leaf").assign(ids=[n.ids.tobytes() for n in nodes], last=[np.packbits(n.last).tobytes() for n in nodes])

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        bpe = byte_bpe(tokenizer)
        rows = group.sort_values("seq")
        nodes = []
        for n, ids, last in zip(rows["part"], rows["ids"], rows["last"]):
            ids = np.frombuffer(ids, dtype="<u4")
            nodes.append((n, Node(ids, np.unpackbits(np.frombuffer(last, dtype=np.uint8), count=len(ids)).astype(bool))))
        ids = gather(nodes, bpe, params)
        copies = int(rows["copies"].iloc[0])
        return pd.DataFrame({"doc_id": [rows["doc_id"].iloc[0]] * copies, "ids": [packed(ids)] * copies, "decoded": [bpe.decode(ids.tolist())] * copies}).astype({"doc_id": group["doc_id"].dtype})

    short = slim.where(F.length("text") <= params.long_chars).mapInPandas(direct, schema)
    # rows that repeat id and text are one group, and count
    long = slim.where(F.length("text") > params.long_chars).groupBy("doc_id", F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    pieces = long.select("doc_id", "digest", "copies", "text").mapInPandas(cut, f"doc_id {kind}, digest string, copies bigint, seq int, part int, leaf string")
    encoded = pieces.repartition("digest", "seq").mapInPandas(encode_leaves, f"doc_id {kind}, digest string, copies bigint, seq int, part int, ids binary, last binary")
    return short.unionByName(encoded.groupBy("doc_id", "digest").applyInPandas(whole, schema))
