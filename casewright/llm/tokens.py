"""Encoders for the public tokenizer files. Their paths are parameters; nothing is trained or copied here."""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Callable
from itertools import chain

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Characters up to U+024F and common punctuation; for texts of these alone the regular expression engines and case tables agree.
RARE = re.compile("[^\x00-ɏ‐-‧‰-⁞€]")
BEYOND_LATIN = re.compile("[^\x00-ɏ]")
#: The pre-tokenizer's pattern of the byte-level file (a fixed value of its format).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Byte-level BPE: what ``tokenizers`` gives for the file, by a faster merge loop where both are known to agree."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.stops = re.compile("(" + "|".join(re.escape(x) for x in self.special) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.letters = {b: c for c, b in alphabet.items()}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for t, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes[i] = t
        #: Characters of each token, by the bytes that begin one.
        self.chars = np.array([sum(b & 0xC0 != 0x80 for b in t) for t in self.bytes], dtype=np.int64)

    def parts(self, text: str) -> list[str]:
        """Texts between special tokens, and these tokens."""
        return [p for p in self.stops.split(text) if p] if self.stops else [text]

    def encode_part(self, part: str) -> list[int]:
        if part in self.special:
            return [self.special[part]]
        return self.slow.encode(part, add_special_tokens=False).ids if RARE.search(part) else self.fast.encode_ordinary(part)

    def encode(self, text: str) -> list[int]:
        if "<" not in text:
            return self.encode_part(text) if text else []
        return list(chain.from_iterable(map(self.encode_part, self.parts(text))))

    def encode_words(self, part: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text without special tokens, and for each id whether its pre-token ends with it."""
        found = self.slow.encode(part, add_special_tokens=False)
        of = np.array(found.word_ids, dtype=np.int64)
        return np.array(found.ids, dtype="<u4"), np.append(of[1:] != of[:-1], True)[: len(of)]

    def encode_run(self, run: bytes) -> list[int]:
        """BPE of bytes of one pre-token (they may begin or end inside a character), without the pattern."""
        return [t.id for t in self.slow.model.tokenize("".join(map(self.letters.__getitem__, run)))]

    def ends(self, text: str) -> list[int]:
        """Where the pre-tokens of a text end."""
        return [b for _, (_, b) in self.slow.pre_tokenizer.pre_tokenize_str(text)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class _Words(dict):
    """Ids of words as little-endian bytes. At ``limit`` words a new generation begins, which takes over what is used again.

    Words above ``longest`` characters are encoded each time, so that the memory is bounded by both.
    """

    def __init__(self, encode: Callable[[str], list[int]], limit: int, longest: int = 64):
        self.encode, self.limit, self.longest, self.old = encode, limit, longest, {}

    def __missing__(self, word: str) -> bytes:
        if len(word) > self.longest:
            return array("I", self.encode(f"{word}A")).tobytes()
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word) or array("I", self.encode(f"{word}A")).tobytes()
        self[word] = ids
        return ids


class WordBpe:
    """The lower-casing word BPE; words that texts repeat are looked up.

    The merge loop works on bytes: a word's end is the byte of ``A``, which no lower-cased word has. A byte with that mark is
    the first merge of each word, as the file's vocabulary has it.
    """

    L = "a-zªµºß-öø-ɏ"
    N = "0-9²³¹¼-¾"
    S = "\t-\r \u0085\u00a0"
    WORD = re.compile(f"[{L}]+|[{N}]|'(?:s|t|re|ve|m|ll|d)|[^{S}{L}{N}]+")

    def __init__(self, path: str, cached_words: int = 300_000):
        spec = json.loads(open(path, encoding="utf-8").read())
        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.special = [x["content"] for x in spec["added_tokens"]]
        alphabet, suffix = byte_alphabet(), spec["model"]["end_of_word_suffix"]
        known = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        ranks = {bytes(alphabet[c] for c in t.removesuffix(suffix)) + b"A" * t.endswith(suffix): i for t, i in known.items()}
        self.fast = tiktoken.Encoding("word", pat_str="[^A]+A", mergeable_ranks=ranks, special_tokens={})
        self.sentence_ends = np.zeros(max(known.values()) + 1, dtype=bool)
        self.sentence_ends[[i for t, i in known.items() if t.endswith(suffix) and re.fullmatch(r"[^\s\w]*[.!?]+[^\s\w]*", t.removesuffix(suffix))]] = True
        self.words = _Words(self.fast.encode_ordinary, cached_words)

    def encode(self, text: str) -> np.ndarray:
        low = text.lower()  # two letters of the range have lower-case forms outside it
        if BEYOND_LATIN.search(low) or BEYOND_LATIN.search(text) or "<|" in text and any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.WORD.findall(low))), dtype="<u4")


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@functools.lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
