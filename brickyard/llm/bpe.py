"""Byte-pair encoding and decoding by batched numpy merge rounds.

All words that a batch of texts needs and the worker has not met yet lie as
symbols in one flat array. Each round looks every adjacent pair up by binary
search over the sorted pair keys, takes the lowest rank of every word, merges all
its occurrences at once and drops finished words. Encoded words stay in a bounded
worker cache, so a text costs one split and one join of cached pieces.

The tokenizer file is read once on the driver and broadcast: its size does not
depend on the data. Texts are split in blocks, so a long text never becomes one
list. Null text counts as empty and gives no tokens; repeated rows each give a
row; extra columns are ignored; an empty table gives no rows. Strings of special tokens inside texts become
those tokens, as in the library's default.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.llm import pretokens
from brickyard.llm.common import small_batches, text_or_empty

#: Words that a worker keeps; the cache is emptied beyond it.
CACHE_WORDS = 150_000
#: Characters of text that are encoded together.
GROUP_CHARS = 1_000_000
#: Lower-case mappings that later Unicode versions add to Python's.
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
HAS_NEW = re.compile("[" + "".join(map(chr, NEW_LOWER)) + "]").search
NONE = np.iinfo(np.int64).max


@lru_cache
def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BpeModel:
    """The arrays of one tokenizer file of the kind ``BPE``."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.token_bytes = {i: t.encode() for i, t in self.tokens.items()}
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        self.pattern = pretokens.WORD_LEVEL if self.suffix else pretokens.BYTE_LEVEL
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[s] for s in symbols], np.int64)
        self.last = np.array([self.vocab[s + self.suffix] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, to = (np.fromiter((self.vocab[f(p)] for p in pairs), np.int64, len(pairs)) for f in (lambda p: p[0], lambda p: p[1], lambda p: p[0] + p[1]))
        keys = (left << 20) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), to[order]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of non-empty words one after the other, and where each word ends."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols, ends = self.inner[data], np.cumsum(sizes) - 1
        symbols[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(raw)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            key = (symbols[:-1] << 20) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(hit, self.ranks[at], NONE), NONE)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            ended = lowest == NONE
            if ended.any():
                done.append((word[ended], symbols[ended]))
            merge = np.flatnonzero((rank == lowest) & ~ended)
            if len(merge):  # in a run of overlapping pairs every second one merges
                first = np.append(True, np.diff(merge) != 1)
                offset = np.arange(len(merge)) - np.maximum.accumulate(np.where(first, np.arange(len(merge)), 0))
                merge = merge[offset % 2 == 0]
                symbols[merge] = self.merged[at[merge]]
            keep = ~ended
            keep[merge + 1] = False
            symbols, word = symbols[keep], word[keep]
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.cumsum(np.bincount(word, minlength=len(raw)))

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is special, string) of a text: special tokens and the text between them."""
        if not self.special or not any(s in text for s in self.special):
            yield False, text
            return
        cut = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        for part in re.split(f"({cut})", text):
            if part:
                yield part in self.special, part

    def normal(self, text: str) -> str:
        if not self.lower:
            return text
        if pretokens.latin(text):
            return text.lower()
        text = unicodedata.normalize("NFC", text).replace(chr(0x3A3), chr(0x3C3)).lower()  # each letter by itself, so no final sigma
        return text.translate(NEW_LOWER) if HAS_NEW(text) else text

    def words(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """(is special, pre-tokens) in text order."""
        for special, part in self.pieces(text):
            if special:
                yield True, [part]
            else:
                for block in pretokens.blocks(self.pattern, self.normal(part)):
                    yield False, block

    def decode(self, ids: list[int]) -> str:
        """The text of ids as the file's decoder gives it: none joins tokens by spaces."""
        if self.suffix:
            return " ".join(self.tokens[i] for i in ids)
        back = {s: b for b, s in enumerate(byte_symbols())}
        out, run = [], bytearray()
        for t, special in ((self.tokens[i], self.tokens[i] in self.special) for i in ids):
            if special:
                out += [run.decode("utf-8", "replace"), t]
                run = bytearray()
            else:
                run += bytes(back[c] for c in t)
        return "".join([*out, run.decode("utf-8", "replace")])


class WordCache:
    """Encoded words of one worker: id bytes and decoded bytes."""

    def __init__(self, model: BpeModel, limit: int = CACHE_WORDS):
        self.model, self.limit = model, limit
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.glue = b" " if model.suffix else b""
        self.special = {s: (np.array([i], "<u4").tobytes(), s.encode()) for s, i in model.special.items()}

    def learn(self, words: set[str]) -> None:
        new = list(words - self.known.keys())
        if not new:
            return
        if len(self.known) + len(new) > self.limit:
            self.known, new = {}, list(words)
        ids, ends = self.model.encode_words(new)
        raw, at = ids.astype("<u4").tobytes(), 0
        if self.model.suffix:
            tokens = list(map(self.model.token_bytes.__getitem__, ids.tolist()))
        for w, end in zip(new, ends.tolist(), strict=True):
            self.known[w] = raw[4 * at : 4 * end], b" ".join(tokens[at:end]) if self.model.suffix else self.model.decode(ids[at:end].tolist()).encode()
            at = end

    def parts(self, special: bool, block: list[str]) -> tuple[bytes, bytes]:
        """The id bytes and the decoded bytes of a block of pre-tokens."""
        if special:
            return self.special[block[0]]
        if not block:
            return b"", b""
        ids, decoded = zip(*map(self.known.__getitem__, block), strict=True)
        return b"".join(ids), self.glue.join(decoded)


def _groups(texts: Iterable[str]) -> Iterator[list[str]]:
    group, chars = [], 0
    for t in texts:
        group.append(t)
        chars += len(t)
        if chars >= GROUP_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


def cached_blocks(model: BpeModel, texts: Iterable[str], learn) -> Iterator[Iterator[tuple[bool, list[str]]]]:
    """For each text its blocks of pre-tokens; ``learn`` meets the words of a block before it is given out."""
    for group in _groups(texts):
        if len(group) == 1 and len(group[0]) > pretokens.LONG_TEXT:
            def long(text: str = group[0]) -> Iterator[tuple[bool, list[str]]]:
                for special, block in model.words(text):
                    if not special:
                        learn(set(block))
                    yield special, block
            yield long()
            continue
        split = [list(model.words(t)) for t in group]
        learn(set(chain.from_iterable(b for blocks in split for special, b in blocks if not special)))
        yield from map(iter, split)


def read_model(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def broadcast_model(spark: SparkSession, path: str):
    small_batches(spark)
    return spark.sparkContext.broadcast(BpeModel(read_model(path)))


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row's whole text."""
    model = broadcast_model(docs.sparkSession, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = WordCache(model.value)
        for texts in batches:
            rows = []
            for blocks in cached_blocks(model.value, texts, cache.learn):
                ids_sha, text_sha, n = hashlib.sha256(), hashlib.sha256(), 0
                for special, block in blocks:
                    ids, decoded = cache.parts(special, block)
                    if n and ids:
                        text_sha.update(cache.glue)
                    text_sha.update(decoded)
                    ids_sha.update(ids)
                    n += len(ids) // 4
                rows.append((n, ids_sha.hexdigest(), text_sha.hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).astype({"n_tokens": "int64", "ids_sha256": object, "decoded_sha256": object})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digests(text_or_empty()).alias("r")).select("doc_id", "r.*")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with the columns ids (array of int) and n_tokens; columns of those names are replaced."""
    model = broadcast_model(docs.sparkSession, path)

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = WordCache(model.value)
        for texts in batches:
            each = [b"".join(cache.parts(*b)[0] for b in blocks) for blocks in cached_blocks(model.value, texts.to_pylist(), cache.learn)]
            ends = np.cumsum([0, *map(len, each)]) // 4
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(each))])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    return docs.withColumn("ids", ids_of(text_or_empty())).withColumn("n_tokens", F.size("ids").cast("long"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the column decoded, from its ids; null ids give null."""
    model = broadcast_model(encoded.sparkSession, path)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([None if ids is None else model.value.decode([int(i) for i in ids]) for ids in rows], dtype=object)

    return encoded.withColumn("decoded", text_of("ids"))
