"""Operator 11: byte-level BPE over length-bucketed, padded matrices.

Texts are cut by the pattern into pre-tokens, and the distinct ones of a slice that are no tokens themselves become rows
of byte symbols: a padded matrix for each bucket of lengths (2, 3 to 4, 5 to 8, ...). In each round every row merges its
leftmost pair of minimum rank; pairs are looked up in an open-addressing hash table, only the two pairs beside a merge
anew. Every row loses one cell a round, so compaction is a reshape; rows without a pair leave, and columns that no row
needs any more are cut off. Pre-tokens of more than WIDE bytes, for which rounds times width would be quadratic, are
merged rank by rank with all occurrences at once (pair_merging), which gives the same ids.

Decoding gathers the tokens' bytes by id. Bytes that are no UTF-8 can come from ids that are not a text's.

Defined results: a null or empty text has no ids and decodes to nothing; strings of special tokens are ordinary text; texts of
any length are encoded whole; ids of rows may be null or repeated and keep their type; a row for each row, repeated ones
included; a column of the result's name gives way to it, others pass through; an empty table gives no rows. A token id
outside the vocabulary is an error. Of pairs of one rank in a pre-token, the left one is merged first.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwake.llm import textbuf as tb
from gridwake.llm.pair_merging import PairTable, merge_all

NONE = np.iinfo(np.int32).max
PAD, FREE = -1, -1
#: Bytes of the longest pre-tokens that matrices hold.
WIDE = 256
#: Characters of a text that are cut into pre-tokens at once, up to the next blank.
CHARS = 1 << 19
#: Ids that are decoded at once.
IDS = 1 << 18


class HashedPairs:
    """Ranks of adjacent symbol pairs by open addressing with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(len(left) * 3).bit_length())
        self.key = np.full(1 << self.bits, FREE, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int32)
        key, rank = left.astype(np.int64) << 32 | right.astype(np.int64), rank.astype(np.int32)
        slot = self._slot(key)
        while len(key):
            _, first = np.unique(slot, return_index=True)
            put = first[self.key[slot[first]] == FREE]
            self.key[slot[put]], self.rank[slot[put]] = key[put], rank[put]
            left_over = np.ones(len(key), bool)
            left_over[put] = False
            key, rank, slot = key[left_over], rank[left_over], (slot[left_over] + 1) & (len(self.key) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE for those that don't merge; padding never does."""
        want = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        slot = self._slot(want)
        held = self.key[slot]
        out = np.where(held == want, self.rank[slot], NONE)
        open_ = np.flatnonzero((held != want) & (held != FREE))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.key) - 1)
            held = self.key[slot[open_]]
            hit = held == want[open_]
            out[open_[hit]] = self.rank[slot[open_[hit]]]
            open_ = open_[~hit & (held != FREE)]
        out[(left == PAD) | (right == PAD)] = NONE
        return out


def merge_rows(sym: np.ndarray, pairs: HashedPairs) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all rows one behind another, their numbers) after all merges of a padded matrix; a pair's rank is the id it makes."""
    n_rows = len(sym)
    sizes = np.zeros(n_rows, np.int64)
    done_rows, done = [], []
    live = np.arange(n_rows)
    rank = pairs.find(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n_rows, -1)
    while len(live):
        width = sym.shape[1]
        at = rank.argmin(axis=1) if width > 1 else np.zeros(len(live), np.int64)
        low = rank[np.arange(len(live)), at] if width > 1 else np.full(len(live), NONE, np.int32)
        over = low == NONE
        if over.any():
            cells = sym[over]
            real = cells != PAD
            sizes[live[over]] = real.sum(axis=1)
            done_rows.append(np.repeat(live[over], real.sum(axis=1)))
            done.append(cells[real])
            live, sym, rank, at, low = live[~over], sym[~over], rank[~over], at[~over], low[~over]
            if not len(live):
                break
            widest = int((sym != PAD).sum(axis=1).max())
            sym, rank = sym[:, :widest], rank[:, : widest - 1]
            width = widest
        row = np.arange(len(live))
        sym[row, at] = low
        keep = np.ones(sym.shape, bool)
        keep[row, at + 1] = False
        sym = sym[keep].reshape(len(live), width - 1)
        keep = np.ones(rank.shape, bool)
        keep[row, at] = False
        rank = rank[keep].reshape(len(live), width - 2)
        # What stands on both sides of the new symbol.
        right, left = row[at < width - 2], row[at > 0]
        rank[right, at[right]] = pairs.find(sym[right, at[right]], sym[right, at[right] + 1])
        rank[left, at[left] - 1] = pairs.find(sym[left, at[left] - 1], sym[left, at[left]])
    rows = np.concatenate(done_rows) if done_rows else np.zeros(0, np.int64)
    flat = np.concatenate(done) if done else np.zeros(0, np.int32)
    return flat[np.argsort(rows, kind="stable")], sizes


class ByteVocabulary:
    """Tables of a file of ranks: a line for each token, its bytes in base64 and its rank, which is its id."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cut = regex.compile(pattern)
        self.blank = regex.compile(r"(?<!\s)\s")
        size = max(self.ids.values()) + 1
        tokens = [b""] * size
        for token, k in self.ids.items():
            tokens[k] = token
        self.known = np.array([bool(t) for t in tokens])
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, k in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(k)
        left, right, rank = (np.array(x, np.int64) for x in (left, right, rank))
        self.pairs = HashedPairs(left, right, rank)
        formed = np.arange(size)
        formed[self.byte] = -1
        self.long_pairs = PairTable(left, right, rank, rank, formed)

    def words(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, about CHARS characters at a time: none goes on from a character that is not blank to one that is."""
        at, n = 0, len(text)
        while at < n:
            found = self.blank.search(text, at + CHARS) if n - at > CHARS else None
            to = found.start() if found else n
            yield self.cut.findall(text[at:to])
            at = to

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one behind another, how many of each) of distinct pre-tokens."""
        whole = np.array([self.ids.get(w, PAD) for w in words], np.int64)
        size = np.array([len(w) for w in words], np.int64)
        count = np.where(whole != PAD, 1, 0)
        known = np.flatnonzero(whole != PAD)
        parts, owners = [whole[known].astype(np.int32)], [known]
        rest = np.flatnonzero(whole == PAD)
        bucket = np.ceil(np.log2(np.maximum(size[rest], 1))).astype(int)
        for b in np.unique(bucket):
            own = rest[bucket == b]
            data = self.byte[np.frombuffer(b"".join(words[k] for k in own), np.uint8)]
            if 1 << int(b) > WIDE:
                flat, n = merge_all(data, size[own], self.long_pairs)
            else:
                grid = np.full((len(own), int(size[own].max())), PAD, np.int32)
                grid[np.arange(grid.shape[1]) < size[own][:, None]] = data
                flat, n = merge_rows(grid, self.pairs)
            count[own] = n
            parts.append(flat.astype(np.int32)), owners.append(np.repeat(own, n))
        return np.concatenate(parts)[np.argsort(np.concatenate(owners), kind="stable")], count

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one behind another, how many of each text)."""
        place: dict[str, int] = {}
        which, per_text = [], []
        for text in texts:
            n = 0
            for words in self.words(text or ""):
                which.append(np.fromiter((place.setdefault(w, len(place)) for w in words), np.int32, len(words)))
                n += len(words)
            per_text.append(n)
        ids, count = self.encode_words([w.encode() for w in place])
        which = np.concatenate(which) if which else np.zeros(0, np.int32)
        begin, n = (np.cumsum(count) - count)[which], count[which]
        ends = np.cumsum(n)
        out = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - n), n)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text, dtype=np.int64)])]
        return out, np.diff(bounds)

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes of ids, a block at a time; an id outside the vocabulary is an error."""
        for k in range(0, len(ids), IDS):
            part = ids[k : k + IDS].astype(np.int64)
            if part.min() < 0 or part.max() >= len(self.known) or not self.known[part].all():
                raise ValueError("an id is not in the vocabulary")
            n = self.sizes[part]
            yield self.bytes[np.arange(int(n.sum())) + np.repeat(self.starts[part] - (np.cumsum(n) - n), n)].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> ByteVocabulary:
    """The tables of a file, made once in each worker."""
    return ByteVocabulary(path, pattern)


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode_column(docs: DataFrame, text_col: str = "text", out: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with the token ids of the text in the column out, which takes the place of a column of that name."""
    at, own = docs.columns.index(text_col), _defaults(path, pattern)
    rest = [k for k, c in enumerate(docs.columns) if c.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(*own)
        for part in tb.slices(batches, text_col):
            ids, n = vocab.encode(part.column(at).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in rest), lists], names=[*(part.schema.names[k] for k in rest), out])

    return docs.mapInArrow(run, T.StructType([docs.schema.fields[k] for k in rest] + [T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode_column(docs: DataFrame, ids_col: str = "ids", out: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with the bytes that the ids decode to in the column out; null ids decode to null."""
    at, own = docs.columns.index(ids_col), _defaults(path, pattern)
    rest = [k for k, c in enumerate(docs.columns) if c.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(*own)
        for part in batches:
            texts = [None if x.as_py() is None else b"".join(vocab.decode(np.array(x.as_py(), np.int64))) for x in part.column(at)]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in rest), pa.array(texts, pa.binary())], names=[*(part.schema.names[k] for k in rest), out])

    return docs.mapInArrow(tb.tidy(run), T.StructType([docs.schema.fields[k] for k in rest] + [T.StructField(out, T.BinaryType())]))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the ids as little-endian 32-bit integers and the bytes they decode to, digested where the ids are made."""
    own = _defaults(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(*own)
        for part in tb.slices(batches, "text"):
            ids, n = vocab.encode(part["text"].to_pylist())
            ends = np.cumsum(n)
            sums, decoded = [], []
            for a, b in zip((ends - n).tolist(), ends.tolist()):
                sums.append(hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest())
                h = hashlib.sha256()
                for block in vocab.decode(ids[a:b]):
                    h.update(block)
                decoded.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(n), pa.array(sums, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


QUERIES = {"op11_byte_bpe": op11_byte_bpe}
