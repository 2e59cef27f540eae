"""Operator 5: token counts of a sentencepiece BPE model by rank-synchronous array merging.

A text gets its leading space and is cut before each run of spaces: no piece of the vocabulary goes on past such a
place (checked when the tables are made). Pre-tokens of many texts are made distinct by hash, held as ragged arrays of
character symbols and merged round by round; the symbols that survive are the tokens. A character without a piece
counts its UTF-8 bytes, as the model's byte fallback does. Long pre-tokens are cut further between characters that stand
side by side in no piece.

Defined results: a null or empty text has 0 bytes and 0 tokens; texts of any length are counted whole; ids may be null or
repeated and keep their type; a row for each row, repeated ones included; other columns are not read, whatever their
names; an empty table gives no rows. Of pairs of one rank in a sequence, the left one is merged first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.llm import textbuf as tb
from gridwake.llm.pair_merging import PairTable, merge_all

#: The mark that stands for a space in pieces.
SPACE = "▁"
#: Pre-tokens of more characters than this are cut where no piece can join.
LONG = 64
#: Texts of this many bytes share one table of distinct pre-tokens.
PART = 4 << 20


class Pieces:
    """Tables of a sentencepiece BPE model with byte fallback and without normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [k for k in range(n) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        assert model.normalize(" ﬁ ") == f"{SPACE}{SPACE}ﬁ{SPACE}", "the model changes texts"
        pieces = {model.id_to_piece(k).replace(SPACE, " "): k for k in plain}
        # Ranks follow the scores, best first; a piece of one character is there from the start.
        rank_of = {k: r for r, k in enumerate(sorted(pieces.values(), key=lambda k: (-model.get_score(k), k)))}
        #: Symbol of each code point; characters without a piece get symbols of their own, below 0: minus their bytes.
        self.char = np.full(0x110000, 0, np.int64)
        code = np.arange(0x110000)
        self.char[:] = -np.select([code < 0x80, code < 0x800, code < 0x10000], [1, 2, 3], 4)
        formed = np.full(n, -1, np.int64)
        left, right, rank, result = [], [], [], []
        joined = set()
        for piece, k in pieces.items():
            if len(piece) == 1:
                self.char[ord(piece)] = k
                continue
            assert " " not in piece.lstrip(" "), "a piece goes on past a space"
            formed[k] = rank_of[k]
            joined.update(a + b for a, b in zip(piece, piece[1:]))
            for cut in range(1, len(piece)):
                a, b = pieces.get(piece[:cut]), pieces.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(rank_of[k]), result.append(k)
        self.table = PairTable(*(np.array(x, np.int64) for x in (left, right, rank, result)), formed)
        self.joined = np.sort(np.array([ord(x[0]) << 32 | ord(x[1]) for x in joined], np.int64))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The tables of a model, made once in each worker."""
    return Pieces(path)


def count_distinct(model: Pieces, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Tokens of each of the pre-tokens that lie one behind another in data."""
    text = data.tobytes().decode("utf-8", "surrogatepass")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    chars = np.diff(np.searchsorted(heads, off))
    sym = model.char[points]
    owner = np.repeat(np.arange(len(chars)), chars)
    fallback = np.bincount(owner, weights=np.where(sym < 0, -sym - 1, 0), minlength=len(chars)).astype(np.int64)
    # Characters without a piece take no part in merges: a symbol that no pair has.
    sizes, part = chars, np.arange(len(chars))
    if (chars > LONG).any():
        cut = np.zeros(len(points), bool)
        cut[np.cumsum(chars) - chars] = True
        inside = np.flatnonzero((chars > LONG)[owner[1:]] & (owner[1:] == owner[:-1]))
        pair = points[inside] << 32 | points[inside + 1]
        at = np.minimum(np.searchsorted(model.joined, pair), len(model.joined) - 1)
        cut[inside[model.joined[at] != pair] + 1] = True
        first = np.flatnonzero(cut)
        sizes, part = np.diff(np.concatenate([first, [len(points)]])), owner[first]
    _, left = merge_all(np.where(sym < 0, 2**31 - 1, sym), sizes, model.table)
    return np.bincount(part, weights=left, minlength=len(chars)).astype(np.int64) + fallback


def text_counts(model: Pieces, column: pa.Array) -> np.ndarray:
    """Tokens of each text."""
    column = pc.fill_null(column, "")
    if pc.any(pc.match_substring(column, SPACE)).as_py():
        column = pc.replace_substring(column, SPACE, " ")
    empty = pc.equal(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    data, off = tb.utf8(pc.binary_join_element_wise(pa.scalar(" "), column, ""))
    space = data == 32
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[off[:-1]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(data))
    _, first, which = np.unique(tb.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    lens = e - s
    own = data[np.arange(int(lens.sum())) + np.repeat(s - (np.cumsum(lens) - lens), lens)]
    each = count_distinct(model, own, np.concatenate([[0], np.cumsum(lens)]))
    total = np.concatenate([[0], np.cumsum(each[which])])
    at = np.searchsorted(starts, off)
    return np.where(empty, 0, total[at[1:]] - total[at[:-1]])


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens), a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for part in tb.slices(batches, "text", PART):
            n_bytes = pc.fill_null(pc.binary_length(part["text"]), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part["id"], n_bytes, pa.array(text_counts(model, part["text"]))], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")


def op5_token_counts(spark: SparkSession, sf_dir: str, model_path: str | None = None, limit: int = 4096) -> DataFrame:
    import public_tokenizers

    got = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path or public_tokenizers.path("piece_bpe_32k.model"))
    return got.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


QUERIES = {"op5_token_counts": op5_token_counts}
