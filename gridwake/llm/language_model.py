"""Operator 6: language-model scores by deleted interpolation.

A word's probability after a context is a mixture of the maximum-likelihood estimates of all orders and of a uniform
share; the weights depend on how often the context was seen (buckets by powers of two) and are learned by
expectation-maximisation on held-out counts: each occurrence of an n-gram in the training texts is scored with that
occurrence taken out of the counts (deleted estimation), so all training texts serve and none is wasted.

N-gram counts are too many to travel as rows and too many to broadcast. A block of documents (some MB of text) sends its
distinct n-gram hashes, sorted and packed, to the hash ranges that own them; a range adds up the counts of all blocks and
answers each block with the counts in the order asked, without the hashes. A block then has the part of the model that
it needs and no more. Ranges are as many as the distinct n-grams of all blocks ask for. What EM needs is a histogram
over the estimates' sizes (powers of STEP), bounded by the number of cells; that alone comes to the driver. Scores are
made of the estimates themselves; only the weights come from rounded ones.

The texts are read twice, and a block is told by its place and a checksum of its tokens; the documents must therefore
come from a table, whose reading deals them alike each time. If they don't, the operator stops with an error.

Defined results: a null or empty text is one end; a text of any length lies whole in one block; a null id trains the
model and is never held out; repeated rows count repeatedly and are scored alike; ids keep their type; other columns are
not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.llm import textbuf as tb
from gridwake.plans.materialize import materialize

U = np.uint64
#: Bytes of text in a block.
PART = 8 << 20
#: N-grams, over all blocks, that one range is to take.
RANGE = 8_000_000
#: Estimates are told apart by this factor when weights are learned, down to 2**-40; one that stands for a cell is off by 9 % at most.
STEP = 2**0.25
CELLS = 160
BUCKETS = 20
_END, _BEGIN = U(1), U(2)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(x: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), kind)


def _packed_hashes(x: np.ndarray) -> bytes:
    """Ascending hashes as differences, byte by byte: the high bytes of small differences are alike."""
    d = np.diff(x, prepend=U(0))
    return _pack(d.view(np.uint8).reshape(-1, 8).T)


def _unpacked_hashes(x: pa.Scalar) -> np.ndarray:
    raw = _unpack(x, "u1").reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(U).reshape(-1), dtype=U)


def token_stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, tokens of each text): the lower-case words of each text and one end."""
    data, off = tb.utf8(column)
    data = tb.lower(data)
    starts, ends = tb.spans(tb.SPACED[data], off)
    n = tb.per_text(starts, off)
    words = tb.hash_spans(data, starts, ends)
    return np.insert(words, np.cumsum(n), _END), n + 1


def gram_hashes(tokens: np.ndarray, n: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1 to order the hash of the k-gram that ends at each token; begins stand before a text's first token."""
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
    out, gram = [], np.zeros(len(tokens), U)
    for k in range(order):
        past = np.full(len(tokens), _BEGIN)
        if k:
            past[k:] = tokens[:-k]
            past[place < k] = _BEGIN
        else:
            past = tokens
        gram = tb.mix(gram * U(0xD1342543DE82EF95) + past + U(k))
        out.append(gram)
    return out


_BEGIN_GRAM = tb.mix(np.array([2], U))[0]  # what gram_hashes gives for a begin alone: the context of a first token


def block_grams(tokens: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, ascending; place of each gram among them): all orders' grams of each token, then a begin for each text."""
    flat = np.concatenate([*gram_hashes(tokens, n, order), np.full(len(n), _BEGIN_GRAM)])
    return np.unique(flat, return_inverse=True)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, rows, tokens, tokens of each text, held) of each block; the key tells blocks apart and says what they hold."""
    part = TaskContext.get().partitionId()
    for seq, rows in enumerate(tb.slices(batches, "text", PART)):
        tokens, n = token_stream(rows["text"])
        key = f"{part}-{seq}-{zlib.crc32(tokens.tobytes()):08x}"
        yield key, rows, tokens, n, rows["held"].to_numpy(zero_copy_only=False).astype(bool)


def _requests(texts: DataFrame, order: int, ranges: int) -> DataFrame:
    """(range, block, hashes, counts): the n-grams of each block with their training counts, by the hash range that owns them."""
    edges = [k * 2**64 // ranges for k in range(1, ranges)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(edges, U)
        for key, _, tokens, n, held in _tokenised(batches):
            hashes, which = block_grams(tokens, n, order)
            weight = np.concatenate([np.tile(np.repeat(~held, n), order), ~held])
            counts = np.bincount(which, weights=weight, minlength=len(hashes)).astype(np.int32)
            cut = [0, *np.searchsorted(hashes, cuts).tolist(), len(hashes)]
            own = [(r, a, b) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _, _ in own], pa.int32()), pa.array([key] * len(own)), pa.array([_packed_hashes(hashes[a:b]) for _, a, b in own], pa.binary()), pa.array([_pack(counts[a:b]) for _, a, b in own], pa.binary())],
                names=["range", "block", "hashes", "counts"],
            )

    return texts.mapInArrow(run, "range int, block string, hashes binary, counts binary")


def _answers(requests: DataFrame) -> DataFrame:
    """(range, block, totals): the corpus counts of the n-grams that a block asked a range for, in their order.

    A range's packets lie in one group of about RANGE n-grams; they are added up in runs that are merged, so a range
    holds its distinct n-grams once and not once for each block.
    """

    def total(group: pa.Table) -> pa.Table:
        runs = [(_unpacked_hashes(h), _unpack(c, "i4").astype(np.int64)) for h, c in zip(group["hashes"], group["counts"])]
        while len(runs) > 1:
            merged = []
            for k in range(0, len(runs), 8):
                keys, values = (np.concatenate(x) for x in zip(*runs[k : k + 8]))
                order = np.argsort(keys, kind="stable")
                keys, values = keys[order], values[order]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                merged.append((keys[first], np.add.reduceat(values, first)))
            runs = merged
        keys, values = runs[0]
        out = [_pack(values[np.searchsorted(keys, _unpacked_hashes(h))].astype(np.int32 if values.max() < 2**31 else np.int64)) for h in group["hashes"]]
        wide = pa.array([values.max() >= 2**31] * len(out))
        return pa.table({"range": group["range"], "block": group["block"], "totals": pa.array(out, pa.binary()), "wide": wide})

    return requests.groupBy("range").applyInArrow(total, "range int, block string, totals binary, wide boolean")


def _documents(texts: DataFrame) -> DataFrame:
    """A row for each block: its documents as distinct words and the places of their tokens among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows, tokens, n, held in _tokenised(batches):
            words, places = np.unique(tokens, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows["id"]), pa.array([held.tolist()], pa.list_(pa.bool_())), pa.array([n.astype(np.int32)], pa.list_(pa.int32())), pa.array([_packed_hashes(words)], pa.binary()), pa.array([_pack(places.astype(np.int32))], pa.binary())],
                names=["block", "ids", "held", "sizes", "words", "places"],
            )

    return texts.mapInArrow(run, f"block string, ids array<{_kind(texts, 'id')}>, held array<boolean>, sizes array<int>, words binary, places binary")


_MODEL = "ids array<{}>, held array<boolean>, sizes array<int>, counts array<binary>, begins bigint, trained bigint, types double"


def _resolved(documents: DataFrame, answers: DataFrame, order: int) -> DataFrame:
    """A row for each block: the corpus counts of its tokens' n-grams, order by order."""

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1 or not right.num_rows:
            raise RuntimeError("the documents were dealt into other blocks when they were read again; write them to a table first")
        right = right.sort_by("range")  # ranges ascend as hashes do
        totals = np.concatenate([_unpack(x, "i8" if w.as_py() else "i4").astype(np.int64) for x, w in zip(right["totals"], right["wide"])])
        n = np.array(left["sizes"][0].as_py(), np.int64)
        tokens = _unpacked_hashes(left["words"][0])[_unpack(left["places"][0], "i4")]
        hashes, which = block_grams(tokens, n, order)
        count = totals[which].reshape(-1)
        counts = count[: order * len(tokens)].reshape(order, -1)
        held = np.array(left["held"][0].as_py(), bool)
        trains = np.repeat(~held, n)
        # A word type is counted once over all blocks: each block adds its part of the type's occurrences.
        local = np.bincount(which[: len(tokens)][trains], minlength=len(hashes))
        seen = np.flatnonzero(local)
        row = {"ids": left["ids"], "held": left["held"], "sizes": left["sizes"], "counts": pa.array([[_pack(c.astype(np.int32 if c.max() < 2**31 else np.int64)) for c in counts]], pa.list_(pa.binary()))}
        row |= {"begins": pa.array([int(count[-1])], pa.int64()), "trained": pa.array([int(trains.sum())], pa.int64()), "types": pa.array([float((local[seen] / totals[seen]).sum())])}
        return pa.table(row)

    return documents.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(whole, _MODEL.format(_kind(documents, "ids").removeprefix("array<")[:-1]))


def _cell(p: np.ndarray) -> np.ndarray:
    """Estimates as cells: 0 for nothing, else by powers of STEP from 1 downwards."""
    with np.errstate(divide="ignore"):
        size = np.where(p > 0, np.rint(-np.log(p) / np.log(STEP)) + 1, 0)
    return np.minimum(size, CELLS - 1).astype(np.int64)


def _centre(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, STEP ** -(cell - 1.0), 0.0)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Bucket of a context's count: 0 if it was never seen, then by powers of two."""
    return np.minimum(np.ceil(np.log2(context + 1.0)), BUCKETS - 1).astype(np.int64)


class Scored:
    """A block with its counts: what each token's estimates are made of."""

    def __init__(self, batch: pa.RecordBatch, k: int, order: int):
        self.sizes = np.array(batch["sizes"][k].as_py(), np.int64)
        self.held = np.array(batch["held"][k].as_py(), bool)
        self.trains = np.repeat(~self.held, self.sizes)
        width = len(self.trains)
        raw = [_unpack(x, "u1") for x in batch["counts"][k]]
        self.count = [x.view(np.int64 if len(x) == 8 * width else np.int32).astype(np.int64) for x in raw]
        first = np.cumsum(self.sizes) - self.sizes
        self.context = []  # for orders from 2 on: the count of the gram that ends one token before
        for c in self.count[: order - 1]:
            before = np.concatenate([[0], c[:-1]])
            before[first] = batch["begins"][k].as_py()
            self.context.append(before)


def _histogram(model: DataFrame, order: int, total: int) -> DataFrame:
    """(bucket, cells, n) of the training tokens, each with its own occurrence deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                block = Scored(batch, k, order)
                on = block.trains
                code = bucket_of((block.context[-1][on] - 1) if order > 1 else np.zeros(int(on.sum())))
                for j in range(order):
                    above = block.count[j][on] - 1
                    below = (block.context[j - 1][on] - 1) if j else np.full(len(above), total - 1)
                    code = code * CELLS + _cell(np.where(below > 0, above / np.maximum(below, 1), 0.0))
                codes, n = np.unique(code, return_counts=True)
                for c, m in zip(codes.tolist(), n.tolist()):
                    found[c] = found.get(c, 0) + m
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["code", "n"])

    return model.mapInArrow(tb.tidy(run), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def learn_weights(histogram: list[tuple[int, int]], order: int, vocabulary: int, rounds: int = 100) -> np.ndarray:
    """Mixture weights (bucket, uniform and orders) by expectation-maximisation; a bucket unseen in training spreads evenly."""
    code, n = (np.array(x) for x in zip(*sorted(histogram))) if histogram else (np.zeros(0, np.int64), np.zeros(0))
    p = np.empty((len(code), order + 1))
    p[:, 0] = 1 / (vocabulary + 1)
    for j in range(order, 0, -1):
        p[:, j] = _centre(code % CELLS)
        code = code // CELLS
    weights = np.full((BUCKETS, order + 1), 1 / (order + 1))
    for b in np.unique(code).tolist():
        own, k, w = p[code == b], n[code == b].astype(float), weights[b]
        for _ in range(rounds):
            part = own * w
            part /= part.sum(axis=1, keepdims=True)
            w = (part * k[:, None]).sum(axis=0) / k.sum()
            w = np.maximum(w, 1e-6)
            w /= w.sum()
        weights[b] = w
    return weights


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, held_out: Column | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    held_out marks the rows that the model must not learn from; base_score is the add-one unigram score.
    """
    spark = docs.sparkSession
    held_out = F.crc32(F.col("id").cast("string").cast("binary")) % 7 == 2 if held_out is None else held_out
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {_kind(texts, 'id')}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    texts = texts.withColumn("held", F.coalesce(held_out, F.lit(False)))
    size = texts.agg(F.sum(F.octet_length("text").cast("long")), F.count(F.lit(1))).first()
    if not size[1]:
        return spark.createDataFrame([], schema)
    # A word of text has 5 bytes or more, as a rule; more n-grams than expected make larger ranges, not lost ones.
    expected = order * ((size[0] or 0) // 5 + size[1])
    answers = _answers(_requests(texts, order, max(1, -(-expected // RANGE))))
    model = materialize(_resolved(_documents(texts), answers, order), "model")
    total, types = model.agg(F.sum("trained"), F.sum("types")).first()
    types = round(types)
    weights = learn_weights([(r["code"], r["n"]) for r in _histogram(model, order, total).collect()], order, types)  # BUCKETS * CELLS ** order cells at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = Scored(batch, k, order)
                w = weights[bucket_of(block.context[-1] if order > 1 else np.zeros(len(block.trains)))]
                p = w[:, 0] / (types + 1)
                for j in range(order):
                    below = block.context[j - 1] if j else np.full(len(p), total)
                    p = p + w[:, j + 1] * np.where(below > 0, block.count[j] / np.maximum(below, 1), 0.0)
                first = np.cumsum(block.sizes) - block.sizes
                base = np.log10((block.count[0] + 1) / (total + types + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch["ids"][k].values, pa.array(block.held), pa.array(block.sizes), pa.array(np.add.reduceat((block.count[0] > 0).astype(np.int64), first)), pa.array(np.full(len(first), total)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(p), first))],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return model.mapInArrow(tb.tidy(run), schema)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
