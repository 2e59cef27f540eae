"""Operator 3: token ids as binary output, coded by a static range asymmetric numeral system.

A data set is a folder with `frequencies` (one shared table for all files: symbol, frequency, of 2**SCALE slots) and
`frames`, Parquet files whose rows, file by file in the order of their names, stand in ascending order of the documents'
ids. A frame holds some documents whole: their ids and lengths, and their symbols in independent blocks of BLOCK symbols. A block is LANES interleaved coders
over one stream of 32-bit words; symbol k belongs to lane k mod LANES. Each block has a checkpoint, the lanes' states
and the place of its words in the frame's stream, and a CRC-32 of its symbols, so any block is decoded and proven by
itself. The coder's state is 64 bits wide, between 2**31 and 2**63, and renormalises by one word.

The ids are made once, after the texts have been dealt out by ranges of the document id, and are kept in the shared
folder, since the table needs the counts of all of them before the first one is coded. The table has a row for each
symbol of the vocabulary at most.

Defined results: a null or empty text is the end id alone; a text of any length lies whole in one frame; rows with equal
ids (ties and repeated rows) follow one another in the order of a hash of their texts; null ids come first; ids keep
their type; other columns are not read, whatever their names; an empty table gives an empty data set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwake.llm import textbuf as tb
from gridwake.llm.bpe_codec import default_path, vocabulary
from gridwake.plans.materialize import join_checked, materialize, new_path

U = np.uint64
SCALE = 20
LANES = 256
BLOCK = 1 << 17
LOW = U(1 << 31)
#: Bytes of text in a frame.
PART = 4 << 20
END = 2


def normalised(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, frequencies): frequencies of at least 1 that add up to 2**SCALE."""
    symbols = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in symbols.tolist()], np.int64)
    room = (1 << SCALE) - len(n)
    assert room >= 0, "more symbols than slots"
    total = int(n.sum())
    f = 1 + np.array([c * room // total for c in n.tolist()], np.int64)
    f[np.argmax(n)] += (1 << SCALE) - int(f.sum())
    return symbols, f


class Coder:
    """Coding and decoding with one frequency table."""

    def __init__(self, symbols: np.ndarray, frequencies: np.ndarray):
        self.symbols, self.f = symbols, frequencies.astype(U)
        self.first = np.cumsum(self.f, dtype=U) - self.f
        self.place = np.zeros(int(symbols.max()) + 1, np.int64)
        self.place[symbols] = np.arange(len(symbols))
        self.slot = np.repeat(np.arange(len(symbols), dtype=np.int32), frequencies)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words, words of each block, states, checksums) of the blocks of ids."""
        blocks = -(-len(ids) // BLOCK)
        own = np.minimum(BLOCK, len(ids) - np.arange(blocks) * BLOCK)
        steps = -(-int(own.max()) // LANES)
        grid = np.zeros((blocks, steps * LANES), np.int64)
        grid.reshape(-1)[(np.arange(len(ids)) // BLOCK) * grid.shape[1] + np.arange(len(ids)) % BLOCK] = self.place[ids]
        grid = grid.reshape(blocks, steps, LANES)
        grid = np.ascontiguousarray(grid.transpose(1, 0, 2)).reshape(steps, -1)
        state = np.full(blocks * LANES, LOW)
        whole = own // LANES  # steps in which all lanes have a symbol
        lane = np.arange(LANES)
        top, wide = U(31 - SCALE + 32), U(1 << SCALE)
        chunks = []
        for t in range(steps - 1, -1, -1):
            f, first = self.f[grid[t]], self.first[grid[t]]
            on = None if t < whole.min() else (lane < (own - t * LANES)[:, None]).reshape(-1)
            full = state >= f << top
            out = np.flatnonzero(full if on is None else full & on)
            if len(out):
                chunks.append((out // LANES, (state[out] & U(0xFFFFFFFF)).astype(np.uint32)))
                state[out] >>= U(32)
            # (q << SCALE) + (state - q f) + first, q being state over f.
            x = state // f
            x *= wide - f
            x += state
            x += first
            state = x if on is None else np.where(on, x, state)
        chunks.reverse()
        owner = np.concatenate([b for b, _ in chunks]) if chunks else np.zeros(0, np.int64)
        words = np.concatenate([w for _, w in chunks])[np.argsort(owner, kind="stable")] if chunks else np.zeros(0, np.uint32)
        state = state.reshape(blocks, LANES)
        sums = np.array([zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) for b in range(blocks)], np.int64)
        return words, np.bincount(owner, minlength=blocks), state, sums

    def decode(self, n: int, words: np.ndarray, lengths: np.ndarray, state: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """The n ids of the blocks; a checksum that doesn't fit is an error."""
        blocks = len(lengths)
        own = np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
        steps = -(-int(own.max()) // LANES)
        out = np.zeros((steps, blocks * LANES), np.int32)
        at = np.cumsum(lengths) - lengths
        whole = own // LANES
        lane = np.arange(LANES)
        mask = U((1 << SCALE) - 1)
        state = state.reshape(-1).copy()
        for t in range(steps):
            low = state & mask
            k = self.slot[low.view(np.int64)]
            out[t] = k
            x = state >> U(SCALE)
            x *= self.f[k]
            x += low
            x -= self.first[k]
            need = x < LOW
            if t >= whole.min():
                on = (lane < (own - t * LANES)[:, None]).reshape(-1)
                x, need = np.where(on, x, state), need & on
            need = np.flatnonzero(need)
            if len(need):
                block = need // LANES
                taken = np.bincount(block, minlength=blocks)
                place = (at - np.cumsum(taken) + taken)[block] + np.arange(len(need))
                x[need] = (x[need] << U(32)) | words[place].astype(U)
                at = at + taken
            state = x
        out = out.reshape(steps, blocks, LANES).transpose(1, 0, 2)
        ids = self.symbols[out.reshape(blocks, -1)]
        for b in range(blocks):
            if zlib.crc32(ids[b, : own[b]].astype("<u4").tobytes()) != sums[b]:
                raise ValueError("a block of token ids is damaged")
        return np.concatenate([ids[b, : own[b]] for b in range(blocks)])


_FRAMES = "start bigint, ids array<{}>, sizes array<int>, words binary, lengths array<int>, states binary, sums array<bigint>"


def tokenised(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """Token ids of the documents in ascending order of the document id. A row is a frame; part and inner, the ids before it in its part, order the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, part, inner = vocabulary(path), TaskContext.get().partitionId(), 0
        for rows in tb.slices(batches, "text", PART):
            ids, n = vocab.encode(rows["text"])
            ids = np.insert(ids, np.cumsum(n), END)
            blob = zstandard.ZstdCompressor(level=1).compress(ids.astype(np.uint16 if vocab.size <= 65536 else np.uint32).tobytes())
            ends = pa.array([0, len(rows)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (rows["id"], pa.array((n + 1).astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([inner]), pa.array([len(ids)]), *lists, pa.array([blob], pa.binary())], names=["part", "inner", "n", "ids", "sizes", "tokens"])
            inner += len(ids)

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text").mapInArrow(run, f"part int, inner bigint, n bigint, ids array<{kind}>, sizes array<int>, tokens binary")


def _tokens(blob: pa.Scalar, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob.as_py())
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype(np.int64)


def token_frequencies(tokens: DataFrame) -> DataFrame:
    """(symbol, n) over all token ids; a task sends a row for each symbol of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for size, blob in zip(batch["n"].to_pylist(), batch["tokens"]):
                n = np.bincount(_tokens(blob, size))
                long, short = (n, total) if len(n) > len(total) else (total, n)
                total = long.copy()
                total[: len(short)] += short
        symbols = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(symbols), pa.array(total[symbols])], names=["symbol", "n"])

    return tokens.select("n", "tokens").mapInArrow(tb.tidy(run), "symbol bigint, n bigint").groupBy("symbol").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token ids of docs, each document with the end id behind it, as a data set in folder."""
    spark = docs.sparkSession
    tokens = materialize(tokenised(docs, path, id_col, text_col), "tokens")
    frames = _FRAMES.format(tokens.schema["ids"].dataType.elementType.simpleString())
    counts = {r["symbol"]: r["n"] for r in token_frequencies(tokens).collect()}  # the vocabulary's size at most
    if not counts:
        spark.createDataFrame([], frames).write.parquet(f"{folder}/frames")
        spark.createDataFrame([], "symbol bigint, frequency bigint").write.parquet(f"{folder}/frequencies")
        return
    symbols, f = normalised(counts)
    spark.createDataFrame(list(zip(symbols.tolist(), f.tolist())), "symbol bigint, frequency bigint").coalesce(1).write.parquet(f"{folder}/frequencies")
    sent = spark.sparkContext.broadcast((symbols, f))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*sent.value)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = _tokens(batch["tokens"][k], batch["n"][k].as_py())
                words, lengths, state, checks = coder.encode(ids)
                coded = [pa.array([words.astype("<u4").tobytes()], pa.binary()), pa.array([lengths.astype(np.int32)], pa.list_(pa.int32())), pa.array([state.astype("<u8").tobytes()], pa.binary()), pa.array([checks], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(k, 1) for c in ("start", "ids", "sizes")), *coded], names=["start", "ids", "sizes", "words", "lengths", "states", "sums"])

    # The ids before each part: a row for each task that made ids, few enough for one running sum.
    parts = tokens.groupBy("part").agg(F.sum("n").alias("own"))
    before = parts.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))
    placed = join_checked(tokens, materialize(before, "before"), "part", "inner").select((F.col("before") + F.col("inner")).alias("start"), "n", "ids", "sizes", "tokens")
    placed.repartitionByRange("start").sortWithinPartitions("start").mapInArrow(tb.tidy(run), frames).write.option("compression", "none").parquet(f"{folder}/frames")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, tokens): the ids of each document, decoded from the files of a data set."""
    table = [(r["symbol"], r["frequency"]) for r in spark.read.parquet(f"{folder}/frequencies").collect()]
    sent = spark.sparkContext.broadcast(sorted(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for k in range(batch.num_rows):
                coder = coder or Coder(*np.array(sent.value, np.int64).T)
                sizes = np.array(batch["sizes"][k].as_py(), np.int64)
                lengths = np.array(batch["lengths"][k].as_py(), np.int64)
                words = np.frombuffer(batch["words"][k].as_py(), "<u4")
                state = np.frombuffer(batch["states"][k].as_py(), "<u8").reshape(len(lengths), LANES)
                ids = coder.decode(int(sizes.sum()), words, lengths, state, batch["sums"][k].as_py())
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                start = batch["start"][k].as_py() + ends - sizes
                yield pa.RecordBatch.from_arrays([batch["ids"][k].values, pa.array(start), pa.array(sizes), lists], names=["id", "start", "n_tokens", "tokens"])

    frames = spark.read.parquet(f"{folder}/frames")
    return frames.mapInArrow(tb.tidy(run), f"id {frames.schema['ids'].dataType.elementType.simpleString()}, start bigint, n_tokens bigint, tokens array<int>")


def checksums(ids: DataFrame) -> DataFrame:
    """(id, start, n_tokens, crc): CRC-32 of each document's ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["tokens"]
            flat = lists.flatten().to_numpy().astype("<u4").tobytes()
            cut = (4 * (lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py())).tolist()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["start"], batch["n_tokens"], pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "crc"])

    return ids.mapInArrow(tb.tidy(run), f"id {ids.schema['id'].dataType.simpleString()}, start bigint, n_tokens bigint, crc bigint")


def op3_rans_output(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    folder = new_path(spark, "token_ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, path or default_path())
    return checksums(read_ids(spark, folder)).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))


QUERIES = {"op3_rans_output": op3_rans_output}
