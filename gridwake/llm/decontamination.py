"""Operator 7: benchmark decontamination with a distributed positional inverted index.

The documents are indexed in shards. A shard's row holds its documents and, for every token of their texts, a posting:
the sorted term hashes, the length of each term's list and the positions in it. The index is a table in the shared
folder, so it is built once and serves any number of benchmarks; shards are independent, so no term, however frequent,
has one place. The benchmark is the stated query set. It goes to the shards in blocks of at most BLOCK windows; the
matches of all blocks meet again by shard, so one block and many take the same path.

A shard looks up the terms of each window, takes the positions of the rarest one minus its offset as candidate starts
and intersects them with the offset-adjusted lists of the other terms, from rare to frequent, until the phrase is
proven. With a slop, terms of a window may be apart: a proximity match is a start at which every distinct term of the
window occurs within the window's length plus the slop.

Defined results: a null or empty text has no words and no hits; a text of any length lies whole in one shard; an item
without words asks for nothing; repeated items count once by their id, and an item without an id is named by the empty
string; ids may be null, are not told apart if they are equal, and keep their type; repeated rows of documents give
repeated results; other columns are not read, whatever their names; an empty table on either side gives no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.llm import textbuf as tb
from gridwake.plans.materialize import LARGE_ROWS, join_checked, materialize

U = np.uint64
#: Windows asked for at once; a larger benchmark is sent in several blocks.
BLOCK = 1_000_000
#: Bytes of text in a shard.
SHARD = 2 << 20
#: Candidate starts that a shard tests at once.
CANDIDATES = 1 << 20
_INDEX = "shard string, ids array<{}>, words array<int>, terms binary, lists binary, positions binary"


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpacked(x: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), kind)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, words of each text)."""
    data, off = tb.utf8(column)
    data = tb.lower(data)
    starts, ends = tb.spans(tb.PLAIN[data], off)
    return tb.hash_spans(data, starts, ends), tb.per_text(starts, off)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of all tokens, a row for each shard of some MB of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        for seq, part in enumerate(tb.slices(batches, "text", SHARD)):
            words, n = words_of(part["text"])
            order = np.argsort(words, kind="stable")
            ranked = words[order]
            first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
            lists = np.diff(np.concatenate([first, [len(ranked)]])).astype(np.int32)
            gaps = order.astype(np.int32)
            gaps[1:] -= order[:-1].astype(np.int32)  # ascending within a list
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{place}-{seq}"]), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part["id"]), pa.array([n.astype(np.int32)], pa.list_(pa.int32())), *(pa.array([_packed(x)], pa.binary()) for x in (ranked[first], lists, gaps))],
                names=["shard", "ids", "words", "terms", "lists", "positions"],
            )

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, _INDEX.format(texts.schema["id"].dataType.simpleString()))


class Shard:
    """A shard's postings: the list of term t is positions[starts[t] : starts[t + 1]]."""

    def __init__(self, row: dict):
        self.words = np.array(row["words"].as_py(), np.int64)
        self.terms, lists = _unpacked(row["terms"], U), _unpacked(row["lists"], np.int32)
        self.starts = np.concatenate([[0], np.cumsum(lists, dtype=np.int64)])
        self.positions = np.cumsum(_unpacked(row["positions"], np.int32), dtype=np.int64)
        self.ends = np.cumsum(self.words)  # of the documents, in positions
        self.keys = np.repeat(np.arange(len(lists), dtype=np.int64), lists) << 40 | self.positions

    def posted(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether the lists of the terms hold the positions."""
        want = term << 40 | position
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return self.keys[at] == want

    def near(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the lists of the terms hold a position from low up to high."""
        at = np.searchsorted(self.keys, term << 40 | np.maximum(low, 0))
        inside = at < len(self.keys)
        inside[inside] = self.keys[at[inside]] <= (term << 40 | high)[inside]
        return inside

    def search(self, words: np.ndarray, windows: np.ndarray, sizes: np.ndarray, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) of all matches. words are distinct term hashes, looked up once; windows has a row of places in words for each window, padded behind its size."""
        if not len(self.terms):
            return
        place = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        there = self.terms[place] == words
        used = np.arange(windows.shape[1]) < sizes[:, None]
        asked = np.arange(len(windows))
        for r in range(windows.shape[1]):  # few windows are left after the first terms
            asked = asked[there[windows[asked, r]] | ~used[asked, r]]
        term, size = place[windows[asked]], sizes[asked]
        count = np.where(used[asked], np.diff(self.starts)[term], np.iinfo(np.int64).max)
        by_rarity = np.argsort(count, axis=1, kind="stable")
        rarest = by_rarity[:, 0]
        total = count[np.arange(len(asked)), rarest]
        done = np.cumsum(total)
        k = 0
        while k < len(asked):
            to = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + CANDIDATES, "right")))
            n = total[k:to]
            w = np.repeat(np.arange(k, to), n)
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = self.positions[self.starts[term[w, rarest[w]]] + inner]
            if slop:
                w, start = self._close(w, start, term, size, used[asked], slop)
            else:
                start = start - rarest[w]
                doc = np.searchsorted(self.ends, start, "right")
                ok = (start >= 0) & (doc < len(self.ends))
                ok[ok] = start[ok] + size[w[ok]] <= self.ends[doc[ok]]
                w, start = w[ok], start[ok]
                for r in range(1, windows.shape[1]):
                    if not len(w):
                        break
                    place = by_rarity[w, r]
                    ok = (r >= size[w]) | self.posted(term[w, place], start + place)
                    w, start = w[ok], start[ok]
            yield asked[w], start
            k = to

    def _close(self, w, start, term, size, used, slop):
        """Starts of spans that hold every term of the window, around each position of the rarest one."""
        reach = size[w] + slop
        doc = np.searchsorted(self.ends, start, "right")
        begin = self.ends[doc] - self.words[doc]
        w, at, begin, end = (np.repeat(x, reach) for x in (w, start, begin, self.ends[doc]))
        low = at - (np.arange(len(at)) - np.repeat(np.cumsum(reach) - reach, reach))
        ok = low >= begin
        w, low, high = w[ok], low[ok], np.minimum(low[ok] + size[w[ok]] + slop, end[ok]) - 1
        for r in range(term.shape[1]):
            ok = ~used[w, r] | self.near(term[w, r], low, high)
            w, low, high = w[ok], low[ok], high[ok]
        return w, low


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """(item, hashes): each distinct window of each item, of `size` words or of all the words of a shorter item, as packed 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, "text"):
            words, n = words_of(part["text"])
            ends, names, rows = np.cumsum(n), [], []
            for name, end, k in zip(part["item"].to_pylist(), ends.tolist(), n.tolist()):
                own = words[end - k : end].tobytes()
                for a in range(max(1, k - size + 1) if k else 0):
                    names.append(name)
                    rows.append(own[8 * a : 8 * (a + size)])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(rows, pa.binary())], names=["item", "hashes"])

    texts = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "item string, hashes binary").distinct()


def _blocks(windows: DataFrame) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(names, distinct term hashes, places of each window's terms among them, sizes) of at most BLOCK windows at a time: the query set, streamed through the driver."""
    rows = windows.toLocalIterator()
    while block := list(islice(rows, BLOCK)):
        sizes = np.array([len(r["hashes"]) // 8 for r in block], np.int64)
        words, place = np.unique(np.frombuffer(b"".join(r["hashes"] for r in block), U), return_inverse=True)
        table = np.zeros((len(block), int(sizes.max())), np.int32)
        table[np.arange(table.shape[1]) < sizes[:, None]] = place
        yield [r["item"] for r in block], words, table, sizes


_MATCHES = "shard string, doc array<int>, item array<string>, start array<int>, size array<int>"


def matches(index: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """A row for each shard and block of windows with matches, as parallel lists: place of the document in the shard, item, first word and words covered."""
    spark, found = index.sparkSession, index.sparkSession.createDataFrame([], _MATCHES)
    for names, *block in _blocks(windows):
        sent = spark.sparkContext.broadcast((names, block))  # at most BLOCK windows

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, block = sent.value
            for batch in batches:
                for k in range(batch.num_rows):
                    shard = Shard({c: batch[c][k] for c in batch.schema.names})
                    got = list(shard.search(*block, slop))
                    if not sum(len(w) for w, _ in got):
                        continue
                    w, start = (np.concatenate(x) for x in zip(*got))
                    doc = np.searchsorted(shard.ends, start, "right")
                    size = np.minimum(block[2][w] + slop, shard.ends[doc] - start)  # a proximity match ends with its document
                    first = start - (shard.ends - shard.words)[doc]
                    item = pa.array([[names[x] for x in w.tolist()]], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([batch["shard"].slice(k, 1), *(x if isinstance(x, pa.Array) else pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (doc, item, first, size))], names=["shard", "doc", "item", "start", "size"])

        found = found.unionByName(index.mapInArrow(tb.tidy(run), _MATCHES))
    return found


def document_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, slop: int = 0, index: DataFrame | None = None) -> DataFrame:
    """(id, n_words, n_hit, items): a row for each row of docs; items are the distinct ids of items found, ascending.

    A word is hit if any match covers it. `index` can be given if it has been built before, then docs is not read.
    """
    index = materialize(build_index(docs, id_col, text_col), "index", LARGE_ROWS) if index is None else index
    found = materialize(matches(index, materialize(item_windows(items, item_col, item_text_col, size), "windows"), slop), "matches")
    # A row for each shard that has matches: as many as a few MB of text hold.
    found = found.groupBy("shard").agg(F.flatten(F.collect_list(F.arrays_zip("doc", "item", "start", "size"))).alias("found"))
    rows = index.select("shard", "ids", "words").join(found.hint("merge"), "shard", "left").select("ids", "words", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, words = batch["ids"][k].values, np.array(batch["words"][k].as_py(), np.int64)
                hit, items = np.zeros(len(words), np.int64), [[] for _ in range(len(words))]
                if batch["found"][k].is_valid:
                    got = batch["found"][k].values
                    doc, start, length = (got.field(c).to_numpy().astype(np.int64) for c in ("doc", "start", "size"))
                    first = np.cumsum(words) - words
                    edge = np.bincount(first[doc] + start, minlength=int(words.sum()) + 1) - np.bincount(first[doc] + start + length, minlength=int(words.sum()) + 1)
                    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
                    hit = covered[first + words] - covered[first]
                    for d, name in sorted(set(zip(doc.tolist(), got.field("item").to_pylist()))):
                        items[d].append(name)
                yield pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(hit), pa.array(items, pa.list_(pa.string()))], names=["id", "n_words", "n_hit", "items"])

    return rows.mapInArrow(tb.tidy(run), f"id {index.schema['ids'].dataType.elementType.simpleString()}, n_words bigint, n_hit bigint, items array<string>")


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that have no hit, with the columns of docs. Rows are told apart by id and text, so one id's clean rows stay."""
    key = F.concat_ws(":", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.xxhash64(F.col(f"`{text_col}`").cast("string")).cast("string"))
    hit = document_hits(docs.select(key.alias("id"), F.col(f"`{text_col}`").alias("text")), items, "id", "text", **options).where("n_hit > 0")
    own = "_hit_key"
    while own in (c.lower() for c in docs.columns):
        own += "_"
    gone = materialize(hit.select(F.col("id").alias(own)).distinct(), "hit")
    return join_checked(docs.withColumn(own, key), gone, own, "left_anti", max_rows=200_000).drop(own)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = document_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op7_benchmark_decontamination": op7_benchmark_decontamination}

SQL = {
    "op7_benchmark_decontamination": r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: list_aggregate(w[i:i + 9], 'string_agg', ' '))) AS g FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, ks.k, unnest(range(1, len(w) - ks.k + 2)) AS s, w FROM d, ks WHERE len(w) >= ks.k),
m AS (SELECT dw.doc_id, win.item_id, dw.s, dw.k FROM dw JOIN win ON win.k = dw.k AND win.g = list_aggregate(dw.w[dw.s:dw.s + dw.k - 1], 'string_agg', ' ')),
hit AS (SELECT doc_id, count(DISTINCT s + o) AS n FROM m, range(0, 10) AS r(o) WHERE o < k GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
}
