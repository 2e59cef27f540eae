"""Operator 10: near-duplicate groups by SuperMinHash, banding, exact verification and union-find grouping.

A document's set holds its distinct word shingles, as 64-bit hashes. Equal sets become one node. Each node gets a
SuperMinHash signature: element by element, a random permutation of the slots deals ranks j + u, and a document stops
as soon as every slot holds a rank below j + 1, which for all but short texts is after one or two rounds. Bands of
rows make buckets. In a bucket every node is compared with one pivot, on full sets. Further pairs of a bucket are
compared only where they can still matter: two nodes that links to pivots connect already need no link of their own,
and of the others two can be linked only if they share one of their rarest shingles, early enough for the shared rest to
suffice (prefix and positional filter of exact set joins, which lose nothing). No bucket is capped. Grouping is
union-find in its distributed form: no task holds a forest; alternating large-star and small-star steps, on tables in the
shared folder, unite the trees of linked nodes and hang every node on the root of its tree.

With 32 bands of 4 rows a pair at similarity 0.75 shares no bucket with probability 5e-6.

Defined results: an empty or null text, or one without words, has an empty set and is linked with nothing; a text of any
length is one set. Rows with the same set are one node, so all rows of the smallest id with that text are kept, and rows
of one id with different texts are judged each by its own text. Ids keep their type and are compared by it. A null id
never names a group unless all its members' ids are null; then the component is null and all are kept. Other columns are
not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwake.llm import textbuf as tb
from gridwake.plans.materialize import join_checked, materialize

U = np.uint64


def shingle_sets(data: np.ndarray, off: np.ndarray, words_each: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes, offsets) of each text's word shingles; a shorter text is one shingle."""
    n = len(off) - 1
    data = tb.lower(data)
    starts, ends = tb.spans(tb.SPACED[data], off)
    n_words = tb.per_text(starts, off)
    owner = np.repeat(np.arange(n), n_words)
    words = tb.hash_spans(data, starts, ends)
    grams = tb.ngrams(words, words_each)
    if len(grams):
        whole = np.flatnonzero(owner[: len(grams)] == owner[words_each - 1 :])
        grams, own = grams[whole], owner[whole]
    else:
        own = owner[:0]
    short = np.flatnonzero((n_words > 0) & (n_words < words_each))
    if len(short):
        first = np.cumsum(n_words) - n_words
        extra = np.zeros(len(short), U)
        for k, d in enumerate(short):  # fewer than words_each words each
            extra[k] = tb.ngrams(words[first[d] : first[d] + n_words[d]], int(n_words[d]))[0]
        grams, own = np.concatenate([grams, extra]), np.concatenate([own, short])
    order = np.lexsort((grams, own))
    grams, own = grams[order], own[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])
    grams, own = grams[fresh], own[fresh]
    return grams, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))])


def super_minhash(elements: np.ndarray, off: np.ndarray, slots: int) -> np.ndarray:
    """Signatures, a row of ranks for each set; an empty set has infinite ranks."""
    n = len(off) - 1
    rank = np.full((n, slots), np.inf)
    flat = rank.reshape(-1)
    alive = np.flatnonzero(np.diff(off) > 0)
    perm, n_rows = None, 0
    for j in range(slots):
        if j == 0:
            seed, own = elements, np.repeat(np.arange(n), np.diff(off))
        elif j == 1 or (len(alive) < 0.75 * n_rows):
            on = np.zeros(n, bool)
            on[alive] = True
            keep = on[own]
            seed, own = seed[keep], own[keep]
            perm = perm[keep] if perm is not None else None
            swapped, n_rows = swapped[keep], len(alive)
        if not len(alive):
            break
        mixed = tb.mix(seed + U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        u = (mixed >> U(11)).astype(np.float64) * 2.0**-53
        k = j + (tb.mix(mixed) % U(slots - j)).astype(np.int64)
        if j == 0:
            slot = swapped = k  # the permutation is still the identity
        else:
            if perm is None:
                perm = np.broadcast_to(np.arange(slots, dtype=np.int16), (len(seed), slots)).copy()
                rows = np.arange(len(seed))
                perm[rows, swapped] = 0
                perm[rows, 0] = swapped
            rows = np.arange(len(seed))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
            perm[rows, j] = slot
        np.minimum.at(flat, own * slots + slot, j + u)
        alive = alive[rank[alive].max(axis=1) >= j + 1]
    return rank


def band_keys(rank: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket for each band of each signature."""
    bits = rank.view(U).reshape(len(rank), bands, rows)
    key = np.broadcast_to(tb.mix(np.arange(bands, dtype=U) + U(77)), bits.shape[:2]).copy()
    for r in range(rows):
        key = tb.mix(key * U(0xD1342543DE82EF95) + bits[:, :, r])
    return key


def _set_table(docs: DataFrame, words_each: int, bands: int, rows: int) -> DataFrame:
    """(id, key, fp, n, bands): fp identifies the set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, "text", tb.SLICE // 2):
            sets, off = shingle_sets(*tb.utf8(part["text"]), words_each)
            n = np.diff(off)
            raw = sets.tobytes()
            fp = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            keys = band_keys(super_minhash(sets, off, bands * rows), bands, rows).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part["id"], part["key"], pa.array(fp, pa.binary()), pa.array(n), lists], names=["id", "key", "fp", "n", "bands"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, key bigint, fp binary, n bigint, bands array<bigint>")


def _wanted_sets(docs: DataFrame, wanted: DataFrame, words_each: int) -> DataFrame:
    """(fp, shingles) of the texts whose id is in wanted (fp, id), read again from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, "text", tb.SLICE // 2):
            sets, off = shingle_sets(*tb.utf8(part["text"]), words_each)
            raw = sets.tobytes()
            cut = [raw[8 * a : 8 * b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in cut], pa.binary()), pa.array(cut, pa.binary())], names=["fp", "shingles"])

    texts = docs.join(wanted.select("id").distinct(), "id", "left_semi")
    found = texts.select("text").mapInArrow(run, "fp binary, shingles binary")
    return found.join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with shared and total, the sizes of intersection and union of their full sets."""
    a = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, total = [], []
            for x, y in zip(batch["sa"], batch["sb"]):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                same = int(np.count_nonzero(y[at] == x)) if len(y) else 0
                shared.append(same)
                total.append(len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(shared, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "shared", "total"])

    full = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "sa", "sb")
    return full.mapInArrow(tb.tidy(run), "a binary, b binary, shared bigint, total bigint")


def _exact_candidates(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes (fp, n, root) with different roots that can reach the similarity.

    Shingles are ranked by how many nodes have them, rare ones first. Sets of n and m share at least
    t = p (n + m) / (100 + p) shingles if they are linked, so they share one among the first n - p n / 100 + 1, and if
    the first shared one has the ranks i and j, 1 + min(n - i, m - j) >= t. Shingles of one node only are counted but
    not sent on. A shingle's largest root is met from the side of its other roots, so that the members of a large group
    are not paired with one another; for that, roots travel as numbers that begin with their size (40 bits of the rest
    tell roots of a size apart). Shingles that only one root has can't be shared by a pair, so they rank before all
    others. Last, 256 parities of the hashes bound the overlap from above: sets that differ in h parities differ in h
    shingles at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["n"].to_numpy()
            tokens = np.frombuffer(b"".join(batch["shingles"].to_pylist()), np.int64)
            first = lambda c: np.frombuffer(b"".join(x[:8] for x in batch[c].to_pylist()), np.int64)
            root = np.minimum(batch["size"].to_numpy(), (1 << 23) - 1) << 40 | first("root") & ((1 << 40) - 1)
            columns = [tokens, *(np.repeat(x, n) for x in (first("fp"), n, root))]
            for k in range(0, len(tokens), 1 << 19):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 19)]) for x in columns], names=["token", "node", "n", "root"])

    sized = nodes.join(nodes.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root")
    rows = sets.join(sized, "fp").select("fp", "n", "root", "size", "shingles").mapInArrow(tb.tidy(run), "token bigint, node bigint, n bigint, root bigint")
    rows = materialize(rows, "open_shingles")
    known = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.max("root").alias("major"), F.min("root").alias("least"))
    known = known.where("least <> major").select("token", "df", "major")
    own = Window.partitionBy("node")
    ranked = rows.join(known, "token").withColumn("k", F.count(F.lit(1)).over(own)).withColumn("i", F.row_number().over(own.orderBy("df", "token")))
    ranked = ranked.withColumn("i", F.col("n") - F.col("k") + F.col("i"))
    prefix = ranked.where(f"i <= n - ceil({percent} * n / 100) + 1").select("token", "node", "n", "root", "i", "major")
    parity = sets.join(nodes.select("fp"), "fp", "left_semi").mapInArrow(tb.tidy(_parities), "node bigint, h array<bigint>")
    prefix = materialize(prefix.join(materialize(parity, "parities"), "node"), "prefixes")
    x = prefix.where("root <> major").select("token", F.col("node").alias("a"), "n", F.col("root").alias("root_a"), "i", F.col("h").alias("g"))
    y = prefix.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("root_b"), F.col("i").alias("j"), "major", "h")
    differ = sum((F.bit_count(F.col("g")[w].bitwiseXOR(F.col("h")[w])) for w in range(4)), F.lit(0))
    fits = F.expr(f"({100 + percent}) * (1 + least(n - i, m - j)) >= {percent} * (n + m)") & ((100 + percent) * (F.col("n") + F.col("m") - differ) >= 2 * percent * (F.col("n") + F.col("m")))
    met = x.join(y, "token").where((F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("major")) | (F.col("a") < F.col("b"))) & fits)
    names = nodes.mapInArrow(tb.tidy(_keys), "fp binary, key bigint")
    pairs = met.select("a", "b").distinct()
    pairs = pairs.join(names.select(F.col("fp").alias("fa"), F.col("key").alias("a")), "a").join(names.select(F.col("fp").alias("fb"), F.col("key").alias("b")), "b")
    return pairs.select(F.col("fa").alias("a"), F.col("fb").alias("b"))


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            part = batch.slice(k, 1024)
            raw = part["shingles"].to_pylist()
            owner = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
            bits = np.bincount(owner * 256 + (np.frombuffer(b"".join(raw), np.uint64) & U(255)).astype(np.int64), minlength=256 * len(raw)) % 2
            words = np.packbits(bits.astype(np.uint8).reshape(-1, 256), axis=1).view(np.int64)
            node = np.frombuffer(b"".join(x[:8] for x in part["fp"].to_pylist()), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * 4), pa.array(words.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(node), lists], names=["node", "h"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["fp"], pa.array(np.frombuffer(b"".join(x[:8] for x in batch["fp"].to_pylist()), np.int64))], names=["fp", "key"])


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of links (a, b); root is the smallest node of the component.

    Large-star hangs a node's larger neighbours on its smallest one, small-star its smaller ones; the edge table stops
    changing when every node hangs on its root. Hubs are met by partial aggregation and by joins that adaptive
    execution can split.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        # Written, so that a hub's edges meet it in a join of its own, by broadcast or split by adaptive execution.
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        met = join_checked(both, least, "a", "inner")
        if large:
            return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()

    def digest(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = digest(edges)
    for _ in range(max_rounds):
        edges = materialize(star(star(edges, True), False), "stars")
        now = digest(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())


def text_key(text_col: str) -> Column:
    """A 64-bit hash that tells the texts of one id apart."""
    return F.xxhash64(F.col(f"`{text_col}`").cast("string"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, percent: int = 75, bands: int = 32, rows: int = 4) -> DataFrame:
    """(id, key, n_shingles, component): a row for each row of docs; component is the smallest id of the group, key the text_key."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), text_key(text_col).alias("key"))
    named = F.lit("0").cast(texts.schema["id"].dataType)
    table = materialize(_set_table(texts, words_each, bands, rows), "sets")
    nodes = table.where("fp IS NOT NULL").groupBy("fp").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    member = materialize(nodes.select("fp", "id", "n", F.explode("bands").alias("bucket")), "members")
    pivots = member.groupBy("bucket").agg(F.min("fp").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket", "pivot")
    member = materialize(member.join(pivots, "bucket"), "shared_buckets")

    # A null id can't be looked up by id; such texts are found through their own rows.
    wanted = materialize(member.select("fp", "id", "n").distinct(), "candidates")
    sets = materialize(_wanted_sets(texts.where("id IS NOT NULL"), wanted, words_each), "candidate_sets")
    if wanted.where("id IS NULL").count():
        sets = materialize(sets.unionByName(_wanted_sets(texts.where("id IS NULL").withColumn("id", named), wanted.where("id IS NULL").withColumn("id", named), words_each)), "candidate_sets")

    first = member.where("fp <> pivot").select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct()
    first = materialize(_verified(first, sets), "first_pairs")
    linked = F.expr(f"100 * shared >= {percent} * total")

    links = first.where(linked).select("a", "b")
    label = materialize(components(links), "labels")

    # Nodes that share a bucket but are not connected so far; a bucket whose nodes are all connected asks for nothing.
    place = member.join(label.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    torn = place.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("size")).where("x <> y AND size > 2").select("bucket")
    open_ = materialize(place.join(torn, "bucket", "left_semi").select("fp", "n", "root").distinct(), "open_nodes")
    second = materialize(_exact_candidates(open_, sets, percent), "second_pairs")
    if second.limit(1).count():
        links = links.union(_verified(second, sets).where(linked).select("a", "b"))
        label = components(links)

    ids = nodes.select(F.col("fp").alias("node"), "id")
    rooted = materialize(label.join(wanted.select(F.col("fp").alias("node"), "id"), "node"), "roots")
    names = rooted.groupBy("root").agg(F.min("id").alias("component"))
    grouped = rooted.join(names, "root").select(F.col("node").alias("fp"), "component")
    alone = ids.join(grouped.select(F.col("fp").alias("node")), "node", "left_anti").select(F.col("node").alias("fp"), F.col("id").alias("component"))
    whole = materialize(grouped.unionByName(alone), "components")
    out = table.select("id", "key", "n", "fp").join(whole, "fp", "left")
    return out.select("id", "key", F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of docs whose id is the smallest of their group, with the columns of docs; rows without an id stay."""
    stem = "_gone_"
    while any(c.lower().startswith(stem) for c in docs.columns):
        stem += "_"
    own, text = f"{stem}id", f"{stem}key"
    gone = near_groups(docs, id_col, text_col, **options).where("component <> id").select(F.col("id").alias(own), F.col("key").alias(text)).distinct()
    keyed = docs.withColumn(own, F.col(f"`{id_col}`")).withColumn(text, text_key(text_col))
    return join_checked(keyed, materialize(gone, "gone"), [own, text], "left_anti", max_rows=200_000).drop(own, text)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


QUERIES = {"op10_minhash_near_dedup": op10_minhash_near_dedup}

SQL = {
    "op10_minhash_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
}
