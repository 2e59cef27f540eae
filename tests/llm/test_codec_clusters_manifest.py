"""Operators 11 to 13 against the library, plain Python and SQL."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.llm import byte_bpe, centroid_clustering, merkle_manifest, registry

CLASH = ("part", "key", "tree", "idx", "n", "place", "none", "name", "id", "ids", "decoded", "q", "cluster", "v", "tie", "leaf", "chain")


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers
    import tiktoken

    vocab = byte_bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return vocab, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ids, special_tokens={})


def _same(codec, texts):
    vocab, library = codec
    ids, n = vocab.encode(texts)
    ends = np.cumsum(n)
    for text, a, b in zip(texts, ends - n, ends):
        assert ids[a:b].tolist() == library.encode_ordinary(text or ""), (text or "")[:40]
        assert b"".join(vocab.decode(ids[a:b])).decode() == (text or "")


def test_bytes_equal_the_library(codec):
    rng = random.Random(3)
    hard = ["", None, "a" * 30_000, "ab" * 3000, "".join(rng.choice("ab") for _ in range(9000)), "日本語" * 900, "\n" * 3000 + "x", " " * 2000, "😀" * 500, "don't WE'LL 'S's " * 9, "<|endoftext|> x", "\0\x1c\x85 "]
    hard += ["x" * k for k in range(1, 12)] + [c * k for k in (255, 256, 257, 513) for c in "yß"] + ["".join(rng.choice("etaoin shrdlu'\n\t0123456789,.") for _ in range(20_000))]
    _same(codec, hard)
    _same(codec, [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} x" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)])
    words = ["".join(chr(rng.choice((rng.randrange(97, 123), rng.randrange(0x400, 0x450), rng.randrange(0x4E00, 0x5000)))) for _ in range(rng.randint(1, 300))) for _ in range(600)]
    _same(codec, words)


def test_texts_are_cut_where_no_word_goes_on(codec, monkeypatch):
    text = "".join(random.Random(k).choice(["word", " ", "  ", "\n", "\n \n", "'s", "9", "é", "　", "!?"]) for k in range(4000))
    whole = codec[0].encode([text])[0].tolist()
    for n in (1, 7, 100):
        monkeypatch.setattr(byte_bpe, "CHARS", n)
        assert codec[0].encode([text])[0].tolist() == whole
    monkeypatch.setattr(byte_bpe, "IDS", 5)
    assert b"".join(codec[0].decode(np.array(whole))).decode() == text
    with pytest.raises(ValueError):
        list(codec[0].decode(np.array([10**6])))


def test_hashed_pairs_with_collisions():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 50_000, (30_000, 2)), axis=0)
    table = byte_bpe.HashedPairs(keys[:, 0], keys[:, 1], np.arange(len(keys)))
    assert table.find(keys[:, 0].astype(np.int32), keys[:, 1].astype(np.int32)).tolist() == list(range(len(keys)))
    known = set(map(tuple, keys.tolist()))
    other = rng.integers(-1, 50_000, (30_000, 2)).astype(np.int32)
    found = table.find(other[:, 0], other[:, 1])
    assert all((f == byte_bpe.NONE) == (tuple(o) not in known) for f, o in zip(found.tolist(), other.tolist()))


def test_rows_merge_like_a_plain_loop():
    rng = np.random.default_rng(2)
    pairs = {(a, b): 10 + k for k, (a, b) in enumerate((a, b) for a in range(10) for b in range(10) if rng.random() < 0.4)}
    for k in range(200):  # merged symbols merge again
        a, b = (int(x) for x in rng.integers(0, 10 + len(pairs), 2))
        pairs.setdefault((a, b), 10 + len(pairs))
    table = byte_bpe.HashedPairs(*(np.array(x) for x in zip(*((a, b, r) for (a, b), r in pairs.items()))))
    rows = [rng.integers(0, 10, rng.integers(2, 40)).tolist() for _ in range(300)]
    grid = np.full((len(rows), max(map(len, rows))), byte_bpe.PAD, np.int32)
    for k, r in enumerate(rows):
        grid[k, : len(r)] = r
    flat, n = byte_bpe.merge_rows(grid, table)
    want = []
    for r in rows:
        while ranks := [(pairs[p], k) for k, p in enumerate(zip(r, r[1:])) if p in pairs]:
            low, at = min(ranks)
            r = r[:at] + [low] + r[at + 2 :]
        want.append(r)
    assert n.tolist() == [len(r) for r in want] and flat.tolist() == [x for r in want for x in r]


def _odd(spark):
    rows = [(1, "one two"), (1, "one two"), (None, "x"), (2, None), (3, ""), (None, None), (4, "long text here " * 9000)]
    df = spark.createDataFrame([(k, t, None if k == 2 else "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def test_byte_columns(spark, codec):
    odd = _odd(spark)
    coded = byte_bpe.encode_column(odd)
    assert coded.columns == [c for c in odd.columns if c != "ids"] + ["ids"]
    back = byte_bpe.decode_column(coded)
    for r in back.collect():
        assert list(r["ids"]) == codec[1].encode_ordinary(r["text"] or "") and bytes(r["decoded"]).decode() == (r["text"] or "")
    assert byte_bpe.decode_column(coded.withColumn("ids", F.lit(None).cast("array<int>"))).where("decoded IS NOT NULL").count() == 0
    got = collections.Counter((r["id"], r["n_tokens"]) for r in byte_bpe.digests(odd).collect())
    assert got == collections.Counter((r["doc_id"], len(codec[1].encode_ordinary(r["text"] or ""))) for r in odd.collect())
    assert byte_bpe.digests(odd.where("false")).count() == byte_bpe.encode_column(odd.where("false")).count() == 0
    assert dict(byte_bpe.digests(odd.withColumn("doc_id", F.lit("a"))).dtypes)["id"] == "string"


def test_byte_digests_of_whole_tables(spark, sf, codec):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = byte_bpe.op11_byte_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = codec[1].encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


# --- clusters -----------------------------------------------------------------------------------------------------


def _lloyd(rows, k, rounds, dims, scale=256):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    centroids = [v for _, v in sorted(((hashlib.sha256(f"2:{i}".encode()).hexdigest(), np.array(v, "<i4").tobytes()), v) for i, v in kept if i is not None)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [tuple(sum(x) // len(groups[j]) for x in zip(*groups[j])) if groups[j] else c for j, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    per = collections.Counter()
    for _, j, d in found:
        per[j] += d
    return collections.Counter((i, j, d, per[j], sum(per.values())) for i, j, d in found), centroids


def test_clusters_against_plain_python(spark):
    rng = random.Random(4)
    hot = [0.5] * 6
    rows = [(k, [rng.uniform(-3, 3) for _ in range(6)]) for k in range(150)] + [(1000 + k, hot) for k in range(120)] + [(5, hot), (5, hot), (None, hot), (None, [0.1] * 6)]
    rows += [(2000, None), (2001, [1.0] * 5), (2002, [1.0] * 7), (2003, [float("nan")] * 6), (2004, [float("inf")] + [0.0] * 5), (2005, [None] + [0.0] * 5), (2006, [])]
    rows += [(3000, [400.0] * 6), (3001, [-90_000.25] * 6), (3002, [400_000.0] * 6)]  # beyond what doubles hold exactly
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in CLASH})
    for k, rounds in ((7, 3), (40, 5), (500, 1), (1, 0)):
        want, centroids = _lloyd(rows, k, rounds, 6)
        got, found = centroid_clustering.cluster(df, k, rounds, dims=6)
        assert collections.Counter(map(tuple, got.collect())) == want
        assert [tuple(c) for c in found.tolist()] == [tuple(c) for c in centroids]
    none, found = centroid_clustering.cluster(df.where("false"), 5, 2, dims=6)
    assert none.count() == 0 and none.columns == got.columns and len(found) == 0
    with pytest.raises(Exception, match="in size"):
        centroid_clustering.cluster(spark.createDataFrame([(1, [float(1 << 19)] * 6)], "vec_id long, embedding array<double>"), 2, 1, dims=6)


def test_ties_go_to_the_smaller_centroid_and_empty_ones_stay(spark):
    number, distance = centroid_clustering.nearest(np.array([[0, 0], [3, 0]]), np.array([[1, 0], [-1, 0], [3, 1]]))
    assert number.tolist() == [0, 2] and distance.tolist() == [1, 1]
    df = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(9)], "vec_id long, embedding array<double>")
    got, centroids = centroid_clustering.cluster(df, 4, 3, dims=2)
    assert {r["cluster"] for r in got.collect()} == {0} and centroids.tolist() == [[256, 512]] * 4
    wide = 1 << 26
    number, distance = centroid_clustering.nearest(np.array([[wide, -wide]]), np.array([[-wide, wide], [wide, -wide + 3]]))
    assert number.tolist() == [1] and distance.tolist() == [9]


# --- manifest -----------------------------------------------------------------------------------------------------


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(leaves, arity):
    """(root, the sibling digests and the place among them of each leaf's ancestors)."""
    ways, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, j in enumerate(at):
            run = nodes[j // arity * arity : j // arity * arity + arity]
            ways[k].append((run[: j % arity], run[j % arity + 1 :]))
            at[k] = j // arity
        nodes = [_h(*nodes[k : k + arity]) for k in range(0, len(nodes), arity)]
    return nodes[0], ways


def _manifest(rows, arity):
    """rows (key, part, leaf, altered): what each gives."""
    parts = sorted({p for _, p, *_ in rows}, key=lambda p: (p is not None, (p or "").encode()))
    trees = {}
    for p in parts:
        own = sorted((r for r in rows if r[1] == p), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[p] = (own, *_tree([r[2] for r in own], arity))
    root, upper = _tree([trees[p][1] for p in parts], arity)
    out = collections.Counter()
    for j, p in enumerate(parts):
        own, sub, ways = trees[p]
        for r, way in zip(own, ways):
            way, h = way + upper[j], r[3] or r[2]
            for before, after in way:
                h = _h(*before, h, *after)
            out[r[0], r[2], sub, root, _h(*(x for before, after in way for x in before + after)), h] += 1
    return out


@pytest.mark.parametrize("arity", [2, 3, 40])
def test_manifest_against_plain_python(spark, arity):
    rng = random.Random(arity)
    rows = []
    for part, n in ((None, 3), ("", 1), ("b", 1100), ("é", 33), ("Z", 2), ("a", 64), ("c", 32)):
        for k in range(n):
            leaf = _h(str(part), str(k))
            rows.append((k * 7 % 1000 if k % 11 else None, part, leaf, _h("x", leaf) if rng.random() < 0.2 else None))
    rows += [rows[5]] * 3 + [(1, "b", _h("tie"), None), (1, "b", _h("tie 2"), _h("y"))]
    df = spark.createDataFrame(rows, "k long, p string, l string, x string").withColumns({c: F.lit("clash") for c in CLASH})
    made = merkle_manifest.build(df, "k", "p", {"leaf": F.col("l"), "altered": F.col("x")}, arity)
    got = made.paths().select("key", "leaf", "subroot", F.lit(made.root), merkle_manifest.proof_digest(F.col("chain")), merkle_manifest.fold(F.col("chain"), F.coalesce("altered", "leaf"))).collect()
    want = _manifest(rows, arity)
    drop = lambda c: collections.Counter({k[:4] + k[5:]: n for k, n in c.items()})
    assert collections.Counter(map(tuple, got)) == want or drop(collections.Counter(map(tuple, got))) == drop(want)
    proofs = collections.Counter(r[4] for r in got)
    assert proofs == collections.Counter({p: sum(n for k, n in want.items() if k[4] == p) for p in {k[4] for k in want}})
    parents = made.parents().collect()
    assert all(len(r["preimage"]) % 64 == 0 and len(r["preimage"]) <= 64 * arity for r in parents)
    sizes = collections.Counter(p for _, p, *_ in rows)
    levels = lambda n: 0 if n == 1 else -(-n // arity) + levels(-(-n // arity))
    assert len(parents) == sum(map(levels, sizes.values())) == len({(r["tree"], r["level"], r["idx"]) for r in parents})


def test_manifest_of_odd_rows_and_none(spark, tmp_path):
    odd = _odd(spark)
    odd.drop(*CLASH).write.parquet(f"file://{tmp_path}/a/documents.parquet")
    odd.drop(*CLASH).where("false").write.parquet(f"file://{tmp_path}/b/documents.parquet")
    got = merkle_manifest.op13_merkle_manifest(spark, f"file://{tmp_path}/a").collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    rows = []
    for r in odd.collect():
        leaf = lambda n, r=r: _h(*map(field, (r["doc_id"], r["source"], r["lang"], n, r["text"])))
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        rows.append((r["doc_id"], r["lang"], leaf(r["n_chars"]), leaf(r["n_chars"] + 1) if hit else None))
    want = _manifest(rows, 2)
    assert collections.Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["folded_root"]) for r in got) == collections.Counter({k[:4] + k[5:]: n for k, n in want.items()})
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)
    none = merkle_manifest.op13_merkle_manifest(spark, f"file://{tmp_path}/b")
    assert none.count() == 0 and none.columns == merkle_manifest.op13_merkle_manifest(spark, f"file://{tmp_path}/a").columns


# --- SQL ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, rel = registry.queries()[name](spark, sf), con.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    value = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = collections.Counter(tuple(value(x[rel.columns.index(c)]) for c in columns) for x in rel.fetchall())
    assert collections.Counter(tuple(value(r[c]) for c in columns) for r in df.collect()) == want


def test_distinct_is_unique():
    from gridwake.llm import textbuf

    rng = np.random.default_rng(7)
    for values in (rng.integers(0, 50, 2000).astype(np.uint64) * np.uint64(2**58 + 12345), rng.integers(-9, 9, 300), np.zeros(0, np.uint64), np.zeros(5, np.int64)):
        want = np.unique(values, return_index=True, return_inverse=True)
        assert all(np.array_equal(a, b) for a, b in zip(textbuf.distinct(values), want))
