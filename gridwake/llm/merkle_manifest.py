"""Operator 13: a Merkle manifest of a table, with proofs and folds by parent preimages.

A row's leaf is the digest of its fields, each with its length. The leaves of a part of the table (a language) stand in
the order of their keys; every `arity` consecutive nodes, the last ones fewer, make a parent, whose preimage is the
concatenation of their digests and whose digest is that of the preimage. The parts' roots make the table's root likewise.

Trees are built in tiers: blocks of consecutive nodes, at most BLOCK of them, hold the preimages of all parents inside
them, and a block's top is a node of the next tier. Stored blocks are the manifest. From the top down each block joins
the chain of preimages above it, and leaves join their block: cutting its own 64 characters out of each ancestor's
preimage leaves a leaf's siblings (its proof), and putting another digest in their place folds it up to a root. No step
needs a tree, a part or a level in one task; rounds are tiers, log(rows) / log(BLOCK) of them.

Defined results: a null field counts as '-' and differs from an empty one; null keys stand first in their part, a null
part is a part of its own and stands first; rows of one key stand in the order of their leaves; equal rows have places of
their own, so their proofs may differ; texts of any length are digested whole; other columns are not read, whatever their
names, unless they are named as fields; an empty table has no rows and no root; a lone leaf is its part's root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.plans.materialize import join_checked, materialize

#: Characters of a digest.
SIZE = 64
#: Nodes of a block at most.
BLOCK = 32
_LINK = "array<struct<pre:string,at:int>>"


def digest(*parts: Column) -> Column:
    """H: lower-case hex sha256 of the parts' concatenation."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field of a leaf: '-' if null, else its bytes' number, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(*(field(v) for v in values))


def _numbered(rows: DataFrame, order: list[str], tag: str) -> tuple[DataFrame, int]:
    """rows with their place in the order, from 0, and how many they are: sorted by ranges, with the rows of the ranges before each."""
    own = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    own = materialize(own.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_k")), tag)
    per = {r["_p"]: r["n"] for r in own.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each task
    before, total = [], 0
    for p in sorted(per):
        before.append((p, total))
        total += per[p]
    ahead = rows.sparkSession.createDataFrame(before, "_p int, _before bigint")
    return own.join(F.broadcast(ahead), "_p").withColumn("place", F.col("_k") + F.col("_before")).drop("_p", "_k", "_before"), total


def _blocks(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """(tree, idx, n, pre1, pre2, ..., top): the blocks of nodes (tree, n, idx, hash); n is the number of nodes in the tree's tier. Levels end where a tree has one node."""
    size = arity**levels
    own = nodes.groupBy("tree", F.expr(f"idx div {size}").alias("blk")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("c"))
    own = own.select("tree", F.col("blk").alias("idx"), "n", F.transform("c", lambda x: x["hash"]).alias("h0"))
    for k in range(1, levels + 1):
        h = F.col(f"h{k - 1}")
        runs = F.sequence(F.lit(0), F.expr(f"CAST((size(h{k - 1}) - 1) div {arity} AS INT)"))
        pre = F.when(F.col("n") > arity ** (k - 1), F.transform(runs, lambda i: F.array_join(F.slice(h, i * arity + 1, arity), ""))).otherwise(F.array().cast("array<string>"))
        own = own.withColumn(f"pre{k}", pre)
        own = own.withColumn(f"h{k}", F.when(F.col("n") > arity ** (k - 1), F.transform(f"pre{k}", lambda x: F.sha2(x, 256))).otherwise(h))
    return own.select("tree", "idx", "n", *(f"pre{k}" for k in range(1, levels + 1)), F.element_at(f"h{levels}", 1).alias("top"))


def _grow(nodes: DataFrame, most: int, arity: int, levels: int, tag: str) -> list[DataFrame]:
    """The blocks of each tier, written; most is the largest n of a tree."""
    size, tiers = arity**levels, []
    while True:
        tiers.append(materialize(_blocks(nodes, arity, levels), f"{tag}{len(tiers)}"))
        if most <= size:
            return tiers
        nodes = tiers[-1].where(F.col("n") > size).select("tree", F.expr(f"(n + {size - 1}) div {size}").alias("n"), "idx", F.col("top").alias("hash"))
        most = -(-most // size)


def _chained(nodes: DataFrame, blocks: DataFrame, arity: int, levels: int) -> DataFrame:
    """nodes (tree, idx, ...) with what their block (tree, idx, n, pre..., above, subroot) has, and chain, the preimages from the node's parent to the root, each with the slot of the node below."""
    size = arity**levels
    b = blocks.select("tree", F.col("idx").alias("_blk"), F.col("n").alias("_n"), *(f"pre{k}" for k in range(1, levels + 1)), "above", "subroot")
    met = nodes.withColumn("_blk", F.expr(f"idx div {size}")).join(b, ["tree", "_blk"])
    inside = F.col("idx") - F.col("_blk") * size
    links = []
    for k in range(1, levels + 1):
        parent = F.floor(inside / arity**k).cast("int")
        link = F.struct(F.get(f"pre{k}", parent).alias("pre"), (F.floor(inside / arity ** (k - 1)) % arity).cast("int").alias("at"))
        links.append(F.when(F.col("_n") > arity ** (k - 1), link))
    own = F.array_compact(F.array(*links)).cast(_LINK)
    return met.withColumn("chain", F.concat(own, "above")).drop("_blk", "_n", "above", *(f"pre{k}" for k in range(1, levels + 1)))


def excised(link: Column) -> Column:
    """A preimage without the digest in the link's slot: the siblings."""
    return F.concat(F.substr(link["pre"], F.lit(1), link["at"] * SIZE), F.substr(link["pre"], link["at"] * SIZE + SIZE + 1))


def spliced(link: Column, by: Column) -> Column:
    """A preimage with another digest in the link's slot."""
    return F.concat(F.substr(link["pre"], F.lit(1), link["at"] * SIZE), by, F.substr(link["pre"], link["at"] * SIZE + SIZE + 1))


def proof_digest(chain: Column) -> Column:
    """H of the siblings on the way to the root, lowest level first."""
    return F.sha2(F.array_join(F.transform(chain, excised), ""), 256)


def fold(chain: Column, start: Column) -> Column:
    """The root that a leaf makes with the siblings on its way."""
    return F.aggregate(chain, start, lambda h, link: F.sha2(spliced(link, h), 256))


@dataclass
class Manifest:
    """leaves (tree, place columns of build, idx, leaf, ...), the tiers of the parts' trees and of the tree above them, and the root (None without rows)."""

    leaves: DataFrame
    tiers: list[DataFrame]
    upper: list[DataFrame]
    root: str | None
    arity: int
    levels: int

    def parents(self) -> DataFrame:
        """(tree, level, idx, preimage) of all parents in the parts' trees."""
        out = None
        for t, tier in enumerate(self.tiers):
            for k in range(1, self.levels + 1):
                part = tier.select("tree", F.lit(t * self.levels + k).alias("level"), (F.col("idx") * self.arity ** (self.levels - k)).alias("at"), F.posexplode(f"pre{k}").alias("j", "preimage"))
                part = part.select("tree", "level", (F.col("at") + F.col("j")).alias("idx"), "preimage")
                out = part if out is None else out.unionByName(part)
        return out

    def paths(self) -> DataFrame:
        """leaves with subroot and chain."""
        size = self.arity**self.levels
        none = F.array().cast(_LINK)
        blocks = self.upper[-1].withColumns({"above": none, "subroot": F.col("top")})
        for lower in reversed(self.upper[:-1]):
            up = _chained(lower.select("tree", "idx"), blocks, self.arity, self.levels)
            blocks = lower.join(up.select("tree", "idx", F.col("chain").alias("above"), "subroot"), ["tree", "idx"])
        roots = None
        for tier in self.tiers:
            own = tier.where(F.col("n") <= size).select(F.col("tree").alias("part"), F.col("top").alias("own"))
            roots = own if roots is None else roots.unionByName(own)
        nodes = roots.select(F.lit(0).cast("bigint").alias("tree"), F.col("part").alias("idx"), "own")
        tops = _chained(nodes, blocks, self.arity, self.levels).select(F.col("idx").alias("tree"), F.col("chain").alias("above"), F.col("own").alias("subroot"))
        tops = materialize(tops, "parts")
        blocks = None
        for tier in reversed(self.tiers):
            ended = tier.where(F.col("n") <= size).join(tops, "tree")
            if blocks is not None:
                lower = tier.where(F.col("n") > size)
                up = _chained(lower.select("tree", "idx"), blocks, self.arity, self.levels)
                ended = ended.unionByName(lower.join(up.select("tree", "idx", F.col("chain").alias("above"), "subroot"), ["tree", "idx"]))
            blocks = ended
        return _chained(self.leaves, blocks, self.arity, self.levels)


def build(rows: DataFrame, key: str, part: str, values: dict[str, Column], arity: int = 2) -> Manifest:
    """The manifest of a table; values are the digests (columns of `rows`) that each leaf's row carries, among them 'leaf'."""
    levels = 1
    while arity ** (levels + 1) <= BLOCK:
        levels += 1
    own = rows.select(F.col(part).alias("part"), F.col(key).alias("key"), *(c.alias(n) for n, c in values.items()), F.monotonically_increasing_id().alias("tie"))
    own, total = _numbered(materialize(own, "leaves"), ["part", "key", "leaf", "tie"], "ordered")
    if not total:
        return Manifest(own.select(F.lit(0).cast("bigint").alias("tree"), F.col("place").alias("idx"), "part", "key", *values), [], [], None, arity, levels)
    parts = own.groupBy("part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    parts, n_parts = _numbered(parts, ["part"], "parts")
    parts = materialize(parts.select(F.col("part").isNull().alias("none"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("name"), F.col("place").alias("tree"), "first", "n"), "parts")
    own = own.withColumns({"none": F.col("part").isNull(), "name": F.coalesce(F.col("part").cast("string"), F.lit(""))})
    own = join_checked(own, parts, ["none", "name"], "inner").drop("none", "name", "tie")
    own = materialize(own.withColumn("idx", F.col("place") - F.col("first")).drop("place", "first"), "placed")
    most = parts.agg(F.max("n")).first()[0]
    tiers = _grow(own.select("tree", "n", "idx", F.col("leaf").alias("hash")), most, arity, levels, "tier")
    tops = None
    for tier in tiers:
        ended = tier.where(F.col("n") <= arity**levels).select(F.lit(0).cast("bigint").alias("tree"), F.lit(n_parts).cast("bigint").alias("n"), F.col("tree").alias("idx"), F.col("top").alias("hash"))
        tops = ended if tops is None else tops.unionByName(ended)
    upper = _grow(tops, n_parts, arity, levels, "upper")
    return Manifest(own.drop("n"), tiers, upper, upper[-1].first()["top"], arity, levels)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    # Tampering adds 1 to n_chars.
    changed = [*fields[:3], F.col("n_chars").cast("decimal(20,0)") + 1, fields[4]]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    made = build(docs, "doc_id", "lang", {"leaf": leaf(fields), "altered": F.when(chosen, leaf(changed))})
    root = F.lit(made.root).cast("string")
    if made.root is None:
        none = F.lit(None).cast("string")
        return made.leaves.select(F.col("key").alias("doc_id"), "leaf", none.alias("subroot"), root.alias("root"), none.alias("proof_sha256"), none.alias("folded_root"), F.lit(None).cast("boolean").alias("verified"))
    out = made.paths().select(F.col("key").alias("doc_id"), "leaf", "subroot", root.alias("root"), proof_digest(F.col("chain")).alias("proof_sha256"), fold(F.col("chain"), F.coalesce("altered", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(n_chars: str) -> str:
    return "sha256({})".format(" || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")))


SQL = {
    "op13_merkle_manifest": f"""WITH RECURSIVE crc AS (SELECT doc_id AS id, doc_id::VARCHAR AS s, 4294967295::BIGINT AS c, 0 AS k FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
 UNION ALL SELECT id, s, CASE WHEN k % 9 = 0 THEN xor(c, ascii(s[k // 9 + 1:k // 9 + 1])::BIGINT) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM crc WHERE k < 9 * length(s)),
hit AS (SELECT id FROM crc WHERE k = 9 * length(s) AND xor(c, 4294967295) % 7 = 0),
lv AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("(n_chars + 1)")} AS other FROM documents),
nl AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM lv),
low AS (SELECT tree, 0 AS lev, idx, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM nl
 UNION ALL SELECT tree, lev + 1, idx, h, count(*) OVER (PARTITION BY tree) FROM (SELECT tree, any_value(lev) AS lev, idx // 2 AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h FROM low WHERE n > 1 GROUP BY tree, idx // 2)),
sub AS (SELECT tree, lev AS depth, h AS subroot FROM low WHERE n = 1),
up AS (SELECT 0 AS lev, tree AS idx, subroot AS h, count(*) OVER () AS n FROM sub
 UNION ALL SELECT lev + 1, idx, h, count(*) OVER () FROM (SELECT any_value(lev) AS lev, idx // 2 AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h FROM up WHERE n > 1 GROUP BY idx // 2)),
root AS (SELECT lev AS depth, h AS root FROM up WHERE n = 1),
way AS (SELECT tree, idx, lev, o.h AS sib, a.idx_at % 2 AS odd FROM (SELECT nl.tree, nl.idx, l AS lev, nl.idx >> l::BIGINT AS idx_at FROM nl JOIN sub USING (tree), LATERAL (SELECT unnest(range(0, sub.depth)) AS l)) a LEFT JOIN (SELECT tree AS t, lev AS l, idx AS i, h FROM low) o ON o.t = a.tree AND o.l = a.lev AND o.i = xor(a.idx_at, 1)),
high AS (SELECT tree, lev, o.h AS sib, a.idx_at % 2 AS odd FROM (SELECT sub.tree, l AS lev, sub.tree >> l::BIGINT AS idx_at FROM sub, root, LATERAL (SELECT unnest(range(0, root.depth)) AS l)) a LEFT JOIN (SELECT lev AS l, idx AS i, h FROM up) o ON o.l = a.lev AND o.i = xor(a.idx_at, 1)),
steps AS (SELECT tree, idx, lev, sib, odd FROM way UNION ALL SELECT nl.tree, nl.idx, sub.depth + high.lev, high.sib, high.odd FROM nl JOIN sub USING (tree) JOIN high USING (tree)),
chain AS (SELECT tree, idx, list([sib, odd::VARCHAR] ORDER BY lev) AS ch FROM steps GROUP BY tree, idx),
alls AS (SELECT nl.*, coalesce(ch, []) AS ch, CASE WHEN doc_id IN (SELECT id FROM hit) AND other IS NOT NULL THEN other ELSE leaf END AS begin_ FROM nl LEFT JOIN chain USING (tree, idx)),
fold AS (SELECT tree, idx, ch, begin_ AS h, 1 AS k FROM alls UNION ALL SELECT tree, idx, ch, CASE WHEN ch[k][1] IS NULL THEN sha256(h) WHEN ch[k][2] = '1' THEN sha256(ch[k][1] || h) ELSE sha256(h || ch[k][1]) END, k + 1 FROM fold WHERE k <= len(ch))
SELECT a.doc_id, a.leaf, sub.subroot, root.root, sha256(array_to_string(list_transform(a.ch, lambda x: coalesce(x[1], '')), '')) AS proof_sha256, f.h AS folded_root, f.h = root.root AS verified
FROM alls a JOIN sub USING (tree) JOIN fold f ON f.tree = a.tree AND f.idx = a.idx AND f.k = len(a.ch) + 1, root"""
}
QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
