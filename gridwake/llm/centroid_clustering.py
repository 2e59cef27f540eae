"""Operator 12: centroid clustering by weighted deduplication.

Vectors are quantised to integers, and equal ones are grouped with their multiplicity. Lloyd's rounds run on the distinct
vectors alone, written once: each task gives the weighted sums of its vectors for each centroid, so a round's exchange is
centroids x components numbers for each task, however many rows a vector stands for. Distances and sums are exact integers.
At the end the assignments of distinct vectors are joined back to the rows.

Defined results: vectors that are null, of another length, or with a null, NaN or infinite component have no row; a
component of 2^19 or more in size is an error, since squared distances would leave 64 bits; ids may be null (such
rows are clustered, but start no centroid) or repeated and keep their type; equal vectors have equal results; of equally
near centroids the smaller number counts; with fewer vectors than centroids each vector starts one; an empty centroid
stays where it is; other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.llm import textbuf as tb
from gridwake.plans.materialize import materialize

#: Quantised components lie below this size.
WIDEST = 1 << 27
#: Up to this size a distance is exact in doubles.
NARROW = 1 << 20
#: Vectors that are compared with the centroids at once.
ROWS = 4096


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: float = 256.0) -> DataFrame:
    """(id, q): floor(scale * x) of the components of whole, finite vectors, as little-endian 32-bit integers."""
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    kept = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where((F.size("v") == dims) & finite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(pc.list_flatten(batch["v"]).to_numpy(zero_copy_only=False) * scale)
            if len(x) and np.abs(x).max() >= WIDEST:
                raise ValueError(f"a component times {scale} is {WIDEST} or more in size")
            packed = pa.Array.from_buffers(pa.binary(4 * dims), batch.num_rows, [None, pa.py_buffer(x.astype("<i4"))])
            yield pa.RecordBatch.from_arrays([batch["id"], packed.cast(pa.binary())], names=["id", "q"])

    return kept.mapInArrow(tb.tidy(run), f"id {kept.schema['id'].dataType.simpleString()}, q binary")


def unpacked(q: pa.Array, dims: int) -> np.ndarray:
    """rows x dims integers of packed vectors."""
    data, _ = tb.utf8(q)
    return data.view("<i4").reshape(-1, dims).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid, the smaller number on ties; exact."""
    number, distance = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
    narrow = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= NARROW
    for k in range(0, len(x), ROWS):
        part = x[k : k + ROWS]
        if narrow:
            a, b = part.astype(float), centroids.astype(float)
            d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
        else:
            d = np.stack([((part - c) ** 2).sum(axis=1) for c in centroids], axis=1)
        best = d.argmin(axis=1)
        number[k : k + ROWS], distance[k : k + ROWS] = best, d[np.arange(len(part)), best]
    return number, distance


def starts(vectors: DataFrame, k: int, prefix: str = "2:") -> list[bytes]:
    """The k vectors whose ids have the smallest lower-case hex sha256 behind the prefix, in that order; rows of one id by their components."""
    hashed = vectors.where("id IS NOT NULL").select(F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")), 256).alias("h"), "q")
    return [bytes(r["q"]) for r in hashed.orderBy("h", "q").limit(k).collect()]


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(q, n, cluster, distance) of distinct vectors (q, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = nearest(unpacked(batch["q"], centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([batch["q"], batch["n"], pa.array(number), pa.array(distance)], names=["q", "n", "cluster", "distance"])

    return distinct.mapInArrow(tb.tidy(run), "q binary, n bigint, cluster int, distance bigint")


def weighted_sums(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, dim, total): the components' sums over the vectors of each cluster times their multiplicities; dim -1 has the number of rows."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            x, n = unpacked(batch["q"], dims), batch["n"].to_numpy()
            number, _ = nearest(x, centroids)
            order = np.argsort(number, kind="stable")
            found, first = np.unique(number[order], return_index=True)
            if len(found):
                total[found, 0] += np.add.reduceat(n[order], first)
                total[found, 1:] += np.add.reduceat((x * n[:, None])[order], first, axis=0)
        c, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array((d - 1).astype(np.int32)), pa.array(total[c, d])], names=["cluster", "dim", "total"])

    each = distinct.select("q", "n").mapInArrow(tb.tidy(run), "cluster int, dim int, total bigint")
    return each.groupBy("cluster", "dim").agg(F.sum("total").alias("total"))


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after the rounds: floors of the exact means; those without vectors stay. The driver gets centroids x components numbers a round."""
    for _ in range(rounds):
        total = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        for r in weighted_sums(distinct, centroids).collect():
            total[r["cluster"], r["dim"] + 1] = r["total"]
        full = total[:, 0] > 0
        centroids = centroids.copy()
        centroids[full] = total[full, 1:] // total[full, :1]
    return centroids


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: float = 256.0) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance, cluster_inertia, inertia) of each kept row, the centroids)."""
    vectors = quantised(rows, id_col, vector_col, dims, scale)
    first = starts(vectors, k)
    centroids = np.array([np.frombuffer(q, "<i4") for q in first], np.int64).reshape(len(first), dims)
    if not first:
        return vectors.where("false").selectExpr("id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia"), centroids
    distinct = materialize(vectors.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "distinct")
    centroids = lloyd(distinct, centroids, rounds)
    found = materialize(assigned(distinct, centroids), "assigned")
    per = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance") * F.col("n")).alias("total")).collect()}  # a number for each centroid
    sums = rows.sparkSession.createDataFrame([(c, t, sum(per.values())) for c, t in sorted(per.items())], "cluster int, cluster_inertia bigint, inertia bigint")
    back = vectors.join(found.select("q", "cluster", "distance"), "q").drop("q")
    return back.join(F.broadcast(sums), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia"), centroids


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    digest = F.element_at(F.array(*(F.lit(d) for d in digests)), F.col("cluster") + 1) if digests else F.lit(None).cast("string")
    return got.withColumnRenamed("id", "vec_id").withColumn("centroid_sha256", digest)


def _sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    near = "a{0} AS MATERIALIZED (SELECT rid, arg_min(c, [d, c]) AS c, min(d) AS d FROM (SELECT rid, c, list_dot_product(k.v, k.v) - 2 * list_dot_product(k.v, m.v) + list_dot_product(m.v, m.v) AS d FROM kept k, c{0} m) GROUP BY rid)"
    mean = "c{1} AS MATERIALIZED (SELECT o.c, coalesce(n.v, o.v) AS v FROM c{0} o LEFT JOIN (SELECT c, list(((s - ((s % n + n) % n)) // n)::DOUBLE ORDER BY j) AS v FROM (SELECT c, j, sum(x::BIGINT)::BIGINT AS s, count(*) AS n FROM (SELECT a.c, unnest(k.v) AS x, unnest(range(0, " + str(dims) + ")) AS j FROM a{0} a JOIN kept k USING (rid)) GROUP BY c, j) GROUP BY c) n USING (c))"
    ctes = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds):
        ctes += [near.format(r), mean.format(r, r + 1)]
    ctes.append(near.format(rounds))
    return "WITH " + ",\n".join(ctes) + f"\nSELECT vec_id, a.c::INT AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(m.v, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM a{rounds} a JOIN kept USING (rid) JOIN c{rounds} m ON m.c = a.c"


QUERIES = {"op12_centroid_clustering": op12_centroid_clustering}
SQL = {"op12_centroid_clustering": _sql()}
