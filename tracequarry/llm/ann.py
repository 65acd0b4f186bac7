"""Nearest neighbours by cosine with cross-polytope hashing.

Each table has a pseudo-rotation of three rounds of random signs and a fast Hadamard transform; a unit
vector's bucket is the signed axis nearest to its image. A query probes the buckets of its first few axes in
each table, and every vector there is ranked by the exact cosine in double precision. Vectors and
probes meet by (table, bucket, block): a bucket is cut into blocks of bounded size by a hash of
vec_id, and its queries likewise, so one that holds a third of all rows is many tasks' work, and each block gives no more than k
rows a query. Of equal vectors only the k + 1 smallest ids are candidates, as no other can be among the k nearest: a crowd of copies
is one vector's work for each query. A query whose buckets hold fewer than k other ids is compared with all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TABLES, PROBES, SEED, BLOCK = 10, 12, 20, 4096


class Rotations:
    """Pseudo-rotations of a dimension, the same in every process."""

    def __init__(self, dim: int, tables: int = TABLES, seed: int = SEED):
        self.size = 1 << max(0, dim - 1).bit_length()
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, 3, self.size))

    def hadamard(self, x: np.ndarray) -> np.ndarray:
        h = 1
        while h < self.size:
            y = x.reshape(len(x), -1, 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), self.size)
            h *= 2
        return x / np.sqrt(self.size)

    def images(self, unit: np.ndarray, table: int) -> np.ndarray:
        x = np.zeros((len(unit), self.size))
        x[:, : unit.shape[1]] = unit
        for s in self.signs[table]:
            x = self.hadamard(x * s)
        return x

    def buckets(self, unit: np.ndarray, table: int, probes: int = 1) -> np.ndarray:
        """The nearest signed axes, nearest first: 2 * axis + (1 if negative)."""
        x = self.images(unit, table)
        both = np.stack([x, -x], 2).reshape(len(x), -1)
        if probes == 1:
            return both.argmax(1)[:, None]
        return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def usable(frame: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id and v of the rows that take part: a key, and a vector that is not null or zero and has only finite components."""
    v = F.col(vec).cast("array<double>")
    out = frame.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return out.filter(F.col("vec_id").isNotNull() & good)


def nearest(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """Rows (query_id, vec_id, score) of each query's k nearest ids, ties to smaller ids; a query is no candidate of its own. An id counts once, by its best vector; so does a query's."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    _, same = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * 8}").ravel(), return_inverse=True)
    once = np.sort(np.unique(np.stack([ids, same], 1), axis=0, return_index=True)[1])
    vectors, ids, same = vectors[once], ids[once], same[once]
    by = np.lexsort((np.arange(len(ids)), same))
    rank = np.arange(len(by)) - np.maximum.accumulate(np.where(np.r_[True, same[by][1:] != same[by][:-1]], np.arange(len(by)), 0))
    keep = np.sort(by[rank <= k])  # of equal vectors no more than k + 1 can count
    vectors, ids = vectors[keep], ids[keep]
    lengths = lambda x: np.sqrt((x * x).sum(1))
    nv, nq = lengths(vectors), lengths(queries)
    unit = (vectors / nv[:, None]).T
    own_ids = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    out = []
    for a in range(0, len(queries), 256):
        q, own = queries[a : a + 256], query_ids[a : a + 256]
        rough = (q / nq[a : a + 256, None]) @ unit
        rough[own[:, None] == ids[None, :]] = -np.inf
        best = rough if len(own_ids) == len(ids) else np.maximum.reduceat(rough, own_ids, axis=1)
        least = np.partition(best, -k, axis=1)[:, -k] if len(own_ids) > k else np.full(len(q), -2.0)
        i, j = np.nonzero(rough >= np.maximum(least, -2.0)[:, None] - 1e-9)
        for c in range(0, len(i), 65536):
            x, y = i[c : c + 65536], j[c : c + 65536]
            out.append((own[x], ids[y], (q[x] * vectors[y]).sum(1) / (nq[a + x] * nv[y])))
    if not out:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)
    qs, vs, sc = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((vs, -sc, qs))
    qs, vs, sc = qs[order], vs[order], sc[order]
    once = np.sort(np.unique(np.stack([qs, vs], 1), axis=0, return_index=True)[1])  # the best, as it comes first
    qs, vs, sc = qs[once], vs[once], sc[once]
    first = np.maximum.accumulate(np.where(np.r_[True, qs[1:] != qs[:-1]], np.arange(len(qs)), 0)) if len(qs) else np.zeros(0, "i8")
    top = np.arange(len(qs)) - first < k
    return qs[top], vs[top], sc[top]


def search(frame: DataFrame, is_query: Column | str, k: int = 5, vec: str = "embedding", key: str = "vec_id", tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which is_query holds, among all rows but its own.

    Rows of different lengths do not meet: each length has tables of its own. Vectors that are null, zero or
    hold null or non-finite components take no part; repeated keys count once for each different vector. An empty frame gives no rows.
    """
    rows = stored(usable(frame, vec, key).distinct(), "vectors")

    def hashed(width: int):  # 0: one bucket for all

        def run(batches):
            import pyarrow as pa

            for b in batches:
                ids, lists = b.column(0).to_numpy(), b.column(1)
                flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
                for d in np.unique(sizes).tolist():
                    pick = np.flatnonzero(sizes == d)
                    v = np.stack([flat[o : o + d] for o in np.concatenate([[0], np.cumsum(sizes)])[pick]])
                    raw = pa.array([x.tobytes() for x in v], pa.binary())
                    unit = v / np.sqrt((v * v).sum(1))[:, None]
                    for t in range(tables if width else 1):
                        at = np.zeros((len(v), 1), "i4") if not width else Rotations(d, tables).buckets(unit, t, width)
                        for c in range(at.shape[1]):
                            yield pa.RecordBatch.from_arrays([pa.array(ids[pick]), pa.array(np.full(len(v), d, "i4")), pa.array(np.full(len(v), t, "i4")), pa.array(at[:, c].astype("i4")), raw], ["id", "d", "t", "bucket", "raw"])

        return run

    schema = "id long, d int, t int, bucket int, raw binary"
    def rank(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "i8", "vec_id": "i8", "score": "f8"})
        get = lambda x: np.frombuffer(b"".join(x["raw"]), "f8").reshape(len(x), -1)
        q, v, s = nearest(get(right), right["id"].to_numpy(), get(left), left["id"].to_numpy(), k)
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    on = ["d", "t", "bucket", "block", "part"]

    def met(index: DataFrame, asked: DataFrame) -> DataFrame:
        own, numbers = ["d", "t", "bucket"], lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        count = lambda rows, n: rows.groupBy(*own).agg(F.ceil(F.count("*") / block).cast("int").alias(n))
        # At most tables * 2 * dimension rows a length: broadcast.
        blocks = F.broadcast(stored(count(index, "blocks").join(count(asked, "parts"), own), "blocks"))
        index = index.join(blocks, own).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("part", F.explode(numbers("parts")))
        asked = asked.join(blocks, own).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("block", F.explode(numbers("blocks")))
        return index.select(*on, "id", "raw").groupBy(*on).cogroup(asked.select(*on, "id", "raw").groupBy(*on)).applyInPandas(rank, "query_id long, vec_id long, score double")

    queries = rows.filter(is_query)
    alike = Window.partitionBy("v").orderBy("vec_id")
    candidates = rows.withColumn("alike", F.row_number().over(alike)).filter(F.col("alike") <= k + 1).select("vec_id", "v")
    merged = lambda near: near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = stored(merged(met(candidates.mapInArrow(hashed(1), schema), queries.mapInArrow(hashed(probes), schema))), "near")
    enough = best.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = stored(queries.join(enough, "vec_id", "left_anti").select(*rows.columns), "short")
    if not short.isEmpty():
        best = merged(best.unionByName(met(candidates.mapInArrow(hashed(0), schema), short.mapInArrow(hashed(0), schema))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
