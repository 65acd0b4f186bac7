"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within r bits of each other agree, in at least one of m parts of their bits, up to that part's
threshold t_i, if the t_i sum to r - m + 1; a part with threshold -1 is never probed. Bits that go
together are put into one part, which leaves the others more selective; a dynamic program picks
the thresholds, over several m, with the fewest expected probes and candidates under the bit
statistics of all distinct fingerprints. Candidates are verified by their distance.

A part value that more than `crowd` fingerprints share is not paired out. Its fingerprints are linked exactly in
another way: each gives every value that a ball of half the radius around it holds, and
whatever meets at a value is within r, so one link from each to the smallest there is enough. That is 65 rows a fingerprint for r = 2,
however large the group.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, hot_join, one_of_equal, packed_rows, row_key, small_batches, stored, texts_of, unpacked

BITS, RADIUS, SHINGLE, CROWD = 64, 2, 3, 64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """A-Z lower-cased, words between ASCII blanks, shingles with repeats, XXH64 with seed 42; a bit is set if more than half the hashes have it. No words: 0."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    ones, left, take = np.zeros(BITS, "i8"), n, 1 << 15
    digest = xxhash.xxh64_intdigest
    while left > 0:
        m = min(left, take)
        h = np.fromiter((digest(s, 42) for _, s in zip(range(m), shingles)), "<u8", m)
        ones += np.unpackbits(h.view("u1").reshape(m, 8), axis=1, bitorder="little").sum(0, dtype="i8")
        left -= m
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, h and g (two hashes of the text), fp (the 64 bits as a signed long) of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            own = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(np.array(own, "u8").view("i8"))], ["doc_id", "h", "g", "fp"])

    key = row_key(F.col("doc_id"), F.col("text"))
    return texts_of(docs).select("doc_id", "text", key["h"].alias("h"), key["g"].alias("g")).mapInArrow(run, "doc_id long, h long, g long, fp long")


def bit_counts(distinct: DataFrame) -> np.ndarray:
    """64 x 64: how many of all distinct fingerprints have both bits; 64 rows a task reach the exchange."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((BITS, BITS))
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().astype("<i8").view("u1").reshape(-1, 8), axis=1, bitorder="little").astype("f4")
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), pa.array(total.astype("i8").tolist(), pa.list_(pa.int64()))], ["i", "row"])

    rows = distinct.select("fp").mapInArrow(run, "i int, row array<long>").groupBy("i").agg(*[F.sum(F.element_at("row", j + 1)).alias(f"c{j}") for j in range(BITS)])
    out = np.zeros((BITS, BITS))
    for r in rows.collect():  # 64 rows
        out[r["i"]] = [r[f"c{j}"] for j in range(BITS)]
    return out


def partition(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of bits, as even as can be: each starts with the bit that tells least and takes the bits that go with it most."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tied = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    rest, out = set(range(BITS)), []
    for g in range(m):
        size = -(-len(rest) // (m - g))
        own = [min(rest, key=lambda i: (spread[i], i))]
        rest.discard(own[0])
        while len(own) < size:
            i = max(rest, key=lambda i: (tied[i, own].sum(), -i))
            own.append(i)
            rest.discard(i)
        out.append(sorted(own))
    return out


def ball(width: int, radius: int) -> int:
    total, now = 0, 1
    for k in range(radius + 1):
        total += now
        now = now * (width - k) // (k + 1)
    return total


def thresholds(both: np.ndarray, n: int, radius: int = RADIUS, most: int = 6) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed: least expected cost over numbers of parts and all threshold vectors that the principle allows."""
    p = np.diag(both) / max(1, n)
    best, chosen = None, []
    for m in range(1, min(most, radius + 4) + 1):
        parts = partition(both, n, m)
        cost = []
        for bits in parts:
            far = np.zeros(radius + 1)  # chance that two fingerprints differ at k bits of the part
            far[0] = 1.0
            for b in bits:
                q = 2 * p[b] * (1 - p[b])
                far = far * (1 - q) + np.concatenate([[0], far[:-1]]) * q
            cost.append([0.0] + [n * ball(len(bits), t) + n * n / 2 * far[: t + 1].sum() for t in range(radius + 1)])
        # least[s]: cost and thresholds of the parts so far whose thresholds + 1 sum to s
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in cost:
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (x, ts) in least.items():
                for t in range(-1, radius + 1):
                    if s + t + 1 <= radius + 1 and (s + t + 1 not in new or x + c[t + 1] < new[s + t + 1][0]):
                        new[s + t + 1] = (x + c[t + 1], [*ts, t])
            least = new
        total, ts = least[radius + 1]
        if best is None or total < best:
            best, chosen = total, [(bits, t) for bits, t in zip(parts, ts) if t >= 0]
    return chosen


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@lru_cache
def half_ball(radius: int) -> tuple[tuple[int, int], ...]:
    """(wild bit or -1, bits to flip): two fingerprints give an equal value under one wild bit if, and only if, they are within radius."""
    flips = [0] + [sum(1 << b for b in c) for k in range(1, radius // 2 + 1) for c in combinations(range(BITS), k)]
    wild = range(BITS) if radius % 2 else [-1]
    return tuple((w, signed(f)) for w in wild for f in flips if w < 0 or not f >> w & 1)


def links(distinct: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """distinct (fp) to links (a, b) whose components are those of all pairs within radius."""
    if not 0 <= radius <= 2:
        raise ValueError("radius is 0 to 2")
    spark = distinct.sparkSession
    if radius == 0:
        return spark.createDataFrame([], "a long, b long")
    n = distinct.count()
    plan = thresholds(bit_counts(distinct), n, radius)
    held, asked = [], []
    for p, (bits, t) in enumerate(plan):
        mask = signed(sum(1 << b for b in bits))
        key = F.col("fp").bitwiseAND(F.lit(mask))
        held.append(F.struct(F.lit(p).alias("p"), key.alias("key")))
        for k in range(t + 1):
            asked += [F.struct(F.lit(p).alias("p"), key.bitwiseXOR(F.lit(signed(sum(1 << b for b in c)))).alias("key")) for c in combinations(bits, k)]
    index = distinct.select("fp", F.explode(F.array(*held)).alias("x")).select("x.*", "fp")
    probes = distinct.select("fp", F.explode(F.array(*asked)).alias("x")).select("x.*", F.col("fp").alias("own")) if len(asked) > len(held) else index.withColumnRenamed("fp", "own")
    full = index.groupBy("p", "key").agg(F.count("*").alias("n"), F.lit(True).alias("full")).filter(F.col("n") > crowd).drop("n")
    full = stored(full, "crowds")
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("own")))
    if full.isEmpty():
        return index.join(probes, ["p", "key"]).filter((F.col("fp") < F.col("own")) & (far <= radius)).select(F.col("own").alias("a"), F.col("fp").alias("b")).distinct()
    calm = index.join(full, ["p", "key"], "left_anti")
    paired = calm.join(probes, ["p", "key"]).filter((F.col("fp") < F.col("own")) & (far <= radius)).select(F.col("own").alias("a"), F.col("fp").alias("b"))
    hot = index.join(full, ["p", "key"], "left_semi").select("fp").unionByName(probes.join(full, ["p", "key"], "left_semi").select(F.col("own").alias("fp"))).distinct()
    masks = [F.struct(F.lit(w).alias("wild"), (F.col("fp").bitwiseXOR(F.lit(f)) if w < 0 else F.col("fp").bitwiseXOR(F.lit(f)).bitwiseAND(F.lit(signed(~(1 << w) & (1 << 64) - 1)))).alias("at")) for w, f in half_ball(radius)]
    met = hot.select("fp", F.explode(F.array(*masks)).alias("x")).select("x.*", "fp")
    # A value meets at most the 65 fingerprints of the ball around it.
    low = met.groupBy("wild", "at").agg(F.min("fp").alias("low"), F.count("*").alias("n")).filter("n > 1").drop("n")
    starred = met.join(low, ["wild", "at"]).filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return paired.unionByName(starred).distinct()


def labelled(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """doc_id, h, g, fp and component (its number), component_id, first (the row that stands for it) of every row."""
    prints = stored(fingerprints(docs, shingle), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "h", "g")
    distinct = stored(prints.groupBy("fp").agg(F.min(order).alias("low"), F.count("*").alias("n")), "distinct")
    found = components(links(distinct.select("fp"), radius, crowd))
    own = stored(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "low", "n", F.coalesce("component", "fp").alias("component")), "labelled")
    least = own.groupBy("component").agg(F.min("low").alias("first"), F.count("*").alias("prints"))
    ids = hot_join(own, stored(least, "components"), ["component"], "prints", own.count()).select("fp", "n", "component", "first")
    return hot_join(prints, stored(ids, "ids"), ["fp"], "n", prints.count()).withColumn("component_id", F.col("first.doc_id"))


def clusters(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the smallest doc_id that links reach).

    Texts without words, null ones too, have fingerprint 0 and link like any other. A null doc_id is never a component_id unless the
    whole component has no other. Repeated rows share their component. Other columns play no part; an empty frame gives no rows.
    """
    return labelled(docs, radius, shingle, crowd).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """The rows of docs, all their columns, of one document of each component: that with the smallest doc_id (null last), of several under that id the one whose text has the least hash, of rows equal in both any one. Columns may have any names."""
    own = labelled(docs, radius, shingle, crowd)
    key = F.struct(F.col("doc_id").isNull().alias("bare"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "h", "g").alias("key")
    own = own.select(key, (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h")) & (F.col("g") == F.col("first.g"))).alias("stays"))
    own = stored(own.groupBy("key", "stays").agg(F.count("*").alias("rows")).filter("not stays or rows > 1"), "dropped")
    rows = packed_rows(docs, row_key(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    rows = rows.join(own.filter("not stays").select("key"), "key", "left_anti")
    return unpacked(one_of_equal(rows, "key", own.filter("stays").select("key")), docs)
