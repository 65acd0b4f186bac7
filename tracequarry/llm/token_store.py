"""Token-id shards with keyed access by a minimal perfect hash.

Documents are range-partitioned and sorted by doc_id, then by two hashes of the text, so shard after shard holds them in ascending
order; an id that many rows share may go on over several shards. Each task writes one payload file of raw ids (unsigned 16-bit where the vocabulary allows,
else 32-bit, little-endian) and one index file. The index is a minimal perfect hash from document
keys to slots: levels of bit arrays in which a key's bit is set if no other key meets it there, the
slot being the bit's rank. A slot holds a fingerprint of the key and where its records are, so a
lookup is a few hashes, one comparison and one read, whatever the shard's size.
Files are written under a name of their own and moved when whole. As ties are ordered, a task that runs again or twice
leaves the same bytes. They go through pyarrow's file systems, so the folder can be in any store that these reach.
"""

from __future__ import annotations

import io
import uuid
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_bpe
from .common import scratch_path, small_batches, texts_of

MAGIC = b"TQIDX002"
SHARDS = "shard long, records long, ids long, unkeyed long, low long, high long"
#: Stretches of a shard's keys that are read by a task each, and bytes that one read asks for.
BLOCKS, READ = 8, 8 << 20
SALT = 0x9E3779B97F4A7C15


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """splitmix64 of unsigned 64-bit keys."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64((salt * SALT + SALT) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct unsigned 64-bit keys onto 0..n-1."""

    GAMMA = 1.5

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # of packed bits
        self.ranks, total = [], 0
        for bits in levels:
            ones = np.unpackbits(bits)
            self.ranks.append(total + np.concatenate([[0], np.cumsum(ones)]).astype("i8"))
            total = int(self.ranks[-1][-1])
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys.astype("u8")
        while len(rest):
            m = -(-max(8, int(cls.GAMMA * len(rest))) // 8) * 8
            at = (mixed(rest, len(levels)) % np.uint64(m)).astype("i8")
            alone = np.bincount(at, minlength=m) == 1
            levels.append(np.packbits(alone))
            rest = rest[~alone[at]]
            if len(levels) > 500:
                raise ValueError("keys repeat")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some keys that were not built in (others meet a slot whose fingerprint differs)."""
        keys = keys.astype("u8")
        out, rest = np.full(len(keys), -1, "i8"), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (mixed(keys[rest], k) % np.uint64(8 * len(bits))).astype("i8")
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype("u1")) & 1 == 1
            out[rest[hit]] = self.ranks[k][at[hit]]
            rest = rest[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.astype("u8"), 0xF1) >> np.uint64(32)).astype("<u4")


class Index:
    """Of one shard: keys to records, records to offsets. Records without a key (null doc_id) come first."""

    def __init__(self, width: int, unkeyed: int, hashed: PerfectHash, prints: np.ndarray, first: np.ndarray, repeats: np.ndarray, offsets: np.ndarray):
        self.width, self.unkeyed, self.hashed, self.prints, self.first, self.repeats, self.offsets = width, unkeyed, hashed, prints, first, repeats, offsets

    @classmethod
    def build(cls, keys: np.ndarray, unkeyed: int, offsets: np.ndarray, width: int) -> Index:
        """keys: of the keyed records, ascending; repeats lie side by side."""
        own, first, repeats = np.unique(keys, return_index=True, return_counts=True)
        hashed = PerfectHash.build(own.astype("u8"))
        slot = hashed.slots(own)
        tables = [np.zeros(len(own), x) for x in ("<u4", "<u4", "<u4")]
        for t, x in zip(tables, (fingerprints(own), first + unkeyed, repeats)):
            t[slot] = x
        return cls(width, unkeyed, hashed, *tables, offsets.astype("<u8"))

    def records(self, keys: np.ndarray) -> list[range]:
        """The records of each key, none for a key that the shard lacks (up to a fingerprint's chance of 2^-32)."""
        slot = self.hashed.slots(keys)
        right = slot >= 0
        right[right] = self.prints[slot[right]] == fingerprints(keys)[right]
        return [range(int(self.first[s]), int(self.first[s] + self.repeats[s])) if ok else range(0) for s, ok in zip(slot, right)]

    def dump(self) -> bytes:
        out = io.BytesIO()
        out.write(MAGIC)
        out.write(np.array([self.width, self.unkeyed, len(self.hashed.levels), len(self.prints), len(self.offsets)], "<u4").tobytes())
        out.write(np.array([len(x) for x in self.hashed.levels], "<u4").tobytes())
        for x in (*self.hashed.levels, self.prints, self.first, self.repeats, self.offsets):
            out.write(x.tobytes())
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Index:
        if raw[:8] != MAGIC:
            raise ValueError("not a token index")
        width, unkeyed, n_levels, n, m = np.frombuffer(raw, "<u4", 5, 8).tolist()
        at = 28
        sizes = np.frombuffer(raw, "<u4", n_levels, at).tolist()
        at += 4 * n_levels
        levels = []
        for x in sizes:
            levels.append(np.frombuffer(raw, "u1", x, at))
            at += x
        tables = []
        for _ in range(3):
            tables.append(np.frombuffer(raw, "<u4", n, at))
            at += 4 * n
        return cls(width, unkeyed, PerfectHash(levels), *tables, np.frombuffer(raw, "<u8", m, at))


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, name: str, write) -> None:
    """Write a file under a name of its own, then move it into place."""
    store, root = file_system(uri)
    store.create_dir(root, recursive=True)
    own = f"{root}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        write(f)
    store.move(own, f"{root}/{name}")


class Shard:
    """Constant-time access to one shard's documents."""

    def __init__(self, uri: str, shard: int):
        store, root = file_system(uri)
        with store.open_input_file(f"{root}/{shard:06d}.idx") as f:
            self.index = Index.load(f.read())
        self.payload = store.open_input_file(f"{root}/{shard:06d}.ids")

    def record(self, r: int) -> np.ndarray:
        a, b = map(int, self.index.offsets[r : r + 2])
        w = self.index.width
        return np.frombuffer(self.payload.read_at((b - a) * w, a * w), f"<u{w}").astype("<u4")

    def each(self, records: list[int], most: int = READ):
        """The ids of each of these records, which ascend; neighbours come by one read of up to `most` bytes."""
        i, w = 0, self.index.width
        while i < len(records):
            a, j = int(self.index.offsets[records[i]]), i + 1
            while j < len(records) and records[j] == records[j - 1] + 1 and (int(self.index.offsets[records[j] + 1]) - a) * w <= most:
                j += 1
            b = int(self.index.offsets[records[j - 1] + 1])
            part = np.frombuffer(self.payload.read_at((b - a) * w, a * w), f"<u{w}")
            for r in records[i:j]:
                yield part[int(self.index.offsets[r]) - a : int(self.index.offsets[r + 1]) - a].astype("<u4")
            i = j

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document with this key."""
        return [self.record(r) for r in self.index.records(np.array([key], "i8"))[0]]

    def close(self) -> None:
        self.payload.close()


def write(docs: DataFrame, uri: str, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write every text's ids and end_id to shards below uri, in ascending doc_id order; returns the manifest, one row a shard with its global start.

    The number of shards, not of documents, bounds what the driver sees. Null texts count as empty; rows
    with a null doc_id come first and have no key; repeated doc_ids are records side by side under one key, in the order of two hashes of their texts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer_path or word_bpe.default_path()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        known = word_bpe.pieces(path)
        width = 2 if known.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else 4
        keys, ends, unkeyed = array("q"), array("Q", [0]), 0

        def payload(f) -> None:
            nonlocal unkeyed
            for b in batches:
                for key, text in zip(b.column(0), b.column(1)):
                    ids = np.frombuffer(known.encode(text.as_py()), "<u4")
                    f.write(np.append(ids, np.uint32(end_id)).astype(f"<u{width}").tobytes())
                    ends.append(ends[-1] + len(ids) + 1)
                    if key.is_valid:
                        keys.append(key.as_py())
                    else:
                        unkeyed += 1

        put(uri, f"{shard:06d}.ids", payload)
        if len(ends) > 1:
            index = Index.build(np.frombuffer(keys, "i8"), unkeyed, np.frombuffer(ends, "u8"), width)
            put(uri, f"{shard:06d}.idx", lambda f: f.write(index.dump()))
            row = [shard, len(ends) - 1, ends[-1], unkeyed, keys[0] if keys else None, keys[-1] if keys else None]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], ["shard", "records", "ids", "unkeyed", "low", "high"])

    ties = ["doc_id", "h", "g"]
    ordered = texts_of(docs).select("doc_id", "text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(7), "text").alias("g")).repartitionByRange(*ties).sortWithinPartitions(*ties).select("doc_id", "text")
    start, rows = 0, []
    for r in sorted(ordered.mapInArrow(run, SHARDS).collect()):
        rows.append((*r, start))
        start += r["ids"]
    return spark.createDataFrame(rows, SHARDS + ", start long").coalesce(1)


def read(keys: DataFrame, manifest: DataFrame, uri: str, with_ids: bool = True) -> DataFrame:
    """Look up every doc_id of keys in the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids unless with_ids is False.

    A key that no shard holds gives no row; a null key gives the records without a key. Keys may repeat: each distinct one is read once.
    """
    spark = keys.sparkSession
    rows = manifest.orderBy("shard").collect()  # one row a shard
    bounds = [(r["shard"], r["low"], r["high"]) for r in rows if r["low"] is not None]
    bare = [(r["shard"], r["start"]) for r in rows if r["unkeyed"]]
    starts = {r["shard"]: r["start"] for r in rows}
    shards, lows, highs = (np.array([x[i] for x in bounds], "i8") for i in range(3))

    def route(batches):
        """Each key to every shard between whose least and greatest key it is, and there to one of BLOCKS equal stretches of keys."""
        import pyarrow as pa

        for b in batches:
            own = b.column(0).to_numpy()
            first, last = np.searchsorted(highs, own, "left"), np.searchsorted(lows, own, "right")
            n = np.maximum(last - first, 0)
            at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = np.repeat(own, n)
            block = (own.astype("f8") - lows[at]) / (highs[at].astype("f8") - lows[at] + 1) * BLOCKS if len(at) else own
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(shards[at]), pa.array(np.clip(block, 0, BLOCKS - 1).astype("i4"))], ["doc_id", "shard", "block"])

    def look(key, pdf):
        import pandas as pd

        shard, out = Shard(uri, int(key[0])), []
        try:
            own = pdf["doc_id"].to_numpy("i8", na_value=0)
            bare_only = pdf["bare"].any()
            found = [(None, range(shard.index.unkeyed))] if bare_only else list(zip(own.tolist(), shard.index.records(own)))
            wanted = [(doc, r) for doc, records in sorted(found, key=lambda x: x[1].start) for r in records]
            for (doc, r), ids in zip(wanted, shard.each([r for _, r in wanted])):
                out.append((doc, starts[int(key[0])] + int(shard.index.offsets[r]), len(ids), zlib.crc32(ids.tobytes()), *([ids.astype("i8")] if with_ids else [])))
        finally:
            shard.close()
        frame = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
        return frame.assign(doc_id=pd.array([x[0] for x in out], "Int64"))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct().mapInArrow(route, "doc_id long, shard long, block int").withColumn("bare", F.lit(False))
    if bare:
        asked = asked.unionByName(spark.createDataFrame([(None, s, 0, True) for s, _ in bare], "doc_id long, shard long, block int, bare boolean"))
    # A block of a shard's keys is a task's work, so a large shard is read by several tasks.
    return asked.groupBy("shard", "bare", "block").applyInPandas(look, schema)


def round_trip(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, uri: str | None = None) -> DataFrame:
    """Write docs to shards, then read every document back by its key: doc_id, start, n_tokens, ids_crc32 of every row.

    Null texts count as empty, so they hold the end id alone; rows without a doc_id and repeated rows have a record each (`write`). Other columns play no part; an empty frame gives no rows.
    """
    spark = docs.sparkSession
    uri = uri or scratch_path(spark, "ids")
    manifest = write(docs, uri, tokenizer_path, end_id)
    null_key = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return read(null_key, manifest, uri, with_ids=False)
