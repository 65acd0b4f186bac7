"""Packing of token pieces into windows: best-fit decreasing over a segment tree of remaining capacities.

Texts become ids where they are read; only (document, start, length, checksum or ids) rows move. A
document longer than a window is first cut into full windows and a rest. All pieces are dealt by a
hash into groups of a few thousand, and each group is packed by itself: from the longest piece on,
each goes to the open window with the least room that still holds it, which the tree finds in
log2(window) steps. A group's last windows are its only loss, so padding does not grow with the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_bpe
from .common import small_batches, stored, texts_of

#: Pieces of one packing group, on average. A group is one task's work and is bounded by this, not by the corpus.
GROUP = 8192
END_ID = 1
WINDOW = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Room:
    """How many open windows have a given room; finds the least room that is enough."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def least(self, need: int) -> int:
        """The least room of at least need that an open window has; -1 if none."""
        i, tree = need + self.size, self.tree
        if tree[i]:
            return need
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) of each length; lengths come in descending order."""
    room, open_at, out, n = Room(window), {}, [], 0
    for length in lengths:
        left = room.least(length)
        if left < 0:
            w, left = n, window
            n += 1
        else:
            w = open_at[left].pop()
            room.add(left, -1)
        out.append((w, window - left))
        if rest := left - length:
            open_at.setdefault(rest, []).append(w)
            room.add(rest, 1)
    return out


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, window: int = WINDOW, ids: bool = False) -> DataFrame:
    """Pieces of at most a window: every id of every document, its end id last, lies in just one. Null texts count as empty: one piece that holds the end id."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        known = word_bpe.pieces(tokenizer_path)
        tail = np.array([end_id], "<u4").tobytes()
        for b in batches:
            doc, start, length, crc, total, raw = [], [], [], [], [], []
            for key, text in zip(b.column(0), b.column(1)):
                packed = known.encode(text.as_py()) + tail
                n, key = len(packed) // 4, key.as_py()
                for at in range(0, n, window):
                    part = packed[4 * at : 4 * (at + window)]
                    doc.append(key)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    if ids:
                        raw.append(part)
            columns = [pa.array(doc, pa.int64()), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * ids, names + ["ids"] * ids)

    return texts_of(docs).mapInArrow(run, PIECES + ", ids binary" * ids)


def pack(found: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, start, length, ...): each sequence's pieces follow each other without a gap from 0.

    Ties in length go by doc_id, then start. Repeated rows are pieces of their own. An empty frame gives none.
    Sequence ids are unique, not consecutive. ids, where pieces carry them, are little-endian unsigned 32-bit.
    """
    found = stored(found, "pieces")
    groups = max(1, -(-found.count() // group))

    def run(key, part):
        import pyarrow as pa
        import pyarrow.compute as pc

        by = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("doc_tokens", "ascending"), ("ids_crc32", "ascending")]
        part = part.drop_columns(["packing_group"])
        part = part.take(pc.sort_indices(part, sort_keys=[x for x in by if x[0] in part.column_names]))
        at = best_fit(part["length"].to_pylist(), window)
        part = part.append_column("sequence_id", pa.array([w * groups + key[0].as_py() for w, _ in at], pa.int64()))
        return part.append_column("offset", pa.array([o for _, o in at], pa.int64()))

    # The row's place in the stored table keeps repeated rows, or many without a doc_id, from meeting in one group.
    dealt = found.withColumn("packing_group", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("packing_group").applyInArrow(run, schema)


def padding(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """sequence_id, filled and padded tokens of packed pieces: a sequence is padded to the window unless its length is a power of two."""
    own = found.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    return own.withColumn("padded", F.when(F.bit_count("filled") == 1, F.lit(0).cast("long")).otherwise(window - F.col("filled")))


def packed(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID, window: int = WINDOW, group: int = GROUP, ids: bool = False) -> DataFrame:
    """Documents to packed pieces; ids=True keeps each piece's ids in the result.

    Null texts count as empty: one piece that holds the end id. Rows with a null doc_id and repeated rows are documents of their own. Other columns play
    no part; an empty frame gives no rows. A sequence is padded to the window, except where its length is a power of two (`padding`).
    """
    return pack(pieces(docs, tokenizer_path or word_bpe.default_path(), end_id, window, ids), window, group)
