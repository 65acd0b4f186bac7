"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations alone.

Each row becomes a digest entry; a hash deals the entries to 2^k runs. In every round the runs whose
numbers differ in the lowest bit meet: their entries are merged and of each digest the row that stays
and the group's size are retained, until one run is left. Entries agree only if SHA-256, an unrelated 64-bit
hash and the normalised length all do: every level verifies what it merges. Copies shrink to one entry
a run and task before each exchange, and the way back to the rows broadcasts the few texts that many rows share.

What Spark makes of the tree: a run is a logical part of a hash-dealt table, not a file, and a round is one sort aggregate, which
sorts its part by digest. So a round moves all digests that are left (64 bytes each and less), not just one partner's run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, packed_rows, stored, texts_of, unpacked

BLANK = r"[\x20\x09-\x0D]+"
RUNS = 8
KEY = ["text_sha256", "check", "size"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BLANK, "")


def key_of(text: Column) -> list[Column]:
    n = normalised(text)
    return [F.sha2(n, 256).alias("text_sha256"), F.xxhash64(n).alias("check"), F.length(n).alias("size")]


def keepers(entries: DataFrame, runs: int = RUNS) -> DataFrame:
    """entries (doc_id, key, n) to one row a digest: key, best (of the row that stays), group_size."""
    if runs < 1 or runs & (runs - 1):
        raise ValueError("runs is a power of two")
    best = F.struct((-F.col("n")).alias("fewer"), F.col("doc_id").isNull().alias("bare"), "doc_id")
    level = entries.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs))).groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
    while runs > 1:
        runs //= 2
        level = level.withColumn("run", F.shiftright("run", 1)).groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
    return level.drop("run")


def decided(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """doc_id, key, n (code points as written), best and group_size of every row."""
    text = F.col("text")
    entries = stored(texts_of(docs).select("doc_id", *key_of(text), F.length(text).alias("n")), "digests")
    found = stored(keepers(entries, runs), "keepers")
    return hot_join(entries, found, KEY, "group_size", entries.count())


def stays() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n") == -F.col("best.fewer"))


def groups(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the text without blanks).

    Of equal texts the one with the most code points as written stays, then the smallest doc_id (null last). Null texts
    count as empty, and empty texts equal each other. Rows repeated under one doc_id are counted each; all
    of them show kept, and `deduplicated` leaves one. Other columns play no part; an empty frame gives no rows.
    """
    return decided(docs, runs).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", stays().alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all their columns, whatever these are called. Of rows that share doc_id and length the one with the least text stays; of rows equal in that as well, any one."""
    key = F.struct(F.col("doc_id").isNull().alias("bare"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), *KEY, "n")
    left = stored(decided(docs, runs).filter(stays()).groupBy(key.alias("key")).agg(F.count("*").alias("rows")), "left")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    own = F.struct(doc_id.isNull().alias("bare"), F.coalesce(doc_id, F.lit(0)).alias("doc_id"), *key_of(text), F.length(text).alias("n"))
    rows = packed_rows(docs, own.alias("key"))
    again = left.filter("rows > 1").select("key")
    out = rows.join(left.filter("rows = 1").select("key"), "key", "left_semi")
    if not again.isEmpty():
        ties = stored(rows.join(again, "key", "left_semi").withColumn("uid", F.monotonically_increasing_id()), "ties")
        least = ties.groupBy("key").agg(F.min(F.struct(F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"), "uid"))["uid"].alias("uid")).select("uid")
        out = out.unionByName(ties.join(least, "uid", "left_semi").drop("uid"))
    return unpacked(out, docs)
