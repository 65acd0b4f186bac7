"""Line dedup within one edit by a deletion-neighbourhood join, in DataFrame operations alone.

A line is the trimmed text between new lines. It is dropped if an earlier line (by doc_id, then line
number) equals it or, for lines of at least `least` code points, is one insertion, deletion or substitution away.

1. The texts are split once. Equal lines: a group minimum over two 64-bit hashes and the length gives each
   distinct line's first place; the hashes of its halves come along.
2. Two lines within one edit agree outside one of B blocks, if the blocks are laid out for the longer length
   and what lies behind is counted from the end. Distinct lines of which no other has a half are out, and only the others'
   texts are read again.
3. With 16 blocks, a line keeps the blocks outside of which another line agrees. These blocks are split in turn until
   they have at most LEAF characters, so a line costs in proportion to its length.
4. In the blocks left, each line emits every deletion variant as a hashed key. Lines of one length that give the
   same variant at the same place are a substitution apart; a line that equals a longer line's variant, an insertion. So a
   group needs only its earliest line, whatever its size: no pairs are made within a group.
5. Each later line is verified against that earliest one: both whole lines, without the character at the place of the
   variant, are compared, which takes time in proportion to their length.

Group minima combine before their exchange; joins on a frequent key are left to adaptive skew splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed_rows, row_key, stored, texts_of, unpacked

LEAST, BLOCKS, LEAF = 16, 16, 32
BLANKS = " \t\n\x0b\x0c\r"
LINE = ["id", "check"]


def line_of(raw: Column) -> Column:
    return F.trim(raw, F.lit(BLANKS))


def keyed_texts(docs: DataFrame) -> DataFrame:
    return texts_of(docs).select(row_key(F.col("doc_id"), F.col("text")).alias("doc"), "text")


def halves(line: Column, n: Column) -> list[Column]:
    """Hashes of what two blocks laid out for n and for n + 1 leave outside: three, as the fourth is one of them. A part's length tells n to within one."""
    half = F.shiftright(n, 1)
    front, back = (lambda size: F.xxhash64(F.lit(0), F.substring(line, F.lit(1), size))), (lambda start: F.xxhash64(F.lit(1), F.substring(line, start, n)))
    return [front(half).alias("front"), back(half + 1).alias("back"), F.when(n % 2 == 1, front(half + 1)).otherwise(back(half)).alias("other")]


def distinct_lines(texts: DataFrame) -> DataFrame:
    """id, check, n, place (of the first) and half keys of every distinct line."""
    rows = texts.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("no", "raw")).select("doc", "no", line_of(F.col("raw")).alias("line")).filter("line <> ''")
    n = F.length("line")
    rows = rows.select(F.xxhash64("line").alias("id"), F.xxhash64(F.lit(7), "line").alias("check"), n.alias("n"), F.struct("doc", "no").alias("place"), *halves(F.col("line"), n))
    return rows.groupBy(*LINE, "n").agg(F.min("place").alias("place"), *[F.min(c).alias(c) for c in ("front", "back", "other")])


def shared(rows: DataFrame) -> DataFrame:
    """Of rows (key, id, check, ...) those whose key another line has."""
    more = rows.groupBy("key").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in LINE for f in (F.min, F.max)])
    return rows.join(more.filter("min_id < max_id or min_check < max_check").select("key"), "key", "left_semi")


def narrowed(rows: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Rows (id, check, place, longer, at, key, inner) to one row a block of inner: key takes in what lies outside the block, at counts what lies before it in the line."""
    inner, n = F.col("inner"), F.length("inner")
    cut = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("m", n + F.col("longer"))
    edge = lambda b: F.floor(b * F.col("m").cast("long") / blocks).cast("int")
    cut = cut.withColumn("before", edge(F.col("b"))).withColumn("behind", F.col("m") - edge(F.col("b") + 1))
    key = F.xxhash64("key", "b", F.substring(inner, F.lit(1), F.col("before")), F.substring(inner, n - F.col("behind") + 1, F.col("behind")))
    return cut.select(*LINE, "place", "longer", (F.col("at") + F.col("before")).alias("at"), key.alias("key"), F.substring(inner, F.col("before") + 1, n - F.col("behind") - F.col("before")).alias("inner"))


def leaves(texts: DataFrame) -> DataFrame:
    """texts (id, check, place, line) to rows (id, check, place, longer, at, key, inner) of short blocks outside of which other lines may agree. longer: laid out for one character more."""
    rows = texts.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.select(*LINE, "place", "longer", F.lit(0).alias("at"), F.xxhash64(F.length("line") + F.col("longer")).alias("key"), F.col("line").alias("inner"))
    size = F.length("inner") + F.col("longer")
    out, top = rows.filter(size <= LEAF), rows.agg(F.max(size)).first()[0] or 0
    while top > LEAF:
        rows = stored(shared(narrowed(rows.filter(size > LEAF))), "blocks")
        out, top = out.unionByName(rows.filter(size <= LEAF)), rows.agg(F.max(size)).first()[0] or 0
    return out


def without(line: Column, at: Column) -> Column:
    """The line without its character at `at`, which counts from 1; 0 takes none."""
    return F.when(at > 0, F.concat(F.substring(line, F.lit(1), at - 1), F.substring(line, at + 1, F.length(line)))).otherwise(line)


def near(texts: DataFrame) -> DataFrame:
    """texts (id, check, place, line) of distinct lines to the (id, check) that have an earlier line within one edit."""
    rows, i = leaves(texts), F.col("i")
    gone = rows.filter("longer = 0 and inner <> ''").withColumn("i", F.explode(F.sequence(F.lit(1), F.length("inner"))))
    gone = gone.select(*LINE, "place", "key", "i", (F.col("at") + i).alias("cut"), F.xxhash64(without(F.col("inner"), i)).alias("v"))
    first = F.struct("place", *LINE, "cut")
    other = [F.col(f"low.{c}").alias(f"other_{c}") for c in (*LINE, "cut")]
    swapped = gone.select(*LINE, "place", "cut", F.xxhash64("key", "v", "i").alias("k"))
    low = swapped.groupBy("k").agg(F.min(first).alias("low"), F.count("*").alias("n")).filter("n > 1").drop("n")
    pairs = swapped.join(low, "k").filter(F.col("place") > F.col("low.place")).select(*LINE, "cut", *other)
    whole = rows.filter("longer = 1").select(*LINE, "place", F.xxhash64("key", F.xxhash64("inner")).alias("k"), F.lit(1).alias("self"), F.lit(0).alias("cut"))
    both = whole.unionByName(gone.groupBy(*LINE, "place", F.xxhash64("key", "v").alias("k")).agg(F.min("cut").alias("cut")).withColumn("self", F.lit(0)))
    least = lambda s: F.min(F.when(F.col("self") == s, first))
    ends = both.groupBy("k").agg(least(1).alias("short"), least(0).alias("long")).filter("short is not null and long is not null")
    met = both.join(ends, "k").withColumn("low", F.when(F.col("self") == 1, F.col("long")).otherwise(F.col("short")))
    pairs = pairs.unionByName(met.filter(F.col("place") > F.col("low.place")).select(*LINE, "cut", *other)).distinct()
    a, b = texts.select(*LINE, F.col("line").alias("a")), texts.select(*[F.col(c).alias(f"other_{c}") for c in LINE], F.col("line").alias("b"))
    verified = pairs.join(a, LINE).join(b, [f"other_{c}" for c in LINE])
    return verified.filter(without(F.col("a"), F.col("cut")) == without(F.col("b"), F.col("other_cut"))).select(*LINE).distinct()


def decisions(docs: DataFrame, least: int = LEAST, fuzzy: bool = True) -> DataFrame:
    """doc (see common.row_key) and kept: the numbers (from 0) of its lines that stay, blank lines left out; docs without any have no row."""
    texts = keyed_texts(docs)
    kept = lines = stored(distinct_lines(texts), "lines")
    if fuzzy:
        half = lines.filter(F.col("n") >= least).select(F.explode(F.array("front", "back", "other")).alias("key"), *LINE)
        likely = lines.join(shared(half).select(*LINE).distinct(), LINE, "left_semi")
        by_doc = likely.groupBy("place.doc").agg(F.collect_list(F.struct("place.no", *LINE)).alias("wanted"))
        own = texts.join(by_doc, "doc").select("doc", F.split("text", "\n", -1).alias("raw"), "wanted")
        cut = own.select("doc", "raw", F.explode("wanted").alias("w")).select(F.col("w.id").alias("id"), F.col("w.check").alias("check"), F.struct("doc", "w.no").alias("place"), line_of(F.get("raw", F.col("w.no"))).alias("line"))
        kept = lines.join(near(stored(cut.distinct(), "likely")), LINE, "left_anti")  # rows repeated under one doc_id give their lines once
    return kept.groupBy("place.doc").agg(F.array_sort(F.collect_list("place.no")).alias("kept"))


def report(docs: DataFrame, least: int = LEAST, fuzzy: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_lines (not blank), n_kept, kept_lines (their numbers, comma-joined).

    Null texts count as empty; blank lines are neither counted nor dropped. Rows with a null doc_id come behind all others. Every row is a
    document of its own: rows that share a doc_id (or have none) go by two hashes of their text, and of rows equal in both one keeps its lines and
    the others lose all. Other columns play no part; an empty frame gives no rows.
    """
    own = decisions(docs, least, fuzzy)
    # A match starts at a line's first character that is not blank and ends with the line.
    rows = keyed_texts(docs).select("doc", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D][^\n]*")).alias("n_lines"))
    rows = rows.groupBy("doc").agg(F.min("n_lines").alias("n_lines"), F.count("*").cast("int").alias("copies")).join(own, "doc", "left")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    kept = F.when(F.col("copy") == 1, F.col("kept"))
    return rows.select(F.when(~F.col("doc.bare"), F.col("doc.doc_id")).alias("doc_id"), "n_lines", F.coalesce(F.size(kept), F.lit(0)).alias("n_kept"), F.coalesce(F.array_join(kept.cast("array<string>"), ","), F.lit("")).alias("kept_lines"))


def deduplicated(docs: DataFrame, least: int = LEAST, fuzzy: bool = True) -> DataFrame:
    """docs with dropped lines taken out of text, blank lines and the others as they were; null texts stay null. Rows are told apart as in `report`; columns may have any names."""
    own = decisions(docs, least, fuzzy)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = packed_rows(docs, row_key(F.col("doc_id").cast("long"), text).alias("doc"))
    again = rows.groupBy("doc").count().filter("count > 1").select("doc")
    if again.isEmpty():
        joined = rows.join(own, "doc", "left").withColumn("first", F.lit(True))
    else:  # of equal rows the first as stored keeps its lines
        rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
        firsts = rows.groupBy("doc").agg(F.min("uid").alias("low"))
        joined = rows.join(firsts, "doc").join(own, "doc", "left").withColumn("first", F.col("uid") == F.col("low"))
    raw = F.split("row.text", "\n", -1)
    blank = F.filter(F.transform(raw, lambda x, i: F.when(line_of(x) == "", i)), lambda i: i.isNotNull())
    kept = F.when(F.col("first"), F.coalesce("kept", F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>"))
    lines = joined.withColumn("raw", raw).withColumn("stay", F.array_sort(F.concat(kept, blank)))
    new = F.array_join(F.transform("stay", lambda i: F.get("raw", i)), "\n")
    return unpacked(lines, docs, text=F.when(F.col("row.text").isNotNull(), new))
