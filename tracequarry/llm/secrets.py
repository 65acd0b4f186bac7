"""Secret scans over an incremental blob ledger, in DataFrame operations alone.

Every version of every path is named by the SHA-256 of its text. Only blobs that the ledger does not
hold for a rule set's version are read and scanned, once each however many paths have them; the findings
join back to all paths. Matches' positions come from the lengths of the texts between them: a split and
an extract by the same pattern, exploded, and a running sum per blob and kind, so a text with
many matches costs in proportion.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import packed_rows, scratch_path, stored, texts_of, unpacked

MASK = "[secret]"


@dataclass(frozen=True)
class Rule:
    """kind, pattern, and the group whose length must reach least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of key letters is taken whole, so its least length can stand in the pattern.
RULES = (Rule("assign", ASSIGN, 2, 6), Rule("access", "AKIA[A-Z0-9]{16,}"), Rule("hex", "[0-9a-f]{24,}"))
VERSION = "base-1"
FINDINGS = "blob string, version string, rank int, kind string, start long, end long"
SEEN = "blob string, version string"


def part_of(rank: int, rule: Rule):
    """Of one match and the text before it: their lengths, and whether the match counts."""
    return lambda x, i: F.struct(F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), i.alias("i"), F.length(x["m"]).alias("size"), F.length(x["gap"]).alias("gap"), (F.length(x["g"]) >= rule.least).alias("good"))


class Ledger:
    """Two tables below a folder: seen (blob, version) and findings. A new folder is an empty ledger."""

    def __init__(self, spark: SparkSession, folder: str, rules: tuple[Rule, ...] = RULES, version: str = VERSION):
        self.spark, self.folder, self.rules, self.version = spark, folder.rstrip("/"), rules, version

    def read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.read.schema(schema).parquet(path).filter(F.col("version") == self.version)
        return self.spark.createDataFrame([], schema)

    def seen(self) -> DataFrame:
        return self.read("seen", SEEN)

    def findings(self) -> DataFrame:
        return self.read("findings", FINDINGS).distinct()

    def scan(self, docs: DataFrame) -> DataFrame:
        """Scan what is unseen of docs, note it, and return the paths: doc_id, blob of every row.

        Findings are written before their blobs count as seen, so a run that dies between scans them again.
        """
        texts = texts_of(docs).withColumn("blob", F.sha2("text", 256))
        paths = stored(texts.select("doc_id", "blob"), "paths")
        unseen = paths.groupBy("blob").agg(F.min("doc_id").alias("first")).join(self.seen().select("blob"), "blob", "left_anti")
        unseen = stored(unseen, "unseen")
        todo = texts.join(unseen, texts["doc_id"].eqNullSafe(unseen["first"]) & (texts["blob"] == unseen["blob"]), "left_semi")
        self.matches(todo).write.mode("append").parquet(f"{self.folder}/findings")
        unseen.select("blob", F.lit(self.version).alias("version")).write.mode("append").parquet(f"{self.folder}/seen")
        return paths

    def matches(self, todo: DataFrame) -> DataFrame:
        """blob, text to the rules' matches, leftmost and non-overlapping per rule, as code points, end exclusive."""
        parts = []
        for k, rule in enumerate(self.rules):
            p = F.lit(rule.pattern)
            zipped = F.arrays_zip(F.regexp_extract_all("text", p, F.lit(0)).alias("m"), F.regexp_extract_all("text", p, F.lit(rule.group)).alias("g"), F.split("text", rule.pattern, -1).alias("gap"))
            parts.append(F.when(F.col("text").rlike(rule.pattern), F.transform(zipped, part_of(k, rule))))
        one = [F.coalesce(x, F.array().cast("array<struct<rank:int,kind:string,i:int,size:int,gap:int,good:boolean>>")) for x in parts]
        rows = todo.select("blob", F.explode(F.concat(*one)).alias("x")).select("blob", "x.*")
        before = Window.partitionBy("blob", "rank").orderBy("i")
        ends = rows.distinct().withColumn("end", F.sum(F.col("gap").cast("long") + F.coalesce("size", F.lit(0))).over(before)).filter("good")
        return ends.select("blob", F.lit(self.version).alias("version"), "rank", "kind", (F.col("end") - F.col("size")).alias("start"), "end")

    def by_blob(self) -> DataFrame:
        """Each blob with findings: spans array of (start, rank, kind, end) in order."""
        return self.findings().groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"))


def scanned(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """One row per row of docs: doc_id, blob, spans (null where there is none). Null texts count as empty."""
    ledger = ledger or Ledger(docs.sparkSession, scratch_path(docs.sparkSession, "ledger"))
    return ledger.scan(docs).join(ledger.by_blob(), "blob", "left")


def report(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans as text; rows without a secret have zeros, an empty text and its digest."""
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))
    found = scanned(docs, ledger).withColumn("spans", spans)
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def redacted(docs: DataFrame, ledger: Ledger | None = None, mask: str = MASK) -> DataFrame:
    """docs with every finding replaced by a mask, overlapping ones by one; n_chars, where there is one, follows. Clean rows stay as they are; columns may have any names."""
    ledger = ledger or Ledger(docs.sparkSession, scratch_path(docs.sparkSession, "ledger"))
    ledger.scan(docs)
    text = F.col("row.text").cast("string")
    rows = packed_rows(docs, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("blob"))
    joined = rows.join(ledger.by_blob(), "blob", "left").withColumn("own", text)
    merged = F.expr(f"""
        aggregate(spans, named_struct('at', 0L, 'out', ''),
          (a, x) -> CASE WHEN x.start >= a.at
            THEN named_struct('at', x.end, 'out', concat(a.out, substring(own, int(a.at) + 1, int(x.start - a.at)), '{mask}'))
            ELSE named_struct('at', greatest(a.at, x.end), 'out', a.out) END,
          a -> concat(a.out, substring(own, int(a.at) + 1)))""")
    new = joined.withColumn("new", F.when(F.col("spans").isNull(), text).otherwise(merged))
    count = {"n_chars": F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("new"))} if "n_chars" in docs.columns else {}
    return unpacked(new, docs, text=F.col("new"), **count)
