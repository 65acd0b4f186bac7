"""Trace views over the driver's tables, the same in Spark and DuckDB SQL: one text serves both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import configure

CONV = """
SELECT CAST(conv_id AS STRING) AS run_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS stage_index,
       concat('turn-', CAST(turn AS STRING)) AS id, role AS label, text,
       max(CASE WHEN role = 'system' THEN text END) OVER (PARTITION BY conv_id) AS guardrail
FROM conversations"""

DOC = """
SELECT CAST(run AS STRING) AS run_id, CAST(stage AS INT) AS stage_index, concat('doc-', CAST(doc_id AS STRING)) AS id, source AS label, text, CAST(NULL AS STRING) AS guardrail
FROM (SELECT concat(source, '/', lang, '/', CAST(CAST(floor((rn - 1) / 2) AS INT) AS STRING)) AS run, (rn - 1) % 2 AS stage, doc_id, source, text
      FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents) d1) d2"""

#: Notes composed from order lines: hedges, quantities, currencies, dates, scope, actions and an instruction turn up in a fixed cycle.
ORDER = """
SELECT CAST(l_orderkey AS STRING) AS run_id, CAST(rn - 1 AS INT) AS stage_index, concat('line ', CAST(rn AS STRING), '/', CAST(l_linenumber AS STRING)) AS id,
  CASE (rn - 1) % 3 WHEN 0 THEN 'Planner' WHEN 1 THEN 'Writer' ELSE 'Sender' END AS label,
  concat(
    CASE (l_partkey + rn) % 6 WHEN 0 THEN 'The order may ship' WHEN 1 THEN 'The order will ship' WHEN 2 THEN 'Shipping is confirmed' WHEN 3 THEN 'It is not confirmed that we ship'
      WHEN 4 THEN 'Carrier data suggests shipping' ELSE 'We expect to ship' END,
    CASE (l_suppkey + rn) % 5 WHEN 0 THEN ' some boxes' WHEN 1 THEN ' all boxes' WHEN 2 THEN ' most boxes' WHEN 3 THEN ' several boxes' ELSE ' boxes' END,
    ' in ', CAST(CAST(l_quantity AS INT) % 9 + 2 AS STRING), CASE l_partkey % 4 WHEN 0 THEN ' days' WHEN 1 THEN ' hours' WHEN 2 THEN ' weeks' ELSE ' days' END,
    CASE l_suppkey % 4 WHEN 0 THEN concat(' for $', CAST(l_partkey % 40 + 1 AS STRING), 'k') WHEN 1 THEN concat(' for $', CAST((l_partkey % 40 + 1) * 1000 AS STRING)) WHEN 2 THEN concat(' at ', CAST(l_partkey % 30 + 1 AS STRING), ' percent') ELSE '' END,
    CASE (l_partkey + l_suppkey) % 5 WHEN 0 THEN '. We do not send invoices' WHEN 1 THEN '. Invoices were sent' WHEN 2 THEN '. Legal has not yet approved; the note was published' WHEN 3 THEN '. Human approval applies to external orders' ELSE '' END, '.') AS text,
  CASE l_orderkey % 3 WHEN 0 THEN 'Do not contact external customers without human approval.' WHEN 1 THEN 'Keep boxes dry.' ELSE NULL END AS guardrail
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn FROM lineitem) li"""

#: Each user's events in blocks of 25 stages.
EVENT = """
SELECT concat(CAST(user_id AS STRING), '.', CAST(CAST(floor((rn - 1) / 25) AS INT) AS STRING)) AS run_id, CAST((rn - 1) % 25 AS INT) AS stage_index, CAST(event_id AS STRING) AS id,
       event_type AS label, concat(event_type, ' of ', CAST(CAST(floor(abs(value)) AS INT) % 50 AS STRING), ' users') AS text, CAST(NULL AS STRING) AS guardrail
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) e"""

#: Nodes of branch-and-merge graphs: node n hangs on n - 1 and on half of n; node 0 is the root.
NODE = f"""
SELECT run_id, stage_index AS node_pos, CAST(stage_index AS STRING) AS id, label, text, guardrail,
  CASE WHEN stage_index = 0 THEN array() WHEN stage_index = 1 THEN array('0') WHEN CAST(floor(stage_index / 2) AS INT) = stage_index - 1 THEN array(CAST(stage_index - 1 AS STRING))
    ELSE array(CAST(stage_index - 1 AS STRING), CAST(CAST(floor(stage_index / 2) AS INT) AS STRING)) END AS parent_ids
FROM ({ORDER}) o"""

VIEWS = {"conv": CONV, "doc": DOC, "order": ORDER, "event": EVENT, "node": NODE}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    configure(spark)
    for t in TABLES:
        if f"FROM {t})" in sql or f"FROM {t} " in sql or sql.endswith(f"FROM {t}"):
            sql = sql.replace(f"FROM {t}", "FROM {" + t + "}")
            frame = {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet")}
            break
    return spark.sql(sql, **frame)


def duck(name: str) -> str:
    return VIEWS[name].replace("AS STRING", "AS VARCHAR").replace("array()", "CAST([] AS VARCHAR[])").replace("array('0')", "['0']").replace("array(CAST(stage_index - 1 AS VARCHAR))", "[CAST(stage_index - 1 AS VARCHAR)]").replace("array(CAST(stage_index - 1 AS VARCHAR), CAST(CAST(floor(stage_index / 2) AS INT) AS VARCHAR))", "[CAST(stage_index - 1 AS VARCHAR), CAST(CAST(floor(stage_index / 2) AS INT) AS VARCHAR)]")
