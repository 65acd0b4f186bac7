"""Branch-and-merge graphs: validation, topological order, closure, edges and reports.

nodes: (run_id, node_pos, id, label, text, parent_ids array<string>, guardrail), and optionally inherited_claims map<string, string>: what a node says it took from a parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fingerprint import GRAPH, json_string, long_id, short_id
from ..functions.text import trimmed, uri_component, utf16_length
from ..session import stored
from .detect import LATER, SIDE, edge_issues, end_of, rank_of, sides
from .rollup import threshold_rank

LIMITS = {"bytes": 2_000_000, "stages": 50, "id": 128, "label": 200, "name": 200, "guardrail": 20_000, "text": 500_000, "total": 1_500_000}


def complete(nodes: DataFrame) -> DataFrame:
    """Trimmed ids and parents, and a claims column whether or not there is one."""
    if "inherited_claims" not in nodes.columns:
        nodes = nodes.withColumn("inherited_claims", F.lit(None).cast("map<string,string>"))
    return nodes.withColumn("id", trimmed(F.col("id"))).withColumn("parent_ids", F.transform("parent_ids", trimmed))


def links(nodes: DataFrame) -> DataFrame:
    """One row a parent link: run_id, node_pos, id, parent_pos, parent."""
    return complete(nodes).select("run_id", "node_pos", "id", F.posexplode("parent_ids").alias("parent_pos", "parent"))


def missing_parents(nodes: DataFrame) -> DataFrame:
    there = complete(nodes).select("run_id", F.col("id").alias("parent"))
    return links(nodes).join(there, ["run_id", "parent"], "left_anti").select("run_id", "id", "parent")


def orphan_claims(nodes: DataFrame) -> DataFrame:
    """Claims for what is no parent of the node."""
    own = complete(nodes).filter("inherited_claims is not null")
    return own.select("run_id", "id", F.explode(F.array_except(F.map_keys("inherited_claims"), "parent_ids")).alias("parent"))


def text_totals(nodes: DataFrame) -> DataFrame:
    """UTF-16 characters of a graph's texts and claims, without its guardrail."""
    claims = F.coalesce(F.aggregate(F.map_values("inherited_claims"), F.lit(0), lambda a, x: a + utf16_length(trimmed(x))), F.lit(0))
    return complete(nodes).groupBy("run_id").agg(F.sum(utf16_length(trimmed(F.col("text"))) + claims).alias("total"))


SHAPE = "node_pos int, id string, topo_index int, depth int, below array<string>"


def shaped(nodes: DataFrame) -> DataFrame:
    """Each node's place in first-in-first-out topological order, its depth (longest path from a root) and all it leads to, itself first.

    A run is one group; payload limits bound it to fifty nodes. Nodes on or behind a cycle have no place; parents that are not there do not count.
    """
    own = complete(nodes).select("run_id", "node_pos", "id", "parent_ids")
    kind = own.schema["run_id"].dataType.simpleString()

    def walk(ids, parents):
        children = {i: [] for i in ids}
        parents = {i: [p for p in parents[i] if p in children] for i in ids}
        for i in ids:
            for p in parents[i]:
                children[p].append(i)
        left = {i: len(parents[i]) for i in ids}
        queue, depth = [i for i in ids if not left[i]], {}
        for i in queue:
            depth[i] = max((depth[p] + 1 for p in parents[i]), default=0)
            for c in children[i]:
                left[c] -= 1
                if not left[c]:
                    queue.append(c)
        place = {i: n for n, i in enumerate(queue)}
        below = []
        for i in ids:
            seen = {i: None}
            for x in (found := [i]):
                for c in children[x]:
                    if c not in seen:
                        seen[c] = None
                        found.append(c)
            below.append(found)
        return [place.get(i) for i in ids], [depth.get(i) for i in ids], below

    def run(batches):
        import pyarrow as pa

        held = {}  # rows of one run: the last may go on in the next batch

        def flush(done):
            out = [[], [], [], [], [], []]
            for run_id in done:
                own = held.pop(run_id)
                pos, ids, parents = zip(*own)
                for x, v in zip(out, ([run_id] * len(ids), pos, ids, *walk(list(ids), dict(zip(ids, parents))))):
                    x.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (key, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())))], ["run_id", "node_pos", "id", "topo_index", "depth", "below"])

        key = None
        for batch in batches:
            key = batch.schema.field(0).type
            for run_id, *own in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(run_id, []).append(own)
            yield from flush(list(held)[:-1])
        if held:
            yield from flush(list(held))

    return own.repartition("run_id").sortWithinPartitions("run_id", "node_pos").mapInArrow(run, f"run_id {kind}, {SHAPE}")


def cycles(nodes: DataFrame) -> DataFrame:
    return shaped(nodes).filter("topo_index is null").select("run_id", "id")


def descendants(nodes: DataFrame) -> DataFrame:
    return shaped(nodes).select("run_id", "id", F.explode("below").alias("descendant"))


def graph_edges(nodes: DataFrame, shape: DataFrame | None = None) -> DataFrame:
    """Edges in topological order of the child, then order of its parents; a parent's signals are computed once, however many children it has."""
    own = complete(nodes).join((shaped(nodes) if shape is None else shape).select("run_id", "node_pos", "topo_index"), ["run_id", "node_pos"])
    parents = sides(own.select("run_id", "id", "label", "text", "guardrail")).select("run_id", F.col("id").alias("parent"), end_of(SIDE).alias("p"), F.col("unc").alias("pu"))
    child = own.select("run_id", "topo_index", "id", "label", "text", "guardrail", "inherited_claims", F.posexplode("parent_ids").alias("parent_pos", "parent"))
    child = child.withColumn("text", F.coalesce(F.try_element_at("inherited_claims", F.col("parent")), "text")).drop("inherited_claims")
    child = sides(child).select("run_id", "topo_index", "id", "guardrail", "parent_pos", "parent", end_of(LATER).alias("c"), F.col("unc").alias("cu"))
    both = child.join(parents, ["run_id", "parent"])
    order = Window.partitionBy("run_id").orderBy("topo_index", "parent_pos")
    labels = F.filter(F.array(F.when(F.col("pu"), F.col("p.label")), F.when(F.col("cu"), F.col("c.label"))), lambda x: x.isNotNull())
    return both.select("run_id", (F.row_number().over(order) - 1).cast("int").alias("edge_index"), F.col("parent").alias("from_id"), F.col("id").alias("to_id"), F.concat(uri_component(F.col("parent")), F.lit("->"), uri_component(F.col("id"))).alias("edge_id"), "p", "c", "guardrail", F.when(F.size(labels) > 0, labels).alias("coverage_labels"))


def merge_projection(nodes: DataFrame) -> DataFrame:
    """The text that each parent is compared with: what the node says it took from it, else all of it."""
    own = complete(nodes).select("run_id", "id", "text", "inherited_claims", F.posexplode("parent_ids").alias("parent_pos", "parent"))
    return own.select("run_id", "id", "parent", F.coalesce(F.try_element_at("inherited_claims", F.col("parent")), "text").alias("compared"))


def graph_issues(edges: DataFrame, rules=()) -> DataFrame:
    """Issues with every edge looked at by itself; ids carry the edge's."""
    found = edge_issues(edges, rules, scan="edge")
    names = edges.select("run_id", "edge_index", "edge_id", "from_id", "to_id")
    # One edge is a chain of two for its own issue ids: they count from 0.
    return found.join(names, ["run_id", "edge_index"]).withColumn("issue_id", F.concat("edge_id", F.lit(":0"), F.regexp_replace("issue_id", "^[0-9]+", "")))


def first_blocking_edge(edges: DataFrame, issues: DataFrame, threshold: str = "medium") -> DataFrame:
    top = issues.groupBy("run_id", "edge_index").agg(F.max(rank_of(F.col("severity"))).alias("r")).filter(F.col("r") >= threshold_rank(threshold))
    first = top.groupBy("run_id").agg(F.min("edge_index").alias("edge_index"))
    return edges.select("run_id", "edge_index", "edge_id", "from_id", "to_id").join(first, ["run_id", "edge_index"])


def graph_states(nodes: DataFrame, first: DataFrame) -> DataFrame:
    """clean, first-break (the first blocking edge's end), downstream (all it leads to) or verified."""
    shape = shaped(nodes)
    hit = first.join(shape.select("run_id", F.col("id").alias("to_id"), "below"), ["run_id", "to_id"]).select("run_id", "to_id", "below")
    own = shape.select("run_id", "id", "topo_index").join(hit, "run_id", "left")
    state = F.when(F.col("to_id").isNull(), "clean").when(F.col("id") == F.col("to_id"), "first-break").when(F.array_contains("below", F.col("id")), "downstream").otherwise("verified")
    return own.select("run_id", "id", "topo_index", state.alias("state"))


def graph_recovery(nodes: DataFrame, first: DataFrame) -> DataFrame:
    """Per run: failed edge, node to retry, its parents in order, and what is contaminated."""
    shape = shaped(nodes).select("run_id", F.col("id").alias("to_id"), "below")
    retry = complete(nodes).select("run_id", F.col("id").alias("to_id"), "label", "parent_ids")
    runs = nodes.select("run_id").distinct()
    own = first.join(shape, ["run_id", "to_id"]).join(retry, ["run_id", "to_id"])
    out = runs.join(own, "run_id", "left")
    return out.select("run_id", F.when(F.col("edge_id").isNull(), "not-required").otherwise("review-required").alias("status"), "edge_id", F.col("to_id").alias("retry_node"), F.array_join("parent_ids", ",").alias("verified_parents"), F.array_join(F.array_sort("below"), ",").alias("contaminated"))


def verified_parents(nodes: DataFrame, first: DataFrame) -> DataFrame:
    """Parents of each node to retry, in their order, with their texts."""
    retry = links(nodes).join(first.select("run_id", F.col("to_id").alias("id")), ["run_id", "id"], "left_semi")
    there = complete(nodes).select("run_id", F.col("id").alias("parent"), "label", "text")
    return retry.join(there, ["run_id", "parent"]).select("run_id", "id", "parent_pos", "parent", "label", "text")


def graph_ids(nodes: DataFrame, threshold: str = "medium") -> DataFrame:
    """Content identity: guardrail, threshold and topologically ordered nodes; absent claims are marked as such."""
    own = complete(nodes).join(shaped(nodes).select("run_id", "node_pos", "topo_index"), ["run_id", "node_pos"])
    pairs = F.transform(F.array_sort(F.transform(F.map_entries("inherited_claims"), lambda e: F.struct(F.lower(e["key"]).alias("l"), e["key"].alias("k"), e["value"].alias("v")))), lambda e: F.concat(json_string(e["k"]), F.lit(":"), json_string(e["v"])))
    claims = F.when(F.col("inherited_claims").isNull(), F.lit('{"$undefined":true}')).otherwise(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))
    body = F.concat(F.lit('{"id":'), json_string(F.col("id")), F.lit(',"inheritedClaims":'), claims, F.lit(',"label":'), json_string(F.col("label")), F.lit(',"parentIds":['), F.array_join(F.transform("parent_ids", json_string), ","), F.lit('],"text":'), json_string(F.col("text")), F.lit("}"))
    run = own.withColumn("b", body).groupBy("run_id").agg(F.max("guardrail").alias("guardrail"), F.array_sort(F.collect_list(F.struct("topo_index", "b"))).alias("n"))
    whole = F.concat(F.lit(f'{{"blockAtOrAbove":"{threshold}","guardrail":'), json_string(F.coalesce("guardrail", F.lit(""))), F.lit(',"nodes":['), F.array_join(F.transform("n", lambda x: x["b"]), ","), F.lit(f'],"schema":"{GRAPH}"}}'))
    return run.withColumn("f", F.sha2(whole, 256)).select("run_id", short_id(F.col("f"), "GRUN").alias("id"), long_id(F.col("f")).alias("fingerprint"))


def graph_report(nodes: DataFrame, threshold: str = "medium", rules=()) -> DataFrame:
    """One row a run: nodes, edges, issues, first blocking edge, families that speak there, contaminated nodes."""
    # What several steps read is worked out once.
    nodes = stored(nodes, "nodes")
    shape = stored(shaped(nodes), "shape")
    edges = stored(graph_edges(nodes, shape), "edges")
    issues = stored(graph_issues(edges, rules).select("run_id", "edge_index", "family", "severity"), "issues")
    first = stored(first_blocking_edge(edges, issues, threshold), "first")
    agree = issues.join(first.select("run_id", "edge_index"), ["run_id", "edge_index"]).groupBy("run_id").agg(F.count_distinct("family").alias("active"))
    below = first.join(shape.select("run_id", F.col("id").alias("to_id"), F.size("below").alias("contaminated")), ["run_id", "to_id"]).select("run_id", "edge_id", "contaminated")
    counts = nodes.groupBy("run_id").agg(F.count("*").alias("n_nodes"), F.sum(F.size("parent_ids")).alias("n_edges"))
    out = counts.join(issues.groupBy("run_id").agg(F.count("*").alias("n_issues")), "run_id", "left").join(below, "run_id", "left").join(agree, "run_id", "left")
    return out.select("run_id", "n_nodes", "n_edges", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), F.col("edge_id").alias("first_blocking_edge"), F.coalesce("active", F.lit(0)).alias("active_families"), F.coalesce("contaminated", F.lit(0)).alias("contaminated"))


def gate_response(nodes: DataFrame, threshold: str = "medium", rules=()) -> DataFrame:
    """The gate's answer a graph as JSON: decision, blocking edge, identity, size of the report and what to do."""
    nodes = stored(nodes, "nodes")
    edges = stored(graph_edges(nodes), "edges")
    issues = stored(graph_issues(edges, rules).select("run_id", "edge_index", "severity"), "issues")
    first = stored(first_blocking_edge(edges, issues, threshold), "first")
    own = graph_recovery(nodes, first).join(graph_ids(nodes, threshold), "run_id").join(issues.groupBy("run_id").agg(F.count("*").alias("n")), "run_id", "left")
    recovery = F.struct("status", F.col("retry_node").alias("retryNode"), F.col("verified_parents").alias("verifiedParents"), "contaminated")
    body = F.struct(
        F.lit("graph").alias("topology"), F.when(F.col("edge_id").isNull(), "allow").otherwise("block").alias("decision"), F.lit(threshold).alias("threshold"), F.col("edge_id").alias("blockingEdgeId"),
        F.col("id").alias("runId"), F.coalesce("n", F.lit(0)).alias("issues"), recovery.alias("recovery"),
    )
    return own.select("run_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("response"))


def validated(nodes: DataFrame) -> DataFrame:
    """Rows (run_id, code, node) of every rule that a graph breaks; a run without a row is sound."""
    n = complete(nodes).withColumn("label", trimmed(F.col("label"))).withColumn("text", trimmed(F.col("text")))
    checks = [
        ("blank-field", (F.col("id") == "") | (F.col("label") == "") | (F.col("text") == "")), ("long-id", utf16_length(F.col("id")) > LIMITS["id"]), ("long-label", utf16_length(F.col("label")) > LIMITS["label"]),
        ("long-text", utf16_length(F.col("text")) > LIMITS["text"]), ("repeated-parent", F.size(F.array_distinct("parent_ids")) < F.size("parent_ids")), ("own-parent", F.array_contains("parent_ids", F.col("id"))),
        ("empty-parent", F.array_contains("parent_ids", "")), ("blank-claim", F.exists(F.coalesce(F.map_values("inherited_claims"), F.array().cast("array<string>")), lambda x: trimmed(x) == "")),
        ("long-claim", F.exists(F.coalesce(F.map_values("inherited_claims"), F.array().cast("array<string>")), lambda x: utf16_length(trimmed(x)) > LIMITS["text"])),
    ]
    rows = n.select("run_id", F.col("id").alias("node"), F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks]), lambda x: x.isNotNull())).alias("code"))
    per_run = n.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.size("parent_ids") == 0).alias("roots"), F.count("id").alias("m"), F.count_distinct("id").alias("d"), F.max(utf16_length(F.coalesce("guardrail", F.lit("")))).alias("g"))
    run_checks = [("too-few-nodes", F.col("n") < 2), ("too-many-nodes", F.col("n") > LIMITS["stages"]), ("no-root", F.col("roots") == 0), ("repeated-id", F.col("d") < F.col("m")), ("long-guardrail", F.col("g") > LIMITS["guardrail"])]
    runs = per_run.select("run_id", F.lit(None).cast("string").alias("node"), F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in run_checks]), lambda x: x.isNotNull())).alias("code"))
    total = text_totals(nodes).filter(F.col("total") > LIMITS["total"]).select("run_id", F.lit(None).cast("string").alias("node"), F.lit("long-total").alias("code"))
    lost = missing_parents(nodes).select("run_id", F.col("id").alias("node"), F.lit("missing-parent").alias("code"))
    stray = orphan_claims(nodes).select("run_id", F.col("id").alias("node"), F.lit("claim-for-non-parent").alias("code"))
    loop = cycles(nodes).select("run_id", F.col("id").alias("node"), F.lit("cycle").alias("code"))
    out = rows
    for x in (runs, total, lost, stray, loop):
        out = out.unionByName(x)
    return out.select("run_id", "node", "code")
