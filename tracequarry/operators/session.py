"""Keyed serial state: the handoff gate with freeze and reset, the tenant rate limiter, snapshots.

One fold serves the batch replay here and the streaming processor: a session's operations in order of seq. The fold needs
each stage's verdict against its predecessor, which the native detectors compute before it, so Python only walks states.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GATE = "seq long, op string, outcome string, stage_id string, frozen boolean, stages int, event_seq long"
WINDOW_MS, QUOTA = 60_000, 60


@dataclass
class Session:
    frozen: bool = False
    failed_at: int | None = None
    stages: list = field(default_factory=list)
    used: dict = field(default_factory=dict)  # idempotency key -> [content, outcome, stage id]
    event_seq: int = 0

    def dump(self) -> dict:
        return asdict(self)

    def stage_id(self, wanted: str) -> str:
        taken = set(self.stages)
        if wanted not in taken:
            return wanted
        n = 2
        while f"{wanted}-{n}" in taken:
            n += 1
        return f"{wanted}-{n}"

    def apply(self, op: str, agent: str | None, content: str | None, key: str | None, blocked: bool) -> tuple[str, str | None]:
        """(outcome, stage id) of one operation. A blocked stage stays in the trace until a reset."""
        if op == "handoff" and key is not None and key in self.used:
            old, outcome, stage = self.used[key]
            return ("replayed-" + outcome, stage) if old == content else ("error-key-conflict", None)
        if op == "reset":
            if not self.frozen:
                return "error-not-frozen", None
            self.stages = self.stages[: self.failed_at + 1]
            self.used = {k: v for k, v in self.used.items() if v[2] in set(self.stages)}
            self.frozen, self.failed_at = False, None
            return "reset", None
        if self.frozen:
            return "error-frozen", None
        if not (agent or "").strip() or not (content or "").strip():
            return "error-blank", None
        if op == "record-source":
            if self.stages:
                return "error-second-source", None
            self.stages.append(agent.strip())
            return "recorded", self.stages[-1]
        if op != "handoff":
            return "error-operation", None
        if not self.stages:
            return "error-no-source", None
        stage = self.stage_id(agent.strip())
        self.stages.append(stage)
        outcome = "blocked" if blocked else "allowed"
        if blocked:
            self.frozen, self.failed_at = True, len(self.stages) - 2
        if key is not None:
            self.used[key] = [content, outcome, stage]
        return outcome, stage


def walked(session: Session, rows) -> list[tuple]:
    """rows (seq, op, agent, content, key, blocked) in order to GATE rows."""
    out = []
    for seq, op, agent, content, key, blocked in rows:
        outcome, stage = session.apply(op, agent, content, key, bool(blocked))
        session.event_seq += 1
        out.append((int(seq), op, outcome, stage, session.frozen, len(session.stages), session.event_seq))
    return out


def folded(rows: DataFrame, key: str, order: list[str], columns: list[str], start, step, schema: str) -> DataFrame:
    """Walk each key's rows in order: step(state, columns of a row) gives (state, row of schema). Rows come sorted and in Arrow batches, so a task holds one batch and one
    key's state, however many rows the key has; a single key's rows are walked by a single task, as each state needs the one before.
    """
    kind = rows.schema[key].dataType.simpleString()
    out = T.StructType.fromDDL(f"{key} {kind}, {schema}")
    own = rows.select(key, *columns).repartition(key).sortWithinPartitions(key, *order, *[c for c in columns if c not in order])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, now, state = to_arrow_schema(out), object(), None
        for batch in batches:
            told = []
            for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if k != now:
                    now, state = k, start()
                state, said = step(state, row)
                told.append((k, *said))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*told) if told else [[] for _ in arrow], arrow)], schema=arrow)

    return own.mapInArrow(run, out)


def gate_replay(operations: DataFrame) -> DataFrame:
    """operations (session_id, seq, op, agent_id, content, idempotency_key, blocked) of whole sessions to one decision each, in order of seq (ties by the other columns)."""
    return folded(operations, "session_id", ["seq"], ["seq", "op", "agent_id", "content", "idempotency_key", "blocked"], Session, lambda s, row: (s, walked(s, [row])[0]), GATE)


def limited(now: int, state: tuple[int, int] | None, quota: int = QUOTA, window: int = WINDOW_MS) -> tuple[bool, int, tuple[int, int]]:
    """(allowed, ms until the window ends, new state): a window starts with the first request after the last one ran out; refused requests count too."""
    if state is None or now - state[0] >= window:
        state = (now, 0)
    state = (state[0], state[1] + 1)
    return state[1] <= quota, max(0, state[0] + window - now), state


def rate_limit(requests: DataFrame, quota: int = QUOTA, window: int = WINDOW_MS) -> DataFrame:
    """requests (tenant, request_id, now_ms) to allowed and retry_after_ms, in order of now_ms, then request_id."""

    def step(state, row):
        ok, wait, state = limited(row[0], state, quota, window)
        return state, (row[1], ok, 0 if ok else wait)

    return folded(requests, "tenant", ["now_ms", "request_id"], ["now_ms", "request_id"], lambda: None, step, "request_id long, allowed boolean, retry_after_ms long")


def snapshot_faults(snapshots: DataFrame) -> DataFrame:
    """Rows (session_id, code) of the invariants that a saved session breaks.

    snapshots: session_id, version, run_name, threshold, mode, frozen, recovery_index, stage_ids array, event_seq, rule_ids array, approvals array (fingerprints),
    executions array<struct<key, fingerprint, status>>, judged array<int>, handoffs array<struct<key, fingerprint, stage_id>>.
    """
    n = F.size("stage_ids")
    hexed = lambda x: x.rlike("^[0-9a-fA-F]{64}$")
    repeated = lambda a: F.size(F.array_distinct(a)) < F.size(a)
    blank = lambda x: x.isNull() | (F.trim(x) == "")
    checks = {
        "version": ~F.col("version").eqNullSafe("1.0"), "session-id": blank(F.col("session_id")), "run-name": blank(F.col("run_name")), "threshold": ~F.coalesce(F.col("threshold").isin("low", "medium", "high"), F.lit(False)),
        "mode": ~F.coalesce(F.col("mode").isin("deterministic", "hybrid", "semantic"), F.lit(True)), "frozen": F.col("frozen").isNull(), "stages": (n < 1) | repeated(F.col("stage_ids")),
        "recovery": F.coalesce(F.col("frozen"), F.lit(False)) != F.col("recovery_index").isNotNull(), "recovery-range": F.coalesce((F.col("recovery_index") < 0) | (F.col("recovery_index") >= n - 1), F.lit(False)), "event-seq": F.coalesce(F.col("event_seq") < 0, F.lit(True)),
        "rules": repeated(F.col("rule_ids")) | F.exists("rule_ids", blank), "approvals": F.exists("approvals", lambda x: ~hexed(x)),
        "executions": repeated(F.transform("executions", lambda x: x["key"])) | F.exists("executions", lambda x: ~hexed(x["fingerprint"]) | ~x["status"].isin("pending", "completed", "failed")),
        "judged": repeated(F.col("judged")) | F.exists("judged", lambda x: (x < 0) | (x >= n - 1)), "handoffs": repeated(F.transform("handoffs", lambda x: x["key"])) | F.exists("handoffs", lambda x: ~hexed(x["fingerprint"]) | ~F.array_contains("stage_ids", x["stage_id"])),
    }
    return snapshots.select("session_id", F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())).alias("code"))
