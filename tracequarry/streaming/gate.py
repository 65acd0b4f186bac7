"""Live sessions: the gate and the rate limiter as keyed stream processors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.session import GATE, QUOTA, WINDOW_MS, Session, limited, walked

GATE_STATE = "snapshot string"
LIMIT_STATE = "started long, count long"


def gate_stream(operations: DataFrame) -> DataFrame:
    """A stream of operations to a stream of decisions. Within a micro-batch a session's operations go by seq; its state is a snapshot that outlives restarts with the checkpoint."""
    kind = operations.schema["session_id"].dataType.simpleString()

    def run(key, frames, state: GroupState):
        import pandas as pd

        session = Session(**json.loads(state.get[0])) if state.exists else Session()
        pdf = pd.concat(list(frames), ignore_index=True)
        pdf = pdf.astype(object).where(pdf.notna(), None).sort_values("seq", kind="stable")
        rows = walked(session, pdf[["seq", "op", "agent_id", "content", "idempotency_key", "blocked"]].itertuples(index=False))
        state.update((json.dumps(session.dump()),))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["session_id", *[x.split()[0] for x in GATE.split(", ")]])

    return operations.groupBy("session_id").applyInPandasWithState(run, f"session_id {kind}, {GATE}", GATE_STATE, "append", GroupStateTimeout.NoTimeout)


def limit_stream(requests: DataFrame, quota: int = QUOTA, window: int = WINDOW_MS) -> DataFrame:
    """A stream of requests to a stream of verdicts; a tenant's state goes when its window has run out."""
    kind = requests.schema["tenant"].dataType.simpleString()

    def run(key, frames, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        own, out = (tuple(state.get) if state.exists else None), []
        for rid, now in pd.concat(list(frames)).sort_values(["now_ms", "request_id"])[["request_id", "now_ms"]].itertuples(index=False):
            ok, wait, own = limited(int(now), own, quota, window)
            out.append((key[0], rid, ok, 0 if ok else wait))
        state.update(tuple(map(int, own)))
        state.setTimeoutDuration(window)
        yield pd.DataFrame(out, columns=["tenant", "request_id", "allowed", "retry_after_ms"])

    return requests.groupBy("tenant").applyInPandasWithState(run, f"tenant {kind}, request_id long, allowed boolean, retry_after_ms long", LIMIT_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def to_parquet(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Write decisions as Parquet; a restart goes on from the checkpoint."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
