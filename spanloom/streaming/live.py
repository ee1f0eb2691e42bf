"""Live traces: lines arrive by trace, state holds them until the trace ends or falls silent.

A finished trace leaves the state as one row with its whole content, which the batch readers then parse; so live
and replayed traces come out alike.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Event types that end a trace, by format.
ENDS = frozenset({"transcript.completed", "result", "agent_end", "thread.completed", "trace_end"})
_OUT = "trace_id string, content string, timed_out boolean, lines long"


def _ends(line: str) -> bool:
    try:
        v = json.loads(line)
    except ValueError:
        return False
    return isinstance(v, dict) and v.get("type") in ENDS


def finished(lines: DataFrame, silence_ms: int = 60_000) -> DataFrame:
    """Traces of a stream ``(trace_id, pos, line)``: one row when a trace ends, or when it was silent so long.

    Lines may come out of order within a trace; they leave in order of pos, repeated ones once.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(json.loads(state.get[0])) if state.exists else {}
        late = state.hasTimedOut
        over = late
        if not late:
            for f in frames:
                for pos, line in zip(f["pos"], f["line"]):
                    held[str(pos)] = line
            over = any(_ends(x) for x in held.values())
        if not over:
            state.update((json.dumps(list(held.items())),))
            state.setTimeoutDuration(silence_ms)
            return
        if state.exists:
            state.remove()
        ordered = [x for _, x in sorted(held.items(), key=lambda p: int(p[0]))]
        yield pd.DataFrame({"trace_id": [key[0]], "content": ["\n".join(ordered)], "timed_out": [late], "lines": [len(ordered)]})

    return lines.groupBy("trace_id").applyInPandasWithState(step, _OUT, "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def line_source(spark, path: str) -> DataFrame:
    """Lines of JSON files ``{"trace_id", "pos", "line"}`` that arrive in a folder."""
    return spark.readStream.schema("trace_id string, pos long, line string").json(path)


def grade_live(lines: DataFrame, parse, sink, checkpoint: str, silence_ms: int = 60_000, once: bool = False):
    """Parse finished traces of each batch and hand them to ``sink(traces, batch_id)``; resumes from its checkpoint."""
    from ..sources.files import json_lines

    def batch(df: DataFrame, batch_id: int) -> None:
        files = df.select(F.col("trace_id").alias("file"), "content")
        sink(parse(json_lines(files)).join(df.select("trace_id", "timed_out"), "trace_id"), batch_id)

    w = finished(lines, silence_ms).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
