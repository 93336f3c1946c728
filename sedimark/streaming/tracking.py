"""Tracking assignments and captures as they arrive: keyed state that decides each row as it comes.

The rule is that of governance.assigned; here a source's moments and what was said at each are state, so a stream that is replayed gives the same states, and a capture
is judged by the assignment that is in effect when it comes. Needs the RocksDB state store.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.governance import POLICY

#: Rows in: kind is `assign` or `capture`; first_seen_at is the source's. Times are microseconds.
ARRIVALS = "seq long, source_id string, kind string, level string, assigned_by string, reason string, effective_at long, recorded_at long, first_seen_at long, needed_rank int"
DECIDED = "seq long, source_id string, kind string, level string, state string"
_RANK = {row[0]: row[2] for row in POLICY}


class Tracking(StatefulProcessor):
    """State of a source: what was assigned at each moment, and the latest moment."""

    def init(self, handle) -> None:
        self.said = handle.getMapState("said", "effective_at long", "level string, assigned_by string, reason string")
        self.latest = handle.getValueState("latest", "recorded_at long, level string")

    def handleInputRows(self, key, rows, timerValues):
        arrived = pd.concat([*rows]).sort_values("seq", kind="stable")
        out = []
        for r in arrived.itertuples(index=False):
            last = self.latest.get() if self.latest.exists() else None
            if r.kind == "capture":
                level = last[1] if last is not None and not pd.isna(r.recorded_at) and r.recorded_at >= last[0] else self._level_at(r.recorded_at)
                allowed = _RANK.get(level or "0", 0) >= r.needed_rank
                out.append((r.seq, key[0], r.kind, level, "allowed" if allowed else "blocked"))
            else:
                out.append((r.seq, key[0], r.kind, r.level, self._assign(r, last)))
        yield pd.DataFrame(out, columns=["seq", "source_id", "kind", "level", "state"])

    def _level_at(self, at) -> str | None:
        """The level in effect at an earlier moment."""
        moments = [k[0] for k in self.said.keys() if not pd.isna(at) and k[0] <= at]
        return self.said.getValue((max(moments),))[0] if moments else None

    def _assign(self, r, last) -> str:
        if pd.isna(r.first_seen_at):
            return "unknown source"
        by, reason = (str(x).strip() if isinstance(x, str) else "" for x in (r.assigned_by, r.reason))
        if not by or not reason:
            return "empty field"
        effective = r.recorded_at if pd.isna(r.effective_at) else r.effective_at
        moment = (int(effective),)
        if self.said.containsKey(moment):
            return "replayed" if tuple(self.said.getValue(moment)) == (r.level, by, reason) else "occupied"
        if effective != r.recorded_at:
            return "not immediate"
        if effective < r.first_seen_at:
            return "before the source"
        if last is not None and r.recorded_at < last[0]:
            return "clock moved back"
        self.said.updateValue(moment, (r.level, by, reason))
        self.latest.update((int(r.recorded_at), r.level))
        return "recorded"

    def close(self) -> None:
        pass


def decided(arrivals: DataFrame) -> DataFrame:
    """DECIDED rows of a stream of ARRIVALS."""
    return arrivals.groupBy("source_id").transformWithStateInPandas(Tracking(), DECIDED, "Append", "None")
