"""Views followed live: when their edits are analysed, and what is stale meanwhile.

A stateful operator per view with event-time timers.  Edits are combined as they come, so the state of a
view is its newest version, the bursts that are not over, and the edits of the allowed lateness: a view that is edited all
the time holds one burst.  A burst is due when the watermark has passed its end; a timer sees to it when
nothing else happens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .events import ANALYSIS_DELAY, _micros

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: ``kind`` is ``burst`` (a due one: begin, due time, version, number of edits), ``state`` (newest and analysed version) or
#: ``closed`` (the version at which a view was closed).
OUTPUT = (
    "view_id string, kind string, first_edit timestamp, analyse_at timestamp, change_count bigint, n_edits bigint, "
    "analysed_count bigint"
)
_COLUMNS = [part.split()[0] for part in OUTPUT.split(", ")]


class ViewProcessor(StatefulProcessor):
    """Versions and bursts of one view, in microseconds; ``drop_closed`` forgets what was edited before a close."""

    def __init__(self, gap: str, drop_closed: bool):
        self.gap, self.drop_closed = _micros(gap), drop_closed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.versions = handle.getValueState("versions", "newest bigint, settled bigint, saved bigint, analysed bigint")
        self.bursts = handle.getListState("bursts", "first bigint, last bigint, newest bigint, n bigint")
        self.recent = handle.getListState("recent", "at bigint, change_count bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.versions.get()) if self.versions.exists() else (None,) * 4
        newest, settled, saved, analysed = before
        bursts, recent, closed = [tuple(b) for b in self.bursts.get()], [tuple(e) for e in self.recent.get()], None
        for part in rows:
            edits = part[part["kind"] == "modified"]
            if len(edits):
                at = edits["at"].astype("int64")
                recent += zip(at.tolist(), edits["change_count"].tolist(), strict=True)
                newest = _largest(newest, int(edits["change_count"].max()))
                bursts = self._merged(bursts, at, edits["change_count"])
            saves = part[part["kind"].isin(["activated", "saved"])]
            if len(saves):
                saved = _largest(saved, int(saves["change_count"].max()))
            closes = part[part["kind"] == "closed"]
            if len(closes) and self.drop_closed:
                closed = _largest(closed, int(closes["change_count"].max()))
        # Analysed at once: the newest edit before the newest save.
        if saved is not None:
            for n in (settled, *(n for _, n in recent)):
                if n is not None and n < saved:
                    analysed = _largest(analysed, n)
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        settled = _largest(settled, *(n for at, n in recent if at <= watermark))
        recent = [(at, n) for at, n in recent if at > watermark]
        if closed is not None:
            yield _frame([(key[0], "closed", None, None, closed, None, None)])
            if newest is None or newest <= closed:
                self._forget()
                return
            # Edits from before the close are no longer known; a burst that spans it goes on.
            bursts = [b for b in bursts if b[2] > closed]
            recent = [(at, n) for at, n in recent if n > closed]
            settled = settled if settled is None or settled > closed else None
        yield from self._settle(key, (newest, settled, saved, analysed), before, bursts, recent, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.versions.exists():
            before = tuple(self.versions.get())
            bursts, recent = [tuple(b) for b in self.bursts.get()], [tuple(e) for e in self.recent.get()]
            yield from self._settle(key, before, before, bursts, recent, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass

    def _merged(self, bursts: list[tuple], at: pd.Series, versions: pd.Series) -> list[tuple]:
        """Bursts with new edits.  These are combined by pauses first, so a batch adds few."""
        order = at.argsort(kind="stable")
        at, versions = at.iloc[order], versions.iloc[order]
        run = (at.diff() > self.gap).cumsum()
        made = pd.DataFrame({"at": at, "n": versions}).groupby(run.to_numpy()).agg(
            first=("at", "min"), last=("at", "max"), newest=("n", "max"), n=("n", "size")
        )
        out: list[tuple] = []
        for b in sorted([*bursts, *(tuple(map(int, r)) for r in made.to_numpy())]):
            if out and b[0] <= out[-1][1] + self.gap:
                a = out[-1]
                out[-1] = (a[0], max(a[1], b[1]), max(a[2], b[2]), a[3] + b[3])
            else:
                out.append(b)
        return out

    def _settle(self, key, now, before, bursts, recent, watermark) -> Iterator[pd.DataFrame]:
        """Emit bursts that are due and a changed state; keep the rest, with a timer for the next burst."""
        newest, settled, saved, analysed = now
        due = [b for b in bursts if b[1] + self.gap <= watermark]
        bursts = [b for b in bursts if b[1] + self.gap > watermark]
        analysed = _largest(analysed, *(b[2] for b in due))
        out = [(key[0], "burst", _time(b[0]), _time(b[1] + self.gap), b[2], b[3], None) for b in due]
        if (newest, analysed) != (before[0], before[3]):
            out.append((key[0], "state", None, None, newest, None, analysed))
        self.versions.update((newest, settled, saved, analysed))
        self.bursts.put(bursts) if bursts else self.bursts.clear()
        self.recent.put(recent) if recent else self.recent.clear()
        timers = {-(-(b[1] + self.gap) // 1000) for b in bursts}
        for t in timers.difference(self.handle.listTimers() if timers else ()):
            self.handle.registerTimer(t)
        if out:
            yield _frame(out)

    def _forget(self) -> None:
        for state in (self.versions, self.bursts, self.recent):
            state.clear()


def _largest(*values):
    return max((v for v in values if v is not None), default=None)


def _time(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    for c in ("change_count", "n_edits", "analysed_count"):
        out[c] = out[c].astype("Int64")
    for c in ("first_edit", "analyse_at"):
        out[c] = pd.to_datetime(out[c])
    return out


def followed(events: DataFrame, gap: str = ANALYSIS_DELAY, drop_closed: bool = False) -> DataFrame:
    """Stream of due bursts and changed states of views, with columns as in ``OUTPUT``.

    ``events`` is a stream with a watermark on ``ts``; set it before events are filtered, so that time goes on with all of
    them.  Versions (``change_count``) grow with time within a view.  Needs the RocksDB state store; see ``ROCKSDB``.
    """
    rows = events.select("view_id", "ts", F.unix_micros("ts").alias("at"), "kind", "change_count")
    return rows.groupBy("view_id").transformWithStateInPandas(
        ViewProcessor(gap, drop_closed), OUTPUT, "Append", "EventTime"
    )


def bursts(followed_views: DataFrame) -> DataFrame:
    """Bursts of edits that have been due, as from ``events.debounced``."""
    found = followed_views.where("kind = 'burst'")
    return found.select("view_id", "first_edit", "analyse_at", "change_count", "n_edits")


def stale(followed_views: DataFrame) -> DataFrame:
    """Open views whose newest version was not analysed yet; both versions only grow, so the last state is the largest."""
    closed = F.max(F.when(F.col("kind") == "closed", F.col("change_count"))).alias("closed")
    seen = followed_views.where("kind in ('state', 'closed') and change_count is not null").withColumn("is_state", F.col("kind") == "state")
    last = F.max(F.when(F.col("is_state"), F.struct("change_count", F.coalesce("analysed_count", F.lit(-1)).alias("n"), "analysed_count")))
    states = seen.groupBy("view_id").agg(last.alias("s"), closed)
    found = states.where(F.col("s.change_count") > F.coalesce("closed", F.lit(-1))).select("view_id", "s.change_count", "s.analysed_count")
    return found.where(~F.col("change_count").eqNullSafe(F.col("analysed_count")))
