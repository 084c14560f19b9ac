"""Table functions for SQL: ``register`` makes them known to a session."""

from __future__ import annotations

from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

HORIZONS = (5, 10, 20)
NEEDED = ("entity_id", "session_date", "session_no", "close")


class SessionLabels:
    """Exact-session labels of one entity at a time, in the order of its sessions.

    ``SELECT * FROM session_labels(TABLE(bars) PARTITION BY entity_id ORDER BY session_no)``
    gives (entity_id, session_date, horizon, target_date, expected) for 5, 10
    and 20 sessions ahead, or for those of a second argument such as ``'1,5'``.
    A label needs the entity's row at exactly that session; one that never
    comes leaves target_date and expected null, and a close that is null or not
    above zero leaves expected null.  The state is the sessions still waiting,
    the longest horizon at most.  Rows without a session number are skipped;
    of a repeated one the first counts.
    """

    @staticmethod
    def analyze(bars: AnalyzeArgument, horizons: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not bars.isTable:
            raise ValueError("session_labels needs a TABLE argument")
        missing = [c for c in NEEDED if c not in bars.dataType.fieldNames()]
        if missing:
            raise ValueError(f"session_labels needs the columns {', '.join(missing)}")
        steps = SessionLabels._steps(horizons.value if horizons else None)
        if not steps or min(steps) < 1:
            raise ValueError("session_labels needs horizons of one session or more")
        fields = [("entity_id", LongType()), ("session_date", DateType()), ("horizon", IntegerType()), ("target_date", DateType()), ("expected", DoubleType())]
        return AnalyzeResult(StructType([StructField(n, t) for n, t in fields]))

    @staticmethod
    def _steps(text: str | None) -> tuple[int, ...]:
        return tuple(sorted({int(x) for x in text.split(",")})) if text else HORIZONS

    def __init__(self) -> None:
        self._waiting: deque = deque()  # (session number, row, horizons not met yet)
        self._last: int | None = None
        self._steps_of: tuple[int, ...] = HORIZONS

    def _rows(self, held, horizons, target=None):
        for h in sorted(horizons):
            known = target is not None and None not in (held["close"], target["close"]) and held["close"] > 0 and target["close"] > 0
            yield held["entity_id"], held["session_date"], h, target["session_date"] if target is not None else None, target["close"] / held["close"] - 1 if known else None

    def eval(self, bars, horizons: str | None = None):
        no = bars["session_no"]
        if no is None or no == self._last:
            return
        self._last, self._steps_of = no, self._steps(horizons)
        for start, held, open_steps in self._waiting:
            met = [h for h in open_steps if start + h == no]
            yield from self._rows(held, met, bars)
            open_steps.difference_update(met)
        while self._waiting and self._waiting[0][0] + self._steps_of[-1] <= no:
            _, held, open_steps = self._waiting.popleft()
            yield from self._rows(held, open_steps)
        self._waiting.append((no, bars, set(self._steps_of)))

    def terminate(self):
        for _, held, open_steps in self._waiting:
            yield from self._rows(held, open_steps)


def register(spark: SparkSession) -> None:
    """Makes ``session_labels`` known to the session's SQL."""
    spark.udtf.register("session_labels", udtf(SessionLabels))
