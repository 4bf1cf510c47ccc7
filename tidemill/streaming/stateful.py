"""Streams that keep a state for each series: cleaning rows as they arrive, and KPIs of closed periods.

State is small and bounded: a series holds what may still change (times or
periods that the watermark has not passed) and a few numbers about the rest.
Each micro-batch is written to a folder of its own, overwritten if the batch is
repeated; the latest version of a row counts, so retries leave no duplicates.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import clock_seconds
from ..operators.clean import TIME_FORMATS, parse_time, to_number
from ..operators.trend import grade_kpis
from ..schema import require_roles

_EPOCH = dt.date(1970, 1, 1)


def _keys_of(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _start(rows: DataFrame, out: str, checkpoint: str, once: bool, interval: str) -> StreamingQuery:
    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version={batch_id}")

    writer = rows.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def _versions(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/version=*")
    if not pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("version", T.LongType())]))
    read = spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.LongType())]))
    return read.option("basePath", out).parquet(f"{out}/version=*")


# ---- cleaning -------------------------------------------------------------------------------


class OpenTimes:
    """The state of one series while its rows are cleaned.

    Each open time keeps its first and its last present value (by ``seq``); the
    last known value of the closed ones is carried on. Closed times from before
    any known value wait for it.
    """

    def __init__(self, saved: str | None):
        at = json.loads(saved) if saved else {}
        self.open = {int(t): v for t, v in at.get("open", {}).items()}  # time -> [last seq, last, first seq, first, shown]
        self.waiting: list[int] = at.get("waiting", [])
        self.carried: str | None = at.get("carried")
        self.closed: int | None = at.get("closed")

    def saved(self) -> str:
        return json.dumps({"open": self.open, "waiting": self.waiting, "carried": self.carried, "closed": self.closed})

    def add(self, time: int, seq: int, value: str | None) -> bool:
        """Take a row in; False if its time is closed."""
        if self.closed is not None and time <= self.closed:
            return False
        at = self.open.setdefault(time, [None, None, None, None, None])
        if value is not None:
            if at[0] is None or seq >= at[0]:
                at[0], at[1] = seq, value
            if at[2] is None or seq < at[2]:
                at[2], at[3] = seq, value
        return True

    def changes(self) -> list[tuple[int, str]]:
        """(time, value) of times whose filled value is new or another one than shown before."""
        out, known, leading = [], self.carried, list(self.waiting)
        for t in sorted(self.open):
            at = self.open[t]
            if at[1] is None and known is None:
                leading.append(t)
                continue
            if known is None:  # the first known value fills what comes before it
                for early in leading:
                    if early not in self.open or self.open[early][4] != at[3]:
                        out.append((early, at[3]))
                    if early in self.open:
                        self.open[early][4] = at[3]
            known = known if at[1] is None else at[1]
            if at[4] != known:
                out.append((t, known))
                at[4] = known
        return out

    def close(self, until: int) -> None:
        """Close all times up to ``until``; call after :meth:`changes`."""
        for t in sorted(t for t in self.open if t <= until):
            at = self.open.pop(t)
            if at[1] is not None:
                self.carried, self.waiting = at[1], []
            elif self.carried is None:
                self.waiting.append(t)
        self.closed = until if self.closed is None else max(self.closed, until)


def clean_stream(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    seq: str,
    keys: Sequence[str] = (),
    ts: str | None = None,
    y: str | None = None,
    late: str = "1 day",
    formats: Sequence[str] = TIME_FORMATS,
    once: bool = True,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Clean rows as they arrive, with the rules of :func:`operators.clean.clean`: read the result by :func:`cleaned`.

    Each time keeps its last present value by the whole number ``seq``, missing
    values are filled forward and, before the first known value, backward. A
    row that arrives later than ``late`` behind the newest one changes nothing
    any more and is put out as late, to be counted. Rows without a time are
    dropped; values that are no numbers are carried and dropped on reading, as
    in batch. Without keys the whole stream is one series.
    """
    if ts is None or y is None:
        ts, y = require_roles([c for c in stream.columns if c not in (*keys, seq)])
    by = list(keys) or ["_all"]
    typed = stream.select(*keys, parse_time(stream, ts, formats).alias("_t"), F.col(y).cast("string").alias("_raw"), F.col(seq).cast("bigint").alias("_seq"))
    typed = typed.withColumn("_all", F.lit(0)) if not keys else typed
    rows = typed.where(F.col("_t").isNotNull()).select(*by, F.timestamp_seconds(clock_seconds("_t")).alias("_ts"), "_raw", F.coalesce("_seq", F.lit(0)).alias("_seq"))
    fields = _keys_of(rows, by) + [T.StructField("seconds", T.LongType()), T.StructField("value", T.StringType()), T.StructField("is_late", T.BooleanType())]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = OpenTimes(state.get[0] if state.exists else None)
        watermark = state.getCurrentWatermarkMs() // 1000
        if watermark > 0:
            held.close(watermark - 1)
        late = []
        for pdf in batches:
            seconds = pdf["_ts"].astype("datetime64[us]").astype("int64") // 1_000_000
            for t, n, v in zip(seconds.tolist(), pdf["_seq"].tolist(), pdf["_raw"].tolist()):
                if not held.add(t, n, None if v is None or v != v else v):
                    late.append((t, v))
        made = [(t, v, False) for t, v in held.changes()] + [(t, v, True) for t, v in late]
        state.update((held.saved(),))
        if made:
            frame = pd.DataFrame(made, columns=["seconds", "value", "is_late"])
            yield pd.DataFrame({**{k: [v] * len(frame) for k, v in zip(by, key)}, **{c: frame[c] for c in frame}})

    timed = rows.withWatermark("_ts", late)
    made = timed.groupBy(*by).applyInPandasWithState(step, T.StructType(fields), "state string", "update", GroupStateTimeout.NoTimeout)
    return _start(made, out, checkpoint, once, interval)


def _cleaned_schema(key_fields: Sequence[T.StructField]) -> T.StructType:
    return T.StructType([*key_fields, T.StructField("seconds", T.LongType()), T.StructField("value", T.StringType()), T.StructField("is_late", T.BooleanType())])


def cleaned(spark: SparkSession, out: str, keys: Sequence[T.StructField] = ()) -> DataFrame:
    """(keys, ts, y): the rows of a cleaning stream as of its last batch. ``keys`` are the fields of the series' keys."""
    fields = list(keys) or [T.StructField("_all", T.IntegerType())]
    names = [f.name for f in fields]
    rows = _versions(spark, out, _cleaned_schema(fields)).where("NOT is_late")
    last = rows.groupBy(*names, "seconds").agg(F.max_by("value", "version").alias("value"))
    moment = F.expr("timestamp_ntz '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, seconds)")
    return last.select(*[f.name for f in keys], moment.alias("ts"), to_number("value").alias("y")).where("y IS NOT NULL")


def late_rows(spark: SparkSession, out: str, keys: Sequence[T.StructField] = ()) -> DataFrame:
    """(keys, n_late): rows of a cleaning stream that came too late."""
    fields = list(keys) or [T.StructField("_all", T.IntegerType())]
    rows = _versions(spark, out, _cleaned_schema(fields)).where("is_late")
    return rows.groupBy(*[f.name for f in keys]).agg(F.count("*").alias("n_late"))


# ---- KPIs -----------------------------------------------------------------------------------

YEAR_ROWS = 13  # values that the year-on-year rate needs
SLOPE_ROWS = 6
_FACTS = T.StructType(
    [T.StructField("total_periods", T.LongType()), T.StructField("start_ts", T.DateType()), T.StructField("end_ts", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in ("current_value", "previous_value", "_year_ago", "avg_value", "recent_slope", "volatility")]
    + [T.StructField("n_late", T.LongType())]
)


def _period(day: dt.date, freq: str) -> int:
    """The number of a day's period: days, weeks from Monday on, or months."""
    days = (day - _EPOCH).days
    return {"D": days, "W": (days + 3) // 7, "M": day.year * 12 + day.month - 1}[freq]


def _first_day(period: int, freq: str) -> dt.date:
    if freq == "M":
        return dt.date(period // 12, period % 12 + 1, 1)
    return _EPOCH + dt.timedelta(days=period if freq == "D" else 7 * period - 3)


class OpenPeriods:
    """The state of one series while its KPIs are kept: sums of open periods, and moments and last values of the closed ones."""

    def __init__(self, saved: str | None, digits: int | None = None):
        at = json.loads(saved) if saved else {}
        self.open = {int(p): v for p, v in at.get("open", {}).items()}
        self.n, self.mean, self.m2 = at.get("n", 0), at.get("mean", 0.0), at.get("m2", 0.0)
        self.last: list[float] = at.get("last", [])
        self.first, self.next, self.late, self.digits = at.get("first"), at.get("next"), at.get("late", 0), digits

    def saved(self) -> str:
        return json.dumps({k: getattr(self, k) for k in ("open", "n", "mean", "m2", "last", "first", "next", "late")})

    def add(self, period: int, value: float | None) -> None:
        """Take a row in; a missing value opens its period and adds nothing."""
        if self.next is not None and period < self.next:
            self.late += 1
        else:
            self.open[period] = self.open.get(period, 0.0) + (value or 0.0)

    def close(self, before: int) -> bool:
        """Close all periods before ``before`` of which a later or the same one has rows; a period without rows between others counts 0."""
        if not self.open:
            return False
        start = min(self.open) if self.next is None else self.next
        end = min(before, max(self.open) + 1)
        for period in range(start, end):
            value = self.open.pop(period, 0.0)
            value = value if self.digits is None else round(value, self.digits)
            self.n += 1
            step = value - self.mean
            self.mean += step / self.n
            self.m2 += step * (value - self.mean)
            self.last = [*self.last, value][-YEAR_ROWS:]
        if end > start:
            self.first, self.next = start if self.first is None else self.first, end
        return end > start

    def waits_for(self) -> int | None:
        """The period whose end is waited for, if any."""
        return None if not self.open else min(self.open) if self.next is None else self.next

    def facts(self, freq: str) -> tuple:
        near = np.array(self.last[-SLOPE_ROWS:])
        x = np.arange(len(near)) - (len(near) - 1) / 2
        slope = float((x * near).sum() / (x * x).sum()) if len(near) > 1 else None
        spread = float(np.sqrt(self.m2 / (self.n - 1))) * 100 / self.mean if self.n > 1 and self.mean else None
        ends = [_first_day(p, freq) - dt.timedelta(days=1) for p in (self.first + 1, self.next)]
        year = self.last[-YEAR_ROWS] if len(self.last) == YEAR_ROWS else None
        return self.n, *ends, self.last[-1], self.last[-2] if self.n > 1 else self.last[-1], year, self.mean, slope, spread, self.late


def kpi_stream(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    keys: Sequence[str],
    ts: str = "ts",
    y: str = "y",
    freq: str = "M",
    late: str = "1 day",
    digits: int | None = None,
    once: bool = True,
    interval: str = "1 minute",
) -> StreamingQuery:
    """KPIs of each series after every period that closes (D, W or M): read the latest by :func:`kpis_now`.

    A period closes when the newest time less ``late`` passes its end, also
    for series that have no new rows. Period sums are rounded to ``digits``, if
    given. State holds the sums of open periods, the moments of the closed ones
    and the last 13 values. Rows of a closed period are counted in ``n_late``
    where they reach the series, and otherwise by Spark's own progress reports
    (:func:`rows_too_late`).
    """
    rows = stream.select(*keys, F.timestamp_seconds(clock_seconds(ts)).alias("_ts"), F.col(y).cast("double").alias("_y")).where("_ts IS NOT NULL")
    schema = T.StructType(_keys_of(rows, keys) + _FACTS.fields)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = OpenPeriods(state.get[0] if state.exists else None, digits)
        if not state.hasTimedOut:
            for pdf in batches:
                days = pdf["_ts"].astype("datetime64[us]").dt.date
                for day, value in zip(days, pdf["_y"].tolist()):
                    held.add(_period(day, freq), None if value is None or value != value else value)
        watermark = state.getCurrentWatermarkMs()
        closed = watermark > 0 and held.close(_period(_EPOCH + dt.timedelta(days=watermark // 86_400_000), freq))
        state.update((held.saved(),))
        if (period := held.waits_for()) is not None:
            end = (_first_day(period + 1, freq) - _EPOCH).days * 86_400_000
            state.setTimeoutTimestamp(max(end, watermark + 1))
        if closed:
            yield pd.DataFrame([(*key, *held.facts(freq))], columns=[f.name for f in schema.fields])

    timed = rows.withWatermark("_ts", late)
    made = timed.groupBy(*keys).applyInPandasWithState(step, schema, "state string", "update", GroupStateTimeout.EventTimeTimeout)
    return _start(made, out, checkpoint, once, interval)


def kpis_now(spark: SparkSession, out: str, keys: Sequence[T.StructField]) -> DataFrame:
    """The KPIs of each series after its last closed period, with the columns of :func:`operators.trend.kpis` and n_late."""
    rows = _versions(spark, out, T.StructType([*keys, *_FACTS.fields]))
    names = [f.name for f in keys]
    newest = F.row_number().over(Window.partitionBy(*names).orderBy(F.desc("version")))
    return grade_kpis(rows.withColumn("_newest", newest).where("_newest = 1").drop("_newest", "version"))


def rows_too_late(query: StreamingQuery) -> int:
    """Rows that the watermark kept from a stream's state, by its recent progress reports."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in json.loads(p.json if hasattr(p, "json") else json.dumps(p))["stateOperators"])
