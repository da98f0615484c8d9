"""The causal filter over a stream: state is the terminal alpha and the last time of each series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..models.hmm import HMM, forward

OUTPUT = "series string, time timestamp, p array<double>, ll_inc double, rejected boolean"
STATE = "alpha array<double>, last timestamp"


def filter_stream(stream: DataFrame, model: HMM, features: list[str], series: str, time: str = "ts") -> DataFrame:
    """Every complete row's probabilities, one transition per row.

    A row that isn't later than the last one of its series comes out as rejected and leaves the state alone; an
    incomplete row is no evidence and gives nothing.
    """
    shipped = stream.sparkSession.sparkContext.broadcast(model)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = shipped.value
        alpha, last = (np.array(state.get[0]), pd.Timestamp(state.get[1])) if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("time", kind="stable")
        rows = rows[rows[features].notna().all(axis=1)]
        if not len(rows):
            return
        late = rows["time"].duplicated() | ((rows["time"] <= last) if last is not None else False)
        good = rows[~late]
        out = [pd.DataFrame({"series": key[0], "time": rows["time"][late], "p": None, "ll_inc": np.nan, "rejected": True})]
        if len(good):
            p, inc = forward(m.log_emissions(good[features].to_numpy(float)), m.start, m.transition, alpha)
            out.append(pd.DataFrame({"series": key[0], "time": good["time"].to_numpy(), "p": list(p), "ll_inc": inc, "rejected": False}))
            state.update((p[-1].tolist(), good["time"].iloc[-1].to_pydatetime()))
        yield pd.concat([o for o in out if len(o)])

    rows = stream.select(F.col(series).cast("string").alias("series"), F.col(time).cast("timestamp").alias("time"), *features)
    return rows.groupBy("series").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def hourly_means(stream: DataFrame, value: str, kinds: dict[str, str], kind: str = "event_type", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """ts and the mean value of each kind per closed hour, in append mode behind a watermark: a panel for filter_stream."""
    hours = stream.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w"))
    return hours.agg(*[F.avg(F.when(F.col(kind) == k, F.col(value))).alias(name) for name, k in kinds.items()]).select(F.col("w.start").alias("ts"), *kinds)


def closed_months(panel: DataFrame, time: str = "ts", zone: str = "Europe/Berlin") -> DataFrame:
    """(month, n, closed) of a panel: a calendar month is emitted only when a later one, or its own last day, was seen."""
    from ..functions.columns import local_month

    months = panel.groupBy(local_month(F.col(time), zone).alias("month")).agg(F.count("*").alias("n"), F.max(time).alias("last"))
    end = months.agg(F.max("last").alias("end"))
    local = F.from_utc_timestamp(F.col("end").cast("timestamp"), zone).cast("date")
    return months.crossJoin(F.broadcast(end)).select("month", "n", (local >= F.last_day("month")).alias("closed"))
