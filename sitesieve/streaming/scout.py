"""The scout on a stream of kept documents, with the state of each site in the state store of the engine.

A site has its measures, the values of its ``distinct`` measures until it is judged, and then one verdict. State is keyed on the site and kept by the engine with its checkpoint: a query started again goes on from there,
and nothing but the documents that pass is written. Rows are narrow (a document meets its text again by ``fetch_seq``); rows of a judged site
pass in Arrow batches as they come, those of an open one are put in order first, so a task holds at most the narrow rows of one site in one batch of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import SieveConfig
from ..operators.scout import SitePolicy, language_policy, measured

_UNJUDGED, _KEEP, _STOP = 0, 1, 2


def _fold(policy: SitePolicy, rows: pd.DataFrame, numbers: dict[str, int | None], seen: dict[str, set[str]]) -> pd.DataFrame:
    """State after each of the rows, which are in order; ``numbers`` and ``seen`` are the state before and are brought up to date."""
    states = {}
    for name, measure in policy.measures.items():
        values, start = rows[name], numbers[name]
        if measure.merge == "distinct":
            known = seen[name]
            new = values.notna() & ~values.duplicated() & ~values.isin(known)
            known.update(values[new])
            states[name] = new.astype("int64").cumsum() + (start or 0)
        elif measure.merge == "sum":
            states[name] = values.fillna(0).astype("int64").cumsum() + (start or 0)
        else:
            running = values.cummin().ffill() if measure.merge == "min" else values.cummax().ffill()
            if start is not None:
                running = running.fillna(start).clip(upper=start) if measure.merge == "min" else running.fillna(start).clip(lower=start)
            states[name] = running
        last = states[name].iloc[-1]
        numbers[name] = None if pd.isna(last) else int(last)
    return pd.DataFrame(states)


def scouted(kept: DataFrame, policy: SitePolicy) -> DataFrame:
    """Documents of a stream that pass: those of a site up to the one that decides against it, all of a site that is kept or open.

    Documents have to arrive in the order of ``fetch_seq`` from batch to batch; within a batch their order does not matter.
    """
    names = list(policy.measures)
    distinct = [n for n in names if policy.measures[n].merge == "distinct"]
    columns = kept.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            verdict, stop, *rest = state.get
        else:
            verdict, stop, rest = _UNJUDGED, None, [None] * len(names) + [[]] * len(distinct)
        numbers = dict(zip(names, rest))
        seen = {n: set(values) for n, values in zip(distinct, rest[len(names) :])}
        if verdict == _UNJUDGED:
            rows = pd.concat(list(batches), ignore_index=True).sort_values("fetch_seq", kind="stable", ignore_index=True)
            states = _fold(policy, rows, numbers, seen)
            ready = policy.ready(states)
            if ready.any():
                at = int(ready.to_numpy().argmax())
                verdict = _KEEP if bool(policy.keep(states.iloc[at : at + 1]).iloc[0]) else _STOP
                if verdict == _STOP:
                    stop = int(rows["fetch_seq"].iloc[at])
                # the state at the decision; the values are no longer needed
                numbers = {n: None if pd.isna(v := states[n].iloc[at]) else int(v) for n in names}
                seen = {n: set() for n in distinct}
            batches = iter([rows])
        for rows in batches:
            passing = rows[rows["fetch_seq"] <= stop] if verdict == _STOP else rows
            if len(passing):
                yield passing[columns]
        state.update((verdict, stop, *(numbers[n] for n in names), *(sorted(seen[n]) for n in distinct)))

    kinds = [f"n{i} bigint" for i in range(len(names))] + [f"seen{i} array<string>" for i in range(len(distinct))]
    grouped = measured(kept.select(*columns), policy).groupBy("site")
    output = ", ".join(f"`{name}` {kind}" for name, kind in kept.dtypes)
    return grouped.applyInPandasWithState(
        step, output, ", ".join(["verdict int", "stop_seq bigint", *kinds]), "append", GroupStateTimeout.NoTimeout
    )


def stream_scout(kept: DataFrame, config: SieveConfig, path: str, state: str, policy: SitePolicy | None = None) -> StreamingQuery:
    """Start the scout over the documents that are available, with the checkpoint of its state in ``state``; documents that pass are appended to ``path``."""
    passing = scouted(kept, language_policy(config) if policy is None else policy)
    return (
        passing.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", f"{state}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def read_scouted(spark: SparkSession, path: str) -> DataFrame:
    """Documents that passed, of all batches."""
    return spark.read.parquet(path)
