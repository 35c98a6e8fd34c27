"""The keyed, ordered fold: ``(key, order, state, step)``, written once and run in batch or as a stream.

A machine is a class without arguments to its constructor call (use ``functools.partial`` for parameters). Calling it with a
row gives output tuples; ``finish`` gives those due at the end of the key. All its state is in its attributes, so a stream can
keep it between batches. In batch, rows are hash-partitioned by key, sorted within the partition (spilling if need be) and
read as one run of record batches: a key's rows are never held together, and the state is all that is kept of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Machine:
    """Base of fold machines."""

    def __call__(self, row: tuple) -> Iterable[tuple]:
        raise NotImplementedError

    def finish(self) -> Iterable[tuple]:
        return ()


def _rows(pdf: pd.DataFrame, columns: list[str]) -> Iterator[tuple]:
    return zip(*(_plain(pdf[c]) for c in columns), strict=True)


def _plain(values: pd.Series) -> list:
    out = values.to_list()
    if values.dtype == object or not values.hasnans:
        return out
    return [None if x is pd.NA or x != x else x for x in out]


def fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], machine: Callable[[], Machine], schema: str) -> DataFrame:
    """Output tuples of ``machine`` over ``columns`` of each key's rows in ``order``, behind the key's columns.

    ``schema`` names and types the tuples. Rows with a null in ``order`` come first, as Spark sorts them. An empty table gives
    no rows; other columns are ignored.
    """
    key_fields = [df.schema[k] for k in keys]
    fields = key_fields + list(T.StructType.fromDDL(schema).fields)
    names = [f.name for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, None
        for pdf in batches:
            out = []
            ks = list(zip(*(pdf[k] for k in keys), strict=True))
            for k, row in zip(ks, _rows(pdf, columns), strict=True):
                if now is None or k != key:
                    if now is not None:
                        out += [(*key, *x) for x in now.finish()]
                    key, now = k, machine()
                out += [(*k, *x) for x in now(row)]
            yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame([(*key, *x) for x in now.finish()], columns=names)

    # Ties in ``order`` are settled by the other columns, so a task that runs again folds alike.
    ties = [c for c in columns if c not in order and not isinstance(df.schema[c].dataType, T.ArrayType | T.StructType | T.MapType)]
    parts = df.select(*keys, *[c for c in dict.fromkeys(columns + order) if c not in keys]).repartition(*keys)
    return parts.sortWithinPartitions(*keys, *order, *ties).mapInPandas(run, T.StructType(fields))


def stream_fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], machine: Callable[[], Machine], schema: str, time: str | None = None, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """The same fold over a streaming DataFrame; a machine's attributes are the state kept per key between batches.

    With ``time``, a column of event time: rows later than the watermark (``late`` behind the newest) are left out; rows wait in
    the state until the watermark has passed them and are folded in ``order`` then, whatever batches they came in; a key without
    rows for ``idle_ms`` beyond that gives what its machine has left to give, and its state is dropped. Without ``time``, rows are
    ordered within a batch only, one that comes in a later batch than a row after it is folded when it comes, and state stays."""
    key_fields = [df.schema[k] for k in keys]
    fields = key_fields + list(T.StructType.fromDDL(schema).fields)
    names = [f.name for f in fields]
    sent = [c for c in dict.fromkeys(columns + order) if c not in keys]

    def fold_rows(now: Machine, pdf: pd.DataFrame, key: tuple) -> list[tuple]:
        return [(*key, *x) for row in _rows(pdf.sort_values(order, kind="stable"), columns) for x in now(row)]

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = machine()
        if state.exists:
            now.__dict__ = pickle.loads(state.get[0])
        out = fold_rows(now, pd.concat(list(pdfs)), key)
        state.update((pickle.dumps(now.__dict__),))
        if out:  # an empty frame would blur the types of those it is put together with
            yield pd.DataFrame(out, columns=names)

    def run_in_time(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, waiting = machine(), None
        if state.exists:
            now.__dict__, waiting = pickle.loads(state.get[0])
        passed, timed_out = state.getCurrentWatermarkMs(), state.hasTimedOut
        parts = [p for p in [waiting, *([] if timed_out else pdfs)] if p is not None and len(p)]
        rows = pd.concat(parts) if parts else pd.DataFrame(columns=[*sent, "_ms"])
        ready = rows["_ms"] <= passed if len(rows) else pd.Series([], dtype=bool)
        out = fold_rows(now, rows[ready.to_numpy(bool)], key) if len(rows) else []
        rows = rows[~ready.to_numpy(bool)] if len(rows) else rows
        if timed_out and not len(rows) and passed >= state.get[1]:
            out += [(*key, *x) for x in now.finish()]
            state.remove()
        else:
            last = int(rows["_ms"].max()) + idle_ms if len(rows) else state.get[1] if state.exists else passed + idle_ms
            last = max(last, state.get[1]) if state.exists else last
            state.update((pickle.dumps((now.__dict__, rows)), last))
            # Woken when the next waiting row is due, else when the key has been idle for long enough.
            state.setTimeoutTimestamp(max(int(rows["_ms"].min()) if len(rows) else last, passed + 1))
        if out:  # an empty frame would blur the types of those it is put together with
            yield pd.DataFrame(out, columns=names)

    if time is None:
        return df.select(*keys, *sent).groupBy(*keys).applyInPandasWithState(run, T.StructType(fields), "state binary", "append", "NoTimeout")
    rows = df.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    rows = rows.select(*keys, *sent, F.unix_millis("_time").alias("_ms"), "_time")
    return rows.groupBy(*keys).applyInPandasWithState(run_in_time, T.StructType(fields), "state binary, until long", "append", "EventTimeTimeout")
