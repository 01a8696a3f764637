"""Carry-forward per subject over a Structured Streaming source.

The batch operator (``impute.locf``) fills a whole table.  When subject rows
arrive over time, the same fill runs incrementally: the state per subject is
the last observed value of every column, kept by ``applyInPandasWithState``
between micro-batches (checkpointed with the query).  Rows of one subject
must arrive in visit order across micro-batches; within a batch they are
sorted by visit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructField, StructType


def locf_stream(events: DataFrame, subject: str, visit: str, cols: Sequence[str]) -> DataFrame:
    cols = list(cols)
    schema = events.schema
    out_schema = StructType([schema[subject], schema[visit]] + [schema[c] for c in cols])
    state_schema = StructType([StructField(f"last_{c}", schema[c].dataType, True) for c in cols])

    def fill(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(visit)
        last = list(state.get) if state.exists else [None] * len(cols)
        out = pdf[[subject, visit] + cols].copy()
        for i, c in enumerate(cols):
            s = out[c].astype(object).where(out[c].notna(), None)
            if last[i] is not None and len(s) and s.iloc[0] is None:
                s.iloc[0] = last[i]
            s = s.ffill()
            out[c] = s
            lv = s.dropna()
            if len(lv):
                v = lv.iloc[-1]
                last[i] = v.item() if hasattr(v, "item") else v
        state.update(tuple(last))
        yield out

    return events.groupBy(subject).applyInPandasWithState(
        fill, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)
