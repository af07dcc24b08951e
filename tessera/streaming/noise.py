"""Noise filters over streams: the state of each key is kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.numeric import filtered, noise_stages


def coloured_noise_stream(df: DataFrame, key: str, order: Sequence[str], value: str, sigma: float, f_min: float, f_knee: float, f_samp: float, slope: float) -> DataFrame:
    """As ``numeric.coloured_noise`` over a stream: key, order and ``filtered`` of every sample.

    Samples of a key are filtered in the order of ``order`` within a micro-batch and of micro-batches among each other,
    so a stream whose samples arrive in order has one result however it is cut. A key's state, two numbers a stage, is in
    Spark's state store and comes back after a restart from the checkpoint. A null value counts as 0.
    """
    stages = noise_stages(f_min, f_knee, f_samp, slope)
    picked = df.select(key, *order, F.col(value).cast("double").alias("_x"))
    fields = {f.name: f.dataType.simpleString() for f in picked.schema.fields[:-1]}
    schema = ", ".join([*[f"`{c}` {t}" for c, t in fields.items()], "filtered double"])

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(list(order), kind="stable")
        held = np.array(state.get[0]).reshape(len(stages), 2) if state.exists else None
        found, after = filtered(stages, rows["_x"].fillna(0.0).to_numpy(), held)
        state.update((after.ravel().tolist(),))
        yield rows[[*fields]].assign(filtered=found * sigma)

    return picked.groupBy(key).applyInPandasWithState(run, schema, "held array<double>", "append", GroupStateTimeout.NoTimeout)
