"""Groups of records that arrive as a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def running_totals(stream: DataFrame, keys: Sequence[str], count: str = "COUNT") -> DataFrame:
    """(keys..., n_records, n_reads) so far, for the update or complete mode; state is a row a group."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum(count), F.lit(0)).alias("n_reads"))


def closed_groups(stream: DataFrame, lanes: int = 64) -> DataFrame:
    """(lane, CB, UMI, n_records, n_reads) of molecules, each once, when it is complete.

    In a file in order of CB and UMI a molecule is complete as soon as a later one of its lane
    begins. Cells are spread over ``lanes``, in each of which order is kept, so the state is one
    open molecule a lane. A key that falls is an error ``Unsorted busfile``. The last molecule of
    a lane stays open until a later one arrives.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("pos")
        totals = rows.groupby(["CB", "UMI"], sort=False)["COUNT"].agg(["size", "sum"]).reset_index()
        out = []
        for cb, umi, n, reads in totals.itertuples(index=False):
            if held is not None and (held[0], held[1]) == (cb, umi):
                held = (cb, umi, held[2] + int(n), held[3] + int(reads))
                continue
            if held is not None:
                if (held[0], held[1]) > (cb, umi):
                    raise ValueError(f"Unsorted busfile: ({held[0]}, {held[1]}) -> ({cb}, {umi})")
                out.append((key[0], *held))
            held = (int(cb), int(umi), int(n), int(reads))
        state.update(held)
        yield pd.DataFrame(out, columns=["lane", "CB", "UMI", "n_records", "n_reads"]).astype("int64")

    laned = stream.withColumn("lane", F.pmod(F.xxhash64("CB"), F.lit(lanes)).cast("bigint"))
    shape = "CB long, UMI long, n_records long, n_reads long"
    return laned.groupBy("lane").applyInPandasWithState(step, f"lane long, {shape}", shape, "append", "NoTimeout")
