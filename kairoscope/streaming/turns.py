"""Numbering of the turns of a stream by keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoscope.session import scratch_path

_OUT = "session_id string, turn_index int, number int"


def _number(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    """The next numbers of one session; the state is how many it has."""
    count = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches)).sort_values("turn_index")
    state.update((count + len(rows),))
    yield pd.DataFrame({"session_id": key[0], "turn_index": rows["turn_index"].astype("int32"), "number": range(count, count + len(rows))})


def number_turns(stream: DataFrame) -> DataFrame:
    """session_id, turn_index, number for a stream of turns; a session goes on where its last batch ended.

    Within a batch the turn index orders a session's turns. A batch of one session is held at once, so
    the source's rate per trigger bounds the memory.
    """
    return stream.select("session_id", "turn_index").groupBy("session_id").applyInPandasWithState(_number, _OUT, "count long", "append", "NoTimeout")


def number_table(spark: SparkSession, path: str) -> DataFrame:
    """Runs the stream over a table's files until it has no more and returns what it wrote."""
    # As a pattern, the path may name a single file, which a stream does not take otherwise.
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    turns = source.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("turn_index"))
    out = scratch_path(spark, "numbered")
    number_turns(turns).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(_OUT).parquet(out)
