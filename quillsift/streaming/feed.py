"""Files that land in a folder, and a feed of status changes, as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import files

BINARY = "path string, modificationTime timestamp, length long, content binary"


def landing(spark: SparkSession, path: str) -> DataFrame:
    """A stream of rows as files.load() gives them, one for each new file; bad files are rows with their error."""
    return files.convert(spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(path))


def write_once(stream: DataFrame, path: str, checkpoint: str):
    """Appends each file's row once; `checkpoint` remembers which files were seen."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_changes(events: DataFrame, key: str, order: str, status: str, idle: str = "600 seconds") -> DataFrame:
    """A stream of the events whose status differs from the last one of their key; a key that is idle is forgotten."""
    schema = events.schema
    names = schema.names
    wait = int(idle.split()[0]) * 1000

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        changed = rows[status].ne(rows[status].shift(fill_value=last) if last is not None else rows[status].shift())
        state.update((rows[status].iloc[-1],))
        state.setTimeoutDuration(wait)
        yield rows.loc[changed, names]

    return events.groupBy(key).applyInPandasWithState(run, schema, "last string", "append", GroupStateTimeout.ProcessingTimeTimeout)
