"""Progress of running conversions as a stream: lines to percents that never go back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "task string, percent double, message string"


def plain_line(line: Column) -> Column:
    """The line without terminal escapes."""
    return F.regexp_replace(line, "\x1b\\[[0-9;?]*[A-Za-z]", "")


def percent(line: Column) -> Column:
    """The percent that a line tells, as 42% or 21/50, between 0 and 100 with one decimal; null if it tells none."""
    told = F.regexp_extract(line, r"(\d+(?:\.\d+)?)\s*%", 1).try_cast("double")
    done, total = (F.regexp_extract(line, r"(\d+)\s*/\s*(\d+)", i).try_cast("double") for i in (1, 2))
    value = F.coalesce(told, F.try_divide(done * 100, total))
    return F.when(value.isNotNull(), F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0)), 1))


def log_lines(chunks: DataFrame) -> DataFrame:
    """task, line of chunks (task, value): cut at carriage returns and line feeds, blank lines left out."""
    out = chunks.select("task", F.explode(F.split("value", "[\r\n]+")).alias("line"))
    return out.select("task", plain_line(F.col("line")).alias("line")).where(F.trim("line") != "")


def _higher(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    top = state.get[0] if state.exists else -1.0
    for batch in batches:
        rows = []
        for p, message in zip(batch["percent"], batch["line"]):
            if p > top:
                top = p
                rows.append((key[0], p, message))
        if rows:
            yield pd.DataFrame(rows, columns=["task", "percent", "message"])
    state.update((top,))


def monotone_progress(lines: DataFrame) -> DataFrame:
    """A stream of (task, percent, message): lines (task, line) that tell more than any before them. The state is one number for a task."""
    told = lines.select("task", "line", percent(F.col("line")).alias("percent")).where("percent is not null")
    return told.groupBy("task").applyInPandasWithState(_higher, OUT, "top double", "append", GroupStateTimeout.NoTimeout)


def deliver(events: DataFrame, *callbacks, checkpoint: str):
    """Starts a query that hands each batch's rows to every callback."""

    def each(batch: DataFrame, number: int) -> None:
        for row in batch.toLocalIterator():
            for call in callbacks:
                call(row.asDict())

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
