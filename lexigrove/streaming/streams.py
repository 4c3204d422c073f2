"""Streams: the parse operator over a stream, windowed counts, and text buffers kept from versioned edits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.parse import parse
from ..plans.ir import Grammar


def parse_stream(stream: DataFrame, column: str, plan: Grammar) -> DataFrame:
    """A stream of texts as a stream of trees and errors: a map, without state."""
    return parse(stream, column, plan)


def windowed_counts(stream: DataFrame, time: str, key: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows by tumbling window and key; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def apply_edit(lines: list[str], l1: int, c1: int, l2: int, c2: int, replacement: str) -> list[str]:
    """Lines with the range from (l1, c1) up to (l2, c2), counted from 0, replaced."""
    if not (0 <= l1 <= l2 < len(lines)) or (l1 == l2 and c1 > c2):
        raise ValueError("no such range")
    new = (lines[l1][:c1] + replacement + lines[l2][c2:]).split("\n")
    return [*lines[:l1], *new, *lines[l2 + 1 :]]


def text_buffers(edits: DataFrame) -> DataFrame:
    """Edits (doc_id long, version int, l1, c1, l2, c2 int, replacement string) as the text of each document after a batch.

    Versions apply in order; one that is not newer than the last is left out. State is one buffer a document.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, version = state.get if state.exists else ("", 0)
        lines = text.split("\n")
        for e in pd.concat(list(frames)).sort_values("version").itertuples():
            if e.version > version:
                try:
                    lines, version = apply_edit(lines, e.l1, e.c1, e.l2, e.c2, e.replacement), int(e.version)
                except ValueError:
                    version = int(e.version)
        text = "\n".join(lines)
        state.update((text, version))
        yield pd.DataFrame({"doc_id": [key[0]], "version": [version], "text": [text]})

    return edits.groupBy("doc_id").applyInPandasWithState(update, "doc_id long, version int, text string", "text string, version int", "update", GroupStateTimeout.NoTimeout)
