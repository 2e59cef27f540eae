"""Streams of blocks and packets to frames (F rows)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwake.operators import ranges


def by_angle(blocks: DataFrame, split: int = 0, order: str = "seq") -> DataFrame:
    """blocks with frame, the number of times that the stream's azimuth has passed the split angle so far.

    An azimuth below the one before has gone round, so the one before counts 36000 less; the first is compared with the split. Azimuths must not be null.
    """

    def passed(now: np.ndarray, before: np.ndarray, first: np.ndarray) -> np.ndarray:
        low = np.where(first, split, before)
        low = np.where(now < low, low - 36000, low)
        return (low < split) & (split <= now)

    return ranges.scan(blocks, "stream_id", order, F.col("azimuth").cast("bigint"), "frame", passed)


def by_count(blocks: DataFrame, most: int, order: str = "seq") -> DataFrame:
    """every most-th block begins a frame and belongs to it."""
    return ranges.numbered(blocks, "stream_id", order, "frame").withColumn("frame", F.floor((F.col("frame") + 1) / most))


def by_marker(rows: DataFrame, marker: str = "marker", order: str = "seq") -> DataFrame:
    """a marker closes a frame; markers themselves are left out."""
    return ranges.running_sum(rows, "stream_id", order, F.col(marker).cast("int"), "frame").where(~F.col(marker))


class SequenceSplitter:
    """frames from packet numbers that start anew, with a tolerance for late packets."""

    def __init__(self, previous: int = 0, largest: int = 0, looped: bool = False, band: int = 10):
        self.previous, self.largest, self.looped, self.band = previous, largest, looped, band

    def take(self, seq: int) -> tuple[bool, bool]:
        """(whether a frame begins with this packet, whether it is complete with it)."""
        self.largest = max(self.largest, seq)
        low = max(0, self.previous - self.band)
        begins = seq < low
        if begins:
            self.previous, self.looped = seq, True
        elif self.previous <= seq <= self.previous + self.band or (seq > self.previous and self.previous == 0):
            self.previous = seq
        return begins, self.looped and seq == self.largest


def by_sequence(packets: DataFrame, order: str = "arrival", band: int = 10) -> DataFrame:
    """packets with frame, and complete, which marks those with which a frame can be sent at once: the largest number so far, after the first turn. Late packets stay in the current frame.

    A stream's packets are read in order, batch by batch.

    The streams are dealt to tasks and sorted there, so that a task holds a batch and a few numbers and no whole stream.
    """
    schema = T.StructType([*packets.schema.fields, T.StructField("frame", T.IntegerType()), T.StructField("complete", T.BooleanType())])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, splitter, frame = object(), None, 0
        for batch in batches:
            frames, complete = [], []
            for s, q in zip(batch["stream_id"], batch["seq"]):
                if s != stream:
                    stream, splitter, frame = s, SequenceSplitter(band=band), 0
                begins, whole = splitter.take(int(q))
                frame += begins
                frames.append(frame)
                complete.append(whole)
            yield batch.assign(frame=pd.Series(frames, index=batch.index, dtype="int32"), complete=pd.Series(complete, index=batch.index, dtype="bool"))

    return packets.repartition("stream_id").sortWithinPartitions("stream_id", order).mapInPandas(split, schema)


def emit(framed: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """one row for each non-empty frame: its number in the stream, first and last time, width and height; a dense frame is one row high."""
    rows = framed.groupBy("stream_id", "frame").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("width"))
    return ranges.numbered(rows, "stream_id", "frame", "number").withColumn("height", F.lit(1))


def count_windows(rows: DataFrame, every: int, order: str = "seq") -> DataFrame:
    """Rows with run, the number of the tumbling window of `every` rows of a stream."""
    return ranges.numbered(rows, "stream_id", order, "run").withColumn("run", F.floor(F.col("run") / every))
