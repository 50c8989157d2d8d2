"""Writers: partition replacement, text files per group, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.store import replace_partitions


def write_segments(segments: DataFrame, path: str) -> None:
    """Replaces the stored segments of the chapters the frame has rows for, and no others."""
    replace_partitions(segments, path, ["book_id", "chapter_id"])


def write_bodies(bodies: DataFrame, path: str, by: list[str]) -> None:
    """One text file per row of (by, body), in a folder per group; a body keeps its line ends."""
    bodies.select(*by, "body").write.option("lineSep", "\x00").partitionBy(*by).mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
