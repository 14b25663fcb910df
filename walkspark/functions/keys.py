"""Keys of walks and tracks. A slug is unique within its source, and a walk may have several tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame

WALK, TRACK = ("source", "slug"), ("source", "slug", "track_no")


def key_of(*frames: DataFrame, of: tuple[str, ...] = WALK) -> list[str]:
    """The columns of the key that all frames have. Frames of one source, or of main tracks alone, may leave out the others."""
    key = [c for c in of if all(c in df.columns for df in frames)]
    if "slug" not in key:
        raise ValueError("no slug to go by")
    return key


def track_key(*frames: DataFrame) -> list[str]:
    return key_of(*frames, of=TRACK)
