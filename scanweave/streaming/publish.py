"""A stream of points as frame files: every frame once, however often its batch runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.frames import place_of, write_frame_files


def _ledger(folder: str) -> str:
    return f"{folder.rstrip('/')}/_batches"


def published(folder: str) -> set[int]:
    """The batches that are whole."""
    from pyarrow import fs

    store, top = place_of(_ledger(folder))
    return {int(i.base_name) for i in store.get_file_info(fs.FileSelector(top, allow_not_found=True)) if i.base_name.isdigit()}


def publish_batch(folder: str, kind: str = "cloud", fields: tuple[str, ...] = (), order: tuple[str, ...] = ("x", "y", "z")) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls. A batch that the ledger has is left out; a frame's file is put in place whole, so a batch that
    fails between its files and its entry writes the same files again."""

    def put(batch: DataFrame, number: int) -> None:
        if number in published(folder):
            return
        write_frame_files(batch, folder, kind, fields, order)
        store, top = place_of(_ledger(folder))
        store.create_dir(top, recursive=True)
        with store.open_output_stream(f"{top}/{number}") as f:
            f.write(b"")

    return put


def publish(frames: DataFrame, folder: str, checkpoint: str, kind: str = "cloud", fields: tuple[str, ...] = (), order: tuple[str, ...] = ("x", "y", "z"), once: bool = False) -> StreamingQuery:
    """Starts the sink. A frame's points must arrive in one batch, as they do when a file holds a frame; null frames are left
    out. once: what is there now, else for ever."""
    writer = frames.where(F.col("frame_id").isNotNull()).writeStream.foreachBatch(publish_batch(folder, kind, fields, order)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
