"""A stream of changes applied to a vector index, batch by batch.

Changes are rows (op, id, embedding): insert, remove, restore, reinsert. Within a micro-batch they
apply in that order, and are published as one version of the index, which names the batch: readers see
all of a batch or nothing, and one that is replayed after a failure is skipped if it was published. An
index follows one stream, from one checkpoint. No event-time semantics are claimed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import VectorIndex

CHANGE = "op string, id bigint, embedding array<float>"
ORDER = ("insert", "remove", "restore", "reinsert")


def apply_changes(index: VectorIndex, changes: DataFrame) -> tuple[dict[str, int], VectorIndex]:
    """(how many ids each op accepted, the index after all of them)."""
    accepted = {}
    for op in ORDER:
        own = changes.where(changes["op"] == op)
        accepted[op], index = getattr(index, op)(own.select("id", "embedding") if op in ("insert", "reinsert") else own.select("id"))
    return accepted, index


def writer(path: str, seen: Callable[[int, dict[str, int]], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that keeps the index at path up to date."""

    def apply(changes: DataFrame, batch: int) -> None:
        index = VectorIndex.open(changes.sparkSession, path)
        if batch <= index.manifest.applied:
            return
        changes = changes.persist()
        try:
            accepted, staged = apply_changes(index.staged(), changes)
            staged.publish(applied=batch)
        finally:
            changes.unpersist()
        if seen is not None:
            seen(batch, accepted)

    return apply


def follow(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start applying a stream of changes; pass availableNow=True or processingTime=... for the trigger."""
    return stream.writeStream.foreachBatch(writer(path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
