"""Batch handlers for streams: keyed sinks and the dead-letter split."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..sources.contracts import contract_reasons, dead_letters
from ..sources.sinks import write_batch


def keyed_sink(path: str, keys: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Put every batch's last row per key into a versioned table; a batch that is delivered again changes nothing."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id, keys, order)

    return on_batch


def dead_letter_split(valid_path: str, dead_path: str) -> Callable[[DataFrame, int], None]:
    """Send valid parsed messages to one folder and the catalogue rows of the others to a table keyed by event."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        checked = contract_reasons(batch).persist()
        try:
            good = checked.filter("size(violations) = 0").drop("violations", "payload", "malformed")
            good.write.mode("overwrite").parquet(f"{valid_path}/batch={batch_id}")
            bad = dead_letters(checked.filter("size(violations) > 0"))
            write_batch(bad, dead_path, batch_id, ["event_id"], ["source_offset"])
        finally:
            checked.unpersist()

    return on_batch
