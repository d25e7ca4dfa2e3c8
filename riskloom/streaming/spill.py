"""Ordering more rows than a Python worker should hold, with a key's state as the place to put them.

Rows come in chunks. Each chunk is sorted and put away as a run of small blocks; then runs are merged, ``FAN_IN``
at a time, until one merge gives all rows in order. At no time are more than about two chunks in memory,
however many rows a key has in a micro-batch. The blocks are deleted as they are read, within the batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa

FAN_IN = 16


def packed(frame: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class Sorter:
    """Sorts chunks by ``order`` (columns without nulls). ``state`` is a map state from (run, block) to bytes.

    ``peak`` is the largest number of rows that were in memory at once.
    """

    def __init__(self, state, order: Sequence[str], chunk_rows: int) -> None:
        self.state, self.order, self.chunk_rows = state, list(order), chunk_rows
        self.block_rows = max(1, chunk_rows // FAN_IN)
        self.runs: list[int] = []  # blocks of each run still to be read
        self.peak = 0

    def _note(self, rows: int) -> None:
        self.peak = max(self.peak, rows)

    def _put(self, run: int, block: int, frame: pd.DataFrame) -> None:
        self.state.updateValue((run, block), (packed(frame),))

    def _take(self, run: int, block: int) -> pd.DataFrame:
        frame = unpacked(bytes(self.state.getValue((run, block))[0]))
        self.state.removeKey((run, block))
        return frame

    def _pieces(self, chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Chunks of exactly ``chunk_rows`` rows but for the last one, whatever the sizes they come in."""
        held: list[pd.DataFrame] = []
        count = 0
        for chunk in chunks:
            for at in range(0, len(chunk), self.chunk_rows):
                part = chunk.iloc[at : at + self.chunk_rows]
                held.append(part)
                count += len(part)
                self._note(count + len(chunk))
                if count >= self.chunk_rows:
                    whole = pd.concat(held, ignore_index=True)
                    yield whole.iloc[: self.chunk_rows]
                    held, count = [whole.iloc[self.chunk_rows :]], count - self.chunk_rows
        if count:
            yield pd.concat(held, ignore_index=True)

    def sorted(self, chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All rows in order, in frames of at most about a chunk."""
        pieces = self._pieces(chunks)
        first = next(pieces, None)
        if first is None:
            return
        second = next(pieces, None)
        if second is None:  # the usual case: nothing is put away
            yield first.sort_values(self.order, ignore_index=True)
            return
        for piece in (first, second):
            self._store(iter([piece.sort_values(self.order, ignore_index=True)]))
        del first, second
        for piece in pieces:
            self._store(iter([piece.sort_values(self.order, ignore_index=True)]))
        low = 0
        while len(self.runs) - low > FAN_IN:
            group = list(range(low, low + FAN_IN))
            self._store(self._merged(group))
            low += FAN_IN
        yield from self._merged(list(range(low, len(self.runs))))

    def _store(self, frames: Iterator[pd.DataFrame]) -> None:
        run, block = len(self.runs), 0
        for frame in frames:
            for at in range(0, len(frame), self.block_rows):
                self._put(run, block, frame.iloc[at : at + self.block_rows])
                block += 1
        self.runs.append(block)

    def _merged(self, group: list[int]) -> Iterator[pd.DataFrame]:
        """The rows of some runs in order. Rows up to the smallest last key of the blocks at hand are complete."""
        at = {run: 0 for run in group}
        open_runs = {run: None for run in group if self.runs[run]}
        while open_runs:
            for run in list(open_runs):
                if open_runs[run] is None or not len(open_runs[run]):
                    if at[run] == self.runs[run]:
                        del open_runs[run]
                        continue
                    open_runs[run] = self._take(run, at[run])
                    at[run] += 1
            if not open_runs:
                return
            self._note(2 * sum(len(f) for f in open_runs.values()))
            limit = min(
                (tuple(f[c].iloc[-1] for c in self.order) for run, f in open_runs.items() if at[run] < self.runs[run]),
                default=None,
            )
            ready = []
            for run, frame in open_runs.items():
                n = len(frame) if limit is None else _upto(frame, self.order, limit)
                ready.append(frame.iloc[:n])
                open_runs[run] = frame.iloc[n:]
            yield pd.concat(ready, ignore_index=True).sort_values(self.order, ignore_index=True)


def _upto(frame: pd.DataFrame, order: Sequence[str], limit: tuple) -> int:
    """Number of leading rows of a sorted frame whose key is not beyond ``limit``."""
    low, high = 0, len(frame)
    columns = [frame[c].to_numpy() for c in order]
    for values, bound in zip(columns[:-1], limit[:-1]):
        part = values[low:high]
        low, high = low + int(np.searchsorted(part, bound, "left")), low + int(np.searchsorted(part, bound, "right"))
    return low + int(np.searchsorted(columns[-1][low:high], limit[-1], "right"))
