"""Sum-of-squares online packing (operator 3).

Documents stream through each task.  Whole windows are cut off long documents;
what remains goes to the fill level that keeps the sum of squared counts of
partially filled windows smallest (Csirik et al., the sum-of-squares rule),
tracked in one array over levels.  A task that has read all its rows closes its
open windows: the fullest are topped up with cut pieces of the emptiest, and
the last one is dealt to windows whose fill is a power of two, which need no
padding.  No row leaves its task, so the job has no shuffle, and a task that is
run again gives the same windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.llm import common, tokens

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
ROWS, BYTES = 4000, 4 << 20


class LevelPacker:
    """Packs (doc_id, ids) into windows of ``size``; ``emit`` gets the pieces
    (doc_id, start, ids, doc_tokens) of each finished window.

    At most max_open windows are open at once (4 max_open size bytes).  Where
    documents leave more unfilled, such as remainders of more than half a window
    alone, all open windows are finished as at the end, by ``close``, and the
    rule begins anew.
    """

    def __init__(self, size: int, emit, max_open: int = 4096):
        self.size, self.emit, self.max_open = size, emit, max_open
        self.count = np.zeros(size + 1, dtype=np.int64)  # of open windows at each fill; ends stay 0
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        at = n - n % self.size
        for start in range(0, at, self.size):
            self.emit([(doc_id, start, ids[start : start + self.size], n)])
        if at < n:
            self._place((doc_id, at, ids[at:], n))

    def level(self, need: int) -> int:
        """The fill to place on: 0 is a new window."""
        top = self.size - need
        # from level h to h + need: (count[h+need] + 1)^2 - count[h+need]^2 + (count[h] - 1)^2 - count[h]^2
        cost = 2 * (self.count[need : self.size + 1] - self.count[: top + 1]) + 2
        cost[0] = 2 * self.count[need] + 1
        cost[top] -= 2 * self.count[self.size] + 1  # a full window is no longer counted
        usable = self.count[: top + 1] > 0
        usable[0] = True
        cost[~usable] = np.iinfo(np.int64).max
        return top - int(np.argmin(cost[::-1]))  # of equal costs the fullest

    def _place(self, piece) -> None:
        need = len(piece[2])
        at = self.level(need)
        if at:
            window = self.open[at].pop()
            self.count[at] -= 1
        else:
            window = []
            self.n_open += 1
        window.append(piece)
        fill = at + need
        if fill == self.size:
            self.emit(window)
            self.n_open -= 1
            return
        self.open.setdefault(fill, []).append(window)
        self.count[fill] += 1
        if self.n_open > self.max_open:
            self.close()

    def close(self) -> None:
        """Finishes all open windows without padding."""
        windows = [(fill, w) for fill in sorted(self.open, reverse=True) for w in self.open[fill]]
        self.open, self.n_open = {}, 0
        self.count[:] = 0
        i, j = 0, len(windows) - 1
        fills = [f for f, _ in windows]
        while i < j:
            gap = self.size - fills[i]
            if not gap:
                self.emit(windows[i][1])
                i += 1
            elif not fills[j]:
                j -= 1
            else:
                doc_id, start, ids, n = windows[j][1].pop()
                if len(ids) > gap:
                    windows[j][1].append((doc_id, start, ids[: len(ids) - gap], n))
                    start, ids = start + len(ids) - gap, ids[len(ids) - gap :]
                windows[i][1].append((doc_id, start, ids, n))
                fills[i] += len(ids)
                fills[j] -= len(ids)
        if windows and fills[i]:
            self._powers(windows[i][1], fills[i])

    def _powers(self, window: list, fill: int) -> None:
        left = list(reversed(window))
        for bit in reversed(range(fill.bit_length())):
            room, out = fill & 1 << bit, []
            while room:
                doc_id, start, ids, n = left.pop()
                if len(ids) > room:
                    left.append((doc_id, start + room, ids[room:], n))
                    ids = ids[:room]
                out.append((doc_id, start, ids, n))
                room -= len(ids)
            if out:
                self.emit(out)


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, max_open: int = 4096) -> DataFrame:
    """Packs ``doc_id, text`` rows into windows of ``size`` tokens.

    One row for each piece: doc_id, start (its document's ids before it),
    length, doc_tokens (with the end id), sequence_id, offset in the window, and
    the ids as little-endian unsigned 32-bit integers.  sequence_id is the
    task's number and a counter.  Windows that the sum-of-squares rule leaves
    open, at a task's end or beyond max_open, are topped up with cut pieces.

    Null text counts as empty: one end id.  Null and repeated doc_ids are packed
    like others, one document a row.  Other columns are not read.  An empty
    table gives no rows.
    """
    path = tokenizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.UnitEncoder.of(path)
        base, rows, held, serial = TaskContext.get().partitionId() << 40, [], 0, 0
        schema = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])

        def emit(window: list) -> None:
            nonlocal serial, held
            offset = 0
            for doc_id, start, ids, n in window:
                rows.append((doc_id, start, len(ids), n, base + serial, offset, ids.tobytes()))
                offset += len(ids)
            held += 4 * offset
            serial += 1

        def flush() -> pa.RecordBatch:
            nonlocal held
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            held = 0
            return out

        packer = LevelPacker(size, emit, max_open)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, ids, ends in encoder.encode(batch.column(1)):
                ids, ends = tokens.with_end(ids, ends, end_id)
                for k in range(len(ends) - 1):
                    packer.add(doc_ids[at + k], ids[ends[k] : ends[k + 1]].copy())
                    if len(rows) >= ROWS or held >= BYTES:
                        yield flush()
        packer.close()
        if rows:
            yield flush()

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The pieces of op3: ids by byte_bpe_50k.json, end id 1, windows of 2048."""
    packed = pack_documents(docs, tokens.tokenizer_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(common.table(spark, sf_dir, "documents"))
