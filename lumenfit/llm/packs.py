"""Packs of texts, and questions that packs ask about their hashes.

A pack is one row with some texts (about PACK bytes), compressed.  Its texts
have fixed numbers, so that answers can be told by position: each pack sends its
distinct hashes, sorted, to buckets of the hash's range; a bucket answers with
one byte for each of them; and the answers of all buckets, side by side, stand
in the order of the pack's hashes.  Nothing is joined hash by hash, a hash that
is in all texts is sent once by each pack, and no task gets more than a bucket
or a pack.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfit.llm import common

PACK = 2 << 20  # bytes of text; a longer text is a pack of its own
ROWS = 1 << 14  # texts of a pack at most
BITS = 48  # of a hash
#: Hashes that a bucket gets on average.
BUCKET = 1 << 20
SCHEMA = "pack long, n int, size long, doc array<long>, h1 array<long>, h2 array<long>, ends array<long>, texts binary"


def packed(df: DataFrame, lower: bool, name: str) -> DataFrame:
    """The rows of ``doc_id long, text string`` as a stashed table of packs.

    doc, h1, h2 (128 bits of hash of the text as given) and ends (byte offsets
    into the concatenated texts, lower-cased if ``lower``) have one entry for
    each row; doc_id may be null, text not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        first, serial = TaskContext.get().partitionId() << 24, 0
        held: list[tuple] = []
        size = 0

        def leave() -> pa.RecordBatch:
            nonlocal serial, size
            doc, h1, h2, texts = zip(*held, strict=True)
            row = (first + serial, len(held), size, doc, h1, h2, np.cumsum([len(t) for t in texts]).tolist(), press(b"".join(texts)))
            held.clear()
            serial, size = serial + 1, 0
            longs = pa.list_(pa.int64())
            kinds = [pa.int64(), pa.int32(), pa.int64(), longs, longs, longs, longs, pa.binary()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            lens = pc.binary_length(batch.column(3)).to_numpy()
            at = 0
            while at < batch.num_rows:  # some texts at once, so that few are Python objects
                to = at + max(1, int(np.searchsorted(np.cumsum(lens[at : at + ROWS]), PACK)))
                part = batch.slice(at, to - at)
                text = part.column(3)
                texts = (pc.utf8_lower(text) if lower else text).cast(pa.binary()).to_pylist()
                for row in zip(*(c.to_pylist() for c in part.columns[:3]), texts, strict=True):
                    if held and (size + len(row[3]) > PACK or len(held) == ROWS):
                        yield leave()
                    held.append(row)
                    size += len(row[3])
                at = to
        if held:
            yield leave()

    cols = df.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    return common.stash(cols.mapInArrow(run, SCHEMA), name)


def row_ids(pack: int, n: int) -> np.ndarray:
    """Numbers of a pack's rows, unique in the table."""
    return (pack << 14) + np.arange(n, dtype=np.int64)


def texts_of(data: bytes, ends: np.ndarray) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return [raw[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]


def planes(values: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte by byte: the upper bytes are mostly 0 and compress away."""
    return np.ascontiguousarray(np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8].T).tobytes()


def from_planes(data: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, : BITS // 8] = np.frombuffer(data, np.uint8, n * BITS // 8).reshape(BITS // 8, n).T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def by_byte(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones, ..: small differences and common upper bytes compress well so."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T).tobytes() if len(values) else b""


def from_bytes(data: bytes, kind: str, n: int, columns: int = 1) -> np.ndarray:
    wide = np.frombuffer(data, np.uint8).reshape(-1, n).T if n else np.empty((0, columns * np.dtype(kind).itemsize), np.uint8)
    out = np.ascontiguousarray(wide).view(kind)
    return out.ravel() if columns == 1 else out


def buckets_for(packs: DataFrame, bytes_a_hash: float) -> int:
    size = packs.agg(F.sum("size")).first()[0] or 0
    return max(1, round(size / bytes_a_hash / BUCKET), min(common.shuffle_width(packs.sparkSession), int(size >> 18)))


ASKED = "bucket long, pack long, n int, hashes binary, extra binary"
TOLD = "pack long, bucket long, answer binary"


def answers(packs: DataFrame, buckets: int, ask: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]], answer: Callable, name: str) -> DataFrame:
    """pack, bucket, answer: a byte for each hash that the pack has sent to the bucket; a stashed table.

    ask(texts, doc) gives a pack's sorted distinct hashes, of BITS bits, and a
    number (or a row of them) for each; answer(hash, number) gives the byte of each of a bucket's,
    which come as one array, pack after pack.
    """
    wide = -(-(1 << BITS) // buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for pack, doc, ends, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, numbers = ask(texts_of(data, np.array(ends, np.int64)), np.array([np.iinfo(np.int64).max if d is None else d for d in doc], np.int64))
                cuts = np.searchsorted(hashes, np.arange(0, buckets + 1, dtype=np.uint64) * np.uint64(wide))
                used = np.flatnonzero(np.diff(cuts))
                for at in range(0, len(used), 256):
                    some = [(b, slice(cuts[b], cuts[b + 1])) for b in used[at : at + 256].tolist()]
                    rows = [[b for b, _ in some], [pack] * len(some), [s.stop - s.start for _, s in some], [press(planes(hashes[s])) for _, s in some], [press(by_byte(numbers[s])) for _, s in some]]
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], [x.split()[0] for x in ASKED.split(", ")])

    def tell(table: pa.Table) -> pa.Table:
        unpress = zstandard.ZstdDecompressor().decompress
        bucket, pack, n = table.column("bucket")[0].as_py(), table.column("pack").to_pylist(), table.column("n").to_pylist()
        hashes = np.concatenate([from_planes(unpress(h), k) for h, k in zip(table.column("hashes").to_pylist(), n, strict=True)])
        extra = [unpress(x) for x in table.column("extra").to_pylist()]
        columns = sum(map(len, extra)) // (8 * len(hashes))
        numbers = np.concatenate([from_bytes(x, "<i8", k, columns) for x, k in zip(extra, n, strict=True)])
        told = answer(hashes, numbers).astype(np.uint8)
        ends = np.cumsum(n)
        return pa.table({"pack": pack, "bucket": pa.array([bucket] * len(pack), pa.int64()), "answer": pa.array([told[a:b].tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)], pa.binary())})

    asked = packs.select("pack", "doc", "ends", "texts").mapInArrow(send, ASKED)
    width = max(common.shuffle_width(packs.sparkSession), buckets // 8)
    return common.stash(asked.repartition(width, "bucket").groupBy("bucket").applyInArrow(tell, TOLD), name)


def with_answers(packs: DataFrame, told: DataFrame, each: Callable[[dict, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """each(pack, answers in the order of its hashes) for all packs."""

    def run(mine: pa.Table, got: pa.Table) -> pa.Table:
        answer = got.sort_by("bucket").column("answer").to_pylist()
        out = [each(row, np.frombuffer(b"".join(answer), np.uint8)) for row in mine.to_pylist()]  # one pack
        return out[0]

    width = max(common.shuffle_width(packs.sparkSession), packs.count() // 32)
    return packs.repartition(width, "pack").groupBy("pack").cogroup(told.repartition(width, "pack").groupBy("pack")).applyInArrow(run, schema)
