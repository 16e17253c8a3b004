"""Binary token files: canonical length-limited Huffman coding (operator 9).

A token file is a folder of Parquet files whose rows are independent blocks,
so that Spark's committers make the writing safe against lost executors and
any store that Spark reads can hold it.  Each row has ``shard, block, first_doc,
n_docs, n_tokens, tokens_before`` (in its shard) and ``payload``::

    magic "LFH1" | u32 n_docs | u32 stride | u64 n_tokens | u64 n_bits
    n_docs x u32 document lengths
    ceil(n_tokens / stride) x u64 bit offsets (checkpoints)
    bits, most significant first, then 4 zero bytes

Code lengths come from the global counts by package-merge and stand in one row
beside the blocks.  A block is decoded by table, all checkpoints at once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.llm import common, tokens

HEAD = struct.Struct("<4sIIQQ")
MAGIC = b"LFH1"


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    levels, current = [], leaf
    leaf_mark = np.ones(len(leaf), dtype=bool)
    marks = leaf_mark
    for _ in range(limit - 1):
        levels.append(marks)
        pairs = current[: len(current) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaf, pairs])
        at = np.argsort(both, kind="stable")
        current, marks = both[at], at < len(leaf)
    levels.append(marks)
    lens = np.zeros(len(leaf), dtype=np.int64)
    take = 2 * len(leaf) - 2
    for marks in reversed(levels):
        n = int(marks[:take].sum())
        lens[:n] += 1
        take = 2 * (take - n)
    out[order] = lens
    return out


def canonical_codes(lens: np.ndarray) -> np.ndarray:
    codes = np.zeros(len(lens), dtype=np.uint64)
    order = np.lexsort((np.arange(len(lens)), lens))
    order = order[lens[order] > 0]
    code, last = 0, 0
    for i in order:
        code <<= int(lens[i]) - last
        last = int(lens[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lens: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Width, and for each value of so many bits the id and its code length."""
    width = max(1, int(lens.max(initial=1)))
    codes = canonical_codes(lens)
    ids, size = np.zeros(1 << width, dtype=np.uint32), np.ones(1 << width, dtype=np.int64)
    for i in np.flatnonzero(lens):
        n = width - int(lens[i])
        at = int(codes[i]) << n
        ids[at : at + (1 << n)], size[at : at + (1 << n)] = i, lens[i]
    return width, ids, size


def encode_block(ids: np.ndarray, doc_lens: np.ndarray, lens: np.ndarray, codes: np.ndarray, stride: int = 256) -> bytes:
    size = lens[ids].astype(np.int64)
    ends = np.cumsum(size)
    off = ends - size
    n_bits = int(ends[-1]) if len(ends) else 0
    wide = codes[ids] << (64 - (off & 31) - size).astype(np.uint64)
    word = off >> 5
    n = (n_bits >> 5) + 2
    # codes don't overlap, so a word's sum stays under 2^32 and is exact in float64
    bits = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return b"".join((HEAD.pack(MAGIC, len(doc_lens), stride, len(ids), n_bits), doc_lens.astype("<u4").tobytes(), off[::stride].astype("<u8").tobytes(), bits.astype(">u4").tobytes()))


def decode_block(payload: bytes, table: tuple[int, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """ids and document lengths."""
    magic, n_docs, stride, n, _ = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = HEAD.size
    doc_lens = np.frombuffer(payload, "<u4", n_docs, at)
    at += 4 * n_docs
    lanes = -(-n // stride)
    pos = np.frombuffer(payload, "<u8", lanes, at).astype(np.int64)
    raw = np.frombuffer(payload, np.uint8, offset=at + 8 * lanes).astype(np.uint32)
    window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    width, ids, size = table
    mask = (1 << width) - 1
    out = np.empty((stride, lanes), dtype=np.uint32)
    full = n - (lanes - 1) * stride if lanes else 0  # of the last lane
    for k in range(stride if n else 0):
        if k == full:
            pos = pos[: lanes - 1]
        if not len(pos):
            break
        code = (window[pos >> 3] >> (24 - width - (pos & 7))) & mask
        out[k, : len(pos)] = ids[code]
        pos = pos + size[code]
    return np.ascontiguousarray(out.T).reshape(-1)[:n], doc_lens


TOKENS = "doc_id long, n long, ids binary"


def tokenize(df: DataFrame, tokenizer: str, end_id: int, wide: bool) -> DataFrame:
    """doc_id, n and zstd-packed ids of each row's text and the end id (null text: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, pack = tokens.UnitEncoder.of(tokenizer, 1_200_000), zstandard.ZstdCompressor(level=1).compress
        kind = np.dtype("<u4" if wide else "<u2")
        for batch in batches:
            for at, ids, ends in encoder.encode(batch.column(1)):
                ids, ends = tokens.with_end(ids, ends, end_id)
                flat, by = ids.astype(kind).tobytes(), ends * kind.itemsize
                rows = [pack(flat[a:b]) for a, b in zip(by[:-1], by[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), pa.array(np.diff(ends)), pa.array(rows, pa.binary())], ["doc_id", "n", "ids"])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TOKENS)


def _ids(batch: pa.RecordBatch, wide: bool, unpack) -> np.ndarray:
    raw = b"".join(unpack(x.as_py()) for x in batch.column("ids"))
    return np.frombuffer(raw, "<u4" if wide else "<u2")


def id_counts(tokenized: DataFrame, vocab: int, wide: bool) -> np.ndarray:
    """How often each id occurs, over all rows: a bounded array of vocab counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, total = zstandard.ZstdDecompressor().decompress, np.zeros(vocab, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                total += np.bincount(_ids(batch.slice(at, 1000), wide, unpack), minlength=vocab)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    out = np.zeros(vocab, dtype=np.int64)
    for r in tokenized.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


BLOCKS = "shard long, block long, first_doc long, n_docs long, n_tokens long, tokens_before long, doc_ids binary, no_id binary, payload binary"


def write_token_file(df: DataFrame, path: str, tokenizer: str, end_id: int, vocab: int, limit: int = 16, block_tokens: int = 1 << 20, stride: int = 256) -> str:
    """Writes the ids of all texts, each with end_id after it, in ascending doc_id order.

    ``path`` gets ``blocks`` and ``codes``.  Null text is one end id; null
    doc_ids come first; rows with the same doc_id (or none) are ordered by a
    hash of their packed ids, so many of them are dealt to several tasks, and each is a
    document.  A long text is one document of one block; it may have up to 2^29
    ids.  Other columns are not read.  Of an empty table no block is written.
    """
    spark, wide = df.sparkSession, vocab > 1 << 16
    tokenized = common.stash(tokenize(df, tokenizer, end_id, wide), "tokens")
    counts = id_counts(tokenized, vocab, wide)
    lens = code_lengths(counts, limit)
    spark.createDataFrame([(bytearray(lens.tobytes()), end_id)], "lens binary, end_id int").write.parquet(f"{path}/codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, codes = zstandard.ZstdDecompressor().decompress, canonical_codes(lens)
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        sizes: list[int] = []
        parts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, before
            ids = np.frombuffer(b"".join(parts), "<u4" if wide else "<u2")
            payload = encode_block(ids, np.array(sizes), lens, codes, stride)
            missing = np.array([d is None for d in docs])
            known = np.array([0 if d is None else d for d in docs], dtype="<i8")
            row = (shard, block, docs[0], len(docs), len(ids), before, known.tobytes(), np.packbits(missing).tobytes() if missing.any() else None, payload)
            block, before = block + 1, before + len(ids)
            docs.clear(), sizes.clear(), parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if i > 5 else pa.int64()) for i, x in enumerate(row)], ["shard", "block", "first_doc", "n_docs", "n_tokens", "tokens_before", "doc_ids", "no_id", "payload"])

        held = 0
        for batch in batches:
            for doc_id, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs.append(doc_id), sizes.append(n), parts.append(unpack(ids))
                held += n
                if held >= block_tokens:
                    yield flush()
                    held = 0
        if docs:
            yield flush()

    width = max(common.shuffle_width(spark), int(counts.sum()) // (16 * block_tokens))
    # a hash and not the ids, as ranges are found from a sample that goes to the driver
    ranged = tokenized.withColumn("h", F.xxhash64("ids")).repartitionByRange(width, "doc_id", "h").sortWithinPartitions("doc_id", "h", "ids")
    ranged.drop("h").mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    common.discard(tokenized)
    return path


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian u32) of each document."""
    lens = np.frombuffer(bytes(spark.read.parquet(f"{path}/codes").select("lens").first()[0]), np.uint8)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # one row for each write task: its tokens, to place its documents after those of tasks before it
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    base, total = {}, 0
    for r in shards:
        base[r.shard], total = total, total + r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lens)
        for batch in batches:
            for i in range(batch.num_rows):
                shard, before, raw, missing, payload = (batch.column(k)[i].as_py() for k in range(5))
                ids, doc_lens = decode_block(payload, table)
                ends = np.cumsum(doc_lens, dtype=np.int64)
                starts = ends - doc_lens
                absent = np.unpackbits(np.frombuffer(missing, np.uint8), count=len(ends)).astype(bool) if missing else None
                flat = pa.py_buffer(ids.astype("<u4").tobytes())
                at = 0
                while at < len(ends):
                    # documents of about 4 M ids, or one longer
                    to = min(at + 2000, max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 22), side="right"))))
                    to = min(to, len(ends))
                    off = np.r_[starts[at:to], ends[to - 1]] * 4
                    data = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer((off - off[0]).astype(np.int32).tobytes()), flat.slice(int(off[0]), int(off[-1] - off[0]))])
                    doc = pa.array(np.frombuffer(raw, "<i8")[at:to], mask=None if absent is None else absent[at:to])
                    yield pa.RecordBatch.from_arrays([doc, pa.array(base[shard] + before + starts[at:to]), pa.array(doc_lens[at:to].astype(np.int64)), data], ["doc_id", "start", "n_tokens", "ids"])
                    at = to

    return blocks.select("shard", "tokens_before", "doc_ids", "no_id", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_token_file(common.table(spark, sf_dir, "documents"), common.new_path(spark, "tokenfile"), tokens.tokenizer_path("word_bpe_49k.json"), 2, 49408)
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
