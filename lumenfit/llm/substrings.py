"""Removal of repeated substrings by an enhanced suffix array (operator 2).

Each byte that a 50-byte string covers goes if that string also starts in a
document with a smaller doc_id.  The corpus doesn't fit one suffix array, so
work is dealt by *anchors*: of each 50-byte window, the 16-byte gram with the
least hash.  A run of windows with one anchor has two halves, by the side of the
gram that has 16 further bytes inside the window; a half's *key* is the hash of
these 32 bytes.  Equal windows have equal keys; hashes only say who meets.

1. Packs of texts ask which keys stand in several documents.
2. The *contexts* of such keys (the bytes that a half's windows cover) are
   dealt by key.  Equal contexts, compared byte by byte, are one leaf with
   several occurrences, in a pack first and then over all.
3. Where a key has several contexts, their windows' suffixes are sorted;
   neighbours' common prefixes give the interval tree by a stack scan, and
   intervals whose left extensions differ are maximal repeats, told with all
   occurrences.  Of a leaf and of a repeat all but the least document's go.
4. A key with more than ``crowd`` contexts doesn't meet in one task: its windows
   themselves, 50 bytes each, are aggregated, which finds the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.llm import common, packs
from lumenfit.llm.bytehash import BASE, BYTES, Spans, U, ragged

SPAN, GRAM = 50, 16
SIDE = SPAN - GRAM  # windows that a gram can be in, less one
NEAR = SPAN - 2 * GRAM - 1  # a window that starts at most so far before its gram holds 16 bytes behind it
WIDEST = SPAN + NEAR  # bytes of a context at most
#: Bytes hashed at once.
BATCH = 1 << 20
#: A longer text is cut into pieces; positions of anchors have 24 bits.
PIECE = 1 << 23
#: Windows in one suffix array, about.
SUFFIXES = 1 << 18
MANY = np.iinfo(np.int64).min  # a key that several documents of a pack have

MARK = np.dtype([("row", "<u4"), ("start", "<u4"), ("end", "<u4")])


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[Spans, tuple]:
    """Hashes of the bytes, and (first window, last window, anchor, text number) of each run of windows with one anchor.

    Texts lie in raw one after another.
    """
    n = np.maximum(ends - starts - SPAN + 1, 0)
    spans = Spans(BYTES[raw])
    if not n.sum():
        return spans, (np.empty(0, np.int64),) * 4
    grams = spans.all(GRAM)
    low = U((1 << 24) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16, SIDE - 31):  # minima of 2, 4, .. 32 and SIDE + 1 neighbours
        least = np.minimum(least[:-step], least[step:])
    where = ragged(starts, n)
    text = np.repeat(np.arange(len(starts)), n)
    anchor = (least[where] & low).astype(np.int64)
    at = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    return spans, (where[at], where[np.r_[at[1:], len(where)] - 1], anchor[at], text[at])


def batches_of(texts: list[bytes], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, starts, ends) of some texts at once."""
    k = 0
    while k < len(texts):
        to, size = k, 0
        while to < len(texts) and (to == k or size + len(texts[to]) <= most):
            size += len(texts[to])
            to += 1
        ends = np.cumsum([len(t) for t in texts[k:to]], dtype=np.int64)
        yield k, np.frombuffer(b"".join(texts[k:to]), np.uint8), np.r_[0, ends[:-1]], ends
        k = to


def halves(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(key, context hash, first window, last window, text number) of all halves; places are those in their text."""
    out: list[tuple] = []
    for k, raw, starts, ends in batches_of(texts, BATCH):
        # only a text that stands alone has several pieces; each window lies in one
        for cut in range(0, len(raw), PIECE):
            to = cut + PIECE + SPAN - 1
            begin = np.maximum(starts - cut, 0)
            spans, (first, last, anchor, text) = anchors(raw[cut:to], begin, np.minimum(ends, to) - cut)
            for lo, hi, at, salt in ((np.maximum(first, anchor - NEAR), last, anchor, 0), (first, np.minimum(last, anchor - NEAR - 1), anchor - GRAM, BASE)):
                some = lo <= hi
                lo, hi, at, of = lo[some], hi[some], at[some], text[some]
                key = (spans.of(at, at + 2 * GRAM) ^ U(salt)) >> U(64 - packs.BITS)
                out.append((key, spans.of(lo, hi + SPAN), lo + cut - starts[of], hi + cut - starts[of], k + of))
    if not out:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of (sorted) keys starts."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def ask(texts: list[bytes], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A pack's distinct keys, and for each its document (MANY for several) and its number of contexts."""
    key, context, _, _, text = halves(texts)
    order = np.lexsort((context, key))
    key, context, doc = key[order], context[order], doc[text[order]]
    at = runs(key)
    if not len(at):
        return key, np.empty((0, 2), np.int64)
    new = np.zeros(len(key), np.int64)
    new[runs(key, context)] = 1
    low, high = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
    return key[at], np.c_[np.where(low == high, low, MANY), np.add.reduceat(new, at)]


APART, SHARED, HOT = 0, 1, 2


def answer(keys: np.ndarray, told: np.ndarray, crowd: int) -> np.ndarray:
    """Of each key: whether several documents have it, and whether in more than ``crowd`` contexts."""
    order = np.argsort(keys, kind="stable")
    at = runs(keys[order])
    doc, n = told[order, 0], told[order, 1]
    low, high = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
    kind = np.where((low == high) & (low != MANY), APART, np.where(np.add.reduceat(n, at) > crowd, HOT, SHARED))
    out = np.empty(len(keys), np.uint8)
    out[order] = np.repeat(kind, np.diff(np.r_[at, len(keys)]))
    return out


def joined(marks: np.ndarray) -> np.ndarray:
    """Spans to remove, overlapping and adjoining ones of a row made one."""
    m = marks[np.lexsort((marks["start"], marks["row"]))]
    if not len(m):
        return m
    # ends grow with starts unless spans are nested; a running maximum within each row settles that
    group = np.zeros(len(m), np.int64)
    group[runs(m["row"])] = 1
    top = np.maximum.accumulate((np.cumsum(group) << 32) + m["end"].astype(np.int64)) & 0xFFFFFFFF
    new = group.astype(bool)
    new[1:] |= m["start"][1:].astype(np.int64) > top[:-1]
    at = np.flatnonzero(new)
    out = m[at].copy()
    out["end"] = top[np.r_[at[1:], len(m)] - 1]
    return out


def marks_of(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(row), MARK)
    out["row"], out["start"], out["end"] = row, start, end
    return out


def leaves(key: np.ndarray, matrix: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each leaf, the leaf of each row), in the keys' order: rows with the same key and the same bytes are one."""
    whole = np.concatenate([key.astype(">u8").view(np.uint8).reshape(-1, 8), size.astype(np.uint8)[:, None], matrix], axis=1)
    _, first, leaf = np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return first, leaf


def matrix_of(raw: np.ndarray, at: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """One row of bytes for each (at, size), filled up with 0."""
    out = np.lib.stride_tricks.sliding_window_view(np.r_[raw, np.zeros(width, np.uint8)], width)[at]
    out[np.arange(width)[None] >= size[:, None]] = 0
    return out


def maximal_repeats(suffixes: np.ndarray, sizes: np.ndarray, before: np.ndarray, least: int = SPAN) -> Iterator[tuple[int, np.ndarray]]:
    """(length, numbers of the suffixes) of each maximal repeat of at least ``least`` bytes.

    suffixes: rows of bytes, filled up with 0; before: the byte left of each,
    or a negative number of its own where there is none.  The array is sorted;
    a stack over neighbours' common prefixes yields the nodes of the interval
    tree, children first.  A node is told if its left extensions differ.
    """
    width = suffixes.shape[1]
    order = np.argsort(np.ascontiguousarray(suffixes).view(f"S{width}").ravel(), kind="stable")
    a, s = suffixes[order], sizes[order]
    if len(order) < 2:
        return
    differ = a[1:] != a[:-1]
    common_ = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common_ = np.minimum(common_, np.minimum(s[1:], s[:-1]))
    left = before[order]
    # a prefix sum of changes tells at once whether a stretch has one left extension
    change = np.r_[0, np.cumsum(left[1:] != left[:-1])].tolist()
    lcp = common_.tolist()
    n, i = len(lcp), 0
    busy = np.flatnonzero(common_ >= least)
    if not len(busy):
        return
    cuts = np.flatnonzero(np.diff(busy) > 1)
    for lo, hi in zip(busy[np.r_[0, cuts + 1]], busy[np.r_[cuts, len(busy) - 1]], strict=True):
        stack: list[tuple[int, int]] = []  # (length, first suffix)
        for i in range(lo, hi + 2):
            length, first = (lcp[i] if i <= hi and i < n else 0), i
            while stack and stack[-1][0] > length:
                depth, first = stack.pop()
                if change[i] != change[first]:
                    yield depth, order[first : i + 1]
            if length >= least and (not stack or stack[-1][0] < length):
                stack.append((length, first))


def repeats(key: np.ndarray, matrix: np.ndarray, size: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(leaves, first bytes in them, length) of what leaves, sorted by key, have in common with an earlier document's leaf.

    doc is the least document of each leaf.  Only leaves of one key can share a
    window, so several keys' windows stand in one suffix array.
    """
    at = runs(key)
    n = np.diff(np.r_[at, len(key)])
    if not len(at):
        return
    open_ = np.repeat((n > 1) & (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)), n)
    some = np.flatnonzero(open_)
    windows = size[some] - SPAN + 1
    part = (np.cumsum(windows) - windows) // SUFFIXES
    group = np.cumsum(np.r_[False, key[some][1:] != key[some][:-1]]) if len(some) else some
    if len(some):  # a key stays in one part
        part = part[runs(group)][group]
    for p in np.unique(part):
        mine, count = some[part == p], windows[part == p]
        owner, inner = np.repeat(mine, count), ragged(np.zeros(len(mine), np.int64), count)
        flat, width = matrix[mine].ravel(), matrix.shape[1]
        begin = np.repeat(np.arange(len(mine)) * width, count) + inner
        left_over = size[owner] - inner
        before = np.where(inner > 0, flat[begin - 1].astype(np.int64), -1 - np.arange(len(begin)))
        for length, who in maximal_repeats(matrix_of(flat, begin, left_over, width), left_over, before):
            docs = doc[owner[who]]
            later = who[docs > docs.min()]
            if len(later):
                yield owner[later], inner[later], length


OUT = "kind int, bucket long, pack long, doc long, row long, at long, win binary, payload binary"
CONTEXTS, MARKS, WINDOWS = 0, 1, 2
KINDS = [pa.int32(), *[pa.int64()] * 5, pa.binary(), pa.binary()]


def rows_out(kind: int, **cols) -> pa.Table:
    names = [x.split()[0] for x in OUT.split(", ")]
    n = len(next(iter(cols.values())))
    return pa.table([cols[k].cast(t) if isinstance(cols.get(k), pa.ChunkedArray) else pa.array(cols[k], t) if k in cols else pa.array([kind] * n, t) if k == "kind" else pa.nulls(n, t) for k, t in zip(names, KINDS, strict=True)], names)


def blob(key, size, count, row, doc, at, body: bytes) -> bytes:
    """Leaves of a pack: key, size and number of occurrences of each, the occurrences, and the leaves' bytes."""
    parts = [size.astype("<u1"), count.astype("<u4"), row.astype("<u4"), doc.astype("<i8"), at.astype("<u4")]
    head = np.array([len(key), len(row)], "<u4").tobytes() + packs.planes(key)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head, *map(packs.by_byte, parts), body]))


def from_blob(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, m = np.frombuffer(raw, "<u4", 2).tolist()
    at = 8 + n * packs.BITS // 8
    out = [packs.from_planes(raw[8:at], n)]
    for kind, k in (("<u1", n), ("<u4", n), ("<u4", m), ("<i8", m), ("<u4", m)):
        size = k * np.dtype(kind).itemsize
        out.append(packs.from_bytes(raw[at : at + size], kind, k))
        at += size
    return [*out, np.frombuffer(raw, np.uint8, offset=at)]


def docs_of(pack: dict) -> np.ndarray:
    return np.array([np.iinfo(np.int64).max if d is None else d for d in pack["doc"]], np.int64)


def contexts(pack: dict, kinds: np.ndarray, buckets: int) -> pa.Table:
    """A pack's contexts and windows of shared keys, and what the pack alone decides."""
    texts, doc = packs.texts_of(pack["texts"], np.array(pack["ends"], np.int64)), docs_of(pack)
    key, _, lo, hi, text = halves(texts)
    kind = kinds[np.searchsorted(np.unique(key), key)] if len(key) else np.empty(0, np.uint8)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    base = np.r_[0, np.array(pack["ends"], np.int64)[:-1]]
    tables, gone = [rows_out(MARKS, pack=[], payload=[])], [np.empty(0, MARK)]
    aside = -1 - pack["pack"]  # what no tree is made of

    def least_of(key_, start, size, row, width):
        """Leaves, and their occurrences in their least document; the others go."""
        matrix = matrix_of(raw, base[row] + start, size, width)
        first, leaf = leaves(key_, matrix, size)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, leaf, doc[row])
        late = doc[row] > least[leaf]
        gone.append(marks_of(row[late], start[late], start[late] + size[late]))
        return matrix, first, leaf, ~late

    some = np.flatnonzero(kind == SHARED)
    for at in range(0, len(some), 1 << 16):
        pick = some[at : at + (1 << 16)]
        matrix, first, leaf, kept = least_of(key[pick], lo[pick], hi[pick] - lo[pick] + SPAN, text[pick], WIDEST)
        order = np.flatnonzero(kept)[np.argsort(leaf[kept], kind="stable")]
        count = np.bincount(leaf[order], minlength=len(first))
        size = (hi - lo + SPAN)[pick][first]
        where = (key[pick][first] // U(-(-(1 << packs.BITS) // buckets))).astype(np.int64)
        ends, cuts = np.r_[0, np.cumsum(count)], np.r_[runs(where), len(where)]
        payload = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            occ = pick[order[ends[a] : ends[b]]]
            body = matrix[first[a:b]][np.arange(WIDEST)[None] < size[a:b, None]].tobytes()
            payload.append(blob(key[pick][first[a:b]], size[a:b], count[a:b], text[occ], doc[text[occ]], lo[occ], body))
        tables.append(rows_out(CONTEXTS, bucket=where[cuts[:-1]], pack=[pack["pack"]] * len(payload), payload=payload))
    some = np.flatnonzero(kind == HOT)
    for at in range(0, len(some), 1 << 13):
        pick = some[at : at + (1 << 13)]
        n = hi[pick] - lo[pick] + 1
        start, row = ragged(lo[pick], n), np.repeat(text[pick], n)
        matrix, first, leaf, kept = least_of(np.zeros(len(start), np.uint64), start, np.full(len(start), SPAN), row, SPAN)
        at_ = np.flatnonzero(kept)
        tables.append(rows_out(WINDOWS, bucket=[aside] * len(at_), pack=[pack["pack"]] * len(at_), doc=doc[row[at_]], row=row[at_], at=start[at_], win=[m.tobytes() for m in matrix[at_]]))
    marks = joined(np.concatenate(gone))
    if len(marks):
        tables.append(rows_out(MARKS, bucket=[aside], pack=[pack["pack"]], payload=[marks.tobytes()]))
    return pa.concat_tables(tables)


FOUND = "pack long, payload binary"


def by_pack(pack: np.ndarray, marks: np.ndarray) -> pa.Table:
    """One row of marks for each pack."""
    order = np.argsort(pack, kind="stable")
    at = np.r_[runs(pack[order]), len(pack)]
    data = [joined(marks[order[a:b]]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.table({"pack": pa.array(pack[order][at[:-1]], pa.int64()), "payload": pa.array(data, pa.binary())})


def trees(table: pa.Table) -> pa.Table:
    """Removals among the contexts of a bucket; other rows as they are."""
    if table.column("kind")[0].as_py() != CONTEXTS:
        return table
    parts = [from_blob(b) for b in table.column("payload").to_pylist()]
    key, size, count, row, doc, at, body = (np.concatenate(c) for c in zip(*parts, strict=True))
    pack = np.repeat(table.column("pack").to_numpy(), [len(p[3]) for p in parts])
    size = size.astype(np.int64)
    matrix = matrix_of(body, np.cumsum(size) - size, size, WIDEST)
    first, leaf = leaves(key, matrix, size)
    of = np.repeat(leaf, count)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, of, doc)
    late = doc > least[of]
    start = at.astype(np.int64)
    packs_, marks = [pack[late]], [marks_of(row[late], start[late], start[late] + size[first][of[late]])]
    # occurrences of each leaf in its least document
    kept = np.flatnonzero(~late)
    kept = kept[np.argsort(of[kept], kind="stable")]
    n = np.bincount(of[kept], minlength=len(first))
    begin = np.cumsum(n) - n
    for who, inner, length in repeats(key[first], matrix[first], size[first], least):
        occ = kept[ragged(begin[who], n[who])]
        lo = start[occ] + np.repeat(inner, n[who])
        packs_.append(pack[occ])
        marks.append(marks_of(row[occ], lo, lo + length))
    out = by_pack(np.concatenate(packs_), np.concatenate(marks))
    return rows_out(MARKS, pack=out.column("pack"), payload=out.column("payload"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def covered(n: int, marks: np.ndarray) -> np.ndarray:
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, marks["start"], 1)
    np.add.at(depth, marks["end"], -1)
    return np.cumsum(depth[:n]) > 0


def remove_repeats(df: DataFrame, crowd: int = 20_000, keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left; null without ``keep``) of each row of ``doc_id, text``.

    A key of more than ``crowd`` contexts takes the way by windows, which gives
    the same result.

    Null text is empty; texts under 50 bytes stay.  A row without doc_id comes
    after all others, and rows with one doc_id (or none) are no source for each
    other.  Repeated rows are each reported.  A text of n bytes takes about 60 n
    bytes in a task, and at most 8 MiB of it are hashed at once.  Further columns
    are not read.  An empty table gives no rows.
    """
    base = df.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    held = packs.packed(base, False, "packs")
    buckets = packs.buckets_for(held, SIDE / 4)
    told = packs.answers(held, buckets, ask, lambda keys, numbers: answer(keys, numbers, crowd), "keys")
    dealt = packs.with_answers(held, told, lambda pack, kinds: contexts(pack, kinds, 4 * buckets), OUT)
    width = max(common.shuffle_width(df.sparkSession), buckets // 2)
    found = common.stash(dealt.repartition(width, "bucket").groupBy("bucket").applyInArrow(trees, OUT), "found")
    common.discard(told)
    windows = found.filter(F.col("kind") == WINDOWS).select("win", "doc", "pack", "row", "at")
    least = windows.groupBy("win").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("win", "least")
    late = windows.join(least, "win").filter("doc > least").select("pack", "row", "at")

    def spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pack, row, at = (c.to_numpy() for c in batch.columns)
            yield from by_pack(pack, marks_of(row, at, at + SPAN)).to_batches()

    own = found.filter(F.col("kind") == MARKS).select("pack", "payload")
    marks = common.stash(own.unionByName(late.mapInArrow(spans_of, FOUND)), "marks")
    common.discard(found)

    def finish(mine: pa.Table, got: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for pack in mine.to_pylist():
            texts = packs.texts_of(pack["texts"], np.array(pack["ends"], np.int64))
            gone = np.concatenate([np.empty(0, MARK), *(np.frombuffer(b, MARK) for b in got.column("payload").to_pylist())])
            gone = gone[np.argsort(gone["row"], kind="stable")]
            cut = np.searchsorted(gone["row"], np.arange(len(texts) + 1))
            for k, (doc, text) in enumerate(zip(pack["doc"], texts, strict=True)):
                hit = covered(len(text), gone[cut[k] : cut[k + 1]])
                kept = np.frombuffer(text, np.uint8)[~hit].tobytes()
                spans = int(np.count_nonzero(np.diff(np.r_[0, hit.astype(np.int8)]) == 1))
                out.append((doc, len(text), int(hit.sum()), spans, sha256(kept).hexdigest(), kept if keep else None))
        kinds = [*[pa.int64()] * 4, pa.string(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    tasks = max(common.shuffle_width(df.sparkSession), held.count() // 32)
    return held.repartition(tasks, "pack").groupBy("pack").cogroup(marks.repartition(tasks, "pack").groupBy("pack")).applyInArrow(finish, RESULT)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"), keep=False).drop("kept")


#: For DuckDB; bytes are pairs of hex digits.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS p FROM d)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
dup AS (SELECT doc_id, p FROM w JOIN m USING (s) WHERE doc_id > first),
isle AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM dup),
grp AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM isle),
span AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM grp GROUP BY doc_id, g),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM span),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS removed, count(*) AS spans FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
