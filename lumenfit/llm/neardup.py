"""Near-duplicates by improved consistent weighted sampling (operator 5).

Texts are multisets of five-word shingles weighted by TF-IDF; document
frequencies are counted exactly, over all rows.  Each text gets a signature of
consistent weighted samples (Ioffe 2010), whose probability of agreement is the
weighted Jaccard similarity.  Bands of samples propose candidates, signatures
thin them out, and links are verified by the exact weighted Jaccard similarity:
first inside blocks of candidates, then between the classes that blocks have
left apart.

Document frequencies take weight from what a large group of copies shares, so
that its near copies fall below the threshold as the group grows.  With
``plain``, min-hashes of the shingles propose candidates too, and the plain
Jaccard similarity links as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.llm import common, packs
from lumenfit.llm.bytehash import BYTES, Spans, U, mix, ragged
from lumenfit.llm.components import components

WORDS = 5
BITS = packs.BITS  # of a shingle's hash
BANDS, ROWS = 13, 3
SAMPLES = BANDS * ROWS
#: Bytes of text, and shingles, that are looked at together.
BATCH, SLICE = 1 << 18, 1 << 16
IN_WORD = np.array([chr(b).isalnum() or b > 127 for b in range(256)])
IN_WORD[128:] = True
#: Min-hashes of the plain shingle sets, which stand behind the weighted samples.
PLAIN_BANDS = 10
PLAIN = PLAIN_BANDS * ROWS
SEEDS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) << U(32))
PLAIN_SEEDS = mix(np.arange(1, PLAIN + 1, dtype=np.uint64) << U(16))


def words_of(text: bytes) -> np.ndarray:
    """Hashes of the words of a lower-case text: runs of letters, digits and non-ASCII bytes."""
    out, at = [np.empty(0, np.uint64)], 0
    while at < len(text):
        to = at + BATCH
        while to < len(text) and IN_WORD[text[to]]:  # a cut stands behind a word
            to += 1
        raw = np.frombuffer(text, np.uint8, min(to, len(text)) - at, at)
        edge = np.flatnonzero(np.diff(np.r_[False, IN_WORD[raw], False].astype(np.int8)))
        out.append(Spans(BYTES[raw]).of(edge[::2], edge[1::2]))
        at = to
    return np.concatenate(out)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, times) of at most 2^14 lower-case texts, sorted; a text of one to four words is one shingle."""
    own = [words_of(t) for t in texts] if sum(map(len, texts)) > BATCH else None
    if own is None:  # short texts at once
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        edge = np.flatnonzero(np.diff(np.r_[False, IN_WORD[raw]].astype(np.int8)))
        word = Spans(BYTES[raw]).of(edge[::2], edge[1::2])
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), edge[::2], side="right")
    else:
        word, text = np.concatenate(own), np.repeat(np.arange(len(own)), [len(w) for w in own])
    row, n = Spans(word), len(word)
    whole = row.all(WORDS) if n >= WORDS else np.empty(0, np.uint64)
    same = text[: len(whole)] == text[WORDS - 1 :] if len(whole) else np.empty(0, bool)
    count = np.bincount(text, minlength=len(texts))
    few = np.flatnonzero((count > 0) & (count < WORDS))
    start = np.cumsum(count) - count
    keys = np.concatenate([(text[: len(whole)][same].astype(np.uint64) << U(BITS)) | (whole[same] >> U(64 - BITS)), (few.astype(np.uint64) << U(BITS)) | (row.of(start[few], start[few] + count[few]) >> U(64 - BITS))])
    keys, times = np.unique(keys, return_counts=True)
    return (keys >> U(BITS)).astype(np.int64), keys & U((1 << BITS) - 1), times


def samples(shingle: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """texts x SAMPLES of 32 bits: one consistent weighted sample for each seed."""
    best = np.full((len(starts), SAMPLES), np.inf)
    out = np.zeros((len(starts), SAMPLES), np.uint32)
    unit, low = 2.0**-21, U((1 << 21) - 1)
    part = lambda z, s: ((z >> U(s)) & low).astype(np.float64) * unit + unit / 2
    for lo in range(0, len(shingle), SLICE):  # a text may lie in several slices
        x, log_w = shingle[lo : lo + SLICE], np.log(weight[lo : lo + SLICE])
        one, two = np.searchsorted(starts, [lo, lo + len(x) - 1], side="right") - 1
        first = np.maximum(starts[one : two + 1] - lo, 0)
        number = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(x)]))
        for k, seed in enumerate(SEEDS):
            a = mix(x ^ seed)
            b = mix(a + U(0x9E3779B97F4A7C15))
            r = -np.log(part(a, 0) * part(a, 21))  # Gamma(2, 1)
            beta = (a >> U(42)).astype(np.float64) * 2.0**-22
            t = np.floor(log_w / r + beta)
            value = np.log(-np.log(part(b, 0) * part(b, 21))) - r * (t - beta + 1)
            top = np.minimum.reduceat(value, first)
            least = np.flatnonzero(value == top[number])
            pick = least[np.r_[True, np.diff(number[least]) > 0]]
            got = mix(x[pick] ^ (t[pick].astype(np.int64).view(np.uint64) * U(0xD1342543DE82EF95))) >> U(32)
            here = top < best[one : two + 1, k]
            out[one : two + 1, k][here] = got[here]
            best[one : two + 1, k] = np.minimum(best[one : two + 1, k], top)
    return out


def minima(shingle: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """texts x PLAIN of 32 bits: the least hash of the shingles for each seed."""
    out = np.empty((len(starts), PLAIN), np.uint32)
    for k, seed in enumerate(PLAIN_SEEDS):
        out[:, k] = np.minimum.reduceat(mix(shingle ^ seed) >> U(32), starts)
    return out


def agree(same: np.ndarray, need: int) -> np.ndarray:
    """Whether ``need`` of the weighted samples agree, or the same share of the min-hashes behind them, if there are any."""
    met = same[:, :SAMPLES].sum(axis=1) >= need
    return met | (same[:, SAMPLES:].sum(axis=1) >= need * PLAIN // SAMPLES) if same.shape[1] > SAMPLES else met


def idf_steps(counts: np.ndarray, rows: int) -> np.ndarray:
    """Inverse document frequency in eighths, at least one."""
    return np.clip(np.round(8 * np.log((1 + rows) / (1 + counts))), 1, 255).astype(np.uint8)


def frequencies(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many rows hold each hash; several packs may have sent it."""
    _, same = np.unique(hashes, return_inverse=True)
    return np.bincount(same, rows)[same]


def parts_of(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at = size = 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > BATCH:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def set_bytes(shingle: np.ndarray, step: np.ndarray, times: np.ndarray) -> bytes:
    """A weighted set: shingles as planes, then IDF steps, then (place, times) of what stands there more than once."""
    more = np.flatnonzero(times > 1)
    return np.array([len(shingle)], "<u4").tobytes() + packs.planes(shingle) + step.tobytes() + more.astype("<u4").tobytes() + times[more].astype("<u4").tobytes()


def from_set_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and weights."""
    n = int(np.frombuffer(data, "<u4", 1)[0])
    at = 4 + n * BITS // 8
    weight = np.frombuffer(data, np.uint8, n, at).astype(np.float64)
    more = np.frombuffer(data, "<u4", offset=at + n).reshape(2, -1)
    weight[more[0]] *= more[1]
    return packs.from_planes(data[4:at], n), weight


class Weighted:
    """Weighted shingle sets, side by side."""

    def __init__(self, sets: list[bytes]):
        both = [from_set_bytes(s) for s in sets]
        self.shingle = np.concatenate([b[0] for b in both] or [np.empty(0, np.uint64)])
        self.weight = np.concatenate([b[1] for b in both] or [np.empty(0)])
        self.start = np.r_[0, np.cumsum([len(b[0]) for b in both], dtype=np.int64)].astype(np.int64)
        self.total = np.array([b[1].sum() for b in both])

    def jaccard(self, x: int, others: np.ndarray, plain: bool = False) -> np.ndarray:
        """Weighted Jaccard similarity of set x to others, some at a time; with ``plain`` the unweighted one where it is greater."""
        mine, w = self.shingle[self.start[x] : self.start[x + 1]], self.weight[self.start[x] : self.start[x + 1]]
        out = np.zeros(len(others))
        sizes = self.start[others + 1] - self.start[others]
        at = 0
        while len(mine) and at < len(others):
            to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 1 << 20)))
            some, size = others[at:to], sizes[at:to]
            where = ragged(self.start[some], size)
            their = self.shingle[where]
            k = np.minimum(np.searchsorted(mine, their), len(mine) - 1)
            number, same = np.repeat(np.arange(len(some)), size), mine[k] == their
            met = np.bincount(number, np.where(same, np.minimum(w[k], self.weight[where]), 0.0), len(some))
            out[at:to] = met / (self.total[x] + self.total[some] - met)
            if plain:
                both = np.bincount(number, same, len(some))
                out[at:to] = np.maximum(out[at:to], both / (len(mine) + size - both))
            at = to
        return out


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that come sorted by keys."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < most:
            continue
        table = pa.Table.from_batches(held)
        at = group_starts(table, keys)[1:]
        if len(at):
            yield table.slice(0, at[-1]).combine_chunks()
            table = table.slice(at[-1])
        held, size = table.combine_chunks().to_batches(), 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def signatures_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), -1)


def searched(sig: np.ndarray, need: int, linked: Callable[[int, np.ndarray], np.ndarray] = lambda y, near: near) -> np.ndarray:
    """For each text the first one of its class: a search from text to text over links, each pair looked at once at most.

    linked(text, others that agree with it in ``need`` samples) picks those with a link.
    """
    label = np.full(len(sig), -1)
    free = np.arange(len(sig))
    for x in range(len(sig)):
        if label[x] >= 0:
            continue
        label[x] = x
        free = free[free != x]
        queue = [x]
        while queue and len(free):
            y = queue.pop()
            near = free[agree(sig[free] == sig[y], need)]
            if not len(near):
                continue
            found = linked(y, near)
            label[found] = x
            queue += found.tolist()
            free = free[label[free] < 0]
    return label


def proposed(texts: DataFrame, need: int, crowd: int) -> DataFrame:
    """(u, v) links that bring candidates together, from texts (node, signature, bands).

    Texts of a bucket that agree in ``need`` samples, directly or by others of
    the bucket, get into one component.  So do all texts of a bucket of more
    than ``crowd``: they are told apart by large_classes.
    """
    keys = texts.select("node", F.explode("bands").alias("key"))
    often = common.stash(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).filter("n > 1"), "buckets")
    members = keys.join(often, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, ["key"]):
            start = group_starts(table, ["key"])
            size = np.diff(np.r_[start, table.num_rows])
            node, sig = table.column("node").to_numpy(), signatures_of(table.column("signature"))
            head = np.repeat(start, size)
            near = agree(sig == sig[head], need)
            for g in np.flatnonzero(~np.logical_and.reduceat(near, start)):  # not all agree with the first
                here = slice(start[g], start[g] + size[g])
                head[here] = start[g] + searched(sig[here], need)
            other = head != np.arange(len(head))
            yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[head[other]])], ["u", "v"])

    usual = members.filter(F.col("n") <= crowd).join(texts.select("node", "signature"), "node").select("key", "node", "signature")
    usual = usual.repartition(common.shuffle_width(texts.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")
    hot = members.filter(F.col("n") > crowd).select(F.col("node").alias("u"), F.col("least").alias("v")).filter("u <> v")
    return common.stash(usual.unionByName(hot), "proposed")


def classes_in(sets: Weighted, sig: np.ndarray, similarity: float, need: int) -> np.ndarray:
    return searched(sig, need, lambda y, near: near[sets.jaccard(y, near, sig.shape[1] > SAMPLES) >= similarity])


def block_classes(rows: DataFrame, similarity: float, need: int) -> DataFrame:
    """(node, class) by all links inside each block of rows (block, node, signature, set); class is one of the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, ["block"], 1000):
            start = np.r_[group_starts(table, ["block"]), table.num_rows]
            for a, b in zip(start[:-1], start[1:], strict=True):
                part = table.slice(a, b - a)
                node = part.column("node").to_numpy()
                got = classes_in(Weighted(part.column("set").to_pylist()), signatures_of(part.column("signature")), similarity, need)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[got])], ["node", "class"])

    dealt = rows.select("block", "node", "signature", "set").repartition(common.shuffle_width(rows.sparkSession), "block")
    return dealt.sortWithinPartitions("block", F.xxhash64("node")).mapInArrow(run, "node long, class long")


class Unions:
    """Sets of class numbers that links make one."""

    def __init__(self, n: int):
        self.over = np.arange(n)

    def join(self, of: int, others: np.ndarray) -> None:
        self.over[np.isin(self.over, self.over[others])] = self.over[of]


def across(sig: np.ndarray, group: Callable[[], np.ndarray], side: np.ndarray, halves: bool, band: int, need: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text, later texts of other groups that agree with it in ``need`` samples and have no band before ``band`` in common).

    With ``halves`` only texts of different sides meet.  group may change meanwhile.
    """
    for y in range(len(sig)):
        rest = np.arange(y + 1, len(sig))
        rest = rest[(group()[rest] != group()[y]) & (not halves or side[rest] != side[y])]
        if not len(rest):
            continue
        same = sig[rest] == sig[y]
        near = agree(same, need) & ~same[:, : band * ROWS].reshape(len(rest), band, ROWS).all(axis=2).any(axis=1)
        if near.any():
            yield y, rest[near]


def border_links(own: DataFrame, bands: DataFrame, similarity: float, need: int, crowd: int) -> DataFrame:
    """Links (u, v) between the classes of own (label, node, class, signature, set): all pairs with a band in common.

    Only buckets with several classes are looked at.  There the texts of the
    commonest class and the others are dealt to blocks of at most about
    ``crowd``, and each block of others meets each block: a bucket of one large
    class and a few others grows in proportion.  Signatures meet first; sets
    follow where they agree with a text of another class.
    """
    keyed = own.select("label", "node", "class").join(bands, "node").select("label", "node", "class", F.posexplode("bands").alias("band", "key"))
    keyed = common.stash(keyed, "keyed")
    at = ["label", "band", "key"]
    sizes = keyed.groupBy(*at, "class").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy(*at).agg(F.sum("n").alias("all"), F.max(F.struct("n", "class")).alias("top"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    mixed = mixed.select(*at, F.col("top.class").alias("main"), F.ceil(F.col("top.n") / crowd).alias("mains"), F.ceil((F.col("all") - F.col("top.n")) / crowd).alias("rest"))
    # blocks of others are 0, 1, ..; those of the main class -1, -2, ..
    dealt = keyed.join(mixed, at).withColumn("is_main", F.col("class") == F.col("main"))
    dealt = dealt.withColumn("side", F.when(F.col("is_main"), -1 - F.pmod(F.xxhash64("node"), "mains")).otherwise(F.pmod(F.xxhash64("node"), "rest")))
    meets = F.when(F.col("is_main"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(-F.col("mains"), F.col("rest") - 1))
    dealt = dealt.withColumn("other", F.explode(meets))
    place = [*at, "one", "two"]
    dealt = dealt.select(*at, F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"), "side", "node", "class")

    def parts(table: pa.Table) -> tuple:
        _, group = np.unique(table.column("class").to_numpy(), return_inverse=True)
        first = table.slice(0, 1).to_pylist()[0]
        return table.column("node").to_numpy(), signatures_of(table.column("signature")), group, table.column("side").to_numpy(), first["one"] != first["two"], first["band"]

    def meet(table: pa.Table) -> pa.Table:
        _, sig, group, side, halves, band = parts(table)
        hit = np.zeros(len(sig), bool)
        for y, near in across(sig, lambda: group, side, halves, band, need):
            hit[y] = hit[near] = True
        return table.select([*place, "side", "node", "class"]).filter(pa.array(hit))

    def verify(table: pa.Table) -> pa.Table:
        node, sig, group, side, halves, band = parts(table)
        sets, unions = Weighted(table.column("set").to_pylist()), Unions(group.max() + 1)
        u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for y, near in across(sig, lambda: unions.over[group], side, halves, band, need):
            linked = near[sets.jaccard(y, near, sig.shape[1] > SAMPLES) >= similarity]
            if len(linked):
                unions.join(group[y], group[linked])
                u.append(node[linked])
                v.append(np.full(len(linked), node[y]))
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)})

    kind = "label long, band int, key long, one long, two long, side long, node long, class long"
    signed = dealt.join(own.select("node", "signature"), "node")
    hit = common.stash(signed.groupBy(*place).applyInArrow(meet, kind), "borders")
    whole = hit.join(own.select("node", "signature", "set"), "node")
    out = common.stash(whole.groupBy(*place).applyInArrow(verify, "u long, v long"), "links")
    common.discard(keyed, hit)
    return out


def large_classes(large: DataFrame, bands: DataFrame, similarity: float, need: int, crowd: int, room: int) -> DataFrame:
    """(node, class) of components that are too large for one task: large (label, node, cells, band, signature, set).

    Blocks hold texts with the same first band, as far as they go together; one
    text of each class of the blocks meets those of other blocks of its label,
    as long as that makes them much fewer.  Whatever is apart then meets in
    border_links, so that no link between classes is lost.
    """
    by = large.groupBy("label", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("cells").alias("cells"))
    cut = lambda n, cells: F.ceil(F.greatest(F.col(n) / crowd, F.col(cells) / room))
    by = by.withColumn("own", cut("n", "cells"))
    rest = by.filter("own = 1").groupBy("label").agg(F.sum("n").alias("rn"), F.sum("cells").alias("rc")).select("label", cut("rn", "rc").alias("spread"))
    where = common.stash(by.select("label", "band", "own").join(rest, "label", "left"), "where")
    block = F.when(F.col("own") > 1, F.xxhash64("label", "band", F.pmod(F.xxhash64("node"), "own"))).otherwise(F.xxhash64("label", F.pmod(F.xxhash64("band"), "spread")))
    now = common.stash(block_classes(large.join(where, ["label", "band"]).withColumn("block", block), similarity, need), "blocks")
    links = now.select(F.col("node").alias("u"), F.col("class").alias("v"))
    heads, before = now.select(F.col("class").alias("node")).distinct(), None
    while True:
        heads = common.stash(large.select("label", "node", "cells").join(heads, "node"), "heads")
        of = heads.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("cells").alias("cells")).withColumn("blocks", cut("n", "cells"))
        of = of if before is None else of.join(before, "label").filter(F.col("n") <= F.col("was") / 2).drop("was")
        of = common.stash(of.filter("n > 1"), "of")
        if of.isEmpty():
            break
        mine = heads.join(of.select("label", "blocks", "n"), "label").withColumn("block", F.xxhash64("label", F.pmod(F.xxhash64("node", "n"), "blocks")))
        now = common.stash(block_classes(mine.select("node", "block").join(large.select("node", "signature", "set"), "node"), similarity, need), "blocks")
        links = links.unionByName(now.select(F.col("node").alias("u"), F.col("class").alias("v")))
        heads = now.select(F.col("class").alias("node")).distinct()
        # those that one block held whole have met
        before = of.filter("blocks > 1").select("label", F.col("n").alias("was"))
    links = common.stash(links.filter("u <> v"), "links")
    found = components(links).select("node", F.col("label").alias("class"))
    own = large.select("label", "node", "signature", "set").join(found, "node", "left").withColumn("class", F.coalesce("class", "node"))
    own = common.stash(own, "own")
    more = border_links(own, bands, similarity, need, crowd)
    out = components(links.unionByName(more)).select("node", F.col("label").alias("class"))
    common.discard(own)
    return out


SIGNED = "doc_id long, h1 long, h2 long, node long, cells int, signature binary, bands array<long>, set binary"


def signed_rows(df: DataFrame, plain: bool = False) -> DataFrame:
    """A stashed row for each of ``doc_id, text``: node (its number), signature, bands and weighted set (null without words)."""
    held = packs.packed(df, True, "packs")
    rows = held.agg(F.sum("n")).first()[0] or 0

    def ask(texts: list[bytes], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([shingles(part)[1] for _, part in parts_of(texts)] or [np.empty(0, np.uint64)]), return_counts=True)

    told = packs.answers(held, packs.buckets_for(held, 6), ask, lambda hashes, n: idf_steps(frequencies(hashes, n), rows), "idf")

    def sign(pack: dict, steps: np.ndarray) -> pa.Table:
        n = pack["n"]
        found = [(at, *shingles(part)) for at, part in parts_of(packs.texts_of(pack["texts"], np.array(pack["ends"], np.int64)))]
        known = np.unique(np.concatenate([f[2] for f in found] or [np.empty(0, np.uint64)]))
        cols: list[list] = [[0] * n, [None] * n, [None] * n, [None] * n]
        for at, text, shingle, times in found:
            if not len(text):
                continue
            step = steps[np.searchsorted(known, shingle)]
            starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            got = samples(shingle, times * (step / 8.0), starts)
            if plain:
                got = np.hstack([got, minima(shingle, starts)])
            keys = np.empty((len(got), got.shape[1] // ROWS), np.uint64)
            for b in range(keys.shape[1]):
                z = np.full(len(got), b + 1, np.uint64)
                for k in range(ROWS):
                    z = mix(z ^ got[:, b * ROWS + k].astype(np.uint64)) + U(k + 1)
                keys[:, b] = z
            for i, (a, b) in enumerate(zip(starts, np.r_[starts[1:], len(text)], strict=True)):
                k = at + int(text[a])
                cols[0][k], cols[1][k], cols[2][k], cols[3][k] = int(b - a), got[i].tobytes(), keys[i].view(np.int64).tolist(), set_bytes(shingle[a:b], step[a:b], times[a:b])
        ids = [pa.array(pack[c], pa.int64()) for c in ("doc", "h1", "h2")]
        kinds = (pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary())
        return pa.table([*ids, pa.array(packs.row_ids(pack["pack"], n)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in SIGNED.split(", ")])

    out = common.stash(packs.with_answers(held, told, sign, SIGNED), "signatures")
    common.discard(held, told)
    return out


def near_duplicates(df: DataFrame, similarity: float = 0.8, agreement: float = 0.5, crowd: int = 2000, room: int = 1 << 20, plain: bool = False) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), and h1, h2 (two hashes of the text) of each row of ``doc_id, text``.

    Classes are components of links: equal texts, and texts whose weighted
    Jaccard similarity is at least ``similarity``.  A link is found unless all
    bands miss it (9e-5 at 0.8, less above) or less than ``agreement`` of the
    samples agree (1e-5).  With ``plain`` texts whose shingle sets have that
    plain Jaccard similarity are links too (missed with 8e-4 at 0.8, 6e-6 at
    0.9), so that a text's group and the table may be of any size.  A task compares about ``crowd`` texts or ``room``
    shingles (or one longer text) at once; larger components of candidates are
    dealt to several, with the same links.

    Null text is an empty text; texts without words are only grouped with equal
    ones.  Rows without doc_id take part; if a class has no doc_id, class_id is
    the number of one of its rows, less 2^63.  Repeated rows are all reported.
    A text of n bytes takes about 12 n bytes in a task.  Further columns are not
    read.  An empty table gives no rows.
    """
    spark = df.sparkSession
    signed = signed_rows(df.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")), plain)
    need = int(np.ceil(agreement * SAMPLES))
    equal = ["h1", "h2"]
    same = signed.groupBy(*equal).agg(F.min("node").alias("node"), F.min("doc_id").alias("first_doc"))
    same = common.stash(same, "texts")
    # of each text the row with the least number stands for all
    texts = signed.select("node", "cells", "signature", "bands").filter("cells > 0").join(same.select("node"), "node", "left_semi")
    texts = common.stash(texts, "signed")
    labels = components(proposed(texts.select("node", "signature", "bands"), need, crowd))
    sizes = labels.join(texts.select("node", "cells"), "node").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("cells").alias("total"))
    placed = labels.join(sizes, "label").join(signed.select("node", "cells", "signature", F.col("bands")[0].alias("band"), "set"), "node")
    whole = common.stash(placed, "candidates")
    fits = (F.col("n") <= crowd) & (F.col("total") <= room)
    classes = block_classes(whole.filter(fits).withColumnRenamed("label", "block"), similarity, need)
    large = whole.filter(~fits)
    if not large.isEmpty():
        classes = classes.unionByName(large_classes(large.drop("n", "total"), texts.select("node", "bands"), similarity, need, crowd, room))
    classes = common.stash(classes, "classes")
    known = same.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    known = common.stash(known, "known")
    names = known.groupBy("class").agg(F.coalesce(F.min("first_doc"), F.first("class") + F.lit(-(1 << 63))).alias("class_id"))
    told = known.join(names, "class").select(*equal, "class_id")
    out = common.stash(signed.select("doc_id", *equal).join(told, equal).select("doc_id", "class_id", *equal), "near")
    common.discard(signed, same, texts, whole, classes, known)
    return out


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), plain=True).select("doc_id", "class_id")
