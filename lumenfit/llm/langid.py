"""Language ID by a byte convolutional network (operator 8).

Texts are cut into windows of fixed length.  Bytes are embedded, filters of
several widths run over them, each filter's largest response in a window is
kept, and a softmax layer gives the languages.  The network is trained in numpy
on the driver from a bounded sample; prediction runs over all windows of every
text, and a text's windows vote by their mean log-probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lumenfit.llm import common

UNKNOWN = "und"


@dataclass
class ByteNet:
    """Filters of all widths stand in one kernel, narrow ones with zeros behind them."""

    langs: list[str]
    embed: np.ndarray  # 256 x d; byte 0 is padding and stays zero
    kernel: np.ndarray  # widest * d x filters
    bias: np.ndarray
    out: np.ndarray  # filters x languages
    out_bias: np.ndarray
    window: int

    def columns(self, x: np.ndarray) -> np.ndarray:
        """windows x positions x (widest * d) of windows x bytes."""
        d, widest = self.embed.shape[1], len(self.kernel) // self.embed.shape[1]
        seen = self.embed[np.pad(x, ((0, 0), (0, widest - 1)))]
        cols = np.empty((*x.shape, widest * d), dtype=np.float32)
        for j in range(widest):
            cols[:, :, j * d : (j + 1) * d] = seen[:, j : j + x.shape[1]]
        return cols

    def log_probs(self, x: np.ndarray, rows: int = 64) -> np.ndarray:
        """Of windows x bytes, a few windows at a time so that responses stay in the CPU's cache."""
        out = np.empty((len(x), len(self.langs)), dtype=np.float32)
        for at in range(0, len(x), rows):
            part = x[at : at + rows]
            pooled = (self.columns(part).reshape(-1, len(self.kernel)) @ self.kernel).reshape(len(part), self.window, -1).max(axis=1)
            z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
            out[at : at + rows] = z - np.logaddexp.reduce(z, axis=1, keepdims=True)
        return out


def train(windows: np.ndarray, labels: list[str], widths=(2, 3, 4), filters: int = 20, dim: int = 6, epochs: int = 6, batch: int = 64, rate: float = 3e-3, seed: int = 7) -> ByteNet:
    """Adam on the cross-entropy; windows is an array of n x length bytes."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    y = np.array([langs.index(v) for v in labels])
    widest, total = max(widths), filters * len(widths)
    mask = np.zeros((widest * dim, total), dtype=np.float32)
    for k, w in enumerate(widths):
        mask[: w * dim, k * filters : (k + 1) * filters] = 1
    scale = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
    embed = rng.normal(0, 1, (256, dim)).astype(np.float32)
    embed[0] = 0
    net = ByteNet(langs, embed, scale(widest * dim, total) * mask, np.zeros(total, np.float32), scale(total, len(langs)), np.zeros(len(langs), np.float32), windows.shape[1])
    names = ("embed", "kernel", "bias", "out", "out_bias")
    first, second = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            grad = gradients(net, windows[pick], y[pick], mask)
            step += 1
            for name, g in grad.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                change = rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, (getattr(net, name) - change).astype(np.float32))
    return net


def gradients(net: ByteNet, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of windows x with labels y; mask is 1 where the kernel may differ from 0."""
    n, (inputs, total), dim = len(x), net.kernel.shape, net.embed.shape[1]
    widest = inputs // dim
    cols = net.columns(x)
    resp = (cols.reshape(-1, inputs) @ net.kernel).reshape(n, net.window, -1)
    best = resp.argmax(axis=1)
    top = np.take_along_axis(resp, best[:, None], 1)[:, 0] + net.bias
    h = np.maximum(top, 0)
    z = h @ net.out + net.out_bias
    p = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
    p[np.arange(n), y] -= 1
    p /= n
    dh = (p @ net.out.T) * (top > 0)
    won = cols[np.arange(n)[:, None], best]  # n x filters x inputs: where the filter responded most
    back = (dh[:, :, None] * net.kernel.T[None]).reshape(n, total, widest, dim)
    place = np.pad(x, ((0, 0), (0, widest - 1)))[np.arange(n)[:, None, None], best[:, :, None] + np.arange(widest)]
    embed = np.zeros_like(net.embed)
    np.add.at(embed, place.reshape(-1), back.reshape(-1, dim))
    embed[0] = 0
    return {"embed": embed, "kernel": np.einsum("nfi,nf->if", won, dh) * mask, "bias": dh.sum(0), "out": h.T @ p, "out_bias": p.sum(0)}


def cut(raw: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, padded with 0, and the number of each text."""
    n = np.array([max(1, -(-len(r) // length)) for r in raw], dtype=np.int64)
    flat = np.zeros(int(n.sum()) * length, dtype=np.uint8)
    at = 0
    for r, k in zip(raw, n, strict=True):
        flat[at : at + len(r)] = np.frombuffer(r, np.uint8)
        at += int(k) * length
    return flat.reshape(-1, length), n


#: More languages than this are taken for a mistake in the labels; the sample that the driver gets grows with them.
MOST_LANGUAGES = 500


def sampled(labelled: DataFrame, per_lang: int, salts: int = 32) -> DataFrame:
    """At most per_lang rows of each language, those with the least hashes; a language is dealt to ``salts`` groups.

    Hashes alone are ordered, and rows with one hash (repeated ones) give one.
    """
    marked = labelled.select("lang", "text", F.xxhash64("doc_id", "text", "lang").alias("o"))
    by = W.partitionBy("lang", "salt").orderBy("o")
    told = marked.select("lang", "o").withColumn("salt", F.pmod(F.shiftright("o", 20), F.lit(salts)))
    least = told.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= max(1, per_lang // salts)).select("o").distinct()
    least = common.stash(least, "sample")
    if least.count() > MOST_LANGUAGES * per_lang:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return marked.join(F.broadcast(least), "o", "left_semi").dropDuplicates(["o"])


def training_windows(labelled: DataFrame, per_lang: int, per_doc: int, length: int) -> tuple[np.ndarray, list[str]]:
    """Windows spread over the sampled texts, and their languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for lang, text, order in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, _ = cut([text.encode()], length)
                for k in np.unique(np.linspace(0, len(found) - 1, per_doc).astype(int)):
                    out.append((order, lang, found[k].tobytes()))
            if out:
                kinds = (pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["o", "lang", "bytes"])

    part = sampled(labelled, per_lang).select("lang", "text", "o")
    rows = part.mapInArrow(run, "o long, lang string, bytes binary").collect()
    rows.sort(key=lambda r: (r.o, r.lang, bytes(r.bytes)))
    return np.array([np.frombuffer(bytes(r.bytes), np.uint8) for r in rows]).reshape(len(rows), length), [r.lang for r in rows]


def predict(df: DataFrame, net: ByteNet | None) -> DataFrame:
    """``df`` with lang_pred and score (the probability of lang_pred; 0.0 with ``und``).

    A text that is null or has no letter is ``und``; so is every text if nothing
    could be learned.  Of equally probable languages the first by name is taken;
    equal texts get equal answers.  All windows of a text vote, however long it
    is.  Only ``text`` is read; other columns stay, and those named lang_pred or
    score are replaced.
    """
    df = df.drop("lang_pred", "score")
    fields = [*df.schema.fields]
    at = df.columns.index("text")
    schema = df.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            known = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
            pred, score = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows)
            rows = np.flatnonzero(known) if net else []
            sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
            k = 0
            while k < len(rows):  # about 2 MB of text at once
                to = k + max(1, int(np.searchsorted(np.cumsum(sizes[rows[k:]]), 2 << 20)))
                part = rows[k:to]
                x, n = cut([t.encode() for t in text.take(pa.array(part)).to_pylist()], net.window)
                mean = np.add.reduceat(net.log_probs(x), np.cumsum(n) - n, axis=0) / n[:, None]
                p = np.exp(mean - np.logaddexp.reduce(mean, axis=1, keepdims=True))
                best = p.argmax(axis=1)
                pred[part], score[part] = np.array(net.langs, dtype=object)[best], p[np.arange(len(best)), best]
                k = to
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], [*(f.name for f in fields), "lang_pred", "score"])

    return df.mapInArrow(run, schema)


def fit(labelled: DataFrame, per_lang: int = 384, per_doc: int = 3, length: int = 256) -> ByteNet | None:
    """The network learned from ``doc_id, text, lang`` rows; None without usable ones.

    At most per_lang rows of each language are used, those with the least hashes,
    and per_doc windows of each; repeated rows count once, and rows without
    doc_id, lang or a letter don't count.  More than MOST_LANGUAGES languages are
    an error.
    """
    usable = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = usable.filter("doc_id IS NOT NULL AND lang IS NOT NULL").filter(F.col("text").rlike(r"\p{L}"))
    x, y = training_windows(usable, per_lang, per_doc, length)
    return train(x, y) if len(x) else None


def held_out() -> F.Column:
    """Rows that nothing is learned from: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    net = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
