"""Grouped moments: the one distributed aggregation behind every linear fit.

Few columns: one pass of JVM aggregates (count, avg, covar_pop), which merge
partial sums by the pairwise update.  Many columns: numpy partials for each task
and group, merged in a second stage by the same update (Chan, Golub & LeVeque
1979), so that the driver gets a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfit.functions.columns import INF, c

#: Up to so many features and outputs the aggregates stay in the JVM.
NATIVE = 12
MERGERS = 32


@dataclass
class Moments:
    """Row count, means and centred sums; of Y'Y only the diagonal."""

    n: int
    x: np.ndarray
    y: np.ndarray
    sxx: np.ndarray
    sxy: np.ndarray
    syy: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def empty(cls, p: int, q: int) -> Moments:
        return cls(0, np.zeros(p), np.zeros(q), np.zeros((p, p)), np.zeros((p, q)), np.zeros(q), np.full(q, np.inf), np.full(q, -np.inf))

    def __add__(self, o: Moments) -> Moments:
        n = self.n + o.n
        if not self.n or not o.n:
            return o if o.n else self
        dx, dy, w = o.x - self.x, o.y - self.y, self.n * o.n / n
        return Moments(n, self.x + dx * o.n / n, self.y + dy * o.n / n, self.sxx + o.sxx + w * np.outer(dx, dx), self.sxy + o.sxy + w * np.outer(dx, dy), self.syy + o.syy + w * dy * dy, np.minimum(self.low, o.low), np.maximum(self.high, o.high))

    def __sub__(self, o: Moments) -> Moments:
        """What is left without o; low and high stay those of all."""
        n = self.n - o.n
        if not o.n or not n:
            return self if n else Moments.empty(len(self.x), len(self.y))
        x, y = (self.x * self.n - o.x * o.n) / n, (self.y * self.n - o.y * o.n) / n
        dx, dy, w = o.x - x, o.y - y, n * o.n / self.n
        return Moments(n, x, y, self.sxx - o.sxx - w * np.outer(dx, dx), self.sxy - o.sxy - w * np.outer(dx, dy), np.maximum(self.syy - o.syy - w * dy * dy, 0), self.low, self.high)

    def features(self, pick: list[int]) -> Moments:
        return Moments(self.n, self.x[pick], self.y, self.sxx[np.ix_(pick, pick)], self.sxy[pick], self.syy, self.low, self.high)

    @property
    def x_scale(self) -> np.ndarray:
        return _scale(np.diag(self.sxx), self.n)

    @property
    def y_scale(self) -> np.ndarray:
        return _scale(self.syy, self.n)

    @property
    def y_range(self) -> np.ndarray:
        return self.high - self.low

    def sse(self, B: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared errors of y ~ B x + b by output, at least 0 (B: outputs x features)."""
        gap = self.y - B @ self.x - b
        return np.maximum(self.syy - 2 * np.einsum("qp,pq->q", B, self.sxy) + np.einsum("qp,pr,qr->q", B, self.sxx, B) + self.n * gap * gap, 0)

    def to_bytes(self) -> bytes:
        return b"".join(np.asarray(v, "<f8").tobytes() for v in (self.n, self.x, self.y, self.sxx, self.sxy, self.syy, self.low, self.high))

    @classmethod
    def from_bytes(cls, data: bytes, p: int, q: int) -> Moments:
        v, parts, at = np.frombuffer(data, "<f8"), [], 1
        for shape in ((p,), (q,), (p, p), (p, q), (q,), (q,), (q,)):
            size = int(np.prod(shape))
            parts.append(v[at : at + size].reshape(shape).copy())
            at += size
        return cls(int(v[0]), *parts)

    @classmethod
    def of(cls, X: np.ndarray, Y: np.ndarray) -> Moments:
        x, y = X.mean(0), Y.mean(0)
        A, B = X - x, Y - y
        return cls(len(X), x, y, A.T @ A, A.T @ B, (B * B).sum(0), Y.min(0), Y.max(0))


def _scale(s: np.ndarray, n: int) -> np.ndarray:
    """Population standard deviations; 1 where a column is constant."""
    sd = np.sqrt(np.maximum(s, 0) / max(n, 1))
    return np.where(sd > 0, sd, 1.0)


def _whole(odd: list[str]) -> None:
    if odd:
        raise ValueError(f"columns with missing or non-finite values: {odd}")


def _native(df: DataFrame, xs: list[str], ys: list[str], by: list[str]) -> dict[tuple, Moments]:
    names = [*xs, *ys]
    p, q = len(xs), len(ys)
    x = {n: c(n).cast("double") for n in names}
    pairs = [(i, j) for i in range(p + q) for j in range(i, p + q) if i < p or i == j]
    finite = lambda v: ~F.isnan(v) & (F.abs(v) != INF)
    whole = [F.count_if(~F.coalesce(finite(x[n]), F.lit(False))).alias(f"odd{i}") for i, n in enumerate(names)]
    aggs = [F.count(F.lit(1)).alias("n"), *whole, *(F.avg(x[n]).alias(f"m{i}") for i, n in enumerate(names)), *(F.covar_pop(x[names[i]], x[names[j]]).alias(f"s{i}_{j}") for i, j in pairs), *(f(x[n]).alias(f"{k}{i}") for k, f in (("lo", F.min), ("hi", F.max)) for i, n in enumerate(ys))]
    out = {}
    for r in df.groupBy(*map(c, by)).agg(*aggs).collect():
        if not r["n"]:
            continue
        _whole([n for i, n in enumerate(names) if r[f"odd{i}"]])
        m = Moments.empty(p, q)
        m.n = r["n"]
        mean = np.array([r[f"m{i}"] for i in range(p + q)])
        m.x, m.y = mean[:p], mean[p:]
        for i, j in pairs:
            s = r[f"s{i}_{j}"] * m.n
            if j < p:
                m.sxx[i, j] = m.sxx[j, i] = s
            elif i < p:
                m.sxy[i, j - p] = s
            else:
                m.syy[i - p] = s
        m.low, m.high = (np.array([r[f"{k}{i}"] for i in range(q)]) for k in ("lo", "hi"))
        out[tuple(r[len(by) * 0 : len(by)])] = m
    return out


def _dense(df: DataFrame, xs: list[str], ys: list[str], by: list[str]) -> dict[tuple, Moments]:
    p, q = len(xs), len(ys)
    key = F.to_json(F.struct(*map(c, by))) if by else F.lit("")
    flat = df.select(key.alias("_key"), F.array(*(c(n).cast("double") for n in [*xs, *ys])).alias("_v"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Moments] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode()
            V = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p + q)
            at = codes.indices.to_numpy()
            for k, name in enumerate(codes.dictionary.to_pylist()):
                rows = V[at == k]
                total[name] = total.get(name, Moments.empty(p, q)) + Moments.of(rows[:, :p], rows[:, p:])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([m.to_bytes() for m in total.values()], pa.binary())], ["key", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Moments] = {}
        for batch in batches:
            for name, data in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                total[name] = total.get(name, Moments.empty(p, q)) + Moments.from_bytes(data, p, q)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([m.to_bytes() for m in total.values()], pa.binary())], ["key", "data"])

    kind = "key string, data binary"
    # partials of tasks meet in MERGERS tasks, theirs in one for each group: the driver gets one of each
    merged = flat.mapInArrow(partial, kind).repartition(MERGERS).mapInArrow(merge, kind).repartition(MERGERS, "key").mapInArrow(merge, kind)
    out: dict[str, Moments] = {}
    for r in merged.toLocalIterator():
        m = out[r.key] = Moments.from_bytes(bytes(r.data), p, q)
        _whole([n for n, v in zip([*xs, *ys], [*np.diag(m.sxx) + m.x, *m.syy + m.y], strict=True) if not np.isfinite(v)])
    if not by:
        return {(): m for m in out.values()}
    names = {r[-1]: tuple(r[:-1]) for r in df.select(*map(c, by), key.alias("_key")).distinct().collect()}
    return {names[k]: m for k, m in out.items()}


def moments(df: DataFrame, features: list[str], outputs: list[str], by: list[str] = ()) -> dict[tuple, Moments]:
    """Moments of each group (one tuple of values of ``by``; () for all rows).

    Missing and non-finite values are errors, by either route.
    """
    by = list(by)
    found = (_native if len(features) + len(outputs) <= NATIVE else _dense)(df, list(features), list(outputs), by)
    return found or ({} if by else {(): Moments.empty(len(features), len(outputs))})
