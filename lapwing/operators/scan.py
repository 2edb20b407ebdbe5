"""Scans along a session in blocks: what depends on all rows before, without one task per session.

A session's rows are cut into blocks. Each block is scanned on its own (one window per block), the blocks'
totals, few rows per session, are scanned after another, and what comes before a block is merged into its rows.
Any associative state will do: sums, extremes, the last value there was, a latch, islands, the two numbers
of a recursive filter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 100_000


def row_block(order: str = "i", rows: int = BLOCK_ROWS) -> Column:
    """Blocks by an integer (or metre) place in the session."""
    return F.floor(F.col(order) / rows)


def time_block(seconds: float, t: str = "t") -> Column:
    """Blocks by time: at most the rate times `seconds` rows each."""
    return F.floor(F.col(t) / seconds)


@dataclass(frozen=True)
class Fold:
    """How a state goes along: within a block (given a window up to the row), a block's total, over the blocks before, and both merged."""

    local: Callable[[WindowSpec], Column]
    total: Column
    carry: Callable[[Column, WindowSpec], Column]
    merge: Callable[[Column, Column], Column]


def total(v: Column) -> Fold:
    """Running sum; missing values add nothing."""
    zero = F.lit(0)
    return Fold(lambda w: F.sum(v).over(w), F.sum(v), lambda t, w: F.sum(t).over(w), lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero))


def largest(v: Column) -> Fold:
    return Fold(lambda w: F.max(v).over(w), F.max(v), lambda t, w: F.max(t).over(w), F.greatest)


def smallest(v: Column) -> Fold:
    return Fold(lambda w: F.min(v).over(w), F.min(v), lambda t, w: F.min(t).over(w), F.least)


def latest(v: Column, order: Sequence[str], backwards: bool = False) -> Fold:
    """The last value that isn't null, up to and with the row (`backwards`: from the row on)."""
    end = (F.min_by if backwards else F.max_by)(v, F.when(v.isNotNull(), F.struct(*order)))
    return Fold(lambda w: F.last(v, True).over(w), end, lambda t, w: F.last(t, True).over(w), F.coalesce)


def latch(on: Column, off: Column, order: Sequence[str]) -> Fold:
    """True from a row where `on` holds, until `off` does; where both do it is off. Null before the first of either."""
    return latest(F.when(off, False).when(on, True), order)


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, folds: dict[str, Fold], backwards: bool = False) -> DataFrame:
    """Adds a column per fold. `block` must not fall along `order`, within `keys`; a null key is a session of blocks that don't know of each other."""
    way = (lambda c: F.desc(c)) if backwards else F.asc
    cut = df.withColumn("__block", block)
    upto = Window.partitionBy(*keys, "__block").orderBy(*map(way, order)).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *(f.local(upto).alias(f"__l{k}") for k, f in enumerate(folds.values())))
    before = Window.partitionBy(*keys).orderBy(way("__block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "__block").agg(*(f.total.alias(f"__t{k}") for k, f in enumerate(folds.values())))
    carried = totals.select(*keys, "__block", *(f.carry(F.col(f"__t{k}"), before).alias(f"__c{k}") for k, f in enumerate(folds.values())))
    merged = [f.merge(F.col(f"__l{k}"), F.col(f"__c{k}")).alias(out) for k, (out, f) in enumerate(folds.items())]
    return local.join(carried, [*keys, "__block"], "left").select(*(F.col(f"`{c}`") for c in df.columns if c not in folds), *merged)


def islands(df: DataFrame, keys: Sequence[str], order: str, block: Column, of: Sequence[str], starts: Callable[[Column, Column], Column], out: str = "island") -> DataFrame:
    """Numbers stretches from 0; `starts(row, before)`, on structs of the columns `of`, says where one begins (as does null, and the first row)."""
    state = lambda: F.struct(*of)
    begins = lambda row, before: F.coalesce(starts(row, before), F.lit(True)).cast("long")
    cut = df.withColumn("__block", block)
    w = Window.partitionBy(*keys, "__block").orderBy(order)
    cut = cut.withColumn("__row", state()).withColumn("__before", F.lag("__row").over(w))
    cut = cut.withColumn("__new", F.when(F.col("__before").isNull(), F.lit(0)).otherwise(begins(F.col("__row"), F.col("__before"))))
    local = cut.withColumn("__n", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__row", "__before", "__new")
    ends = cut.groupBy(*keys, "__block").agg(F.sum("__new").alias("__inside"), F.min_by("__row", order).alias("__first"), F.max_by("__row", order).alias("__last"))
    along = Window.partitionBy(*keys).orderBy("__block")
    before = F.lag("__last").over(along)
    ends = ends.select(*keys, "__block", "__inside", F.when(before.isNull(), F.lit(1)).otherwise(begins(F.col("__first"), before)).alias("__begins"))
    base = F.sum(F.col("__inside") + F.col("__begins")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__inside") - 1
    ends = ends.select(*keys, "__block", base.alias("__base"))
    return local.join(ends, [*keys, "__block"], "left").withColumn(out, (F.col("__n") + F.coalesce("__base", F.lit(0))).cast("long")).drop("__block", "__n", "__base")


@dataclass(frozen=True)
class Biquad:
    """A second-order Butterworth low pass: y = b x + s1, s1' = 2 b x - a1 y + s2, s2' = b x - a2 y."""

    b: float
    a1: float
    a2: float

    @classmethod
    def lowpass(cls, cutoff: float, rate: float) -> Biquad:
        k = np.tan(np.pi * cutoff / rate)
        norm = 1 / (1 + np.sqrt(2) * k + k * k)
        return cls(float(k * k * norm), float(2 * (k * k - 1) * norm), float((1 - np.sqrt(2) * k + k * k) * norm))

    @property
    def poles(self) -> tuple[float, float, float]:
        """Radius, imaginary part and angle of the poles of these very coefficients; in doubles the difference would lose half its digits at low cutoffs."""
        side = math.sqrt(Fraction(self.a2) - Fraction(self.a1) ** 2 / 4)
        return math.sqrt(self.a2), side, math.atan2(side, -self.a1 / 2)

    def run(self, x: np.ndarray, s1: float = 0.0, s2: float = 0.0) -> tuple[np.ndarray, float, float]:
        """The output and the state after it. Lanes of a long series step together, then each gets what the one before leaves."""
        if len(x) < 4096:
            return self._short(x, s1, s2)
        lanes = 256
        rows = len(x) // lanes
        y, e1, e2 = self._steps(x[: rows * lanes].reshape(rows, lanes))
        power = np.linalg.matrix_power(np.array([[-self.a1, 1], [-self.a2, 0]], np.longdouble), lanes)
        state = np.zeros((rows + 1, 2), np.longdouble)
        state[0] = s1, s2
        for k in range(rows):
            state[k + 1] = power @ state[k] + (e1[k], e2[k])
        free, entered = self.free(np.arange(lanes)), state[:-1].astype(float)
        y += entered[:, :1] * free[0] + entered[:, 1:] * free[1]
        tail, s1, s2 = self._short(x[rows * lanes :], *map(float, state[-1]))
        return np.concatenate([y.ravel(), tail]), s1, s2

    def _short(self, x: np.ndarray, s1: float, s2: float) -> tuple[np.ndarray, float, float]:
        out, b, a1, a2 = [], self.b, self.a1, self.a2
        for v in x.tolist():
            y = b * v + s1
            s1, s2 = 2 * b * v - a1 * y + s2, b * v - a2 * y
            out.append(y)
        return np.array(out, float), s1, s2

    def _steps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row from rest."""
        y = np.empty_like(x)
        one, two = np.zeros(len(x)), np.zeros(len(x))
        for k in range(x.shape[1]):
            v = x[:, k]
            out = self.b * v + one
            one, two = 2 * self.b * v - self.a1 * out + two, self.b * v - self.a2 * out
            y[:, k] = out
        return y, one, two

    def free(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What s1 = 1 and s2 = 1 alone give at step n: by the poles r e^(+-i angle), which are never real."""
        r, sine, angle = self.poles
        rn, c, s = r**n, np.cos(n * angle), np.sin(n * angle)
        return rn * (c + (-self.a1 / 2) / sine * s), rn * s / sine

    def free_response(self, n: str, s1: str, s2: str) -> str:
        """SQL of the output at step n of the state (s1, s2) left alone."""
        r, sine, angle = self.poles
        turned = f"({s1} * {-self.a1 / 2 / sine!r}D + {s2} / {sine!r}D)"
        return f"pow({r!r}D, {n}) * ({s1} * cos({n} * {angle!r}D) + {turned} * sin({n} * {angle!r}D))"


def biquad(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, f: Biquad, backwards: bool = False, rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds `out`, the filter along each series of `keys`, from rest. `value` has no missing numbers.

    Each block that has one after it is filtered from rest and leaves its state; states go from block to block, and then
    every block is filtered from the state that enters it. Equal places of `order` aren't defined.
    """
    way = F.desc if backwards else F.asc
    cut = df.withColumn("__block", F.floor(F.col(order) / rows))
    tail = cut.groupBy(*keys).agg((F.min if backwards else F.max)("__block").alias("__tail"))
    slim = cut.select(*keys, "__block", F.col(order).alias("__o"), F.col(value).cast("double").alias("__x"))
    slim = slim.join(tail, list(keys)).where(F.col("__block") != F.col("__tail")).select(*keys, "__block", "__o", "__x", F.xxhash64(*keys, "__block").alias("__g"))
    named = [(k, df.schema[k].dataType.simpleString()) for k in keys]
    left = slim.repartition(*keys, "__block").sortWithinPartitions("__g", way("__o"))
    left = left.mapInArrow(lambda batches: _states(batches, f, keys), ", ".join(f"`{k}` {t}" for k, t in named) + ", __block long, __n long, __s1 double, __s2 double")
    last = F.max(F.struct(F.col("__n").alias("n"), F.col("__s1").alias("s1"), F.col("__s2").alias("s2")))
    ends = left.groupBy(*keys, "__block").agg(last.alias("e"))
    # a block of n samples makes of the entering state (o1, o2) what it becomes alone, and what the block left itself
    blocks = F.sort_array(F.collect_list(F.struct("__block", "e.n", "e.s1", "e.s2")), not backwards)
    after = f"'o1', {f.free_response('x.n', 's.o1', 's.o2')} + x.s1, 'o2', {-f.a2!r}D * ({f.free_response('(x.n - 1)', 's.o1', 's.o2')}) + x.s2"
    none = "cast(array() as array<struct<b:bigint,o1:double,o2:double>>)"
    step = f"transform(array(named_struct('b', x.`__block`, {after})), a -> named_struct('o1', a.o1, 'o2', a.o2, 'all', concat(s.all, array(a))))[0]"
    states = ends.groupBy(*keys).agg(blocks.alias("__all")).select(*keys, F.inline(F.expr(f"aggregate(__all, named_struct('o1', 0.0D, 'o2', 0.0D, 'all', {none}), (s, x) -> {step}, s -> s.all)")))
    states = states.select(*keys, (F.col("b") + (-1 if backwards else 1)).alias("__next"), "o1", "o2")
    # blocks without samples leave the state as it is: a block is entered by what the nearest one before it left
    entered = cut.select(*keys, "__block").distinct().withColumn("__prior", F.lag("__block").over(Window.partitionBy(*keys).orderBy(way("__block"))))
    entered = entered.withColumn("__next", F.col("__prior") + (-1 if backwards else 1)).join(states, [*keys, "__next"], "left").select(*keys, "__block", F.coalesce("o1", F.lit(0.0)).alias("__i1"), F.coalesce("o2", F.lit(0.0)).alias("__i2"))
    rest = [c for c in df.columns if c != out]
    whole = cut.withColumn("__x", F.col(value).cast("double")).join(entered, [*keys, "__block"], "left").withColumn("__g", F.xxhash64(*keys, "__block"))
    whole = whole.select(*rest, "__x", "__g", "__i1", "__i2").repartition("__g").sortWithinPartitions("__g", way(order))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return whole.mapInArrow(lambda batches: _filtered(batches, f, rest, out), f"{schema}, `{out}` double")


def _groups(batches: Iterator[pa.RecordBatch], f: Biquad) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, int, float, float]], np.ndarray]]:
    """Each batch with its runs of one block (begin, end, samples of the block so far, state) and the output; a block may go on in the next batch."""
    block, n, s1, s2 = None, 0, 0.0, 0.0
    for batch in batches:
        g, x = batch.column("__g").to_numpy(), batch.column("__x").to_numpy(zero_copy_only=False)
        first = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("__i1", "__i2")] if "__i1" in batch.schema.names else None
        edges = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)] if len(g) else [0]
        runs, y = [], np.empty(len(g))
        for a, b in zip(edges, edges[1:], strict=False):
            if g[a] != block:
                block, n = g[a], 0
                s1, s2 = (first[0][a], first[1][a]) if first else (0.0, 0.0)
            y[a:b], s1, s2 = f.run(x[a:b], s1, s2)
            n += b - a
            runs.append((a, b, n, s1, s2))
        yield batch, runs, y


def _states(batches: Iterator[pa.RecordBatch], f: Biquad, keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for batch, runs, _ in _groups(batches, f):
        if runs:
            at = pa.array([a for a, *_ in runs])
            state = [pa.array([r[k] for r in runs], kind) for k, kind in ((2, pa.int64()), (3, pa.float64()), (4, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (*keys, "__block")), *state], [*keys, "__block", "__n", "__s1", "__s2"])


def _filtered(batches: Iterator[pa.RecordBatch], f: Biquad, rest: Sequence[str], out: str) -> Iterator[pa.RecordBatch]:
    for batch, _, y in _groups(batches, f):
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(y)], [*rest, out])
