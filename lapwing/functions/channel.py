"""The functions of derived channels, as functions on Columns.

Elementwise ones take and give Columns. Those that look along the samples take an `Along` that
names the session key, the order and the sample rate, and become window expressions. There is no
text form of their own: expressions are written as Columns, or as SQL with `F.expr`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lapwing.functions.missing import INF, NAN, compare, divide, finite, flag, floor_mod, log_or_nan, pairwise, present, truth


@dataclass(frozen=True)
class Along:
    """Samples of one session in order."""

    session: str = "session_id"
    order: str = "i"
    rate: float = 1.0

    @property
    def rows(self):
        return Window.partitionBy(self.session).orderBy(self.order)

    @property
    def upto(self):
        return self.rows.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def back(self):
        """From the last sample to this one; frames that begin at the current row are quadratic."""
        return Window.partitionBy(self.session).orderBy(F.desc(self.order)).rowsBetween(Window.unboundedPreceding, 0)

    @property
    def whole(self):
        return Window.partitionBy(self.session)

    @property
    def dt(self) -> float:
        return 1.0 / self.rate


def trunc(v: Column) -> Column:
    return F.when(v >= 0, F.floor(v).cast("double")).otherwise(F.when(v < 0, F.ceil(v).cast("double")).otherwise(v))


def _bits(v: Column) -> Column:
    return F.when(finite(v), F.rint(v)).cast("long")


def _domain(v: Column, ok: Column, f: Callable[[Column], Column]) -> Column:
    return F.when(ok, f(v)).otherwise(F.when(v.isNotNull(), F.lit(NAN)))


#: Elementwise functions by name.
SCALAR: dict[str, Callable[..., Column]] = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh,
    "acosh": lambda v: _domain(v, v >= 1, F.acosh), "atanh": lambda v: F.when(F.abs(v) == 1, F.signum(v) * F.lit(INF)).otherwise(_domain(v, F.abs(v) < 1, F.atanh)),
    "ln": log_or_nan, "log": lambda v: log_or_nan(v, True), "exp": F.exp, "exp10": lambda v: F.pow(F.lit(10.0), v), "sqr": lambda v: v * v, "sqrt": F.sqrt, "power": F.pow, "hypot": F.hypot,
    "int": trunc, "round": F.rint, "round_down": lambda v: F.floor(v).cast("double"), "round_up": lambda v: F.ceil(v).cast("double"), "frac": lambda v: v - trunc(v), "remainder": floor_mod,
    "sgn": F.signum, "abs": F.abs, "min": lambda a, b: pairwise(a, b, True), "max": lambda a, b: pairwise(a, b, False),
    "choose": lambda c, a, b: F.when(truth(c), a).otherwise(b), "invalid": lambda: F.lit(NAN),
    "bit_and": lambda a, b: _bits(a).bitwiseAND(_bits(b)).cast("double"), "bit_or": lambda a, b: _bits(a).bitwiseOR(_bits(b)).cast("double"), "bit_xor": lambda a, b: _bits(a).bitwiseXOR(_bits(b)).cast("double"), "bit_not": lambda a: F.bitwise_not(_bits(a)).cast("double"),
}

#: Operators by sign; comparisons and logic give 1.0 or 0.0.
OPERATORS: dict[str, Callable[..., Column]] = {
    "||": lambda a, b: flag(truth(a) | truth(b)), "&&": lambda a, b: flag(truth(a) & truth(b)), "|": SCALAR["bit_or"], "&": SCALAR["bit_and"],
    **{s: (lambda how: lambda a, b: compare(a, b, how))(s) for s in ("==", "!=", "<", "<=", ">", ">=")},
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "%": floor_mod, "^": F.pow, "!": lambda a: flag(~truth(a)), "~": SCALAR["bit_not"], "neg": lambda a: -a,
}


# Functions along the samples.


def segment(reset: Column, a: Along) -> Column:
    """Number of the segment; each sample whose reset holds begins one."""
    return F.sum(truth(reset).cast("long")).over(a.upto)


def interval_stat(name: str, v: Column, a: Along, seg: str, condition: Column | None = None) -> Column:
    """One constant per segment (a column's name), over its finite samples where the condition holds."""
    w = Window.partitionBy(a.session, seg)
    v = present(v if condition is None else F.when(truth(condition), v))
    order = F.when(v.isNotNull(), F.col(a.order))
    return {"stat_min": F.min(v), "stat_max": F.max(v), "stat_mean": F.avg(v), "stat_std_dev": F.stddev_pop(v), "stat_start": F.min_by(v, order), "stat_end": F.max_by(v, order)}[name].over(w)


def smooth(v: Column, a: Along, points: int = 5) -> Column:
    """Centred moving average of an odd number of points; the ends count on beyond the edges."""
    h = (points | 1) // 2
    w = a.rows.rowsBetween(-h, h)
    n, place = F.count(F.lit(1)).over(a.whole), F.row_number().over(a.rows)
    before, after = F.greatest(F.lit(0), h + 1 - place), F.greatest(F.lit(0), place + h - n)
    total = F.sum(v).over(w) + before * F.first(v).over(a.upto) + after * F.last(v).over(a.whole.orderBy(a.order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    whole = F.count(F.when(~F.isnan(v), v)).over(w) == F.count(F.lit(1)).over(w)
    return F.when(whole, total / (2 * h + 1))


def derivative(v: Column, a: Along, window: int = 3) -> Column:
    """Difference over the window, which is cut at the ends."""
    h = max(1, window // 2)
    w = a.rows.rowsBetween(-h, h)
    span = F.count(F.lit(1)).over(w) - 1
    return F.when(span > 0, (F.last(v).over(w) - F.first(v).over(w)) / (span * a.dt))


def integrate(v: Column, a: Along, seg: str | None = None, gate: Column | None = None) -> Column:
    """Trapezoids summed from the segment's first sample, which is 0; gated samples add theirs."""
    step = 0.5 * (v + F.lag(v).over(a.rows)) * a.dt
    if gate is not None:
        step = F.when(truth(gate), step).otherwise(0.0)
    if seg is None:
        return F.coalesce(F.sum(step).over(a.upto), F.lit(0.0))
    w = Window.partitionBy(a.session, seg).orderBy(a.order)
    step = F.when(F.row_number().over(w) == 1, 0.0).otherwise(step)
    return step  # sum it over `w` in a further projection: windows don't nest


def flip_flop(on: Column, off: Column, a: Along) -> Column:
    """1 after a set until a reset; both at once: 0."""
    last = lambda c: F.coalesce(F.max(F.when(truth(c), F.col(a.order))).over(a.upto), F.lit(-1))
    return flag(last(on) > last(off))


def time_valid(condition: Column, a: Along, seconds: float) -> Column:
    """1 where the condition has held for so long: samples since it last failed, times the step."""
    failed = F.coalesce(F.max(F.when(~truth(condition), F.row_number().over(a.rows))).over(a.upto), F.lit(0))
    return flag((F.row_number().over(a.rows) - failed - 1) * a.dt >= seconds)


def time_shift(v: Column, a: Along, seconds: float) -> Column:
    """The series later by so many seconds, linear between samples; NULL where there is none."""
    k = seconds * a.rate
    whole = int(k // 1)
    part = k - whole
    at = lambda n: F.lag(v, n).over(a.rows) if n >= 0 else F.lead(v, -n).over(a.rows)
    return at(whole) if part == 0 else at(whole) * (1 - part) + at(whole + 1) * part


def range_is(t: Column, start: float, end: float) -> Column:
    return flag(t.between(start, end))


def range_change(t: Column, a: Along, start: float, end: float) -> Column:
    """1 at the sample where the range is entered."""
    inside = t.between(start, end)
    return flag(inside & ~F.coalesce(F.lag(inside).over(a.rows), F.lit(False)))


def edge_delay(v: Column, a: Along, samples: int, mode: int = -1) -> Column:
    """The flags of a signal, delayed by `samples`: 0 moves the rising edges, 1 the falling ones, other modes the whole signal.

    With moved edges the flag is up while the last rising edge, as moved, lies after the last falling
    one. NULL counts as down.
    """
    up = F.coalesce(truth(v), F.lit(False))
    if samples <= 0:
        return flag(up)
    if mode not in (0, 1):
        return flag(F.coalesce(F.lag(up, samples).over(a.rows), F.lit(False)))
    was, place = F.coalesce(F.lag(up).over(a.rows), F.lit(False)), F.row_number().over(a.rows)
    latest = lambda edge, later: F.coalesce(F.max(F.when(edge, place + later)).over(a.upto), F.lit(0))
    return flag(latest(up & ~was, samples if mode == 0 else 0) > latest(~up & was, samples if mode == 1 else 0))


def fill_gaps(v: Column, a: Along) -> Column:
    """The last valid value; before the first, the first."""
    v = present(v)
    return F.coalesce(F.last(v, True).over(a.upto), F.last(v, True).over(a.back))


def battery_power(power: Column | None, current: Column, voltage: Column, has_power: Column) -> Column:
    """Power channel where it says anything, else -current x voltage in kW above 100 V, else 0."""
    own = F.coalesce(F.when(voltage > 100, -current * voltage / 1000), F.lit(0.0))
    return own if power is None else F.when(has_power, power).otherwise(own)
