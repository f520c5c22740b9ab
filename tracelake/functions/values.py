"""Values of expressions: constants folded on the driver, and real or complex columns with one set of functions over them.

A complex value is a pair of columns; as a table column it is ``struct<re:double,im:double>``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import ieee

# Fixed values.
CONSTANTS = {"e": math.e, "pi": math.pi, "mho": 1.0, "s": 1.0, "t": 1e12, "g": 1e9, "meg": 1e6, "k": 1e3, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15}


@dataclass(frozen=True)
class Value:
    """``const`` has the number of a constant; else ``re`` and, if complex, ``im`` have columns. ``span``: constant, full, or step. ``plain``: a variable as it is."""

    const: np.generic | None = None
    re: Column | None = None
    im: Column | None = None
    span: str = "constant"
    plain: bool = False

    @property
    def is_complex(self) -> bool:
        return np.iscomplexobj(self.const) if self.const is not None else self.im is not None

    def parts(self) -> tuple[Column, Column | None]:
        if self.const is None:
            return self.re, self.im
        return F.lit(float(self.const.real)), F.lit(float(self.const.imag)) if self.is_complex else None

    def column(self) -> Column:
        re, im = self.parts()
        return re if im is None else F.struct(re.alias("re"), im.alias("im"))


def constant(x: complex | float) -> Value:
    return Value(np.complex128(x) if isinstance(x, complex | np.complexfloating) else np.float64(x))


def vector(re: Column, im: Column | None = None, span: str = "full", plain: bool = False) -> Value:
    return Value(None, re, im, span, plain)


def _span(args: tuple[Value, ...]) -> str:
    spans = {a.span for a in args} - {"constant"}
    if len(spans) > 1:
        raise ValueError("values of one step and of all steps can't be combined")
    return spans.pop() if spans else "constant"


Pair = tuple[Column, Column]


def _lift(x: Value) -> Pair:
    re, im = x.parts()
    return re, F.lit(0.0) if im is None else im


def apply(fold: Callable, real: Callable | None, cplx: Callable | None, *args: Value) -> Value:
    """``fold`` for constants; ``real`` takes and gives columns; ``cplx`` takes pairs and gives a pair, or a column for a real result."""
    span = _span(args)
    if span == "constant":
        with np.errstate(all="ignore"):
            out = fold(*(a.const for a in args))
        return constant(complex(out) if np.iscomplexobj(out) else float(out))
    if any(a.is_complex for a in args):
        if cplx is None:
            raise ValueError("this function has no complex form")
        out = cplx(*(_lift(a) for a in args))
        return vector(*out, span) if isinstance(out, tuple) else vector(out, None, span)
    return vector(real(*(a.parts()[0] for a in args)), None, span)


# Complex formulas on pairs of columns


def mul(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def div(a: Pair, b: Pair) -> Pair:
    """The divisor is scaled by its larger part, so that its square neither overflows nor vanishes."""
    large = F.greatest(F.abs(b[0]), F.abs(b[1]))
    size = F.when((large == 0) | (large == float("inf")), F.lit(1.0)).otherwise(large)
    u, v = b[0] / size, b[1] / size
    q = u * u + v * v
    return ieee.divide(ieee.divide(a[0] * u + a[1] * v, q), size), ieee.divide(ieee.divide(a[1] * u - a[0] * v, q), size)


def modulus(a: Pair) -> Column:
    return F.hypot(a[0], a[1])


def argument(a: Pair) -> Column:
    return ieee.atan2(a[1], a[0])


def exp(a: Pair) -> Pair:
    return F.exp(a[0]) * F.cos(a[1]), F.exp(a[0]) * F.sin(a[1])


def log(a: Pair) -> Pair:
    return ieee.ln(modulus(a)), argument(a)


def sqrt(a: Pair) -> Pair:
    """The larger part by a sum, the smaller one by division, so that no digits cancel."""
    m, side = modulus(a), F.when(a[1] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    large = F.sqrt((m + F.abs(a[0])) / 2)
    small = F.when(m == 0, F.lit(0.0)).when(m == float("inf"), F.sqrt((m - F.abs(a[0])) / 2)).otherwise(ieee.divide(F.abs(a[1]), 2 * large))
    right = a[0] >= 0
    return F.when(right, large).otherwise(small), side * F.when(right, small).otherwise(large)


def power(a: Pair, b: Pair) -> Pair:
    m, t = modulus(a), argument(a)
    size = F.exp(b[0] * ieee.ln(m) - b[1] * t)
    turn = b[0] * t + b[1] * ieee.ln(m)
    zero = (F.when((b[0] == 0) & (b[1] == 0), F.lit(1.0)).when((b[0] > 0) & (b[1] == 0), F.lit(0.0)).otherwise(F.lit(ieee.NAN)), F.when(b[1] == 0, F.lit(0.0)).otherwise(F.lit(ieee.NAN)))
    return F.when(m == 0, zero[0]).otherwise(size * F.cos(turn)), F.when(m == 0, zero[1]).otherwise(size * F.sin(turn))


def _sin(a):
    return F.sin(a[0]) * F.cosh(a[1]), F.cos(a[0]) * F.sinh(a[1])


def _cos(a):
    return F.cos(a[0]) * F.cosh(a[1]), -F.sin(a[0]) * F.sinh(a[1])


def _tan(a):
    along, across = _ratio(a[1], a[0])
    return across, along


def _sinh(a):
    return F.sinh(a[0]) * F.cos(a[1]), F.cosh(a[0]) * F.sin(a[1])


def _cosh(a):
    return F.cosh(a[0]) * F.cos(a[1]), F.sinh(a[0]) * F.sin(a[1])


def _ratio(x: Column, y: Column) -> Pair:
    """tanh(x + iy) by powers of exp(-2|x|), which can't overflow."""
    t = F.exp(-2 * F.abs(x))
    d = 1 + t * t + 2 * t * F.cos(2 * y)
    return ieee.divide(F.signum(x) * -F.expm1(-4 * F.abs(x)), d), ieee.divide(2 * t * F.sin(2 * y), d)


def _tanh(a):
    return _ratio(a[0], a[1])


def _below(y: Column) -> Column:
    """Whether y is negative, -0.0 included: on a cut the sign of zero names the side."""
    return ieee.atan2(y, F.lit(-1.0)) < 0


def _asinh(v: Column) -> Column:
    """Of a number that isn't negative, without loss for small ones or overflow for large ones."""
    return F.when(v > 1e8, ieee.ln(v) + math.log(2)).otherwise(F.log1p(v + v * v / (1 + F.sqrt(1 + v * v))))


def _roots(a: Pair) -> tuple[Pair, Pair, Column]:
    """The square roots of 1 - z and 1 + z above the real axis, all four parts not negative, and the height of asin: sums of products, so nothing cancels."""
    y = F.abs(a[1])
    p, q = sqrt((1 - a[0], y)), sqrt((1 + a[0], y))
    height = _asinh(p[0] * q[1] + p[1] * q[0])
    return p, q, F.when(_below(a[1]), -height).otherwise(height)


def _named(f: Callable[[Pair], Pair]) -> Callable[[Pair], Pair]:
    """``f`` of a pair that is made once, however often the formula names it. Spark interprets such a formula, which takes several times as long as compiled code."""

    def run(a: Pair) -> Pair:
        made = F.transform(F.array(F.struct(a[0].alias("x"), a[1].alias("y"))), lambda z: F.struct(*[v.alias(n) for v, n in zip(f((z["x"], z["y"])), ("re", "im"), strict=True)]))
        return F.get(made, F.lit(0))["re"], F.get(made, F.lit(0))["im"]

    return run


def _asin(a):
    p, q, height = _roots(a)
    return ieee.atan2(a[0], p[0] * q[0] + p[1] * q[1]), height


def _acos(a):
    p, q, height = _roots(a)
    return 2 * ieee.atan2(p[0], q[0]), -height


def _atan(a):
    x, y, m = a[0], F.abs(a[1]), modulus(a)
    near = F.hypot(x, 1 - y)
    height = F.log1p(4 * ieee.divide(ieee.divide(y, near), near)) / 4
    # Far away only the side counts; squares would overflow.
    far = m > 1e100
    along = F.when(far, ieee.atan2(2 * ieee.divide(ieee.divide(x, m), m), F.lit(-1.0))).otherwise(ieee.atan2(2 * x, (1 - y) * (1 + y) - x * x))
    return along / 2, F.when(_below(a[1]), -height).otherwise(height)


def _less(a: Pair, b: Pair) -> Column:
    return (a[0] < b[0]) | (a[0] == b[0]) & (a[1] < b[1])


def _pick(small: bool):
    def choose(*xs: Pair) -> Pair:
        out = xs[0]
        for x in xs[1:]:
            bad = F.isnan(out[0]) | F.isnan(out[1])
            first = bad | ~(F.isnan(x[0]) | F.isnan(x[1])) & (_less(out, x) if small else _less(x, out))
            out = F.when(first, out[0]).otherwise(x[0]), F.when(first, out[1]).otherwise(x[1])
        return out

    return choose


def _fold_least(*xs):
    out = xs[0]
    for x in xs[1:]:
        out = np.minimum(out, x)
    return out


def _fold_greatest(*xs):
    out = xs[0]
    for x in xs[1:]:
        out = np.maximum(out, x)
    return out


# Operators


def add(a, b):
    return apply(np.add, lambda x, y: x + y, lambda x, y: (x[0] + y[0], x[1] + y[1]), a, b)


def subtract(a, b):
    return apply(np.subtract, lambda x, y: x - y, lambda x, y: (x[0] - y[0], x[1] - y[1]), a, b)


def multiply(a, b):
    return apply(np.multiply, lambda x, y: x * y, mul, a, b)


def divide(a, b):
    return apply(np.divide, ieee.divide, div, a, b)


def raise_to(a, b):
    return apply(np.power, F.pow, power, a, b)


def negate(a):
    return apply(np.negative, lambda x: -x, lambda x: (-x[0], -x[1]), a)


def equal(a, b):
    return apply(lambda x, y: float(x == y), lambda x, y: ieee.number(ieee.equal(x, y)), lambda x, y: ieee.number(ieee.equal(x[0], y[0]) & ieee.equal(x[1], y[1])), a, b)


def unequal(a, b):
    return apply(lambda x, y: float(x != y), lambda x, y: ieee.number(~ieee.equal(x, y)), lambda x, y: ieee.number(~(ieee.equal(x[0], y[0]) & ieee.equal(x[1], y[1]))), a, b)


def ordered(op: str):
    fold = {"<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}[op]
    real = lambda x, y: ieee.number(ieee.compare(op, x, y))
    return lambda a, b: apply(lambda x, y: float(fold(x.real, y.real)), real, lambda x, y: real(x[0], y[0]), a, b)


def truth(a: Value) -> Column:
    """Where the real part isn't 0; NaN counts as true."""
    return a.parts()[0] != 0


def invert(a):
    return apply(lambda x: float(x.real == 0), lambda x: ieee.number(x == 0), lambda x: ieee.number(x[0] == 0), a)


def _real_only(fold, real):
    """For functions of the real parts."""
    return lambda *a: apply(lambda *x: fold(*(v.real for v in x)), real, lambda *x: real(*(v[0] for v in x)), *a)


def _unary(fold, real, cplx):
    return lambda a: apply(fold, real, cplx, a)


def _inverse(fold, real, cplx):
    """For asin and acos: of a variable they are compiled, of anything else its value is made once. Compiled, atan takes longer than interpreted."""
    named = _named(cplx)
    return lambda a: apply(fold, real, cplx if a.plain else named, a)


def _abs_power(signed: bool):
    def real(x, y):
        size = F.pow(F.abs(x), y)
        return F.signum(x) * size if signed else size

    def cplx(x, y):
        size = F.pow(modulus(x), y[0])
        return F.signum(x[0]) * size if signed else size

    def fold(x, y):
        size = np.power(np.abs(x), y.real)
        return np.sign(x.real) * size if signed else size

    return lambda a, b: apply(fold, real, cplx, a, b)


_magnitude = _unary(np.abs, F.abs, modulus)
_ln = _unary(np.log, ieee.ln, log)
_degrees = _unary(lambda x: np.degrees(np.angle(x)), lambda x: F.degrees(F.atan2(F.lit(0.0), x)), lambda x: F.degrees(argument(x)))
_asin_f, _acos_f, _atan_f = _inverse(np.arcsin, F.asin, _asin), _inverse(np.arccos, F.acos, _acos), _unary(np.arctan, F.atan, _named(_atan))
_sign = _real_only(np.sign, F.signum)

#: name: (least and most arguments, function of Values)
FUNCTIONS: dict[str, tuple[int, int | None, Callable[..., Value]]] = {
    "abs": (1, 1, _magnitude),
    "mag": (1, 1, _magnitude),
    "sqrt": (1, 1, _unary(np.sqrt, F.sqrt, sqrt)),
    "log": (1, 1, _ln),
    "ln": (1, 1, _ln),
    "log10": (1, 1, _unary(np.log10, ieee.log10, lambda a: tuple(x / math.log(10) for x in log(a)))),
    "db": (1, 1, _unary(lambda x: 20 * np.log10(np.abs(x)), lambda x: 20 * ieee.log10(F.abs(x)), lambda x: 20 * ieee.log10(modulus(x)))),
    "real": (1, 1, _unary(np.real, lambda x: x, lambda x: x[0])),
    "imag": (1, 1, _unary(np.imag, lambda x: x * 0.0, lambda x: x[1])),
    "conj": (1, 1, _unary(np.conj, lambda x: x, lambda x: (x[0], -x[1]))),
    "angle": (1, 1, _degrees),
    "ph": (1, 1, _degrees),
    "phase": (1, 1, _degrees),
    "sin": (1, 1, _unary(np.sin, F.sin, _sin)),
    "cos": (1, 1, _unary(np.cos, F.cos, _cos)),
    "tan": (1, 1, _unary(np.tan, F.tan, _tan)),
    "asin": (1, 1, _asin_f),
    "arcsin": (1, 1, _asin_f),
    "acos": (1, 1, _acos_f),
    "arccos": (1, 1, _acos_f),
    "atan": (1, 1, _atan_f),
    "arctan": (1, 1, _atan_f),
    "atan2": (2, 2, _real_only(np.arctan2, ieee.atan2)),
    "sinh": (1, 1, _unary(np.sinh, F.sinh, _sinh)),
    "cosh": (1, 1, _unary(np.cosh, F.cosh, _cosh)),
    "tanh": (1, 1, _unary(np.tanh, F.tanh, _tanh)),
    "exp": (1, 1, _unary(np.exp, F.exp, exp)),
    "sqr": (1, 1, _unary(lambda x: x * x, lambda x: x * x, lambda x: mul(x, x))),
    "sign": (1, 1, _sign),
    "sgn": (1, 1, _sign),
    "uramp": (1, 1, _real_only(lambda x: np.maximum(x, 0.0), ieee.ramp)),
    "round": (1, 1, _unary(np.round, F.rint, lambda x: (F.rint(x[0]), F.rint(x[1])))),
    "floor": (1, 1, _unary(np.floor, ieee.floor, None)),
    "ceil": (1, 1, _unary(np.ceil, ieee.ceil, None)),
    "int": (1, 1, _unary(np.trunc, ieee.truncate, None)),
    "pow": (2, 2, raise_to),
    "pwr": (2, 2, _abs_power(False)),
    "pwrs": (2, 2, _abs_power(True)),
    "min": (1, None, lambda *a: apply(_fold_least, ieee.least, _pick(True), *a)),
    "max": (1, None, lambda *a: apply(_fold_greatest, ieee.greatest, _pick(False), *a)),
    "limit": (3, 3, lambda x, lo, hi: apply(lambda v, a, b: np.minimum(np.maximum(v, a), b), lambda v, a, b: ieee.least(ieee.greatest(v, a), b), lambda v, a, b: _pick(True)(_pick(False)(v, a), b), x, lo, hi)),
}
