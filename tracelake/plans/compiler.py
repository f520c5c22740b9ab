"""Expressions over a table of points, compiled to columns.

Names, functions and step selectors are resolved on the driver; what is left is a plain Catalyst expression. Functions of the user are
expanded where they are called. A step selector is a join on the place within the step.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import values as V
from tracelake.functions.values import Value
from tracelake.plans import units
from tracelake.plans.syntax import PROBES, AtStep, Binary, Call, Choice, Function, Name, Number, Unary, canonical, is_network_name, parse, parse_function, probe_key
from tracelake.sources.columns import ColumnStore

_ALIASES = itertools.count()
_BINARY = {"+": V.add, "-": V.subtract, "*": V.multiply, "/": V.divide, "^": V.raise_to, "==": V.equal, "!=": V.unequal} | {op: V.ordered(op) for op in ("<", "<=", ">", ">=")}


@dataclass(frozen=True)
class Variable:
    """A column of the points under the name that expressions use."""

    name: str
    column: str
    unit: str = ""
    kind: str = ""
    is_complex: bool = False
    #: Columns of a source that the column is made of; none for the column itself.
    uses: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Compiled:
    text: str
    value: Value
    unit: str
    selectors: tuple = ()
    #: Columns of the points, and those of a source that they are made of.
    columns: frozenset[str] = frozenset()
    uses: frozenset[str] = frozenset()

    @property
    def is_complex(self) -> bool:
        return self.value.is_complex


@dataclass
class Points:
    """A table of points with its variables and functions.

    ``keys`` name the columns that tell tables of points apart (files); ``step`` and ``step_idx`` number the steps and the points in each. ``n_steps`` is needed
    for selectors only. ``scan`` gives the points with these columns alone, where a source can leave out others; ``derived`` are the columns made from them since.
    """

    df: DataFrame
    variables: dict[str, Variable]
    functions: dict[str, Function] = field(default_factory=dict)
    keys: tuple[str, ...] = ()
    step: str = "step"
    step_idx: str = "step_idx"
    n_steps: int | None = None
    scan: Callable[[frozenset[str]], DataFrame] | None = None
    derived: tuple[tuple[str, Compiled], ...] = ()
    #: Where evaluated columns are kept and found again; None keeps none.
    store: ColumnStore | None = None
    #: Expressions compiled so far; a copy with other variables starts anew.
    _compiled: dict[str, Compiled] = field(default_factory=dict, init=False, repr=False, compare=False)

    @classmethod
    def of(cls, df: DataFrame, variables: list[Variable], functions: list[str] = (), **more) -> Points:
        """Bad function definitions are left out, as are functions that call themselves, by others or not; of two equal names the later one counts."""
        known: dict[str, Function] = {}
        for text in functions:
            try:
                f = parse_function(text)
            except ValueError:
                continue
            known[f.name.casefold()] = f
        return cls(df, {v.name.casefold(): v for v in variables}, without_recursion(known), **more)

    def search(self, part: str = "") -> list[str]:
        return [v.name for v in self.variables.values() if part.casefold() in v.name.casefold()]

    def compile(self, text: str) -> Compiled:
        """Text that is a variable's whole name, such as one made by an operator, is that variable."""
        if text in self._compiled:
            return self._compiled[text]
        work = _Work(self)
        if (known := self.variables.get(text.casefold())) is not None:
            return Compiled(known.name, work.variable(text.casefold()), known.unit, (), frozenset(work.columns), frozenset(work.uses))
        tree = parse(text)
        value = work.value(tree, {}, ())
        unit = units.infer(tree, {k: v.unit for k, v in self.variables.items()}, self.functions)
        found = Compiled(canonical(tree), value, unit, tuple(work.selectors), frozenset(work.columns), frozenset(work.uses))
        if not found.selectors:  # their joins have names of their own each time
            self._compiled[text] = found
        return found

    def resolved(self, texts: list[str]) -> list[Compiled]:
        """Those of the texts that compile."""
        out = []
        for text in texts:
            try:
                out.append(self.compile(text))
            except ValueError:
                continue
        return out

    def joined(self, compiled: Compiled) -> DataFrame:
        """The points with what the expression's selectors need."""
        df = self.df
        for alias, column, step in compiled.selectors:
            on = [*self.keys, self.step_idx]
            side = self.df.filter(F.col(self.step) == step - 1).select(*on, column.alias(alias))
            df = df.join(side, on, "left")
        return df

    def stored_in(self, folder: str, identity: str, keys: tuple[str, ...]) -> Points:
        """The points with a folder in which their evaluated columns are kept, under ``identity``; ``keys`` tell points apart."""
        return replace(self, store=ColumnStore(self.df.sparkSession, folder, identity, (*self.keys, *(k for k in keys if k not in self.keys))))

    def narrowed(self, wanted: list[Compiled], keep: tuple[str, ...]) -> Points:
        """The points over a scan of what the expressions and ``keep`` use."""
        if self.scan is None:
            return replace(self)
        made = dict(self.derived)
        kept = frozenset().union(*[made[c].uses if c in made else {c} for c in keep])
        out = replace(self, df=self.scan(kept.union(*[c.uses for c in wanted])))
        needed = set(keep).union(*[c.columns for c in wanted])
        for column, c in reversed(self.derived):
            needed |= c.columns if column in needed else set()
        for column, c in self.derived:
            if column in needed:
                out = replace(out, df=out.joined(c).withColumn(column, c.value.column()).select(*out.df.columns, column))
        return out

    def over(self, scan: Callable[[frozenset[str]], DataFrame]) -> Points:
        """The same variables over other rows."""
        wanted = frozenset(v.column for v in self.variables.values() if not v.uses) | {"x"}
        out = replace(self, df=scan(wanted), scan=scan)
        return replace(out, df=out.narrowed([], tuple(out.df.columns) + tuple(c for c, _ in self.derived)).df)

    def evaluate(self, *texts: str, keep: tuple[str, ...] = ()) -> DataFrame:
        """``keep`` and a column for each expression, named by its canonical text, with the unit in its metadata."""
        done = [self.compile(t) for t in texts]
        if self.store is not None:
            return self._from_store(done, keep)
        return self._made(done, keep)

    def _from_store(self, wanted: list[Compiled], keep: tuple[str, ...]) -> DataFrame:
        """Stored columns joined by the points' keys; those that aren't stored yet are made first. What ``keep`` names besides keys comes from the points."""
        keys = self.store.keys
        for c in {c.text: c for c in wanted}.values():
            if self.store.find(c.text) is None:
                self.store.put(c.text, self._made([c], keys).toDF(*keys, "value"))
        others = tuple(k for k in keep if k not in keys)
        out = self._made([], (*keys, *others)) if others or not wanted else None
        for k, c in enumerate(wanted):
            column = self.store.find(c.text).withColumnRenamed("value", f"__v{k}")
            out = column if out is None else out.join(column, list(keys))
        return out.select(*keep, *[F.col(f"__v{k}").alias(c.text, metadata={"unit": c.unit}) for k, c in enumerate(wanted)])

    def _made(self, done: list[Compiled], keep: tuple[str, ...]) -> DataFrame:
        out = self.narrowed(done, keep)
        for c in done:
            out = replace(out, df=out.joined(c))
        return out.df.select(*keep, *[c.value.column().alias(c.text, metadata={"unit": c.unit}) for c in done])

    def with_expression(self, text: str, name: str | None = None) -> Points:
        """The points with a column for the expression and a variable for it; the text evaluates again under its canonical form.

        An expression that is a variable's name already changes nothing, and neither does a blank one.
        """
        if not text.strip() or (name or text).casefold() in self.variables:
            return self
        c = self.compile(text)
        column = f"d{len(self.df.columns)}"
        df = self.joined(c).withColumn(column, c.value.column()).select(*self.df.columns, column)
        v = Variable(name or c.text, column, c.unit, "", c.is_complex, c.uses)
        return replace(self, df=df, variables=self.variables | {v.name.casefold(): v}, derived=(*self.derived, (column, c)))


def _called(node: object) -> set[str]:
    """Names of all functions that a tree calls."""
    if isinstance(node, tuple):
        return set().union(*map(_called, node))
    if not is_dataclass(node):
        return set()
    own = {node.name.casefold()} if isinstance(node, Call) else set()
    return own.union(*(_called(getattr(node, f.name)) for f in fields(node)))


def without_recursion(functions: dict[str, Function]) -> dict[str, Function]:
    """The functions that can't reach themselves over calls."""
    reached = {name: _called(f.body) & functions.keys() for name, f in functions.items()}
    for _ in functions:
        reached = {name: found.union(*(reached[x] for x in found)) for name, found in reached.items()}
    return {name: f for name, f in functions.items() if name not in reached[name]}


class _Work:
    def __init__(self, points: Points):
        self.points, self.selectors = points, []
        self.uses: set[str] = set()
        self.columns: set[str] = set()

    def variable(self, key: str) -> Value | None:
        v = self.points.variables.get(key)
        if v is None:
            return None
        self.columns.add(v.column)
        self.uses |= v.uses or {v.column}
        col = F.col(f"`{v.column}`")
        return V.vector(col["re"], col["im"], plain=True) if v.is_complex else V.vector(col.cast("double"))

    def value(self, node: object, scope: dict[str, Value], stack: tuple[str, ...]) -> Value:
        of = lambda n: self.value(n, scope, stack)
        match node:
            case Number(text):
                return V.constant(float(text))
            case Name(name):
                return self.name(name, scope)
            case Unary(op, operand):
                return {"+": lambda x: x, "-": V.negate, "!": V.invert}[op](of(operand))
            case Binary("&&" | "||" as op, left, right):
                return self.logic(op == "&&", of(left), right, of)
            case Binary(op, left, right):
                return _BINARY[op](of(left), of(right))
            case Choice(condition, yes, no):
                return self.choice(of(condition), yes, no, of)
            case Call():
                return self.call(node, scope, stack)
            case AtStep(base, step):
                return self.at_step(of(base), step)
        raise ValueError(f"not an expression: {node!r}")

    def name(self, name: str, scope: dict[str, Value]) -> Value:
        key = name.casefold()
        found = scope.get(key) or self.variable(key)
        if found is None and key in V.CONSTANTS:
            found = V.constant(V.CONSTANTS[key])
        if found is None:
            raise ValueError(f"unknown name: {name}")
        return found

    @staticmethod
    def logic(both: bool, a: Value, right: object, of) -> Value:
        if a.const is not None and bool(a.const) != both:
            return V.constant(0.0 if both else 1.0)
        b = of(right)
        if a.const is not None and b.const is not None:
            return V.constant(float(b.const.real != 0))
        span = V._span((a, b))
        x, y = V.truth(a), V.truth(b)
        return V.vector((x & y if both else x | y).cast("double"), None, span)

    @staticmethod
    def choice(condition: Value, yes: object, no: object, of) -> Value:
        if condition.const is not None:
            return of(yes) if bool(condition.const) else of(no)
        a, b = of(yes), of(no)
        span, first = V._span((condition, a, b)), V.truth(condition)
        (ar, ai), (br, bi) = a.parts(), b.parts()
        if ai is None and bi is None:
            return V.vector(F.when(first, ar).otherwise(br), None, span)
        zero = F.lit(0.0)
        return V.vector(F.when(first, ar).otherwise(br), F.when(first, zero if ai is None else ai).otherwise(zero if bi is None else bi), span)

    def call(self, node: Call, scope: dict[str, Value], stack: tuple[str, ...]) -> Value:
        low = node.name.casefold()
        key = probe_key(node)
        if low in PROBES and node.args:
            return self.probe(node, key)
        if is_network_name(low) and key in self.points.variables:
            return self.variable(key)
        args = [self.value(a, scope, stack) for a in node.args] if low in V.FUNCTIONS or low in self.points.functions else []
        if low in V.FUNCTIONS:
            least, most, function = V.FUNCTIONS[low]
            if len(args) < least or most is not None and len(args) > most:
                raise ValueError(f"{node.name} doesn't take {len(args)} arguments")
            return function(*args)
        f = self.points.functions.get(low)
        if f is None:
            raise ValueError(f"unknown function: {node.name}")
        if low in stack:
            raise ValueError(f"{node.name} calls itself")
        if len(args) != len(f.params):
            raise ValueError(f"{node.name} takes {len(f.params)} arguments, not {len(args)}")
        return self.value(f.body, {p.casefold(): a for p, a in zip(f.params, args, strict=True)}, (*stack, low))

    def probe(self, node: Call, key: str) -> Value:
        """A variable by its name, or for two nodes the difference of their voltages, whatever the probe's letter."""
        found = self.variable(key)
        if found is None and len(node.args) == 2:
            a, b = (n.name.casefold() for n in node.args)
            va, vb = self.variable(f"v({a})"), self.variable(f"v({b})")
            if b == "0":
                found = va
            elif a == "0" and vb is not None:
                found = V.negate(vb)
            elif va is not None:
                found = va if vb is None else V.subtract(va, vb)
        if found is None:
            raise ValueError(f"unknown probe: {key}")
        return found

    def at_step(self, base: Value, step: int) -> Value:
        """The base of one step, beside the points with the same place in theirs; NULL where that step is shorter."""
        n = self.points.n_steps
        if n is None:
            raise ValueError("@ needs the number of steps")
        if step > n:
            raise ValueError(f"step {step} of {n}")
        if base.const is not None:
            raise ValueError("@ needs a variable, not a constant")
        alias = f"__at{next(_ALIASES)}"
        self.selectors.append((alias, base.column(), step))
        col = F.col(alias)
        return V.vector(col["re"], col["im"], "step", True) if base.is_complex else V.vector(col, None, "step")


def expand_ac(points: Points, name: str) -> list[str]:
    """The expressions that a chart over frequency draws for a variable: its size in dB and its phase if it is complex."""
    return expand(points, name, "AC")


def expand(points: Points, text: str, chart: str) -> list[str]:
    """The expressions that a chart draws for one: size in dB and phase of a complex one over frequency; other charts leave complex ones out."""
    c = points.compile(text)
    if not c.is_complex:
        return [text]
    return [f"db({c.text})", f"phase({c.text})"] if chart == "AC" else []


def unit_of(df: DataFrame, column: str) -> str:
    return df.schema[column].metadata.get("unit", "")


def as_column(points: Points, text: str) -> Column:
    """An expression without selectors as a column over ``points.df``."""
    c = points.compile(text)
    if c.selectors:
        raise ValueError("an expression with step selectors needs a join; use evaluate")
    return c.value.column()
