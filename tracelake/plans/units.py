"""Units of expressions, inferred on the driver from the tree and the units of variables."""

from __future__ import annotations

from tracelake.plans.syntax import PROBES, AtStep, Binary, Call, Choice, Function, Name, Number, Unary, is_network_name, probe_key

# Units of constants, of probes without one, and of products and quotients.
CONSTANT_UNITS = {"mho": "S", "s": "s"}
PROBE_UNITS = {"v": "V", "i": "A", "id": "A", "z": "Ω", "y": "S"}
PRODUCTS = {frozenset(("V", "A")): "W", frozenset(("S", "V")): "A"}
QUOTIENTS = {("V", "A"): "Ω", ("A", "V"): "S", ("", "S"): "Ω", ("", "Ω"): "S", ("", "s"): "Hz", ("", "Hz"): "s"}
FUNCTION_UNITS = {"db": "dB", "angle": "°", "ph": "°", "phase": "°"}
KEEPING = {"abs", "real", "imag", "mag", "conj", "uramp", "round", "floor", "ceil", "int"}
KEEPING_FIRST = {"min", "max", "limit"}


def product(a: str, b: str) -> str:
    if not a:
        return b
    return PRODUCTS.get(frozenset((a, b)), a) if a != b else a


def quotient(a: str, b: str) -> str:
    if a == b:
        return ""
    return QUOTIENTS.get((a, b), a if not b else "")


def infer(node: object, units: dict[str, str], functions: dict[str, Function]) -> str:
    """``units``: of each variable by its case-folded name."""
    of = lambda n: infer(n, units, functions)
    match node:
        case Name(name):
            key = name.casefold()
            return units.get(key, CONSTANT_UNITS.get(key, ""))
        case Unary(_, operand):
            return of(operand)
        case Binary(op, left, right):
            a, b = of(left), of(right)
            if op in "+-":
                return a if a == b else ""
            return product(a, b) if op == "*" else quotient(a, b) if op == "/" else ""
        case Choice(_, yes, no):
            a = of(yes)
            return a if a == of(no) else ""
        case AtStep(base, _):
            return of(base)
        case Call(name, args):
            low, key = name.casefold(), probe_key(node)
            if low in PROBES or is_network_name(low) and key in units:
                return units.get(key) or PROBE_UNITS.get(low if low in PROBES else low[0], "")
            if low in functions and low not in FUNCTION_UNITS and low not in KEEPING | KEEPING_FIRST:
                f = functions[low]
                return infer(f.body, units | {p.casefold(): of(a) for p, a in zip(f.params, args, strict=False)}, functions)
            if not args:
                return ""
            if len(args) == 1 and low not in KEEPING_FIRST:
                return FUNCTION_UNITS.get(low, of(args[0]) if low in KEEPING else "")
            return of(args[0]) if low in KEEPING_FIRST and len(args) > 1 else ""
        case Number():
            return ""
    return ""
