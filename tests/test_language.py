"""Tokens, grammar, values and units of the expression language."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import values as V
from tracelake.plans.compiler import Points, Variable, expand_ac
from tracelake.plans.syntax import AtStep, Binary, Call, Name, Number, canonical, lexemes, parse, parse_function


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("-2^2", "-(2^2)"),
        ("2^-1", "(2^-1)"),
        ("2^3^2", "(2^(3^2))"),
        ("a?b:c?d:e", "(a?b:(c?d:e))"),
        ("a||b&&c==d<e+f*g", "(a||(b&&(c==(d<(e+(f*g))))))"),
        ("a-b-c", "((a-b)-c)"),
        ("a<b<c", "((a<b)<c)"),
        ("1/2k", "((1/2)*k)"),
        ("2*pi*Frequency*1s", "((((2*pi)*Frequency)*1)*s)"),
        ("7•x1", "7•x1"),
        ("V(7•x1•xu302, 0)@2", "V(7•x1•xu302,0)@2"),
        ("v(net-_u304a-g2_)", "v(net-_u304a-g2_)"),
        ("v(/power_amplifier/vcc1)", "v(/power_amplifier/vcc1)"),
        ("x@2*y", "(x@2*y)"),
        ("f()", "f()"),
        ("!a&&+b", "(!a&&+b)"),
        ("1.5e3 + 2.", "(1.5e3+2.)"),
    ],
)
def test_canonical(text, expected):
    assert canonical(parse(text)) == expected


@pytest.mark.parametrize("text", [".5", "1e", "-2k", "a@0", "a@1.5", "a@b", "f(", "a b(", "1 2", "a ? b", "$", "", "v(,)", "(a", "a)"])
def test_refused(text):
    with pytest.raises(ValueError):
        parse(text)


def test_lexemes_have_their_places():
    assert [(x.kind, x.text, x.start, x.stop) for x in lexemes("a[3] >= 1e3")] == [("name", "a[3]", 0, 4), (">=", ">=", 5, 7), ("number", "1e3", 8, 11), ("end", "", 11, 11)]


def test_trees():
    assert parse("V(a,b)@3") == AtStep(Call("V", (Name("a"), Name("b"))), 3)
    assert parse("2k") == Binary("*", Number("2"), Name("k"))
    f = parse_function(".FUNC g(a, b) {a+b}")
    assert (f.name, f.params, canonical(f.body)) == ("g", ("a", "b"), "(a+b)")
    for bad in (".fun g() {1}", ".func g(a,) {1}", ".func g(a) {1", "g(a) {1}"):
        with pytest.raises(ValueError):
            parse_function(bad)


SPECIAL = [float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 1.0, -1.0, 2.5, -2.5, 0.5, 1e300, 2.0**53, -3.7]


@pytest.fixture(scope="module")
def points(spark):
    pairs = [(k, a, b) for k, (a, b) in enumerate((a, b) for a in SPECIAL for b in SPECIAL)]
    return Points.of(spark.createDataFrame(pairs, "i int, x double, y double").coalesce(1), [Variable("x", "x", "V"), Variable("y", "y", "A")], [".func twice(x) {2*x}", ".func loop(x) {loop(x)}", ".func a(x) {b(x)}", ".func b(x) {a(x)}", ".func bad(", ".func total(q) {q+y}"])


def column(points, text):
    rows = points.evaluate(text, keep=("i",)).toDF("i", "v").orderBy("i").collect()
    return np.array([r["v"] for r in rows])


X, Y = (np.array(v) for v in zip(*((a, b) for a in SPECIAL for b in SPECIAL), strict=True))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("x/y", lambda x, y: x / y),
        ("x^2", lambda x, y: x**2),
        ("x == y", lambda x, y: (x == y) * 1.0),
        ("x != y", lambda x, y: (x != y) * 1.0),
        ("x < y", lambda x, y: (x < y) * 1.0),
        ("x >= y", lambda x, y: (x >= y) * 1.0),
        ("!x", lambda x, y: (x == 0) * 1.0),
        ("x && y", lambda x, y: ((x != 0) & (y != 0)) * 1.0),
        ("x || y", lambda x, y: ((x != 0) | (y != 0)) * 1.0),
        ("x ? y : 7", lambda x, y: np.where(x != 0, y, 7)),
        ("min(x, y)", np.minimum),
        ("max(x, y)", np.maximum),
        ("limit(x, -1, y)", lambda x, y: np.minimum(np.maximum(x, -1), y)),
        ("uramp(x)", lambda x, y: np.maximum(x, 0)),
        ("round(x)", lambda x, y: np.round(x)),
        ("floor(x)", lambda x, y: np.floor(x)),
        ("ceil(x)", lambda x, y: np.ceil(x)),
        ("int(x)", lambda x, y: np.trunc(x)),
        ("log(x)", lambda x, y: np.log(x)),
        ("log10(x)", lambda x, y: np.log10(x)),
        ("db(x)", lambda x, y: 20 * np.log10(np.abs(x))),
        ("sqrt(x)", lambda x, y: np.sqrt(x)),
        ("asin(x)", lambda x, y: np.arcsin(x)),
        ("sign(x)", lambda x, y: np.sign(x)),
        ("pwrs(x, 2)", lambda x, y: np.sign(x) * np.abs(x) ** 2),
        ("atan2(x, y)", np.arctan2),
        ("twice(y)", lambda x, y: 2 * y),
        ("total(x)", lambda x, y: x + y),
    ],
)
def test_like_arrays(points, text, expected):
    with np.errstate(all="ignore"):
        np.testing.assert_allclose(column(points, text).astype(float), expected(X, Y), rtol=1e-12)


COMPLEX = ["exp(z)", "log(z)", "sqrt(z)", "sin(z)", "cos(z)", "tan(z)", "sinh(z)", "cosh(z)", "tanh(z)", "asin(z)", "acos(z)", "atan(z)", "z^w", "z/w", "z*w", "conj(z)", "log10(z)", "sqr(z)", "min(z,w)", "max(z,w)", "-z", "z^2"]
NUMPY = {"exp(z)": np.exp, "log(z)": np.log, "sqrt(z)": np.sqrt, "sin(z)": np.sin, "cos(z)": np.cos, "tan(z)": np.tan, "sinh(z)": np.sinh, "cosh(z)": np.cosh, "tanh(z)": np.tanh, "asin(z)": np.arcsin, "acos(z)": np.arccos, "atan(z)": np.arctan, "conj(z)": np.conj, "log10(z)": np.log10, "sqr(z)": np.square, "-z": np.negative}


@pytest.mark.parametrize("text", COMPLEX)
def test_complex(spark, text):
    rng = np.random.default_rng(0)
    z, w = (rng.normal(size=60) + 1j * rng.normal(size=60) for _ in range(2))
    df = spark.createDataFrame([(k, (float(a.real), float(a.imag)), (float(b.real), float(b.imag))) for k, (a, b) in enumerate(zip(z, w, strict=True))], "i int, z struct<re:double,im:double>, w struct<re:double,im:double>")
    p = Points.of(df, [Variable("z", "z", "V", "", True), Variable("w", "w", "A", "", True)])
    found = np.array([complex(r["v"]["re"], r["v"]["im"]) for r in p.evaluate(text, keep=("i",)).toDF("i", "v").orderBy("i").collect()])
    two = {"z^w": z**w, "z/w": z / w, "z*w": z * w, "min(z,w)": np.minimum(z, w), "max(z,w)": np.maximum(z, w), "z^2": z**2}
    np.testing.assert_allclose(found, two[text] if text in two else NUMPY[text](z), rtol=1e-9, atol=1e-10)
    # The same on the driver, where constants are folded.
    assert V.constant(1j).is_complex and not V.constant(1.0).is_complex
    assert expand_ac(p, "Z") == ["db(z)", "phase(z)"]


@pytest.mark.parametrize("text", ["asin(z)", "acos(z)", "atan(z)"])
def test_complex_inverses_everywhere(spark, text):
    """Both sides of the cuts, next to and on the branch points, tiny and large parts: each part to 1e-12 of its own size."""
    sizes = [0.0, 1e-300, 1e-160, 1e-20, 1e-10, 1e-8, 1e-3, 0.3, 1 - 1e-9, 1 + 1e-9, 1.7, 3.0077026728735397, 7.61972874609815, 1e3, 1e8, 1e20, 1e120, 1e160]
    parts = [*sizes, *(-x for x in sizes)]
    rng = np.random.default_rng(2)
    z = [complex(x, y) for x in [*parts, 1.0, -1.0] for y in parts if not (text == "atan(z)" and x == 0 and abs(y) == 1)] + list(rng.normal(size=200) * 10 ** rng.uniform(-12, 12, 200) + 1j * rng.normal(size=200))
    df = spark.createDataFrame([(k, (float(a.real), float(a.imag))) for k, a in enumerate(z)], "i int, z struct<re:double,im:double>")
    p = Points.of(df, [Variable("z", "z", "", "", True)])
    found = p.evaluate(text, keep=("i",)).toDF("i", "v").orderBy("i").collect()
    with np.errstate(all="ignore"):
        want = NUMPY[text](np.array(z))
    for part, of in (("re", np.real), ("im", np.imag)):
        np.testing.assert_allclose([r["v"][part] for r in found], of(want), rtol=1e-12, atol=1e-300)


def test_names_and_errors(points):
    for text in ("nothing", "loop(x)", "a(x)", "bad(x)", "abs()", "atan2(x)", "limit(x, 1)", "twice(x, y)", "V(n)", "x@1", "unknown(1)"):
        with pytest.raises(ValueError):
            points.compile(text)
    assert points.compile("1k + 2meg + 3m").value.const == pytest.approx(2001000.003)
    assert points.compile("PI").value.const == math.pi
    assert points.compile("0 && nothing").value.const == 0 and points.compile("1 || nothing").value.const == 1
    assert points.compile("1 ? X : nothing").text == "(1?X:nothing)"
    assert points.search("X") == ["x"]
    grown = points.with_expression("x*2", "k").with_expression("k+1")
    assert column(grown, "k")[5 * len(SPECIAL)] == 2.0 and "(k+1)" in grown.variables
    assert grown.with_expression("x") is grown


def test_probes(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0, 9.0)], "i int, a double, b double, s double")
    p = Points.of(df, [Variable("V(a)", "a", "V"), Variable("V(b)", "b", "V"), Variable("S11(x)", "s", ""), Variable("s", "s", "")])
    for text, expected in {"v(A)": 1, "V(a,b)": -4, "i(a,b)": -4, "V(a,0)": 1, "V(0,b)": -5, "V(a,zz)": 1, "s11(x)": 9, "2s": 18, "V(b)-V(a)": 4}.items():
        assert p.evaluate(text).first()[0] == expected, text
    assert p.evaluate("V(a)*V(b)").schema[0].metadata == {"unit": "V"}


def test_step_selectors(spark):
    rows = [(0, 0, 10.0), (0, 1, 20.0), (1, 0, 2.0), (1, 1, 4.0), (1, 2, 8.0)]
    df = spark.createDataFrame(rows, "step int, step_idx bigint, v double")
    p = Points.of(df, [Variable("V(inoise)", "v", "V")], [".func NFDB() {20*log10(V(inoise)@1/V(inoise)@2)}"], n_steps=2)
    run = lambda t: [r[2] for r in p.evaluate(t, keep=("step", "step_idx")).toDF("s", "i", "v").orderBy("s", "i").collect()]
    assert run("V(inoise)@1 / V(inoise)@2") == [5, 5, 5, 5, None]
    assert run("NFDB()")[:2] == pytest.approx([20 * math.log10(5)] * 2)
    assert p.compile("V(inoise)@1").unit == "V"
    for text in ("V(inoise)@3", "V(inoise)@1 - V(inoise)"):
        with pytest.raises(ValueError):
            p.compile(text)
    assert p.df.select(F.lit(1)).count() == 5


def test_recursion_is_refused_where_it_is_defined():
    from tracelake.plans.compiler import without_recursion
    from tracelake.plans.syntax import parse_function

    texts = [".func loop(x) {1 ? x : loop(x)}", ".func a(x) {b(x)+1}", ".func b(x) {c(x)}", ".func c(x) {max(1, A(x))}", ".func uses(x) {a(x)}", ".func fine(x) {twice(twice(x))}", ".func twice(x) {2*x}"]
    known = {f.name.casefold(): f for f in map(parse_function, texts)}
    assert set(without_recursion(known)) == {"uses", "fine", "twice"}


def test_recursive_functions_are_no_functions(spark):
    points = Points.of(spark.range(1).withColumn("q", F.lit(1.0)), [Variable("q", "q", "V")], [".func f(x) {1 ? x : f(x)}", ".func g(x) {x+q}"])
    with pytest.raises(ValueError):
        points.compile("f(q)")
    assert points.compile("g(q)").unit == "V"


def test_compiled_text_is_kept(spark):
    points = Points.of(spark.range(1).withColumn("q", F.lit(1.0)), [Variable("q", "q", "V")])
    assert points.compile("q+1") is points.compile("q+1")
    more = points.with_expression("q+1", "sum").with_expression("2*q", "q2")
    assert more.compile("sum+1").text == "(sum+1)" and points.with_expression("  ") is points
    with pytest.raises(ValueError):
        points.compile("sum+1")


def test_complex_formulas_at_the_edges(spark):
    """Large and small parts neither overflow nor lose their digits."""
    cases = [400 + 1j, -400 - 2j, 1e-9 + 3j, 0.3 + 800j, -0.2 - 900j, 1e200 + 1e200j, 1e-200 + 2e-200j, -5 + 1e-9j, 7 - 1e-9j, 3j, -4 + 0j]
    df = spark.createDataFrame([(k, (z.real, z.imag)) for k, z in enumerate(cases)], "i int, z struct<re:double,im:double>")
    points = Points.of(df, [Variable("z", "z", "", "voltage", True)])
    of = {"tan(z)": np.tan, "tanh(z)": np.tanh, "sqrt(z)": np.sqrt, "z/(2*z)": lambda z: z * 0 + 0.5, "acos(1/(z+3))": lambda z: np.arccos(1 / (z + 3)), "min(z, 0*z)": lambda z: np.where(z.real < 0, z, 0), "limit(z, 0*z, 0*z+2)": lambda z: np.where(z.real < 0, 0, np.where(z.real > 2, 2, z))}
    rows = points.evaluate(*of, keep=("i",)).toDF("i", *[f"v{k}" for k in range(len(of))]).orderBy("i").collect()
    z = np.array(cases)
    with np.errstate(all="ignore"):
        for k, (text, make) in enumerate(of.items()):
            expected = make(z)
            for r in rows:
                e, v = expected[r["i"]], r[f"v{k}"]
                if not np.isfinite(e) or (text.startswith(("acos", "limit")) and abs(z[r["i"]]) > 1e150):
                    continue
                if text == "limit(z, 0*z, 0*z+2)" and z[r["i"]].real in (0.0, 2.0):
                    continue  # ties in the real part go by the imaginary one
                assert abs(complex(v["re"], v["im"]) - e) <= 1e-12 * max(abs(e), 1e-300) * (1e4 if "acos" in text else 1), (text, z[r["i"]], v, e)
