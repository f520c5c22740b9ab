"""Secret scans with multipart credential linking, in DataFrame functions only.

Three base kinds are strong and always reported. Three weak kinds (an account name, a mixed-case token, an endpoint) mean
little alone: they are reported when complementary parts stand within ``scope`` characters and share no character with them, found by an interval join of a
document's parts on cells of that width, so the work grows with the number of parts and not with its square.

Patterns are tried only on texts that hold what each of their matches holds: a run of twenty letters or digits, a colon or an equals sign, ``://``.

Positions: the text is split by a pattern and the matches extracted; running sums of the lengths of pieces and
matches are the places of the matches, in code points.

Nulls: a null text is empty, a null id is kept. Repeated rows give equal results. Documents of any length are scanned whole.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import written

SCOPE = 200


def _either(word: str) -> str:
    """A word in either case, without regular-expression flags, whose meaning differs between engines."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_USERS = "|".join(_either(w) for w in ("username", "user", "login", "account", "client_id"))
_GIVEN = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

# Kind, pattern, and the least length of a group (0: the match).
KINDS = [
    ("assign", f"({_NAMES}){_GIVEN}", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("account", f"({_USERS}){_GIVEN}", 2, 3),
    ("mixed", "[A-Za-z0-9+/]{20,}", 0, 20),
    ("endpoint", r"https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", 0, 10),
]
BASE = 3
#: What a text holds if a kind's pattern matches in it at a sufficient length. The run begins where no such character stands before it.
_NEEDS = {"assign": "given", "access": "run", "hex": "run", "account": "given", "mixed": "run", "endpoint": "url"}
_RUN = "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20}"
#: Which kinds are a credential's identifier and which its secret.
IDENTIFIERS, SECRETS = ("access", "account"), ("assign", "hex", "mixed")


def running(numbers: Column) -> Column:
    """Inclusive running sums of an array, in blocks, so that very long arrays aren't copied for each element."""
    block = 256
    zero = lambda: F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("a"))
    sums = lambda a: F.aggregate(a, zero(), lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a")))["a"]
    before = lambda a: F.aggregate(a, zero(), lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")))["a"]
    parts = F.transform(F.sequence(F.lit(0), F.expr("0") + ((F.size(numbers) - 1) / block).cast("int")), lambda c: sums(F.slice(numbers, c * block + 1, F.lit(block))))
    shifted = F.flatten(F.zip_with(parts, before(F.transform(parts, lambda p: F.element_at(p, -1))), lambda p, o: F.transform(p, lambda v: v + o)))
    return F.when(F.size(numbers) > 0, shifted).otherwise(F.array().cast("array<bigint>"))


def _steps(pieces: str, matches: str) -> Column:
    """From each match's start to the next one's: the match before it and the piece between."""
    return F.transform(F.slice(pieces, F.lit(1), F.size(matches)), lambda n, i: n + F.when(i > 0, F.char_length(F.try_element_at(F.col(matches), i))).otherwise(F.lit(0)))


def _accepted(kind: str, pattern: str, group: int, least: int):
    if kind == "mixed":
        return lambda m: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
    if group:
        return lambda m: F.char_length(F.regexp_extract(m, pattern, group)) >= least
    return lambda m: F.char_length(m) >= least


def _placed(matches: str, starts: str, accepted) -> Column:
    spans = F.zip_with(matches, starts, lambda m, s: F.when(accepted(m), F.struct(s.alias("start"), (s + F.char_length(m)).alias("stop"))))
    return F.filter(spans, lambda x: x.isNotNull())


def _tagged(kind: str, ord_: int) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(ord_).alias("ord"), s["stop"].alias("stop")))


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, same (a hash of the text), and for each kind an array of (start, stop) in order."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    pieces = lambda p: F.transform(F.split("text", p, -1), lambda x: F.char_length(x).cast("long"))
    may = {"given": F.col("text").contains("=") | F.col("text").contains(":"), "run": F.col("text").rlike(_RUN), "url": F.col("text").contains("://")}
    out = out.select("doc_id", "text", *[c.alias(n) for n, c in may.items()])
    found = {}
    for kind, pattern, _, _ in KINDS:
        found[f"m_{kind}"] = F.when(F.col(_NEEDS[kind]), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        found[f"p_{kind}"] = F.when(F.col(_NEEDS[kind]), pieces(pattern)).otherwise(F.array().cast("array<bigint>"))
    out = out.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("same"), *[c.alias(n) for n, c in found.items()])
    starts = {f"s_{k}": running(_steps(f"p_{k}", f"m_{k}")) for k, *_ in KINDS}
    out = out.select("doc_id", "same", *[f"m_{k}" for k, *_ in KINDS], *[c.alias(n) for n, c in starts.items()])
    spans = {k: _placed(f"m_{k}", f"s_{k}", _accepted(k, pattern, group, least)) for k, pattern, group, least in KINDS}
    return out.select("doc_id", "same", *[c.alias(k) for k, c in spans.items()])


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    named = F.array(*[F.lit(k) for k, *_ in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(named, s["ord"] + 1), s["start"], s["stop"])), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """A row for each row: doc_id, the number of spans of each base kind, base and spans (arrays of start, ord, stop; ord counts KINDS)."""
    scanned = written(_scan(docs, id_col, text_col), "spans")
    kinds = [k for k, *_ in KINDS]
    base = F.concat(*[_tagged(k, o) for o, k in enumerate(kinds[:BASE])])
    weak = F.concat(*[_tagged(k, o) for o, k in enumerate(kinds) if o >= BASE])
    rows = scanned.select("doc_id", "same", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds[:BASE]], base.alias("base"), weak.alias("weak"))

    # Parts of documents that have a weak part and could complete it; copies of a document are one.
    key = ["doc_id", "same"]
    some = lambda names: sum((F.size(k) for k in names), F.lit(0)) > 0
    open_ = scanned.filter(some(kinds[BASE:]) & (some(IDENTIFIERS) & some(SECRETS))).dropDuplicates(key)
    part = open_.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "same", F.explode(F.concat(*[_tagged(k, o) for o, k in enumerate(kinds)])).alias("s")).select("doc", "same", "s.*")
    cell = lambda at: F.floor(at / scope)
    mine = part.filter(F.col("ord") >= BASE).withColumn("cell", F.explode(F.sequence(cell(F.col("start") - scope), cell(F.col("stop") + scope))))
    theirs = part.filter(F.col("ord") != kinds.index("endpoint")).select("doc", "same", F.col("start").alias("a"), F.col("ord").alias("o"), F.col("stop").alias("b")).withColumn("cell", F.explode(F.sequence(cell(F.col("a")), cell(F.col("b")))))
    ids, secrets = ([kinds.index(k) for k in names] for names in (IDENTIFIERS, SECRETS))
    near = mine.join(theirs, ["doc", "same", "cell"]).filter((F.col("a") <= F.col("stop") + scope) & (F.col("b") >= F.col("start") - scope))
    # No character is part of both halves.
    near = near.filter((F.col("a") >= F.col("stop")) | (F.col("b") <= F.col("start")))
    of = lambda own, column: F.when(F.col("o").isin(own), F.col(column))
    seen = near.groupBy("doc", "same", "start", "ord", "stop").agg(F.max(of(ids, "a")).alias("id"), F.min(of(ids, "b")).alias("id_stop"), F.max(of(secrets, "a")).alias("secret"), F.min(of(secrets, "b")).alias("secret_stop"))
    # An identifier needs a secret, a secret needs an identifier, an endpoint needs both, apart from each other.
    both = (F.col("id_stop") <= F.col("secret")) | (F.col("secret_stop") <= F.col("id"))
    linked = seen.filter(F.when(F.col("ord") == kinds.index("account"), F.col("secret").isNotNull()).when(F.col("ord") == kinds.index("mixed"), F.col("id").isNotNull()).otherwise(both))
    added = written(linked.groupBy("doc", "same").agg(F.collect_list(F.struct("start", "ord", "stop")).alias("added")), "linked")
    rows = rows.withColumn("doc", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    joined = rows.join(added, ["doc", "same"], "left")
    return joined.select("doc_id", *[f"n_{k}" for k in kinds[:BASE]], "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:bigint,ord:int,stop:bigint>>")))).alias("spans"))


def listed(spans: str) -> Column:
    """A column of spans as text: kind:start:end, comma-joined."""
    return _joined(F.col(spans))
