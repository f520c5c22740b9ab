"""Corpus operators against brute force on small tables with nulls, ties, repeats, long texts and clashing names."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

CLASH = ["fp", "uid", "n", "key", "part", "id", "hash", "sha", "node", "label", "rank", "length", "same"]
LINE = "this line stands in very many of the documents here"
LONG = "word " * 60_000 + "\n" + LINE


def rows():
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    near = " ".join(base * 5)
    texts = [None, "", " \n\t", "same text here", "same  text\nhere ", "samete xthere", near, near + " omega", near.replace("mu", "my", 1), "Ünïcode ÄÖ text", LONG, "short", "a", "A", "a b"]
    texts += [f"{LINE}\nown line {k}\n  {LINE.upper()}  " for k in range(6)]
    return [(k, t) for k, t in enumerate(texts)] + [(3, "same text here"), (None, "same text here"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id bigint, text string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def got(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(x) for x in r))


# 1


def test_exact_dedup(docs, empty):
    from tracelake.llm.exact_dedup import exact_dedup

    groups = defaultdict(list)
    for d, t in rows():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is not None, d or 0, d))
    expected = []
    for norm, members in groups.items():
        first = min(members, key=lambda m: m[:3])
        for k, m in enumerate(sorted(members, key=lambda m: m[:3])):
            expected.append((m[3], first[3], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    out = exact_dedup(docs)
    assert got(out.drop("n_chars")) == sorted(expected, key=lambda r: tuple(str(x) for x in r))
    assert got(exact_dedup(docs, broadcast_bytes=0)) == got(out)
    assert exact_dedup(empty).count() == 0


def test_quotient_filter_is_lossless():
    from tracelake.llm.exact_dedup import QuotientFilter

    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) for n in (500, 77))
    a = np.concatenate([a, a[:50], b[:20], [np.uint64(0), np.uint64((1 << 64) - 1)]])
    merged = QuotientFilter.from_bytes(QuotientFilter.build(a).to_bytes()).merge(QuotientFilter.from_bytes(QuotientFilter.build(b).to_bytes()))
    keys, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    assert (merged.fingerprints() == keys).all() and (merged.counts == counts).all()
    parts = [f for _, f in merged.slice(3)]
    assert (np.concatenate([f.fingerprints() for f in parts]) == keys).all()


# 2


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[a] = b
    least = {}
    for k, d in enumerate(ids):
        r = find(k)
        least[r] = min(least.get(r, d), d, key=lambda x: (x is not None, x))
    return [least[find(k)] for k in range(len(ids))]


def test_simhash_components(docs, empty):
    from tracelake.llm.simhash import simhash_components

    data = rows()
    fps = [brute_fingerprint(t) for _, t in data]
    roots = brute_components([d for d, _ in data], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    expected = sorted([(d, f - (1 << 64) if f >> 63 else f, c) for (d, _), f, c in zip(data, fps, roots, strict=True)], key=lambda r: tuple(str(x) for x in r))
    assert got(simhash_components(docs)) == expected
    assert simhash_components(empty).count() == 0


@pytest.mark.parametrize(("tau", "hot"), [(2, None), (3, None), (2, 4), (3, 4)])
def test_links_give_all_components(spark, tau, hot, monkeypatch):
    """Dense and sparse groups of fingerprints, buckets of every size; with a small ``hot`` most keys are keyed anew, some many times."""
    from tracelake.llm import simhash
    from tracelake.llm.components import components
    from tracelake.llm.simhash import candidate_links

    if hot:
        monkeypatch.setattr(simhash, "HOT", hot)

    rng = np.random.default_rng(tau)
    base = rng.integers(0, 1 << 62, 40, dtype=np.int64)
    fps = set(base.tolist())
    for b in base[:3].tolist():
        for _ in range(60):
            fps.add(b ^ (1 << int(rng.integers(62))) ^ (1 << int(rng.integers(62))))
    fps = sorted(fps)
    points = spark.createDataFrame([(0, k, f) for k, f in enumerate(fps)], "l int, node bigint, fp bigint")
    found = {r["node"]: r["root"] for r in components(candidate_links(points, tau)).collect()}
    expected = brute_components(list(range(len(fps))), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= tau)
    assert [found.get(k, k) for k in range(len(fps))] == expected


def test_hot_keys_become_finer(spark, monkeypatch):
    """A key that holds all rows is split to keys of few; equal fingerprints, which no bit tells apart, are left together once."""
    from tracelake.llm import simhash

    monkeypatch.setattr(simhash, "HOT", 10)
    kept = ("l", "mask", "key", "node", "fp")
    fps = np.random.default_rng(5).integers(0, 1 << 30, 200) << 1
    spread = spark.createDataFrame([(0, 1, 0, k, f) for k, f in enumerate(fps.tolist())], "l int, mask bigint, key bigint, node bigint, fp bigint")
    finer = simhash.without_hot_keys(spread, 2)
    assert tuple(finer.columns) == kept and finer.select("node").distinct().count() == 200
    assert finer.groupBy("l", "mask", "key").count().agg(F.max("count")).first()[0] <= 10
    assert finer.filter("(fp & mask) != key").isEmpty()
    equal = spark.createDataFrame([(0, 1, 0, k, 2) for k in range(50)], spread.schema)
    assert sorted(simhash.without_hot_keys(equal, 2).collect()) == sorted(equal.collect())


def test_forest_of_equal_fingerprints(monkeypatch):
    """Many rows that no bit tells apart are compared once, not again for every part of the bits."""
    from tracelake.llm import simhash

    monkeypatch.setattr(simhash, "LARGE", 20)
    n = 300
    rows = simhash.Rows(np.arange(n), np.zeros(n, np.uint64), np.full(n, 10), np.zeros((n, 2), np.uint64), 3, 0.8, 36)
    left, _ = simhash.forest(rows, np.arange(n), 0)
    assert len(left) == n - 1


def test_forest_splits_large_groups(monkeypatch):
    from tracelake.llm import simhash

    monkeypatch.setattr(simhash, "LARGE", 20)
    rng = np.random.default_rng(2)
    fp = np.unique(np.concatenate([rng.integers(0, 1 << 12, 150, dtype=np.uint64), (rng.integers(0, 1 << 63, 30, dtype=np.uint64))]))
    left, right = simhash.forest(simhash.Rows(np.arange(len(fp)), fp, tau=2), np.arange(len(fp)), 0)
    parent = list(range(len(fp)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(left, right, strict=True):
        assert (int(fp[a]) ^ int(fp[b])).bit_count() <= 2
        parent[find(a)] = find(b)
    expected = brute_components(list(range(len(fp))), lambda i, j: (int(fp[i]) ^ int(fp[j])).bit_count() <= 2)
    mine = brute_components(list(range(len(fp))), lambda i, j: find(i) == find(j))
    assert mine == expected


def test_thresholds():
    from tracelake.llm.simhash import allocate, keys_of

    cost, chosen = allocate([{-1: 0, 0: 5, 1: 9}, {-1: 0, 0: 1, 1: 2}, {-1: 0, 0: 7, 1: 20}], 0)
    assert (cost, chosen) == (7, [0, 1, -1])
    assert keys_of([0, 1, 5], 1) == [0b100010, 0b100001, 0b11] and keys_of([0, 1], -1) == []


def test_shingles_in_pieces(monkeypatch):
    from tracelake.llm import simhash

    text = ("One two  three\tfour FIVE six seven " * 30).encode()
    whole = np.concatenate(list(simhash.shingle_hashes(text, 3)))
    monkeypatch.setattr(simhash, "_PIECE", 17)
    assert (np.concatenate(list(simhash.shingle_hashes(text, 3))) == whole).all()


def test_near_duplicates(docs, empty):
    from tracelake.llm.simhash import near_duplicates

    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    data = [(d if d is not None else None, grams(t)) for d, t in rows()]
    roots = brute_components([d for d, _ in data], lambda i, j: bool(data[i][1]) and bool(data[j][1]) and len(data[i][1] & data[j][1]) >= 0.8 * len(data[i][1] | data[j][1]))
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    for (d, g), c in zip(data, roots, strict=True):
        if g and d is not None and d != 3:
            assert found[d] == c, d
    # Rows that share an id, or have none, each have the component of their own text; those without words have none but their id.
    pairs = [(d, c if g else d) for (d, g), c in zip(data, roots, strict=True)]
    assert got(near_duplicates(docs)) == sorted(pairs, key=lambda r: tuple(str(x) for x in r))
    assert found[7] == found[6] == found[8] == 6
    assert near_duplicates(empty).count() == 0


def five_grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    x, y = five_grams(a), five_grams(b)
    return len(x & y) >= 0.8 * len(x | y)


def edited_copies():
    """Texts with copies that are cut, extended or changed in one block, each barely still alike."""
    rng, out = np.random.default_rng(5), []
    for _ in range(40):
        n = int(rng.integers(100, 300))
        new = lambda k: [f"w{x}" for x in rng.integers(0, 3000, k)]
        w = new(n)
        out.append(" ".join(w))
        for shape in ("cut", "extended", "block"):
            for k in range(n // 3, 0, -1):
                at = int(rng.integers(0, n - k))
                t = " ".join({"cut": w[: n - k], "extended": w + new(k), "block": w[:at] + new(k) + w[at + k :]}[shape])
                if alike(out[-1 - ("cut", "extended", "block").index(shape)], t):
                    out.append(t)
                    break
    return out


def test_near_duplicates_of_any_shape(spark):
    """Every pair is linked to its original: none of the 120 copies may be missed."""
    from tracelake.llm.simhash import near_duplicates

    texts = edited_copies()
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(texts) == 160
    assert [found[k] for k in range(160)] == [k // 4 * 4 for k in range(160)]


def template_copies(n, seed=2):
    rng = np.random.default_rng(seed)
    template = [f"w{x}" for x in rng.integers(0, 3000, 120)]
    out = []
    for k in range(n):
        w = list(template)
        for at in rng.choice(120, 2 + k % 2, replace=False):
            w[at] = f"x{rng.integers(1 << 30)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_at_the_threshold(spark):
    """Copies of a template of which most pairs are just not alike: no link may be given up for a nearer one that proves false."""
    from tracelake.llm.simhash import near_duplicates

    texts = template_copies(150)
    roots = brute_components(list(range(150)), lambda i, j: alike(texts[i], texts[j]))
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(set(roots)) > 5
    assert [found[k] for k in range(150)] == roots


def test_near_duplicates_are_dropped_by_row(spark):
    """Ids that are null or repeated: of each group one row stays, and no other row that shares its id is lost or spared."""
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    data = [(None, a), (None, a + " end"), (None, b), (5, b + " end"), (7, c), (7, c + " end"), (7, a + " more"), (8, ""), (8, "")]
    found = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(data, "doc_id long, text string"), "")
    rows = sorted(((r["doc_id"], r["text"][:1]) for r in found.collect()), key=str)
    assert rows == sorted([(None, "a"), (None, "b"), (7, "c"), (8, ""), (8, "")], key=str)


# 3


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_packing(docs, empty, tokenizer):
    from tokenizers import Tokenizer

    from tracelake.llm.packing import pack_documents, sequences

    exact = Tokenizer.from_file(tokenizer)
    packed = pack_documents(docs, tokenizer)
    out = packed.collect()
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        assert r["length"] == len(r["ids"]) <= 4096 and r["start"] == 4096 * r["piece"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    whole = defaultdict(list)
    for d, t in rows():
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 1]
        whole[d] += [(p, 4096 * p, ids[4096 * p : 4096 * p + 4096]) for p in range(-(-len(ids) // 4096))]
    for d, expected in whole.items():
        assert sorted((r["piece"], r["start"], list(r["ids"])) for r in by_doc[d]) == sorted(expected), d
    bare = pack_documents(docs, tokenizer, with_ids=False)
    assert "ids" not in bare.columns and got(bare.select("doc_id", "piece", "ids_crc32", "length")) == got(packed.select("doc_id", "piece", "ids_crc32", "length"))
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in out)
    assert len(places) == -(-total // 4096)
    assert sum(len(r["ids"]) for r in sequences(packed).collect()) == total
    assert pack_documents(empty, tokenizer).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_plan_places_every_piece(seed):
    from tracelake.llm.packing import plan

    rng = np.random.default_rng(seed)
    histogram = {int(k): int(n) for k, n in zip(rng.integers(1, 101, 40), rng.integers(1, 50, 40), strict=True)}
    rows_ = plan(histogram, 100)
    bins = defaultdict(list)
    for length, n in histogram.items():
        own = rows_[rows_[:, 0] == length]
        for rank in range(n):
            r = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
            bins[r[3] + (rank - r[1]) // r[2]].append((r[4] + (rank - r[1]) % r[2] * length, length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 100
    room: list[int] = []  # first fit, longest first
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        at = next((i for i, r in enumerate(room) if r >= length), None)
        if at is None:
            room.append(100)
            at = len(room) - 1
        room[at] -= length
    assert len(bins) <= len(room)


def test_exchange_takes_the_tightest_two():
    from tracelake.llm.packing import fill

    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]  # greedy: 6 + 3, gap 1; 3 gives way to 2 + 2
    assert fill(counts, 10) == {6: 1, 2: 2}


def test_words_equal_the_tokenizer(tokenizer):
    from tracelake.llm.tokens import WordBpe

    coder = WordBpe(tokenizer)
    odd = ["don't STOP 'S x's", "<|endoftext|>a", "ÀÉß ÿ ×÷", "Σας ΣΑΣ", "a\x00b", "é é", "a\xa0b c", "İstanbul", "  lead trail  ", "", "\n", "'ll've'd--'s...", "日本語 text", "½ ² 12345", "ﬁ \x1c\x1d a", "🙂🙂", "x" * 5000]
    ids, ends = coder.encode([x.encode() for x in odd])
    for k, x in enumerate(odd):
        assert ids[ends[k] : ends[k + 1]].tolist() == coder.exact.encode(x, add_special_tokens=False).ids, x


# 4


def test_line_dedup(docs, empty):
    from tracelake.llm.line_dedup import dedup_lines

    space = " \t\n\x0b\x0c\r"
    owners = defaultdict(set)
    low = -(1 << 63)
    for d, t in rows():
        for line in (t or "").split("\n"):
            k = line.strip(space).translate({i: i + 32 for i in range(65, 91)})
            if len(k) >= 40:
                owners[k].add(low if d is None else d)
    expected = []
    for d, t in rows():
        lines = (t or "").split("\n")
        keys = [x.strip(space).translate({i: i + 32 for i in range(65, 91)}) for x in lines]
        left = [x for x, k in zip(lines, keys, strict=True) if not (len(k) >= 40 and len(owners[k]) >= 5 and max(owners[k]) != (low if d is None else d))]
        expected.append((d, "\n".join(left), len(lines), len(lines) - len(left)))
    out = dedup_lines(docs)
    assert [c for c in out.columns if c in CLASH] == CLASH
    assert got(out.select("doc_id", "text", "n_lines", "n_dropped")) == sorted(expected, key=lambda r: tuple(str(x) for x in r))
    assert any(r[3] for r in expected)
    assert dedup_lines(empty).count() == 0


# 5


def brute_counts(text, rule):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    parts = text.splitlines(keepends=True) if "\n" in text else [text]
    parts = re.findall(r"[^\n]*\n|[^\n]+$", text) or [""]
    bounds = np.cumsum([0, *map(len, parts)])
    counts = [0] * len(parts)
    for a, b in exact.encode(text, add_special_tokens=False).offsets:
        at = {"first": a, "last": b - 1}[rule]
        counts[int(np.searchsorted(bounds, at, side="right")) - 1] += 1
    return counts


@pytest.mark.parametrize("rule", ["first", "last"])
def test_token_counts(docs, empty, rule):
    import public_tokenizers as P

    from tracelake.llm.token_counts import token_counts

    run = lambda df: token_counts(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, rule=rule)
    found = defaultdict(list)
    for r in run(docs).collect():
        found[r["doc_id"]].append(r)
    whole = defaultdict(list)
    for d, t in rows():
        at = 0
        for k, (line, n) in enumerate(zip(re.findall(r"[^\n]*\n|[^\n]+$", t or "") or [""], brute_counts(t or "", rule), strict=True)):
            whole[d].append((k, at, at + len(line), n))
            at += len(line)
    for d, expected in whole.items():
        assert sorted((r["section"], r["start"], r["stop"], r["n_tokens"]) for r in found[d]) == sorted(expected), d
    assert run(empty).count() == 0


def test_most_of_a_token():
    from tracelake.llm.token_counts import attribute, sections

    data = np.frombuffer(b"ab\ncdefg\n", np.uint8)
    bounds = sections(data, b"\n")
    assert bounds.tolist() == [0, 3, 9]
    assert attribute(np.array([2, 4, 3]), bounds, "most").tolist() == [1, 2]
    assert attribute(np.array([2, 4, 3]), bounds, "first").tolist() == [2, 1]
    assert sections(np.frombuffer(b"a----b", np.uint8), b"--").tolist() == [0, 3, 5, 6]


# 6


def test_chat_round_trip(spark):
    from tracelake.llm.chat_format import format_conversations, parse, read_back

    odd = [r"\### Assistant: </turn> ok", "<|end|>\n", "a<|b", "\\", "\\\\<|", "<\\|", "|>", "<", "", None, "Ünï 🙂", "x" * 300_000, "<|assistant|>\nno"]
    data = [(c, t, r, odd[(c + t) % len(odd)]) for c in range(6) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    data += [(None, 0, "user", "null id"), (None, None, None, None), (9, 1, "a|>b<|\\", "role"), (9, 1, "assistant", "tie"), (10, 0, "assistant", "same"), (10, 0, "assistant", "same")]
    df = spark.createDataFrame(data, "conv_id bigint, turn int, role string, text string").withColumn("formatted", F.lit(1)).repartition(3)
    made = format_conversations(df)
    back = {r["conv_id"]: r for r in read_back(made).collect()}
    groups = defaultdict(list)
    for c, t, r, x in data:
        groups[c].append((t is not None, t or 0, r or "", x or ""))
    for r in made.collect():
        turns = [(b.decode(), x.decode()) for b, x in parse(r["formatted"].encode())]
        expected = [(role, x) for _, _, role, x in sorted(groups[r["conv_id"]])]
        assert turns == expected
        loss = "".join(x for role, x in expected if role == "assistant")
        b = back[r["conv_id"]]
        assert b["n_turns"] == len(turns) and b["loss_chars"] == len(loss) and b["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert b["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for role, x in expected).encode()).hexdigest()
        assert b["formatted_chars"] == len(r["formatted"])
    assert format_conversations(df.limit(0)).count() == 0


# 7


def test_warc_round_trip(spark, tmp_path):
    from tracelake.llm.warc import archives, read_warc, write_warc

    same = "<p>" + "copy " * 50
    data = [(5, "http://a/ b\r\nX: y", same), (3, None, same), (4, "u", same), (1, "u", None), (2, "u", ""), (6, "u", "tiny"), (7, "u", "tiny"), (None, "u", "x" * 200), (8, "u", "long " * 100_000), (9, "u", "\x1f\u008b WARC/1.0\r\n\r\n")]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    manifest = write_warc(pages, f"file://{tmp_path}/w")
    out = {r["page_id"]: r for r in read_warc(manifest, 1000).collect()}
    assert len(out) == len(data)
    for d, _, t in data:
        raw = (t or "").encode()
        assert out[d]["payload_bytes"] == len(raw) and out[d]["payload_digest"] == hashlib.sha256(raw).hexdigest()
        revisit = t == same and d != 3
        assert (out[d]["record_type"], out[d]["refers_to"]) == (("revisit", 3) if revisit else ("response", None))
        assert out[d]["payload"] == (None if revisit else raw)
    listed = read_warc(archives(spark, f"file://{tmp_path}/w/*.warc.gz"), 1 << 20)
    assert listed.count() == len(data)
    assert read_warc(write_warc(pages.limit(0))).count() == 0


def test_ranges_own_what_starts_inside(tmp_path):
    import gzip
    import io

    from tracelake.llm.warc import record, records_from

    rng = np.random.default_rng(1)
    inner = record(99, "u", b"inside", "d", 6, None, "now")
    payloads = [bytes(rng.integers(0, 256, int(n), dtype=np.uint8)) for n in rng.integers(0, 3000, 20)] + [inner, b"\x1f\x8b\x08" * 50, b"z" * 200_000]
    data, starts = b"", []
    for k, p in enumerate(payloads):
        starts.append(len(data))
        data += record(k, "u", p, "d", len(p), None, "now")
    for width in (1, 97, 4096, len(data)) if len(data) < 1 else (997, 4096, len(data)):
        seen = [at for lo in range(0, len(data), width) for at, _ in records_from(io.BytesIO(data), len(data), lo, min(lo + width, len(data)))]
        assert seen == starts
    assert gzip.decompress(data).count(b"WARC/1.1") >= len(payloads)


# 8


def brute_hits(docs_, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in docs_:
        w = split(t)
        hit, found = set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if k + n <= len(w) and (own := windows.get(tuple(w[k : k + n]))):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [500_000, 3])
def test_decontamination(spark, docs, empty, block):
    from tracelake.llm.decontaminate import decontaminate

    items = [(1, "a"), (2, " ".join(f"q{k}" for k in range(14))), (30, " ".join(f"q{k}" for k in range(14))), (4, None), (5, "..."), (None, "hidden item"), (11, "Straße größer")]
    texts = [(100, "x " + " ".join(f"Q{k}," for k in range(12)) + " y a"), (101, " ".join(f"q{k}" for k in range(9))), (102, "the hidden item, straße-größer"), (103, " ".join(f"q{k}" for k in range(14)) * 2), (104, "q0 q1 extra " + " ".join(f"q{k}" for k in range(2, 14)))]
    data = rows()[:10] + texts
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("spans", F.lit("clash")).withColumn("id", F.lit(1))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("score", F.lit(1))
    out = decontaminate(df, bench, block_windows=block, slop=2)
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in out.collect()], key=str) == brute_hits(data, items)
    assert decontaminate(empty, bench).count() == 0
    assert decontaminate(df, bench.limit(0)).filter("contaminated").count() == 0


def test_near_phrases(spark):
    from tracelake.llm.decontaminate import decontaminate

    item = " ".join(f"q{k}" for k in range(10))
    texts = [(1, item), (2, item.replace("q5", "extra q5")), (3, item.replace("q5", "one two three four five q5"))]
    out = decontaminate(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string"), slop=2)
    assert {r["doc_id"]: (r["item_ids"], r["near_item_ids"]) for r in out.collect()} == {1: (["7"], ["7"]), 2: ([], ["7"]), 3: ([], [])}


# 9


def brute_secrets(text):
    text = text or ""
    names = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    out = [(m.start(), 0, m.end()) for m in re.finditer(names + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark, docs, empty):
    from tracelake.llm.secrets import find_secrets, listed

    key = "AKIA" + "B" * 17
    token = "Ab3" * 9
    texts = ["ü🙂 password=hunter22 " + key, "secret=token: abcdefgh", "x" * 500 + " SECRET : 'abc' api_key=\"abc.def=12\"", "f" * 30 + " " + "a1" * 12 + "password:short", "AKIAAKIA" + "C" * 12, f"user=bob {token}", token, f"{token} " + "- " * 300 + key, f"https://h.example/x login: mel {token}", "https://alone.example", ("token=abcdef " * 3000), "password=abcdef" * 3, "paſſword=abcdefg toKen=abcdefg"]
    data = rows() + [(200 + k, t) for k, t in enumerate(texts)] + [(205, f"user=bob {token}")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("base", F.lit("clash")).withColumn("doc", F.lit("clash")).repartition(3)
    out = find_secrets(df)
    assert not any("Python" in x or "Arrow" in x for x in out._jdf.queryExecution().executedPlan().toString().split())
    found = {(r["doc_id"], i): r for i, r in enumerate(out.select("*", listed("spans").alias("text")).collect())}
    by_id = defaultdict(list)
    for (d, _), r in found.items():
        by_id[d].append(r)
    for d, t in data:
        expected = brute_secrets(t)
        assert any([tuple(s) for s in sorted(r["base"])] == expected for r in by_id[d]), d
    weak = {d: [s["ord"] for s in r[0]["spans"] if s["ord"] >= 3] for d, r in by_id.items()}
    assert weak[205] == [3, 4] and weak[206] == [] and weak[207] == [] and sorted(weak[208]) == [3, 4, 5] and weak[209] == []
    assert by_id[205][0]["text"] == by_id[205][1]["text"] == "account:0:8,mixed:9:36"
    assert find_secrets(empty).count() == 0


# 10


def test_toxicity(spark, empty):
    from tracelake.llm.toxicity import held_out, score_toxicity, train

    rng = np.random.default_rng(3)
    plain, rude = [f"w{k}ord" for k in range(300)], ["wretched", "vilest", "grubbing"]
    data, labels = [], []
    for k in range(600):
        toxic = k % 5 == 1
        words = list(rng.choice(plain, 40)) + (list(rng.choice(rude, 2)) if toxic else [])
        data.append((k, " ".join(rng.permutation(words))))
        labels.append((k, int(toxic)))
    extra = [(None, None), (1000, ""), (1001, None), (1002, "plain " * 50_000)]
    df = spark.createDataFrame(data + extra, "doc_id bigint, text string").withColumn("label", F.lit(1)).withColumn("score", F.lit("clash"))
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (3, 0)], "doc_id bigint, toxic int").withColumn("text", F.lit("clash"))
    model = train(df, known)
    out = {r["doc_id"]: r for r in score_toxicity(df, model).withColumn("out", held_out(F.col("doc_id"))).collect()}
    assert len(out) == len(data) + len(extra)
    held = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert {k for k, r in out.items() if r["out"]} == {k for k, _ in held} | {None} | {k for k in (1000, 1001, 1002) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([(out[k]["score"] >= 0.5) == bool(y) for k, y in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[1000]["score"] < 0.5
    assert score_toxicity(empty, model).count() == 0
    none = train(df, known.limit(0))
    assert score_toxicity(df.limit(3), none).filter("score >= 0.5").count() == 0
    # Labels of held-out rows are never read.
    flipped = spark.createDataFrame([(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, y in labels], "doc_id bigint, toxic int")
    again = {r["doc_id"]: r["score"] for r in score_toxicity(df, train(df, flipped)).collect()}
    assert all(abs(again[k] - out[k]["score"]) < 1e-9 for k in range(600))


# What the first round left open


def test_pieces_that_end_in_white_space(monkeypatch):
    """A last piece without a word adds no shingle; a text of fewer words than a shingle still is one."""
    from tracelake.llm import simhash

    monkeypatch.setattr(simhash, "_PIECE", 16)
    for text in ("one two three four" + " " * 40, "one two three four five" + "\n" * 17 + " ", " " * 40 + "one two", "one two" + " " * 40, " " * 50):
        found = list(simhash.shingle_hashes(text.encode(), 3))
        assert simhash.majority(found) == brute_fingerprint(text)
        w = text.split()
        assert sum(map(len, found)) == (max(1, len(w) - 2) if w else 0)


def test_stars_keep_components(spark, monkeypatch):
    from tracelake.llm import components as C

    monkeypatch.setattr(C, "STAR_EDGES", 10)
    rng = np.random.default_rng(4)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(int(a), int(b)) for a, b in rng.integers(0, 90, (40, 2))] + [(300, 300)]
    found = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()}
    linked = {(min(p), max(p)) for p in pairs}
    roots = brute_components(list(range(310)), lambda i, j: (j, i) in linked)
    assert [found.get(k, k) for k in range(310)] == roots
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parts_share_no_character(spark):
    """One string isn't both halves of a credential."""
    from tracelake.llm.secrets import find_secrets, listed

    key, token = "AKIA" + "B" * 18, "Ab3" * 9
    texts = [key + "abcxyz1", "login: token=abcdef", f"{key} {token}", f"https://h.example/?token=abcdef {key}", f"https://h.example/x {key}ab1", f"https://h.example/x {key} password=abcdef", "user=" + "a" * 30 + "b1"]
    found = {r["doc_id"]: r["t"] for r in find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", listed("spans").alias("t")).collect()}
    assert found[0] == "access:0:22" and found[1] == "assign:7:19"
    assert found[2] == "access:0:22,mixed:23:50"
    # The token inside the address is a secret of its own, which the address doesn't complete.
    assert "endpoint" not in found[3] and "endpoint" not in found[4] and "endpoint" in found[5]
    assert found[6] == "hex:5:37"


def malformed(spark):
    """One row: an id, and a text with bytes that aren't UTF-8."""
    return spark.createDataFrame([(1,)], "doc_id long").select("doc_id", F.expr("cast(x'61ff62800a63' as string)").alias("text"))


def test_malformed_text(spark, tokenizer):
    import public_tokenizers as P

    from tracelake.llm.chat_format import format_conversations, parse, read_back
    from tracelake.llm.decontaminate import decontaminate
    from tracelake.llm.exact_dedup import exact_dedup
    from tracelake.llm.line_dedup import dedup_lines
    from tracelake.llm.packing import pack_documents
    from tracelake.llm.secrets import find_secrets
    from tracelake.llm.simhash import near_duplicates, simhash_components
    from tracelake.llm.token_counts import token_counts
    from tracelake.llm.toxicity import score_toxicity, train

    df = malformed(spark)
    raw = bytes.fromhex("61ff62800a63")
    assert dedup_lines(df).select(F.col("text").cast("binary").alias("b")).first()["b"] == raw
    turns = df.select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text")
    made = format_conversations(turns)
    assert parse(made.first()["formatted"].encode()) == [(b"assistant", raw.decode("utf-8", "replace").encode())]
    assert read_back(made).first()["loss_chars"] == 6
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for out in (exact_dedup(df), simhash_components(df), near_duplicates(df), pack_documents(df, tokenizer), decontaminate(df, df.withColumnRenamed("doc_id", "item_id")), find_secrets(df), score_toxicity(df, train(df, labels))):
        assert out.count() == 1
    assert token_counts(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 2


class Counting:
    """A file that counts what is read of it."""

    def __init__(self, data):
        import io

        self.file, self.bytes, self.calls = io.BytesIO(data), 0, 0

    def seek(self, at):
        self.file.seek(at)

    def read(self, n):
        data = self.file.read(n)
        self.bytes += len(data)
        self.calls += 1
        return data


def test_archives_are_read_once():
    from tracelake.llm.warc import record, records_from

    rng = np.random.default_rng(2)
    data = b"".join(record(k, "u", bytes(rng.integers(97, 123, 1500, dtype=np.uint8)), "d", 1500, None, "now") for k in range(6000))
    for width in (len(data), 3 << 20):
        file = Counting(data)
        n = sum(1 for lo in range(0, len(data), width) for _ in records_from(file, len(data), lo, min(lo + width, len(data))))
        assert n == 6000 and file.bytes <= 1.2 * len(data) and file.calls < 20


def test_nested_members_are_no_records(monkeypatch):
    """A record stored inside another's compressed bytes isn't taken for one, wherever a range begins; small steps cross every border."""
    from tracelake.llm import warc

    monkeypatch.setattr(warc, "CHUNK", 64)
    inner = warc.record(99, "u", b"inside " * 9, "d", 63, None, "now")
    rng = np.random.default_rng(3)
    parts = [warc.record(k, "u", p, "d", len(p), None, "now") for k, p in enumerate([bytes(rng.integers(0, 256, 700, dtype=np.uint8)), inner + inner, b"WARC/" * 40, inner])]
    data = b"".join(parts)
    starts = np.cumsum([0, *map(len, parts)])[:-1].tolist()
    for width in (50, 333, len(data)):
        assert [at for lo in range(0, len(data), width) for at, _ in warc.records_from(Counting(data), len(data), lo, min(lo + width, len(data)))] == starts


def test_repeated_pages(spark):
    """Rows that repeat the smallest id of a payload are all responses."""
    from tracelake.llm.warc import read_warc, write_warc

    same = "<p>" * 60
    pages = spark.createDataFrame([(1, "u", same), (1, "u", same), (2, "u", same), (3, "u", "x"), (3, "u", "x")], "page_id long, url string, html string")
    assert got(read_warc(write_warc(pages)).select("page_id", "record_type", "refers_to")) == got(spark.createDataFrame([(1, "response", None)] * 2 + [(2, "revisit", 1)] + [(3, "response", None)] * 2, "page_id long, t string, r long"))


def brute_near(docs_, items, slop, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    out = {}
    for d, t in docs_:
        w, found = split(t), set()
        for i, text in items:
            x = split(text)
            for k in range(max(1, len(x) - window + 1)) if x else ():
                own = x[k : k + window]
                if any(all(term in w[max(0, s + j - slop) : max(0, s + j + slop + 1)] for j, term in enumerate(own)) for s in range(-slop, len(w) + slop)):
                    found.add(str(i))
        out[d] = sorted(found)
    return out


@pytest.mark.parametrize(("segment", "block"), [(1, 100_000), (200, 2), (1 << 20, 100_000)])
@pytest.mark.parametrize("slop", [0, 1, 3])
def test_near_matches_equal_brute_force(spark, monkeypatch, segment, block, slop):
    """Documents don't influence each other: results are the same however they share segments, and the rarest word may itself be off its place."""
    from tracelake.llm import decontaminate as D

    monkeypatch.setattr(D, "SEGMENT_BYTES", segment)
    rng = np.random.default_rng(slop)
    phrase = [f"q{k}" for k in range(12)]
    items = [(1, " ".join(phrase)), (2, "the a the a the a the a the a the"), (3, "short one"), (4, "")]
    texts = []
    for k in range(60):
        w = list(phrase)
        for _ in range(k % 5):
            at = int(rng.integers(len(w)))
            if k % 2:
                w.insert(at, ["x", "the", "a", "q3"][int(rng.integers(4))])
            else:
                w[at], w[at - 1] = w[at - 1], w[at]
        texts.append(" ".join(w))
    # A phrase cut in two neighbours, and one whose end stands in the next document.
    texts += [" ".join(phrase[:6]), " ".join(phrase[6:]), " ".join(phrase[:9]), " ".join(["j", *phrase[9:]]), "the a " * 20, "one short", "short x one", ""]
    data = list(enumerate(texts))
    df = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    out = D.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), slop=slop, block_windows=block).collect()
    exact = {r[0]: r for r in brute_hits(data, items)}
    for r in out:
        assert (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) == exact[r["doc_id"]][1:], r["doc_id"]
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_hit"]
    near = brute_near(data, items, slop)
    assert {r["doc_id"]: r["near_item_ids"] for r in out} == ({k: [] for k in near} if not slop else near)


def test_uncontaminated(spark, docs):
    from tracelake.llm.decontaminate import decontaminate, uncontaminated

    bench = spark.createDataFrame([(1, "same text here"), (2, LINE)], "item_id long, text string")
    expected = decontaminate(docs, bench).filter("not contaminated").select(docs.columns)
    found = uncontaminated(docs, bench)
    assert found.columns == docs.columns and got(found) == got(expected) and 0 < found.count() < docs.count()


def test_toxicity_equals_brute_force(spark):
    """Ratios, chosen features and scores, by sets of n-grams and Newton steps instead of arrays and gradients."""
    from tracelake.llm import toxicity as T

    rng = np.random.default_rng(6)
    words = ["ähre", "дом", "plain", "river", "日本語の", "stone", "cloud"]
    data, labels = [], []
    for k in range(120):
        w = list(rng.choice(words, 6)) + (["гадкий", "vile"] if k % 3 == 0 else [])
        data.append((k, " ".join(rng.permutation(w)).upper() if k % 7 == 0 else " ".join(rng.permutation(w))))
        labels.append((k, int(k % 3 == 0 and k % 11 != 0)))
    df = spark.createDataFrame([*data, (3, "plain again")], "doc_id long, text string").repartition(2)
    model = T.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))

    def bucket(gram):
        h = len(gram)
        for c in gram:
            h = (h * 16777619 & 0xFFFFFFFF) ^ ord(c)
        return (h * 2654435761 & 0xFFFFFFFF) >> (32 - T.BITS)

    def grams(text):
        t = f" {text.lower()} "
        return {bucket(t[i : i + n]) for n in T.SIZES for i in range(len(t) - n + 1)}

    y = dict(labels)
    rows_ = [(grams(t), y[d]) for d, t in [*data, (3, "plain again")] if zlib.crc32(str(d).encode()) % 5]
    n1, n0 = sum(v for _, v in rows_), sum(1 - v for _, v in rows_)
    count = {v: defaultdict(int) for v in (0, 1)}
    for g, v in rows_:
        for b in g:
            count[v][b] += 1
    ratio = {b: np.log((count[1][b] + 1) / (n1 + 2)) - np.log((count[0][b] + 1) / (n0 + 2)) for b in {*count[0], *count[1]} if count[0][b] + count[1][b] >= T.MIN_DOCS}
    ratio = {b: r for b, r in ratio.items() if abs(r) >= T.MIN_RATIO}
    assert set(np.flatnonzero(model.feature >= 0).tolist()) == set(ratio)
    order = sorted(ratio)
    x = np.array([[ratio[b] * (b in g) for b in order] + [1.0] for g, _ in rows_])
    label, w = np.array([v for _, v in rows_], float), np.zeros(len(order) + 1)
    penalty = np.diag([T.PENALTY] * len(order) + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(w)), x.T @ (p - label) + penalty @ w)
    for r in T.score_toxicity(df, model).collect():
        own = grams(r["text"])
        z = w[-1] + sum(w[k] * ratio[b] for k, b in enumerate(order) if b in own)
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 0.01


def test_packed_positions():
    from tracelake.llm.decontaminate import pack, unpack

    rng = np.random.default_rng(9)
    counts = np.array([3, 0, 1, 500, 2])
    positions = np.concatenate([np.sort(rng.choice(1 << 34, n, replace=False)) for n in counts])
    positions[0] = 0
    assert (unpack(pack(positions, counts), counts) == positions).all()
    assert len(unpack(pack(np.zeros(0, np.int64), np.zeros(0, np.int64)), np.zeros(0, np.int64))) == 0


@pytest.mark.parametrize(("rows_", "shingles", "ordered"), [(2048, 1 << 22, 1 << 16), (20, 1 << 22, 1 << 16), (2048, 3000, 1 << 16), (20, 1 << 22, 7)])
def test_large_groups_in_parts(spark, monkeypatch, rows_, shingles, ordered):
    """Copies of a template, most of them just not alike, with bands that are put in order and compared whole or in parts."""
    from tracelake.llm import simhash

    monkeypatch.setattr(simhash, "UNIT_ROWS", rows_)
    monkeypatch.setattr(simhash, "UNIT_SHINGLES", shingles)
    monkeypatch.setattr(simhash, "ORDER_ROWS", ordered)
    monkeypatch.setattr(simhash, "REACH", 1)
    texts = template_copies(120, seed=4)
    roots = brute_components(list(range(120)), lambda i, j: alike(texts[i], texts[j]))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert 5 < len(set(roots)) < 120
    assert [found[k] for k in range(120)] == roots
