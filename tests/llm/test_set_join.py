"""The Jaccard join against brute force: words in any white space, nulls, repeated rows and ids, template texts near the threshold, hot lists, small blocks."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tracelake.llm import set_join as S


def shingles(text, size=3):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ") if w]
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size=3, percent=90):
    """doc_id to component; a null id is None and below all others."""
    rank = lambda d: (d is not None, d or 0)
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    return sorted(((d, len(s), min(groups[find(k)], key=rank)) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def corpus(seed=1, n=160):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        if rows and r.random() < 0.6:
            own = r.choice(rows)[1].split() or ["a", "b", "c"]
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                at = r.randrange(len(own) + 1)
                own[at : at + r.choice([0, 1])] = r.choice([[], [r.choice(words)], ["the"]])
            own = own[: r.choice([len(own), len(own), max(1, int(len(own) * 0.93))])]
        else:
            own = [r.choice(words) for _ in range(r.choice([1, 2, 3, 10, 40, 80, 200]))]
        rows.append((k, r.choice([" ", "  ", "\n", "\t"]).join(own) if own else ""))
    return rows


@pytest.mark.parametrize("bits", [22, 4])
def test_equals_brute_force(spark, bits):
    """A sketch of 16 counters orders grams badly, and results are the same."""
    rows = corpus()
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, rows[5][1]), (None, "other words of no one else"), (7, rows[9][1]), rows[11], rows[11], (1003, rows[5][1].upper()), (1004, "One"), (1005, "one"), (1006, "one two")]
    df = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, name string, n_shingles int").repartition(3)
    got = S.similar_sets(df, sketch_bits=bits)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert S.similar_sets(df.limit(0)).collect() == []


@pytest.mark.parametrize(("rounds", "reach"), [(1, 1), (3, 2)])
def test_template_texts_in_small_blocks(spark, monkeypatch, rounds, reach):
    """Texts that share most words, some linked and some just not, with lists of all of them: blocks and parts of a few rows."""
    monkeypatch.setattr(S, "UNIT_ROWS", 7)
    monkeypatch.setattr(S, "ROUNDS", rounds)
    monkeypatch.setattr(S, "REACH", reach)
    monkeypatch.setattr(S, "ORDER_ROWS", 40)
    r = random.Random(5)
    base = [f"t{k}" for k in range(150)]
    rows = []
    for k in range(70):
        own = list(base)
        for _ in range(r.choice([1, 2, 3, 4])):
            own[r.randrange(len(own))] = f"u{r.randrange(40)}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = S.similar_sets(df, sketch_bits=10)
    expected = brute(rows)
    assert 1 < len({c for _, _, c in expected}) < 70
    assert sorted(map(tuple, got.collect()), key=repr) == expected


@pytest.mark.parametrize("postings", [0, 1 << 30])
def test_search_finds_all(monkeypatch, postings):
    """Short lists merged by a heap and by a sort: the same sets, those of brute force."""
    monkeypatch.setattr(S, "HEAP_POSTINGS", postings)
    sets = [s for s in S.gram_sets(pa.array([t.encode() for _, t in corpus(7, 300)], pa.binary()), 3) if len(s)]
    for percent in (50, 80, 90, 100):
        index = S.Index(sets, percent)
        for q in sets[::7]:
            want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= percent * len(np.union1d(q, s))]
            assert sorted(index.search(q).tolist()) == want


def test_sets_are_those_of_words():
    texts = ["", " ", "a", "A  b", "a b", "b a", "a b c", "x a b c", "a b c a b c\n", "É b c", "é b c", "a b\xa0c d"]
    sets = S.gram_sets(pa.array([t.encode() for t in texts], pa.binary()).slice(0), 3)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            assert len(np.intersect1d(s, t)) == len(shingles(texts[i]) & shingles(texts[j]))
    assert S.gram_sets(pa.array([b"skip", b"a b c"], pa.binary()).slice(1), 3)[0].tolist() == sets[6].tolist()


def test_query_against_brute_force(spark, sf_dir):
    from tracelake.llm.queries import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries()["op13_ngram_join"](spark, sf_dir).collect()), key=repr) == brute(rows)


def test_only_long_or_cut_lists_are_opened(spark, monkeypatch):
    """Lists of at most ``REACH + 1`` rows were compared whole: their rows are dropped before any of them is joined or grouped, unless one was cut."""
    n = S.REACH + 2
    lists = [(1, k, 50, 0, n) for k in range(n)] + [(key, 100 * key + k, 50, 0, 3) for key in range(2, 40) for k in range(3)]
    rows = spark.createDataFrame(lists, "key long, node long, size long, place int, n long")
    roots = spark.createDataFrame([(k, k % 2) for k in range(n)], "node long, root long")
    made, write = {}, S.written
    monkeypatch.setattr(S, "written", lambda df, name: made.setdefault(name, write(df, name)))
    found = S.open_rows(rows, roots, spark.createDataFrame([], "node long"), 90)
    assert made["rooted"].count() == n and {r["node"] for r in found.collect()} == set(range(n))
    made.clear()
    found = S.open_rows(rows, roots, spark.createDataFrame([(301,)], "node long"), 90)
    assert made["rooted"].count() == n + 3 and {r["node"] for r in found.collect()} == {*range(n), 300, 301, 302}


def test_sets_are_sent_as_texts():
    """What is sent of a set takes less than half of its hashes, and gives the same set, also where few bytes are read at once."""
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choice(["th", "on", "er", "and", "ing", "re"]) for _ in range(rnd.randrange(1, 5))) for _ in range(300)).encode() for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, texts[0]], pa.binary())], ["text"])
    (sent,) = S._whole_texts(3)(iter([batch]))
    sets = S.gram_sets(pa.array(texts, pa.binary()), 3)
    assert sent.num_rows == 20 and sum(map(len, sent.column("text").to_pylist())) < 0.5 * sum(s.nbytes for s in sets)
    S_bytes, S.READ_BYTES = S.READ_BYTES, 1000
    try:
        assert [s.tolist() for s in S._sets_of(sent.column("text").to_pylist(), 3)] == [s.tolist() for s in sets]
    finally:
        S.READ_BYTES = S_bytes


def test_bits_rule_out_no_link():
    """Sets differ in no more bits than grams, also where one has more words of bits; those that share a gram by chance are left out."""
    rnd = np.random.default_rng(4)
    sets = []
    for n in (1, 2, 20, 63, 64, 126, 128, 129, 135, 255, 257, 400, 1000, 1030):
        own = np.unique(rnd.integers(0, 1 << 64, n, np.uint64))
        sets += [own, np.unique(np.concatenate([own[: n - n // 20], rnd.integers(0, 1 << 64, n // 20, np.uint64)])), np.unique(np.concatenate([own[:1], rnd.integers(0, 1 << 64, n, np.uint64)]))]
    bits = [S.parity(s).tolist() for s in sets]
    assert {len(b) for b in bits} == {1, 2, 4, 8, 16}
    pairs = [(a, b) for a in range(len(sets)) for b in range(a)]
    words = pa.list_(pa.int64())
    columns = [pa.array([p[k] for p in pairs]) for k in (0, 1)] + [pa.array([len(sets[p[k]]) for p in pairs]) for k in (0, 1)] + [pa.array([bits[p[k]] for p in pairs], words) for k in (0, 1)]
    (out,) = S._few_bits_apart(90)(iter([pa.RecordBatch.from_arrays(columns, ["a", "b", "a_size", "b_size", "a_bits", "b_bits"]).slice(3)]))
    kept = set(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True))
    linked = {(a, b) for a, b in pairs[3:] if 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b]))}
    assert linked and linked <= kept
    assert not any(a // 3 != b // 3 for a, b in kept if min(len(sets[a]), len(sets[b])) > 100)
    rows = [(0, k, k, True, True, len(sets[k]), bits[k]) for k in range(len(sets))]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c), words if k == 6 else None) for k, c in enumerate(zip(*rows, strict=True))], ["unit", "node", "root", "asks", "held", "size", "bits"])
    (out,) = S._asked_alike(90)(iter([batch]))
    asked = set(out.column("node").to_pylist())
    assert {k for p in linked for k in p} <= asked and not any(k % 3 == 2 for k in asked if len(sets[k]) > 100)


def test_chance_grams_send_no_texts(spark, monkeypatch):
    """Texts that share single rare grams in a chain are candidates of each other, more than a unit holds: the bits leave them out, so none is cut, asked or sent again."""
    monkeypatch.setattr(S, "UNIT_ROWS", 10)
    rnd = random.Random(8)
    own = lambda k: [f"q{k}x{j}" for j in range(3)]  # noqa: E731  a gram that texts k and k + 1 share
    rows = []
    for k in range(60):
        rest = [f"z{rnd.randrange(1 << 40)}" for _ in range(150)]
        rows.append((k, " ".join([*own(k), *rest[:75], *own(k + 1), *rest[75:]])))
    rows += [(100 + k, rows[k][1] + " more") for k in (3, 5)]
    sent, write = [], S.written
    monkeypatch.setattr(S, "written", lambda df, name: sent.append((name, out := write(df, name))) or out)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, S.similar_sets(df).collect()), key=repr)
    assert got == brute(rows)
    assert sum(out.count() for name, out in sent if name == "asked") == 4


def test_a_list_put_in_order_by_parts_is_open(spark, monkeypatch):
    """Few rows of its two levels may be in different parts, where none is a neighbour of the other."""
    monkeypatch.setattr(S, "ORDER_ROWS", 100)
    n = 200
    rows = spark.createDataFrame([(1, k, 50 if k < 10 else 1000 + 500 * k, 0, n) for k in range(n)], "key long, node long, size long, place int, n long")
    found = S.open_rows(rows, spark.createDataFrame([], "node long, root long"), spark.createDataFrame([], "node long"), 90)
    assert set(range(10)) <= {r["node"] for r in found.collect()}
