"""The near-duplicate search takes candidates from SimHash fingerprints, not from MinHash bands alone."""

import random

from tracelake.llm import simhash


def test_close_fingerprints_are_candidates(spark):
    """With one band of 150 MinHashes few pairs share it, so the others are found by their fingerprints."""
    rng = random.Random(5)
    texts = []
    for _ in range(20):
        words = [f"w{rng.randrange(100000)}" for _ in range(900)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"])]
    bits = [simhash.majority([simhash._shingle_set(t.encode(), 5)]) for t in texts]
    close = [(bits[k] ^ bits[k + 1]).bit_count() <= 2 for k in range(0, len(texts), 2)]
    assert sum(close) > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, missed=1 - 2**-52, rows=150).collect()}
    for k, near in enumerate(close):
        assert found[2 * k] == 2 * k and (not near or found[2 * k + 1] == 2 * k)


def test_equal_fingerprints_of_different_sets_are_pairs(spark):
    nodes = spark.createDataFrame([(0, 5), (1, 5), (2, 5), (3, 7), (4, -1)], "node long, fp long")
    assert {tuple(r) for r in simhash.fingerprint_links(nodes, 2).collect()} == {(0, 1), (0, 2), (0, 3)}
    assert simhash.fingerprint_links(nodes.filter("false"), 2).count() == 0
