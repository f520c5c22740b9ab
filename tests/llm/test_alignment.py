"""Token alignment against plain Python on small tables with nulls, repeats, odd spaces, special strings, malformed and long texts."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tracelake.llm.alignment import Pieces, align, pieces
from tracelake.llm.tokens import byte_alphabet

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LONG = "A longer text, with words that come again. " * 400
TEXTS = [
    None,
    "",
    " ",
    "one",
    "two  spaces   and a tail ",
    "  leading, then unbelievable tokenization of antidisestablishmentarianism",
    "lines\n\nand\ttabs\r\n end",
    "<|endoftext|> is plain <s> and <unk> too",
    "émigré naïve 日本語 текст 🙂 mixed",
    "a ▁ mark of its own",
    LONG,
    "one",
    "zero\x00byte",
]


def brute(texts):
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    alphabet = byte_alphabet()
    docs = []
    for text in texts:
        text = text or ""
        e = a_model.encode(" " + text, add_special_tokens=False) if text else None
        ids = (e.ids, b_model.encode(text)) if text else ([], [])
        spelled = [bytes(alphabet[c] for c in t) for t in (e.tokens if e else [])], []
        for k in ids[1]:
            piece = b_model.id_to_piece(k)
            spelled[1].append(bytes([int(piece[3:5], 16)]) if b_model.is_byte(k) else piece.replace("▁", " ").encode())
        if any(b"".join(s) != (" " + text).encode() for s in spelled) or not text:
            docs.append((0, 0, []))
            continue
        ends = [[sum(map(len, s[: k + 1])) for k in range(len(s))] for s in (spelled[0], spelled[1])]
        groups, at = [], (0, 0)
        for cut in sorted(set(ends[0]) & set(ends[1])):
            to = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append((ids[0][at[0] : to[0]], ids[1][at[1] : to[1]]))
            at = to
        docs.append((len(ids[0]), len(ids[1]), groups))
    linked = [[(x, y) for a, b in g for x in a for y in b] for _, _, g in docs]
    counts = Counter(p for own in linked for p in set(own))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (n_a, n_b, g), own in zip(docs, linked, strict=True):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        digest = hashlib.sha256(shown.encode()).hexdigest() if g else ""
        out.append((n_a, n_b, len(g), len(own), sum(counts[p] == most[p[0]] for p in own), sum(counts[p] for p in own), digest))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize(("piece", "broadcast"), [(1 << 20, 1 << 20), (200, 0)])
def test_align(spark, piece, broadcast):
    """Whole and cut into pieces of 200 bytes, joined by broadcast and by shuffle: the same. Other columns, clashing ones too, are ignored."""
    rows = [(k if k != 3 else None, t, "x", 1) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, groups string, n_a int")
    got = align(df, A, P.PATTERN, B, piece=piece, broadcast_groups=broadcast)
    assert got.columns == ["doc_id", *COLUMNS]
    want = brute([*TEXTS, TEXTS[5]])
    key = lambda r: (r[0] is not None, r)
    expected = [(r[0], *w) for r, w in zip([*rows, rows[5]], want, strict=True)]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)
    assert align(df.limit(0), A, P.PATTERN, B).collect() == []


def test_malformed_bytes(spark):
    df = spark.createDataFrame([(1, b"good text"), (2, b"bad \xff text")], "doc_id long, text binary")
    got = {r["doc_id"]: r for r in align(df, A, P.PATTERN, B).collect()}
    assert got[1]["n_a"] > 0 and got[1]["count_sum"] == got[1]["n_links"]
    assert tuple(got[2])[1:] == (0, 0, 0, 0, 0, 0, "")


def test_pieces_of_a_text_and_words():
    cut = pieces(LONG.encode(), 300)
    assert b" ".join(cut) == LONG.encode() and max(map(len, cut)) < 400
    assert pieces(b"x" * 1000, 100) == [b"x" * 1000]
    model, whole = Pieces(B), sentencepiece.SentencePieceProcessor(model_file=B)
    for text in ["a b", " a", "  a", "a  b   c", "a ", "a  ", " ", "   ", "a\n b", "x" * 300, "日本 語"]:
        assert model.encode([text])[0].tolist() == whole.encode(text), repr(text)
    model.MEMO = 5  # words are forgotten and learned again
    assert [x.tolist() for x in model.encode(["one two three", "four five six"])] == [whole.encode("one two three"), whole.encode("four five six")]


def test_query_against_brute_force(spark, sf_dir):
    """The registered query on every row of the smallest table."""
    from tracelake.llm.queries import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {d["doc_id"]: w for d, w in zip(docs, brute([d["text"] for d in docs]), strict=True)}
    got = queries()["op11_token_alignment"](spark, sf_dir).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want


def test_words_in_both_vocabularies():
    """Words known on their own give what whole texts give, also beside spaces of all kinds, where the first vocabulary has tokens across spaces."""
    from tracelake.llm.alignment import ByteLevel

    a = ByteLevel(A, P.PATTERN)
    model, whole = Pieces(B, a), sentencepiece.SentencePieceProcessor(model_file=B)
    texts = ["one two three", "it's 's n't", "a   b", " a", "a\n b", "a \n b", "a\n\n b ", "tail ", "x  y", "日本 語 🙂", LONG]
    for _ in range(2):
        other, own = model.encode_both(texts)
        assert [x.tolist() for x in other] == [a.encode(t, len(t.encode())).tolist() for t in texts]
        assert [x.tolist() for x in own] == [whole.encode(t) for t in texts]
        model.MEMO = 3  # all are forgotten and learned again


def test_only_the_last_step_is_interpreted(spark):
    """No lambda function runs for each token: of the array functions only the one that puts groups together has one."""
    from tracelake.llm.alignment import grouped, separate_steps

    tokens = spark.createDataFrame([], "a_ends array<bigint>, a array<bigint>, b_ends array<bigint>, b array<bigint>")
    with separate_steps(spark):
        plan = grouped(tokens).select("groups")._jdf.queryExecution().analyzed().toString()
    assert plan.count("zip_with(") == 1 and "transform(" not in plan


def test_distinct_groups_are_found_once(spark):
    """A piece's distinct groups go with it: pairs and the table of groups are made of them, not of all its groups."""
    from tracelake.llm.alignment import alignments

    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = alignments(df, A, P.PATTERN, B).collect()
    assert len(rows) == len(TEXTS) and all(sorted(r["kinds"]) == sorted(set(r["groups"])) for r in rows)
    assert [len(r["kinds"]) < r["n_groups"] for r in rows if r["doc_id"] == TEXTS.index(LONG)] == [True]
