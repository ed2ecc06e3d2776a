import base64
import random

import pytest

from loupe.llm import tokenizer as tk

P = pytest.importorskip("public_tokenizers")
TEXTS = [
    "", " ", "\n\n \t", "Hello world's  end\n", "don't I'll we've IT'S", "<|endoftext|> is text", "naïve café ﬁ 漢字かな交じり文。",
    "مرحبا", "👩‍👩‍👧 é​ x", "1234567 12.5%", "a" * 5000, "ab" * 3000, "   lead and trail   ", " 　x y", "\x00\x7f", "…—“”",
]


@pytest.fixture(scope="module")
def bpe():
    return tk.byte_bpe(tk.vocabulary())


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"k{i}".encode() for i in range(5000)] + [b""]
    table = tk.PerfectHash(keys, list(range(len(keys))))
    assert sorted(table.values) == list(range(len(keys))) and len(table.keys) == len(keys)
    assert all(table.get(k) == i for i, k in enumerate(keys))
    assert all(table.get(f"x{i}".encode()) == -1 for i in range(5000))
    assert tk.PerfectHash([], []).get(b"x") == -1


def test_same_ids_as_the_public_libraries(bpe):
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    third = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    third.encode_special_tokens = True
    rng = random.Random(3)
    letters = "aeioubcdst ÄßéЖ漢 \n.,'0123"
    for text in TEXTS + ["".join(rng.choice(letters) for _ in range(200)) for _ in range(50)]:
        want = other.encode_ordinary(text)
        assert bpe.encode(text) == want == third.encode(text, add_special_tokens=False).ids
        assert bpe.count(text) == len(want)
    assert P.PATTERN == tk.PATTERN


def test_round_trip(bpe):
    whole = {i: k for k, i in zip(bpe.whole.keys, bpe.whole.values)}
    for text in TEXTS:
        assert b"".join(whole[i] for i in bpe.encode(text)).decode() == text


def test_memory_of_pre_tokens_is_bounded_and_harmless(monkeypatch):
    monkeypatch.setattr(tk, "REMEMBERED", 4)
    small = tk.ByteBPE(tk.vocabulary())
    a = [small.encode(f"xq{i} zzv{i}") for i in range(50)]
    assert len(small.known) <= 5 and a == [small.encode(f"xq{i} zzv{i}") for i in range(50)]


def test_documents(spark, bpe):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "x" * 100_000), (1, "Hello world"), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS __t")
    got = sorted(((r.doc_id, list(r.ids)) for r in tk.encode_documents(df).collect()), key=str)
    assert got == sorted(((d, bpe.encode(t)) for d, t in rows), key=str)
    assert tk.encode_documents(df.limit(0)).count() == 0
    assert dict(got)[2] == [] and dict(got)[3] == []
