import pytest

from loupe.llm import split
from loupe.llm.tokenizer import byte_bpe, vocabulary

PROSE = "The first one is short. Another follows, with a clause; it ends here!\nA new line begins. " * 12
TEXTS = [
    PROSE, PROSE.replace("\n", "\n\n"), "a" * 4000, "漢字" * 1500, "🎉" * 700, " " * 3000, "\n" * 900, "x y " * 800,
    "彼は言った。「はい」と。次の文、続く。" * 90, "word " * 1500, "1 2 3\r\n\r\n4" * 400, "é" * 1200, "​" * 500,
]


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe(vocabulary())


@pytest.mark.parametrize("limit,overlap", [(256, 32), (64, 16), (40, 0), (64, 32)])
def test_limits_overlap_and_round_trip(bpe, limit, overlap):
    for text in TEXTS:
        pieces = split.split_text(text, bpe, limit, overlap)
        assert "".join(text[new:end] for _, new, end, _ in pieces) == text
        for k, (start, new, end, tokens) in enumerate(pieces):
            assert tokens == bpe.count(text[start:end]) <= limit and new < end
            assert bpe.count(text[start:new]) <= overlap and start >= (pieces[k - 1][0] if k else 0)
            if k:
                assert new == pieces[k - 1][2]
            else:
                assert start == new == 0
        if overlap and len(pieces) > 1:
            assert any(start < new for start, new, _, _ in pieces)


def test_cuts_lie_at_the_strongest_boundaries(bpe):
    text = PROSE.replace("\n", "\n\n")
    for start, new, end, _ in split.split_text(text, bpe, 128, 16)[:-1]:
        assert text[:end].endswith("\n\n")
    for _, _, end, _ in split.split_text("One two three. " * 200, bpe, 100, 10)[:-1]:
        assert ("One two three. " * 200)[:end].endswith(".")  # a blank goes with the word behind it
    words = "supercalifragilistic expialidocious " * 90
    for _, new, _, _ in split.split_text(words, bpe, 100, 32)[1:]:
        assert words[new].isspace() or words[new - 1].isspace()
    japanese = "彼は言った。" * 300
    assert all(japanese[:end].endswith("。") for _, _, end, _ in split.split_text(japanese, bpe, 100, 10))


def test_short_texts_stay_whole(bpe):
    assert split.split_text("short", bpe) == [(0, 0, 5, 1)]
    assert split.split_text("", bpe) == []


def test_documents(spark, bpe):
    rows = [(1, PROSE), (2, None), (3, ""), (4, "x"), (4, "x"), (None, "y"), (5, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS start", "3 AS tokens")
    got = split.split_documents(df, limit=64, overlap=16).collect()
    mine = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.piece)
    assert [r.piece for r in mine] == list(range(1, len(mine) + 1)) and len(mine) > 3
    assert "".join(r.piece_text[r.new - r.start :] for r in mine) == PROSE
    assert sorted((r.doc_id, r.piece_text) for r in got if r.doc_id in (2, 3, 4, 5)) == [(4, "x"), (4, "x"), (5, " \n")]
    assert split.split_documents(df.limit(0)).count() == 0


def test_limits_are_checked(spark):
    with pytest.raises(ValueError):
        split.split_documents(spark.createDataFrame([], "doc_id long, text string"), limit=40, overlap=30)
