import random

import numpy as np
import pytest

from loupe.llm import leaks


def brute(docs, items, passage=8):
    out = {}
    for d, t in docs:
        w = leaks.words(t)
        for i, x in items:
            v = leaks.words(x)
            m = min(passage, len(v))
            longest = 0
            for a in range(len(v) - m + 1 if v else 0):
                for b in range(len(w) - m + 1):
                    if w[b : b + m] == v[a : a + m]:
                        k = m
                        while a + k < len(v) and b + k < len(w) and v[a + k] == w[b + k]:
                            k += 1
                        longest = max(longest, k)
            if longest and d is not None and i is not None:
                out[d, i] = max(longest, out.get((d, i), 0))
    return out


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS words"),
        spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id"),
    )


def sample(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 20)))) for i in range(15)]
    for i in range(0, n, 3):
        v = rng.choice(items)[1].split()
        a = rng.randint(0, max(0, len(v) - 9))
        docs[i] = (i, docs[i][1] + " x " + ", ".join(v[a : a + rng.randint(5, 14)]).upper() + "! y")
    return docs + [(900, None), (901, ""), (902, " \n"), (None, items[0][1])], items + [(90, None), (91, ""), (92, "w1 w2 w3"), (None, "w1")]


def test_words():
    assert leaks.words("Ｈello​World, it's ①2 ﬁn_e") == ["helloworld", "it", "s", "12", "fin", "e"]
    assert leaks.words(None) == leaks.words("") == leaks.words("…—") == []


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8, 13, 400])
def test_suffixes_sort_by_depth_and_know_common_prefixes(depth):
    text = np.random.default_rng(depth).integers(0, 4, 300)
    found = leaks.Suffixes(text, depth)
    places = np.flatnonzero(text)
    reach = 1 << (depth - 1).bit_length()  # ranks are by a power of two of symbols

    def word(i):  # up to the next end
        stop = np.flatnonzero(np.append(text[i:], 0) == 0)[0]
        return tuple(text[i : i + min(stop, reach)])

    order = found.order(places)
    keys = [word(i) for i in order]
    assert sorted(order.tolist()) == places.tolist() and keys == sorted(keys)
    rng = np.random.default_rng(1)
    a, b = rng.choice(places, 500), rng.choice(places, 500)
    for x, y, got in zip(a, b, found.common(a, b)):
        u, v = word(x), word(y)
        want = next((k for k, (p, q) in enumerate(zip(u, v)) if p != q), min(len(u), len(v)))
        assert got == want or (got > want and want == min(len(u), len(v)))  # only beyond an end


@pytest.mark.parametrize("shard_words,item_words", [(1_000_000, 2_000_000), (50, 40)])
def test_matches_brute_force(spark, shard_words, item_words):
    docs, items = sample(shard_words % 7)
    d, h = frames(spark, docs, items)
    got = leaks.leaked_passages(d, h, shard_words=shard_words, item_words=item_words).collect()
    assert {(r.doc_id, r.item_id): r.words for r in got} == brute(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    texts, wanted = {k: leaks.words(t) for k, t in docs if k is not None}, {k: leaks.words(t) for k, t in items if k is not None}
    for r in got:
        assert texts[r.doc_id][r.doc_word : r.doc_word + r.words] == wanted[r.item_id][r.item_word : r.item_word + r.words]


def test_passage_may_not_cross_documents_or_items(spark):
    d, h = frames(spark, [(1, "a b c d"), (2, "e f g h")], [(1, "a b c d e f g h"), (2, "i j k l m n o p")])
    assert leaks.leaks(d, h).count() == 0


def test_removal_and_empty_tables(spark):
    docs, items = sample(1)
    d, h = frames(spark, docs, items)
    bad = {k for k, _ in brute(docs, items)}
    kept = [r.doc_id for r in leaks.without_leaks(d, h).collect()]
    assert sorted(kept, key=str) == sorted((k for k, _ in docs if k not in bad), key=str)
    assert leaks.leaks(d.limit(0), h).count() == 0 and leaks.leaks(d, h.limit(0)).count() == 0


def test_very_long_document(spark):
    long = " ".join(f"z{i % 977}" for i in range(60_000)) + " a b c d e f g h i " + "q " * 1000
    d, h = frames(spark, [(1, long), (1, long), (2, "x")], [(5, "b c d e f g h i j")])
    (r,) = leaks.leaked_passages(d, h, shard_words=1000).collect()
    assert (r.doc_id, r.item_id, r.words, r.doc_word) == (1, 5, 8, 60_001)


def test_a_repeated_word_costs_no_more_than_its_places(spark):
    """Occurrences times length would be 40,000 x 113 x 120 words."""
    import time

    items = leaks.Items.of([1, 2], [["a"] * 120, ["b", "a"] * 20], 8)
    took = {}
    for n in (10_000, 160_000):
        text = np.array([items.symbol["a"]] * n + [0], dtype=np.int64)
        began = time.perf_counter()
        m = leaks._search(np.array([7]), np.array([0]), text, items)
        took[n] = time.perf_counter() - began
        assert [list(m[c]) for c in ("doc", "item", "length", "in_item", "in_doc")] == [[0], [0], [120], [0], [0]]
    assert took[160_000] < 2


def test_the_first_of_equal_matches_is_reported(spark):
    run = "p q r s t u v w"
    d, h = frames(spark, [(1, f"x {run} y {run} z {run} p")], [(1, f"k {run} l {run} p"), (2, "t u v")])
    got = {r.item_id: (r.words, r.item_word, r.doc_word) for r in leaks.leaked_passages(d, h).collect()}
    assert got == {1: (9, 10, 19), 2: (3, 0, 5)}
