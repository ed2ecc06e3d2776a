"""Evaluation texts inside a training corpus (problem 8): suffix arrays over words.

Texts become words: after compatibility normalisation (NFKC), removal of format
characters and lower-casing, the maximal runs of letters and numbers.  The corpus
is taken in shards, each a run of documents of one input partition up to a
number of words.  Of each shard the suffixes are sorted as far as the longest
evaluation text goes (prefix doubling); every suffix of every evaluation text is
found in it by binary search, all of them at once, and with it the longest verbatim
match in each document.

A document contains a passage of an item if it has eight consecutive words of it;
an item of fewer words must be contained whole.  Words no item has are one
symbol that matches nothing, so equality of symbols is equality of words and no
result rests on hashing.

The corpus is never shuffled: a shard needs nothing but the items, which are
sent to the tasks in blocks of bounded size (one pass over the corpus for each
block of ``ITEM_WORDS`` words; the usual evaluation set is one block).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.session import Scratch

#: Consecutive words that make a passage.
PASSAGE_WORDS = 8
#: Words of one shard; a longer document is a shard of its own.
SHARD_WORDS = 1_000_000
#: Words of one block of items (some megabytes in each task).
ITEM_WORDS = 2_000_000
#: Occurrences held at once.
BATCH = 1 << 19

_FORMAT = regex.compile(r"\p{Cf}+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.lower())


@dataclass
class Items:
    """Evaluation texts as symbols: symbol 0 is kept for everything else."""

    ids: np.ndarray
    symbol: dict[str, int]
    text: np.ndarray  # all items' symbols, each followed by a 0
    start: np.ndarray  # of each item in text
    size: np.ndarray
    # one row for each suffix that is searched
    suffix: np.ndarray  # place in text
    owner: np.ndarray  # number of the item
    need: np.ndarray  # words that must match

    @classmethod
    def of(cls, ids: list[int], texts: list[list[str]], passage: int) -> Items:
        symbol: dict[str, int] = {}
        parts, sizes = [], []
        for t in texts:
            parts += [symbol.setdefault(w, len(symbol) + 1) for w in t] + [0]
            sizes.append(len(t))
        size = np.array(sizes, dtype=np.int64)
        start = np.cumsum(size + 1) - size - 1
        need = np.minimum(size, passage)
        count = np.where(size > 0, size - need + 1, 0)
        owner = np.repeat(np.arange(len(size)), count)
        inside = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        return cls(
            np.array(ids, dtype=np.int64), symbol, np.array(parts, dtype=np.int64),
            start, size, start[owner] + inside, owner, need[owner],
        )


class Suffixes:
    """Suffix array of symbols, sorted to a depth, and longest common prefixes.

    Prefix doubling: the rank of a place by 2r symbols comes from its rank by r and
    that of the place r further on; only places that still share their rank are
    sorted again.  Symbol 0 ends a suffix: it keeps rank 0, is never refined and
    equals nothing that is asked for.  The ranks by 1, 2, 4, ... symbols are kept, so
    that the longest common prefix of any two places takes one comparison a level.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n = self.n = len(text)
        count = np.bincount(text, minlength=1)
        rank = (np.cumsum(count) - count)[text].astype(np.int32) if n else np.zeros(0, dtype=np.int32)
        # ranks past the end are those of symbol 0
        self.levels = [np.append(rank, np.int32(0))]
        active = np.flatnonzero((text > 0) & (count[text] > 1)) if n else np.zeros(0, dtype=np.int64)
        reach = 1
        while reach < depth and len(active):
            rank = self.levels[-1]
            first, second = rank[active].astype(np.int64), rank[np.minimum(active + reach, n)]
            order = np.argsort(first * (n + 1) + second, kind="stable")
            active, first, second = active[order], first[order], second[order]
            group = np.append(True, first[1:] != first[:-1])
            part = group | np.append(True, second[1:] != second[:-1])
            at = np.arange(len(active))
            group_start, part_start = (np.maximum.accumulate(np.where(b, at, 0)) for b in (group, part))
            rank = rank.copy()
            rank[active] = first + part_start - group_start
            self.levels.append(rank)
            alone = part & np.append(part[1:], True)
            active, reach = active[~alone], reach * 2
        self.rank = self.levels[-1]

    def order(self, places: np.ndarray) -> np.ndarray:
        """``places`` in suffix order."""
        return places[np.argsort(self.rank[places], kind="stable")]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that two places begin with alike, up to the depth."""
        a, b = np.broadcast_arrays(a, b)
        length = np.zeros(a.shape, dtype=np.int64)
        for k in reversed(range(len(self.levels))):
            x, y = (self.levels[k][np.minimum(p + length, self.n)] for p in (a, b))
            length += ((x == y) & (x > 0)) * (1 << k)
        return length


def _first_true(low: np.ndarray, high: np.ndarray, holds) -> np.ndarray:
    """Per row the first place in [low, high) from which on ``holds(rows, places)`` is true, high if none is."""
    low, high = low.copy(), high.copy()
    while len(rows := np.flatnonzero(low < high)):
        mid = (low[rows] + high[rows]) // 2
        yes = holds(rows, mid)
        high[rows[yes]] = mid[yes]
        low[rows[~yes]] = mid[~yes] + 1
    return low


def _search(docs: np.ndarray, starts: np.ndarray, text: np.ndarray, items: Items) -> dict[str, np.ndarray]:
    """MATCH of a shard: for each document and item the longest match, the first of equals.

    Items and shard are sorted together, so an item's suffix knows its place among the
    shard's; binary searches around it give all places that share the words needed.
    Suffixes with the same needed words share these places.  They are told apart by
    document, and in each a suffix meets its two neighbours in suffix order, one of
    which has the longest match; nothing is extended word by word.
    """
    from loupe.llm.near import _expand, _slices

    offset = len(items.text)
    known = np.flatnonzero(text) + offset
    empty = {c: np.zeros(0, dtype=np.int64) for c in ("doc", "item", "length", "in_item", "in_doc")}
    if not len(known) or not len(items.suffix):
        return empty
    both = Suffixes(np.concatenate([items.text, text]), int(items.size.max()))
    sa = both.order(known)
    q, need = items.suffix, items.need
    rest = items.start[items.owner] + items.size[items.owner] - q  # words from here to the item's end
    at = np.searchsorted(both.rank[sa], both.rank[q])
    enough = lambda rows, places: both.common(q[rows], sa[places]) >= need[rows]
    low = _first_true(np.zeros(len(q), dtype=np.int64), at, enough)
    high = _first_true(at, np.full(len(q), len(sa)), lambda rows, places: ~enough(rows, places))
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return empty
    # ranges of places, each once, and the queries that have them
    ranges, group = np.unique(np.stack([low[hit], high[hit]], axis=1), axis=0, return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    queries = hit[by_group]
    q_count = np.bincount(group, minlength=len(ranges))
    q_start = np.cumsum(q_count) - q_count
    best: dict[str, np.ndarray] = {}
    for s in _slices(ranges[:, 1] - ranges[:, 0], BATCH):
        # the places of some ranges, by range and document, in suffix order
        k, place = _expand(ranges[s, 0], ranges[s, 1] - ranges[s, 0])
        doc = np.searchsorted(starts, sa[place] - offset, side="right") - 1
        of = k * len(docs) + doc
        order = np.argsort(of, kind="stable")
        of, place = of[order], place[order]
        fresh = np.append(True, of[1:] != of[:-1])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(of))
        number = np.cumsum(fresh) - 1
        key = number * (len(sa) + 1) + place
        g = of[first] // len(docs) + (s.start or 0)
        for t in _slices(q_count[g], BATCH):
            c, row = _expand(q_start[g[t]], q_count[g[t]])
            c, query = c + t.start, queries[row]
            here = np.searchsorted(key, c * (len(sa) + 1) + at[query])
            length = np.zeros(len(c), dtype=np.int64)
            for beside in (here - 1, here):
                there = (beside >= first[c]) & (beside < last[c])
                x = np.where(there, sa[place[np.clip(beside, 0, len(place) - 1)]], both.n)
                length = np.maximum(length, np.minimum(both.common(q[query], x), rest[query]) * there)
            owner = items.owner[query]
            # the longest of a document and item, the earliest in the item of equals
            o = np.lexsort((q[query], -length, owner, of[first[c]] % len(docs)))
            pair = (of[first[c]] % len(docs))[o] * len(items.ids) + owner[o]
            o = o[np.append(True, pair[1:] != pair[:-1])]
            c, query, here, length = c[o], query[o], here[o], length[o]
            # where it stands first in the document: the least of the places that share all of it
            shares = lambda rows, places: np.minimum(both.common(q[query[rows]], sa[place[places]]), rest[query[rows]]) >= length[rows]
            a = _first_true(first[c], here, shares)
            b = _first_true(here, last[c], lambda rows, places: ~shares(rows, places))
            in_doc = np.zeros(len(c), dtype=np.int64)
            for u in _slices(b - a, BATCH):
                _, spot = _expand(a[u], (b - a)[u])
                in_doc[u] = np.minimum.reduceat(sa[place[spot]], np.cumsum((b - a)[u]) - (b - a)[u])
            d = of[first[c]] % len(docs)
            rows = {
                "doc": d, "item": items.owner[query], "length": length,
                "in_item": q[query] - items.start[items.owner[query]], "in_doc": in_doc - offset - starts[d],
            }
            if best:
                rows = {name: np.concatenate([best[name], v]) for name, v in rows.items()}
            o = np.lexsort((rows["in_doc"], rows["in_item"], -rows["length"], rows["item"], rows["doc"]))
            rows = {name: v[o] for name, v in rows.items()}
            new = np.append(True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["item"][1:] != rows["item"][:-1]))
            best = {name: v[new] for name, v in rows.items()}
    return best


MATCH = "doc_id long, item_id long, words long, item_word long, doc_word long"


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["item_id", "words"])


def _blocks(items: DataFrame, passage: int, most: int) -> Iterator[Items]:
    """Items in blocks of bounded size; their words are cut by the tasks and streamed through the driver."""
    ids: list[int] = []
    texts: list[list[str]] = []
    held = 0
    slim = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    for item_id, w in slim.mapInArrow(_cut_words, "item_id long, words array<string>").toLocalIterator():
        if w:
            ids.append(item_id)
            texts.append(w)
            held += len(w)
        if held > most:
            yield Items.of(ids, texts, passage)
            ids, texts, held = [], [], 0
    if ids:
        yield Items.of(ids, texts, passage)


def leaked_passages(
    documents: DataFrame, heldout: DataFrame, *, passage: int = PASSAGE_WORDS,
    shard_words: int = SHARD_WORDS, item_words: int = ITEM_WORDS,
) -> DataFrame:
    """Longest passage of each item in each document: MATCH, one row per pair that leaks.

    words: length of the match; item_word, doc_word: where it begins, in words.
    Null, empty and blank texts match nothing, on either side; ids that repeat are
    reported per text and merged; documents or items with a null id are left out.
    Whole texts are searched, of any length.  What a block of items matches is
    written before the next block is sent, and the block is taken back.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "leaks")
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim = slim.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    found: DataFrame | None = None
    for number, block in enumerate(_blocks(heldout, passage, item_words)):
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            symbol = items.symbol.get
            docs: list[int] = []
            starts: list[int] = []
            text: list[int] = []

            def flush() -> Iterator[pa.RecordBatch]:
                ids = np.array(docs, dtype=np.int64)
                m = _search(ids, np.array(starts, dtype=np.int64), np.array(text, dtype=np.int64), items)
                if len(m["doc"]):
                    columns = (ids[m["doc"]], items.ids[m["item"]], m["length"], m["in_item"], m["in_doc"])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "words", "item_word", "doc_word"])

            for batch in batches:
                for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    docs.append(doc)
                    starts.append(len(text))
                    text += [symbol(w, 0) for w in words(t)]
                    text.append(0)
                    if len(text) >= shard_words:
                        yield from flush()
                        docs, starts, text = [], [], []
            yield from flush()

        part, _ = scratch.cut(slim.mapInArrow(search, MATCH), f"block-{number}")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], MATCH)
    longest = F.max_by(F.struct("words", "item_word", "doc_word"), F.struct("words", -F.col("item_word"), -F.col("doc_word")))
    return found.groupBy("doc_id", "item_id").agg(longest.alias("m")).select("doc_id", "item_id", "m.*")


def leaks(documents: DataFrame, heldout: DataFrame, **options) -> DataFrame:
    """(``doc_id``, ``item_id``) of the documents that contain a passage of an item."""
    return leaked_passages(documents, heldout, **options).select("doc_id", "item_id")


def without_leaks(documents: DataFrame, heldout: DataFrame, **options) -> DataFrame:
    """The documents, all columns, that contain no passage of any item.

    Documents with a null id or text are kept; they contain nothing that is known.
    """
    bad = leaks(documents, heldout, **options).select("doc_id").distinct()
    return documents.join(bad, "doc_id", "left_anti")
