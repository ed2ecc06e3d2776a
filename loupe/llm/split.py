"""Splitting oversized texts at natural boundaries (problem 9): recursive bisection.

A text is a row of atoms: the tokenizer's pre-tokens, long ones cut into shorter
runs of characters.  Between atoms lie boundaries of different strength: blank
line, line end, sentence end, clause end, blank, and mere change of kind.  A text
over the limit is cut at the strongest boundary in the middle part of it (the
nearest to the midpoint of equals); halves over the limit less the overlap are
cut again.  Then every piece but the first is given the overlap: as many whole
atoms before it as fit in the overlap's tokens.

Sizes are those the tokenizer gives for the finished piece.  Pieces meet the
limit because each is encoded once more at the end: where a piece is over it
(tokens can join or part at its edges), it gives up overlap, and is cut again if
that is not enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from loupe.llm.tokenizer import ByteBPE, byte_bpe, vocabulary
from loupe.session import ship_code

LIMIT_TOKENS = 256
OVERLAP_TOKENS = 32
#: Part of a text around its midpoint in which the strongest boundary is looked for.
MIDDLE = 0.5
#: Pre-tokens of more tokens than this (or half the overlap) are cut into runs of a quarter as many characters.
ATOM_TOKENS = 16

#: First code of the scripts that set no blanks after punctuation.
WIDE = 0x2E80

#: Boundary strengths.
BLANK_LINE, LINE, SENTENCE, CLAUSE, BLANK, KIND, NONE = 6, 5, 4, 3, 2, 1, 0
_SENTENCE_END = regex.compile(r"[.!?…。！？｡؟।]+[\"'”’»)\]」』）]*$")
_CLAUSE_END = regex.compile(r"[,;:，、；：—–][\"'”’»)\]」』）]*$")
_LINE_END = r"(?:\r\n|[\n\r\v\f\x85\u2028])"
_BLANK_LINE = regex.compile(_LINE_END + r"[ \t\u00a0\u3000]*" + _LINE_END + r"|\u2029")
_LINE = regex.compile(_LINE_END)
#: Characters that can close a sentence or clause; others need no closer look.
_CLOSERS = frozenset(".!?…。！？｡؟।,;:，、；：—–\"'”’»)]」』）")


class Atoms:
    """Atoms of a text: where they begin, tokens before them, strength of the boundary there."""

    def __init__(self, text: str, bpe: ByteBPE, overlap: int = 0):
        # an atom must fit in the overlap; a character takes four tokens at the most
        whole = max(1, min(ATOM_TOKENS, overlap // 2)) if overlap else ATOM_TOKENS
        chars = max(1, whole // 4)
        starts: list[int] = []
        sizes: list[int] = []
        strengths: list[int] = []
        known, ids_of = bpe.known.get, bpe.ids_of
        at = 0
        white_from: int | None = None  # start of the white space that ends at the next atom
        for piece in bpe.pieces(text):
            end = at + len(piece)
            if piece.isspace():
                # a boundary before white space would leave the white space to the next piece
                strength = NONE
                if white_from is None:
                    white_from = at
            elif not at:
                strength = NONE
            else:
                lead = piece[0].isspace()
                if white_from is not None:
                    strength = self._strength(text, white_from, text[white_from : at + lead])
                    white_from = None
                elif text[at - 1] in _CLOSERS:
                    strength = self._strength(text, at, piece[0] if lead else "")
                elif lead:
                    strength = BLANK
                else:
                    strength = KIND
            size = len(known(piece) or ids_of(piece))
            if size <= whole:
                starts.append(at)
                sizes.append(size)
                strengths.append(strength)
            else:
                for k in range(0, end - at, chars):
                    part = piece[k : k + chars]
                    starts.append(at + k)
                    sizes.append(len(known(part) or ids_of(part)))
                    strengths.append(NONE if k else strength)
            at = end
        self.starts = starts + [at]
        self.before = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))]).astype(np.int64)
        self.strength = np.array(strengths + [NONE], dtype=np.int8)

    @staticmethod
    def _strength(text: str, end: int, gap: str) -> int:
        if gap and not gap == " ":
            if _BLANK_LINE.search(gap):
                return BLANK_LINE
            if _LINE.search(gap):
                return LINE
        last = text[end - 1]
        if last in _CLOSERS and (gap or ord(last) >= WIDE):
            tail = text[max(0, end - 8) : end]
            if _SENTENCE_END.search(tail):
                return SENTENCE
            if _CLAUSE_END.search(tail):
                return CLAUSE
        return BLANK if gap else KIND


def _middle_cut(atoms: Atoms, a: int, b: int) -> int:
    """Atom before which to cut the atoms a to b: the strongest boundary in the middle part."""
    before = atoms.before
    size = before[b] - before[a]
    mid = before[a] + size / 2
    low = int(np.searchsorted(before, mid - size * MIDDLE / 2, side="left"))
    high = int(np.searchsorted(before, mid + size * MIDDLE / 2, side="right"))
    low, high = max(low, a + 1), min(high, b)
    if low >= high:
        low, high = a + 1, b
    strength = atoms.strength[low:high]
    distance = np.abs(before[low:high] - mid)
    best = strength == strength.max()
    return low + int(np.flatnonzero(best)[distance[best].argmin()])


def split_text(text: str, bpe: ByteBPE, limit: int = LIMIT_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[tuple[int, int, int, int]]:
    """(start, new, end, tokens) of each piece: text[start:end], of which text[new:end] is new."""
    if not text:
        return []
    tokens = bpe.count(text)
    if tokens <= limit:
        return [(0, 0, len(text), tokens)]
    atoms = Atoms(text, bpe, overlap)
    starts, before = atoms.starts, atoms.before
    most = limit - overlap
    out: list[tuple[int, int, int, int]] = []
    open_ = [(0, len(starts) - 1)]  # ranges still to come, the leftmost last
    while open_:
        a, b = open_.pop()
        if before[b] - before[a] > most and b - a > 1:
            cut = _middle_cut(atoms, a, b)
            open_ += [(cut, b), (a, cut)]
            continue
        first = a
        if out and overlap:
            first = int(np.searchsorted(before, before[a] - overlap, side="left"))
        while first < a and bpe.count(text[starts[first] : starts[a]]) > overlap:
            first += 1
        size = bpe.count(text[starts[first] : starts[b]])
        while first < a and size > limit:
            first += 1
            size = bpe.count(text[starts[first] : starts[b]])
        if size > limit and b - a > 1:
            cut = _middle_cut(atoms, a, b)
            open_ += [(cut, b), (a, cut)]
            continue
        if size > limit:  # one atom over the limit: only with limits below a few tokens
            raise ValueError(f"a limit of {limit} tokens cannot hold {text[starts[a]:starts[b]]!r}")
        out.append((starts[first], starts[a], starts[b], size))
    return out


def split_column(
    rows: DataFrame, text: str = "text", *, keep: list[str], path: str | None = None,
    limit: int = LIMIT_TOKENS, overlap: int = OVERLAP_TOKENS,
) -> DataFrame:
    """Pieces of ``text``: the columns ``keep``, piece (from 1), start, new, end (characters), tokens, piece_text.

    Each piece has at most ``limit`` tokens; piece_text = text[start:end], and the
    parts text[new:end] of all pieces put together are the text.  text[start:new]
    repeats the end of the piece before: as many whole atoms as ``overlap`` tokens
    hold.  A text within the limit is one piece; a null or empty text has none.
    limit must exceed overlap by 32 at least (two of the largest atoms).  No shuffle; rows are independent, repeated ones included.
    """
    if overlap < 0 or limit < overlap + 2 * ATOM_TOKENS:
        raise ValueError(f"the limit must exceed the overlap by {2 * ATOM_TOKENS} tokens at least")
    ship_code(rows.sparkSession)
    path = path or vocabulary()
    slim = rows.select(*(F.col(c) for c in keep), F.col(text).cast("string").alias("__text"))
    schema = StructType([
        *slim.drop("__text").schema.fields, StructField("piece", IntegerType()), StructField("start", LongType()),
        StructField("new", LongType()), StructField("end", LongType()), StructField("tokens", LongType()),
        StructField("piece_text", StringType()),
    ])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            row, cells, texts = [], [], []
            for k, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for number, (start, new, end, tokens) in enumerate(split_text(t or "", bpe, limit, overlap), 1):
                    row.append(k)
                    cells.append((number, start, new, end, tokens))
                    texts.append(t[start:end])
            table = np.array(cells, dtype=np.int64).reshape(-1, 5)
            took = pa.array(row, pa.int32())
            columns = [c.take(took) for c in batch.columns[:-1]] + [pa.array(table[:, 0].astype(np.int32))]
            columns += [pa.array(table[:, c]) for c in range(1, 5)] + [pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return slim.mapInArrow(split, schema)


def split_documents(documents: DataFrame, **options) -> DataFrame:
    """Pieces of every document's ``text``, see ``split_column``."""
    return split_column(documents, "text", keep=["doc_id"], **options)
