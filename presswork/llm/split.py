"""Cutting oversized texts at natural borders, with an overlap between consecutive pieces.

Recursive bisection: a stretch that is still too long is cut at the strongest border near its
middle (paragraph, then sentence, then word; a bare sign border only where there is no other), and
both halves are treated alike; then each piece but the first gets up to ``overlap`` signs of the
text before it, from a word's beginning where there is one.

Defined results
  * texts up to the limit, null and empty ones give no pieces from :func:`cut_rows`;
  * a piece never exceeds the limit, whatever the text (one word of a million signs, only blanks);
  * the pieces without their overlaps, put together, are the text;
  * rows repeated exactly are cut once each; extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import broadcast_if_small, written

LIMIT, OVERLAP = 700, 80
_PIECE = (("piece_no", T.IntegerType()), ("piece_text", T.StringType()), ("piece_start", T.IntegerType()), ("own_start", T.IntegerType()), ("piece_end", T.IntegerType()))

#: Ends of paragraphs, sentences and words, strongest first: the cut comes where the match begins.
_BORDERS = (
    re.compile(r"(?<=\S)[^\S\n]*\n\s*(?=\S)"),
    re.compile(r"(?<=[.!?…])(?=\s+\S)|(?<=[.!?…][\"'»”“’)\]])(?=\s+\S)"),
    re.compile(r"(?<=\S)(?=\s)"),
)


def _borders(text: str) -> list[list[int]]:
    return [[m.start() for m in b.finditer(text)] for b in _BORDERS]


def _nearest(at: list[int], low: int, high: int, middle: int) -> int | None:
    """The member of the sorted list at in [low, high] that is nearest to middle."""
    i = bisect_left(at, middle)
    best = [x for x in at[max(0, i - 1) : i + 1] if low <= x <= high]
    return min(best, key=lambda x: (abs(x - middle), x), default=None)


def _sign_border(text: str, at: int, low: int) -> int:
    """at, or somewhat before it, so that no sign is parted from its combining marks."""
    i = at
    while i > low and (unicodedata.combining(text[i]) or text[i] in "‍️" or text[i - 1] == "‍"):
        i -= 1
    return i if i > low else at


def bisect_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(begin with overlap, begin, end) of the pieces of text.

    A piece's own part is at most limit - overlap long, so that the overlap always has room.
    """
    room = limit - overlap
    if len(text) <= limit:
        return [(0, 0, len(text))] if text else []
    at = _borders(text)
    stack, parts = [(0, len(text))], []
    while stack:
        low, high = stack.pop()
        if high - low <= room:
            parts.append((low, high))
            continue
        middle, near = (low + high) // 2, (high - low) // 4
        cut = None
        for reach in (near, (high - low) // 2 - 1):  # near the middle first, then anywhere
            for kind in at:
                cut = _nearest(kind, max(low + 1, middle - reach), min(high - 1, middle + reach), middle)
                if cut is not None:
                    break
            if cut is not None:
                break
        if cut is None:
            cut = _sign_border(text, middle, low + 1)
        stack += [(cut, high), (low, cut)]
    merged = [parts[0]]
    for low, high in parts[1:]:  # halves that turned out small go together again where they fit
        first = len(merged) == 1
        if high - merged[-1][0] <= (limit if first else room) and high - low + merged[-1][1] - merged[-1][0] <= room // 2:
            merged[-1] = (merged[-1][0], high)
        else:
            merged.append((low, high))
    out = []
    for i, (low, high) in enumerate(merged):
        start = low
        if i and overlap:
            floor = max(merged[i - 1][0], low - min(overlap, limit - (high - low)))
            start = floor
            if floor > 0 and not text[floor - 1].isspace():  # inside a word: from the next word on
                m = re.compile(r"\s\S").search(text, floor, low)
                start = m.end() - 1 if m else _sign_border(text, floor, 0) if floor else floor
                start = start if start >= floor else floor
        out.append((start, low, high))
    return out


def cut_rows(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, piece_text, piece_start, own_start, piece_end) of the rows over the limit.

    Places count signs of the text from 0; own_start is where the part after the overlap begins.
    The filter on the length runs in the scan's stage, only oversized texts reach Python; no shuffle.
    """
    over = df.select(key, text).where(F.length(text) > limit)
    kind = df.select(key).schema
    schema = T.StructType(kind.fields + [T.StructField(c, t) for c, t in _PIECE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                take, rows = [], []
                for j, t in enumerate(part.column(1).to_pylist()):
                    for n, (start, own, end) in enumerate(bisect_text(t, limit, overlap)):
                        take.append(j)
                        rows.append((n, t[start:end], start, own, end))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                types = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(take, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]],
                    [f.name for f in schema],
                )

    return over.mapInArrow(run, schema)


def cut_chunks(chunks: DataFrame, articles: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, piece_no, piece_text, char_start, char_end) of the oversized chunks.

    char_start and char_end are places in the article's body. A chunk's own offsets are used where
    the body has the chunk's text there; stale and null ones are replaced by the first place of the
    text; where the article is missing or differs they are null, and piece_start and piece_end still
    give the places in the chunk. Rows repeated exactly count once.
    """
    over = written(chunks.where(F.length("chunk_text") > limit).select("id", "article_id", "chunk_text", "char_start").dropDuplicates(), "oversized")
    # Only the bodies of articles with an oversized chunk are moved; of repeated ids the smallest body is taken.
    wanted = broadcast_if_small(written(over.select("article_id").where("article_id is not null").distinct(), "wanted"))
    bodies = articles.select(F.col("id").alias("article_id"), "body_text").join(wanted, "article_id", "left_semi").groupBy("article_id").agg(F.min("body_text").alias("body_text"))
    here = F.expr("substring(body_text, char_start + 1, length(chunk_text))") == F.col("chunk_text")
    place = F.instr("body_text", F.col("chunk_text")) - 1
    base = F.when(here, F.col("char_start")).otherwise(F.when(place >= 0, place))
    placed = over.join(bodies, "article_id", "left").select(F.struct("id", base.cast("int").alias("base")).alias("key"), "chunk_text")
    return cut_rows(placed, "key", "chunk_text", limit, overlap).select(
        F.col("key.id").alias("chunk_id"), "piece_no", "piece_text", "piece_start", "piece_end",
        (F.col("key.base") + F.col("piece_start")).alias("char_start"), (F.col("key.base") + F.col("piece_end")).alias("char_end"),
    )
