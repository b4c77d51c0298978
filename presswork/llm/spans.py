"""Long spans that stand word for word in several texts.

Equal texts are one entry. Every entry is winnowed: of the hashes of its GRAM-sign stretches, the
least of each window of LEAST - GRAM + 1 is an anchor, so that every span of LEAST signs holds an
anchor, the same one wherever the span stands. Anchors that stand in one entry only are dropped by
a count on their hash; around the others, the stretch that any span through the anchor can need is
cut out of its text. The stretches of one anchor are a reference shard: suffix automata are built
over them, the other stretches are streamed through, and wherever their matching statistic reaches
LEAST there is a span. Broadcasting automata of whole corpus shards to every task would stream each
text once per shard, which grows with the square of the corpus; here only texts meet that share an
anchor.

Defined results
  * null texts and those shorter than LEAST share nothing; texts of any length are taken whole;
  * equal texts share all of themselves; repeated ids are the same document;
  * places count signs from 0; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written

#: Least span, and stretch that is hashed for an anchor.
LEAST, GRAM = 300, 150
#: Stretches of one anchor that a block holds; more are met block by block.
BLOCK = 64
#: Stretches of one anchor from which their windows are counted instead, where only the cover is wanted.
HOT = 256

_B = 0x9E3779B97F4A7C15 | 1
_B_INVERSE = pow(_B, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def anchors(texts: list[str], least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, hash) of the anchors of texts, each at least ``least`` signs long."""
    signs = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    n = len(signs)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    # Rolling hash of all stretches at once: differences of running sums, brought to a common power.
    sums = np.concatenate([[np.uint64(0)], np.cumsum((signs.astype(np.uint64) + np.uint64(1)) * _powers(_B, n))])
    h = (sums[gram:] - sums[:-gram]) * _powers(_B_INVERSE, n - gram + 1)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    w = least - gram + 1
    low = _sliding(np.minimum, h, w)
    # Windows that lie in one text: one span of ``least`` signs each.
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    lone = np.where(np.arange(len(low)) + least <= ends[owner[: len(low)]], low, np.uint64(0))
    # A place is an anchor if its hash is the least of some window over it, that is, the largest of their least ones.
    edge = np.zeros(w - 1, np.uint64)
    chosen = np.flatnonzero((_sliding(np.maximum, np.concatenate([edge, lone, edge]), w) == h) & (h > 0))
    chosen = _thinned(chosen, h[chosen], owner[chosen], w)
    own = owner[chosen]
    return own, chosen - (ends - sizes)[own], h[chosen].view(np.int64)


def _thinned(places: np.ndarray, h: np.ndarray, own: np.ndarray, w: int) -> np.ndarray:
    """Of tied anchors of one text as few as leave one in every window: the last that is at most w after the one kept.

    Which of the equal stretches is kept does not matter, as what is cut out around either holds the whole window.
    """
    same = (h[1:] == h[:-1]) & (own[1:] == own[:-1]) & (places[1:] - places[:-1] <= w)
    if not same.any():
        return places
    keep = np.ones(len(places), dtype=bool)
    border = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    for lo, hi in border.reshape(-1, 2):
        run = places[lo : hi + 1]
        keep[lo + 1 : hi] = False
        at = 0
        while at < len(run) - 1:
            at = max(at + 1, int(np.searchsorted(run, run[at] + w, "right")) - 1)
            keep[lo + at] = True
    return places[keep]


def _sliding(op: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """op over every w neighbours of x, in linear time: by running results of blocks of w from both ends."""
    n = len(x) - w + 1
    full = np.concatenate([x, np.full(-len(x) % w, x[-1])]).reshape(-1, w)
    after = op.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    before = op.accumulate(full, axis=1).ravel()
    return op(after[:n], before[w - 1 : w - 1 + n])


class Automaton:
    """The suffix automaton of one stretch."""

    def __init__(self, text: str) -> None:
        link, size, step = [-1], [0], [{}]
        last = 0
        for c in text:
            new = len(size)
            size.append(size[last] + 1)
            link.append(0)
            step.append({})
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if size[p] + 1 == size[q]:
                    link[new] = q
                else:
                    twin = len(size)
                    size.append(size[p] + 1)
                    link.append(link[q])
                    step.append(step[q].copy())
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.link, self.size, self.step = link, size, step

    def spans(self, text: str, least: int) -> list[tuple[int, int]]:
        """[begin, end) of text's stretches whose matching statistic reaches least, joined where they meet."""
        link, size, step = self.link, self.size, self.step
        at = n = 0
        out: list[tuple[int, int]] = []
        for i, c in enumerate(text):
            while at and c not in step[at]:
                at = link[at]
                n = size[at]
            if c in step[at]:
                at = step[at][c]
                n += 1
            if n >= least:
                if out and i + 1 - n <= out[-1][1]:
                    out[-1] = (min(out[-1][0], i + 1 - n), i + 1)
                else:
                    out.append((i + 1 - n, i + 1))
        return out


def _entries(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members, entries): (key, rep, n) of every text; (rep, text) once for equal texts."""
    some = df.where(F.length(text) >= LEAST).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    h = some.select("doc", F.xxhash64("text", F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), F.reverse("text")).alias("h2")).distinct()
    reps = h.groupBy("h1", "h2").agg(F.min("doc").alias("rep"), F.count("*").alias("n"))
    members = h.join(reps, ["h1", "h2"]).select("doc", "rep", "n")
    return members, some.join(reps.select(F.col("rep").alias("doc")), "doc", "left_semi").dropDuplicates(["doc"]).withColumnRenamed("doc", "rep")


def _anchor_rows(entries: DataFrame, least: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                own, place, h = anchors(part.column(1).to_pylist(), least, gram)
                yield pa.RecordBatch.from_arrays([pa.array(h), part.column(0).take(pa.array(own)), pa.array(place, pa.int32())], ["h", "rep", "place"])

    return entries.mapInArrow(run, "h bigint, rep bigint, place int")


def _met(left: dict[str, list], right: dict[str, list], same: bool, least: int, cover: bool) -> list[tuple]:
    """What the stretches of two blocks of one anchor share; a stretch maps to its (entry, place) list.

    As pairs: (a, b, 0, 0). As cover: (entry, entry, begin, end) of each stretch of it that another has.
    """
    made: dict[str, Automaton] = {}
    out: set[tuple] = set()

    def note(spans: list[tuple[int, int]], of: list, other: list) -> None:
        reps = {r for r, _ in other}
        for r, at in of:
            if reps - {r}:
                out.update((r, r, at + lo, at + hi) for lo, hi in spans)

    segs = list(left)
    for i, s in enumerate(segs):
        for t in segs[i:] if same else right:
            mine, theirs = left[s], (left if same else right)[t]
            if s == t:
                spans = back = [(0, len(s))] if len(s) >= least else []
            else:
                pairs = {(min(a, b), max(a, b)) for a, _ in mine for b, _ in theirs if a != b} if not cover else None
                if pairs is not None and all((a, b, 0, 0) in out for a, b in pairs):
                    continue
                if s not in made:
                    made[s] = Automaton(s)
                spans = made[s].spans(t, least)
                if spans and cover:
                    if t not in made:
                        made[t] = Automaton(t)
                    back = made[t].spans(s, least)
            if not spans:
                continue
            if cover:
                note(spans, theirs, mine)
                note(back, mine, theirs)
            else:
                out.update((min(a, b), max(a, b), 0, 0) for a, _ in mine for b, _ in theirs if a != b)
    return list(out)


def _shard_spans(batches: Iterator[pa.RecordBatch], least: int, cover: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (h, x, y): the two blocks of a reference shard, side 0 and 1."""
    now, sides = None, ({}, {})

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["a", "b", "lo", "hi"])

    for b in batches:
        done: list[tuple] = []
        for h, x, y, side, rep, at, seg in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if (h, x, y) != now:
                if now is not None:
                    done += _met(*sides, now[1] == now[2], least, cover)
                now, sides = (h, x, y), ({}, {})
            sides[side].setdefault(seg, []).append((rep, at))
        if done:
            yield batch(done)
    if now is not None and (done := _met(*sides, now[1] == now[2], least, cover)):
        yield batch(done)


def shared_spans(entries: DataFrame, cover: bool, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """Pairs (a, b) of entries that share a span; or, as cover, (a, lo, hi) of what of an entry stands in others.

    Every shared stretch of ``least`` signs is covered by such a row; longer ones come in parts that meet.
    """
    rows = written(_anchor_rows(entries, least, gram), "anchors")
    counted = rows.groupBy("h").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("m")).where("lo < hi")
    shared = rows.join(counted.select("h", "m"), "h")
    # Back to the texts, once per entry with shared anchors; only the stretches around them go on.
    per = shared.groupBy("rep").agg(F.collect_list(F.struct("h", "place", "m")).alias("marks"))  # bounded by the text
    cut = entries.join(per, "rep").select("rep", "text", F.explode("marks").alias("k"))
    begin = F.greatest(F.col("k.place") - (least - gram), F.lit(0))
    seg = F.substring("text", begin + 1, F.col("k.place") + F.lit(least) - begin)
    cut = cut.select("k.h", "k.m", "rep", begin.alias("begin"), seg.alias("seg"))
    many = None
    if cover:
        cut = written(cut, "stretches")
        many, cut = _hot_cover(cut.where(F.col("m") > HOT), least), cut.where(F.col("m") <= HOT)
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    # Equal stretches go into one block, so that they are compared once.
    cut = cut.withColumns({"blocks": blocks, "mine": F.pmod(F.xxhash64("seg"), blocks).cast("int")})
    # A block meets itself and those after it as side 0, and those before it as side 1.
    as_left = cut.select("h", F.col("mine").alias("x"), F.explode(F.sequence(F.col("mine"), F.col("blocks") - 1)).alias("y"), F.lit(0).alias("side"), "rep", "begin", "seg")
    as_right = cut.where("mine > 0").select("h", F.explode(F.sequence(F.lit(0), F.col("mine") - 1)).alias("x"), F.col("mine").alias("y"), F.lit(1).alias("side"), "rep", "begin", "seg")
    sent = as_left.unionByName(as_right).repartition("h", "x", "y").sortWithinPartitions("h", "x", "y")
    out = sent.mapInArrow(lambda it: _shard_spans(it, least, cover), "a bigint, b bigint, lo int, hi int")
    return out if many is None else out.unionByName(many)


def _hot_cover(cut: DataFrame, least: int) -> DataFrame:
    """The cover by hot anchors: stretches are not met in pairs, their windows of ``least`` signs are counted.

    A stretch has at most least - gram + 1 windows, so that the work grows with the stretches. Windows
    are told apart by two hashes of 64 bits.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                reps, begins, segs = (c.to_pylist() for c in b.slice(i, 256).columns)
                cols: list[list[np.ndarray]] = [[], [], [], []]
                for r, at, s in zip(reps, begins, segs, strict=True):
                    n = len(s) - least + 1
                    if n < 1:
                        continue
                    signs = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
                    for to, base in ((cols[0], _B), (cols[1], 0xC2B2AE3D27D4EB4F)):
                        h = np.zeros(n, np.uint64)
                        for k in range(least):
                            h = h * np.uint64(base) + signs[k : k + n]
                        to.append(h.view(np.int64))
                    cols[2].append(np.full(n, r, np.int64))
                    cols[3].append((np.arange(n) + at).astype(np.int32))
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["h1", "h2", "rep", "lo"])

    rows = written(cut.select("rep", "begin", "seg").mapInArrow(windows, "h1 bigint, h2 bigint, rep bigint, lo int").distinct(), "windows")
    several = rows.groupBy("h1", "h2").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").select("h1", "h2")
    found = rows.join(several, ["h1", "h2"], "left_semi")
    return found.select(F.col("rep").alias("a"), F.col("rep").alias("b"), "lo", (F.col("lo") + least).alias("hi"))


def sharing_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents that share a span of at least LEAST signs."""
    members, entries = _entries(df, key, text)
    members, entries = written(members, "members"), written(entries, "entries")
    met = shared_spans(entries, False).select("a", "b").distinct()
    one, two = members.select(F.col("rep").alias("a"), F.col("doc").alias("x")), members.select(F.col("rep").alias("b"), F.col("doc").alias("y"))
    across = met.join(one, "a").join(two, "b").select("x", "y")
    within = one.join(members.where("n > 1").select(F.col("rep").alias("a"), F.col("doc").alias("y")), "a").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def shared_parts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_part, spans): what of each document stands elsewhere too.

    Documents of every length and null texts are listed; those that share nothing show 0.
    """
    members, entries = _entries(df, key, text)
    members, entries = written(members, "members"), written(entries, "entries")
    found = shared_spans(entries, True).select(F.col("a").alias("rep"), "lo", "hi").distinct()
    part = found.selectExpr("rep", "lo", "hi", "max(hi) OVER (PARTITION BY rep ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach")
    sums = part.groupBy("rep").agg(
        F.sum(F.greatest(F.col("hi") - F.greatest("lo", F.coalesce("reach", F.lit(0))), F.lit(0))).alias("shared"),
        F.sum((F.col("reach").isNull() | (F.col("reach") < F.col("lo"))).cast("int")).alias("spans"),
    )
    docs = df.select(F.col(key).alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars")).dropDuplicates(["doc_id"])
    out = docs.join(members.withColumnRenamed("doc", "doc_id"), "doc_id", "left").join(sums, "rep", "left")
    copied = F.col("n") > 1
    shared = F.when(copied, F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0))).cast("bigint")
    return out.select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(0.0).alias("shared_part"), F.when(copied, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("int").alias("spans"))
