"""The most similar vectors of every vector, by an inverted file with product-quantised residuals.

Vectors of one direction (equal or scaled) are one entry, so that copies never meet in pairs. The
entries of one model and length form a space. Its coarse centroids and the code books of the
residuals are fitted on a bounded sample, one task a space; where a space needs more lists than such
a task should fit, each of its cells is divided further by a task of its own. Every entry is put
into the list of its nearest centroid, as its code and vector, and is sent as a query to the lists
of its ``probes`` nearest centroids. Neighbouring lists share a shard, so that a query travels once
for several of them. In a shard, a table of products between query and code books gives the
approximate similarity of every list member (asymmetric distance); a member can be wanted only if
that, and the length of what its code leaves out, reach the least similarity. All such members are
ranked anew by the exact cosine.

Defined results
  * null vectors, empty ones, and those that hold null, NaN or infinity or are all zero, are left out;
  * repeated rows of a frame are one frame; of differing vectors under one id the smallest holds;
  * cosines are rounded to 9 digits, ties go to the smaller id;
  * only the choice of the lists is approximate: spaces of at most ``probes`` lists are searched whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, written

#: Neighbours wanted and least cosine.
K, LEAST = 5, 0.85
#: Lists for n entries: LISTS_PER_ROOT * sqrt(n); sampled entries per list; lists that one task fits.
LISTS_PER_ROOT, SAMPLE_PER_LIST, TASK_LISTS = 2.0, 32, 4_096
PROBES, ROUNDS = 16, 6
#: Dimensions of a sub-vector, its code words, and sampled residuals that the code books are fitted on at most.
SUB, WORDS, MOST_RESIDUALS = 8, 256, 32_768
#: Steps of a unit vector's number: vectors that agree in all steps have one direction. Cosines of such
#: differ by far less than the nine digits they are rounded to, and far more than floats err.
STEPS = 1e12
#: Entries wanted in a shard; larger shards are split into blocks that see all its queries.
SHARD_ROWS = 12_000
#: Bytes of quantisers that are broadcast at once; more spaces are worked through in several passes.
QUANTISER_BYTES = 64 << 20
#: What single-precision sums may be off by.
SLACK = 1e-4


def _nearest(x: np.ndarray, c: np.ndarray, block: int = 4096) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[i : i + block] @ c.T - half).argmax(1) for i in range(0, len(x), block)]) if len(x) else np.zeros(0, np.int64)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 11) -> np.ndarray:
    """Plain Lloyd rounds from sampled points; a centroid without members moves to a sampled point."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        order = np.argsort(at, kind="stable")
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        some = n > 0
        c[some] = np.add.reduceat(x[order], starts[some], axis=0) / n[some, None]
        if (~some).any():
            c[~some] = x[rng.integers(0, len(x), int((~some).sum()))]
    return c


class Space:
    """Centroids, shards of centroids and code books of one space."""

    def __init__(self, n: int, centroids: np.ndarray, share: np.ndarray, residuals: np.ndarray, shard_rows: int, grouped: bool = True) -> None:
        """share is each list's part of the entries, residuals a sample of what the centroids leave."""
        self.centroids = centroids
        shards = max(1, min(len(centroids), round(n / shard_rows)))
        own = np.arange(len(centroids)) if not grouped or shards == len(centroids) else _nearest(centroids, _kmeans(centroids, shards, ROUNDS))
        self.shard_of = own.astype(np.int32)
        # Blocks of a shard: so many that the sample's share of it says they hold shard_rows entries.
        self.blocks = np.maximum(1, np.ceil(np.bincount(own, share, minlength=shards) * n / shard_rows / 1.5)).astype(np.int32)
        rest = self._subs(residuals)
        self.books = np.stack([_kmeans(rest[:, m], min(WORDS, len(rest)), ROUNDS) for m in range(rest.shape[1])])

    @staticmethod
    def _subs(x: np.ndarray) -> np.ndarray:
        pad = -x.shape[1] % SUB
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, SUB)

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of what they leave out)."""
        rest = self._subs(x - self.centroids[at])
        codes = np.stack([_nearest(rest[:, m], self.books[m]) for m in range(rest.shape[1])], axis=1)
        left = rest - np.stack([self.books[m][codes[:, m]] for m in range(rest.shape[1])], axis=1)
        return codes.astype(np.uint8), np.sqrt((left * left).sum((1, 2))).astype(np.float32)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of every query's sub-vectors with every code word: (queries, subs, words)."""
        return np.einsum("qmd,mwd->qmw", self._subs(q), self.books, optimize=True)


def _direction(v: Column) -> Column:
    """The unit vector in whole steps: equal for vectors that are multiples of each other.

    Largest number and length are accumulators, so that they are taken once a vector; numbers are
    divided by the largest first, as squares may leave the range.
    """
    steps = lambda m, s: F.transform(v, lambda x: F.rint(x / m / F.sqrt(s) * STEPS).cast("bigint"))
    squares = lambda m: F.aggregate(v, F.lit(0.0), lambda s, x: s + (x / m) * (x / m), lambda s: steps(m, s))
    return F.aggregate(v, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)), squares)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def entries(df: DataFrame, key: str = "frame_id", vector: str = "vector", model: str = "model_name") -> tuple[DataFrame, DataFrame]:
    """(frames, classes): (space, frame, vid) of every valid frame; (space, vid, vector, members).

    vid is the smallest frame of the vectors of one direction; members are the K + 1 smallest, which
    are all that can ever be chosen as neighbours. Only 128-bit stand-ins of the directions are grouped.
    """
    v = F.col(vector)
    sane = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = df.where(v.isNotNull() & sane & F.col(key).isNotNull()).select(F.xxhash64(model, F.size(v)).alias("space"), F.col(key).alias("frame"), v.alias("vector"))
    rows = rows.groupBy("space", "frame").agg(F.min("vector").alias("vector"))
    rows = rows.withColumn("way", _direction(F.col("vector")))
    rows = written(rows.withColumns({"h1": F.xxhash64("way", F.lit(1)), "h2": F.xxhash64(F.lit(2), F.reverse("way"))}).drop("way"), "vectors")
    small = rows.select("space", "frame", "h1", "h2")
    reps = small.groupBy("space", "h1", "h2").agg(F.min("frame").alias("vid"), F.count("*").alias("n"))
    frames = small.join(reps, ["space", "h1", "h2"]).select("space", "frame", "vid", "n")
    # The group limit runs before the shuffle, so that a hot vector sends K + 1 ids a partition.
    ranked = frames.where("n > 1").selectExpr("space", "vid", "frame", "row_number() OVER (PARTITION BY space, vid ORDER BY frame) AS r").where(F.col("r") <= K + 1)
    several = ranked.groupBy("space", "vid").agg(F.array_sort(F.collect_list("frame")).alias("members"))
    vectors = rows.join(reps.select("space", F.col("vid").alias("frame")), ["space", "frame"], "left_semi").select("space", F.col("frame").alias("vid"), "vector")
    return frames.select("space", "frame", "vid"), vectors.join(several, ["space", "vid"], "left")


def _sampled(classes: DataFrame, counts: DataFrame, most_lists: int | None) -> DataFrame:
    """Entries with their space's number of entries and lists: SAMPLE_PER_LIST a list, by a hash of the id."""
    lists = F.greatest(F.lit(1), F.floor(LISTS_PER_ROOT * F.sqrt("n")))
    known = counts.withColumn("lists", lists)
    if most_lists is None:
        known = known.where(F.col("lists") > TASK_LISTS)
    else:
        known = known.withColumn("lists", F.least("lists", F.lit(most_lists)))
    part = F.least(F.lit(1.0), F.col("lists") * SAMPLE_PER_LIST / F.col("n"))
    rows = classes.select("space", "vid", "vector").join(broadcast_if_small(known), "space")
    return rows.where(F.pmod(F.xxhash64("vid"), F.lit(1 << 30)) < part * (1 << 30)).select("space", "n", "lists", "vector")


def _matrix(vectors: pd.Series) -> np.ndarray:
    return _unit(np.array(vectors.tolist(), dtype=np.float64)).astype(np.float32)


def _thinned(x: np.ndarray, most: int) -> np.ndarray:
    return x if len(x) <= most else x[np.random.default_rng(5).permutation(len(x))[:most]]


def fit(classes: DataFrame, task_lists: int = TASK_LISTS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(space, size, space_fit): every space's quantiser as a written table.

    A task sees at most task_lists * SAMPLE_PER_LIST entries, whatever the table's size.
    """
    counts = written(classes.groupBy("space").agg(F.count("*").alias("n")), "spaces")

    def coarse(pdf: pd.DataFrame) -> pd.DataFrame:
        n, lists = int(pdf["n"].iloc[0]), int(pdf["lists"].iloc[0])
        x = _matrix(pdf["vector"])
        c = _kmeans(x, min(lists, len(x)), ROUNDS)
        at = _nearest(x, c)
        space = Space(n, c, np.bincount(at, minlength=len(c)) / len(x), _thinned(x - c[at], MOST_RESIDUALS), shard_rows)
        return _packed(pdf["space"].iloc[0], space)

    schema = "space bigint, size bigint, space_fit binary"
    first = written(_sampled(classes, counts, task_lists).groupBy("space").applyInPandas(coarse, schema), "quantisers")
    large = counts.where(F.floor(LISTS_PER_ROOT * F.sqrt("n")) > task_lists)
    if large.isEmpty():
        return first

    # Cells of large spaces are divided in proportion to their entries.
    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for space, rows in pdf.groupby("space"):
                yield rows.drop(columns="lists").assign(cell=_nearest(_matrix(rows["vector"]), top.value[space].centroids).astype(np.int64))

    def divide(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["vector"])
        c = _kmeans(x, max(1, min(task_lists, round(len(x) / SAMPLE_PER_LIST))), ROUNDS)
        at = _nearest(x, c)
        left = _thinned(x - c[at], max(1, MOST_RESIDUALS // task_lists))
        return pd.DataFrame([(pdf["space"].iloc[0], int(pdf["n"].iloc[0]), int(pdf["cell"].iloc[0]), pickle.dumps((c, np.bincount(at, minlength=len(c)), left)))], columns=["space", "n", "cell", "part"])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        c, m, left = (np.concatenate(x) for x in zip(*[pickle.loads(p) for p in pdf.sort_values("cell")["part"]], strict=True))
        return _packed(pdf["space"].iloc[0], Space(int(pdf["n"].iloc[0]), c, m / m.sum(), left, shard_rows, grouped=False))

    more = []
    for passed in _passes(first.join(broadcast_if_small(large.select("space")), "space", "left_semi")):
        top = classes.sparkSession.sparkContext.broadcast(passed)
        some = F.col("space").isin(list(passed))
        dealt = _sampled(classes.where(some), counts.where(some), 1 << 40).mapInPandas(cells, "space bigint, n bigint, vector array<double>, cell bigint")
        parts = dealt.groupBy("space", "cell").applyInPandas(divide, "space bigint, n bigint, cell bigint, part binary")
        more.append(written(parts.groupBy("space").applyInPandas(joined, schema), "quantisers"))
    out = first.join(broadcast_if_small(large.select("space")), "space", "left_anti")
    for m in more:
        out = out.unionByName(m)
    return written(out, "quantisers")


def _packed(space: int, fitted: Space) -> pd.DataFrame:
    told = pickle.dumps(fitted)
    return pd.DataFrame([(space, len(told), told)], columns=["space", "size", "space_fit"])


def _passes(fitted: DataFrame) -> Iterator[dict[int, Space]]:
    """The quantisers, some spaces at a time, so that no more than QUANTISER_BYTES are broadcast at once.

    Only a space whose own quantiser is larger, which grows with the root of its entries, goes beyond.
    """
    now: dict[int, Space] = {}
    held = 0
    for r in fitted.toLocalIterator():
        if now and held + r["size"] > QUANTISER_BYTES:
            yield now
            now, held = {}, 0
        now[r["space"]] = pickle.loads(r["space_fit"])
        held += r["size"]
    if now:
        yield now


_ROW = "space bigint, shard int, block int, kind tinyint, vid string, vec binary, aux binary"


def _sent(batches: Iterator[pd.DataFrame], spaces: dict[int, Space], probes: int) -> Iterator[pd.DataFrame]:
    """List entries (kind 0: list, what the code leaves out, code) and queries (kind 1: lists) with the shard they go to."""
    for pdf in batches:
        for lo in range(0, len(pdf), 2048):
            for space, rows in pdf.iloc[lo : lo + 2048].groupby("space"):
                x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
                raw, vids = [r.tobytes() for r in x], rows["vid"].tolist()
                s = spaces[space]
                u = _unit(x).astype(np.float32)
                sim = u @ s.centroids.T - (s.centroids * s.centroids).sum(1) / 2
                p = min(probes, sim.shape[1])
                near = np.argpartition(-sim, p - 1, axis=1)[:, :p] if p < sim.shape[1] else np.tile(np.arange(p), (len(u), 1))
                own = sim.argmax(1).astype(np.int32)
                codes, left = s.encode(u, own)
                home = s.shard_of[own]
                told = np.concatenate([own[:, None].view(np.uint8), left[:, None].view(np.uint8), codes], axis=1)
                # The block is taken from the vector's bytes, so that it does not depend on the batch.
                out = [(int(h), hash_bytes(r) % int(s.blocks[h]), 0, v, r, t.tobytes()) for h, r, v, t in zip(home, raw, vids, told, strict=True)]
                of = s.shard_of[near]
                for i, v in enumerate(vids):
                    for shard in np.unique(of[i]):
                        lists = near[i][of[i] == shard].astype(np.int32).tobytes()
                        out += [(int(shard), b, 1, v, raw[i], lists) for b in range(int(s.blocks[shard]))]
                yield _frame(space, out)


def hash_bytes(x: bytes) -> int:
    import zlib

    return zlib.crc32(x)


def _frame(space: int, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["shard", "block", "kind", "vid", "vec", "aux"])
    out.insert(0, "space", space)
    return out.astype({"shard": "int32", "block": "int32", "kind": "int8"})


class _Shard:
    """The lists of one shard block, and the search in them; without a space all entries are compared."""

    def __init__(self, space: Space | None, vids: list[str], vecs: list[bytes], aux: list[bytes]) -> None:
        self.space = space
        order = sorted(range(len(vids)), key=vids.__getitem__)  # places in order of the ids: ties by place
        self.vids = np.array([vids[i] for i in order], dtype=object)
        self.unit = _unit(np.stack([np.frombuffer(vecs[i], dtype=np.float64) for i in order]))
        if space is not None:
            told = np.frombuffer(b"".join([aux[i] for i in order]), dtype=np.uint8).reshape(len(order), -1)
            cells = np.ascontiguousarray(told[:, :4]).view(np.int32).ravel()
            self.left = np.ascontiguousarray(told[:, 4:8]).view(np.float32).ravel()
            self.codes = told[:, 8:]
            by = np.argsort(cells, kind="stable")
            cut = np.flatnonzero(np.diff(cells[by])) + 1
            self.lists = {int(cells[at[0]]): at for at in np.split(by, cut)}

    def _pairs(self, q: np.ndarray, aux: list[bytes], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, places) that may reach least."""
        if self.space is None:
            for lo in range(0, len(q), 64):
                n = len(q[lo : lo + 64])
                yield np.repeat(np.arange(lo, lo + n), len(self.unit)), np.tile(np.arange(len(self.unit)), n)
            return
        f = q.astype(np.float32)
        coarse, tables = f @ self.space.centroids.T, self.space.tables(f)
        wanted: dict[int, list[int]] = {}
        for i, a in enumerate(aux):
            for c in np.frombuffer(a, dtype=np.int32).tolist():
                if c in self.lists:
                    wanted.setdefault(c, []).append(i)
        for c, who in wanted.items():
            for lo in range(0, len(self.lists[c]), 2048):
                at = self.lists[c][lo : lo + 2048]
                code = self.codes[at]
                score = coarse[who, c][:, None] + self.left[at]
                for m in range(code.shape[1]):
                    score += tables[who, m][:, code[:, m]]
                i, j = np.nonzero(score >= least - SLACK)
                yield np.asarray(who)[i], at[j]

    def search(self, vids: list[str], vecs: list[bytes], aux: list[bytes], k: int, least: float) -> tuple[list[str], list[str], np.ndarray]:
        q = _unit(np.stack([np.frombuffer(v, dtype=np.float64) for v in vecs]))
        found: list[list[np.ndarray]] = [[], [], []]
        for i, j in self._pairs(q, aux, least):
            for lo in range(0, len(i), 65_536):
                a, b = i[lo : lo + 65_536], j[lo : lo + 65_536]
                sim = np.round(np.einsum("ij,ij->i", q[a], self.unit[b]), 9)
                keep = sim >= least
                for to, x in zip(found, (a[keep], b[keep], sim[keep]), strict=True):
                    to.append(x)
        i, j, sim = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        by = np.lexsort((j, -sim, i))
        i, j, sim = i[by], j[by], sim[by]
        # The k + 1 best of each query, as one of them may be the query itself.
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        best = rank <= k
        i, j, sim = i[best], j[best], sim[best]
        asked, other = np.array(vids, dtype=object)[i], self.vids[j]
        own = asked != other
        return asked[own].tolist(), other[own].tolist(), sim[own]


def _searched(batches: Iterator[pa.RecordBatch], spaces: dict[int, Space], k: int, least: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (space, shard, block, kind): a block's list, then its queries."""
    now, held, shard = None, ([], [], []), None
    for b in batches:
        pdf = b.to_pandas()
        keys = pdf[["space", "shard", "block"]].to_numpy()
        kinds = pdf["kind"].to_numpy()
        change = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1) | (kinds[1:] != kinds[:-1])]))
        for lo, hi in zip(change, [*change[1:], len(pdf)], strict=True):
            key, kind = tuple(int(x) for x in keys[lo]), kinds[lo]
            if key != now:
                now, held, shard = key, ([], [], []), None
            cols = [pdf[c].iloc[lo:hi].tolist() for c in ("vid", "vec", "aux")]
            if kind == 0:
                for h, c in zip(held, cols, strict=True):
                    h += c
                continue
            if shard is None and held[0]:
                shard = _Shard(spaces.get(key[0]), *held)
            if shard is None:
                continue
            for at in range(0, hi - lo, 1024):
                q, o, s = shard.search(*[c[at : at + 1024] for c in cols], k, least)
                if q:
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(q), pa.int64()), pa.array(q), pa.array(o), pa.array(s, pa.float64())], ["space", "vid", "other", "cosine"])


_FOUND = "space bigint, vid string, other string, cosine double"


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of what the shards found, at most k + 1 rows per query and shard."""
    best = found.groupBy("space", "vid").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("order"), "other"))), 1, k).alias("best"))
    return best.select("space", "vid", F.explode("best").alias("b")).select("space", "vid", "b.other", (-F.col("b.order")).alias("cosine"))


def neighbours(classes: DataFrame, k: int = K, least: float = LEAST, probes: int = PROBES, task_lists: int = TASK_LISTS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(space, vid, other, cosine): up to k most similar other entries of every entry."""
    spark = classes.sparkSession
    passes = list(_passes(fit(classes, task_lists, shard_rows)))
    out = spark.createDataFrame([], _FOUND)
    for spaces in passes:
        fitted = spark.sparkContext.broadcast(spaces)
        rows = classes if len(passes) == 1 else classes.where(F.col("space").isin(list(spaces)))
        sent = rows.select("space", "vid", "vector").mapInPandas(lambda it, f=fitted: _sent(it, f.value, probes), _ROW)
        placed = sent.repartition("space", "shard", "block").sortWithinPartitions("space", "shard", "block", "kind")
        out = out.unionByName(placed.mapInArrow(lambda it, f=fitted: _searched(it, f.value, k, least), _FOUND))
    return _best(out, k)


def frame_neighbours(df: DataFrame, k: int = K, least: float = LEAST, probes: int = PROBES, **how: int) -> DataFrame:
    """(frame, other, cosine, rank): the k most similar other frames of every frame."""
    frames, classes = entries(df)
    classes = written(classes, "classes")
    several = classes.where("members is not null").select("space", F.col("vid").alias("other"), "members")
    near = neighbours(classes, k, least, probes, **how).join(several, ["space", "other"], "left")
    ids = F.coalesce(F.col("members"), F.array("other"))
    listed = near.select("space", "vid", F.transform(ids, lambda x: F.struct((-F.col("cosine")).alias("order"), x.alias("other"))).alias("c"))
    own = several.select("space", F.col("other").alias("vid"), F.transform("members", lambda x: F.struct(F.lit(-1.0).alias("order"), x.alias("other"))).alias("c"))
    # k other entries and the own one, each with at most k + 1 ids.
    pool = listed.unionByName(own).groupBy("space", "vid").agg(F.array_sort(F.flatten(F.collect_list("c"))).alias("pool"))
    out = frames.join(pool, ["space", "vid"])
    chosen = F.slice(F.filter("pool", lambda x: x["other"] != F.col("frame")), 1, k)
    out = out.select("frame", F.posexplode(chosen).alias("i", "c"))
    return out.select("frame", "c.other", (-F.col("c.order")).alias("cosine"), (F.col("i") + 1).alias("rank"))


def similar_pairs(df: DataFrame, **how: float) -> DataFrame:
    """(frame_id_a, frame_id_b), a < b: one is among the most similar ones of the other."""
    n = frame_neighbours(df, **how)
    return n.select(F.least("frame", "other").alias("frame_id_a"), F.greatest("frame", "other").alias("frame_id_b")).distinct()


def brute_force(classes: DataFrame, asked: DataFrame, k: int = K, least: float = LEAST, blocks: int = 64) -> DataFrame:
    """(space, vid, other, cosine) of the asked entries against all, exactly: each block of the table meets all of them."""
    to = lambda df, block, kind: df.select("space", F.lit(0).cast("int").alias("shard"), block.alias("block"), F.lit(kind).cast("tinyint").alias("kind"), "vid", "vector")
    rows = to(classes, F.pmod(F.xxhash64("vid"), F.lit(blocks)).cast("int"), 0).unionByName(to(asked, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), 1))

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(vec=[np.asarray(v, dtype=np.float64).tobytes() for v in pdf["vector"]], aux=b"").drop(columns="vector")

    placed = rows.mapInPandas(pack, _ROW).repartition("space", "shard", "block").sortWithinPartitions("space", "shard", "block", "kind")
    return _best(placed.mapInArrow(lambda it: _searched(it, {}, k, least), _FOUND), k)


def recall(df: DataFrame, every: int = 100, k: int = K, least: float = LEAST, probes: int = PROBES) -> DataFrame:
    """(queries, true_neighbours, found_neighbours, recall): the index against brute force.

    The queries are the entries whose frame's first number is divisible by every.
    """
    _, classes = entries(df)
    classes = written(classes, "classes")
    asked = written(classes.where(F.regexp_extract("vid", r"(\d+)", 1).cast("bigint") % every == 0).select("space", "vid", "vector"), "asked")
    true = brute_force(classes, asked, k, least).withColumn("t", F.lit(1))
    found = neighbours(classes, k, least, probes).join(asked.select("space", "vid"), ["space", "vid"], "left_semi").withColumn("f", F.lit(1))
    both = true.join(found.select("space", "vid", "other", "f"), ["space", "vid", "other"], "left")
    share = F.coalesce(F.round(F.sum("f") / F.count("*"), 4), F.lit(1.0))
    return both.agg(F.countDistinct("space", "vid").alias("queries"), F.count("*").alias("true_neighbours"), F.coalesce(F.sum("f"), F.lit(0)).alias("found_neighbours"), share.alias("recall"))
