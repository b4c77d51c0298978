"""New batches checked against all that was accepted before, without working through it again.

Rows match by url, by content hash, by their squeezed body, or by the Jaccard similarity of their
runs of five words. A text is worked through once in its life: its keys and the numbers of its runs
are kept in the index's rows. Equal texts are one class; the classes' runs are ordered rarest first
by a count sketch of fixed size over all documents, and the beginning of that order - the only part
in which two similar sets must meet - is kept as an inverted index of postings, a table bucketed by
run. A batch's beginnings probe it; sizes and places bound the overlap, and the pairs that are left
are verified on their whole sets of runs. The accepted rows and their postings are appended. The
order is frozen when the index is made: any order is exact, later runs only make it less sharp.

Which rows are duplicates depends on the order of their ids, as a row counts only against accepted
ones. That is settled in rounds over groups of rows: a row is accepted once no smaller undecided or
accepted row matches it, and is a duplicate once an accepted one does.

Defined results
  * null and blank urls, null, blank and empty-text hashes, and null and blank bodies match nothing;
  * texts of fewer than five words match by their squeezed body only;
  * history rows are never duplicates; of rows with one id in a batch one is looked at, those without id are not;
  * rows without a batch number form the first batch; a row only ever repeats one of smaller id;
  * empty history and empty batches are fine; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, forget, remove_folder, scratch_folder, written

WORDS, SIMILARITY = 5, 0.6
#: Counters of the sketch that orders the runs; its size does not depend on the data.
COUNTERS, BLOCK = 1 << 20, 1 << 14
#: Rows of the first history to a bucket of postings.
BUCKET_ROWS = 50_000
# Fixed value: SHA-256 of the empty text.
EMPTY_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

_word = re.compile(r"[^\W_]+").findall
_known: dict[str, int] = {}


def _runs(texts: list[list[str]]) -> list[np.ndarray]:
    """The distinct runs of five words of each text, given as its words, as sorted 64-bit numbers."""
    import xxhash

    if len(_known) > 500_000:
        _known.clear()
    out = []
    for ws in texts:
        if len(ws) < WORDS:
            out.append(np.zeros(0, np.uint64))
            continue
        for w in set(ws):
            if w not in _known:
                _known[w] = xxhash.xxh3_64_intdigest(w)
        a = np.fromiter(map(_known.__getitem__, ws), dtype=np.uint64, count=len(ws))
        h = np.zeros(len(a) - WORDS + 1, np.uint64)
        for i in range(WORDS):
            h = h * np.uint64(0x9E3779B97F4A7C15) + a[i : len(a) - WORDS + 1 + i]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(np.unique(h ^ (h >> np.uint64(29))))
    return out


def url_key(url: Column) -> Column:
    """A url without outer blanks, fragment, one closing slash, empty and utm parameters; scheme and host in lower case."""
    u = F.regexp_replace(F.trim(F.regexp_replace(url, r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")), "#.*$", "")
    head = F.regexp_extract(u, r"^([^?]*)", 1)
    origin = F.regexp_extract(head, r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*)", 1)
    path = F.regexp_replace(F.substr(head, F.length(origin) + 1), "/$", "")
    params = F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: p.rlike("^[^=]+=.") & ~p.rlike("(?i)^utm_"))
    key = F.concat(F.lower(origin), path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))
    return F.when(F.length(key) > 0, key)


def _wide(x: Column, name: str) -> list[Column]:
    """128 bits that stand for a text, null for a null one."""
    return [F.when(x.isNotNull(), F.xxhash64(x, F.lit(1))).alias(f"{name}_a"), F.when(x.isNotNull(), F.xxhash64(F.lit(2), F.reverse(x))).alias(f"{name}_b")]


_KEYS = ("url_a", "url_b", "hash_a", "hash_b", "text_a", "text_b")
#: Bits of the signature that bounds an overlap: those of all runs' hashes.
SIGNATURE_BITS = 512
_SIGNS = tuple(f"s{i}" for i in range(SIGNATURE_BITS // 64))
_ROW = "id bigint, " + ", ".join(f"{k} bigint" for k in (*_KEYS, *_SIGNS, "n")) + ", runs binary"


def rows_of(df: DataFrame, key: str = "id", url: str = "url", digest: str = "content_hash", body: str = "body_text", sketch: bool = False) -> DataFrame:
    """(id, keys, signature, runs): what is ever needed of each row; one narrow stage.

    The text's key stands for its words if it has at least WORDS, else for its squeezed body. With
    sketch, each partition adds its counts of runs, as rows without id: block number and counts.
    """
    told = F.lower(F.trim(digest))
    some = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), url_key(F.col(url)).alias("u"), F.when((told != "") & (told != EMPTY_HASH), told).alias("h"), F.col(body).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        counts = np.zeros(COUNTERS, np.int64)
        names = ["id", *_KEYS, *_SIGNS, "n", "runs"]
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                words, same = [], []
                for t in part.column(5).to_pylist():
                    ws = _word(t.lower()) if t else []
                    words.append(ws)
                    plain = ("w" + " ".join(ws)) if len(ws) >= WORDS else "b" + " ".join(t.split()) if t else "b"
                    same.append(xxhash.xxh3_128_digest(plain) if plain != "b" else b"\0" * 16)
                runs = _runs(words)
                all_ = np.concatenate(runs)
                signs = np.zeros((len(runs), SIGNATURE_BITS), np.uint8)
                signs[np.repeat(np.arange(len(runs)), [len(r) for r in runs]), (all_ >> np.uint64(40)).astype(np.int64) % SIGNATURE_BITS] = 1
                signs = np.packbits(signs, axis=1).view(np.int64)
                if sketch and len(all_):
                    counts += np.bincount((all_ & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                wide = np.frombuffer(b"".join(same), np.int64).reshape(-1, 2)
                none = ~wide.any(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:5], *[pa.array(wide[:, j], mask=none) for j in range(2)], *[pa.array(signs[:, j]) for j in range(len(_SIGNS))], pa.array([len(r) for r in runs], pa.int64()), pa.array([r.tobytes() for r in runs], pa.binary())], names
                )
        if counts.any():
            blocks = [np.minimum(counts[i : i + BLOCK], 2**31 - 1).astype(np.int32).tobytes() for i in range(0, COUNTERS, BLOCK)]
            n = len(blocks)
            nothing = [pa.nulls(n, pa.int64())] * (len(names) - 3)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(range(n), pa.int64()), *nothing, pa.array(blocks, pa.binary())], names)

    return some.select("id", *_wide(F.col("u"), "url"), *_wide(F.col("h"), "hash"), "text").mapInArrow(make, _ROW)


def sketch_of(rows: DataFrame) -> np.ndarray:
    """The sum of the partitions' counts: COUNTERS numbers in all."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(counts, np.int32).astype(np.int64)
                sums[block] = sums[block] + x if block in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    parts = rows.where("id is null").select(F.col("url_a").cast("int").alias("block"), F.col("runs").alias("counts"))
    out = np.zeros(COUNTERS, np.int32)
    for r in parts.repartition("block").mapInArrow(add, "block int, counts binary").collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.int32)
    return out


def representatives(rows: DataFrame) -> DataFrame:
    """(cls, runs): one row per class of equal texts that has runs, and cls its smallest id.

    The ids of the other rows are taken away: they are few unless most texts are copies, and then the
    anti-join shuffles.
    """
    keys = rows.where("text_a is not null").select("id", "text_a", "text_b")
    reps = keys.groupBy("text_a", "text_b").agg(F.min("id").alias("rep"))
    rest = keys.join(reps, ["text_a", "text_b"]).where("rep <> id").select(F.col("id").alias("cls"))
    return rows.where("n > 0").select(F.col("id").alias("cls"), "runs").join(broadcast_if_small(written(rest, "repeats")), "cls", "left_anti")


_POSTING = "run bigint, cls bigint, size int, pos int"


def postings(classes: DataFrame, order, similarity: float = SIMILARITY) -> DataFrame:
    """(run, cls, size, pos): the rarest runs of every class, as many as a similar set must share one of."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                raw = part.column(1).to_pylist()
                n = np.array([len(x) // 8 for x in raw])
                # All texts at once: their runs in order of the sketch, and the places in that order.
                flat, at = np.frombuffer(b"".join(raw), np.uint64), np.repeat(np.arange(len(n)), n)
                seen = counts[(flat & np.uint64(COUNTERS - 1)).astype(np.int64)]
                by = np.lexsort((flat, seen, at))
                pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                keep = np.flatnonzero(pos < (n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1)[at])
                own = at[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[by][keep].view(np.int64)), part.column(0).take(pa.array(own)), pa.array(n[own].astype(np.int32)), pa.array(pos[keep].astype(np.int32))],
                    ["run", "cls", "size", "pos"],
                )

    return classes.select("cls", "runs").mapInArrow(make, _POSTING)


def candidates(probe: DataFrame, index: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(cls, other): pairs whose sizes and places of shared runs leave room for the similarity.

    A probe of a checked size is broadcast, so that the index is not moved at all; a larger one goes
    to the buckets of the index. A run that many classes share stands at the end of their order and
    is seldom kept, and where it is, the join's skewed partitions are split at run time.
    """
    p = probe.select("run", "cls", F.col("size").alias("n"), F.col("pos").alias("i"))
    q = index.select("run", F.col("cls").alias("other"), F.col("size").alias("m"), F.col("pos").alias("j"))
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("m")) - 1e-6)
    near = (F.col("m") >= similarity * F.col("n") - 1e-6) & (F.col("n") >= similarity * F.col("m") - 1e-6)
    # At the first shared run, what stands before it on either side is lost, and so is what one side has left over.
    room = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= need
    return q.join(broadcast_if_small(p), "run").where((F.col("cls") != F.col("other")) & near & room).select("cls", "other").distinct()


def _sides(pairs: DataFrame, left: DataFrame, right: DataFrame, columns: list[Column]) -> DataFrame:
    """pairs (cls, other) with columns of both sides, a_ and b_; pairs of a checked size are broadcast to the tables."""
    named = lambda df, p, to: df.select(F.col("id").alias(to), *[c.alias(f"{p}_{n}") for n, c in columns])
    one = written(named(left, "a", "cls").join(broadcast_if_small(pairs), "cls"), "pairs")
    return named(right, "b", "other").join(broadcast_if_small(one), "other")


def bounded(pairs: DataFrame, left: DataFrame, right: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose signatures leave room for the similarity: a bit of one side alone is a run the other lacks."""
    both = _sides(pairs, left, right, [("n", F.col("n")), *[(c, F.col(c)) for c in _SIGNS]])
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("a_n") + F.col("b_n")) - 1e-6)
    only = lambda x, y: sum((F.bit_count(F.col(f"{x}_{c}").bitwiseAND(F.bitwise_not(F.col(f"{y}_{c}")))) for c in _SIGNS), F.lit(0))
    return both.where((F.col("a_n") - only("a", "b") >= need) & (F.col("b_n") - only("b", "a") >= need)).select("cls", "other")


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(cls, other) of the pairs whose whole sets of runs are similar enough; left and right are rows."""
    both = _sides(pairs, left, right, [("runs", F.col("runs"))]).select("cls", "other", "a_runs", "b_runs")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                u = np.sort(np.frombuffer(x + y, np.uint64))
                same = int((u[1:] == u[:-1]).sum())
                keep.append(same > 0 and same >= similarity * (len(u) - same) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["cls", "other"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(test, "cls bigint, other bigint")


class Index:
    """What was accepted so far, in a folder of its own: rows, postings bucketed by run, and their order.

    ``create`` makes it from a first history, ``open`` takes up one that was made before, ``check``
    probes it with a batch, and ``append`` adds a batch's accepted rows.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int) -> None:
        self.spark, self.folder, self.name = spark, folder, f"presswork_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({_POSTING}) USING parquet OPTIONS ('parquet.enable.dictionary#run' 'false') CLUSTERED BY (run) INTO {buckets} BUCKETS LOCATION '{os.path.join(folder, 'postings')}'")
        self.buckets = buckets

    @classmethod
    def create(cls, df: DataFrame, folder: str) -> Index:
        spark = df.sparkSession
        rows_of(df, sketch=True).write.parquet(os.path.join(folder, "rows"))
        held = spark.read.schema(_ROW).parquet(os.path.join(folder, "rows"))
        counts = sketch_of(held)
        buckets = int(max(8, held.where("id is not null").count() // BUCKET_ROWS))
        spark.createDataFrame([(buckets, counts.tobytes())], "buckets int, counts binary").write.parquet(os.path.join(folder, "order"))
        out = cls(spark, folder, buckets)
        out._order(counts)
        out._post(representatives(out.rows))
        return out

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        kept = spark.read.parquet(os.path.join(folder, "order")).first()  # one row of COUNTERS numbers
        out = cls(spark, folder, kept["buckets"])
        out._order(np.frombuffer(kept["counts"], np.int32))
        return out

    def _order(self, counts: np.ndarray) -> None:
        self.order = self.spark.sparkContext.broadcast(counts)

    def _post(self, classes: DataFrame) -> None:
        # One file a bucket: the rows are dealt as the buckets are.
        postings(classes, self.order).repartition(self.buckets, "run").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(_ROW).parquet(os.path.join(self.folder, "rows")).where("id is not null")

    @property
    def postings(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, accepted: DataFrame) -> None:
        """Add rows that :meth:`check` has accepted: only their own postings are made."""
        accepted = accepted.select("id", *_KEYS, *_SIGNS, "n", "runs")
        classes = representatives(accepted)
        self._post(classes)
        accepted.write.mode("append").parquet(os.path.join(self.folder, "rows"))

    def close(self, remove: bool = False) -> None:
        """Drop the catalogue's entry; with remove, the tables too."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if remove:
            remove_folder(self.spark, self.folder)

    def check(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(duplicates, accepted): (kept_id, dup_id) as a written table, and the rows of the batch that are none."""
        mine = written(rows_of(batch), "batch")
        if mine.select("id").distinct().count() < mine.count():  # repeated ids: one row each
            mine = written(mine.groupBy("id").agg(F.min(F.struct(*_KEYS, *_SIGNS, "n", "runs")).alias("r")).select("id", "r.*"), "batch")
        classes = written(representatives(mine), "batch-classes")
        probe = written(postings(classes, self.order), "probe")
        old = written(candidates(probe, self.postings), "candidates")
        new = written(candidates(probe, probe).where("cls < other"), "candidates")
        near_old = written(verified(written(bounded(old, mine, self.rows), "pairs"), mine, self.rows), "near")
        near_new = written(verified(written(bounded(new, mine, mine), "pairs"), mine, mine), "near")

        # Each kind of key, and each class of texts, is a group of rows that all match.
        def groups(rows: DataFrame) -> DataFrame:
            kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(f"{c}_a").alias("a"), F.col(f"{c}_b").alias("b")) for i, c in enumerate(("url", "hash", "text"))])).alias("g")
            return rows.select("id", kinds).where("g.a is not null").select("id", "g.*")

        gid = ["kind", "a", "b"]
        own = written(groups(mine), "groups")
        asked = broadcast_if_small(own.select(gid).distinct())
        first = groups(self.rows).join(asked, gid, "left_semi").groupBy(gid).agg(F.min("id").alias("first"))
        by_key = own.join(first, gid).select("id", "first")
        rep = own.where("kind = 2").groupBy(gid).agg(F.min("id").alias("cls"))
        of_class = written(own.where("kind = 2").join(rep, gid).select("id", "cls", *gid), "of-class")
        # Several appends may hold classes of one text: each stands for its own ids, the smallest counts.
        by_text = near_old.join(of_class, "cls").select("id", F.col("other").alias("first"))
        against = written(by_key.unionByName(by_text).groupBy("id").agg(F.min("first").alias("kept_id")).where("kept_id < id"), "against")

        free = mine.select("id").join(against, "id", "left_anti")
        both = near_new.unionByName(near_new.select(F.col("other").alias("cls"), F.col("cls").alias("other")))
        gid_of = of_class.select("cls", *gid).distinct()
        looks = of_class.join(both, "cls").select("id", F.col("other").alias("cls")).join(gid_of, "cls").select("id", *gid)
        members = written(own.join(free, "id"), "members")
        looks = written(members.unionByName(looks.join(free, "id")), "looks")
        # Only rows that look at a group with a smaller id wait; all others are accepted at once.
        head = members.groupBy(gid).agg(F.min("id").alias("head"))
        waiting = looks.join(head, gid).where("head < id").select("id").distinct()
        state = written(free.join(waiting.withColumn("waits", F.lit(1)), "id", "left").select("id", F.when(F.col("waits").isNull(), 1).otherwise(0).alias("state")), "state")
        while not state.where("state = 0").isEmpty():  # 0 undecided, 1 accepted, 2 duplicate
            g = members.join(state, "id").groupBy(gid).agg(F.min(F.when(F.col("state") == 1, F.col("id"))).alias("acc"), F.min(F.when(F.col("state") == 0, F.col("id"))).alias("und"))
            open_ = looks.join(state.where("state = 0").select("id"), "id")
            seen = open_.join(g, gid).groupBy("id").agg(F.min(F.when(F.col("acc") < F.col("id"), F.col("acc"))).alias("acc"), F.min(F.when(F.col("und") < F.col("id"), F.col("und"))).alias("und"))
            fresh = F.when(F.col("state") != 0, F.col("state")).when(F.col("acc").isNotNull(), 2).when(F.col("und").isNull(), 1).otherwise(0)
            nxt = written(state.join(seen, "id", "left").select("id", fresh.alias("state")), "state")
            forget(state)
            state = nxt
        g = members.join(state.where("state = 1"), "id").groupBy(gid).agg(F.min("id").alias("acc"))
        within = looks.join(state.where("state = 2").select("id"), "id").join(g, gid).where(F.col("acc") < F.col("id")).groupBy("id").agg(F.min("acc").alias("kept_id"))
        found = written(against.unionByName(within.select("id", "kept_id")).select("kept_id", F.col("id").alias("dup_id")), "found")
        accepted = written(mine.join(found.select(F.col("dup_id").alias("id")), "id", "left_anti"), "accepted")
        forget(mine, classes, probe, old, new, near_old, near_new, own, of_class, against, members, looks, state)
        return found, accepted


def repeats(history: DataFrame, incoming: DataFrame, batch: str = "batch_no") -> DataFrame:
    """(kept_id, dup_id) of the batches, one after the other, against the history and what was accepted before.

    The index of the history is made once; each batch probes it and adds its accepted rows.
    """
    spark = history.sparkSession
    index = Index.create(history, os.path.join(scratch_folder(spark), f"index-{uuid.uuid4().hex}"))
    out = spark.createDataFrame([], "kept_id bigint, dup_id bigint")
    for (number,) in incoming.select(batch).distinct().orderBy(F.col(batch).asc_nulls_first()).collect():  # one row a batch
        found, accepted = index.check(incoming.where(F.col(batch).eqNullSafe(number)))
        index.append(accepted)
        forget(accepted)
        out = out.unionByName(found)
    index.close(remove=True)
    return out
