"""Encoding of whole texts with a public byte-level BPE vocabulary.

Each partition keeps a DuckDB database in memory. Texts are cut into pieces by the vocabulary's
pattern; the pieces not met before in this worker become (word, position, token) rows, and a
recursive query joins neighbouring rows to the merge table and contracts the leftmost pair of
lowest rank of every word until none is left; an ordered aggregation gives the ids of a word.
The texts are then put together from their words' ids.

Defined results: null, and empty texts give an empty list; special tokens' strings in a text are
ordinary text; texts of any length are encoded whole; repeated rows each get their list; extra
columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public vocabularies (a parameter of every function here).
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.json"
#: Words whose ids a worker keeps; beyond it the table is dropped and filled anew.
KEPT_WORDS = 400_000

#: Texts encoded and handed on at once.
ROWS = 1024

# Fixed value: the public pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_MERGE = """
WITH RECURSIVE step(round, w, pos, tok) AS (
    SELECT 0, w, pos, tok FROM word_bytes
  UNION ALL
    SELECT round + 1, w, pos, tok FROM (
        WITH neighbour AS (
            SELECT round, w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM step
        ), best AS (
            SELECT n.w, min(m.rank::BIGINT * 1048576 + n.pos) AS pick
            FROM neighbour n JOIN merges m ON n.tok = m.l AND n.nxt = m.r GROUP BY n.w
        ), marked AS (
            SELECT n.round, n.w, n.pos, n.tok, n.nxt, b.pick % 1048576 AS at,
                   lag(n.pos) OVER (PARTITION BY n.w ORDER BY n.pos) AS prev
            FROM neighbour n JOIN best b ON n.w = b.w
        )
        SELECT k.round, k.w, k.pos, coalesce(m.merged, k.tok) AS tok
        FROM marked k LEFT JOIN merges m ON k.pos = k.at AND m.l = k.tok AND m.r = k.nxt
        WHERE k.prev IS NULL OR k.prev <> k.at
    )
)
SELECT w, list(tok ORDER BY pos) AS ids
FROM (SELECT *, max(round) OVER (PARTITION BY w) AS last FROM step)
WHERE round = last GROUP BY w ORDER BY w
"""


def _ship(df: DataFrame, folder: str, name: str) -> None:
    """Send the vocabulary's file to the executors, which need not have the folder."""
    df.sparkSession.sparkContext.addFile(f"{folder}/{name}")


def _found(folder: str, name: str) -> str:
    path = SparkFiles.get(name)
    return path if os.path.isfile(path) else f"{folder}/{name}"


@lru_cache(maxsize=2)
def _merge_table(folder: str, name: str) -> tuple[pa.Table, np.ndarray]:
    """(l, r, rank, merged) of the vocabulary, and the id of every byte."""
    with open(_found(folder, name), encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    rows = np.array([(vocab[a], vocab[b], i, vocab[a + b]) for i, (a, b) in enumerate(pairs)], dtype=np.int32)
    # The vocabulary writes a byte as itself where it is printable Latin-1, else as the next sign from U+0100.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_ids, extra = np.zeros(256, dtype=np.int32), 0
    for b in range(256):
        sign = chr(b) if b in printable else chr(256 + extra)
        extra += b not in printable
        byte_ids[b] = vocab[sign]
    return pa.table(dict(zip(("l", "r", "rank", "merged"), rows.T, strict=True))), byte_ids


class Encoder:
    """Encodes batches of texts in one worker; words already met are not merged again."""

    #: Words merged by one run of the recursive query, to bound its memory.
    BLOCK = 8_000
    #: Signs of a word above which it is merged alone.
    LONG = 4_000

    def __init__(self, folder: str = TOKENIZERS, name: str = BYTE_BPE_50K) -> None:
        import duckdb
        import regex

        self.source = (folder, name)
        merges, self.byte_ids = _merge_table(folder, name)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        self.db.register("given", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.unregister("given")
        self.pieces = regex.compile(PATTERN).findall
        self.words: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {"": b""}  # stretches at the head of a text
        self.rest: dict[str, bytes] = {}  # stretches after a single blank, which belongs to them

    def _merge(self, words: list[str]) -> None:
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        flat = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        at = np.repeat(np.arange(len(raw)), sizes)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.db.register("word_bytes", pa.table({"w": at, "pos": pos, "tok": flat}))
        ids = self.db.sql(_MERGE).to_arrow_table().column("ids").combine_chunks()
        self.db.unregister("word_bytes")
        values, ends = np.asarray(ids.values, dtype=np.int32), np.asarray(ids.offsets)
        for i, w in enumerate(words):
            self.words[w] = values[ends[i] : ends[i + 1]].tobytes()

    def learn(self, words: set[str]) -> None:
        new = sorted(words - self.words.keys())
        if len(self.words) + len(new) > KEPT_WORDS:
            self.words.clear()
            new = sorted(words)
        block: list[str] = []
        for w in new:
            if len(w) > self.LONG:
                self._merge_long(w)
            else:
                block.append(w)
        for i in range(0, len(block), self.BLOCK):
            self._merge(block[i : i + self.BLOCK])

    def _merge_long(self, word: str) -> None:
        """One very long piece: the same contraction with a heap, as a round a merge would be quadratic."""
        import heapq

        table = _merge_dict(*self.source)
        toks = self.byte_ids[np.frombuffer(word.encode("utf-8"), dtype=np.uint8)].tolist()
        after, before = list(range(1, len(toks) + 1)), list(range(-1, len(toks) - 1))
        heap = [(m[0], i, a, b, m[1]) for i, (a, b) in enumerate(zip(toks, toks[1:])) if (m := table.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if toks[i] != a or j >= len(toks) or toks[j] != b:
                continue
            toks[i], toks[j] = merged, -1
            after[i] = after[j]
            if after[i] < len(toks):
                before[after[i]] = i
                if m := table.get((merged, toks[after[i]])):
                    heapq.heappush(heap, (m[0], i, merged, toks[after[i]], m[1]))
            if before[i] >= 0 and (m := table.get((toks[before[i]], merged))):
                heapq.heappush(heap, (m[0], before[i], toks[before[i]], merged, m[1]))
        self.words[word] = np.array([t for t in toks if t >= 0], dtype=np.int32).tobytes()

    def _met(self, cuts: list[list[str]]) -> dict[str, bytes]:
        """Ids of all stretches in cuts; the short ones that begin and end plainly are kept."""
        new = {c for cut in cuts for c in cut}
        pieces = {c: self.pieces(c) for c in new}
        self.learn({w for ws in pieces.values() for w in ws})
        if len(self.first) + len(self.rest) > KEPT_WORDS:
            self.first, self.rest = {"": b""}, {}
        ids = {c: b"".join([self.words[w] for w in ws]) for c, ws in pieces.items()}
        for c, x in ids.items():
            if len(c) <= 64:
                if c[:1] != " ":
                    if c == c.rstrip():
                        self.first[c] = x
                elif len(c) > 1 and c[1:] == c.strip():
                    self.rest[c[1:]] = x
        return ids

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, end of each text's ids).

        A text is cut at single blanks, across which the pattern never matches; known stretches are
        looked up, and texts with any other are cut anew and their words learnt in one go.
        """
        out: list[bytes] = []
        missed: list[int] = []
        first, get = self.first, self.rest.__getitem__
        for i, t in enumerate(texts):
            parts = t.split(" ") if t else [""]
            try:
                out.append(first[parts[0]] + b"".join(map(get, parts[1:])))
            except KeyError:
                out.append(b"")
                missed.append(i)
        if missed:
            cuts = [_BETWEEN(texts[i]) for i in missed]
            ids = self._met(cuts)
            for i, cut in zip(missed, cuts, strict=True):
                out[i] = b"".join([ids[c] for c in cut])
        ends = np.cumsum(np.fromiter(map(len, out), dtype=np.int64, count=len(out)) // 4)
        return np.frombuffer(b"".join(out), dtype=np.int32), ends


#: A blank before a sign and after another: a border that no match crosses, whatever stands elsewhere.
_BETWEEN = re.compile(r"(?<=\S)(?= \S)").split


@lru_cache(maxsize=2)
def _merge_dict(folder: str, name: str) -> dict[tuple[int, int], tuple[int, int]]:
    t = _merge_table(folder, name)[0]
    return {(a, b): (r, m) for a, b, r, m in zip(*[c.to_pylist() for c in t.columns], strict=True)}


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(folder: str, name: str) -> Encoder:
    """The encoder of this worker process."""
    if (folder, name) not in _encoders:
        _encoders[folder, name] = Encoder(folder, name)
    return _encoders[folder, name]


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids array<int>) of every row of df. One narrow stage, no shuffle."""
    schema = df.select(key).schema.add("ids", T.ArrayType(T.IntegerType()))
    _ship(df, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, name)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                ids, ends = e.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, "ids"])

    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = BYTE_BPE_50K) -> DataFrame:
    """(key, n_tokens bigint): as encode_documents, without handing the ids on."""
    schema = df.select(key).schema.add("n_tokens", T.LongType())
    _ship(df, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, name)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                _, ends = e.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends, prepend=0), pa.int64())], [key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, schema)


_DECODE = """
SELECT t.doc, string_agg(v.hex, '' ORDER BY t.pos) AS hex FROM tokens t JOIN vocabulary v USING (id) GROUP BY t.doc
"""


@lru_cache(maxsize=2)
def _decoder(folder: str, name: str):
    """A DuckDB database with the bytes of every id, in hexadecimal."""
    import duckdb

    merges, byte_ids = _merge_table(folder, name)
    of = {int(i): bytes([b]) for b, i in enumerate(byte_ids)}
    for a, b, m in zip(*[merges.column(c).to_pylist() for c in ("l", "r", "merged")], strict=True):
        of[m] = of[a] + of[b]  # merges come in order of rank: their parts are known
    db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
    db.register("given", pa.table({"id": pa.array(of.keys(), pa.int32()), "hex": [x.hex() for x in of.values()]}))
    db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
    return db


def decode_documents(df: DataFrame, key: str = "doc_id", ids: str = "ids", folder: str = TOKENIZERS, name: str = BYTE_BPE_50K) -> DataFrame:
    """(key, text) from (key, ids): an ordered aggregation of the ids' bytes. Null and empty lists give an empty text."""
    schema = df.select(key).schema.add("text", T.StringType())
    _ship(df, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _decoder(folder, name)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                lists = part.column(1).fill_null([]) if part.column(1).null_count else part.column(1)
                sizes = np.array([len(x) for x in lists])
                doc = np.repeat(np.arange(len(sizes)), sizes)
                pos = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                db.register("tokens", pa.table({"doc": doc, "pos": pos, "id": lists.flatten()}))
                texts = [""] * len(sizes)
                for d, h in db.sql(_DECODE).fetchall():
                    texts[d] = bytes.fromhex(h).decode("utf-8", "replace")
                db.unregister("tokens")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, schema)


def token_totals(df: DataFrame, source: str = "source", **where: str) -> DataFrame:
    """(source, n_docs, n_tokens) over all documents; the partial sums are made before the shuffle."""
    counted = count_tokens(df.select(source, "text"), source, "text", **where)
    return counted.groupBy(source).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
