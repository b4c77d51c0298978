import random

import pytest
from tokenizers import Tokenizer

from presswork.llm import tokens as tk


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(f"{tk.TOKENIZERS}/{tk.BYTE_BPE_50K}")
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_agrees_with_the_library_on_anything(library):
    rnd = random.Random(4)
    signs = ["a", "b", " ", "  ", "\n", "\t", "é", "я", "Ω", "1", "²", "'s", "'ll", "!", "中", "🙂", " ", "́", "<|endoftext|>", "the", "\r\n", "​", "½", "　", "\x85", "\x1c"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    texts += [None, "", " ", "  ", " a", "a ", "a  b", "word " * 3000, "a" * 9000, "ab" * 5000 + " x", "я" * 4001]
    e = tk.Encoder()
    flat, ends = e.encode(texts)
    starts = [0, *ends[:-1]]
    assert [flat[a:b].tolist() for a, b in zip(starts, ends)] == library(texts)


def test_rows_nulls_repeats_and_extra_columns(spark, library):
    rows = [(1, "Hello, world", "x"), (1, "Hello, world", "x"), (2, None, "y"), (3, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in tk.encode_documents(df).collect())
    hello = library(["Hello, world"])[0]
    assert got == [(1, hello), (1, hello), (2, []), (3, [])]
    assert sorted(r["n_tokens"] for r in tk.count_tokens(df).collect()) == [0, 0, len(hello), len(hello)]
    assert tk.encode_documents(df.limit(0)).count() == 0


def test_what_a_worker_keeps_is_bounded(library, monkeypatch):
    monkeypatch.setattr(tk, "KEPT_WORDS", 50)
    e = tk.Encoder()
    for i in range(20):
        texts = [f"word{i}x{j} and more{j}" for j in range(10)]
        flat, ends = e.encode(texts)
        assert flat.tolist() == [x for t in library(texts) for x in t]
    assert len(e.words) < 200
