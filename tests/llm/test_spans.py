import itertools
import random

import numpy as np

from presswork.llm import spans


def brute_pairs(docs):
    at = {}
    for i, t in docs:
        for p in range(len(t or "") - 299):
            at.setdefault(t[p : p + 300], set()).add(i)
    return {p for v in at.values() for p in itertools.combinations(sorted(v), 2)}, {k for k, v in at.items() if len(v) > 1}


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcde fgh ijя") for _ in range(n))
    quotes = [text(n) for n in (299, 300, 301, 450, 900)]
    docs = [text(rnd.randrange(400)) + rnd.choice(quotes) + text(rnd.randrange(400)) for _ in range(24)]
    docs += [docs[0], docs[0], "x" * 700, "x" * 640, "y" * 299, "", None, "ab" * 400, "ab" * 200 + "c"]
    return list(enumerate(docs))


def test_agrees_with_brute_force(spark):
    docs = corpus(5)
    df = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id bigint, text string, rep string")
    want, shared = brute_pairs(docs)
    got = [tuple(r) for r in spans.sharing_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    parts = {r["doc_id"]: r["shared_chars"] for r in spans.shared_parts(df).collect()}
    for i, t in docs:
        cover = np.zeros(len(t or "") + 1, int)
        for p in range(len(t or "") - 299):
            if t[p : p + 300] in shared:
                cover[p] += 1
                cover[p + 300] -= 1
        assert parts[i] == int((np.cumsum(cover)[: len(t or "")] > 0).sum()), i
    assert spans.sharing_pairs(df.limit(0)).count() == 0 and spans.shared_parts(df.limit(0)).count() == 0


def test_one_anchor_in_many_texts_is_met_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 4)
    rnd = random.Random(2)
    core = "".join(rnd.choice("abcdefgh") for _ in range(320))
    docs = [(i, f"{i:04}" * 30 + core + f"{i:04}" * 30) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert spans.sharing_pairs(df).count() == 30 * 29 // 2


def test_automaton_matches_plain_search():
    rnd = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rnd.choice("ab") for _ in range(60)) for _ in range(2))
        got = set()
        for lo, hi in spans.Automaton(a).spans(b, 5):
            got |= set(range(lo, hi))
        want = {q for p in range(len(b) - 4) if b[p : p + 5] in a for q in range(p, p + 5)}
        assert got == want


def test_equal_signs_leave_few_anchors():
    for text in ("-" * 10_000, "ab" * 5_000, "═" * 700 + "x" + "═" * 900):
        own, place, h = spans.anchors([text, text[:400]])
        mine = np.sort(place[own == 0])
        assert len(mine) <= 2 + len(text) // 60
        assert all(((mine >= p) & (mine + spans.GRAM <= p + spans.LEAST)).any() for p in range(len(text) - spans.LEAST + 1))


def test_cover_of_an_anchor_in_very_many_texts(spark):
    rnd = random.Random(3)
    core = "".join(rnd.choice("abcdefgh") for _ in range(400))
    docs = [(i, f"{i:05}" * 20 + core[: 350 + i % 50] + f"{i:05}" * 20) for i in range(3000)]
    got = {r["doc_id"]: (r["shared_chars"], r["spans"]) for r in spans.shared_parts(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    # Where the quote ends, the number's first signs may go on alike; the quote itself is always covered.
    assert all(350 + i % 50 <= got[i][0] <= 350 + i % 50 + 8 and got[i][1] == 1 for i, _ in docs)
