import hashlib
import random
import re

from pyspark.sql import functions as F

from presswork.llm import incremental as inc

SCHEMA = "id bigint, batch_no int, url string, content_hash string, body_text string, text_key string"
EMPTY = hashlib.sha256(b"").hexdigest()


def url(u):
    if u is None:
        return None
    u = re.sub(r"^[\s ]+|[\s ]+$", "", u).split("#")[0]
    head, _, q = u.partition("?")
    m = re.match(r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*)(.*)$", head, re.S)
    origin, path = (m.group(1).lower(), m.group(2)) if m else ("", head)
    ps = [x for x in q.split("&") if re.match("^[^=]+=.", x) and not x.lower().startswith("utm_")]
    return (origin + path.removesuffix("/") + ("?" + "&".join(ps) if ps else "")) or None


def features(r):
    i, _, u, h, b, _ = r
    words = re.findall(r"[^\W_]+", (b or "").lower())
    h = (h or "").strip().lower() or None
    return i, url(u), None if h == EMPTY else h, re.sub(r"\s+", " ", b or "").strip() or None, {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(history, incoming):
    held, out = [features(r) for r in history], set()
    for r in sorted(incoming):
        i, u, h, b, s = features(r)
        hits = [j for j, v, g, c, w in held if (u and u == v) or (h and h == g) or (b and b == c) or (s and w and len(s & w) >= 0.6 * len(s | w))]
        if hits:
            out.add((min(hits), i))
        else:
            held.append((i, u, h, b, s))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 5, 12, 40]))) for _ in range(6)]

    def row(i, batch):
        t = rnd.choice(texts).split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            t[rnd.randrange(len(t))] = rnd.choice(vocab)
        b = rnd.choice([" ", "  ", "\n"]).join(t)
        u = rnd.choice([None, "", f"https://A.example/p{rnd.randrange(30)}/", f"https://a.example/p{rnd.randrange(30)}?utm_x=1#f", f" https://a.example/q{i}?a="])
        return i, batch, u, rnd.choice([None, EMPTY, "", f"H{rnd.randrange(25)}", f"h{rnd.randrange(25)}"]), rnd.choice([b, b, b.upper(), None, "  "]), "clash"

    return [row(i, 0) for i in range(1, 26)], [row(i, 1 + (i - 100) // 10) for i in range(100, 130)]


def frames(spark, data):
    return [spark.createDataFrame(x, SCHEMA) for x in data]


def test_batches_agree_with_brute_force(spark):
    for seed in (1, 2):
        data = corpus(seed)
        history, incoming = frames(spark, data)
        assert {tuple(r) for r in inc.repeats(history, incoming).select("kept_id", "dup_id").collect()} == brute(*data)


def test_an_index_is_taken_up_again(spark, tmp_path):
    data = corpus(4)
    history, incoming = frames(spark, data)
    inc.Index.create(history, str(tmp_path / "index")).close()
    got = set()
    for n in (1, 2, 3):
        index = inc.Index.open(spark, str(tmp_path / "index"))
        found, accepted = index.check(incoming.where(F.col("batch_no") == n))
        got |= {tuple(r) for r in found.collect()}
        index.append(accepted)
        index.close()
    assert got == brute(*data)


def test_odd_rows(spark):
    rows = [(1, 1, "u", None, "a b c d e f", None), (1, 1, "u", None, "a b c d e f", None), (None, 1, "u", "h", "x", None), (2, None, "u", None, None, None), (3, 2, None, None, "A  b c d e f", None)]
    batch = spark.createDataFrame(rows, SCHEMA)
    # The row without a batch number comes first, but a row only repeats one of smaller id.
    assert {tuple(r) for r in inc.repeats(batch.limit(0), batch).collect()} == {(1, 3)}


def test_a_hot_text_and_empty_tables(spark):
    hot = "the same long text stands in very many rows of this batch today"
    rows = [(100 + i, 1, None, None, hot, None) for i in range(200)]
    batch = spark.createDataFrame(rows, SCHEMA)
    empty = batch.limit(0)
    got = inc.repeats(empty, batch)
    assert got.count() == 199 and got.select("kept_id").distinct().collect()[0][0] == 100
    assert inc.repeats(batch, empty).count() == 0 and inc.repeats(empty, empty).count() == 0


def test_url_key(spark):
    cases = [" HTTPS://A.example/P/?utm_a=1&b=&c=2#x ", "https://a.example", "", None, "/relative/", "https://a.example/?UTM_x=1"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "u string").select(inc.url_key(F.col("u"))).collect()]
    assert got == [url(c) for c in cases]
