import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.llm import fusion, knn, mixing, queries, residue, sql


def vectors(spark, rows):
    return spark.createDataFrame(rows, "frame_id string, representation_text string, vector array<double>, model_name string, space string")


def test_neighbours_of_odd_rows(spark):
    base = [1.0, 0.2, 0.0]
    rows = [("a", None, base, "m", ""), ("a", None, base, "m", ""), ("b", None, [2.0, 0.4, 0.0], "m", ""), ("c", None, base, "m", ""), ("d", None, [0.0, 0.0, 1.0], "m", ""), ("e", None, [0.0, 0.0, 0.0], "m", ""),
            ("f", None, None, "m", ""), ("g", None, [1.0, float("nan"), 0.0], "m", ""), ("h", None, [1.0, None, 0.0], "m", ""), ("i", None, [1.0, 0.2], "m", ""), ("j", None, base, "other", ""), ("k", None, [], "m", "")]
    got = {tuple(r) for r in knn.similar_pairs(vectors(spark, rows)).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
    assert knn.similar_pairs(vectors(spark, rows).limit(0)).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    rows = [(f"x{i:02}", None, [1.0, 1.0], "m", "") for i in range(20)]
    got = {(r["frame"], r["other"]) for r in knn.frame_neighbours(vectors(spark, rows)).collect()}
    assert {o for f, o in got if f == "x19"} == {f"x{i:02}" for i in range(5)}
    assert {o for f, o in got if f == "x02"} == {"x00", "x01", "x03", "x04", "x05"}


@pytest.mark.parametrize("task_lists", [4096, 30])
def test_index_recall(spark, task_lists):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(150, 32))
    x = (centres[rng.integers(0, 150, 3000)] + 0.25 * rng.normal(size=(3000, 32))).round(4)
    rows = [(f"v{i:05}", None, [float(z) for z in v], "m", "") for i, v in enumerate(x)]
    df = vectors(spark, rows).repartition(4)
    got = {(r["vid"], r["other"]) for r in knn.neighbours(knn.entries(df)[1], task_lists=task_lists, shard_rows=600).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for i in range(0, 3000, 10):
        s = np.round(u @ u[i], 9)
        s[i] = -2
        want |= {(f"v{i:05}", f"v{j:05}") for j in np.argsort(-s, kind="stable")[:5] if s[j] >= 0.85}
    assert len(want) > 500 and len(want & got) >= 0.97 * len(want)


@pytest.mark.parametrize("noise", [0.0, 1e-8])
def test_index_ties_of_scaled_copies(spark, noise):
    # A third of the rows has one direction, but no two of these vectors are equal.
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(100, 32))
    x = centres[rng.integers(0, 100, 1800)] + 0.25 * rng.normal(size=(1800, 32))
    hot = rng.permutation(1800)[:600]
    x[hot] = rng.uniform(0.1, 9, (600, 1)) * (centres[0] + noise * rng.normal(size=(600, 32)))
    rows = [(f"v{i:05}", None, [float(z) for z in v], "m", "") for i, v in enumerate(x)]
    got = {}
    for r in knn.frame_neighbours(vectors(spark, rows).repartition(4), shard_rows=600).collect():
        got.setdefault(r["frame"], set()).add(r["other"])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = np.flatnonzero(np.round(u @ u[hot[0]], 9) >= 0.85)
    assert len(near) > 600
    for i in near:
        s = np.round(u @ u[i], 9)
        s[i] = -2
        want = {f"v{j:05}" for j in np.argsort(-s, kind="stable")[:5]}
        # With noise only the copies' own cosines tie.
        assert got[f"v{i:05}"] == want or noise and i not in hot


def test_survivors_follow_trust_then_time_then_id(spark):
    arts = spark.createDataFrame([
        (1, 10, "g", "T1", "—", "A", None, "2025-01-01 00:00:00", "x"), (2, 20, "g", "T2", None, " ", "C2", None, "x"), (3, 20, None, "T3", "S3", None, "C3", "2025-02-01 00:00:00", "x"),
        (4, 30, "g", "T4", "S4", "B", "C4", "2026-01-01 00:00:00", "x"), (5, 99, " ", "T5", "S5", "Z", "C5", None, "x"), (6, 10, "g", "T6", None, "A6", None, "2025-01-01 00:00:00", "x"),
    ], "id bigint, source_id bigint, duplicate_group_id string, title string, subtitle string, author string, category string, updated_at string, field string")
    dups = spark.createDataFrame([("g", 3), ("g", 3), ("g", 777), (None, 1), ("h", 5)], "duplicate_group_id string, article_id bigint")
    prof = spark.createDataFrame([(10, 2), (20, 1), (30, None)], "source_id bigint, trust_rank int")
    got = {(r["duplicate_group_id"], r["field"]): r["article_id"] for r in fusion.trusted_values(arts, dups, prof).collect()}
    assert got == {("g", "title"): 3, ("g", "subtitle"): 3, ("g", "author"): 1, ("g", "category"): 3, ("h", "title"): 5, ("h", "subtitle"): 5, ("h", "author"): 5, ("h", "category"): 5}
    assert fusion.trusted_values(arts.limit(0), dups, prof).count() == 0 and fusion.fused_records(arts.limit(0), dups, prof).count() == 0


def test_copied_votes_are_discounted(spark):
    # Sources 3 and 4 share many values that others contradict; the independent ones prevail.
    rows, i = [], 0
    for g in range(40):
        for s in (1, 2, 5, 6):
            i += 1
            rows.append((f"g{g}", "title", f"true {g}" if (g + s) % 9 else f"slip {g} {s}", i, s, 1, 0))
        for s in (3, 4):
            i += 1
            rows.append((f"g{g}", "title", f"false {g}" if g % 2 else f"true {g}", i, s, 1, 0))
    for s, v in ((3, "wrong"), (4, "wrong"), (1, "right")):
        i += 1
        rows.append(("z", "title", v, i, s, 1, 0))
    claimed = spark.createDataFrame(rows, "duplicate_group_id string, field string, value string, article_id bigint, source_id bigint, trust_at int, age bigint")
    post, acc, dep = fusion.fuse(claimed)
    a = {r["source_id"]: r["accuracy"] for r in acc.collect()}
    p = {(r["a"], r["b"]): r["p"] for r in dep.collect()}
    assert min(a[1], a[2]) > max(a[3], a[4]) and p[(3, 4)] > max(p[k] for k in p if k != (3, 4))
    best = {r["duplicate_group_id"]: r["value"] for r in fusion.survivors(claimed, post, ("posterior", "smallest")).collect()}
    assert all(best[f"g{g}"] == f"true {g}" for g in range(1, 40, 2))


def test_rounding_keeps_mass():
    rng = np.random.default_rng(0)
    mass, part = rng.integers(1, 900, 500).astype(float).tolist(), rng.random(500).tolist()
    out = mixing.pivot(list(range(500)), mass, part, 3)
    left = [p for p in out if 0 < p < 1]
    assert len(left) <= 1 and abs(sum(m * p for m, p in zip(mass, out)) - sum(m * p for m, p in zip(mass, part))) < 1e-3
    mean = np.mean([mixing.pivot([0, 1, 2], [5.0, 3.0, 9.0], [0.3, 0.6, 0.2], s) for s in range(4000)], axis=0)
    assert np.allclose(mean, [0.3, 0.6, 0.2], atol=0.03)


def test_mixture_shares_and_caps(spark, data):
    docs, targets = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "mix_targets"))
    copies, report = mixing.mixture(docs, targets)
    caps = {r["source"]: r["max_repeats"] for r in targets.collect()}
    rows = copies.collect()
    assert rows and all(1 <= r["copies"] <= caps[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    rep = {r["source"]: r for r in report.collect()}
    assert len(rep) == targets.count() and abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-9
    for r in rep.values():
        biggest = 3000
        assert abs(r["mixed_tokens"] - r["quota_tokens"]) <= biggest
    again = {(r["doc_id"], r["copies"]) for r in mixing.mixture(docs.repartition(3), targets)[0].collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in rows}


def test_mixture_of_odd_input(spark):
    docs = spark.createDataFrame([(1, None, "a", 1), (2, "", "a", 1), (3, "some text here", None, 1), (4, "some text here", "b", 1)], "doc_id bigint, text string, source string, copies int")
    t = spark.createDataFrame([("a", 1.0, 2), ("b", 0.5, None), ("b", 0.5, 3), ("none", 2.0, 1), (None, 1.0, 1), ("z", None, 1)], "source string, target_weight double, max_repeats int")
    copies, report = mixing.mixture(docs, t)
    assert [(r["doc_id"], r["copies"]) for r in copies.collect()] == [(4, 1)]
    assert {r["source"] for r in report.collect()} == {"a", "b", "none", "z"}
    assert mixing.mixture(docs.limit(0), t)[0].count() == 0


GOOD = ["The council approved the budget of {} million after a long debate in the town hall.", "Die Behörden der Stadt prüften den Plan Nr. {} für das Ufer.", "Власти города одобрили проект номер {} после обсуждения.",
        "A JavaScript course in the town drew {} pupils, who had to enable nothing but curiosity.", "The show “Lorem Ipsum”, on the history of typefaces, opened with {} posters."]
BAD = ["{{{{ article.title }}}} {}", "Please enable JavaScript and reload to read this article. {}", "{} Not Found", "Lorem ipsum dolor sit amet velit nulla morbi {}", "[INSERT CITY] {}", "Страница не найдена"]


def test_residue_on_unseen_hosts(spark):
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for i in range(900):
        text = [GOOD[rng.integers(len(GOOD))].format(rng.integers(100, 999)) for _ in range(4)]
        if i % 6 == 0:
            text.insert(int(rng.integers(4)), BAD[rng.integers(len(BAD))].format(rng.integers(400, 599)))
            want.add(i)
        rows.append((i, int(i % 30), "Budget debate" if i % 3 else None, "\n".join(text), "c"))
    rows += [(2000, 1, None, None, "c"), (2001, None, "x", "   ", "c"), (2002, None, "x", "", "c")]
    df = spark.createDataFrame(rows, "id bigint, source_id bigint, title string, body_text string, text string")
    model = residue.fit(df)
    report = dict(model.report)
    assert report["unseen hosts: recall"] > 0.95 and report["unseen hosts: precision"] > 0.95
    chunks = df.select("id", F.col("body_text").alias("chunk_text")).where("id < 60").unionByName(df.select("id", F.col("body_text").alias("chunk_text")).where("id < 6"))
    got = [tuple(r) for r in residue.residue_rows(df, chunks).collect()]
    assert len(got) == len(set(got))
    assert {i for t, i in got if t == "articles"} == want and {i for t, i in got if t == "article_chunks"} == {i for i in want if i < 60}
    assert residue.residue_rows(df.limit(0), chunks.limit(0)).count() == 0
    # Wordings that no phrase of the weak labels matches, and reports that hold one.
    new = ["Oops! Something went wrong on our side", "This site needs cookies to function", "Sorry, this article is no longer available", "Произошла ошибка, материал не показан"]
    told = ["A leaflet for pensioners shows how to enable JavaScript, step by step, and where to ask.", "The museum's album “Page Not Found” drew critics to the town."]
    texts = spark.createDataFrame(list(enumerate(new + told)), "id bigint, text string")
    assert not any(p.search(t.lower()) for t in new for _, p in residue._FAMILIES)
    assert {r["row_id"] for r in residue.flagged(texts, "text", spark.sparkContext.broadcast(model)).collect()} == set(range(len(new)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() >= 0
    assert set(sql.SQL) <= set(queries.QUERIES)
