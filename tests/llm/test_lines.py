import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from presswork.llm import lines


def key(x):
    return re.sub("[0-9]+", "0", re.sub(r"[\s ]+", " ", x).strip().lower())


def brute(rows, least=5, share=0.04):
    n, c = Counter(s for _, s, _ in rows if s is not None), Counter()
    for _, s, b in rows:
        if s is not None and b is not None:
            c.update({(s, key(x)) for x in b.split("\n") if key(x)})
    good = {k for k, v in c.items() if v >= least and v >= share * n[k[0]]}
    return sorted((i, j) for i, s, b in rows if s is not None and b is not None for j, x in enumerate(b.split("\n")) if (s, key(x)) in good)


piece = st.sampled_from(["© 2024 Site", "©  2023 site\r", "Share this", "share this ", "unique a", "unique b", "", "   ", "12", "7 "])
bodies = st.lists(st.tuples(st.sampled_from([1, 2, None]), st.one_of(st.none(), st.lists(piece, max_size=5).map("\n".join))), min_size=1, max_size=40)


@settings(max_examples=8, deadline=None)
@given(bodies)
def test_agrees_with_brute_force(spark, rows):
    rows = [(i, s, b) for i, (s, b) in enumerate(rows)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "id bigint, source_id bigint, body_text string, line_no string")
    assert sorted((r["id"], r["line_no"]) for r in lines.repeated_lines(df).collect()) == brute(rows)


def test_clean_text_and_templates(spark):
    rows = [(i, 1, f"Story {chr(97 + i)}\nJoin {i * 11} readers\n\nEnd {chr(97 + i)}") for i in range(6)] + [(9, 2, None), (10, None, "Join 5 readers"), (11, 1, "")]
    df = spark.createDataFrame(rows, "id bigint, source_id bigint, body_text string")
    got = {r["id"]: (r["clean_text"], r["n_removed"]) for r in lines.without_repeated_lines(df).collect()}
    assert got[0] == ("Story a\n\nEnd a", 1) and got[9] == (None, 0) and got[10] == ("Join 5 readers", 0) and got[11] == ("", 0)
    t = lines.template_report(df).collect()
    assert [(r["source_id"], r["template"], r["n_docs"]) for r in t] == [(1, "join 0 readers", 6)]
    assert lines.repeated_lines(df.limit(0)).count() == 0
