from hypothesis import given, settings
from hypothesis import strategies as st

from presswork.llm import split

texts = st.lists(st.sampled_from(["word", "a", "longer-word" * 6, ". ", ".\n\n", " ", "  ", "\n", "! ", "é́", "🙂", "x" * 90]), min_size=1, max_size=400).map("".join)


@settings(max_examples=300, deadline=None)
@given(texts, st.sampled_from([(700, 80), (100, 20), (50, 0), (60, 30)]))
def test_pieces_cover_fit_and_overlap(text, how):
    limit, overlap = how
    got = split.bisect_text(text, limit, overlap)
    assert "".join(text[own:end] for _, own, end in got) == text
    for i, (start, own, end) in enumerate(got):
        assert own < end and end - start <= limit and 0 <= own - start <= overlap
        if i:
            assert start >= got[i - 1][1]
        else:
            assert start == own


def test_borders_come_first():
    p = ("Sentence one is here. " * 14).strip()
    text = p + "\n\n" + p + "\n\n" + p
    got = split.bisect_text(text)
    assert all(text[e - 1] == "." for _, _, e in got)
    assert {e for _, _, e in got} == {2 * len(p) + 2, len(text)}  # the paragraph's end nearest to the middle
    long = "x" * 5000
    assert len(split.bisect_text(long)) >= 8 and split.bisect_text(" " * 5000)[-1][2] == 5000


def test_rows_offsets_and_odd_input(spark):
    body = "intro\n\n" + "Some words stand here. " * 60
    chunk = body[7:]
    rows = [(1, 10, chunk, 7), (1, 10, chunk, 7), (2, 10, chunk, 3), (3, 10, chunk, None), (4, 99, chunk, 7), (5, 10, "short", 0), (6, 10, None, 0), (7, None, "", None)]
    chunks = spark.createDataFrame(rows, "id bigint, article_id bigint, chunk_text string, char_start int")
    arts = spark.createDataFrame([(10, body, "x"), (11, None, "y")], "id bigint, body_text string, chunk_text string")
    got = split.cut_chunks(chunks, arts).collect()
    assert {r["chunk_id"] for r in got} == {1, 2, 3, 4}
    for r in got:
        assert r["piece_text"] == chunk[r["piece_start"] : r["piece_end"]]
        if r["chunk_id"] == 4:
            assert r["char_start"] is None
        else:
            assert body[r["char_start"] : r["char_end"]] == r["piece_text"]
    assert len([r for r in got if r["chunk_id"] == 1]) == len([r for r in got if r["chunk_id"] == 2])
    assert split.cut_rows(chunks.limit(0), "id", "chunk_text").count() == 0
