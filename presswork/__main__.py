"""python -m presswork {ingest,index,search,analyze,run} ...: the steps over parquet folders."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .functions import text as t
from .operators import chunking, retrieval
from .plans import pipelines, queries
from .runtime import build_session, table


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="presswork", description=__doc__)
    sub = p.add_subparsers(dest="step", required=True)
    s = sub.add_parser("ingest", help="landed pages to articles, chunks and counters")
    s.add_argument("pages"), s.add_argument("stored"), s.add_argument("out")
    s = sub.add_parser("index", help="chunks of articles, with embeddings")
    s.add_argument("articles"), s.add_argument("out")
    s = sub.add_parser("search", help="hybrid search over a folder of tables")
    s.add_argument("tables"), s.add_argument("query")
    s.add_argument("--date-from"), s.add_argument("--date-to"), s.add_argument("--limit", type=int, default=10), s.add_argument("--domains", nargs="*")
    s = sub.add_parser("analyze", help="narrative run over a folder of tables")
    s.add_argument("tables"), s.add_argument("out")
    s = sub.add_parser("run", help="one catalogue query")
    s.add_argument("name"), s.add_argument("tables"), s.add_argument("--out")
    a = p.parse_args(args)
    spark = build_session()
    if a.step == "ingest":
        for name, df in pipelines.ingest_pages(spark.read.parquet(a.pages), spark.read.parquet(a.stored)).items():
            df.write.mode("append").parquet(f"{a.out}/{name}")
    elif a.step == "index":
        c = chunking.chunk_articles(spark.read.parquet(a.articles)).withColumn("chunk_id", F.xxhash64("article_id", "chunk_index"))
        c.write.mode("overwrite").parquet(f"{a.out}/chunks")
        none = c.limit(0).select("chunk_id", F.lit("").alias("model_name"))
        pipelines.embed_missing(c, none).write.mode("overwrite").parquet(f"{a.out}/embeddings")
    elif a.step == "search":
        q = t.Query.of(a.query)
        rows = queries._rows(spark, a.tables).withColumn("embedding", t.hashed_embedding(F.concat_ws(" ", "article_title", "chunk_text")))
        found = retrieval.search(rows, q, t.hashed_embedding(F.lit(" ".join(x for x, _ in q.terms))), a.date_from, a.date_to, a.limit, a.domains)
        found.select("final_score", "source_domain", "published_at", "article_title", "chunk_text").show(a.limit, 120, True)
    elif a.step == "analyze":
        run = pipelines.analyse(queries._frames(spark, a.tables), queries._vectors(spark, a.tables), table(spark, a.tables, "articles"), table(spark, a.tables, "sources"))
        pipelines.saved_run(run, a.out, None, None, None).show(1, False, True)
    else:
        df = queries.QUERIES[a.name](spark, a.tables)
        df.write.mode("overwrite").json(a.out) if a.out else df.show(50, False)
    spark.stop()



if __name__ == "__main__":
    main()
