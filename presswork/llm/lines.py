"""Lines that one source repeats over many of its documents.

Every line is parsed into a template by a token tree of fixed depth: below the source come the
number of tokens and the first tokens, where tokens with digits and very long ones are wildcard
slots. Each partition counts its own tree (the partial aggregation), the trees are merged by node,
and only the nodes that cover enough documents go on. Within these the lines - a template with its
slots filled - are counted in the same way, as two lines are only equal if they agree in every
token; those that cover enough documents of their source are removed. A line is brought into its
compared form once; only numbers that stand for nodes and lines are shuffled, never texts.

Defined results
  * null and blank bodies, and rows without a source, have no lines to remove;
  * a line counts once a document, however often it stands there; every place of it goes;
  * repeated document ids are separate documents; extra columns are not read;
  * an empty table gives no templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, written

#: A line goes if it stands in at least so many, and this share, of its source's documents.
LEAST_DOCS, LEAST_SHARE = 5, 0.04
#: Tokens below which the tree branches, and length from which a token is a slot.
DEPTH, LONG_TOKEN = 3, 24
SLOT = "<*>"

_BLANK = r"[\t\r\f\x0B\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def line_keys(body: Column) -> Column:
    """The lines of a text, in order, in the form in which they are compared."""
    even = F.regexp_replace(F.regexp_replace(F.lower(body), "[0-9]+", "0"), _BLANK, " ")
    return F.transform(F.split(even, "\n"), lambda x: F.trim(x))


def _node(key: Column, depth: int) -> Column:
    """The line's place in the tree: number of tokens, and the first ones with wildcards."""
    tokens = F.split(key, " ", depth + 1)
    size = F.length(key) - F.length(F.translate(key, " ", ""))

    def slot(i: int) -> Column:
        t = F.get(tokens, F.lit(i))
        return F.when(t.contains("0") | (F.length(t) >= LONG_TOKEN), SLOT).otherwise(t)

    return F.xxhash64(size, *[slot(i) for i in range(depth)])


def _parsed(df: DataFrame, key: str, source: str, body: str, depth: int) -> DataFrame:
    """(key, source, lines): node and 128-bit leaf of every line in order, null for empty ones."""
    leaf = lambda k: F.struct(_node(k, depth).alias("node"), F.xxhash64(k, F.lit(1)).alias("a"), F.xxhash64(F.lit(2), F.reverse(k)).alias("b"))
    lines = F.transform(line_keys(F.col(body)), lambda k: F.when(k != "", leaf(k)))
    return df.where(F.col(source).isNotNull()).select(F.col(key).alias("key"), F.col(source).alias("source"), lines.alias("lines"))


def templates(parsed: DataFrame, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(source, node, a, b, n_docs) of the lines to remove, from the parsed documents.

    Every kept leaf covers at least least_share of its source's documents, so that a source has at
    most 1 / least_share times the mean number of lines of its documents; the same holds for nodes.
    """
    totals = broadcast_if_small(written(parsed.groupBy("source").agg(F.count("*").alias("of")), "totals"))
    seen = parsed.select("source", F.explode(F.array_distinct("lines")).alias("l")).where("l is not null").select("source", "l.*")
    enough = (F.col("n_docs") >= least_docs) & (F.col("n_docs") >= least_share * F.col("of"))

    def covering(rows: DataFrame, by: list[str]) -> DataFrame:
        merged = rows.groupBy("source", *by).agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least_docs)
        return merged.join(totals, "source").where(enough).select("source", *by, "n_docs")

    # A node's lines are at least as many as the documents it covers: no repeated line is lost with it.
    nodes = broadcast_if_small(written(covering(seen, ["node"]).select("source", "node"), "nodes"))
    return covering(seen.join(nodes, ["source", "node"], "left_semi"), ["node", "a", "b"])


def repeated_lines(df: DataFrame, key: str = "id", source: str = "source_id", body: str = "body_text", depth: int = DEPTH, **how: float) -> DataFrame:
    """(key, source, line_no) of every line to remove; line_no counts the text split at each newline.

    The lines are joined to the templates on (source, line), a key that no source can make hot; the
    join is a broadcast where the templates turn out to be small.
    """
    parsed = written(_parsed(df, key, source, body, depth), "lines")
    found = broadcast_if_small(written(templates(parsed, **how).select("source", "a", "b"), "templates"))
    lines = parsed.select("key", "source", F.posexplode("lines").alias("line_no", "l")).where("l is not null")
    lines = lines.select("key", "source", F.col("line_no").cast("bigint").alias("line_no"), "l.a", "l.b")
    return lines.join(found, ["source", "a", "b"], "left_semi").select(F.col("key").alias(key), F.col("source").alias(source), "line_no")


def without_repeated_lines(df: DataFrame, key: str = "id", source: str = "source_id", body: str = "body_text", **how: float) -> DataFrame:
    """(key, clean_text, n_removed): each document without its source's lines; the others are untouched.

    key must be unique here, as the removed lines are brought back to their document by it.
    """
    gone = repeated_lines(df, key, source, body, **how).groupBy(F.col(key).alias("__k")).agg(F.collect_set("line_no").alias("__gone"))
    joined = df.select(key, body).join(gone, F.col(key) == F.col("__k"), "left")
    kept = F.filter(F.split(F.col(body), "\n"), lambda x, i: ~F.array_contains("__gone", i.cast("bigint")))
    text = F.when(F.col("__gone").isNull(), F.col(body)).otherwise(F.array_join(kept, "\n"))
    return joined.select(key, text.alias("clean_text"), F.coalesce(F.size("__gone"), F.lit(0)).alias("n_removed"))


def template_report(df: DataFrame, key: str = "id", source: str = "source_id", body: str = "body_text", depth: int = DEPTH, **how: float) -> DataFrame:
    """(source, template, n_lines, n_docs): removed lines merged within a tree node.

    Tokens in which the node's lines differ are shown as the slot ``<*>``.
    """
    parsed = written(_parsed(df, key, source, body, depth), "lines")
    found = broadcast_if_small(written(templates(parsed, **how), "templates"))
    texts = df.where(F.col(source).isNotNull()).select(F.col(source).alias("source"), F.explode(F.array_distinct(line_keys(F.col(body)))).alias("text")).where("text <> ''")
    kept = texts.withColumns({"a": F.xxhash64("text", F.lit(1)), "b": F.xxhash64(F.lit(2), F.reverse("text"))}).join(found, ["source", "a", "b"])
    one = kept.groupBy("source", "node", "a", "b").agg(F.first("text").alias("text"), F.first("n_docs").alias("n_docs"))
    tokens = one.select("source", "node", "text", "n_docs", F.posexplode(F.split("text", " ")).alias("i", "token"))
    slots = tokens.groupBy("source", "node", "i").agg(
        F.when(F.min("token") == F.max("token"), F.min("token")).otherwise(SLOT).alias("slot"),
        F.count("*").alias("n_lines"),
        F.sum("n_docs").alias("n_docs"),
    )
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "slot"))), lambda x: x["slot"]), " ")
    out = slots.groupBy("source", "node").agg(shown.alias("template"), F.max("n_lines").alias("n_lines"), F.max("n_docs").alias("n_docs"))
    return out.select(F.col("source").alias(source), "template", "n_lines", "n_docs")
