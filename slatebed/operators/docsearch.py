"""Search over documents by an inverted index.

A term is found wherever a text holds it, so it is found in a document if some
word of the document holds it, terms and words being free of space. The index
is the postings of words by document, with the places they have there; the
pieces of three characters of each distinct word; and the lower-cased texts. A
table of queries is answered by joins: long terms to words by their first piece
and words to postings. Short terms are held by very many words and most
documents, so postings would be longer than the texts: all short terms of all
queries are looked for in one pass over these. Hits are dealt by document once
and summed there by query, so a term that most documents have is not dealt for
each query that asks it; no query has a pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of the pieces that words are looked up by, and of the longest term that is short.
PIECE = 3
#: Points for a term in the title, in a heading, anywhere; results of a query.
TITLE, HEADING, ANYWHERE, MOST = 10, 5, 1, 12
#: Rows, counted first, up to which terms of queries and words that hold them are broadcast.
FEW_ROWS = 100_000
_HEADINGS = r"(?m)^#{2,3}[ \t]+([^\n]+)$"


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def headings(text: Column) -> Column:
    """The texts of second and third level Markdown headings."""
    return F.regexp_extract_all(text, F.lit(_HEADINGS), 1)


def postings(docs: DataFrame) -> DataFrame:
    """``word, doc_id, in_title, in_heading`` of ``docs(doc_id, title, body)``, each word of a document once.

    Words are lower-cased. Null titles and bodies are empty.
    """
    title, body = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.concat_ws("\n", "title", "body"))
    read = docs.select("doc_id", _terms(title).alias("t"), _terms(F.array_join(headings(body), " ")).alias("h"), _terms(body).alias("b"))
    marked = lambda words, title, heading: F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(title).alias("in_title"), F.lit(heading).alias("in_heading")))
    places = F.concat(
        marked(F.array_intersect("t", "h"), True, True),
        marked(F.array_except("t", "h"), True, False),
        marked(F.array_except("h", "t"), False, True),
        marked(F.array_except(F.array_except("b", "t"), F.col("h")), False, False),
    )
    return read.select("doc_id", F.inline(places)).select("word", "doc_id", "in_title", "in_heading")


def pieces(index: DataFrame) -> DataFrame:
    """``piece, word``: the pieces of PIECE characters of every word."""
    starts = F.sequence(F.lit(1), F.length("word") - (PIECE - 1))
    every = F.array_distinct(F.transform(starts, lambda i: F.substr(F.col("word"), i, F.lit(PIECE))))
    return index.select("word").distinct().where(F.length("word") >= PIECE).select(F.explode(every).alias("piece"), "word")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id, title, heading, body`` of ``docs(doc_id, title, body)`` in small letters, the body with the title before it."""
    title, body = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.concat_ws("\n", "title", "body"))
    return docs.select("doc_id", title.alias("title"), F.array_join(headings(body), " ").alias("heading"), body.alias("body"))


def _held_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each short term that a text holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            terms = some.column(4)[0].as_py().split(" ") if some.column(4)[0].as_py() else []
            rows, held, in_title, in_heading = [], [], [], []
            for i, (title, heading, body) in enumerate(zip(*(some.column(c).to_pylist() for c in (1, 2, 3)))):
                for term in terms:
                    if term in body:
                        rows.append(i)
                        held.append(term)
                        in_title.append(term in title)
                        in_heading.append(term in heading)
            columns = [pa.array(held, pa.string()), some.column(0).take(pa.array(rows, pa.int64())), pa.array(in_title, pa.bool_()), pa.array(in_heading, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "doc_id", "in_title", "in_heading"])


def search(queries: DataFrame, index: DataFrame, word_pieces: DataFrame, whole_texts: DataFrame, most: int = MOST) -> DataFrame:
    """``query_id, doc_id, score``: for each of ``queries(query_id, text)`` the best documents that have all of its terms.

    A term that a query repeats counts as often; equal scores go by doc_id;
    queries without terms find nothing.
    """
    asked = queries.select("query_id", F.explode(_terms(F.lower("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    needed = asked.groupBy("query_id").agg(F.count("*").alias("needed"))
    terms = asked.select("term").distinct()
    long = terms.where(F.length("term") > PIECE).withColumn("piece", F.substring("term", 1, PIECE))
    words = long.join(word_pieces, "piece").where(F.col("word").contains(F.col("term"))).select("term", "word")
    hits = index.join(_few(words.distinct()), "word").select("term", "doc_id", "in_title", "in_heading")
    # one row: the different short terms that are asked, which hold no blanks
    brief = F.broadcast(terms.where(F.length("term") <= PIECE).agg(F.array_join(F.collect_set("term"), " ").alias("brief")))
    kind = index.schema["doc_id"].dataType.simpleString()
    hits = hits.union(whole_texts.crossJoin(brief).select("doc_id", "title", "heading", "body", "brief").mapInArrow(_held_batches, f"term string, doc_id {kind}, in_title boolean, in_heading boolean"))
    # all that follows is of one document, but for the places
    found = hits.repartition("doc_id").groupBy("doc_id", "term").agg(F.bool_or("in_title").alias("in_title"), F.bool_or("in_heading").alias("in_heading"))
    points = F.when(F.col("in_title"), TITLE).otherwise(0) + F.when(F.col("in_heading"), HEADING).otherwise(0) + ANYWHERE
    scores = found.select("term", "doc_id", points.alias("points")).join(_few(asked), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("points") * F.col("times")).alias("score"), F.count("*").alias("matched"))
    whole = scores.join(_few(needed), "query_id").where("matched = needed")
    # a place up to a bound, so that each task hands on no more than that of a query
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return whole.withColumn("place", place).where(F.col("place") <= most).select("query_id", "doc_id", F.col("score").cast("long").alias("score"), F.col("place").cast("long").alias("place"))
