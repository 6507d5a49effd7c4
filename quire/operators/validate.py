"""Constraint checks of the document model: rows (book_id, check_no, detail) for everything that is wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import text as T
from quire.schema import HORIZONTAL, VERTICAL

CHECKS = (
    "title", "language", "identifier", "writing mode", "resource", "cover", "no chapter", "chapter id twice", "level",
    "tag", "image address", "image unknown", "note unknown", "navigation target",
)


def errors(books: DataFrame, chapters: DataFrame, nav: DataFrame, notes: DataFrame, resources: DataFrame) -> DataFrame:
    def wrong(rows: DataFrame, name: str, detail: Column) -> DataFrame:
        return rows.select("book_id", F.lit(CHECKS.index(name) + 1).alias("check_no"), F.lit(name).alias("check"), detail.cast("string").alias("detail"))

    blank = lambda c: F.coalesce(T.trim(F.col(c)), F.lit("")) == ""
    modes = F.coalesce(F.col("writing_mode"), F.lit("")).isin(HORIZONTAL, VERTICAL)
    found = [wrong(books.where(blank(c)), c, F.col(c)) for c in ("title", "language", "identifier")]
    found.append(wrong(books.where(~modes), "writing mode", F.col("writing_mode")))
    found.append(wrong(resources.where(F.col("href").isNull() | F.col("mime").isNull() | F.col("data").isNull()), "resource", F.col("rid")))
    rids = resources.select("book_id", F.col("rid").alias("cover_rid"))
    found.append(wrong(books.where("cover_rid is not null").join(rids, ["book_id", "cover_rid"], "left_anti"), "cover", F.col("cover_rid")))
    found.append(wrong(books.join(chapters, "book_id", "left_anti"), "no chapter", F.lit(None)))
    again = F.row_number().over(Window.partitionBy("book_id", "chapter_id").orderBy("ord")) > 1
    found.append(wrong(chapters.withColumn("_again", again).where("_again"), "chapter id twice", F.col("chapter_id")))
    found.append(wrong(chapters.where(~F.coalesce(F.col("level").isin(1, 2, 3), F.lit(False))), "level", F.concat_ws(": ", "chapter_id", F.col("level").cast("string"))))
    found.append(wrong(chapters.select("book_id", "chapter_id", F.explode(H.illegal_tags(F.col("html"))).alias("tag")), "tag", F.concat_ws(": ", "chapter_id", "tag")))
    src = chapters.select("book_id", "chapter_id", F.explode(H.images(F.col("html"))).alias("href"))
    outside = T.is_external(F.col("href")) | F.lower("href").startswith("data:")
    found.append(wrong(src.where(outside), "image address", F.col("href")))
    found.append(wrong(src.where(~outside).join(resources.select("book_id", "href"), ["book_id", "href"], "left_anti"), "image unknown", F.col("href")))
    marks = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)<a(?=\s[^>]*class=\"[^\">]*\bnoteref\b)[^>]*\shref=\"#([^\">]*)\""), 1)
    refs = chapters.select("book_id", F.explode(marks).alias("note_id"))
    found.append(wrong(refs.join(notes.select("book_id", "note_id"), ["book_id", "note_id"], "left_anti"), "note unknown", F.col("note_id")))
    known = chapters.select("book_id", F.col("chapter_id").alias("target"))
    found.append(wrong(nav.join(known, ["book_id", "target"], "left_anti"), "navigation target", F.col("target")))
    return reduce(DataFrame.unionByName, found)


def verdicts(books: DataFrame, found: DataFrame) -> DataFrame:
    """book_id, ok, errors in the order of the checks."""
    text = F.concat_ws(": ", "check", "detail")
    by = found.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("check_no", text.alias("t")))), lambda x: x["t"]).alias("errors"))
    out = books.select("book_id").join(by, "book_id", "left")
    return out.select("book_id", F.col("errors").isNull().alias("ok"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))
