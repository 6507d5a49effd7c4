"""Warnings and the sentences that users read for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Codes by what the user is told; several codes share a sentence.
SENTENCES = {
    "Some files in the archive are no books and were skipped.": ("zip.skipped",),
    "Some files in the archive can't be handled yet and were skipped.": ("zip.unsupported",),
    "Only the outermost archive was opened.": ("zip.nested-too-deep",),
    "The archive holds several books; the first by name was converted.": ("zip.multiple-books",),
    "No table of contents was found; one was made from the chapters.": ("epub.no-toc", "azw3.no-nav"),
    "Part of the content points nowhere and was skipped.": ("epub.broken-spine-item",),
    "Some images are missing from the book and were left out.": ("epub.missing-image", "azw3.image-unresolved"),
    "Some fonts are encrypted and were left out.": ("epub.encrypted",),
    "The structure of this format could be read in part only.": ("mobi.no-chapters", "mobi.flat-nav", "mobi.filepos-unresolved"),
    "The file holds an old and a new version; the new one was used.": ("azw3.combo",),
    "No headings were found; the whole document is one chapter.": ("docx.no-headings", "txt.no-chapters", "md.no-chapters"),
    "The encoding isn't certain; some characters may be wrong.": ("txt.encoding-fallback",),
    "Some images weren't found; their descriptions stand in.": ("md.image-unresolved",),
    "The structure was guessed from the page layout.": ("pdf.no-structure", "pdf.flat-nav", "pdf.paged-chapters"),
    "Reading marks weren't made: their dictionary couldn't be loaded.": ("ruby.unavailable",),
    "Reading marks weren't made: this format can't hold them.": ("ruby.format",),
    "Characters weren't converted: the book is Japanese.": ("variants.japanese-kept",),
    "EPUB suits a book that came as AZW3.": ("azw3.output",),
    "Images and notes were left out: text files can't hold them.": ("txt.media-dropped", "txt.notes-dropped"),
    "Reading marks were reduced to their base text.": ("mobi.readings-dropped",),
    "Notes stand at the end of the book.": ("mobi.notes-moved",),
    "The vertical writing mode isn't kept by this format.": ("output.upright",),
}
FALLBACK = "A detail couldn't be kept; the rest isn't affected."


def told(codes: list[str]) -> list[str]:
    """The sentences of these codes, each once, in order."""
    by = {code: sentence for sentence, own in SENTENCES.items() for code in own}
    return list(dict.fromkeys(by.get(c, FALLBACK) for c in codes))


def messages(spark: SparkSession) -> DataFrame:
    rows = [(code, sentence) for sentence, codes in SENTENCES.items() for code in codes]
    return spark.createDataFrame(rows, "code string, sentence string")


def deduplicated(warnings: DataFrame) -> DataFrame:
    """Of equal (book_id, code, detail), the first."""
    return warnings.groupBy("book_id", "code", "detail").agg(F.min("seq").alias("seq"))


def notes(warnings: DataFrame) -> DataFrame:
    """book_id, seq, sentence: each sentence once, at its first warning. The table of messages is a constant."""
    known = F.broadcast(messages(warnings.sparkSession))
    told = warnings.join(known, "code", "left").withColumn("sentence", F.coalesce("sentence", F.lit(FALLBACK)))
    return told.groupBy("book_id", "sentence").agg(F.min("seq").alias("seq"))


def first_few(rows: DataFrame, key: str, value: Column, order: str, n: int = 5) -> DataFrame:
    """key, shown: the first n values of each group, and how many there are if more. Groups are cut before they
    are shuffled."""
    total = rows.groupBy(key).agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    top = rows.select(key, value.cast("string").alias("_v"), place.alias("_r")).where(F.col("_r") <= n)
    line = F.transform(F.array_sort(F.collect_list(F.struct("_r", "_v"))), lambda x: x["_v"])
    top = top.groupBy(key).agg(F.array_join(line, ", ").alias("_s"))
    shown = F.when(F.col("_n") > n, F.concat("_s", F.lit(" ("), F.col("_n").cast("string"), F.lit(" in all)"))).otherwise(F.col("_s"))
    return total.join(top, key).select(key, shown.alias("shown"))


def losses(books: DataFrame, fmt: str) -> DataFrame:
    """book_id, code of what a format can't keep. books: book_id, has_ruby, has_notes, has_images."""
    rules = {
        "txt": [("has_images", "txt.media-dropped"), ("has_notes", "txt.notes-dropped")],
        "mobi": [("has_ruby", "mobi.readings-dropped"), ("has_notes", "mobi.notes-moved")],
        "html": [], "epub": [], "kepub": [],
    }.get(fmt, [])
    made = F.array_compact(F.array(*[F.when(F.col(c), F.lit(code)) for c, code in rules])) if rules else F.array().cast("array<string>")
    return books.select("book_id", F.explode(made).alias("code"))
