"""Segmentation: ordered rows to groups, as running sums over windows partitioned by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, line: every line of every text."""
    return docs.select(key, F.posexplode(F.split(T.newlines(F.col(text)), "\n")).alias("pos", "line"))


def running_group(starts: Column, *keys: str, order: str = "pos") -> Column:
    """The number of group starts so far; 0 before the first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(starts.cast("int")).over(w)


def joined(value: Column, order: Column, sep: str) -> Column:
    """Values in order, joined: an aggregate."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), sep)


def txt_chapters(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ord, chapter_id, title, level, html of plain texts: a heading line opens a chapter, other lines that
    aren't blank become paragraphs, those before the first heading a chapter without title; a text without any is one
    empty chapter. A document's lines stay in one row of an array, so nothing is shuffled; each chapter takes its own slice, so a
text costs what its lines cost."""
    rows = F.transform(F.split(T.newlines(F.col(text)), "\n"), lambda line: T.trim(line))
    rows = F.transform(F.filter(rows, lambda line: line != ""), lambda line: F.struct(line.alias("line"), T.is_heading(line).alias("head")))
    base = docs.select(key, rows.alias("rows"))
    heads = F.filter(F.transform("rows", lambda r, i: F.when(r["head"], i)), lambda i: i.isNotNull())
    base = base.withColumn("heads", heads)
    none_first = F.coalesce(F.get("heads", F.lit(0)) > 0, F.lit(True))
    base = base.withColumn("starts", F.when(none_first, F.concat(F.array(F.lit(-1)), "heads")).otherwise(F.col("heads")))
    paragraph = lambda r: F.concat(F.lit("<p>"), T.escape_text(r["line"]), F.lit("</p>"))

    def chapter(start: Column, i: Column) -> Column:
        n = F.coalesce(F.get("starts", i + 1), F.size("rows")) - start - 1
        title = F.when(start >= 0, F.get("rows", start)["line"])
        return F.struct(title.alias("title"), F.array_join(F.transform(F.slice("rows", start + 2, n), paragraph), "\n").alias("html"))

    out = base.select(key, F.posexplode(F.transform("starts", chapter)).alias("at", "c"))
    number = F.col("at") + 1
    return out.select(key, number.alias("ord"), F.concat(F.lit("c"), number).alias("chapter_id"), F.col("c.title").alias("title"), F.lit(1).alias("level"), F.col("c.html").alias("html"))


def sentence_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, seq (from 1), sentence; pieces join to the text."""
    return docs.select(key, F.posexplode(T.sentences(F.col(text))).alias("p", "sentence")).select(key, (F.col("p") + 1).alias("seq"), "sentence")


def heading_sections(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section, text: texts cut before every match of pattern (a zero-width look-ahead in Java's syntax); blank
    ones go unless a document has nothing else."""
    parts = docs.select(key, F.posexplode(F.split(F.col(text), f"(?={pattern})")).alias("section", "text"))
    n = F.count("*").over(Window.partitionBy(key))
    return parts.withColumn("n", n).where((T.trim(F.col("text")) != "") | (F.col("n") == 1)).drop("n")


def gap_groups(rows: DataFrame, key: str, order: str, gap: Column, name: str = "group") -> DataFrame:
    """Rows with a group number that grows where `gap`, a condition that may use prev_<order>, holds."""
    w = Window.partitionBy(key).orderBy(order)
    prev = rows.withColumn(f"prev_{order}", F.lag(order).over(w))
    return prev.withColumn(name, running_group(F.coalesce(gap, F.lit(False)), key, order=order))


#: Fixed values of the layout rules for text runs.
LINE_HEIGHT, PARAGRAPH_GAP, CHAPTER_GAP, INDENT, PAGES = 1.3, 1.8, 3.2, 1.2, 20


def page_paragraphs(rows: DataFrame, key: str = "book_id") -> DataFrame:
    """Lines (key, page, pos, text, x0, y, font) with para and chapter numbers. A paragraph starts behind a wide gap, or
    where a line that no wide gap precedes is indented against its page's margin; a chapter behind a very wide gap, or,
    in a book without any, at every PAGES-th page."""
    w = Window.partitionBy(key).orderBy("page", "pos")
    margin = F.min("x0").over(Window.partitionBy(key, "page"))
    r = rows.withColumns({"margin": margin, "prev_y": F.lag("y").over(w), "prev_page": F.lag("page").over(w), "height": F.col("font") * LINE_HEIGHT})
    same = F.col("prev_page") == F.col("page")
    space = F.when(same, F.col("prev_y") - F.col("y"))
    indented = F.col("x0") - F.col("margin") > INDENT * F.col("font")
    r = r.withColumn("new_para", F.col("prev_page").isNull() | F.coalesce(space >= PARAGRAPH_GAP * F.col("height"), F.lit(False)) | indented)
    r = r.withColumn("wide", F.coalesce(space >= CHAPTER_GAP * F.col("height"), F.lit(False)))
    run = Window.partitionBy(key).orderBy("page", "pos").rowsBetween(Window.unboundedPreceding, 0)
    any_wide = F.max("wide").over(Window.partitionBy(key))
    bucket = lambda c: F.floor((F.col(c) - 1) / PAGES)
    chapter = F.when(any_wide, F.sum(F.col("wide").cast("int")).over(run)).otherwise(bucket("page")).cast("int")
    starts = F.col("new_para") | (~any_wide & (bucket("prev_page") != bucket("page")))
    r = r.withColumns({"starts": starts, "chapter": chapter})
    return r.withColumn("para", F.sum(F.col("starts").cast("int")).over(run).cast("int")).select(*rows.columns, "para", "chapter")


def buckets(number: Column, size: int = PAGES) -> Column:
    return F.floor((number - 1) / size).cast("int")
