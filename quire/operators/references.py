"""References between chapters, notes, resources and positions: look-ups as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import text as T


def spine(items: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items (book_id, ord, idref) with the manifest's columns (book_id, id, href, media_type); and warnings for
    those that point nowhere."""
    m = manifest.select("book_id", F.col("id").alias("idref"), *[c for c in manifest.columns if c not in ("book_id", "id")])
    found = items.join(m.withColumn("_hit", F.lit(True)), ["book_id", "idref"], "left")
    lost = found.where("_hit is null").select("book_id", F.col("ord").alias("seq"), F.lit("epub.broken-spine-item").alias("code"), F.col("idref").alias("detail"))
    return found.where("_hit").drop("_hit"), lost


def by_path(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """wanted (book_id, path) with entry: the entry (book_id, path) of that path, else the first that differs
    in case only."""
    e = entries.select("book_id", F.col("path").alias("entry"), F.col("ord").alias("_ord"))
    pairs = wanted.join(e.withColumn("_low", F.lower("entry")), [wanted.book_id == e.book_id, F.lower(wanted.path) == F.col("_low")], "left").select(wanted["*"], "entry", "_ord")
    best = Window.partitionBy(*wanted.columns).orderBy(F.col("entry") != F.col("path"), "_ord")
    return pairs.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "_ord")


def missing_images(chapters: DataFrame, resources: DataFrame) -> DataFrame:
    """book_id, src of images in chapters that no resource has."""
    used = chapters.select("book_id", F.explode(H.images(F.col("html"))).alias("src")).distinct()
    return used.join(resources.select("book_id", F.col("href").alias("src")), ["book_id", "src"], "left_anti")


def used_resources(chapters: DataFrame, resources: DataFrame, covers: DataFrame) -> DataFrame:
    """Resources that are a cover or in a chapter, numbered from 1: the cover first, then by first use."""
    seen = chapters.select("book_id", "ord", F.posexplode(H.images(F.col("html"))).alias("pos", "href"))
    seen = seen.unionByName(covers.select("book_id", F.lit(-1).alias("ord"), F.lit(0).alias("pos"), "href"))
    first = seen.groupBy("book_id", "href").agg(F.min(F.struct("ord", "pos")).alias("at"))
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("at", "href"))
    return resources.join(first, ["book_id", "href"]).withColumn("number", n).drop("at")


def note_places(chapters: DataFrame, notes: DataFrame) -> DataFrame:
    """notes with chapter_id: the first chapter that refers to the note, else the book's last."""
    refs = chapters.select("book_id", "ord", "chapter_id", F.explode(H.links(F.col("html"))).alias("href")).where(F.col("href").startswith("#"))
    first = refs.groupBy("book_id", F.expr("substring(href, 2)").alias("note_id")).agg(F.min_by("chapter_id", "ord").alias("_first"))
    last = chapters.groupBy("book_id").agg(F.max_by("chapter_id", "ord").alias("_last"))
    out = notes.join(first, ["book_id", "note_id"], "left").join(last, "book_id", "left")
    return out.withColumn("chapter_id", F.coalesce("_first", "_last")).drop("_first", "_last")


def first_definition(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def anchors(links: DataFrame, headings: DataFrame) -> DataFrame:
    """links (book_id, href) with target: the first heading (book_id, ord, title, chapter_id) of that slug;
    without one, href is left as it is."""
    known = first_definition(headings.withColumn("slug", T.slug(F.col("title"))), ["book_id", "slug"], "ord").select("book_id", "slug", F.col("chapter_id").alias("target"))
    return links.withColumn("slug", F.expr("substring(href, 2)")).join(known, ["book_id", "slug"], "left").drop("slug")


def ranged(positions: DataFrame, parts: DataFrame, step: int) -> DataFrame:
    """positions (book_id, pos) with part_id and the offset within it: the first part (book_id, part_id, start, stop)
    with start <= pos < stop. Ranges are cut at every step-th position, so the join is on equal keys."""
    cells = parts.select("book_id", "part_id", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.col("stop") - 1) / step))).alias("_cell"))
    p = positions.withColumn("_cell", F.floor(F.col("pos") / step))
    hits = p.join(cells.where("start < stop"), ["book_id", "_cell"], "left").where(F.col("start").isNull() | ((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop"))))
    best = hits.groupBy(*positions.columns).agg(F.min(F.struct("start", "part_id")).alias("_b"))
    return best.select(*positions.columns, F.col("_b.part_id").alias("part_id"), (F.col("pos") - F.col("_b.start")).alias("offset"))


def covers(books: DataFrame, resources: DataFrame) -> DataFrame:
    """book_id, rid of the cover: the resource marked as the cover image, else the one named in the metadata."""
    r = resources.where(F.col("mime").startswith("image/"))
    marked = r.where(F.array_contains("properties", "cover-image")).groupBy("book_id").agg(F.min_by("rid", "ord").alias("_marked"))
    named = books.join(r.select("book_id", F.col("rid").alias("_named")), [books.book_id == r.book_id, books.cover_meta == F.col("_named")], "left").select(books.book_id, "_named")
    return named.join(marked, "book_id", "left").select("book_id", F.coalesce("_marked", "_named").alias("rid"))
