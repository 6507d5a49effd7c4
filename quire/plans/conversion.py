"""Files to books, books to tables, books to files. A book is one nested row (quire.model.BOOK), so reading, changing
and writing need no shuffle; a file that fails becomes a row with `failure` and stops nothing."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.model import BOOK, BookError, chapter, failed, nav_from_levels, new_book
from quire.operators import notices
from quire.operators.ruby import with_readings
from quire.operators.variants import SCHEMES, TAGS, converted
from quire.schema import HORIZONTAL, VERTICAL
from quire.sinks import epub as epub_sink
from quire.sinks import mobi as mobi_sink
from quire.sinks import texts
from quire.sources import archive, docx, epub, kindle, markdown, plain

OUT = "src_path string, name string, mime string, content binary, notes array<string>, failure string"
RUBY_FORMATS = ("epub", "kepub")
UPRIGHT_FORMATS = ("txt", "mobi")

READERS: dict[str, Callable[[bytes, str], dict]] = {
    "txt": plain.read, "md": markdown.read, "epub": epub.read, "docx": docx.read,
    "mobi": kindle.read_mobi, "azw3": kindle.read_azw3, "azw": kindle.read_azw,
}
WRITERS: dict[str, tuple[str, str, Callable[[dict], bytes]]] = {
    "txt": ("txt", "text/plain", texts.write_txt), "epub": ("epub", "application/epub+zip", epub_sink.write),
    "kepub": ("kepub.epub", "application/epub+zip", epub_sink.write_kepub), "mobi": ("mobi", "application/x-mobipocket-ebook", mobi_sink.write),
    "html": ("html", "text/html", texts.write_html),
}


@dataclass(frozen=True)
class Options:
    """A conversion. writing_mode: keep, or one of the two modes. readings: off, all kanji, or rare ones only, of Japanese
    books in formats that can hold them. tag: of output names; None stands for the scheme's own."""

    output: str = "epub"
    scheme: str = "none"
    writing_mode: str = "keep"
    tag: str | None = ""
    readings: str = "off"

    def __post_init__(self):
        known = self.output in WRITERS and self.scheme in SCHEMES and self.readings in ("off", "all", "rare")
        if not known or self.writing_mode not in ("keep", HORIZONTAL, VERTICAL):
            raise ValueError(f"options that aren't known: {self}")


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def parsed(path: str, content: bytes, first: bool = False) -> list[dict]:
    """The books of one file, or the first of an archive; failures are books too."""
    ext = archive.extension(path)
    try:
        if ext == "zip":
            return archive.read_all(content, path, READERS, first)
        if ext not in READERS:
            raise BookError(f"files of type {ext or 'none'} can't be read")
        return [READERS[ext](content, path)]
    except Exception as e:  # of any file, known or not: it must not stop the others
        return [failed(path, f"{type(e).__name__}: {e}")]


def _rows(batches: Iterable[pa.RecordBatch], schema: pa.Schema, make: Callable[[dict], Iterable[dict]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):  # a book at a time: they may be large
            rows = list(make(batch.slice(i, 1).to_pylist()[0]))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def parsed_files(files: DataFrame, first: bool = False) -> DataFrame:
    """BOOK rows of files (path, content). first: of each archive only its first book."""
    schema = arrow_schema(BOOK)
    return files.select("path", "content").mapInArrow(lambda it: _rows(it, schema, lambda r: parsed(r["path"], r["content"], first)), BOOK)


def of_books(path: Column) -> Column:
    """Files of types that can be read, or that hold books and fail with a reason."""
    return F.lower(path).rlike(rf"\.({'|'.join([*READERS, 'zip', *archive.UNSUPPORTED])})$")


def read_books(spark: SparkSession, path: str, first: bool = False) -> DataFrame:
    """BOOK rows of all files under path; those of types that can't be read are failures, PDF among them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return parsed_files(files.where(of_books(F.col("path"))), first)


def read_layouts(runs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """BOOK rows of text runs (path, page, str, x, y, width, font) as a PDF engine gives them; labels (path, page, title) make
    the navigation. The runs of a file meet in one row."""
    from quire.sources import layout

    schema = arrow_schema(BOOK)
    by = runs.groupBy("path").agg(F.collect_list(F.struct("page", "str", "x", "y", "width", "font")).alias("runs"))
    if labels is not None:
        by = by.join(labels.groupBy("path").agg(F.collect_list(F.struct("page", "title")).alias("labels")), "path", "left")

    def make(r: dict) -> list[dict]:
        pages: list[list[dict]] = [[] for _ in range(max(x["page"] for x in r["runs"]))]
        for x in r["runs"]:
            pages[x["page"] - 1].append(x)
        try:
            return [layout.read(pages, r["path"], {x["page"]: x["title"] for x in r.get("labels") or []})]
        except Exception as e:
            return [failed(r["path"], f"{type(e).__name__}: {e}")]

    return by.mapInArrow(lambda it: _rows(it, schema, make), BOOK)


def mapped(books: DataFrame, change: Callable[[dict], dict] | None = None, prepare: Callable[[], Callable[[dict], dict]] | None = None) -> DataFrame:
    """BOOK rows through change, or through what prepare makes once for each task; failed ones pass."""
    schema = arrow_schema(BOOK)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = change if prepare is None else prepare()
        yield from _rows(it, schema, lambda b: [b if b["failure"] else f(b)])

    return books.mapInArrow(run, BOOK)


def in_mode(books: DataFrame, mode: str) -> DataFrame:
    return books if mode == "keep" else books.withColumn("meta", F.col("meta").withField("writing_mode", F.lit(mode)))


def written(books: DataFrame, options: Options) -> DataFrame:
    """OUT rows: a file for each book."""
    schema = arrow_schema(OUT)
    ext, mime, write = WRITERS[options.output]

    def one(book: dict) -> list[dict]:
        from quire.model import stem

        japanese = (book["meta"]["language"] or "").lower().startswith("ja")
        tag = TAGS.get("none" if japanese else options.scheme, "") if options.tag is None else options.tag
        out = {"src_path": book["src_path"], "name": f"{stem(book['src_path'])}{f'（{tag}）' if tag else ''}.{ext}", "mime": mime, "content": None, "notes": [], "failure": book["failure"]}
        if not out["failure"]:
            try:
                out["content"] = write(book)
                out["notes"] = notices.told([w["code"] for w in [*book["warnings"], *output_warnings(book, options)]])
            except Exception as e:
                out["failure"] = f"{type(e).__name__}: {e}"
        return [out]

    return books.mapInArrow(lambda it: _rows(it, schema, one), OUT)


def output_warnings(book: dict, options: Options) -> list[dict]:
    """What an output can't keep of a book, and what was done otherwise than asked."""
    japanese = (book["meta"]["language"] or "").lower().startswith("ja")
    html = "".join(x["html"] for x in [*book["chapters"], *book["notes"]])
    rows = [
        (japanese and options.scheme != "none", "variants.japanese-kept"), (japanese and options.readings != "off" and options.output not in RUBY_FORMATS, "ruby.format"),
        (book["src_path"].lower().endswith(".azw3"), "azw3.output"),
        (options.output == "txt" and bool(book["resources"] or book["notes"]), "txt.media-dropped"),
        (options.output == "mobi" and bool(re.search(r"<ruby[\s>]", html, re.I)), "mobi.readings-dropped"), (options.output == "mobi" and bool(book["notes"]), "mobi.notes-moved"),
        (book["meta"]["writing_mode"] == VERTICAL and options.output in UPRIGHT_FORMATS, "output.upright"),
    ]
    return [{"code": code, "detail": None} for holds, code in rows if holds]


def convert(books: DataFrame, options: Options, dictionaries: dict | None = None, load_tokenizer: Callable | None = None, common: frozenset[str] | None = None) -> DataFrame:
    """OUT rows: readings first, then variants, then the writing mode. load_tokenizer makes the tokenizer of readings; common:
    the kanji that stay bare where only rare ones are marked."""
    if options.readings != "off" and options.output in RUBY_FORMATS:
        if load_tokenizer is None or (options.readings == "rare" and common is None):
            raise ValueError("readings need a tokenizer, and for rare kanji the common ones")
        books = with_readings(books, load_tokenizer, common if options.readings == "rare" else None)
    return written(in_mode(converted(books, options.scheme, dictionaries or {}), options.writing_mode), options)


# Tables


def tables(books: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of quire.schema. book_id is a hash of the path and the identifier."""
    own = books.withColumn("book_id", F.sha2(F.concat_ws("\u0000", "src_path", "meta.identifier"), 256))
    good = own.where("failure is null")
    meta = ["title", "author", "language", "identifier", "publisher", "date", "description", "writing_mode"]

    def each(column: str) -> DataFrame:
        return good.select("book_id", F.posexplode(column).alias("pos", "x")).select("book_id", (F.col("pos") + 1).cast("int").alias("ord"), "x.*")

    nav = each("nav").withColumnsRenamed({"id": "node_id", "parent": "parent_id"})
    sib = F.row_number().over(Window.partitionBy("book_id", "parent_id").orderBy("ord"))
    return {
        "books": good.select("book_id", "src_path", *[f"meta.{m}" for m in meta], F.col("cover").alias("cover_rid")),
        "chapters": each("chapters").withColumnRenamed("id", "chapter_id"),
        "resources": each("resources").withColumnRenamed("id", "rid"),
        "nav": nav.withColumn("sib_ord", sib).withColumnRenamed("ord", "pre_ord"),
        "notes": each("notes").withColumnRenamed("id", "note_id"),
        "warnings": notices.deduplicated(each("warnings").withColumnRenamed("ord", "seq")),
        "failures": own.where("failure is not null").select("src_path", F.lit("read").alias("stage"), F.col("failure").alias("message")),
    }


# A query over the test tables


def conversation_books(rows: DataFrame) -> DataFrame:
    """A BOOK row for each conversation; a turn is a chapter. Turns of a conversation meet in one row."""
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    schema = arrow_schema(BOOK)

    def make(r: dict) -> list[dict]:
        from quire.functions.markup import escape_text

        book = new_book(f"conversation-{r['conv_id']}.txt", title=f"Conversation {r['conv_id']}", language="en")
        for x in r["turns"]:
            lines = [line for line in (x["text"] or "").split("\n") if line.strip()]
            chapter(book, f"{x['role']} {x['turn']}", "\n".join(f"<p>{escape_text(line)}</p>" for line in lines), 1 if x["turn"] % 3 == 0 else 2)
        nav_from_levels(book)
        return [book]

    return turns.mapInArrow(lambda it: _rows(it, schema, make), BOOK)


def conversations_round_trip(rows: DataFrame) -> DataFrame:
    """conv_id, chapters, titles, chars of conversations that were written as EPUB and read again."""
    files = written(conversation_books(rows), Options("epub")).select(F.col("name").alias("path"), "content")
    books = parsed_files(files)
    own = books.select(F.regexp_extract("src_path", r"(\d+)", 1).cast("long").alias("conv_id"), F.posexplode("chapters").alias("pos", "c"))
    return own.select("conv_id", F.col("pos").alias("ord"), F.col("c.title").alias("title"), F.col("c.level").alias("level"))
