"""Queries over the joins, trees and checks of the document model, on rows made of the test tables: an order or a
conversation is a book, its items or turns are chapters, pages' links are references. The SQL is written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import nav, references, segment
from quire.operators.validate import errors, verdicts
from quire.plans.registry import query, t

# Spine, manifest, entries

ITEMS = "SELECT l_orderkey AS book_id, l_linenumber AS ord, 'p' || l_partkey AS idref FROM lineitem"
MANIFEST = "SELECT DISTINCT l_orderkey AS book_id, 'p' || l_partkey AS id, 'text/' || l_partkey || '.xhtml' AS href FROM lineitem WHERE l_partkey % 5 <> 0"


def spine_rows(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("ord"), "l_partkey")
    items = rows.select("book_id", "ord", F.concat(F.lit("p"), "l_partkey").alias("idref"))
    known = rows.where("l_partkey % 5 <> 0").select("book_id", F.concat(F.lit("p"), "l_partkey").alias("id"), F.concat(F.lit("text/"), "l_partkey", F.lit(".xhtml")).alias("href"))
    return references.spine(items, known.distinct())


@query(f"SELECT i.book_id, i.ord, i.idref, m.href FROM ({ITEMS}) i JOIN ({MANIFEST}) m ON m.book_id = i.book_id AND m.id = i.idref")
def spine_items(spark, sf):
    return spine_rows(spark, sf)[0].select("book_id", "ord", "idref", "href")


@query(f"SELECT i.book_id, i.ord AS seq, 'epub.broken-spine-item' AS code, i.idref AS detail FROM ({ITEMS}) i WHERE NOT EXISTS (SELECT 1 FROM ({MANIFEST}) m WHERE m.book_id = i.book_id AND m.id = i.idref)")
def broken_spine_items(spark, sf):
    return spine_rows(spark, sf)[1]


PATHS = "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS book_id, regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1) AS path, page_id FROM pages"


@query(f"""WITH p AS ({PATHS}), e AS (SELECT book_id, CASE WHEN page_id % 2 = 0 THEN upper(path) ELSE path END AS entry, page_id AS ord FROM p
UNION ALL SELECT book_id, CASE WHEN page_id % 3 = 0 THEN path ELSE path || '?' END, page_id + 1000000 FROM p),
w AS (SELECT DISTINCT book_id, path FROM p UNION SELECT DISTINCT book_id, path || '#none' FROM p WHERE page_id % 7 = 0)
SELECT w.book_id, w.path, (SELECT entry FROM e WHERE e.book_id = w.book_id AND lower(e.entry) = lower(w.path) ORDER BY entry <> w.path, ord LIMIT 1) AS entry FROM w""")
def entries_by_path(spark, sf):
    """Archive entries by their path, else by one that differs in case only."""
    p = t(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("book_id"), F.regexp_extract("url", "^[a-z]+://[^/]+(/.*)$", 1).alias("path"), "page_id")
    entry = p.select("book_id", F.when(F.col("page_id") % 2 == 0, F.upper("path")).otherwise(F.col("path")).alias("path"), F.col("page_id").alias("ord"))
    other = p.select("book_id", F.when(F.col("page_id") % 3 == 0, F.col("path")).otherwise(F.concat("path", F.lit("?"))).alias("path"), (F.col("page_id") + 1000000).alias("ord"))
    wanted = p.select("book_id", "path").unionByName(p.where("page_id % 7 = 0").select("book_id", F.concat("path", F.lit("#none")).alias("path"))).distinct()
    return references.by_path(wanted, entry.unionByName(other)).select("book_id", "path", "entry")


# Images, covers, notes

IMAGES = "SELECT conv_id AS book_id, turn, 'img/' || (turn * 3 % 11) || '.png' AS href, conv_id FROM conversations"


def illustrated(spark, sf) -> tuple[DataFrame, DataFrame]:
    """chapters with an image, and one they share; and resources of which some are missing."""
    c = t(spark, sf, "conversations")
    html = F.concat(F.lit('<p><img src="img/'), F.col("turn") * 3 % 11, F.lit('.png" alt=""/>x<img class="c" src="img/10.png" /></p>'))
    chapters = c.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("ord"), F.col("turn").alias("chapter_id"), html.alias("html"))
    resources = c.select(F.col("conv_id").alias("book_id")).distinct().select("book_id", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("n"))
    return chapters, resources.where("n <> 6").select("book_id", F.concat(F.lit("img/"), "n", F.lit(".png")).alias("href"))


@query(f"SELECT DISTINCT book_id, href AS src FROM ({IMAGES}) WHERE href IN ('img/0.png', 'img/6.png')")
def missing_images(spark, sf):
    return references.missing_images(*illustrated(spark, sf))


@query(f"SELECT book_id, count(DISTINCT href) AS missing FROM ({IMAGES}) WHERE href IN ('img/0.png', 'img/6.png') GROUP BY 1")
def missing_image_counts(spark, sf):
    return references.missing_images(*illustrated(spark, sf)).groupBy("book_id").agg(F.count("*").alias("missing"))


@query(f"""WITH s AS (SELECT book_id, turn AS ord, 0 AS pos, href FROM ({IMAGES}) UNION ALL SELECT book_id, turn, 1, 'img/10.png' FROM ({IMAGES})
UNION ALL SELECT DISTINCT conv_id, -1, 0, 'img/9.png' FROM conversations WHERE conv_id % 2 = 0),
f AS (SELECT book_id, href, min((ord, pos)) AS first FROM s WHERE href NOT IN ('img/0.png', 'img/6.png') GROUP BY 1, 2)
SELECT book_id, href, row_number() OVER (PARTITION BY book_id ORDER BY first)::INT AS number FROM f""")
def used_resources(spark, sf):
    """Resources in use: the cover, then images by their first use; those without use are left out."""
    chapters, resources = illustrated(spark, sf)
    covers = chapters.where("book_id % 2 = 0").select("book_id", F.lit("img/9.png").alias("href")).distinct()
    return references.used_resources(chapters, resources, covers).select("book_id", "href", "number")


@query("""SELECT conv_id AS book_id, CASE WHEN conv_id % 3 = 0 THEN 'r2' WHEN conv_id % 3 = 1 THEN 'r1' END AS rid FROM (SELECT DISTINCT conv_id FROM conversations)""")
def cover_resources(spark, sf):
    """The resource marked as cover, else the one that the metadata names, images only."""
    b = t(spark, sf, "conversations").select(F.col("conv_id").alias("book_id")).distinct()
    books = b.withColumn("cover_meta", F.when(F.col("book_id") % 3 == 1, "r1").otherwise("r4"))
    properties = F.when((F.col("book_id") % 3 == 0) & F.col("n").isin(2, 3), F.array(F.lit("x"), F.lit("cover-image"))).otherwise(F.array().cast("array<string>"))
    rows = b.select("book_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n"))
    mime = F.when(F.col("n") == 4, "text/css").otherwise("image/png")
    resources = rows.select("book_id", F.col("n").alias("ord"), F.concat(F.lit("r"), "n").alias("rid"), mime.alias("mime"), properties.alias("properties"))
    return references.covers(books, resources)


HEADINGS = "SELECT conv_id AS book_id, turn AS ord, role || ' ' || (turn % 4) || '!' AS title FROM conversations"


@query(f"""WITH h AS ({HEADINGS}), s AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') AS slug FROM h)
SELECT c.conv_id AS book_id, '#' || lower(role) || '-' || (turn % 6) AS href,
(SELECT min(ord) FROM s WHERE s.book_id = c.conv_id AND rtrim(s.slug, '-') = lower(role) || '-' || (c.turn % 6)) AS target FROM conversations c""")
def anchor_targets(spark, sf):
    """Links to headings by their slugs; of equal ones the first counts."""
    c = t(spark, sf, "conversations").withColumn("book_id", F.col("conv_id"))
    headings = c.select("book_id", F.col("turn").alias("ord"), F.concat("role", F.lit(" "), F.col("turn") % 4, F.lit("!")).alias("title"), F.col("turn").alias("chapter_id"))
    links = c.select("book_id", F.concat(F.lit("#"), F.lower("role"), F.lit("-"), F.col("turn") % 6).alias("href"))
    return references.anchors(links, headings)


@query("""SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1""")
def first_definitions(spark, sf):
    return references.first_definition(t(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


# Navigation

TREE = """SELECT conv_id::VARCHAR AS book_id, turn, CASE WHEN turn % 7 = 0 THEN 1 WHEN turn % 3 = 0 THEN 2 ELSE 3 END AS level FROM conversations"""
PARENTS = f"""t AS ({TREE}), p AS (SELECT book_id, turn, (SELECT max(u.turn) FROM t u WHERE u.book_id = t.book_id AND u.turn < t.turn AND u.level < t.level) AS parent FROM t)"""


def turn_tree(spark, sf) -> DataFrame:
    """Navigation (with path) of conversations, levels from the turns' numbers."""
    level = F.when(F.col("turn") % 7 == 0, 1).when(F.col("turn") % 3 == 0, 2).otherwise(3)
    rows = t(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").alias("ord"), level.alias("level"))
    tree = nav.tree_from_levels(rows, "book_id")
    return nav.preorder(tree.select("book_id", F.col("ord").cast("string").alias("node_id"), F.col("parent").cast("string").alias("parent_id"), F.col("ord").alias("sib_ord"), F.col("ord").cast("string").alias("target")))


@query(f"""WITH RECURSIVE {PARENTS}, up AS (SELECT book_id, turn, parent AS anc FROM p WHERE turn % 4 <> 1
UNION ALL SELECT up.book_id, up.turn, p.parent FROM up JOIN p ON p.book_id = up.book_id AND p.turn = up.anc WHERE up.anc % 4 = 1)
SELECT book_id, turn::VARCHAR AS node_id, max(anc) FILTER (anc % 4 <> 1)::VARCHAR AS parent_id FROM up GROUP BY 1, 2""")
def promoted_nav(spark, sf):
    """Entries without target go; their children move to the nearest ancestor that stays."""
    tree = turn_tree(spark, sf)
    targets = tree.where("cast(target AS int) % 4 <> 1").select("book_id", "target")
    return nav.promoted(tree, targets).select("book_id", "node_id", "parent_id")


@query(f"""WITH RECURSIVE {PARENTS}, d AS (SELECT book_id, turn, 1 AS depth FROM p WHERE parent IS NULL
UNION ALL SELECT p.book_id, p.turn, d.depth + 1 FROM p JOIN d ON d.book_id = p.book_id AND d.turn = p.parent)
SELECT book_id, (turn % 5)::VARCHAR AS target, least(3, min(depth))::INT AS level FROM d WHERE turn % 2 = 0 GROUP BY 1, 2""")
def chapter_levels(spark, sf):
    """The least depth of a chapter's entries without anchor, 1 to 3."""
    tree = turn_tree(spark, sf)
    n = F.col("node_id").cast("int")
    rows = tree.select("book_id", (n % 5).cast("string").alias("target"), "depth", F.when(n % 2 == 1, "x").when(n % 4 == 0, "").alias("anchor"))
    return nav.chapter_levels(rows)


@query("""SELECT conv_id AS book_id, 'n' || row_number() OVER w AS node_id, row_number() OVER w ::INT AS pre_ord, role AS title, turn AS target FROM conversations WHERE turn % 3 <> 0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def flat_navigation(spark, sf):
    """An entry for each titled chapter."""
    c = t(spark, sf, "conversations")
    chapters = c.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("ord"), F.col("turn").alias("chapter_id"), F.when(F.col("turn") % 3 != 0, F.col("role")).alias("title"), F.lit(1).alias("level"))
    return nav.flat_nav(chapters).select("book_id", "node_id", "pre_ord", "title", "target")


@query("""SELECT l_orderkey AS book_id, l_linenumber AS ord, 'img' || printf('%03d', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)) AS rid FROM lineitem""")
def numbered_ids(spark, sf):
    """Ids by running number within a book."""
    rows = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("ord"))
    return rows.withColumn("rid", nav.numbered("img", F.col("ord"), "book_id", width=3))


# Layout

LAYOUT = """SELECT o_custkey AS book_id, 1 + r // 4 AS page, r AS pos, 700.0 - 13.0 * r - (CASE WHEN r % 5 = 2 THEN 15.0 WHEN r % 11 = 7 AND o_custkey % 2 = 0 THEN 40.0 ELSE 0.0 END) AS y,
CASE WHEN r % 7 = 3 THEN 74.0 ELSE 50.0 END AS x0, 10.0 AS font FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r FROM orders)"""


@query(f"""WITH l AS ({LAYOUT}), a AS (SELECT *, lag(y) OVER w - y AS gap, lag(page) OVER w AS prev, min(x0) OVER (PARTITION BY book_id, page) AS margin FROM l WINDOW w AS (PARTITION BY book_id ORDER BY pos)),
b AS (SELECT *, prev = page AND gap >= 3.2 * 1.3 * font AS wide, prev = page AND gap >= 1.8 * 1.3 * font AS broad FROM a),
c AS (SELECT *, bool_or(coalesce(wide, false)) OVER (PARTITION BY book_id) AS any_wide FROM b),
d AS (SELECT *, (prev IS NULL OR coalesce(broad, false) OR x0 - margin > 1.2 * font OR (NOT any_wide AND (prev - 1) // 20 <> (page - 1) // 20))::INT AS start FROM c)
SELECT book_id, page, pos, sum(start) OVER w ::INT AS para, (CASE WHEN any_wide THEN sum(coalesce(wide, false)::INT) OVER w ELSE (page - 1) // 20 END)::INT AS chapter
FROM d WINDOW w AS (PARTITION BY book_id ORDER BY pos ROWS UNBOUNDED PRECEDING)""")
def page_paragraphs(spark, sf):
    """Lines of pages to paragraphs and chapters, by gaps and indents."""
    r = F.row_number().over(_by("o_custkey", "o_orderkey")) - 1
    rows = t(spark, sf, "orders").select(F.col("o_custkey").alias("book_id"), r.cast("long").alias("pos"))
    p = F.col("pos")
    extra = F.when(p % 5 == 2, 15.0).when((p % 11 == 7) & (F.col("book_id") % 2 == 0), 40.0).otherwise(0.0)
    lines = rows.select("book_id", (F.floor(p / 4) + 1).alias("page"), "pos", (F.lit(700.0) - 13.0 * p - extra).alias("y"), F.when(p % 7 == 3, 74.0).otherwise(50.0).alias("x0"), F.lit(10.0).alias("font"))
    return segment.page_paragraphs(lines).select("book_id", "page", "pos", "para", "chapter")


def _by(key: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order)


@query(f"SELECT book_id, page, min(x0) AS margin, max(font) AS font FROM ({LAYOUT}) GROUP BY 1, 2")
def page_margins(spark, sf):
    r = F.row_number().over(_by("o_custkey", "o_orderkey")) - 1
    rows = t(spark, sf, "orders").select(F.col("o_custkey").alias("book_id"), (F.floor(r / 4) + 1).alias("page"), F.when(r % 7 == 3, 74.0).otherwise(50.0).alias("x0"), F.lit(10.0).alias("font"))
    return rows.groupBy("book_id", "page").agg(F.min("x0").alias("margin"), F.max("font").alias("font"))


@query(r"""WITH p AS (SELECT doc_id, string_split_regex(regexp_replace(text, '(The |Der )', chr(1) || '\1', 'g'), chr(1)) AS x FROM documents),
q AS (SELECT doc_id, unnest(x) AS text, generate_subscripts(x, 1) - 1 AS k, len(x) AS n FROM p)
SELECT doc_id, (k - CASE WHEN lead THEN 1 ELSE 0 END)::INT AS section, text FROM
(SELECT *, bool_or(k = 0 AND text = '') OVER (PARTITION BY doc_id) AND n > 1 AS lead FROM q) WHERE NOT (k = 0 AND text = '' AND n > 1) AND (trim(text, ' ' || chr(9) || chr(10)) <> '' OR n = 1)""")
def heading_sections(spark, sf):
    """Texts cut before every match of a pattern."""
    return segment.heading_sections(t(spark, sf, "documents"), "The |Der ")


# Checks

FAULTY = """b AS (SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'T' END AS title, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'en' END AS language,
CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'u' END AS identifier, CASE WHEN o_orderkey % 13 = 0 THEN 'diagonal' WHEN o_orderkey % 2 = 0 THEN 'vertical-rl' ELSE 'horizontal-tb' END AS mode FROM orders),
e AS (SELECT id, 1 AS check_no, 'title' AS "check", title AS detail FROM b WHERE trim(coalesce(title, '')) = ''
UNION ALL SELECT id, 2, 'language', language FROM b WHERE language = '' UNION ALL SELECT id, 3, 'identifier', identifier FROM b WHERE identifier IS NULL
UNION ALL SELECT id, 4, 'writing mode', mode FROM b WHERE mode = 'diagonal' UNION ALL SELECT id, 5, 'resource', 'r1' FROM b WHERE id % 5 IN (0, 1, 2)
UNION ALL SELECT id, 6, 'cover', 'r9' FROM b WHERE id % 3 = 0 UNION ALL SELECT id, 7, 'no chapter', NULL FROM b WHERE id % 17 = 0
UNION ALL SELECT id, 11, 'image address', 'https://a/b.png' FROM b WHERE id % 17 <> 0 AND id % 4 = 1 UNION ALL SELECT id, 11, 'image address', 'data:image/png;base64,AA' FROM b WHERE id % 17 <> 0 AND id % 4 = 2
UNION ALL SELECT id, 12, 'image unknown', 'c.png' FROM b WHERE id % 17 <> 0 AND id % 4 = 3 UNION ALL SELECT id, 12, 'image unknown', 'a.png' FROM b WHERE id % 17 <> 0 AND id % 4 = 0 AND id % 5 = 0
UNION ALL SELECT id, 13, 'note unknown', 'n2' FROM b WHERE id % 17 <> 0 AND id % 6 = 5)"""


def faulty(spark, sf) -> tuple[DataFrame, DataFrame]:
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("book_id"))
    i = F.col("book_id")
    mode = F.when(i % 13 == 0, "diagonal").when(i % 2 == 0, "vertical-rl").otherwise("horizontal-tb")
    books = o.select(
        "book_id", F.when(i % 9 == 0, F.lit(None)).when(i % 9 == 1, " ").otherwise("T").alias("title"), F.when(i % 7 == 0, "").otherwise("en").alias("language"),
        F.when(i % 11 != 0, "u").alias("identifier"), mode.alias("writing_mode"), F.when(i % 3 == 0, "r9").when(i % 3 == 1, "r1").alias("cover_rid"),
    )
    resources = o.select(
        "book_id", F.lit("r1").alias("rid"), F.when(i % 5 != 0, "a.png").alias("href"), F.when(i % 5 != 1, "image/png").alias("mime"), F.when(i % 5 != 2, F.lit(b"x")).alias("data"),
    )
    src = F.element_at(F.array(*map(F.lit, ("a.png", "https://a/b.png", "data:image/png;base64,AA", "c.png"))), (i % 4 + 1).cast("int"))
    note = F.when(i % 6 == 5, '<a class="x noteref" href="#n2">2</a>').otherwise('<a href="#n1" class="noteref">1</a>')
    html = F.concat(F.lit('<p>x<img src="'), src, F.lit('" /></p>'), note)
    chapters = o.where("book_id % 17 <> 0").select("book_id", F.lit(1).alias("ord"), F.lit("c1").alias("chapter_id"), F.lit(1).alias("level"), html.alias("html"))
    notes = o.select("book_id", F.lit("n1").alias("note_id"))
    nav_rows = chapters.select("book_id", F.col("chapter_id").alias("target"))
    return books, errors(books, chapters, nav_rows, notes, resources)


@query(f"""WITH {FAULTY} SELECT id AS book_id, check_no, "check", detail FROM e""")
def book_faults(spark, sf):
    return faulty(spark, sf)[1]


@query(f"""WITH {FAULTY}, g AS (SELECT id, string_agg("check" || coalesce(': ' || detail, ''), '|' ORDER BY check_no, "check" || coalesce(': ' || detail, '')) AS errors FROM e GROUP BY 1)
SELECT b.id AS book_id, g.id IS NULL AS ok, coalesce(errors, '') AS errors FROM b LEFT JOIN g ON g.id = b.id""")
def book_verdicts(spark, sf):
    """Whether a book is whole, and all that is wrong with it, in the order of the checks."""
    return verdicts(*faulty(spark, sf)).select("book_id", "ok", F.array_join("errors", "|").alias("errors"))


@query("SELECT page_id, CASE WHEN href LIKE '%..%' THEN 'x' ELSE href END AS href, regexp_replace('OPS/text' || '/' || href, '//+', '/', 'g') AS path FROM (SELECT page_id, 'p/' || page_id || '.html' AS href FROM pages)")
def joined_paths(spark, sf):
    href = F.concat(F.lit("p/"), "page_id", F.lit(".html"))
    return t(spark, sf, "pages").select("page_id", href.alias("href"), T.resolve_path(F.lit("OPS/text/c.xhtml"), href).alias("path"))
