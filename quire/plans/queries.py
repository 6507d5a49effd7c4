"""One query for each operator that can run over the test tables, and the same in SQL.

Tables stand in for the model where it has no data of its own: pages for chapters, documents for plain texts,
conversations for books (turns are chapters, roles titles), events for lines of a layout, lineitem for positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import text as T
from quire.operators import nav, notices, references, segment
from quire.plans.registry import QUERIES, SQL, query, quoted, t
from quire.schema import ALLOWED_TAGS, DROPPED_TAGS

# SQL pieces

SP = T.SPACE_RE2


def sql_replace(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {by if by.startswith('chr') else quoted(by)}, 'g')"


def sql_trim(x: str) -> str:
    return sql_replace(x, f"^[{SP}]+|[{SP}]+$", "")


#: Plain text by hand, step by step: what the functions' own tables say isn't used here.
ENTITY = "&(?:#[xX][0-9A-Fa-f]+|#[0-9]+|[A-Za-z]+);"
DECODED = r"""CASE WHEN regexp_matches(r, '^&#[xX]0*[0-9A-Fa-f]{1,6};$') AND ('0x' || r[4:-2])::BIGINT < 1114112 THEN chr(('0x' || r[4:-2])::INT)
WHEN regexp_matches(r, '^&#0*[0-9]{1,7};$') AND r[3:-2]::BIGINT < 1114112 THEN chr(r[3:-2]::INT)
WHEN lower(r) = '&amp;' THEN '&' WHEN lower(r) = '&lt;' THEN '<' WHEN lower(r) = '&gt;' THEN '>' WHEN lower(r) = '&quot;' THEN '"'
WHEN lower(r) = '&apos;' THEN '''' WHEN lower(r) = '&nbsp;' THEN chr(160) ELSE r END"""
DROPPED_RE2 = "|".join(rf"<{x}(?:\s(?:[^>]*[^/>])?)?>.*?(?:</{x}\s*>|\z)" for x in "script style link meta iframe object embed head title".split())


def sql_decoded(x: str) -> str:
    pieces, found = f"string_split_regex({x}, '{ENTITY}')", f"list_transform(regexp_extract_all({x}, '{ENTITY}'), lambda r: {DECODED})"
    return f"array_to_string(list_transform(list_zip({pieces}, {found}), lambda z: z[1] || coalesce(z[2], '')), '')"


def sql_plain(table: str, key: str, html: str = "html") -> str:
    """(SELECT key, plain ...): one step a sub-query, so that none is written out twice."""
    return rf"""(WITH a AS (SELECT {key}, regexp_replace(regexp_replace({html}, '(?s)<!--.*?(?:-->|\z)', '', 'g'), '(?is){DROPPED_RE2}', '', 'g') AS x FROM {table}),
b AS (SELECT {key}, regexp_replace(regexp_replace(x, '<[!?][^>]*>', '', 'g'), '(?i)<br(?:\s[^>]*)?/?>|</(?:p|div|li|h[1-6]|blockquote|tr|figcaption|dd|dt)\s*>', chr(10), 'g') AS x FROM a),
c AS (SELECT {key}, regexp_replace(x, '</?[A-Za-z][^>]*>', '', 'g') AS x FROM b),
d AS (SELECT {key}, {sql_decoded('x')} AS x FROM c),
e AS (SELECT {key}, regexp_replace(regexp_replace(x, '[ \t\x{{00A0}}]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM d)
SELECT {key}, {sql_trim('x')} AS plain FROM e)"""


#: Pages with what real ones hold besides: references by number and name, an embedded object, a comment without end.
RICH = """(SELECT page_id, url, html || '<p>&#' || (20013 + page_id % 900) || ';&#x' || printf('%X', 128512 + page_id % 50) || ';&AMP;&lt;b&gt;&amp;lt; &nbsp;&unknown;&#1114112;</p>'
|| CASE page_id % 4 WHEN 0 THEN '<embed src="x">gone</embed>a' WHEN 1 THEN '<BR class="x"/>b<!-- open' WHEN 2 THEN '<title/>c' ELSE '<script>var x = "</p>"' END AS html FROM pages)"""


def rich_pages(spark, sf) -> DataFrame:
    i, p = F.col("page_id"), t(spark, sf, "pages")
    more = F.concat(F.lit("<p>&#"), (i % 900 + 20013).cast("string"), F.lit(";&#x"), F.hex(i % 50 + 128512), F.lit(";&AMP;&lt;b&gt;&amp;lt; &nbsp;&unknown;&#1114112;</p>"))
    ends = ('<embed src="x">gone</embed>a', '<BR class="x"/>b<!-- open', "<title/>c", '<script>var x = "</p>"')
    end = F.element_at(F.array(*map(F.lit, ends)), (i % 4 + 1).cast("int"))
    return p.select("page_id", "url", F.concat("html", more, end).alias("html"))


def sql_tags(x: str) -> str:
    bare = sql_replace(x, r"(?s)<!--.*?-->", "")
    return f"list_distinct(list_transform(regexp_extract_all({bare}, '</?([A-Za-z][A-Za-z0-9]*)', 1), lambda z: lower(z)))"


def sql_heading(x: str) -> str:
    inner = f"regexp_extract({x}, '(?is)<h[1-6](?:\\s[^>]*)?>(.*?)</h[1-6]\\s*>', 1)"
    return f"nullif({sql_trim(sql_replace(inner, '<[^>]*>', ''))}, '')"


LINKS = r"""regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*"([^">]*)"', 1)"""
EXTERNAL = "^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)"
LINES = r"unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) - 1 AS pos"
HEAD = f"regexp_matches(line, '^[{SP}]*(?:{T.HEADING})(?:[{SP}]|$)')"
ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


# HTML


@query(f"SELECT page_id, plain FROM {sql_plain(RICH, 'page_id')}")
def plain_text(spark, sf):
    return rich_pages(spark, sf).select("page_id", H.plain_text(F.col("html")).alias("plain"))


UNITS = r"(2 * length(x) - length(regexp_replace(x, '[\x{10000}-\x{10FFFF}]', '', 'g')))"


@query(f"SELECT page_id, {UNITS}::BIGINT AS chars FROM (SELECT page_id, {sql_replace('plain', f'[{SP}]+', '')} AS x FROM {sql_plain(RICH, 'page_id')})")
def character_counts(spark, sf):
    return rich_pages(spark, sf).select("page_id", H.character_count(F.col("html")).alias("chars"))


@query(f"""SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS pages, sum({UNITS})::BIGINT AS chars
FROM (SELECT page_id, {sql_replace('plain', f'[{SP}]+', '')} AS x FROM {sql_plain(RICH, 'page_id')}) JOIN pages USING (page_id) GROUP BY 1""")
def characters_per_book(spark, sf):
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return rich_pages(spark, sf).groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.sum(H.character_count(F.col("html"))).alias("chars"))


@query(f"SELECT page_id, unnest({sql_tags('html')}) AS tag FROM pages")
def distinct_tags(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.explode(H.tags_in(F.col("html"))).alias("tag"))


@query(f"SELECT * FROM (SELECT page_id, unnest({sql_tags('html')}) AS tag FROM pages) WHERE tag NOT IN ({', '.join(map(quoted, ALLOWED_TAGS))})")
def illegal_tags(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.explode(H.illegal_tags(F.col("html"))).alias("tag"))


@query(f"SELECT tag, count(*) AS pages FROM (SELECT unnest({sql_tags('html')}) AS tag FROM pages) WHERE tag IN ({', '.join(map(quoted, DROPPED_TAGS))}) GROUP BY 1")
def dropped_tags(spark, sf):
    return t(spark, sf, "pages").select(F.explode(H.dropped_tags(F.col("html"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("pages"))


@query(f"SELECT page_id, {sql_heading('html')} AS heading FROM pages")
def first_heading(spark, sf):
    return t(spark, sf, "pages").select("page_id", H.first_heading(F.col("html")).alias("heading"))


@query(f"""SELECT page_id, title, coalesce({sql_heading('html')} = {sql_trim('title')}, false) AS present
FROM (SELECT page_id, html, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages)""")
def title_is_heading(spark, sf):
    title = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    p = t(spark, sf, "pages").select("page_id", "html", title.alias("title"))
    return p.select("page_id", "title", H.title_is_heading(F.col("html"), F.col("title")).alias("present"))


CLASS = f"CASE WHEN {sql_trim('href')} = '' THEN 'drop' WHEN regexp_matches(href, '{EXTERNAL}') THEN 'external' WHEN starts_with(href, '#') THEN 'same' ELSE 'cross' END"


@query(f"SELECT page_id, {CLASS} AS class, count(*) AS n FROM (SELECT page_id, unnest({LINKS}) AS href FROM pages) GROUP BY 1, 2")
def link_classes(spark, sf):
    links = t(spark, sf, "pages").select("page_id", F.explode(H.links(F.col("html"))).alias("href"))
    return links.groupBy("page_id", H.link_class(F.col("href")).alias("class")).agg(F.count("*").alias("n"))


@query(f"""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest({LINKS}) AS href FROM pages) l
WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE regexp_extract(p.url, '^[a-z]+://[^/]+(/.*)$', 1) = l.href OR p.url = l.href) GROUP BY 1, 2""")
def links_without_target(spark, sf):
    pages = t(spark, sf, "pages")
    links = pages.select("page_id", F.explode(H.links(F.col("html"))).alias("href"))
    path = F.regexp_extract("url", "^[a-z]+://[^/]+(/.*)$", 1)
    known = pages.select(F.explode(F.array("url", path)).alias("href")).distinct()
    return links.join(known, "href", "left_anti").groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(f"""SELECT href, arg_min(page_id, page_id) AS first_page, count(*) AS refs FROM (SELECT page_id, unnest({LINKS}) AS href FROM pages) GROUP BY 1""")
def first_reference(spark, sf):
    links = t(spark, sf, "pages").select("page_id", F.explode(H.links(F.col("html"))).alias("href"))
    return links.groupBy("href").agg(F.min_by("page_id", "page_id").alias("first_page"), F.count("*").alias("refs"))


@query("""SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<body(?:\\s[^>]*)?>.*</body\\s*>')
THEN regexp_extract(html, '(?is)<body(?:\\s[^>]*)?>(.*)</body\\s*>', 1) ELSE html END AS body FROM pages""")
def bodies(spark, sf):
    return t(spark, sf, "pages").select("page_id", H.body(F.col("html")).alias("body"))


# Plain text

CHAPTERS = f"""WITH l AS (SELECT doc_id, pos, {sql_trim('line')} AS line, {HEAD} AS head FROM (SELECT doc_id, {LINES} FROM documents)),
g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM l WHERE line <> ''),
a AS (SELECT doc_id, grp, max(CASE WHEN head THEN line END) AS title,
      string_agg(CASE WHEN NOT head THEN '<p>' || {ESCAPED.format('line')} || '</p>' END, chr(10) ORDER BY pos) AS html FROM g GROUP BY 1, 2),
e AS (SELECT doc_id, grp, title, coalesce(html, '') AS html FROM a UNION ALL
      SELECT doc_id, 0, NULL, '' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = d.doc_id))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp)::INT AS ord, title, html FROM e"""


@query(CHAPTERS)
def txt_chapters(spark, sf):
    return segment.txt_chapters(t(spark, sf, "documents")).select("doc_id", "ord", "title", "html")


@query(f"""SELECT doc_id, count(*) AS lines, count(*) FILTER ({sql_trim('line')} = '') AS blank, count(*) FILTER ({HEAD}) AS headings
FROM (SELECT doc_id, {LINES} FROM documents) GROUP BY 1""")
def line_counts(spark, sf):
    rows = segment.lines(t(spark, sf, "documents"))
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.count_if(T.trim(F.col("line")) == "").alias("blank"), F.count_if(T.is_heading(F.col("line"))).alias("headings")
    )


SENTENCES = rf"""string_split(regexp_replace(text, '([{T.ENDERS}][{T.CLOSERS.replace("'", "''")}]*|[.!?](?:[{SP}]+|\z))', '\1' || chr(1), 'g'), chr(1))"""


@query(f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT AS seq, sentence FROM
(SELECT doc_id, unnest({SENTENCES}) AS sentence, generate_subscripts({SENTENCES}, 1) AS pos FROM documents) WHERE sentence <> ''""")
def sentences(spark, sf):
    return segment.sentence_rows(t(spark, sf, "documents"))


@query(f"SELECT conv_id, turn, len(list_filter({SENTENCES}, lambda x: x <> ''))::INT AS sentences FROM conversations")
def sentence_counts(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", F.size(T.sentences(F.col("text"))).alias("sentences"))


@query(f"SELECT doc_id, round(CASE WHEN text = '' THEN 1.0 ELSE (length(text) - length({sql_replace('text', f'[{T.BAD_RE2}]', '')})) / length(text) END, 9) AS score FROM documents")
def bad_scores(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.round(T.bad_score(F.col("text")), 9).alias("score"))


@query(f"SELECT conv_id, string_agg(CASE WHEN {sql_trim('text')} <> '' THEN role || chr(10) || chr(10) || {sql_trim('text')} END, chr(10) || chr(10) ORDER BY turn) AS txt FROM conversations GROUP BY 1")
def chapters_to_txt(spark, sf):
    rows = t(spark, sf, "conversations").withColumn("plain", T.trim(F.col("text"))).where("plain <> ''")
    return rows.groupBy("conv_id").agg(segment.joined(F.concat_ws("\n\n", "role", "plain"), F.col("turn"), "\n\n").alias("txt"))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) // 20 AS bucket, length(line) AS n FROM (SELECT doc_id, " + LINES + " FROM documents) QUALIFY true")
def page_buckets(spark, sf):
    rows = segment.lines(t(spark, sf, "documents"))
    return rows.select("doc_id", segment.buckets(F.col("pos") + 1).cast("long").alias("bucket"), F.length("line").cast("long").alias("n"))


@query("""SELECT user_id, grp, count(*) AS events, min(ts) AS first_ts FROM (
SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM (
SELECT user_id, ts, event_id, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 3600 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY 1, 2""")
def gap_groups(spark, sf):
    """An analogue, over events, of paragraphs cut at gaps."""
    e = t(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id").withColumn("at", F.struct("ts", "event_id"))
    gap = F.unix_micros(F.col("ts")) - F.unix_micros(F.col("prev_at.ts")) >= 3_600_000_000
    rows = segment.gap_groups(e, "user_id", "at", gap, "grp")
    return rows.groupBy("user_id", "grp").agg(F.count("*").alias("events"), F.min("ts").cast("timestamp_ntz").alias("first_ts"))


@query("""SELECT l_orderkey, l_linenumber, (l_partkey // 37)::BIGINT AS part_id, (l_partkey % 37)::BIGINT AS "offset" FROM lineitem""")
def range_lookup(spark, sf):
    """An analogue, over parts of 37 keys, of positions looked up in ranges."""
    items = t(spark, sf, "lineitem").select(F.lit(1).alias("book_id"), F.col("l_partkey").cast("long").alias("pos"), "l_orderkey", "l_linenumber")
    top = t(spark, sf, "part").agg(F.max("p_partkey").alias("most"))
    ids = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("most") / 37))).alias("part_id"))
    parts = ids.select(F.lit(1).alias("book_id"), "part_id", (F.col("part_id") * 37).alias("start"), (F.col("part_id") * 37 + 37).alias("stop"))
    keys = items.select("book_id", "pos").distinct()
    found = references.ranged(keys, parts, 100)
    return items.join(found, ["book_id", "pos"]).select("l_orderkey", "l_linenumber", "part_id", "offset")


LEVELS = f"(SELECT doc_id, pos AS ord, (length(line) % 3 + 1)::INT AS level FROM (SELECT doc_id, {LINES} FROM documents))"


@query(f"""WITH r AS {LEVELS}, p AS (SELECT doc_id, ord, level, (SELECT max(q.ord) FROM r q WHERE q.doc_id = r.doc_id AND q.ord < r.ord AND q.level < r.level) AS parent FROM r)
SELECT doc_id, ord::INT AS ord, level, parent::INT AS parent FROM p""")
def level_tree(spark, sf):
    """Trees from levels; lines stand in for headings, their lengths for levels."""
    rows = segment.lines(t(spark, sf, "documents")).select("doc_id", F.col("pos").alias("ord"), (F.length("line") % 3 + 1).alias("level"))
    return nav.tree_from_levels(rows, "doc_id").select("doc_id", "ord", "level", "parent")


CODES = ", ".join(f"({quoted(c)}, {quoted(s)})" for s, cs in notices.SENTENCES.items() for c in cs)
NAMES = [c for cs in notices.SENTENCES.values() for c in cs] + ["other.code"]
PICK = "CASE doc_id % " + str(len(NAMES)) + " " + " ".join(f"WHEN {i} THEN {quoted(c)}" for i, c in enumerate(NAMES)) + " END"


def warning_rows(spark, sf):
    names = F.array(*[F.lit(n) for n in NAMES])
    d = t(spark, sf, "documents").select("source", "doc_id")
    return d.select(F.col("source").alias("book_id"), F.col("doc_id").alias("seq"), F.element_at(names, (F.col("doc_id") % len(NAMES) + 1).cast("int")).alias("code"), (F.col("doc_id") % 7).cast("string").alias("detail"))


@query(f"SELECT source AS book_id, {PICK} AS code, (doc_id % 7)::VARCHAR AS detail, min(doc_id) AS seq FROM documents GROUP BY 1, 2, 3")
def warnings_once(spark, sf):
    return notices.deduplicated(warning_rows(spark, sf))


@query(f"""SELECT source AS book_id, coalesce(m.sentence, {quoted(notices.FALLBACK)}) AS sentence, min(doc_id) AS seq
FROM documents d LEFT JOIN (VALUES {CODES}) m(code, sentence) ON m.code = {PICK} GROUP BY 1, 2""")
def notes_once(spark, sf):
    return notices.notes(warning_rows(spark, sf))


@query("""SELECT source, CASE WHEN count(*) > 5 THEN array_to_string(list(doc_id::VARCHAR ORDER BY doc_id)[1:5], ', ') || ' (' || count(*) || ' in all)'
ELSE string_agg(doc_id::VARCHAR, ', ' ORDER BY doc_id) END AS shown FROM documents GROUP BY 1""")
def first_few(spark, sf):
    return notices.first_few(t(spark, sf, "documents"), "source", F.col("doc_id"), "doc_id")


@query("""SELECT page_id, url, lower(regexp_extract(url, '\\.([^./\\\\]+)$', 1)) AS ext, regexp_replace(regexp_replace(url, '^.*[/\\\\]', ''), '\\.[^.]*$', '') AS stem,
regexp_matches(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)') AS external FROM pages""")
def path_parts(spark, sf):
    u = F.col("url")
    return t(spark, sf, "pages").select("page_id", "url", T.extension(u).alias("ext"), T.stem(u).alias("stem"), T.is_external(u).alias("external"))


@query("""SELECT page_id, 'data:text/html;base64,' || base64(encode(html)) AS uri FROM pages""")
def data_uris(spark, sf):
    return t(spark, sf, "pages").select("page_id", T.data_uri(F.lit("text/html"), F.encode("html", "UTF-8")).alias("uri"))


@query(f"SELECT doc_id, {ESCAPED.format('text')} AS escaped FROM documents")
def escaped_text(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.escape_text(F.col("text")).alias("escaped"))


TAG_NAME = "lower(regexp_extract(k, '^</?([A-Za-z][A-Za-z0-9]*)', 1))"
MAY_STAY = """'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'p', 'div', 'span', 'em', 'strong', 'i', 'b', 'u', 's', 'ruby', 'rt', 'rp', 'img', 'figure', 'figcaption', 'blockquote', 'pre', 'code',
'ul', 'ol', 'li', 'dl', 'dt', 'dd', 'table', 'thead', 'tbody', 'tr', 'th', 'td', 'a', 'br', 'hr', 'sup', 'sub'"""
ATTRIBUTES = r"""array_to_string(list_transform(list_filter(regexp_extract_all(k, '\s([A-Za-z-]+="[^"]*")', 1), lambda a: split_part(lower(a), '=', 1) IN ('id', 'class', 'lang', 'dir')
OR ({n} = 'a' AND starts_with(lower(a), 'href=')) OR ({n} = 'img' AND split_part(lower(a), '=', 1) IN ('src', 'alt', 'width', 'height')) OR ({n} IN ('td', 'th') AND split_part(lower(a), '=', 1) IN ('colspan', 'rowspan'))),
lambda a: ' ' || lower(split_part(a, '=', 1)) || substr(a, strpos(a, '='))), '')""".replace("{n}", TAG_NAME)
CLEAN = f"""CASE WHEN regexp_matches(k, '^</[A-Za-z]') THEN CASE WHEN {TAG_NAME} IN ({MAY_STAY}) AND {TAG_NAME} NOT IN ('img', 'br', 'hr') THEN '</' || {TAG_NAME} || '>' ELSE '' END
WHEN regexp_matches(k, '^<[A-Za-z]') THEN CASE WHEN {TAG_NAME} IN ({MAY_STAY}) THEN '<' || {TAG_NAME} || {ATTRIBUTES} || CASE WHEN {TAG_NAME} IN ('img', 'br', 'hr') THEN ' /' ELSE '' END || '>' ELSE '' END
ELSE {ESCAPED.format(sql_decoded('k'))} END"""


@query(rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g'), '(?is){DROPPED_RE2}', '', 'g') AS x FROM {RICH}),
b AS (SELECT page_id, regexp_extract_all(regexp_replace(x, '<[!?][^>]*>', '', 'g'), '<[^>]*>|[^<]+') AS ks FROM a)
SELECT page_id, array_to_string(list_transform(ks, lambda k: {CLEAN}), '') AS html FROM b""")
def sanitized(spark, sf):
    """The sanitiser, a state machine, against steps of regular expressions."""
    from quire.functions.markup import sanitize_column

    return rich_pages(spark, sf).select("page_id", sanitize_column(F.col("html")).alias("html"))


@query("""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS ord, role || ' ' || turn AS title,
CASE WHEN turn % 3 = 0 THEN 1 WHEN EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = c.conv_id AND b.turn < c.turn AND b.turn % 3 = 0) THEN 2 ELSE 1 END::INT AS level
FROM conversations c""")
def books_written_and_read(spark, sf):
    """Conversations as books, written as EPUB and read again."""
    from quire.plans.conversion import conversations_round_trip

    return conversations_round_trip(t(spark, sf, "conversations"))


# Books made of the test tables: a host is a book, its pages are chapters, their links the navigation

PAGES = "SELECT page_id, url, html, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages"


def page_books(spark, sf):
    p = t(spark, sf, "pages").withColumn("book_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1))
    none = F.lit(None).cast("string")
    books = p.select("book_id").distinct().select("book_id", F.col("book_id").alias("title"), F.lit("en").alias("language"), F.col("book_id").alias("identifier"), F.lit("horizontal-tb").alias("writing_mode"), none.alias("cover_rid"))
    chapters = p.select("book_id", F.col("page_id").alias("ord"), F.col("url").alias("chapter_id"), (F.col("page_id") % 5).cast("int").alias("level"), "html")
    nav_rows = p.select("book_id", F.explode(H.links(F.col("html"))).alias("target"))
    return books, chapters, nav_rows


@query(f"""WITH p AS ({PAGES}), tag AS (SELECT host, unnest({sql_tags('html')}) AS tag FROM p),
link AS (SELECT host, unnest({LINKS}) AS href FROM p),
again AS (SELECT host, row_number() OVER (PARTITION BY host, url ORDER BY page_id) AS r FROM p),
e AS (SELECT host, 'tag' AS "check" FROM tag WHERE tag NOT IN ({', '.join(map(quoted, ALLOWED_TAGS))})
UNION ALL SELECT host, 'navigation target' FROM link l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.host = l.host AND p.url = l.href)
UNION ALL SELECT host, 'chapter id twice' FROM again WHERE r > 1
UNION ALL SELECT host, 'level' FROM p WHERE page_id % 5 NOT IN (1, 2, 3))
SELECT host AS book_id, "check", count(*) AS n FROM e GROUP BY 1, 2""")
def validation_errors(spark, sf):
    from quire.operators.validate import errors

    books, chapters, nav_rows = page_books(spark, sf)
    notes = spark.createDataFrame([], "book_id string, note_id string")
    resources = spark.createDataFrame([], "book_id string, rid string, href string, mime string, data binary")
    return errors(books, chapters, nav_rows, notes, resources).groupBy("book_id", "check").agg(F.count("*").alias("n"))


@query("""SELECT conv_id AS book_id, 'n' || k AS note_id, coalesce(min(turn) FILTER (turn % 3 = k), max(turn)) AS turn
FROM conversations, (VALUES (0), (1), (2), (7)) v(k) GROUP BY 1, 2""")
def note_places(spark, sf):
    c = t(spark, sf, "conversations")
    html = F.concat(F.lit('<p>x<a class="noteref" href="#n'), (F.col("turn") % 3).cast("string"), F.lit('">1</a></p>'))
    chapters = c.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("ord"), F.col("turn").alias("chapter_id"), html.alias("html"))
    notes = c.select(F.col("conv_id").alias("book_id")).distinct().select("book_id", F.explode(F.array(*[F.lit(f"n{k}") for k in (0, 1, 2, 7)])).alias("note_id"))
    return references.note_places(chapters, notes).select("book_id", "note_id", F.col("chapter_id").alias("turn"))


@query(f"SELECT doc_id::VARCHAR AS book_id, ord::VARCHAR AS node_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord)::INT AS pre_ord FROM {LEVELS}")
def nav_preorder(spark, sf):
    rows = segment.lines(t(spark, sf, "documents")).select("doc_id", F.col("pos").alias("ord"), (F.length("line") % 3 + 1).alias("level"))
    tree = nav.tree_from_levels(rows, "doc_id")
    own = tree.select(F.col("doc_id").cast("string").alias("book_id"), F.col("ord").cast("string").alias("node_id"), F.col("parent").cast("string").alias("parent_id"), F.col("ord").alias("sib_ord"))
    return nav.preorder(own).select("book_id", "node_id", "pre_ord")


@query("SELECT conv_id AS book_id, max(CASE WHEN turn % 3 = 0 THEN 1 ELSE 2 END)::INT AS depth FROM conversations GROUP BY 1")
def nav_depth(spark, sf):
    c = t(spark, sf, "conversations").select(F.col("conv_id").alias("book_id"), F.when(F.col("turn") % 3 == 0, 1).otherwise(2).alias("depth"))
    return nav.depth(c)


@query("""SELECT doc_id AS book_id, unnest(list_filter(['txt.media-dropped', 'txt.notes-dropped'], lambda x: CASE WHEN x = 'txt.media-dropped' THEN doc_id % 2 = 0 ELSE doc_id % 3 = 0 END)) AS code FROM documents""")
def losses(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("book_id"), (F.col("doc_id") % 2 == 0).alias("has_images"), (F.col("doc_id") % 3 == 0).alias("has_notes"), F.lit(False).alias("has_ruby"))
    return notices.losses(d, "txt")


from quire.plans import format_queries, model_queries, text_queries  # noqa: E402, F401  (registers its queries)
