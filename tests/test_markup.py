import html.parser

import pytest
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import markup as m
from quire.functions import text as T
from quire.plans.queries import QUERIES

CASES = [
    ("<p>a &amp; b</p>", "<p>a &amp; b</p>", "a & b"), ("x &copy; y", "x &amp;copy; y", "x &copy; y"), ("&#65;&#x42;&#1114112;", "AB&amp;#1114112;", "AB&#1114112;"),
    ("<!-- a > b --><b>c</b>", "<b>c</b>", "c"), ("<p onclick='x' style=y id=k>t</p>", '<p id="k">t</p>', "t"), ("<script>a<b></script>c", "c", "c"),
    ("<style><style></style>x</style>y", "y", "y"), ("<font>f</font>", "f", "f"), ("<p/>a", "<p>a", "a"), ("a<br>b<br/>c", "a<br />b<br />c", "a\nb\nc"),
    ("a < b <> c", "a &lt; b &lt;&gt; c", "a < b <> c"), ("t <unclosed", "t &lt;unclosed", "t <unclosed"), ("<meta charset=x>gone", "", ""), ("<head><meta x></head>kept", "kept", "kept"),
    ("<ruby>漢<rt>かん</rt></ruby>", "<ruby>漢<rt>かん</rt></ruby>", "漢かん"), ("<a href='q' target=_x>l</a>", '<a href="q">l</a>', "l"), ("<img src=a.png onerror=x>", '<img src="a.png" />', ""),
    ("<td title=t colspan=2>c</td>", '<td colspan="2">c</td>', "c"), ('<p id="&gt;">a</p>', '<p id="&gt;">a</p>', "a"), ("a &nbsp; b　", "a   b　", "a b"),
    ("<li>a</li><li>b</li><p></p><p></p>c", "<li>a</li><li>b</li><p></p><p></p>c", "a\nb\n\nc"),
]


@pytest.mark.parametrize("given,clean,plain", CASES)
def test_cases(given, clean, plain):
    assert m.sanitize(given) == clean and m.plain_text(given) == plain


@pytest.mark.parametrize("given", [c[1] for c in CASES])
def test_sanitized_is_stable(given):
    if "copy" not in given and "1114112" not in given:
        assert m.sanitize(m.sanitize(given)) == m.sanitize(given)


class Second(html.parser.HTMLParser):
    """Another sanitiser, for well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.skip = [], []

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag == self.skip[0]:
                self.skip.append(tag)
        elif tag in m.DROPPED:
            self.skip.append(tag)
        elif tag in m.ALLOWED:
            self.out.append(m.tag_text(tag, [(k, v or "") for k, v in attrs if m.allowed(tag, k)], tag in m.VOID))

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[0]:
                self.skip.pop()
        elif tag in m.ALLOWED and tag not in m.VOID:
            self.out.append(f"</{tag}>")

    def text(self, raw):
        if not self.skip:
            self.out.append(m.escape_text(m.decode_entities(raw)))

    def handle_data(self, data):
        self.text(data)

    def handle_entityref(self, name):
        self.text(f"&{name};")

    def handle_charref(self, name):
        self.text(f"&#{name};")


def test_sanitiser_on_pages(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    pages = {r.page_id: r.html for r in table.collect()}
    for r in table.select("page_id", m.sanitize_column(F.col("html")).alias("html")).collect():
        p = Second()
        p.feed(pages[r.page_id])
        p.close()
        assert r.html == "".join(p.out)


def test_expression_equals_state_machine(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("html", H.plain_text(F.col("html")).alias("plain"), H.character_count(F.col("html")).alias("n"), H.tags_in(F.col("html")).alias("tags")).collect()
    for r in rows:
        assert r.plain == m.plain_text(r.html) and r.n == m.character_count(r.html)
        assert set(r.tags) == {t[1] for t in m.tokens(r.html) if t[0] != "text"}


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, "𠮟a", T.utf16_length) == 3 and one(spark, "　﻿a ", T.trim) == "a"
    assert one(spark, "他说。」好 3.14 a. b!", T.sentences) == ["他说。」", "好 3.14 a. ", "b!"] and one(spark, "", T.bad_score) == 1
    assert one(spark, "Ａ b-c d!", T.slug) == "ａ-b-c-d" and one(spark, "d/e/文.TXT", T.extension) == "txt" and one(spark, "d/文.a.txt", T.stem) == "文.a"
    assert one(spark, "text/a/b.html", lambda c: T.resolve_path(c, F.lit("../img/./x.png"))) == "text/img/x.png"
    assert one(spark, "Ｔ: a/b", lambda c: T.file_base(c, F.lit(3))) == "Ｔ-ab" and one(spark, "???", lambda c: T.file_base(c, F.lit(3))) == "chapter-0003"
    assert one(spark, "b/x.txt", lambda c: T.output_name(c, F.lit("t"), F.lit("kepub"))) == "x（t）.kepub.epub"
    assert one(spark, "漢字", lambda c: T.has_rare_kanji(c, "漢字")) is False and one(spark, "漢鬱", lambda c: T.has_rare_kanji(c, "漢")) is True
    assert one(spark, '<p class="a noteref b">x</p>', lambda c: H.without_class(c, "noteref")) == '<p class="a b">x</p>'
    assert one(spark, "FFD8FF00", lambda c: T.mime_by_content(F.unhex(c))) == "image/jpeg" and one(spark, "x", lambda c: T.mime_by_content(F.encode(c, "UTF-8"))) is None


def test_xml():
    x = m.xml('<?xml v?><a:b x="1" p:y="&lt;2"><c><![CDATA[<d>]]>&amp;e</c><f/></a:b>')
    b = x.first("b")
    assert b.get("x") == "1" and b.get("y") == "<2" == b.get("p:y") and b.first("c").text == "<d>&e" and b.first("f").children == []


def test_rewritten():
    change = lambda tag, a: None if tag == "a" else "" if tag == "img" else a
    assert m.rewritten('<p><a href="x">t</a><img src="y" />u</p>', change) == "<p>tu</p>"


def test_outermost_elements():
    from quire.functions.markup import xml

    root = xml('<a><b id="1"><b id="2"/></b><c><b id="3"/></c></a>')
    assert [n.get("id") for n in root.all("b")] == ["1", "3"]


def test_plain_text_of_columns_is_that_of_the_state_machine(spark, sf):
    from pyspark.sql import functions as F

    from quire.functions import html as H
    from quire.functions.markup import character_count, plain_text

    texts = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()] + [
        "&#20013;&#x6587;&AMP;&lt;b&gt;&amp;lt;&#1114112;&#xD800;&nope;&#99999999999999999999;", "a<!-- open", "<embed src=x>gone</embed>a", "<script>x", "<p>a<br>b<BR/>c</p>\n\n\n\nd", "1 < 2 &#x1F600;", "<style/>kept", "",
    ]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", H.plain_text(F.col("x")).alias("p"), H.character_count(F.col("x")).alias("n")).collect()
    for r in got:
        assert (r.p, r.n) == (plain_text(texts[r.i]), character_count(texts[r.i])), texts[r.i][:80]


def test_size_labels_between_two_decimals_equal_sql(spark, tmp_path):
    import duckdb

    from quire.plans.queries import SQL

    con = duckdb.connect()
    keys = (512, 1471246, 1489008, 2125452, 3737808, 8528760)  # 1.75 MB and 4.25 MB
    con.execute(f"CREATE VIEW orders AS SELECT unnest({list(keys)})::BIGINT AS o_orderkey")
    con.execute(f"COPY (FROM orders) TO '{tmp_path}/orders.parquet'")
    want = con.execute(f"SELECT o_orderkey, size, label FROM ({SQL['size_labels']}) ORDER BY 1").fetchall()
    got = QUERIES["size_labels"](spark, str(tmp_path)).orderBy("o_orderkey").collect()
    assert [(r.o_orderkey, r.size, r.label) for r in got] == want and want[1][1] == 4456448
