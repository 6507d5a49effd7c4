"""Tables of the document model. Order is explicit (`ord`, `seq`); a tree is an adjacency list."""

BOOKS = (
    "book_id string, src_path string, title string, author string, language string, identifier string, "
    "publisher string, date string, description string, writing_mode string, cover_rid string"
)
CHAPTERS = "book_id string, ord int, chapter_id string, title string, level int, html string"
RESOURCES = "book_id string, ord int, rid string, href string, mime string, data binary"
NAV = (
    "book_id string, node_id string, parent_id string, depth int, sib_ord int, pre_ord int, "
    "title string, target string, anchor string, level int"
)
NOTES = "book_id string, ord int, note_id string, html string"
WARNINGS = "book_id string, seq int, code string, detail string"
FAILURES = "src_path string, stage string, message string"

UNTITLED = "未命名"
LANGUAGE = "zh-Hans"
HORIZONTAL, VERTICAL = "horizontal-tb", "vertical-rl"

#: Fixed values of the restricted HTML that chapters and notes hold.
ALLOWED_TAGS = (
    "h1", "h2", "h3", "h4", "h5", "h6", "p", "div", "span", "em", "strong", "i", "b", "u", "s", "ruby", "rt", "rp",
    "img", "figure", "figcaption", "blockquote", "pre", "code", "ul", "ol", "li", "dl", "dt", "dd",
    "table", "thead", "tbody", "tr", "th", "td", "a", "br", "hr", "sup", "sub",
)
DROPPED_TAGS = ("script", "style", "link", "meta", "iframe", "object", "embed", "head", "title")
VOID_TAGS = ("img", "br", "hr")
GLOBAL_ATTRIBUTES = ("id", "class", "lang", "dir")
TAG_ATTRIBUTES = {"a": ("href",), "img": ("src", "alt", "width", "height"), "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan")}
