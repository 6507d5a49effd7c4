"""Secret scans with a trigram inverted index (DataFrame functions only).

Each rule's regular expression gives a Boolean trigram query (`trigrams`). The index has a posting (trigram,
doc_id) for each trigram that a rule asks for and a document holds; postings of a document meet by doc_id,
are merged on the map side into a bit set, and the rules' queries intersect them. Only rules whose query holds are
verified on a document, by their regular expression, over the whole text; rules without mandatory trigrams
(`hex`) scan every text.

Texts meet the candidates by doc_id, but only those whose doc_id is in a bitmap of the candidates' hashed ids move for that;
all others are scanned where they are, by the rules without mandatory trigrams. The bitmap has BITS_A_KEY bits for each candidate and
MOST_BITS (32 MB) at most; beyond that more texts move, with equal results.

Positions come from the pieces between matches, whose lengths are added up, in code points.

Defined cases: a null text counts as empty; rows with a null doc_id aren't in the index and are scanned by every rule; rows that repeat a doc_id share
postings, which can only add candidates; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import trigrams
from quire.llm.common import stored, table


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and don't overlap; those whose group has fewer than `least` characters are dropped."""

    kind: str
    regex: str
    group: int
    least: int
    base: bool = True


KEYWORDS = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), f"{either_case('api')}_?{either_case('key')}"])
RULES = (
    Rule("assign", rf"({KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, False),
)
#: Equal to the rule's matches that are long enough, and cheaper: a run is matched whole or not at all.
FASTER = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
STEP = 256
BITS_A_KEY = 16
MOST_BITS = 1 << 28
BITMAP_BITS = 1 << 15  # fixed value: of one of Spark's bitmaps


def postings(docs: DataFrame, queries: list, grams: list[str]) -> DataFrame:
    """gram, doc_id: the inverted index, of the trigrams that the rules ask for. A conjunction's rarest trigram is looked for in
    every lower-cased text, its others only where that one was found: without it their postings decide nothing."""
    low = docs.where("doc_id IS NOT NULL").select("doc_id", F.lower("text").alias("low"))
    leads: dict[str, set[str] | None] = {}
    for q in queries:
        for conjunction in trigrams.conjunctions(q):
            lead = trigrams.rarest(conjunction)
            for g in conjunction:
                leads.setdefault(g, set()).add(lead)
    first = [g for g in grams if g in leads[g]]
    low = low.select("*", *[F.contains("low", F.lit(g)).alias(f"g{grams.index(g)}") for g in first])
    found = lambda g: F.col(f"g{grams.index(g)}")
    later = lambda g: reduce(Column.__or__, map(found, sorted(leads[g]))) & F.contains("low", F.lit(g))
    held = F.array(*[F.when(found(g) if g in first else later(g), F.lit(i)) for i, g in enumerate(grams)])
    return low.select("doc_id", F.explode(F.array_compact(held)).alias("gram"))


def holds(q, grams: list[str], bits: list[Column]) -> Column:
    if q is True:
        return F.lit(True)
    if isinstance(q, str):
        i = grams.index(q)
        return bits[i // 62].bitwiseAND(F.lit(1 << (i % 62)).cast("long")) != 0
    out = None
    for x in q[1]:
        own = holds(x, grams, bits)
        out = own if out is None else out & own if q[0] == "and" else out | own
    return out


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, and a boolean for each rule with mandatory trigrams: its postings intersect in the document."""
    asked = {r.kind: q for r in rules if (q := trigrams.query(r.regex)) is not True}
    grams = sorted(set().union(*map(trigrams.trigrams, asked.values())))
    words = range((len(grams) + 61) // 62)
    one = lambda w: F.when((F.col("gram") >= 62 * w) & (F.col("gram") < 62 * w + 62), F.expr(f"shiftleft(1L, gram - {62 * w})")).otherwise(F.lit(0).cast("long"))
    sets = postings(docs, list(asked.values()), grams).groupBy("doc_id").agg(*[F.bit_or(one(w)).alias(f"w{w}") for w in words])
    bits = [F.col(f"w{w}") for w in words]
    found = sets.select(F.col("doc_id").alias("_id"), *[holds(q, grams, bits).alias(f"may_{k}") for k, q in asked.items()])
    any_rule = None
    for k in asked:
        any_rule = F.col(f"may_{k}") if any_rule is None else any_rule | F.col(f"may_{k}")
    return found.where(any_rule)


def running(lengths: Column) -> Column:
    """Sums of the first 0, 1, ... elements; in steps, so that a long array costs little more than its length."""
    add = lambda xs, first: F.aggregate(xs, F.array(first), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    zero = F.lit(0).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STEP).cast("int")), lambda b: F.slice(lengths, b * STEP + 1, STEP))
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, x: s + x))
    inner = F.flatten(F.zip_with(blocks, add(sums, zero), lambda b, first: F.when(b.isNotNull(), F.slice(add(b, first), 1, F.size(b))).otherwise(F.array().cast("array<bigint>"))))
    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(inner)


def spans(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start,number,end,kind>> of the rule's matches that are long enough."""
    regex = F.lit(FASTER.get(rule.kind, rule.regex))
    found = F.regexp_extract_all(text, regex, 0)
    size = lambda xs: F.transform(xs, lambda x: F.length(x).cast("long"))
    pieces = size(F.split(text, FASTER.get(rule.kind, rule.regex), -1))
    both = F.zip_with(F.slice(pieces, 1, F.size(found)), size(found), lambda p, m: p + m)
    starts = F.zip_with(running(both), pieces, lambda s, p: s + p)
    values = found if rule.group == 0 else F.regexp_extract_all(text, regex, rule.group)
    made = F.transform(
        F.arrays_zip(F.slice(starts, 1, F.size(found)).alias("s"), size(found).alias("m"), size(values).alias("v")),
        lambda z: F.struct(z["s"].alias("start"), F.lit(number).alias("number"), (z["s"] + z["m"]).alias("end"), F.lit(rule.kind).alias("kind"), z["v"].alias("size")),
    )
    kept = F.filter(made, lambda z: z["size"] >= rule.least)
    none = F.array().cast("array<struct<start:bigint,number:int,end:bigint,kind:string,size:bigint>>")
    return F.when(F.regexp_like(text, regex), kept).otherwise(none)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda z: F.concat_ws(":", z["kind"], z["start"].cast("string"), z["end"].cast("string"))), ",")


def bitmap(ids: Column, bits: int) -> tuple[Column, Column]:
    """The number of the bitmap, and the position in it, of hashed ids."""
    at = F.pmod(F.xxhash64(ids, F.lit("bitmap")), F.lit(bits).cast("long"))
    return F.floor(at / BITMAP_BITS), F.pmod(at, F.lit(BITMAP_BITS).cast("long"))


def near(rows: DataFrame, found: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """rows with a column _near: doc_id may be among the _id of found."""
    wanted = BITS_A_KEY * found.count()
    bits = min(most_bits, max(BITMAP_BITS, 1 << wanted.bit_length()))
    number, place = bitmap(F.col("_id"), bits)
    maps = found.select(number.alias("_map"), place.alias("p")).groupBy("_map").agg(F.bitmap_construct_agg("p").alias("_bits"))
    number, place = bitmap(F.col("doc_id"), bits)
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_place") / 8).cast("int") + 1, 1)), 16, 10).cast("long")
    set_ = F.call_function("getbit", byte, F.pmod("_place", F.lit(8)).cast("int")) == 1
    both = rows.withColumns({"_map": number, "_place": place}).join(F.broadcast(maps), "_map", "left")
    return both.withColumn("_near", F.col("doc_id").isNotNull() & F.coalesce(set_, F.lit(False))).drop("_map", "_place", "_bits")


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES, most_bits: int = MOST_BITS) -> DataFrame:
    """docs and a column _spans: array<struct<start,number,end,kind,size>> by start, then rule."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = stored(candidates(docs.select("doc_id", text.alias("text")), rules), "secret-candidates")
    rows = near(docs.withColumn("_text", text), found, most_bits)
    none = F.array().cast("array<struct<start:bigint,number:int,end:bigint,kind:string,size:bigint>>")
    indexed = [c.removeprefix("may_") for c in found.columns if c.startswith("may_")]
    own = {r.kind: spans(F.col("_text"), r, n) for n, r in enumerate(rules)}
    every = lambda may: F.array_sort(F.concat(*[F.when(may(k), x).otherwise(none) if k in indexed else x for k, x in own.items()]))
    there = rows.where("_near").join(found, F.col("doc_id") == F.col("_id"), "left").withColumn("_spans", every(lambda k: F.col(f"may_{k}")))
    here = rows.where("NOT _near").withColumn("_spans", every(lambda k: F.col("doc_id").isNull()))
    return there.select(*docs.columns, "_spans").unionByName(here.select(*docs.columns, "_spans"))


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scanned(narrow, rules).select("doc_id", "_spans")
    base = F.filter("_spans", lambda z: z["number"].isin([n for n, r in enumerate(rules) if r.base]))
    of = lambda n: F.size(F.filter("_spans", lambda z: z["number"] == n)).cast("long")
    counts = [of(n).alias(f"n_{r.kind}") for n, r in enumerate(rules) if r.base]
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret (overlapping spans together) replaced by [kind], n_chars made to fit."""
    rows = scanned(docs, rules)
    kind = "array<struct<start:bigint,end:bigint,kind:string>>"
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    merged = F.aggregate(
        "_spans", F.array().cast(kind),
        lambda acc, z: F.when(
            (F.size(acc) > 0) & (z["start"] < last(acc)["end"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], z["end"]).alias("end"), last(acc)["kind"].alias("kind")))),
        ).otherwise(F.array_append(acc, F.struct(z["start"].alias("start"), z["end"].alias("end"), z["kind"].alias("kind")))),
    )
    rows = rows.withColumn("_cuts", merged)
    before = F.concat(F.array(F.lit(0).cast("long")), F.transform("_cuts", lambda z: z["end"]))
    parts = F.zip_with(F.slice(before, 1, F.size("_cuts")), F.col("_cuts"), lambda b, z: F.concat(F.substring(F.col("text"), (b + 1).cast("int"), (z["start"] - b).cast("int")), F.lit("["), z["kind"], F.lit("]")))
    tail = F.substring(F.col("text"), (F.element_at(before, -1) + 1).cast("int"), F.length("text"))
    text = F.when(F.size("_cuts") == 0, F.col("text")).otherwise(F.concat(F.array_join(parts, ""), tail))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size("_cuts") == 0, F.col("n_chars")).otherwise(F.length("text")))
    return rows.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    parts = []
    for n, r in enumerate(rules):
        p = "'" + r.regex.replace('\\"', '"').replace("'", "''") + "'"
        parts.append(f"""SELECT doc_id, {n} AS number, '{r.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i:
  {{'start': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
    'size': length(m[i]), 'value': length(v[i])}})) AS z, {r.least} AS least, {r.base} AS base
FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {r.group}) AS v, string_split_regex(t, {p}) AS p
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE regexp_matches(t, {p}))""")
    union = "\nUNION ALL\n".join(parts)
    counts = ", ".join(f"count(*) FILTER (number = {n} AND f.doc_id IS NOT NULL)::BIGINT AS n_{r.kind}" for n, r in enumerate(rules) if r.base)
    line = "kind || ':' || start || ':' || stop"
    return f"""WITH s AS ({union}),
f AS (SELECT doc_id, number, kind, base, z.start::BIGINT AS start, (z.start + z.size)::BIGINT AS stop FROM s WHERE z.value >= least)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({line}, ',' ORDER BY start, number) FILTER (base), '')) AS base_sha256,
       coalesce(string_agg({line}, ',' ORDER BY start, number), '') AS spans
FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id"""


SQL = sql()
