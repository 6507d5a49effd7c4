"""Language identification by language-bitmask n-gram filters.

A Bloom filter is kept for each language, bit-sliced: slot i holds a mask with a bit for each language, so k
look-ups give all languages that contain an n-gram. A document's n-grams are looked up at once; for each language the
share found, corrected for the filter's false positives, decides.

n-grams are of N letters and word boundaries: letters are lower-cased, and whatever stands between them is one
boundary. A language contains an n-gram if it is frequent enough in it (LEAST, SHARE).

The filters are learned from a bounded sample, of about SAMPLE documents a language, chosen by a hash of doc_id among
the rows that may be learned from. What is collected and broadcast has SLOTS x languages bits.

A filtering stage (`accepted`) rejects a text without letters, and one whose best language holds too few of its
n-grams: it is in no language that was learned. Too few are less than KNOWN, or than half of what all but a hundredth of
one half of the sample have in a model of the other half, if that is less: with little to learn from, little is rejected. Texts of fewer than ENOUGH n-grams are too short
to be rejected so.

Defined cases: null texts and texts without letters are `und` with score 0; texts with no n-gram of a language get the
most frequent language and its share; null languages and doc_ids are never learned from; repeated rows are
separate rows; an empty table gives no rows; with nothing to learn from, all is `und`; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import sliced_batches, table

N = 4
HASHES = 2
SLOTS = 1 << 20
SAMPLE = 4000
LEAST = 4
SHARE = 0.2
KNOWN = 0.2
ENOUGH = 12
CHUNK = 1 << 20
BATCH_ROWS = 1000
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """filters: a mask of languages for each slot, in words of 64 languages."""

    languages: tuple[str, ...]
    filters: np.ndarray
    false_positives: np.ndarray
    most: int
    prior: float
    least_share: float = KNOWN


_FOLD: list[np.ndarray] = []


def fold() -> np.ndarray:
    """Of each code point: the lower-cased letter, or 32."""
    if not _FOLD:
        out = np.full(0x110000, 32, np.uint32)
        for i, c in enumerate(map(chr, range(0x110000))):
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _FOLD.append(out)
    return _FOLD[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, one text after the other; their number, and that of letters, in each text."""
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    code = np.frombuffer("".join(f"\n{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    folded = fold()[code]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    letter = folded != 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a boundary counts after a letter, and at the start of a text
    keep[starts] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    c = folded[keep].astype(np.uint32)
    letters = np.add.reduceat(letter, starts, dtype=np.int64)
    n = max(0, len(c) - N + 1)
    h = np.zeros(n, np.uint32)
    for i in range(N):
        h *= np.uint32(0x9E3779B1)
        h ^= c[i : i + n]
        h += np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(13)
    counts = np.maximum(0, at[ends] - at[starts] - N + 1)
    own = np.ones(n, bool)  # without those that reach into the next text
    for e in at[ends[:-1]]:
        own[max(0, e - N + 1) : e] = False
    return h[own], counts, letters


def slots(h: np.ndarray, k: int) -> np.ndarray:
    return (h * np.uint32((0x2545F491, 0xB5297A4D, 0x68E31DA5)[k % 3] + 2 * (k // 3))) >> np.uint32(32 - (SLOTS.bit_length() - 1))


def trainable(docs: DataFrame) -> Column:
    """crc32(doc_id as text) mod 3 isn't 1; text and lang are known."""
    return (F.crc32(F.col("doc_id").cast("string")) % 3 != 1) & F.col("text").isNotNull() & F.col("lang").isNotNull()


def counted(docs: DataFrame) -> DataFrame:
    """lang, gram, n of docs (lang, text)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_batches(batches, BATCH_ROWS):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for part in chunks(texts):
                    g, n = np.unique(grams(part)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """Lists of texts, CHUNK characters or one text at most; no text is cut."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > CHUNK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def sliced(kept: DataFrame, number: dict[str, int]) -> DataFrame:
    """word, slot, mask: the slots that are set by kept (gram, langs), languages by their numbers, 64 a word."""

    def set_bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().astype(np.uint32)
            i = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            word, mask = i // 64, (np.uint64(1) << (i % 64).astype(np.uint64)).view(np.int64)
            for k in range(HASHES):
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(slots(h, k).astype(np.int64)), pa.array(mask)], names=["word", "slot", "mask"])

    rows = kept.select("gram", F.explode("langs").alias("lang"))
    return rows.mapInArrow(set_bits, "word long, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))


def sampled(docs: DataFrame, sample: int) -> tuple[DataFrame, dict[str, int]]:
    """text, lang, half of the sample of docs (doc_id, text, lang), and the rows of each language that it is from."""
    own = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(trainable(docs))
    known = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    chosen = F.lit(False)
    for lang, n in known.items():
        cut = min(1.0, sample / n)
        chosen = chosen | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(cut * (1 << 30))))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    return own.where(chosen).repartition(8, "doc_id").select("text", "lang", half.alias("half")), known


def learned(docs: DataFrame, sample: int = SAMPLE, least: int = LEAST, share: float = SHARE) -> Model:
    """A model of docs (doc_id, text, lang), from the rows that may be learned from."""
    return model_of(*sampled(docs, sample), least, share)


def model_of(rows: DataFrame, known: dict[str, int], least: int = LEAST, share: float = SHARE) -> Model:
    languages = tuple(sorted(known))
    words = max(1, -(-len(languages) // 64))
    filters = np.zeros((words, SLOTS), np.uint64)
    if not languages:
        return Model((), filters, np.zeros(0), 0, 0.0)
    counts = counted(rows)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("n") >= least)
    entries = rated.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("lang", "rate")).alias("by"))
    kept = entries.select("gram", F.transform(F.filter("by", lambda x: x["rate"] >= share * F.col("most")), lambda x: x["lang"]).alias("langs"))
    made = sliced(kept, {lang: i for i, lang in enumerate(languages)}).toArrow()  # SLOTS rows for 64 languages at most
    word, slot, mask = (made.column(i).to_numpy() for i in range(3))
    filters[word, slot] = mask.view(np.uint64)
    fill = np.array([((filters[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    most = max(languages, key=lambda x: (known[x], x))
    return Model(languages, filters, fill**HASHES, languages.index(most), known[most] / sum(known.values()))


def shares(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: the corrected share of its n-grams in each language, and the numbers of its n-grams and letters."""
    h, counts, letters = grams(texts)
    out = np.zeros((len(texts), len(model.languages)))
    ends = np.cumsum(counts)
    at = [slots(h, k) for k in range(HASHES)]
    for w in range(len(model.filters)):
        masks = model.filters[w][at[0]]
        for s in at[1:]:
            masks &= model.filters[w][s]
        for i in range(64 * w, min(64 * w + 64, len(model.languages))):
            ones = (masks >> masks.dtype.type(i % 64)) & masks.dtype.type(1)
            sums = np.concatenate(([0], np.cumsum(ones, dtype=np.int64)))
            out[:, i] = sums[ends] - sums[ends - counts]
    out /= np.maximum(counts, 1)[:, None]
    return np.maximum(0, (out - model.false_positives) / (1 - model.false_positives)), counts, letters


def decided(texts: list[str], model: Model) -> list[tuple[str, float, bool]]:
    """For each text: its language, the score, and whether it may well be in that language."""
    if not model.languages:
        return [(UNKNOWN, 0.0, n > 0) for n in grams(texts)[2].tolist()] if texts else []
    own, counts, letters = shares(texts, model)
    best, total = own.argmax(axis=1), own.sum(axis=1)
    out = []
    for k in range(len(texts)):
        if not letters[k]:
            out.append((UNKNOWN, 0.0, False))
        elif not total[k]:
            out.append((model.languages[model.most], model.prior, bool(counts[k] < ENOUGH or not model.least_share)))
        else:
            known = counts[k] < ENOUGH or own[k, best[k]] >= model.least_share
            out.append((model.languages[best[k]], float(own[k, best[k]] / total[k]), bool(known)))
    return out


def narrow(filters: np.ndarray, languages: int) -> np.ndarray:
    return filters.astype(np.uint8 if languages <= 8 else np.uint16 if languages <= 16 else np.uint64)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs with columns lang_pred, score and known after those of docs."""
    spark = docs.sparkSession
    small = replace(model, filters=narrow(model.filters, len(model.languages)))
    shared = spark.sparkContext.broadcast(small)
    at = docs.columns.index("text")
    kept = [f"c{i}" for i in range(len(docs.columns))]
    schema = ", ".join(f"{k} {f.dataType.simpleString()}" for k, f in zip(kept, docs.schema, strict=True))

    def identify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_batches(batches, BATCH_ROWS):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            out = [x for part in chunks(texts) for x in decided(part, shared.value)]
            added = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*kept, "lang_pred", "score", "known"])

    made = docs.toDF(*kept).mapInArrow(identify, f"{schema}, lang_pred string, score double, known boolean")
    return made.toDF(*docs.columns, "lang_pred", "score", "known")


def predictions(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = identified(own, learned(docs, sample))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def least_share(rows: DataFrame, model: Model) -> float:
    """The share of a text's n-grams below which it is in no known language, from rows (text) that the model hasn't seen."""
    shared = rows.sparkSession.sparkContext.broadcast(replace(model, filters=narrow(model.filters, len(model.languages))))

    def rate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_batches(batches, BATCH_ROWS):
            for part in chunks(batch.column(0).to_pylist()):
                own, counts, _ = shares(part, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(own.max(axis=1)[counts >= ENOUGH], pa.float64())], names=["x"])

    low = rows.select("text").mapInArrow(rate, "x double").agg(F.percentile("x", 0.01).alias("low")).first().low
    return min(KNOWN, (low or 0.0) / 2)


def accepted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with their columns, whose text has letters and may well be in a language that was learned; with
    nothing to learn from, those with letters."""
    columns = [f"c{i}" for i in range(len(docs.columns))]
    rows, known = sampled(docs, sample)
    model = model_of(rows, known)
    if known:
        model = replace(model, least_share=least_share(rows.where("half = 1"), model_of(rows.where("half = 0"), known)))
    found = identified(docs, model).toDF(*columns, "lang_pred", "score", "known")
    return found.where("known").select(*columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(table(spark, sf_dir, "documents"))
