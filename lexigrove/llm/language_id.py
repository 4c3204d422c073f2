"""Language ID by compression: the language whose dictionary makes a text smallest; narrow margins are rejected."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, documents, fold, numbered, string_array, text_column

SAMPLE_DOCS = 64  # documents of a language that its dictionary is made of, at most
DICTIONARY_BYTES = 32 << 10
SEGMENT = 4 << 10  # bytes of text compressed at a time, so that the dictionary counts all through a long text
PIECES = 4  # of a text that is longer than its part of the dictionary
LEVEL = 6
NARROW = 0.005  # of the second smallest size
#: ASCII other than a-z becomes a space.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letters(text: str) -> bytes:
    """The lower-cased words of a text: ASCII digits, marks and white space become single spaces."""
    return b" ".join(text.lower().encode().translate(LETTERS).split())


def spread(data: bytes, most: int, pieces: int) -> bytes:
    """At most so many bytes: all, or evenly spaced pieces of the same size from the start to the end."""
    if len(data) <= most:
        return data
    pieces = max(1, min(pieces, (most + 1) // 2))
    size = (most + 1) // pieces - 1
    return b" ".join(data[a : a + size] for a in ((len(data) - size) * k // max(1, pieces - 1) for k in range(pieces)))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, sample: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Raw-content dictionaries by language from at most ``sample`` labelled documents of each outside the held-out fold.

    The documents with the smallest hashes of their ids are chosen, in two steps so that a frequent language never meets in
    one task; their texts give equal parts of the dictionary, at most 32 KB together: of a text with more letters than its
    part, ``PIECES`` evenly spaced pieces of the whole text. Rows with a null id, lang or text do not teach.
    """
    rows = docs.select(col(id_col).alias("id"), col(lang_col).cast("string").alias("lang"), fold(id_col, folds).alias("fold"), F.xxhash64(col(id_col).cast("string")).alias("h"))
    rows = rows.where((F.col("fold") != held) & F.col("lang").isNotNull())
    by_part = Window.partitionBy("lang", F.pmod("h", F.lit(4096))).orderBy("h")
    # ids whose hash is among the smallest of a part; then among the smallest of all
    first = rows.withColumn("r", F.row_number().over(by_part)).where(F.col("r") <= 4).select("id", "lang", "h")
    best = first.groupBy("lang").agg(F.slice(F.sort_array(F.collect_set(F.struct("h", "id"))), 1, sample).alias("ids"))
    chosen = best.select("lang", F.explode("ids").alias("x")).select("lang", "x.id")
    wanted = [r.id for r in chosen.collect()]
    if not wanted:
        return {}
    texts = docs.where(col(id_col).isin(wanted)).select(col(lang_col).cast("string").alias("lang"), col(id_col).alias("id"), text_column(text_col).alias("t"), fold(id_col, folds).alias("fold"))
    share = DICTIONARY_BYTES // max(1, sample)
    found: dict[str, list[tuple]] = {}

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a whole text is read, the driver gets no more of it than a dictionary holds
        for batch in batches:
            parts = [spread(letters(t), DICTIONARY_BYTES, SAMPLE_DOCS) for t in string_array(batch.column(2)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.binary())], ["lang", "id", "t"])

    whole = texts.where("lang is not null").select("lang", F.col("id").cast("string").alias("id"), "t")
    for r in whole.mapInArrow(reduced, "lang string, id string, t binary").distinct().toLocalIterator():
        found.setdefault(r.lang, []).append((r.id, bytes(r.t)))
    out = {}
    for lang, parts in found.items():
        parts.sort()
        each = max(share, DICTIONARY_BYTES // len(parts))
        out[lang] = b" ".join(spread(t, each, PIECES) for _, t in parts)[-DICTIONARY_BYTES:]
    return out


class Classifier:
    """Sizes of texts under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.langs = sorted(x for x in dictionaries if dictionaries[x].strip())
        self.coders = []
        for lang in self.langs:
            made = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        parts = [text[a : a + SEGMENT] for a in range(0, len(text), SEGMENT)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.coders]

    def best(self, text: str) -> tuple[str, float, bool]:
        """(language or ``und``, score, narrow). Ties go to the smaller language by code point."""
        if not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        sizes = self.sizes(letters(text))
        low = min(sizes)
        chosen = self.langs[sizes.index(low)]
        rest = sorted(sizes)[1:]
        margin = (rest[0] - low) / rest[0] if rest else 1.0
        # the share of the likelihood 2 ** -bits that the choice has, bits per 64 bytes of text
        scale = 8 * math.log(2) / max(1.0, len(text) / 64)
        score = 1 / sum(math.exp(-min(700.0, (s - low) * scale)) for s in sizes)
        return chosen, score, margin < NARROW


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, rejected; only the text is looked at.

    The whole text counts. ``und`` (score 0, rejected): null text, no letter, or nothing learned. ``rejected`` also
    where the smallest size is less than 0.5 % below the next. Repeated rows: repeated results.
    """
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("t"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for batch in batches:
            found = [model.best(t) for t in string_array(batch.column(1)).to_pylist()]
            lang, score, narrow = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(narrow, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    out = rows.mapInArrow(predict, f"id {dict(rows.dtypes)['id']}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is not rejected."""
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for batch in batches:
            texts = string_array(batch.column(at)).to_pylist()
            yield batch.filter(pa.array([not model.best(t)[2] for t in texts], pa.bool_()))

    plain, _ = numbered(docs)
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs, learn(docs))
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
