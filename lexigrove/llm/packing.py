"""Best-fit packing by exact-complement hashing over length counts, and its assignment to rows without a global sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, documents, materialise, string_array, text_column

SEQUENCE = 2048
PER_BUCKET = 100_000  # rows of one length, if all have it, that are numbered together
END_ID = 0
SPECIAL = "<|endoftext|>"  # fixed value: the vocabulary's special token
SPECIAL_ID = 50256


class ByteEncoder:
    """The ids that ``byte_bpe_50k.json`` gives, mostly from the faster library that has the same vocabulary as ranks.

    Both libraries split a text by the same pattern; for characters beyond Latin, Greek and Cyrillic letters and common
    punctuation, where their Unicode tables might differ, the text goes to the slower one.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import base64
        import re

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(json_path)
        self.plain = re.compile("[\t\n\r\x20-\x7e\u00a0-\u017f\u2010-\u2027\u20ac]*")

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL in text or not self.plain.fullmatch(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


def encoder() -> ByteEncoder:
    import public_tokenizers

    return ByteEncoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def cut(n: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: all of ``most``, but for the first, which may be shorter."""
    first = n % most or min(n, most)
    return [(0, first), *((a, most) for a in range(first, n, most))] if n else []


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SEQUENCE, ids: bool = False) -> DataFrame:
    """One row per piece of each document's ids and the end id: id, piece, start, length, ids_crc32 (and ids, if wanted)."""
    import zlib

    rows = docs.select(col(id_col).alias("id"), text_column(text_col).alias("t"))
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder()
        for batch in batches:
            texts = string_array(batch.column(1))
            for a in range(0, len(texts), 128):
                of, out = [], []
                for k, t in enumerate(texts[a : a + 128].to_pylist()):
                    found = np.append(coder.ids(t), np.uint32(END_ID)).astype("<u4")
                    for j, (start, n) in enumerate(cut(len(found), most)):
                        part = found[start : start + n]
                        of.append(k)
                        out.append((j, start, n, zlib.crc32(part.tobytes()), *[part] * ids))
                columns = list(zip(*out, strict=True)) if out else [()] * (len(names) - 1)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * ids]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + 128].take(pa.array(of, pa.int32())), *map(pa.array, columns, kinds)], names)

    return rows.mapInArrow(encode, f"id {dict(rows.dtypes)['id']}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids)


class Lengths:
    """Available lengths with their counts, as bit sets: bit n of ``have``, bit most - n of ``mirror``."""

    def __init__(self, counts: np.ndarray, most: int):
        self.most, self.left = most, [0, *(int(x) for x in counts[1:])]
        self.left += [0] * (most + 1 - len(self.left))
        self.have = sum(1 << n for n, x in enumerate(self.left) if x)
        self.mirror = sum(1 << (most - n) for n, x in enumerate(self.left) if x)

    def fits(self, parts: tuple[int, ...]) -> int:
        """How many times the lengths can be had together."""
        return min(self.left[x] // parts.count(x) for x in set(parts))

    def use(self, parts: tuple[int, ...], times: int) -> None:
        for x in parts:
            self.left[x] -= times
        for x in set(parts):
            if not self.left[x]:
                self.have &= ~(1 << x)
                self.mirror &= ~(1 << (self.most - x))

    def longest(self, most: int) -> int:
        """The longest available length of at most ``most``; 0 if there is none."""
        return max(0, (self.have & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def pair(self, total: int, others: tuple[int, ...]) -> tuple[int, ...] | None:
        """Two lengths of this sum that can be had beside the others, the longer one as long as can be."""
        # the index of pair sums: lengths a whose complement total - a is available, of which the longer halves
        both = self.have & (self.mirror >> (self.most - total)) & ((1 << total) - 1)
        both = both >> ((total + 1) // 2) << ((total + 1) // 2)
        while both:
            a = both.bit_length() - 1
            if self.fits((*others, a, total - a)):
                return a, total - a
            both ^= 1 << a
        return None

    def triple(self, total: int, others: tuple[int, ...]) -> tuple[int, ...] | None:
        """Three lengths of this sum, the longest one as long as can be."""
        a = self.longest(total - 2)
        while a * 3 >= total:
            if (found := self.pair(total - a, (*others, a))) and self.fits((*others, a, *found)):
                return a, *found
            a = self.longest(a - 1)
        return None


def plan(counts: np.ndarray, most: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences take each, for ``counts[n]`` pieces of length n.

    From the longest length down, a sequence opened by a piece of length L has the gap g = most - L. An index of
    single lengths, of pairs and of triples by their sum is asked for lengths that fill g exactly; as many as the
    availability counts allow are consumed at a time. The pieces for which no such combination is left are put,
    longest first, where they fit best. The work depends on the number of lengths, not of pieces.
    """
    lengths, out = Lengths(counts, most), []

    def use(parts: tuple[int, ...]) -> None:
        n = lengths.fits(parts)
        out.append((parts, n))
        lengths.use(parts, n)

    if lengths.left[most]:
        use((most,))
    for n in range(most - 1, 0, -1):
        while lengths.left[n]:
            gap = most - n
            if lengths.left[gap] and lengths.fits((n, gap)):
                use((n, gap))
            elif found := lengths.pair(gap, (n,)) or lengths.triple(gap, (n,)):
                use((n, *found))
            else:
                break
    # what is left: best fit of the longest first; a sequence is filled by the longest lengths that fit, which
    # leaves the least room, and is repeated as long as its lengths last
    while first := lengths.longest(most):
        parts, room = [first], most - first
        while x := lengths.longest(room):
            while x and parts.count(x) >= lengths.left[x]:
                x = lengths.longest(x - 1)
            if not x:
                break
            parts.append(x)
            room -= x
        use(tuple(parts))
    return out


def pack(rows: DataFrame, keys: list[str], length: str = "length", most: int = SEQUENCE) -> DataFrame:
    """``rows`` with sequence_id and offset; ``rows`` should be a table, as it is read twice. Empty input: empty result.

    The driver plans on the counts of lengths (at most ``most`` numbers). Each length's pieces are numbered from 0: by bucket
    of a hash of the keys, with counts of the buckets before the shuffle, so that a frequent length never meets in one
    task; there are as many buckets as hold PER_BUCKET rows of a length that all rows had. A piece's number tells its
    sequence by those of the plan's slots that its bucket reaches. Rows with equal keys and lengths are interchangeable.
    Other columns are kept; none may be called ``_bucket`` or the like (``pack_documents`` has none of its own).
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*[col(k) for k in keys]), F.lit(max(4 * parts, rows.count() // PER_BUCKET))))
    by_bucket = materialise(keyed.groupBy(col(length).alias("_n"), F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_count")), "pack-counts")
    counts = np.zeros(most + 1, np.int64)
    for r in by_bucket.groupBy("_n").agg(F.sum("_count").alias("c")).collect():
        counts[r["_n"]] = r.c
    slots, taken, sequences = [], np.zeros(most + 1, np.int64), 0
    for parts_of, times in plan(counts, most):
        offset = 0
        for x in parts_of:
            slots.append((x, int(taken[x]), int(times), sequences, offset))
            taken[x] += times
            offset += x
        sequences += times
    if not slots:
        return rows.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")}).where("false")
    table: dict[int, list] = {}
    for x, a, times, first, offset in slots:
        table.setdefault(x, []).append((a, times, first, offset))
    # the slots of a length by their first number: at most the plan's length in all, which depends on ``most`` only
    frame = spark.createDataFrame([(x, v) for x, v in table.items()], "_n long, _slots array<struct<a:long,times:long,first:long,offset:long>>")
    before = Window.partitionBy("_n").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0))).join(F.broadcast(frame), "_n")
    reached = F.filter("_slots", lambda s: (s["a"] < F.col("_before") + F.col("_count")) & (s["a"] + s["times"] > F.col("_before")))
    starts = starts.select("_n", "_b", "_before", reached.alias("_slots"))
    inner = Window.partitionBy(col(length), "_bucket").orderBy(*[col(k) for k in keys])
    numbered = keyed.withColumn("_r", F.row_number().over(inner) - 1)
    numbered = numbered.join(starts, (col(length) == F.col("_n")) & (F.col("_bucket") == F.col("_b"))).withColumn("_r", F.col("_r") + F.col("_before"))
    placed = numbered.withColumn("_slot", F.element_at(F.filter("_slots", lambda s: s["a"] <= F.col("_r")), -1))
    sequence = F.col("_slot.first") + F.col("_r") - F.col("_slot.a")
    return placed.select(*[col(c) for c in rows.columns], sequence.alias("sequence_id"), F.col("_slot.offset").alias("offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SEQUENCE, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset.

    Null and empty texts are one piece, the end id. Repeated rows are packed as often as they come, with pieces alike.
    Texts are encoded once and the pieces kept as a table without the ids, unless these are wanted. Empty input: empty result.
    """
    rows = materialise(pieces(docs, id_col, text_col, most, ids), "pack-pieces")
    packed = pack(rows, ["id", "piece", "ids_crc32"], "length", most)
    return packed.withColumnRenamed("id", id_col)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
