"""Jaccard join on word n-grams: MinHash bands find candidates, full n-gram sets decide, no pair is ever a row."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import col, documents, materialise, numbered, raw, slices, string_array, text_column

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.9995
CHUNK = 400_000  # n-grams (and 200 a document) that one side of a comparison holds
RARE = 8  # n-grams in so few documents are counted pair by pair, others by matrix products


def banding(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): as many rows a band as reach the recall at the threshold with ``most`` hashes, then the fewest bands."""
    for rows in range(most, 0, -1):
        p = threshold**rows
        bands = next((b for b in range(1, most // rows + 1) if 1 - (1 - p) ** b >= recall), 0)
        if bands:
            return bands, rows
    return most, 1


@functools.cache
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(991))
    return r.integers(0, 1 << 64, n, dtype=np.uint64), r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_sets(texts: pa.StringArray, n: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct n-grams; words in lower case (A-Z), a text of fewer words is one n-gram."""
    buffer, offsets = raw(texts)
    starts, ends, firsts = hashing.words(buffer, offsets)
    grams, at = hashing.shingle_hashes(hashing.word_hashes(buffer, starts, ends), firsts, n)
    return [np.unique(grams[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set size, two 64-bit sums over the set, band hashes) of each set; an empty set has zeros."""
    sizes = np.array([len(x) for x in sets], np.int64)
    first, second = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    out = np.zeros((len(sets), bands), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        grams = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        first[full] = hashing.mix(np.add.reduceat(hashing.mix(grams), at) + sizes[full].astype(np.uint64))
        second[full] = hashing.mix(np.add.reduceat(hashing.mix(grams ^ np.uint64(0x5851F42D4C957F2D)), at))
        xor, times = _functions(bands * rows)
        k, work = 0, np.empty_like(grams)
        for band in range(bands):
            both = np.full(len(full), band + 1, np.uint64)
            for _ in range(rows):
                np.bitwise_xor(grams, xor[k], out=work)
                np.multiply(work, times[k], out=work)
                both = both * np.uint64(0x9FB21C651E98DF25) + np.minimum.reduceat(work, at)
                k += 1
            out[full, band] = hashing.mix(both)
    return sizes, first, second, out


def _intersections(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of every set of one side with every one of the other (or of the same)."""
    sets = left + (right or [])
    a, b = len(left), len(right) if right else len(left)
    out = np.zeros((a, b), np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(grams, kind="stable")  # within an n-gram, documents ascend
    grams, owner = grams[order], owner[order]
    new = np.concatenate([[True], grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(grams)))
    flat = out.reshape(-1)
    for n in range(2, RARE + 1):
        base = at[counts == n]
        for i in range(n if len(base) else 0):
            for j in range(i + 1, n):
                x, y = owner[base + i], owner[base + j]
                if right:
                    across = (x < a) & (y >= a)
                    x, y = x[across], y[across] - a
                flat += np.bincount(x * b + y, minlength=a * b).astype(np.float32) if len(x) * 4 > a * b else 0
                if len(x) * 4 <= a * b:
                    np.add.at(flat, x * b + y, 1)
    many = np.flatnonzero(counts > RARE)
    for s in range(0, len(many), 4096):
        part = many[s : s + 4096]
        sizes = counts[part]
        rows = np.repeat(np.arange(len(part)), sizes)
        where = np.repeat(at[part], sizes) + np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        matrix = np.zeros((len(sets), len(part)), np.float32)
        matrix[owner[where], rows] = 1
        out += matrix[:a] @ (matrix[a:] if right else matrix).T
    return out


def compare(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets reach the threshold with which (within one side: only i < j)."""
    shared = _intersections(left, right).astype(np.float64)
    a = np.array([len(x) for x in left], np.float64)
    b = np.array([len(x) for x in right], np.float64) if right else a
    union = a[:, None] + b[None, :] - shared
    found = (shared >= threshold * union - 1e-9) & (shared > 0)
    return found if right else np.triu(found, 1)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows with the same first ``keys`` columns, from batches sorted by them."""
    now, held = None, []
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        edges = np.zeros(max(0, batch.num_rows - 1), bool)
        for c in columns:
            edges |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(edges) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            key = tuple(c[a] for c in columns)
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


def _verify(n: int, threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), held in _groups(batches, 3):
            table = pa.Table.from_batches(held)
            nodes, at = np.unique(table.column("node").to_numpy(), return_index=True)  # rows that repeat id and text: once
            table = table.take(pa.array(at))
            side, copies = table.column("side").to_numpy(), table.column("copies").to_numpy()
            texts, sets = string_array(table.column("t")), []
            for a, b in slices(texts):
                sets += gram_sets(texts[a:b], n)
            first, second = np.flatnonzero(side == i), np.flatnonzero(side == j)
            found = compare([sets[k] for k in first], [sets[k] for k in second] if i != j else None, threshold)
            links = np.zeros(len(nodes), np.int64)
            if not len(first) or not len(second):
                continue
            x, y = np.nonzero(found)
            x, y = first[x], second[y]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            # edges that connect what the links connect: at most one for each document
            root = np.arange(len(nodes))

            def top(k: int, root=root) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                p, q = top(p), top(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
            to = np.array([top(k) for k in range(len(nodes))])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), pa.array(nodes[to])], ["node", "links", "to"])

    return verify


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b): the smallest vertex that it is connected with.

    Alternating large-star and small-star steps until nothing changes, each written as a table; minima are taken before
    the shuffle, so that a vertex with many neighbours never gathers them in one task.
    """

    def step(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "components-low")
        joined = both.join(low, "a")
        if small:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        else:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.where("a <> b")
        return materialise(out.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components-edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components-edges")
    now = state(edges)
    while now[0]:
        edges = step(step(edges, False), True)
        now, last = state(edges), now
        if now == last:
            break
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("root"))).distinct()


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, n_copies, n_grams.

    Documents with the same set of n-grams are copies (two 64-bit sums over the set agree); a set is compared as one,
    so copies are never paired. ``n_links`` is the number of other documents, copies among them, whose Jaccard
    similarity is at least the threshold; ``class_id`` is the smallest id that links lead to.

    Bands of MinHashes put sets into buckets; buckets that share sets form components, found by star contraction. A
    component's sets are dealt over chunks of bounded size and each two chunks are compared by one task with full n-gram
    sets, which emits one row per set: its number of links and one edge. So a group's pairs never become rows.

    Words are split at space and 0x09-0x0D, A-Z in lower case. Texts of 1 to n-1 words are one n-gram of all their words.
    Texts without a word, and null: no links, one copy, class of their own id. Null ids stay null and count as the largest.
    Repeated rows are copies. Empty input: empty result. Other columns are ignored.
    """
    bands, rows = banding(threshold, recall)
    base = docs.select(col(id_col).alias("id"), text_column(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    kind = dict(base.dtypes)["id"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = string_array(batch.column(1))
            for a, b in slices(texts):
                sizes, first, second, band = signatures(gram_sets(texts[a:b], n), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(band.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(sizes), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), lists], ["id", "h", "n", "node", "check", "bands"])

    signed = materialise(base.mapInArrow(sign, f"id {kind}, h long, n long, node long, check long, bands array<long>"), "join-signatures")
    worded = signed.where("n > 0")
    # two sets with one 64-bit sum, told apart by the other: the larger one gets another number
    twins = worded.groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low < high")
    if not twins.isEmpty():
        apart = signed.join(twins, "node", "left").withColumn("node", F.when(F.col("check") > F.col("low"), F.xxhash64("node", "check")).otherwise(F.col("node")))
        signed = materialise(apart.select("id", "h", "n", "node", "check", "bands"), "join-signatures")
        worded = signed.where("n > 0")
    counts = worded.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("low"))
    sets = materialise(worded.dropDuplicates(["node"]).select("id", "h", "n", "node", "bands"), "join-sets")
    dealt = sets.select("node", F.explode("bands").alias("bucket"))
    shared = materialise(dealt.groupBy("bucket").agg(F.min("node").alias("b"), F.max("node").alias("high")).where("b < high").select("bucket", "b"), "join-buckets")
    candidates = components(dealt.join(shared, "bucket").select(F.col("node").alias("a"), "b"))
    candidates = materialise(candidates.select(F.col("v").alias("node"), F.col("root").alias("comp")).join(sets.drop("bands"), "node"), "join-candidates")
    weights = materialise(candidates.groupBy("comp").agg(F.ceil(F.sum(F.col("n") + 200) / CHUNK).cast("int").alias("chunks")), "join-components")
    chunked = candidates.join(weights, "comp").withColumn("side", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    chunked = materialise(chunked.join(counts, "node").select(F.col("id").alias("cid"), F.col("h").alias("ch"), "node", "comp", "chunks", "side", "copies"), "join-chunks")
    # merged at every size: the texts are dealt out by id, whether or not the candidates would fit a broadcast
    texts = base.join(chunked.hint("merge"), F.col("id").eqNullSafe(F.col("cid")) & (F.col("h") == F.col("ch")))
    dealt = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("comp", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "side", "copies", "t")
    dealt = dealt.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    verified = materialise(dealt.mapInArrow(_verify(n, threshold), "node long, links long, to long"), "join-links")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(verified.select(F.col("node").alias("a"), F.col("to").alias("b")))
    nodes = counts.join(links, "node", "left").join(classes.withColumnRenamed("v", "node"), "node", "left")
    nodes = materialise(nodes.select("node", "copies", "low", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "join-nodes")
    lows = materialise(nodes.groupBy("root").agg(F.min("low").alias("class_id")), "join-classes")
    nodes = materialise(nodes.join(lows, "root").select(F.col("node").alias("k"), "copies", "links", "class_id"), "join-nodes")
    out = signed.join(nodes, (F.col("n") > 0) & (F.col("node") == F.col("k")), "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.col("n").alias("n_grams"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of its class; of rows with equal ids, one stays."""
    stay = jaccard_join(docs, id_col, text_col, **how).where(F.col("class_id").eqNullSafe(col(id_col)))
    stay = materialise(stay.groupBy(F.col("class_id").alias("_k")).agg(F.count(F.lit(1)).alias("_times")), "join-stay")

    plain, names = numbered(docs)

    def of(condition: str) -> DataFrame:
        return plain.join(stay.where(condition).select("_k"), col(names[id_col]).eqNullSafe(F.col("_k")), "left_semi")

    # ids that come once need no second look; others keep one row for each text
    many = of("_times > 1").withColumn("_text", F.sha2(text_column(names[text_col]).cast("binary"), 256))
    return of("_times = 1").unionByName(many.dropDuplicates([names[id_col], "_text"]).drop("_text")).toDF(*docs.columns)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))
