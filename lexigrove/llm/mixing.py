"""Mixing sources to target weights by Efraimidis-Spirakis sampling: whole epochs first, then the smallest keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import col, documents, materialise, numbered, text_column

WORD = r"[^\x20\x09-\x0D]+"
FINEST = 65_536
MANY = 20_000  # sources whose plan is sent to every executor: some 2 MB


def words(text: Column) -> Column:
    """The number of words of a text."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def letters_weight(text: Column) -> Column:
    """A quality weight in [0.05, 1]: the share of letters and spaces among the characters."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\x20]+", ""))
    return F.greatest(F.lit(0.05), kept / F.greatest(F.length(text), F.lit(1)))


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float], share: float = 1.0, most: float = 3.0) -> dict[str | None, float]:
    """Target by source. Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all
    sizes; a target stops at ``most`` times its source's size and the excess goes to the others by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))  # Python compares strings by code point
    weigh = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    free, out, left = dict(order), {}, share * sum(n for _, n in order)
    while free:
        each = left / sum(weigh[s] for s in free)
        over = [s for s, n in free.items() if each * weigh[s] > most * n]
        if not over:
            return out | {s: each * weigh[s] for s in free}
        for s in over:
            out[s] = most * float(free.pop(s))
            left -= out[s]
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, quality: Callable[[Column], Column]) -> DataFrame:
    """``docs`` with _id, _source, _size and _key = -ln(u) / w."""
    text = text_column(text_col)
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), col(id_col).cast("string"), text), 11).cast("double") + 0.5) / float(1 << 53)
    return docs.withColumns({"_id": col(id_col), "_source": col(source_col).cast("string"), "_size": words(text), "_key": -F.log(unit) / quality(text)})


def _ranged(rows: DataFrame, plan: list[tuple], spark: SparkSession) -> DataFrame:
    """``rows`` with the plan of their source and the range that their key falls into."""
    schema = T.StructType([T.StructField(n, t) for n, t in (("_s", T.StringType()), ("_source_size", T.LongType()), ("_target", T.DoubleType()), ("_epochs", T.IntegerType()), ("_budget", T.DoubleType()), ("_ranges", T.LongType()), ("_border", T.LongType()), ("_before", T.LongType()))])
    by_source = spark.createDataFrame(plan, schema)
    if len(plan) <= MANY:  # a row for each source; of more sources the plan is joined by source, with skewed ones split
        by_source = F.broadcast(by_source)
    joined = rows.join(by_source, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    return joined.withColumn("_range", F.least(F.floor((1 - F.exp(-F.col("_key"))) * F.col("_ranges")), F.col("_ranges") - 1))


def _planned(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> list[tuple]:
    """By source: size, target, epochs, budget of words beyond them, number of ranges, the range that holds the border, words before it."""
    totals = rows.groupBy("_source").agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    aims, plan = targets([(r["_source"], r["size"]) for r in totals], weights, share, most), []
    for r in totals:
        aim, total = aims[r["_source"]], r["size"]
        epochs = min(int(aim // total), int(most)) if total else 0
        plan.append((r["_source"], total, aim, epochs, max(0.0, aim - epochs * total), min(FINEST, r.n // 256 + 1), None, None))
    sums = _ranged(rows, plan, rows.sparkSession).groupBy("_source", "_range", "_budget").agg(F.sum("_size").alias("sum"))
    run = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    border = sums.withColumn("before", F.coalesce(F.sum("sum").over(run), F.lit(0))).where("before < _budget and before + sum >= _budget")
    at = {r["_source"]: (r.b["_range"], r.b.before) for r in border.groupBy("_source").agg(F.min_by(F.struct("_range", "before"), "_range").alias("b")).collect()}
    return [x[:6] + at.get(x[0], (None, None)) for x in plan]


def _timed(rows: DataFrame, plan: list[tuple]) -> DataFrame:
    """``rows`` with _times. Only rows of the ranges that hold a border are sorted; the others need no look at any other row."""
    rows = _ranged(rows, plan, rows.sparkSession)
    inner = Window.partitionBy("_source").orderBy("_key", "_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where("_range = _border").withColumn("_sum", F.col("_before") + F.sum("_size").over(inner))
    # half of the border document inside the budget: the sum is nearer with it
    edge = edge.withColumn("_more", (F.col("_sum") - F.col("_size") / 2 <= F.col("_budget")).cast("int")).drop("_sum")
    # without a border the whole source fits the budget, which happens only through rounding or at a budget of 0
    rest = rows.where("_border is null or _range <> _border").withColumn("_more", F.coalesce((F.col("_range") < F.col("_border")).cast("int"), F.lit(0)))
    return edge.unionByName(rest).withColumn("_times", (F.col("_epochs") + F.col("_more")).cast("int"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = 7, quality: Callable[[Column], Column] = letters_weight) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, times, taken.

    A source of size S and target t is taken floor(t / S) times whole; of the rest, documents are taken in the order
    of their keys -ln(u) / w until the words reach the budget, w a quality weight (``quality`` makes it from the text column) and u a hash of id and text. The document at
    the border is taken if the sum is nearer with it. Thus no document is taken more than ceil(most) times.

    The order within a source needs no single sorted run: keys fall into up to 65,536 ranges by source (about 256
    rows each), range sums are made before the shuffle, and only the one range that holds the border is sorted.
    The driver gets one row per source, which the recipe of weights names anyhow.

    Null text: size 0. A source of size 0 has target 0 and is not taken. Null source: a source of its own, last in
    order. Null ids and repeated rows are rows like others (equal keys: the smaller id first). Empty input: empty result.
    """
    rows = materialise(_keyed(docs, id_col, text_col, source_col, seed, quality).select("_id", "_source", "_size", "_key"), "mix-keys")
    out = _timed(rows, _planned(rows, weights, share, most))
    return out.select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.col("_times").alias("times"), (F.col("_times") * F.col("_size")).alias("taken"),
    )


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = 7, quality: Callable[[Column], Column] = letters_weight) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as ``mix`` takes it (0 times: gone).

    Nulls, empty texts, repeated rows and ties as for ``mix``; columns keep their names, whatever these are. Empty input: empty result.
    The plan comes from a narrow table of keys; then each row is taken by its own key, without a join to any other table of rows.
    """
    plain, names = numbered(docs)
    keyed = _keyed(plain, names[id_col], names[text_col], names[source_col], seed, quality)
    rows = materialise(keyed.select("_id", "_source", "_size", "_key"), "mix-keys")
    timed = _timed(keyed, _planned(rows, weights, share, most)).where("_times > 0")
    copies = timed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_times"))))
    return copies.select(*names.values()).toDF(*docs.columns)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "times")
