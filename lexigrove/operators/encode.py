"""Trees built inside the JVM: of a text's lines or of any pieces, and of rows that name their parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tree import TREE_TYPE

_EMPTY = "CAST(map() AS map<string,string>)"


def running(numbers: Column) -> Column:
    """Struct (out, total) of an array: what stands before each number, summed, and the sum of all.

    In blocks of about as many numbers as there are blocks: sums that grow an array stay cheap, as no array gets long.
    """
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("out"))
    short = lambda rows: F.aggregate(rows, start, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def of_blocks(blocks: Column) -> Column:
        sums = short(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n)))
        return bound(sums, lambda s: F.struct(F.flatten(F.transform(blocks, lambda b, k: F.transform(short(b)["out"], lambda x: x + F.get(s["out"], k)))).alias("out"), s["at"].alias("total")))

    def of_size(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(numbers) / n).cast("int") - 1, F.lit(0))), lambda k: F.slice(numbers, k * n + 1, n))

    return bound(bound(F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(numbers))).cast("int")), of_size), of_blocks)


def flat_tree(pieces: Column, root: str, name: str) -> Column:
    """A root with one leaf for each piece of text (an array of strings), in the encoding of trees."""
    starts = running(F.transform(pieces, lambda x: F.length(x)))

    def row(nid, pid, last, depth, rank, label, text, cs, ce) -> Column:
        return F.struct(
            *[x.cast("int").alias(n) for n, x in (("nid", nid), ("pid", pid), ("last", last), ("depth", depth), ("ord", rank))],
            label.alias("name"), text.cast("string").alias("text"), cs.cast("int").alias("cs"), ce.cast("int").alias("ce"), cs.cast("int").alias("pos"),
            F.expr(_EMPTY).alias("attrs"), F.expr("CAST(array() AS array<string>)").alias("attr_keys"),
        )

    zero = F.lit(0)
    top = row(zero, F.lit(-1), F.size(pieces), zero, zero, F.lit(root), F.when(F.size(pieces) == 0, ""), zero, starts["total"])
    kids = F.zip_with(F.zip_with(pieces, starts["out"], lambda t, s: F.struct(t.alias("t"), s.alias("s"))), F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1))), lambda p, k: row(k, zero, k, F.lit(1), k - 1, F.lit(name), p["t"], p["s"], p["s"] + F.length(p["t"])))
    return F.concat(F.array(top), F.when(F.size(pieces) > 0, kids).otherwise(F.slice(kids, 1, 0))).cast(TREE_TYPE)


def line_tree(text: Column, root: str = "doc", name: str = "line") -> Column:
    """Lines as leaves, each with its newline."""
    return flat_tree(F.filter(F.split(text, r"(?<=\n)", -1), lambda x: x != ""), root, name)


def group_trees(rows: DataFrame, key: str, order: str, text: str, name: str, root: str) -> DataFrame:
    """(key, tree): one tree per key with a leaf for each row, in order. Rows are gathered by key, as the tree holds them all."""
    parts = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.col(name).alias("n")))).alias("rows"))
    tree = flat_tree(F.transform("rows", lambda r: F.coalesce(r["t"], F.lit(""))), root, "")
    named = F.transform(tree, lambda n: F.when(n["pid"] >= 0, n.withField("name", F.get(F.col("rows"), n["ord"])["n"])).otherwise(n))
    return parts.select(key, named.alias("tree"))


def runs(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Rows with ``run``: a number for each stretch of neighbours with the same name, as merging adjacent nodes needs it."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.lag(name).over(w).eqNullSafe(F.col(name)), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")
