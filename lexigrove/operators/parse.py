"""Parsing as a narrow map: text columns to tree and error columns, or regular expressions inside the JVM."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..plans import ebnf, kernel, lower
from ..plans.ir import Grammar
from ..sources.serde import tree_array
from ..tree import ERROR_TYPE, TREE_TYPE

ERRORS = T.ArrayType(ERROR_TYPE)
BATCH = 100
STEPS = 10_000  # rows of a batch of steps
_INT, _STRING = T.IntegerType(), T.StringType()
_OPEN = T.StructType([T.StructField("name", _STRING), T.StructField("pos", _INT)])
STEP = T.StructType([
    T.StructField(name, kind)
    for name, kind in [("seq", _INT), ("symbol", _STRING), ("status", _STRING), ("recalled", T.BooleanType()), ("line", _INT), ("col", _INT), ("pos", _INT), ("length", _INT), ("stack", T.ArrayType(_OPEN)), ("excerpt", _STRING)]
])


def grammar(text: str, **how) -> Grammar:
    return ebnf.read(text, **how)


def parse(df: DataFrame, column: str, plan: Grammar, start: str | None = None, keep: list[str] | None = None, complete: bool = True, tree: bool = True) -> DataFrame:
    """``keep`` columns (default: all others), ``tree`` (unless it is not wanted), ``errors`` (by position) and ``max_code``; null texts have null trees."""
    keep = [c for c in (keep or df.columns) if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = kernel.Parser(plan)
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                texts = part.column(len(keep)).to_pylist()
                found = kernel.deep(lambda texts=texts: [(None, [], None) if t is None else parser.parse(t, start, complete) for t in texts])
                errors = [[{"pos": p, "length": n, "code": c, "message": m} for p, n, c, m in e] for _, e, _ in found]
                trees = [tree_array([t for t, _, _ in found])] if tree else []
                top = pa.array([max((x["code"] for x in e), default=0) for e in errors], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *trees, pa.array(errors, to_arrow_type(ERRORS)), top], [*keep, *["tree"] * tree, "errors", "max_code"])

    some = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`"))
    schema = T.StructType([some.schema[c] for c in keep] + [T.StructField("tree", TREE_TYPE)] * tree + [T.StructField("errors", ERRORS), T.StructField("max_code", T.IntegerType())])
    return some.mapInArrow(run, schema)


def each_text_once(df: DataFrame, column: str, work: Callable[[DataFrame], DataFrame], tasks: int = 3) -> DataFrame:
    """Rows with what ``work`` makes of the table of their distinct texts; rows with null texts, and of texts it drops, get nulls.

    ``work`` gets and keeps the column, one row a text. The texts are dealt out to so many tasks a core: parsing short texts
    takes far more time than their bytes, by which files are split and shuffled partitions put together, let expect.
    """
    texts = df.select(F.col(f"`{column}`")).where(F.col(f"`{column}`").isNotNull()).distinct()
    made = work(texts.repartition(tasks * df.sparkSession.sparkContext.defaultParallelism, F.col(f"`{column}`")))
    return df.join(made, column, "left")


def history(df: DataFrame, column: str, plan: Grammar, id_col: str = "doc_id", start: str | None = None, width: int = 40) -> DataFrame:
    """id_col, seq, symbol, status, recalled, line, col, pos, length, stack, excerpt: the steps of each text's parsing as they ended.

    A step is a symbol or a nameless leaf (``:Text``, ``:RegExp``, ...), so parts come before what they are parts of. ``status``:
    MATCH, DROP (matched and left out of the tree), FAIL, ABORT (a mandatory part was missing and nobody resumed inside),
    RESUME (of the symbol whose rule says where to go on; what was skipped) or ERROR (its symbol is the code).
    ``recalled``: the result was known from before. ``stack``: name and place of the open symbols, the step's own last.
    ``excerpt``: the ``width`` characters from ``pos`` on, or those that matched if fewer. Null and empty texts: no steps and
    those of an empty text. Rows with the same id: each with its own steps.
    """

    def rows_of(text: str, steps: list) -> list[tuple]:
        text = kernel.without_mark(text)
        breaks, rows = [-1, *(m.start() for m in re.finditer("\n", text))], []
        for seq, (symbol, pos, end, status, recalled, stack) in enumerate(steps):
            line = bisect_left(breaks, pos)
            excerpt = text[pos : pos + width if status == "FAIL" else min(end, pos + width)]
            rows.append((seq, symbol, status, recalled, line, pos - breaks[line - 1], pos, end - pos, [{"name": n, "pos": p} for n, p in stack], excerpt))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = kernel.Parser(plan, trace=True)

        def some_texts(texts: list, first: int) -> tuple[int, list[int], list[tuple]]:
            """The steps of texts from the first on, until they are many: the next text, each step's text, the steps."""
            at, of, rows = first, [], []
            while at < len(texts) and len(rows) < STEPS:
                found = [] if texts[at] is None else rows_of(texts[at], parser.parse(texts[at], start)[2])
                of += [at] * len(found)
                rows += found
                at += 1
            return at, of, rows

        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                at, of, rows = kernel.deep(lambda texts=texts, at=at: some_texts(texts, at))
                for a in range(0, len(rows), STEPS):
                    columns = [pa.array(x, to_arrow_type(f.dataType)) for x, f in zip(zip(*rows[a : a + STEPS], strict=True), STEP, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[a : a + STEPS])), *columns], [id_col, *STEP.names])

    some = df.select(F.col(f"`{id_col}`"), F.col(f"`{column}`"))
    return some.mapInArrow(run, T.StructType([some.schema[0], *STEP]))


def stack_path(stack: Column, sep: str = "->") -> Column:
    """The names of a step's stack as one string."""
    return F.array_join(F.transform(stack, lambda x: x["name"]), sep)


def step_line(width: int = 40) -> Column:
    """A row of ``history`` as one line: place, stack, status, excerpt with line breaks escaped."""
    place = F.concat(F.col("line").cast("string"), F.lit(":"), F.col("col").cast("string"))
    shown = F.replace(F.substring("excerpt", 1, width), F.lit("\n"), F.lit("\\n"))
    return F.concat_ws("  ", place, stack_path(F.col("stack")), F.col("status"), shown)


def turning_points(steps: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of each text's steps (rows of ``history``): id_col, n_steps, last_match, furthest_match, furthest_fail (structs or null).

    A text's last step that matched; the one that matched up to the furthest end, and the one that failed at the furthest
    place, of several the last. One row by id is made before rows are shuffled.
    """
    step = F.struct(*STEP.names)
    matched, failed = F.col("status").isin("MATCH", "DROP"), F.col("status") == "FAIL"
    best = lambda which, *by: F.max(F.when(which, F.struct(*by, step.alias("step"))))["step"]
    end = (F.col("pos") + F.col("length")).alias("end")
    return steps.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_steps"), best(matched, "seq").alias("last_match"), best(matched, end, "seq").alias("furthest_match"), best(failed, "pos", "seq").alias("furthest_fail")
    )


def match(text: Column, plan: Grammar, symbol: str) -> Column:
    """The prefix of a text that a symbol matches, null if none: a JVM expression. NotLowered if the symbol cannot be."""
    rx = lower.pattern(plan, symbol)
    return F.when(text.rlike(f"^(?:{rx})"), F.regexp_extract(text, f"^(?:{rx})", 0))


def fullmatch(text: Column, plan: Grammar, symbol: str) -> Column:
    """Whether a symbol matches a whole text, as a JVM expression."""
    return text.rlike(f"^(?:{lower.pattern(plan, symbol)})\\z")


def match_all(text: Column, plan: Grammar, symbol: str) -> Column:
    """All matches of a symbol that a search from left to right finds, as a JVM expression."""
    return F.regexp_extract_all(text, F.lit(f"(?:{lower.pattern(plan, symbol)})"), F.lit(0))


def match_parts(text: Column, plan: Grammar, symbol: str, parts: list[str]) -> list[Column]:
    """What each named part of a symbol's match at the start of a text covers, as JVM expressions."""
    rx = "^(?:" + lower.group_pattern(plan, symbol, parts) + ")"
    return [F.regexp_extract(text, rx, k + 1).alias(p) for k, p in enumerate(parts)]
