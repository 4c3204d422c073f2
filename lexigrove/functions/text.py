"""Text functions: token sequences, lines and columns, error severities, source maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Severities by the lowest code of each.
NOTICE, WARNING, ERROR, FATAL = 1, 100, 1000, 10000


def severity(code: Column) -> Column:
    return F.when(code < NOTICE, "none").when(code < WARNING, "notice").when(code < ERROR, "warning").when(code < FATAL, "error").otherwise("fatal")


def has_errors(errors: Column, level: int = ERROR) -> Column:
    return F.exists(errors, lambda e: e["code"] >= level)


def only_errors(errors: Column, level: int = ERROR) -> Column:
    return F.filter(errors, lambda e: e["code"] >= level)


def error_rows(df: DataFrame, errors: str = "errors", keep: list[str] | None = None) -> DataFrame:
    """One row per error, deduplicated by place and code (the first wins, which the kernel has seen to)."""
    return df.select(*(keep or ["doc_id"]), F.posexplode(errors).alias("seq", "e")).select(*(keep or ["doc_id"]), "seq", "e.*")


def line_breaks(text: Column) -> Column:
    """Offsets of all newlines."""
    parts = F.split(text, "\n", -1)
    ends = F.aggregate(parts, F.array(F.lit(-1)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x) + 1)))
    return F.slice(ends, 2, F.size(parts) - 1)


def line_col(text: Column, pos: Column) -> Column:
    """Struct of line and column, both from 1, of an offset in code points."""
    before = F.substring(text, F.lit(1), pos)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.struct(line.alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).alias("col"))


def text_pos(text: Column, line: Column, column: Column) -> Column:
    """The offset of a line and column, the inverse of ``line_col``; null if there is no such line."""
    lines = F.split(text, "\n", -1)
    before = F.aggregate(F.slice(lines, F.lit(1), line - 1), F.lit(0), lambda a, x: a + F.length(x) + 1)
    return F.when((line >= 1) & (line <= F.size(lines)), before + column - 1)


def is_token_sequence(s: Column) -> Column:
    """Tokens with single blanks in between and nothing around them."""
    return ~s.rlike(r"^ | $|  |\n")


def normalize_tokens(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def has_token(s: Column, token: Column, all_: bool = True) -> Column:
    """Whether all (or any) of the tokens are among those of ``s``; an empty token always is."""
    wanted, own = F.split(F.trim(token), r" +"), F.split(F.trim(s), r" +")
    test = F.size(F.array_except(wanted, own)) == 0 if all_ else F.arrays_overlap(wanted, own)
    return (F.trim(token) == "") | test


def add_token(s: Column, token: Column, whole: bool = False) -> Column:
    """``s`` with the tokens that are not yet contained. As in the model, containment is one of substrings unless ``whole``."""
    wanted = F.filter(F.split(F.trim(token), r" +"), lambda t: t != "")

    def step(acc: Column, t: Column) -> Column:
        there = F.array_contains(F.split(acc, r" +"), t) if whole else acc.contains(t)
        return F.when(there, acc).otherwise(F.trim(F.concat(acc, F.lit(" "), t)))

    return F.aggregate(wanted, s, step)


def remove_token(s: Column, token: Column, whole: bool = False) -> Column:
    """``s`` without the tokens; by substrings unless ``whole``."""
    wanted = F.filter(F.split(F.trim(token), r" +"), lambda t: t != "")
    if whole:
        return F.array_join(F.filter(F.split(s, r" +"), lambda x: ~F.array_contains(wanted, x)), " ")
    return F.aggregate(wanted, s, lambda acc, t: F.replace(F.trim(F.replace(acc, t, F.lit(""))), F.lit("  "), F.lit(" ")))


def eq_tokens(a: Column, b: Column) -> Column:
    bag = lambda s: F.sort_array(F.array_distinct(F.filter(F.split(F.trim(s), r" +"), lambda t: t != "")))
    return bag(a) == bag(b)


def source_position(srcmap: Column, pos: Column) -> Column:
    """Struct (file, pos) in the original of a position in the preprocessed text; segments (start, end, offset, file) ascend."""
    hit = F.element_at(F.filter(srcmap, lambda s: s["start"] <= pos), -1)
    return F.struct(hit["file"].alias("file"), (pos + hit["offset"]).alias("pos"))


def source_lookup(positions: DataFrame, segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same as an as-of join of rows: (key, pos) with (key, start, offset, file), one shuffle by key."""
    left = positions.select(key, F.col("pos").alias("at"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("string").alias("file"), F.lit(1).alias("kind"))
    right = segments.select(key, F.col("start").alias("at"), F.col("offset").cast("long").alias("offset"), "file", F.lit(0).alias("kind"))
    w = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumns({"o": F.last("offset", True).over(w), "f": F.last("file", True).over(w)})
    return both.where("kind = 1").select(key, F.col("at").alias("pos"), F.col("f").alias("orig_file"), (F.col("at") + F.col("o")).alias("orig_pos"))


def expand_includes(root: str, files: dict[str, str], pattern: str = r'include\("([^"]*)"\)') -> tuple[str, list[tuple[int, int, int, str]]]:
    """The text of ``root`` with the files that it names put in, and the segments (start, end, offset, file) of its source map.

    ``offset`` added to a position gives the one in the file. A file that includes itself raises ValueError.
    """
    import re

    rx = re.compile(pattern)
    out: list[str] = []
    segments: list[tuple[int, int, int, str]] = []
    size = 0

    def put(name: str, chain: tuple[str, ...]) -> None:
        nonlocal size
        if name in chain:
            raise ValueError(f"{name} includes itself: {' > '.join((*chain, name))}")
        if name not in files:
            raise ValueError(f"no file {name}")
        text, at = files[name], 0

        def plain(a: int, b: int) -> None:
            nonlocal size
            if b > a:
                segments.append((size, size + b - a, a - size, name))
                out.append(text[a:b])
                size += b - a

        for m in rx.finditer(text):
            plain(at, m.start())
            put(m[1], (*chain, name))
            at = m.end()
        plain(at, len(text))

    put(root, ())
    return "".join(out), segments
