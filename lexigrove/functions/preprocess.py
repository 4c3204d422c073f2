"""Preprocessing: tokens inside texts, source maps and their composition, chains of preprocessors; and errors shown in the source."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters around a token's name and argument.
BEGIN, BAR, END = "\x1b", "\x1c", "\x1d"
TOKEN = re.compile("\x1b(\\w+)\x1c([^\x1b\x1c\x1d]*)\x1d")
TOKEN_JAVA = "\\x1b(\\w+)\\x1c([^\\x1b\\x1c\\x1d]*)\\x1d"


def make_token(name: str, argument: str = "") -> str:
    """A token that grammars can ask for. ValueError for names that are no words and arguments with token signs."""
    if not re.fullmatch(r"\w+", name) or re.search("[\x1b\x1c\x1d]", argument):
        raise ValueError(f"no token: {name!r}, {argument!r}")
    return f"{BEGIN}{name}{BAR}{argument}{END}"


def token_column(name: str, argument: Column) -> Column:
    return F.concat(F.lit(BEGIN + name + BAR), argument, F.lit(END))


def strip_tokens(text: Column) -> Column:
    """The text with every token replaced by its argument."""
    return F.regexp_replace(text, TOKEN_JAVA, "$2")


def show_tokens(text: Column) -> Column:
    """Token signs as angle brackets and bars."""
    return F.translate(text, BEGIN + BAR + END, "<|>")


def tokens(text: Column) -> Column:
    """(name, argument) of all tokens."""
    every = lambda k: F.regexp_extract_all(text, F.lit(TOKEN_JAVA), F.lit(k))
    return F.zip_with(every(1), every(2), lambda n, a: F.struct(n.alias("name"), a.alias("argument")))


def token_map(text: Column) -> Column:
    """Segments (start, end, offset, file) that lead from a text with tokens to that without: an array as ``text.source_position`` wants it."""
    names, arguments = F.regexp_extract_all(text, F.lit(TOKEN_JAVA), F.lit(1)), F.regexp_extract_all(text, F.lit(TOKEN_JAVA), F.lit(2))
    rows = F.zip_with(F.zip_with(F.split(text, TOKEN_JAVA), names, lambda b, n: F.struct(b.alias("b"), n.alias("n"))), arguments, lambda x, a: F.struct(x["b"].alias("b"), x["n"].alias("n"), a.alias("a")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("off"), F.expr("CAST(array() AS array<struct<start:int,end:int,offset:int,file:string>>)").alias("out"))
    segment = lambda a, b, off: F.struct(a.alias("start"), b.alias("end"), off.alias("offset"), F.lit("").alias("file"))

    def step(acc: Column, x: Column) -> Column:
        plain = acc["at"] + F.length(x["b"])
        inner, off = plain + F.length(x["n"]) + 2, acc["off"] - F.length(x["n"]) - 2
        behind = inner + F.length(x["a"])
        before = F.concat(acc["out"], F.array(segment(acc["at"], plain, acc["off"])))
        token = F.struct((behind + 1).alias("at"), (off - 1).alias("off"), F.concat(before, F.array(segment(inner, behind, off))).alias("out"))
        return F.when(x["n"].isNull(), F.struct(plain.alias("at"), acc["off"].alias("off"), before.alias("out"))).otherwise(token)

    return F.aggregate(rows, start, step, lambda a: F.filter(a["out"], lambda s: s["end"] > s["start"]))


@dataclass(frozen=True)
class SourceMap:
    """Where each stretch of a text comes from: it begins at ``starts[k]``, ``offsets[k]`` added gives the place in ``files[k]``."""

    starts: tuple[int, ...]
    offsets: tuple[int, ...]
    files: tuple[str, ...]

    def __post_init__(self):
        if not len(self.starts) == len(self.offsets) == len(self.files) or list(self.starts) != sorted(self.starts) or self.starts[:1] != (0,):
            raise ValueError("starts must ascend from 0, with an offset and a file each")

    def __call__(self, pos: int) -> tuple[str, int]:
        k = max(0, bisect.bisect_right(self.starts, pos) - 1)
        return self.files[k], pos + self.offsets[k]


def neutral(name: str = "") -> SourceMap:
    """The map of a text that is as it was."""
    return SourceMap((0,), (0,), (name,))


def chained(maps: list[Callable[[int], tuple[str, int]]], pos: int) -> tuple[str, int]:
    """A position led back through maps, the last one first."""
    name = ""
    for m in reversed(maps):
        name, pos = m(pos)
    return name, pos


@dataclass(frozen=True)
class Preprocessed:
    """A text that came out of preprocessing, how positions lead back, and errors (position in the original, message)."""

    text: str
    source: Callable[[int], tuple[str, int]]
    errors: tuple[tuple[int, str], ...] = ()


Preprocessor = Callable[[str, str], Preprocessed]


def nothing(text: str, name: str = "") -> Preprocessed:
    """A preprocessor that leaves the text as it is."""
    return Preprocessed(text, neutral(name))


def tokenizer(f: Callable[[str], tuple[str, list[tuple[int, str]]]]) -> Preprocessor:
    """A preprocessor from a function that gives the text with tokens put in, and errors."""

    def run(text: str, name: str = "") -> Preprocessed:
        out, errors = f(text)
        starts, offsets, off = [0], [0], 0
        for m in TOKEN.finditer(out):
            off -= len(m[1]) + 2
            starts.append(m.start(2))
            offsets.append(off)
            off -= 1
            starts.append(m.end())
            offsets.append(off)
        return Preprocessed(out, SourceMap(tuple(starts), tuple(offsets), (name,) * len(starts)), tuple(errors))

    return run


def includes(files: dict[str, str], pattern: str = r'include\("([^"]*)"\)') -> Preprocessor:
    """A preprocessor that puts in the files that a text names."""
    from .text import expand_includes

    def run(text: str, name: str = "") -> Preprocessed:
        try:
            out, segments = expand_includes(name, files | {name: text}, pattern)
        except ValueError as e:
            return Preprocessed(text, neutral(name), ((0, str(e)),))
        return Preprocessed(out, SourceMap(tuple(s[0] for s in segments) or (0,), tuple(s[2] for s in segments) or (0,), tuple(s[3] for s in segments) or (name,)))

    return run


def chain(*steps: Preprocessor) -> Preprocessor:
    """Preprocessors one after another; positions are led back through all of them."""

    def run(text: str, name: str = "") -> Preprocessed:
        maps, errors = [], []
        for step in steps:
            got = step(text, name)
            errors += [(chained(maps, p)[1] if maps else p, m) for p, m in got.errors]
            text = got.text
            maps.append(got.source)
        return Preprocessed(text, lambda pos: chained(maps, pos) if maps else (name, pos), tuple(errors))

    return run


# -- errors in their source


def visualize(text: Column, pos: Column) -> Column:
    """The line of a position, and below it a caret."""
    before = F.substring_index(F.substring(text, F.lit(1), pos), "\n", -1)
    rest = F.substring_index(F.substring(text, pos + 1, F.length(text)), "\n", 1)
    return F.concat(before, rest, F.lit("\n"), F.repeat(F.lit(" "), F.length(before)), F.lit("^\n"))


def error_range(text: Column, pos: Column, length: Column) -> Column:
    """Struct (start, end) of (line, character), both from 0, of an error; it does not reach beyond the text."""
    from .text import line_col

    end = F.least(pos + length, F.length(text))
    place = lambda p: F.struct((line_col(text, p)["line"] - 1).alias("line"), (line_col(text, p)["col"] - 1).alias("character"))
    return F.struct(place(pos).alias("start"), place(end).alias("end"))


def diagnostic(text: Column, error: Column) -> Column:
    """Struct (range, severity, code, message) as editors want it: 1 error, 2 warning, 3 notice."""
    severity = F.when(error["code"] < 100, 3).when(error["code"] < 1000, 2).otherwise(1)
    return F.struct(error_range(text, error["pos"], error["length"]).alias("range"), severity.alias("severity"), error["code"].alias("code"), error["message"].alias("message"))


def error_string(file: Column | str, text: Column, error: Column) -> Column:
    """``file:line:column: severity (code): message``."""
    from .text import line_col, severity

    at = line_col(text, error["pos"])
    kind = severity(error["code"])
    return F.concat_ws(":", file if isinstance(file, Column) else F.lit(file), at["line"].cast("string"), at["col"].cast("string"), F.concat(F.lit(" "), F.initcap(kind), F.lit(" ("), error["code"].cast("string"), F.lit("): "), error["message"]))


def error_signature(text: Column, error: Column) -> Column:
    """Line, column and code in one number: equal errors have equal signatures."""
    from .text import line_col

    at = line_col(text, error["pos"])
    return F.shiftleft(at["line"].cast("long"), 32).bitwiseOR(F.shiftleft(at["col"].cast("long"), 16)).bitwiseOR(error["code"].cast("long"))


def error_leaf(tree: Column, error: Column) -> Column:
    """The last leaf that begins at or before an error's position, to which it belongs."""
    return F.element_at(F.filter(tree, lambda n: n["text"].isNotNull() & (n["pos"] <= error["pos"])), -1)


def errors_below(tree: Column, errors: Column, node: Column) -> Column:
    """The errors whose leaf is the node or stands below it."""
    return F.filter(errors, lambda e: error_leaf(tree, e)["nid"].between(node["nid"], node["last"]))
