"""Files of grammars' unit cases: read, merged, written, as a table of cases for ``compile.unit_cases``, and reported.

A unit is ``{symbol: {stage: {name: code}}}``. Stages are ``match`` and ``fail``, whose codes are inputs, and others
(``cst``, ``ast``, ...), whose codes are what the input of the match of the same name must give.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from textwrap import dedent, indent

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Unit = dict[str, dict[str, dict[str, str]]]
INPUTS = ("match", "fail")
QUOTES = ('"""', "'''", '"', "'")
_HEAD = re.compile(r"\[\s*(\w+)\s*:\s*(\w+)\s*\]\s*$")
_KEY = re.compile(r"([\w.*-]+)\s*[:=]\s?(.*)$", re.S)


def code(text: str) -> str:
    """A value without its quotes, or without the indentation that its lines share after the first."""
    bare = text.strip()
    for q in QUOTES:
        if len(bare) >= 2 * len(q) and bare.startswith(q) and bare.endswith(q):
            return bare[len(q) : -len(q)]
    first, _, rest = bare.partition("\n")
    return first + ("\n" + dedent(rest) if rest else "")


def read_ini(text: str) -> Unit:
    """Sections ``[stage:symbol]`` of entries ``name: code``; indented lines go on with an entry, as all lines do up to its closing triple quote.

    Lines that start with ``#`` or ``;`` between entries are comments. ValueError, with the line, for anything else and for repeated names.
    """
    unit: Unit = {}
    section, name, value = None, None, []

    def close(line: int) -> None:
        if name is None:
            return
        if any(k.rstrip("*") == name.rstrip("*") for k in section):
            raise ValueError(f"line {line}: {name} is there already")
        section[name] = code("\n".join(value))

    is_open = lambda: any((t := "\n".join(value).strip()).startswith(q) and (len(t) < 6 or not t.endswith(q)) for q in QUOTES[:2])
    lines = text.expandtabs(4).split("\n")
    for at, line in enumerate(lines, 1):
        if name is not None and (is_open() or line[:1] == " " or not line.strip()):
            value.append(line)
        elif not line.strip() or line[0] in "#;":
            continue
        elif head := _HEAD.match(line):
            close(at)
            name, section = None, unit.setdefault(head[2], {}).setdefault(head[1].lower(), {})
        elif section is not None and (entry := _KEY.match(line)):
            close(at)
            name, value = entry[1], [entry[2]]
        else:
            raise ValueError(f"line {at}: a section or an entry is expected")
    close(len(lines))
    return unit


def read_json(text: str) -> Unit:
    """A JSON object of the form of a unit; keys of stages in lower case, names as strings."""
    return {symbol: {stage.lower(): {str(n): c for n, c in entries.items()} for stage, entries in stages.items()} for symbol, stages in json.loads(text).items()}


def read(path: str, text: str) -> Unit:
    return read_json(text) if path.endswith(".json") else read_ini(text)


def merged(*units: Unit) -> Unit:
    """All cases of units; ValueError if two differ under one name."""
    out: Unit = {}
    for unit in units:
        for symbol, stages in unit.items():
            known = out.setdefault(symbol, {})
            for stage, entries in stages.items():
                there = known.setdefault(stage, {})
                for name, value in entries.items():
                    if there.setdefault(name, value) != value:
                        raise ValueError(f"{stage}:{symbol}:{name} differs")
    return out


def quoted(text: str) -> str:
    """A value as ``read_ini`` reads it back. ValueError if it has both triple quotes."""
    for q in QUOTES[2:] if "\n" not in text else QUOTES[:2]:
        if q not in text:
            return q + text + q
    for q in QUOTES[:2]:
        if q not in text and not text.endswith(q[0]):
            return q + text + q
    raise ValueError("both triple quotes inside a value")


def write_ini(unit: Unit) -> str:
    return "\n".join(f"[{stage}:{symbol}]\n" + "".join(f"{n}: {quoted(c)}\n" for n, c in entries.items()) for symbol, stages in unit.items() for stage, entries in stages.items())


def cases(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """path, symbol, kind, name, input, expect, error: the cases of each file, in a map.

    A file that cannot be read is one row with an error, as is an expectation without a match of its name. Null texts: no rows.
    """

    def rows(path: str | None, text: str) -> Iterator[tuple]:
        try:
            unit = read(path or "", text)
        except (ValueError, AttributeError) as e:
            yield None, None, None, None, None, f"{type(e).__name__}: {e}"
            return
        for symbol, stages in unit.items():
            inputs = {n.rstrip("*"): c for n, c in stages.get("match", {}).items()}
            for kind, entries in stages.items():
                for name, value in entries.items():
                    given = value if kind in INPUTS else inputs.get(name.rstrip("*"))
                    yield symbol, kind, name, given, None if kind in INPUTS else value, None if given is not None else "no match of this name"

    kinds = [pa.string()] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], []
            for at, (path, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                found = [] if text is None else list(rows(path, text))
                of += [at] * len(found)
                out += found
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *columns], ["path", "symbol", "kind", "name", "input", "expect", "error"])

    some = files.select(F.col(f"`{path_col}`").cast("string"), F.col(f"`{text_col}`"))
    return some.mapInArrow(run, "path string, symbol string, kind string, name string, input string, expect string, error string")


def report() -> Column:
    """A row of results (symbol, kind, name, passed, got) as a section of Markdown."""
    block = F.concat(F.lit("    "), F.replace("got", F.lit("\n"), F.lit("\n    ")))
    head = F.concat(F.lit("### "), F.col("symbol"), F.lit(", "), F.col("kind"), F.lit(" "), F.col("name"), F.lit(": "), F.when(F.col("passed"), "passed").otherwise("failed"))
    return F.concat_ws("\n\n", head, block)


def unit_report(unit: Unit) -> str:
    """The cases of a unit as Markdown."""
    return "\n".join(f"## {symbol}\n" + "".join(f"\n### {stage} {name}\n\n{indent(value, '    ')}\n" for stage, entries in stages.items() for name, value in entries.items()) for symbol, stages in unit.items())
