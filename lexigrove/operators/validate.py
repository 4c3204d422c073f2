"""Validation of trees by schemas that are trees themselves: what children, texts and attributes a node may have.

A schema node's name says what it asks of the data; ``name`` names the node that it is about.

``leaf``: a leaf, its text as the pattern ``content``; ``branch``: a node whose children fit the schema's only child;
``series``: one after another; ``alternative``: the first that fits; ``optional``, ``zero_or_more``, ``one_or_more``: so many
times; ``interleave``: each once in any order; ``forward``: the schema that ``name`` was given elsewhere (``define``).
Attributes: ``attributes`` lists names with commas (a last ``*``: others may stand there), ``values`` patterns for them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.serde import nodes_of
from ..tree import ERROR_TYPE, Node

INVALID = 1200
RELAX = ("leaf", "branch", "series", "alternative", "optional", "zero_or_more", "one_or_more", "interleave", "forward")


def is_schema(schema: Node, language: tuple[str, ...] | dict = RELAX) -> bool:
    """Whether all nodes have names of the language."""
    return all(n.name in language for n in schema.walk())


def verify_attributes(schema: Node, node: Node) -> list[str]:
    """What is wrong with a node's attributes; nothing if the schema does not speak of them."""
    if "attributes" not in schema.attrs:
        return []
    names = [x.strip() for x in schema.attrs["attributes"].split(",") if x.strip()]
    free = names[-1:] == ["*"]
    names = names[:-1] if free else names
    patterns = schema.attrs["values"].split(",") if "values" in schema.attrs else [".*"] * len(names)
    if len(patterns) != len(names):
        raise ValueError(f"{len(names)} attributes, but {len(patterns)} values")
    out = [f"{node.name} lacks the attribute {n}" for n in names if n not in node.attrs]
    out += [f"attribute {n} of {node.name} does not match {p}" for n, p in zip(names, patterns, strict=True) if n in node.attrs and not re.fullmatch(p, node.attrs[n])]
    return out if free else out + [f"{node.name} may not have the attribute {n}" for n in node.attrs if n not in names]


class Validator:
    """Checks trees against a schema. Schemas with a ``define`` attribute can be named by ``forward``."""

    def __init__(self, schema: Node):
        if not is_schema(schema):
            raise ValueError("not a schema: " + ", ".join(sorted({n.name for n in schema.walk()} - set(RELAX))))
        self.schema, self.named = schema, {n.attrs["define"]: n for n in schema.walk() if "define" in n.attrs}

    def fits(self, schema: Node, nodes: list[Node], at: int, errors: list[tuple[int, str]]) -> Iterator[int]:
        """Places behind what the schema can take of the nodes from ``at`` on; ``errors`` gets what the nodes themselves lack."""
        kind, parts = schema.name, schema.children or []
        if kind == "forward":
            yield from self.fits(self.named[schema.attrs["name"]], nodes, at, errors)
        elif kind in ("leaf", "branch"):
            if at < len(nodes) and nodes[at].name == schema.attrs.get("name", nodes[at].name) and (nodes[at].children is None) == (kind == "leaf" or not nodes[at].children):
                yield at + 1
        elif kind == "alternative":
            for p in parts:
                yield from self.fits(p, nodes, at, errors)
        elif kind == "series":
            yield from self.series(parts, nodes, at, errors)
        elif kind == "interleave":
            if not parts:
                yield at
            for k, p in enumerate(parts):
                for to in self.fits(p, nodes, at, errors):
                    yield from self.fits(Node("interleave", parts[:k] + parts[k + 1 :]), nodes, to, errors)
        else:
            if kind != "one_or_more":
                yield at
            seen, new = {at} if kind != "one_or_more" else set(), [at]
            while new:
                found = sorted({to for a in new for to in self.series(parts, nodes, a, errors)} - seen)
                yield from found
                new = [] if kind == "optional" else [x for x in found if x not in seen]
                seen.update(found)

    def series(self, parts: list[Node], nodes: list[Node], at: int, errors: list[tuple[int, str]]) -> Iterator[int]:
        if not parts:
            yield at
        else:
            for to in self.fits(parts[0], nodes, at, errors):
                yield from self.series(parts[1:], nodes, to, errors)

    def about(self, schema: Node, name: str) -> Node | None:
        """The schema of a child's name among those that make up its parent's content."""
        stack = list(schema.children or [])
        while stack:
            s = stack.pop(0)
            s = self.named[s.attrs["name"]] if s.name == "forward" else s
            if s.name in ("leaf", "branch"):
                if s.attrs.get("name", name) == name:
                    return s
            else:
                stack = [*(s.children or []), *stack]
        return None

    def check(self, root: Node) -> list[tuple[int, str]]:
        """(position, message) of all that does not fit, in the order of the tree."""
        out: list[tuple[int, str]] = []
        if 1 not in self.fits(self.schema, [root], 0, out):
            return [(root.pos or 0, f"{root.name} is not what the schema asks for")]
        stack = [(root, self.about(Node("series", [self.schema]), root.name))]
        while stack:
            node, schema = stack.pop()
            if schema is None:
                continue
            out += [(node.pos or 0, m) for m in verify_attributes(schema, node)]
            if schema.name == "leaf":
                if "content" in schema.attrs and not re.fullmatch(schema.attrs["content"], node.text or ""):
                    out.append((node.pos or 0, f"{node.name} does not match {schema.attrs['content']}"))
                continue
            kids = node.children or []
            if schema.children and len(kids) not in self.series(schema.children, kids, 0, out):
                out.append((node.pos or 0, f"{node.name} may not have {', '.join(c.name for c in kids) or 'nothing'} in it"))
                continue
            stack += [(c, self.about(schema, c.name)) for c in reversed(kids)]
        return out


def validated(df: DataFrame, schema: Node, tree: str = "tree", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``tree`` and ``invalid``: errors of all that does not fit the schema. Null trees have none."""
    keep = [c for c in (keep or df.columns) if c != tree]
    kind = T.ArrayType(ERROR_TYPE)
    make: Callable[[], Validator] = lambda: Validator(schema)
    make()  # a bad schema fails here and not in a worker

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        validator = make()
        for batch in batches:
            found = [[] if root is None else [{"pos": p, "length": 1, "code": INVALID, "message": m} for p, m in validator.check(root)] for root in nodes_of(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], pa.array(found, to_arrow_type(kind))], [*keep, tree, "invalid"])

    some = df.select(*[F.col(f"`{c}`") for c in keep], tree)
    return some.mapInArrow(run, T.StructType([*(some.schema[c] for c in keep), some.schema[tree], T.StructField("invalid", kind)]))
