"""Compilation: a visitor with one method per node name, run over a tree column; and a runner for grammars' unit cases."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..plans import kernel
from ..plans.ir import Grammar
from ..sources.serde import as_sxpr, nodes_of, parse_sxpr
from ..tree import ERROR_TYPE, Node
from . import rewrite as R

CRASHED = 10500


class Compiler:
    """Base of visitors: ``on_<name>`` methods take a node and return its compiled form; others get ``fallback``.

    ``path`` holds the nodes from the root to the current one. ``prepare`` runs before, ``finish`` gets the result.
    """

    def __init__(self):
        self.path: list[Node] = []
        self.errors: list[tuple[int, int, str]] = []

    @staticmethod
    def method_name(name: str) -> str:
        return "on_" + name.replace(":", "_").replace("-", "_").replace(".", "_")

    def prepare(self, root: Node) -> None:
        pass

    def finish(self, result: object) -> object:
        return result

    def error(self, node: Node, message: str, code: int = 1000) -> None:
        self.errors.append((node.pos or 0, code, message))

    def attributes(self, node: Node) -> None:
        """Calls ``attr_<name>(node, value)`` for the attributes that have such a method."""
        for k, v in list(node.attrs.items()):
            method = getattr(self, "attr_" + k.replace(":", "_").replace("-", "_"), None)
            if method:
                method(node, v)

    def fallback(self, node: Node) -> object:
        """Children compiled, those that give nothing left out; a leaf as it is."""
        if node.children is None:
            return node
        kids = [x for c in node.children if (x := self.compile(c)) is not None]
        if all(isinstance(x, Node) for x in kids):
            node.result = kids
            return node
        return kids

    def compile(self, node: Node) -> object:
        self.path.append(node)
        try:
            self.attributes(node)
            return getattr(self, self.method_name(node.name), self.fallback)(node)
        finally:
            self.path.pop()

    def __call__(self, root: Node) -> object:
        self.path, self.errors = [], []
        self.prepare(root)
        return self.finish(self.compile(root))


def compiled(df: DataFrame, make: Callable[[], Compiler], tree: str = "tree", keep: list[str] | None = None, errors: str = "errors") -> DataFrame:
    """``keep`` columns, ``data`` (the result as JSON text; trees as S-expressions) and the errors found.

    A crash of the visitor is an error of its own, unless the tree had errors before (``errors``, if ``df`` has it): then these
    tell more.
    """
    had = errors in df.columns
    keep = [c for c in (keep or df.columns) if c not in (tree, errors)]
    kind = T.ArrayType(ERROR_TYPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor = make()
        for batch in batches:
            data, found = [], []
            before = batch.column(len(keep) + 1).to_pylist() if had else [[]] * batch.num_rows
            for root, known in zip(nodes_of(batch.column(len(keep))), before, strict=True):
                known = list(known or [])
                visitor.errors, value = [], None
                if root is not None:
                    try:
                        value = visitor(root)
                    except Exception as e:  # any bug of a visitor is a row
                        if not known:
                            visitor.errors.append((0, CRASHED, f"{type(e).__name__}: {e}"))
                data.append(None if value is None else as_sxpr(value) if isinstance(value, Node) else json.dumps(value, ensure_ascii=False, default=str))
                found.append(known + [{"pos": p, "length": 1, "code": c, "message": m} for p, c, m in visitor.errors])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(data, pa.string()), pa.array(found, to_arrow_type(kind))], [*keep, "data", "errors"])

    some = df.select(*[F.col(f"`{c}`") for c in keep], tree, *([errors] if had else []))
    return some.mapInArrow(run, T.StructType([some.schema[c] for c in keep] + [T.StructField("data", T.StringType()), T.StructField("errors", kind)]))


def unit_cases(cases: DataFrame, plan: Grammar, table: dict | None = None, keep: list[str] | None = None) -> DataFrame:
    """Runs cases (symbol, kind, name, input, expect) of a grammar: ``keep`` columns, symbol, kind, name, passed, got.

    ``match``: no errors of 1000 or more; ``fail``: such an error; ``cst``: the tree equals the expected S-expression; ``ast``: so
    does the tree rewritten by the table.
    """
    names, keep = ["symbol", "kind", "name", "input", "expect"], keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = kernel.Parser(plan)
        for batch in batches:
            out = []
            for case in batch.select(names).to_pylist():
                tree, errors, _ = parser.parse(case["input"] or "", case["symbol"])
                bad = any(c >= 1000 for _, _, c, _ in errors)
                if case["kind"] == "ast":
                    R.traverse(tree, table or {})
                got = as_sxpr(tree)
                if case["kind"] in ("cst", "ast"):
                    passed = not bad and parse_sxpr(case["expect"]).equals(tree)
                else:
                    passed = bad == (case["kind"] == "fail")
                out.append((case["symbol"], case["kind"], case["name"], passed, got))
            found = [pa.array([x[k] for x in out], pa.bool_() if k == 3 else pa.string()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *found], [*keep, "symbol", "kind", "name", "passed", "got"])

    some = cases.select(*[F.col(f"`{c}`") for c in keep], *names)
    result = T.StructType([T.StructField(n, T.BooleanType() if n == "passed" else T.StringType()) for n in ("symbol", "kind", "name", "passed", "got")])
    return some.mapInArrow(run, T.StructType([*(some.schema[c] for c in keep), *result]))
