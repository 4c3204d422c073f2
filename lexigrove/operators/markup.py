"""Content mapping and markup: spans of the content wrapped in elements, trees split at nodes, segments between nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.serde import nodes_of, tree_array
from ..tree import TREE_TYPE, Node, encode
from . import select as S


def mapping(tree: Column, select: S.Selector = S.ANY_NODE, ignore: S.Selector = S.NO_NODE) -> Column:
    """Leaves in order with their offsets in the mapped content (that of selected leaves only) and their names from the root."""
    rows = S.leaves(tree, select, ignore)
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<leaf_idx:int,nid:int,start:int,end:int,names:array<string>>>)").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        end = acc["at"] + F.length(n["text"])
        row = F.struct(F.size(acc["out"]).alias("leaf_idx"), n["nid"].alias("nid"), acc["at"].alias("start"), end.alias("end"), S.path_names(tree, n).alias("names"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    return F.aggregate(rows, start, step, lambda a: a["out"])


def locate(mapped: Column, offset: Column, left_biased: bool = False) -> Column:
    """The mapped leaf that an offset falls into; at a border the right one, or the left one."""
    before = (lambda m: m["start"] < offset) if left_biased else (lambda m: m["start"] <= offset)
    return F.when(offset >= 0, F.element_at(F.filter(mapped, before), -1))


def _index(root: Node) -> list[tuple[list[Node], int]]:
    """Paths of all leaves with the offset of each."""
    out, at = [], 0
    stack: list[list[Node]] = [[root]]
    while stack:
        p = stack.pop()
        if p[-1].children is None:
            out.append((p, at))
            at += len(p[-1].text)
        else:
            stack += [[*p, c] for c in reversed(p[-1].children)]
    return out


def _split_leaf(p: list[Node], at: int) -> list[Node]:
    """The path of the leaf's second part after it has been cut at an offset inside."""
    leaf = p[-1]
    if leaf.anonymous and len(p) > 1:
        new = Node(leaf.name, leaf.text[at:], dict(leaf.attrs), None if leaf.pos is None else leaf.pos + at)
        leaf.text = leaf.text[:at]
        k = next(i for i, c in enumerate(p[-2].children) if c is leaf)
        p[-2].children.insert(k + 1, new)
        return [*p[:-1], new]
    a, b = Node(":Text", leaf.text[:at], pos=leaf.pos), Node(":Text", leaf.text[at:], pos=None if leaf.pos is None else leaf.pos + at)
    leaf.result = [a, b]
    return [*p, b]


def markup(root: Node, start: int, end: int, name: str, attrs: dict[str, str] | None = None, divisible: frozenset[str] = frozenset(), chain: str = "") -> int:
    """Wraps [start, end) of the content; how many elements it took. The content stays as it is.

    Elements that are cut by a border of the span are split if their name is divisible; otherwise the markup itself is
    split into parts that nest properly, numbered in the attribute ``chain`` if one is named.
    """
    if not 0 <= start < end:
        return 0
    for offset in (start, end):
        for p, at in _index(root):
            if at < offset < at + len(p[-1].text):
                _split_leaf(p, offset - at)
                break
    covered = [p for p, at in _index(root) if start <= at and at + len(p[-1].text) <= end and p[-1].text]
    if not covered:
        return 0
    # divisible elements that reach over a border are cut there
    for edge, after in ((covered[0], False), (covered[-1], True)):
        low = 1
        for depth in range(len(edge) - 2, 0, -1):
            if edge[depth].name not in divisible:
                low = depth + 1
                break
        for depth in range(len(edge) - 2, low - 1, -1):
            node, up, child = edge[depth], edge[depth - 1], edge[depth + 1]
            k = next(i for i, c in enumerate(node.children) if c is child) + after
            if 0 < k < len(node.children):
                rest = Node(node.name, node.children[k:], dict(node.attrs), node.children[k].pos)
                node.result = node.children[:k]
                up.children.insert(next(i for i, c in enumerate(up.children) if c is node) + 1, rest)
                if not after:
                    edge[depth] = rest
    covered = [p for p, at in _index(root) if start <= at and at + len(p[-1].text) <= end and p[-1].text]
    inside = {id(p[-1]) for p in covered}

    def whole(n: Node) -> bool:
        return all(id(x) in inside or not x.text for x in n.walk() if x.children is None)

    # the largest nodes that the span covers, in runs of siblings
    tops: list[tuple[Node | None, Node]] = []
    for p in covered:
        k = len(p) - 1
        while k > 1 and whole(p[k - 1]):
            k -= 1
        parent, node = (p[k - 1], p[k]) if k > 0 else (None, p[0])
        if not tops or tops[-1][1] is not node:
            tops.append((parent, node))
    runs: list[tuple[Node | None, list[Node]]] = []
    for parent, node in tops:
        if runs and parent is not None and runs[-1][0] is parent:
            runs[-1][1].append(node)
        else:
            runs.append((parent, [node]))
    for number, (parent, run) in enumerate(runs):
        extra = dict(attrs or {}) | ({chain: f"{start}-{end}:{number}"} if chain and len(runs) > 1 else {})
        if parent is None:
            run[0].result = [Node(name, run[0].result, extra, run[0].pos)]
            continue
        a = next(i for i, c in enumerate(parent.children) if c is run[0])
        b = next(i for i, c in enumerate(parent.children) if c is run[-1])
        inner = parent.children[a : b + 1]
        new = Node(name, inner[0].text if len(inner) == 1 and inner[0].children is None and inner[0].anonymous else inner, extra, run[0].pos)
        parent.children[a : b + 1] = [new]
    return len(runs)


def insert_node(root: Node, offset: int, node: Node) -> None:
    """Puts a node at an offset of the content, cutting a leaf if need be."""
    for p, at in _index(root):
        if at <= offset <= at + len(p[-1].text):
            if at < offset < at + len(p[-1].text):
                p, at = _split_leaf(p, offset - at), offset
            if len(p) == 1:
                p[0].result = [Node(":Text", p[0].text), node] if offset > at else [node, *([Node(":Text", p[0].text)] if p[0].text else [])]
                return
            k = next(i for i, c in enumerate(p[-2].children) if c is p[-1])
            p[-2].children.insert(k + (offset > at), node)
            return
    raise IndexError(offset)


def split(root: Node, milestone: Callable[[Node], bool]) -> list[Node]:
    """The trees between milestone nodes, each with the root's name and the ancestors that hold it; milestones are left out."""
    marks = [n for n in root.walk(include_root=False) if milestone(n)]
    inner = {id(x) for m in marks for x in m.walk(include_root=False)}
    marks = [m for m in marks if id(m) not in inner]
    order = {id(n): k for k, n in enumerate(root.walk())}
    bounds = [-1, *(order[id(m)] for m in marks), len(order)]
    gone = {id(x) for m in marks for x in m.walk()}

    def part(n: Node, low: int, high: int) -> Node | None:
        if id(n) in gone:
            return None
        if n.children is None:
            return Node(n.name, n.text, dict(n.attrs), n.pos) if low < order[id(n)] < high else None
        kids = [x for c in n.children if (x := part(c, low, high)) is not None]
        return Node(n.name, kids, dict(n.attrs), n.pos) if kids else None

    return [part(root, a, b) or Node(root.name, "", dict(root.attrs)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def segment(root: Node, begin: int, end: int) -> Node:
    """The smallest subtree from node ``begin`` to node ``end`` (pre-order ranks, both with all below them), pruned on both sides."""
    order = list(root.walk())
    last: dict[int, int] = {}
    for k, r in enumerate(encode(root)):
        last[k] = r["last"]
    rank = {id(n): k for k, n in enumerate(order)}
    begin, end = min(begin, end), max(begin, end)
    stop = last[end]

    def part(n: Node) -> Node | None:
        k = rank[id(n)]
        if k >= begin and last[k] <= stop:
            return n.copy()
        if n.children is None or last[k] < begin or k > stop:
            return None
        kids = [x for c in n.children if (x := part(c)) is not None]
        return Node(n.name, kids, dict(n.attrs), n.pos) if kids else None

    top = root
    while True:
        k = next((c for c in top.children or () if rank[id(c)] <= begin and stop <= last[rank[id(c)]]), None)
        if k is None:
            return part(top)
        top = k


SPANS = "array<struct<start:int,end:int,name:string>>"


def markup_spans(df: DataFrame, spans: str = "spans", tree: str = "tree", keep: list[str] | None = None, divisible: frozenset[str] = frozenset(), chain: str = "chain") -> DataFrame:
    """``keep`` columns, the ``tree`` with all spans (an array of start, end, name) wrapped, and ``n_parts``, in one kernel call."""
    keep = [c for c in (keep or df.columns) if c not in (tree, spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                part = batch.slice(a, 100)
                trees, counts = [], []
                for root, todo in zip(nodes_of(part.column(len(keep))), part.column(len(keep) + 1).to_pylist(), strict=True):
                    n = 0
                    if root is not None:
                        for s in sorted(todo or [], key=lambda s: (s["start"], -s["end"])):
                            n += markup(root, s["start"], s["end"], s["name"], divisible=divisible, chain=chain)
                    counts.append(n)
                    trees.append(root)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], tree_array(trees), pa.array(counts, pa.int32())], [*keep, tree, "n_parts"])

    some = df.select(*[F.col(f"`{c}`") for c in keep], tree, F.col(spans).cast(SPANS))
    return some.mapInArrow(run, T.StructType([some.schema[c] for c in keep] + [T.StructField(tree, TREE_TYPE), T.StructField("n_parts", T.IntegerType())]))
