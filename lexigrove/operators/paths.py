"""Paths (lists of nodes from the root) and content mappings of nested trees, and kernels that compute values from trees.

These are the forms for steps that run inside a kernel call; ``select`` has those that stay columns.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.serde import nodes_of
from ..tree import Node
from . import markup as M

Path = list[Node]
Test = Callable[[Node], bool]


def node_test(selector: object) -> Test:
    """A function of a node from a name, a set of names, a pattern of the whole content, a node itself, or such a function."""
    if isinstance(selector, str):
        return lambda n: n.name == selector
    if isinstance(selector, (set, frozenset, tuple, list)):
        return lambda n: n.name in selector
    if isinstance(selector, re.Pattern):
        return lambda n: selector.fullmatch(n.content) is not None
    if isinstance(selector, Node):
        return lambda n: n is selector
    if selector is None or isinstance(selector, bool):
        return lambda n: bool(selector)
    return selector


def path_test(selector: object) -> Callable[[Path], bool]:
    """A function of a path: the selector holds for its last node; a pattern of slashes and stars for its names."""
    if isinstance(selector, str) and "/" in selector:
        import fnmatch

        rx = re.compile(fnmatch.translate(selector))
        return lambda p: rx.match("/" + "/".join(n.name for n in p)) is not None
    test = node_test(selector)
    return lambda p: test(p[-1])


ANY = lambda n: True
LEAF = lambda n: n.children is None
BRANCH = lambda n: n.children is not None


# -- paths below a node


def walk_paths(root: Node, include_root: bool = True, reverse: bool = False, skip: object = None, start: Path | None = None) -> Iterator[Path]:
    """Paths of all nodes in pre-order; nothing below nodes that ``skip`` accepts. ``start``: the path that ends with ``root``."""
    wall = node_test(skip)
    first = start or [root]
    stack = [first]
    while stack:
        p = stack.pop()
        if include_root or p[-1] is not root:
            yield p
        if p[-1].children is not None and not (p[-1] is not root and wall(p[-1])):
            stack += [[*p, c] for c in (p[-1].children if reverse else p[-1].children[::-1])]


def select_paths(root: Node, selector: object, include_root: bool = False, reverse: bool = False, skip: object = None) -> Iterator[Path]:
    test = path_test(selector)
    return (p for p in walk_paths(root, include_root, reverse, skip) if test(p))


def pick_path(root: Node, selector: object, include_root: bool = False, reverse: bool = False, skip: object = None) -> Path | None:
    return next(select_paths(root, selector, include_root, reverse, skip), None)


def reconstruct(root: Node, node: Node) -> Path | None:
    """The path to a node of the tree."""
    return next((p for p in walk_paths(root) if p[-1] is node), None)


def locate_path(root: Node, offset: int) -> Path | None:
    """The path of the leaf that covers an offset of the content."""
    at = 0
    for p in select_paths(root, LEAF, include_root=True):
        if at <= offset < at + len(p[-1].text):
            return p
        at += len(p[-1].text)
    return None


# -- from path to path


def prev_path(p: Path | None) -> Path | None:
    """The path of the sibling before, or of the nearest ancestor's sibling before; None at the first node."""
    return _beside(p, -1)


def next_path(p: Path | None) -> Path | None:
    """The path of the sibling behind, or of the nearest ancestor's sibling behind; None at the last node."""
    return _beside(p, 1)


def _beside(p: Path | None, way: int) -> Path | None:
    for depth in range(len(p or ()) - 1, 0, -1):
        row = p[depth - 1].children
        k = next(i for i, c in enumerate(row) if c is p[depth]) + way
        if 0 <= k < len(row):
            return [*p[:depth], row[k]]
    return None


def first_child(n: Node) -> Node:
    return n.children[0]


def last_child(n: Node) -> Node:
    return n.children[-1]


def zoom_into(p: Path | None, pick: Callable[[Node], Node] = first_child, steps: int = -1) -> Path | None:
    """The path so many generations further, along the children that ``pick`` chooses; below 0: down to a leaf."""
    out = list(p or ())
    while out and out[-1].children and steps:
        out.append(pick(out[-1]))
        steps -= 1
    return out or None


def leaf_path(p: Path) -> Path:
    return zoom_into(p, first_child)


def prev_leaf(p: Path | None) -> Path | None:
    return zoom_into(prev_path(p), last_child)


def next_leaf(p: Path | None) -> Path | None:
    return zoom_into(next_path(p), first_child)


def select_from_path(p: Path, selector: object, reverse: bool = False) -> Iterator[Node]:
    test = node_test(selector)
    return (n for n in (reversed(p) if reverse else p) if test(n))


def pick_from_path(p: Path, selector: object, reverse: bool = False) -> Node | None:
    return next(select_from_path(p, selector, reverse), None)


def common_ancestor(a: Path, b: Path) -> tuple[Node | None, int]:
    """The last node that two paths share and its place in them; (None, -1) if they have no root in common."""
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x is not y), min(len(a), len(b)))  # noqa: B905
    return (a[k - 1], k - 1) if k else (None, -1)


def shown(p: Path, contents: int = 0, most: int | None = None, delimiter: str = " <- ") -> str:
    """Names along the path, with the contents of its last nodes (below 0: of all), cut to ``most`` characters."""
    n = len(p) if contents < 0 else contents
    cut = lambda s: s if most is None or len(s) <= most else s[: most // 2 - 2] + " ... " + s[-(most // 2 - 3) :]
    return delimiter.join(x.name if k < len(p) - n else f'{x.name} "{cut(x.content)}"' for k, x in enumerate(p))


def is_path(p: Path) -> bool:
    """Whether each node is a child of the one before."""
    return all(any(c is b for c in a.children or ()) for a, b in zip(p[:-1], p[1:], strict=True))


def evaluate_path(root: Node, actions: dict[str, Callable], path: Path | None = None) -> object:
    """A bottom-up fold whose actions get the path to the node, then the children's values or the leaf's text."""
    p = path or [root]
    n = p[-1]
    action = actions.get(n.name) or actions.get("*")
    if action is None:
        raise KeyError(n.name)
    return action(p, *([n.text] if n.children is None else [evaluate_path(root, actions, [*p, c]) for c in n.children]))


# -- mappings


class Mapping:
    """The content of (selected) leaves with the path and the place of each: positions of the text lead to nodes and back.

    ``select`` and ``ignore`` hold for nodes: a leaf counts if it or a node above it is selected and none is ignored.
    """

    def __init__(self, root: Node, select: object = ANY, ignore: object = None, stump: Path | None = None):
        self.root, self.stump = root, list(stump or ())
        self.wanted, self.unwanted = node_test(select), node_test(ignore)
        self.rebuild()

    def rebuild(self) -> None:
        """Reads the whole tree again."""
        self.paths = [self.stump + p for p in self._leaves([self.root])]
        self._place()

    def _leaves(self, start: Path) -> list[Path]:
        out = []
        for p in walk_paths(start[-1], start=start):
            if p[-1].children is None and any(map(self.wanted, p)) and not any(map(self.unwanted, p)):
                out.append(p)
        return out

    def _place(self) -> None:
        self.positions, at = [], 0
        for p in self.paths:
            self.positions.append(at)
            at += len(p[-1].text)
        self.content = "".join(p[-1].text for p in self.paths)

    def __str__(self) -> str:
        return "\n".join(f'{at} -> {", ".join(n.name for n in p)} "{p[-1].text}"' for at, p in zip(self.positions, self.paths, strict=True))

    def path(self, index: int) -> Path:
        return self.paths[index]

    def position(self, index: int) -> int:
        return self.positions[index]

    def path_string(self, index: int) -> str:
        return "/" + "/".join(n.name for n in self.paths[index])

    def names(self) -> set[str]:
        """Names of the leaves that count."""
        return {p[-1].name for p in self.paths}

    def path_names(self) -> set[str]:
        return {self.path_string(k) for k in range(len(self.paths))}

    def index(self, position: int, left_biased: bool = False) -> int:
        """The number of the path that a position falls into; at a border the right one, or the left one. IndexError outside."""
        if not 0 <= position <= len(self.content) or not self.paths:
            raise IndexError(position)
        if left_biased and position > 0:
            return bisect.bisect_left(self.positions, position) - 1
        return bisect.bisect_right(self.positions, position) - 1

    def location(self, position: int, left_biased: bool = False) -> tuple[int, Path, int]:
        """(number of the path, path, offset in its leaf)."""
        k = self.index(position, left_biased)
        return k, self.paths[k], position - self.positions[k]

    def node_index(self, node: Node | None, reverse: bool = False) -> int:
        """The number of the first (or last) path that holds a node, -1 if none does."""
        every = range(len(self.paths))
        return next((k for k in (reversed(every) if reverse else every) if any(n is node for n in self.paths[k])), -1)

    def node_position(self, node: Node | None, reverse: bool = False) -> int:
        """Where a node's content begins (or, in reverse, ends), -1 if it is in no path."""
        k = self.node_index(node, reverse)
        return -1 if k < 0 else self.positions[k] + (len(self.paths[k][-1].text) if reverse else 0)

    def between(self, start: int, end: int, left_biased: bool = False) -> Iterator[Path]:
        """The paths from one position to another."""
        return iter(self.paths[self.index(start, left_biased) : self.index(end, True) + 1] if end > start else self.paths[self.index(start, left_biased) :][:1])

    def select(self, selector: object, start: int = 0, end: int | None = None, reverse: bool = False) -> Iterator[Path]:
        """Paths of nodes above or at the leaves, each once, for which the selector holds, between two numbers of paths."""
        test, seen, out = path_test(selector), set(), []
        for p in self.paths[start:end]:
            for k in range(1, len(p) + 1):
                if id(p[k - 1]) not in seen:
                    seen.add(id(p[k - 1]))
                    if test(p[:k]):
                        out.append(p[:k])
        return iter(out[::-1] if reverse else out)

    def pick(self, selector: object, start: int = 0, end: int | None = None, reverse: bool = False) -> Path | None:
        return next(self.select(selector, start, end, reverse), None)

    def rebuild_slice(self, first: int, last: int) -> None:
        """Reads again what is below the last node that the paths ``first`` to ``last`` share, after changes below it."""
        a, b = self.paths[first], self.paths[last]
        node, depth = common_ancestor(a[:-1] or a, b[:-1] or b)
        same = [k for k, p in enumerate(self.paths) if len(p) > depth and p[depth] is node]
        self.paths[same[0] : same[-1] + 1] = self._leaves(a[: depth + 1])
        self._place()

    def rebuild_between(self, start: int, end: int) -> None:
        self.rebuild_slice(self.index(start), self.index(end, True))

    def insert(self, position: int, node: Node) -> None:
        """Puts a node at a position of a mapping that leaves nothing out."""
        M.insert_node(self.root, position, node)
        self.rebuild()

    def markup(self, start: int, end: int, name: str, attrs: dict[str, str] | None = None, divisible: frozenset[str] = frozenset(), chain: str = "") -> int:
        """Wraps [start, end) of the mapped content; what the mapping leaves out stays outside. How many elements it took."""
        # from the mapping's positions to those of the whole content, stretch by stretch
        starts, at = {}, 0
        for p in walk_paths(self.root):
            if p[-1].children is None:
                starts[id(p[-1])] = at
                at += len(p[-1].text)
        runs: list[list[int]] = []
        for place, p in zip(self.positions, self.paths, strict=True):
            a, b = max(start, place), min(end, place + len(p[-1].text))
            if a < b:
                low, high = starts[id(p[-1])] + a - place, starts[id(p[-1])] + b - place
                if runs and runs[-1][1] == low:
                    runs[-1][1] = high
                else:
                    runs.append([low, high])
        n = sum(M.markup(self.root, a, b, name, attrs, divisible, chain) for a, b in reversed(runs))
        self.rebuild()
        return n


class LocalMapping(Mapping):
    """A mapping of the leaves from one path to another only; positions count from the first of them."""

    def __init__(self, start: Path, end: Path, select: object = ANY, ignore: object = None):
        node, depth = common_ancestor(start, end)
        if node is None:
            raise ValueError("the paths have no root in common")
        self.first, self.last = zoom_into(start, first_child)[-1], zoom_into(end, last_child)[-1]
        super().__init__(node, select, ignore, start[:depth])

    def _leaves(self, start: Path) -> list[Path]:
        out = super()._leaves(start)
        order = {id(p[-1]): k for k, p in enumerate(out)}
        return out[order.get(id(self.first), 0) : order.get(id(self.last), len(out) - 1) + 1]


# -- values of trees as columns


def values(df: DataFrame, functions: dict[str, Callable[[Node], object]], tree: str = "tree", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and, for each function of a tree's root, its value as text; a failing function gives its error's name and message.

    Every function gets a copy of its own. Null trees give nulls. One kernel call.
    """
    keep = [c for c in (keep or df.columns) if c != tree]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, columns = nodes_of(batch.column(len(keep))), []
            for f in functions.values():
                out = []
                for root in roots:
                    try:
                        got = None if root is None else f(root.copy())
                    except Exception as e:  # a user's function: an error of its row
                        got = f"{type(e).__name__}: {e}"
                    out.append(None if got is None else str(got))
                columns.append(pa.array(out, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], [*keep, *functions])

    some = df.select(*[F.col(f"`{c}`") for c in keep], tree)
    return some.mapInArrow(run, T.StructType([some.schema[c] for c in keep] + [T.StructField(n, T.StringType()) for n in functions]))
