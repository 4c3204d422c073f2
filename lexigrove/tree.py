"""The tree model: a pre-order, interval-encoded node array as a column, and its nested form inside kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import types as T

LEAF_NAMES = (":Text", ":RegExp", ":Whitespace", ":EMPTY", ":CharRef", ":EntityRef")
ZOMBIE = "ZOMBIE__"
SKIPPED = ("_skip_", "_resume_")

NODE_TYPE = T.StructType(
    [
        T.StructField("nid", T.IntegerType()),  # pre-order rank, root = 0
        T.StructField("pid", T.IntegerType()),  # parent, -1 at the root
        T.StructField("last", T.IntegerType()),  # last descendant, nid for a leaf
        T.StructField("depth", T.IntegerType()),
        T.StructField("ord", T.IntegerType()),  # rank among the siblings
        T.StructField("name", T.StringType()),
        T.StructField("text", T.StringType()),  # of leaves, null for branches
        T.StructField("cs", T.IntegerType()),  # [cs, ce) in the content
        T.StructField("ce", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),  # in the source, null if unset
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("attr_keys", T.ArrayType(T.StringType())),
    ]
)
TREE_TYPE = T.ArrayType(NODE_TYPE)
ERROR_TYPE = T.StructType([T.StructField(n, t) for n, t in (("pos", T.IntegerType()), ("length", T.IntegerType()), ("code", T.IntegerType()), ("message", T.StringType()))])


class Node:
    """A nested node: text or children, never both."""

    __slots__ = ("name", "text", "children", "attrs", "pos")

    def __init__(self, name: str, result: str | list[Node] = "", attrs: dict[str, str] | None = None, pos: int | None = None):
        self.name, self.attrs, self.pos = name, attrs or {}, pos
        self.text, self.children = (result, None) if isinstance(result, str) else (None, list(result))
        if self.children == []:
            self.text, self.children = "", None

    @property
    def anonymous(self) -> bool:
        return not self.name or self.name[0] == ":"

    @property
    def result(self) -> str | list[Node]:
        return self.text if self.children is None else self.children

    @result.setter
    def result(self, value: str | list[Node]) -> None:
        if isinstance(value, str):
            self.text, self.children = value, None
        elif value:
            self.text, self.children = None, list(value)
        else:
            self.text, self.children = "", None

    @property
    def content(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if n.children is None:
                out.append(n.text)
            else:
                stack += n.children[::-1]
        return "".join(out)

    def copy(self) -> Node:
        """A deep copy without recursion."""
        top = Node(self.name, "", dict(self.attrs), self.pos)
        stack = [(self, top)]
        while stack:
            old, new = stack.pop()
            if old.children is None:
                new.text = old.text
            else:
                new.children, new.text = [Node(c.name, "", dict(c.attrs), c.pos) for c in old.children], None
                stack += zip(old.children, new.children, strict=True)
        return top

    def walk(self, include_root: bool = True, reverse: bool = False, skip: Callable[[Node], bool] | None = None) -> Iterator[Node]:
        """Pre-order (or with children reversed); the descendants of nodes that ``skip`` accepts are left out."""
        stack = [self]
        while stack:
            n = stack.pop()
            if include_root or n is not self:
                yield n
            if n.children is not None and not (skip and n is not self and skip(n)):
                stack += n.children if reverse else n.children[::-1]

    def equals(self, other: Node, ignore_attr_order: bool = True) -> bool:
        pairs = [(self, other)]
        while pairs:
            a, b = pairs.pop()
            if a.name != b.name or a.attrs != b.attrs or a.text != b.text or (not ignore_attr_order and list(a.attrs) != list(b.attrs)):
                return False
            if a.children is not None:
                if len(a.children) != len(b.children or []):
                    return False
                pairs += zip(a.children, b.children, strict=True)
        return True

    def __repr__(self) -> str:
        return f"Node({self.name!r}, {self.result!r})"


def set_positions(root: Node, pos: int = 0) -> Node:
    """Source offsets by running lengths for all nodes that have none yet."""
    for n in root.walk():
        if n.pos is None:
            n.pos = pos
        if n.children is None:
            pos += len(n.text)
    return root


def encode(root: Node) -> list[dict]:
    """Rows of the node array; childless nodes are leaves even if they are empty."""
    rows: list[dict] = []
    at = 0
    stack: list[tuple[Node | None, int, int, int]] = [(root, -1, 0, 0)]
    while stack:
        node, pid, depth, order = stack.pop()
        if node is None:  # all below row pid is done
            rows[pid]["last"], rows[pid]["ce"] = len(rows) - 1, at
            continue
        nid, leaf = len(rows), node.children is None
        rows.append({"nid": nid, "pid": pid, "last": nid, "depth": depth, "ord": order, "name": node.name, "text": node.text, "cs": at, "ce": at, "pos": node.pos, "attrs": node.attrs, "attr_keys": list(node.attrs)})
        if leaf:
            at += len(node.text)
            rows[nid]["ce"] = at
        else:
            stack.append((None, nid, 0, 0))
            stack += [(c, nid, depth + 1, k) for k, c in reversed(list(enumerate(node.children)))]
    return rows


def decode(rows: list[dict] | None) -> Node | None:
    """The nested form of a node array; None for none."""
    if not rows:
        return None
    made: list[Node] = []
    for r in rows:
        attrs = r["attrs"] or {}
        attrs = dict(attrs) if not isinstance(attrs, list) else dict(attrs)
        node = Node(r["name"], r["text"] or "", {k: attrs[k] for k in r["attr_keys"] or attrs}, r["pos"])
        made.append(node)
        if r["pid"] >= 0:
            parent = made[r["pid"]]
            if parent.children is None:
                parent.children, parent.text = [], None
            parent.children.append(node)
    return made[0]


def check(rows: list[dict]) -> list[str]:
    """Violations of the encoding's laws."""
    out = []
    for i, r in enumerate(rows):
        if r["nid"] != i or not r["pid"] < i <= r["last"] < len(rows):
            out.append(f"order at {i}")
        if i and not (rows[r["pid"]]["last"] >= r["last"] and rows[r["pid"]]["cs"] <= r["cs"] <= r["ce"] <= rows[r["pid"]]["ce"]):
            out.append(f"nesting at {i}")
        if (r["last"] == i) != (r["text"] is not None):
            out.append(f"leaf at {i}")
    return out
