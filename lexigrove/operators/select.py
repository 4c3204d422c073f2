"""Selecting and navigating: selectors as columns over a node, operators over the tree column, and joins over node rows.

``tree`` forms are narrow (higher-order functions, no shuffle); ``nodes`` forms work on exploded rows for questions that cross
documents. A selector is a name, a set of names, a compiled pattern on the whole content, or a function from a node's
struct (and the content) to a boolean column.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..tree import NODE_TYPE

Selector = str | set | frozenset | re.Pattern | Callable[[Column], Column] | int


def content(tree: Column) -> Column:
    """The text of a whole tree: its leaves' texts in order."""
    return F.array_join(F.transform(F.filter(tree, lambda n: n["text"].isNotNull()), lambda n: n["text"]), "")


def node_content(text: Column, node: Column) -> Column:
    """A node's text from that of its tree."""
    return F.substring(text, node["cs"] + 1, node["ce"] - node["cs"])


def matcher(selector: Selector, text: Column | None = None) -> Callable[[Column], Column]:
    """A selector as a function from a node's struct to a boolean column. Patterns need the tree's content as ``text``."""
    if isinstance(selector, bool) or selector is None:
        return lambda n: F.lit(bool(selector))
    if isinstance(selector, int):
        return lambda n: n["nid"] == selector
    if isinstance(selector, str):
        return lambda n: n["name"] == selector
    if isinstance(selector, (set, frozenset, list, tuple)):
        return lambda n: n["name"].isin(*sorted(selector))
    if isinstance(selector, re.Pattern):
        if text is None:
            raise ValueError("a pattern needs the tree's content")
        return lambda n: node_content(text, n).rlike(f"^(?:{selector.pattern})\\z")
    return selector


ANY_NODE = lambda n: F.lit(True)
NO_NODE = lambda n: F.lit(False)
LEAF = lambda n: n["last"] == n["nid"]
BRANCH = lambda n: n["last"] > n["nid"]
VOID = lambda n: (n["last"] == n["nid"]) & (n["cs"] == n["ce"])
ANONYMOUS = lambda n: (n["name"] == "") | n["name"].startswith(":")
ZOMBIE_NODE = lambda n: (n["name"] == "ZOMBIE__") | n["name"].rlike("_skip_|_resume_")


def root(tree: Column) -> Column:
    return F.get(tree, F.lit(0))


def select(tree: Column, selector: Selector, include_root: bool = False, reverse: bool = False, skip: Selector | None = None, text: Column | None = None) -> Column:
    """Matching nodes in pre-order (``reverse``: from the end). Nodes below one that ``skip`` matches are left out, itself not."""
    test = matcher(selector, text)
    rows = tree if include_root else F.filter(tree, lambda n: n["pid"] >= 0)
    if skip is not None:
        walls = F.filter(tree, lambda n: matcher(skip, text)(n) & (n["last"] > n["nid"]) & (n["nid"] > 0))
        rows = F.filter(rows, lambda n: ~F.exists(walls, lambda w: (w["nid"] < n["nid"]) & (n["nid"] <= w["last"])))
    out = F.filter(rows, test)
    return F.reverse(out) if reverse else out


def pick(tree: Column, selector: Selector, include_root: bool = False, reverse: bool = False, skip: Selector | None = None, text: Column | None = None) -> Column:
    """The first of the selected nodes, null if there is none."""
    return F.get(select(tree, selector, include_root, reverse, skip, text), F.lit(0))


def children(tree: Column, node: Column, selector: Selector = ANY_NODE) -> Column:
    test = matcher(selector)
    return F.filter(tree, lambda n: (n["pid"] == node["nid"]) & test(n))


def pick_child(tree: Column, node: Column, selector: Selector, reverse: bool = False) -> Column:
    found = children(tree, node, selector)
    return F.element_at(F.when(F.size(found) > 0, found), F.lit(-1 if reverse else 1))


def index(tree: Column, node: Column, selector: Selector) -> Column:
    """Rank of the first matching child, null if none."""
    return F.get(children(tree, node, selector), F.lit(0))["ord"]


def indices(tree: Column, node: Column, selector: Selector) -> Column:
    return F.transform(children(tree, node, selector), lambda n: n["ord"])


def parent(tree: Column, node: Column) -> Column:
    return F.get(tree, F.when(node["pid"] >= 0, node["pid"]))


def descendants(tree: Column, node: Column, selector: Selector = ANY_NODE) -> Column:
    """Nodes below a node: the slice of the array that its interval names."""
    test = matcher(selector)
    return F.filter(F.slice(tree, node["nid"] + 2, node["last"] - node["nid"]), test)


def path(tree: Column, node: Column) -> Column:
    """Nodes from the root to a node: those whose interval holds it."""
    return F.filter(tree, lambda a: (a["nid"] <= node["nid"]) & (node["nid"] <= a["last"]))


def path_names(tree: Column, node: Column) -> Column:
    return F.transform(path(tree, node), lambda n: n["name"])


def path_str(tree: Column, node: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(path_names(tree, node), "/"))


def match_path_str(path_string: Column, glob: str) -> Column:
    """Whether a path string matches a shell pattern."""
    import fnmatch

    return path_string.rlike("^" + fnmatch.translate(glob).replace("(?s:", "(?s:").replace(r"\Z", r"\z").replace(r"\z", "") + r"\z")


def path_head(nodes: Column, selector: Selector, greedy: bool = False) -> Column:
    """A path up to its first (``greedy``: last) match; empty without one."""
    hits = F.transform(nodes, matcher(selector))
    at = F.array_position(hits, True) if not greedy else F.size(nodes) + 1 - F.array_position(F.reverse(hits), True)
    return F.when(F.array_contains(hits, True), F.slice(nodes, F.lit(1), at.cast("int"))).otherwise(F.slice(nodes, 1, 0))


def path_tail(nodes: Column, selector: Selector, greedy: bool = False) -> Column:
    """A path from its last (``greedy``: first) match on; empty without one."""
    hits = F.transform(nodes, matcher(selector))
    at = F.array_position(hits, True) if greedy else F.size(nodes) + 1 - F.array_position(F.reverse(hits), True)
    return F.when(F.array_contains(hits, True), F.slice(nodes, at.cast("int"), F.size(nodes))).otherwise(F.slice(nodes, 1, 0))


def common_ancestor(a: Column, b: Column) -> Column:
    """The last node that two paths share."""
    return F.element_at(F.filter(a, lambda n: F.exists(b, lambda m: m["nid"] == n["nid"])), -1)


def leaves(tree: Column, select_: Selector = ANY_NODE, ignore: Selector = NO_NODE) -> Column:
    """Leaves below (or at) a selected and not below an ignored node."""
    out = F.filter(tree, lambda n: n["text"].isNotNull())
    inside = lambda rows, n: F.exists(rows, lambda a: (a["nid"] <= n["nid"]) & (n["nid"] <= a["last"]))
    # what is always or never so needs no look at the nodes above
    if select_ is not ANY_NODE:
        keep = F.filter(tree, matcher(select_))
        out = F.filter(out, lambda n: inside(keep, n))
    if ignore is not NO_NODE:
        drop = F.filter(tree, matcher(ignore))
        out = F.filter(out, lambda n: ~inside(drop, n))
    return out


def content_of(tree: Column, select_: Selector = ANY_NODE, ignore: Selector = NO_NODE) -> Column:
    return F.array_join(F.transform(leaves(tree, select_, ignore), lambda n: n["text"]), "")


def leaf_at(tree: Column, offset: Column, left_biased: bool = False) -> Column:
    """The leaf that covers an offset of the content, null outside; ``left_biased``: at a border the leaf that ends there."""
    if left_biased:
        hit = lambda n: n["text"].isNotNull() & (n["cs"] < offset) & (offset <= n["ce"])
    else:
        hit = lambda n: n["text"].isNotNull() & (n["cs"] <= offset) & (offset < n["ce"])
    return F.get(F.filter(tree, hit), F.lit(0))


def siblings(tree: Column, node: Column, following: bool) -> Column:
    near = (lambda n: n["ord"] > node["ord"]) if following else (lambda n: n["ord"] < node["ord"])
    return F.filter(tree, lambda n: (n["pid"] == node["pid"]) & near(n))


def foregoing(text: Column, node: Column, length: int) -> Column:
    low = F.greatest(node["cs"] - length, F.lit(0))
    return F.substring(text, low + 1, node["cs"] - low)


def ensuing(text: Column, node: Column, length: int) -> Column:
    return F.substring(text, node["ce"] + 1, F.lit(length))


def get_attr(node: Column, name: str, default: str | None = None) -> Column:
    return F.coalesce(node["attrs"][name], F.lit(default))


def empty_names(df: DataFrame, tree: str = "tree") -> DataFrame:
    """Names whose nodes are all void."""
    rows = nodes(df.select(tree), tree, [])
    return rows.groupBy("name").agg(F.bool_and((F.col("last") == F.col("nid")) & (F.col("cs") == F.col("ce"))).alias("void")).where("void").select("name")


# -- node rows


def nodes(df: DataFrame, tree: str = "tree", keep: list[str] | None = None, where: Selector | None = None) -> DataFrame:
    """One row per node; ``where`` filters inside the array, before the rows are made."""
    keep = ["doc_id"] if keep is None else keep
    array = F.col(tree) if where is None else F.filter(F.col(tree), matcher(where))
    return df.select(*keep, F.inline(array))


def with_paths(df: DataFrame, tree: str = "tree", keep: list[str] | None = None) -> DataFrame:
    """Node rows with ``ids`` and ``names`` from the root down: a path is its parent's path and the node, so one pass makes all."""
    keep = ["doc_id"] if keep is None else keep
    fields = [f.name for f in NODE_TYPE.fields]

    @F.arrow_udf(T.StructType.fromDDL("p array<struct<ids:array<int>,names:array<string>>>")["p"].dataType)
    def paths(pids: pa.Array, names: pa.Array) -> pa.Array:
        ids_out, names_out, ends, bounds = [], [], [0], [0]
        for up, own in zip(pids.to_pylist(), names.to_pylist(), strict=True):
            ids: list[list[int]] = []
            called: list[list[str]] = []
            for k, (p, n) in enumerate(zip(up or (), own or (), strict=True)):
                ids.append([*ids[p], k] if p >= 0 else [k])
                called.append([*called[p], n] if p >= 0 else [n])
                ids_out += ids[-1]
                names_out += called[-1]
                ends.append(len(ids_out))
            bounds.append(len(ends) - 1)
        cuts = pa.array(ends, pa.int32())
        rows = pa.StructArray.from_arrays([pa.ListArray.from_arrays(cuts, pa.array(ids_out, pa.int32())), pa.ListArray.from_arrays(cuts, pa.array(names_out, pa.string()))], ["ids", "names"])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)

    made = paths(F.transform(tree, lambda n: n["pid"]), F.transform(tree, lambda n: n["name"]))
    full = F.zip_with(F.col(tree), made, lambda n, p: F.struct(*[n[f].alias(f) for f in fields], p["ids"].alias("ids"), p["names"].alias("names")))
    return df.select(*keep, F.inline(full))


def with_siblings(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Node rows with the ids of the previous and next sibling."""
    w = Window.partitionBy(key, "pid").orderBy("ord")
    return rows.withColumns({"prev_sibling": F.lag("nid").over(w), "next_sibling": F.lead("nid").over(w)})


def with_leaf_neighbours(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Leaf rows with their rank and the ids of the leaves before and after."""
    w = Window.partitionBy(key).orderBy("nid")
    only = rows.where(F.col("last") == F.col("nid"))
    return only.withColumns({"leaf_idx": F.row_number().over(w) - 1, "prev_leaf": F.lag("nid").over(w), "next_leaf": F.lead("nid").over(w)})


def ancestor_join(below: DataFrame, above: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of node rows of which the second's interval strictly holds the first: an equi-join by document with a range condition."""
    left = below.select(F.col(key), F.col("nid").alias("below"), F.col("name").alias("below_name"))
    right = above.select(F.col(key).alias("_k"), F.col("nid").alias("above"), F.col("last").alias("_last"), F.col("name").alias("above_name"))
    joined = left.join(right, (F.col(key) == F.col("_k")) & (F.col("above") < F.col("below")) & (F.col("below") <= F.col("_last")))
    return joined.drop("_k", "_last")
