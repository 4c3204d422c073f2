"""Queries of the rewriting steps and conditions: trees of the rows of ``part``, rewritten by one table for each column.

A case is a base tree, and for each column a table and the S-expression that it must give, both with the row's values as
``{k}`` (key), ``{a}`` and ``{b}`` (words of the name) and ``{t}`` (type). The SQL puts the expected text together from the
table's columns alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import rewrite as R
from .registry import ORACLE_SQL, QUERIES, table
from .sources import serde

VALUES = {"k": "CAST(p_partkey AS VARCHAR)", "a": "split_part(p_name, ' ', 1)", "b": "split_part(p_name, ' ', 2)", "t": "p_type"}


def trees(spark: SparkSession, sf_dir: str, base: str) -> DataFrame:
    """p_partkey and the tree of the S-expression ``base`` with the values of each row."""
    words = F.split("p_name", " ")
    values = {"k": F.col("p_partkey").cast("string"), "a": F.get(words, F.lit(0)), "b": F.get(words, F.lit(1)), "t": F.col("p_type")}
    text = F.concat(*[values[x[1:-1]] if re.fullmatch(r"\{[kabt]\}", x) else F.lit(x) for x in re.split(r"(\{[kabt]\})", base) if x])
    return serde.read_trees(table(spark, sf_dir, "part").select("p_partkey", text.alias("s")), "s", "sxpr").select("p_partkey", "tree")


def expected(template: str) -> str:
    """A template as an SQL expression."""
    return " || ".join(VALUES[x[1:-1]] if re.fullmatch(r"\{[kabt]\}", x) else "'" + x.replace("'", "''") + "'" for x in re.split(r"(\{[kabt]\})", template) if x) or "''"


def register(name: str, what: str, run, columns: dict[str, tuple[object, str]]) -> None:
    run.__name__, run.__doc__ = name, what
    QUERIES[name] = run
    ORACLE_SQL[name] = "SELECT p_partkey, " + ", ".join(f"{expected(e)} AS {c}" for c, (_, e) in columns.items()) + " FROM part"


def cases(name: str, what: str, base: str, columns: dict[str, tuple[dict | list[dict], str]]) -> None:
    register(name, what, lambda spark, sf_dir: R.variants(trees(spark, sf_dir, base), {c: t for c, (t, _) in columns.items()}), columns)


comma = R.node_maker("mark", ",")
WORDS = '(part (word "{a}") (:Whitespace " ") (word "{b}") (:Text ",") (kind "{t}"))'

cases(
    "rewrite_keep_and_remove",
    "Children kept or removed by place, name, token, content and condition.",
    WORDS,
    {
        "keep_children": ({"part": R.keep_children(slice(0, 2))}, '(part (word "{a}") (:Whitespace " "))'),
        "keep_children_if": ({"part": R.keep_children_if(R.is_named)}, '(part (word "{a}") (word "{b}") (kind "{t}"))'),
        "keep_nodes": ({"part": R.keep_nodes("word")}, '(part (word "{a}") (word "{b}"))'),
        "keep_tokens": ({"part": R.keep_tokens(",")}, '(part (:Text ","))'),
        "keep_content": ({"part": R.keep_content("[A-Z]+")}, '(part (kind "{t}"))'),
        "remove_children": ({"part": R.remove_children("word")}, '(part (:Whitespace " ") (:Text ",") (kind "{t}"))'),
        "remove_children_if": ({"part": R.remove_children_if(R.is_anonymous)}, '(part (word "{a}") (word "{b}") (kind "{t}"))'),
        "remove_tokens": ({"part": R.remove_tokens(",")}, '(part (word "{a}") (:Whitespace " ") (word "{b}") (kind "{t}"))'),
        "remove_content": ({"part": R.remove_content(r"\s")}, '(part (word "{a}") (word "{b}") (:Text ",") (kind "{t}"))'),
        "remove": ({"kind": R.remove}, '(part (word "{a}") (:Whitespace " ") (word "{b}") (:Text ","))'),
        "remove_if": ({"*": R.remove_if(R.is_anonymous_leaf)}, '(part (word "{a}") (word "{b}") (kind "{t}"))'),
        "drop_leaf": ({"kind": R.drop_leaf}, '(part (word "{a}") (:Whitespace " ") (word "{b}") (:Text ","))'),
    },
)
cases(
    "rewrite_edges",
    "What stands at both ends of a node: stripped, taken off as brackets, or moved to the parent.",
    '(all (part (:Whitespace " ") (word "{a}") (:Text "-") (word "{b}") (:Whitespace " ")) (:Whitespace " ") (kind (:Text "<") (word "{t}") (:Text ">")))',
    {
        "lstrip": ({"part": R.lstrip()}, '(all (part (word "{a}") (:Text "-") (word "{b}") (:Whitespace " ")) (:Whitespace " ") (kind (:Text "<") (word "{t}") (:Text ">")))'),
        "rstrip": ({"part": R.rstrip()}, '(all (part (:Whitespace " ") (word "{a}") (:Text "-") (word "{b}")) (:Whitespace " ") (kind (:Text "<") (word "{t}") (:Text ">")))'),
        "strip": ({"part": R.strip()}, '(all (part (word "{a}") (:Text "-") (word "{b}")) (:Whitespace " ") (kind (:Text "<") (word "{t}") (:Text ">")))'),
        "remove_brackets": ({"kind": R.remove_brackets}, '(all (part (:Whitespace " ") (word "{a}") (:Text "-") (word "{b}") (:Whitespace " ")) (:Whitespace " ") (kind (word "{t}")))'),
        "move_fringes": ({"part": R.move_fringes(R.is_a(":Whitespace"))}, '(all (:Whitespace " ") (part (word "{a}") (:Text "-") (word "{b}")) (:Whitespace "  ") (kind (:Text "<") (word "{t}") (:Text ">")))'),
        "move_left": ({"part": R.move_fringes(R.is_a(":Whitespace"), side="left")}, '(all (:Whitespace " ") (part (word "{a}") (:Text "-") (word "{b}") (:Whitespace " ")) (:Whitespace " ") (kind (:Text "<") (word "{t}") (:Text ">")))'),
        "move_unmerged": ({"part": R.move_fringes(R.is_a(":Whitespace"), merge=False)}, '(all (:Whitespace " ") (part (word "{a}") (:Text "-") (word "{b}")) (:Whitespace " ") (:Whitespace " ") (kind (:Text "<") (word "{t}") (:Text ">")))'),
    },
)
cases(
    "rewrite_levels",
    "Levels taken out, joined, swapped or turned.",
    '(part (name (word "{a}")) (:pair (x "{k}") (:pair (y "{b}") (z "!"))) (kind (up (low "{t}") (low "?"))))',
    {
        "replace_by_single_child": ({"name": R.replace_by_single_child}, '(part (word "{a}") (:pair (x "{k}") (:pair (y "{b}") (z "!"))) (kind (up (low "{t}") (low "?"))))'),
        "reduce_single_child": ({"name, kind": R.reduce_single_child}, '(part (name "{a}") (:pair (x "{k}") (:pair (y "{b}") (z "!"))) (kind (low "{t}") (low "?")))'),
        "replace_or_reduce": ({"name": R.replace_or_reduce(), "kind": R.replace_or_reduce(R.never)}, '(part (word "{a}") (:pair (x "{k}") (:pair (y "{b}") (z "!"))) (kind (low "{t}") (low "?")))'),
        "replace_by_children": ({"kind": R.replace_by_children}, '(part (name (word "{a}")) (:pair (x "{k}") (:pair (y "{b}") (z "!"))) (up (low "{t}") (low "?")))'),
        "flatten": ({"part": R.flatten()}, '(part (name (word "{a}")) (x "{k}") (y "{b}") (z "!") (kind (up (low "{t}") (low "?"))))'),
        "flatten_once": ({"<<<": R.flatten(recursive=False)}, '(part (name (word "{a}")) (x "{k}") (:pair (y "{b}") (z "!")) (kind (up (low "{t}") (low "?"))))'),
        "collapse": ({"kind": R.collapse}, '(part (name (word "{a}")) (:pair (x "{k}") (:pair (y "{b}") (z "!"))) (kind "{t}?"))'),
        "swap_nested": ({"name": R.swap_nested}, '(part (word (name "{a}")) (:pair (x "{k}") (:pair (y "{b}") (z "!"))) (kind (up (low "{t}") (low "?"))))'),
        "change_name": ({"name": R.change_name("title")}, '(part (title (word "{a}")) (:pair (x "{k}") (:pair (y "{b}") (z "!"))) (kind (up (low "{t}") (low "?"))))'),
        "replace_child_names": ({"part, up": R.replace_child_names({"name": "n", "low": "l"})}, '(part (n (word "{a}")) (:pair (x "{k}") (:pair (y "{b}") (z "!"))) (kind (up (l "{t}") (l "?"))))'),
        "pull_up": ({"up": R.pull_up}, '(part (name (word "{a}")) (:pair (x "{k}") (:pair (y "{b}") (z "!"))) (up (kind (low "{t}") (low "?"))))'),
    },
)
cases(
    "rewrite_merging",
    "Neighbours merged: leaves, runs of a kind, runs with delimiters in between.",
    '(part (:Text "{a}") (:RegExp "{b}") (w "{k}") (s " ") (w "{t}") (s ";") (s " ") (end (:Text "{a}") (:Text ".")))',
    {
        "merge_treetops": ({"end": R.merge_treetops}, '(part (:Text "{a}") (:RegExp "{b}") (w "{k}") (s " ") (w "{t}") (s ";") (s " ") (end "{a}."))'),
        "merge_leaves": ({"part": R.merge_leaves}, '(part (:Text "{a}{b}") (w "{k}") (s " ") (w "{t}") (s ";") (s " ") (end (:Text "{a}") (:Text ".")))'),
        "merge_adjacent": ({"part": R.merge_adjacent(R.is_a("s"))}, '(part (:Text "{a}") (:RegExp "{b}") (w "{k}") (s " ") (w "{t}") (s "; ") (end (:Text "{a}") (:Text ".")))'),
        "merge_preferred": ({"part": R.merge_adjacent(R.is_anonymous_leaf, ":RegExp")}, '(part (:RegExp "{a}{b}") (w "{k}") (s " ") (w "{t}") (s ";") (s " ") (end (:Text "{a}") (:Text ".")))'),
        "merge_connected": ({"part": R.merge_connected(R.is_a("w"), R.is_a("s"), "ws", "ss")}, '(part (:Text "{a}") (:RegExp "{b}") (ws "{k} {t}") (ss "; ") (end (:Text "{a}") (:Text ".")))'),
        "join_content": ({"part": R.collapse_children_if(R.is_a("w", "s"), "line", R.join_content)}, '(part (:Text "{a}") (:RegExp "{b}") (line "{k} {t}; ") (end (:Text "{a}") (:Text ".")))'),
        "fix_content": ({"part": R.collapse_children_if(R.is_a("w", "s"), "line", R.fix_content("-"))}, '(part (:Text "{a}") (:RegExp "{b}") (line "-") (end (:Text "{a}") (:Text ".")))'),
        "merge_results": ({"part": lambda p: R.merge_results(p[-1], p[-1].children[:2])}, '(part "{a}{b}")'),
        "fuse": ({"part": R.transform_result(lambda r: R.fuse(r[-2:], R.is_a("s")))}, '(part (s " ") (:Text "{a}."))'),
    },
)
cases(
    "rewrite_pick_longest",
    "The longest text of a run of children.",
    '(part (w "{t}{t}{t}{a}{b}{k}") (w "{t}") (x "{k}"))',
    {"pick_longest": ({"part": R.collapse_children_if(R.is_a("w"), "long", R.pick_longest)}, '(part (long "{t}{t}{t}{a}{b}{k}") (x "{k}"))')},
)
cases(
    "rewrite_association",
    "Flat lists and right-leaning chains as trees that lean to the left; attributes stay with their operator.",
    '(part (sum (n "{k}") (op "-") (n "{a}") (op "-") (n "{b}")) (add `(at "1") (n "{k}") (sub `(at "2") (n "{a}") (add `(at "3") (n "{b}") (n "{t}")))))',
    {
        "left_associative": ({"sum": R.left_associative, "part": R.keep_nodes("sum")}, '(part (sum (sum (n "{k}") (op "-") (n "{a}")) (op "-") (n "{b}")))'),
        "lean_left": ([{"part": [R.keep_nodes("add"), R.replace_by_single_child]}, {"add, sub": R.lean_left("add", "sub")}], '(add `(at "3") (sub `(at "2") (add `(at "1") (n "{k}") (n "{a}")) (n "{b}")) (n "{t}"))'),
    },
)
cases(
    "rewrite_content",
    "Texts changed, attributes added and taken away.",
    '(part `(k "{k}") `(m "1") (name "{a}  {b}") (kind "{t}"))',
    {
        "transform_result": ({"kind": R.transform_result(lambda r: r + r)}, '(part `(k "{k}") `(m "1") (name "{a}  {b}") (kind "{t}{t}"))'),
        "replace_content_with": ({"kind": R.replace_content_with("-")}, '(part `(k "{k}") `(m "1") (name "{a}  {b}") (kind "-"))'),
        "normalize_whitespace": ({"name": R.normalize_whitespace}, '(part `(k "{k}") `(m "1") (name "{a} {b}") (kind "{t}"))'),
        "add_attributes": ({"kind": R.add_attributes({"x": "y"})}, '(part `(k "{k}") `(m "1") (name "{a}  {b}") (kind `(x "y") "{t}"))'),
        "del_attributes": ({"part": R.del_attributes("m")}, '(part `(k "{k}") (name "{a}  {b}") (kind "{t}"))'),
        "del_all_attributes": ({"part": R.del_attributes()}, '(part (name "{a}  {b}") (kind "{t}"))'),
        "swap_attributes": ({"part": lambda p: R.swap_attributes(p[-1], p[-1].children[0])}, '(part (name `(k "{k}") `(m "1") "{a}  {b}") (kind "{t}"))'),
        "update_attr": ({"part": lambda p: R.update_attr(p[-1].children[1], p[-1])}, '(part `(k "{k}") `(m "1") (name "{a}  {b}") (kind `(k "{k}") `(m "1") "{t}"))'),
        "update_attr_unless": ({"part": lambda p: R.update_attr_unless(p[-1].children[1], p[-1], exclude=R.has_attr("k"))}, '(part `(k "{k}") `(m "1") (name "{a}  {b}") (kind "{t}"))'),
    },
)
cases(
    "rewrite_insertion",
    "New nodes at places by number, by name, between children, from makers.",
    '(part (w "{a}") (w "{b}") (kind "{t}"))',
    {
        "insert_first": ({"part": R.insert(0, comma)}, '(part (mark ",") (w "{a}") (w "{b}") (kind "{t}"))'),
        "insert_last": ({"part": R.insert(-1, comma)}, '(part (w "{a}") (w "{b}") (kind "{t}") (mark ","))'),
        "insert_several": ({"part": R.insert((1, 2), comma)}, '(part (w "{a}") (mark ",") (w "{b}") (mark ",") (kind "{t}"))'),
        "insert_nothing": ({"part": R.insert(None, comma)}, '(part (w "{a}") (w "{b}") (kind "{t}"))'),
        "positions_of": ({"part": R.insert(R.positions_of("kind"), comma)}, '(part (w "{a}") (w "{b}") (mark ",") (kind "{t}"))'),
        "delimiter_positions": ({"part": R.insert(R.delimiter_positions, R.node_maker("d", (comma, R.node_maker("blank", " "))))}, '(part (w "{a}") (d (mark ",") (blank " ")) (w "{b}") (d (mark ",") (blank " ")) (kind "{t}"))'),
        "delimit_children": ({"part": R.delimit_children(comma)}, '(part (w "{a}") (mark ",") (w "{b}") (mark ",") (kind "{t}"))'),
        "node_maker": ({"kind": R.transform_result(lambda r: [R.node_maker("new", r, {"of": "kind"})()])}, '(part (w "{a}") (w "{b}") (kind (new `(of "kind") "{t}")))'),
    },
)
cases(
    "rewrite_errors",
    "Errors that steps record, and those of steps that fail.",
    '(part `(k "1") (w `(k "2") "{a}") (kind "{t}"))',
    {
        "add_error": ({"kind": R.add_error("seen {name}: {content}")}, '(part `(k "1") (w `(k "2") "{a}") (kind "{t}"))\nseen kind: {t}'),
        "error_on": ({"*": R.error_on(R.content_matches("[A-Z]+$"), "upper {content}")}, '(part `(k "1") (w `(k "2") "{a}") (kind "{t}"))\nupper {t}'),
        "assert_content": ({"w": R.assert_content("[0-9]+")}, '(part `(k "1") (w `(k "2") "{a}") (kind "{t}"))\ncontent of w does not match [0-9]+'),
        "require": ({"part": R.require("w")}, '(part `(k "1") (w `(k "2") "{a}") (kind "{t}"))\npart may only have w'),
        "forbid": ({"part": R.forbid("kind")}, '(part `(k "1") (w `(k "2") "{a}") (kind "{t}"))\npart must not have kind'),
        "conflict": ({"part": [R.keep_nodes("w"), R.reduce_single_child]}, "(part `(k \"1\") \"{a}\")\nValueError: part and w have different values of k: '1', '2'"),
        "failing_step": ({"kind": lambda p: 1 // 0}, '(part `(k "1") (w `(k "2") "{a}") (kind "{t}"))\nZeroDivisionError: integer division or modulo by zero'),
    },
)

HIT = R.change_name("hit")


def when(c: R.Condition) -> dict:
    return {"<": R.apply_if(HIT, c)}


DEEP = '(part (name (word "{a}") (:Whitespace " ") (word "{b}")) (kind `(k "{k}") (up "{t}")) (none))'

cases(
    "conditions_of_nodes",
    "Conditions on a node itself: those that hold rename it.",
    DEEP,
    {
        "always_": (when(R.always), '(hit (hit (hit "{a}") (hit " ") (hit "{b}")) (hit `(k "{k}") (hit "{t}")) (hit))'),
        "never_": (when(R.never), DEEP),
        "is_named": (when(R.is_named), '(hit (hit (hit "{a}") (:Whitespace " ") (hit "{b}")) (hit `(k "{k}") (hit "{t}")) (hit))'),
        "is_anonymous": (when(R.is_anonymous), '(part (name (word "{a}") (hit " ") (word "{b}")) (kind `(k "{k}") (up "{t}")) (none))'),
        "is_anonymous_leaf": (when(R.is_anonymous_leaf), '(part (name (word "{a}") (hit " ") (word "{b}")) (kind `(k "{k}") (up "{t}")) (none))'),
        "is_empty": (when(R.is_empty), '(part (name (word "{a}") (:Whitespace " ") (word "{b}")) (kind `(k "{k}") (up "{t}")) (hit))'),
        "only_whitespace": (when(R.contains_only_whitespace), '(part (name (word "{a}") (hit " ") (word "{b}")) (kind `(k "{k}") (up "{t}")) (hit))'),
        "is_a": (when(R.is_a("word", "up")), '(part (name (hit "{a}") (:Whitespace " ") (hit "{b}")) (kind `(k "{k}") (hit "{t}")) (none))'),
        "not_a": (when(R.not_a("word", ":Whitespace", "part", "up")), '(part (hit (word "{a}") (:Whitespace " ") (word "{b}")) (hit `(k "{k}") (up "{t}")) (hit))'),
        "name_matches": (when(R.name_matches("n.*")), '(part (hit (word "{a}") (:Whitespace " ") (word "{b}")) (kind `(k "{k}") (up "{t}")) (hit))'),
        "content_matches": (when(R.content_matches("[A-Z]+$")), '(part (name (word "{a}") (:Whitespace " ") (word "{b}")) (hit `(k "{k}") (hit "{t}")) (none))'),
        "has_content": (when(R.has_content(" ")), '(part (name (word "{a}") (hit " ") (word "{b}")) (kind `(k "{k}") (up "{t}")) (none))'),
        "has_attr": (when(R.has_attr("k")), '(part (name (word "{a}") (:Whitespace " ") (word "{b}")) (hit `(k "{k}") (up "{t}")) (none))'),
        "is_token": ([{"name": R.replace_child_names({":Whitespace": ":Text"})}, when(R.is_token(" "))], '(part (name (word "{a}") (hit " ") (word "{b}")) (kind `(k "{k}") (up "{t}")) (none))'),
    },
)
cases(
    "conditions_of_places",
    "Conditions on what stands above, below and beside a node. Nodes are visited from below: what was renamed has its new name.",
    DEEP,
    {
        "is_single_child": (when(R.is_single_child), '(part (name (word "{a}") (:Whitespace " ") (word "{b}")) (kind `(k "{k}") (hit "{t}")) (none))'),
        "has_parent": (when(R.has_parent("name")), '(part (name (hit "{a}") (hit " ") (hit "{b}")) (kind `(k "{k}") (up "{t}")) (none))'),
        "has_ancestor": ({"word, up": R.apply_if(HIT, R.has_ancestor("kind"))}, '(part (name (word "{a}") (:Whitespace " ") (word "{b}")) (kind `(k "{k}") (hit "{t}")) (none))'),
        "has_ancestor_near": ({"word, up": R.apply_if(HIT, R.has_ancestor("part", generations=1))}, DEEP),
        "has_children": (when(R.has_children), '(hit (hit (word "{a}") (:Whitespace " ") (word "{b}")) (hit `(k "{k}") (up "{t}")) (none))'),
        "has_child": (when(R.has_child("up")), '(part (name (word "{a}") (:Whitespace " ") (word "{b}")) (hit `(k "{k}") (up "{t}")) (none))'),
        "has_descendant": (when(R.has_descendant("up")), '(hit (name (word "{a}") (:Whitespace " ") (word "{b}")) (hit `(k "{k}") (up "{t}")) (none))'),
        "has_sibling": ({"none": R.apply_if(HIT, R.has_sibling("kind")), "up": R.apply_if(HIT, R.has_sibling("kind"))}, '(part (name (word "{a}") (:Whitespace " ") (word "{b}")) (kind `(k "{k}") (up "{t}")) (hit))'),
    },
)
cases(
    "conditions_combined",
    "Conditions put together, and steps that depend on them.",
    DEEP,
    {
        "neg": ({"*": R.apply_if(HIT, R.neg(R.has_children))}, '(part (name (hit "{a}") (hit " ") (hit "{b}")) (kind `(k "{k}") (hit "{t}")) (hit))'),
        "any_of": (when(R.any_of(R.is_empty, R.has_attr("k"))), '(part (name (word "{a}") (:Whitespace " ") (word "{b}")) (hit `(k "{k}") (up "{t}")) (hit))'),
        "all_of": (when(R.all_of(R.has_children, R.has_parent("part"))), '(part (hit (word "{a}") (:Whitespace " ") (word "{b}")) (hit `(k "{k}") (up "{t}")) (none))'),
        "three_valued": (when(R.neg(R.three_valued(R.has_children, R.is_empty))), '(part (name (word "{a}") (:Whitespace " ") (word "{b}")) (kind `(k "{k}") (up "{t}")) (hit))'),
        "apply_unless": ({"*": R.apply_unless(HIT, R.is_named)}, '(part (name (word "{a}") (hit " ") (word "{b}")) (kind `(k "{k}") (up "{t}")) (none))'),
        "apply_ifelse": ({"word, none": R.apply_ifelse(HIT, R.change_name("miss"), R.is_empty)}, '(part (name (miss "{a}") (:Whitespace " ") (miss "{b}")) (kind `(k "{k}") (up "{t}")) (hit))'),
        "run_steps": ({"up": lambda p: R.run_steps(p, [HIT, R.add_attributes({"x": "1"})])}, '(part (name (word "{a}") (:Whitespace " ") (word "{b}")) (kind `(k "{k}") (hit `(x "1") "{t}")) (none))'),
    },
)
cases(
    "traversals",
    "Keys of tables, filters of what is visited, tables inside tables and one after another.",
    DEEP,
    {
        "others": ({"word, up": R.change_name("w"), "*": HIT}, '(hit (hit (w "{a}") (hit " ") (w "{b}")) (hit `(k "{k}") (w "{t}")) (hit))'),
        "blanks": ({"~": HIT}, '(part (name (word "{a}") (hit " ") (word "{b}")) (kind `(k "{k}") (up "{t}")) (none))'),
        "before_and_after": ({"<": R.add_attributes({"x": "1"}), "none": R.add_attributes({"x": "2"}), "<<<": R.keep_nodes("none"), ">>>": HIT}, '(hit `(x "1") (none `(x "2")))'),
        "block_children": ({"name": [R.BLOCK_CHILDREN, HIT], "word, up": HIT}, '(part (hit (word "{a}") (:Whitespace " ") (word "{b}")) (kind `(k "{k}") (hit "{t}")) (none))'),
        "block_leaves": ({"name": [R.BLOCK_LEAVES], "word, up, :Whitespace": HIT}, '(part (name (word "{a}") (:Whitespace " ") (word "{b}")) (kind `(k "{k}") (hit "{t}")) (none))'),
        "block_anonymous_leaves": ({"name": [R.BLOCK_ANONYMOUS_LEAVES], "word, :Whitespace": HIT}, '(part (name (hit "{a}") (:Whitespace " ") (hit "{b}")) (kind `(k "{k}") (up "{t}")) (none))'),
        "locally": ({"kind": R.traverse_locally({"up": HIT})}, '(part (name (word "{a}") (:Whitespace " ") (word "{b}")) (kind `(k "{k}") (hit "{t}")) (none))'),
        "in_turn": ([{"up": R.change_name("word")}, {"word": HIT}], '(part (name (hit "{a}") (:Whitespace " ") (hit "{b}")) (kind `(k "{k}") (hit "{t}")) (none))'),
        "by_other_keys": ({"<<<": lambda p: R.traverse(p[-1], {"4": HIT}, key=lambda n: str(len(n.name)))}, '(hit (hit (hit "{a}") (:Whitespace " ") (hit "{b}")) (hit `(k "{k}") (up "{t}")) (hit))'),
        "transformer": ({"<<<": lambda p: R.transformer({"up": R.change_name("x")}, {"x": HIT})(p[-1])}, '(part (name (word "{a}") (:Whitespace " ") (word "{b}")) (kind `(k "{k}") (hit "{t}")) (none))'),
    },
)
