"""Queries of what is computed from single trees: paths, mappings, values, serializations, validation, compilation.

As in ``queries_rewriting``, a case is a base tree with values of the rows of ``part``, and for each column a function of
the tree's root and the text that it must give.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import preprocess as X
from .functions import text as T
from .operators import compile as C
from .operators import parse as P
from .operators import paths as A
from .operators import units as U
from .operators import validate as V
from .queries_rewriting import register, trees
from .registry import query, table
from .sources import serde
from .tree import Node, set_positions

parse = serde.parse_sxpr


def cases(name: str, what: str, base: str, columns: dict) -> None:
    register(name, what, lambda spark, sf_dir: A.values(trees(spark, sf_dir, base), {c: f for c, (f, _) in columns.items()}), columns)


BASE = '(part (name (word "{a}") (:Whitespace " ") (word "{b}")) (kind `(k "{k}") (up "{t}") (none)) (end "!"))'
names = lambda p: "none" if p is None else "/".join(n.name for n in p)
up = lambda t: A.pick_path(t, "up")

cases(
    "tree_paths",
    "Paths found by name, content and pattern; from path to path; nodes of a path.",
    BASE,
    {
        "select_path": (lambda t: " ".join(map(names, A.select_paths(t, "word"))), "part/name/word part/name/word"),
        "select_path_if": (lambda t: " ".join(map(names, A.select_paths(t, A.BRANCH, include_root=True))), "part part/name part/kind"),
        "pick_path": (lambda t: A.pick_path(t, "word", reverse=True)[-1].text, "{b}"),
        "pick_path_if": (lambda t: names(A.pick_path(t, lambda n: n.text == "")), "part/kind/none"),
        "by_pattern": (lambda t: A.pick_path(t, re.compile("[A-Z]+"))[-1].name, "kind"),
        "by_glob": (lambda t: " ".join(p[-1].content for p in A.select_paths(t, "/part/*/word")), "{a} {b}"),
        "skipping": (lambda t: " ".join(map(names, A.select_paths(t, A.LEAF, skip="name"))), "part/kind/up part/kind/none part/end"),
        "locate_path": (lambda t: names(A.locate_path(t, len(t.content) - 1)), "part/end"),
        "reconstruct": (lambda t: names(A.reconstruct(t, t.children[1].children[0])), "part/kind/up"),
        "prev_path": (lambda t: names(A.prev_path(up(t))), "part/name"),
        "next_path": (lambda t: names(A.next_path(A.pick_path(t, "none"))), "part/end"),
        "no_next": (lambda t: names(A.next_path(A.pick_path(t, "end"))), "none"),
        "prev_leaf": (lambda t: A.prev_leaf(up(t))[-1].text, "{b}"),
        "next_leaf": (lambda t: A.next_leaf(A.pick_path(t, "name"))[-1].text, "{t}"),
        "zoom_into": (lambda t: names(A.zoom_into([t], A.last_child, 1)) + " " + names(A.zoom_into([t])), "part/end part/name/word"),
        "from_path": (lambda t: " ".join(n.name for n in A.select_from_path(up(t), {"part", "kind"}, reverse=True)), "kind part"),
        "pick_from_path": (lambda t: A.pick_from_path(up(t), "kind").attrs["k"], "{k}"),
        "common_ancestor": (lambda t: A.common_ancestor(up(t), A.pick_path(t, "none"))[0].name, "kind"),
        "shown": (lambda t: A.shown(up(t), 1), 'part <- kind <- up "{t}"'),
        "is_path": (lambda t: f"{A.is_path(up(t))} {A.is_path([t, t])}", "True False"),
        "evaluate_path": (lambda t: A.evaluate_path(t, {":Whitespace": lambda p, s: "_", "none": lambda p, s: "0", "word": lambda p, s: s, "up": lambda p, s: p[-2].attrs["k"] + s, "*": lambda p, *x: "(" + "".join(x) + ")" if len(p) > 1 else ".".join(x)}), "({a}_{b}).({k}{t}0).(!)"),
    },
)


def changed_mapping(t: Node) -> int:
    m = A.Mapping(t)
    t.children[0].result = [*t.children[0].children, Node("x", "+")]
    m.rebuild_slice(0, 1)
    return m.node_index(t.children[0].children[-1])


def marked(t: Node) -> str:
    m = A.Mapping(t, ignore="kind")
    m.markup(m.position(2), len(m.content), "hi")
    return "".join(n.content for n in t.walk() if n.name == "hi")


def local(t: Node) -> A.LocalMapping:
    return A.LocalMapping(A.pick_path(t, "up"), A.pick_path(t, "end"))


def inserted(t: Node) -> str:
    m = A.Mapping(t)
    m.insert(len(m.content) - 1, Node("x"))
    return serde.as_sxpr(next(n for n in t.walk() if n.name == "x"))


cases(
    "tree_mappings",
    "Content mappings: from places in the text of (some) leaves to nodes and back, and what changes a tree through them.",
    BASE,
    {
        "content": (lambda t: A.Mapping(t, ignore={"kind", ":Whitespace"}).content, "{a}{b}!"),
        "selected": (lambda t: A.Mapping(t, select={"kind", "end"}).content, "{t}!"),
        "shown": (lambda t: str(A.Mapping(t, select="end")), '0 -> part, end "!"'),
        "path_strings": (lambda t: " ".join(sorted(A.Mapping(t).path_names())), "/part/end /part/kind/none /part/kind/up /part/name/:Whitespace /part/name/word"),
        "names": (lambda t: " ".join(sorted(A.Mapping(t, ignore=":Whitespace").names())), "end none up word"),
        "location": (lambda t: "{0} {2}".format(*(m := A.Mapping(t)).location(m.position(3) + 1)), "3 1"),
        "biased": (lambda t: "{0} {1}".format((m := A.Mapping(t)).index(m.position(1), True), m.index(m.position(1))), "0 1"),
        "path_at": (lambda t: names((m := A.Mapping(t)).path(m.index(len(m.content) - 1))), "part/end"),
        "outside": (lambda t: A.Mapping(t).index(10**6), "IndexError: 1000000"),
        "node_index": (lambda t: f"{(m := A.Mapping(t)).node_index(t.children[1])} {m.node_index(t.children[1], True)} {m.node_index(Node('x'))}", "3 4 -1"),
        "node_position": (lambda t: (m := A.Mapping(t)).content[m.node_position(t.children[1]) : m.node_position(t.children[1], True)], "{t}"),
        "between_paths": (lambda t: (lambda m: " ".join(p[-1].name for p in m.between(m.position(1), m.position(3) + 1)))(A.Mapping(t)), ":Whitespace word up"),
        "select_paths": (lambda t: " ".join(map(names, A.Mapping(t).select({"name", "word"}))), "part/name part/name/word part/name/word"),
        "pick_paths": (lambda t: A.Mapping(t).pick("word", reverse=True)[-1].text, "{b}"),
        "rebuilt": (changed_mapping, "3"),
        "markup": (marked, "{b}!"),
        "insert_node": (inserted, "(x)"),
        "local_content": (lambda t: local(t).content, "{t}!"),
        "local_paths": (lambda t: " ".join(map(names, local(t).paths)), "part/kind/up part/kind/none part/end"),
        "local_location": (lambda t: "{0} {2}".format(*local(t).location(1)), "0 1"),
    },
)

FLAT = '(part `(k "{k}") (name "{a}") (:Text "{b}") (none))'
again = lambda write, read: lambda t: f"{read(write(t)).equals(t)}"

cases(
    "tree_serializations",
    "Trees written in the formats, and read back.",
    FLAT,
    {
        "sxpr": (serde.as_sxpr, FLAT),
        "sxpr_indented": (lambda t: serde.as_sxpr(t, 2), '(part `(k "{k}")\n  (name "{a}")\n  (:Text "{b}")\n  (none))'),
        "one_line": (lambda t: serde.one_line(serde.as_sxpr(t, 2), 1000), FLAT),
        "sxml": (serde.as_sxml, '(part (@ (k "{k}")) (name "{a}") (:Text "{b}") (none))'),
        "sxml2": (lambda t: serde.as_sxml(t, 2), '(part (@ (k "{k}")) (name (@) "{a}") (:Text (@) "{b}") (none (@)))'),
        "xml": (serde.as_xml, '<part k="{k}"><name>{a}</name>{b}<none/></part>'),
        "xml_flat": (lambda t: serde.flatten_xml(serde.as_xml(t, inline=False)), '<part k="{k}"><name>{a}</name>{b}<none/></part>'),
        "json": (lambda t: json.dumps(serde.to_json_obj(t)), '["part", [["name", "{a}"], [":Text", "{b}"], ["none", ""]], {"k": "{k}"}]'),
        "dict": (lambda t: json.dumps(serde.to_json_obj(t, True)), '{"part": {"name": "{a}", ":Text": "{b}", "none": ""}}'),
        "outline": (serde.as_outline, 'part\n  name "{a}"\n  :Text "{b}"\n  none'),
        "xast": (lambda t: json.dumps(serde.unist(t)["children"][0]), '{"type": "element", "name": "name", "children": [{"type": "text", "value": "{a}"}]}'),
        "ndst": (lambda t: json.dumps(serde.unist(t, "ndst")["children"][1]), '{"type": ":Text", "value": "{b}"}'),
        "positions": (lambda t: json.dumps(serde.unist(set_positions(t), "ndst", t.content)["children"][0]["position"]["start"]), '{"line": 1, "column": 1, "offset": 0}'),
        "frozen": (lambda t: f"{serde.frozen(t) == serde.frozen(t.copy())} {hash(serde.frozen(t)) == hash(serde.frozen(t.copy()))}", "True True"),
        "thawed": (again(serde.frozen, serde.thawed), "True"),
        "sxpr_back": (again(serde.as_sxpr, parse), "True"),
        "xml_back": (again(serde.as_xml, serde.parse_xml), "True"),
        "json_back": (again(lambda t: json.loads(json.dumps(serde.to_json_obj(t))), serde.from_json_obj), "True"),
        "dispatched": (lambda t: f"{serde.deserialize(serde.as_xml(t)).equals(serde.deserialize(serde.as_sxpr(t)))}", "True"),
    },
)

SCHEMA = parse("""(branch `(name "part") `(attributes "k") `(values "[0-9]+")
    (series (leaf `(name "name") `(content "[a-z]+")) (zero_or_more (alternative (leaf `(name ":Text")) (branch `(name "more") (forward `(name "any"))))) (optional (leaf `(name "none") `(define "any") `(attributes "*")))))""")
check = lambda change: lambda t: "; ".join(m for _, m in V.Validator(SCHEMA).check(change(t)))


def wrong_name(t: Node) -> Node:
    t.children[0].text += "7"
    return t


def more_attributes(t: Node) -> Node:
    t.attrs = {"k": t.attrs["k"] + "x", "l": "1"}
    return t


def turned(t: Node) -> Node:
    t.result = t.children[::-1]
    return t


cases(
    "tree_validation",
    "Trees against a schema of leaves, branches, series, alternatives and options.",
    FLAT,
    {
        "valid": (check(lambda t: t), ""),
        "bad_content": (check(wrong_name), "name does not match [a-z]+"),
        "bad_attributes": (check(more_attributes), "attribute k of part does not match [0-9]+; part may not have the attribute l"),
        "bad_order": (check(turned), "part may not have none, :Text, name in it"),
        "other_root": (check(lambda t: t.children[0]), "name is not what the schema asks for"),
        "interleaved": (lambda t: "; ".join(m for _, m in V.Validator(parse('(branch (interleave (leaf `(name "none")) (leaf `(name "name")) (one_or_more (leaf `(name ":Text")))))')).check(t)), ""),
        "no_schema": (lambda t: f"{V.is_schema(SCHEMA)} {V.is_schema(t)}", "True False"),
    },
)


class Report(C.Compiler):
    """A visitor: names in upper case, kinds counted, attributes noted, the rest as it is."""

    def prepare(self, root: Node) -> None:
        self.noted = []

    def attr_k(self, node: Node, value: str) -> None:
        self.noted.append(f"{node.name}.k={value}")

    def on_name(self, node: Node) -> str:
        return node.text.upper()

    def on_none(self, node: Node) -> None:
        self.error(node, "nothing here")

    def on__Text(self, node: Node) -> str:  # noqa: N802
        return f"{len(self.path)}:{node.text}"

    def finish(self, result: object) -> object:
        return " ".join([*result, *self.noted])


class Crash(C.Compiler):
    def on_name(self, node: Node) -> str:
        return node.missing


@query("""
SELECT p_partkey, '"' || upper(split_part(p_name, ' ', 1)) || ' 2:' || split_part(p_name, ' ', 2) || ' part.k=' || p_partkey || '"' AS data, 'nothing here' AS message, 1000 AS code,
       10500 AS crash_code FROM part""")
def compiled_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A visitor with methods for names and attributes, its errors, and one that crashes."""
    some = trees(spark, sf_dir, FLAT)
    done = C.compiled(some, Report).select("p_partkey", "data", F.get("errors", F.lit(0)).alias("e"))
    crashed = C.compiled(some, Crash).select("p_partkey", F.get("errors", F.lit(0))["code"].alias("crash_code"))
    return done.join(crashed, "p_partkey").select("p_partkey", "data", F.col("e.message").alias("message"), F.col("e.code").alias("code"), "crash_code")


@query("""
SELECT p_partkey, '<NAME|' || p_name || '>:<KIND|' || p_type || '>' AS shown, p_name || ':' || p_type AS stripped, p_type AS kind,
       length(p_name) AS name_at, (length(p_name) + 2)::BIGINT AS kind_at FROM part""")
def tokens_and_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens put into texts, read, taken out, and positions led back to the text without them."""
    text = F.concat(X.token_column("NAME", F.col("p_name")), F.lit(":"), X.token_column("KIND", F.col("p_type")))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("t"), F.length("p_name").alias("n")).withColumn("map", X.token_map("t"))
    at = lambda pos: T.source_position(F.col("map"), pos)["pos"].cast("long")
    # the colon, and the second letter of the second token's argument
    return rows.select(
        "p_partkey", X.show_tokens(F.col("t")).alias("shown"), X.strip_tokens(F.col("t")).alias("stripped"), F.get(X.tokens(F.col("t")), F.lit(1))["argument"].alias("kind"),
        at(F.col("n") + 7).alias("name_at"), at(F.col("n") + 15).alias("kind_at"),
    )


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) // 3 AS p FROM documents),
     e AS (SELECT *, substring(t, 1, p) AS before, substring(t, p + 1) AS behind FROM d),
     f AS (SELECT *, length(before) - length(replace(before, chr(10), '')) AS line, CASE WHEN strpos(before, chr(10)) = 0 THEN before ELSE right(before, strpos(reverse(before), chr(10)) - 1) END AS head,
                  split_part(behind, chr(10), 1) AS rest FROM e)
SELECT doc_id, md5((CASE WHEN strpos(before, chr(10)) > 0 AND right(before, 1) = chr(10) THEN '' ELSE head END) || rest || chr(10) || repeat(' ', length(CASE WHEN right(before, 1) = chr(10) THEN '' ELSE head END)) || '^' || chr(10)) AS picture,
       line::INTEGER AS start_line, length(CASE WHEN right(before, 1) = chr(10) THEN '' ELSE head END)::INTEGER AS start_character, 2 AS severity,
       'doc:' || (line + 1) || ':' || (length(CASE WHEN right(before, 1) = chr(10) THEN '' ELSE head END) + 1) || ': Warning (150): odd' AS said,
       ((line + 1)::BIGINT << 32) + ((length(CASE WHEN right(before, 1) = chr(10) THEN '' ELSE head END) + 1)::BIGINT << 16) + 150 AS signature
FROM f""")
def errors_in_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error at a third of each text: the line with a caret, the editor's range and severity, the message line."""
    t = F.coalesce("text", F.lit(""))
    error = F.struct(F.floor(F.length(t) / 3).cast("int").alias("pos"), F.lit(1).alias("length"), F.lit(150).alias("code"), F.lit("odd").alias("message"))
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"), error.alias("e"))
    d = X.diagnostic(F.col("t"), F.col("e"))
    return rows.select(
        "doc_id", F.md5(X.visualize(F.col("t"), F.col("e.pos")).cast("binary")).alias("picture"), d["range"]["start"]["line"].alias("start_line"), d["range"]["start"]["character"].alias("start_character"),
        d["severity"].alias("severity"), X.error_string("doc", F.col("t"), F.col("e")).alias("said"), X.error_signature(F.col("t"), F.col("e")).alias("signature"),
    )


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS n_errors, CASE WHEN p_partkey % 4 = 0 THEN 'ZOMBIE__' END AS leaf, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS n_below,
       0::BIGINT AS n_in_key FROM part""")
def errors_at_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that the parse found, tied to the leaf at their place and counted below a node."""
    g = P.grammar("pair = key `=` §value\nkey = /\\w+/\nvalue = /[0-9]+/")
    text = F.concat(F.lit("k="), F.when(F.col("p_partkey") % 4 == 0, F.lit("?")).otherwise(F.col("p_partkey").cast("string")))
    rows = P.parse(table(spark, sf_dir, "part").select("p_partkey", text.alias("t")), "t", g)
    tree, errors = F.col("tree"), F.col("errors")
    leaf = X.error_leaf(tree, F.get(errors, F.lit(0)))["name"]
    below = lambda k: F.size(X.errors_below(tree, errors, F.get(tree, F.lit(k)))).cast("long")
    return rows.select("p_partkey", F.size(errors).cast("long").alias("n_errors"), F.when(F.size(errors) > 0, leaf).alias("leaf"), below(0).alias("n_below"), below(1).alias("n_in_key"))


@query("SELECT o_orderkey, (o_orderkey % 1000) + 1 - 2 * (o_custkey % 10) AS value FROM orders")
def nested_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums in up to twelve pairs of brackets through a left-recursive grammar: time is linear in the nesting. Each distinct text is parsed once."""
    from .operators import rewrite as R
    from .queries import SUM

    deep = (F.col("o_orderkey") % 13).cast("int")
    text = F.concat(F.repeat(F.lit("("), deep), (F.col("o_orderkey") % 1000).cast("string"), F.lit("+1"), F.repeat(F.lit(")"), deep), F.lit("-2*"), F.lit("("), (F.col("o_custkey") % 10).cast("string"), F.lit(")"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))

    def apply(*parts):
        total = parts[0]
        for sign, x in zip(parts[1::2], parts[2::2], strict=True):
            total = total + x if sign == "+" else total - x if sign == "-" else total * x
        return total

    def evaluated(texts: DataFrame) -> DataFrame:
        trees = P.parse(texts.select("t", F.col("t").alias("text")), "text", P.grammar(SUM)).select("t", "tree")
        return R.evaluated(trees, {"expr": apply, "term": apply, "number": int, "group": lambda a, x, b: x, ":Text": str}, "long").select("t", "value")

    return P.each_text_once(rows, "t", evaluated).select("o_orderkey", "value")


UNIT_SQL = """
WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS w FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS path, kind, name, CASE WHEN kind = 'match' THEN NULL WHEN kind = 'fail' THEN NULL
  ELSE '(pair (key "' || w || '") (:Text "=") (value "' || p_partkey || '"))' END AS tree, kind <> 'cst' OR name <> 'M2' AS passed
FROM p, (VALUES ('match', 'M1'), ('match', 'M2'), ('fail', 'F1'), ('cst', 'M1'), ('cst', 'M2')) AS c(kind, name)"""


@query(UNIT_SQL)
def unit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of unit cases, one made of each part, read as a table of cases and run; the second expectation of each is wrong."""
    word, number = F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_partkey").cast("string")
    tree = F.concat(F.lit('(pair (key "'), word, F.lit('")\n    (:Text "=")\n    (value "'), number, F.lit('"))\n'))
    pair = F.concat(word, F.lit("="), number)
    text = F.concat(
        F.lit("# cases\n[match:pair]\nM1: "), pair, F.lit('\nM2: """'), pair, F.lit('"""\n\n[fail:pair]\nF1: "'), number, F.lit('"\n[CST:pair]\nM1: '), tree, F.lit('M2: (pair (key "0"))\n'),
    )
    cases = U.cases(table(spark, sf_dir, "part").select(number.alias("path"), text.alias("text")))
    found = C.unit_cases(cases, P.grammar("pair = key `=` value\nkey = /[a-zA-Z#]+/\nvalue = /[0-9]+/"), keep=["path"])
    return found.select("path", "kind", "name", F.when(F.col("kind") == "cst", F.col("got")).alias("tree"), "passed")
