import json
import re

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import text as X
from lexigrove.operators import compile as C
from lexigrove.operators import encode as E
from lexigrove.operators import markup as M
from lexigrove.operators import parse as P
from lexigrove.operators import rewrite as R
from lexigrove.operators import select as S
from lexigrove.operators import units as U
from lexigrove.plans import pipeline
from lexigrove.sources import serde
from lexigrove.streaming import streams

DOC = '(doc (head "A b") (para `(id "1") (w "c") (:Whitespace " ") (w "d") (e)) (para (b (w "x"))))'


@pytest.fixture(scope="module")
def tree(spark):
    df = serde.read_trees(spark.createDataFrame([(1, DOC)], "doc_id long, s string"), "s", "sxpr").cache()
    assert df.first().error is None
    return df


def one(df, *columns):
    return tuple(df.select(*columns).first())


def test_selection(tree):
    t = F.col("tree")
    c = S.content(t)
    names = lambda x: F.transform(x, lambda n: n["name"])
    texts = lambda x: F.transform(x, lambda n: S.node_content(c, n))
    assert one(tree, c) == ("A bc dx",)
    assert one(tree, texts(S.select(t, "w")), texts(S.select(t, "w", reverse=True)), names(S.select(t, {"head", "b"}))) == (["c", "d", "x"], ["x", "d", "c"], ["head", "b"])
    assert one(tree, names(S.select(t, re.compile("[cd]"), text=c)), texts(S.select(t, "w", skip="b")), names(S.select(t, S.VOID))) == (["w", "w"], ["c", "d"], ["e"])
    assert one(tree, S.pick(t, "zz"), S.pick(t, "w")["nid"], S.get_attr(S.pick(t, "para"), "id"), S.get_attr(S.pick(t, "head"), "id", "?")) == (None, 3, "1", "?")
    para = S.pick(t, "para")
    assert one(tree, names(S.children(t, para)), S.index(t, para, "e"), S.indices(t, para, "w"), S.pick_child(t, para, "w", reverse=True)["text"]) == (["w", ":Whitespace", "w", "e"], 3, [0, 2], "d")
    x = S.pick(t, "w", reverse=True)
    assert one(tree, S.path_str(t, x), S.parent(t, x)["name"], names(S.descendants(t, S.root(t), "w")), S.match_path_str(S.path_str(t, x), "/doc/*/w")) == ("/doc/para/b/w", "b", ["w"] * 3, True)
    p = S.path(t, x)
    assert one(tree, names(S.path_head(p, "para")), names(S.path_tail(p, "para")), names(S.path_head(p, "q")), S.common_ancestor(p, S.path(t, S.pick(t, "w")))["name"]) == (["doc", "para"], ["para", "b", "w"], [], "doc")
    assert one(tree, S.leaf_at(t, F.lit(3))["text"], S.leaf_at(t, F.lit(3), left_biased=True)["text"], S.leaf_at(t, F.lit(99))) == ("c", "A b", None)
    assert one(tree, names(S.siblings(t, para, True)), names(S.siblings(t, para, False)), S.foregoing(c, para, 2), S.ensuing(c, para, 5)) == (["para"], ["head"], " b", "x")
    assert one(tree, S.content_of(t, "para", "b"), S.content_of(t, "w")) == ("c d", "cdx")
    assert [r.name for r in S.empty_names(tree).collect()] == ["e"]


def test_node_rows(tree):
    rows = S.with_paths(tree)
    assert {r.nid: "/".join(r.names) for r in rows.collect()}[8] == "doc/para/b"
    pairs = S.ancestor_join(S.nodes(tree, where="w"), S.nodes(tree, where="para"))
    assert sorted((r.below, r.above) for r in pairs.collect()) == [(3, 2), (5, 2), (9, 7)]
    near = S.with_leaf_neighbours(S.nodes(tree)).collect()
    assert [(r.nid, r.prev_leaf, r.next_leaf) for r in near] == [(1, None, 3), (3, 1, 4), (4, 3, 5), (5, 4, 6), (6, 5, 9), (9, 6, None)]


def test_mapping(tree):
    t = F.col("tree")
    m = M.mapping(t, "para", "b")
    assert [(r.leaf_idx, r.nid, r.start, r.end) for r in tree.select(m.alias("m")).first().m] == [(0, 3, 0, 1), (1, 4, 1, 2), (2, 5, 2, 3), (3, 6, 3, 3)]
    assert one(tree, M.locate(m, F.lit(1))["nid"], M.locate(m, F.lit(1), True)["nid"]) == (4, 3)


@pytest.mark.parametrize("divisible", [frozenset(), frozenset({"b"})])
def test_markup_keeps_content(divisible):
    source = '(doc (p (:Text "one ") (b "two") (:Text " three")) (p (i (:Text "fo") (u "ur"))))'
    whole = serde.parse_sxpr(source).content
    for a in range(len(whole)):
        for b in range(a + 1, len(whole) + 1):
            t = serde.parse_sxpr(source)
            n = M.markup(t, a, b, "hi", divisible=divisible, chain="c")
            assert n >= 1 and t.content == whole
            assert "".join(x.content for x in t.walk() if x.name == "hi") == whole[a:b]


def test_insert_split_segment():
    t = serde.parse_sxpr('(doc (a "12") (lb) (b (c "3") (lb) (d "4")))')
    assert [serde.as_sxpr(x) for x in M.split(t, lambda n: n.name == "lb")] == ['(doc (a "12"))', '(doc (b (c "3")))', '(doc (b (d "4")))']
    assert serde.as_sxpr(M.segment(t, 4, 6)) == '(b (c "3") (lb) (d "4"))'
    M.insert_node(t, 1, serde.parse_sxpr("(x)"))
    assert serde.as_sxpr(t).startswith('(doc (a (:Text "1") (x) (:Text "2"))')


@pytest.mark.parametrize(
    "source, table, result",
    [
        ('(a (b "x"))', {"a": R.replace_by_single_child}, '(b "x")'),
        ('(a (b "x"))', {"a": R.reduce_single_child}, '(a "x")'),
        ('(a (:b "x"))', {"a": R.replace_or_reduce()}, '(a "x")'),
        ('(a (b (c "x") (d "y")) (e "z"))', {"b": R.replace_by_children}, '(a (c "x") (d "y") (e "z"))'),
        ('(a (:b (c "x") (:d (e "y"))) (f "z"))', {"a": R.flatten()}, '(a (c "x") (e "y") (f "z"))'),
        ('(a (b "x") (c "y"))', {"a": R.collapse}, '(a "xy")'),
        ('(a (:Text "x") (:RegExp "y"))', {"a": R.merge_treetops}, '(a "xy")'),
        ('(a (b "x") (b "y") (c "z"))', {"a": R.merge_adjacent(R.is_a("b"))}, '(a (b "xy") (c "z"))'),
        ('(a (:Text "x") (:T "y") (c "z"))', {"a": R.collapse_children_if(R.is_anonymous, "t")}, '(a (t "xy") (c "z"))'),
        ('(a (w "x") (s " ") (w "y") (s " ") (c "z"))', {"a": R.merge_connected(R.is_a("w"), R.is_a("s"), "w", "s")}, '(a (w "x y") (s " ") (c "z"))'),
        ('(a (b (s " ") (c "x") (s " ")))', {"b": R.move_fringes(R.is_a("s"))}, '(a (s " ") (b (c "x")) (s " "))'),
        ('(a (p (x "1") (m "2") (y "3")))', {"m": R.pull_up}, '(a (p (x "1")) (m (p "2")) (p (y "3")))'),
        ('(e (n "1") (o "-") (n "2") (o "-") (n "3"))', {"e": R.left_associative}, '(e (e (n "1") (o "-") (n "2")) (o "-") (n "3"))'),
        ('(m (n "1") (m (n "2") (n "3")))', {"<<<": R.lean_left("m")}, '(m (m (n "1") (n "2")) (n "3"))'),
        ('(a (s " ") (b "x") (s " "))', {"a": R.strip()}, '(a (b "x"))'),
        ('(a (s " ") (b "x") (s " "))', {"a": R.lstrip()}, '(a (b "x") (s " "))'),
        ('(a (b "1") (c "2") (b "3"))', {"a": R.keep_nodes("b")}, '(a (b "1") (b "3"))'),
        ('(a (b "1") (c "2"))', {"a": R.remove_children("c")}, '(a (b "1"))'),
        ('(a (b "1") (c "2"))', {"c": R.remove}, '(a (b "1"))'),
        ('(a (b "1") (c "2"))', {"a": R.keep_children(slice(1, None))}, '(a (c "2"))'),
        ('(a (:Text "(") (b "x") (:Text ")"))', {"a": R.remove_brackets}, '(a (b "x"))'),
        ('(a (:Text ",") (b "x"))', {"a": R.remove_tokens(",")}, '(a (b "x"))'),
        ('(a "x  y")', {"a": R.normalize_whitespace}, '(a "x y")'),
        ('(a (b "x"))', {"a": R.change_name("z"), "b": R.add_attributes({"k": "v"})}, '(z (b `(k "v") "x"))'),
        ('(a `(k "1") `(l "2") "x")', {"a": R.del_attributes("k")}, '(a `(l "2") "x")'),
        ('(a (b "1") (b "2"))', {"a": R.delimit_children(lambda: serde.Node("c", ","))}, '(a (b "1") (c ",") (b "2"))'),
        ('(a (b "1"))', {"a": R.insert(-1, lambda: serde.Node("c"))}, '(a (b "1") (c))'),
        ('(a (b "1"))', {"a": R.swap_nested}, '(b (a "1"))'),
        ('(a (b "1") (c "2"))', {"b, c": R.change_name("d"), "*": R.replace_child_names({"d": "e"})}, '(a (e "1") (e "2"))'),
        ('(a (b (c "")) (d "x"))', {"c": R.drop_leaf}, '(a (d "x"))'),
        ('(a (b "1"))', {"b": R.apply_if(R.replace_content_with("2"), R.has_ancestor("a"))}, '(a (b "2"))'),
        ('(a (b "1"))', {"b": R.apply_unless(R.replace_content_with("2"), R.has_parent("a"))}, '(a (b "1"))'),
    ],
)
def test_rewriting(source, table, result):
    t = serde.parse_sxpr(source)
    R.traverse(t, table)
    assert serde.as_sxpr(t) == result


def test_conditions_with_three_values():
    p = [serde.parse_sxpr("(a)")]
    unknown = lambda p: None
    assert R.neg(unknown)(p) is None and R.all_of(unknown, R.always)(p) is False and R.any_of(unknown, R.always)(p) is True
    assert R.three_valued(R.never, R.never)(p) is None and R.three_valued(R.never, R.always)(p) is False


def test_rewrite_reports_errors(spark, tree):
    out = R.rewrite(tree.select("doc_id", "tree"), {"w": R.error_on(R.content_matches("x"), "bad {content}", 1001), "para": R.forbid("b")}).first()
    assert [(e.code, e.message) for e in out.rewrite_errors] == [(1001, "bad x"), (1000, "para must not have b")]


def test_evaluate(spark):
    actions = {"n": float, "add": lambda *x: sum(x), "mul": lambda a, b: a * b}
    df = serde.read_trees(spark.createDataFrame([(1, '(add (n "1") (mul (n "2") (n "3")))'), (2, '(q "1")'), (3, None)], "k int, s string"), "s", "sxpr")
    assert [(r.k, r.value, r.error) for r in R.evaluated(df.select("k", "tree"), actions).orderBy("k").collect()] == [(1, 7.0, None), (2, None, "KeyError: 'q'"), (3, None, None)]


def test_parse_rows_and_history(spark):
    g = P.grammar("a = b { `+` §b }\nb = /\\w/")
    df = spark.createDataFrame([(1, "x+y"), (2, "x+"), (3, None), (4, "?")], "doc_id int, t string")
    rows = {r.doc_id: r for r in P.parse(df, "t", g).collect()}
    assert [rows[k].max_code for k in (1, 2, 3, 4)] == [0, 1010, 0, 1040] and rows[3].tree is None
    assert X.error_rows(P.parse(df, "t", g)).count() == 2
    assert P.history(df, "t", g).where("doc_id = 4 and symbol = 'b'").count() == 1
    steps = P.history(df, "t", g).orderBy("doc_id", "seq").select("doc_id", "seq", P.step_line().alias("line")).collect()
    assert [r.line for r in steps if r.doc_id == 1] == [
        "1:1  a->b  MATCH  x", "1:2  a->:Text  MATCH  +", "1:3  a->b  MATCH  y", "1:4  a->:Text  FAIL  ", "1:1  a  MATCH  x+y",
    ]
    assert [r.line for r in steps if r.doc_id == 2][2:] == ["1:3  a->b  FAIL  ", "1:3  a->1010  ERROR  ", "1:1  a  ABORT  x+"] and not [r for r in steps if r.doc_id == 3]
    assert [r.line for r in steps if r.doc_id == 4] == ["1:1  a->b  FAIL  ?", "1:1  a  FAIL  ?", "1:1  1040  ERROR  ?"]


def test_history_of_dropped_recalled_and_resumed(spark):
    g = P.grammar("@ drop = sep\n@ a_resume = /(;)/\nlist = a { sep a }\na = `[` §w `]` `;`\nsep = /\\n/\nw = /\\w+/")
    df = spark.createDataFrame([(1, "\ufeff[x];\n[?];"), (1, ""), (2, None)], "doc_id int, t string")
    rows = P.history(df, "t", g).collect()
    assert {(r.status, r.symbol, r.line, r.col, r.length) for r in rows if r.status in ("DROP", "RESUME")} == {("DROP", "sep", 1, 5, 1), ("RESUME", "a", 2, 2, 3)}
    assert P.history(df.limit(0), "t", g).count() == 0 and [r.doc_id for r in P.turning_points(P.history(df, "t", g)).collect()] == [1]
    g = P.grammar("s = x `1` | x `2`\nx = /a/")
    steps = P.history(spark.createDataFrame([(1, "a2"), (2, "b" * 50)], "doc_id int, t string"), "t", g)
    assert [r.recalled for r in steps.where("doc_id = 1 and symbol = 'x'").orderBy("seq").collect()] == [False, True]
    top = {r.doc_id: r for r in P.turning_points(steps).collect()}
    assert top[1].furthest_match.symbol == "s" and top[1].furthest_fail.excerpt == "2" and top[2].last_match is None and top[2].furthest_fail.excerpt == "b" * 40


def test_lines_and_tokens(spark):
    df = spark.createDataFrame([("ab\nc😀\n\nd", 5)], "t string, p int")
    t = F.col("t")
    assert one(df, X.line_breaks(t), X.line_col(t, F.col("p")), X.text_pos(t, F.lit(2), F.lit(3)), X.text_pos(t, F.lit(9), F.lit(1))) == ([2, 5, 6], (2, 3), 5, None)
    s, k = F.lit("semibold red"), F.lit
    assert one(df, X.has_token(s, k("red")), X.has_token(s, k("bold")), X.has_token(s, k("")), X.add_token(s, k("bold blue")), X.add_token(s, k("bold"), whole=True)) == (True, False, True, "semibold red blue", "semibold red bold")
    assert one(df, X.remove_token(s, k("bold")), X.remove_token(s, k("bold"), whole=True), X.eq_tokens(k("b a"), k("a b a")), X.normalize_tokens(k(" a  b ")), X.is_token_sequence(k("a  b"))) == ("semi red", "semibold red", True, "a b", False)
    assert [r[0] for r in spark.createDataFrame([(c,) for c in (0, 5, 100, 1040, 10400)], "c int").select(X.severity(F.col("c"))).collect()] == ["none", "notice", "warning", "error", "fatal"]


def test_includes():
    text, segments = X.expand_includes("m", {"m": 'A include("x") B', "x": '1include("y")2', "y": "yy"})
    assert text == "A 1yy2 B"
    files = {"m": 'A include("x") B', "x": '1include("y")2', "y": "yy"}
    for start, end, offset, name in segments:
        assert files[name][start + offset : end + offset] == text[start:end]
    with pytest.raises(ValueError):
        X.expand_includes("m", {"m": 'include("m")'})


def test_pipeline(spark):
    add = lambda n: lambda df: df.withColumn("x", F.col("x") + n)
    js = [pipeline.Junction("s", add(1), "a"), pipeline.Junction("a", add(10), "b"), pipeline.Junction("a", add(100), "c")]
    assert pipeline.as_paths(js) == {"b": ["s", "a", "b"], "c": ["s", "a", "c"]} and pipeline.origin(js) == "s"
    df = spark.createDataFrame([(1, 0), (2, 10400)], "x int, max_code int")
    out = pipeline.run(js, df)
    assert {k: [r.x for r in v.collect()] for k, v in out.items()} == {"b": [12], "c": [102]}
    with pytest.raises(ValueError):
        pipeline.connection(js, "zz")
    with pytest.raises(ValueError):
        pipeline.origin([*js, pipeline.Junction("q", add(1), "b")])


def test_trees_of_rows(spark):
    rows = spark.createDataFrame([(1, 2, "b", "u"), (1, 1, "a", "v"), (2, 1, None, "u")], "k int, o int, t string, n string")
    out = {r.k: r for r in E.group_trees(rows, "k", "o", "t", "n", "root").collect()}
    assert [(n.nid, n.name, n.text, n.cs, n.ce) for n in out[1].tree] == [(0, "root", None, 0, 2), (1, "v", "a", 0, 1), (2, "u", "b", 1, 2)]
    lines = spark.createDataFrame([("a\nb",), ("",)], "t string").select(E.line_tree(F.col("t")).alias("x")).collect()
    assert [n.text for n in lines[0].x] == [None, "a\n", "b"] and [n.text for n in lines[1].x] == [""]


def test_text_buffers(spark, tmp_path):
    schema = "doc_id long, version int, l1 int, c1 int, l2 int, c2 int, replacement string"
    spark.createDataFrame([(1, 1, 0, 0, 0, 0, "one\ntwo"), (1, 2, 1, 0, 1, 1, "T"), (2, 1, 0, 0, 0, 0, "x")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = streams.text_buffers(stream).writeStream.outputMode("update").format("memory").queryName("buffers").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r.doc_id, r.version, r.text) for r in spark.table("buffers").collect()) == [(1, 2, "one\nTwo"), (2, 1, "x")]
    with pytest.raises(ValueError):
        streams.apply_edit(["a"], 3, 0, 3, 0, "")


def test_compiler(spark):
    from lexigrove.operators.compile import Compiler, compiled, unit_cases

    class Sum(Compiler):
        def on_add(self, node):
            return sum(self.compile(c) for c in node.children)

        def on_n(self, node):
            if not node.text.isdigit():
                self.error(node, "no number", 1001)
                return 0
            return int(node.text)

        def attr_k(self, node, value):
            self.error(node, f"{self.path[0].name} has {value}", 1)

    df = serde.read_trees(spark.createDataFrame([(1, '(add (n "1") (add (n "2") (n `(k "v") "x")))'), (2, '(add "q")'), (3, "(other (n \"4\"))")], "k int, s string"), "s", "sxpr")
    out = compiled(df.select("k", "tree"), Sum).orderBy("k").collect()
    assert [(r.data, [e.code for e in r.errors]) for r in out] == [("3", [1, 1001]), (None, [10500]), ("[4]", [])]
    g = P.grammar("a = b { `+` b }\nb = /\\w/")
    cases = [("a", "match", "1", "x+y", None), ("a", "fail", "2", "x+", None), ("b", "cst", "3", "x", '(b "x")'), ("a", "ast", "4", "x", '(b "x")'), ("a", "match", "5", "+", None)]
    ran = unit_cases(spark.createDataFrame(cases, "symbol string, kind string, name string, input string, expect string"), g, {"a": R.replace_by_single_child})
    assert {r.name: r.passed for r in ran.collect()} == {"1": True, "2": True, "3": True, "4": True, "5": False}


def test_tag_names_are_whole(spark, tmp_path):
    from lexigrove import queries

    long = "x" * 150
    spark.createDataFrame([(1, "u", f"<{long}a><{long}b><p><p class='c'>")], "page_id int, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.page_tag_histogram(spark, str(tmp_path)).collect()
    assert {r.name: r.n for r in found} == {long + "a": 1, long + "b": 1, "p": 2}


def test_titles_as_written(spark, tmp_path):
    import duckdb

    from lexigrove import queries

    pages = [
        None, "", "plain", "<title>a&&amp</title><h1>k = &quot;73</h1>", "<title>&amp;lt; &lt;b&gt; &nbsp;&#65;</title>", "<h1>a<b>c</b></h1><h1>second</h1>", "<TITLE>x</TITLE><title id='1'>y</title>",
        "<!-- <title>in a comment --><title>behind</title>", "<script>'<h1>raw'</script>", "<title>\n \n</title><h1></h1>", "<title>a < b</title>", "\ufeff<title>mark\u00e9\U0001f600</title>", "<title><title>t<h1<h1>open", "<<h1>",
    ]
    folder = str(tmp_path)
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    found = queries.page_titles(spark, folder).collect()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
        wanted = con.execute(queries.ORACLE_SQL["page_titles"]).fetchall()
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_each_distinct_text_is_parsed_once_and_in_several_tasks(spark, tmp_path):
    from lexigrove import queries_trees

    rows = [(k, k % 20) for k in range(0, 52000, 13)] + [(5, 3), (5, 3), (7, None), (None, 1)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    found = queries_trees.nested_sums(spark, str(tmp_path))
    value = lambda k, c: None if k is None or c is None else k % 1000 + 1 - 2 * (c % 10)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((k, value(k, c)) for k, c in rows), key=str)
    plan = re.findall(r"^[ :+-]*(\w+)", found._jdf.queryExecution().optimizedPlan().toString(), re.M)
    assert " MapInArrow RepartitionByExpression Aggregate " in " ".join(x for x in plan if x != "Project")

    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("",), ("c",)], "t string").coalesce(1).withColumn("n", F.monotonically_increasing_id())
    done = P.each_text_once(texts, "t", lambda t: t.where("t <> 'c'").select("t", F.length("t").alias("size"), F.rand().alias("run")))
    got = {r.n: r for r in done.collect()}
    assert [got[k].t for k in range(6)] == ["a", "b", "a", None, "", "c"] and [got[k]["size"] for k in range(6)] == [1, 1, 1, None, 0, None]
    assert got[0].run == got[2].run != got[1].run


def test_long_trees_cost_in_proportion(spark):
    """50,000 leaves: built in the JVM, with offsets and paths that follow from the lines."""
    import time

    from lexigrove.operators import encode as E

    text = "".join(f"line {k}\n" for k in range(50_000))
    began = time.time()
    df = spark.createDataFrame([(1, text)], "doc_id int, t string").select("doc_id", E.line_tree(F.col("t")).alias("tree"))
    rows = S.with_paths(df).where("nid > 0").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids"), F.sum(F.col("ce") - F.col("cs")).alias("chars"), F.max("ce").alias("end")).first()
    assert (rows.n, rows.ids, rows.chars, rows.end) == (50_000, 100_000, len(text), len(text))
    assert time.time() - began < 60


def test_conditions_and_filters_of_tables():
    t = serde.parse_sxpr('(a (b (c "x") (:d "y")) (e "z"))')
    with pytest.raises(KeyError):
        R.expand_table({"a, b": [], "b": []})
    R.traverse(t, {"b": [R.BLOCK_LEAVES], "*": R.change_name("q")})
    assert serde.as_sxpr(t) == '(q (b (c "x") (:d "y")) (q "z"))'
    assert R.fuse(serde.parse_sxpr('(a (b "x") (c "y"))').children) == "xy"


def test_failing_steps_are_rows(spark, tree):
    out = R.rewrite(tree.select("doc_id", "tree"), {"w": lambda p: 1 // 0}).first()
    assert [(e.code, e.message) for e in out.rewrite_errors] == [(R.FAILED, "ZeroDivisionError: integer division or modulo by zero")]


def test_validation_rows(spark, tree):
    from lexigrove.operators import validate as V

    schema = serde.parse_sxpr('(branch (zero_or_more (alternative (leaf) (branch (zero_or_more (alternative (leaf) (branch)))))))')
    assert V.validated(tree.select("doc_id", "tree"), schema).first().invalid == []
    with pytest.raises(ValueError):
        V.validated(tree, serde.parse_sxpr("(nonsense)"))


def test_preprocessors_in_a_chain():
    from lexigrove.functions import preprocess as X

    mark = X.tokenizer(lambda s: (s.replace("def", X.make_token("DEF", "def")), [(0, "seen")]))
    both = X.chain(X.includes({"lib": "two\ndef\n"}), mark)
    got = both('one\ninclude("lib")\nthree def', "main")
    assert X.TOKEN.sub(lambda m: m[2], got.text) == "one\ntwo\ndef\n\nthree def"
    assert got.source(got.text.index("two")) == ("lib", 0) and got.source(got.text.rindex("def")) == ("main", 25) and got.errors == ((("main", 0)[1], "seen"),)
    assert X.nothing("x", "f").source(0) == ("f", 0)
    with pytest.raises(ValueError):
        X.SourceMap((1,), (0,), ("",))
    with pytest.raises(ValueError):
        X.make_token("no name")


def test_unit_files(spark):
    text = "; c\n[match:a]\nM1: x+y\nM2*: \"\"\"\nx\n[no section]\n\"\"\"\nM3: one\n    two\n      three\n\n[fail:a]\n[AST:a]\nM1: (a)\nM9: (b)\n"
    unit = U.read_ini(text)
    assert unit == {"a": {"match": {"M1": "x+y", "M2*": "\nx\n[no section]\n", "M3": "one\ntwo\n  three"}, "fail": {}, "ast": {"M1": "(a)", "M9": "(b)"}}}
    assert U.read_ini(U.write_ini(unit)) == unit == U.read_json(json.dumps(unit)) and U.merged(unit, {"b": {}}, unit) == {**unit, "b": {}}
    assert U.unit_report({"a": {"match": {"M": "x\ny"}}}) == "## a\n\n### match M\n\n    x\n    y\n"
    for value in ("", "a", "it's", '"', "'\"", '"""\n', "a\n'"):
        assert U.code(U.quoted(value)) == value
    for bad, message in (("[match:a]\nM: 1\nM*: 2", "line 3"), ("M: 1", "line 1"), ("[match:a]\n???", "line 2")):
        with pytest.raises(ValueError, match=message):
            U.read_ini(bad)
    with pytest.raises(ValueError, match="match:a:M1"):
        U.merged(unit, {"a": {"match": {"M1": "z"}}})
    files = spark.createDataFrame([("f.ini", text), ("g.json", "[1]"), ("h.ini", "?"), (None, None), ("i.ini", "")], "path string, text string")
    rows = {(r.path, r.kind, r.name): r for r in U.cases(files).collect()}
    assert len(rows) == 7 and rows["f.ini", "ast", "M1"].input == "x+y" and rows["f.ini", "ast", "M9"].error == "no match of this name"
    assert rows["g.json", None, None].error.startswith("AttributeError") and rows["h.ini", None, None].error.startswith("ValueError: line 1")
    done = C.unit_cases(U.cases(files).where("kind = 'match' and name = 'M1'"), P.grammar("a = /x/ `+` /y/"), keep=["path"])
    assert [(r.path, r.passed, r.report) for r in done.select("*", U.report().alias("report")).collect()] == [("f.ini", True, '### a, match M1: passed\n\n    (a (:RegExp "x") (:Text "+") (:RegExp "y"))')]
