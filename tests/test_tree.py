import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrove.sources import serde
from lexigrove.tree import Node, check, decode, encode, set_positions

names = st.sampled_from(["a", "b", ":Text", "w.x", "c-d"])
texts = st.text(alphabet='ab \n"\\<&é😀', max_size=6)
leaves = st.builds(lambda n, t: Node(n, t), names, texts)
trees = st.recursive(leaves, lambda kids: st.builds(lambda n, c, a: Node(n, c, a), names, st.lists(kids, min_size=1, max_size=4), st.dictionaries(st.sampled_from(["k", "l"]), st.text(alphabet='x"<\\', max_size=3))), max_leaves=12)


@given(trees)
@settings(max_examples=150, deadline=None)
def test_encoding_round_trip(tree):
    rows = encode(tree)
    assert check(rows) == [] and decode(rows).equals(tree, ignore_attr_order=False)
    assert tree.content == "".join(r["text"] for r in rows if r["text"] is not None)
    assert all(tree.content[r["cs"] : r["ce"]] == n.content for r, n in zip(rows, tree.walk(), strict=True))


@given(trees)
@settings(max_examples=150, deadline=None)
def test_serialization_round_trips(tree):
    assert serde.parse_sxpr(serde.as_sxpr(tree)).equals(tree)
    assert serde.parse_sxpr(serde.as_sxpr(tree, 2)).equals(tree)
    assert serde.from_json_obj(json.loads(json.dumps(serde.to_json_obj(tree)))).equals(tree)


@pytest.mark.parametrize("text", ['(a (b "x") (c `(k "v") "y"))', '(a "x" "y")', "(a)", '(a (b "(") (:Text ")"))'])
def test_sxpr(text):
    assert serde.parse_sxpr(serde.as_sxpr(serde.parse_sxpr(text))).equals(serde.parse_sxpr(text))


@pytest.mark.parametrize("bad", ["", "(a", "a)", '(a "x") (b)', '"x"', '(a "x"))'])
def test_bad_sxpr(bad):
    with pytest.raises(ValueError):
        serde.parse_sxpr(bad)


def test_xml():
    t = serde.parse_xml('<?xml version="1.0"?><!DOCTYPE d><doc id="1 &amp; 2"><!-- no -->a &lt; b<x/><y z=\'q\'>t</y>\n  <![CDATA[<raw>]]></doc>')
    assert serde.as_sxpr(t) == '(doc `(id "1 & 2") (:Text "a < b") (x) (y `(z "q") "t") (:Text "<raw>"))'
    assert serde.parse_xml(serde.as_xml(t)).content == t.content
    for bad in ("<a>", "<a></b>", "</a>", "<a/><b/>"):
        with pytest.raises(ValueError):
            serde.parse_xml(bad)


def test_html_is_read_as_found():
    t = serde.parse_xml('<HTML><p>a<br>b<script>x</p></script><li>c</p></ul>d', tolerant=True)
    assert serde.as_sxpr(t) == '(html (p (:Text "a") (br) (:Text "b") (script "x</p>") (li "c")) (:Text "d"))'


def test_outline_and_dispatch():
    t = serde.parse_sxpr('(a (b "x") (c))')
    assert serde.as_outline(t) == 'a\n  b "x"\n  c'
    assert all(serde.deserialize(serde.WRITERS[k](t)).equals(t) for k in ("sxpr", "json", "xml"))
    assert serde.deserialize("  ") is None
    assert serde.unist(set_positions(t), source=t.content)["position"]["start"] == {"offset": 0, "line": 1, "column": 1}
    assert "position" not in serde.unist(t)


def test_deep_and_wide_trees():
    deep = Node("x", "y")
    for _ in range(5000):
        deep = Node("x", [deep])
    assert check(encode(deep)) == [] and encode(deep)[-1]["depth"] == 5000 and deep.copy().equals(deep)
    assert decode(encode(Node("r", [Node("c", "t") for _ in range(10_000)]))).content == "t" * 10_000
