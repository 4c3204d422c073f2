"""Readers and writers of trees: S-expressions, XML, JSON forms, outlines and HTML; as kernels and as columns."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tree import NODE_TYPE, TREE_TYPE, Node, encode

SXPR_TOKEN = re.compile(r"""\s*(?:(\()\s*([^\s()"'`]+)|(\))|"((?:\\.|[^"\\])*)"|'((?:\\.|[^'\\])*)'|([^\s()"']+))""", re.S)
NAME = re.compile(r"[A-Za-z_:][\w.:-]*")


def parse_sxpr(text: str) -> Node:
    """A tree from ``(name `(attr "value") "text" (child ...))``; several strings of a leaf are joined by blanks' absence."""
    stack: list[tuple[Node, list]] = []
    at, root = 0, None
    text = text.strip()
    while at < len(text):
        if text.startswith("`(", at) and stack:
            m = re.compile(r"`\(\s*([^\s()\"]+)\s*(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[^\s()]*)\s*\)\s*").match(text, at)
            if not m:
                raise ValueError(f"bad attribute at {at}")
            value = m[2][1:-1] if m[2][:1] in ("'", '"') else m[2]
            stack[-1][0].attrs[m[1]] = re.sub(r"\\(.)", r"\1", value)
            at = m.end()
            continue
        m = SXPR_TOKEN.match(text, at)
        if not m or root is not None:
            raise ValueError(f"unexpected {text[at : at + 10]!r} at {at}")
        at = m.end()
        while at < len(text) and text[at].isspace():
            at += 1
        if m[1]:
            stack.append((Node(m[2]), []))
        elif m[3]:
            if not stack:
                raise ValueError("closing bracket without an opening one")
            node, parts = stack.pop()
            if all(isinstance(p, str) for p in parts):
                node.result = "".join(parts)
            else:
                node.result = [p if isinstance(p, Node) else Node(":Text", p) for p in parts]
            if stack:
                stack[-1][1].append(node)
            else:
                root = node
        else:
            if not stack:
                raise ValueError("text outside of a node")
            raw = m[4] if m[4] is not None else m[5] if m[5] is not None else m[6]
            stack[-1][1].append(re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), raw, flags=re.S))
    if stack or root is None:
        raise ValueError("missing closing bracket" if stack else "no tree")
    return root


def _quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def as_sxpr(root: Node, indent: int | None = None) -> str:
    """One line, or with ``indent`` blanks a level one node a line."""
    out: list[str] = []
    stack: list[tuple[Node | str, int]] = [(root, 0)]
    while stack:
        n, depth = stack.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        gap = "" if not out else " " if indent is None else "\n" + " " * (indent * depth)
        head = f"{gap}({n.name}" + "".join(f" `({k} {_quoted(v)})" for k, v in n.attrs.items())
        if n.children is None:
            out.append(head + (f" {_quoted(n.text)})" if n.text else ")"))
        else:
            out.append(head)
            stack.append((")", 0))
            stack += [(c, depth + 1) for c in reversed(n.children)]
    return "".join(out)


def flatten_sxpr(text: str, threshold: int = 92) -> str:
    """An S-expression on one line if that is no longer than the threshold (below 0: always)."""
    flat = re.sub(r"\s+(?=\))", "", re.sub(r"\s+", " ", text)).strip()
    return flat if threshold < 0 or len(flat) <= threshold else text


def xml_name(name: str) -> str:
    return "ANONYMOUS_" + name[1:] + "__" if name[:1] == ":" else name


def restore_name(name: str) -> str:
    m = re.fullmatch(r"ANONYMOUS_(.*)__", name)
    return ":" + m[1] if m else name


def as_xml(root: Node, string_tags: frozenset[str] = frozenset({":Text"}), empty_tags: frozenset[str] = frozenset(), inline: bool = True, indent: int = 2) -> str:
    out: list[str] = []
    stack: list[tuple[Node | str, int]] = [(root, 0)]
    while stack:
        n, depth = stack.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        gap = "" if inline or not out else "\n" + " " * (indent * depth)
        if n.name in string_tags and n.children is None and not n.attrs:
            out.append(gap + html.escape(n.text, quote=False))
            continue
        name = xml_name(n.name)
        head = f"{gap}<{name}" + "".join(f' {k}="{html.escape(v)}"' for k, v in n.attrs.items())
        if n.children is None:
            if not n.text and (n.name in empty_tags or not empty_tags):
                out.append(head + "/>")
            else:
                out.append(f"{head}>{html.escape(n.text, quote=False)}</{name}>")
        else:
            out.append(head + ">")
            stack.append((("" if inline else "\n" + " " * (indent * depth)) + f"</{name}>", 0))
            stack += [(c, depth + 1) for c in reversed(n.children)]
    return "".join(out)


TAG = re.compile(r"""<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?.*?\?>|<!(?:[^\[>]|\[.*?\])*>|<(?P<close>/)?\s*(?P<name>[A-Za-z_:][\w.:-]*)(?P<attrs>(?:[^<>"']|"[^"]*"|'[^']*')*?)(?P<empty>/)?\s*>""", re.S)
ATTR = re.compile(r"""([A-Za-z_:][\w.:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())  # fixed values of HTML
RAW = frozenset({"script", "style"})


def parse_xml(text: str, string_tag: str = ":Text", keep_space: bool = False, tolerant: bool = False) -> Node:
    """A tree from XML text: instructions, document types and comments are left out; blank text that spans lines is, too.

    ``tolerant`` reads HTML as it is found: names in lower case, void and raw-text elements, closing tags that are missing or
    have no opening one. Otherwise such faults raise ValueError.
    """
    root = Node("")
    stack, at = [(root, [])], 0

    def add_text(s: str) -> None:
        if s and (keep_space or s.strip() or "\n" not in s):
            stack[-1][1].append(Node(string_tag, html.unescape(s)))

    def close() -> None:
        node, parts = stack.pop()
        if len(parts) == 1 and parts[0].name == string_tag and parts[0].children is None:
            node.result = parts[0].text
        else:
            node.result = parts
        stack[-1][1].append(node)

    while at < len(text):
        m = TAG.search(text, at)
        if not m:
            break
        add_text(text[at : m.start()]) if m.start() > at else None
        at = m.end()
        if m["cdata"] is not None:
            stack[-1][1].append(Node(string_tag, m["cdata"]))
        elif m["name"]:
            name = restore_name(m["name"].lower() if tolerant else m["name"])
            if m["close"]:
                if tolerant and all(n.name != name for n, _ in stack[1:]):
                    continue
                while tolerant and stack[-1][0].name != name:
                    close()
                if len(stack) < 2 or stack[-1][0].name != name:
                    raise ValueError(f"</{name}> at {m.start()} closes nothing")
                close()
                continue
            attrs = {k: html.unescape(v[1:-1] if v[:1] in ("'", '"') else v) for k, v in ATTR.findall(m["attrs"] or "")}
            stack.append((Node(name, "", attrs), []))
            if m["empty"] or (tolerant and name in VOID):
                close()
            elif tolerant and name in RAW:
                end = re.compile(f"</{name}\\s*>", re.I).search(text, at)
                stop = end.start() if end else len(text)
                if stop > at:
                    stack[-1][1].append(Node(string_tag, text[at:stop]))
                at = end.end() if end else len(text)
                close()
    add_text(text[at:])
    if len(stack) > 1:
        if not tolerant:
            raise ValueError(f"<{stack[-1][0].name}> is not closed")
        while len(stack) > 1:
            close()
    parts = [p for p in stack[0][1] if p.name != string_tag or p.text.strip()]
    if len(parts) == 1 and parts[0].name != string_tag:
        return parts[0]
    if not tolerant:
        raise ValueError("not one root element")
    return Node("html" if tolerant else "", parts)


def to_json_obj(n: Node, as_dict: bool = False) -> object:
    result = n.text if n.children is None else [to_json_obj(c, as_dict) for c in n.children]
    if as_dict:
        return {n.name: {c.name: to_json_obj(c, True)[c.name] for c in n.children} if n.children and len({c.name for c in n.children}) == len(n.children) else result}
    return [n.name, result, *([n.attrs] if n.attrs else []), *([n.pos] if n.pos is not None else [])]


def from_json_obj(x: object) -> Node:
    if not isinstance(x, list) or len(x) < 2 or not isinstance(x[0], str):
        raise ValueError("not a tree in JSON form")
    rest = x[2:]
    return Node(x[0], x[1] if isinstance(x[1], str) else [from_json_obj(c) for c in x[1]], next((r for r in rest if isinstance(r, dict)), None), next((r for r in rest if isinstance(r, int)), None))


def as_outline(root: Node) -> str:
    """One line a node: indented names, texts quoted."""
    return "\n".join("  " * r["depth"] + r["name"] + (f" {json.dumps(r['text'], ensure_ascii=False)}" if r["text"] else "") for r in encode(root))


def as_html(root: Node, css: str = "", lang: str = "en") -> str:
    style = f"<style>{css}</style>" if css else ""
    return f'<!DOCTYPE html>\n<html lang="{lang}"><head><meta charset="UTF-8"/>{style}</head><body>{as_xml(root)}</body></html>'


def unist(root: Node, flavor: str = "xast", source: str | None = None) -> dict:
    """The tree as an object of the unist family: ``xast`` (elements and texts) or ``ndst`` (a node's name is its type).

    With the ``source`` text, nodes that know their position get a start and an end in line, column and offset.
    """
    import bisect

    breaks = [-1, *(m.start() for m in re.finditer("\n", source or ""))]

    def place(pos: int) -> dict:
        line = bisect.bisect_left(breaks, pos)
        return {"line": line, "column": pos - breaks[line - 1], "offset": pos}

    def made(n: Node, top: bool) -> tuple[dict, int | None]:
        out: dict = {"type": ("root" if top else "element"), "name": n.name} if flavor == "xast" else {"type": n.name}
        if n.attrs:
            out["attributes"] = dict(n.attrs)
        end = None
        if n.children is not None:
            out["children"] = []
            for c in n.children:
                child, end = made(c, False)
                out["children"].append(child)
        elif flavor == "xast":
            out["children"] = [{"type": "text", "value": n.text}]
        else:
            out["value"] = n.text
        if n.pos is not None and source is not None:
            end = n.pos + len(n.text) if n.children is None else end
            out["position"] = {"start": place(n.pos), "end": place(n.pos if end is None else end)}
        return out, end

    return made(root, True)[0]


def as_sxml(root: Node, form: int = 1) -> str:
    """SXML: attributes as ``(@ (name "value"))``; in form 2 every node has such a list, empty or not."""
    out: list[str] = []
    stack: list[Node | str] = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        attrs = "".join(f" ({k} {_quoted(v)})" for k, v in n.attrs.items())
        out.append((" " if out else "") + f"({n.name}" + (f" (@{attrs})" if attrs or form == 2 else ""))
        if n.children is None:
            out.append(f" {_quoted(n.text)})" if n.text else ")")
        else:
            stack += [")", *n.children[::-1]]
    return "".join(out)


def flatten_xml(text: str) -> str:
    """XML on one line: blanks and breaks between a tag and the next go."""
    return re.sub(r"(?<=>)\s*\n\s*(?=<)|(?<=>)\s*\n\s*(?=\S)|\s*\n\s*(?=<)", "", text).strip()


def one_line(text: str, most: int = 92) -> str:
    """A serialization of several lines on one, if that is no longer than ``most`` characters."""
    flat = re.sub(r"\s*\n\s*", " ", text).replace(" )", ")")
    return flat if len(flat) <= most else text


def frozen(n: Node) -> tuple:
    """A tree as nested tuples (name, text or children, attributes, position): equal trees are equal keys."""
    return n.name, n.text if n.children is None else tuple(map(frozen, n.children)), tuple(n.attrs.items()), n.pos


def thawed(t: tuple) -> Node:
    return Node(t[0], t[1] if isinstance(t[1], str) else [thawed(c) for c in t[1]], dict(t[2]), t[3])


def deserialize(text: str) -> Node | None:
    """By the first character: XML, S-expression or JSON; None for blank text."""
    s = text.strip()
    if not s:
        return None
    if s[0] == "<":
        return parse_xml(s)
    return parse_sxpr(s) if s[0] == "(" else from_json_obj(json.loads(s))


READERS = {"sxpr": parse_sxpr, "xml": parse_xml, "html": lambda s: parse_xml(s, tolerant=True), "json": lambda s: from_json_obj(json.loads(s)), "auto": deserialize}
WRITERS = {
    "sxpr": as_sxpr,
    "sxpr_indented": lambda n: as_sxpr(n, 2),
    "xml": as_xml,
    "xml_indented": lambda n: as_xml(n, inline=False),
    "html": as_html,
    "json": lambda n: json.dumps(to_json_obj(n), ensure_ascii=False),
    "dict": lambda n: json.dumps(to_json_obj(n, True), ensure_ascii=False),
    "tree": as_outline,
    "sxml": as_sxml,
    "sxml2": lambda n: as_sxml(n, 2),
    "xast": lambda n: json.dumps(unist(n), ensure_ascii=False),
    "ndst": lambda n: json.dumps(unist(n, "ndst"), ensure_ascii=False),
    "text": lambda n: n.content,
}


def tree_array(roots: list[Node | None]) -> pa.Array:
    """Trees as an Arrow column of the node array's type, filled field by field."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(TREE_TYPE)
    fields: list[list] = [[] for _ in range(10)]
    nids, pids, lasts, depths, orders, names, texts, begins, ends, places = fields
    keys, values, attr_ends, bounds = [], [], [0], [0]
    for root in roots:
        first, at = len(nids), 0
        stack: list[tuple[Node | None, int, int, int]] = [] if root is None else [(root, -1, 0, 0)]
        while stack:
            node, pid, depth, order = stack.pop()
            if node is None:  # all below row pid is done
                lasts[first + pid], ends[first + pid] = len(nids) - first - 1, at
                continue
            nid = len(nids) - first
            nids.append(nid)
            pids.append(pid)
            lasts.append(nid)
            depths.append(depth)
            orders.append(order)
            names.append(node.name)
            texts.append(node.text)
            begins.append(at)
            places.append(node.pos)
            if node.attrs:
                keys += node.attrs
                values += node.attrs.values()
            attr_ends.append(len(keys))
            if node.children is None:
                at += len(node.text)
                ends.append(at)
            else:
                ends.append(at)
                stack.append((None, nid, 0, 0))
                k = len(node.children)
                for c in reversed(node.children):
                    k -= 1
                    stack.append((c, nid, depth + 1, k))
        bounds.append(len(nids))
    item = kind.value_type
    cuts, names_of = pa.array(attr_ends, pa.int32()), pa.array(keys, pa.string())
    maps = pa.MapArray.from_arrays(cuts, names_of, pa.array(values, pa.string())).cast(item.field("attrs").type)
    columns = [pa.array(x, item.field(i).type) for i, x in enumerate(fields)] + [maps, pa.ListArray.from_arrays(cuts, names_of).cast(item.field("attr_keys").type)]
    rows = pa.StructArray.from_arrays(columns, fields=list(item))
    none = pa.array([r is None for r in roots], pa.bool_()) if any(r is None for r in roots) else None
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows, mask=none).cast(kind)


def nodes_of(column: pa.Array) -> list[Node | None]:
    """The nested forms of a column of trees, read field by field; None for null and empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_pylist()
    rows = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    fields = dict(zip((f.name for f in rows.type), rows.flatten(), strict=True))
    pids, names, texts, places = (fields[n].to_pylist() for n in ("pid", "name", "text", "pos"))
    sizes = fields["attrs"].offsets.to_numpy()
    some = set((sizes[1:] > sizes[:-1]).nonzero()[0].tolist())
    out: list[Node | None] = []
    for valid, a, b in zip(column.is_valid().to_pylist(), offsets[:-1], offsets[1:], strict=True):
        if not valid or a == b:
            out.append(None)
            continue
        made: list[Node] = []
        for k in range(a - offsets[0], b - offsets[0]):
            node = Node(names[k], texts[k] or "", None, places[k])
            if k in some:
                attrs = dict(fields["attrs"][k].as_py())
                node.attrs = {x: attrs[x] for x in fields["attr_keys"][k].as_py() or attrs}
            made.append(node)
            if pids[k] >= 0:
                up = made[pids[k]]
                if up.children is None:
                    up.children, up.text = [node], None
                else:
                    up.children.append(node)
        out.append(made[0])
    return out


def read_trees(df: DataFrame, column: str, format: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all others), ``tree`` and ``error`` (why a text could not be read, tree null)."""
    keep = [c for c in (keep or df.columns) if c != column]
    read = READERS[format]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                trees, errors = [], []
                for text in part.column(len(keep)).to_pylist():
                    try:
                        node = None if text is None else read(text)
                        trees.append(node)
                        errors.append(None)
                    except (ValueError, RecursionError) as e:
                        trees.append(None)
                        errors.append(str(e) or type(e).__name__)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], tree_array(trees), pa.array(errors, pa.string())], [*keep, "tree", "error"])

    some = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`"))
    schema = T.StructType([some.schema[c] for c in keep] + [T.StructField("tree", TREE_TYPE), T.StructField("error", T.StringType())])
    return some.mapInArrow(run, schema)


def serialize(tree: Column, how: str) -> Column:
    """A tree column as text in one of the formats of ``WRITERS``."""
    write = WRITERS[how]

    @F.arrow_udf(T.StringType())
    def run(trees: pa.Array) -> pa.Array:
        return pa.array([None if t is None else write(t) for t in nodes_of(trees)], pa.string())

    return run(tree)


__all__ = ["NODE_TYPE", "READERS", "WRITERS", "read_trees", "serialize"]
