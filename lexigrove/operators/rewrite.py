"""Tree rewriting: node-local steps chosen by name in a post-order walk, a whole table fused into one kernel call.

A step is a function of a path (root to node); it changes the kernel's own copy of the tree. Steps with parameters are made
by functions that return them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.serde import WRITERS, nodes_of, tree_array
from ..tree import ERROR_TYPE, TREE_TYPE, Node

Path = list[Node]
Step = Callable[[Path], object]
Condition = Callable[[Path], bool | None]


# -- conditions: true, false or unknown (None)


def always(p: Path) -> bool:
    return True


def never(p: Path) -> bool:
    return False


def neg(c: Condition) -> Condition:
    return lambda p: None if (x := c(p)) is None else not x


def any_of(*cs: Condition) -> Condition:
    return lambda p: any(c(p) for c in cs)


def all_of(*cs: Condition) -> Condition:
    return lambda p: all(c(p) for c in cs)


def three_valued(true: Condition, false: Condition) -> Condition:
    return lambda p: True if true(p) else False if false(p) else None


def is_single_child(p: Path) -> bool:
    return len(p) > 1 and len(p[-2].children) == 1


def is_named(p: Path) -> bool:
    return not p[-1].anonymous


def is_anonymous(p: Path) -> bool:
    return p[-1].anonymous


def is_anonymous_leaf(p: Path) -> bool:
    return p[-1].anonymous and p[-1].children is None


def is_empty(p: Path) -> bool:
    return p[-1].children is None and not p[-1].text


def contains_only_whitespace(p: Path) -> bool:
    return not p[-1].content.strip()


def is_token(*tokens: str) -> Condition:
    return lambda p: p[-1].name == ":Text" and p[-1].children is None and (not tokens or p[-1].text in tokens)


def is_a(*names: str) -> Condition:
    return lambda p: p[-1].name in names


def not_a(*names: str) -> Condition:
    return lambda p: p[-1].name not in names


def name_matches(rx: str) -> Condition:
    return lambda p: re.fullmatch(rx, p[-1].name) is not None


def content_matches(rx: str) -> Condition:
    return lambda p: re.match(rx, p[-1].content) is not None


def has_content(text: str) -> Condition:
    return lambda p: p[-1].content == text


def has_attr(name: str, value: str | None = None) -> Condition:
    return lambda p: name in p[-1].attrs and (value is None or p[-1].attrs[name] == value)


def has_ancestor(*names: str, generations: int = 0, until: Iterable[str] = ()) -> Condition:
    """A named node above within so many generations; without a number the node itself counts, too."""
    stop = set(until)

    def test(p: Path) -> bool:
        for n in reversed(p[:-1][-generations:] if generations > 0 else p):
            if n.name in names:
                return True
            if n.name in stop:
                return False
        return False

    return test


def has_parent(*names: str) -> Condition:
    return lambda p: len(p) > 1 and p[-2].name in names


def has_children(p: Path) -> bool:
    return p[-1].children is not None


def has_child(*names: str) -> Condition:
    return lambda p: any(c.name in names for c in p[-1].children or ())


def has_descendant(*names: str, generations: int = 0) -> Condition:
    def test(p: Path) -> bool:
        level, depth = p[-1].children or [], 1
        while level and (generations <= 0 or depth <= generations):
            if any(c.name in names for c in level):
                return True
            level, depth = [x for c in level for x in c.children or ()], depth + 1
        return False

    return test


def has_sibling(*names: str) -> Condition:
    return lambda p: len(p) > 1 and any(c is not p[-1] and c.name in names for c in p[-2].children)


# -- control


def apply_if(steps: Step | list[Step], c: Condition) -> Step:
    return lambda p: run_steps(p, steps) if c(p) else None


def apply_unless(steps: Step | list[Step], c: Condition) -> Step:
    return lambda p: None if c(p) else run_steps(p, steps)


def apply_ifelse(yes: Step | list[Step], no: Step | list[Step], c: Condition) -> Step:
    return lambda p: run_steps(p, yes if c(p) else no)


def run_steps(p: Path, steps: Step | list[Step]) -> None:
    for s in steps if isinstance(steps, (list, tuple)) else [steps]:
        s(p)


def traverse_locally(table: dict) -> Step:
    return lambda p: traverse(p[-1], table)


# -- steps


def update_attr(node: Node, *others: Node) -> None:
    """Attributes of nodes that will go are added to ``node``; ValueError if both have different values of one."""
    for other in others:
        if other is not node:
            for k, v in other.attrs.items():
                if node.attrs.get(k, v) != v:
                    raise ValueError(f"{node.name} and {other.name} have different values of {k}: {node.attrs[k]!r}, {v!r}")
                node.attrs = node.attrs | {k: v}


def update_attr_unless(node: Node, *others: Node, exclude: Condition) -> None:
    """``update_attr`` from those that ``exclude`` does not hold for."""
    update_attr(node, *(o for o in others if not exclude([o])))


def swap_attributes(a: Node, b: Node) -> None:
    a.attrs, b.attrs = b.attrs, a.attrs


def _take(node: Node, other: Node) -> None:
    node.result = other.result
    update_attr(node, other)


def replace_by_single_child(p: Path) -> None:
    """The node becomes its only child."""
    n = p[-1]
    if n.children and len(n.children) == 1:
        n.name = n.children[0].name
        _take(n, n.children[0])


def reduce_single_child(p: Path) -> None:
    """The only child's result moves up; the node keeps its name."""
    n = p[-1]
    if n.children and len(n.children) == 1:
        _take(n, n.children[0])


def replace_or_reduce(c: Condition = is_named) -> Step:
    def step(p: Path) -> None:
        n = p[-1]
        if n.children and len(n.children) == 1:
            (replace_by_single_child if c([*p, n.children[0]]) else reduce_single_child)(p)

    return step


def replace_by_children(p: Path) -> None:
    """The node gives way to its children in its parent; at the root as ``replace_by_single_child``."""
    if len(p) < 2:
        replace_by_single_child(p)
    elif p[-1].children is not None:
        up, k = p[-2], next(i for i, c in enumerate(p[-2].children) if c is p[-1])
        up.result = up.children[:k] + p[-1].children + up.children[k + 1 :]


def swap_nested(p: Path) -> None:
    n = p[-1]
    if n.children and len(n.children) == 1:
        c = n.children[0]
        n.name, c.name, n.attrs, c.attrs = c.name, n.name, c.attrs, n.attrs


def change_name(name: str) -> Step:
    def step(p: Path) -> None:
        p[-1].name = name

    return step


def replace_child_names(names: dict[str, str]) -> Step:
    def step(p: Path) -> None:
        for c in p[-1].children or ():
            c.name = names.get(c.name, c.name)

    return step


def flatten(c: Condition = is_anonymous, recursive: bool = True) -> Step:
    """Children of matching branch children are lifted into the node."""

    def lifted(p: Path) -> list[Node]:
        out = []
        for child in p[-1].children:
            if child.children is not None and c([*p, child]):
                out += lifted([*p, child]) if recursive else child.children
                update_attr(p[-1], child)
            else:
                out.append(child)
        return out

    def step(p: Path) -> None:
        if p[-1].children:
            p[-1].result = lifted(p)

    return step


def collapse(p: Path) -> None:
    p[-1].result = p[-1].content


def merge_treetops(p: Path) -> None:
    n = p[-1]
    if n.children and all(c.anonymous and c.children is None for c in n.children):
        collapse(p)


def fuse_anonymous_leaves(nodes: list[Node]) -> list[Node]:
    """Neighbouring anonymous leaves become one, with the first one's name."""
    out: list[Node] = []
    for n in nodes:
        if out and n.anonymous and n.children is None and out[-1].anonymous and out[-1].children is None:
            out[-1] = Node(out[-1].name, out[-1].text + n.text, out[-1].attrs, out[-1].pos)
        else:
            out.append(n)
    return out


def fuse(nodes: list[Node], swallow: Condition = never) -> str | list[Node]:
    """The common result of several nodes: their texts joined if all are leaves, else their children strung together.

    Nodes for which ``swallow`` holds are taken as they are.
    """
    kept = [bool(swallow([n])) for n in nodes]
    if not any(kept) and all(n.children is None for n in nodes):
        return "".join(n.text for n in nodes)
    parts = [[n] if k else n.children if n.children is not None else [Node(":Text", n.text, pos=n.pos)] if n.text else [] for n, k in zip(nodes, kept, strict=True)]
    return fuse_anonymous_leaves([x for part in parts for x in part])


def merge_results(node: Node, nodes: list[Node]) -> bool:
    """Results of nodes that are all leaves, or all branches, merged into ``node``; False if they are mixed."""
    if len({n.children is None for n in nodes}) > 1:
        return False
    node.result = fuse(nodes)
    update_attr(node, *nodes)
    return True


def merge_leaves(p: Path) -> None:
    """Neighbouring anonymous leaves among the children become one."""
    if p[-1].children:
        p[-1].result = fuse_anonymous_leaves(p[-1].children)


def join_content(run: list[Node]) -> str:
    return "".join(n.content for n in run)


def pick_longest(run: list[Node]) -> str:
    return max((n.content for n in run), key=len)


def fix_content(text: str) -> Callable[[list[Node]], str]:
    return lambda run: text


def _runs(p: Path, c: Condition) -> Iterator[tuple[bool, list[Node]]]:
    """Stretches of children that match or do not."""
    held: list[Node] = []
    state = None
    for child in p[-1].children or ():
        now = bool(c([*p, child]))
        if now != state and held:
            yield bool(state), held
            held = []
        state = now
        held.append(child)
    if held:
        yield bool(state), held


def collapse_children_if(c: Condition, name: str, rule: Callable[[list[Node]], str] = join_content) -> Step:
    """Each run of matching children becomes one leaf."""

    def step(p: Path) -> None:
        if p[-1].children:
            p[-1].result = [x for hit, run in _runs(p, c) for x in ([Node(name, rule(run), pos=run[0].pos)] if hit else run)]

    return step


def merge_adjacent(c: Condition, preferred: str = "") -> Step:
    """Runs of two or more matching children are merged: texts joined, or children strung together."""

    def merged(run: list[Node]) -> Node:
        if len(run) == 1:
            return run[0]
        names = [n.name for n in run]
        name = preferred if preferred in names else names[0]
        whole = Node(name)
        update_attr(whole, *run)
        attrs = whole.attrs
        if all(n.children is None for n in run):
            return Node(name, join_content(run), attrs, run[0].pos)
        parts = [x for n in run for x in (n.children if n.children is not None else [Node(":Text", n.text, pos=n.pos)] if n.text else [])]
        return Node(name, parts, attrs, run[0].pos)

    def step(p: Path) -> None:
        if p[-1].children:
            p[-1].result = [x for hit, run in _runs(p, c) for x in ([merged(run)] if hit else run)]

    return step


def merge_connected(content: Condition, delimiter: Condition, content_name: str = "", delimiter_name: str = "") -> Step:
    """Runs of content children with delimiters in between are merged; delimiters at the edges of a run are merged apart."""

    def step(p: Path) -> None:
        if not p[-1].children:
            return
        out: list[Node] = []
        for hit, run in _runs(p, any_of(content, delimiter)):
            if not hit:
                out += run
                continue
            kind = [bool(content([*p, n])) for n in run]
            if True not in kind:
                out.append(Node(delimiter_name or run[0].name, join_content(run), pos=run[0].pos))
                continue
            a, b = kind.index(True), len(kind) - kind[::-1].index(True)
            for part, name in ((run[:a], delimiter_name), (run[a:b], content_name), (run[b:], delimiter_name)):
                if part:
                    out.append(Node(name or part[0].name, join_content(part), pos=part[0].pos) if len(part) > 1 or name else part[0])
        p[-1].result = out

    return step


def move_fringes(c: Condition, side: str = "both", merge: bool = True) -> Step:
    """Matching children at the node's edges move to its parent.

    With ``merge``, what has moved is merged with the neighbour in the parent that matches as well; leaves that are merged
    keep the name of the first.
    """

    def joined(nodes: list[Node], up: Path) -> list[Node]:
        out: list[Node] = []
        for n in nodes:
            if merge and out and c([*up, n]) and c([*up, out[-1]]) and merge_results(whole := Node(out[-1].name, pos=out[-1].pos), [out[-1], n]):
                out[-1] = whole
            else:
                out.append(n)
        return out

    def step(p: Path) -> None:
        n = p[-1]
        if len(p) < 2 or not n.children:
            return
        a, b = 0, len(n.children)
        while a < b and c([*p, n.children[a]]):
            a += 1
        while b > a and c([*p, n.children[b - 1]]):
            b -= 1
        a, b = a if side != "right" else 0, b if side != "left" else len(n.children)
        up = p[-2].children
        k = next(i for i, x in enumerate(up) if x is n)
        before, after = n.children[:a], n.children[b:]
        # only what stands next to the node can meet what has moved
        left = joined([*up[k - 1 : k], *before], p[:-1]) if before else up[max(0, k - 1) : k]
        right = joined([*after, *up[k + 1 : k + 2]], p[:-1]) if after else up[k + 1 : k + 2]
        n.result = n.children[a:b]
        p[-2].result = up[: max(0, k - 1)] + left + [n] + right + up[k + 2 :]

    return step


def pull_up(p: Path) -> None:
    """The node moves up one level: its parent is split around it, and the node's result is wrapped in a copy of the parent."""
    if len(p) < 3:
        return
    n, up, top = p[-1], p[-2], p[-3]
    k, at = next(i for i, x in enumerate(up.children) if x is n), next(i for i, x in enumerate(top.children) if x is up)
    parts = [Node(up.name, up.children[:k], dict(up.attrs), up.pos)] if k else []
    n.result = [Node(up.name, n.result, dict(up.attrs), n.pos)]
    parts.append(n)
    if up.children[k + 1 :]:
        parts.append(Node(up.name, up.children[k + 1 :], dict(up.attrs), up.children[k + 1].pos))
    top.result = top.children[:at] + parts + top.children[at + 1 :]


def left_associative(p: Path) -> None:
    """A flat list of operands and operators becomes a tree that leans to the left."""
    n = p[-1]
    if n.children and len(n.children) >= 5 and len(n.children) % 2:
        parts = list(n.children)
        while len(parts) > 3:
            parts[:3] = [Node(n.name, parts[:3], pos=parts[0].pos)]
        n.result = parts


def lean_left(*operators: str) -> Step:
    """A right-leaning chain (op1 a (op2 b c)) becomes (op2 (op1 a b) c), again in the new left node: attributes stay with their operator."""

    def step(p: Path) -> None:
        n = p[-1]
        while n.name in operators and n.children and len(n.children) == 2 and (right := n.children[1]).name in operators and right.children and len(right.children) == 2:
            left, (b, c) = n.children[0], right.children
            inner = Node(n.name, [left, b], n.attrs, left.pos)
            n.name, n.attrs = right.name, right.attrs
            n.result = [inner, c]
            n = inner

    return step


def _strip(left: bool, right: bool, c: Condition) -> Step:
    def step(p: Path) -> None:
        n = p[-1]
        while left and n.children and c([*p, n.children[0]]):
            n.result = n.children[1:]
        while right and n.children and c([*p, n.children[-1]]):
            n.result = n.children[:-1]
        if n.children and left:
            step_left([*p, n.children[0]]) if n.children[0].children else None
        if n.children and right:
            step_right([*p, n.children[-1]]) if n.children[-1].children else None

    step_left = step if not right else lambda p: _strip(True, False, c)(p)
    step_right = step if not left else lambda p: _strip(False, True, c)(p)
    return step


def lstrip(c: Condition = contains_only_whitespace) -> Step:
    return _strip(True, False, c)


def rstrip(c: Condition = contains_only_whitespace) -> Step:
    return _strip(False, True, c)


def strip(c: Condition = contains_only_whitespace) -> Step:
    return _strip(True, True, c)


def keep_children(section: slice) -> Step:
    def step(p: Path) -> None:
        if p[-1].children:
            p[-1].result = p[-1].children[section]

    return step


def keep_children_if(c: Condition) -> Step:
    def step(p: Path) -> None:
        if p[-1].children:
            p[-1].result = [x for x in p[-1].children if c([*p, x])]

    return step


def remove_children_if(c: Condition) -> Step:
    return keep_children_if(lambda p: not c(p))


def keep_nodes(*names: str) -> Step:
    return keep_children_if(is_a(*names))


def keep_tokens(*tokens: str) -> Step:
    return keep_children_if(is_token(*tokens))


def keep_content(rx: str) -> Step:
    return keep_children_if(content_matches(rx))


def remove_children(*names: str) -> Step:
    return remove_children_if(is_a(*names))


def remove_tokens(*tokens: str) -> Step:
    return remove_children_if(is_token(*tokens))


def remove_content(rx: str) -> Step:
    return remove_children_if(content_matches(rx))


def remove_brackets(p: Path) -> None:
    """Anonymous whitespace, literals and pattern matches at both ends go."""
    n = p[-1]
    if n.children:
        edge = (":Text", ":Whitespace", ":RegExp")
        a, b = 0, len(n.children)
        while a < b and n.children[a].name in edge:
            a += 1
        while b > a and n.children[b - 1].name in edge:
            b -= 1
        n.result = n.children[a:b]


def remove(p: Path) -> None:
    if len(p) > 1:
        p[-2].result = [x for x in p[-2].children if x is not p[-1]]


def remove_if(c: Condition) -> Step:
    return apply_if(remove, c)


def transform_result(f: Callable) -> Step:
    def step(p: Path) -> None:
        p[-1].result = f(p[-1].result)

    return step


def replace_content_with(text: str) -> Step:
    return transform_result(lambda _: text)


def normalize_whitespace(p: Path) -> None:
    if p[-1].children is None:
        p[-1].text = re.sub(r"\s+", " ", p[-1].text)


def add_attributes(attrs: dict[str, str]) -> Step:
    def step(p: Path) -> None:
        p[-1].attrs = p[-1].attrs | attrs

    return step


def del_attributes(*names: str) -> Step:
    def step(p: Path) -> None:
        p[-1].attrs = {k: v for k, v in p[-1].attrs.items() if names and k not in names}

    return step


def node_maker(name: str, result: str | Iterable[Callable[[], Node]] = "", attrs: dict[str, str] | None = None) -> Callable[[], Node]:
    """A function that makes a new node at each call; ``result`` is a text or other makers."""
    parts = result if isinstance(result, str) else tuple(result)
    return lambda: Node(name, parts if isinstance(parts, str) else [make() for make in parts], dict(attrs or {}))


def delimiter_positions(p: Path) -> range:
    """The places between all children."""
    return range(1, len(p[-1].children or ()))


def place_numbers(p: Path, position: int | Iterable[int] | Callable | None) -> list[int]:
    """Any form of a position as a list: a number, several, a function of the path that gives one of these, or None."""
    if callable(position):
        position = position(p)
    return [] if position is None else [position] if isinstance(position, int) else list(position)


def insert(position: int | Iterable[int] | Callable | None, make: Callable[[], Node]) -> Step:
    def step(p: Path) -> None:
        n = p[-1]
        parts = list(n.children or ([Node(":Text", n.text)] if n.text else []))
        places = [k if k >= 0 else len(parts) + k + 1 for k in place_numbers(p, position)]
        for k in sorted(set(places), reverse=True):
            parts.insert(k, make())
        n.result = parts

    return step


def delimit_children(make: Callable[[], Node]) -> Step:
    return insert(delimiter_positions, make)


def positions_of(*names: str) -> Callable[[Path], list[int]]:
    return lambda p: [k for k, c in enumerate(p[-1].children or ()) if c.name in names]


def drop_leaf(p: Path) -> None:
    """The leaf goes, and with it ancestors that are left empty."""
    for k in range(len(p) - 1, 0, -1):
        p[k - 1].result = [x for x in p[k - 1].children if x is not p[k]]
        if p[k - 1].children is not None:
            break


class Report:
    """Errors that steps record: (pos, code, message)."""

    def __init__(self):
        self.found: list[tuple[int, int, str]] = []


REPORT = Report()


def note(pos: int, code: int, message: str) -> None:
    """Records an error of the tree that is being rewritten. Steps call it by name, as a worker has one report."""
    REPORT.found.append((pos, code, message))


def add_error(message: str, code: int = 1000) -> Step:
    def step(p: Path) -> None:
        note(p[-1].pos or 0, code, message.format(name=p[-1].name, content=p[-1].content[:40]))

    return step


def error_on(c: Condition, message: str = "condition holds for {name}", code: int = 1000) -> Step:
    """An error where the condition is true."""
    return apply_if(add_error(message, code), c)


def assert_content(rx: str) -> Step:
    return error_on(neg(content_matches(rx)), f"content of {{name}} does not match {rx}")


def require(*names: str) -> Step:
    return error_on(lambda p: any(c.name not in names for c in p[-1].children or ()), f"{{name}} may only have {', '.join(names)}")


def forbid(*names: str) -> Step:
    return error_on(has_child(*names), f"{{name}} must not have {', '.join(names)}")


# -- tables


class Filter:
    """First among a node's steps, it says which of the children are visited. ``keeps`` is a function of a child."""

    def __init__(self, keeps: Callable[[Node], bool]):
        self.keeps = keeps


BLOCK_CHILDREN = Filter(lambda c: False)
BLOCK_LEAVES = Filter(lambda c: c.children is not None)
BLOCK_ANONYMOUS_LEAVES = Filter(lambda c: c.children is not None or not c.anonymous)


def node_name(n: Node) -> str:
    return n.name


def expand_table(table: dict) -> dict[str, list]:
    """A table with one name for each key and a list of steps for each name: keys are names, several with commas, or tuples.

    ``~`` stands for ``:Whitespace``. KeyError if a name is there twice.
    """
    out: dict[str, list] = {}
    for key, steps in table.items():
        for name in (x.strip() for x in (key.split(",") if isinstance(key, str) else key)):
            name = ":Whitespace" if name == "~" else name
            if name in out:
                raise KeyError(f"{name} is in the table twice")
            out[name] = list(steps) if isinstance(steps, (list, tuple)) else [steps]
    return out


def traverse(root: Node, table: dict[str, Step | list[Step]], key: Callable[[Node], str] = node_name) -> Node:
    """Post-order application. Keys: names (several with commas), ``*`` for others, ``<`` before and ``>`` after each node's own
    steps, ``<<<`` and ``>>>`` before and after everything. ``key`` gives a node's key. Filters stand before a key's steps."""
    by = expand_table(table)
    chosen: dict[str, tuple[list[Filter], list[Step]]] = {}

    def steps_of(name: str) -> tuple[list[Filter], list[Step]]:
        if name not in chosen:
            every = [*by.get("<", []), *by.get(name, by.get("*", [])), *by.get(">", [])]
            chosen[name] = [x for x in every if isinstance(x, Filter)], [x for x in every if not isinstance(x, Filter)]
        return chosen[name]

    run_steps([root], by.get("<<<", []))
    stack: list[tuple[Path, bool]] = [([root], False)]
    while stack:
        p, seen = stack.pop()
        filters, steps = steps_of(key(p[-1]))
        if not seen:
            stack.append((p, True))
            stack += [([*p, c], False) for c in reversed(p[-1].children or ()) if all(f.keeps(c) for f in filters)]
            continue
        if len(p) > 1 and not any(c is p[-1] for c in p[-2].children or ()):
            continue  # removed by a sibling's step
        run_steps(p, steps)
    run_steps([root], by.get(">>>", []))
    return root


def transformer(*tables: dict) -> Callable[[Node], Node]:
    """A function that applies tables one after another to a tree."""

    def run(root: Node) -> Node:
        for t in tables:
            traverse(root, t)
        return root

    return run


FAILED = 10600  # a step raised an exception: the tree is as it was left


def _rewritten(root: Node, tables: Iterable[dict]) -> list[dict]:
    """Applies the tables and returns the errors that were recorded, by place and code the first."""
    REPORT.found = []
    try:
        for t in tables:
            traverse(root, t)
    except Exception as e:  # a user's step: an error of its row, not of the job
        REPORT.found.append((0, FAILED, f"{type(e).__name__}: {e}"))
    first = {(p, c): m for p, c, m in reversed(REPORT.found)}
    return [{"pos": p, "length": 1, "code": c, "message": first[p, c]} for p, c in dict.fromkeys((p, c) for p, c, _ in REPORT.found)]


def rewrite(df: DataFrame, *tables: dict[str, Step | list[Step]], tree: str = "tree", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, the rewritten ``tree`` and ``rewrite_errors``: all tables in one kernel call, one encoding at the end."""
    keep = [c for c in (keep or df.columns) if c != tree]
    errors_type = T.ArrayType(ERROR_TYPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                part = batch.slice(a, 100)
                trees, errors = [], []
                for root in nodes_of(part.column(len(keep))):
                    errors.append([] if root is None else _rewritten(root, tables))
                    trees.append(root)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], tree_array(trees), pa.array(errors, to_arrow_type(errors_type))], [*keep, tree, "rewrite_errors"])

    some = df.select(*[F.col(f"`{c}`") for c in keep], tree)
    return some.mapInArrow(run, T.StructType([some.schema[c] for c in keep] + [T.StructField(tree, TREE_TYPE), T.StructField("rewrite_errors", errors_type)]))


def variants(df: DataFrame, tables: dict[str, dict | list[dict]], how: str = "sxpr", tree: str = "tree", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and, for each of several tables (or lists of them), the tree that it makes, written in a format of ``serde.WRITERS``.

    Each table gets a copy of the tree; all run in one kernel call. A table whose steps recorded errors gives their
    messages behind the text, parted by newlines.
    """
    keep = [c for c in (keep or df.columns) if c != tree]
    write = WRITERS[how]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = nodes_of(batch.column(len(keep)))
            columns = []
            for ts in tables.values():
                out = []
                for root in roots:
                    own = None if root is None else root.copy()
                    errors = [] if own is None else _rewritten(own, ts if isinstance(ts, list) else [ts])
                    out.append(None if own is None else "\n".join([write(own), *(e["message"] for e in errors)]))
                columns.append(pa.array(out, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], [*keep, *tables])

    some = df.select(*[F.col(f"`{c}`") for c in keep], tree)
    return some.mapInArrow(run, T.StructType([some.schema[c] for c in keep] + [T.StructField(n, T.StringType()) for n in tables]))


def evaluate(root: Node, actions: dict[str, Callable]) -> object:
    """A bottom-up fold: the action of a node's name (or ``*``) gets its children's values, or a leaf's text. KeyError without one."""
    values: list[list] = [[]]
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        n, seen = stack.pop()
        if n.children is not None and not seen:
            values.append([])
            stack.append((n, True))
            stack += [(c, False) for c in reversed(n.children)]
            continue
        arguments = [n.text] if n.children is None else values.pop()
        action = actions.get(n.name) or actions.get("*")
        if action is None:
            raise KeyError(n.name)
        values[-1].append(action(*arguments))
    return values[0][0]


def evaluated(df: DataFrame, actions: dict[str, Callable], returns: str = "double", tree: str = "tree", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``value`` of the fold and ``error`` if it failed."""
    keep = [c for c in (keep or df.columns) if c != tree]
    kind = T.StructType.fromDDL(f"value {returns}")["value"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, errors = [], []
            for root in nodes_of(batch.column(len(keep))):
                try:
                    values.append(None if root is None else evaluate(root, actions))
                    errors.append(None)
                except (KeyError, ValueError, TypeError, ArithmeticError) as e:
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(values, to_arrow_type(kind)), pa.array(errors, pa.string())], [*keep, "value", "error"])

    some = df.select(*[F.col(f"`{c}`") for c in keep], tree)
    return some.mapInArrow(run, T.StructType([some.schema[c] for c in keep] + [T.StructField("value", kind), T.StructField("error", T.StringType())]))
