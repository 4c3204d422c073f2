"""The parse kernel: memoizing recursive descent over a plan, with left recursion, captures and error recovery."""

from __future__ import annotations

import re
import sys
import threading
from collections.abc import Callable

from ..tree import ZOMBIE, Node
from . import ir
from .ir import Expr, Grammar

STOPPED, MANDATORY, RECURSION, NO_MATCH, LOOP = 1040, 1010, 10400, 1040, 1100
BRACKETS = str.maketrans("()[]{}<>", ")(][}{><")


class Abort(Exception):
    """A mandatory part is missing and no rule says where to go on."""

    def __init__(self, nodes: list[Node], pos: int):
        super().__init__()
        self.nodes, self.pos = nodes, pos


class State:
    __slots__ = ("text", "memo", "growing", "stacks", "log", "errors", "far", "far_symbol", "trace", "stack", "uses", "loose", "version")

    def __init__(self, text: str, trace: bool):
        self.text, self.memo, self.growing = text, {}, {}
        self.stacks, self.log, self.errors = {}, [], {}
        self.far, self.far_symbol = 0, ""
        self.trace, self.stack = [] if trace else None, ()  # steps; the open symbols and where they began
        # while seeds grow: which of them each open symbol has used, results that hold for seeds of one version only
        self.uses, self.loose, self.version = [], {}, 0

    def error(self, pos: int, code: int, message: str, length: int = 1) -> None:
        if self.trace is not None and (pos, code) not in self.errors:
            self.trace.append((str(code), pos, pos + length, "ERROR", False, (*self.stack, (str(code), pos))))
        self.errors.setdefault((pos, code), (pos, length, code, message))

    def note(self, status: str, symbol: str, pos: int, end: int, recalled: bool = False) -> None:
        self.trace.append((symbol, pos, end, status, recalled, self.stack))

    def undo(self, mark: int) -> None:
        while len(self.log) > mark:
            symbol, value = self.log.pop()
            if value is None:
                self.stacks[symbol].pop()
            else:
                self.stacks.setdefault(symbol, []).append(value)


Result = tuple[list[Node], int] | None  # nodes and where they end; None: no match


def without_mark(text: str) -> str:
    """The text without a byte order mark; offsets count from there."""
    return text[1:] if text[:1] in ("\ufeff", "\uffef") else text


class Parser:
    """A plan made ready to run: one function by expression. Made once in each worker.

    With ``trace``, steps are recorded as they end: each symbol and each nameless leaf, errors, and where reading resumes.
    """

    def __init__(self, grammar: Grammar, trace: bool = False):
        self.g, self.trace = grammar, trace
        self.recursive, self.sensitive = ir.left_recursive(grammar), ir.context_sensitive(grammar)
        self.direct = {} if trace else ir.directly_recursive(grammar)
        self.hides = {s for s in grammar.rules if grammar.is_disposable(s)}
        self.ws = re.compile(grammar.ws_pattern() or "")
        self.symbols: dict[str, Callable[[State, int], Result]] = {}
        for s in grammar.rules:
            self.symbols[s] = self.traced(s, self.symbol(s), s in grammar.dropped, True) if trace else self.symbol(s)
        self.bodies = {s: self.build(e, s) for s, e in grammar.rules.items()}

    @staticmethod
    def traced(name: str, run: Callable[[State, int], Result], drop: bool, symbol: bool) -> Callable[[State, int], Result]:
        """Notes how a run ends; the stack ends with the step itself."""

        def step(st: State, pos: int) -> Result:
            before, recalled = st.stack, symbol and (name, pos) in st.memo
            st.stack = *before, (name, pos)
            try:
                got = run(st, pos)
                st.note("FAIL" if got is None else "DROP" if drop else "MATCH", name, pos, pos if got is None else got[1], recalled)
            except Abort as stop:
                st.note("ABORT", name, pos, stop.pos)
                raise
            finally:
                st.stack = before
            return got

        return step

    # -- symbols

    def symbol(self, name: str) -> Callable[[State, int], Result]:
        g, key = self.g, name
        plain = name not in self.sensitive
        resume = [re.compile(p) for p in g.resume.get(name, ())]

        def body(st: State, pos: int, run: Callable[[State, int], Result] | None = None) -> Result:
            try:
                got = (run or self.bodies[name])(st, pos)
            except Abort as stop:
                to = self.reentry(st, stop.pos, resume) if resume else None
                if to is None:
                    stop.nodes = self.wrap(name, stop.nodes, pos)
                    raise
                if st.trace is not None:
                    st.note("RESUME", name, stop.pos, to)
                got = [*stop.nodes, *([Node(ZOMBIE, st.text[stop.pos : to], pos=stop.pos)] if to > stop.pos else [])], to
            if got is None:
                return None
            return self.wrap(name, got[0], pos), got[1]

        def tracked(st: State, pos: int, run: Callable[[State, int], Result]) -> Result:
            """Runs with seeds growing around: the result is kept for good if it used none of them, else for their versions."""
            at = (key, pos)
            if at in st.loose:
                got, used = st.loose[at]
                if all(u in st.growing and st.growing[u][1] == v for u, v in used.items()):
                    if st.uses:
                        st.uses[-1].update(used)
                    return got
            st.uses.append({})
            try:
                got = run(st, pos)
            finally:
                used = st.uses.pop()
                used.pop(at, None)
                if st.uses:
                    st.uses[-1].update(used)
            if used:
                st.loose[at] = got, used
            else:
                st.memo[at] = got
            return got

        def once(st: State, pos: int) -> Result:
            if not plain:
                return body(st, pos)
            at = (key, pos)
            if at in st.memo:
                return st.memo[at]
            if st.growing:
                return tracked(st, pos, body)
            got = st.memo[at] = body(st, pos)
            return got

        def rounds(st: State, pos: int) -> Result:
            """Seed and grow: the symbol's own result at this place is what the last round found."""
            at, best = (key, pos), None
            st.version += 1
            st.growing[at] = None, st.version
            try:
                while True:
                    got = body(st, pos)
                    if got is None or (best is not None and got[1] <= best[1]):
                        return best
                    best = got
                    st.version += 1
                    st.growing[at] = best, st.version
            finally:
                del st.growing[at]

        def grow(st: State, pos: int) -> Result:
            at = (key, pos)
            if at in st.growing:
                got, version = st.growing[at]
                if st.uses:
                    st.uses[-1][at] = version
                return got
            if not plain:
                return rounds(st, pos)
            if at in st.memo:
                return st.memo[at]
            return tracked(st, pos, rounds)

        if name in self.direct and plain:
            parts, n = [self.build(p, name) for p in g.rules[name].parts], self.direct[name]
            longer, others = parts[:n], parts[n:]

            def begin(st: State, pos: int) -> Result:
                for part in others:
                    got = part(st, pos)
                    if got is not None:
                        return got
                return None

            def lengthen(st: State, pos: int) -> Result:
                """Seed and grow without a seed to look up: the alternatives that begin with the symbol go on where it ended."""
                best = body(st, pos, begin)
                if best is not None and best[1] == pos:  # what goes on begins where the symbol does
                    return rounds(st, pos)
                got = best
                while got is not None:
                    best = got

                    def further(st: State, pos: int, best: Result = best) -> Result:
                        for part in longer:
                            got = part(st, pos, best)
                            if got is not None:
                                return got
                        return None

                    got = body(st, pos, further)
                    if got is not None and got[1] <= best[1]:
                        break
                return best

            def direct(st: State, pos: int) -> Result:
                at = (key, pos)
                if st.growing:  # of this symbol, if it was empty here, or of others
                    return grow(st, pos) if at in st.growing else st.memo[at] if at in st.memo else tracked(st, pos, lengthen)
                if at in st.memo:
                    return st.memo[at]
                got = st.memo[at] = lengthen(st, pos)
                return got

            return direct
        return grow if name in self.recursive else once

    def wrap(self, name: str, nodes: list[Node], pos: int) -> list[Node]:
        """The node of a symbol from what its expression gave."""
        g = self.g
        if name in g.dropped:
            return []
        nodes = self.reduce(nodes)
        if name in self.hides:
            if g.reduction:
                return nodes
            return [Node(":" + name, nodes or "", pos=pos)]
        if len(nodes) == 1 and nodes[0].anonymous:
            only = nodes[0]
            return [Node(name, only.result, dict(only.attrs), pos)]
        return [Node(name, nodes or "", pos=pos)]

    def reduce(self, nodes: list[Node]) -> list[Node]:
        level = self.g.reduction
        if level == 0:
            return nodes
        nodes = [n for n in nodes if n.text != "" or not n.anonymous]
        if level >= 2 and len(nodes) > 1 and all(n.children is None and n.anonymous for n in nodes):
            return [Node(":Text", "".join(n.text for n in nodes), pos=nodes[0].pos)]
        if level >= 3:
            out: list[Node] = []
            for n in nodes:
                if out and n.children is None and n.anonymous and out[-1].children is None and out[-1].anonymous and out[-1].name != ZOMBIE:
                    out[-1] = Node(out[-1].name if out[-1].name == n.name else ":Text", out[-1].text + n.text, pos=out[-1].pos)
                else:
                    out.append(n)
            return out
        return nodes

    @staticmethod
    def reentry(st: State, pos: int, rules: list[re.Pattern]) -> int | None:
        found = [m.end() if m.lastindex else m.start() for r in rules if (m := r.search(st.text, pos))]
        return min(found) if found else None

    # -- expressions

    def build(self, e: Expr, symbol: str) -> Callable[[State, int], Result]:
        return getattr(self, "_" + e.op.replace("and", "ahead").replace("not", "ahead"))(e, symbol)

    def miss(self, st: State, pos: int, symbol: str) -> None:
        if pos > st.far:
            st.far, st.far_symbol = pos, symbol

    def leaf(self, e: Expr, symbol: str, name: str, end: Callable[[str, int], int]) -> Callable[[State, int], Result]:
        drop = e.drop

        def run(st: State, pos: int) -> Result:
            to = end(st.text, pos)
            if to < 0:
                self.miss(st, pos, symbol)
                return None
            return ([] if drop else [Node(name, st.text[pos:to], pos=pos)]), to

        # a leaf that is all of a symbol is that symbol's step
        return self.traced(name, run, drop, False) if self.trace and self.g.rules.get(symbol) is not e else run

    def _text(self, e: Expr, symbol: str):
        t = e.value
        return self.leaf(e, symbol, ":Text", lambda s, p: p + len(t) if s.startswith(t, p) else -1)

    def _icase(self, e: Expr, symbol: str):
        rx = re.compile(re.escape(e.value), re.I)
        return self.leaf(e, symbol, ":IgnoreCase", lambda s, p: m.end() if (m := rx.match(s, p)) else -1)

    def _regex(self, e: Expr, symbol: str):
        rx = re.compile(e.value)
        return self.leaf(e, symbol, ":RegExp", lambda s, p: m.end() if (m := rx.match(s, p)) else -1)

    def _ws(self, e: Expr, symbol: str):
        rx, drop = self.ws, e.drop

        def run(st: State, pos: int) -> Result:
            m = rx.match(st.text, pos)
            to = m.end() if m else pos
            return ([] if drop or to == pos else [Node(":Whitespace", st.text[pos:to], pos=pos)]), to

        return run

    def _any(self, e: Expr, symbol: str):
        return self.leaf(e, symbol, ":AnyChar", lambda s, p: p + 1 if p < len(s) else -1)

    def _always(self, e: Expr, symbol: str):
        return lambda st, pos: ([], pos)

    def _never(self, e: Expr, symbol: str):
        return lambda st, pos: None

    def _err(self, e: Expr, symbol: str):
        code, _, message = e.value.partition(":")
        known = code.isdigit()

        def run(st: State, pos: int) -> Result:
            st.error(pos, int(code) if known else 1000, message if known else e.value)
            return [], pos

        return run

    def _custom(self, e: Expr, symbol: str):
        """A user function (text, pos) -> end of the match, or -1."""
        f = self.g.custom.get(e.value)
        if f is None:
            raise KeyError(f"no custom parser {e.value}")
        return self.leaf(e, symbol, ":" + str(e.value), f)

    def _ref(self, e: Expr, symbol: str):
        name = e.value
        return lambda st, pos: self.symbols[name](st, pos)

    def _seq(self, e: Expr, symbol: str):
        parts, mandatory = [self.build(p, symbol) for p in e.parts], e.mandatory
        skip = [re.compile(p) for p in self.g.skip.get(symbol, ())]
        said = [(re.compile(p), m) for p, m in self.g.messages.get(symbol, ())]
        expected = [ir.to_ebnf(Grammar(rules={"x": p})).partition("=")[2].strip() for p in e.parts]

        def run(st: State, pos: int, seed: Result = None) -> Result:
            """With a seed, the first part is known: what it gave, and where it ended."""
            mark, out, at = len(st.log), [], pos
            if seed is not None:
                out, at = [*seed[0]], seed[1]
            for k in range(seed is not None, len(parts)):
                try:
                    got = parts[k](st, at)
                except Abort as stop:
                    stop.nodes = out + stop.nodes
                    raise
                if got is None:
                    if mandatory is None or k < mandatory:
                        st.undo(mark)
                        return None
                    found = st.text[at : at + 10]
                    message = next((m for r, m in said if r.match(st.text, at)), "{1} expected, {0!r} found")
                    st.error(at, MANDATORY, message.format(found, expected[k]))
                    to = self.reentry(st, at, skip) if skip else None
                    if to is None:
                        raise Abort(out, at)
                    if to > at:
                        out.append(Node(ZOMBIE, st.text[at:to], pos=at))
                    at = to
                    continue
                out += got[0]
                at = got[1]
            return out, at

        return run

    def _alt(self, e: Expr, symbol: str):
        parts = [self.build(p, symbol) for p in e.parts]

        def run(st: State, pos: int) -> Result:
            for part in parts:
                got = part(st, pos)
                if got is not None:
                    return got
            return None

        return run

    def _opt(self, e: Expr, symbol: str):
        part = self.build(e.parts[0], symbol)
        return lambda st, pos: part(st, pos) or ([], pos)

    def _times(self, part, low: int, high: int, symbol: str):
        def run(st: State, pos: int) -> Result:
            mark, out, at, n = len(st.log), [], pos, 0
            while n < high:
                try:
                    got = part(st, at)
                except Abort as stop:
                    stop.nodes = out + stop.nodes
                    raise
                if got is None:
                    break
                n += 1
                if got[1] == at:  # no progress: more rounds would match as well
                    if n <= 1:
                        out += got[0]
                    n = max(n, low)
                    break
                out += got[0]
                at = got[1]
            if n < low:
                st.undo(mark)
                return None
            return out, at

        return run

    def _star(self, e: Expr, symbol: str):
        return self._times(self.build(e.parts[0], symbol), 0, 1 << 60, symbol)

    def _plus(self, e: Expr, symbol: str):
        return self._times(self.build(e.parts[0], symbol), 1, 1 << 60, symbol)

    def _count(self, e: Expr, symbol: str):
        return self._times(self.build(e.parts[0], symbol), *e.value, symbol)

    def _inter(self, e: Expr, symbol: str):
        parts, ranges, mandatory = [self.build(p, symbol) for p in e.parts], e.value, e.mandatory

        def run(st: State, pos: int) -> Result:
            mark, out, at, counts = len(st.log), [], pos, [0] * len(parts)
            def next_part(part: Callable[[State, int], Result]) -> Result:
                try:
                    return part(st, at)
                except Abort as stop:
                    stop.nodes = out + stop.nodes
                    raise

            while True:
                for k, part in enumerate(parts):
                    if counts[k] < ranges[k][1] and (got := next_part(part)) is not None and (got[1] > at or counts[k] < ranges[k][0]):
                        counts[k] += 1
                        out += got[0]
                        at = got[1]
                        break
                else:
                    break
            missing = [k for k, r in enumerate(ranges) if counts[k] < r[0]]
            if not missing:
                return out, at
            if mandatory is not None and all(k >= mandatory for k in missing) and at > pos:
                st.error(at, MANDATORY, f"{ir.to_ebnf(Grammar(rules={'x': e.parts[missing[0]]})).partition('=')[2].strip()} expected")
                raise Abort(out, at)
            st.undo(mark)
            return None

        return run

    def _ahead(self, e: Expr, symbol: str):
        part, wanted = self.build(e.parts[0], symbol), e.op == "and"

        def run(st: State, pos: int) -> Result:
            mark, far, errors = len(st.log), (st.far, st.far_symbol), dict(st.errors)
            try:
                got = part(st, pos)
            except Abort:
                got = None
            st.undo(mark)
            st.errors = errors
            if not wanted:
                st.far, st.far_symbol = far
            if (got is not None) == wanted:
                return [], pos
            self.miss(st, pos, symbol)
            return None

        return run

    def _behind(self, e: Expr, symbol: str):
        e_inner, wanted = e.parts[0], e.op == "behind"
        if e_inner.op == "seq" and e_inner.value == "literal":
            e_inner = next(p for p in e_inner.parts if p.op in ("text", "icase"))
        if e_inner.op == "ref":
            e_inner = self.g.rules[e_inner.value]
        if e_inner.op not in ("text", "icase", "regex"):
            raise ValueError("lookbehind takes a literal or a pattern")
        rx = re.compile(f"(?:{e_inner.value if e_inner.op == 'regex' else re.escape(e_inner.value)})\\Z", re.I if e_inner.op == "icase" else 0)
        size = None if e_inner.op == "regex" else len(e_inner.value)

        def run(st: State, pos: int) -> Result:
            # a match that ends at pos may begin anywhere before; a literal's length is known
            found = (rx.search(st.text, 0, pos) if size is None else pos >= size and rx.match(st.text, pos - size, pos)) not in (None, False)
            return ([], pos) if found == wanted else None

        return run

    _nbehind = _behind

    def _capture(self, e: Expr, symbol: str):
        part = self.build(e.parts[0], symbol)

        def run(st: State, pos: int) -> Result:
            got = part(st, pos)
            if got is not None:
                st.stacks.setdefault(e.value, []).append(st.text[pos : got[1]])
                st.log.append((e.value, None))
            return got

        return run

    def _retrieved(self, e: Expr, symbol: str, take: bool, optional: bool):
        name, mirror = e.value, self.g.filters.get(e.value) == "matching_bracket"

        def run(st: State, pos: int) -> Result:
            stack = st.stacks.get(name) or []
            if not stack:
                return ([], pos) if optional else None
            value = stack[-1][::-1].translate(BRACKETS) if mirror else stack[-1]
            if not st.text.startswith(value, pos):
                if optional:
                    return [], pos
                self.miss(st, pos, symbol)
                return None
            if take:
                st.log.append((name, stack.pop()))
            return ([] if name in self.g.dropped else [Node(":" + name if self.g.is_disposable(name) else name, value, pos=pos)]), pos + len(value)

        return run

    def _retrieve(self, e: Expr, symbol: str):
        return self._retrieved(e, symbol, False, False)

    def _pop(self, e: Expr, symbol: str):
        return self._retrieved(e, symbol, True, False)

    def _popopt(self, e: Expr, symbol: str):
        return self._retrieved(e, symbol, True, True)

    # -- texts

    @staticmethod
    def with_rest(root: Node, text: str, at: int) -> Node:
        """The tree with what follows in the text in a node of its own."""
        if at >= len(text):
            return root
        parts = root.children if root.children is not None else [Node(":Text", root.text, pos=root.pos)] if root.text else []
        return Node(root.name, [*parts, Node(ZOMBIE, text[at:], pos=at)], root.attrs, root.pos)

    def parse(self, text: str, start: str | None = None, complete: bool = True) -> tuple[Node, list[tuple[int, int, int, str]], list]:
        """(tree, errors by position, steps). The whole text is in the tree: what was not parsed is in ZOMBIE__ nodes."""
        text = without_mark(text)
        start = start or self.g.root
        st = State(text, self.trace)
        try:
            got = self.symbols[start](st, 0)
        except Abort as stop:
            top = stop.nodes[0] if len(stop.nodes) == 1 and stop.nodes[0].name == start else Node(start, stop.nodes, pos=0)
            got = [self.with_rest(top, text, stop.pos)], len(text)
        except RecursionError:
            st.error(0, RECURSION, "nested too deeply", len(text))
            got = [Node(ZOMBIE, text, pos=0)], len(text)
        if got is None:
            st.error(st.far, NO_MATCH, f"{start} does not match; {st.far_symbol or start} fails at {text[st.far : st.far + 10]!r}", max(1, len(text) - st.far))
            nodes, end = [Node(ZOMBIE, text, pos=0)], len(text)
            root = Node(start, nodes if text else "", pos=0)
        else:
            nodes, end = got
            root = nodes[0] if len(nodes) == 1 and not nodes[0].anonymous else Node(start, nodes or "", pos=0)
        if complete and end < len(text):
            at = max(end, st.far)
            st.error(at, STOPPED, f"stopped before the end; {st.far_symbol or start} fails at {text[at : at + 10]!r}", len(text) - at)
            root = self.with_rest(root, text, end)
        return root, [st.errors[k] for k in sorted(st.errors)], st.trace or []


def deep(run: Callable[[], object], megabytes: int = 256, frames: int = 60_000) -> object:
    """Runs a function in a thread with a large stack, for deeply nested texts."""
    out: list = []
    before = sys.getrecursionlimit()

    def inside() -> None:
        sys.setrecursionlimit(frames)
        try:
            out.append((True, run()))
        except BaseException as e:  # handed on to the caller
            out.append((False, e))

    threading.stack_size(megabytes << 20)
    thread = threading.Thread(target=inside)
    thread.start()
    thread.join()
    threading.stack_size(0)
    sys.setrecursionlimit(before)
    ok, value = out[0]
    if not ok:
        raise value
    return value
