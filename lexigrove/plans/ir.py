"""The grammar plan: immutable expressions by symbol, with directives; picklable and broadcast to the kernels."""

from __future__ import annotations

from dataclasses import dataclass, field

ATOMS = ("text", "icase", "regex", "ws", "any", "always", "never", "err", "custom", "ref", "retrieve", "pop", "popopt")
GROUPS = ("seq", "alt", "inter", "opt", "star", "plus", "count", "and", "not", "behind", "nbehind", "capture")


@dataclass(frozen=True)
class Expr:
    """An operator with its parts. ``value``: literal, pattern, symbol, message or range; ``mandatory``: first part after §."""

    op: str
    parts: tuple[Expr, ...] = ()
    value: object = None
    mandatory: int | None = None
    drop: bool = False


@dataclass
class Grammar:
    rules: dict[str, Expr] = field(default_factory=dict)
    root: str = ""
    whitespace: str = ""
    comment: str = ""
    literalws: frozenset[str] = frozenset({"right"})
    ignorecase: bool = False
    disposable: frozenset[str] = frozenset()
    disposable_rx: str = ""
    hidden: frozenset[str] = frozenset()
    dropped: frozenset[str] = frozenset()  # symbols, and whitespace, strings, backticked, regexps
    reduction: int = 1  # 0 none, 1 flatten, 2 merge treetops, 3 merge leaves
    skip: dict[str, tuple[str, ...]] = field(default_factory=dict)
    resume: dict[str, tuple[str, ...]] = field(default_factory=dict)
    messages: dict[str, tuple[tuple[str, str], ...]] = field(default_factory=dict)
    filters: dict[str, str] = field(default_factory=dict)
    custom: dict[str, object] = field(default_factory=dict)
    errors: list[tuple[str, int, str]] = field(default_factory=list)  # symbol, code, message

    def ws_pattern(self) -> str:
        """Insignificant whitespace with comments in between."""
        if not self.comment:
            return self.whitespace
        return f"(?:{self.whitespace})(?:(?:{self.comment})(?:{self.whitespace}))*"

    def is_disposable(self, symbol: str) -> bool:
        import re

        return symbol in self.disposable or symbol in self.hidden or bool(self.disposable_rx and re.fullmatch(self.disposable_rx, symbol))


def references(e: Expr) -> set[str]:
    out, stack = set(), [e]
    while stack:
        x = stack.pop()
        if x.op in ("ref", "retrieve", "pop", "popopt"):
            out.add(x.value)
        stack += x.parts
    return out


def reachable(g: Grammar, start: str) -> set[str]:
    seen, stack = set(), [start]
    while stack:
        s = stack.pop()
        if s not in seen and s in g.rules:
            seen.add(s)
            stack += references(g.rules[s])
    return seen


def nullable(g: Grammar) -> set[str]:
    """Symbols that can match without consuming."""
    import re

    known: set[str] = set()

    def test(e: Expr) -> bool:
        if e.op in ("always", "opt", "star", "and", "not", "behind", "nbehind", "err", "ws", "popopt"):
            return True
        if e.op in ("text", "icase"):
            return not e.value
        if e.op == "regex":
            return re.match(e.value, "") is not None
        if e.op == "ref":
            return e.value in known
        if e.op in ("seq", "plus", "capture"):
            return all(map(test, e.parts))
        if e.op == "alt":
            return any(map(test, e.parts))
        if e.op in ("count", "inter"):
            low = [r[0] for r in e.value] if e.op == "inter" else [e.value[0]]
            return all(n == 0 or test(p) for n, p in zip(low, e.parts, strict=True))
        return e.op in ("retrieve", "pop")

    while True:
        new = {s for s, e in g.rules.items() if s not in known and test(e)}
        if not new:
            return known
        known |= new


def left_recursive(g: Grammar) -> set[str]:
    """Symbols that can reach themselves without consuming."""
    import re

    empty = nullable(g)

    def first(e: Expr) -> tuple[set[str], bool]:
        """Symbols at the left edge; whether the expression can be empty."""
        if e.op == "ref":
            return {e.value}, e.value in empty
        if e.op in ("alt", "inter"):
            got = [first(p) for p in e.parts]
            return set().union(*(s for s, _ in got)), any(x for _, x in got)
        if e.op in ("opt", "star", "and", "not", "behind", "nbehind"):
            return first(e.parts[0])[0], True
        if e.op in ("plus", "count", "capture"):
            s, x = first(e.parts[0])
            return s, x or (e.op == "count" and e.value[0] == 0)
        if e.op == "seq":
            out: set[str] = set()
            for p in e.parts:
                s, x = first(p)
                out |= s
                if not x:
                    return out, False
            return out, True
        if e.op == "regex":
            return set(), re.match(e.value, "") is not None
        return set(), e.op in ("always", "ws", "err", "popopt", "retrieve", "pop") or (e.op in ("text", "icase") and not e.value)

    edges = {s: first(e)[0] & set(g.rules) for s, e in g.rules.items()}
    out = set()
    for s in g.rules:
        seen, stack = set(), list(edges[s])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += edges[x]
        if s in seen:
            out.add(s)
    return out


def directly_recursive(g: Grammar) -> dict[str, int]:
    """Symbols ``a = a x | a y | z``, with how many alternatives begin with the symbol: they come first, and no other can reach it without consuming.

    Whatever may be empty counts as empty here.
    """
    import re

    known: set[str] = set()
    bare = re.compile(r"\(\?[=!<(]|\\[bBAZ]|(?<!\[)\^|\$")  # of no width, so that a match of "" says nothing

    def first(e: Expr) -> tuple[set[str], bool]:
        """Symbols that may stand at the left edge; whether the expression may be empty."""
        if e.op == "ref":
            return {e.value}, e.value in known
        if e.op in ("text", "icase"):
            return set(), not e.value
        if e.op == "regex":
            return set(), bool(bare.search(e.value)) or re.match(e.value, "") is not None
        if e.op in ("any", "never"):
            return set(), False
        got = [first(p) for p in e.parts]
        if e.op == "seq":
            n = next((k for k, (_, empty) in enumerate(got) if not empty), len(got))
            return set().union(*(s for s, _ in got[: n + 1])), n == len(got)
        empty = any(x for _, x in got) if e.op == "alt" else got[0][1] if e.op in ("plus", "capture") else True
        return set().union(*(s for s, _ in got)), empty

    while True:
        found = {s: first(e) for s, e in g.rules.items()}
        now = {s for s, (_, empty) in found.items() if empty}
        if now == known:
            break
        known = now
    edges = {s: x & set(g.rules) for s, (x, _) in found.items()}

    out = {}
    for s, e in g.rules.items():
        if e.op != "alt":
            continue
        begins = lambda p, s=s: p.op == "seq" and len(p.parts) > 1 and p.parts[0] == Expr("ref", value=s) and p.mandatory != 0
        n = next((k for k, p in enumerate(e.parts) if not begins(p)), len(e.parts))
        seen: set[str] = set()
        stack = [x for p in e.parts[n:] for x in first(p)[0] if x in edges]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += edges[x]
        if 0 < n < len(e.parts) and s not in seen:
            out[s] = n
    return out


def context_sensitive(g: Grammar) -> set[str]:
    """Symbols whose matching depends on captured values; they are not memoized."""
    captured = {s for e in g.rules.values() for s in _retrieved(e)}
    out = set(captured)
    out |= {s for s, e in g.rules.items() if _retrieved(e)}
    while True:
        new = {s for s, e in g.rules.items() if s not in out and references(e) & out}
        if not new:
            return out
        out |= new


def _retrieved(e: Expr) -> set[str]:
    out, stack = set(), [e]
    while stack:
        x = stack.pop()
        if x.op in ("retrieve", "pop", "popopt"):
            out.add(x.value)
        stack += x.parts
    return out


def analyze(g: Grammar) -> list[tuple[str, int, str]]:
    """Static errors: (symbol, code, message)."""
    out = []
    for s, e in g.rules.items():
        for r in sorted(references(e) - set(g.rules)):
            out.append((s, 1310, f"undefined symbol {r}"))
        stack = [e]
        empty = nullable(g)
        while stack:
            x = stack.pop()
            stack += x.parts
            if x.op in ("star", "opt", "plus") and x.parts[0].op in ("opt", "star"):
                out.append((s, 1510, f"{x.op} of an optional expression"))
            if x.op == "plus" and x.parts[0].op == "ref" and x.parts[0].value in empty:
                out.append((s, 1510, "repetition of what may be empty"))
            if x.op == "alt":
                for k, p in enumerate(x.parts[:-1]):
                    if p.op in ("opt", "star", "always") or (p.op == "text" and p.value == ""):
                        out.append((s, 1520, f"alternative {k + 1} always matches: later ones are never tried"))
                texts = [p.value for p in x.parts if p.op == "text"]
                for i, a in enumerate(texts):
                    for b in texts[i + 1 :]:
                        if b.startswith(a):
                            out.append((s, 1520, f"{a!r} comes before {b!r}, which it begins"))
            if x.op in ("seq", "inter") and x.mandatory is not None and x.mandatory >= len(x.parts):
                out.append((s, 1530, "nothing is mandatory"))
            if x.op == "count" and x.value[1] < x.value[0]:
                out.append((s, 1540, "empty range of repetitions"))
    for r in sorted(set(g.rules) - reachable(g, g.root)):
        out.append((r, 620, "symbol is not connected to the root"))
    return out


def to_ebnf(g: Grammar) -> str:
    """The plan as text in the notation that it is read from."""

    def show(e: Expr, inner: bool = True) -> str:
        quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
        p = e.parts
        match e.op:
            case "text":
                return "`" + e.value + "`" if "`" not in e.value else quote(e.value)
            case "icase":
                return quote(e.value)
            case "regex":
                return "/" + e.value.replace("/", "\\/") + "/"
            case "ws":
                return "~"
            case "any":
                return "."
            case "ref":
                return e.value
            case "retrieve" | "pop" | "popopt":
                return {"retrieve": ":", "pop": "::", "popopt": ":?"}[e.op] + e.value
            case "seq":
                out = " ".join(("§" if k == e.mandatory else "") + show(x) for k, x in enumerate(p))
                return f"({out})" if inner else out
            case "alt":
                out = " | ".join(map(show, p))
                return f"({out})" if inner else out
            case "inter":
                out = " ° ".join(show(x) + ("" if r == (1, 1) else f"{{{r[0]},{r[1]}}}") for x, r in zip(p, e.value, strict=True))
                return f"({out})" if inner else out
            case "opt":
                return f"[{show(p[0], False)}]"
            case "star":
                return f"{{{show(p[0], False)}}}"
            case "plus":
                return f"{{{show(p[0], False)}}}+"
            case "count":
                return f"{show(p[0])}{{{e.value[0]},{e.value[1]}}}"
            case "and" | "not" | "behind" | "nbehind":
                return {"and": "&", "not": "!", "behind": "<-&", "nbehind": "<-!"}[e.op] + show(p[0])
            case "capture":
                return show(p[0])
            case "custom":
                return f"@Custom({e.value})"
            case "err":
                return f'@Error({quote(str(e.value))})'
        return "``"

    return "\n".join(f"{s} = {show(e, False)}" for s, e in g.rules.items()) + "\n"


def reachable_below(g: Grammar, symbol: str) -> set[str]:
    """Symbols that the definition of a symbol refers to, directly or not; with itself only if it is recursive."""
    seen, stack = set(), list(references(g.rules[symbol])) if symbol in g.rules else []
    while stack:
        s = stack.pop()
        if s not in seen:
            seen.add(s)
            stack += references(g.rules[s]) if s in g.rules else []
    return seen
