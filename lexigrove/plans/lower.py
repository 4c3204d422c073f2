"""Lowers grammar parts without recursion to JVM regular expressions, with atomic groups and possessive repeats.

A PEG never takes back a finished part; atomic groups give exactly that. What cannot be shown to mean the same for the
JVM's matcher is refused, and the kernel takes it.
"""

from __future__ import annotations

import re

from . import ir
from .ir import Expr, Grammar

#: Escapes and groups that both dialects read alike, given the (?U) and (?s)-free flags used here.
REFUSED = re.compile(r"\(\?P|\(\?\(|\\[AZzGQEhHRXvVkNpP]|\\\d|\(\?[a-zA-Z-]*[aLuxU][a-zA-Z-]*[:)]|&&|\[[^\]]*\[")


class NotLowered(ValueError):
    pass


def pattern(g: Grammar, symbol: str) -> str:
    """The JVM pattern of a symbol, to be matched at a place; NotLowered with the reason if there is none."""
    recursive = {s for s in g.rules if s in ir.reachable_below(g, s)}
    sensitive = ir.context_sensitive(g)
    empty = ir.nullable(g)

    def terminal(rx: str) -> str:
        if REFUSED.search(rx):
            raise NotLowered(f"pattern {rx} may differ between the dialects")
        return f"(?>(?U:{rx}))" if re.search(r"\\[wWdDsSbB]", rx) else f"(?>{rx})"

    def lit(s: str, icase: bool = False) -> str:
        out = "".join(c if c.isalnum() and c.isascii() else f"\\x{{{ord(c):x}}}" for c in s)
        return f"(?iu:{out})" if icase else f"(?:{out})"

    def optional(e: Expr) -> bool:
        probe = Grammar(rules=g.rules | {"\0": e}, whitespace=g.whitespace, comment=g.comment)
        return "\0" in ir.nullable(probe) if empty is not None else False

    def low(e: Expr) -> str:
        p = e.parts
        match e.op:
            case "text":
                return lit(e.value)
            case "icase":
                return lit(e.value, True)
            case "regex":
                return terminal(e.value)
            case "ws":
                return terminal(g.ws_pattern()) if g.ws_pattern() else ""
            case "any":
                return r"(?s:.)"
            case "always":
                return ""
            case "never":
                return r"(?!)"
            case "ref":
                if e.value in recursive:
                    raise NotLowered(f"{e.value} is recursive")
                if e.value in sensitive:
                    raise NotLowered(f"{e.value} depends on captured values")
                return low(g.rules[e.value])
            case "seq":
                if e.mandatory is not None:
                    raise NotLowered("mandatory parts raise errors")
                return "".join(map(low, p))
            case "alt":
                return "(?>" + "|".join(map(low, p)) + ")"
            case "opt":
                return f"(?:{low(p[0])})?+"
            case "star" | "plus" | "count":
                if optional(p[0]):
                    raise NotLowered("repetition of what may be empty")
                times = {"star": "*+", "plus": "++"}.get(e.op) or ("{%d,%s}+" % (e.value[0], "" if e.value[1] >= 1 << 30 else e.value[1]))
                return f"(?:{low(p[0])}){times}"
            case "and":
                return f"(?={low(p[0])})"
            case "not":
                return f"(?!{low(p[0])})"
        raise NotLowered(f"{e.op} is not regular")

    if symbol in recursive or symbol in sensitive:
        raise NotLowered(f"{symbol} is recursive or depends on captured values")
    return low(g.rules[symbol])


def lowered(g: Grammar) -> dict[str, str]:
    """Patterns of all symbols that can be lowered."""
    out = {}
    for s in g.rules:
        try:
            out[s] = pattern(g, s)
        except NotLowered:
            pass
    return out


def group_pattern(g: Grammar, symbol: str, wanted: list[str]) -> str:
    """The pattern of a symbol in which each wanted symbol, occurring once and outside repetitions, is a numbered group in order of occurrence."""
    marked = dict(g.rules)
    order: list[str] = []

    def mark(e: Expr, inside: bool) -> Expr:
        if e.op == "ref":
            if e.value in wanted:
                if e.value in order or inside:
                    raise NotLowered(f"{e.value} occurs more than once")
                order.append(e.value)
                return Expr("group", (e,))
            if e.value in ir.reachable_below(g, e.value):
                raise NotLowered(f"{e.value} is recursive")
            return mark(g.rules[e.value], inside)
        return Expr(e.op, tuple(mark(p, inside or e.op in ("star", "plus", "count", "not", "and", "alt")) for p in e.parts), e.value, e.mandatory, e.drop)

    tree = mark(marked[symbol], False)
    if order != wanted:
        raise NotLowered(f"found {order}")

    def text(e: Expr) -> str:
        if e.op == "group":
            return f"({pattern(g, e.parts[0].value)})"
        if e.op == "seq" and e.mandatory is None:
            return "".join(map(text, e.parts))
        if any(p.op == "group" for p in _all(e)):
            if e.op == "opt":
                return f"(?:{text(e.parts[0])})?+"
            raise NotLowered(f"groups inside {e.op}")
        return pattern(Grammar(rules=g.rules | {"\0x": e}, whitespace=g.whitespace, comment=g.comment), "\0x")

    return text(tree)


def _all(e: Expr):
    yield e
    for p in e.parts:
        yield from _all(p)
