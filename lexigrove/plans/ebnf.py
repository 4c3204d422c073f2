"""Reads grammars in an EBNF-style notation into plans.

    name = expr            definition (also := and ::=); HIDE:name, DROP:name, ``-> HIDE``, ``-> DROP``
    a b   a | b   a ° b    sequence, ordered choice, any order        §   the rest of a sequence is mandatory
    [a] a?  {a} a*  {a}+ a+  a{n,m} a{n} n*a a*n                      repetitions
    &a !a <-&a <-!a        lookahead and lookbehind                   a - b   a, but not where b matches
    "x" 'x'                literal with insignificant whitespace      `x`     literal as it is
    /rx/  ~  .  0x41  [0x41-0x5A]                                     pattern, whitespace, characters
    :a ::a :?a             the value captured last: keep, take, take or nothing
    $m($x) = expr, $m(a)   macros                                     @Custom(f), @Error("msg")
    @ directive = values
"""

from __future__ import annotations

import re

from . import ir
from .ir import Expr, Grammar

TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
  | (?P<name>[A-Za-z_][\w-]*(?<!-))
  | (?P<macro>\$[A-Za-z_]\w*)
  | (?P<text>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|’[^’]*’)
  | (?P<plain>`(?:\\.|[^`\\])*`|´[^´]*´)
  | (?P<regex>/(?:\\.|[^/\\])*/)
  | (?P<range>\[\s*(?:0x[0-9A-Fa-f]+(?:\s*-\s*0x[0-9A-Fa-f]+)?\s*)+\])
  | (?P<code>0x[0-9A-Fa-f]+)
  | (?P<number>\d+)
  | (?P<sign>::?=|<-&|<-!|->|::|:\?|[=|()\[\]{}§°&!~.?*+,:;@-])""",
    re.X,
)
WHITESPACE = {"horizontal": r"[ \t]*", "linefeed": r"[ \t]*\n?(?!\s*\n)[ \t]*", "vertical": r"\s*", "none": ""}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


UNHEEDED = 1590
WITHOUT_EFFECT = {
    "optimizations": "what becomes a regular expression is decided by where the grammar is used",
    "lowering": "what becomes a regular expression is decided by where the grammar is used",
    "flavor": "the notation is not switched, signs of the others are read as far as they are clear",
    "tokens": "names of a preprocessor's tokens are not checked",
}


class GrammarError(ValueError):
    def __init__(self, errors: list[tuple[str, int, str]]):
        super().__init__("; ".join(f"{s}: {m} ({c})" for s, c, m in errors))
        self.errors = errors


def _unquote(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), s[1:-1], flags=re.S)


class Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise GrammarError([("", 1000, f"cannot read {text[at : at + 20]!r}")])
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0], m.start(), m.end()))
            at = m.end()
        self.tokens.append(("end", "", len(text), len(text)))
        self.k, self.g, self.macros, self.bound = 0, Grammar(), {}, {}

    def look(self, n: int = 0) -> str:
        return self.tokens[min(self.k + n, len(self.tokens) - 1)][1]

    def kind(self, n: int = 0) -> str:
        return self.tokens[min(self.k + n, len(self.tokens) - 1)][0]

    def take(self, sign: str | None = None) -> str:
        if sign is not None and self.look() != sign:
            raise GrammarError([("", 1000, f"expected {sign!r}, found {self.look()!r}")])
        self.k += 1
        return self.tokens[self.k - 1][1]

    def begins(self) -> bool:
        """Whether a definition, a directive or the end is next."""
        if self.kind() == "end":
            return True
        if self.look() == "@":
            return not (self.kind(1) == "name" and self.look(2) == "(")
        if self.kind() == "name":
            if self.look() in ("HIDE", "DROP") and self.look(1) == ":":
                return True
            return self.look(1) in ("=", ":=", "::=")
        if self.kind() == "macro" and self.look(1) == "(":
            depth, n = 0, 1
            while self.kind(n) != "end":
                depth += {"(": 1, ")": -1}.get(self.look(n), 0)
                if not depth:
                    return self.look(n + 1) in ("=", ":=", "::=")
                n += 1
        return self.kind() == "macro" and self.look(1) in ("=", ":=", "::=")

    def grammar(self) -> Grammar:
        bodies: list[tuple[str, int]] = []
        while self.kind() != "end":
            if self.look() == "@":
                self.directive()
                continue
            if not self.begins():
                raise GrammarError([("", 1000, f"expected a definition, found {self.look()!r}")])
            mark = ""
            if self.look() in ("HIDE", "DROP") and self.look(1) == ":":
                mark = self.take()
                self.take(":")
            name, parameters = self.take(), []
            macro = name.startswith("$")
            if macro and self.look() == "(":
                self.take()
                while self.look() != ")":
                    parameters.append(self.take())
                    if self.look() == ",":
                        self.take()
                self.take(")")
            self.take()
            start = self.k
            while not self.begins():
                if self.look() == "->":
                    self.take()
                    mark = self.take().upper()
                else:
                    self.k += 1
            if macro:
                self.macros[name] = (parameters, start)
                continue
            if name in dict(bodies):
                self.g.errors.append((name, 1320, "symbol is defined twice"))
            bodies.append((name, start))
            if mark:
                self.g.hidden |= {name}
            if mark == "DROP":
                self.g.dropped |= {name}
        # directives hold for all definitions, so these are read afterwards
        for name, start in bodies:
            self.k = start
            self.g.rules[name] = self.choice()
            if self.look() != "->" and not self.begins():
                raise GrammarError([(name, 1000, f"unexpected {self.look()!r}")])
        self.g.root = bodies[0][0] if bodies else ""
        captured = {s for e in self.g.rules.values() for s in ir._retrieved(e)}
        for s in captured & set(self.g.rules):
            self.g.rules[s] = Expr("capture", (self.g.rules[s],), s)
        self.g.errors += ir.analyze(self.g)
        return self.g

    def directive(self) -> None:
        self.take("@")
        name = self.take()
        self.take()
        values = []
        while True:
            values.append((self.kind(), self.take()))
            while self.look() == "-" and self.kind(1) == "name":  # never part of a value here
                break
            if self.look() != ",":
                break
            self.take()
        g, words = self.g, [v for k, v in values if k == "name"]

        def pattern(k: str, v: str) -> str:
            return v[1:-1].replace("\\/", "/") if k == "regex" else re.escape(_unquote(v)) if k in ("text", "plain") else v

        patterns = [pattern(k, v) for k, v in values]
        match name.lower():
            case "whitespace":
                g.whitespace = WHITESPACE.get(patterns[0].lower(), patterns[0])
            case "comment":
                g.comment = patterns[0]
            case "literalws":
                g.literalws = frozenset({"left", "right"} if "both" in words else set(words) - {"none"})
            case "ignorecase":
                g.ignorecase = patterns[0].lower() in ("true", "yes", "on")
            case "disposable" | "anonymous" | "hide":
                g.disposable |= frozenset(words)
                g.disposable_rx = "|".join([*([g.disposable_rx] if g.disposable_rx else []), *(p for (k, _), p in zip(values, patterns, strict=True) if k == "regex")])
            case "drop":
                g.dropped |= frozenset(words)
            case "reduction":
                g.reduction = {"none": 0, "flatten": 1, "merge_treetops": 2, "merge": 3, "merge_leaves": 3}.get(words[0].lower() if words else "", 1)
            case _ if name.endswith(("_skip", "_resume", "_error", "_filter")):
                symbol, _, what = name.rpartition("_")
                if what == "error":
                    rules = [(pattern(*v) if v[0] == "regex" else "", "") for v in values[:-1]] or [("", "")]
                    message = _unquote(values[-1][1])
                    g.messages[symbol] = g.messages.get(symbol, ()) + ((rules[0][0], message),)
                elif what == "filter":
                    g.filters[symbol] = words[0]
                else:
                    {"skip": g.skip, "resume": g.resume}[what][symbol] = tuple(patterns)
            case "include":
                g.errors.append(("", 1050, "includes are resolved before the grammar is read"))
            case "optimizations" | "flavor" | "tokens" | "lowering" as known:
                g.errors.append(("", UNHEEDED, f"directive {known}: {WITHOUT_EFFECT[known]}"))
            case _:
                g.errors.append(("", 1350, f"unknown directive {name}"))

    def choice(self) -> Expr:
        parts = [self.sequence()]
        while self.look() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else Expr("alt", tuple(parts))

    def sequence(self) -> Expr:
        parts, mandatory = [], None
        while self.look() not in ("|", ")", "]", "}", "->", ",", ";") and not self.begins():
            if self.look() == "§":
                self.take()
                mandatory = len(parts) if mandatory is None else mandatory
                continue
            parts.append(self.interleave())
        if not parts:
            return Expr("always")
        return parts[0] if len(parts) == 1 and mandatory is None else Expr("seq", tuple(parts), mandatory=mandatory)

    def interleave(self) -> Expr:
        parts, mandatory = [self.difference()], None
        while self.look() == "°":
            self.take()
            if self.look() == "§":
                self.take()
                mandatory = len(parts) if mandatory is None else mandatory
            parts.append(self.difference())
        if len(parts) == 1:
            return parts[0]
        ranges, inner = [], []
        for p in parts:
            low_high = {"opt": (0, 1), "star": (0, 1 << 30), "plus": (1, 1 << 30)}.get(p.op) or (p.value if p.op == "count" else (1, 1))
            ranges.append(low_high)
            inner.append(p.parts[0] if p.op in ("opt", "star", "plus", "count") else p)
        return Expr("inter", tuple(inner), tuple(ranges), mandatory)

    def difference(self) -> Expr:
        e = self.lookaround()
        while self.look() == "-":
            self.take()
            e = Expr("seq", (Expr("not", (self.lookaround(),)), e))
        return e

    def lookaround(self) -> Expr:
        op = {"&": "and", "!": "not", "<-&": "behind", "<-!": "nbehind"}.get(self.look())
        if op:
            self.take()
            return Expr(op, (self.lookaround(),))
        return self.postfix()

    def postfix(self) -> Expr:
        if self.kind() == "number" and self.look(1) == "*":
            n = int(self.take())
            self.take()
            return Expr("count", (self.postfix(),), (n, n))
        e = self.atom()
        while True:
            if self.look() == "?":
                e = Expr("opt", (e,))
            elif self.look() == "*" and self.kind(1) == "number":
                self.take()
                e = Expr("count", (e,), (int(self.look()), int(self.look())))
            elif self.look() == "*":
                e = Expr("star", (e,))
            elif self.look() == "+":
                e = Expr("plus", (e.parts[0],) if e.op == "star" else (e,))
            elif self.look() == "{" and self.kind(1) == "number" and self.look(2) in (",", "}"):
                self.take()
                low = int(self.take())
                high = low
                if self.look() == ",":
                    self.take()
                    high = int(self.take()) if self.kind() == "number" else 1 << 30
                e = Expr("count", (e,), (low, high))
            else:
                return e
            self.take()

    def literal(self, text: str) -> Expr:
        g = self.g
        drop = "strings" in g.dropped
        e = Expr("icase" if g.ignorecase else "text", value=text, drop=drop)
        ws = Expr("ws", drop="whitespace" in g.dropped)
        parts = [*([ws] if "left" in g.literalws else []), e, *([ws] if "right" in g.literalws else [])]
        return e if len(parts) == 1 or not g.ws_pattern() else Expr("seq", tuple(parts), "literal")

    def atom(self) -> Expr:
        kind, g = self.kind(), self.g
        token = self.take()
        if kind == "text":
            return self.literal(_unquote(token))
        if kind == "plain":
            return Expr("icase" if g.ignorecase else "text", value=_unquote(token), drop="backticked" in g.dropped)
        if kind == "regex":
            rx = token[1:-1].replace("\\/", "/")
            rx = re.sub(r"\s+", "", rx) if "\n" in rx else rx
            try:
                re.compile(rx)
            except re.error as e:
                g.errors.append(("", 1330, f"bad pattern {rx}: {e}"))
                return Expr("never")
            return Expr("regex", value=f"(?i:{rx})" if g.ignorecase else rx, drop="regexps" in g.dropped)
        if kind == "range":
            spans = re.findall(r"0x([0-9A-Fa-f]+)(?:\s*-\s*0x([0-9A-Fa-f]+))?", token)
            return Expr("regex", value="[" + "".join(re.escape(chr(int(a, 16))) + ("-" + re.escape(chr(int(b, 16))) if b else "") for a, b in spans) + "]")
        if kind == "code":
            return Expr("text", value=chr(int(token, 16)))
        if kind == "name":
            return Expr("ref", value=token)
        if kind == "macro":
            return self.macro(token)
        if token in ("(", "[", "{"):
            e = self.choice()
            self.take({"(": ")", "[": "]", "{": "}"}[token])
            return e if token == "(" else Expr("opt" if token == "[" else "star", (e,))
        if token == "~":
            return Expr("ws", drop="whitespace" in g.dropped)
        if token == ".":
            return Expr("any")
        if token in (":", "::", ":?"):
            return Expr({":": "retrieve", "::": "pop", ":?": "popopt"}[token], value=self.take())
        if token == "@":
            name = self.take()
            self.take("(")
            argument = self.take() if self.look() != ")" else ""
            self.take(")")
            if name == "Error":
                return Expr("err", value=_unquote(argument))
            return Expr("custom", value=argument or name)
        raise GrammarError([("", 1000, f"unexpected {token!r}")])

    def macro(self, name: str) -> Expr:
        if name in self.bound:
            return self.bound[name]
        if name not in self.macros:
            raise GrammarError([("", 1340, f"undefined macro {name}")])
        parameters, start = self.macros[name]
        arguments = []
        if self.look() == "(":
            self.take()
            while self.look() != ")":
                arguments.append(self.choice())
                if self.look() == ",":
                    self.take()
            self.take(")")
        if len(arguments) != len(parameters):
            raise GrammarError([("", 1341, f"macro {name} takes {len(parameters)} arguments")])
        back, outer = self.k, self.bound
        if len(outer) > 200:
            raise GrammarError([("", 1342, f"macro {name} is recursive")])
        self.k, self.bound = start, outer | dict(zip(parameters, arguments, strict=True)) | {f"{name}#{len(outer)}": Expr("always")}
        e = self.choice()
        self.k, self.bound = back, outer
        return e


def read(text: str, custom: dict[str, object] | None = None, strict: bool = True) -> Grammar:
    """The plan of a grammar. ``strict``: raise GrammarError for static errors of code 1000 and more (lint has 15xx)."""
    g = Reader(text).grammar()
    g.custom = custom or {}
    hard = [e for e in g.errors if 1000 <= e[1] < 1500]
    if strict and hard:
        raise GrammarError(hard)
    return g
