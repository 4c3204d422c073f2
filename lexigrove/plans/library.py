"""Grammars ready to use."""

from __future__ import annotations

from . import ebnf
from .ir import Grammar

JSON = r"""
@ whitespace = /\s*/
@ drop = whitespace, strings, backticked
@ disposable = value, chars
json   = ~ value !.
value  = object | array | string | number | bool | null
object = "{" [ member { "," §member } ] §"}"
member = key §":" value
array  = "[" [ value { "," value } ] §"]"
key    = `"` chars `"` ~
string = `"` chars `"` ~
chars  = /[^"\\]*(?:\\.[^"\\]*)*/
number = /-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?/ ~
bool   = /true|false/ ~
null   = /null/ ~
"""

ARITHMETIC = r"""
@ whitespace = /\s*/
@ drop = whitespace
@ disposable = factor
expr   = expr `+` ~ term | expr `-` ~ term | term
term   = term `*` ~ factor | term `/` ~ factor | factor
factor = number | group | negated
group   = `(` ~ expr §`)` ~
negated = `-` ~ factor
number  = /\d+(?:\.\d+)?/ ~
"""

INI = r"""
@ drop = backticked
@ disposable = line, blank, eol
ini     = { blank } { entry { blank } } { section }
section = `[` name §`]` eol { blank } { entry { blank } }
entry   = !`[` key /[ \t]*=[ \t]*/ value eol
name    = /[^\]\n]+/
key     = /[^=\s\[;#][^=\n]*?(?=[ \t]*=)/
value   = /[^\n]*/
blank   = /[ \t]*(?:[;#][^\n]*)?\n/
eol     = /\n/ | !.
"""

CSV = r"""
@ drop = backticked
@ disposable = cell, eol
csv    = row { eol row }
row    = cell { `,` cell }
cell   = quoted | plain
quoted = `"` /(?:[^"]|"")*/ §`"`
plain  = /[^,"\n\r]*/
eol    = /\r?\n/
"""

OUTLINE = r"""
@ drop = backticked
@ disposable = block, gap
outline = { gap } { block { gap } }
block   = heading | item | par
heading = /#{1,6}(?= )/ / +/ title
title   = /[^\n]+/
item    = /[ \t]*[-*+](?= )/ / +/ body
body    = /[^\n]+/
par     = text { /\n(?=[^\n#*+-])/ text }
text    = /[^\n]+/
gap     = /\n/
"""

ALL = {"json": JSON, "arithmetic": ARITHMETIC, "ini": INI, "csv": CSV, "outline": OUTLINE}


def load(name: str) -> Grammar:
    return ebnf.read(ALL[name])
