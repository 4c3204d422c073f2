"""String functions as columns: views on parts of texts, searching, quoting, names. All but ``matching_brackets`` stay in the JVM.

Offsets count code points from 0. Null gives null.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \n\r\t"  # what strip takes off if nothing else is named


def _lit(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def pack_index(index: Column | int, length: Column) -> Column:
    """An index counted from the end if negative, held between 0 and the length."""
    i = _lit(index)
    return F.greatest(F.lit(0), F.least(F.when(i < 0, i + length).otherwise(i), length))


def real_indices(s: Column, begin: Column | int | None, end: Column | int | None) -> tuple[Column, Column]:
    n = F.length(s)
    return pack_index(0 if begin is None else begin, n), n if end is None else pack_index(end, n)


def view(s: Column, begin: Column | int | None = 0, end: Column | int | None = None) -> Column:
    """The part from ``begin`` up to ``end``, as slices give it; empty if that lies before."""
    a, b = real_indices(s, begin, end)
    return F.substring(s, a + 1, F.greatest(b - a, F.lit(0)))


def index(s: Column, begin: Column | int, at: Column | int) -> Column:
    """The place in ``s`` of offset ``at`` of the view that begins at ``begin``."""
    return pack_index(begin, F.length(s)) + _lit(at)


def first_char(s: Column, chars: str = BLANKS) -> Column:
    """The offset of the first character that is not among ``chars``."""
    return F.length(s) - F.length(F.ltrim(s, F.lit(chars)))


def last_char(s: Column, chars: str = BLANKS) -> Column:
    """The offset behind the last character that is not among ``chars``, at least that of the first one."""
    return F.greatest(F.length(F.rtrim(s, F.lit(chars))), first_char(s, chars))


def count(s: Column, part: str, begin: Column | int | None = 0, end: Column | int | None = None) -> Column:
    """Occurrences that do not overlap; of the empty string one more than there are characters."""
    v = view(s, begin, end)
    return F.length(v) + 1 if not part else ((F.length(v) - F.length(F.replace(v, F.lit(part), F.lit("")))) / len(part)).cast("int")


def find(s: Column, part: str, begin: Column | int = 0, end: Column | int | None = None) -> Column:
    """The first offset of ``part`` between the bounds, -1 if there is none."""
    a, b = real_indices(s, begin, end)
    at = F.locate(part, F.substring(s, a + 1, F.greatest(b - a, F.lit(0))))
    return F.when(at > 0, a + at - 1).otherwise(F.when(s.isNotNull(), F.lit(-1)))


def rfind(s: Column, part: str, begin: Column | int = 0, end: Column | int | None = None) -> Column:
    """The last offset of ``part`` between the bounds, -1 if there is none."""
    a, b = real_indices(s, begin, end)
    at = F.locate(part[::-1], F.reverse(F.substring(s, a + 1, F.greatest(b - a, F.lit(0)))))
    return F.when(at > 0, b - at + 1 - len(part)).otherwise(F.when(s.isNotNull(), F.lit(-1)))


def startswith(s: Column, prefix: str, begin: Column | int = 0, end: Column | int | None = None) -> Column:
    return view(s, begin, end).startswith(prefix)


def endswith(s: Column, suffix: str, begin: Column | int = 0, end: Column | int | None = None) -> Column:
    return view(s, begin, end).endswith(suffix)


def match(s: Column, rx: str) -> Column:
    """What a pattern matches at the start, null if it does not."""
    return F.when(s.rlike(f"^(?:{rx})"), F.regexp_extract(s, f"^(?:{rx})", 0))


def search(s: Column, rx: str) -> Column:
    """Struct (start, text) of a pattern's first match, null without one."""
    return F.when(s.rlike(rx), F.struct((F.regexp_instr(s, F.lit(rx)) - 1).alias("start"), F.regexp_extract(s, f"({rx})", 0).alias("text")))


def finditer(s: Column, rx: str) -> Column:
    """The texts of all matches."""
    return F.regexp_extract_all(s, F.lit(rx), F.lit(0))


def strip(s: Column, chars: str = BLANKS) -> Column:
    return F.btrim(s, F.lit(chars))


def lstrip(s: Column, chars: str = BLANKS) -> Column:
    return F.ltrim(s, F.lit(chars))


def rstrip(s: Column, chars: str = BLANKS) -> Column:
    return F.rtrim(s, F.lit(chars))


def split(s: Column, part: str) -> Column:
    return F.split(s, "\\Q" + part + "\\E", -1)


def replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def subf(s: Column, rx: str, f) -> Column:
    """Each match of a pattern (never empty) replaced by a column function of it."""
    rest, found = F.split(s, rx, -1), F.regexp_extract_all(s, F.lit(f"(?:{rx})"), F.lit(0))
    pieces = F.zip_with(rest, F.transform(found, f), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(pieces, "")


def escape_re(s: Column) -> Column:
    """Characters that mean something in patterns with a backslash before them."""
    return F.regexp_replace(s, r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0B\f])", r"\\$1")


def char_code(s: Column) -> Column:
    """The first character as a code: two, four or eight hexadecimal digits behind ``\\x``."""
    return F.concat(F.lit("\\x"), _digits(s))


def xml_entity(s: Column) -> Column:
    """The first character as an entity of two, four or eight hexadecimal digits."""
    return F.concat(F.lit("&#x"), _digits(s), F.lit(";"))


def _digits(s: Column) -> Column:
    o = F.ascii(s)
    return F.lower(F.lpad(F.hex(o), F.when(o < 256, 2).when(o < 65536, 4).otherwise(8), F.lit("0")))


def escape_ctrl_chars(s: Column) -> Column:
    """Control characters and backslashes written with a backslash."""
    out = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for c, e in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(c), F.lit(e))
    return subf(out, r"[\x00-\x1f\x7f]", char_code)


def abbreviate_middle(s: Column, most: int) -> Column:
    """Texts of more than 40 characters, if longer than ``most``, with an ellipsis in their middle."""
    if most <= 6:
        raise ValueError("must be more than 6")
    a, b = most // 2 - 2, most // 2 - 3
    return F.when((F.length(s) > most) & (F.length(s) > 40), F.concat(F.substring(s, 1, a), F.lit(" ... "), F.right(s, F.lit(b)))).otherwise(s)


def as_identifier(s: Column, replacement: str = "_") -> Column:
    """Each character that no name can have replaced."""
    return F.regexp_replace(s, r"(?U)\W", replacement.replace("\\", "\\\\").replace("$", "\\$"))


def escape_formatstr(s: Column) -> Column:
    """Single braces doubled."""
    return F.regexp_replace(F.regexp_replace(s, r"(?<!\{)\{(?!\{)", "{{"), r"(?<!\})\}(?!\})", "}}")


ENTITY = r"&(?:[A-Za-z_:][\w.:-]*|#\d+|#x[0-9a-fA-F]+);"


def is_xml_attribute(s: Column) -> Column:
    """Whether a value can stand in an attribute as it is: not with both quotes, ``<``, or ``&`` other than in entities."""
    return ~((s.contains('"') & s.contains("'")) | s.contains("<") | F.regexp_replace(s, ENTITY, "").contains("&"))


def xml_attribute(s: Column, fix: bool = True, latin: bool = False) -> Column:
    """The quoted value of an attribute, with entities where it needs them (``fix``), else null where it cannot stand as it is.

    ``latin``: characters beyond code 255 become question marks.
    """
    v = F.regexp_replace(s, r"[^\x00-\xFF]", "?") if latin else s
    if fix:
        v = F.regexp_replace(F.replace(v, F.lit("<"), F.lit("&lt;")), "&(?!" + ENTITY[1:] + ")", "&amp;")
        v = F.when(v.contains('"') & v.contains("'"), F.replace(v, F.lit("'"), F.lit("&apos;"))).otherwise(v)
    quoted = F.when(v.contains('"'), F.concat(F.lit("'"), v, F.lit("'"))).otherwise(F.concat(F.lit('"'), v, F.lit('"')))
    return quoted if fix else F.when(is_xml_attribute(v), quoted)


def json_string(s: Column) -> Column:
    """The text as a JSON string."""
    out = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, e in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(c), F.lit(e))
    out = subf(out, r"[\x00-\x1f]", lambda c: F.concat(F.lit("\\u00"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0"))))
    return F.concat(F.lit('"'), out, F.lit('"'))


def smart_list(s: Column) -> Column:
    """Values of a list parted by semicolons, else by commas, else by blanks."""
    trimmed = lambda parts: F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.when(s.contains(";"), trimmed(F.split(s, ";", -1))).when(s.contains(","), trimmed(F.split(s, ",", -1))).otherwise(trimmed(F.split(F.regexp_replace(s, r"^\s+|\s+$", ""), " ", -1)))


def normalize_circular_path(path: Column) -> Column:
    """A path that leads back to its start, turned so that its least item comes first."""
    at = F.array_position(path, F.array_min(path)).cast("int")
    return F.when(F.size(path) == 0, path).otherwise(F.concat(F.slice(path, at, F.size(path)), F.slice(path, F.lit(1), at - 1)))


def has_fenced_code(s: Column, infos: tuple[str, ...] = ("ebnf", "test")) -> Column:
    """Whether a text has a fenced block with one of the info strings that is closed again."""
    label = "|".join(f"(?:{x})" for x in infos)
    return s.rlike(rf"(?si)\n(```+) *(?:{label})(?=[ .\-:\n])[^`\n]*\n.*?\n\1") | s.rlike(rf"(?si)\n(~~~+) *(?:{label})(?=[ .\-:\n])[^\n]*\n.*?\n\1")


def md5(*parts: Column) -> Column:
    """The digest of the texts one after another."""
    return F.md5(F.concat(*parts).cast("binary"))


def matching_brackets(s: Column, opening: str = "(", closing: str = ")") -> Column:
    """Struct (pairs, unmatched): offsets of brackets that belong together, by their closing one, and of those left over.

    A kernel on batches, as a stack is needed.
    """
    kind = T.StructType.fromDDL("pairs array<struct<open:int,close:int>>, unmatched array<int>")

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        out = []
        for t in texts.to_pylist():
            pairs, stack, lone = [], [], []
            for k, c in enumerate(t or ""):
                if c == opening:
                    stack.append(k)
                elif c == closing:
                    if stack:
                        pairs.append({"open": stack.pop(), "close": k})
                    else:
                        lone.append(k)
            out.append(None if t is None else {"pairs": pairs, "unmatched": sorted(lone + stack)})
        return pa.array(out, to_arrow_type(kind))

    return run(s)
