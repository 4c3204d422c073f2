"""PII spans: patterns propose, checksums (Luhn, modulo 97) confirm, nearby words adjust the score. JVM functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, documents, numbered, text_column

# Matches may begin where the last one ended or where no character of the same run stands before: elsewhere in a run the
# match, if any, would have begun earlier. This keeps a long run of such characters linear; possessive repeats keep the
# matcher from recursing where nothing could be given back anyhow.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Characters of an IBAN by country code, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Groups of four and a shorter last one up to the country's length; a code that is not registered takes all that follows."""
    codes = {n: "|".join(c.split()) for n, c in IBAN_LENGTHS.items()}
    known = [rf"(?:{c})[0-9]{{2}}(?:[\x20-]?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"[\x20-]?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in codes.items()]
    other = rf"(?!{'|'.join(codes.values())})[A-Z]{{2}}[0-9]{{2}}(?:[\x20-]?[A-Z0-9]{{4}}){{2,7}}(?:[\x20-]?[A-Z0-9]{{1,3}})?"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([*known, other])})(?![A-Za-z0-9])"


IBAN = _iban()
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: kind: pattern and the cheap text that every match contains, in the order of the output.
KINDS = {"email": (EMAIL, "@"), "ip": (IP, "."), "card": (CARD, None), "phone": (PHONE, "+"), "iban": (IBAN, None), "ssn": (SSN, "-")}
BASE = ("email", "ip", "card", "phone")
#: Score without context, and the words that raise it when they stand within WINDOW characters before or after.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|login|adresse|direcci[oó]n)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone)\b",
    "iban": r"(?i)\b(?:iban|bank|account|konto|cuenta|compte)\b",
    "ssn": r"(?i)\b(?:ssn|social|security|tax)\b",
}
WINDOW, RAISE = 40, 0.3
#: Kinds beyond the base whose span is reported only from this score on.
LEAST = {"iban": 0.5, "ssn": 0.5}


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    places = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod_97(iban: Column) -> Column:
    """Whether an IBAN passes the modulo 97 check (letters count 10 to 35, the first four characters go to the end)."""
    plain = F.upper(F.regexp_replace(iban, r"[\x20-]", ""))
    turned = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda a, c: (a * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + value(c)) % 97) == 1


def confirmed(kind: str, match: Column) -> Column:
    """The validator of a kind."""
    number = digits(match)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(number).between(16, 19), luhn(number)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(number).between(8, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(match, r"[\x20-]", "")).between(15, 34), mod_97(match)).otherwise(F.lit(False))
    if kind == "ssn":
        return ~F.substring(match, 1, 3).isin("000", "666") & (F.substring(match, 1, 1) != "9") & (F.substring(match, 5, 2) != "00") & (F.substring(match, 8, 4) != "0000")
    return F.lit(True)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def in_blocks(rows: Column) -> Column:
    """The array cut into about as many blocks as a block has rows, and of 64 rows at least.

    Sums over rows that a block or a list of blocks makes by appending stay cheap, as neither gets long.
    """
    return bound(
        F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(rows))).cast("int")),
        lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(rows) / n).cast("int") - 1, F.lit(0))), lambda k: F.slice(rows, k * n + 1, n)),
    )


def running(numbers: Column) -> Column:
    """What stands before each number of an array, summed."""
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("out"))
    return F.aggregate(numbers, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


SPAN = "array<struct<kind:string,start:int,end:int,score:double,match:string>>"


def spans_of(kind: str, text: Column) -> Column:
    """Confirmed, scored spans of a kind in a text: offsets in code points, end exclusive, in order.

    Places follow from the lengths of what stands between the matches and of the matches: ``split`` and
    ``regexp_extract_all`` step through the same matches. These are taken in blocks; context words are looked for in a
    block's own text and WINDOW characters around it, so that no match walks through the whole text.
    """
    pattern, needle = KINDS[kind]
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    pieces = F.zip_with(between, matches, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    joined = lambda rows: F.array_join(F.transform(rows, lambda x: F.concat(x["b"], F.coalesce(x["m"], F.lit("")))), "")

    def of_block(rows: Column, before: Column, own: Column, after: Column, at: Column) -> Column:
        """The spans of a block that begins at ``at``: its pieces and texts, of the blocks beside it what is near."""
        places = running(F.transform(rows, lambda x: F.length(x["b"]) + F.coalesce(F.length(x["m"]), F.lit(0))))
        placed = F.zip_with(rows, places, lambda x, p: F.struct((p + F.length(x["b"])).alias("start"), x["m"].alias("match")))
        placed = F.filter(placed, lambda x: x["match"].isNotNull() & confirmed(kind, x["match"]))

        def scored(x: Column, whole: Column) -> Column:
            here, n = F.length(before) + x["start"], F.length(x["match"])
            low = F.greatest(here - WINDOW, F.lit(0))
            near = F.concat_ws(" ", F.substring(whole, low + 1, here - low), F.substring(whole, here + n + 1, F.lit(WINDOW)))
            score = F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), RAISE).otherwise(0.0))
            return F.struct(F.lit(kind).alias("kind"), (at + x["start"]).alias("start"), (at + x["start"] + n).alias("end"), score.alias("score"), x["match"].alias("match"))

        return bound(F.concat(before, own, after), lambda whole: F.transform(placed, lambda x: scored(x, whole)))

    def of_blocks(blocks: Column) -> Column:
        starts = running(F.transform(blocks, lambda x: F.length(x["t"])))
        near = lambda k: F.coalesce(F.get(blocks, k)["t"], F.lit(""))
        return bound(starts, lambda at: F.flatten(F.transform(blocks, lambda x, k: of_block(x["rows"], F.right(near(k - 1), F.lit(WINDOW)), x["t"], F.substring(near(k + 1), 1, WINDOW), F.get(at, k)))))

    found = bound(pieces, lambda p: bound(F.transform(in_blocks(p), lambda rows: F.struct(rows.alias("rows"), joined(rows).alias("t"))), of_blocks))
    if kind in LEAST:
        found = F.filter(found, lambda x: x["score"] >= LEAST[kind])
    maybe = text.rlike(pattern) if needle is None else text.contains(needle)
    return F.when(maybe, found).otherwise(F.expr(f"CAST(array() AS {SPAN})"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and ``found``, an array of (kind, start, end, score, match).

    Whole texts, null as empty; kinds in the order of ``KINDS``, then by start. Base kinds (email, ip, card, phone) are
    reported whatever their score; IBANs have their country's length and must pass modulo 97, social security numbers need a context word nearby.
    Repeated rows give repeated results; other columns are ignored. One map over the rows, no shuffle.
    """
    rows = docs.select(col(id_col).alias("id"), text_column(text_col).alias("t"))
    rows = rows.select(col("id").alias(id_col), F.concat(*[spans_of(k, F.col("t")) for k in KINDS]).alias("found"))
    return rows


def mask(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with each span of at least this score replaced by its kind in angle brackets; spans in another are left to it.

    Of spans that overlap, the one that begins first counts, of those that begin together the shorter. Null texts stay
    null, empty ones empty; repeated rows give repeated results; all columns are kept under their names.
    """
    plain, names = numbered(docs)
    own = names[text_col]
    rows = plain.withColumn("_pii_text", text_column(own))
    spans = F.concat(*[spans_of(k, F.col("_pii_text")) for k in KINDS])
    spans = F.array_sort(F.transform(F.filter(spans, lambda x: x["score"] >= least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    text = F.col("_pii_text")

    def of_block(block: Column, low: Column, high: Column) -> Column:
        """The text from ``low`` to ``high`` with a block's spans masked."""
        start = F.struct(low.alias("at"), F.lit("").alias("out"))

        def masked(part: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                new = F.concat(acc["out"], F.substring(part, acc["at"] - low + 1, x["start"] - acc["at"]), F.lit("<"), x["kind"], F.lit(">"))
                return F.when(x["start"] < acc["at"], F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(x["end"].alias("at"), new.alias("out")))

            return F.aggregate(block, start, step, lambda acc: F.concat(acc["out"], F.substring(part, acc["at"] - low + 1, F.greatest(high - acc["at"], F.lit(0)))))

        return bound(F.substring(text, low + 1, F.greatest(high - low, F.lit(0))), masked)

    # a block's text reaches from behind the spans before it to its own last span's end
    def of_blocks(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda x: x["end"])))
        reach = bound(ends, lambda e: F.transform(e, lambda _, k: F.array_max(F.slice(e, F.lit(1), k + 1))))
        return bound(reach, lambda r: F.concat(F.array_join(F.transform(blocks, lambda b, k: of_block(b, F.coalesce(F.get(r, k - 1), F.lit(0)), F.get(r, k))), ""), F.substring(text, F.element_at(r, -1) + 1, F.length(text))))

    rows = rows.withColumn("_pii_spans", spans)
    found = F.when(F.size("_pii_spans") > 0, bound(in_blocks(F.col("_pii_spans")), of_blocks)).otherwise(col(own))
    return rows.withColumn(own, found).drop("_pii_text", "_pii_spans").toDF(*docs.columns)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    scores = F.array_join(F.transform("found", lambda x: F.format_number(x["score"], 2)), ",")
    return found.select("doc_id", *map(count, BASE), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("found")).alias("spans"), scores.alias("scores"))
