"""Scalar functions of the ledger: Column -> Column, built-in expressions only."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

WHITE = " \t\n\x0b\f\r"


def literals(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values))


def trimmed(c: Column) -> Column:
    """c without white space at its ends; null if nothing is left."""
    t = F.btrim(c, F.lit(WHITE))
    return F.when(t != "", t)


def let(c: Column, body) -> Column:
    """body of c, with c worked out once."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def slug(c: Column) -> Column:
    """A header in lower case with every run of other characters as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


# Dates -------------------------------------------------------------------------------------------


#: Shapes of the formats that parse_date() reads without trying them, by format.
SHAPES = {
    "d/M/yyyy": r"\d{1,2}/\d{1,2}/\d{4}",
    "M/d/yyyy": r"\d{1,2}/\d{1,2}/\d{4}",
    "d-M-yyyy": r"\d{1,2}-\d{1,2}-\d{4}",
    "yyyy-M-d": r"\d{4}-\d{1,2}-\d{1,2}",
    "yyyy/M/d": r"\d{4}/\d{1,2}/\d{1,2}",
    "d-MMM-yyyy": r"\d{1,2}-[A-Za-z]{3}-\d{4}",
    "d MMM yyyy": r"\d{1,2} [A-Za-z]{3} \d{4}",
    "d MMMM yyyy": r"\d{1,2} [A-Za-z]+ \d{4}",
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def parse_date(c: Column, formats: Sequence[str] = fixed.DATE_FORMATS) -> Column:
    """The date by the first format that fits, else null.

    A text of a known shape is cut at its separators and its parts are put in order; formats without one
    in SHAPES are tried by the parser. fixed.MONTH_FIRST_FORMATS reads 03/04 as 4 March.
    """
    t = trimmed(c)
    known = [f for f in formats if f in SHAPES]
    if len(known) < len(formats):
        return F.coalesce(*(parse_date(c, (f,)) if f in SHAPES else F.try_to_date(t, f) for f in formats))
    same = F.translate(t, "/ ", "--")
    first, last = F.substring_index(same, "-", 1), F.substring_index(same, "-", -1)
    middle = F.substring_index(F.substring_index(same, "-", 2), "-", -1)
    name = F.lower(middle)
    named = {m: i + 1 for i, m in enumerate(MONTHS)} if "d MMMM yyyy" in known else {}
    short = {m[:3]: i + 1 for i, m in enumerate(MONTHS)}
    month = F.try_element_at(F.create_map(*(F.lit(x) for pair in (named | short).items() for x in pair)), name).cast("string")
    day = lambda *parts: F.concat_ws("-", *parts).try_cast("date")
    slashed = [day(last, middle, first) if f == "d/M/yyyy" else day(last, first, middle) for f in known if f in ("d/M/yyyy", "M/d/yyyy")]
    date = (
        F.when(F.length(first) == 4, day(first, middle, last))
        .when(F.contains(t, F.lit("/")), F.coalesce(*slashed) if slashed else F.lit(None))
        .when(middle.rlike("^[A-Za-z]"), F.when(month.isNotNull(), day(last, month, first)))
        .otherwise(day(last, middle, first))
    )
    return F.when(t.rlike("^(" + "|".join(dict.fromkeys(SHAPES[f] for f in known)) + ")$"), date)


def fiscal_year(d: Column) -> Column:
    """July to June, as 2023-2024."""
    first = F.year(d) - F.when(F.month(d) < 7, 1).otherwise(0)
    return F.concat(first.cast("string"), F.lit("-"), (first + 1).cast("string"))


def year_month(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def period_start(ym: Column) -> Column:
    return F.try_to_date(F.concat(ym, F.lit("-01")), "yyyy-MM-dd")


def period_end(ym: Column) -> Column:
    return F.last_day(period_start(ym))


def human_date(d: Column, padded: bool = False) -> Column:
    return F.coalesce(F.date_format(d, "dd MMM yyyy" if padded else "d MMM yyyy"), F.lit("Unknown date"))


# Amounts -----------------------------------------------------------------------------------------


def number(c: Column) -> Column:
    """A plain decimal text as a double; inf, nan and suffixed numbers are null."""
    return F.when(c.rlike(fixed.NUMBER), c.try_cast("double"))


def _bracketed(t: Column) -> Column:
    return t.startswith("(") & t.endswith(")")


def _inside(t: Column) -> Column:
    """A text without its brackets, if it has them."""
    return F.when(_bracketed(t), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def parse_amount(c: Column) -> Column:
    """Silver rule: brackets or a leading minus are negative; PKR or Rs, commas and spaces are dropped."""

    def read(t: Column) -> Column:
        return let(F.trim(_inside(t)), lambda inner: signed(t, inner))

    def signed(t: Column, inner: Column) -> Column:
        minus = inner.startswith("-")
        plain = F.when(minus, F.trim(F.substring(inner, F.lit(2), F.length(inner)))).otherwise(inner)
        bare = F.translate(F.regexp_replace(plain, r"(?i)^(PKR|Rs\.|Rs)\s*", ""), ", ", "")
        return let(bare, number) * F.when(_bracketed(t) | minus, -1.0).otherwise(1.0)

    return let(trimmed(c), read)


def parse_amount_gate(c: Column) -> Column:
    """Gate rule: tokens for no amount, nine currency prefixes, and a trailing DR or CR."""

    def read(t: Column) -> Column:
        bare = F.translate(F.regexp_replace(_inside(t), r"(?i)^(PKR|Rs\.|Rs|USD|\$|EUR|€|GBP|£)\s*", ""), ", ", "")
        value = let(F.regexp_replace(bare, r"\s*(DR|CR|Dr|Cr)\.?\s*$", ""), number)
        return F.when(~F.lower(t).isin(*fixed.NO_AMOUNT), value * F.when(_bracketed(t), -1.0).otherwise(1.0))

    return let(trimmed(c), read)


def parse_amount_or_zero(c: Column) -> Column:
    """File-to-gold rule: PKR prefix, commas and brackets; anything else is 0."""
    minus = lambda t: F.when(_bracketed(t), F.concat(F.lit("-"), _inside(t))).otherwise(t)
    plain = F.translate(F.regexp_replace(trimmed(c), r"(?i)^pkr\s*", ""), ",", "")
    return F.coalesce(let(plain, lambda t: let(minus(t), number)), F.lit(0.0))


def amount_text(amount: Column, currency: Column) -> Column:
    """PKR 1,234,568: rounded half to even."""
    return F.concat(currency, F.lit(" "), F.format_number(F.bround(amount, 0), 0))


def quantised(c: Column) -> Column:
    """An amount as decimal(18, 2), half to even; null if it is no number."""
    return F.bround(c.try_cast("decimal(38,18)"), 2).cast("decimal(18,2)")


# Text and personal data --------------------------------------------------------------------------


def language(c: Column) -> Column:
    """ur, mixed or en by script."""
    urdu, latin = F.coalesce(c.rlike(fixed.URDU), F.lit(False)), F.coalesce(c.rlike("[a-zA-Z]"), F.lit(False))
    return F.when(urdu & latin, "mixed").when(urdu, "ur").otherwise("en")


def _masked(text: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The text after each replacement in turn, and the names of those that hit the text as it then was."""
    hits, now = [], F.coalesce(text, F.lit(""))
    for name, pattern, mark in rules:
        hits.append(F.when(now.rlike(pattern), F.lit(name)))
        now = F.regexp_replace(now, pattern, mark)
    return now, F.array_distinct(F.array_compact(F.array(*hits)))


def mask(text: Column, style: str = "silver") -> tuple[Column, Column]:
    """(masked text, array of the types found) by the rules of the silver step or of the file-to-gold job."""
    return _masked(text, {"silver": fixed.SILVER_MASKS, "pipeline": fixed.PIPELINE_MASKS}[style])


def pii_matches(fields: dict[str, Column]) -> Column:
    """All matches of personal data: array of (type, original, token, field).

    Order: field, then type, then place. Tokens are numbered by type over all fields of the row.
    """

    def named(hits: Column, kind: str, base: Column, field: str) -> Column:
        token = lambda i: F.concat(F.lit(f"[{kind}_"), (i + 1 + base).cast("string"), F.lit("]"))
        return F.transform(hits, lambda x, i: F.struct(F.lit(kind).alias("type"), x.alias("original"), token(i).alias("token"), F.lit(field).alias("field")))

    found, seen = [], dict.fromkeys(fixed.PII_PATTERNS, F.lit(0))
    for field, c in fields.items():
        for kind, pattern in fixed.PII_PATTERNS.items():
            hits = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))
            if kind in fixed.PII_SCREENS:  # no match is without one of these, and most texts are
                has = [F.contains(c, F.lit(x)) for x in fixed.PII_SCREENS[kind]]
                hits = F.when(functools.reduce(Column.__or__, has), hits).otherwise(F.array().cast("array<string>"))
            found.append(named(hits, kind, seen[kind], field))
            seen[kind] = seen[kind] + F.size(hits)
    return F.concat(*found)


def mask_tokens(text: Column, matches: Column, field: str, mode: str = "places") -> Column:
    """The field with its matches replaced by their tokens, one after the other in their order.

    mode `places`: each match where its own pattern found it, so `abroad` stays though `road` was found; a match that
    an earlier token has covered is left out. mode `compat`: every occurrence of the matched text.
    """
    own = F.filter(matches, lambda m: m["field"] == field)
    if mode == "compat":
        return F.aggregate(own, text, lambda acc, m: F.replace(acc, m["original"], m["token"]))
    if mode != "places":
        raise ValueError("mode is places or compat")
    now = text
    for kind, pattern in fixed.PII_PATTERNS.items():
        now = _placed(now, own, kind, pattern)
    # most rows have no match and are left as they are
    return F.when(F.exists(matches, lambda m: m["field"] == field), now).otherwise(text)


def _placed(text: Column, matches: Column, kind: str, pattern: str) -> Column:
    """The text with each match of a kind replaced where the pattern finds it, unless an earlier token covers it."""

    def step(acc: Column, m: Column) -> Column:
        same = F.coalesce(F.regexp_substr(acc["rest"], F.lit(pattern)) == m["original"], F.lit(False))
        # a match that the pattern finds elsewhere first is taken where its text stands: nothing found is left
        at = F.when(same, F.regexp_instr(acc["rest"], F.lit(pattern))).otherwise(F.position(m["original"], acc["rest"]))
        return let(at, lambda at: placed(acc, m, at))

    def placed(acc: Column, m: Column, at: Column) -> Column:
        done = F.concat(acc["done"], F.substring(acc["rest"], F.lit(1), at - 1), m["token"])
        rest = F.substring(acc["rest"], at + F.length(m["original"]), F.length(acc["rest"]))
        return F.when(at > 0, F.struct(done.alias("done"), rest.alias("rest"))).otherwise(acc)

    start = F.struct(F.lit("").alias("done"), text.alias("rest"))
    return F.aggregate(F.filter(matches, lambda m: m["type"] == kind), start, step, lambda acc: F.concat(acc["done"], acc["rest"]))


def pii_summary(matches: Column) -> Column:
    return F.struct(
        (F.size(matches) > 0).alias("has_pii"),
        F.array_distinct(F.transform(matches, lambda m: m["field"])).alias("fields"),
        F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["type"]))).alias("types"),
        F.size(matches).alias("redactions"),
    )


# Scores, hashes, categories ----------------------------------------------------------------------


def quality_score(has_date: Column, has_amount: Column, has_description: Column, has_vendor: Column, has_pii: Column) -> Column:
    """A sum of tenths: date 3, amount 3, description 2, vendor 1, no personal data 1."""
    tenths = sum((F.when(c, n).otherwise(0) for c, n in ((has_date, 3), (has_amount, 3), (has_description, 2), (has_vendor, 1), (~has_pii, 1))), F.lit(0))
    return tenths / F.lit(10.0)


def row_hash(date: Column, description: Column, amount: Column, party: Column, reference: Column, *more: Column) -> Column:
    """SHA-256 of the fields, lower-cased and trimmed, nulls empty, joined by bars."""
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    when = F.coalesce(F.date_format(date, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    money = F.coalesce(F.format_string("%.2f", amount.cast("double")), F.lit(""))
    return F.sha2(F.concat_ws("|", when, text(description), money, text(party), text(reference), *map(text, more)), 256)


def currency(c: Column) -> Column:
    """The code of a currency's spelling; unknown ones stay in upper case, null stays null."""
    up = F.upper(F.trim(c))
    known = F.create_map(*(F.lit(x) for pair in fixed.CURRENCIES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, up), up)


def _looks_numeric(c: Column) -> Column:
    return F.translate(F.trim(c), ", ", "").rlike(fixed.NUMBER)


def neutralised(c: Column) -> Column:
    """A cell that a spreadsheet would run gets a mark in front."""
    dangerous = F.lit(False)
    for pattern in fixed.FORMULAS:
        dangerous = dangerous | c.rlike(pattern)
    leading = c.rlike("^[=@\t\r]") | (c.rlike(r"^[+-]") & ~_looks_numeric(c))
    return F.when(dangerous | leading, F.concat(F.lit(fixed.FORMULA_MARK), c)).otherwise(c)


def keyword_category(text: Column, word_boundary: bool = False) -> Column:
    """(category, taxable) of the first keyword contained in the text, null and false without one."""
    return let(F.lower(text), lambda low: lowered_category(low, word_boundary))


def lowered_category(low: Column, word_boundary: bool = False) -> Column:
    """keyword_category() of a text in lower case."""
    out = F
    for word, name, taxable in fixed.KEYWORD_CATEGORIES:
        hit = low.rlike(rf"\b{word}\b") if word_boundary else F.contains(low, F.lit(word))
        out = out.when(hit, F.struct(F.lit(name).alias("category"), F.lit(taxable).alias("taxable")))
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("category"), F.lit(False).alias("taxable")))


def tax_class(category: Column) -> Column:
    """Tax class of a category by the first rule with a word that it contains, else null."""
    low, out = F.lower(category), F
    for words, name in fixed.TAX_CLASSES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = out.when(hit, name)
    return out


def embedding_text(date: Column, amount_debit: Column, amount_credit: Column, code: Column, vendor: Column, category: Column, style: str = "gold") -> Column:
    """The sentence for a row: On 5 Jan 2024, PKR 5,000 was paid to X — Category."""
    debit = F.coalesce(amount_debit, F.lit(0.0)) > 0
    amount = amount_text(F.coalesce(F.when(debit, amount_debit).otherwise(amount_credit), F.lit(0.0)), F.coalesce(code, F.lit("PKR")))
    if style == "pipeline":
        who = F.concat(F.when(debit, "paid to ").otherwise("received from "), F.coalesce(vendor, F.lit("unknown")))
        tail = F.concat(F.lit(" — "), F.coalesce(category, F.lit("uncategorised")))
        return F.concat(F.lit("On "), human_date(date, padded=True), F.lit(", "), amount, F.lit(" was "), who, tail)
    named = F.when(F.coalesce(vendor, F.lit("")) != "", vendor)
    who = F.coalesce(F.concat(F.when(debit, "paid to ").otherwise("received from "), named), F.when(debit, "debited").otherwise("credited"))
    tail = F.when(F.coalesce(category, F.lit("")) != "", F.concat(F.lit(" — "), category)).otherwise("")
    return F.concat(F.lit("On "), human_date(date), F.lit(", "), amount, F.lit(" was "), who, tail)


# Encryption --------------------------------------------------------------------------------------


def tenant_key(secret: str, org: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(secret), org.cast("string")), 256))


def encrypted(c: Column, secret: str, org: Column) -> Column:
    """AES-256-GCM under the tenant's key, as base64."""
    return F.base64(F.aes_encrypt(c, tenant_key(secret, org), F.lit("GCM")))


def decrypted(c: Column, secret: str, org: Column) -> Column:
    return F.aes_decrypt(F.unbase64(c), tenant_key(secret, org), F.lit("GCM")).cast("string")
