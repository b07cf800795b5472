"""Text functions as column expressions. Positions and lengths are in code points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the reference behaviour trims it: Unicode spaces, not blanks alone.
SPACES = r"(?U)\s+"
#: Words that mark a submission control, in order of preference.
SUBMIT_TERMS = ("send", "submit", "post", "publish", "search", "ask", "go", "continue")
#: Parts of a field's description that make it sensitive.
SENSITIVE = ("one-time code", "one time code", "verification code", "security code", "authentication code", "passcode", "password")


def chars(c: Column) -> Column:
    """The characters of a string; none for the empty one."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def common_prefix(x: Column, y: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    differ = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
    return F.when(differ > 0, differ - 1).otherwise(F.size(x).cast("bigint"))


def minimal_edit(before: Column, after: Column) -> Column:
    """struct(operation, offset, removed, inserted): longest common prefix, then longest common suffix of the rest.

    Equal strings: operation none at the end. operation is insert, delete or replace otherwise.
    """

    def body(sa: Column, sb: Column) -> Column:
        p = common_prefix(sa, sb)
        s = F.least(common_prefix(F.reverse(sa), F.reverse(sb)), F.least(F.size(sa), F.size(sb)) - p)
        part = lambda a: F.array_join(F.slice(a, (p + 1).cast("int"), (F.size(a) - p - s).cast("int")), "")
        return F.struct(p.alias("offset"), part(sa).alias("removed"), part(sb).alias("inserted"))

    edit = let(F.struct(chars(before).alias("a"), chars(after).alias("b")), lambda v: body(v["a"], v["b"]))
    kind = lambda e: F.when((e["removed"] == "") & (e["inserted"] == ""), "none").when(e["removed"] == "", "insert").when(e["inserted"] == "", "delete").otherwise("replace")
    return let(edit, lambda e: F.struct(kind(e).alias("operation"), e["offset"].alias("offset"), e["removed"].alias("removed"), e["inserted"].alias("inserted")))


def apply_edit(before: Column, offset: Column, removed: Column, inserted: Column) -> Column:
    """before with removed at offset replaced by inserted; null where it doesn't stand there."""
    at = offset.cast("int")
    fits = F.substring(before, at + 1, F.length(removed)) == removed
    return F.when(fits, F.concat(F.substring(before, F.lit(1), at), inserted, F.substring(before, at + F.length(removed) + 1, F.length(before))))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("bigint")


def utf16_to_offset(c: Column, units: Column) -> Column:
    """The code-point offset of a UTF-16 offset; null inside a surrogate pair or beyond the end."""
    start = F.struct(F.lit(0).cast("bigint").alias("u"), F.lit(0).cast("bigint").alias("n"), F.when(units == 0, F.lit(0)).cast("bigint").alias("hit"))

    def step(s: Column, x: Column) -> Column:
        u, n = s["u"] + F.when(F.ascii(x) > 65535, 2).otherwise(1), s["n"] + 1
        return F.struct(u.alias("u"), n.alias("n"), F.coalesce(s["hit"], F.when(u == units, n)).alias("hit"))

    return F.aggregate(chars(c), start, step)["hit"]


def normalized_line(c: Column) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def trimmed(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def novel_lines(previous: Column, current: Column) -> Column:
    """Lines of current whose normalized form neither stands in previous nor came before; current itself without previous."""
    lines = F.filter(F.split(current, "\n"), lambda x: x != "")
    normal = lambda a: F.transform(a, normalized_line)
    old = F.filter(F.split(previous, "\n"), lambda x: x != "")

    def body(v: Column) -> Column:
        keep = F.filter(v["l"], lambda x, i: (F.get(v["n"], i) != "") & ~F.array_contains(v["o"], F.get(v["n"], i)) & (F.array_position(v["n"], F.get(v["n"], i)) == i + 1))
        return F.array_join(keep, "\n")

    new = let(F.struct(lines.alias("l"), normal(lines).alias("n"), normal(old).alias("o")), body)
    return F.when(previous.isNull() | (previous == ""), current).otherwise(new)


def without_spaces(c: Column, lower: bool = False) -> Column:
    """Without white space, zero-width spaces and byte-order marks."""
    out = F.regexp_replace(c, r"(?U)[\s​﻿]+", "")
    return F.lower(out) if lower else out


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; 1 for two empty strings."""
    return F.coalesce(1 - F.levenshtein(a, b) / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0)), F.lit(1.0))


def prefix_length(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings."""
    return let(F.struct(chars(a).alias("a"), chars(b).alias("b")), lambda v: common_prefix(v["a"], v["b"]))


def occurrences(needle: Column, text: Column) -> Column:
    """Non-overlapping occurrences of a non-empty string."""
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.nullif(F.length(needle), F.lit(0))).cast("bigint")


def occurs_once(needle: Column, text: Column) -> Column:
    at = F.position(needle, text)
    return (at > 0) & (F.position(needle, text, at + 1) == 0)


def word_count(c: Column) -> Column:
    """Runs of word characters and apostrophes."""
    return F.size(F.regexp_extract_all(c, F.lit("(?U)([\\w’']+)"), 1))


def longest_contained_prefix(text: Column, within: Column, least: int = 24, most: int = 512) -> Column:
    """Length of the longest prefix of least..most characters of text that occurs in within; null if none.

    Containment is monotone in the length, so it is found by ten halvings.
    """
    top = F.least(F.length(text), F.lit(most))

    def step(s: Column, _: Column) -> Column:
        mid = F.ceil((s["lo"] + s["hi"]) / 2).cast("int")
        hit = F.contains(within, F.substring(text, F.lit(1), mid))
        return F.struct(F.when(hit, mid).otherwise(s["lo"]).alias("lo"), F.when(hit, s["hi"]).otherwise(mid - 1).alias("hi"))

    start = F.struct(F.lit(least).alias("lo"), top.cast("int").alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(10)), start, step)["lo"]
    return F.when((top >= least) & F.contains(within, F.substring(text, 1, least)), found)


def cursor_window(value: Column, location: Column, length: Column, radius: int = 512) -> Column:
    """struct(left, selected, right, left_cut, selected_cut, right_cut): the text around a selection."""
    loc, n = location.cast("int"), length.cast("int")
    left_from = F.greatest(loc - radius, F.lit(0))
    right_from = loc + n
    return F.struct(
        F.substring(value, left_from + 1, loc - left_from).alias("left"),
        F.substring(value, loc + 1, F.least(n, F.lit(2 * radius))).alias("selected"),
        F.substring(value, right_from + 1, F.lit(radius)).alias("right"),
        (left_from > 0).alias("left_cut"),
        (n > 2 * radius).alias("selected_cut"),
        (F.length(value) - right_from > radius).alias("right_cut"),
    )


def first_reason(*cases: tuple[Column, str]) -> Column:
    """The reason of the first case that holds, in order; null if none does."""
    return F.coalesce(*[F.when(condition, F.lit(reason)) for condition, reason in cases])


def logical_value(value: Column, placeholder: Column) -> Column:
    """Empty where a field shows its placeholder."""
    shown = (trimmed(value) == trimmed(placeholder)) & (trimmed(placeholder) != "")
    return F.when(F.coalesce(shown, F.lit(False)), "").otherwise(value)


def sensitive_category(role: Column, description: Column) -> Column:
    """Why a field's text must not be kept: a secure role, one digit of a code, or a credential; null for others."""
    low = F.lower(F.coalesce(description, F.lit("")))
    return first_reason(
        (F.lower(F.coalesce(role, F.lit(""))).contains("securetextfield"), "secure_text_field"),
        (low.rlike(r"\bdigit\s+\d+\s+of\s+\d+\b"), "segmented_verification_code"),
        (F.exists(F.array(*map(F.lit, SENSITIVE)), lambda w: F.contains(low, w)), "credential_or_verification_field"),
    )


def is_sensitive(role: Column, description: Column) -> Column:
    return sensitive_category(role, description).isNotNull()


def looks_like_address(c: Column) -> Column:
    return F.rlike(trimmed(c), F.lit(r"^(https?://)?\S+\.\S+/?$"))


def submit_term(c: Column, terms: Sequence[str] = SUBMIT_TERMS) -> Column:
    """The first of the terms, in their order, that is a whole word of c; null if none is."""
    return let(F.split(F.lower(c), r"(?U)[^\p{L}\p{N}]+"), lambda words: F.get(F.filter(F.array(*map(F.lit, terms)), lambda t: F.array_contains(words, t)), F.lit(0)))


def writable(c: Column) -> Column:
    """Without control and private-use key characters; tabs and line ends stay."""
    return F.regexp_replace(c, r"[\p{Cntrl}&&[^\r\n\t]]|[-]", "")


def stable_label(c: Column) -> Column:
    """Without spinner glyphs between a comma and a blank."""
    return F.regexp_replace(c, r"(?<=, )[⠀-⣿]+(?= )", "")
