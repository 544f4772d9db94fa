"""Token counts, token-bounded folds and Markdown structure as Column expressions.

The folds (split, merge, overlap) are local to a row, so they never shuffle. They carry counts along in place of
counting joined text again: separators are blank and add no token.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word (letters, digits, underscore of any script) or any single other visible character.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"
FENCE = "```"
_PIECES = "array<struct<text:string,n:int>>"


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1)


def split_by_tokens(text: Column, most: int, sep: str = "\n\n") -> Column:
    """Greedy runs of parts of at most `most` tokens; one part that is larger stays whole. Returns array<string>."""
    parts = F.transform(F.split(text, sep.replace("\n", r"\n"), -1), lambda p: F.struct(F.array(p).alias("parts"), token_count(p).alias("n")))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(F.concat(last["parts"], x["parts"]).alias("parts"), (last["n"] + x["n"]).alias("n"))
        head = F.slice(acc, F.lit(1), F.size(acc) - 1)
        return F.when(F.size(acc) == 0, F.array(x)).when(last["n"] + x["n"] <= most, F.concat(head, F.array(grown))).otherwise(F.concat(acc, F.array(x)))

    start = F.array().cast("array<struct<parts:array<string>,n:int>>")
    folded = F.aggregate(parts, start, step, lambda acc: F.transform(acc, lambda g: F.array_join(g["parts"], sep)))
    return F.when(token_count(text) <= most, F.array(text)).otherwise(folded)


def merge_small(texts: Column, least: int) -> Column:
    """Appends each text to the last while that has fewer than `least` tokens; a small one at the end stays."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        n = token_count(x)
        grown = F.struct(F.concat(last["text"], F.lit("\n\n"), x).alias("text"), (last["n"] + n).alias("n"))
        fresh = F.struct(x.alias("text"), n.alias("n"))
        small = (F.size(acc) > 0) & (F.coalesce(last["n"], F.lit(0)) < least)
        return F.when(small, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    return F.aggregate(texts, F.array().cast(_PIECES), step, lambda acc: F.transform(acc, lambda x: x["text"]))


def tail(text: Column, n: int) -> Column:
    """The last n tokens joined by blanks, or the text itself if it has no more."""
    own = tokens(text)
    return F.when(F.size(own) <= n, text).otherwise(F.array_join(F.slice(own, -n, n), " "))


def overlap(texts: Column, n: int) -> Column:
    """Each text but the first led by the tail of the one before, as that was."""
    if n <= 0:
        return texts
    lead = lambda i: tail(F.element_at(texts, i.cast("int")), n)
    return F.transform(texts, lambda t, i: F.when((i == 0) | (lead(F.greatest(i, F.lit(1))) == ""), t).otherwise(F.concat(lead(F.greatest(i, F.lit(1))), F.lit("\n\n"), t)))


#: A line like a heading; the blanks are those of RE2, and a line may hold any other character.
_HEADING = r"(?s)^#{1,6}[\t\n\f\r ]+([^\t\n\f\r ].*)\z"


def headings(markdown: Column) -> Column:
    """Texts of all lines like a heading, those inside fences too; blanks around a line go, those of any script (Zs)."""
    # a lambda, as F.trim itself would get the line's number as the characters to trim
    lines = F.transform(F.split(markdown, r"\n", -1), lambda x: F.regexp_replace(x, r"^\p{Zs}+|\p{Zs}+\z", ""))
    return F.transform(F.filter(lines, lambda x: x.rlike(_HEADING)), lambda x: F.regexp_extract(x, _HEADING, 1))


def code_blocks(markdown: Column) -> Column:
    """array<struct<language, content>> of fenced blocks; `text` where no language is named."""
    pattern = F.lit(r"(?s)`{3}(\w*)\n(.*?)`{3}")
    both = F.arrays_zip(F.regexp_extract_all(markdown, pattern, 1).alias("l"), F.regexp_extract_all(markdown, pattern, 2).alias("c"))
    return F.transform(both, lambda x: F.struct(
        F.when(x["l"] == "", "text").otherwise(x["l"]).alias("language"), F.regexp_replace(x["c"], r"^\n+|\n+$", "").alias("content")))


def code_languages(text: Column) -> Column:
    """Distinct languages of opening fences in order; a chunk has code if there is one."""
    fences = F.filter(F.split(text, r"\n", -1), lambda x: x.startswith(FENCE))
    opening = F.filter(fences, lambda x, i: i % 2 == 0)
    return F.array_distinct(F.filter(F.transform(opening, lambda x: F.trim(F.substring(x, 4, 1_000_000))), lambda x: x != ""))


_HINTS = [
    ("sql", r"\b(select|insert|create table|create index)\b"),
    ("python", r"\bdef \w+\("),
    ("javascript", r"\b(function|const|import)\b"),
    ("go", r"\b(?:package main\b|func \w+\()"),
    ("bash", r"\b(curl|wget|pip install|npm install)\b"),
    ("bash", r"\b(kubectl|docker)\b"),
]


def code_language(code: Column) -> Column:
    """Language by content; the first hint that fits, null if none does."""
    out = F.lit(None).cast("string")
    for language, pattern in reversed(_HINTS):
        out = F.when(code.rlike("(?i)" + pattern), language).otherwise(out)
    return out


def class_language(css: Column) -> Column:
    """Language by the classes of a code element."""
    own = F.regexp_extract(css, r"(?i)language-([\w+#.\-]+)", 1)
    other = F.regexp_extract(css, r"(?i)highlight-(\w+)", 1)
    return F.lower(F.coalesce(F.nullif(own, F.lit("")), F.nullif(other, F.lit(""))))
