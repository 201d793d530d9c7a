"""Text functions as Columns: they stay in generated code and can be pushed below other operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "[ \\t\\r\\f\\u000B]"


def lines(text) -> Column:
    return F.split(text, "\n")


def filled_lines(text) -> Column:
    """Lines with something other than white space."""
    return F.filter(lines(text), lambda x: x.rlike("\\S"))


def char_share(text, pattern: str) -> Column:
    """Share of characters that match, 0 for empty text."""
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(pattern)) / F.length(text)).otherwise(F.lit(0.0))


def cjk_share(text) -> Column:
    return char_share(text, "[\\u4e00-\\u9fff]")


def estimated_tokens(text) -> Column:
    """Half the characters, rounded down."""
    return F.floor(F.length(text) / 2).cast("long")


def tokens(text) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}_]+)"), 1))


def jaccard(a, b) -> Column:
    """Of two token sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def occurrences(text, needle: str) -> Column:
    """Non-overlapping, case-insensitive."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(needle.lower())))) / len(needle)).cast("long")


def html_to_text(html) -> Column:
    """Scripts and styles dropped, tags blank, four references decoded, white space collapsed."""
    x = F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>", "")
    x = F.regexp_replace(x, "(?is)<style[^>]*>.*?</style>", "")
    x = F.regexp_replace(x, "<[^>]+>", " ")
    for reference, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = F.replace(x, F.lit(reference), F.lit(char))
    return F.trim(F.regexp_replace(x, "[ \\t\\n\\r\\f]+", " "))


def html_title(html) -> Column:
    """The first title element, else the first h1 without tags."""
    clean = lambda p: F.trim(F.regexp_replace(F.regexp_extract(html, p, 1), "<[^>]+>", ""))
    title, heading = clean("(?is)<title[^>]*>(.*?)</title>"), clean("(?is)<h1[^>]*>(.*?)</h1>")
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(heading, F.lit("")))


def canonical_v1(text) -> Column:
    """Line feeds only, no white space at line ends, trimmed."""
    x = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \\t\\f]+(?=\n)", "")
    return F.regexp_replace(x, "^[ \\t\\n\\f]+|[ \\t\\n\\f]+$", "")


def first_title(text, source) -> Column:
    """The first filled line without its heading mark, at most 120 characters; else the source's stem."""
    first = F.trim(F.get(filled_lines(text), F.lit(0)))
    stem = F.regexp_replace(F.regexp_replace(source, "^.*[/\\\\]", ""), "\\.[^.]*$", "")
    return F.when(first.isNull(), stem).when(first.startswith("# "), F.trim(F.substring(first, 3, 1_000_000))).otherwise(F.substring(first, 1, 120))


def stable_id(prefix: str, *parts) -> Column:
    """prefix and 24 hex digits of the parts, joined by the unit separator."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 24))


def list_density(text) -> Column:
    """Share of list items among filled lines."""
    filled = filled_lines(text)
    return F.when(F.size(filled) == 0, F.lit(0.0)).otherwise(F.size(F.filter(filled, lambda x: x.rlike("^[ \\t]*([-*]|[0-9]+[.)])[ \\t]+"))) / F.size(filled))


def ascii_slug(text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalized_term(text) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f]+", " ")))


def wikilinks(text) -> Column:
    """Targets of [[target|label]]."""
    return F.regexp_extract_all(text, F.lit("\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]"), 1)


def citations(text) -> Column:
    """Distinct numbers of [n], in the order of the text."""
    return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit("\\[([1-9][0-9]*)\\]"), 1)), lambda x: x.cast("long"))


def fingerprint(text) -> Column:
    """md5 of the text without white space."""
    return F.md5(F.regexp_replace(text, "[ \\t\\n\\r]+", ""))
