"""Text columns: whitespace, previews, prompts, statistics."""

from pyspark.sql import functions as F

# The characters that count as whitespace, as a list and as a regex class.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The rare ones stand behind a range check, which keeps the class quick for plain text.
_RARE = r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
_COMMON = r"\t\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
SPACE = f"[\\n{_COMMON}{_RARE}]"
NOT_SPACE = f"[^\\n{_COMMON}{_RARE}]"
LINE_SPACE = f"[{_COMMON}{_RARE}]"

# Fixed value: an unfilled placeholder starts like this; longer words with this start count too.
PLACEHOLDER = "[EXPAND"


def strip(col):
    """Without leading and trailing whitespace of any kind (``trim`` alone drops only blanks)."""
    return F.trim(col, F.lit(WHITESPACE))


def token_count(col):
    """Number of whitespace-separated tokens."""
    return F.regexp_count(col, F.lit(f"{NOT_SPACE}+"))


def preview(col, n=200):
    """The first ``n`` characters, for reports."""
    return F.substring(col, 1, n)


def occurrences(col, needle):
    """How often ``needle`` stands in the text, without overlap."""
    removed = F.length(col) - F.length(F.replace(col, F.lit(needle)))
    return (removed / len(needle)).cast("long")


def text_stats(text, seed_text):
    """Length, placeholder count, growth and expansion ratio of a text against its seed."""
    size, seed_size = F.length(text), F.length(seed_text)
    return {
        "n_chars": size.cast("long"),
        "markers": occurrences(text, PLACEHOLDER),
        "growth": (size - seed_size).cast("long"),
        "growth_pct": F.try_divide((size - seed_size) * F.lit(100.0), seed_size),
        "expansion_ratio": F.try_divide(size.cast("double"), seed_size),
        "markers_removed": occurrences(seed_text, PLACEHOLDER) - occurrences(text, PLACEHOLDER),
    }


def text_column(columns, preferred=("translated_te", "text")):
    """The first of ``preferred`` that exists as a column, else an empty text.

    A choice by schema, not a null coalesce: a null in the chosen column stays null.
    """
    for name in preferred:
        if name in columns:
            return F.col(name)
    return F.lit("")


def system_prompt(system, text):
    return F.concat(system, F.lit("\n\nText: "), text)


def user_prompt(text):
    return F.concat(F.lit("Classify:\n"), text)


def template_prompt(template, text, slot="{text}"):
    """A worked-examples template (the caller's words) with the text put in its slot."""
    before, found, after = template.partition(slot)
    if not found:
        raise ValueError(f"the template has no {slot}")
    return F.concat(F.lit(before), text, F.lit(after))
