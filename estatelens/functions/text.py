"""Text columns: whitespace, truncation, tokens, keys, stance and excerpts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelens import rules

# Whitespace as text tools outside the JVM see it: Unicode, with the four separators.
WS = r"(?U)[\s\x1c-\x1f]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flat(c) -> Column:
    """Runs of whitespace become one space; ends trimmed."""
    return F.btrim(F.regexp_replace(_col(c), WS + "+", " "), F.lit(" "))


def strip_ws(c) -> Column:
    """Whitespace off both ends, inner runs untouched."""
    return F.regexp_replace(_col(c), rf"\A{WS}+|{WS}+\z", "")


def strip_right(c) -> Column:
    return F.regexp_replace(_col(c), rf"{WS}+\z", "")


def collapse_ws(c) -> Column:
    """One-space text, null when blank."""
    return F.nullif(flat(c), F.lit(""))


def truncate_words(c, n: int = rules.SUMMARY_MAX) -> Column:
    """At most ``n`` characters, cut at the last blank when there is one."""
    c = _col(c)
    cut = F.substring(c, 1, n)
    head = strip_right(F.regexp_extract(cut, r"(?s)\A(.+)[ \t\n]", 1))
    return F.when(F.length(c) <= n, c).otherwise(F.coalesce(F.nullif(head, F.lit("")), cut))


def normalize(c) -> Column:
    return flat(F.lower(_col(c)))


def content_tokens(c) -> Column:
    """Lower-case alphanumeric runs without stop words, plural ``s`` cut."""
    words = F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(rules.STOP_WORDS))
    return F.transform(
        kept,
        lambda w: F.when((F.length(w) >= 4) & w.endswith("s"), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w),
    )


def strip_markers(c) -> Column:
    """Ownership phrases of several words become a space, longest first."""
    return without_markers(normalize(c))


def without_markers(plain) -> Column:
    """X4 on text that :func:`normalize` gave."""
    phrases = [p for p in rules.OWNER_PHRASES + rules.DELEGATE_PHRASES if " " in p]
    phrases.sort(key=lambda p: (-len(p), p))
    return reduce(lambda acc, p: F.replace(acc, F.lit(p), F.lit(" ")), phrases, _col(plain))


def key_tokens(c) -> Column:
    """Tokens of the marker-free text, marker words dropped."""
    return plain_key_tokens(normalize(c))


def plain_key_tokens(plain) -> Column:
    """X5 on text that :func:`normalize` gave."""
    return F.filter(content_tokens(without_markers(plain)), lambda t: ~t.isin(rules.MARKER_WORDS))


def responsibility_key(tokens) -> Column:
    """First two tokens joined by a space; null without tokens."""
    tokens = _col(tokens)
    return F.when(F.size(tokens) > 0, F.array_join(F.slice(tokens, 1, 2), " "))


def jaccard(a, b) -> Column:
    """Set similarity; two empty sets give 0."""
    both = F.size(F.array_intersect(_col(a), _col(b)))
    union = F.size(F.array_union(_col(a), _col(b)))
    return F.when(union == 0, F.lit(0.0)).otherwise(both / union)


def ownership_stance(c) -> Column:
    """``delegator`` before ``owner``; null without a claim."""
    return plain_stance(normalize(c))


def plain_stance(plain) -> Column:
    """X8 on text that :func:`normalize` gave: each phrase is a term of its own that reads it."""
    text = _col(plain)

    def says(phrases):
        return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])

    return F.when(says(rules.DELEGATE_PHRASES), F.lit("delegator")).when(says(rules.OWNER_PHRASES), F.lit("owner"))


def excerpt(c, n: int = rules.EXCERPT_MAX) -> Column:
    """One line of at most ``n`` characters, ending in an ellipsis if cut."""
    line = flat(c)
    return F.when(F.length(line) <= n, line).otherwise(
        F.concat(F.rtrim(F.substring(line, 1, n - 1)), F.lit("…"))
    )


def quoted(c) -> Column:
    """Text in single quotes with escapes, or double quotes when that saves escaping."""
    c = _col(c)
    body = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    double = c.contains("'") & ~c.contains('"')
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )
