"""Review text: cleaning, sentences, titles, labels for display."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import KEPT_CHARS, PICKER_LIMIT, TITLE_LIMIT, WHITESPACE, WS
from .matching import _contains_any, let


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim every kind of whitespace, not only the blank."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def clean_text(c) -> Column:
    """Lower-case words and basic punctuation, single-spaced; null becomes ''.

    URLs go first, then tags (`(?d)`: a dot stops at newline only). Dropping other characters
    and squeezing blanks is one pass: a run of either ends up as one blank. Plain substring tests come
    first, so texts without URLs or tags are not searched for their patterns.
    """
    out = F.lower(F.coalesce(_col(c), F.lit("")))
    out = _replaced(out, ("http", "www"), f"http[^{WS}]+|www[^{WS}]+")
    out = _replaced(out, ("<",), "(?d)<.*?>")
    return F.trim(F.regexp_replace(out, f"[^{KEPT_CHARS}]+", " "))


def _replaced(c: Column, words, pattern: str) -> Column:
    """Matches of `pattern`, each of which holds one of `words`, dropped."""
    def dropped(s: Column) -> Column:
        return F.when(_contains_any(s, words), F.regexp_replace(s, pattern, "")).otherwise(s)

    return let(c, dropped)


def split_sentences(c) -> Column:
    """Cut after `.`, `!` or `?` followed by whitespace; no empty sentences.

    A cut takes all whitespace around it, so only the text's own ends are stripped.
    """
    parts = F.split(let(_col(c), _stripped), f"(?<=[.!?])[{WS}]+")
    return F.filter(parts, lambda s: F.length(s) > 0)


def _stripped(s: Column) -> Column:
    """As `strip`, which reads the whole text, but only where an end is whitespace."""
    blank = [F.substring(s, place, 1).isin(*WHITESPACE) for place in (1, -1)]
    return F.when(blank[0] | blank[1], strip(s)).otherwise(s)


def strip_urls(c) -> Column:
    return strip(F.regexp_replace(_col(c), f"https?://[^{WS}]+", ""))


def split_titles(c) -> Column:
    """Comma-joined titles as a list, blanks dropped."""
    return F.filter(F.transform(F.split(_col(c), ","), strip), lambda t: F.length(t) > 0)


def shorten(c, limit: int = TITLE_LIMIT) -> Column:
    """At most `limit` characters, cut at the last blank, with an ellipsis."""
    name = strip(c)
    head = F.regexp_replace(F.substring(name, 1, limit), " [^ ]*$", "")
    return F.when(F.length(name) <= limit, name).otherwise(F.concat(head, F.lit("…")))


def breadcrumb(*parts, default: str = "All categories") -> Column:
    """Non-empty parts joined by ` › `."""
    kept = [F.nullif(_col(p), F.lit("")) for p in parts]
    return F.coalesce(F.nullif(F.concat_ws(" › ", *kept), F.lit("")), F.lit(default))


def category_crumbs(c) -> Column:
    """`A|B||C` as `A › B › C`."""
    return F.array_join(F.filter(F.split(_col(c), r"\|"), lambda p: F.length(p) > 0), " › ")


def scope_label(crumbs, tiers) -> Column:
    """Scope line of a prompt; an empty tier selection prints `none`."""
    return F.concat(_col(crumbs), F.lit(f" | tiers: {', '.join(tiers) or 'none'}"))


def picker_label(name, key, limit: int = PICKER_LIMIT) -> Column:
    return F.concat(F.substring(_col(name), 1, limit), F.lit(" — "), _col(key))


def has_text(c) -> Column:
    return F.length(strip(F.coalesce(_col(c), F.lit("")))) > 0


def parts(c, size: int) -> Column:
    """A text cut into pieces of `size` characters; an empty one is one empty piece, a null one a null piece."""
    def cut(s: Column) -> Column:
        last = F.greatest(F.ceil(F.length(s) / size) - 1, F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(s, i * size + 1, F.lit(size)))

    return F.flatten(F.transform(F.array(_col(c)), cut))


def review_blob(titles, content) -> Column:
    """Titles and text of a product's reviews."""
    text = lambda c: F.coalesce(_col(c), F.lit(""))
    blob = F.concat(F.lit("Review titles: "), text(titles), F.lit("\n\nReview text: "), text(content))
    return strip(blob)
