"""Aspect keywords, complaint cues and span positions inside sentences.

Three keyword matchers exist on purpose: first aspect by substring, all aspects by substring,
and first keyword per aspect at word boundaries. They answer different questions.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    ASPECT_KEYWORDS, COMPLAINT_CUES, LEXICON_ALPHA, LEXICON_NEGATIVE, LEXICON_POSITIVE, SPAN_CONTEXT,
    WORD_CHARS,
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _quote(word: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|\-])", r"\\\1", word)


#: Two word characters.
WORD_PAIR = r"^[\p{L}\p{N}_]{2}$"


def _any_of(words) -> str:
    return "|".join(_quote(w) for w in words)


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _contains_any(s: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(s, F.lit(w))
    return found


def first_aspect(span, taxonomy=ASPECT_KEYWORDS) -> Column:
    """The first aspect, in taxonomy order, with a keyword inside the span; else null."""
    return let(F.lower(_col(span)), lambda s: first_aspect_lowered(s, taxonomy))


def first_aspect_lowered(span, taxonomy=ASPECT_KEYWORDS) -> Column:
    """The same for a lower-case column, without a lambda function, so Spark compiles it."""
    s = _col(span)
    return F.coalesce(*[F.when(_contains_any(s, kws), a) for a, kws in taxonomy.items()])


def all_aspects(sentence, taxonomy=ASPECT_KEYWORDS) -> Column:
    """Every aspect with a keyword inside the sentence, in taxonomy order."""
    s = _col(sentence)
    hits = [F.when(_contains_any(s, kws), a) for a, kws in taxonomy.items()]
    return F.filter(F.array(*hits), lambda a: a.isNotNull())


def _first_word(sentence: Column, priority: int, aspect: str, keywords) -> Column:
    pattern = rf"\b({_any_of(keywords)})\b"

    def hit(s: Column) -> Column:
        return _contains_any(s, keywords) & s.rlike(pattern)

    def span(s: Column) -> Column:
        return F.struct(
            F.lit(priority).alias("priority"),
            F.lit(aspect).alias("aspect"),
            F.regexp_extract(s, pattern, 1).alias("span"),
            F.length(F.element_at(F.split(s, pattern, 2), 1)).alias("start"),
        )

    return F.transform(F.filter(F.array(sentence), hit), span)


def word_spans(sentence, taxonomy=ASPECT_KEYWORDS) -> Column:
    """Per aspect the first whole-word keyword: array of (priority, aspect, span, start).

    Plain substring tests come first, so most sentences meet few regular expressions.
    """
    s = _col(sentence)
    return F.concat(*[_first_word(s, i, a, kws) for i, (a, kws) in enumerate(taxonomy.items())])


def first_words(sentence, taxonomy=ASPECT_KEYWORDS) -> Column:
    """The spans of `word_spans` alone: array of strings in taxonomy order.

    Without a lambda function, so Spark compiles the tests: half the time of `word_spans`.
    """
    s, none = _col(sentence), F.array().cast("array<string>")

    def one(keywords) -> Column:
        pattern = rf"\b({_any_of(keywords)})\b"
        hit = _contains_any(s, keywords) & s.rlike(pattern)
        return F.when(hit, F.array(F.regexp_extract(s, pattern, 1))).otherwise(none)

    return F.concat(*[one(kws) for kws in taxonomy.values()])


def count_before(sentence, span, start) -> Column:
    """How often `span` occurs, without overlap, left of `start`."""
    prefix = F.substring(_col(sentence), F.lit(1), _col(start))
    removed = F.length(prefix) - F.length(F.replace(prefix, _col(span)))
    return F.try_divide(removed, F.length(_col(span))).cast("int")


def cue_hits(sentence, cues=COMPLAINT_CUES) -> Column:
    """Distinct cues inside the sentence, stripped and sorted."""
    s = _col(sentence)
    hits = F.filter(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(s, c))
    return F.array_sort(F.array_distinct(F.transform(hits, lambda c: F.trim(c))))


def nearest_cue(sentence, start, end, cues=COMPLAINT_CUES) -> Column:
    """Characters between [start, end) and the closest cue; 0 when touching, null without a cue.

    The closest cue is the last one left of the keyword, the first one right of it, or one
    across its edges. Three searches per cue, so the cost is linear in the sentence.
    """
    s, a, e = _col(sentence), _col(start), _col(end)
    left, right = F.reverse(F.substring(s, F.lit(1), a)), F.substring(s, e + 1, F.length(s))

    def distance(cue: Column) -> Column:
        n = F.length(cue)
        low = F.greatest(a - n + 1, F.lit(0))
        across = F.contains(F.substring(s, low + 1, e + n - 1 - low), cue)
        before = F.nullif(F.position(F.reverse(cue), left), F.lit(0)) - 1
        after = F.nullif(F.position(cue, right), F.lit(0)) - 1
        return F.when(across, F.lit(0)).otherwise(F.least(before, after))

    present = F.filter(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(s, c))
    return F.array_min(F.transform(present, distance))


def _next_place(text: Column, span: Column, after: Column) -> Column:
    """1-based place of the next occurrence that starts after place `after`; 0 if there is none."""
    return F.position(span, text, after + 1)


def _inside_word(text: Column, place: Column) -> Column:
    """Whether the characters before and at a 1-based place are both word characters."""
    return (place > 1) & F.substring(text, place - 1, F.lit(2)).rlike(WORD_PAIR)


def aligned_ordinal(text, span) -> Column:
    """Index of the first occurrence of `span`, overlaps counted, that stands at word boundaries.

    Null when the span is absent or never so placed. An approximation of aligning a span to
    tokens: a place is no boundary when the characters on both sides of it are word ones.
    The search goes from one occurrence to the next. Each that a search without overlaps finds stands
    for at most as many as the span has characters, which bounds the number of steps.
    """
    t, s = _col(text), _col(span)
    size = F.length(s)
    most = F.length(t) - F.length(F.replace(t, s))

    def step(state: Column, _: Column) -> Column:
        def moved(at: Column) -> Column:
            fits = ~_inside_word(t, at) & ~_inside_word(t, at + size)
            seen = state["seen"] + 1
            return F.struct(at.alias("at"), seen.alias("seen"), F.when(fits, seen).alias("hit"))

        return F.when((state["at"] < 0) | state["hit"].isNotNull(), state).otherwise(
            let(_next_place(t, s, state["at"]), lambda at: F.when(at > 0, moved(at)).otherwise(end))
        )

    none = F.lit(None).cast("int")
    begin = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("seen"), none.alias("hit"))
    end = F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("seen"), none.alias("hit"))
    steps = F.array_repeat(F.lit(0), most)
    return F.when(size > 0, F.aggregate(steps, begin, step, lambda x: x["hit"]))


def span_context(text, span, ordinal, window: int = SPAN_CONTEXT) -> Column:
    """`window` words on each side of one occurrence of the span, then `:` and the whole text.

    `ordinal` counts as `aligned_ordinal` does. Null when the text has no such occurrence.
    """
    t, s, k = _col(text), _col(span), _col(ordinal)
    place = F.aggregate(
        F.array_repeat(F.lit(0), k + 1), F.lit(0),
        lambda at, _: F.when(at < 0, at).otherwise(F.coalesce(F.nullif(_next_place(t, s, at), F.lit(0)), F.lit(-1))),
    )
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 0)

    def around(at: Column) -> Column:
        left, right = words(F.substring(t, F.lit(1), at - 1)), words(F.substring(t, at + F.length(s), F.length(t)))
        tail = F.slice(left, F.greatest(F.size(left) - window, F.lit(0)) + 1, F.lit(window))
        near = F.concat(tail, F.array(s), F.slice(right, 1, window))
        return F.when(at > 0, F.concat(F.array_join(near, " "), F.lit(":"), t))

    return F.when((F.length(s) > 0) & (k >= 0), let(place, around))


def lexicon_score(text, lexicon: dict, alpha: float = LEXICON_ALPHA) -> Column:
    """Sum of word valences squashed to (-1, 1). For a lexicon held as a small dict.

    Words off the lexicon are dropped by hash before the others' valences are looked up one by one.
    """
    lowered = F.lower(_col(text))
    if "" in lexicon:  # the empty words that splitting gives count too
        words = F.split(lowered, f"[^{WORD_CHARS}]+")
    else:  # unlike that of `split`, this pattern is compiled once a task
        words = F.regexp_extract_all(lowered, F.lit(f"[{WORD_CHARS}]+"), F.lit(0))
    words = F.filter(words, lambda w: w.isin(*lexicon))
    valence = F.create_map(*[F.lit(x) for kv in lexicon.items() for x in (kv[0], float(kv[1]))])
    return F.aggregate(
        words,
        F.lit(0.0),
        lambda acc, w: acc + F.coalesce(F.try_element_at(valence, w), F.lit(0.0)),
        lambda total: total / F.sqrt(total * total + F.lit(float(alpha))),
    )


def lexicon_polarity(score, positive=LEXICON_POSITIVE, negative=LEXICON_NEGATIVE) -> Column:
    return let(
        _col(score),
        lambda c: F.when(c >= positive, "positive").when(c <= negative, "negative").otherwise("neutral"),
    )
