"""Tokens of a text by rules, with their places: exceptions, then endings, numbers, words and signs, in that order."""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .matching import _col, _next_place, _quote, let


@dataclass(frozen=True)
class TokenRules:
    """What is one token. All lists are parameters; they are matched in any case.

    `whole`: kept together though signs stand inside. `endings`: tokens of their own behind a word, as in "do|n't" and
    "it|'s". `joiners`: signs that stay inside a number, between two digits. Digits and letters that touch are two
    tokens ("10|km"), as are a sign and what it stands before or behind ("$|5", "well|-|known"), and dots in a row
    are one.
    """

    whole: tuple[str, ...] = ("e.g.", "i.e.", "etc.", "vs.", "approx.", "a.m.", "p.m.", "u.s.", "u.k.", "o'clock", "wi-fi", "t-shirt")
    negation: str = "n't"
    endings: tuple[str, ...] = ("'s", "'m", "'re", "'ve", "'ll", "'d")
    joiners: str = ".,:"

    def pattern(self) -> str:
        some = lambda words: "|".join(_quote(w) for w in sorted(words, key=lambda w: (-len(w), w)))
        end, negation = r"(?![\p{L}\p{N}])", _quote(self.negation)
        return "|".join((
            r"(?iu)\s+", f"(?:{some(self.whole)}){end}", rf"\p{{L}}+?(?={negation}{end})", f"{negation}{end}",
            rf"(?:{some(self.endings)}){end}", rf"\p{{N}}+(?:[{_quote(self.joiners)}]\p{{N}}+)*", r"\p{L}+", r"\.{2,}", r"[\s\S]",
        ))


def pieces(text, rules: TokenRules = TokenRules()) -> Column:
    """All tokens and the blanks between them, in order; joined they are the text."""
    return F.regexp_extract_all(_col(text), F.lit(rules.pattern()), F.lit(0))


def _blank(piece: Column) -> Column:
    return piece.rlike(r"^\s")


def tokens(text, rules: TokenRules = TokenRules()) -> Column:
    """Tokens as an array of (token, start, end), start from 0; null for a null text."""
    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        token = F.array(F.struct(piece.alias("token"), state["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(_blank(piece), state["found"]).otherwise(F.concat(state["found"], token)).alias("found"))

    none = F.array().cast("array<struct<token:string,start:int,end:int>>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("found"))
    return F.aggregate(pieces(text, rules), begin, step, lambda s: s["found"])


def token_ordinal(text, span, rules: TokenRules = TokenRules()) -> Column:
    """Index of the first occurrence of `span`, overlaps counted, that begins and ends where tokens do.

    Null when the span is absent, empty or never so placed. Meant for sentences.
    """
    t, s = _col(text), _col(span)
    size = F.length(s)
    most = F.length(t) - F.length(F.replace(t, s))  # bounds the number of occurrences

    def search(found: Column) -> Column:
        starts, ends = F.transform(found, lambda x: x["start"]), F.transform(found, lambda x: x["end"])

        def step(state: Column, _: Column) -> Column:
            def moved(at: Column) -> Column:
                fits = F.array_contains(starts, at - 1) & F.array_contains(ends, at - 1 + size)
                seen = state["seen"] + 1
                return F.struct(at.alias("at"), seen.alias("seen"), F.when(fits, seen).alias("hit"))

            return F.when((state["at"] < 0) | state["hit"].isNotNull(), state).otherwise(
                let(_next_place(t, s, state["at"]), lambda at: F.when(at > 0, moved(at)).otherwise(stop)))

        return F.aggregate(F.array_repeat(F.lit(0), most), begin, step, lambda x: x["hit"])

    none = F.lit(None).cast("int")
    begin = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("seen"), none.alias("hit"))
    stop = F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("seen"), none.alias("hit"))
    return F.when((size > 0) & F.contains(t, s), let(tokens(t, rules), search))
