"""Polarity of a text by word values and rules on the words around them, as one fold over its tokens."""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import LEXICON_ALPHA
from .matching import _col, let


@dataclass(frozen=True)
class Rules:
    """What changes a word's value. All amounts are this library's own and are parameters.

    A word is rated if the lexicon has it. `negations` and `degrees` (word to amount) act on rated words among the
    `reach` tokens after them: the last degree word adds its amount in the direction of the value, a negation
    multiplies it. A word in capitals, in a text that is not all capitals, gains `capitals` in its direction. A
    word of `contrast` (such as "but") weighs what comes before its last occurrence by `before` and the rest by
    `after`. Up to `marks` exclamation marks move the sum by `mark` each, away from zero.
    """

    negations: tuple[str, ...] = ("not", "no", "never", "none", "nor", "without", "cannot", "can't", "don't", "isn't", "won't")
    degrees: tuple[tuple[str, float], ...] = (
        ("very", 0.25), ("really", 0.25), ("extremely", 0.5), ("so", 0.25), ("quite", 0.125),
        ("slightly", -0.25), ("barely", -0.5), ("somewhat", -0.25), ("hardly", -0.5),
    )
    contrast: tuple[str, ...] = ("but",)
    reach: int = 3
    negated: float = -0.75
    capitals: float = 0.75
    before: float = 0.5
    after: float = 1.5
    mark: float = 0.25
    marks: int = 4


#: Signs at both ends of a token, not part of its word.
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
CAPITALS = r"^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$"


def lexicon_rules_sum(text, lexicon: dict, rules: Rules = Rules()) -> Column:
    """The sum of all rated words after the rules; null for a null text.

    The fold's state holds the tokens that a negation and a degree word still reach.
    """
    t = _col(text)
    values = F.create_map(*[F.lit(x) for w, v in lexicon.items() for x in (w, float(v))]) if lexicon else None
    degrees = dict(rules.degrees)
    known = lambda w, words: F.coalesce(w.isin(list(words)), F.lit(False)) if words else F.lit(False)
    plain = ~t.rlike("[a-z]")

    def token(raw: Column) -> Column:
        word = F.lower(F.regexp_replace(raw, EDGES, ""))
        value = F.try_element_at(values, word) if lexicon else F.lit(None).cast("double")
        degree = F.coalesce(*[F.when(word == w, F.lit(float(v))) for w, v in degrees.items()]) if degrees else F.lit(None).cast("double")
        loud = raw.rlike(CAPITALS) & ~plain
        return F.struct(
            value.alias("value"), degree.alias("degree"), known(word, rules.negations).alias("negation"),
            known(word, rules.contrast).alias("contrast"), loud.alias("loud"),
        )

    def rated(state: Column, w: Column) -> Column:
        way = F.signum(w["value"])
        value = w["value"] + F.when(w["loud"], way * rules.capitals).otherwise(0.0)
        value = value + F.when(state["degree_left"] > 0, way * state["degree"]).otherwise(0.0)
        return value * F.when(state["negation_left"] > 0, rules.negated).otherwise(1.0)

    def step(state: Column, w: Column) -> Column:
        total = state["total"] + F.coalesce(rated(state, w), F.lit(0.0))
        return F.struct(
            F.when(w["contrast"], state["head"] + total).otherwise(state["head"]).alias("head"),
            F.when(w["contrast"], 0.0).otherwise(total).alias("total"),
            (state["turned"] | w["contrast"]).alias("turned"),
            F.coalesce(w["degree"], state["degree"]).alias("degree"),
            F.when(w["degree"].isNotNull(), rules.reach).otherwise(state["degree_left"] - 1).alias("degree_left"),
            F.when(w["negation"], rules.reach).otherwise(state["negation_left"] - 1).alias("negation_left"),
        )

    start = F.struct(
        F.lit(0.0).alias("head"), F.lit(0.0).alias("total"), F.lit(False).alias("turned"), F.lit(0.0).alias("degree"),
        F.lit(0).alias("degree_left"), F.lit(0).alias("negation_left"),
    )
    end = lambda s: F.when(s["turned"], s["head"] * rules.before + s["total"] * rules.after).otherwise(s["total"])
    tokens = F.transform(F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 0), token)
    louder = F.least(F.regexp_count(t, F.lit("!")), F.lit(rules.marks)) * rules.mark
    return let(F.aggregate(tokens, start, step, end), lambda s: s + F.signum(s) * louder)


def lexicon_rules_score(text, lexicon: dict, rules: Rules = Rules(), alpha: float = LEXICON_ALPHA) -> Column:
    """The sum squashed to (-1, 1)."""
    return let(lexicon_rules_sum(text, lexicon, rules), lambda s: s / F.sqrt(s * s + F.lit(float(alpha))))
