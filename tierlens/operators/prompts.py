"""Prompt text as tables: one data block per scope, one review block per product, one request
per conversation, and what the requests cost. Nothing here calls a model."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as k
from ..functions import display, text
from ..sources.io import written
from . import tokens
from .cube import scope_products, scope_rollup
from .marts import COUNTS
from .skew import next_value

SCOPE = ("scope_key", "scope")


def _line(name: str) -> Column:
    parts = [display.percent_of(p, "total") for p in ("positive", "neutral", "negative")]
    return F.format_string(k.CONTEXT_LINE, F.col(name), F.col("total"), *parts)


def _context(aspects: DataFrame, tiers: DataFrame, totals: DataFrame, all_tiers, note: str) -> DataFrame:
    """Join the three parts per scope. A scope has one line per aspect and tier, so lists stay short."""
    ordered = lambda *by: F.array_sort(F.collect_list(F.struct(*by)))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["line"]), "\n")
    a = aspects.withColumn("line", _line("aspect")).groupBy(*SCOPE).agg(
        joined(ordered((-F.col("total")).alias("rank"), "aspect", "line")).alias("_aspects")
    )
    t = tiers.withColumn("line", _line("discount_group")).groupBy(*SCOPE).agg(
        ordered("discount_group", "line").alias("_lines")
    )
    t = t.select(
        *SCOPE, joined("_lines").alias("_tiers"),
        F.transform("_lines", lambda x: x["discount_group"]).alias("_present"),
    )
    absent = F.array_except(F.array(*[F.lit(x) for x in all_tiers]), F.col("_present"))
    names = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("none"))
    body = F.concat(
        F.format_string(k.CONTEXT_HEADER, F.col("scope"), F.col("products"), F.col("mentions")),
        F.format_string(k.CONTEXT_TIERS, names(F.col("_present")), F.lit(note), names(absent)),
        F.format_string(k.CONTEXT_BODY, F.col("_aspects"), F.col("_tiers")),
    )
    out = totals.join(a, list(SCOPE)).join(t, list(SCOPE))
    return out.select(*SCOPE, "products", "mentions", body.alias("context"))


def _named_scope(df: DataFrame, levels) -> DataFrame:
    return df.withColumn("scope_key", F.concat_ws("|", *levels)).withColumn(
        "scope", text.breadcrumb(*levels)
    )


def scope_contexts(
    cube: DataFrame, levels=k.CATEGORY_LEVELS, all_tiers=k.TIER_LABELS, note: str = k.ABSENT_NOTE
) -> DataFrame:
    """The data block of every category scope at once."""
    aspects = _named_scope(scope_rollup(cube, ("aspect",), levels), levels)
    tiers = _named_scope(scope_rollup(cube, ("discount_group",), levels), levels)
    totals = _named_scope(scope_products(cube, levels), levels)
    return _context(aspects, tiers, totals, all_tiers, note)


def build_context(filtered: DataFrame, label: str, all_tiers=k.TIER_LABELS, note: str = k.ABSENT_NOTE) -> DataFrame:
    """The data block of one filtered cube; one row, also when nothing is left."""
    rows = filtered.withColumn("scope_key", F.lit("")).withColumn("scope", F.lit(label))
    sums = [F.sum(c).cast("bigint").alias(c) for c in COUNTS]
    totals = rows.groupBy(*SCOPE).agg(
        F.count_distinct("product_id").alias("products"), F.sum("total").cast("bigint").alias("mentions")
    )
    block = _context(
        rows.groupBy(*SCOPE, "aspect").agg(*sums),
        rows.groupBy(*SCOPE, "discount_group").agg(*sums),
        totals, all_tiers, note,
    )
    return block.agg(F.coalesce(F.max("context"), F.lit(k.CONTEXT_EMPTY)).alias("context"))


def summary_prompts(contexts: DataFrame, task: str = k.SUMMARY_TASK, role: str = k.ANALYST_ROLE) -> DataFrame:
    """One summary request per scope."""
    prompt = F.concat(F.col("context"), F.lit(f"\n\n{task}"))
    return contexts.select(*SCOPE, F.lit(role).alias("system"), prompt.alias("prompt"))


def review_prompts(
    products: DataFrame, task: str = k.REVIEW_TASK, role: str = k.REVIEW_ROLE, size: int = k.REVIEW_BLOB_LIMIT
) -> DataFrame:
    """Pros-and-cons requests: a product's review text in numbered parts of `size` characters, nothing left out."""
    pieces = text.parts(text.review_blob("review_title", "review_content"), size)
    name = F.coalesce("product_name", F.lit(""))
    rows = products.select("product_id", name.alias("_name"), F.posexplode_outer(pieces).alias("part", "_piece"))
    prompt = F.concat(F.lit("Product: "), F.col("_name"), F.lit("\n\n"), F.col("_piece"), F.lit(f"\n\n{task}"))
    return rows.select("product_id", "part", F.lit(role).alias("system"), prompt.alias("prompt"))


def answered_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Turns without the earlier user turns that no assistant turn follows; the open question at the end stays."""
    rows = next_value(turns, [key], order, "role", "_reply")
    answered = (F.col("role") != "user") | F.col("_reply").isNull() | (F.col("_reply") == "assistant")
    return rows.where(answered).drop("_reply")


def chat_system(context: Column, role: str = k.ANALYST_ROLE) -> Column:
    return F.concat(F.lit(f"{role}\n\nData for the current selection:\n"), context)


def chat_requests(
    turns: DataFrame, system: Column, key: str = "conv_id", order: str = "turn", content: str = "text"
) -> DataFrame:
    """The messages of each conversation's request: the system message at -1, then the history.

    One row per message, so a conversation of any length stays spread over tasks.
    """
    history = answered_turns(turns, key, order).select(
        key, F.col(order).cast("bigint").alias("turn"), "role", F.col(content).alias("content")
    )
    first = turns.select(key).distinct().select(
        key, F.lit(-1).cast("bigint").alias("turn"), F.lit("system").alias("role"), system.alias("content")
    )
    return first.unionByName(history)


def pack_messages(requests: DataFrame, key: str = "conv_id", size: int = 256) -> DataFrame:
    """Messages as arrays in turn order, `size` turns to a part, so no array grows without bound."""
    part = F.floor((F.col("turn") + 1) / size).cast("bigint").alias("part")
    message = F.struct("turn", "role", "content")
    return requests.groupBy(key, part).agg(F.array_sort(F.collect_list(message)).alias("messages"))


# Cost


def token_estimate(c) -> Column:
    """Tokens of a text without a vocabulary, taken as one per four characters."""
    return F.ceil(F.length(c) / 4).cast("int")


def typed(prompts: DataFrame, query_type: str, kind: str) -> DataFrame:
    """Prompts with what they are for; output sizes come from the request kind."""
    typical, cap = k.OUT_TOKENS[kind]
    return prompts.select(
        F.lit(query_type).alias("query_type"), F.lit(kind).alias("kind"), "system", "prompt",
        F.lit(typical).alias("out_typ"), F.lit(cap).alias("out_cap"),
    )


def request_sizes(requests: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """Typed prompts with `in_tok`, their true tokens for a vocabulary of ranks, or an estimate without one."""
    keep = ["query_type", "kind", "in_tok", "out_typ", "out_cap"]
    if ranks is None:
        return requests.withColumn("in_tok", token_estimate("system") + token_estimate("prompt")).select(*keep)
    rows = written(requests.withColumn("_row", F.monotonically_increasing_id()), "requests")
    texts = rows.select("_row", F.explode(F.array("system", "prompt")).alias("text"))
    counts = tokens.count_tokens(texts, "text", ["_row"], ranks, "in_tok")
    return rows.join(counts.withColumn("in_tok", F.col("in_tok").cast("int")), "_row").select(*keep)


def with_cost(
    requests: DataFrame, price_in: float = k.PRICE_IN, price_out: float = k.PRICE_OUT,
    first_token: float = k.FIRST_TOKEN_SECONDS, rate: float = k.TOKENS_PER_SECOND,
) -> DataFrame:
    """Dollars and seconds per request, typical and at the output cap.

    Preparation times come from `prep_ms_mean` and `prep_ms_max` where the table has them.
    """
    prep = lambda c: F.col(c) / 1000 if c in requests.columns else F.lit(0.0)
    usd = lambda out: F.col("in_tok") / 1e6 * price_in + F.col(out) / 1e6 * price_out
    return requests.withColumns(
        {
            "cost": usd("out_typ"),
            "cost_capped": usd("out_cap"),
            "seconds": prep("prep_ms_mean") + first_token + F.col("out_typ") / rate,
            "seconds_worst": prep("prep_ms_max") + first_token + F.col("out_cap") / rate,
        }
    )


def cost_projection(costs: DataFrame, scales=k.MONTHLY_SCALES) -> DataFrame:
    """Blended cost, an equal mix of the request kinds, at each monthly scale.

    A query that takes several requests, such as a long review in parts, costs their sum.
    """
    queries = costs.groupBy("kind", "query_type").agg(F.sum("cost").alias("cost"))
    kinds = queries.groupBy("kind").agg(F.avg("cost").alias("cost"))
    blended = kinds.agg(F.avg("cost").alias("blended"))
    monthly = F.explode(F.array(*[F.lit(s) for s in scales])).alias("queries_per_month")
    return blended.select("blended", monthly).withColumn(
        "dollars_per_month", F.col("blended") * F.col("queries_per_month")
    )


def time_summary(samples: DataFrame, by: str = "query_type", value: str = "ms") -> DataFrame:
    """Mean and maximum of measured times."""
    return samples.groupBy(by).agg(
        F.avg(value).alias("prep_ms_mean"), F.max(value).alias("prep_ms_max")
    )
