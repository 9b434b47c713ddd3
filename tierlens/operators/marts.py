"""Answers read from the cube: filters, roll-ups, bands, rankings, product pages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BANDS, CATEGORY_LEVELS, TIER_LABELS, TITLE_LIMIT
from ..functions import display, parsing, text
from ..sources.io import written
from .skew import lookup

COUNTS = ("positive", "negative", "neutral", "total")


def _sums(df: DataFrame, *by) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTS])


def _share(count: str, total: str = "total") -> Column:
    """Zero when there is nothing to share."""
    return F.col(count) / F.greatest(F.col(total), F.lit(1))


def _with_shares(df: DataFrame, *polarities) -> DataFrame:
    return df.withColumns({f"{p}_share": _share(p) for p in polarities})


# Filters


def cascade_filter(df: DataFrame, *choices, levels=CATEGORY_LEVELS, all_drops_null: bool = True) -> DataFrame:
    """Category path filter; a None choice means "All" at that level."""
    choices = list(choices) + [None] * (len(levels) - len(choices))
    for level, choice in zip(levels, choices):
        if choice is not None:
            df = df.where(F.col(level) == choice)
        elif all_drops_null:
            df = df.where(F.col(level).isNotNull())
    return df


def cascade_options(df: DataFrame, *choices, levels=CATEGORY_LEVELS) -> DataFrame:
    """Sorted choices of the level below the chosen path."""
    level = levels[len(choices)]
    scoped = cascade_filter(df, *choices, levels=levels[: len(choices)])
    return scoped.select(level).na.drop().distinct().orderBy(level)


def all_cascade_options(df: DataFrame, levels=CATEGORY_LEVELS) -> DataFrame:
    """Every level's choices under every path, in one pass."""
    paths = [
        F.struct(
            F.lit(i + 1).alias("level"),
            F.concat_ws("|", *levels[:i]).alias("parent"),
            F.col(level).alias("choice"),
            F.array(*[F.col(c) for c in levels[: i + 1]]).alias("path"),
        )
        for i, level in enumerate(levels)
    ]
    rows = df.select(*levels).distinct().select(F.inline(F.array(*paths)))
    known = F.forall("path", lambda c: c.isNotNull())
    return rows.where(known).select("level", "parent", "choice").distinct()


def tier_filter(df: DataFrame, tiers) -> DataFrame:
    """Rows of the selected tiers; nothing selected means no filter."""
    return df.where(F.col("discount_group").isin(*tiers)) if tiers else df


# Roll-ups


def overall_split(df: DataFrame) -> DataFrame:
    """Grand totals and shares; one row."""
    out = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS])
    return _with_shares(out, "positive", "neutral", "negative")


def by_aspect(df: DataFrame) -> DataFrame:
    out = _with_shares(_sums(df, "aspect"), "positive", "neutral", "negative")
    return out.orderBy(F.desc("total"), "aspect")


def by_tier(df: DataFrame, tiers=TIER_LABELS) -> DataFrame:
    """Per tier, in tier order, with shares in percent."""
    out = _sums(df.where("discount_group is not null"), "discount_group")
    for label in ("Positive", "Neutral", "Negative"):
        out = out.withColumn(label, _share(label.lower()) * 100)
    return out.orderBy(parsing.tier_rank("discount_group", tiers))


def by_tier_long(df: DataFrame) -> DataFrame:
    """The chart form: one row per tier and sentiment."""
    shares = ["Positive", "Neutral", "Negative"]
    return by_tier(df).unpivot(["discount_group", "total"], shares, "Sentiment", "Share")


def sentiment_shape(df: DataFrame, order=("Positive", "Neutral", "Negative")) -> DataFrame:
    """Three rows: sentiment, mentions, share, in the order given."""
    total = overall_split(df)
    rows = [
        F.struct(
            F.lit(i).alias("rank"),
            F.lit(s).alias("Sentiment"),
            F.col(s.lower()).alias("Mentions"),
            F.col(f"{s.lower()}_share").alias("Share"),
        )
        for i, s in enumerate(order)
    ]
    return total.select(F.inline(F.array(*rows)))


def products_in_scope(df: DataFrame, by=(), approximate: bool = False) -> DataFrame:
    """Distinct products; `approximate` trades exactness for one small sketch per task."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(*by).agg(count("product_id").alias("products"))


def complaint_ranking(df: DataFrame, n: int = 5) -> DataFrame:
    """Aspects by negative mentions, with the negative share of each."""
    out = _with_shares(_sums(df, "aspect"), "negative").select("aspect", "negative", "negative_share")
    return out.orderBy(F.desc("negative"), "aspect").limit(n)


def discount_drivers(df: DataFrame, tiers=BANDS["High"], n: int = 5) -> DataFrame:
    """Among highly discounted products, the aspects with the largest negative share."""
    high = df.where(F.col("discount_group").isin(*tiers))
    out = _with_shares(_sums(high, "aspect"), "negative").select("aspect", "negative", "negative_share")
    return out.orderBy(F.desc("negative_share"), "aspect").limit(n)


def _top(value: Column, key: str, what: Column) -> Column:
    """`what` of the row with the largest value, ties to the least key."""
    return F.min_by(what, F.struct(-value, F.col(key)))


def top_aspects(df: DataFrame, by=()) -> DataFrame:
    """Per scope the aspect with the largest negative share and the one with the largest positive."""
    aspects = _sums(df, *by, "aspect")
    picks = []
    for p in ("negative", "positive"):
        picks.append(_top(_share(p), "aspect", F.col("aspect")).alias(f"top_{p}_aspect"))
        picks.append(F.max(_share(p)).alias(f"top_{p}_share"))
    return aspects.groupBy(*by).agg(*picks)


# Low against high discount


def band(bands) -> Column:
    """The discount band of a tier, null outside all."""
    out = None
    for name, tiers in bands.items():
        hit = F.col("discount_group").isin(*tiers)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def band_summary(df: DataFrame, bands=BANDS, by=(), products: DataFrame | None = None) -> DataFrame:
    """One row per discount band with mentions: totals, shares, products, worst aspect.

    One pass over the cube counts per band and per band and aspect, and products once per task
    before they meet, so no band is gathered in one task. A band without mentions has no row.
    With `products` (by, band, products) these are taken from there, and `df` needs no products.
    """
    by = list(by)
    rows = df.withColumn("band", band(bands)).where("band is not null")
    columns = [*by, "band", "aspect"]
    sets = [[F.col(c) for c in columns], [F.col(c) for c in columns[:-1]]]
    counts = rows.groupingSets(sets, *columns).agg(
        F.grouping("aspect").alias("_whole"),
        *[F.sum(c).cast("bigint").alias(c) for c in COUNTS],
        (F.count_distinct("product_id") if products is None else F.lit(0)).alias("products"),
    )
    whole = F.col("_whole") == 1
    worst = F.min(F.when(~whole, F.struct((-_share("negative")).alias("share"), "aspect")))
    out = counts.groupBy(*by, "band").agg(
        *[F.max(F.when(whole, F.col(c))).alias(c) for c in (*COUNTS, "products")], worst.alias("_worst")
    ).where("total > 0").withColumns(
        {"top_neg_aspect": F.col("_worst.aspect"), "top_neg_aspect_share": -F.col("_worst.share")}
    )
    if products is not None:
        out = lookup(out.drop("products"), written(products, "products"), [*by, "band"])
    return out.select(
        *by, "band", "total", F.coalesce("products", F.lit(0)).alias("products"),
        F.col("positive").alias("pos"), F.col("neutral").alias("neu"), F.col("negative").alias("neg"),
        (F.col("positive") / F.col("total")).alias("pos_share"),
        (F.col("neutral") / F.col("total")).alias("neu_share"),
        (F.col("negative") / F.col("total")).alias("neg_share"),
        "top_neg_aspect", "top_neg_aspect_share",
    )


def band_gap(summary: DataFrame, by=(), low: str = "Low", high: str = "High") -> DataFrame:
    """Points of negative share between the bands and the verdict; only where both bands exist."""
    share = lambda b: F.max(F.when(F.col("band") == b, F.col("neg_share")))
    out = summary.groupBy(*by).agg(share(low).alias("low_share"), share(high).alias("high_share"))
    gap = (F.col("high_share") - F.col("low_share")) * 100
    verdict = F.when(F.col("gap") > 1, "more negative").when(F.col("gap") < -1, "less negative")
    return (
        out.where("low_share is not null and high_share is not null")
        .withColumn("gap", gap)
        .withColumn("verdict", verdict.otherwise("about the same"))
    )


# Product page


def product_search(products: DataFrame, pattern: str | None) -> DataFrame:
    """Products whose name matches a case-insensitive regular expression; missing names do not."""
    if not pattern:
        return products
    return products.where(F.coalesce(F.col("product_name").rlike(f"(?i){pattern}"), F.lit(False)))


def product_picker(products: DataFrame) -> DataFrame:
    """Picker entries by name. Of products that share a label the last in name order is kept."""
    label = text.picker_label("product_name", "product_id")
    picked = products.withColumn("label", label).groupBy("label").agg(
        F.max(F.struct("product_name", "product_id")).alias("_p")
    )
    return picked.select("label", "_p.product_name", "_p.product_id").orderBy("product_name", "product_id")


def product_row(products: DataFrame, product_id: str) -> DataFrame:
    return products.where(F.col("product_id") == product_id)


def product_breakdown(cube: DataFrame, product_id: str | None = None) -> DataFrame:
    """A product's mentions and shares per aspect, most mentioned first; every product, unsorted, when none is named."""
    rows = cube if product_id is None else product_row(cube, product_id)
    out = _with_shares(_sums(rows, "product_id", "aspect"), "positive", "negative").select(
        "product_id", "aspect", F.col("total").alias("mentions"), "positive_share", "negative_share"
    )
    return out if product_id is None else out.orderBy(F.desc("mentions"), "aspect")


def product_card(products: DataFrame) -> DataFrame:
    """Heading, breadcrumb, titles and text of a product page."""
    name = text.strip("product_name")
    return products.select(
        "product_id",
        text.shorten("product_name").alias("heading"),
        F.when(F.length(name) > TITLE_LIMIT, name).alias("full_name"),
        text.category_crumbs("category").alias("crumbs"),
        text.has_text("review_title").alias("has_titles"),
        text.has_text("review_content").alias("has_content"),
        F.array_join(text.split_titles("review_title"), "\n").alias("titles"),
        text.strip_urls("review_content").alias("content"),
    )


def product_metrics(products: DataFrame) -> DataFrame:
    """The page's figures as text."""
    return products.select(
        "product_id",
        display.thousands("discounted_price").alias("discounted"),
        F.concat(F.lit("-"), F.col("discount_percentage").cast("string"), F.lit("%")).alias("delta"),
        display.thousands("actual_price").alias("actual"),
        F.concat(display.one_decimal("rating"), F.lit(" ★")).alias("stars"),
        F.concat(display.thousands("rating_count"), F.lit(" ratings")).alias("ratings"),
        F.coalesce("discount_group", F.lit("nan")).alias("tier"),
    )


def headline_metrics(df: DataFrame) -> DataFrame:
    """The overview's figures as text: mentions, and each sentiment as `x of y` with its percent."""
    out = overall_split(df)
    cols = [display.thousands("total").alias("mentions")]
    for p in ("positive", "neutral", "negative"):
        cols.append(display.x_of_y(p, "total").alias(f"{p}_of_total"))
        cols.append(display.whole_percent(f"{p}_share").alias(f"{p}_percent"))
    return out.select(*cols)


def aspect_display(df: DataFrame) -> DataFrame:
    """The aspect table as text."""
    return by_aspect(df).select(
        "aspect",
        display.thousands("total").alias("mentions"),
        *[display.whole_percent(f"{p}_share").alias(p) for p in ("positive", "neutral", "negative")],
    )
