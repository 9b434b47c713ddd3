"""Numbers as text. Rounding is half-even, as `bround` does and `format_string` does not."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def percent_of(n, d) -> Column:
    """`n/d` as a whole percent, `n/a` when `d` is 0."""
    share = F.try_divide(_col(n).cast("double"), _col(d).cast("double")) * 100
    return F.when(_col(d) == 0, "n/a").otherwise(F.format_string("%.0f%%", F.bround(share, 0)))


def whole_percent(share) -> Column:
    return F.format_string("%.0f%%", F.bround(_col(share) * 100, 0))


def thousands(c) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(F.bround(_col(c).cast("double"), 0), 0)


def one_decimal(c) -> Column:
    return F.format_string("%.1f", F.bround(_col(c), 1))


def x_of_y(x, y) -> Column:
    return F.concat(thousands(x), F.lit(" of "), thousands(y))
