"""Fixed values the operators take as defaults. Every one is a parameter somewhere."""

from pyspark.sql import types as T

# Tracked aspects and their keywords, in matching priority order.
ASPECT_KEYWORDS = {
    "battery": ("battery", "charge", "charging", "power", "backup"),
    "quality": ("quality", "build", "material", "cheap", "premium"),
    "performance": ("performance", "speed", "fast", "slow", "lag", "smooth"),
    "durability": ("durable", "durability", "broke", "broken", "stopped working", "lasted"),
    "delivery": ("delivery", "shipping", "arrived", "package", "packaging"),
    "value": ("price", "worth", "value", "money", "cost", "expensive", "cheap"),
    "sound": ("sound", "bass", "volume", "audio", "noise"),
}

# Complaint and negation cues; trailing spaces are part of the cue.
COMPLAINT_CUES = (
    "not", "no ", "n't", "never", "but ", "however", "issue", "issues", "problem",
    "problems", "poor", "bad", "worst", "worse", "broke", "broken", "stopped",
    "stop working", "fails", "failed", "fault", "faulty", "defect", "defective",
    "damaged", "damage", "disappoint", "waste", "return", "refund", "useless",
    "overpriced", "expensive", "costly", "slow", "lag", "drain", "drains", "heats",
    "heating", "hot ", "cheap", "flimsy", "doesn", "didn", "won't", "wont", "can't",
    "cant", "not worth", "stopped working", "dead", "died", "loose", "missing",
)

# Sentiment classes. The cube order and the evaluation order differ.
POLARITIES = ("positive", "negative", "neutral")
LABEL_ORDER = ("negative", "neutral", "positive")

# Discount tiers as (label, upper percent), right-closed, lowest edge 0 included.
DISCOUNT_TIERS = (("0-15%", 15), ("15-30%", 30), ("30-50%", 50), ("50%+", 100))
TIER_LABELS = tuple(label for label, _ in DISCOUNT_TIERS)
BANDS = {"Low": ("0-15%", "15-30%"), "High": ("30-50%", "50%+")}

# Top-level categories in scope.
ALLOWED_MAIN_CATEGORIES = ("Electronics", "Computers&Accessories")

# Strings a CSV reader treats as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# The code points a Unicode-aware `\s` stands for (Java's own set differs).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# Characters that cleaned text keeps, and those that make up a word. Listed one by one:
# Java looks single characters up in a table but tries ranges in turn, ten times slower.
KEPT_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789.,!?'"
WORD_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789'"

# Mining limits, gates, sampling, and display widths.
MIN_SENTENCE, MAX_SENTENCE = 25, 220
MAX_CUE_DISTANCE = 60
PER_ASPECT_CAP = 40
ACCURACY_TARGET, NEGATIVE_RECALL_TARGET = 0.70, 0.60
SEED, TEST_SIZE = 42, 0.2
SPAN_CONTEXT = 3
TITLE_LIMIT, PICKER_LIMIT, REVIEW_BLOB_LIMIT = 70, 90, 6000
LEXICON_POSITIVE, LEXICON_NEGATIVE, LEXICON_ALPHA = 0.05, -0.05, 15.0

# Dollars per million tokens, seconds to first token, tokens per second,
# (typical, capped) output tokens per request kind, monthly request scales.
PRICE_IN, PRICE_OUT = 0.15, 0.60
FIRST_TOKEN_SECONDS, TOKENS_PER_SECOND = 0.5, 80.0
OUT_TOKENS = {"summary": (220, 350), "product": (260, 400), "chat": (200, 500)}
MONTHLY_SCALES = (100, 1000, 10000)

# The lines of a scope's data block and of a product's review block.
CONTEXT_EMPTY = "No data in the current filter."
CONTEXT_HEADER = "Scope: %s\nProducts in scope: %d; total aspect mentions: %d\n"
CONTEXT_TIERS = "Discount tiers PRESENT here: %s.\nDiscount tiers ABSENT here (%s): %s.\n"
CONTEXT_BODY = "\nSentiment by aspect:\n%s\n\nSentiment by discount tier:\n%s"
CONTEXT_LINE = "- %s: %d mentions, %s positive, %s neutral, %s negative"

# Default wording of the requests; every function that uses one takes another.
ABSENT_NOTE = "leave them out of every comparison"
ANALYST_ROLE = (
    "You answer questions about review sentiment and price discounts. Use only the counts in the "
    "data block and quote their percentages. Say nothing about a discount tier listed as absent; "
    "with a single tier present, say that discounts cannot be compared."
)
SUMMARY_TASK = (
    "Summarise this selection in three markdown bullets: a pattern across aspects that the "
    "largest complaint and the overall split do not show, how negative sentiment moves across "
    "the tiers that are present, and one thing to act on. Give the numbers."
)
REVIEW_ROLE = (
    "You sum up customer reviews of one product. They come joined together with stray commas and "
    "links; skip that noise and report only what reviewers say."
)
REVIEW_TASK = (
    "List up to four pros and up to four cons as markdown bullets, then a one-sentence verdict. "
    "Say so when there are no complaints."
)

# Column sets.
RAW_COLS = (
    "product_id", "product_name", "category", "discounted_price", "actual_price",
    "discount_percentage", "rating", "rating_count", "review_title", "review_content",
)
KEEP_COLS = (
    "product_id", "product_name", "category", "main_category", "sub_category_1",
    "sub_category_2", "discounted_price", "actual_price", "discount_percentage",
    "rating", "rating_count", "review_title", "review_content",
)
CARRY_COLS = (
    "product_id", "product_name", "main_category", "sub_category_1", "sub_category_2",
    "discount_percentage", "discount_group", "rating",
)
PRODUCT_COLS = (
    "product_id", "product_name", "category", "main_category", "sub_category_1",
    "sub_category_2", "actual_price", "discounted_price", "discount_percentage",
    "discount_amount", "discount_group", "rating", "rating_count", "review_title",
    "review_content",
)
CUBE_KEYS = (
    "product_id", "product_name", "main_category", "sub_category_1", "sub_category_2",
    "discount_group", "aspect",
)
LABEL_COLS = ("text", "span", "polarity", "polarity_predicted", "aspect", "ordinal")
CATEGORY_LEVELS = ("main_category", "sub_category_1", "sub_category_2")

SPAN_LIST = T.ArrayType(
    T.StructType([T.StructField("span", T.StringType()), T.StructField("polarity", T.StringType())])
)
LABEL_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in LABEL_COLS[:-1]]
    + [T.StructField("ordinal", T.IntegerType())]
)
