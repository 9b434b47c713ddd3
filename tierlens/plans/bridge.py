"""The test tables seen as reviews, spans, labels and chats, in Spark and as SQL.

The tables hold invented words, so aspects, cues and valences here are words that do occur in them.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import NA_TOKENS, POLARITIES, WHITESPACE, WS
from ..functions import matching, parsing, text
from ..functions.lexicon import Rules
from ..operators import curate, cube, reviews
from ..sources.io import split_text, written

NOUNS = {
    "battery": ("widget", "bolt"),
    "quality": ("gizmo", "cold"),
    "performance": ("gear", "old"),
    "durability": ("anvil",),
    "value": ("rod", "hot"),
    "sound": ("ring",),
}
WORDS = {
    "battery": ("with", "from"),
    "quality": ("this", "are", "the of"),
    "performance": ("was", "by"),
    "durability": ("and the",),
    "delivery": ("for", "that"),
    "value": ("are", "it"),
    "sound": ("is", "as"),
}
CUES = ("not", "no ", "ed ", "ing", "ha", "th ", "ontion", "rewh", "wh")
VALENCE = {
    "with": 1.5, "this": 0.5, "are": 1.25, "and": 0.25, "from": 2.0, "der": 0.75, "la": 0.5,
    "was": -1.5, "that": -0.75, "by": -2.0, "is": -0.5, "of": -0.25, "que": -1.0, "die": -1.25,
}
#: Rule words that occur in the tables; all amounts are sums of powers of two, so sums are the same in any order.
RULES = Rules(negations=("of", "que", "die"), degrees=(("the", 0.25), ("la", -0.25), ("und", 0.5), ("le", -0.5)), contrast=("and", "et"))
#: A public vocabulary of byte pairs.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAINS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
FEWER_MAINS = ("STANDARD", "PROMO", "SMALL", "LARGE")
ID_STEP, POS_STEP = 1 << 24, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return split_text(table(spark, sf_dir, name), key)


def raw_reviews(spark, sf_dir) -> DataFrame:
    """Documents as reviews of parts, every value still a string."""
    d, p = texts(spark, sf_dir), table(spark, sf_dir, "part")
    n, size, price = F.col("n_chars"), F.col("p_size"), F.col("p_retailprice")
    pct = n % 104 - 1
    fixed = F.concat_ws(
        "|", "p_type", F.when(size % 7 != 0, F.col("p_brand")),
        F.when((size % 7 != 0) & (size % 5 != 0), F.concat(F.lit("size "), F.floor(size / 10).cast("string"))),
    )
    return d.join(p, d["doc_id"] == p["p_partkey"], "left").select(
        F.col("doc_id").alias("row_ord"),
        F.col("source").alias("product_id"),
        F.col("p_name").alias("product_name"),
        fixed.alias("category"),
        F.concat(F.lit("₹"), F.format_number(F.floor(price * (100 - pct) / 100), 0)).alias("discounted_price"),
        F.concat(F.lit("₹"), F.format_number(price, 2)).alias("actual_price"),
        F.concat(pct.cast("string"), F.lit("%")).alias("discount_percentage"),
        F.when(F.contains("text", F.lit(" | ")), "|")
        .when(F.contains("text", F.lit(".")), F.concat_ws(".", n % 4 + 1, n % 10)).alias("rating"),
        F.when(n < 60, None).when(n < 100, "NaN").otherwise(F.format_number(n * 7, 0)).alias("rating_count"),
        F.substring_index("text", "\n", 1).alias("review_title"),
        F.when(n >= 120, F.col("text")).alias("review_content"),
    )


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_clean(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), "
        f"'http[^{WS}]+|www[^{WS}]+', '', 'g'), '<.*?>', '', 'g'), "
        f"'[^a-zA-Z0-9{WS}.,!?'']', ' ', 'g'), '[{WS}]+', ' ', 'g'))"
    )


def sql_sentences(x: str) -> str:
    cut = f"string_split(regexp_replace({x}, '([.!?])[{WS}]+', '\\1' || chr(1), 'g'), chr(1))"
    return f"[trim(x) for x in {cut} if length(trim(x)) > 0]"


def sql_strip(x: str) -> str:
    chars = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
    return f"trim({x}, {chars})"


def sql_tier(x: str) -> str:
    return (
        f"CASE WHEN {x} BETWEEN 0 AND 15 THEN '0-15%' WHEN {x} BETWEEN 16 AND 30 THEN '15-30%' "
        f"WHEN {x} BETWEEN 31 AND 50 THEN '30-50%' WHEN {x} BETWEEN 51 AND 100 THEN '50%+' END"
    )


def sql_number(x: str, drop: str, kind: str) -> str:
    return f"CASE WHEN {x} NOT IN ({_list(NA_TOKENS)}) THEN TRY_CAST(regexp_replace({x}, '{drop}', '', 'g') AS {kind}) END"


def sql_first_aspect(x: str, taxonomy) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({x}), '{k}')" for k in kws) + f" THEN '{a}'"
        for a, kws in taxonomy.items()
    )
    return f"CASE {whens} END"


def sql_compound(x: str) -> str:
    values = ", ".join(f"'{w}': {v}::DOUBLE" for w, v in VALENCE.items())
    words = f"regexp_split_to_array(lower({x}), '[^a-z0-9'']+')"
    total = f"list_sum([coalesce(MAP {{{values}}}[w], 0.0::DOUBLE) for w in {words}])"
    return f"({total} / sqrt({total} * {total} + 15.0::DOUBLE))"


def sql_rules(source: str, key: str, column: str, rules: Rules = RULES) -> str:
    """CTEs down to `ruled` (key, rules_score): word values with the rules, by windows over the tokens of a text."""
    values = ", ".join(f"'{w}': {v}::DOUBLE" for w, v in VALENCE.items())
    degrees = ", ".join(f"'{w}': {v}::DOUBLE" for w, v in rules.degrees)
    near = f"OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN {rules.reach} PRECEDING AND 1 PRECEDING)"
    return f"""tokens AS (
  SELECT {key}, i, w[i] AS raw, lower(regexp_replace(w[i], '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) AS word, plain
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (
    SELECT {key}, [x for x in regexp_split_to_array({column}, '[ \\t\\n\\x0B\\f\\r]+') if len(x) > 0] AS w,
      NOT regexp_matches({column}, '[a-z]') AS plain FROM {source}))),
valued AS (
  SELECT *, MAP {{{values}}}[word] AS v, word IN ({_list(rules.contrast)}) AS contrast,
    last_value(MAP {{{degrees}}}[word] IGNORE NULLS) {near} AS degree,
    coalesce(bool_or(word IN ({_list(rules.negations)})) {near}, false) AS negated,
    NOT plain AND regexp_matches(raw, '^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$') AS loud
  FROM tokens),
rated AS (
  SELECT {key}, i, contrast, (v + CASE WHEN loud THEN sign(v) * {rules.capitals}::DOUBLE ELSE 0 END + coalesce(sign(v) * degree, 0))
    * CASE WHEN negated THEN {rules.negated}::DOUBLE ELSE 1 END AS r FROM valued),
weighed AS (
  SELECT {key}, sum(r * CASE WHEN last IS NULL THEN 1 WHEN i <= last THEN {rules.before}::DOUBLE ELSE {rules.after}::DOUBLE END) AS s
  FROM (SELECT *, max(CASE WHEN contrast THEN i END) OVER (PARTITION BY {key}) AS last FROM rated) GROUP BY {key}),
summed AS (
  SELECT o.{key}, coalesce(s, 0) + sign(coalesce(s, 0)) * least(length({column}) - length(replace({column}, '!', '')), {rules.marks}) * {rules.mark}::DOUBLE AS s
  FROM {source} o LEFT JOIN weighed ON weighed.{key} = o.{key}),
ruled AS (SELECT {key}, s / sqrt(s * s + 15.0::DOUBLE) AS rules_score FROM summed)"""


def sql_tokens(source: str, key: str, column: str) -> str:
    """CTEs down to `counted` (key, n), for WITH RECURSIVE: pieces by a pattern, merged by rank, bytes in hexadecimal.

    The pattern has no look-ahead here, so the last blank of a run before a word is cut off first.
    """
    mark = f"regexp_replace(coalesce({column}, ''), '([{WS}]+)([{WS}][^{WS}])', '\\1' || chr(1) || '\\2', 'g')"
    pattern = f"''s|''t|''re|''ve|''m|''ll|''d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{WS}\\p{{L}}\\p{{N}}]+|[{WS}]+"
    return f"""ranks AS (
  SELECT hex(from_base64(split_part(line, ' ', 1))) AS token, split_part(line, ' ', 2)::INTEGER AS rank
  FROM read_csv('{VOCABULARY}', columns = {{'line': 'VARCHAR'}}, header = false, delim = chr(9), quote = '', escape = '')),
piece_rows AS (
  SELECT {key}, unnest(flatten([regexp_extract_all(x, '{pattern}') for x in string_split({mark}, chr(1))])) AS piece FROM {source}),
merging AS (
  SELECT piece, [substr(h, i, 2) for i in range(1, len(h), 2)] AS t FROM (SELECT piece, hex(encode(piece)) AS h FROM (SELECT DISTINCT piece FROM piece_rows))
  UNION ALL
  SELECT piece, t[:p - 1] || [t[p] || t[p + 1]] || t[p + 2:] FROM (
    SELECT piece, t, arg_min(p, (rank, p)) AS p FROM (SELECT piece, t, unnest(range(1, len(t))) AS p FROM merging) JOIN ranks ON token = t[p] || t[p + 1]
    GROUP BY piece, t)),
lengths AS (SELECT piece, min(len(t)) AS n FROM merging GROUP BY piece),
counted AS (
  SELECT o.{key}, coalesce(sum(lengths.n), 0)::BIGINT AS n
  FROM (SELECT DISTINCT {key} FROM {source}) o LEFT JOIN piece_rows ON piece_rows.{key} = o.{key} LEFT JOIN lengths ON lengths.piece = piece_rows.piece GROUP BY o.{key})"""


def sql_polarity(c: str) -> str:
    return f"CASE WHEN {c} >= 0.05 THEN 'positive' WHEN {c} <= -0.05 THEN 'negative' ELSE 'neutral' END"


RAW = """raw AS (
  SELECT doc_id AS row_ord, source AS product_id, p_name AS product_name,
    concat_ws('|', p_type, CASE WHEN p_size % 7 <> 0 THEN p_brand END,
      CASE WHEN p_size % 7 <> 0 AND p_size % 5 <> 0 THEN 'size ' || (p_size // 10)::VARCHAR END) AS category,
    '₹' || format('{:,}', floor(p_retailprice * (100 - (n_chars % 104 - 1)) / 100)::BIGINT) AS discounted_price,
    '₹' || format('{:,.2f}', p_retailprice) AS actual_price,
    (n_chars % 104 - 1)::VARCHAR || '%' AS discount_percentage,
    CASE WHEN contains(text, ' | ') THEN '|' WHEN contains(text, '.')
      THEN (n_chars % 4 + 1)::VARCHAR || '.' || (n_chars % 10)::VARCHAR END AS rating,
    CASE WHEN n_chars < 60 THEN NULL WHEN n_chars < 100 THEN 'NaN' ELSE format('{:,}', n_chars * 7) END AS rating_count,
    split_part(text, chr(10), 1) AS review_title,
    CASE WHEN n_chars >= 120 THEN text END AS review_content
  FROM documents LEFT JOIN part ON doc_id = p_partkey)"""

PARSED = f"""parsed AS (
  SELECT row_ord, product_id, product_name, category, review_title, review_content,
    {sql_number('discounted_price', '[₹,]', 'DOUBLE')} AS discounted_price,
    {sql_number('actual_price', '[₹,]', 'DOUBLE')} AS actual_price,
    {sql_number('discount_percentage', '%', 'INTEGER')} AS discount_percentage,
    CASE WHEN rating NOT IN ({_list(NA_TOKENS)})
      THEN TRY_CAST(nullif(regexp_replace(rating, '[^0-9.]', '', 'g'), '') AS DOUBLE) END AS rating,
    {sql_number('rating_count', '[₹,]', 'DOUBLE')} AS rating_count,
    split_part(category, '|', 1) AS main_category,
    nullif(split_part(category, '|', 2), '') AS sub_category_1,
    nullif(split_part(category, '|', 3), '') AS sub_category_2
  FROM raw)"""

def sql_clean_reviews(allowed) -> str:
    return f"""clean AS (
  SELECT *, actual_price - discounted_price AS discount_amount, {sql_tier('discount_percentage')} AS discount_group,
    {sql_clean('review_content')} AS clean_review
  FROM parsed WHERE rating IS NOT NULL AND rating_count IS NOT NULL AND main_category IN ({_list(allowed)}))"""


CLEAN = sql_clean_reviews(MAINS)

SENTENCES = f"""sentences AS (
  SELECT product_id, row_ord, (i - 1)::INTEGER AS pos, s[i] AS sentence
  FROM (SELECT product_id, row_ord, s, unnest(range(1, len(s) + 1)) AS i
    FROM (SELECT source AS product_id, doc_id AS row_ord, {sql_sentences(sql_clean('text'))} AS s FROM documents)))"""


def _word_span(i: int, aspect: str, kws) -> str:
    pattern = rf"\b({'|'.join(kws)})\b"
    return (
        f"SELECT *, {i} AS priority, '{aspect}' AS aspect, regexp_extract(sentence, '{pattern}', 1) AS span, "
        f"length(split_part(regexp_replace(sentence, '{pattern}', chr(1)), chr(1), 1))::INTEGER AS start "
        f"FROM sentences WHERE regexp_matches(sentence, '{pattern}')"
    )


WORD_SPANS = "word_spans AS (" + " UNION ALL ".join(
    _word_span(i, a, kws) for i, (a, kws) in enumerate(WORDS.items())
) + ")"

ORDINAL = "((length(left(sentence, start)) - length(replace(left(sentence, start), span, ''))) // length(span))::INTEGER"

SPANS = f"""spans AS (
  SELECT *, {sql_first_aspect('span', NOUNS)} AS aspect, {sql_tier('discount_percentage')} AS discount_group
  FROM (SELECT l_partkey::VARCHAR AS product_id, p_name AS product_name, p_type AS main_category,
    CASE WHEN p_size % 21 <> 0 THEN p_brand END AS sub_category_1,
    CASE WHEN p_size % 7 <> 0 THEN 'size ' || (p_size // 10)::VARCHAR END AS sub_category_2,
    round(l_discount * 1000)::INTEGER AS discount_percentage, p_name AS span,
    CASE WHEN l_returnflag = 'R' THEN 'negative' WHEN l_returnflag = 'A' THEN 'positive'
      WHEN l_linenumber = 7 THEN 'conflict' ELSE 'neutral' END AS polarity
    FROM lineitem JOIN part ON l_partkey = p_partkey)
  WHERE {sql_first_aspect('span', NOUNS)} IS NOT NULL)"""

_COUNTS = """count(*) FILTER (polarity = 'positive') AS positive, count(*) FILTER (polarity = 'negative') AS negative,
  count(*) FILTER (polarity = 'neutral') AS neutral,
  count(*) FILTER (polarity IN ('positive', 'negative', 'neutral')) AS total"""


def sql_counts(source: str, keys: str) -> str:
    inner = f"SELECT {keys}, {_COUNTS} FROM {source} GROUP BY {keys}"
    return (
        f"SELECT *, positive::DOUBLE / nullif(total, 0) AS positive_share, "
        f"negative::DOUBLE / nullif(total, 0) AS negative_share FROM ({inner})"
    )


KEYS = "product_id, product_name, main_category, sub_category_1, sub_category_2, discount_group, aspect"
CUBE = f"""cube AS ({sql_counts('spans WHERE sub_category_1 IS NOT NULL AND sub_category_2 IS NOT NULL '
                                  'AND discount_group IS NOT NULL', KEYS)})"""

GOLD = f"""gold AS (
  SELECT row_ord * {ID_STEP} + pos * {POS_STEP} + priority AS label_id, sentence AS text, span, aspect,
    {ORDINAL} AS ordinal, polarity,
    CASE WHEN length(sentence) % 11 = 0 THEN NULL WHEN length(sentence) % 7 = 0 THEN 'nan'
      WHEN length(sentence) % 5 = 0 THEN ' Neutral' WHEN length(sentence) % 3 = 0 THEN 'negative'
      ELSE polarity END AS polarity_predicted,
    CASE WHEN length(sentence) % 13 = 0 THEN NULL WHEN length(sentence) % 4 = 0 THEN 'positive'
      ELSE polarity END AS polarity_finetuned
  FROM (SELECT *, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS polarity
    FROM word_spans JOIN labels ON row_ord = doc_id))"""


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(names) + "\n"


def clean(spark, sf_dir, allowed=MAINS) -> DataFrame:
    return reviews.clean_reviews(raw_reviews(spark, sf_dir), allowed)


def sentences(spark, sf_dir, docs: DataFrame | None = None, *more: str) -> DataFrame:
    """Every sentence of every document, or of those given, with its place."""
    parts = text.split_sentences(text.clean_text("text"))
    return (
        (texts(spark, sf_dir) if docs is None else docs)
        .select(F.col("source").alias("product_id"), F.col("doc_id").alias("row_ord"), *more, parts.alias("_s"))
        .select("product_id", "row_ord", *more, F.posexplode_outer("_s").alias("pos", "sentence"))
        .where("sentence is not null")
    )


def _line_items(spark, sf_dir) -> DataFrame:
    """Line items with tier and polarity."""
    polarity = (
        F.when(F.col("l_returnflag") == "R", "negative").when(F.col("l_returnflag") == "A", "positive")
        .when(F.col("l_linenumber") == 7, "conflict").otherwise("neutral")
    )
    pct = F.rint(F.col("l_discount") * 1000).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        "l_partkey", parsing.discount_tier(pct).alias("discount_group"), polarity.alias("polarity")
    )


def _on_parts(spark, sf_dir, facts: DataFrame, *columns) -> DataFrame:
    """Facts counted per part, joined to the parts an aspect is tracked for."""
    size = F.col("p_size")
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_type", F.when(size % 21 != 0, F.col("p_brand")).alias("sub_category_1"),
        F.when(size % 7 != 0, F.concat(F.lit("size "), F.floor(size / 10).cast("string"))).alias("sub_category_2"),
        matching.first_aspect("p_name", NOUNS).alias("aspect"),
    ).where("aspect is not null")
    return facts.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").cast("string").alias("product_id"), F.col("p_name").alias("product_name"),
        F.col("p_type").alias("main_category"), "sub_category_1", "sub_category_2", "discount_group",
        "aspect", *columns,
    )


def span_facts(spark, sf_dir) -> DataFrame:
    """Line items as spans on parts, counted per part, tier and polarity before the join."""
    keys = ["l_partkey", "discount_group", "polarity"]
    facts = _line_items(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("n"))
    return _on_parts(spark, sf_dir, facts, F.col("p_name").alias("span"), "polarity", "n")


def span_cube(spark, sf_dir, keep_null_keys: bool = False) -> DataFrame:
    """The cube of the same spans, counted per part and tier before the join: a part that holds a
    large share of the line items is a handful of rows by then."""
    facts = cube.polarity_counts(_line_items(spark, sf_dir), ["l_partkey", "discount_group"])
    return cube.results_cube_from_counts(_on_parts(spark, sf_dir, facts, *POLARITIES), keep_null_keys)


def word_rows(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    rows = sentences(spark, sf_dir) if rows is None else rows
    return rows.select("*", F.inline_outer(matching.word_spans("sentence", WORDS))).where("start is not null")


def label_id() -> Column:
    return F.col("row_ord") * ID_STEP + F.col("pos") * POS_STEP + F.col("priority")


def gold(spark, sf_dir) -> DataFrame:
    """Aspect spans of the labelled documents, with gold and two predicted polarities.

    Documents meet their labels before any text work.
    """
    polarity = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    n = F.length("sentence")
    docs = split_text(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id"), "doc_id")
    rows = word_rows(spark, sf_dir, sentences(spark, sf_dir, docs, "toxic", "quality"))
    return rows.withColumn("polarity", polarity).select(
        label_id().alias("label_id"), F.col("sentence").alias("text"), "span", "aspect",
        matching.count_before("sentence", "span", "start").alias("ordinal"), "polarity",
        F.when(n % 11 == 0, None).when(n % 7 == 0, "nan").when(n % 5 == 0, " Neutral")
        .when(n % 3 == 0, "negative").otherwise(F.col("polarity")).alias("polarity_predicted"),
        F.when(n % 13 == 0, None).when(n % 4 == 0, "positive").otherwise(F.col("polarity")).alias("polarity_finetuned"),
    )


def gold_table(spark, sf_dir) -> DataFrame:
    """The same as a written table, for queries that read it more than once."""
    return written(gold(spark, sf_dir), "gold")


def candidates(spark, sf_dir) -> DataFrame:
    """Cue sentences with aspect spans as a hand-reviewed sheet: most rows kept as guessed,
    some with another polarity, some spoiled. Repeats and labelled sentences are still in it."""
    rows = curate.keyword_cue_distance(curate.sentence_cues(sentences(spark, sf_dir), CUES), CUES, WORDS)
    n = F.length("sentence")
    return rows.select(
        (-label_id() - 1).alias("label_id"), F.col("sentence").alias("text"),
        F.when(n % 13 == 0, F.concat("span", F.lit("zz"))).when(n % 6 == 0, F.substring("span", 1, 2))
        .otherwise(F.col("span")).alias("span"),
        F.when(n % 29 == 0, "bogus").when(n % 7 == 0, "Positive ").when(n % 5 == 0, "neutral")
        .otherwise("negative").alias("polarity"),
        "ordinal", "aspect",
    )
