"""Queries that build prompt text and its cost."""

from pyspark.sql import functions as F

from .. import constants as k
from ..functions import text
from ..operators import marts, profile, prompts, tokens
from ..sources.io import written
from . import bridge as b
from .registry import query

_TIERS = "['0-15%', '15-30%', '30-50%', '50%+']"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _pct(p: str) -> str:
    return f"CASE WHEN total = 0 THEN 'n/a' ELSE format('{{:.0f}}%', {p}::DOUBLE / total * 100) END"


def _line(name: str) -> str:
    return (
        f"format('- {{}}: {{}} mentions, {{}} positive, {{}} neutral, {{}} negative', {name}, total, "
        f"{_pct('positive')}, {_pct('neutral')}, {_pct('negative')})"
    )


_SUMS = "sum(positive) AS positive, sum(negative) AS negative, sum(neutral) AS neutral, sum(total)::BIGINT AS total"
SCOPED = """scoped AS (
  SELECT *, '' AS scope_key, 'All categories' AS scope FROM cube
  UNION ALL SELECT *, main_category, main_category FROM cube
  UNION ALL SELECT *, main_category || '|' || sub_category_1, main_category || ' › ' || sub_category_1 FROM cube
  UNION ALL SELECT *, main_category || '|' || sub_category_1 || '|' || sub_category_2,
    main_category || ' › ' || sub_category_1 || ' › ' || sub_category_2 FROM cube)"""


def _contexts(source: str, name: str = "contexts") -> str:
    return f"""{name} AS (
  WITH a AS (SELECT scope_key, scope, string_agg(line, chr(10) ORDER BY total DESC, aspect) AS lines
    FROM (SELECT *, {_line('aspect')} AS line FROM (SELECT scope_key, scope, aspect, {_SUMS} FROM {source} GROUP BY ALL))
    GROUP BY scope_key, scope),
  t AS (SELECT scope_key, scope, string_agg(line, chr(10) ORDER BY discount_group) AS lines,
      list(discount_group ORDER BY discount_group) AS present
    FROM (SELECT *, {_line('discount_group')} AS line
      FROM (SELECT scope_key, scope, discount_group, {_SUMS} FROM {source} GROUP BY ALL)) GROUP BY scope_key, scope),
  n AS (SELECT scope_key, scope, count(DISTINCT product_id) AS products, sum(total)::BIGINT AS mentions
    FROM {source} GROUP BY scope_key, scope)
  SELECT scope_key, scope, products, mentions,
    'Scope: ' || scope || chr(10) || 'Products in scope: ' || products || '; total aspect mentions: ' || mentions || chr(10)
    || 'Discount tiers PRESENT here: ' || array_to_string(present, ', ') || '.' || chr(10)
    || 'Discount tiers ABSENT here (leave them out of every comparison): '
    || coalesce(nullif(array_to_string([x for x in {_TIERS} if NOT list_contains(present, x)], ', '), ''), 'none') || '.' || chr(10)
    || chr(10) || 'Sentiment by aspect:' || chr(10) || a.lines || chr(10) || chr(10)
    || 'Sentiment by discount tier:' || chr(10) || t.lines AS context
  FROM n JOIN a USING (scope_key, scope) JOIN t USING (scope_key, scope))"""


ALL = b.ctes(b.SPANS, b.CUBE, SCOPED, _contexts("scoped"))


@query(ALL + "SELECT * FROM contexts")
def scope_context(spark, sf_dir):
    return prompts.scope_contexts(b.span_cube(spark, sf_dir))


_HIGH_LABEL = "PROMO | tiers: 30-50%, 50%+"


@query(b.ctes(b.SPANS, b.CUBE, f"""picked AS (
  SELECT *, '' AS scope_key, '{_HIGH_LABEL}' AS scope FROM cube
  WHERE main_category = 'PROMO' AND discount_group IN ('30-50%', '50%+'))""", _contexts("picked")) + "SELECT context FROM contexts")
def filtered_context(spark, sf_dir):
    tiers = ("30-50%", "50%+")
    rows = marts.tier_filter(marts.cascade_filter(b.span_cube(spark, sf_dir), "PROMO"), tiers)
    return prompts.build_context(rows, _HIGH_LABEL)


@query(b.ctes(b.SPANS, b.CUBE) + """
SELECT main_category, main_category || ' | tiers: none' AS scope_label, count(DISTINCT discount_group) AS tiers
FROM cube GROUP BY main_category""")
def scope_labels(spark, sf_dir):
    tiers = b.span_cube(spark, sf_dir).groupBy("main_category").agg(F.count_distinct("discount_group").alias("tiers"))
    label = text.scope_label(text.breadcrumb("main_category"), ())
    return tiers.select("main_category", label.alias("scope_label"), "tiers")


@query(ALL + f"""
SELECT scope_key, scope, {_text(k.ANALYST_ROLE)} AS system,
  context || chr(10) || chr(10) || {_text(k.SUMMARY_TASK)} AS prompt FROM contexts""")
def summary_prompt(spark, sf_dir):
    return prompts.summary_prompts(prompts.scope_contexts(b.span_cube(spark, sf_dir)))


_BLOB = b.sql_strip("'Review titles: ' || coalesce(review_title, '') || chr(10) || chr(10) || 'Review text: ' || coalesce(review_content, '')")
REVIEWS = f"""review_prompts AS (
  SELECT product_id, part::INTEGER AS part, {_text(k.REVIEW_ROLE)} AS system,
    'Product: ' || coalesce(product_name, '') || chr(10) || chr(10) || substring(blob, (part * 6000 + 1)::BIGINT, 6000)
      || chr(10) || chr(10) || {_text(k.REVIEW_TASK)} AS prompt, size
  FROM (SELECT *, unnest(range(0, greatest(1, ceil(length(blob) / 6000)::BIGINT))) AS part
    FROM (SELECT row_ord::VARCHAR AS product_id, product_name, {_BLOB} AS blob,
      length(coalesce(review_content, ''))::INTEGER AS size FROM clean)))"""


def _products(spark, sf_dir):
    return b.clean(spark, sf_dir).withColumn("product_id", F.col("row_ord").cast("string"))


@query(b.ctes(b.RAW, b.PARSED, b.CLEAN, REVIEWS) + "SELECT product_id, part, system, prompt FROM review_prompts")
def review_prompt(spark, sf_dir):
    return prompts.review_prompts(_products(spark, sf_dir))


_SYSTEM = f"{_text(k.ANALYST_ROLE)} || chr(10) || chr(10) || 'Data for the current selection:' || chr(10) || context"


@query(ALL.rstrip() + f""",
said AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations)
SELECT conv_id, turn, role, text AS content FROM said WHERE role <> 'user' OR reply IS NULL OR reply = 'assistant'
UNION ALL SELECT DISTINCT conv_id, -1, 'system', (SELECT {_SYSTEM} FROM contexts WHERE scope_key = '') FROM conversations""")
def chat_requests(spark, sf_dir):
    context = prompts.build_context(b.span_cube(spark, sf_dir), "All categories").scalar()
    turns = b.table(spark, sf_dir, "conversations")
    return prompts.chat_requests(turns, prompts.chat_system(context))


def _sizes(spark, sf_dir):
    """A summary and a chat turn on the largest category, and two product prompts: the one of
    median and the one of greatest length."""
    cube = b.span_cube(spark, sf_dir)
    contexts = prompts.scope_contexts(cube)
    top = profile.largest_group(cube, "main_category", "total").select("main_category").scalar()
    scope = contexts.where(F.col("scope_key") == top)
    products = _products(spark, sf_dir)
    picks = written(profile.length_picks(products, "review_content", "product_id"), "picks")
    # Two rows: their prompts alone are built.
    picked = products.join(picks.drop("length"), "product_id")
    question = F.lit("Which aspect has the most complaints, and does it get worse at higher discounts?")
    chat = scope.select(prompts.chat_system(F.col("context")).alias("system"), question.alias("prompt"))
    requests = prompts.typed(prompts.summary_prompts(scope), "summary", "summary")
    for pick in ("median", "longest"):
        one = prompts.review_prompts(picked.where(F.col("pick") == pick))
        requests = requests.unionByName(prompts.typed(one, f"product ({pick} review)", "product"))
    requests = requests.unionByName(prompts.typed(chat, "chat (1 turn)", "chat"))
    return prompts.request_sizes(requests, tokens.read_ranks(b.VOCABULARY))


_QUESTION = "'Which aspect has the most complaints, and does it get worse at higher discounts?'"
SIZES = f"""top AS (SELECT main_category FROM cube GROUP BY main_category ORDER BY sum(total) DESC, main_category LIMIT 1),
scope AS (SELECT context FROM contexts WHERE scope_key = (SELECT main_category FROM top)),
pieces AS (SELECT * FROM review_prompts WHERE part = 0),
longest AS (SELECT * FROM review_prompts WHERE product_id = (SELECT product_id FROM pieces ORDER BY size DESC, product_id LIMIT 1)),
middle AS (SELECT * FROM review_prompts WHERE product_id = (
  SELECT product_id FROM pieces ORDER BY abs(size - (SELECT median(size) FROM pieces)), product_id LIMIT 1)),
timed AS (SELECT kind, avg(value) AS prep_mean, max(value) AS prep_max
  FROM (SELECT value, CASE event_type WHEN 'click' THEN 'summary' WHEN 'view' THEN 'product' ELSE 'chat' END AS kind FROM events) GROUP BY kind),
requests AS (
  SELECT row_number() OVER () AS request, * FROM (
  SELECT 'summary' AS query_type, 'summary' AS kind, {_text(k.ANALYST_ROLE)} AS system, context || chr(10) || chr(10) || {_text(k.SUMMARY_TASK)} AS prompt, 220 AS out_typ, 350 AS out_cap FROM scope
  UNION ALL SELECT 'product (median review)', 'product', system, prompt, 260, 400 FROM middle
  UNION ALL SELECT 'product (longest review)', 'product', system, prompt, 260, 400 FROM longest
  UNION ALL SELECT 'chat (1 turn)', 'chat', {_SYSTEM}, {_QUESTION}, 200, 500 FROM scope)),
said AS (SELECT request, unnest([system, prompt]) AS text FROM requests),
{b.sql_tokens('said', 'request', 'text')},
sizes AS (SELECT query_type, kind, n::INTEGER AS in_tok, out_typ, out_cap FROM requests JOIN counted USING (request)),
costs AS (
  SELECT *, in_tok::DOUBLE / 1e6::DOUBLE * 0.15::DOUBLE + out_typ::DOUBLE / 1e6::DOUBLE * 0.6::DOUBLE AS cost,
    in_tok::DOUBLE / 1e6::DOUBLE * 0.15::DOUBLE + out_cap::DOUBLE / 1e6::DOUBLE * 0.6::DOUBLE AS cost_capped,
    prep_mean / 1000 + 0.5::DOUBLE + out_typ / 80.0::DOUBLE AS seconds,
    prep_max / 1000 + 0.5::DOUBLE + out_cap / 80.0::DOUBLE AS seconds_worst
  FROM sizes JOIN timed USING (kind))"""
COSTS = b.ctes(b.SPANS, b.CUBE, SCOPED, _contexts("scoped"), b.RAW, b.PARSED, b.CLEAN, REVIEWS, SIZES).replace("WITH", "WITH RECURSIVE", 1)


@query("WITH RECURSIVE " + b.sql_tokens("documents", "doc_id", "text") + " SELECT doc_id, n AS tokens FROM counted")
def document_tokens(spark, sf_dir):
    """True tokens of every document."""
    return tokens.count_tokens(b.texts(spark, sf_dir), "text", ["doc_id"], tokens.read_ranks(b.VOCABULARY))


@query(COSTS + """
SELECT query_type, kind, in_tok, out_typ, out_cap, round(cost, 9) AS cost, round(cost_capped, 9) AS cost_capped,
  round(seconds, 6) AS seconds, round(seconds_worst, 6) AS seconds_worst FROM costs""")
def query_cost(spark, sf_dir):
    """One row per request; event values stand in for measured preparation times."""
    kind = F.when(F.col("event_type") == "click", "summary").when(F.col("event_type") == "view", "product").otherwise("chat")
    times = prompts.time_summary(b.table(spark, sf_dir, "events").withColumn("kind", kind), "kind", "value")
    costs = prompts.with_cost(_sizes(spark, sf_dir).join(times, "kind")).drop("prep_ms_mean", "prep_ms_max")
    rounded = costs.withColumns({c: F.round(c, 6) for c in ("seconds", "seconds_worst")})
    return rounded.withColumns({c: F.round(c, 9) for c in ("cost", "cost_capped")})


@query(COSTS + """
SELECT round(blended, 9) AS blended, queries_per_month, round(blended * queries_per_month, 9) AS dollars_per_month
FROM (SELECT avg(c) AS blended FROM (SELECT avg(q) AS c FROM (
  SELECT kind, query_type, sum(cost) AS q FROM costs GROUP BY ALL) GROUP BY kind)),
  (VALUES (100), (1000), (10000)) s(queries_per_month)""")
def cost_projection(spark, sf_dir):
    out = prompts.cost_projection(prompts.with_cost(_sizes(spark, sf_dir)))
    return out.withColumn("blended", F.round("blended", 9)).withColumn("dollars_per_month", F.round("dollars_per_month", 9))


@query("""
SELECT event_type, round(avg(value), 6) AS prep_ms_mean, max(value) AS prep_ms_max FROM events GROUP BY event_type""")
def time_summary(spark, sf_dir):
    out = prompts.time_summary(b.table(spark, sf_dir, "events"), "event_type", "value")
    return out.withColumn("prep_ms_mean", F.round("prep_ms_mean", 6))
