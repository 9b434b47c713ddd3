"""The registered queries of this package and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, html_text, lang_id, line_dedup, merkle, mixing, ngram_join, pii, spelling, token_counts, topk, toxicity, url_filter,
)
from .fold import held_out
from .store import kept, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query()
def op5_token_counts(spark, sf_dir):
    """Every context limit that is the length of some document, over all documents."""
    return token_counts.totals(token_counts.histogram(table(spark, sf_dir, "documents")))


SQL_LINES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
bad AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT doc_id, pos, line, keeper IS NOT NULL AND keyed.doc_id > keeper AS gone
  FROM keyed LEFT JOIN bad ON keyed.k = bad.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query(SQL_LINES)
def op6_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


SQL_MIX = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || 'mix')[1:30] AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, (place % 3 + 1)::DOUBLE AS w FROM p),
h AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(source_size) OVER b, 0)::BIGINT * 3)::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS share,
         row_number() OVER (ORDER BY source_size / w, place) AS o
  FROM w WINDOW b AS (ORDER BY source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(o) AS o FROM h WHERE share * w <= source_size * 3),
t AS (
  SELECT source, source_size,
         CASE WHEN h.o >= f.o THEN (SELECT share FROM h x, f y WHERE x.o = y.o) * w
              ELSE (source_size * 3)::DOUBLE END AS target
  FROM h, f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT *, round(target - whole * source_size)::BIGINT AS budget FROM q),
c AS (
  SELECT source, h, sum(size)::BIGINT AS s, (sum(sum(size)) OVER (PARTITION BY source ORDER BY h))::BIGINT AS upto
  FROM d GROUP BY source, h)
SELECT d.doc_id, d.size, g.source_size, g.target,
       (d.size * (whole + CASE WHEN budget > 0 AND (upto < budget OR (upto - s < budget AND 2 * (budget - upto + s) > s))
                               THEN 1 ELSE 0 END))::BIGINT AS taken,
       (whole + CASE WHEN budget > 0 AND (upto < budget OR (upto - s < budget AND 2 * (budget - upto + s) > s))
                     THEN 1 ELSE 0 END)::BIGINT AS copies
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h
"""


@query(SQL_MIX)
def op7_mixing(spark, sf_dir):
    docs = mixing.measured(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    rows = kept(docs.drop("text"), "measured")
    return mixing.mix(rows).select("doc_id", "size", "source_size", "target", "taken", "copies")


SQL_TOP = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query(SQL_TOP)
def op8_topk(spark, sf_dir):
    vectors = topk.whole_numbers(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


@query()
def op10_decontamination(spark, sf_dir):
    found = decontaminate.find_leaks(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL_JOIN = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, hash(w[i : i + 4], 5) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
       least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id))::BIGINT AS component_id,
       (SELECT count(*) FROM l WHERE l.a = d.doc_id)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id)
"""


@query(SQL_JOIN)
def op1_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


@query()
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query()
def op3_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query()
def op4_url_filter(spark, sf_dir):
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), depth=None)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query()
def op2_lang_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_id.fit(docs)
    found = lang_id.predict(docs.drop("lang"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: crc32 of a list of bytes: `t` is its table of 256 values.
SQL_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i))"""


def sql_crc(some_bytes: str) -> str:
    step = "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {some_bytes}), {step}), 4294967295::BIGINT)"


def _sql_leaf(n_chars: str) -> str:
    field = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    return f"sha256({' || '.join(field(x) for x in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


SQL_MERKLE = f"""
WITH RECURSIVE {SQL_CRC_TABLE},
leaves AS (
  SELECT doc_id, lang, {_sql_leaf('n_chars')} AS leaf,
    CASE WHEN {sql_crc("[unicode(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]")} % 7 = 0
      THEN {_sql_leaf('(n_chars + 1)')} END AS tampered,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n
  FROM documents, crc_table),
nodes(level, lang, pos, n, h) AS (
  SELECT 0, lang, pos, n, leaf FROM leaves
  UNION ALL
  SELECT any_value(level) + 1, lang, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY lang, pos // 2),
subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, pos, n, h) AS (
  SELECT 0, pos, n, h FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM tops WHERE n > 1 GROUP BY pos // 2),
up(doc_id, lang, level, pos, n, proof, folded) AS (
  SELECT doc_id, lang, 0, pos, n, '', coalesce(tampered, leaf) FROM leaves
  UNION ALL
  SELECT doc_id, u.lang, u.level + 1, u.pos // 2, (u.n + 1) // 2, proof || coalesce(s.h, ''),
    sha256(CASE WHEN u.pos % 2 = 1 THEN s.h || folded ELSE folded || coalesce(s.h, '') END)
  FROM up u LEFT JOIN nodes s ON u.lang IS NOT DISTINCT FROM s.lang AND s.level = u.level AND s.pos = xor(u.pos, 1)
  WHERE u.n > 1),
over(doc_id, level, pos, n, proof, folded) AS (
  SELECT doc_id, 0, s.pos, s.n, proof, folded FROM up u JOIN subroots s ON u.lang IS NOT DISTINCT FROM s.lang WHERE u.n = 1
  UNION ALL
  SELECT doc_id, o.level + 1, o.pos // 2, (o.n + 1) // 2, proof || coalesce(s.h, ''),
    sha256(CASE WHEN o.pos % 2 = 1 THEN s.h || folded ELSE folded || coalesce(s.h, '') END)
  FROM over o LEFT JOIN tops s ON s.level = o.level AND s.pos = xor(o.pos, 1) WHERE o.n > 1)
SELECT l.doc_id, leaf, s.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256,
  folded AS folded_root, folded = (SELECT h FROM tops WHERE n = 1) AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN over o ON o.doc_id = l.doc_id AND o.n = 1
"""


@query(SQL_MERKLE)
def op13_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    n_chars = F.col("n_chars") + 1
    spoiled = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(spoiled, merkle.row_hash("doc_id", "source", "lang", n_chars, "text"))
    rows = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", ["doc_id"], {"tampered": tampered})
    rows = rows.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


SQL_SPELLING = f"""
WITH RECURSIVE {SQL_CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, {sql_crc('''flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END
    for x in string_split(doc_id::VARCHAR || ':' || run, '')])''')} AS h
  FROM counted, crc_table),
made AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
              ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (
  SELECT word, i, left(word, i - 1) AS a, substr(word, i + 1) AS b
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
holes AS (SELECT word, a || '_' || b AS hole FROM cut),
shorter AS (SELECT DISTINCT cut.word AS long, words.word AS short FROM cut JOIN words ON words.word = a || b),
near AS (
  SELECT x.word, y.word AS other FROM holes x JOIN holes y ON x.hole = y.hole AND x.word <> y.word
  UNION ALL SELECT long, short FROM shorter UNION ALL SELECT short, long FROM shorter),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(other, (-w.n, other)) AS other, max(w.n) AS other_n
  FROM near JOIN words w ON w.word = other GROUP BY near.word),
forms AS (
  SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form,
    CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best ON best.word = words.word),
walk AS (
  SELECT word, word AS at_word, form AS to_word FROM forms
  UNION ALL SELECT walk.word, walk.to_word, f.form FROM walk JOIN forms f ON f.word = walk.to_word)
SELECT forms.word, n, n_near, form, form_n, walk.at_word AS root
FROM forms JOIN walk ON walk.word = forms.word AND walk.to_word IS NULL
"""


@query(SQL_SPELLING)
def op12_spelling(spark, sf_dir):
    words = spelling.count_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


@query()
def op11_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.fit(docs)).select("doc_id", *pii.RESULTS)
