"""Queries over the engine's operators on the project's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import schema
from folioscope.functions import collections as col
from folioscope.functions import text as tx
from folioscope.functions import vectors as vec
from folioscope.operators import author_ids as aid
from folioscope.operators import dendrogram as tree
from folioscope.operators import evaluation as ev
from folioscope.operators import filters as fl
from folioscope.operators import graph as gr
from folioscope.operators import manifold as mf
from folioscope.operators import scoring as sc
from folioscope.operators import temporal as tm
from folioscope.operators import vocabulary as vo
from folioscope.operators.current import current_rows
from folioscope.session import checkpointed, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

CUR = """cur AS (SELECT * FROM papers WHERE paper_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at DESC) = 1)"""
DA = CUR + """,
da AS (SELECT DISTINCT paper_id, date, author_id FROM (SELECT paper_id, date, unnest(author_ids) AS author_id FROM cur)
  WHERE author_id IS NOT NULL),
dan AS (SELECT *, count(*) OVER (PARTITION BY paper_id) AS n_authors FROM da)"""
EDGES = DA + """,
edges AS (SELECT x.author_id AS src, y.author_id AS dst, count(*) AS cnt FROM da x JOIN da y
  ON x.paper_id = y.paper_id AND x.author_id < y.author_id GROUP BY 1, 2),
bidi AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges),
deg AS (SELECT a AS id, count(*) AS degree FROM bidi GROUP BY a)"""
TOK = CUR + """,
tok AS (SELECT paper_id, pos, t FROM (SELECT paper_id, generate_subscripts(preprocessed_text, 1) AS pos, unnest(preprocessed_text) AS t FROM cur)
  WHERE t IS NOT NULL AND t <> '')"""
PHI = TOK + """,
pc AS (SELECT DISTINCT paper_id, c FROM (SELECT paper_id, unnest(categories) AS c FROM cur) WHERE c IS NOT NULL),
phi AS (SELECT c AS topic, t AS term, count(*) AS weight FROM pc JOIN tok USING (paper_id) GROUP BY 1, 2)"""
REL = PHI + """,
rel AS (
  SELECT topic, term, 0.6 * ln(greatest(p, 1e-12)) + (1 - 0.6) * (ln(greatest(p, 1e-12)) - ln(greatest(q, 1e-12))) AS relevance FROM (
    SELECT topic, term, CAST(weight AS DOUBLE) / sum(weight) OVER (PARTITION BY topic) AS p,
      CAST(sum(weight) OVER (PARTITION BY term) AS DOUBLE) / sum(weight) OVER () AS q FROM phi)),
top AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(relevance, 6) DESC, term) AS rank FROM rel
  QUALIFY row_number() OVER (PARTITION BY topic ORDER BY round(relevance, 6) DESC, term) <= 10)"""
DIST = """ct AS (SELECT author_id, CAST(author_topic_space_probs AS DOUBLE[]) AS v FROM author_topics WHERE author_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY computed_at DESC) = 1),
dist AS (SELECT author_id, topic - 1 AS topic, x / s AS p FROM (
    SELECT author_id, list_sum(v) AS s, generate_subscripts(v, 1) AS topic, unnest(v) AS x FROM ct WHERE len(v) > 0) WHERE s > 0 AND x > 0)"""
# a document's topics: the leading letters of its terms, as a stand-in for a fitted model
THETA = TOK + """,
theta AS (SELECT paper_id, topic, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY paper_id) AS p FROM (
  SELECT paper_id, ascii(lower(trim(t))) % 8 AS topic, count(*) AS n FROM tok WHERE trim(t) <> '' GROUP BY 1, 2))"""
CHUNK = CUR + """,
chunked AS (SELECT paper_id, date, CAST(ceil(((year(date) - year(f)) * 12 + month(date) - month(f)) / 12.0) AS INT) AS chunk_id
  FROM cur, (SELECT min(date) AS f FROM cur) WHERE date IS NOT NULL),
stats AS (SELECT chunk_id, min(date) AS start_date, max(date) AS end_date, count(*) AS n, row_number() OVER (ORDER BY chunk_id) - 1 AS chunk
  FROM chunked GROUP BY chunk_id)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def papers(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_rows(table(spark, d, "papers"), "paper_id", "ingested_at", list(columns))


def edges(spark: SparkSession, d: str, **kw) -> DataFrame:
    return gr.coauthor_edges(papers(spark, d, "author_ids"), **kw)


def tokens(spark: SparkSession, d: str, *more: str) -> DataFrame:
    kept = F.filter("preprocessed_text", lambda t: t.isNotNull() & (t != ""))
    return papers(spark, d, "preprocessed_text", *more).select("paper_id", F.coalesce(kept, F.array().cast("array<string>")).alias("tokens"), *more)


def category_terms(spark: SparkSession, d: str) -> DataFrame:
    """(topic, term, weight): categories as topics, the terms of their papers as words."""
    docs = tokens(spark, d, "categories").select("tokens", F.explode(F.array_distinct(F.array_compact("categories"))).alias("topic"))
    return docs.select("topic", F.explode("tokens").alias("term")).groupBy("topic", "term").agg(F.count(F.lit(1)).alias("weight"))


def distributions(spark: SparkSession, d: str) -> DataFrame:
    """(author_id, topic, p) of usable current author distributions, positive entries."""
    rows = current_rows(table(spark, d, "author_topics"), "author_id", "computed_at", {"v": F.col("author_topic_space_probs").cast("array<double>")})
    rows = rows.withColumn("s", vec.total("v")).where((F.size("v") > 0) & (F.col("s") > 0))
    return rows.select("author_id", "s", F.posexplode("v").alias("topic", "x")).where("x > 0").select("author_id", "topic", (F.col("x") / F.col("s")).alias("p"))


def letter_topics(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, topic, p): shares of the leading letters of a document's terms, a stand-in for a fitted model."""
    rows = tokens(spark, d).select("paper_id", F.explode("tokens").alias("t")).where(F.trim("t") != "")
    n = rows.groupBy("paper_id", (F.ascii(F.lower(F.trim("t"))) % 8).alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("paper_id").agg(F.sum("n").alias("t"))
    return n.join(total, "paper_id").select("paper_id", "topic", (F.col("n") / F.col("t")).alias("p"))


# ---- reading and filtering -------------------------------------------------------------------------------------


@query(r"""SELECT DISTINCT entry_id, trim(coalesce(title, '')) AS title,
  CASE WHEN regexp_full_match(substr(date, 1, 10), '\d{4}-\d{2}-\d{2}') THEN try_cast(substr(date, 1, 10) AS DATE) END AS date,
  len(string_split_regex(trim(coalesce(author_names, '')), ';')) AS parts
FROM raw_entries WHERE trim(coalesce(date, '')) = '' OR (regexp_full_match(substr(date, 1, 10), '\d{4}-\d{2}-\d{2}') AND try_cast(substr(date, 1, 10) AS DATE) IS NOT NULL)""")
def schema_projection(spark: SparkSession, d: str) -> DataFrame:
    raw = schema.rename_fields(table(spark, d, "raw_entries"), {"author_names": "authors"})
    out = schema.to_schema(raw, ["entry_id", "authors"])
    return out.select("entry_id", "title", "date", F.size(F.split(F.trim(F.coalesce("authors", F.lit(""))), ";")).cast("bigint").alias("parts")).distinct()


@query(r"""SELECT DISTINCT entry_id, coalesce(
  try_cast(CASE WHEN regexp_matches(d, '^\d{4}-\d{2}-\d{2}[T ]') THEN substr(d, 1, 10) WHEN regexp_full_match(d, '\d{4}-\d{2}-\d{2}') THEN d END AS DATE),
  CAST(try_strptime(CASE WHEN regexp_full_match(d, '\d{4}/\d{2}/\d{2}') THEN d END, '%Y/%m/%d') AS DATE),
  CAST(try_strptime(CASE WHEN regexp_full_match(d, '\d{1,2}\.\d{1,2}\.\d{4}') THEN d END, '%d.%m.%Y') AS DATE),
  CAST(try_strptime(CASE WHEN regexp_full_match(d, '\d{2}/\d{2}/\d{4}') THEN d END, '%d/%m/%Y') AS DATE),
  CAST(try_strptime(CASE WHEN regexp_full_match(d, '\d{8}') THEN d END, '%Y%m%d') AS DATE),
  CAST(try_strptime(CASE WHEN regexp_full_match(d, '[A-Z][a-z]{2} \d{1,2}, \d{4}') THEN d END, '%b %d, %Y') AS DATE),
  CAST(try_strptime(CASE WHEN regexp_full_match(d, '\d{1,2} [A-Z][a-z]{2} \d{4}') THEN d END, '%d %b %Y') AS DATE),
  CAST(try_strptime(CASE WHEN regexp_full_match(d, '[A-Z][a-z]+ \d{1,2}, \d{4}') THEN d END, '%B %d, %Y') AS DATE),
  CAST(try_strptime(CASE WHEN regexp_full_match(d, '\d{1,2} [A-Z][a-z]+ \d{4}') THEN d END, '%d %B %Y') AS DATE)) AS day
FROM (SELECT entry_id, trim(date) AS d FROM raw_entries)""")
def flexible_dates(spark: SparkSession, d: str) -> DataFrame:
    """Every entry; a date in none of the accepted forms is null."""
    return table(spark, d, "raw_entries").select("entry_id", tx.any_date("date").alias("day")).distinct()


@query(f"""WITH {CUR} SELECT count_if(ok) AS valid_rows, count_if(NOT ok) AS invalid_rows, min(date) AS first_date, max(date) AS last_date
FROM (SELECT date, title IS NOT NULL AND date IS NOT NULL AND raw_text IS NOT NULL AND author_names IS NOT NULL AS ok FROM cur)""")
def load_metadata(spark: SparkSession, d: str) -> DataFrame:
    return schema.load_summary(papers(spark, d, "title", "date", "raw_text", "author_names"))


@query(f"WITH {CUR} SELECT paper_id, date FROM cur WHERE title IS NOT NULL AND date IS NOT NULL AND raw_text IS NOT NULL AND author_names IS NOT NULL")
def valid_rows(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d, "title", "date", "raw_text", "author_names").where(schema.is_valid()).select("paper_id", "date")


@query(f"WITH {CUR} SELECT paper_id, date FROM cur WHERE date BETWEEN DATE '2005-01-01' AND DATE '2012-06-30'")
def date_range_filter(spark: SparkSession, d: str) -> DataFrame:
    return fl.date_range(papers(spark, d, "date"), "2005-01-01", "30.06.2012").select("paper_id", "date")


@query(f"WITH {CUR} SELECT paper_id FROM cur WHERE list_has_any(categories, ['geo.SED', 'ice/core'])")
def category_overlap_filter(spark: SparkSession, d: str) -> DataFrame:
    return fl.any_category(papers(spark, d, "categories"), ["geo.SED", "ice/core"]).select("paper_id")


@query(f"""WITH {CUR}, hot AS (SELECT a FROM (SELECT unnest(author_ids) AS a FROM cur) WHERE a IS NOT NULL GROUP BY a ORDER BY count(*) DESC, a LIMIT 3)
SELECT DISTINCT paper_id FROM (SELECT paper_id, unnest(author_ids) AS a FROM cur WHERE year(date) BETWEEN 2000 AND 2015) WHERE a IN (SELECT a FROM hot)""")
def year_author_filter(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d, "date", "author_ids")
    hot = [r[0] for r in p.select(F.explode(F.array_compact("author_ids")).alias("a")).groupBy("a").count().orderBy(F.desc("count"), "a").limit(3).collect()]
    return fl.year_and_authors(p, 2000, 2015, hot).select("paper_id")


@query(f"""WITH {CUR}, n AS (SELECT paper_id, author_ids, author_names, unnest(range(1, CAST(len(author_ids) AS BIGINT) + 1)) AS i FROM cur)
SELECT author_id, count(DISTINCT paper_id) AS papers, count(DISTINCT name) AS names FROM (SELECT paper_id, author_ids[i] AS author_id, author_names[i] AS name FROM n) WHERE author_id IS NOT NULL GROUP BY author_id""")
def author_mappings(spark: SparkSession, d: str) -> DataFrame:
    return aid.id_names(papers(spark, d, "author_ids", "author_names"))


@query(f"WITH {CUR} SELECT paper_id, substr(md5(title), 1, 8) AS code FROM cur WHERE title IS NOT NULL")
def title_codes(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d, "title").where("title IS NOT NULL").select("paper_id", tx.short_hash("title").alias("code"))


@query("SELECT count(DISTINCT c) AS n FROM (SELECT unnest(categories) AS c FROM papers) WHERE c IS NOT NULL")
def unique_categories(spark: SparkSession, d: str) -> DataFrame:
    return col.count_unique(table(spark, d, "papers"), "categories")


# ---- text and vocabulary -----------------------------------------------------------------------------------------


@query(f"""WITH {CUR}, w AS (SELECT paper_id, unnest(regexp_extract_all(lower(strip_accents(title)), '[a-z_]+')) AS term FROM cur)
SELECT term, count(DISTINCT paper_id) AS df, count(*) AS cf FROM w WHERE length(term) BETWEEN 2 AND 15 AND NOT starts_with(term, '_') GROUP BY term""")
def title_terms(spark: SparkSession, d: str) -> DataFrame:
    return vo.term_frequencies(papers(spark, d, "title"), "paper_id", tx.simple_tokens("title"))


@query(f"""WITH {TOK}, n AS (SELECT count(*) AS n FROM cur), f AS (SELECT t AS term, count(DISTINCT paper_id) AS df, count(*) AS cf FROM tok GROUP BY t)
SELECT term, df, cf FROM f, n WHERE df > 1 AND df <= CAST(floor(n * 0.6) AS BIGINT) AND length(term) >= 3 AND term NOT IN ('the', 'and', 'study')""")
def vocabulary_filter(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d)
    return vo.approved_terms(vo.term_frequencies(t, "paper_id", "tokens"), t.count(), 1, 0.6, ["the", "and", "study"])


@query(f"WITH {TOK} SELECT paper_id, t AS term, count(*) AS n FROM tok GROUP BY 1, 2")
def bow_counts(spark: SparkSession, d: str) -> DataFrame:
    return vo.bag_of_words(tokens(spark, d), "paper_id", "tokens")


@query(f"""WITH {TOK} SELECT paper_id, string_agg(t, ' ' ORDER BY pos) AS tokens FROM tok WHERE t IN (SELECT t FROM tok GROUP BY t HAVING count(*) > 1) GROUP BY paper_id""")
def hapax_filter(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d)
    kept = vo.keep_terms(t, "paper_id", "tokens", vo.term_frequencies(t, "paper_id", "tokens").where("cf > 1"))
    return kept.select("paper_id", F.array_join("tokens", " ").alias("tokens"))


@query(f"""WITH {CUR}, w AS (SELECT paper_id, unnest(regexp_extract_all(lower(strip_accents(title)), '[a-z_]+')) AS term FROM cur)
SELECT paper_id, count(*) AS n FROM w WHERE length(term) BETWEEN 2 AND 15 AND NOT starts_with(term, '_')
  AND term NOT IN ({', '.join(repr(w) for w in tx.STOPWORDS)}) GROUP BY paper_id""")
def stopword_removal(spark: SparkSession, d: str) -> DataFrame:
    t = papers(spark, d, "title").select("paper_id", tx.without(tx.simple_tokens("title"), tx.STOPWORDS).alias("t"))
    return t.where(F.size("t") > 0).select("paper_id", F.size("t").cast("bigint").alias("n"))


_LEMMA = ", ".join(f"('{a}', '{b}')" for a, b in tx.IRREGULAR.items())


@query(f"""WITH {CUR}, w AS (SELECT paper_id, unnest(regexp_extract_all(lower(strip_accents(title)), '[a-z_]+')) AS t FROM cur), ir(a, b) AS (VALUES {_LEMMA}),
l AS (SELECT paper_id, coalesce(b, CASE WHEN length(t) <= 3 THEN t WHEN regexp_matches(t, '[^aeiou]ies$') AND length(t) > 4 THEN regexp_replace(t, 'ies$', 'y')
  WHEN regexp_matches(t, '(ss|x|ch|sh|z)es$') THEN regexp_replace(t, 'es$', '') WHEN regexp_matches(t, '(ss|us|is)$') THEN t WHEN ends_with(t, 's') THEN regexp_replace(t, 's$', '') ELSE t END) AS term
 FROM w LEFT JOIN ir ON a = t WHERE length(t) BETWEEN 2 AND 15 AND NOT starts_with(t, '_'))
SELECT term, count(DISTINCT paper_id) AS df, count(*) AS cf FROM l GROUP BY term""")
def lemma_counts(spark: SparkSession, d: str) -> DataFrame:
    t = papers(spark, d, "title").select("paper_id", tx.lemmas(tx.simple_tokens("title")).alias("tokens"))
    return vo.term_frequencies(t, "paper_id", "tokens")


@query(f"WITH {REL} SELECT topic, term, round(relevance, 4) AS relevance, rank FROM top")
def term_relevance_topk(spark: SparkSession, d: str) -> DataFrame:
    rel = vo.relevance(category_terms(spark, d)).withColumn("r6", F.round("relevance", 6))
    return vo.top_terms(rel, 10, "r6").select("topic", "term", F.round("relevance", 4).alias("relevance"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {PHI}, s AS (SELECT term, sum(CASE WHEN topic IN ('nl.MOR', 'nl.SEM') THEN weight ELSE 0 END) AS i, sum(CASE WHEN topic IN ('nl.MOR', 'nl.SEM') THEN 0 ELSE weight END) AS o FROM phi GROUP BY term),
q AS (SELECT term, greatest(CAST(i AS DOUBLE) / sum(i) OVER (), 1e-12) AS p, greatest(CAST(o AS DOUBLE) / sum(o) OVER (), 1e-12) AS q, i FROM s)
SELECT term, round(0.6 * ln(p) + (1 - 0.6) * (ln(p) - ln(q)), 4) AS relevance FROM q WHERE i > 0""")
def contrastive_terms(spark: SparkSession, d: str) -> DataFrame:
    out = vo.contrastive_relevance(category_terms(spark, d), ["nl.MOR", "nl.SEM"])
    return out.select("term", F.round("relevance", 4).alias("relevance"))


@query(f"WITH {REL} SELECT paper_id, count(*) AS n FROM tok WHERE t IN (SELECT term FROM top) GROUP BY paper_id")
def relevance_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    rel = vo.relevance(category_terms(spark, d)).withColumn("r6", F.round("relevance", 6))
    terms = vo.top_terms(rel, 10, "r6").select("term").distinct()
    return vo.keep_terms(tokens(spark, d), "paper_id", "tokens", terms).select("paper_id", F.size("tokens").cast("bigint").alias("n"))


@query(f"WITH {REL} SELECT CAST(count(DISTINCT term) AS DOUBLE) / count(*) AS diversity FROM top")
def topic_diversity(spark: SparkSession, d: str) -> DataFrame:
    rel = vo.relevance(category_terms(spark, d)).withColumn("r6", F.round("relevance", 6))
    return ev.topic_diversity(vo.top_terms(rel, 10, "r6"))


_PAIRS = REL + """,
dt AS (SELECT DISTINCT paper_id, t AS term FROM tok WHERE t IN (SELECT term FROM top)),
df AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
pr AS (SELECT x.topic, x.term AS a, y.term AS b FROM top x JOIN top y ON x.topic = y.topic AND x.rank < y.rank),
un AS (SELECT DISTINCT least(a, b) AS lo, greatest(a, b) AS hi FROM pr),
jn AS (SELECT un.lo, un.hi, count(*) AS df_ab FROM un JOIN dt p ON p.term = un.lo JOIN dt q ON q.term = un.hi AND q.paper_id = p.paper_id GROUP BY 1, 2),
al AS (SELECT pr.topic, d1.df AS df_a, d2.df AS df_b, coalesce(jn.df_ab, 0) AS df_ab FROM pr JOIN df d1 ON d1.term = pr.a JOIN df d2 ON d2.term = pr.b
  LEFT JOIN jn ON jn.lo = least(pr.a, pr.b) AND jn.hi = greatest(pr.a, pr.b))"""


def _coherence_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(pairs of the ten best terms of each category, documents); the tokens are read once and written."""
    t = checkpointed(tokens(spark, d, "categories"))
    topics = t.select("tokens", F.explode(F.array_distinct(F.array_compact("categories"))).alias("topic"))
    weights = checkpointed(topics.select("topic", F.explode("tokens").alias("term")).groupBy("topic", "term").agg(F.count(F.lit(1)).alias("weight")))
    top = checkpointed(vo.top_terms(vo.relevance(weights).withColumn("r6", F.round("relevance", 6)), 10, "r6").select("topic", "term", "rank"))
    return ev.term_pairs(top, t.select("paper_id", F.explode("tokens").alias("term")), "paper_id"), t


@query(f"WITH {_PAIRS} SELECT topic, round(avg(ln((df_ab + 1) / CAST(df_a AS DOUBLE))), 4) AS coherence FROM al GROUP BY topic")
def umass_coherence(spark: SparkSession, d: str) -> DataFrame:
    return ev.umass(_coherence_pairs(spark, d)[0]).select("topic", F.round("coherence", 4).alias("coherence"))


@query(f"""WITH {_PAIRS}, n AS (SELECT count(*) AS n FROM cur)
SELECT topic, round(avg(ln((CAST(df_ab AS DOUBLE) / n + 1e-12) / ((CAST(df_a AS DOUBLE) / n) * (CAST(df_b AS DOUBLE) / n))) / -ln(CAST(df_ab AS DOUBLE) / n + 1e-12)), 4) AS coherence FROM al, n GROUP BY topic""")
def npmi_coherence(spark: SparkSession, d: str) -> DataFrame:
    pairs, t = _coherence_pairs(spark, d)
    return ev.npmi(pairs, t.count()).select("topic", F.round("coherence", 4).alias("coherence"))


_WIN = REL + """,
ln AS (SELECT paper_id, max(pos) AS n FROM (SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY pos) AS pos FROM tok) GROUP BY paper_id),
tp AS (SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY pos) - 1 AS ps, t FROM tok),
tk AS (SELECT * FROM tp WHERE t IN (SELECT term FROM top)),
wt AS (SELECT DISTINCT tk.paper_id, s.s, t AS term FROM tk JOIN ln USING (paper_id), LATERAL (SELECT unnest(range(greatest(ps - 29, 0), least(ps, greatest(n - 30, 0)) + 1)) AS s) s),
nw AS (SELECT CAST(sum(greatest(n - 30, 0) + 1) AS DOUBLE) AS w FROM ln),
wd AS (SELECT term, count(*) / (SELECT w FROM nw) AS p FROM wt GROUP BY term),
pa AS (SELECT x.topic, x.term AS i, y.term AS j FROM top x JOIN top y ON x.topic = y.topic),
ij AS (SELECT DISTINCT i, j FROM pa WHERE i < j),
wj AS (SELECT i, j, count(*) / (SELECT w FROM nw) AS p FROM ij JOIN wt a ON a.term = i JOIN wt b ON b.term = j AND a.paper_id = b.paper_id AND a.s = b.s GROUP BY i, j),
nm AS (SELECT pa.topic, pa.i, pa.j, CASE WHEN a.p IS NULL OR b.p IS NULL THEN 0 WHEN pa.i = pa.j THEN ln((a.p + 1e-12) / (a.p * a.p)) / -ln(a.p + 1e-12)
   ELSE ln((coalesce(wj.p, 0) + 1e-12) / (a.p * b.p)) / -ln(coalesce(wj.p, 0) + 1e-12) END AS x
 FROM pa LEFT JOIN wd a ON a.term = pa.i LEFT JOIN wd b ON b.term = pa.j LEFT JOIN wj ON wj.i = least(pa.i, pa.j) AND wj.j = greatest(pa.i, pa.j)),
tt AS (SELECT topic, j, sum(x) AS t FROM nm GROUP BY 1, 2),
cs AS (SELECT nm.topic, nm.i, sum(x * t) / sqrt(sum(x * x)) AS c FROM nm JOIN tt USING (topic, j) GROUP BY 1, 2)"""


@query(f"WITH {_WIN} SELECT cs.topic, round(avg(c / l), 4) AS coherence FROM cs JOIN (SELECT topic, sqrt(sum(t * t)) AS l FROM tt GROUP BY topic) USING (topic) GROUP BY cs.topic")
def window_coherence(spark: SparkSession, d: str) -> DataFrame:
    """Coherence of the ten best terms of each category over sliding windows of 30 tokens."""
    t = checkpointed(tokens(spark, d))
    top = checkpointed(vo.top_terms(vo.relevance(category_terms(spark, d)).withColumn("r6", F.round("relevance", 6)), 10, "r6").select("topic", "term", "rank"))
    pairs, n = ev.window_pairs(top, t, "paper_id", "tokens", 30)
    return ev.c_v(pairs, n).select("topic", F.round("coherence", 4).alias("coherence"))


# ---- vectors ------------------------------------------------------------------------------------------------------

_ADJ = """v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS e FROM embeddings),
n AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM v WHERE list_sum(e) > 0),
z AS (SELECT a.vec_id, generate_subscripts(a.p, 1) AS i, unnest(a.p) AS p, unnest(b.p) AS q FROM n a JOIN n b ON b.vec_id = a.vec_id + 1)"""


def _shares(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x)).alias("e"))
    return e.where(vec.total("e") > 0).select("vec_id", vec.normalised("e").alias("p"))


@query(f"""WITH {_ADJ} SELECT vec_id, round(sqrt(0.5 * sum((sqrt(p) - sqrt(q)) * (sqrt(p) - sqrt(q)))), 4) AS hellinger, round(sqrt(sum((p - q) * (p - q))), 4) AS euclidean,
  round(sum(abs(p - q)), 4) AS manhattan, round(sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q))), 4) AS cosine,
  round(sum(CASE WHEN p > 0 AND q > 0 THEN p * ln(p / q) ELSE 0 END), 4) AS kl,
  round(sum((CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2), 4) AS js,
  round(-ln(sum(sqrt(greatest(p, 1e-10) * greatest(q, 1e-10)))), 4) AS bhattacharyya, round(sum(abs(p - q) * least(p, q)), 6) AS tv_min, round(sum(abs(p - q) * (p + q) / 2), 6) AS tv_mean
FROM z GROUP BY vec_id""")
def vector_distances(spark: SparkSession, d: str) -> DataFrame:
    s = _shares(spark, d)
    pairs = s.join(s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")
    names = ["hellinger", "euclidean", "manhattan", "cosine", "kl", "js", "bhattacharyya"]
    small = [F.round(vec.kernel(n)("p", "q"), 6).alias(n) for n in ("tv_min", "tv_mean")]
    return pairs.select("vec_id", *[F.round(vec.kernel(n)("p", "q"), 4).alias(n) for n in names], *small)


@query(f"""WITH {_ADJ}, x AS (SELECT vec_id, generate_subscripts(p, 1) AS i, unnest(p) AS p FROM n),
r AS (SELECT vec_id, p, i, row_number() OVER (PARTITION BY vec_id ORDER BY p) AS k, count(*) OVER (PARTITION BY vec_id) AS n FROM x WHERE p <> 0),
t AS (SELECT vec_id, round(sum(-p * log2(p)), 4) AS entropy, round(sum((2 * k - n - 1) * p) / (max(n) * sum(p)), 4) AS gini FROM r GROUP BY vec_id)
SELECT t.vec_id, entropy, gini, list_position(n.p, list_max(n.p)) - 1 AS top FROM t JOIN n ON n.vec_id = t.vec_id""")
def vector_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d).select(
        "vec_id", F.round(vec.entropy_bits("p"), 4).alias("entropy"), F.round(vec.gini("p"), 4).alias("gini"), vec.argmax("p").alias("top")
    )


@query("WITH v AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT generate_subscripts(e, 1) - 1 AS pos, unnest(e) AS x FROM v) SELECT pos, round(avg(x), 6) AS x FROM x GROUP BY pos")
def mean_vector(spark: SparkSession, d: str) -> DataFrame:
    return vec.mean_vector(table(spark, d, "embeddings"), "embedding").select("pos", F.round("x", 6).alias("x"))


@query(f"""WITH {_ADJ}, x AS (SELECT list_max(p) AS w, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS x FROM n), s AS (SELECT pos, sum(w * x) AS s FROM x GROUP BY pos)
SELECT pos, round(s / sum(s) OVER (), 6) AS x FROM s""")
def max_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return vec.max_weighted_mean(_shares(spark, d), "p").select("pos", F.round("x", 6).alias("x"))


@query(f"""WITH {_ADJ}, x AS (SELECT vec_id, unnest(p) AS x FROM n) SELECT round(avg(e), 6) AS mean_entropy FROM (SELECT sum(-greatest(x, 1e-10) * ln(greatest(x, 1e-10))) AS e FROM x GROUP BY vec_id)""")
def mean_entropy(spark: SparkSession, d: str) -> DataFrame:
    return vec.mean_entropy(_shares(spark, d), "p").select(F.round("mean_entropy", 6).alias("mean_entropy"))


@query(f"""WITH {_ADJ}, x AS (SELECT list_max(p) AS w, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS x FROM n), s AS (SELECT pos, sum(w * x) AS s FROM x GROUP BY pos)
SELECT round(sum(-q * log2(q)), 6) AS entropy FROM (SELECT s / sum(s) OVER () AS q FROM s)""")
def max_weighted_entropy(spark: SparkSession, d: str) -> DataFrame:
    return vec.entropy_of_max_weighted_mean(_shares(spark, d), "p").select(F.round("entropy", 6).alias("entropy"))


@query("""WITH v AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v),
x AS (SELECT generate_subscripts(u, 1) AS i, unnest(u) AS x FROM u), s AS (SELECT sum(x) AS s, sum(x * x) AS o FROM x GROUP BY i), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM u)
SELECT round((sum(s * s) - sum(o)) / (max(n) * (max(n) - 1)), 6) AS mean_cosine FROM s, n""")
def mean_offdiag_cosine(spark: SparkSession, d: str) -> DataFrame:
    return vec.mean_pairwise_cosine(table(spark, d, "embeddings"), "embedding").select(F.round("mean_cosine", 6).alias("mean_cosine"))


@query("""WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT i, avg(x) AS c FROM v GROUP BY i),
d AS (SELECT vec_id, sum(abs(x - c)) AS d FROM v JOIN c USING (i) GROUP BY vec_id) SELECT round(avg(CASE WHEN d > 1e-10 THEN 1 / d ELSE 1 END), 6) AS density FROM d""")
def space_density(spark: SparkSession, d: str) -> DataFrame:
    return vec.density(table(spark, d, "embeddings"), "embedding").select(F.round("density", 6).alias("density"))


# ---- co-author graph ------------------------------------------------------------------------------------------------


@query(f"WITH {EDGES} SELECT src, dst, cnt FROM edges")
def coauthor_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


@query(f"""WITH {DA} SELECT year(x.date) AS year, x.author_id AS src, y.author_id AS dst, count(*) AS cnt FROM da x JOIN da y
  ON x.paper_id = y.paper_id AND x.author_id < y.author_id WHERE x.date IS NOT NULL GROUP BY 1, 2, 3""")
def coauthor_edges_yearly(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d, "author_ids", "date").where("date IS NOT NULL").withColumn("year", F.year("date").cast("bigint"))
    return gr.coauthor_edges(p, by=["year"])


@query(f"""WITH {DA}, e AS (SELECT DISTINCT x.author_id AS src, y.author_id AS dst FROM da x JOIN da y ON x.paper_id = y.paper_id AND x.author_id < y.author_id
  WHERE year(x.date) BETWEEN 2000 AND 2010), g AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id HAVING count(*) BETWEEN 2 AND 30)
SELECT src, dst FROM e WHERE src IN (SELECT id FROM g) AND dst IN (SELECT id FROM g)""")
def composed_network(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d, "author_ids", "date").withColumn("year", F.year("date"))
    return gr.compose(gr.coauthor_edges(p, by=["year"]), 2000, 2010, 2, 30)


@query(f"""WITH {CUR}, l AS (SELECT paper_id, list_sort(list_filter(author_ids, lambda x: x IS NOT NULL)) AS a FROM cur), p AS (SELECT paper_id, generate_subscripts(a, 1) AS i, unnest(a) AS a FROM l)
SELECT x.a AS src, y.a AS dst, count(*) AS times FROM p x JOIN p y ON x.paper_id = y.paper_id AND x.i < y.i WHERE x.a < y.a GROUP BY 1, 2 HAVING count(*) > 1""")
def multigraph_repeats(spark: SparkSession, d: str) -> DataFrame:
    m = gr.multigraph_edges(papers(spark, d, "author_ids")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))
    return m.where("times > 1")


@query(f"""WITH {EDGES}, hot AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 1) SELECT b AS coauthor FROM bidi WHERE a = (SELECT id FROM hot)""")
def coauthors_of(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    hot = gr.degrees(e).orderBy(F.desc("degree"), "id").first()
    return gr.neighbours(e, hot[0] if hot else -1)


@query(f"WITH {EDGES} SELECT id, degree FROM deg")
def author_degrees(spark: SparkSession, d: str) -> DataFrame:
    return gr.degrees(edges(spark, d))


@query(f"""WITH {DA} SELECT paper_id, string_agg(CAST(author_id AS VARCHAR), ',' ORDER BY author_id) AS members, count(*) AS size FROM da GROUP BY paper_id""")
def hyperedges(spark: SparkSession, d: str) -> DataFrame:
    h = gr.hyperedges(papers(spark, d, "author_ids"))
    return h.select("paper_id", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), "size")


@query(f"""WITH {EDGES}, t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON x.dst = y.src JOIN edges z ON z.src = x.src AND z.dst = y.dst),
n AS (SELECT id, count(*) AS triangles FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY id)
SELECT deg.id, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END, 4) AS clustering FROM deg LEFT JOIN n ON n.id = deg.id""")
def clustering_coefficients(spark: SparkSession, d: str) -> DataFrame:
    return gr.clustering(checkpointed(edges(spark, d))).withColumn("clustering", F.round("clustering", 4))


@query(f"WITH {EDGES} SELECT a AS id, round(avg(degree), 4) AS neighbour_degree FROM bidi JOIN deg ON deg.id = b GROUP BY a")
def neighbour_degree(spark: SparkSession, d: str) -> DataFrame:
    return gr.neighbour_degrees(edges(spark, d)).withColumn("neighbour_degree", F.round("neighbour_degree", 4))


@query(f"WITH {EDGES} SELECT round(corr(x.degree, y.degree), 4) AS assortativity FROM bidi JOIN deg x ON x.id = a JOIN deg y ON y.id = b")
def degree_assortativity(spark: SparkSession, d: str) -> DataFrame:
    return gr.degree_assortativity(edges(spark, d)).select(F.round("assortativity", 4).alias("assortativity"))


_COMP = EDGES + """,
cc(id, component) USING KEY (id) AS (SELECT DISTINCT a, a FROM bidi UNION
  (SELECT b.b, min(cc.component) FROM cc JOIN bidi b ON b.a = cc.id JOIN recurring.cc u ON u.id = b.b WHERE cc.component < u.component GROUP BY b.b))"""


@query(f"WITH RECURSIVE {_COMP} SELECT id, component FROM cc")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return gr.components(edges(spark, d))


@query(f"WITH RECURSIVE {_COMP} SELECT component, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS rank FROM cc GROUP BY component")
def component_ranking(spark: SparkSession, d: str) -> DataFrame:
    return gr.component_sizes(gr.components(edges(spark, d))).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""WITH RECURSIVE {_COMP}, v AS (SELECT component, count(*) AS vertices FROM cc GROUP BY component), e AS (SELECT component, count(*) AS edges FROM edges JOIN cc ON cc.id = src GROUP BY component)
SELECT v.component, vertices, edges, round(2.0 * edges / (vertices * (vertices - 1)), 4) AS density FROM v JOIN e ON e.component = v.component""")
def component_densities(spark: SparkSession, d: str) -> DataFrame:
    e = checkpointed(edges(spark, d))
    return gr.component_density(e, gr.components(e)).withColumn("density", F.round("density", 4))


@query(f"""WITH {EDGES}, a AS (SELECT id FROM deg WHERE degree BETWEEN 3 AND 12) SELECT DISTINCT paper_id FROM da WHERE author_id IN (SELECT id FROM a)""")
def papers_by_degree(spark: SparkSession, d: str) -> DataFrame:
    """Papers of the authors with 3 to 12 co-authors."""
    p, e = papers(spark, d, "author_ids"), checkpointed(edges(spark, d))
    return gr.documents_within(p, e, gr.authors_by_degree(e, 3, 12))[0].select("paper_id")


@query(f"""WITH RECURSIVE {_COMP}, n AS (SELECT component FROM cc GROUP BY component HAVING count(*) BETWEEN 2 AND 20) SELECT src, dst, cnt FROM edges JOIN cc ON cc.id = src WHERE component IN (SELECT component FROM n)""")
def links_by_component_size(spark: SparkSession, d: str) -> DataFrame:
    """Links of the connected components of 2 to 20 authors."""
    p, e = papers(spark, d, "author_ids"), checkpointed(edges(spark, d))
    return gr.documents_within(p, e, gr.authors_by_component(e, sizes=(2, 20)))[1]


@query(f"""WITH {DA}, b AS (SELECT author_id, min(year(date)) AS f, max(year(date)) AS l FROM da WHERE date IS NOT NULL GROUP BY author_id)
SELECT CASE WHEN l < 2010 THEN 'early' WHEN f >= 2010 THEN 'late' ELSE 'both' END AS time, author_id FROM b""")
def author_sets(spark: SparkSession, d: str) -> DataFrame:
    """Authors with papers only before 2010, only from then on, and both: difference and intersection of two sets."""
    p = papers(spark, d, "author_ids", "date").where("date IS NOT NULL")
    early, late = (col.merged_values(p.where(c), "author_ids") for c in ("year(date) < 2010", "year(date) >= 2010"))
    parts = {"early": early.exceptAll(late), "late": late.exceptAll(early), "both": early.intersect(late)}
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("time"), F.col("value").alias("author_id"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {DA}, n AS (SELECT count(*) AS n FROM da GROUP BY author_id) SELECT quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.99) AS p99 FROM n")
def productivity_percentiles(spark: SparkSession, d: str) -> DataFrame:
    n = gr.doc_authors(papers(spark, d, "author_ids")).groupBy("author_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(*[F.percentile("n", q).alias(name) for name, q in (("median", 0.5), ("p90", 0.9), ("p99", 0.99))])


@query("""SELECT b AS bin, 1 + b * 7.0 AS low, 1 + (b + 1) * 7.0 AS high, count(q) AS n FROM range(7) r(b) LEFT JOIN (SELECT CAST(l_quantity AS DOUBLE) AS q FROM lineitem) ON least(floor((q - 1) / 7.0), 6) = b AND q BETWEEN 1 AND 50 GROUP BY b""")
def quantity_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = col.histogram(table(spark, d, "lineitem"), "l_quantity", 1.0, 50.0, 7)
    return h.select(F.col("bin").cast("bigint").alias("bin"), "low", "high", "n")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON abs(CAST(c_acctbal AS DOUBLE) - CAST(s_acctbal AS DOUBLE)) <= 2.5")
def balance_band_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("a"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("b"))
    return col.band_join(c, s, "a", "b", 2.5).select("c_custkey", "s_suppkey")


@query(f"""WITH {DA}, n AS (SELECT author_id FROM da GROUP BY author_id HAVING count(*) BETWEEN 3 AND 5) SELECT DISTINCT paper_id FROM da WHERE author_id IN (SELECT author_id FROM n)""")
def papers_by_productivity(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d, "author_ids")
    n = gr.doc_authors(p).groupBy("author_id").agg(F.count(F.lit(1)).alias("n")).where("n BETWEEN 3 AND 5")
    return gr.documents_of(p, n).select("paper_id")


@query(f"""WITH {DA}, e AS (SELECT DISTINCT x.author_id AS src, y.author_id AS dst, year(x.date) AS y FROM da x JOIN da y ON x.paper_id = y.paper_id AND x.author_id < y.author_id WHERE x.date IS NOT NULL),
tr AS (SELECT DISTINCT src, dst FROM e WHERE y < 2010), te AS (SELECT DISTINCT src, dst FROM e WHERE y >= 2010), pr AS (SELECT DISTINCT src, dst FROM e WHERE y BETWEEN 2005 AND 2014),
c AS (SELECT (SELECT count(*) FROM (SELECT * FROM pr EXCEPT SELECT * FROM tr) x SEMI JOIN te USING (src, dst)) AS tp, (SELECT count(*) FROM (SELECT * FROM pr EXCEPT SELECT * FROM te)) AS fp, (SELECT count(*) FROM (SELECT * FROM te EXCEPT SELECT * FROM pr)) AS fn)
SELECT tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM
 (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS r FROM c)""")
def link_f1(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d, "author_ids", "date").where("date IS NOT NULL").withColumn("year", F.year("date"))
    e = gr.coauthor_edges(p, by=["year"])
    out = gr.link_scores(e.where("year BETWEEN 2005 AND 2014"), e.where("year < 2010"), e.where("year >= 2010"))
    return out.select("tp", "fp", "fn", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH v AS (SELECT label, list_position(e, list_max(e)) - 1 AS top FROM (SELECT label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS e FROM embeddings)),
c AS (SELECT label, top, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c),
a AS (SELECT sum(n) AS n FROM c GROUP BY label), b AS (SELECT sum(n) AS n FROM c GROUP BY top),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS same, (SELECT sum(n * (n - 1) / 2) FROM a) AS pa, (SELECT sum(n * (n - 1) / 2) FROM b) AS pb, t * (t - 1) / 2 AS pt,
 (SELECT sum(-n / t * ln(n / t)) FROM a) AS ha, (SELECT sum(-n / t * ln(n / t)) FROM b) AS hb, (SELECT sum(-n / t * ln(n / t)) FROM c) AS hab FROM t)
SELECT round((same - pa * pb / pt) / ((pa + pb) / 2 - pa * pb / pt), 4) AS ari, round((ha + hb - hab) / ((ha + hb) / 2), 4) AS nmi FROM s""")
def labeling_agreement(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", vec.argmax(F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x))).alias("top"))
    return gr.agreement(e, "label", "top").select(F.round("ari", 4).alias("ari"), F.round("nmi", 4).alias("nmi"))


@query()
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    """Seeds: each author who has a usable distribution, labelled by its main topic; the others take labels from them."""
    main = distributions(spark, d).groupBy(F.col("author_id").alias("id")).agg(F.max_by("topic", F.struct("p", "topic")).cast("bigint").alias("label"))
    e = edges(spark, d)
    return gr.propagate_labels(e, main.join(gr.degrees(e).select("id"), "id", "left_semi"))


@query()
def louvain_communities(spark: SparkSession, d: str) -> DataFrame:
    return gr.louvain(edges(spark, d))


#: Authors that ``distance_by_path_length`` starts from; each gives one pair per hop, so about 10,000 pairs in all.
SOURCES = 1_000


@query()
def distance_by_path_length(spark: SparkSession, d: str) -> DataFrame:
    e = checkpointed(edges(spark, d))
    rows = distributions(spark, d).groupBy(F.col("author_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("topic", "p"))).alias("m"))
    vectors = rows.select("id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda t: F.coalesce(F.element_at("m", t), F.lit(0.0))).alias("v"))
    sources = gr.degrees(e).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SOURCES).select(F.col("id").alias("source"))
    return gr.distance_by_path_length(e, sources, vectors, vec.hellinger)


# ---- time -----------------------------------------------------------------------------------------------------------


@query(f"WITH {CHUNK} SELECT paper_id, chunk_id FROM chunked")
def temporal_chunks(spark: SparkSession, d: str) -> DataFrame:
    return tm.with_chunks(papers(spark, d, "date")).select("paper_id", "chunk_id")


@query(f"WITH {CHUNK} SELECT chunk_id, chunk, start_date, end_date, n FROM stats")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return tm.chunk_statistics(tm.with_chunks(papers(spark, d, "date"))).withColumn("chunk", F.col("chunk").cast("bigint"))


@query(f"WITH {CHUNK} SELECT count(*) AS chunks, min(n) AS smallest, max(n) AS largest, round(avg(n), 4) AS mean, round(stddev_pop(n), 4) AS sd FROM stats")
def chunk_size_summary(spark: SparkSession, d: str) -> DataFrame:
    s = tm.size_summary(tm.chunk_statistics(tm.with_chunks(papers(spark, d, "date"))))
    return s.withColumn("mean", F.round("mean", 4)).withColumn("sd", F.round("sd", 4))


@query(f"""WITH {CHUNK}, k AS (SELECT chunk, n, greatest(least(4, n), n // 50) AS topics FROM stats) SELECT chunk, n, topics, coalesce(sum(topics) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_topic FROM k""")
def chunk_offsets(spark: SparkSession, d: str) -> DataFrame:
    return tm.topic_offsets(tm.chunk_statistics(tm.with_chunks(papers(spark, d, "date")))).withColumn("chunk", F.col("chunk").cast("bigint"))


_SIZES = CHUNK + """,
sizes AS (SELECT b.chunk AS base, c.chunk AS chunk, CAST(floor(power(CAST(0.3 AS DOUBLE), abs(b.chunk - c.chunk)) * c.n + 1e-9) AS BIGINT) AS wanted FROM stats b JOIN stats c ON b.chunk <> c.chunk
  WHERE floor(power(CAST(0.3 AS DOUBLE), abs(b.chunk - c.chunk)) * c.n + 1e-9) > 0)"""


@query(f"WITH {_SIZES} SELECT base, chunk, wanted FROM sizes")
def smoothing_sizes(spark: SparkSession, d: str) -> DataFrame:
    s = tm.smoothing_sizes(tm.chunk_statistics(tm.with_chunks(papers(spark, d, "date"))))
    return s.select(F.col("base").cast("bigint").alias("base"), F.col("chunk").cast("bigint").alias("chunk"), "wanted")


@query(f"""WITH {_SIZES}, dc AS (SELECT paper_id, chunk FROM chunked JOIN stats USING (chunk_id)), r AS (SELECT base, paper_id, wanted, row_number() OVER (PARTITION BY base, sizes.chunk ORDER BY md5('42-' || base || '-' || paper_id), paper_id) AS r FROM dc JOIN sizes ON sizes.chunk = dc.chunk)
SELECT base, paper_id, false AS is_base FROM r WHERE r <= wanted UNION ALL SELECT chunk, paper_id, true FROM dc""")
def smoothing_sample(spark: SparkSession, d: str) -> DataFrame:
    chunked = checkpointed(tm.with_chunks(papers(spark, d, "date")).select("paper_id", "date", "chunk_id"))
    stats = tm.chunk_statistics(chunked)
    docs = chunked.join(stats.select("chunk_id", "chunk"), "chunk_id").select("paper_id", "chunk")
    out = tm.smoothed_documents(docs, tm.smoothing_sizes(stats))
    return out.withColumn("base", F.col("base").cast("bigint"))


@query(f"WITH {DA} SELECT paper_id, author_id, n_authors, round(1.0 / n_authors, 6) AS w FROM dan")
def doc_author_weights(spark: SparkSession, d: str) -> DataFrame:
    return gr.doc_authors(papers(spark, d, "author_ids")).withColumn("w", F.round(1.0 / F.col("n_authors"), 6))


_BARY = DA + THETA[len(CUR):] + """,
w AS (SELECT paper_id, author_id, CAST(1.0 AS DOUBLE) / n_authors AS w FROM dan WHERE paper_id IN (SELECT paper_id FROM theta)),
bary AS (SELECT author_id, topic, sum(w * p) / max(t) AS p FROM w JOIN theta USING (paper_id) JOIN (SELECT author_id, sum(w) AS t FROM w GROUP BY author_id) USING (author_id) GROUP BY 1, 2)"""


@query(f"WITH {_BARY} SELECT author_id, topic, round(p, 6) AS p FROM bary")
def author_barycenters(spark: SparkSession, d: str) -> DataFrame:
    theta = checkpointed(letter_topics(spark, d))
    out = tm.author_barycentres(theta, gr.doc_authors(papers(spark, d, "author_ids")))
    return out.withColumn("p", F.round("p", 6))


_YEAR_TOPICS = CHUNK + """,
tok AS (SELECT paper_id, t FROM (SELECT paper_id, unnest(preprocessed_text) AS t FROM cur) WHERE t IS NOT NULL AND t <> ''),
pc AS (SELECT DISTINCT paper_id, c FROM (SELECT paper_id, unnest(categories) AS c FROM cur) WHERE c IS NOT NULL),
w AS (SELECT chunk, c AS topic, t AS term, CAST(count(*) AS DOUBLE) AS p FROM chunked JOIN stats USING (chunk_id) JOIN pc USING (paper_id) JOIN tok USING (paper_id) GROUP BY 1, 2, 3),
u AS (SELECT chunk, topic, term, p / sqrt(sum(p * p) OVER (PARTITION BY chunk, topic)) AS u FROM w),
s AS (SELECT x.chunk, x.topic, y.topic AS other, sum(x.u * y.u) AS s FROM u x JOIN u y ON y.chunk = x.chunk + 1 AND x.term = y.term GROUP BY 1, 2, 3),
b AS (SELECT k.chunk, k.topic, coalesce(max(s.s), 0) AS best FROM (SELECT DISTINCT chunk, topic FROM w WHERE chunk + 1 IN (SELECT chunk FROM w)) k LEFT JOIN s ON s.chunk = k.chunk AND s.topic = k.topic GROUP BY 1, 2)"""


@query(f"WITH {_YEAR_TOPICS} SELECT chunk, round(avg(best), 4) AS score FROM b GROUP BY chunk")
def alignment_scores(spark: SparkSession, d: str) -> DataFrame:
    chunked = checkpointed(tm.with_chunks(papers(spark, d, "date", "preprocessed_text", "categories")))
    number = tm.chunk_statistics(chunked).select("chunk_id", F.col("chunk").cast("bigint").alias("chunk"))
    rows = chunked.join(F.broadcast(number), "chunk_id").select("chunk", "preprocessed_text", F.explode(F.array_distinct(F.array_compact("categories"))).alias("topic"))
    rows = rows.select("chunk", "topic", F.explode("preprocessed_text").alias("term")).where("term <> ''")
    topics = checkpointed(rows.groupBy("chunk", "topic", "term").agg(F.count(F.lit(1)).cast("double").alias("p")))
    return tm.chunk_alignment(topics).withColumn("score", F.round("score", 4))


# ---- neighbours, diffusion, trees -------------------------------------------------------------------------------------

_HP = PHI + """,
nm AS (SELECT topic, term, CAST(weight AS DOUBLE) / sum(weight) OVER (PARTITION BY topic) AS p FROM phi),
hp AS (SELECT x.topic AS i, y.topic AS j, round(sqrt(greatest(0, 1 - sum(sqrt(x.p * y.p)))), 9) AS distance FROM nm x JOIN nm y ON x.term = y.term AND x.topic < y.topic GROUP BY 1, 2),
nn AS (SELECT i, j, distance, row_number() OVER (PARTITION BY i ORDER BY distance, j) AS rank FROM (SELECT i, j, distance FROM hp UNION ALL SELECT j, i, distance FROM hp)),
knn AS (SELECT * FROM nn WHERE rank <= 5),
dw AS (SELECT i, j, 1 - distance / t AS w FROM (SELECT *, sum(distance) OVER (PARTITION BY i) AS t FROM knn) WHERE t > 0)"""


def _topic_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = mf.hellinger_pairs(category_terms(spark, d).select("topic", "term", F.col("weight").cast("double").alias("p")))
    return checkpointed(pairs.withColumn("distance", F.round("distance", 9)))


@query(f"WITH {_HP} SELECT i, j, round(distance, 4) AS distance FROM hp")
def hellinger_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _topic_pairs(spark, d).withColumn("distance", F.round("distance", 4))


@query(f"WITH {_HP} SELECT i, j, round(distance, 4) AS distance, rank FROM knn")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    out = mf.nearest_topics(_topic_pairs(spark, d), 5)
    return out.select("i", "j", F.round("distance", 4).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_HP} SELECT i, j, round(w, 4) AS w FROM dw")
def diffusion_weights(spark: SparkSession, d: str) -> DataFrame:
    return mf.diffusion_weights(mf.nearest_topics(_topic_pairs(spark, d), 5)).withColumn("w", F.round("w", 4))


@query(f"""WITH {_HP}, x AS (SELECT paper_id, c AS topic, CAST(1.0 AS DOUBLE) / count(*) OVER (PARTITION BY paper_id) AS p FROM pc),
m AS (SELECT paper_id, i AS topic, 0.7 * sum(w * p) AS p FROM x JOIN dw ON dw.j = x.topic GROUP BY 1, 2 HAVING sum(w * p) > 0),
f AS (SELECT * FROM x UNION ALL SELECT m.* FROM m ANTI JOIN x USING (paper_id, topic))
SELECT paper_id, topic, round(p / sum(p) OVER (PARTITION BY paper_id), 4) AS p FROM f""")
def diffusion_step(spark: SparkSession, d: str) -> DataFrame:
    w = checkpointed(mf.diffusion_weights(mf.nearest_topics(_topic_pairs(spark, d), 5)))
    c = F.array_distinct(F.array_compact("categories"))
    x = papers(spark, d, "categories").select("paper_id", F.explode(c).alias("topic"), F.try_divide(F.lit(1.0), F.size(c)).alias("p"))
    return mf.diffuse(w, x, "paper_id").withColumn("p", F.round("p", 4))


def _tree(spark: SparkSession, d: str):
    pairs = _topic_pairs(spark, d)
    ids, m = mf.distance_matrix(category_terms(spark, d), pairs)
    return ids, mf.linkage(m, "average"), m


@query()
def topic_linkage(spark: SparkSession, d: str) -> DataFrame:
    _, z, _ = _tree(spark, d)
    return spark.createDataFrame([(i, int(a), int(b), float(h), int(n)) for i, (a, b, h, n) in enumerate(z)], "step int, left int, right int, height double, size int")


@query()
def dendrogram_cut(spark: SparkSession, d: str) -> DataFrame:
    ids, z, _ = _tree(spark, d)
    return spark.createDataFrame(list(zip(ids, mf.cut(z, 0.7, True))), "topic string, cluster int")


@query()
def topic_embedding(spark: SparkSession, d: str) -> DataFrame:
    ids, _, m = _tree(spark, d)
    return spark.createDataFrame([(t, float(a), float(b)) for t, (a, b) in zip(ids, mf.potential_embedding(m, 2))], "topic string, x double, y double")


@query()
def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    ids, z, _ = _tree(spark, d)
    nodes, _ = tree.tree_tables(spark, z, list(range(len(ids))))
    return nodes


# a tree over eight groups of topics (leaves 0 to 7): node, its children, and the leaves below them
_SPLITS = [(8, 0, 1), (9, 2, 3), (10, 4, 5), (11, 6, 7), (12, 8, 9), (13, 10, 11), (14, 12, 13)]
_BELOW: dict[int, list[int]] = {i: [i] for i in range(8)}
for _node, _left, _right in _SPLITS:
    _BELOW[_node] = _BELOW[_left] + _BELOW[_right]
_TREE = EDGES + ",\n" + DIST + f""",
tn(node, a, b, c, e) AS (VALUES {', '.join(f"({n}, {min(_BELOW[x])}, {max(_BELOW[x])}, {min(_BELOW[y])}, {max(_BELOW[y])})" for n, x, y in _SPLITS)}),
g AS (SELECT author_id, topic // 8 AS g, sum(p) AS p FROM dist GROUP BY 1, 2),
m AS (SELECT node, author_id, sum(CASE WHEN g BETWEEN a AND b THEN p ELSE 0 END) AS l, sum(CASE WHEN g BETWEEN c AND e THEN p ELSE 0 END) AS r FROM g, tn GROUP BY 1, 2),
o AS (SELECT node, author_id, l * (1 - r) AS x, r * (1 - l) AS y FROM m WHERE l > 0 OR r > 0),
bw AS (SELECT node, sum(x) * sum(y) AS mass FROM o GROUP BY node),
hit AS (SELECT u.node, sum(u.x * v.y + v.x * u.y) AS s FROM edges JOIN o u ON u.author_id = src JOIN o v ON v.author_id = dst AND v.node = u.node GROUP BY 1),
pr AS (SELECT tn.node, a, e, CASE WHEN mass > 0 THEN coalesce(s, 0) / mass ELSE 0 END AS p FROM tn LEFT JOIN bw USING (node) LEFT JOIN hit USING (node)),
lt AS (SELECT i, j, CASE WHEN i = j THEN 0 ELSE (SELECT arg_min(p, e - a) FROM pr WHERE i BETWEEN a AND e AND j BETWEEN a AND e) END AS p FROM range(8) x(i), range(8) y(j))"""


def _group_tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, closure, distributions over the groups, link probabilities) of the tree over eight groups of topics."""
    rows = [(i, None, None, 0.0, 1) for i in range(8)] + [(n, a, b, float(len(_BELOW[n])), len(_BELOW[n])) for n, a, b in _SPLITS]
    nodes = spark.createDataFrame(rows, "node int, left int, right int, height double, leaves int")
    closure = spark.createDataFrame([(n, leaf) for n, below in _BELOW.items() for leaf in below], "node int, leaf int")
    groups = checkpointed(distributions(spark, d).groupBy("author_id", F.floor(F.col("topic") / 8).cast("int").alias("topic")).agg(F.sum("p").alias("p")))
    return nodes, closure, groups, checkpointed(tree.link_probabilities(nodes, tree.node_authors(closure, groups), edges(spark, d)))


@query(f"WITH {_TREE} SELECT node, round(p, 8) AS probability FROM pr")
def link_probability(spark: SparkSession, d: str) -> DataFrame:
    return _group_tree(spark, d)[3].select(F.col("node").cast("bigint").alias("node"), F.round("probability", 8).alias("probability"))


@query(f"WITH {_TREE} SELECT i, j, round(p, 8) AS p FROM lt")
def link_table(spark: SparkSession, d: str) -> DataFrame:
    nodes, closure, _, p = _group_tree(spark, d)
    return tree.link_table(closure, nodes, nodes.where("node < 8"), p).select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.round("p", 8).alias("p"))


@query(f"WITH {_TREE} SELECT src, dst, round(sum(u.p * v.p * lt.p), 8) AS score FROM edges JOIN g u ON u.author_id = src JOIN g v ON v.author_id = dst JOIN lt ON lt.i = u.g AND lt.j = v.g GROUP BY 1, 2")
def link_likelihood(spark: SparkSession, d: str) -> DataFrame:
    nodes, closure, groups, p = _group_tree(spark, d)
    links = checkpointed(tree.link_table(closure, nodes, nodes.where("node < 8"), p))
    return tree.link_likelihood(edges(spark, d), groups, links).withColumn("score", F.round("score", 8))


@query(f"""WITH {DIST}, g AS (SELECT author_id, topic // 8 AS leaf, sum(p) AS p FROM dist GROUP BY 1, 2) SELECT author_id, leaf, round(p / sum(p) OVER (PARTITION BY author_id), 6) AS p FROM g""")
def leaf_distributions(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.createDataFrame([(t, t // 8) for t in range(64)], "topic int, leaf bigint")
    return tree.leaf_groups(distributions(spark, d), groups).withColumn("p", F.round("p", 6))


# ---- scores ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {DA}, {DIST}, t AS (SELECT author_id, p FROM dist QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY p DESC, topic) <= 10),
e AS (SELECT author_id, sum(-q * log2(q)) AS e FROM (SELECT author_id, p / sum(p) OVER (PARTITION BY author_id) AS q FROM t) GROUP BY author_id),
n AS (SELECT author_id, count(*) AS n FROM da GROUP BY author_id)
SELECT e.author_id, round(e * ln(1 + coalesce(n, 0)), 4) AS score FROM e LEFT JOIN n ON n.author_id = e.author_id""")
def interdisciplinarity_authors(spark: SparkSession, d: str) -> DataFrame:
    n = gr.doc_authors(papers(spark, d, "author_ids")).groupBy("author_id").agg(F.count(F.lit(1)).alias("n"))
    return sc.author_scores(distributions(spark, d), n, 10).withColumn("score", F.round("score", 4))


@query(f"""WITH {DA}{THETA[len(CUR):]}, n AS (SELECT author_id, count(*) AS n FROM da GROUP BY author_id), w AS (SELECT paper_id, avg(sqrt(n)) AS w FROM da JOIN n USING (author_id) GROUP BY paper_id),
k AS (SELECT paper_id FROM theta GROUP BY paper_id), f AS (SELECT k.paper_id, (coalesce(p, 0) + 1e-10) / (1 + 8 * 1e-10) AS q FROM k CROSS JOIN range(8) r(topic) LEFT JOIN theta ON theta.paper_id = k.paper_id AND theta.topic = r.topic)
SELECT f.paper_id, round(sum(-q * log2(q)) * coalesce(max(w), 1), 4) AS score FROM f LEFT JOIN w ON w.paper_id = f.paper_id GROUP BY f.paper_id""")
def interdisciplinarity_docs(spark: SparkSession, d: str) -> DataFrame:
    da = checkpointed(gr.doc_authors(papers(spark, d, "author_ids")))
    n = da.groupBy("author_id").agg(F.count(F.lit(1)).alias("n"))
    w = da.join(n, "author_id").groupBy("paper_id").agg(F.avg(F.sqrt("n")).alias("w"))
    return sc.document_scores(letter_topics(spark, d), "paper_id", 8, w).withColumn("score", F.round("score", 4))


@query(f"""WITH {DA}, {DIST}, h AS (SELECT paper_id, author_id FROM da WHERE author_id IN (SELECT author_id FROM dist)), n AS (SELECT paper_id, count(*) AS n FROM h GROUP BY paper_id),
m AS (SELECT paper_id, topic, sum(p) / max(n) AS q FROM h JOIN dist USING (author_id) JOIN n USING (paper_id) GROUP BY 1, 2) SELECT paper_id, round(sum(-q * log2(q + 1e-10)), 4) AS score FROM m GROUP BY paper_id""")
def team_interdisciplinarity(spark: SparkSession, d: str) -> DataFrame:
    return sc.team_scores(gr.doc_authors(papers(spark, d, "author_ids")), distributions(spark, d)).withColumn("score", F.round("score", 4))


@query(f"""WITH {DA}, {DIST}, t AS (SELECT author_id, topic, p FROM dist QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY p DESC, topic) <= 2),
s AS (SELECT paper_id, topic, sum(p) AS s FROM dan JOIN t USING (author_id) WHERE n_authors > 1 GROUP BY 1, 2)
SELECT paper_id, round(sum(-q * log2(q)), 4) AS score FROM (SELECT paper_id, s / sum(s) OVER (PARTITION BY paper_id) AS q FROM s) GROUP BY paper_id""")
def major_topic_score(spark: SparkSession, d: str) -> DataFrame:
    out = sc.major_topic_scores(gr.doc_authors(papers(spark, d, "author_ids")), distributions(spark, d), 2)
    return out.select("paper_id", F.round(F.col("score") + 0.0, 4).alias("score"))


@query(f"WITH {EDGES}, r AS (SELECT id, degree AS score, row_number() OVER (ORDER BY degree DESC, id) AS r, count(*) OVER () AS n FROM deg) SELECT id, score FROM r WHERE r <= greatest(1, n * 5 // 100)")
def top_percent(spark: SparkSession, d: str) -> DataFrame:
    return sc.top_percent(checkpointed(gr.degrees(edges(spark, d)).withColumnRenamed("degree", "score")), "id", 5)


@query(f"""WITH {EDGES}, n AS (SELECT author_id AS id, count(*) AS n FROM da GROUP BY author_id), c AS (SELECT degree AS x, n AS y, CAST(count(*) AS DOUBLE) AS w, row_number() OVER (ORDER BY degree, n) AS k FROM deg JOIN n USING (id) GROUP BY 1, 2)
SELECT round(sum(a.w * b.w * sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(a.w * b.w * abs(sign(a.x - b.x))) * sum(a.w * b.w * abs(sign(a.y - b.y)))), 4) AS tau FROM c a JOIN c b ON a.k < b.k""")
def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Of degree and number of papers, over all linked authors; the SQL counts pairs of distinct scores."""
    p = papers(spark, d, "author_ids")
    a = gr.degrees(gr.coauthor_edges(p)).select("id", F.col("degree").alias("score"))
    b = gr.doc_authors(p).groupBy(F.col("author_id").alias("id")).agg(F.count(F.lit(1)).alias("score"))
    return sc.kendall_tau(a, b, "id").select(F.round("tau", 4).alias("tau"))


@query(f"""WITH {_TREE}, ea AS (SELECT DISTINCT x.author_id AS src, y.author_id AS dst FROM da x JOIN da y ON x.paper_id = y.paper_id AND x.author_id < y.author_id WHERE year(x.date) < 2010),
eb AS (SELECT src AS a, dst AS b FROM ea UNION ALL SELECT dst, src FROM ea), lo AS (SELECT a FROM eb GROUP BY a HAVING count(*) <= 30),
ca AS (SELECT DISTINCT x.b AS src, y.b AS dst FROM eb x JOIN eb y ON x.a = y.a AND x.b < y.b WHERE x.a IN (SELECT a FROM lo)),
cn AS (SELECT * FROM ca EXCEPT SELECT src, dst FROM ea)
SELECT src, dst, round(sum(u.p * v.p * lt.p), 8) AS score, max(CASE WHEN (src, dst) IN (SELECT (src, dst) FROM edges) THEN 1 ELSE 0 END) = 1 AS linked_later
FROM cn JOIN g u ON u.author_id = src JOIN g v ON v.author_id = dst JOIN lt ON lt.i = u.g AND lt.j = v.g GROUP BY 1, 2""")
def predicted_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs not linked before 2010 that share a co-author of at most 30 links then, scored by the tree's link model, and
    whether they are linked by now."""
    early = checkpointed(gr.coauthor_edges(papers(spark, d, "author_ids", "date").where("year(date) < 2010")))
    nodes, closure, groups, p = _group_tree(spark, d)
    links = checkpointed(tree.link_table(closure, nodes, nodes.where("node < 8"), p))
    out = tree.link_likelihood(gr.two_hop_pairs(early, 30), groups, links)
    now = edges(spark, d).select("src", "dst", F.lit(True).alias("now"))
    return out.join(now, ["src", "dst"], "left").select("src", "dst", F.round("score", 8).alias("score"), F.coalesce("now", F.lit(False)).alias("linked_later"))


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), m AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.e, b.e)) AS t, count(*) AS n FROM v a JOIN v b ON true GROUP BY 1, 2, 3),
s AS (SELECT vec_id, max(CASE WHEN own = other AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b FROM m GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette FROM s""")
def silhouette_labels(spark: SparkSession, d: str) -> DataFrame:
    return ev.silhouette(table(spark, d, "embeddings"), "vec_id", "embedding", "label").select(F.round("silhouette", 4).alias("silhouette"))


# ---- author ids ----------------------------------------------------------------------------------------------------------

_STD = CUR + """,
std AS (SELECT DISTINCT name FROM (SELECT trim(substr(upper(trim(n)), 1, 20)) AS name FROM (SELECT unnest(author_names) AS n FROM cur) WHERE regexp_matches(trim(n), '^[A-Za-z]')) WHERE length(name) >= 2)"""


@query(f"WITH {_STD} SELECT name FROM std")
def author_standardize(spark: SparkSession, d: str) -> DataFrame:
    return aid.standard_names(papers(spark, d, "author_names"))


_GRAMS = _STD + f""",
cl AS (SELECT name, ' ' || trim(array_to_string(list_transform(range(1, length(u) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substr(u, CAST(i AS BIGINT) - 1, 1), '[a-z]') THEN upper(substr(u, CAST(i AS BIGINT), 1)) ELSE substr(u, CAST(i AS BIGINT), 1) END), '')) || ' ' AS s FROM (SELECT name, regexp_replace(t, ' +', ' ', 'g') AS u FROM (SELECT name, regexp_replace(replace(regexp_replace(lower(regexp_replace(name, '[^\\x00-\\x7F]', '', 'g')), '[)(.|\\[\\]{{}}'']', '', 'g'), '&', 'and'), '[,-]', ' ', 'g') AS t FROM std))),
gm AS (SELECT substr(name, 1, 2) AS block, name, substr(s, CAST(i AS BIGINT), 3) AS gram FROM (SELECT name, regexp_replace(s, '[,-./]|\\sBD', '', 'g') AS s FROM cl WHERE length(name) >= 3), LATERAL (SELECT unnest(range(1, greatest(length(s) - 1, 2))) AS i) WHERE length(s) >= 3)"""


@query(f"WITH {_GRAMS} SELECT gram, count(*) AS n FROM gm GROUP BY gram")
def author_ngrams(spark: SparkSession, d: str) -> DataFrame:
    names = aid.standard_names(papers(spark, d, "author_names"))
    return names.select(F.explode(tx.name_ngrams("name")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_GRAMS},
tf AS (SELECT block, name, gram, count(*) AS tf FROM gm GROUP BY 1, 2, 3), nd AS (SELECT substr(name, 1, 2) AS block, count(*) AS docs FROM std GROUP BY 1), df AS (SELECT block, gram, count(*) AS df FROM tf GROUP BY 1, 2),
x AS (SELECT tf.block, name, tf.gram, tf * (ln((docs + 1.0) / (df + 1)) + 1) AS x FROM tf JOIN df ON df.block = tf.block AND df.gram = tf.gram JOIN nd ON nd.block = tf.block),
w AS (SELECT block, name, gram, x / sqrt(sum(x * x) OVER (PARTITION BY block, name)) AS w FROM x)
SELECT block, a.name AS a, b.name AS b, round(sum(a.w * b.w), 4) AS similarity FROM w a JOIN w b USING (block, gram) WHERE a.name < b.name GROUP BY 1, 2, 3 HAVING sum(a.w * b.w) > 0.6""")
def author_name_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Names of one block with a cosine above 0.6."""
    return aid.similar_names(aid.standard_names(papers(spark, d, "author_names")), 0.6).withColumn("similarity", F.round("similarity", 4))


@query()
def author_id_assignment(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d, "author_names")
    return aid.assign_author_ids(p, checkpointed(aid.author_map(checkpointed(aid.standard_names(p)))))


# ---- models and streams ---------------------------------------------------------------------------------------------------


@query()
def lda_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topic models per year as the pipeline fits them: the ten best terms of each topic."""
    from folioscope.operators.topic_models import chunk_models
    from folioscope.plans.pipeline import Settings

    s = Settings()
    chunked = checkpointed(tm.with_chunks(papers(spark, d, "date"), s.months).select("paper_id", "date", "chunk_id"))
    stats = checkpointed(tm.chunk_statistics(chunked))
    docs = chunked.join(stats.select("chunk_id", "chunk"), "chunk_id").select("paper_id", "chunk")
    members = checkpointed(tm.smoothed_documents(docs, tm.smoothing_sizes(stats, s.decay), seed=s.seed))
    phi, _, _ = chunk_models(tokens(spark, d), members, tm.topic_offsets(stats, s.docs_per_topic), "paper_id", "tokens", s.seed, s.rounds)
    return vo.top_terms(phi, 10, "p")


@query("""SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts by the streaming operator, over all events there are."""
    from folioscope.session import checkpoint_dir
    from folioscope.streaming import streams

    like = table(spark, d, "events").schema
    root = f"{checkpoint_dir(spark)}/stream-{spark.sparkContext.applicationId}-{abs(hash(d)) % 10**8}-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    stream = streams.windowed_counts(streams.read_events(spark, d, "events.parquet", like), "ts", ["event_type"], "value", late="3650 days")
    # each batch replaces the table of counts in the shared folder; nothing is gathered in the driver
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/counts")
    q = stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/counts").select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


# ---- reading topics ----------------------------------------------------------------------------------------------------------


_SHARE = """,
sh AS (SELECT topic, term, CAST(weight AS DOUBLE) / sum(weight) OVER (PARTITION BY topic) AS p FROM phi),
rs AS (SELECT topic, term, p, round(0.6 * ln(greatest(p, 1e-12)) + (1 - 0.6) * (ln(greatest(p, 1e-12)) - ln(greatest(q, 1e-12))), 6) AS r FROM (SELECT *, sum(p) OVER (PARTITION BY term) / sum(p) OVER () AS q FROM sh)),
bt AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY r DESC, term) AS k FROM rs)"""


def _shares_of(weights: DataFrame) -> DataFrame:
    """(topic, term, p) of (topic, term, weight), written once."""
    total = weights.groupBy("topic").agg(F.sum("weight").alias("t"))
    return checkpointed(weights.join(total, "topic").select("topic", "term", (F.col("weight") / F.col("t")).alias("p")))


@query(f"WITH {PHI}{_SHARE} SELECT topic, term, round(p / sum(p) OVER (PARTITION BY topic), 6) AS p FROM bt WHERE k <= 10")
def filtered_topics(spark: SparkSession, d: str) -> DataFrame:
    """The ten most relevant terms of each category, as distributions."""
    from folioscope.operators.interpretation import filtered_topics as filtered

    return filtered(_shares_of(category_terms(spark, d)), 10, digits=6).withColumn("p", F.round("p", 6))


@query(f"WITH {TOK} SELECT t AS term, count(*) AS n FROM tok GROUP BY t ORDER BY n DESC, term LIMIT 200")
def frequent_words(spark: SparkSession, d: str) -> DataFrame:
    from folioscope.operators.interpretation import word_counts

    return word_counts(tokens(spark, d), "tokens", 200)


@query(f"""WITH {PHI}, q AS (SELECT topic, term, CAST(weight AS DOUBLE) / sum(weight) OVER (PARTITION BY topic) AS p FROM phi),
m AS (SELECT ascii(topic) % 4 AS cluster, term, round(avg(p), 9) AS p FROM q GROUP BY 1, 2)
SELECT cluster, term, round(p, 6) AS p, row_number() OVER (PARTITION BY cluster ORDER BY p DESC, term) AS rank FROM m QUALIFY rank <= 40""")
def cluster_words(spark: SparkSession, d: str) -> DataFrame:
    """Mean term probabilities over groups of categories (by their first letter)."""
    from folioscope.operators.interpretation import cluster_words as words

    phi = _shares_of(category_terms(spark, d))
    groups = phi.select("topic").distinct().withColumn("cluster", F.ascii("topic") % 4)
    return words(phi, groups, 40).select("cluster", "term", F.round("p", 6).alias("p"), F.col("rank").cast("bigint").alias("rank"))


_MAIN = DA + TOK[len(CUR):] + ",\n" + DIST + """,
mt AS (SELECT author_id, topic FROM dist QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY p DESC, topic) = 1),
fa AS (SELECT paper_id, min(author_id) AS author_id FROM da WHERE author_id IN (SELECT author_id FROM mt) GROUP BY paper_id),
phi AS (SELECT topic, t AS term, count(*) AS weight FROM fa JOIN mt USING (author_id) JOIN tok USING (paper_id) GROUP BY 1, 2)"""


@query(f"""WITH {_MAIN}{_SHARE}, ft AS (SELECT topic, term, p / sum(p) OVER (PARTITION BY topic) AS p FROM bt WHERE k <= 100),
s AS (SELECT author_id, term, sum(dist.p * ft.p) AS s FROM dist JOIN ft ON ft.topic = dist.topic GROUP BY 1, 2)
SELECT author_id, term, round(s / sum(s) OVER (PARTITION BY author_id), 5) AS p FROM s""")
def author_terms(spark: SparkSession, d: str) -> DataFrame:
    """Authors over the 100 most relevant terms of all their topics. A topic's terms are those of the papers whose first
    author with a distribution (the smallest id) has it as main topic."""
    from folioscope.operators.interpretation import author_term_distribution, filtered_topics as filtered

    dist = checkpointed(distributions(spark, d))
    main = dist.groupBy("author_id").agg(F.max_by("topic", F.struct("p", (-F.col("topic")).alias("t"))).alias("topic"))
    authors = gr.doc_authors(papers(spark, d, "author_ids")).join(main.select("author_id"), "author_id", "left_semi")
    first = authors.groupBy("paper_id").agg(F.min("author_id").alias("author_id")).join(main, "author_id")
    rows = first.join(tokens(spark, d), "paper_id").select("topic", F.explode("tokens").alias("term"))
    phi = _shares_of(rows.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("weight")))
    return author_term_distribution(dist, filtered(phi, 100, digits=6)).withColumn("p", F.round("p", 5))


@query(f"""WITH RECURSIVE {_HP}, g AS (SELECT i, j, min(distance) AS d FROM (SELECT i, j, distance FROM knn UNION ALL SELECT j, i, distance FROM knn) GROUP BY 1, 2),
sp(id, d, path) USING KEY (id) AS (SELECT min(i), CAST(0 AS DOUBLE), [min(i)] FROM knn UNION
 (SELECT g.j, min(sp.d + g.d), arg_min(list_append(sp.path, g.j), sp.d + g.d) FROM sp JOIN g ON g.i = sp.id LEFT JOIN recurring.sp o ON o.id = g.j WHERE o.d IS NULL OR sp.d + g.d < o.d GROUP BY g.j))
SELECT generate_subscripts(path, 1) - 1 AS step, unnest(path) AS topic FROM sp WHERE id = (SELECT max(i) FROM knn)""")
def topic_trajectory(spark: SparkSession, d: str) -> DataFrame:
    """The shortest path over neighbouring categories from the first to the last."""
    from folioscope.operators.interpretation import trajectory

    knn = checkpointed(mf.nearest_topics(_topic_pairs(spark, d), 5))
    ends = knn.agg(F.min("i"), F.max("i")).first()
    _, path = trajectory(knn, ends[0], ends[1])
    return spark.createDataFrame([(n, t) for n, t in enumerate(path)], "step int, topic string")


@query()
def path_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances along long shortest paths that share no link, 10,000 pairs if the network has them."""
    from folioscope.operators.interpretation import disjoint_longest_paths

    rows = distributions(spark, d).groupBy(F.col("author_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("topic", "p"))).alias("m"))
    vectors = rows.select("id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda t: F.coalesce(F.element_at("m", t), F.lit(0.0))).alias("v"))
    return disjoint_longest_paths(edges(spark, d), vectors, vec.hellinger)
