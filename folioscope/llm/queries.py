"""Queries of the training-data problems and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import cooccurrence, frequency, markup, mixing, name_variants, similar_vectors, tokens, toxicity
from folioscope.operators.current import current_rows, current_wide_rows
from folioscope.session import table


def _papers(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return current_rows(table(spark, sf_dir, "papers"), "paper_id", "ingested_at", columns)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence.pair_counts(_papers(spark, sf_dir, ["author_ids"]), "author_ids", 5)
    strong = F.col("n_ab") * F.col("n") >= 3 * F.col("n_a") * F.col("n_b")
    return pairs.where(strong).select(F.col("item_a").alias("author_a"), F.col("item_b").alias("author_b"))


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs with their counts, lift and corrected odds ratio."""
    pairs = cooccurrence.pair_counts(_papers(spark, sf_dir, ["author_ids"]), "author_ids")
    return pairs.select(
        F.col("item_a").alias("author_a"), F.col("item_b").alias("author_b"), "n_ab", "n_a", "n_b",
        F.round("lift", 4).alias("lift"), F.round("odds_ratio", 4).alias("odds_ratio"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions are labelled in place and only their bits are shuffled to find the current one."""
    papers = table(spark, sf_dir, "papers").where(F.col("paper_id").isNotNull())
    labelled = markup.label_markup(papers, "raw_text", ["paper_id", "ingested_at"])
    current = labelled.groupBy("paper_id").agg(F.max(F.struct("ingested_at", "kinds")).alias("r")).select("paper_id", "r.kinds")
    kinds = F.array(*[F.when(F.col("kinds").bitwiseAND(1 << i) > 0, name) for i, name in enumerate(markup.LABELS) if i])
    return current.where("kinds > 0").select("paper_id", F.explode(F.array_compact(kinds)).alias("structure"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean text of every current paper."""
    papers = _papers(spark, sf_dir, ["raw_text"])
    return markup.label_markup(papers, "raw_text", ["paper_id"], clean=True).select("paper_id", "clean_text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = table(spark, sf_dir, "author_topics")
    vectors = similar_vectors.usable_distributions(topics, "author_id", "computed_at", "author_topic_space_probs")
    near = similar_vectors.similar_distributions(vectors, 10, 0.15)
    return near.select(F.least("key", "other").alias("author_a"), F.greatest("key", "other").alias("author_b")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.linked_pairs(name_variants.link_names(table(spark, sf_dir, "name_variants")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = current_wide_rows(table(spark, sf_dir, "papers"), "paper_id", "ingested_at", ["preprocessed_text"])
    counts, total = frequency.ngram_counts(papers, frequency.normalised_terms(F.col("preprocessed_text")))
    marked = frequency.term_marks(counts, total).where(F.col("mark").isNotNull())
    return marked.select(F.get("ngram", F.lit(0)).alias("term"), "mark")


def p7_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all terms and pairs of neighbouring terms."""
    papers = current_wide_rows(table(spark, sf_dir, "papers"), "paper_id", "ingested_at", ["preprocessed_text"])
    counts, total = frequency.ngram_counts(papers, frequency.normalised_terms(F.col("preprocessed_text")), 2)
    return frequency.term_marks(counts, total).select(F.array_join("ngram", "\t").alias("ngram"), "occurrences", "records", "mark")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"), "text", ["doc_id"])


# The domains of the project's sources.
DOMAINS = {
    "preprint_feed": "papers", "journal_dump": "papers", "thesis_repo": "papers", "conference_site": "papers",
    "review_forum": "talk", "mailing_list": "talk",
    "lab_wiki": "records", "field_notes": "records", "ocr_scans": "scans", "tape_archive": "scans",
}


def _mix(spark: SparkSession, sf_dir: str, total: int | str | None = None) -> tuple[DataFrame, DataFrame]:
    documents = tokens.token_counts(table(spark, sf_dir, "documents"), "text", ["doc_id", "source", "lang"])
    return mixing.mix_sources(documents, table(spark, sf_dir, "mix_targets"), total=total, domains=DOMAINS)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p9_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the largest mixture in which no source with documents falls short of its target."""
    return _mix(spark, sf_dir, mixing.REACHABLE)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return scores.where("flagged").select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, flagged documents and their share per source."""
    return toxicity.rates(toxicity.toxicity_scores(table(spark, sf_dir, "documents"), "text", ["source"]), "source")


QUERIES = {
    "p1_found": p1_found, "p1_pairs": p1_pairs, "p2_found": p2_found, "p2_clean": p2_clean, "p4_found": p4_found, "p5_found": p5_found, "p7_found": p7_found, "p7_ngrams": p7_ngrams, "p8_ids": p8_ids,
    "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_reachable": p9_reachable,
    "p10_found": p10_found, "p10_rates": p10_rates,
}

_AUTHORS = """
cur AS (
  SELECT paper_id, author_ids FROM papers
  QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at DESC) = 1),
ids AS (
  SELECT DISTINCT paper_id, a FROM (SELECT paper_id, unnest(author_ids) AS a FROM cur) WHERE a IS NOT NULL),
tot AS (SELECT count(DISTINCT paper_id) AS n FROM ids),
one AS (SELECT a, count(*) AS n_a FROM ids GROUP BY a),
two AS (
  SELECT x.a AS author_a, y.a AS author_b, count(*) AS n_ab
  FROM ids x JOIN ids y ON x.paper_id = y.paper_id AND x.a < y.a GROUP BY 1, 2),
pairs AS (
  SELECT author_a, author_b, n_ab, p.n_a, q.n_a AS n_b, n
  FROM two JOIN one p ON p.a = author_a JOIN one q ON q.a = author_b CROSS JOIN tot)
"""
_TERMS = r"""
cur AS (
  SELECT paper_id, preprocessed_text FROM papers
  QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at DESC) = 1),
raw AS (SELECT paper_id, generate_subscripts(preprocessed_text, 1) AS i, unnest(preprocessed_text) AS t FROM cur),
clean AS (
  SELECT paper_id, i, lower(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS t FROM raw),
terms AS (
  SELECT paper_id, t, row_number() OVER (PARTITION BY paper_id ORDER BY i) AS pos FROM clean WHERE t IS NOT NULL AND t <> ''),
tot AS (SELECT count(DISTINCT paper_id) AS n FROM terms)
"""
_MARK = "CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.3 * (SELECT n FROM tot) THEN 'common' END"

SQL = {
    "p1_found": f"WITH {_AUTHORS} SELECT author_a, author_b FROM pairs WHERE n_ab >= 5 AND n_ab * n >= 3 * n_a * n_b",
    "p1_pairs": f"""WITH {_AUTHORS}
SELECT author_a, author_b, n_ab, n_a, n_b, round(CAST(n_ab AS DOUBLE) * n / (CAST(n_a AS DOUBLE) * n_b), 4) AS lift,
  round(((n_ab + CAST(0.5 AS DOUBLE)) * (n - n_a - n_b + n_ab + CAST(0.5 AS DOUBLE))) / ((n_a - n_ab + CAST(0.5 AS DOUBLE)) * (n_b - n_ab + CAST(0.5 AS DOUBLE))), 4) AS odds_ratio
FROM pairs""",
    "p4_found": """WITH cur AS (
  SELECT author_id AS a, CAST(author_topic_space_probs AS DOUBLE[]) AS v FROM author_topics WHERE author_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY computed_at DESC) = 1),
ok AS (SELECT a, v, list_sum(v) AS s FROM cur WHERE len(v) > 0 AND list_sum(v) > 0),
u AS (SELECT a, CAST(list_transform(v, lambda x: sqrt(x / s)) AS DOUBLE[64]) AS u FROM ok),
d AS (
  SELECT x.a AS a, y.a AS b, sqrt(greatest(0, 1 - array_inner_product(x.u, y.u))) AS h
  FROM u x JOIN u y ON x.a <> y.a AND array_inner_product(x.u, y.u) >= 0.97),
r AS (SELECT a, b, h, row_number() OVER (PARTITION BY a ORDER BY h, b) AS k FROM d)
SELECT DISTINCT least(a, b) AS author_a, greatest(a, b) AS author_b FROM r WHERE k <= 10 AND h <= 0.15""",
    "p7_found": f"""WITH {_TERMS},
c AS (SELECT t AS term, count(DISTINCT paper_id) AS records FROM terms GROUP BY t)
SELECT term, {_MARK} AS mark FROM c WHERE {_MARK} IS NOT NULL""",
    "p7_ngrams": f"""WITH {_TERMS},
grams AS (
  SELECT paper_id, t AS ngram FROM terms UNION ALL
  SELECT x.paper_id, x.t || chr(9) || y.t FROM terms x JOIN terms y ON x.paper_id = y.paper_id AND y.pos = x.pos + 1),
c AS (SELECT ngram, count(*) AS occurrences, count(DISTINCT paper_id) AS records FROM grams GROUP BY ngram)
SELECT ngram, occurrences, records, {_MARK} AS mark FROM c""",
}
