"""Queries of the general problems: packed fields (3) and skewed keys (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.current import current_rows
from folioscope.operators.packed_fields import split_codes, split_names, unpack_fields
from folioscope.operators.skewed_keys import heavy_keys, key_results
from folioscope.session import table

# The closed list of categories becomes part of a pattern; beyond this it would have to be joined instead.
MAX_KNOWN = 10_000


def known_categories(spark: SparkSession, sf_dir: str) -> list[str]:
    """Codes and labels of category_list; raises above MAX_KNOWN rather than collecting an unbounded table."""
    rows = table(spark, sf_dir, "category_list").select("category", "label").limit(MAX_KNOWN + 1).collect()
    if len(rows) > MAX_KNOWN:
        raise ValueError(f"category_list has more than {MAX_KNOWN} rows")
    return [v for r in rows for v in r if v]


def p3_values(spark: SparkSession, sf_dir: str, least: int = 1) -> DataFrame:
    """Every value of both packed fields; ``least`` = 2 keeps the fields that hold several."""
    known = known_categories(spark, sf_dir)
    entries = table(spark, sf_dir, "raw_entries").select("entry_id", "author_names", "categories")
    fields = {"author_names": split_names(F.col("author_names")), "categories": split_codes(F.col("categories"), known)}
    return unpack_fields(entries, "entry_id", fields, least)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_values(spark, sf_dir, 2)


def _papers(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return current_rows(table(spark, sf_dir, "papers"), "paper_id", "ingested_at", columns)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = _papers(spark, sf_dir, ["author_ids", "categories", "date"])
    return heavy_keys(papers, "paper_id", ["author_ids", "categories"], "date", 0.02, 20)


def p6_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = _papers(spark, sf_dir, ["author_ids", "categories", "date"])
    return key_results(papers, "paper_id", ["author_ids", "categories"], "date", "author_ids")


_CURRENT = """
cur AS (
  SELECT paper_id, author_ids, categories, date FROM papers
  QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at DESC) = 1),
keys AS (
  SELECT DISTINCT paper_id, date, 'author_ids' AS field, CAST(k AS VARCHAR) AS item_key
  FROM (SELECT paper_id, date, unnest(author_ids) AS k FROM cur) WHERE k IS NOT NULL
  UNION ALL
  SELECT DISTINCT paper_id, date, 'categories', k
  FROM (SELECT paper_id, date, unnest(categories) AS k FROM cur) WHERE k IS NOT NULL)
"""

QUERIES = {"p3_found": p3_found, "p6_found": p6_found, "p6_results": p6_results}

SQL = {
    "p6_found": f"""WITH {_CURRENT}
SELECT field, item_key FROM keys GROUP BY field, item_key
HAVING count(*) >= 20 AND count(*) >= 0.02 * (SELECT count(*) FROM cur)""",
    "p6_results": f"""WITH {_CURRENT},
pairs AS (
  SELECT k.field, k.item_key, count(DISTINCT a.item_key) AS coauthors
  FROM keys k JOIN keys a ON a.paper_id = k.paper_id AND a.field = 'author_ids'
  WHERE k.field <> 'author_ids' OR a.item_key <> k.item_key GROUP BY 1, 2)
SELECT c.field, c.item_key, c.papers, c.first_date, c.last_date, coalesce(p.coauthors, 0) AS coauthors
FROM (SELECT field, item_key, count(*) AS papers, min(date) AS first_date, max(date) AS last_date
      FROM keys GROUP BY 1, 2) c
LEFT JOIN pairs p ON p.field = c.field AND p.item_key = c.item_key""",
}
