"""Frequency of every term and n-gram: suffix-sorted counting.

Every position of a record starts a suffix, cut after ``max_n`` terms. A task reads its records in one pass, sorts each
one's suffixes, and combines equal ones in a bounded table with mergeable states: the number of occurrences and, for
each prefix length, the number of records in which that prefix occurs here for the first time - so record counts of
prefixes just add up and no record sets are kept. The runs of all tasks are routed by their first term and sorted in
descending lexicographic order, and one pass with a stack adds up equal suffixes and gives the counts of all prefixes.
A frequent first term is spread by its second one; only the counts of single terms are added up once more for that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import checkpointed

_OUT = pa.schema([("ngram", pa.list_(pa.string())), ("occurrences", pa.int64()), ("records", pa.int64())])
_BATCH = 10_000
_RUN = pa.schema([("suffix", pa.list_(pa.string())), ("n", pa.int64()), ("firsts", pa.list_(pa.int64()))])
#: Suffixes of a task's table; a full table is given out and begun anew.
TABLE_SUFFIXES = 200_000
#: Second terms are spread over this many routes of their first term.
ROUTES = 64


def normalised_terms(terms: Column) -> Column:
    """Terms trimmed (any white space) and lower-cased; null and empty ones dropped; null arrays give an empty one."""
    clean = F.transform(terms, lambda t: F.lower(F.regexp_replace(t, "^\\s+|\\s+$", "")))
    return F.coalesce(F.filter(clean, lambda t: t.isNotNull() & (t != "")), F.array().cast("array<string>"))


def _stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all prefixes of suffixes that come in descending order; the stack holds the current path."""
    path: list[str] = []
    occurrences: list[int] = []
    records: list[int] = []
    out: tuple[list, list, list] = ([], [], [])

    def close(depth: int) -> None:
        while len(path) > depth:
            n = occurrences.pop()
            out[0].append(list(path))
            out[1].append(n)
            out[2].append(records.pop())
            path.pop()
            if path:
                occurrences[-1] += n

    for batch in batches:
        for suffix, n, firsts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            same = 0
            while same < len(path) and same < len(suffix) and path[same] == suffix[same]:
                same += 1
            close(same)
            for term in suffix[same:]:
                path.append(term)
                occurrences.append(0)
                records.append(0)
            occurrences[-1] += n
            for depth in range(len(suffix)):
                records[depth] += firsts[depth]
        if len(out[0]) >= _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _OUT)], schema=_OUT)
            out = ([], [], [])
    close(0)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _OUT)], schema=_OUT)


def _runs(lists: Iterator[list[str]], max_n: int) -> Iterator[dict[tuple[str, ...], list[int]]]:
    """Tables of suffixes with their states [n, first occurrences of prefixes of 1, 2, ... terms]. The empty suffix
    stands for the records that hold at least one term."""
    table: dict[tuple[str, ...], list[int]] = {}
    for terms in lists:
        if not terms:
            continue
        state = table.get(())
        if state is None:
            state = table[()] = [0] * (max_n + 1)
        state[0] += 1
        if max_n == 1:
            for term, n in Counter(terms).items():
                state = table.get((term,))
                if state is None:
                    table[(term,)] = [n, 1]
                else:
                    state[0] += n
                    state[1] += 1
        else:
            last: tuple[str, ...] = ()
            for suffix in sorted([tuple(terms[i : i + max_n]) for i in range(len(terms))], reverse=True):
                state = table.get(suffix)
                if state is None:
                    state = table[suffix] = [0] * (max_n + 1)
                state[0] += 1
                if suffix != last:
                    same = 0
                    while same < len(suffix) and same < len(last) and suffix[same] == last[same]:
                        same += 1
                    for depth in range(same + 1, len(suffix) + 1):
                        state[depth] += 1
                    last = suffix
        if len(table) >= TABLE_SUFFIXES:
            yield table
            table = {}
    yield table


def suffix_runs(df: DataFrame, terms: Column, max_n: int) -> DataFrame:
    """(suffix, n, firsts): suffixes of at most ``max_n`` terms with their mergeable states, combined within each task.
    The empty suffix stands for the records that hold at least one term: its n is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs((t for batch in batches for t in batch.column(0).to_pylist()), max_n):
            rows = [(list(k), v[0], v[1:]) for k, v in table.items()]
            for at in range(0, len(rows), _BATCH):
                columns = zip(*rows[at : at + _BATCH])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RUN)], schema=_RUN)

    return df.select(terms.alias("__t")).mapInArrow(run, "suffix array<string>, n bigint, firsts array<bigint>")


def ngram_counts(df: DataFrame, terms: Column, max_n: int = 1) -> tuple[DataFrame, int]:
    """((ngram, occurrences, records), number of records with a term) of all n-grams of 1 to ``max_n`` terms.

    ``df`` has one row per record; ``terms`` is an array column without nulls (see ``normalised_terms``).
    Records without terms count for nothing; an empty table gives no rows and 0.
    """
    runs = checkpointed(suffix_runs(df, terms, max_n))
    total = runs.where(F.size("suffix") == 0).agg(F.sum("n")).first()[0]
    route = [F.get("suffix", F.lit(0))]
    if max_n > 1:
        route.append(F.pmod(F.xxhash64(F.get("suffix", F.lit(1))), F.lit(ROUTES)))
    routed = runs.where(F.size("suffix") > 0).repartition(*route).sortWithinPartitions(F.desc("suffix"))
    counts = routed.mapInArrow(_stack, "ngram array<string>, occurrences bigint, records bigint")
    if max_n > 1:  # longer ones lie on one route
        counts = checkpointed(counts)
        one = counts.where(F.size("ngram") == 1).groupBy("ngram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        counts = one.unionByName(counts.where(F.size("ngram") > 1))
    return counts, int(total or 0)


def term_marks(counts: DataFrame, total: int, rare: int = 2, common: float = 0.3) -> DataFrame:
    """Adds ``mark``: ``rare`` for n-grams in at most ``rare`` records, ``common`` for those in more than the
    share ``common`` of all records with a term, else null. A term that is both (tiny collections) is rare."""
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * total, "common")
    return counts.withColumn("mark", mark)
