"""Several values packed in one string: quoted spans become placeholders, the rest is split, spans come back.

All steps are built-in string and array expressions; nothing leaves the JVM and nothing is shuffled but
the final removal of repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.bind import let

# Marks of a placeholder. An input that holds MARK itself is escaped with ESCAPE first, so a
# placeholder (MARK, digits, CLOSE) can never be confused with what stood in the input.
MARK, CLOSE, ESCAPE = "\ue000", "\ue001", "\ue002"

# What stands in a field for "no value".
PLACEHOLDERS = ["-", "--", "?", ".", "n/a", "na", "n.a.", "none", "null", "nil", "unknown", "anonymous", "tba", "tbd"]

# Particles that belong to a family name, and what may follow a name.
PARTICLES = ["van", "von", "der", "den", "de", "la", "le", "du", "da", "di", "del", "ten", "ter", "zu", "zum", "af", "av"]
SUFFIXES = ["Jr", "Sr", "II", "III", "IV", "PhD", "MD"]

# What stands before a quoted span: the start of the field or a separator with any blanks. It is part of the match, and
# a ";" takes its place. After an inner bracket, which stays, there may be a few blanks only.
_BEFORE = r"(?:(?:^|[;,|\t\n\r]|\s/)\s*+|(?<=\[\s{0,8}))"
_AFTER = r"(?=\s*(?:$|[;,|/\t\n\r\]]))"
_QUOTED_LIST = rf"{_BEFORE}(\"(?:[^\"]++|\"\")*+\"|'(?:[^']++|'(?!\s*(?:$|[,;\]])))*+'){_AFTER}"


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\u000b\f\r\u00a0\u200b\ufeff"))


def _mask(text: Column, span: str, groups: int) -> Column:
    """Struct of ``masked``, the text with the i-th match of ``span`` replaced by placeholder i, and ``spans``, what the
    matches hold: group 1 (quoted; a ";" goes before its placeholder) or group 2. The pattern must not match "", else
    split and extract would disagree."""
    quoted = F.regexp_extract_all(text, F.lit(span), F.lit(1))
    listed = F.regexp_extract_all(text, F.lit(span), F.lit(2)) if groups > 1 else quoted

    def put(q: Column) -> Column:
        pieces = F.transform(
            F.split(text, span, -1),
            lambda piece, i: F.when(i == 0, piece).otherwise(
                F.concat(F.when(F.get(q, i - 1) != "", ";").otherwise(""), F.lit(MARK), (i - 1).cast("string"), F.lit(CLOSE), piece)
            ),
        )
        spans = F.zip_with(q, listed, lambda a, b: F.when(a != "", a).otherwise(b))
        return F.struct(F.array_join(pieces, "").alias("masked"), spans.alias("spans"))

    return let(quoted, put)


def _restore(value: Column, spans: Column) -> Column:
    """Every placeholder of ``value`` replaced by its span through the array."""
    place = f"{MARK}([0-9]+){CLOSE}"

    def put(index: Column) -> Column:
        pieces = F.transform(
            F.split(value, place, -1),
            lambda piece, i: F.when(i == 0, piece).otherwise(F.concat(F.get(spans, F.get(index, i - 1).cast("int")), piece)),
        )
        return F.array_join(pieces, "")

    filled = let(F.regexp_extract_all(value, F.lit(place), F.lit(1)), put)
    return F.when(value.contains(MARK), filled).otherwise(value)


def _unquote(value: Column) -> Column:
    """Without enclosing quotes; doubled quotes inside become one."""
    double = value.rlike(r'(?s)^".*"$') & (F.length(value) >= 2)
    single = value.rlike(r"(?s)^'.*'$") & (F.length(value) >= 2)
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    return (
        F.when(double, F.replace(inner, F.lit('""'), F.lit('"')))
        .when(single, F.replace(inner, F.lit("''"), F.lit("'")))
        .otherwise(value)
    )


def _words(c: Column) -> Column:
    """Number of words of a name that are neither particles, initials nor suffixes."""
    bare = F.regexp_replace(c, rf"(?i)(?<![\p{{L}}'-])(?:{'|'.join(PARTICLES)})(?=\s)", " ")
    bare = F.regexp_replace(bare, rf"(?<![\p{{L}}])(?:{'|'.join(SUFFIXES)})\.?(?![\p{{L}}])", " ")
    bare = F.regexp_replace(bare, r"(?<![\p{L}])\p{L}\.", " ")
    return F.size(F.regexp_extract_all(bare, F.lit(rf"[\p{{L}}{MARK}][\p{{L}}\p{{N}}{CLOSE}'&.-]*"), F.lit(0)))


def _finish(parts: Column, spans: Column) -> Column:
    """Restored, trimmed, unquoted and non-empty values in their order."""

    def value(v: Column) -> Column:
        bare = let(_trim(_restore(v, spans)), _unquote)
        return _trim(F.replace(bare, F.lit(MARK + ESCAPE), F.lit(MARK)))

    return F.filter(F.transform(parts, value), lambda v: v != "")


def _open(field: Column) -> Column:
    """Escaped, trimmed, without the brackets of the whole list; null and placeholders for nothing become ""."""

    def inner(text: Column) -> Column:
        listed = text.rlike(r"(?s)^\[.*\]$") & ~text.rlike(r"(?s)^\[[^\]]*\].*\[[^\]]*\]$")
        body = F.when(listed, _trim(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)
        return F.when(F.lower(body).isin(PLACEHOLDERS), F.lit("")).otherwise(body)

    return let(_trim(F.replace(F.coalesce(field, F.lit("")), F.lit(MARK), F.lit(MARK + ESCAPE))), inner)


def split_names(field: Column) -> Column:
    """Array of the names in a packed author field, in order.

    Quoted spans are one value each. Outside them a line break, tab, ``;``, ``|`` and a spaced ``/`` separate;
    ``and`` and ``&`` separate between two names of two words or more, so that "Institute of Rivers and Lakes"
    and "Ashe & Birk Survey" stay whole. A comma separates where every part is a full name; else it stands
    inside "Last, First", and a plain comma list of "Last, F." is read in pairs, a "Jr." staying with its name.
    Null gives an empty array, as do blank fields and placeholders such as "N/A".
    """
    hard = r"[\r\n\t;|]+(?!\s*Section\s+[A-Z0-9]\b)|\s+/\s+"
    word = rf"[^\s;|,/&{MARK}]++"
    link = r"\s+(?:and|AND|&)\s+"
    two_before = rf"(?:^|[\s,])(?!and\s|AND\s|&\s){word},?\s+{word}"
    comma = r"\s*,\s*(?:(?:and|AND|&)\s+)?"
    ends = "|".join(SUFFIXES)

    def soft(p: Column, left: str, right: str) -> Column:
        """Parts at each "and" between texts that end like ``left`` and begin like ``right``; elsewhere it stays."""

        def fold(x: Column) -> Column:
            def step(done: Column, i: Column) -> Column:
                before, after = F.get(x["parts"], i - 1), F.get(x["parts"], i)
                whole = F.concat(F.element_at(done, -1), F.get(x["links"], i - 1), after)
                names = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.regexp_replace(F.element_at(done, -1), r",\s*$", ""), after))
                return F.when(before.rlike(left) & after.rlike(right), names).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(whole)))

            return F.aggregate(F.sequence(F.lit(1), F.size(x["links"])), F.array(F.get(x["parts"], F.lit(0))), step)

        split = let(F.struct(F.split(p, link, -1).alias("parts"), F.regexp_extract_all(p, F.lit(link), F.lit(0)).alias("links")), fold)
        return F.when(p.rlike(link), split).otherwise(F.array(p))

    def soft_full(p: Column) -> Column:
        """Between full names ("A B and C D")."""
        return soft(p, rf"(?:,|{two_before},?)$", rf"^{word}\s+(?!/){word}")

    def soft_last(p: Column) -> Column:
        """Between "Last, First" names as well."""
        return soft(p, rf"{two_before}$", rf"^{word},?\s+(?!/){word}")

    def full(p: Column) -> Column:
        return (_words(p) >= 2) | p.contains(MARK)

    def paired(masked: Column, by_soft: Column) -> Column:
        # "Last, F., Last, F.": pairs; a suffix goes to the name before it
        kept = F.regexp_replace(masked, rf"\s*,\s*(?=(?:{ends})\.?\s*(?:,|$))", f"{ESCAPE} ")
        flat = F.filter(F.split(kept, r"\s*,\s*", -1), lambda p: _trim(p) != "")

        def choose(flat: Column) -> Column:
            pairs = F.transform(
                F.sequence(F.lit(0), F.greatest((F.size(flat) / 2).cast("int") - 1, F.lit(0))),
                lambda i: F.replace(F.concat_ws(", ", F.get(flat, 2 * i), F.get(flat, 2 * i + 1)), F.lit(ESCAPE), F.lit(",")),
            )
            fits = (F.size(flat) >= 4) & (F.size(flat) % 2 == 0) & F.forall(flat, lambda p: _words(p) <= 1)
            fits = fits & ~F.exists(flat, lambda p: p.rlike(rf"(?i)^(?:{ends})\.?$"))
            return F.when(fits, pairs).otherwise(by_soft)

        return F.when(F.size(by_soft) == 1, let(flat, choose)).otherwise(by_soft)

    def by_pieces(masked: Column, spans: Column, pieces: Column) -> Column:
        quoted = F.flatten(F.transform(pieces, lambda p: F.split(p, rf"\s*,\s*(?={MARK})|(?<={CLOSE})\s*,\s*", -1)))
        by_soft = F.flatten(F.transform(pieces, soft_last))

        def unquoted(listed: Column) -> Column:
            by_comma = F.flatten(F.transform(F.split(masked, comma, -1), soft_full))
            comma_list = (F.size(listed) > 1) & F.forall(listed, full)
            return F.when(comma_list, by_comma).otherwise(let(by_soft, lambda names: paired(masked, names)))

        one = let(F.filter(F.split(masked, comma, -1), lambda p: _trim(p) != ""), unquoted)
        parts = F.when(F.size(spans) > 0, quoted).when(F.size(pieces) > 1, by_soft).otherwise(one)
        return _finish(parts, spans)

    def split(m: Column) -> Column:
        pieces = F.filter(F.split(m["masked"], hard, -1), lambda p: _trim(p) != "")
        return let(pieces, lambda p: by_pieces(m["masked"], m["spans"], p))

    none = F.array().cast("array<string>")
    return let(_open(field), lambda text: F.when(text == "", none).otherwise(let(_mask(text, _QUOTED_LIST, 1), split)))


def _known_pattern(known: Iterable[str]) -> str:
    """Alternation of the known values that separators could cut, longest first."""
    cut = sorted({k for k in known if k and re.search(r"[^\w.-]", k)}, key=lambda k: (-len(k), k))
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", k).replace(" ", r"\s") for k in cut)


def split_codes(field: Column, known: Iterable[str]) -> Column:
    """Array of the codes or labels in a packed category field, in order.

    ``known``: the values of a closed list (bounded: it becomes a pattern); those that hold a separator are
    protected as quoted spans are. Then ``, ; |``, tabs, line breaks and blanks separate. Null, blank fields
    and placeholders give an empty array.
    """
    protected = _known_pattern(known)
    span = _QUOTED_LIST + (rf"|(?<![\p{{L}}\p{{N}}])({protected})(?![\p{{L}}\p{{N}}])" if protected else "")
    none = F.array().cast("array<string>")

    def split(m: Column) -> Column:
        return _finish(F.split(m["masked"], r"[,;|\s]+", -1), m["spans"])

    return let(_open(field), lambda text: F.when(text == "", none).otherwise(let(_mask(text, span, 2 if protected else 1), split)))


def unpack_fields(df: DataFrame, key: str, fields: dict[str, Column], least: int = 1) -> DataFrame:
    """One row (``key``, ``field``, ``pos``, ``val``) per value; ``fields`` maps a name to an array column.

    Fields with fewer than ``least`` values give no rows. Exact repeats of a row come out once.
    """
    arrays = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("vals")) for n, c in fields.items()])
    rows = df.select(F.col(key), F.explode(arrays).alias("f")).where(F.size("f.vals") >= least)
    rows = rows.select(key, F.col("f.field").alias("field"), F.posexplode("f.vals").alias("pos", "val"))
    return rows.select(key, "field", (F.col("pos") + 1).cast("int").alias("pos"), "val").distinct()
