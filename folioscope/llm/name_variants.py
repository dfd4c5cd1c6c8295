"""Variant spellings of names: metric-space partitioning with exact radius joins, then linking.

1. A spelling is read into a key string (the family name; the initials of an organisation) and the rest (given name or
   initial, middle initials; the words of an organisation).
2. The distinct family names, and apart from them the words of organisations that are written out, form a metric space under the unrestricted Damerau-Levenshtein distance. Each goes to
   the cell of its nearest pivot and, by the triangle inequality, as a guest to every cell whose pivot is at most
   2 * radius farther; within a cell, home strings meet all members, pivot distances rule most pairs out, and the
   edit distance decides. This finds every pair within the radius, whatever the pivots are. A cell with many home
   strings gets pivots of its own, level after level, so cells stay small however many strings there are.
3. Spellings whose keys are within the radius and whose affiliations agree are compared by the rest. Full names
   that agree form groups (connected components); initials and abbreviations join a group only if it is the only
   one that fits; spellings of unknown affiliation likewise, over all affiliations, and those that fit nowhere among
   themselves.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from folioscope.llm.graph_labels import component_labels
from folioscope.session import checkpointed

RADIUS = 1
#: Pivots are drawn from about this many strings of a cell (the smallest hashes); every string is partitioned.
PIVOT_SAMPLE = 2_000
#: Pivots of one cell. Cells with more home strings than CELL_STRINGS are parted again, unless their strings cannot be
#: told apart by pivots (LEVELS).
MIN_PIVOTS, MAX_PIVOTS = 8, 128
CELL_STRINGS, LEVELS = 4_000, 6

# Titles, particles and suffixes that do not tell persons apart.
TITLES = "dr prof professor mr mrs ms sir phd md".split()
PARTICLES = "van von der den de la le du da di del ten ter zu zum af av".split()
SUFFIXES = "jr sr ii iii iv".split()

# Full given name, then its short forms and spellings.
SHORT_FORMS = """
adela: addie dela / albert: al bert / alexander: alex sasha sandy xander / alina: lina / amara: mara
andrea: andi andy / anton: tony toni / arthur: art artie / astrid: asta / beatrice: bea trixie / benjamin: ben benny
birgit: gitta bibi / bruno: bruni / camilla: milla cam cami / carlos: carlo charly / caroline: carrie caro carol lina
catherine: cathy kate cat katie / christian: chris / clara: clare / daniel: dan danny / daria: dasha / david: dave davy
deborah: debbie deb / dimitri: dima mitya / dominic: dom nick / edmund: ed eddie ned ted / edward: ed eddie ned ted
elena: lena ellie nell / elizabeth: liz beth lizzie betty eliza lisa / emil: milo / erika: rika / esther: essie
fatima: fati / felix: fee lix / fiona: fi / frederick: fred freddie fritz / gabriel: gabe / george: georgie / greta: gretel
gustav: gus / hanna: hanni / harold: harry hal / helena: lena nell helen / henry: hank harry hal / hugo: huey
ibrahim: ibo / ingrid: inga / irene: rena reni / isabel: bella izzy isa / ivan: vanya / jacob: jake / james: jim jimmy jamie
jasmin: jas / joanna: jo joan / jonas: jon / joseph: joe joey / julia: jule julie / karim: kari / katarina: kat kaja katja
kenneth: ken kenny / kirsten: kirsty / lars: lasse / laura: laurie / leo: leon / linda: lindy / lucas: luke luc
magdalena: magda lena / margaret: maggie peggy meg marge greta / maria: mary mia / marcus: mark marc / martin: marty
matilda: tilda tilly mattie / matthew: matt / michael: mike mick / miriam: mimi mim / nadia: nadja / natalie: nat tally
nicholas: nick nicky nico / nina: nin / noah: noe / oliver: ollie / olga: olya / omar: omi / oscar: ossie
patricia: pat trish patty tricia / paul: pauly / petra: peti / philip: phil pip / rachel: rae / rafael: rafa raff
rebecca: becky becca / richard: rick dick rich richie / robert: bob rob bobby bert robbie / rosa: rosie / rupert: rupe
samuel: sam sammy / sandra: sandy / sebastian: seb bastian / simon: si / sofia: sofie / stefan: steve stef / susan: sue susie
tamara: tammy tam / teresa: terry tess / theodore: ted theo teddy / thomas: tom tommy / timothy: tim timmy / ulrike: uli
valentin: val / vera: verena / victor: vic / victoria: vicky tori / viktor: vik / walter: walt wally / william: bill will billy
yasmin: yas / yusuf: yus / zachary: zach zack / zoe: zo
andrew: andy drew / anthony: tony / barbara: barb babs / charles: charlie chuck / dolores: lola / donald: don donnie
eugene: gene / francis: frank / francisco: paco pancho / friedrich: fritz / gerald: gerry jerry / giovanni: gianni
giuseppe: beppe pino / gregory: greg / guadalupe: lupe / ignacio: nacho / jeffrey: jeff / jennifer: jen jenny
jessica: jess jessie / johannes: hannes hans / jonathan: jon jonny / josef: sepp / jose: pepe / joshua: josh / judith: judy
kimberly: kim / lawrence: larry / leonard: len lenny / luigi: gigi / mikhail: misha / mitchell: mitch / nathaniel: nate
nikolai: kolya / pamela: pam / raymond: ray / ronald: ron ronnie / russell: russ / sarah: sally / sergei: seryozha
stephanie: steph / vincent: vince vinny / virginia: ginny / vladimir: vova volodya / yevgeny: zhenya
"""
SHORT: dict[str, set[str]] = {}
for _entry in re.split(r"[/\n]", SHORT_FORMS.strip()):
    _full, _, _rest = _entry.partition(":")
    for _name in [_full.strip(), *_rest.split()]:
        SHORT.setdefault(_name, set()).add(_full.strip())

# Kinds of organisation and their usual abbreviations.
ORG_KINDS = {
    "institute": "inst", "laboratory": "lab", "centre": "ctr", "center": "ctr", "observatory": "obs", "station": "stn",
    "survey": "surv", "consortium": "consort", "academy": "acad", "university": "univ", "department": "dept",
    "group": "grp", "society": "soc", "foundation": "found", "museum": "mus", "college": "coll",
}
ORG_STOP = {"the", "of", "and", "for", "in", "on"}
AFFILIATION_WORDS = {"univ": "university", "inst": "institute", "acad": "academy", "sci": "sciences", "tech": "technology",
                     "lab": "laboratory", "dept": "department", "coll": "college", "ctr": "centre", "center": "centre"}


def fold(text: str) -> str:
    """Lower case without accents; digits that scanners put for letters become those letters inside words."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    flat = flat.replace("ø", "o").replace("ł", "l").replace("ß", "ss").replace("æ", "ae")
    flat = re.sub(r"(?<=[a-z])[01](?=[a-z. ,]|$)|(?<![a-z0-9])[01](?=[a-z])", lambda m: "o" if m[0] == "0" else "l", flat)
    return re.sub(r"(?<=[a-z])[01](?=[a-z])", lambda m: "o" if m[0] == "0" else "l", flat)


# Letter groups that look like one letter in print.
LOOKALIKES = [("rn", "m"), ("cl", "d"), ("vv", "w"), ("li", "h")]


def affiliation_key(text: str | None) -> str | None:
    """The same string for all usual ways to write one affiliation; None for null and blank."""
    words = re.findall(r"[a-z0-9]+", fold(text)) if text else []
    words = sorted({AFFILIATION_WORDS.get(w, w) for w in words if w not in ORG_STOP})
    return " ".join(words) or None


def within_one(a: str, b: str) -> bool:
    """Damerau-Levenshtein distance of at most 1."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words by place, lengths): code points, padded with 0."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    out = np.zeros((len(words), int(lengths.max(initial=0))), dtype=np.int32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    out[np.repeat(np.arange(len(words)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out, lengths


#: Cells of the tables of distances that are held at once (2 bytes each).
_TABLE_CELLS = 16_000_000


def distances_to(words: list[str], pivots: list[str]) -> np.ndarray:
    """(word, pivot): unrestricted Damerau-Levenshtein distances. All words meet all pivots in one table, a vector step per
    pair of places."""
    b, m_lengths = _letters(pivots)
    longest = max((len(w) for w in words), default=0)
    step = max(1, _TABLE_CELLS // max(1, len(pivots) * (b.shape[1] + 2) * (longest + 2)))
    parts = [_distance_table(words[i : i + step], b, m_lengths) for i in range(0, len(words), step)]
    return np.concatenate(parts) if parts else np.zeros((0, len(pivots)), np.int16)


def _distance_table(words: list[str], b: np.ndarray, m_lengths: np.ndarray) -> np.ndarray:
    a, n_lengths = _letters(words)
    n, m = len(a), len(b)
    pairs = n * m
    wide, high = a.shape[1], b.shape[1]
    column = [np.repeat(a[:, j], m) for j in range(wide)]
    far = wide + high + 1
    table = np.full((high + 2, wide + 2, pairs), far, dtype=np.int16)  # shifted by one: row and column 0 are a border
    table[1:, 1, :] = np.arange(high + 1, dtype=np.int16)[:, None]
    table[1, 1:, :] = np.arange(wide + 1, dtype=np.int16)[:, None]
    last_row = np.zeros((wide, pairs), dtype=np.int16)  # the last row whose letter is that of the column
    for i in range(1, high + 1):
        code = np.tile(b[:, i - 1], n)
        last_col = np.zeros(pairs, dtype=np.int16)
        for j in range(1, wide + 1):
            equal = column[j - 1] == code
            best = np.minimum(table[i, j] + ~equal, np.minimum(table[i + 1, j], table[i, j + 1]) + np.int16(1))
            i1 = last_row[j - 1]
            # a swap needs both letters before, the other way round
            at = np.flatnonzero((i1 > 0) & (last_col > 0))
            if len(at):
                r, c = i1[at], last_col[at]
                best[at] = np.minimum(best[at], table[r, c, at] + (i - r - 1) + 1 + (j - c - 1))
            table[i + 1, j + 1] = best
            last_col[equal] = j
            last_row[j - 1][equal] = i
    rows, columns = np.tile(m_lengths, n) + 1, np.repeat(n_lengths, m) + 1
    return table[rows, columns, np.arange(pairs)].reshape(n, m)


def edit_distances(words: list[str], pivot: str) -> np.ndarray:
    """Distances of ``words`` to one string."""
    return distances_to(words, [pivot])[:, 0]


# ---- reading a spelling -------------------------------------------------------------------------------------


def _org_kind(word: str) -> str | None:
    bare = word.rstrip(".")
    for kind, short in ORG_KINDS.items():
        if bare == kind or bare == short or (len(bare) >= 5 and within_one(bare, kind)):
            return "centre" if kind == "center" else kind
    return None


def read_name(text: str | None) -> tuple[str, str, str, str, int] | None:
    """(kind, key, rest, middle initials, grade) of a spelling; None for null and blank.

    Grade 2: written out; 1: abbreviated ("Hel."); 0: initials or an acronym only. A person's name without a comma
    is read as "first last", unless its last word can only be initials; ``swap`` below offers the other order.
    """
    if text is None:
        return None
    raw = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip()
    raw = re.sub(rf"(?<=[a-zß-ÿ])({'|'.join(PARTICLES[:6])})(?=[A-ZÀ-Þ])", r" \1 ", raw)
    raw = re.sub(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])", " ", raw)
    if not re.search(r"\w", raw):
        return None
    upper = re.fullmatch(r"[A-Z]{2,6}", raw)
    flat = fold(raw)
    flat = re.sub(r"\bof(?=(?:" + "|".join(ORG_KINDS) + r"|[a-z]{4,}))(?![a-z]*\b(?:off|oft))", "of ", flat) if " of" in flat and " of " not in flat else flat
    words = [w for w in re.findall(r"[^\W_]+(?:['-][^\W_]+)*\.?|,", flat)]
    kinds = [k for k in (_org_kind(w) for w in words if w != ",") if k]
    if upper:
        return "o", "#" + flat, "", "", 0
    if kinds and len([w for w in words if w != ","]) >= 2 and "," not in words:
        small = [w for w in words if len(w) <= 3 and any(within_one(w, x) for x in ("of", "the", "and"))]
        rest = [w for w in words if _org_kind(w) is None and w not in ORG_STOP and w not in small and len(w.rstrip(".")) > 1]
        grade = 1 if any(w.endswith(".") for w in words) else 2
        return "o", "#" + kinds[0][0] + "".join(w[0] for w in rest), " ".join([kinds[0], *sorted(rest)]), "", grade
    words = [w for w in words if w.rstrip(".") not in TITLES and w.rstrip(".") not in SUFFIXES]
    # a particle is a listed one or, where the name has capitals, a short word without one (also a mistyped particle)
    small = {fold(w.strip(",.")) for w in raw.split() if w[:1].islower() and len(w.strip(",.")) <= 3} if re.search(r"[A-ZÀ-Þ]", raw) else set()
    particle = lambda w: w.rstrip(".") in PARTICLES or w.rstrip(".") in small
    if "," in words:
        at = words.index(",")
        last, first = words[:at], [w for w in words[at + 1 :] if w != ","]
    else:
        tail = raw.split()[-1]
        if len(words) > 1 and re.fullmatch(r"[A-Z]{1,3}", tail) and not re.fullmatch(r"[A-Z .]+", raw):
            last, first = words[:-1], [c + "." for c in words[-1]]
        else:
            last, first = words[-1:], words[:-1]
    first = [p for w in first for p in re.findall(r"[^\W_.]+\.?", w) if not particle(p)]
    core = [w for w in last[:-1] if not particle(w)] + last[-1:] if last else last
    key = re.sub(r"[\W\d_]", "", "".join(core)) or flat
    if not first:
        return "p", key, "", "", 0
    given = first[0]
    middles = "".join(w[0] for w in first[1:])
    bare = given.rstrip(".")
    if len(bare) == 1:
        return "p", key, bare, middles, 0
    return "p", key, bare, middles, 1 if given.endswith(".") else 2


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for name_id, name, affiliation in zip(frame["name_id"], frame["author_names"], frame["affiliation"]):
            got = read_name(name)
            if got is None:
                continue
            two_way = got[0] == "p" and got[4] == 2 and "," not in name
            other = None
            if two_way:
                other = read_name(f"{' '.join(name.split()[:-1])}, {name.split()[-1]}") if len(name.split()) > 1 else None
            rows.append((int(name_id), affiliation_key(affiliation), *got, "," in name, *((other[1], other[2]) if other and other[0] == "p" else (None, None))))
        yield pd.DataFrame(rows, columns=["name_id", "aff", "kind", "key", "rest", "mids", "grade", "comma", "key2", "rest2"])


# ---- joining key strings within the radius ------------------------------------------------------------------


def choose_pivots(words: list[str], n: int) -> list[str]:
    """Farthest-first: each pivot is the word farthest from those chosen before (ties: the smaller word)."""
    words = sorted(set(words))
    if not words:
        return []
    pivots = [words[0]]
    nearest = edit_distances(words, pivots[0])
    while len(pivots) < min(n, len(words)):
        pick = int(np.argmax(nearest))
        if nearest[pick] == 0:
            break
        pivots.append(words[pick])
        nearest = np.minimum(nearest, edit_distances(words, words[pick]))
    return pivots


def _spread(df: DataFrame, *columns: str) -> DataFrame:
    """As many partitions as shuffles have; a stated number keeps small inputs of slow steps from one single task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def _part(members: DataFrame, pivots: dict[int, list[str]], radius: int) -> DataFrame:
    """Members (cell, key, home) of the cells in ``pivots`` placed in the cells of these pivots; a home string is home in
    the cell of its nearest pivot, all others are guests wherever a home string within the radius can be."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for cell, part in frame.groupby("cell"):
                chosen = pivots[cell]
                for at in range(0, len(part), 2_000):
                    words = part["key"].iloc[at : at + 2_000].tolist()
                    own = part["home"].to_numpy()[at : at + 2_000]
                    away = distances_to(words, chosen)
                    nearest = away.argmin(axis=1)
                    # of two strings at home in different cells one has to visit the other: the one of the later cell
                    visits = ~own[:, None] | (np.arange(len(chosen)) <= nearest[:, None])
                    word, to = np.nonzero((away <= away.min(axis=1, keepdims=True) + 2 * radius) & visits)
                    packed = [row.astype(np.int16).tobytes() for row in away]
                    yield pd.DataFrame({
                        "cell": cell * MAX_PIVOTS + to + 1, "key": [words[i] for i in word], "home": own[word] & (nearest[word] == to), "away": [packed[i] for i in word],
                    })

    return members.mapInPandas(place, "cell bigint, key string, home boolean, away binary")


def close_keys(keys: DataFrame, radius: int = RADIUS, pivots: int | None = None) -> DataFrame:
    """(key_a, key_b) of all pairs of distinct strings of the column ``key`` within ``radius``, both ways, with
    the pairs of each string with itself. Strings that begin with "#" (organisations) are a space of their own and
    meet only their like. Nulls are ignored; an empty table gives no rows."""
    keys = keys.where(F.col("key").isNotNull()).select("key").distinct()
    space = F.when(F.col("key").startswith("#"), F.lit(2)).otherwise(F.lit(1)).cast("bigint")  # the children of a cell 0
    members = checkpointed(_spread(keys).select(space.alias("cell"), "key", F.lit(True).alias("home")))
    sizes = {r["cell"]: r["n"] for r in members.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    settled: DataFrame | None = None
    for level in range(LEVELS):
        large = {c: n for c, n in sizes.items() if level == 0 or n > CELL_STRINGS}
        if not large:
            break
        # about PIVOT_SAMPLE strings of each large cell; their pivots are chosen cell by cell
        rate = F.create_map(*[F.lit(x) for c, n in large.items() for x in (c, max(1, n // PIVOT_SAMPLE))])
        drawn = members.where(F.col("home") & F.col("cell").isin(list(large)))
        drawn = drawn.where(F.pmod(F.xxhash64("key", F.lit(level)), F.get(F.array(rate), F.lit(0))[F.col("cell")]) == 0)
        wanted = {c: pivots or int(min(MAX_PIVOTS, max(MIN_PIVOTS, n**0.5 / 2))) for c, n in large.items()}

        def choose(frame: pd.DataFrame) -> pd.DataFrame:
            cell = int(frame["cell"].iloc[0])
            return pd.DataFrame({"cell": cell, "pivot": choose_pivots(frame["key"].tolist(), wanted[cell])})

        chosen: dict[int, list[str]] = {}
        for r in drawn.groupBy("cell").applyInPandas(choose, "cell bigint, pivot string").collect():
            chosen.setdefault(r["cell"], []).append(r["pivot"])
        fine = members.where(~F.col("cell").isin(list(chosen)))
        if level:
            settled = fine if settled is None else settled.unionByName(fine)
        members = checkpointed(_part(_spread(members.where(F.col("cell").isin(list(chosen)))), chosen, radius))
        sizes = {r["cell"]: r["n"] for r in members.where("home").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_STRINGS).collect()}
    everything = members if settled is None else settled.unionByName(members)
    if "away" not in everything.columns:  # no strings at all
        return keys.select(F.col("key").alias("key_a"), F.col("key").alias("key_b"))

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        away = np.stack([np.frombuffer(b, dtype=np.int16) for b in frame["away"]])
        words = frame["key"].tolist()
        length = np.array([len(w) for w in words])
        # an edit changes at most two of a string's letter counts by one (a swap none)
        bags = np.zeros((len(words), 32), dtype=np.int16)
        np.add.at(bags, (np.repeat(np.arange(len(words)), length), np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32) % 32), 1)
        left, right = [], []
        for i in np.flatnonzero(frame["home"].to_numpy()):
            near = np.flatnonzero(np.abs(length - length[i]) <= radius)
            near = near[np.abs(bags[near] - bags[i]).sum(axis=1) <= 2 * radius]
            near = near[(np.abs(away[near] - away[i]) <= radius).all(axis=1)]
            if radius == 1:
                hits = [j for j in near if within_one(words[i], words[j])]
            else:
                hits = near[edit_distances([words[j] for j in near], words[i]) <= radius]
            left += [words[i]] * len(hits)
            right += [words[j] for j in hits]
        return pd.DataFrame({"key_a": left, "key_b": right})

    met = everything.groupBy("cell").applyInPandas(meet, "key_a string, key_b string")
    both = met.unionByName(met.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b")))
    return both.distinct()


# ---- comparing the rest --------------------------------------------------------------------------------------


FULL_NAMES = sorted({full for fulls in SHORT.values() for full in fulls})


@functools.lru_cache(maxsize=100_000)
def full_names(name: str) -> frozenset[str]:
    """The full names that a given name, a short form or a mistyped full name can stand for."""
    return frozenset(SHORT.get(name) or {name, *(full for full in FULL_NAMES if len(name) > 3 and within_one(full, name))})


def given_letters(rest: str) -> list[str]:
    """Letters of a given name or initial; two that ``agree`` share one. Strings one edit apart share one of their first
    two, short forms and initials the first of a full name."""
    return sorted({*rest[:2], *(full[0] for full in full_names(rest))})


@F.pandas_udf(ArrayType(StringType()))
def _given_letters(rest: pd.Series) -> pd.Series:
    return rest.map(lambda r: given_letters(r) if r else [])


def _unmatched(a: list[str], b: list[str], short: bool) -> int | None:
    """How many words of two organisations differ by one edit (or, if ``short``, by an abbreviation), in whatever order
    they stand; None if some word has no partner."""
    if len(a) != len(b):
        return None
    left = sorted(w.rstrip(".") for w in b)
    rest = []
    for w in sorted((w.rstrip(".") for w in a), key=lambda w: (-len(w), w)):
        if w in left:
            left.remove(w)
        else:
            rest.append(w)
    for w in rest:
        fits = [x for x in left if within_one(w, x) or (short and (x.startswith(w) or w.startswith(x)))]
        if not fits:
            return None
        left.remove(max(fits, key=lambda x: (x[:1] == w[:1], len(x), x)))
    return len(rest)


def agree(kind: str, rest_a: str, mids_a: str, grade_a: int, known_a: bool, rest_b: str, mids_b: str, grade_b: int, known_b: bool) -> int:
    """How well two spellings with close keys agree: 0 not, 1 as far as initials and abbreviations tell, 2 fully."""
    if kind == "o":
        if not rest_a or not rest_b:
            return 1
        written_out = grade_a == grade_b == 2
        wrong = _unmatched(rest_a.split(), rest_b.split(), not written_out)
        return 0 if wrong is None or (written_out and wrong > 2) else 2 if written_out else 1
    n = min(len(mids_a), len(mids_b))
    if mids_a[:n] != mids_b[:n]:
        return 0
    if not rest_a or not rest_b:
        return 1
    if grade_a == grade_b == 2:
        if rest_a == rest_b or SHORT.get(rest_a, set()) & SHORT.get(rest_b, set()):
            return 2
        if (known_a and known_b) or min(len(rest_a), len(rest_b)) < 3:
            return 0
        return 2 if within_one(rest_a, rest_b) or full_names(rest_a) & full_names(rest_b) else 0
    short, long_ = (rest_a, rest_b) if len(rest_a) <= len(rest_b) else (rest_b, rest_a)
    if long_.startswith(short):
        return 1
    return int(any(full.startswith(short) for full in full_names(long_)))


def _score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        level = [
            agree(*x)
            for x in zip(f["kind"], f["rest_a"], f["mids_a"], f["grade_a"], f["known_a"], f["rest_b"], f["mids_b"], f["grade_b"], f["known_b"])
        ]
        out = pd.DataFrame({"a": f["a"], "b": f["b"], "level": np.array(level, dtype=np.int32), "exact": f["exact"],
                            "mid": (f["mids_a"] != "") & (f["mids_a"] == f["mids_b"]), "same": (np.array(level) == 2) & (f["rest_a"] == f["rest_b"])})
        yield out[out["level"] > 0]


def _with_rarest_word(forms: DataFrame) -> DataFrame:
    """``forms`` with ``pick``: the rarest word of an organisation that is written out, else null."""
    is_org = (F.col("kind") == "o") & (F.col("grade") == 2)
    words = forms.where(is_org).select("rest").distinct().withColumn("word", F.explode(_words(F.col("rest"))))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    picks = words.join(counts, "word").groupBy("rest").agg(F.min(F.struct("n", "word"))["word"].alias("pick"))
    return forms.where(is_org).join(picks, "rest").unionByName(forms.where(~is_org).withColumn("pick", F.lit(None).cast("string")))


def _words(rest: Column) -> Column:
    """The distinct words of an organisation as strings of the metric space, apart from family names."""
    return F.transform(F.array_distinct(F.split(rest, " ")), lambda w: F.concat(F.lit("#"), w))


def key_bases(keys: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((key, base), (base_a, base_b), (word_a, word_b)) for a column ``key`` with repeats and the words (column
    ``key``) of organisations that are written out.

    Keys are close within RADIUS as typed or as skeletons (see ``skeleton_column``). The base of a key is the one of its
    close keys (itself included) that occurs most often, so a mistyped key gets the key it stands for; two bases
    are paired where keys of theirs are close. Organisations' initials ("#...") are close to themselves only, their
    words within RADIUS.
    """
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    counts = checkpointed(counts.withColumn("skel", skeleton_column(F.col("key"))))
    persons = counts.where(~F.col("key").startswith("#"))
    skeletons = persons.where("skel <> ''")  # no letters are no likeness
    close = checkpointed(close_keys(persons.select("key").unionByName(skeletons.select(F.col("skel").alias("key"))).unionByName(words)))
    near_words = close.where(F.col("key_a").startswith("#")).select(F.col("key_a").alias("word_a"), F.col("key_b").alias("word_b"))
    typed = persons.select(F.col("key").alias("key_a"), F.col("n").alias("n_a"))
    raw = close.join(typed.select("key_a"), "key_a").join(typed.select(F.col("key_a").alias("key_b")), "key_b")
    one = skeletons.select(F.col("skel").alias("key_a"), F.col("key").alias("k_a"))
    two = skeletons.select(F.col("skel").alias("key_b"), F.col("key").alias("k_b"))
    look = close.join(one, "key_a").join(two, "key_b").select(F.col("k_a").alias("key_a"), F.col("k_b").alias("key_b"))
    near = checkpointed(raw.select("key_a", "key_b").unionByName(look).distinct())
    weighed = near.join(typed.select(F.col("key_a").alias("key_b"), F.col("n_a").alias("n_b")), "key_b")
    first = F.struct(F.col("n_b"), (F.col("key_a") == F.col("key_b")).alias("self"), F.col("key_b").alias("base"))
    bases = weighed.groupBy(F.col("key_a").alias("key")).agg(F.max(first).alias("m")).select("key", F.col("m.base").alias("base"))
    rest = counts.where(F.col("key").startswith("#")).select("key", F.col("key").alias("base"))
    bases = checkpointed(bases.unionByName(rest))
    a, b = (bases.select(F.col("key").alias(f"key_{x}"), F.col("base").alias(f"base_{x}")) for x in "ab")
    pairs = near.join(a, "key_a").join(b, "key_b").select("base_a", "base_b")
    pairs = pairs.unionByName(rest.select(F.col("base").alias("base_a"), F.col("base").alias("base_b"))).distinct()
    return bases, checkpointed(pairs), near_words


def skeleton_column(key: Column) -> Column:
    """Letters only, with letter groups that look alike in print made equal."""
    flat = F.regexp_replace(key, "[^\\p{L}]", "")
    for look, letter in LOOKALIKES:
        flat = F.replace(flat, F.lit(look), F.lit(letter))
    return flat


def _close_skeletons(a: Column, b: Column) -> Column:
    """Whether two keys with letters have skeletons within RADIUS; two swapped letters are one edit, but two to ``levenshtein``."""
    a, b = skeleton_column(a), skeleton_column(b)
    swapped = F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))
    return (a != "") & (b != "") & (F.levenshtein(a, b) <= F.when(swapped, 2 * RADIUS).otherwise(RADIUS))


def _candidates(forms_a: DataFrame, forms_b: DataFrame, close: DataFrame, words: DataFrame, on: list[str]) -> DataFrame:
    """Scored pairs of forms with paired bases (or close words of organisations) and equal ``on`` columns."""
    cols = ["id", "key", "base", "rest", "pick", "mids", "grade", "known", *(["letters"] if "letter" in on else [])]
    left = forms_a.select(*[F.col(c).alias(f"{c}_a") for c in cols], "kind", *on)
    right = forms_b.select(*[F.col(c).alias(f"{c}_b") for c in cols], "kind", *on)
    pairs = left.join(close, "base_a").join(right, ["base_b", "kind", *on]).where("id_a <> id_b")
    typed = F.levenshtein("key_a", "key_b") <= 2 * RADIUS
    pairs = pairs.where((F.col("base_a") == F.col("base_b")) | typed | _close_skeletons(F.col("key_a"), F.col("key_b")))
    # organisations that are written out: each word has a close one in the other, so the rarest is looked for
    left_words = left.where("kind = 'o' AND grade_a = 2").withColumn("word_a", F.col("pick_a"))
    right_words = right.where("kind = 'o' AND grade_b = 2").withColumn("word_b", F.explode(_words(F.col("rest_b"))))
    # those of one base came above
    more = left_words.join(words, "word_a").join(right_words, ["word_b", "kind", *on]).where("id_a <> id_b AND base_a <> base_b")
    more = more.where(F.size(F.split("rest_a", " ")) == F.size(F.split("rest_b", " ")))
    pairs = pairs.unionByName(more.select(*pairs.columns))
    if "letter" in on:  # two forms meet at the first letter that they share
        pairs = pairs.where(F.col("letter") == F.array_min(F.array_intersect("letters_a", "letters_b")))
    pairs = pairs.select(
        F.col("id_a").alias("a"), F.col("id_b").alias("b"), "kind", "rest_a", "mids_a", "grade_a", "known_a",
        "rest_b", "mids_b", "grade_b", "known_b", (F.col("key_a") == F.col("key_b")).alias("exact"),
    )
    return pairs.mapInPandas(_score, "a bigint, b bigint, level int, exact boolean, mid boolean, same boolean")


def _by_letter(forms: DataFrame, bare: list[str], given: str) -> DataFrame:
    """Each person's form once for each of its letters. A bare family name stands at the signs ``bare``, all others also
    at ``given``: so bare names of one side meet all of the other, and given names only those that can agree."""
    signs = F.when(F.col("rest") == "", F.array(*[F.lit(x) for x in bare]))
    letters = F.array_union(_given_letters(F.when(F.col("kind") == "p", F.col("rest"))), F.array(F.lit(given)))
    letters = F.when(F.col("kind") == "p", F.coalesce(signs, letters)).otherwise(F.array(F.lit("")))
    return forms.withColumn("letters", letters).withColumn("letter", F.explode("letters"))


def _rank() -> Column:
    """How good a link is: its level, then equal keys, then equal middle initials, then full names typed alike."""
    return F.col("level") * 8 + F.col("exact").cast("int") * 4 + F.col("mid").cast("int") * 2 + F.col("same").cast("int")


def _only_group(links: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, label): for each form ``a`` the group its links reach, where the best links reach just one."""
    reached = links.join(groups.select(F.col("id").alias("b"), "label"), "b").groupBy("a", "label").agg(F.max(_rank()).alias("rank"))
    best = reached.withColumn("top", F.max("rank").over(Window.partitionBy("a"))).where("rank = top")
    return best.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("label")).where("n = 1").select("a", "label")


def _labelled(forms: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, label) of all ``forms``; those in none of the groups are their own."""
    return checkpointed(forms.select("id").join(groups, "id", "left").select("id", F.coalesce("label", "id").alias("label")))


def _grouped(forms: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, label) of full names, (id, label) of all ``forms``): full names that agree form groups; initials and
    abbreviations join the only group that fits, else their like."""
    groups = component_labels(forms.where("grade = 2"), links.where("level = 2"))
    weak = forms.where("grade < 2")
    joined = _only_group(links.join(weak.select(F.col("id").alias("a")), "a", "left_semi"), groups)
    reach = links.join(groups.select(F.col("id").alias("b")), "b", "left_semi").select("a").distinct()
    alone = weak.join(reach.withColumnRenamed("a", "id"), "id", "left_anti")
    ends = alone.select("id")
    inner = links.join(ends.withColumnRenamed("id", "a"), "a", "left_semi").join(ends.withColumnRenamed("id", "b"), "b", "left_semi")
    weak_groups = component_labels(alone, inner)
    return groups, _labelled(forms, groups.unionByName(joined.withColumnRenamed("a", "id")).unionByName(weak_groups))


def link_names(names: DataFrame) -> DataFrame:
    """(name_id, entity): the group of each spelling; ``entity`` is a number without meaning.

    ``names`` has name_id (BIGINT), author_names and affiliation (STRING). Repeated rows count once. Null and blank
    names take part in nothing. Equal spellings at the same affiliation are one entity; a spelling of unknown
    affiliation joins the only entity it fits; those that fit none are grouped with each other as at one affiliation.
    """
    rows = names.select("name_id", "author_names", "affiliation").where(F.col("name_id").isNotNull()).distinct()
    read = checkpointed(_spread(rows).mapInPandas(
        _read, "name_id bigint, aff string, kind string, key string, rest string, mids string, grade int, comma boolean, key2 string, rest2 string"
    ))
    # which words are given names: seen so after a comma, and more often than as a family name
    person = read.where("kind = 'p'")
    given = person.where("comma AND grade = 2").groupBy(F.col("rest").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    family = person.where("comma").groupBy(F.col("key").alias("word")).agg(F.count(F.lit(1)).alias("m"))
    given = given.join(family, "word", "left").where(F.col("n") > F.coalesce("m", F.lit(0)))
    given = checkpointed(given.select("word", F.lit(True).alias("is_given")))
    second = given.select(F.col("word").alias("rest2"), F.col("is_given").alias("given2"))
    first = given.select(F.col("word").alias("rest"), F.col("is_given").alias("given1"))
    oriented = read.join(second, "rest2", "left").join(first, "rest", "left")
    short = F.array(*[F.lit(w) for w in sorted(SHORT)])
    first_ok = F.coalesce("given1", F.lit(False)) | F.array_contains(short, F.col("rest"))
    second_ok = F.coalesce("given2", F.lit(False)) | F.coalesce(F.array_contains(short, F.col("rest2")), F.lit(False))
    swap = ~F.col("comma") & second_ok & ~first_ok
    oriented = oriented.select(
        "name_id", "aff", "kind", F.when(swap, F.col("key2")).otherwise(F.col("key")).alias("key"),
        F.when(swap, F.col("rest2")).otherwise(F.col("rest")).alias("rest"),
        F.when(swap, F.lit("")).otherwise(F.col("mids")).alias("mids"), "grade",
        ((F.col("kind") == "p") & (first_ok | swap)).alias("known"),
    )
    what = ["aff", "kind", "key", "rest", "mids", "grade", "known"]
    oriented = checkpointed(oriented)
    written = oriented.where("kind = 'o' AND grade = 2").select(F.explode(_words(F.col("rest"))).alias("key"))
    bases, close, words = key_bases(oriented.select("key"), written)
    forms = oriented.select(*what).distinct().join(bases, "key")
    forms = checkpointed(_with_rarest_word(checkpointed(forms)).withColumn("id", F.monotonically_increasing_id()))

    settled, unknown = forms.where("aff IS NOT NULL"), forms.where("aff IS NULL")
    links = checkpointed(_candidates(settled, settled, close, words, ["aff"]))
    full_groups, groups = _grouped(settled, links)
    written_out = full_groups.select("label").distinct()

    # unknown affiliation: compared with all; letters that given names share if they agree are part of the join. A form
    # that stands at many affiliations is met once, and brings the smallest and largest label it has there
    name = ["kind", "key", "base", "rest", "pick", "mids", "grade", "known"]
    held = settled.select("id", *name).join(groups.select("id", "label"), "id").join(written_out.withColumn("written", F.lit(True)), "label", "left")
    # a full name joins through initials only where the group has no full name that contradicts it
    short = F.when(F.col("written").isNull(), F.col("label"))
    places = checkpointed(held.groupBy(*name).agg(
        F.min("id").alias("id"), F.min("label").alias("low"), F.max("label").alias("high"), F.min(short).alias("short_low"), F.max(short).alias("short_high"),
    ))
    sides = [(["<"], ">"), (["<", ">"], "<")]  # of the first and the second forms: signs of bare names, sign of the others
    links0 = _candidates(_by_letter(unknown, *sides[0]), _by_letter(places, *sides[1]), close, words, ["letter"])
    through = (F.col("level") == 1) & (F.col("grade") == 2)
    fitting = links0.join(places.select(F.col("id").alias("b"), "low", "high", "short_low", "short_high"), "b").join(unknown.select(F.col("id").alias("a"), "grade"), "a")
    fitting = fitting.select(
        "a", _rank().alias("rank"), F.when(through, F.col("short_low")).otherwise(F.col("low")).alias("low"), F.when(through, F.col("short_high")).otherwise(F.col("high")).alias("high")
    )
    fitting = checkpointed(fitting.where("low IS NOT NULL"))
    best = fitting.withColumn("top", F.max("rank").over(Window.partitionBy("a"))).where("rank = top").groupBy("a").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    joined0 = best.where("low = high").select("a", F.col("low").alias("label"))
    apart = unknown.join(fitting.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
    apart = checkpointed(apart)
    inner0 = checkpointed(_candidates(_by_letter(apart, *sides[0]), _by_letter(apart, *sides[1]), close, words, ["letter"]))
    _, groups0 = _grouped(apart, inner0)
    groups = _labelled(forms, groups.unionByName(joined0.withColumnRenamed("a", "id")).unionByName(groups0))

    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}")) for c in what]
    matched = oriented.alias("o").join(forms.alias("f"), [F.col("o.key") == F.col("f.key"), F.col("o.rest") == F.col("f.rest"), *same]).select("o.name_id", "f.id")
    return matched.join(groups, "id").select("name_id", F.col("label").alias("entity"))


def linked_pairs(entities: DataFrame) -> DataFrame:
    """(name_a, name_b) of all different name_ids of one entity, name_a < name_b."""
    one = entities.select("name_id", "entity").distinct()
    left, right = one.select(F.col("name_id").alias("name_a"), "entity"), one.select(F.col("name_id").alias("name_b"), "entity")
    return left.join(right, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()
