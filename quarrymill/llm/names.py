"""Problem 1: variant spellings of persons and organisations, linked to one entity.

Method: noisy-channel attribution. Frequent spellings are the candidate canonical forms. A variant is
attached to the form with the largest posterior: the logarithm of the form's frequency, less what the
channel charges for its misprints, abbreviations, nicknames, reordered and missing parts. What rows say
beside the name (e-mail, home page, areas, education) counts as evidence where spellings alone leave several
forms. Attribution is linear: each spelling goes to one form, and pairs are only made of the result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from quarrymill.runtime import slots, stored

# Letters that do not decompose.
LETTERS = {"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"}
# Titles and degrees around names.
TITLES = frozenset("dr prof professor phd assoc associate asst assistant mr mrs ms miss md dphil jr sr ii iii esq sir dame rev emeritus emerita dipl ing mag".split())
# Short forms of given names.
NICKNAMES = {
    "alex": "alexander aleksandra alexandra", "sasha": "alexander aleksandra", "sandra": "alexandra aleksandra", "ola": "aleksandra", "abby": "abigail", "gail": "abigail", "tony": "anthony", "andy": "andrew", "ben": "benjamin", "benny": "benjamin",
    "beth": "elizabeth", "liz": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "lisa": "elizabeth", "bill": "william", "will": "william", "billy": "william", "liam": "william", "bob": "robert", "rob": "robert", "bobby": "robert",
    "chris": "christopher christine", "kit": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dima": "dmitri", "mitya": "dmitri", "ed": "edward", "eddie": "edward", "ted": "edward theodore", "ned": "edward",
    "katya": "ekaterina", "kate": "katherine ekaterina", "kathy": "katherine", "katie": "katherine", "paco": "francisco", "pancho": "francisco", "fran": "francisco frances", "fred": "frederick friedrich", "freddie": "frederick", "fritz": "friedrich", "gabi": "gabriela", "gaby": "gabriela", "beppe": "giuseppe", "peppe": "giuseppe", "pino": "giuseppe", "greg": "gregory", "lupe": "guadalupe", "lupita": "guadalupe",
    "jim": "james", "jimmy": "james", "jamie": "james", "jen": "jennifer", "jenny": "jennifer", "joe": "joseph", "joey": "joseph", "jo": "joseph josephine", "hans": "johannes", "johann": "johannes", "jon": "jonathan", "jonny": "jonathan", "larry": "lawrence", "laurie": "lawrence", "maggie": "margaret", "peg": "margaret", "peggy": "margaret", "meg": "margaret", "matt": "matthew", "mike": "michael", "mick": "michael", "mickey": "michael", "misha": "michael mikhail",
    "nick": "nicholas", "nico": "nicholas", "pat": "patricia patrick", "trish": "patricia", "patty": "patricia", "tricia": "patricia", "pasha": "pavel", "becca": "rebecca", "becky": "rebecca", "sam": "samuel samantha", "sammy": "samuel", "steve": "stephen steven", "stevie": "stephen", "sue": "susan", "susie": "susan", "suzy": "susan", "thea": "theodora", "dora": "theodora", "theo": "theodora theodore", "tom": "thomas", "tommy": "thomas", "vicky": "victoria", "vic": "victoria victor", "tori": "victoria", "vova": "vladimir", "volodya": "vladimir", "zach": "zachary", "zack": "zachary", "zak": "zachary", "lukas": "lukasz", "xochi": "xochitl", "oksanka": "oksana", "chuck": "charles", "charlie": "charles", "dick": "richard", "rick": "richard", "harry": "henry", "jack": "john", "nancy": "ann", "tina": "christina", "lena": "elena helena", "kolya": "nikolai", "pepe": "jose", "gus": "august",
}
# Words for kinds of groups, and what people add to a group's name.
KINDS = {"lab": "lab", "laboratory": "lab", "labs": "lab", "center": "center", "centre": "center", "ctr": "center", "group": "group", "grp": "group", "initiative": "initiative", "init": "initiative", "collective": "collective", "coll": "collective", "institute": "institute", "inst": "institute"}
FILLERS = frozenset("the for of and in at research".split())
ROLE = re.compile(r"(?i)^\s*(?:(?:co-)?(?:director|lead|leader|head|chair|founder|pi|member|fellow|affiliate|coordinator)s?\b(?: (?:of|at))?\s*(?:the\b)?\s*[,:–-]?\s*)+")
SINCE = re.compile(r"(?i)\((?:since|from|until|\d{4})[^)]*\)")

EDIT, ABBREVIATION, MISSING, EXTRA, REORDER, KIND_MISSING, KIND_OTHER = 2.4, 0.8, 3.0, 3.5, 0.2, 0.6, 4.0
REJECT = 6.2
#: What the channel charges for a letter of a given name, a short form and an initial; for a letter of a surname and of a short one, which has near ones by chance.
GIVEN_EDIT, NICKNAME, INITIAL, SURNAME_EDIT, SHORT_EDIT, LONG = 0.9, 0.5, 1.0, 0.6, 1.8, 6
#: What a shared detail counts for, up to four of them, and a short form or initial as a form of its own.
FACT, NO_FORM = 1.5, -2.5
LABS_AT_ONCE = 20_000
#: Before how many names a word must stand behind a comma to be a place; at most this many places are sent to the tasks.
PLACE, PLACES = 20, 10_000


def fold(text: str) -> str:
    """Lower case without accents."""
    t = unicodedata.normalize("NFKD", text.lower())
    return "".join(LETTERS.get(c, c) for c in t if not unicodedata.combining(c))


def distance(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; more than ``most`` is most + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


# ---- organisations -----------------------------------------------------------------------------------------


@lru_cache(maxsize=200_000)
def group_parts(name: str) -> tuple[tuple[str, ...], tuple[bool, ...], frozenset, tuple[str, ...]]:
    """(content words, whether each was cut short, kinds, acronyms) of a group's name in any spelling."""
    t = SINCE.sub(" ", unicodedata.normalize("NFKC", name))
    t = ROLE.sub("", t)
    acronyms = re.findall(r"\b[A-Z]{3,8}\b", t) if re.search(r"[a-z]", re.sub(r"\([^)]*\)", "", t)) or len(t.split()) == 1 or "," in t else []
    t = re.sub(r"\(\s*[A-Z]{2,8}\s*\)", " ", t)
    t = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", t)
    words, cut, kinds = [], [], set()
    for m in re.finditer(r"[^\W\d_]+(\.)?", fold(t)):
        w = m.group(0).rstrip(".")
        if w in KINDS:
            kinds.add(KINDS[w])
        elif w not in FILLERS:
            words.append(w)
            cut.append(bool(m.group(1)))
    return tuple(words), tuple(cut), frozenset(kinds), tuple(acronyms)


@lru_cache(maxsize=200_000)
def _near(a: str, b: str, most: int) -> int:
    """``distance`` of words that come up again and again."""
    return distance(a, b, most)


@lru_cache(maxsize=50_000)
def _like_a_kind(word: str) -> bool:
    """Whether a word is a misprinted one for a kind of group, or a filler."""
    return len(word) > 4 and any(distance(word, k, 2) <= 2 for k in (*KINDS, "research") if len(k) > 4)


def group_cost(seen: tuple, lab: tuple, places: frozenset = frozenset()) -> float:
    """What the channel charges for writing ``lab`` as ``seen``; both from group_parts."""
    words, cut, kinds, _ = seen
    want, _, want_kinds, _ = lab
    left = [(w, c) for w, c in zip(words, cut)]
    cost, at, missing = 0.0, {}, 0
    for w in sorted(want, key=lambda x: x not in words):
        best, pick = 99.0, None
        for k, (o, c) in enumerate(left):
            if o == w:
                v = 0.0
            elif len(o) >= 3 and w.startswith(o) and (c or len(o) <= len(w) - 2):
                v = ABBREVIATION if c else 2 * ABBREVIATION
            else:
                most = 2 if min(len(o), len(w)) >= 5 else 1
                d = _near(o, w, most) if min(len(o), len(w)) >= 3 else 9
                v = EDIT * d if d <= most else 99.0
            if v < best:
                best, pick = v, k
        if pick is None or best > 2 * EDIT:
            missing += 1
            cost += MISSING
        else:
            cost += best
            at[w] = words.index(left[pick][0])
            left.pop(pick)
    if missing > 1 or missing == len(want):
        return 99.0
    for o, _ in left:
        # a misprinted word for a kind or a filler is no word of its own; nor is a place that follows a comma
        if o in places or _like_a_kind(o):
            cost += 0.3
        else:
            cost += EXTRA
    order = [at[w] for w in want if w in at]
    if order != sorted(order):
        cost += REORDER
    if not kinds:
        cost += KIND_MISSING
    elif not kinds & want_kinds:
        cost += KIND_OTHER if not left else KIND_MISSING
    return cost


def attribute_groups(spellings: DataFrame, labs: DataFrame, name: str, lab_id: str, lab_name: str, acronym: str, places: list[str] | None = None) -> DataFrame:
    """(spelling, lab_id, cost): each distinct spelling with the reference name of the largest posterior, if any is likely enough.

    The prior is how often the reference name is written in full. Reference names go to the tasks in parts
    of at most LABS_AT_ONCE rows, and the best of all parts wins. Words that only tell where a group is, learned
    from the spellings or given as ``places``, cost little. Null and blank spellings have no row.
    """
    counted = spellings.select(F.col(name).alias("spelling")).where(F.length(F.trim("spelling")) > 0).groupBy("spelling").count()
    counted = stored(counted, "spellings")
    ref = labs.select(F.col(lab_id).alias("lab"), F.col(lab_name).alias("full"), F.col(acronym).alias("acro")).where("lab is not null and full is not null")
    ref = ref.join(counted.select(F.col("spelling").alias("full"), "count"), "full", "left").select("lab", "full", "acro", F.coalesce("count", F.lit(0)).alias("n"))
    parts = max(1, -(-ref.count() // LABS_AT_ONCE))
    spots = _places(counted, ref) | {fold(p) for p in places or ()}
    out = None
    for p in range(parts):
        rows = [(r["lab"], group_parts(r["full"]), r["acro"], float(np.log(r["n"] + 1.0))) for r in ref.where(F.pmod(F.xxhash64("lab"), F.lit(parts)) == p).collect()]
        shared = spellings.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            table = shared.value
            acros: dict[str, list[int]] = {}
            by_start: dict[str, set[int]] = {}
            for i, (_, parts_, acro, _) in enumerate(table):
                if acro:
                    acros.setdefault(acro.upper(), []).append(i)
                for w in parts_[0]:
                    by_start.setdefault(w[:2], set()).add(i)
                    by_start.setdefault("*" + w[-2:], set()).add(i)
            for pdf in batches:
                got = []
                for s in pdf["spelling"]:
                    seen = group_parts(s)
                    best = None
                    if len([w for w in seen[0] if fold(w) not in spots and w.upper() not in seen[3]]) == 0:
                        for a in seen[3]:
                            for i in acros.get(a, ()):
                                v = (table[i][3] * 0.3 - 0.5, table[i][0], 0.5)
                                best = max(best, v) if best else v
                    if best is None:
                        near: dict[int, int] = {}
                        for w in seen[0]:
                            for i in by_start.get(w[:2], set()) | by_start.get("*" + w[-2:], set()):
                                near[i] = near.get(i, 0) + 1
                        for i, hits in near.items():
                            if hits < min(2, len(seen[0])):
                                continue
                            c = group_cost(seen, table[i][1], spots)
                            if c <= REJECT:
                                v = (table[i][3] * 0.3 - c, table[i][0], c)
                                best = max(best, v) if best else v
                    if best:
                        got.append((s, best[1], best[2], best[0]))
                yield pd.DataFrame(got, columns=["spelling", "lab", "cost", "posterior"])

        part = counted.select("spelling").repartition(slots(spellings.sparkSession)).mapInPandas(run, "spelling string, lab long, cost double, posterior double")
        out = part if out is None else out.unionByName(part)
    if parts > 1:
        out = out.groupBy("spelling").agg(F.max_by("lab", "posterior").alias("lab"), F.max_by("cost", "posterior").alias("cost"))
    return out.select("spelling", F.col("lab").alias(lab_id), "cost")


def _places(counted: DataFrame, ref: DataFrame) -> frozenset:
    """Words people put behind the comma of many names without there being a reference name that has them: where a group is, not what it is called."""
    tail = F.lower(F.regexp_extract("spelling", r",\s*([^,()]+?)\s*$", 1))
    head = F.regexp_extract("spelling", r"^([^,]+),", 1)
    seen = counted.select(tail.alias("tail"), head.alias("head")).where("tail <> ''").groupBy("tail").agg(F.approx_count_distinct("head").alias("n"))
    named = ref.select(F.explode(F.split(F.lower("full"), r"(?U)\W+")).alias("w")).distinct()
    words = seen.where(F.col("n") >= PLACE).select("tail", F.explode(F.split("tail", r"(?U)\W+")).alias("w")).join(named.hint("merge"), "w", "left_anti")
    top = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(PLACES).collect()  # bounded
    return frozenset(fold(r["w"]) for r in top if r["w"])


# ---- persons -----------------------------------------------------------------------------------------------


@lru_cache(maxsize=200_000)
def name_tokens(name: str) -> tuple[tuple[str, ...], int]:
    """(folded tokens without titles, number of tokens before a comma or -1)."""
    t = re.sub(r"\([^)]*\)", " ", unicodedata.normalize("NFKC", name))
    t = re.sub(r"(?i),?\s*\bph\.?\s*d\b\.?|,?\s*\bm\.?d\b\.", " ", t)
    t = fold(t)
    head, comma, tail = t.partition(",")
    parts = []
    for side in (head, tail):
        w = [re.sub(r"[^a-z]", "", x) for x in re.split(r"[\s.]+", side)]
        parts.append([x for x in w if x and x not in TITLES])
    if comma and parts[0] and parts[1]:
        return tuple(parts[0] + parts[1]), len(parts[0])
    return tuple(parts[0] + parts[1]), -1


def _evidence(surname: str, given: str, sites: list, contact: list) -> str:
    """The surname as e-mail and home page write it, if that is a near spelling of ``surname``; else ''."""
    found = []
    for w in sites:
        href = (w or {}).get("href") or "" if isinstance(w, dict) else (w["href"] or "" if w is not None else "")
        m = re.search(r"/~([a-z.\-]+?)\d*/?$", href)
        if m:
            found.append(re.sub(r"[^a-z]", "", m.group(1)))
        elif href.startswith("mailto:"):
            contact = [*contact, href[7:]]
    for c in contact:
        local = (c or "").partition("@")
        if local[1]:
            x = local[0].lower()
            first, dot, rest = x.partition(".")
            if dot and len(first) > 1:
                found.append(re.sub(r"[^a-z]", "", rest))
                # a double given name is dotted as well
                found.append(re.sub(r"[^a-z]", "", x.split(".", 2)[-1]))
            y = re.sub(r"[^a-z]", "", x)
            found += [y[1:], y[:-1]]
    # one half of a double surname stands for the whole
    best = [(1 if len(surname) >= 6 and f != surname and (f.startswith(surname) or f.endswith(surname)) and len(f) >= len(surname) + 5 else distance(f, surname, 3), k, f) for k, f in enumerate(found) if len(f) > 2]
    best = [b for b in best if b[0] <= 3]
    return min(best)[2] if best else ""


def same_persons(df: DataFrame, key: str, name: str, contact: str, websites: str, details: list[str]) -> DataFrame:
    """(key, person): rows of one person have one value of person, a canonical surname and given name.

    Rows with a null or blank name have no row. ``details`` are columns of type array<string> that tell
    persons of like names apart. Equal rows get equal persons; an empty table gives an empty result.
    """
    src = df.select(
        F.col(key).alias("key"), F.col(name).alias("name"), F.coalesce(F.col(contact), F.array().cast("array<string>")).alias("contact"), F.coalesce(F.transform(websites, lambda w: w["href"]), F.array().cast("array<string>")).alias("sites"),
        F.array_distinct(F.filter(F.concat(F.filter(F.coalesce(F.col(contact), F.array().cast("array<string>")), lambda c: c.contains("@")), *[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in details]), lambda x: x.isNotNull())).alias("details"),
    ).where(F.length(F.trim("name")) > 0)

    @F.pandas_udf("tokens array<string>, comma int")
    def parse(names: pd.Series) -> pd.DataFrame:
        got = [name_tokens(n) for n in names]
        return pd.DataFrame({"tokens": [list(t) for t, _ in got], "comma": [c for _, c in got]})

    rows = stored(src.withColumn("p", parse("name")).select("*", "p.tokens", "p.comma").drop("p", "name").where("size(tokens) > 0"), "names")
    # which words are given names: how often they stand first, how often last; counted over all rows, joined, not collected
    last = F.when(F.col("comma") > 0, F.col("tokens")[0]).otherwise(F.element_at("tokens", -1))
    first = F.when(F.col("comma") > 0, F.get("tokens", F.col("comma"))).otherwise(F.col("tokens")[0])
    use = rows.where("size(tokens) > 1").select(F.explode(F.array(F.struct(first.alias("t"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(last.alias("t"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("u")).select("u.*")
    stats = use.groupBy("t").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("length(t) > 1").select("t", "a", (F.log((F.col("a") + 0.5) / (F.col("b") + 0.5))).alias("s"))
    stats = stored(stats, "words")
    rows = (
        rows.join(stats.select(F.col("t").alias("t1"), F.col("s").alias("s1")).hint("merge"), rows["tokens"][0] == F.col("t1"), "left")
        .join(stats.select(F.col("t").alias("t2"), F.col("s").alias("s2")).hint("merge"), F.element_at(rows["tokens"], -1) == F.col("t2"), "left")
        .drop("t1", "t2")
    )

    @F.pandas_udf("surname string, given string, near string")
    def split(tokens: pd.Series, comma: pd.Series, s1: pd.Series, s2: pd.Series, contact: pd.Series, sites: pd.Series) -> pd.DataFrame:
        out = []
        for t, c, a, b, mails, hrefs in zip(tokens, comma, s1, s2, contact, sites):
            t = list(t)
            if c > 0:
                sur, giv = t[:c], t[c:]
            elif len(t) == 1:
                sur, giv = t, []
            elif len(t[-1]) == 1 or (len(t[0]) > 1 and not np.isnan(b) and (np.isnan(a) or b > a + 1.0) and b > 0):
                # surname first: an initial at the end, or the last word is the usual given name
                k = len(t) - 1
                while k > 1 and len(t[k - 1]) == 1:
                    k -= 1
                sur, giv = t[:k], t[k:]
            else:
                k = 1
                while k < len(t) - 1 and len(t[k]) == 1:
                    k += 1
                sur, giv = t[k:], t[:k]
            full = [g for g in giv if len(g) > 1]
            g = full[0] if full else (giv[0] if giv else "")
            s = "".join(sur)
            out.append((s, g, _evidence(s, g, [{"href": h} for h in hrefs], list(mails))))
        return pd.DataFrame(out, columns=["surname", "given", "near"])

    split_ = rows.withColumn("x", split("tokens", "comma", "s1", "s2", "contact", "sites")).select("key", "details", "x.*")
    split_ = stored(split_, "split")
    # frequent surnames are canonical; what e-mails and pages write counts like another spelling
    counts = split_.select(F.explode(F.array("surname", "near")).alias("s")).where("length(s) > 1").groupBy("s").count()
    counts = stored(counts.withColumnRenamed("count", "n"), "surnames")

    # two words within two edits share a form with at most two letters left out; the ratio of their counts decides, at any size
    less = counts.select(F.col("s").alias("v"), F.col("n").alias("nv"), F.explode(_shortened("s")).alias("k"))
    form = counts.where("n >= 2").select(F.col("s").alias("c"), F.col("n").alias("nc"), F.explode(_shortened("s")).alias("k"))
    short = F.least(F.length("v"), F.length("c")) < LONG
    better = (
        less.join(form.hint("merge"), "k")
        .where("c <> v and nc > nv")
        .select("v", "nv", "c", "nc")
        .distinct()
        .withColumn("d", _apart("v", "c"))
        .where(F.col("d") <= F.when(short, 1).otherwise(2))
        # short names have near ones by chance
        .withColumn("gain", F.log(F.col("nc") / F.col("nv")) - F.when(short, SHORT_EDIT).otherwise(SURNAME_EDIT) * F.col("d"))
        .where("gain > 0")
        .groupBy("v")
        .agg(F.max_by("c", F.struct("gain", "c")).alias("c"))
    )
    better = stored(better, "surname_forms")
    own = F.when(F.length("near") > 1, F.col("near")).otherwise(F.col("surname"))
    named = split_.withColumn("v", own).join(better.hint("merge"), "v", "left").withColumn("family", F.coalesce("c", "v")).select("key", "details", "family", "given")
    named = stored(named, "named")
    return _persons(named, stats)


@F.pandas_udf(ArrayType(StringType()))
def _shortened(words: pd.Series) -> pd.Series:
    """A word and its forms with one letter left out, for long words also those with two."""

    def forms(x: str) -> list[str]:
        one = {x[:i] + x[i + 1 :] for i in range(len(x))} if len(x) > 2 else set()
        two = {y[:i] + y[i + 1 :] for y in one for i in range(len(y))} if len(x) >= 4 else set()
        return sorted({x} | one | two)

    return pd.Series([forms(x) for x in words])


@F.pandas_udf(IntegerType())
def _apart(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance(x, y, 2) for x, y in zip(a, b)], dtype="int32")


def _given_costs(spelled: DataFrame) -> DataFrame:
    """(g, c, cost): what the channel charges for writing the given name ``c`` as ``g``, for all spellings of more than a letter.

    It depends on the two words alone, so it is looked up once however many families have them.
    """
    spark = spelled.sparkSession
    words = spelled.select("given").where("length(given) > 1").distinct()
    forms = stored(words.select("given", F.explode(_shortened("given")).alias("k")), "given_forms")
    nick = spark.createDataFrame([(k, c) for k, v in NICKNAMES.items() for c in v.split()], "nick string, c string")  # a list of this module
    pairs = forms.select(F.col("given").alias("g"), "k").join(forms.select(F.col("given").alias("c"), "k").hint("merge"), "k").where("g <> c").select("g", "c").distinct()
    most = F.when(F.least(F.length("g"), F.length("c")) >= 4, 2).otherwise(1)
    ends = (F.left("g", F.lit(1)) == F.left("c", F.lit(1))) | (F.right("g", F.lit(1)) == F.right("c", F.lit(1)))
    # a misprint hardly ever spoils both ends of a word
    typo = pairs.withColumn("d", _apart("g", "c")).where((F.col("d") <= most) & ((F.col("d") < 2) | ends)).select("g", "c", (F.col("d") * GIVEN_EDIT).alias("cost"))
    short = nick.select(F.col("nick").alias("g"), "c", F.lit(NICKNAME).alias("cost"))
    # a misprinted short form
    keys = nick.where("length(nick) > 2").withColumn("k", F.explode(_shortened("nick")))
    missed = forms.select(F.col("given").alias("g"), "k").join(F.broadcast(keys), "k").where("g <> nick").select("g", "nick", "c").distinct()
    missed = missed.where((_apart("g", "nick") == 1) & (F.least(F.length("g"), F.length("c")) >= 4)).select("g", "c", F.lit(2 * GIVEN_EDIT).alias("cost"))
    missed = missed.where(~F.col("g").isin(*NICKNAMES))
    costs = short.unionByName(typo).unionByName(missed).groupBy("g", "c").agg(F.min("cost").alias("cost"))
    # a short form is no canonical form of a name that is none
    g_nick = F.col("g").isin(*NICKNAMES)
    return stored(costs.where(g_nick | ~F.col("c").isin(*NICKNAMES)).withColumn("g_nick", g_nick), "given_costs")


def _persons(named: DataFrame, stats: DataFrame) -> DataFrame:
    """(key, person) of rows with family and given name: every spelling goes to the given name of its family that is likeliest.

    Candidates meet by equal keys only (a near word, a nickname, an initial), never as all pairs of a family,
    and what two spellings have in common is counted by joining their details, never gathered.
    """
    common = stats.select(F.col("t").alias("given"), F.col("a").alias("common"))
    spelled = named.groupBy("family", "given").agg(F.count("*").alias("n"), F.max(F.size("details") > 0).alias("told")).join(common.hint("merge"), "given", "left")
    spelled = stored(spelled.select("family", "given", "n", "told", (F.log("n") + 0.5 * F.log1p(F.coalesce("common", F.lit(0)))).alias("strength")), "spelled")
    facts = stored(named.select("family", "given", F.explode("details").alias("fact")).distinct(), "facts")
    costs = _given_costs(spelled)
    whole_name = (F.length("given") > 1) & ~F.col("given").isin(*NICKNAMES)
    own = spelled.select("family", F.col("given").alias("g"), F.col("given").alias("c"), (F.col("strength") + F.when(whole_name, 0.0).otherwise(NO_FORM)).alias("score"))

    left = spelled.select("family", F.col("given").alias("g"), F.col("strength").alias("sg"), F.col("told").alias("told_g"))
    right = spelled.where("length(given) > 1").select("family", F.col("given").alias("c"), F.col("strength").alias("sc"), F.col("told").alias("told_c"))
    near = left.join(costs.hint("merge"), "g").join(right.hint("merge"), ["family", "c"]).where("g_nick or sc >= sg").select("family", "g", "c", "cost", "sc", "told_g", "told_c")
    initial = left.where("length(g) = 1").join(right.withColumn("g", F.substring("c", 1, 1)).hint("merge"), ["family", "g"]).select("family", "g", "c", F.lit(INITIAL).alias("cost"), "sc", "told_g", "told_c")
    pairs = stored(near.unionByName(initial), "candidates")
    shared = pairs.select("family", "g", "c").join(facts.withColumnRenamed("given", "g").hint("merge"), ["family", "g"]).join(facts.withColumnRenamed("given", "c").hint("merge"), ["family", "c", "fact"]).groupBy("family", "g", "c").agg(F.count("*").alias("common"))
    scored = pairs.join(shared.hint("merge"), ["family", "g", "c"], "left")
    evidence = F.when(F.col("common") > 0, FACT * F.least("common", F.lit(4))).when(F.col("told_g") & F.col("told_c"), -FACT).otherwise(0.0)
    found = own.unionByName(scored.select("family", "g", "c", (F.col("sc") - F.col("cost") + evidence).alias("score")))
    canon = found.groupBy("family", "g").agg(F.max_by("c", F.struct("score", "c")).alias("person")).select("family", F.col("g").alias("given"), "person")
    for _ in range(2):  # a form may itself be attached to another
        canon = stored(canon, "given_forms")
        on = canon.select("family", F.col("given").alias("person"), F.col("person").alias("next"))
        canon = canon.join(on.hint("merge"), ["family", "person"], "left").select("family", "given", F.coalesce("next", "person").alias("person"))
    whole = stored(canon, "given_forms")

    # initials are ambiguous by themselves: each row goes to the person it shares most with, else to the most frequent one
    of = whole.where("length(person) > 1").withColumn("given_", F.substring("person", 1, 1))
    people = spelled.join(of.hint("merge"), ["family", "given"]).groupBy("family", F.col("given_").alias("given"), "person").agg(F.sum("n").alias("n"))
    people = stored(people, "people")
    single = named.where("length(given) = 1").select("key", "family", "given", "details")
    told_by = facts.where("length(given) > 1").join(of.hint("merge"), ["family", "given"]).select("family", F.col("given_").alias("given"), "person", "fact").distinct()
    alike = single.select("key", "family", "given", F.explode(F.array_distinct("details")).alias("fact")).join(told_by.hint("merge"), ["family", "given", "fact"]).groupBy("key", "family", "given", "person").agg(F.count("*").alias("common"))
    by_fact = alike.join(people.hint("merge"), ["family", "given", "person"]).groupBy("key").agg(F.max_by("person", F.struct(F.col("common") * 3.0 + F.log("n"), "person")).alias("pick"), F.max(F.col("common") * 3.0 + F.log("n")).alias("score"))
    usual = people.groupBy("family", "given").agg(F.max_by("person", F.struct("n", "person")).alias("usual"), F.log(F.max("n")).alias("usual_score"))
    by_row = single.select("key", "family", "given").join(usual.hint("merge"), ["family", "given"]).join(by_fact.hint("merge"), "key", "left").select("key", F.when(F.col("score") >= F.col("usual_score"), F.col("pick")).otherwise(F.col("usual")).alias("pick"))
    by_row = stored(by_row, "by_row")
    return named.join(whole.hint("merge"), ["family", "given"]).join(by_row.hint("merge"), "key", "left").select("key", F.concat("family", F.lit("|"), F.coalesce("pick", "person")).alias("person"))


def pairs_of(members: DataFrame, key: str, group: str) -> DataFrame:
    """(a, b), a < b: every pair of keys of one group."""
    m = stored(members.select(F.col(key).alias("k"), F.col(group).alias("g")).distinct(), "members")
    m = m.join(m.groupBy("g").count().where("count > 1").select("g").hint("merge"), "g", "left_semi")
    return m.alias("l").join(m.alias("r").hint("merge"), (F.col("l.g") == F.col("r.g")) & (F.col("l.k") < F.col("r.k"))).select(F.col("l.k").alias("a"), F.col("r.k").alias("b"))
