"""Column expressions on strings: blank tests, cleaning, hashes, query analysis.

All are built-ins, stay in the JVM and are null-safe: a null text is blank, has no tokens, no keywords and no
entities. White space and word characters are Unicode's throughout ((?U)).
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of entities in a query.
ENTITY_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "url": r"https?://[^\s]+",
    "course_code": r"\b[A-Z]{2,4}\s?\d{3,4}\b",
    "number": r"\b\d+(?:,\d{3})*(?:\.\d+)?\b",
    "name": r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b",
}
# Words that tell what is asked for; the first group with a hit wins.
INTENT_WORDS = {
    "person": ("who", "professor", "faculty", "teaches", "advisor"),
    "course": ("course", "class", "teach", "syllabus"),
    "research_area": ("research", "work on", "area", "interest", "lab"),
    "location": ("where", "location", "campus"),
}


def is_blank(c: Column) -> Column:
    """Null or empty; white space alone is not blank."""
    return c.isNull() | (c == "")


def is_empty(c: Column) -> Column:
    """A null or empty array."""
    return c.isNull() | (F.size(c) == 0)


def or_else(c: Column, *others: Column) -> Column:
    """The first of the strings that is not blank; null if all are."""
    return F.coalesce(*(F.when(~is_blank(x), x) for x in (c, *others)))


def strip(c: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@lru_cache(maxsize=1)
def _letters() -> str:
    """Ranges of all letters and digits Python knows, for a character class."""
    word = bytes(chr(i).isalnum() for i in range(sys.maxunicode + 1))
    return "".join(f"\\x{{{m.start():x}}}-\\x{{{m.end() - 1:x}}}" for m in re.finditer(b"\1+", word))


def clean_text(c: Column) -> Column:
    """Runs of white space to one space, punctuation but ``-``, ``?`` and ``_`` removed, lower case.

    Characters younger than the JVM's tables are judged by those of Python.
    """
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), rf"(?U)[^\p{{L}}\p{{N}}_\s\-?[\p{{Cn}}&&[{_letters()}]]]", ""))


def words(c: Column) -> Column:
    """Tokens between white space; an empty array for null or blank."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def token_count(c: Column) -> Column:
    return F.size(words(c))


def keywords(cleaned: Column, most: int = 10) -> Column:
    """Distinct tokens of more than three characters that don't start with ``-``, in order, the first ``most``."""
    return F.slice(F.array_sort(F.array_distinct(F.filter(words(cleaned), lambda x: (F.length(x) > 3) & ~x.startswith("-")))), 1, most)


def entities(text: Column, kinds: tuple[str, ...] = tuple(ENTITY_PATTERNS)) -> Column:
    """Distinct matches of the entity shapes in the original text, in order."""
    t = F.coalesce(text, F.lit(""))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(t, F.lit("(?U)" + ENTITY_PATTERNS[k]), 0) for k in kinds)))))


def intent(cleaned: Column) -> Column:
    out = None
    for name, hints in INTENT_WORDS.items():
        hit = cleaned.rlike("|".join(hints))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("informational")


def is_question(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+$", "").endswith("?")


def strategy(n_tokens: Column, found: Column) -> Column:
    """Short queries are expanded, those with entities searched by words as well, the rest by meaning."""
    return F.when(n_tokens < 3, "expand").when(F.size(found) > 0, "hybrid").otherwise("semantic")


def content_hash(text: Column) -> Column:
    """``sha256:`` and the first 32 hex digits; null for null."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, 32))


def page_hash(text: Column, version: str) -> Column:
    """The same over a version and the text, so that a new version makes every page new."""
    return content_hash(F.concat(F.lit(version + "\n"), text))


def header(name: Column, title: Column) -> Column:
    return F.concat(name, F.when(is_blank(title), "").otherwise(F.concat(F.lit(" ("), title, F.lit(")"))))


def bullet_list(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), F.coalesce(x, F.lit("None")))), "\n")


def key_name(c: Column) -> Column:
    """A heading as a key: stripped, lower case, spaces to underscores."""
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))


def label_of(section: Column, labels: dict[str, str]) -> Column:
    """The label of a section; an unknown one in title case: a letter is large where none stands before it."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    spaced = F.replace(section, F.lit("_"), F.lit(" "))
    chars = F.split(spaced, "")
    titled = F.array_join(F.transform(chars, lambda c, i: F.when((i == 0) | ~F.get(chars, i - 1).rlike(r"^\p{L}$"), F.upper(c)).otherwise(F.lower(c))), "")
    return F.coalesce(F.element_at(F.create_map(*pairs), section), titled)
