"""Text and sequence columns: cleaning, labels, token arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP = ["the", "and", "of", "a", "is", "in", "to", "for", "with"]


def squeeze(s: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def strip_tags(html: Column) -> Column:
    """Scripts, styles and tags out, white space squeezed; entities stay."""
    bare = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return squeeze(F.regexp_replace(bare, r"<[^>]*>", " "))


def unescape(s: Column) -> Column:
    """The five common named entities, ampersand last."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        s = F.replace(s, F.lit(f"&{name};"), F.lit(sign))
    return s


def tokens(s: Column, stop: list[str] = ()) -> Column:
    """Lower-cased words of letters, in order and with repeats, without stop words."""
    found = F.filter(F.split(F.regexp_replace(F.lower(s), "[^a-zà-ÿ]+", " "), " "), lambda x: x != "")
    return F.filter(found, lambda x: ~x.isin(list(stop))) if stop else found


def first_match(s: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first rule whose text occurs."""
    return reduce(lambda acc, r: F.when(s.contains(r[0]), r[1]).otherwise(acc), reversed(rules), F.lit(default))


def join_and(parts: Column) -> Column:
    """'a, b and c'."""
    n = F.size(parts)
    return F.when(n == 0, "").when(n == 1, F.get(parts, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(parts, -1)))


def flatten_paths(paths: Column) -> Column:
    """Distinct sorted entries of nested paths, joined by blanks."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(paths))), " ")


def compose(*parts: Column) -> Column:
    """Non-empty parts joined by blanks."""
    return F.trim(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts)))
