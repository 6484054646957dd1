"""Expressions over columns: text, tags, dates and URLs. All stay in the JVM; invalid input gives null or empty, no error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon


def clean_text(c: Column) -> Column:
    """White space of any kind collapsed and stripped; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


#: White space of any kind, as (?U)\\s has it.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def split_tags(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\|"), strip), lambda x: x != "")


def split_keywords(c: Column) -> Column:
    return F.filter(F.split(c, r"\s*,\s*"), lambda x: x != "")


def dedupe_ci(a: Column) -> Column:
    """First of entries that differ in case only; empty ones go.

    By two sorts, so that an array may be as long as a text: equal entries stand together, the first in front.
    """
    placed = F.sort_array(F.transform(a, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x"))))
    # as the only entry of an array, the sorted one is made once and not for each of its entries
    firsts = F.transform(F.array(placed), lambda s: F.filter(s, lambda e, i: (e["x"] != "") & ((i == 0) | ~F.get(s, i - 1)["low"].eqNullSafe(e["low"]))))
    back = F.sort_array(F.transform(F.get(firsts, F.lit(0)), lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
    return F.transform(back, lambda e: e["x"])


def limit_tags(a: Column, most: int = lexicon.MAX_TAGS, no_tags: Sequence[str] = lexicon.NO_TAGS) -> Column:
    """Cleaned tags without boilerplate; a list longer than ``most`` is rejected, never cut."""
    kept = F.filter(dedupe_ci(F.transform(a, clean_text)), lambda x: ~F.lower(x).isin(list(no_tags)))
    return F.when(F.size(kept) <= most, kept).otherwise(F.array().cast("array<string>"))


def link_labels(a: Column) -> Column:
    """Labels of links that may be tags."""
    plain = lambda x: (x != "") & (F.length(x) <= 60) & ~F.lower(x).isin(lexicon.NO_TAGS) & ~x.rlike("^[0-9]+$")
    return dedupe_ci(F.filter(F.transform(a, clean_text), plain))


def excerpt(c: Column, n: int = 500) -> Column:
    return F.substring(c, 1, n)


def first_nonempty(*cs: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))


def strict_date(c: Column) -> Column:
    """A date as year-month-day with digits only, in the range of 64-bit nanoseconds; else null."""
    day = F.when(c.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(c, "yyyy-M-d"))
    return F.when(day.between(F.lit("1677-09-22").cast("date"), F.lit("2262-04-11").cast("date")), day)


def parse_date(c: Column) -> Column:
    """Dates of pages as yyyy-MM-dd: ISO with its own local day, written-out months, slashes; else any dddd-dd-dd in it, else empty."""
    text = clean_text(c)
    plain = F.regexp_replace(text, r"(?i)\b([0-9]{1,2})(st|nd|rd|th)\b", "$1")
    iso = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}($|[T ][0-9]{2}(:?[0-9]{2}){0,2}([.,][0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?$)"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    shapes = [
        (r"^[A-Za-z]+ [0-9]{1,2}, [0-9]{4}$", "MMMM d, yyyy"),
        (r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$", "MMM d, yyyy"),
        (r"^[0-9]{1,2} [A-Za-z]+ [0-9]{4}$", "d MMMM yyyy"),
        (r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$", "d MMM yyyy"),
        (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
        (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    ]
    named = F.initcap(plain)
    days = [F.when(named.rlike(pattern), F.try_to_date(named, shape)) for pattern, shape in shapes]
    return F.coalesce(F.date_format(F.coalesce(iso, *days), "yyyy-MM-dd"), F.nullif(F.regexp_extract(text, "[0-9]{4}-[0-9]{2}-[0-9]{2}", 0), F.lit("")), F.lit(""))


_URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)"


def canonical_url(c: Column) -> Column:
    """An absolute http(s) URL without query, fragment and final slashes, its host in lower case; else null. Relative ones are resolved in operators.html."""
    c = F.trim(c)
    scheme, host, path = F.lower(F.regexp_extract(c, _URL, 1)), F.lower(F.regexp_extract(c, _URL, 2)), F.rtrim(F.regexp_extract(c, _URL, 3), F.lit("/"))
    return F.when(scheme.isin("http", "https"), F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path)))


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, _URL, 2))


def url_segments(c: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(c, _URL, 3), "/"), lambda x: x != "")


def is_article_url(c: Column, host: str, section: str | None = "blog", listing: Sequence[str] = lexicon.LISTING_SEGMENTS) -> Column:
    """A page of two segments on ``host``, the first being ``section`` (any if None), the second no listing."""
    parts = url_segments(c)
    ok = (url_host(c) == host.lower()) & (F.size(parts) == 2) & ~F.lower(F.get(parts, F.lit(1))).isin(list(listing))
    return ok if section is None else ok & (F.get(parts, F.lit(0)) == section)


def is_taxonomy_path(c: Column) -> Column:
    path = F.lower(F.regexp_extract(c, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1))
    path = F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))
    return _any(path.contains(x) for x in lexicon.TAXONOMY_PATHS)


def _any(tests) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def bar(value: Column, most: Column, width: int = 40) -> Column:
    """A bar of blocks in proportion, at least one for a positive value."""
    n = F.greatest(F.lit(1), F.rint(F.try_divide(value * width, most)).cast("int"))
    return F.when((value > 0) & (most > 0), F.repeat(F.lit("█"), n)).otherwise("")


def share(part: Column, total: Column, digits: int = 1) -> Column:
    return F.coalesce(F.bround(F.try_divide(part * 100.0, total), digits), F.lit(0.0))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def raw_tokens(c: Column) -> Column:
    """Matches of the token pattern in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({lexicon.TOKEN})"), F.lit(1))


def token_parts(x: Column) -> Column:
    """The tokens that a match stands for: without marks at its ends, none for a number, variants in one spelling, its words apart."""
    bare = F.rtrim(F.btrim(x, F.lit("-_/")), F.lit("."))
    # only the few variants are looked up
    folded = F.when(bare.isin(list(lexicon.CANONICAL)), F.element_at(_map(lexicon.CANONICAL), bare)).otherwise(bare)
    return F.when((bare == "") | (F.translate(bare, lexicon.NUMBER_MARKS, "") == ""), F.array().cast("array<string>")).otherwise(F.split(folded, " "))


def tokens(c: Column) -> Column:
    """Lower-case tokens of a text, in order."""
    return F.flatten(F.transform(raw_tokens(c), token_parts))


def depluralize(c: Column) -> Column:
    """The singular by rules of endings, or null."""
    no = _any(c.endswith(x) for x in lexicon.NO_PLURAL)
    es = _any(c.endswith(x) for x in ("sses", "shes", "ches", "xes", "zes"))
    n = F.length(c)
    return (
        F.when(c.endswith("ies") & (n > 4), F.concat(F.substring(c, F.lit(1), n - 3), F.lit("y")))
        .when(es & (n > 4), F.substring(c, F.lit(1), n - 2))
        .when(c.endswith("s") & (n > lexicon.MIN_LENGTH) & ~no, F.substring(c, F.lit(1), n - 1))
    )
