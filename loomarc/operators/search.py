"""A positional postings index and the small query language over it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

MOST_CHARS, MOST_CLAUSES = 4096, 16


class QueryError(ValueError):
    """A query that cannot be understood."""


@dataclass(frozen=True)
class Query:
    words: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    without: list[list[str]] = field(default_factory=list)
    facets: dict[str, list[str]] = field(default_factory=dict)
    not_facets: dict[str, list[str]] = field(default_factory=dict)
    dates: list[tuple[str | None, str | None, bool]] = field(default_factory=list)
    sort: str = "relevance"


_TOKEN = re.compile(r'(-?)(?:([A-Za-z]+):)?(?:"((?:[^"\\]|\\.)*)"|(\S+))')
_DAY = r"\d{4}-\d\d-\d\d"


def _terms(text: str) -> list[str]:
    return [t for w in text.split() if (t := "".join(c for c in w if c.isalnum()).lower())]


def parse(raw: str, fields: tuple[str, ...] = ("source", "lang", "quality", "toxic")) -> Query:
    """Words, "phrases", -exclusions, field:value, date:a..b, sort:newest."""
    if len(raw) > MOST_CHARS:
        raise QueryError("the query is too long")
    if len(re.findall(r'(?<!\\)"', raw)) % 2:
        raise QueryError("a quote is not closed")
    query, clauses = Query(), 0
    for minus, name, quoted, plain in _TOKEN.findall(raw):
        value, name = (quoted.replace('\\"', '"') or plain), name.lower()
        clauses += 1
        if clauses > MOST_CLAUSES:
            raise QueryError("the query has too many clauses")
        if name == "sort":
            if value not in ("relevance", "newest", "oldest") or minus:
                raise QueryError(f"unknown sort {value}")
            query = Query(**{**query.__dict__, "sort": value})
        elif name == "date":
            query.dates.append((*_days(value), bool(minus)))
        elif name in fields:
            (query.not_facets if minus else query.facets).setdefault(name, []).append(value)
        else:
            terms = _terms(f"{name} {value}" if name else value)
            if minus and terms:
                query.without.append(terms)
            elif quoted and terms:
                query.phrases.append(terms)
            else:
                query.words.extend(terms)
    if not (query.words or query.phrases) and query.sort == "relevance":
        query = Query(**{**query.__dict__, "sort": "newest"})
    return query


def _days(value: str) -> tuple[str | None, str | None]:
    if m := re.fullmatch(rf"({_DAY})?\.\.({_DAY})?", value):
        low, high = m[1], m[2]
    elif m := re.fullmatch(rf"(>=|<=|=)?({_DAY})", value):
        low, high = (m[2] if m[1] != "<=" else None), (m[2] if m[1] != ">=" else None)
    else:
        raise QueryError(f"not a date: {value}")
    if low and high and low > high:
        raise QueryError("the dates are reversed")
    return low, high


def postings(docs: DataFrame, name: str = "doc_id", text: str = "text") -> DataFrame:
    """(name, position, term) of all texts."""
    return docs.select(name, F.posexplode(tx.tokens(F.col(text))).alias("position", "term"))


def having_all(index: DataFrame, terms: list[str], name: str = "doc_id") -> DataFrame:
    wanted = sorted(set(terms))
    return index.where(F.col("term").isin(wanted)).groupBy(name).agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(wanted)).select(name)


def having_phrase(index: DataFrame, terms: list[str], name: str = "doc_id") -> DataFrame:
    """Texts in which the terms stand one after another: each occurrence votes
    for the start it would belong to."""
    at = F.create_map(*[x for t in sorted(set(terms)) for x in (F.lit(t), F.array(*[F.lit(i) for i, u in enumerate(terms) if u == t]))])
    votes = index.where(F.col("term").isin(sorted(set(terms)))).select(
        name, F.explode(F.transform(F.element_at(at, F.col("term")), lambda i: F.col("position") - i)).alias("start")
    )
    return votes.groupBy(name, "start").agg(F.count("*").alias("n")).where(F.col("n") == len(terms)).select(name).distinct()


def passing(docs: DataFrame, query: Query, date: str | None = None) -> DataFrame:
    """Rows of docs that pass a query's facets and dates.  One field's values
    are alternatives, different fields all hold."""
    kept = docs
    for field_, values in query.facets.items():
        kept = kept.where(F.col(field_).cast("string").isin(values))
    for field_, values in query.not_facets.items():
        kept = kept.where(~F.coalesce(F.col(field_).cast("string").isin(values), F.lit(False)))
    for low, high, negative in query.dates if date else ():
        day = F.date_format(date, "yyyy-MM-dd")
        inside = F.lit(True) & (day >= low if low else F.lit(True)) & (day <= high if high else F.lit(True))
        kept = kept.where(~inside if negative else inside)
    return kept


def in_order(rows: DataFrame, query: Query, name: str, date: str | None) -> DataFrame:
    """Rows by a query's sort, where a date is given and it is a date's."""
    if date and query.sort != "relevance":
        rows = rows.orderBy(F.desc(date) if query.sort == "newest" else F.asc(date), name)
    return rows


def search(docs: DataFrame, query: Query, name: str = "doc_id", date: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """Rows of docs that a query matches, by its sort where a date is given.

    ``index`` has (name, position, term) of the query's terms at least; without
    one, the texts that pass the facets and dates are cut into terms here.
    """
    kept = passing(docs, query, date)
    index = postings(kept, name) if index is None else index
    found = [having_all(index, query.words, name)] if query.words else []
    found += [having_phrase(index, p, name) for p in query.phrases]
    kept = reduce(lambda d, f: d.join(f, name, "left_semi"), found, kept)
    kept = reduce(lambda d, t: d.join(having_phrase(index, t, name), name, "left_anti"), query.without, kept)
    return in_order(kept, query, name, date)
