"""Model steps as pluggable providers. Defaults are deterministic stand-ins that need no model, not equals of trained ones;
a provider is any function of columns (or a pandas UDF) with the same arguments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessellar.functions import text as T


def share_of_query(query: Column, text: Column) -> Column:
    """Relevance 0..1: the part of the query's terms that the text holds."""
    q = F.array_distinct(T.terms(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.terms(text))) / F.size(q)).otherwise(0.0)


def cosine_of_terms(a: Column, b: Column) -> Column:
    """Similarity 0..1 of two lists of terms: the cosine of the sets' indicator vectors; 0 where either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.sqrt(F.size(x) * F.size(y))).otherwise(0.0)


def share_of_terms(query: Column, terms: Column) -> Column:
    """The part of the query's distinct terms among others; 0 without terms."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, terms)) / F.size(query)).otherwise(0.0)


def matching_sentences(query: Column, text: Column) -> Column:
    """Sentences that share a term with the query, joined by `` | ``; the first 200 characters where none does."""
    hits = F.filter(T.sentences(text), lambda s: F.size(F.array_intersect(T.terms(s), T.terms(query))) > 0)
    return F.when(F.size(hits) > 0, F.array_join(hits, " | ")).otherwise(F.substring(text, 1, 200))


def hashed_vector(text: Column, size: int = 64) -> Column:
    """Counts of hashed terms as a vector, not scaled."""
    h = F.transform(T.terms(text), lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(h, lambda x: x == i)).cast("double"))


@dataclass(frozen=True)
class Providers:
    relevance: Callable[[Column, Column], Column] = field(default=share_of_query)
    #: of two texts; without one, plans that hold the texts' terms as columns use ``cosine_of_terms`` on these
    similarity: Callable[[Column, Column], Column] | None = None
    extract: Callable[[Column, Column], Column] = field(default=matching_sentences)
    embed: Callable[[Column], Column] = field(default=hashed_vector)

    def alike(self, a: Column, b: Column, a_terms: Column, b_terms: Column) -> Column:
        return self.similarity(a, b) if self.similarity else cosine_of_terms(a_terms, b_terms)

    def relevant(self, query: Column, text: Column, query_terms: Column, text_terms: Column) -> Column:
        return share_of_terms(query_terms, text_terms) if self.relevance is share_of_query else self.relevance(query, text)
