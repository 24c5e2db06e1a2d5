"""Structured filters as predicates, which Catalyst pushes into the scan."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SearchFilter:
    paper_id: str | None = None
    section_title: str | None = None
    min_page: int | None = None
    max_page: int | None = None

    def on_page(self, page: str = "page_number") -> Column:
        """For rows with one page each."""
        conditions = []
        if self.paper_id is not None:
            conditions.append(F.col("paper_id") == self.paper_id)
        if self.section_title is not None:
            conditions.append(F.col("section_title") == self.section_title)
        if self.min_page is not None and self.min_page == self.max_page:
            conditions.append(F.col(page) == self.min_page)
        else:
            if self.min_page is not None:
                conditions.append(F.col(page) >= self.min_page)
            if self.max_page is not None:
                conditions.append(F.col(page) <= self.max_page)
        return reduce(lambda a, b: a & b, conditions, F.lit(True))

    def on_pages(self, pages: str = "page_numbers") -> Column:
        """For rows with a list of pages: some page reaches each bound, not necessarily the same one. Empty names don't filter."""
        conditions = []
        if self.paper_id:
            conditions.append(F.col("paper_id") == self.paper_id)
        if self.section_title:
            conditions.append(F.col("section_title") == self.section_title)
        if self.min_page is not None:
            conditions.append(F.exists(pages, lambda p: p >= self.min_page))
        if self.max_page is not None:
            conditions.append(F.exists(pages, lambda p: p <= self.max_page))
        return reduce(lambda a, b: a & b, conditions, F.lit(True))

    def scoped(self, paper_id: str | None) -> SearchFilter:
        """With another paper, if one is given."""
        return self if paper_id is None else replace(self, paper_id=paper_id)


def compile_where(where: dict[str, Any] | None) -> Column:
    """{"a": 1}, {"a": {"$gte": 1}}, {"$and": [...]}, {"$or": [...]} and the other comparisons as a predicate."""
    compare = {"$eq": Column.__eq__, "$ne": Column.__ne__, "$gt": Column.__gt__, "$gte": Column.__ge__, "$lt": Column.__lt__, "$lte": Column.__le__}
    conditions = []
    for name, value in (where or {}).items():
        if name in ("$and", "$or"):
            parts = [compile_where(v) for v in value]
            conditions.append(reduce((lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b), parts))
        elif isinstance(value, dict):
            for op, x in value.items():
                if op in ("$in", "$nin"):
                    inside = F.col(name).isin(*x)
                    conditions.append(inside if op == "$in" else ~inside)
                elif op in compare:
                    conditions.append(compare[op](F.col(name), F.lit(x)))
                else:
                    raise ValueError(f"unknown comparison {op}")
        else:
            conditions.append(F.col(name) == value)
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
