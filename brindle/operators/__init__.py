"""Relational operators as DataFrame combinators."""

from .relational import (
    aggregate,
    cross_product,
    except_rows,
    filter_rows,
    grouping_sets,
    hash_join,
    intersect_rows,
    mark_join,
    project,
    range_join,
    running_sum,
    sample_rows,
    single_join,
    small,
    top_k,
    union_rows,
    window,
)

__all__ = ["aggregate", "cross_product", "except_rows", "filter_rows", "grouping_sets", "hash_join", "intersect_rows", "mark_join", "project", "range_join", "running_sum", "sample_rows", "single_join", "small", "top_k", "union_rows", "window"]
