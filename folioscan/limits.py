"""Bounds that are part of results; the defaults are the published ones of document tools of this kind."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    hits: int = 10_000
    snippet_bytes: int = 512
    snippet_context: int = 24
    snippet_match: int = 96
    hit_boxes: int = 16
    query_bytes: int = 1024
    list_items: int = 100
    item_chars: int = 1024
    page_sizes: int = 32
    problems: int = 16
    revision_ranges: int = 1024
    depth: int = 32
    tree_depth: int = 64
    path: int = 64
    prefix_chars: int = 64
    label_repeats: int = 8
    uri_bytes: int = 2048
    line_bytes: int = 4096
    tail_lines: int = 200
    budget_bytes: int = 1 << 20
    compare_chars: int = 6000


LIMITS = Limits()
