"""Intervals of integers as few blocks of 2^k, so that intervals and places meet by equality: an interval is cut into at most two blocks of each size, and a place lies in one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = "struct<size:int,block:bigint>"


def blocks_of(first: str, end: str, sizes: int) -> Column:
    """Array of blocks (size, block) that make up [first, end): size k has the places block * 2^k to (block + 1) * 2^k - 1. Sizes go up to `sizes`, of which any number may be taken."""
    low, high = f"shiftright({first} + shiftleft(1L, k) - 1, k)", f"shiftright({end}, k)"
    inner = f"""filter(array(IF({low} % 2 <> 0 AND {low} < {high}, {low}, NULL),
      IF({high} % 2 <> 0 AND {low} + abs({low} % 2) < {high}, {high} - 1, NULL)), b -> b IS NOT NULL)"""
    last = f"IF({low} < {high}, sequence({low}, {high} - 1), array())"
    pieces = f"transform(IF(k < {sizes}, {inner}, {last}), b -> named_struct('size', k, 'block', b))"
    return F.expr(f"flatten(transform(sequence(0, {sizes}), k -> {pieces}))").cast(f"array<{BLOCK}>")


def blocks_around(place: str, sizes: int) -> Column:
    """Array of the blocks (size, block) that a place lies in, one of each size."""
    return F.expr(f"transform(sequence(0, {sizes}), k -> named_struct('size', k, 'block', shiftright({place}, k)))").cast(f"array<{BLOCK}>")
