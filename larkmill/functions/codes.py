"""Arrays of codes: offsets, separators, labels, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chance import uniform


def dense(indices: Column, values: Column, n: int) -> Column:
    """An array of n values from the places and values of a sparse one; other places hold 0, of equal places the last value."""
    held = F.map_from_entries(F.transform(F.array_sort(F.arrays_zip(indices.alias("i"), values.alias("v"))), lambda x: F.struct(x["i"].cast("int"), x["v"])))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at(held, k.cast("int")), F.lit(0)))


def squeeze(nested: Column) -> Column:
    """The inner array of an array that holds just one; longer ones raise an error, null and empty ones give null."""
    return F.when(F.size(nested) > 1, F.raise_error(F.lit("more than one entry to squeeze"))).otherwise(F.get(nested, F.lit(0)))


def add_level_offset(codes: Column, levels: int, width: int) -> Column:
    """codes of level h (by place) plus h * width; -1 (padding) stays."""
    return F.transform(codes, lambda x, i: F.when(x < 0, x).otherwise(x + (i % levels) * width))


def remove_level_offset(codes: Column, levels: int, stride: int) -> Column:
    """The inverse; codes outside their level's range raise an error."""
    bare = F.transform(codes, lambda x, i: x - (i % levels) * stride)
    return F.when(F.exists(bare, lambda x: (x < 0) | (x >= stride)), F.raise_error(F.lit("code out of its level's range"))).otherwise(bare)


def with_separators(codes: Column, levels: int, separator: int) -> Column:
    """The separator after every item's codes."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(codes), F.lit(1)), F.lit(levels))
    return F.when(F.size(codes) == 0, codes).otherwise(F.flatten(F.transform(starts, lambda i: F.concat(F.slice(codes, i, levels), F.array(F.lit(separator).cast("bigint"))))))


def next_k_label(seq: Column, k: int, mask: int, pad: int) -> tuple[Column, Column]:
    """(input, label): the last k tokens are the label; the input has a mask and k - 1 pads in their place."""
    size = F.size(seq)
    checked = F.when(size <= k, F.raise_error(F.lit("sequence too short"))).otherwise(seq)
    head = F.slice(checked, F.lit(1), F.greatest(size - k, F.lit(0)))
    return F.concat(head, F.array(F.lit(mask).cast("bigint")), F.array_repeat(F.lit(pad).cast("bigint"), k - 1)), F.slice(checked, F.lit(-k), F.lit(k))


def causal_mask(n: int) -> Column:
    """n rows of n flags: place j is seen from i where j <= i."""
    row = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(row, lambda i: F.transform(row, lambda j: j <= i))


def mask_tokens(seq: Column, key: Column, share: float, mask: int, seed: int, span: int = 1) -> Column:
    """seq with about `share` of its tokens (or spans of tokens) masked by hash, at least one where there is any."""
    u = lambda i: uniform(key, F.floor(i / span), seed=seed)
    least = F.array_min(F.transform(seq, lambda _, i: F.struct(u(i).alias("u"), F.floor(i / span).alias("i"))))["i"]
    return F.transform(seq, lambda x, i: F.when((u(i) < share) | (F.floor(i / span) == least), F.lit(mask).cast("bigint")).otherwise(x))
