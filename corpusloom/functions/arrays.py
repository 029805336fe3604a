"""Sequence expressions over token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.vectors import let

IGNORE_LABEL = -100


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fan_out(df: DataFrame, keep: list[str | Column], arr: str | Column, value: str, pos: str | None = None) -> DataFrame:
    """One row per array item with its position; rows without items disappear.

    Same result as ``posexplode``. The optimizer infers ``size(arr) > 0`` from a plain explode and
    pushes it below, which evaluates an expensive array expression a second time; from the outer
    form, with empty rows dropped afterwards, it infers nothing.
    """
    name = pos or "_pos"
    out = df.select(*keep, F.posexplode_outer(_c(arr)).alias(name, value)).filter(F.col(name).isNotNull())
    return out if pos else out.drop(name)


def last_n(arr: str | Column, n: Column | int) -> Column:
    """The last ``n`` items (all of them when there are fewer)."""
    n = F.lit(n) if isinstance(n, int) else n
    keep = F.least(n, F.size(_c(arr)))
    return F.when(keep > 0, F.slice(_c(arr), F.size(_c(arr)) - keep + 1, keep)).otherwise(F.slice(_c(arr), 1, 0))


def first_n(arr: str | Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(_c(arr), F.lit(1), F.greatest(n, F.lit(0)))


def pad(arr: str | Column, length: Column | int, value: Column | int, side: str = "right") -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    value = F.lit(value) if isinstance(value, int) else value
    fill = F.array_repeat(value, F.greatest(length - F.size(_c(arr)), F.lit(0)).cast("int"))
    return F.concat(_c(arr), fill) if side == "right" else F.concat(fill, _c(arr))


def fit(arr: str | Column, length: int, value: int) -> Column:
    """Cut or right-pad to exactly ``length``."""
    return pad(first_n(arr, length), length, value)


def pad_mask(arr: str | Column, value: int) -> Column:
    return F.transform(_c(arr), lambda x: (x != value).cast("int"))


def segment_ids(arr: str | Column, separator: Column | int) -> Column:
    """0/1 per token, flipping at every separator: (separators so far - 1) mod 2."""
    sep = F.lit(separator) if isinstance(separator, int) else separator
    places = F.filter(F.transform(_c(arr), lambda x, i: F.when(x == sep, i)), lambda i: i.isNotNull())

    def runs(p: Column) -> Column:
        begins, ends = F.concat(F.array(F.lit(0)), p), F.concat(p, F.array(F.size(_c(arr))))
        # run k lies between separators k and k + 1; the one before the first separator counts as odd
        sized = F.zip_with(begins, ends, lambda b, e: e - b)
        return F.flatten(F.transform(sized, lambda n, k: F.array_repeat(F.pmod(k - 1, F.lit(2)), n)))

    return let(places, runs)


def truncate_left(source: str | Column, target: str | Column, budget: int) -> Column:
    """Keep the last tokens of ``source`` so that both fit in ``budget``."""
    fits = F.size(_c(source)) + F.size(_c(target)) <= budget
    return F.when(fits, _c(source)).otherwise(last_n(source, F.lit(budget) - F.size(_c(target))))


def multi_hot(labels: str | Column, classes: list[str]) -> Column:
    return F.array(*[F.array_contains(_c(labels), c).cast("int") for c in classes])


def most_frequent(arr: str | Column) -> Column:
    """All items with the largest count, in order of first appearance."""
    items = F.array_distinct(_c(arr))
    counted = F.transform(
        items,
        lambda x: F.struct(x.alias("item"), F.size(F.filter(_c(arr), lambda y: y == x)).alias("n")),
    )

    def winners(c: Column) -> Column:
        top = F.array_max(F.transform(c, lambda s: s["n"]))
        return let(top, lambda t: F.transform(F.filter(c, lambda s: s["n"] == t), lambda s: s["item"]))

    return let(counted, winners)


def choice(arr: str | Column, key: Column) -> Column:
    """One item picked by a reproducible key."""
    return F.element_at(_c(arr), (F.pmod(key, F.size(_c(arr)).cast("long")) + 1).cast("int"))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Jaccard similarity of two token sets (arrays may repeat items); two empty sets are equal."""
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / F.nullif(union, F.lit(0)))


def align_labels(piece_counts: str | Column, labels: str | Column, length: int, lead: int = 1) -> Column:
    """Word labels on first pieces, the ignore label elsewhere; boundary tokens included; padded."""
    ignore = F.lit(IGNORE_LABEL)
    per_word = F.zip_with(
        _c(piece_counts),
        _c(labels),
        lambda n, label: F.when(
            n > 0, F.concat(F.array(label.cast("int")), F.array_repeat(ignore, n.cast("int") - 1))
        ).otherwise(F.array().cast("array<int>")),
    )
    body = first_n(F.flatten(per_word), length - 2 * lead)
    edge = F.array_repeat(ignore, lead)
    return pad(F.concat(edge, body, edge), length, IGNORE_LABEL)
