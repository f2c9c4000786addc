"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The maximal runs of characters that are no white space; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, start: Column, step) -> Column:
    """For each of an array's values, the fold of those before it, beginning with ``start``.

    Values go in blocks of about the square root of their number, so n values
    take n times that root steps, and no array is built by appending.
    """
    fold = lambda x, first: F.aggregate(x, first, step)

    def blocks(size: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda b: F.slice(values, b * size + 1, size))
        return let(cuts, lambda parts: let(F.transform(parts, lambda x: fold(x, start)), lambda sums: F.flatten(F.transform(
            parts, lambda x, b: let(fold(F.slice(sums, F.lit(1), b), start), lambda first: F.transform(x, lambda v, j: fold(F.slice(x, F.lit(1), j), first)))))))

    return F.when(F.size(values) == 0, values).otherwise(let(F.ceil(F.sqrt(F.size(values))).cast("int"), blocks))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double; 0 where ``whole`` is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column bears it, whatever the case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def settle(df, columns: dict):
    """``df`` with ``columns``, evaluated once whatever follows.

    A filter on a plain projection is rewritten onto its inputs, so costly
    expressions would be evaluated again, inside lambdas once per element.
    Nothing is moved through a generator: this one yields a single row.
    """
    keep = [c for c in df.columns if c.lower() not in {x.lower() for x in columns}]
    return df.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


_held: dict = {}


def held(key, make):
    """What a worker process keeps from task to task: one operator's state at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]
