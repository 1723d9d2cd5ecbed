"""Arithmetic on array columns; everything stays in JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression named inside a lambda is evaluated again for every element, even when it comes
    from an earlier column, because the optimizer may inline that column. A bound lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit-length copy of a vector; the zero vector has no direction and yields null."""
    return let(v, lambda w: let(norm(w), lambda n: F.transform(w, lambda x: F.try_divide(x.cast("double"), n))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(
        total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    )


def distances_to(v: Column, centers: Column) -> Column:
    """Distance of ``v`` to every vector of the array ``centers``, in the order of ``centers``."""
    return let(v, lambda w: F.transform(centers, lambda c: euclidean(w, c)))


def project(v: Column, mean: Column, components: Column) -> Column:
    """Centre, then one dot product per component."""
    return let(subtract(v, mean), lambda w: F.transform(components, lambda c: dot(w, c)))


def ranked(d: Column) -> Column:
    """``(distance, id)`` structs, nearest first; the lower id wins a tie."""
    return F.array_sort(F.transform(d, lambda x, i: F.struct(x.alias("distance"), i.alias("id"))))


def argmax(p: Column) -> Column:
    """0-based position of the largest entry; the lowest position wins a tie."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def gibbs(d: Column, temperature: Column) -> Column:
    """Soft memberships ``exp(-(d - min d) / temperature)``, scaled to sum to one."""
    def affinities(w: Column) -> Column:
        return let(F.array_min(w), lambda nearest: F.transform(w, lambda x: F.exp((nearest - x) / temperature)))

    return scaled_to_one(let(d, affinities))


def scaled_to_one(v: Column) -> Column:
    return let(v, lambda w: let(total(w), lambda mass: F.transform(w, lambda x: x / mass)))


def entropy(m: Column) -> Column:
    return -total(F.transform(m, lambda x: x * F.ln(F.greatest(x, F.lit(TINY)))))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
