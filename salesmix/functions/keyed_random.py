"""Random numbers that depend only on a text key.

A draw is a function of md5(key), so it is the same on every engine, for every
partitioning and after every task retry; nothing here reads a generator state.
Expressions are SQL text: one parsed expression costs the driver far less than a
tree of column calls, which counts in a loop that plans anew each time.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

GAMMA_TRIES = 32


def key_of(*parts: int | str, columns: tuple[str, ...] = (), name: str = "") -> str:
    """SQL text of a key: literal parts, column values, then a literal name.

    A string part is a column (an iteration number, say), an integer a literal.
    """
    texts = [f"'{p}'" if isinstance(p, int) else f"CAST({p} AS STRING)" for p in parts]
    return f"concat_ws('|', {', '.join([*texts, *columns, f"'{name}'"])})"


def _unit(digest: str, first: int) -> str:
    return f"((CAST(conv(substring({digest}, {first}, 8), 16, 10) AS DOUBLE) + 0.5D) / 4294967296D)"


def _normal(digest: str) -> str:
    return f"(sqrt(-2D * ln({_unit(digest, 1)})) * cos({2 * pi!r}D * {_unit(digest, 9)}))"


def _digests(key: str, count: int) -> str:
    return (f"transform(sequence(0, {count - 1}), "
            f"k -> md5(concat_ws('|', {key}, CAST(k AS STRING))))")


def uniforms(key: str, count: int) -> Column:
    """Array of ``count`` uniforms on (0, 1)."""
    return F.expr(f"transform({_digests(key, count)}, g -> {_unit('g', 1)})")


def normals(key: str, count: int) -> Column:
    """Array of ``count`` standard normals, one digest each."""
    return F.expr(f"transform({_digests(key, count)}, g -> {_normal('g')})")


def gamma(key: str, shape: str, scale: str) -> Column:
    """Gamma(shape, scale) by rejection from a cubed normal (Marsaglia and Tsang).

    A try is accepted with probability above 0.95, so that all of ``GAMMA_TRIES``
    fail about once in 1e41 draws; then the expression raises an error.
    Shapes below 1 are drawn at shape + 1 and multiplied by u ** (1 / shape).
    """
    small = f"({shape}) < 1D"
    d = f"(CASE WHEN {small} THEN ({shape}) + 1D ELSE ({shape}) END - 1D / 3D)"
    drawn = (f"transform({_digests(key, GAMMA_TRIES)}, g -> named_struct("
             f"'x', {_normal('g')}, 'log_u', ln({_unit('g', 17)})))")
    cubed = (f"transform({drawn}, t -> named_struct('x', t.x, 'log_u', t.log_u, "
             f"'v', pow(1D + t.x / sqrt(9D * {d}), 3D)))")
    accepted = (f"filter(filter({cubed}, t -> t.v > 0D), "
                f"t -> t.log_u < 0.5D * t.x * t.x + {d} - {d} * t.v + {d} * ln(t.v))")
    boost = f"CASE WHEN {small} THEN pow({_unit(f'md5({key})', 1)}, 1D / ({shape})) ELSE 1D END"
    failed = "CAST(raise_error('no accepted gamma draw') AS DOUBLE)"
    first = f"coalesce(try_element_at({accepted}, 1).v, {failed})"
    return F.expr(f"{d} * {first} * {boost} * ({scale})")
