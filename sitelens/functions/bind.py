"""Evaluate an expression once and reuse it.

Catalyst substitutes a column's defining expression into every place that
references it when it pushes filters through projections, so a value used
five times by a predicate would be computed five times (and can push generated
code past the JVM's 64 KB method limit).  ``let`` binds the value to a lambda
variable of a one-element array instead: the expression appears once in the
plan, and the body refers to the variable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), 0)
