"""Merge policies: how the values of rows with one key become one value.

A policy is an aggregate of (value, order). Order-free ones need no order column
at all, so the planner need not number the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.plans.values import Value


class MergePolicy:
    """Base of custom policies: define ``merge(old, new)``, folded in arrival order from None.

    ``returns`` is the type of the result, by default the field's own.
    """

    ordered = True
    returns: str | T.DataType | None = None

    def merge(self, old: Any, new: Any) -> Any:
        raise NotImplementedError

    def result_type(self, dtype: T.DataType) -> T.DataType:
        return dtype if self.returns is None else T.DataType.fromDDL(self.returns) if isinstance(self.returns, str) else self.returns

    def aggregate(self, value: Value, order: Column, defined: Column | None) -> Column:
        """All values in order, folded by ``merge`` in Arrow batches of groups."""
        merge = self.merge

        def fold(groups: pd.Series) -> pd.Series:
            out = []
            for values in groups:
                state = None
                for v in values:
                    state = merge(state, v.item() if hasattr(v, "item") else v)
                out.append(state)
            return pd.Series(out, dtype=object)

        return F.pandas_udf(fold, self.result_type(value.dtype))(_in_order(value.col, order, defined, keep_null=True))


def _in_order(col: Column, order: Column, defined: Column | None, *, keep_null: bool = False) -> Column:
    entry = F.struct(order.alias("o"), col.alias("v"))
    use = F.lit(True) if defined is None else defined
    if not keep_null:
        use = use & col.isNotNull()
    # the comparator looks at the order only, so that values need not be sortable
    ranked = F.array_sort(F.collect_list(F.when(use, entry)), lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0))
    return F.transform(ranked, lambda e: e["v"])


@dataclass(frozen=True)
class LastWritePolicy(MergePolicy):
    """The latest value, null included, of the emissions that define the field. The default."""

    def aggregate(self, value: Value, order: Column, defined: Column | None) -> Column:
        boxed = F.struct(value.col.alias("v"))
        return F.max_by(boxed, order if defined is None else F.when(defined, order))["v"]


@dataclass(frozen=True)
class AddPolicy(MergePolicy):
    """The sum, null as 0; booleans count as numbers."""

    ordered = False

    def result_type(self, dtype: T.DataType) -> T.DataType:
        return T.DoubleType() if isinstance(dtype, (T.DoubleType, T.FloatType, T.VariantType)) else dtype if isinstance(dtype, T.DecimalType) else T.LongType()

    def aggregate(self, value: Value, order: Column, defined: Column | None) -> Column:
        if isinstance(value.dtype, (T.StringType, T.ArrayType, T.MapType, T.StructType)):
            raise TypeError(f"AddPolicy cannot add {value.dtype.simpleString()}")
        col = value.col.cast("int") if isinstance(value.dtype, (T.BooleanType, T.NullType)) else value.col.cast("double") if value.is_variant else value.col
        return F.coalesce(F.sum(col), F.lit(0)).cast(self.result_type(value.dtype))


@dataclass(frozen=True)
class AppendPolicy(MergePolicy):
    """A list of the values that are not null, in arrival order."""

    def result_type(self, dtype: T.DataType) -> T.DataType:
        return T.ArrayType(T.StringType() if isinstance(dtype, T.NullType) else dtype)

    def aggregate(self, value: Value, order: Column, defined: Column | None) -> Column:
        return _in_order(value.col, order, defined)


@dataclass(frozen=True)
class ExtendPolicy(MergePolicy):
    """The lists joined in arrival order; a single value counts as a list of one."""

    def result_type(self, dtype: T.DataType) -> T.DataType:
        return dtype if isinstance(dtype, T.ArrayType) else T.ArrayType(T.StringType() if isinstance(dtype, T.NullType) else dtype)

    def aggregate(self, value: Value, order: Column, defined: Column | None) -> Column:
        if isinstance(value.dtype, T.ArrayType):
            return F.flatten(_in_order(value.col, order, defined))
        if value.is_variant:
            listed = F.coalesce(F.try_variant_get(value.col, "$", "array<variant>"), F.when(value.col.isNotNull(), F.array(value.col)))
            return F.flatten(_in_order(listed, order, defined))
        return _in_order(value.col, order, defined)


def _sortable(value: Value, name: str) -> Column:
    if value.is_variant:
        raise TypeError(f"{name} needs a typed value: use apply(int, ..), apply(float, ..) or apply(str, ..)")
    return value.col


@dataclass(frozen=True)
class MinPolicy(MergePolicy):
    """The least value, nulls ignored."""

    ordered = False

    def aggregate(self, value: Value, order: Column, defined: Column | None) -> Column:
        return F.min(_sortable(value, "MinPolicy"))


@dataclass(frozen=True)
class MaxPolicy(MergePolicy):
    """The greatest value, nulls ignored."""

    ordered = False

    def aggregate(self, value: Value, order: Column, defined: Column | None) -> Column:
        return F.max(_sortable(value, "MaxPolicy"))


@dataclass(frozen=True)
class FirstNonNullPolicy(MergePolicy):
    """The earliest value that is not null; False, 0 and "" are values."""

    def aggregate(self, value: Value, order: Column, defined: Column | None) -> Column:
        return F.min_by(value.col, F.when(value.col.isNotNull(), order))
