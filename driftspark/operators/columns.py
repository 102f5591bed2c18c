"""Plan-time column selection (P1-P3, P7, P17, P18) and long-form reshaping."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

# Names that are never monitored as numeric features.
TIME_PART_NAMES = ("year", "month", "day", "hour")
# Score column aliases tried after the configured name, in order.
SCORE_ALIASES = ("prob", "proba", "proba_1", "p1", "prob_positive", "score_1", "prediction_score")
# 0/1 prediction columns used for the positive ratio when no score exists.
BINARY_PREDICTION_NAMES = ("prediction", "y_pred", "label", "target")
# Metrics compared across scenarios, in this order.
SCENARIO_METRICS = ("f1", "psi", "ttfd", "ttr")


# What a column's type makes of it, and the names that stay out of that use all the same.
USES = {"numeric": (NumericType, frozenset(TIME_PART_NAMES)), "categorical": (StringType, frozenset())}


@dataclass(frozen=True)
class Roles:
    """What a monitor does with each column of a table, settled once from its schema.

    ``numeric`` and ``categorical`` (P1, P2) are in schema order; ``score`` (P7) is the numeric
    column that PSI and the positive ratio use, ``assumed`` says that no known name led to it;
    ``binary`` (P12) are the 0/1 predictions that stand in where there is no score.
    """
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    score: str | None
    assumed: bool
    binary: tuple[str, ...]


def roles(df: DataFrame, exclude: Iterable[str] = (), score: str = "score", numeric: Sequence[str] | None = None,
          categorical: Sequence[str] | None = None) -> Roles:
    """The roles of a table's columns; a given list replaces the one read from the schema."""
    out = frozenset(exclude)
    used: dict[str, tuple[str, ...]] = {}
    for use, given in (("numeric", numeric), ("categorical", categorical)):
        kind, reserved = USES[use]
        used[use] = tuple(given) if given is not None else tuple(
            f.name for f in df.schema if isinstance(f.dataType, kind) and f.name not in out | reserved)
    known = {name: place for place, name in reversed([*enumerate((score, *SCORE_ALIASES))])}
    best = min(used["numeric"], key=lambda c: known.get(c, len(SCORE_ALIASES) + 1), default=None)
    return Roles(**used, score=best, assumed=best is not None and best not in known,
                 binary=tuple(c for c in BINARY_PREDICTION_NAMES if c in used["numeric"]))


def existing(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that the frame has, in the wanted order."""
    have = set(df.columns)
    return [c for c in wanted if c in have]


def find_column(df: DataFrame, name: str) -> str | None:
    """Case-insensitive column lookup (P18: ``SCENARIO`` accepted for ``scenario``)."""
    for c in df.columns:
        if c == name:
            return c
    for c in df.columns:
        if c.lower() == name.lower():
            return c
    return None


def metric_columns(df: DataFrame, candidates: Sequence[str] = SCENARIO_METRICS) -> list[str]:
    """Metrics present in the frame (P17); none is an error."""
    found = existing(df, candidates)
    if not found:
        raise ValueError(f"none of the metric columns {list(candidates)} is present")
    return found


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], value_type: str,
            column_name: str = "column", value_name: str = "value",
            null_policy: str = "per_column") -> DataFrame:
    """Wide → (ids..., column, value) with one row per non-null cell.

    ``null_policy="listwise"`` first drops every row with a null in any of ``cols``
    (parity with the sampled detector); ``"per_column"`` keeps each cell on its own.
    """
    if null_policy not in ("per_column", "listwise"):
        raise ValueError(null_policy)
    base = df.select(*ids, *[F.col(c).cast(value_type).alias(c) for c in cols])
    if value_type in ("double", "float"):  # NaN is a missing value, as null is
        base = base.select(*ids, *[F.nanvl(F.col(c), F.lit(None).cast(value_type)).alias(c) for c in cols])
    if null_policy == "listwise":
        base = base.dropna(subset=list(cols))
    # explode(array(struct)) rather than unpivot: the Expand node that unpivot plans
    # renames its pass-through columns when the frame meets itself in a self-join,
    # which defeats exchange reuse in the two-phase running counts.
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias(column_name), F.col(c).alias(value_name))
                             for c in cols])).alias("_kv")
    long = base.select(*ids, kv).select(*ids, F.col(f"_kv.{column_name}").alias(column_name),
                                        F.col(f"_kv.{value_name}").alias(value_name))
    return long.where(F.col(value_name).isNotNull())
