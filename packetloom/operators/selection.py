"""Which numeric columns become model features."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.packets import finite_or

# Columns that identify or label a flow and never become features.
NOT_FEATURES = (
    "day", "capture_file", "flow_id", "flow_src_ip", "flow_dst_ip", "flow_src_port", "flow_dst_port",
    "flow_start_ts", "flow_end_ts", "dst_port", "label", "attempted_category", "matched",
    "label_encoded", "y", "is_attempted", "cut", "split", "weight", "match_level",
    "flow_start_us", "flow_end_us",
)
INITIAL_WINDOW = ("init_fwd_win_byts", "init_bwd_win_byts")
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def feature_columns(
    df: DataFrame, drop: Sequence[str] = NOT_FEATURES, extra: Iterable[str] = (), strict: bool = False
) -> list[str]:
    """Numeric columns minus the drop set and extra drops, in schema order."""
    kept = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in drop]
    extra = set(extra)
    unknown = extra - set(kept)
    if strict and unknown:
        raise ValueError(f"not feature columns: {sorted(unknown)}")
    return [c for c in kept if c not in extra]


def _clean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[finite_or("zero", c).alias(c) for c in columns])


def constant_features(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns whose sample deviation is 0 or undefined, after non-finite became 0.

    A column is constant when its minimum equals its maximum, which is exact where a
    floating deviation might leave a residue.
    """
    clean = _clean(df, columns)
    spans = clean.agg(
        F.count(F.lit(1)).alias("_n"), *[(F.max(c) == F.min(c)).alias(c) for c in columns]
    ).first()
    return [c for c in columns if spans["_n"] < 2 or spans[c]]


def correlated_features(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> list[str]:
    """Columns that correlate above the threshold with some later column."""
    if len(columns) < 2:
        return []
    vectors = VectorAssembler(inputCols=list(columns), outputCol="v").transform(_clean(df, columns)).select("v")
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    return [
        a for i, a in enumerate(columns) if any(abs(matrix[i, j]) > threshold for j in range(i + 1, len(columns)))
    ]


def selection_report(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """(feature, position, reason): kept, constant or correlated."""
    constant = set(constant_features(df, columns))
    varying = [c for c in columns if c not in constant]
    correlated = set(correlated_features(df, varying, threshold))
    reason = lambda c: "constant" if c in constant else "correlated" if c in correlated else "kept"
    rows = [(c, i, reason(c)) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "feature string, position int, reason string")
