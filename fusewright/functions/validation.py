"""Checks of inputs: one aggregate per table, errors as ``ValueError`` on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DUPLICATES = ("first", "sum", "mean", "max", "min")
#: A value of ``validate``: bad rows are errors of the operator's own job.
IN_PLAN = "in plan"
METHODS = ("mean", "median", "trimmed_mean", "huber", "lts")


def _number(c: str) -> Column:
    return F.col(c).cast("double")


def offences(column: str, *, finite: bool = True, non_negative: bool = False, positive: bool = False, lower: float | None = None, upper: float | None = None, inclusive: bool = True) -> dict[str, Column]:
    """Named conditions that offending rows meet."""
    x = _number(column)
    out = {f"{column} is null": x.isNull()}
    if finite:
        out[f"{column} must be finite"] = F.isnan(x) | (F.abs(x) == float("inf"))
    if non_negative:
        out[f"{column} must be non-negative"] = x < 0
    if positive:
        out[f"{column} must be positive"] = x <= 0
    if lower is not None:
        out[f"{column} must be {'>=' if inclusive else '>'} {lower}"] = x < lower if inclusive else x <= lower
    if upper is not None:
        out[f"{column} must be {'<=' if inclusive else '<'} {upper}"] = x > upper if inclusive else x >= upper
    return out


def violations(column: str, **rules: bool | float | None) -> dict[str, Column]:
    """Named counts of offending rows, for one ``agg``; ``rules`` are those of ``offences``."""
    return {name: F.count_if(bad) for name, bad in offences(column, **rules).items()}


def guard(df: DataFrame, column: str, **rules: bool | float | None) -> DataFrame:
    """``df`` whose job fails, with the offence's name, at the first row that breaks a rule of ``offences``. No job runs here and no row is read twice."""
    sound = F.lit(True)
    for name, bad in offences(column, **rules).items():
        sound = sound & F.assert_true(~F.coalesce(bad, F.lit(False)), F.lit(name)).isNull()
    return df.withColumn(column, F.when(sound, F.col(column)))


def check(df: DataFrame, counts: dict[str, Column]) -> None:
    """Raise for the first named count that is not zero."""
    if not counts:
        return
    row = df.agg(*[c.alias(f"c{k}") for k, c in enumerate(counts.values())]).head()
    for name, n in zip(counts, row):
        if n:
            raise ValueError(f"{name} ({n} rows)")


def check_array(df: DataFrame, column: str, *, allow_nan: bool = False, non_negative: bool = False, positive: bool = False) -> DataFrame:
    """``allow_nan`` lets NaN and infinities pass."""
    counts = violations(column, finite=not allow_nan, non_negative=non_negative, positive=positive)
    if allow_nan:
        counts = {k: v for k, v in counts.items() if not k.endswith("is null")}
    check(df, counts)
    return df


def positive_int(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a positive integer, got {value!r}")
    return value


def positive_number(value: float, name: str) -> float:
    if not value > 0 or value == float("inf"):
        raise ValueError(f"{name} must be positive and finite, got {value!r}")
    return float(value)


def choice(value: str, allowed: tuple[str, ...], name: str) -> str:
    if value.lower() not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, got {value!r}")
    return value.lower()


def fraction(value: float, name: str = "trim") -> float:
    if not 0 <= value <= 0.5:
        raise ValueError(f"{name} must be between 0 and 0.5, got {value!r}")
    return float(value)


def group_report(obs: DataFrame, column: str = "group_id") -> DataFrame:
    """What ``check_groups`` looks at, as one row."""
    g = F.col(column)
    bad = g.isNull() | F.isnan(g.cast("double")) | (g.cast("double") != F.floor(g.cast("double")))
    return obs.agg(
        F.count("*").alias("n_rows"), F.count_if(bad).alias("n_invalid"), F.count_if(g < 0).alias("n_negative"),
        F.count_distinct(g).alias("n_unique"), F.min(g).cast("long").alias("min_id"), F.max(g).cast("long").alias("max_id"),
    )


def survey(obs: DataFrame, counts: dict[str, Column], column: str = "group_id") -> dict[str, int | None]:
    """What ``group_report`` says, ``largest`` (rows of the largest group) and named ``counts`` of offending rows, in one job with one partial aggregation by group."""
    g = F.col(column)
    bad = g.isNull() | F.isnan(g.cast("double")) | (g.cast("double") != F.floor(g.cast("double")))
    own = obs.groupBy(column).agg(F.count("*").alias("n_"), *[c.alias(f"c{k}_") for k, c in enumerate(counts.values())])
    row = own.agg(
        F.sum("n_").alias("n_rows"), F.sum(F.when(bad, F.col("n_"))).alias("n_invalid"), F.sum(F.when(g < 0, F.col("n_"))).alias("n_negative"), F.count(g).alias("n_unique"),
        F.min(g).cast("long").alias("min_id"), F.max(g).cast("long").alias("max_id"), F.max("n_").alias("largest"), *[F.sum(f"c{k}_").alias(name) for k, name in enumerate(counts)],
    ).head().asDict()
    return {k: row[k] if k in ("min_id", "max_id", "largest") else row[k] or 0 for k in row}


def raise_first(report: dict[str, int | None]) -> None:
    """Raise for the first of ``survey``'s counts that is not zero."""
    for name in list(report)[7:]:
        if report[name]:
            raise ValueError(f"{name} ({report[name]} rows)")


def check_groups(obs: DataFrame, n_groups: int | None = None, column: str = "group_id") -> int:
    """The number of groups. Without ``n_groups`` the ids must be 0 to k-1; with it, gaps are fine but id 0 must occur. No rows: ``n_groups`` or 0."""
    return settle_groups(survey(obs, {}, column), n_groups, column)


def settle_groups(r: dict[str, int | None], n_groups: int | None = None, column: str = "group_id") -> int:
    """``check_groups`` of a ``survey``."""
    if not r["n_rows"]:
        return n_groups or 0
    if r["n_invalid"]:
        raise ValueError(f"{column} must hold whole numbers ({r['n_invalid']} rows do not)")
    if r["n_negative"]:
        raise ValueError(f"{column} must be non-negative ({r['n_negative']} rows are not)")
    if n_groups is None:
        if r["min_id"] != 0 or r["max_id"] != r["n_unique"] - 1:
            raise ValueError(f"{column} must be contiguous from 0: {r['n_unique']} ids from {r['min_id']} to {r['max_id']}")
        return r["n_unique"]
    positive_int(n_groups, "n_groups")
    if r["n_unique"] > n_groups:
        raise ValueError(f"there are {r['n_unique']} groups, more than n_groups={n_groups}")
    if r["max_id"] >= n_groups:
        raise ValueError(f"the largest id {r['max_id']} is not below n_groups={n_groups}")
    if r["min_id"] != 0:
        raise ValueError(f"{column} must start at 0, it starts at {r['min_id']}")
    return n_groups


def pair_report(pairs: DataFrame, n_params: int | None = None) -> DataFrame:
    """Counts of what is wrong with raw pairs, as one row."""
    w = _number("weight")
    top = F.count_if(F.greatest("u", "v") >= n_params) if n_params is not None else F.lit(0).cast("long")
    return pairs.agg(
        F.count("*").alias("n_pairs"), F.count_if(F.col("u").isNull() | F.col("v").isNull()).alias("n_null"), F.count_if((F.col("u") < 0) | (F.col("v") < 0)).alias("n_negative"),
        F.count_if(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf"))).alias("n_weight_not_finite"), F.count_if(w <= 0).alias("n_weight_not_positive"),
        F.count_if(F.col("u") == F.col("v")).alias("n_loops"), top.alias("n_out_of_bounds"),
    )


def check_pairs(pairs: DataFrame, n_params: int | None = None) -> None:
    """Ids non-negative and below ``n_params``, weights finite and positive; self-loops are fine here."""
    if n_params is not None:
        positive_int(n_params, "n_params")
    r = pair_report(pairs, n_params).head()
    for name, what in (
        ("n_null", "pairs must not be null"), ("n_negative", "pairs must be non-negative"), ("n_weight_not_finite", "weights must be finite"),
        ("n_weight_not_positive", "weights must be positive"), ("n_out_of_bounds", f"pairs must be below n_params={n_params}"),
    ):
        if r[name]:
            raise ValueError(f"{what} ({r[name]} rows are not)")


def check_index(i: int, n: int) -> int:
    if not 0 <= i < n:
        raise IndexError(f"node {i} is out of range [0, {n})")
    return i
