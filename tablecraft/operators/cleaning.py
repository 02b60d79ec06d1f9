"""Cleaning: empty columns and rows, dates, whitespace, sparse columns, missing values, duplicates, types."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.functions import sketches
from tablecraft.functions.columns import (
    col,
    datetime_cols,
    is_floating,
    moment,
    number,
    numeric_cols,
    parse_moment,
    present,
    string_cols,
    strip,
)
from tablecraft.functions.statistics import column_stats, few_valued, quantiles, scalars, value_counts, value_summary
from tablecraft.settings import SETTINGS

DATE_PARTS = ("year", "month", "day", "dayofweek", "hour")
UNKNOWN = "Unknown"
INT_RANGES = (("tinyint", -(2**7), 2**7 - 1), ("smallint", -(2**15), 2**15 - 1), ("int", -(2**31), 2**31 - 1))
TYPE_NAMES = {"bigint": "int64", "tinyint": "int8", "smallint": "int16", "int": "int32", "double": "float64", "float": "float32"}


def null_census(df: DataFrame) -> DataFrame:
    """(column, position, n_rows, nulls) from one aggregate."""
    return column_stats(
        df,
        df.columns,
        {"n_rows": lambda x: F.count(F.lit(1)), "nulls": F.count_if},
        lambda d, c: present(d, c).isNull(),
    )


def empty_columns(df: DataFrame) -> list[str]:
    return [r["column"] for r in null_census(df).where("nulls = n_rows AND n_rows > 0").collect()]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*empty_columns(df))


def row_is_empty(df: DataFrame) -> Column:
    return reduce(and_, [present(df, c).isNull() for c in df.columns])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.where(~row_is_empty(df))


def detect_date_columns(df: DataFrame, ratio: float = SETTINGS.date_detect_ratio) -> list[str]:
    """Date and timestamp columns, and text columns most of whose values parse as dates."""
    typed, text = datetime_cols(df), string_cols(df)
    shares = scalars(
        df, text, {"n": F.count, "ok": lambda x: F.count(parse_moment(x))}, lambda d, c: col(c)
    )
    found = {c for c in text if shares[c]["n"] and shares[c]["ok"] / shares[c]["n"] > ratio}
    return [c for c in df.columns if c in typed or c in found]


def date_part(ts: Column, part: str) -> Column:
    """A calendar part; Monday is day 0."""
    return {
        "year": F.year,
        "month": F.month,
        "day": F.dayofmonth,
        "dayofweek": F.weekday,
        "dow": F.weekday,
        "hour": F.hour,
    }[part](ts)


def expand_dates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Replace date columns by year, month, day, dayofweek and hour integers (0 when missing)."""
    columns = detect_date_columns(df) if columns is None else columns
    parts = [
        F.coalesce(date_part(moment(df, c), p).cast("bigint"), F.lit(0)).alias(f"{c}_{p}")
        for c in columns
        for p in DATE_PARTS
    ]
    return df.select(*[col(c) for c in df.columns if c not in columns], *parts)


def strip_whitespace(df: DataFrame) -> DataFrame:
    text = set(string_cols(df))
    return df.select(*[strip(col(c)).alias(c) if c in text else col(c) for c in df.columns])


def sparse_columns(df: DataFrame, threshold: float = SETTINGS.null_drop_threshold) -> list[str]:
    rows = null_census(df).collect()
    return [r["column"] for r in rows if r["n_rows"] and r["nulls"] / r["n_rows"] > threshold]


def drop_high_null(df: DataFrame, threshold: float = SETTINGS.null_drop_threshold) -> DataFrame:
    return df.drop(*sparse_columns(df, threshold))


def _with_gaps(df: DataFrame, columns: list[str]) -> list[str]:
    gaps = scalars(df, columns, {"gaps": F.count_if}, lambda d, c: present(d, c).isNull())
    return [c for c in columns if gaps[c]["gaps"]]


def _fill(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """Integer columns become double when filled: a median may fall between two integers."""
    return df.select(*[_filled(df, c, fills[c]).alias(c) if c in fills else col(c) for c in df.columns])


def _filled(df: DataFrame, name: str, value) -> Column:
    if isinstance(value, str):
        return F.coalesce(col(name), F.lit(value))
    return F.coalesce(number(df, name), F.lit(float(value)))


def median_fills(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> dict[str, float]:
    """Exact medians, or with `approx` those of mergeable states: one pass of bounded size, a value whose rank is near the middle."""
    columns = _with_gaps(df, numeric_cols(df)) if columns is None else columns
    if approx and columns:
        found = sketches.quantile_estimates(sketches.states(df, columns), [0.5]).collect()  # a row for each column
        return {r["column"]: r["estimate"] for r in found if r["estimate"] is not None}
    medians = quantiles(df, columns, [0.5]) if columns else {}
    return {c: m[0] for c, m in medians.items() if m is not None}


def fill_median(df: DataFrame, approx: bool = False) -> DataFrame:
    return _fill(df, median_fills(df, approx=approx))


def mode_fills(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """The most frequent text (smallest on ties) of each column with gaps; Unknown if it has no text at all."""
    columns = _with_gaps(df, string_cols(df)) if columns is None else columns
    if not columns:
        return {}
    modes = {r["column"]: r["mode"] for r in value_summary(value_counts(df, columns)).collect()}
    return {c: modes.get(c, UNKNOWN) for c in columns}


def fill_mode(df: DataFrame) -> DataFrame:
    return _fill(df, mode_fills(df))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row duplicates; copies collapse on the map side, so a hot row is shuffled once per task."""
    return df.dropDuplicates()


def _smallest_int(lo, hi) -> str | None:
    return next((t for t, a, b in INT_RANGES if a <= lo and hi <= b), None)


def _float_error(x: Column) -> Column:
    return F.max(F.abs(x - x.cast("float").cast("double")))


def downcast_plan(df: DataFrame) -> list[tuple[str, str, str]]:
    """(column, from, to) for every 64-bit number column that fits a narrower type."""
    ints = [f.name for f in df.schema if isinstance(f.dataType, T.LongType)]
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    spans = scalars(df, ints, {"lo": F.min, "hi": F.max}, lambda d, c: col(c))
    errors = scalars(df, floats, {"err": _float_error})
    plan = []
    for c in df.columns:
        if c in spans and spans[c]["lo"] is not None:
            to = _smallest_int(spans[c]["lo"], spans[c]["hi"])
            if to:
                plan.append((c, "bigint", to))
        elif c in errors and (errors[c]["err"] or 0.0) <= SETTINGS.float32_tolerance:
            plan.append((c, "double", "float"))
    return plan


def category_columns(df: DataFrame, threshold: int = SETTINGS.categorical_threshold) -> dict[str, int]:
    """Text columns with fewer distinct values than the threshold, with that number."""
    text = string_cols(df)
    if not text:
        return {}
    return few_valued(df, text, threshold)


# --- everything together -----------------------------------------------------------------------


@dataclass
class CleanPlan:
    """Fitted cleaning decisions; transform() is lazy and works on any table with the same columns."""

    columns: list[str]
    n_rows: int
    nulls_before: dict[str, int]
    empty: list[str]
    empty_rows: int
    dates: list[str]
    text: list[str]
    sparse: list[str]
    fills: dict[str, object]
    casts: dict[str, tuple[str, str]] = field(default_factory=dict)
    categories: list[str] = field(default_factory=list)
    threshold: float = SETTINGS.null_drop_threshold

    def transform(self, df: DataFrame, deduplicate: bool = True) -> DataFrame:
        kept = [c for c in self.columns if c not in self.empty]
        out = drop_empty_rows(df.select(*[col(c) for c in kept]))
        out = expand_dates(out, self.dates)
        out = strip_whitespace(out)
        out = _fill(out.drop(*self.sparse), self.fills)
        if deduplicate:
            out = drop_duplicates(out)
        if not self.casts and not self.categories:
            return out
        return out.select(
            *[
                (col(c).cast(self.casts[c][1]) if c in self.casts else col(c)).alias(
                    c, metadata={"categorical": True} if c in self.categories else {}
                )
                for c in out.columns
            ]
        )

    def actions(self) -> list[tuple[str, str]]:
        """(step, detail) in the order the steps are applied."""
        log = []
        if self.empty:
            log.append(("drop_empty_columns", ", ".join(self.empty)))
        if self.empty_rows:
            log.append(("drop_empty_rows", str(self.empty_rows)))
        log += [("expand_dates", c) for c in self.dates]
        if self.text:
            log.append(("strip_whitespace", ", ".join(self.text)))
        if self.sparse:
            log.append(("drop_high_null", ", ".join(self.sparse)))
        for c, v in self.fills.items():
            log.append(("fill_mode", f"{c} = {v}") if isinstance(v, str) else ("fill_median", f"{c} = {v:.2f}"))
        if self.casts or self.categories:
            kinds = [f"{c}: {TYPE_NAMES[a]} -> {TYPE_NAMES[b]}" for c, (a, b) in self.casts.items()]
            kinds += [f"{c}: text -> category" for c in self.categories]
            log.append(("narrow_types", ", ".join(kinds)))
        return log


@dataclass
class Cleaner:
    """fit() decides in at most four small aggregates: a census, then medians, modes and value ranges."""

    null_threshold: float = SETTINGS.null_drop_threshold
    narrow: bool = True
    narrow_floats: bool = False

    def fit(self, df: DataFrame) -> CleanPlan:
        text, numbers = string_cols(df), numeric_cols(df)
        row = df.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(row_is_empty(df)).alias("empty_rows"),
            *[F.count(present(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)],
            *[F.count(parse_moment(col(c))).alias(f"d{i}") for i, c in enumerate(df.columns) if c in text],
            *[F.count(strip(col(c))).alias(f"s{i}") for i, c in enumerate(df.columns) if c in text],
        ).first()
        n, empty_rows = row["n"], row["empty_rows"]
        held = {c: row[f"n{i}"] for i, c in enumerate(df.columns)}
        parsed = {c: row[f"d{i}"] for i, c in enumerate(df.columns) if c in text}
        stripped = {c: row[f"s{i}"] for i, c in enumerate(df.columns) if c in text}
        empty = [c for c in df.columns if n and held[c] == 0]
        typed = datetime_cols(df)
        dates = [
            c
            for c in df.columns
            if c not in empty
            and (c in typed or (c in text and held[c] and parsed[c] / held[c] > SETTINGS.date_detect_ratio))
        ]
        left = n - empty_rows
        rest = [c for c in df.columns if c not in empty and c not in dates]
        gaps = {c: left - (stripped[c] if c in text else held[c]) for c in rest}
        sparse = [c for c in rest if left and gaps[c] / left > self.null_threshold]
        rest = [c for c in rest if c not in sparse]
        text = [c for c in rest if c in text]
        clean = strip_whitespace(df.select(*[col(c) for c in rest])) if rest else df
        fills: dict[str, object] = median_fills(clean, [c for c in rest if c in numbers and gaps[c]])
        counted, seen = [c for c in text if gaps[c]], {}
        if counted:
            seen = {r["column"]: r for r in value_summary(value_counts(clean, counted)).collect()}
        for c in text:
            if gaps[c]:
                fills[c] = seen[c]["mode"] if c in seen else UNKNOWN
        plan = CleanPlan(
            list(df.columns), n, {c: n - held[c] for c in df.columns}, empty, empty_rows, dates, text, sparse,
            {c: fills[c] for c in rest if c in fills}, threshold=self.null_threshold,
        )
        if self.narrow:
            few = few_valued(clean, [c for c in text if not gaps[c]], SETTINGS.categorical_threshold)
            few |= {c: seen[c]["n_unique"] if c in seen else 1 for c in counted}  # without any value, the filling is the only one
            plan.categories = [c for c in text if few.get(c, SETTINGS.categorical_threshold) < SETTINGS.categorical_threshold]
            plan.casts = self._casts(clean, plan, rest)
        return plan

    def _casts(self, clean: DataFrame, plan: CleanPlan, rest: list[str]) -> dict[str, tuple[str, str]]:
        kinds = {f.name: f.dataType for f in clean.schema}
        ints = [c for c in rest if isinstance(kinds[c], T.LongType) and c not in plan.fills]
        spans = scalars(clean, ints, {"lo": F.min, "hi": F.max}, lambda d, c: col(c))
        casts = {}
        for c in ints:
            to = spans[c]["lo"] is not None and _smallest_int(spans[c]["lo"], spans[c]["hi"])
            if to:
                casts[c] = ("bigint", to)
        if self.narrow_floats:
            doubles = [c for c in rest if is_floating(kinds[c]) or (c in plan.fills and c not in plan.text)]
            errors = scalars(_fill(clean, plan.fills), doubles, {"err": _float_error})
            casts |= {c: ("double", "float") for c in doubles if (errors[c]["err"] or 0.0) <= SETTINGS.float32_tolerance}
        for c in plan.dates:  # calendar parts always fit; years reach 5-digit values only beyond smallint
            casts |= {f"{c}_{p}": ("bigint", "smallint" if p == "year" else "tinyint") for p in DATE_PARTS}
        return casts


@dataclass
class CleanReport:
    plan: CleanPlan
    rows_after: int
    columns_after: list[str]
    nulls_after: dict[str, int]

    @property
    def duplicates_removed(self) -> int:
        return self.plan.n_rows - self.plan.empty_rows - self.rows_after


def clean(df: DataFrame, null_threshold: float = SETTINGS.null_drop_threshold, **options) -> tuple[DataFrame, CleanPlan]:
    plan = Cleaner(null_threshold, **options).fit(df)
    return plan.transform(df), plan


def report(plan: CleanPlan, cleaned: DataFrame) -> CleanReport:
    """Counts after cleaning: one aggregate over the cleaned table."""
    row = cleaned.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(present(cleaned, c).isNull()).alias(f"n{i}") for i, c in enumerate(cleaned.columns)],
    ).first()
    return CleanReport(plan, row["n"], cleaned.columns, {c: row[f"n{i}"] for i, c in enumerate(cleaned.columns)})
