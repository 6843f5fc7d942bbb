"""A cleaning plan as data, and its execution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tabulens.functions.nulls import is_numeric, nan_to_null
from tabulens.operators import clean
from tabulens.operators.profile import missing_counts
from tabulens.operators.schema import numeric_columns
from tabulens.session import materialized

# What a plan may say.
STRATEGIES = ("median", "mean", "mode", "constant", "drop", "leave")
NUMERIC_STRATEGIES = ("median", "mean", "leave")
CATEGORICAL_STRATEGIES = ("mode", "constant", "unknown", "leave")
OUTLIER_STRATEGIES = ("clip", "drop", "leave")
OUTLIER_METHODS = ("iqr", "zscore")
TYPES = ("int", "float", "datetime", "category", "string")
TEXT_STEPS = ("lowercase", "remove_punct", "strip", "lemmatize", "remove_numbers")


def _section(plan: Mapping, name: str) -> Mapping:
    found = plan.get(name, {})
    return found if isinstance(found, Mapping) else {}


def _choice(section: Mapping, key: str, allowed: Sequence[str], default: str | None) -> str | None:
    value = section.get(key, "")
    value = value.lower() if isinstance(value, str) else ""
    return value if value in allowed else default


@dataclass(frozen=True)
class CleaningPlan:
    """Values outside the allowed sets fall back to doing nothing; unknown columns are ignored.

    ``compat`` keeps two surprises of earlier plan files: without explicit sub-strategies numbers take
    the median and text takes "Unknown" whatever ``strategy`` says, and ``strategy="drop"`` fills
    instead of dropping rows. By default the sub-strategy wins where given, then ``strategy``.
    """

    remove_duplicates: bool = False
    strategy: str = "leave"
    numeric_strategy: str | None = None
    categorical_strategy: str | None = None
    constant_values: Mapping[str, object] = field(default_factory=dict)
    outlier_strategy: str = "leave"
    outlier_method: str = "iqr"
    zscore_threshold: float = 3.0
    date_columns: tuple[str, ...] = ()
    manual_types: Mapping[str, str] = field(default_factory=dict)
    text_columns: tuple[str, ...] = ()
    text_steps: tuple[str, ...] = ()
    notes: str = ""
    compat: bool = False

    @classmethod
    def from_dict(cls, plan: Mapping, columns: Sequence[str], compat: bool = False) -> CleaningPlan:
        missing, outliers = _section(plan, "missing_values"), _section(plan, "outliers")
        types, text = _section(plan, "convert_types"), _section(plan, "text_cleaning")
        known = set(columns)
        threshold = outliers.get("zscore_threshold")
        is_number = isinstance(threshold, (int, float)) and not isinstance(threshold, bool)
        listed = lambda section, key: [c for c in section.get(key, []) if isinstance(section.get(key), list)]
        constants, manual = missing.get("constant_values", {}), types.get("manual", {})
        return cls(
            remove_duplicates=bool(plan.get("remove_duplicates", False)),
            strategy=_choice(missing, "strategy", STRATEGIES, "leave"),
            numeric_strategy=_choice(missing, "numeric_strategy", NUMERIC_STRATEGIES, "median" if compat else None),
            categorical_strategy=_choice(
                missing, "categorical_strategy", CATEGORICAL_STRATEGIES, "unknown" if compat else None
            ),
            constant_values=dict(constants) if isinstance(constants, Mapping) else {},
            outlier_strategy=_choice(outliers, "strategy", OUTLIER_STRATEGIES, "leave"),
            outlier_method=_choice(outliers, "method", OUTLIER_METHODS, "iqr"),
            zscore_threshold=float(threshold) if is_number else 3.0,
            date_columns=tuple(c for c in listed(types, "date_columns") if c in known),
            manual_types={
                c: t for c, t in (manual.items() if isinstance(manual, Mapping) else []) if c in known and t in TYPES
            },
            text_columns=tuple(c for c in listed(text, "columns") if c in known),
            text_steps=tuple(s for s in listed(text, "steps") if s in TEXT_STEPS),
            notes=str(plan.get("notes", "")),
            compat=compat,
        )

    def numeric_fill(self) -> str:
        """``median``, ``mean`` or ``leave``."""
        if self.strategy == "leave":
            return "leave"
        asked = (self.numeric_strategy, self.strategy)
        if self.compat:
            return next((s for s in ("median", "mean") if s in asked), "leave")
        if self.numeric_strategy:
            return self.numeric_strategy
        return self.strategy if self.strategy in ("median", "mean") else "median"

    def categorical_fill(self) -> str:
        """``mode``, ``constant``, ``unknown`` or ``leave``."""
        if self.strategy == "leave":
            return "leave"
        asked = (self.categorical_strategy, self.strategy)
        if self.compat:
            return next((s for s in ("mode", "constant", "unknown") if s in asked), "leave")
        if self.categorical_strategy:
            return self.categorical_strategy
        return self.strategy if self.strategy in ("mode", "constant") else "unknown"

    def drops_missing(self) -> bool:
        return self.strategy == "drop" and not self.compat


REPORT_SCHEMA = "step string, column string, action string, affected long, detail string"


def apply_plan(df: DataFrame, plan: CleaningPlan) -> tuple[DataFrame, DataFrame]:
    """Duplicates, missing values, outliers, text, types, in that order; returns the table and a report.

    Only counts and one value per column reach the driver. Where later steps read statistics, the table
    without duplicates is written to the shared folder first: the full-row shuffle runs once, and each
    statistic reads only its own columns.
    """
    spark = df.sparkSession
    rows: list[tuple] = []
    out = nan_to_null(df)

    if plan.remove_duplicates:
        unique = clean.dedupe(out)
        if plan.strategy != "leave" or plan.outlier_strategy != "leave":
            unique = materialized(unique, "deduped")
        removed = out.count() - unique.count()
        out = unique if removed else out
        rows.append(("duplicates", None, "removed" if removed else "none_found", removed, None))

    out, filled = _handle_missing(out, plan)
    rows += filled
    out, handled = _handle_outliers(out, plan)
    rows += handled

    if plan.text_columns and plan.text_steps:
        # There is no lemmatiser: the report names the steps that ran.
        steps = list(dict.fromkeys("remove_stopwords" if s == "lemmatize" else s for s in plan.text_steps))
        out = clean.clean_text(out, plan.text_columns, steps, null_as="None" if plan.compat else None)
        rows += [("text", c, "cleaned", None, ",".join(steps)) for c in plan.text_columns]

    types = {**{c: "datetime" for c in plan.date_columns}, **plan.manual_types}
    if types:
        out = clean.convert(out, types)
        rows += [("types", c, "converted", None, t) for c, t in types.items()]
    return out, spark.createDataFrame(rows, REPORT_SCHEMA)


def _handle_missing(df: DataFrame, plan: CleaningPlan) -> tuple[DataFrame, list[tuple]]:
    if plan.strategy == "leave":
        return df, [("missing", None, "left", None, None)]
    gaps = {r["column"]: r["num_missing"] for r in missing_counts(df).collect() if r["num_missing"]}
    if plan.drops_missing():
        return df.na.drop("any"), [("missing", c, "dropped_rows", n, None) for c, n in gaps.items()]
    numeric = [f.name for f in df.schema if f.name in gaps and is_numeric(f.dataType)]
    other = [c for c in df.columns if c in gaps and c not in numeric]
    rows, fills = [], {}
    for cols, how in ((numeric, plan.numeric_fill()), (other, plan.categorical_fill())):
        if how == "leave":
            rows += [("missing", c, "left", gaps[c], None) for c in cols]
            continue
        if how == "constant":
            found = {c: plan.constant_values.get(c, clean.UNKNOWN) for c in cols}
        else:
            found = clean.fill_values(df, cols, how)
        fills.update(found)
        rows += [("missing", c, f"filled_{how}", gaps[c], str(found[c])) for c in cols]
    return clean.fill_with(df, fills), rows


def _handle_outliers(df: DataFrame, plan: CleaningPlan) -> tuple[DataFrame, list[tuple]]:
    if plan.outlier_strategy == "leave":
        return df, [("outliers", None, "left", None, None)]
    cols = numeric_columns(df)
    if not cols:
        return df, []
    args = (plan.outlier_method, plan.zscore_threshold)
    rows = []
    if plan.outlier_strategy == "clip":
        found = [r for r in clean.outlier_counts(df, cols, *args).collect() if r["num_outliers"]]
        rows = [("outliers", r["column"], "clipped", r["num_outliers"], plan.outlier_method) for r in found]
        return clean.clip_to(df, {r["column"]: (r["lower"], r["upper"]) for r in found}), rows
    out = df
    for c in cols:
        found = clean.outlier_counts(out, [c], *args).first()
        if found["num_outliers"]:
            out = clean.keep_within(out, {c: (found["lower"], found["upper"])})
            rows.append(("outliers", c, "dropped_rows", found["num_outliers"], plan.outlier_method))
    return out, rows
