"""Validation rules and quality scores: findings are rows ``(check, column, severity, value)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions import schema as roles
from .quantiles import quantiles
from .stats import COLUMNS_PER_JOB, distinct_table, null_count, numeric_summary, single_row

FINDING = "check string, column string, severity string, value double"


def _finding(check: str, column: str | Column, severity: str, value: Column) -> Column:
    name = F.lit(column) if isinstance(column, str) or column is None else column
    return F.struct(
        F.lit(check).alias("check"), name.cast("string").alias("column"),
        F.lit(severity).alias("severity"), value.cast("double").alias("value"),
    )


def _share(n: Column, rows: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), rows), F.lit(0.0))


def _per_column(df: DataFrame, columns: Sequence[str], measure) -> DataFrame:
    """``(column, rows, n)``, one aggregate per ``COLUMNS_PER_JOB`` columns."""
    out = None
    for start in range(0, len(columns), COLUMNS_PER_JOB):
        some = columns[start : start + COLUMNS_PER_JOB]
        wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[measure(c).alias(f"_m{i}") for i, c in enumerate(some)])
        cells = [
            F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"_m{i}").alias("n")) for i, c in enumerate(some)
        ]
        part = wide.select(F.inline(F.array(*cells)))
        out = part if out is None else out.unionByName(part)
    return out


def _structure_findings(df: DataFrame) -> list[Column]:
    """Findings over ``_rows`` and the column names; null where a rule does not apply."""
    unnamed = [c for c in df.columns if c.startswith("Unnamed:")]
    repeated = sorted({c for c in df.columns if df.columns.count(c) > 1})
    rows = F.col("_rows")
    rules = [
        (rows == 0, _finding("empty", None, "error", rows)),
        ((rows > 0) & (rows < 2), _finding("very_few_rows", None, "warning", rows)),
        ((rows >= 2) & (rows < 10), _finding("few_rows", None, "warning", rows)),
        ((rows > 0) & F.lit(len(df.columns) < 2), _finding("few_columns", None, "warning", F.lit(len(df.columns)))),
        ((rows > 0) & F.lit(bool(unnamed)), _finding("unnamed_columns", None, "warning", F.lit(len(unnamed)))),
        *[((rows > 0), _finding("duplicate_column_name", c, "warning", F.lit(df.columns.count(c)))) for c in repeated],
    ]
    return [F.when(cond, f) for cond, f in rules]


def check_structure(df: DataFrame) -> DataFrame:
    """Empty (error); fewer than 2 or 10 rows; one column; unnamed or repeated column names."""
    fired = F.filter(F.array(*_structure_findings(df)), lambda x: x.isNotNull())
    return df.select(F.lit(1)).agg(F.count(F.lit(1)).alias("_rows")).select(F.inline(fired))


def looks_numeric(c: Column) -> Column:
    return F.regexp_replace(c, "[,$%]", "").rlike(patterns.NUMBER)


def looks_like_date(c: Column) -> Column:
    hit = F.lit(False)
    for p in patterns.DATES:
        hit = hit | c.rlike(p)
    return hit


def _kind_parts(v: Column, i: int) -> tuple[list[Column], Column, Column, Column, Column]:
    """Aggregates of one text column (its non-null count is ``n{i}``), and from them the shares, kind and mixed flag."""
    aggregates = [
        F.sum(looks_numeric(v).cast("bigint")).alias(f"num{i}"), F.sum(looks_like_date(v).cast("bigint")).alias(f"dat{i}")
    ]
    number, date = _share(F.col(f"num{i}"), F.col(f"n{i}")), _share(F.col(f"dat{i}"), F.col(f"n{i}"))
    kind = F.when(number > 0.8, "numeric").when(date > 0.8, "datetime").otherwise("text")
    words = (F.lit(1.0) - number - date > 1e-12) & (F.col(f"n{i}") > 0)
    several = (number > 0).cast("int") + (date > 0).cast("int") + words.cast("int")
    return aggregates, number, date, kind, several > 1


def infer_text_kind(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per text column the shares of numeric-like and date-like values and the resulting kind.

    ``mixed`` marks a column whose values are of more than one kind.
    """
    columns = list(columns or roles.text_columns(df))
    aggregates, cells = [], []
    for i, c in enumerate(columns):
        more, number, date, kind, mixed = _kind_parts(F.col(c), i)
        aggregates += [F.count(c).alias(f"n{i}"), *more]
        cells.append(
            F.struct(
                F.lit(c).alias("column"), number.alias("numeric_share"), date.alias("date_share"), kind.alias("kind"), mixed.alias("mixed")
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*cells)))


def missing_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(column, missing_ratio)`` above the threshold."""
    shares = _per_column(df, df.columns, null_count).select("column", _share(F.col("n"), F.col("rows")).alias("missing_ratio"))
    return shares.filter(F.col("missing_ratio") > threshold)


_ROUGH = 0.05  # standard error of the sketch that looks for likely identifiers
_SURE = 0.7  # six of those errors below the share that is looked for


def distinct_per_column(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    found = distinct_table(df, {c: F.col(c) for c in columns or df.columns}, approx)
    return found.select(F.col("name").alias("column"), "rows", F.col("distinct").alias("n"))


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct value: their smallest and largest value agree, so nothing is shuffled."""
    same = lambda c: F.coalesce((F.min(c) == F.max(c)), F.lit(True)).cast("bigint")
    return _per_column(df, df.columns, same).filter(F.col("n") == 1).select("column")


def high_cardinality_columns(df: DataFrame, threshold: float = 0.95, approx: bool = False) -> DataFrame:
    """``(column, distinct_ratio)`` above the threshold.

    A sketch first rules out the columns far below it; only the others are counted exactly.
    """
    rough = distinct_per_column(df, approx=True).collect()
    likely = [r["column"] for r in rough if r["rows"] and r["n"] / r["rows"] > threshold * 0.8]
    if not likely:
        likely = df.columns[:1]
    shares = distinct_per_column(df, likely, approx).select("column", _share(F.col("n"), F.col("rows")).alias("distinct_ratio"))
    return shares.filter(F.col("distinct_ratio") > threshold)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first copy; equal nulls are equal. Copies merge before the shuffle."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"))


def detect_sensitive_columns(df: DataFrame) -> DataFrame:
    """``(column, reason, confidence)``; the first rule that holds wins.

    Names decide first. One pass then matches patterns and sketches distinct
    values; exact distinct counts are taken only where an identifier is likely,
    so long texts are never shuffled.
    """
    texts = set(roles.text_columns(df))
    named = [c for c in df.columns if any(k in c.lower() for k in patterns.SENSITIVE_NAMES)]
    measured = [c for c in df.columns if c in texts and c not in named]
    exprs: dict[str, Column] = {"rows": F.count(F.lit(1))}
    for i, c in enumerate(measured):
        v = F.col(c)
        exprs[f"n{i}"] = F.count(v)
        exprs[f"e{i}"] = F.count_if(v.rlike(patterns.EMAIL))
        exprs[f"p{i}"] = F.count_if(v.rlike(patterns.PHONE))
        exprs[f"a{i}"] = F.min(F.regexp_replace(v, "[-_]", "").rlike(patterns.ALPHANUMERIC))
        exprs[f"d{i}"] = F.approx_count_distinct(F.xxhash64(v), _ROUGH)
    seen = single_row(df, exprs)

    def cell(column: str, reason: str, confidence: str) -> Column:
        return F.struct(F.lit(column).alias("column"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"))

    cells, likely = [cell(c, "sensitive_keyword_in_name", "high") for c in named], []
    for i, c in enumerate(measured):
        half = seen[f"n{i}"] * 0.5
        if seen[f"e{i}"] > half:
            cells.append(cell(c, "email_pattern", "high"))
        elif seen[f"p{i}"] > half:
            cells.append(cell(c, "phone_pattern", "high"))
        elif seen[f"a{i}"] and seen[f"d{i}"] > seen["rows"] * 0.9 * _SURE:
            likely.append(c)
    if likely:
        for r in distinct_table(df, {c: F.col(c) for c in likely}).collect():  # one row per column
            if r["distinct"] > r["rows"] * 0.9:
                cells.append(cell(r["name"], "potential_identifier", "medium"))
    empty = F.lit(None).cast("struct<column:string,reason:string,confidence:string>")
    return df.sparkSession.range(1).select(F.inline(F.filter(F.array(empty, *cells), lambda x: x.isNotNull())))


def zscore_outliers(df: DataFrame, threshold: float = 3.0, share: float = 0.05, minimum: int = 10) -> DataFrame:
    """``(column, outliers, rows, reported)``: |z| above the threshold by the sample deviation."""
    numbers = roles.numeric_columns(df)
    s = numeric_summary(df, numbers, ("mean", "std"))

    def outside(c: str) -> Column:
        mean, std = s[c]["mean"], s[c]["std"]
        if not std:
            return F.lit(0).cast("bigint")
        return F.count_if(F.abs((F.col(c).cast("double") - F.lit(mean)) / F.lit(std)) > threshold)

    wide = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(numbers)], *[outside(c).alias(f"o{i}") for i, c in enumerate(numbers)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"o{i}").alias("outliers"), F.col(f"n{i}").alias("rows")) for i, c in enumerate(numbers)]
    rows = wide.select(F.inline(F.array(*cells))).filter(F.col("rows") >= minimum)
    return rows.withColumn("reported", F.col("outliers") > F.col("rows") * share)


def _corrected(g: Column, n: Column) -> Column:
    """Population skewness with the small-sample correction; undefined below three values."""
    return F.nanvl(F.coalesce(g, F.lit(0.0)), F.lit(0.0)) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)


def skewness(df: DataFrame, threshold: float = 2.0, minimum: int = 10) -> DataFrame:
    """``(column, skewness, reported)`` with the small-sample correction."""
    numbers = roles.numeric_columns(df)
    wide = df.agg(*[F.skewness(F.col(c).cast("double")).alias(f"g{i}") for i, c in enumerate(numbers)], *[F.count(c).alias(f"n{i}") for i, c in enumerate(numbers)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"g{i}").alias("g"), F.col(f"n{i}").cast("double").alias("n")) for i, c in enumerate(numbers)]
    n, corrected = F.col("n"), _corrected(F.col("g"), F.col("n"))
    rows = wide.select(F.inline(F.array(*cells))).filter(n >= minimum)
    return rows.select("column", corrected.alias("skewness")).withColumn("reported", F.abs("skewness") > threshold)


def validate_schema(df: DataFrame, rules: dict) -> DataFrame:
    """Required columns, column types, min / max / allowed values, as findings with violation counts.

    A null violates only ``allowed_values``.
    """
    static, measured = [], []
    kinds = {f.name: roles.role_name(f.dataType) for f in df.schema}
    for c in sorted(set(rules.get("required_columns", [])) - set(df.columns)):
        static.append(("missing_required", c, "error"))
    for c, expected in rules.get("column_types", {}).items():
        if c in kinds and expected.lower() not in patterns.TYPE_NAMES[kinds[c]]:
            static.append(("type_mismatch", c, "warning"))
    for c, limits in rules.get("constraints", {}).items():
        if c not in df.columns:
            continue
        if "min_value" in limits:
            measured.append(("below_minimum", c, F.count_if(F.col(c) < F.lit(limits["min_value"]))))
        if "max_value" in limits:
            measured.append(("above_maximum", c, F.count_if(F.col(c) > F.lit(limits["max_value"]))))
        if "allowed_values" in limits:
            allowed = F.coalesce(F.col(c).isin(list(limits["allowed_values"])), F.lit(False))
            measured.append(("not_allowed", c, F.count_if(~allowed)))
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[e.alias(f"v{i}") for i, (_, _, e) in enumerate(measured)])
    cells = [_finding(check, c, severity, F.lit(1)) for check, c, severity in static]
    cells += [F.when(F.col(f"v{i}") > 0, _finding(check, c, "error", F.col(f"v{i}"))) for i, (check, c, _) in enumerate(measured)]
    empty = F.lit(None).cast("struct<check:string,column:string,severity:string,value:double>")
    return wide.select(F.inline(F.filter(F.array(empty, *cells), lambda x: x.isNotNull())))


def violating_rows(df: DataFrame, column: str, limits: dict) -> DataFrame:
    """The rows that break a column's constraint."""
    bad = F.lit(False)
    if "min_value" in limits:
        bad = bad | F.coalesce(F.col(column) < F.lit(limits["min_value"]), F.lit(False))
    if "max_value" in limits:
        bad = bad | F.coalesce(F.col(column) > F.lit(limits["max_value"]), F.lit(False))
    if "allowed_values" in limits:
        bad = bad | ~F.coalesce(F.col(column).isin(list(limits["allowed_values"])), F.lit(False))
    return df.filter(bad)


def _single_pass_findings(df: DataFrame, missing_share: float = 0.5, skew: float = 2.0, minimum: int = 10) -> DataFrame:
    """Structure, missing values, constants, text kinds and skewness from one aggregate over the table."""
    texts, numbers = roles.text_columns(df), roles.numeric_columns(df)
    aggregates, cells = [F.count(F.lit(1)).alias("_rows")], _structure_findings(df)
    for i, c in enumerate(df.columns):
        v = F.col(c)
        aggregates += [F.count(v).alias(f"n{i}"), F.coalesce(F.min(v) == F.max(v), F.lit(True)).alias(f"same{i}")]
        missing = _share(F.col("_rows") - F.col(f"n{i}"), F.col("_rows"))
        cells.append(F.when(missing > missing_share, _finding("missing_values", c, "warning", missing)))
        cells.append(F.when(F.col(f"same{i}"), _finding("constant", c, "warning", F.lit(1))))
        if c in texts:
            more, number, date, kind, mixed = _kind_parts(v, i)
            aggregates += more
            cells.append(F.when(mixed, _finding("mixed_types", c, "warning", F.lit(1))))
            for name, share in (("numeric", number), ("datetime", date)):
                cells.append(F.when(kind == name, _finding(f"might_be_{name}", c, "warning", share)))
        elif c in numbers:
            aggregates.append(F.skewness(v.cast("double")).alias(f"g{i}"))
            skewed = _corrected(F.col(f"g{i}"), F.col(f"n{i}").cast("double"))
            cells.append(F.when((F.col(f"n{i}") >= minimum) & (F.abs(skewed) > skew), _finding("skewed", c, "warning", skewed)))
    empty = F.lit(None).cast("struct<check:string,column:string,severity:string,value:double>")
    return df.agg(*aggregates).select(F.inline(F.filter(F.array(empty, *cells), lambda x: x.isNotNull())))


def validate_dataset(df: DataFrame, rules: dict | None = None) -> DataFrame:
    """Every check as findings ``(check, column, severity, value)``; valid when no row is an error.

    What one aggregate can answer is answered in one pass; distinct values,
    duplicates and outliers take passes of their own.
    """
    warn = lambda d, check, value: d.select(
        F.lit(check).alias("check"), F.col("column"), F.lit("warning").alias("severity"), value.cast("double").alias("value")
    )
    copies = duplicate_rows(df).filter("duplicate_rows > 0").withColumn("column", F.lit(None).cast("string"))
    parts = [
        _single_pass_findings(df),
        warn(high_cardinality_columns(df), "high_cardinality", F.col("distinct_ratio")),
        warn(copies, "duplicate_rows", F.col("duplicate_rows")),
        detect_sensitive_columns(df).select(
            F.concat(F.lit("sensitive:"), F.col("reason")).alias("check"), "column",
            F.lit("warning").alias("severity"), F.when(F.col("confidence") == "high", 1.0).otherwise(0.5).alias("value"),
        ),
    ]
    if roles.numeric_columns(df):
        parts.append(warn(zscore_outliers(df).filter("reported"), "outliers", F.col("outliers")))
    if rules:
        parts.append(validate_schema(df, rules))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validation_recommendations(findings: DataFrame) -> DataFrame:
    """One row per piece of advice that the findings call for."""
    has = lambda pattern: F.max(F.col("check").rlike(pattern).cast("int")) == 1
    # Advice per kind of finding.
    rules = [
        (has("^missing_values$"), "Consider handling missing values using imputation or removal"),
        (has("^mixed_types$"), "Review and fix mixed data type columns"),
        (has("^outliers$"), "Investigate and handle outlier values"),
        (has("^sensitive:"), "Review sensitive data columns and apply appropriate anonymization"),
        (has("^duplicate"), "Remove duplicate rows to improve data quality"),
        (has("^high_cardinality$"), "Consider grouping or binning high cardinality columns"),
    ]
    flags = findings.agg(*[F.coalesce(cond, F.lit(False)).alias(f"r{i}") for i, (cond, _) in enumerate(rules)])
    fired = F.filter(F.array(*[F.when(F.col(f"r{i}"), F.lit(text)) for i, (_, text) in enumerate(rules)]), lambda m: m.isNotNull())
    fine = F.array(F.lit("Data validation passed - dataset appears ready for processing"))
    return flags.select(F.explode(F.when(F.size(fired) > 0, fired).otherwise(fine)).alias("recommendation"))


# ---- quality scores ----------------------------------------------------------------


def completeness_score(df: DataFrame) -> DataFrame:
    shares = _per_column(df, df.columns, null_count).select(_share(F.col("n"), F.col("rows")).alias("missing"))
    return shares.agg((F.lit(1.0) - F.avg("missing")).alias("completeness"))


def uniqueness_score(df: DataFrame) -> DataFrame:
    return duplicate_rows(df).select(
        "duplicate_rows", (F.lit(1.0) - _share(F.col("duplicate_rows"), F.col("rows"))).alias("uniqueness")
    )


def quality_by_column(df: DataFrame) -> DataFrame:
    """``(column, missing_ratio, uniqueness_ratio)``: shares of null cells and of distinct values among all rows."""
    missing = _per_column(df, df.columns, null_count).select("column", _share(F.col("n"), F.col("rows")).alias("missing_ratio"))
    distinct = distinct_per_column(df).select("column", _share(F.col("n"), F.col("rows")).alias("uniqueness_ratio"))
    return missing.join(distinct, "column")  # one row per column


def casing_issues(df: DataFrame) -> DataFrame:
    """Text columns with fewer distinct values after lowercasing."""
    texts = roles.text_columns(df)
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, distinct long, distinct_lower long")
    both = distinct_table(df, {c: F.col(c) for c in texts} | {f"{c} lowered": F.lower(c) for c in texts}).select(F.col("name"), F.col("distinct"))
    low = both.select(F.col("name").alias("_low"), F.col("distinct").alias("distinct_lower"))
    met = both.join(low, F.concat("name", F.lit(" lowered")) == F.col("_low"))  # one row per column
    return met.where((F.col("distinct") != F.col("distinct_lower")) & F.col("name").isin(texts)).select(F.col("name").alias("column"), "distinct", "distinct_lower")


def _issue_score(issues: DataFrame, columns: int, name: str) -> DataFrame:
    return issues.agg(F.greatest(F.lit(0.0), F.lit(1.0) - F.count(F.lit(1)) / F.lit(float(columns))).alias(name))


def casing_consistency(df: DataFrame) -> DataFrame:
    return _issue_score(casing_issues(df), len(df.columns), "consistency")


def iqr_outliers(df: DataFrame, share: float = 0.05, approx: bool = False) -> DataFrame:
    """``(column, outliers, rows, reported)``: values beyond 1.5 interquartile ranges from the quartiles."""
    numbers = roles.numeric_columns(df)
    quartiles = quantiles(df, numbers, [0.25, 0.75], approx)

    def outside(c: str) -> Column:
        q1, q3 = quartiles[c]
        if q1 is None:
            return F.lit(0).cast("bigint")
        reach = 1.5 * (q3 - q1)
        v = F.col(c).cast("double")
        return F.count_if((v < F.lit(q1 - reach)) | (v > F.lit(q3 + reach)))

    rows = _per_column(df, numbers, outside).withColumnRenamed("n", "outliers")
    return rows.select("column", "outliers", "rows", (F.col("outliers") > F.col("rows") * share).alias("reported"))


def quality_report(df: DataFrame, approx: bool = False) -> DataFrame:
    """The four scores and their mean in one row."""
    parts = {
        "completeness": completeness_score(df),
        "uniqueness": uniqueness_score(df),
        "consistency": casing_consistency(df),
        "validity": _issue_score(iqr_outliers(df, approx=approx).filter("reported"), len(df.columns), "validity"),
    }
    rows = None
    for name, p in parts.items():
        one = p.select(F.lit(name).alias("metric"), F.col(name).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    wide = rows.agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in parts])
    total = (F.col("completeness") + F.col("uniqueness") + F.col("consistency") + F.col("validity")) / F.lit(4.0)
    return wide.withColumn("overall_score", total)


def quality_recommendations(report: DataFrame) -> DataFrame:
    """Advice from a ``quality_report`` row."""
    # Advice per low score.
    rules = [
        (F.col("completeness") < 0.8, "Consider handling missing values before anonymization"),
        (F.col("uniqueness") < 1.0, "Remove duplicate rows"),
        (F.col("consistency") < 1.0, "Address data consistency issues"),
    ]
    fired = F.filter(F.array(*[F.when(cond, F.lit(text)) for cond, text in rules]), lambda m: m.isNotNull())
    fine = F.array(F.lit("Data quality looks good"))
    return report.select(F.explode(F.when(F.size(fired) > 0, fired).otherwise(fine)).alias("recommendation"))
