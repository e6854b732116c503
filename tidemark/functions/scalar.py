"""Column expressions: every scalar rule of the engine, all JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Part of the metric definitions, so results agree across systems.
DEFAULT_BINS = 10
DEFAULT_EPSILON = 1e-6
MISSING_LEVEL = "__MISSING__"
MISSING_BUCKET = -1
STABLE_BELOW = 0.10
MAJOR_ABOVE = 0.20
VALUE_DRIFT_RESIDUAL = 0.05
UNKNOWN_CODE = -1.0
SECONDS_PER_DAY = 86_400
MAX_LEAKAGE_OVERLAP = 0.01
MIN_ROWS = 5_000
MIN_POSITIVES = 100
DEFAULT_MARGIN_SES = 1.0
LIVE_WITHIN_SECONDS = 120
SCORE_TOLERANCE = 0.01

DRIFT_RETRAIN_AND_PIPELINE = "RETRAIN + INVESTIGATE PIPELINE"
DRIFT_RETRAIN = "RETRAIN"
DRIFT_PIPELINE = "INVESTIGATE PIPELINE (no retrain)"
DRIFT_STABLE = "STABLE"

GATE_LEAKED = "NO VERDICT -- evaluation rows overlap the challenger's training window"
GATE_INSUFFICIENT = "NO PROMOTION -- insufficient data"
GATE_PROMOTE = "PROMOTE"
GATE_BEHIND = "NO PROMOTION -- challenger is not ahead"
GATE_NOISE = "no promotion, difference within noise"


# --- missing values -----------------------------------------------------------

def is_missing(column: Column, data_type: T.DataType) -> Column:
    """NULL, NaN or a blank string: the one notion of missing."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return column.isNull() | F.isnan(column)
    if isinstance(data_type, T.StringType):
        return column.isNull() | (F.trim(column) == "")
    return column.isNull()


def missing_as_null(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.StringType)):
        return F.when(~is_missing(column, data_type), column)
    return column


def to_number(column: Column) -> Column:
    """Numeric reading of any value; text that is no number becomes NULL."""
    number = column.try_cast("double")
    return F.when(~F.isnan(number), number)


# --- distribution shift -------------------------------------------------------

def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def psi_term(reference_share: Column, current_share: Column,
             epsilon: float = DEFAULT_EPSILON) -> Column:
    """One bucket's contribution; zero shares are floored, never dropped."""
    r = F.greatest(reference_share, F.lit(epsilon))
    c = F.greatest(current_share, F.lit(epsilon))
    return (c - r) * F.ln(c / r)


def psi_band(psi: Column) -> Column:
    return (
        F.when(psi.isNull() | F.isnan(psi), "unmeasurable")
        .when(psi < STABLE_BELOW, "stable")
        .when(psi <= MAJOR_ABOVE, "moderate")
        .otherwise("major")
    )


def right_closed_bin(value: Column, inner_edges: list[Column]) -> Column:
    """Bin index for bins ``(a, b]``; absent edges are NULL and count nothing.

    Written as a sum of comparisons, which stays inside generated code.
    """
    if not inner_edges:
        return F.when(value.isNull(), F.lit(MISSING_BUCKET)).otherwise(F.lit(0))
    above = reduce(
        lambda a, b: a + b,
        [F.when(value > edge, 1).otherwise(0) for edge in inner_edges],
    )
    return F.when(value.isNull(), F.lit(MISSING_BUCKET)).otherwise(above)


def significant4(value: Column) -> Column:
    """Four significant digits in the style of C's ``%.4g``."""
    sci = F.format_string("%.3e", value)
    exponent = F.regexp_extract(sci, r"e([+-]\d+)$", 1).try_cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(sci, r"^(.*)e", 1), r"\.?0+$", "")
    fixed = F.when(exponent == 3, F.format_string("%.0f", value))
    for power in range(2, -5, -1):
        text = F.format_string(f"%.{3 - power}f", value)
        fixed = fixed.when(exponent == power, F.regexp_replace(text, r"\.?0+$", ""))
    scientific = F.concat(mantissa, F.regexp_extract(sci, r"(e[+-]\d+)$", 1))
    return (
        F.when(value.isNull(), None)
        .when(value == float("inf"), "inf")
        .when(value == float("-inf"), "-inf")
        .when(value == 0, "0")
        .when(exponent.between(-4, 3), fixed)
        .otherwise(scientific)
    )


def bin_label(low: Column, high: Column) -> Column:
    return F.concat(F.lit("("), significant4(low), F.lit(", "), significant4(high), F.lit("]"))


# --- decisions and verdicts ---------------------------------------------------

def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def mean_probability(*members: Column) -> Column:
    return reduce(lambda a, b: a + b, members) / F.lit(float(len(members)))


def decision(probability: Column, threshold: Column) -> Column:
    return F.when(probability >= threshold, "BLOCK").otherwise("ALLOW")


def direction(contribution: Column) -> Column:
    return F.when(contribution > 0, "toward fraud").otherwise("toward legitimate")


def drift_verdict(retrain: Column, pipeline: Column) -> Column:
    return (
        F.when(retrain & pipeline, DRIFT_RETRAIN_AND_PIPELINE)
        .when(retrain, DRIFT_RETRAIN)
        .when(pipeline, DRIFT_PIPELINE)
        .otherwise(DRIFT_STABLE)
    )


def leaked(overlap: Column) -> Column:
    """Unknown overlap is not leakage, but it is not a clean bill either."""
    return F.coalesce(overlap > MAX_LEAKAGE_OVERLAP, F.lit(False))


def margin_in_ses(delta: Column, standard_error: Column) -> Column:
    se = F.when(~F.isnan(standard_error) & (standard_error > 0), standard_error)
    return F.coalesce(F.try_divide(F.abs(delta), se), F.lit(0.0))


def gate_verdict(is_leaked: Column, sufficient: Column, delta: Column,
                 margin: Column, required: float = DEFAULT_MARGIN_SES) -> Column:
    """Leakage first, then evidence, then sign, then noise."""
    return (
        F.when(is_leaked, GATE_LEAKED)
        .when(~sufficient, GATE_INSUFFICIENT)
        .when((delta > 0) & (margin >= required), GATE_PROMOTE)
        .when(delta <= 0, GATE_BEHIND)
        .otherwise(GATE_NOISE)
    )


def verdict_outcome(verdict: Column) -> Column:
    text = F.lower(F.coalesce(verdict, F.lit("")))
    return (
        F.when(text.contains("rolled back"), "rolled back")
        .when(text.startswith("promote"), "promoted")
        .when(text.contains("no verdict"), "refused")
        .otherwise("rejected")
    )


def match_flag(score: Column, expected: Column, tolerance: float = SCORE_TOLERANCE) -> Column:
    # differences of decimal scores carry binary noise, which must not decide at the tolerance
    return F.when(F.round(F.abs(score - expected), 9) <= tolerance, "MATCH").otherwise("DIVERGED")


def implied_positives(rows: Column, rate_pct: Column) -> Column:
    return F.round(rows * rate_pct / 100.0).cast("bigint")


# --- text and time ------------------------------------------------------------

def render_number(value: Column) -> Column:
    """Thousands separators, at most four decimals, tiny values scientific."""
    number = value.cast("double")
    whole = (F.abs(number) < 1e15) & (number == F.floor(number))
    decimals = F.regexp_replace(F.format_number(number, 4), r"\.?0+$", "")
    return (
        F.when(number.isNull(), None)
        .when(F.isnan(number), "nan")
        .when(number == float("inf"), "inf")
        .when(number == float("-inf"), "-inf")
        .when(whole, F.format_number(number, 0))
        .when(F.abs(number) >= 1e-3, decimals)
        .otherwise(F.format_string("%.3e", number))
    )


def iso_utc(moment: Column) -> Column:
    """ISO-8601 text to the second; the session clock is pinned to UTC."""
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def utc_now() -> Column:
    return iso_utc(F.current_timestamp())


def parse_iso(text: Column) -> Column:
    return F.try_to_timestamp(text)


def parse_json_list(text: Column, element: str) -> Column:
    """Typed list out of JSON text; unreadable text gives an empty list."""
    schema = f"array<{element}>"
    return F.coalesce(F.from_json(text, schema), F.array().cast(schema))


def to_json_text(value: Column) -> Column:
    return F.to_json(value)


def pick_features(entries: Column, kind: str, limit: int = 20) -> Column:
    """Names of the entries of one kind, the first ``limit`` joined by commas."""
    names = F.transform(
        F.filter(entries, lambda e: e["type"] == kind), lambda e: e["feature"]
    )
    joined = F.array_join(F.slice(names, 1, limit), ",")
    return F.when(joined == "", "(none recorded)").otherwise(joined)


def examples_text(values: Column, limit: int = 3) -> Column:
    """``value (n), value (n)`` for the first few ranked values."""
    return F.array_join(
        F.transform(
            F.slice(values, 1, limit),
            lambda v: F.concat(v["value"], F.lit(" ("), v["n"].cast("string"), F.lit(")")),
        ),
        ", ",
    )


def day_offset(moment: Column, origin: float | Column) -> Column:
    start = F.lit(origin) if isinstance(origin, (int, float)) else origin
    return (moment - start) / F.lit(float(SECONDS_PER_DAY))


def overlap_fraction(judged_low: Column, judged_high: Column,
                     trained_low: Column, trained_high: Column) -> Column:
    """Share of the judged time range inside the trained range; NULL if unknown."""
    span = judged_high - judged_low
    covered = F.least(judged_high, trained_high) - F.greatest(judged_low, trained_low)
    inside = (trained_low <= judged_low) & (judged_low <= trained_high)
    known = judged_low.isNotNull() & trained_low.isNotNull() & trained_high.isNotNull()
    return F.when(
        known,
        F.when(span <= 0, F.when(inside, 1.0).otherwise(0.0)).otherwise(
            F.greatest(F.lit(0.0), covered) / span
        ),
    )


def epoch_seconds(moment: Column) -> Column:
    """Seconds since 1970 as a double, for TIMESTAMP and TIMESTAMP_NTZ alike."""
    return F.unix_micros(moment.cast("timestamp")) / F.lit(1e6)
