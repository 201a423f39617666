"""Confidence extraction from free text (T10-T15) as array/map expressions.

Scores come out as ``array<double>`` aligned to the label order; use
:func:`as_map` for a ``map<string,double>`` or explode to long form for metrics."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelforge.schema import LABELS


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# Variant A: any word followed by a number; later match of a label wins.
# Fixed value, as in pattern_b: equal scores need the very same pattern.
PATTERN_A = r"(?U)(\w+)\s*[:,\s]*([\d.]+)"
_DECIMAL_RE = r"^(?:\d+\.?\d*|\.\d+)$"
# Decimal digits beyond ASCII, which ``float`` reads as well, and their values.
_DIGITS = [chr(c) for c in range(128, 0x110000) if unicodedata.category(chr(c)) == "Nd"]
_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def pattern_b(labels: list[str] | None = None) -> str:
    """Variant B: label (no word boundary) then an optional number and ``%``."""
    alt = "|".join(labels or LABELS)
    return rf"(?U)({alt})\s*[:\s/]*\s*([\d.]+)?%?"


def _pairs(text: Column, pattern: str) -> Column:
    """``array<struct<k, v>>`` of (group 1, group 2) for every match; one regex
    pass per group, zipped without a per-element lambda."""
    keys = F.regexp_extract_all(text, F.lit(pattern), 1)
    vals = F.regexp_extract_all(text, F.lit(pattern), 2)
    return F.arrays_zip(keys.alias("k"), vals.alias("v"))


def _last_value(pairs: Column, label: str) -> Column:
    return F.try_element_at(F.filter(pairs, lambda p: p["k"] == F.lit(label)), F.lit(-1))["v"]


def _to_double(v: Column) -> Column:
    v = F.when(v.rlike(r"^[\x00-\x7F]*$"), v).otherwise(F.translate(v, "".join(_DIGITS), _VALUES))
    return F.when(v.rlike(_DECIMAL_RE), v.cast("double")).otherwise(F.lit(0.0))


def pairs_a(text) -> Column:
    return _pairs(_c(text), PATTERN_A)


def pairs_b(text, labels: list[str] | None = None) -> Column:
    return _pairs(_c(text), pattern_b(labels))


def scores_from_pairs_a(pairs, labels: list[str] | None = None) -> Column:
    labels = labels or LABELS
    return F.array(*[F.coalesce(_to_double(_last_value(_c(pairs), lab)), F.lit(0.0)) for lab in labels])


def confidences_a(text, labels: list[str] | None = None) -> Column:
    """``(\\w+)\\s*[:,\\s]*([\\d.]+)``; known labels only (case-sensitive);
    last match wins; ``.`` or an unparsable number gives 0.0; absent labels 0.0.
    Row scalar; on DataFrames prefer :func:`with_confidences` (regex runs once)."""
    return scores_from_pairs_a(pairs_a(text), labels)


def confidences_b(text, labels: list[str] | None = None, fallback: str = "one_hot") -> Column:
    """T11 + T12: label alternation without word boundary, value/100 always; a
    match without a number sets 0.0 (and overwrites). When every score is 0, the
    first label (label order) present as a whole word gets 1.0 (``one_hot``), or
    every label gets 1.0 (``uniform``, what the reference's code does)."""
    return scores_from_pairs_b(pairs_b(text, labels), text, labels, fallback)


def raw_scores_b(pairs, labels: list[str] | None = None) -> Column:
    labels = labels or LABELS
    scores = []
    for lab in labels:
        v = _last_value(_c(pairs), lab)
        scores.append(F.coalesce(F.when(v.isNull() | (v == ""), F.lit(0.0)).otherwise(_to_double(v) / 100.0), F.lit(0.0)))
    return F.array(*scores)


def first_word_index(text, labels: list[str] | None = None) -> Column:
    """0-based position (label order) of the first label present as a whole word."""
    labels = labels or LABELS
    t = _c(text)
    return F.coalesce(*[F.when(t.rlike(rf"(?U)\b{lab}\b"), F.lit(i)) for i, lab in enumerate(labels)])


def apply_fallback(raw, first, labels: list[str] | None = None, fallback: str = "one_hot") -> Column:
    labels = labels or LABELS
    raw, first = _c(raw), _c(first)
    if fallback == "one_hot":
        fb = F.array(*[F.when(first == i, 1.0).otherwise(0.0) for i in range(len(labels))])
    elif fallback == "uniform":
        fb = F.array(*[F.lit(1.0) for _ in labels])
    else:
        raise ValueError(f"unknown fallback {fallback!r}")
    return F.when(F.forall(raw, lambda x: x == 0.0) & first.isNotNull(), fb).otherwise(raw)


def scores_from_pairs_b(pairs, text, labels: list[str] | None = None, fallback: str = "one_hot") -> Column:
    return apply_fallback(raw_scores_b(pairs, labels), first_word_index(text, labels), labels, fallback)


def normalise(scores) -> Column:
    """Divide by the sum when it is > 0, else unchanged."""
    s = _c(scores)
    total = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(total > 0, F.transform(s, lambda x: x / total)).otherwise(s)


def as_map(scores, labels: list[str] | None = None) -> Column:
    labels = labels or LABELS
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), _c(scores))


def argmax_label(scores, labels: list[str] | None = None) -> Column:
    """Label of the highest score; first in label order on ties."""
    labels = labels or LABELS
    s = _c(scores)
    m = F.array_max(s)
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(s, m).cast("int"))


def _compliance_struct(t: Column, stated: Column, pairs: Column, raw: Column, total: Column,
                       labels: list[str], tol: float) -> Column:
    def key_is(lab):
        return lambda p: p["k"] == F.lit(lab)

    has_all = F.lit(True)
    for lab in labels:
        has_all = has_all & F.exists(pairs, key_is(lab))
    pos = F.array_position(F.array(*[F.lit(x) for x in labels]), stated).cast("int")
    stated_score = F.when(pos > 0, F.element_at(raw, pos))
    return F.struct(
        has_all.alias("all_labels"),
        (F.abs(total - 1.0) <= tol).alias("sums_to_one"),
        F.coalesce((stated_score == F.array_max(raw)) & (total > 0), F.lit(False)).alias("stated_is_max"),
        (t == F.lower(t)).alias("lower_case"),
    )


def compliance(text, stated, labels: list[str] | None = None, tol: float = 1e-6) -> Column:
    """Struct of format flags demanded by the prompts: every label
    present, raw scores sum to 1, stated label holds the maximum, lower case."""
    labels = labels or LABELS
    t = _c(text)
    pairs = pairs_a(t)
    raw = scores_from_pairs_a(pairs, labels)
    total = F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x)
    return _compliance_struct(t, _c(stated), pairs, raw, total, labels, tol)

def with_confidences(df, text: str, out: str = "scores", variant: str = "a", fallback: str = "one_hot",
                     normalised: bool = False, labels: list[str] | None = None):
    """DataFrame-level T10/T11 (+T12, T14): the regex pairs and the sum are
    materialised as intermediate columns, so each regex runs once per row and
    no array expression is re-evaluated inside a lambda."""
    labels = labels or LABELS
    x = df.withColumn("__pairs", pairs_a(text) if variant == "a" else pairs_b(text, labels))
    if variant == "a":
        x = x.withColumn(out, scores_from_pairs_a("__pairs", labels))
    elif variant == "b":
        x = x.withColumn("__raw", raw_scores_b("__pairs", labels))
        # the whole-word scan only matters when every score is 0
        x = x.withColumn("__first", F.when(F.forall("__raw", lambda v: v == 0.0), first_word_index(text, labels)))
        x = x.withColumn(out, apply_fallback("__raw", "__first", labels, fallback)).drop("__raw", "__first")
    else:
        raise ValueError(f"unknown variant {variant!r}")
    if normalised:
        x = x.withColumn("__total", F.aggregate(F.col(out), F.lit(0.0), lambda acc, v: acc + v))
        x = x.withColumn(out, F.when(F.col("__total") > 0, F.transform(out, lambda v: v / F.col("__total")))
                         .otherwise(F.col(out))).drop("__total")
    return x.drop("__pairs")


def with_compliance(df, text: str, stated: str, out: str = "compliance", labels: list[str] | None = None,
                    tol: float = 1e-6):
    """DataFrame-level T15 (see :func:`compliance`)."""
    labels = labels or LABELS
    x = df.withColumn("__pairs", pairs_a(text))
    x = x.withColumn("__raw", scores_from_pairs_a("__pairs", labels))
    x = x.withColumn("__total", F.aggregate(F.col("__raw"), F.lit(0.0), lambda acc, v: acc + v))
    return x.withColumn(out, _compliance_struct(F.col(text), F.col(stated), F.col("__pairs"), F.col("__raw"),
                                                F.col("__total"), labels, tol)).drop("__pairs", "__raw", "__total")


def long_scores(df, scores: str, keys, labels: list[str] | None = None, label: str = "label", score: str = "score"):
    """Wide ``array<double>`` -> long ``(keys..., label, score)``.

    Uses ``inline(arrays_zip(labels, scores))``: ``posexplode`` of a computed
    array makes whole-stage codegen re-evaluate the array for every element."""
    labels = labels or LABELS
    z = F.arrays_zip(F.array(*[F.lit(x) for x in labels]).alias(label), F.col(scores).alias(score))
    return df.select(*keys, F.inline(z))
