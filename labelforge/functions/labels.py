"""Label scalars: normalisation (P3) and response parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelforge.functions.text import LINE_SPLIT_RE, after_last, py_strip, splitlines
from labelforge.schema import LABELS


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def label_alternation(labels: list[str] | None = None) -> str:
    return "|".join(labels or LABELS)


def normalise_label(c, mode: str = "compat", labels: list[str] | None = None) -> Column:
    """P3. ``compat``: the reference's ``re.sub(r'[N|n]o\\s*', 'no', x)`` (unanchored,
    so it also rewrites a ``no`` inside a longer string and eats the spaces after it).
    ``strict``: ``lower(strip(x))`` kept only when it is a known label, else NULL."""
    c = _c(c)
    if mode == "compat":  # fixed value: the pattern decides what is rewritten
        return F.regexp_replace(c, r"(?U)[N|n]o\s*", "no")
    if mode == "strict":
        v = F.lower(py_strip(c))
        return F.when(v.isin(labels or LABELS), v)
    raise ValueError(f"unknown mode {mode!r}")


def first_label(c, unparsed: str = "raw", labels: list[str] | None = None) -> Column:
    """T4. First whole-word label in the text (case-sensitive). No match:
    ``unparsed='raw'`` keeps the raw text as the label (reference behaviour),
    ``'null'`` gives NULL (use ``filter(isNotNull)`` for ``'drop'``)."""
    c = _c(c)
    hit = F.regexp_extract(c, rf"(?U)\b({label_alternation(labels)})\b", 1)
    if unparsed == "raw":
        return F.when(hit != "", hit).otherwise(c)
    if unparsed in ("null", "drop"):
        return F.when(hit != "", hit)
    raise ValueError(f"unknown unparsed policy {unparsed!r}")


# Fixed value: the forms that Python's float() accepts, after strip.
FLOAT_RE = (r"^[+-]?(?:(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?"
            r"|(?i:inf(?:inity)?|nan))$")


def _float(c: Column) -> Column:
    """``float(text)`` of a text that matches ``FLOAT_RE``."""
    return F.regexp_replace(F.regexp_replace(c, "_", ""), "(?i)^[+-]nan$", "nan").cast("double")


def key_value_entries(lines: Column) -> Column:
    """T6 building block: ``array<struct<k,v,pos>>`` of lines with exactly one
    ``:`` whose right side parses as a float."""
    indexed = F.transform(lines, lambda l, i: F.struct(F.split(l, ":", -1).alias("p"), i.alias("pos")))
    kv = F.filter(
        indexed,
        lambda e: (F.size(e["p"]) == 2) & py_strip(F.element_at(e["p"], 2)).rlike(FLOAT_RE),
    )
    return F.transform(
        kv,
        lambda e: F.struct(
            py_strip(F.element_at(e["p"], 1)).alias("k"),
            _float(py_strip(F.element_at(e["p"], 2))).alias("v"),
            e["pos"].alias("pos"),
        ),
    )


def _dedupe_first_pos_last_value(entries: Column) -> Column:
    """Python-dict semantics for repeated keys: first position, last value.

    Sorted by key and position, a key's first entry is the one whose left
    neighbour has another key, its last the one whose right neighbour has; both
    lists hold the keys in one order, so they are zipped and put back by
    position: n log n steps, where each entry against all others takes n^2."""
    by_key = F.sort_array(F.transform(entries, lambda e: F.struct(e["k"].alias("k"), e["pos"].alias("pos"), e["v"].alias("v"))))
    none = F.slice(F.transform(by_key, lambda e: F.lit(None).cast("string")), 1, 1)  # one, or none for no entries
    keys = F.transform(by_key, lambda e: e["k"])
    n = F.size(by_key)
    left = F.concat(none, F.slice(keys, 1, F.greatest(n - 1, F.lit(0))))
    right = F.concat(F.slice(keys, 2, F.greatest(n - 1, F.lit(0))), none)
    near = F.arrays_zip(by_key.alias("e"), left.alias("l"), right.alias("r"))
    firsts = F.filter(near, lambda x: ~x["e"]["k"].eqNullSafe(x["l"]))
    lasts = F.filter(near, lambda x: ~x["e"]["k"].eqNullSafe(x["r"]))
    folded = F.zip_with(firsts, lasts, lambda f, z: F.struct(
        f["e"]["pos"].alias("pos"), f["e"]["k"].alias("k"), z["e"]["v"].alias("v")))
    return F.transform(F.sort_array(folded), lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v")))


def _first_argmax(folded: Column) -> Column:
    """``max(d, key=d.get)``: first key among equal maxima; in Python no
    comparison with ``nan`` is true, so it neither takes nor gives up the lead."""
    best = F.aggregate(
        folded,
        F.element_at(folded, 1),
        lambda acc, x: F.when((x["v"] > acc["v"]) & ~F.isnan(x["v"]), x).otherwise(acc),
    )
    return F.when(F.size(folded) > 0, best["k"])


def key_value_argmax(entries: Column, known_labels_only: bool = False,
                     labels: list[str] | None = None) -> Column:
    """T6. Python-dict semantics: a repeated key keeps its first position and
    takes its last value; argmax keeps the first of equal maxima."""
    if known_labels_only:
        entries = F.filter(entries, lambda e: e["k"].isin(labels or LABELS))
    return _first_argmax(_dedupe_first_pos_last_value(entries))


# Fixed values in the stages: the line prefix and the section marker of answers.
def _stage1(lines: Column) -> Column:
    finals = F.filter(lines, lambda l: l.startswith("final label:"))
    return F.when(F.size(finals) > 0, py_strip(F.regexp_replace(F.element_at(finals, -1), "^final label:", "")))


def _stage2(c: Column, labels: list[str] | None = None) -> Column:
    section = py_strip(after_last(c, "### output ###"))
    head = F.array_join(F.slice(splitlines(section), 1, 2), " ")
    hit = F.lower(F.regexp_extract(head, rf"(?iuU)\b({label_alternation(labels)})\b", 1))
    return F.when(hit != "", hit)


def multi_stage_label(c, labels: list[str] | None = None, known_labels_only: bool = False) -> Column:
    """T5. (1) last line starting with ``final label:`` (any value, even empty);
    (2) else the first two lines after the last ``### output ###`` (whole text if
    absent), first label ignoring case; (3) else argmax of ``key: number`` lines;
    (4) else NULL. Row scalar; on DataFrames prefer :func:`with_multi_stage_label`."""
    c = _c(c)
    lines = splitlines(c)
    stage3 = key_value_argmax(key_value_entries(lines), known_labels_only, labels)
    return F.coalesce(_stage1(lines), _stage2(c, labels), stage3)


def _first_two_lines(section: Column) -> Column:
    """``' '.join(section.splitlines()[:2])`` without splitting the rest of a
    long text (a third element, if any, holds the remainder)."""
    parts = F.split(section, LINE_SPLIT_RE, 3)
    return F.when(section == "", F.lit("")).otherwise(F.array_join(F.slice(parts, 1, 2), " "))


def with_multi_stage_label(df, text, out: str = "predicted", labels: list[str] | None = None,
                           known_labels_only: bool = False):
    """DataFrame-level T5: the text is split into lines once; stage 1 keeps lines
    by a prefix test, stage 3 looks only at lines holding a ``:`` (no regex on
    the others), stage 2 splits off just the first two lines after the marker.
    Intermediates are columns, so nothing is re-evaluated inside a lambda."""
    t = _c(text)
    x = df.withColumn("__lines", splitlines(t))
    x = x.withColumn("__colon", F.filter(
        F.transform("__lines", lambda l, i: F.struct(l.alias("l"), i.alias("i"))), lambda e: e["l"].contains(":")))
    indexed = F.transform("__colon", lambda e: F.struct(F.split(e["l"], ":", -1).alias("p"), e["i"].alias("pos")))
    kv = F.filter(indexed, lambda e: (F.size(e["p"]) == 2) & py_strip(F.element_at(e["p"], 2)).rlike(FLOAT_RE))
    entries = F.transform(kv, lambda e: F.struct(
        py_strip(F.element_at(e["p"], 1)).alias("k"),
        _float(py_strip(F.element_at(e["p"], 2))).alias("v"),
        e["pos"].alias("pos")))
    if known_labels_only:
        entries = F.filter(entries, lambda e: e["k"].isin(labels or LABELS))
    x = x.withColumn("__kv", entries)
    x = x.withColumn("__folded", _dedupe_first_pos_last_value(F.col("__kv")))
    section = py_strip(after_last(t, "### output ###"))
    hit = F.lower(F.regexp_extract(_first_two_lines(section), rf"(?iuU)\b({label_alternation(labels)})\b", 1))
    stage2 = F.when(hit != "", hit)
    x = x.withColumn(out, F.coalesce(_stage1(F.col("__lines")), stage2, _first_argmax(F.col("__folded"))))
    return x.drop("__lines", "__colon", "__kv", "__folded")
