"""Report-text operators (T16-T23): sections, keyword rates, signal and
phrase scoring, ordered rules, rule-out flags, error keyword attribution.

Keyword, phrase and rule tables are fixed values in code: they become
expressions of the row, and no report text is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.text import py_strip
from labelforge.operators.rank import null_safe_join
from labelforge.schema import LABELS

# Fixed values from the reference's prompt catalogue: keywords per label.
LABEL_KEYWORDS = {
    "no": ["no evidence", "no evidence of metastasis", "no abnormal"],
    "mets": ["metastases", "metastatic", "clinical correlation", "follow up"],
    "progression": ["progressive disease", "increased number of", "clinical correlation", "follow up",
                    "progressed", "aggravated state"],
    "stable": ["stable disease", "no interval changes in metastasis", "stable status"],
    "improved": ["improved", "decreased", "improvement", "decreased in enhancement"],
    "romets": ["recommendation: clinical correlation", "follow up", "r/o", "possibility"],
}

# Fixed values from the reference's prompt catalogue: signal families and
# their phrases, and the label each family points to.
SIGNAL_FAMILIES = [
    ("stability", "stable", ["no change", "stable", "unchanged"]),
    ("progression", "progression", ["increased", "worsened", "progression"]),
    ("metastasis", "mets", ["spread", "metastasis"]),
    ("improvement", "improved", ["reduced", "improved"]),
]

# Fixed values from the reference's prompt catalogue: key phrases and the
# label(s) they raise.
PHRASE_LABELS = [
    ("no evidence", ["no", "stable"]),
    ("metastasis", ["mets"]),
    ("progression", ["progression"]),
    ("improvement", ["improved"]),
    ("no significant change", ["stable", "no"]),
    ("increased spread", ["progression", "mets"]),
    ("improvement compared to previous", ["improved"]),
]

# Fixed values from the reference's prompt catalogue: the ordered
# substring rules (case-sensitive), first match wins, else romets.
RULES = [
    ("no", ["No evidence", "No remarkable change"]),
    ("mets", ["metastases", "metastasis"]),
    ("progression", ["progression", "increased size of", "Newly developed"]),
    ("stable", ["no chance of", "stable", "Stable disease", "Similar size"]),
    ("improved", ["improvement", "improved"]),
]
RULE_DEFAULT = "romets"

# Section headings of the reports, and their canonical names.
HEADINGS = r"EXAM|FINDINGS?|CONCLUSIONS?|IMPRESSION|RECOMMEND(?:ATION)?|HISTORY|CLINICAL INFORMATION|COMPARISON"
HEADING_RE = rf"(?imd)^({HEADINGS})[ \t]*:"
CANONICAL = {"FINDING": "FINDINGS", "CONCLUSIONS": "CONCLUSION", "RECOMMEND": "RECOMMENDATION"}
_OPEN, _CLOSE, _ESCAPE = "\ue000", "\ue001", "\ue002"  # delimiters; those in a text are escaped

RULE_OUT_RE = r"(?iU)\br/o\b|rule[- ]out|follow[- ]up"


def canonical_section(name: Column) -> Column:
    u = F.upper(name)
    expr = u
    for k, v in CANONICAL.items():
        expr = F.when(u == k, F.lit(v)).otherwise(expr)
    return expr


def sections(df: DataFrame, text: str = "report", keys: Sequence[str] = ("report_id",)) -> DataFrame:
    """``(keys..., seq, section, body)``; text before the first heading is
    section ``PREAMBLE`` (dropped when blank). One row per section, so
    downstream keyword work is per section, not per report."""
    # inline over (position, part) structs: posexplode of a computed array is
    # re-evaluated per element under whole-stage codegen
    x = df.select(*keys, F.inline(F.transform(_parts(F.col(text)), lambda p, i: F.struct(i.alias("seq"), p.alias("__part")))))
    out = x.select(*keys, F.col("seq").cast("int").alias("seq"), _section_name(F.col("__part"), F.col("seq")).alias("section"),
                   _section_body(F.col("__part"), F.col("seq")).alias("body"))
    return out.filter((F.col("seq") > 0) | (F.col("body") != ""))


def _parts(text: Column) -> Column:
    """The text cut before each heading; a heading ends with ``_CLOSE``."""
    safe = text
    for i, c in enumerate((_ESCAPE, _OPEN, _CLOSE)):
        safe = F.replace(safe, F.lit(c), F.lit(f"{_ESCAPE}{i}"))
    return F.split(F.regexp_replace(safe, HEADING_RE, _OPEN + "$1" + _CLOSE), _OPEN, -1)


def _section_name(part: Column, seq: Column) -> Column:
    return F.when(seq > 0, canonical_section(F.substring_index(part, _CLOSE, 1))).otherwise(F.lit("PREAMBLE"))


def _section_body(part: Column, seq: Column) -> Column:
    body = F.when(seq > 0, F.substring_index(part, _CLOSE, -1)).otherwise(part)
    for i, c in reversed(list(enumerate((_ESCAPE, _OPEN, _CLOSE)))):
        body = F.replace(body, F.lit(f"{_ESCAPE}{i}"), F.lit(c))
    return py_strip(body)


def keyword_hits(secs: DataFrame, keywords: dict[str, list[str]] | None = None, keys: Sequence[str] = ("report_id",)) -> DataFrame:
    """``(keys..., section, label, ord, keyword)`` for each keyword contained
    (lower-cased) in a section."""
    keywords = keywords or LABEL_KEYWORDS
    arr = F.array(*[F.struct(F.lit(lab).alias("label"), F.lit(i).alias("ord"), F.lit(kw).alias("keyword"))
                    for i, lab in enumerate(keywords) for kw in keywords[lab]])
    x = secs.select(*keys, "section", F.lower(F.col("body")).alias("__lb"))
    return x.select(*keys, "section", F.inline(F.filter(arr, lambda k: F.col("__lb").contains(k["keyword"]))))


def with_keyword_pairs(df: DataFrame, text: str = "report", out: str = "hits",
                       keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """``df`` with ``out``: the distinct (section, keyword) pairs of each report,
    found on the report's own row."""
    words = sorted({k for v in (keywords or LABEL_KEYWORDS).values() for k in v})
    x = df.withColumn("__parts", F.transform(_parts(F.col(text)), lambda p, i: F.struct(
        _section_name(p, i).alias("section"), F.lower(_section_body(p, i)).alias("body"))))
    found = F.transform("__parts", lambda s: F.transform(
        F.filter(F.array(*[F.lit(w) for w in words]), lambda w: s["body"].contains(w)),
        lambda w: F.struct(s["section"].alias("section"), w.alias("keyword"))))
    return x.withColumn(out, F.array_distinct(F.flatten(found))).drop("__parts")


def keyword_lift(predictions: DataFrame, reports: DataFrame, key: str = "report_id", keys: Sequence[str] = ("prompt_id",),
                 text: str = "report", keywords: dict[str, list[str]] | None = None, smooth: float = 0.5) -> DataFrame:
    """Which keywords, in which section, go with an error: for each error
    pair (true -> predicted) the reports with the keyword among its
    ``error_rows`` (``n_error``) and among the ``correct_rows`` of the same
    true label (``n_correct``), and ``lift``, the smoothed log-odds ratio of the two
    (above 0: the keyword is commoner where the model errs).

    Pairs are found on the report's row and joined once by ``key``; one
    aggregate counts them for right and wrong predictions alike, and a pair of
    NULLs in each row's list counts the rows themselves."""
    from labelforge.sources.files import materialize

    keys = list(keys)
    hits = with_keyword_pairs(reports.select(key, text), text, "__hits", keywords).select(key, "__hits")
    itself = F.array(F.struct(F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("keyword")))
    rows = predictions.select(key, *keys, "correct", "predicted").join(hits, key)
    n = rows.select(*keys, "correct", "predicted", F.inline(F.concat("__hits", itself))).groupBy(
        *keys, "correct", "predicted", "section", "keyword").agg(F.count(F.lit(1)).alias("n"))
    n = materialize(n, "keyword-counts")
    right, total = F.col("correct").eqNullSafe(F.col("predicted")), F.col("keyword").isNull()
    out = n.where(~right & ~total).withColumnRenamed("n", "n_error")
    out = null_safe_join(out, n.where(~right & total).select(*keys, "correct", "predicted", F.col("n").alias("error_rows")),
                         [*keys, "correct", "predicted"])
    out = null_safe_join(out, n.where(right & ~total).select(*keys, "correct", "section", "keyword", F.col("n").alias("n_correct")),
                         [*keys, "correct", "section", "keyword"], "left")
    out = null_safe_join(out, n.where(right & total).select(*keys, "correct", F.col("n").alias("correct_rows")), [*keys, "correct"], "left")
    out = out.fillna(0, ["n_correct", "correct_rows"])

    def log_odds(hit: str, all_rows: str) -> Column:
        return F.log((F.col(hit) + smooth) / (F.col(all_rows) - F.col(hit) + smooth))

    return out.select(*keys, "correct", "predicted", "section", "keyword", "n_error", "error_rows", "n_correct", "correct_rows",
                      (log_odds("n_error", "error_rows") - log_odds("n_correct", "correct_rows")).alias("lift"))


def keyword_label(df: DataFrame, text: str = "report", keys: Sequence[str] = ("report_id",),
                  keywords: dict[str, list[str]] | None = None,
                  primary: Sequence[str] = ("CONCLUSION", "IMPRESSION"), secondary: Sequence[str] = ("FINDINGS",)) -> DataFrame:
    """Share of each label's keywords found in the conclusion/impression
    (primary) and findings (secondary) sections; highest primary share wins,
    then secondary share, then label order. No keyword at all -> no row. All
    of it is computed on the report's own row: nothing is shuffled."""
    keywords = keywords or LABEL_KEYWORDS
    x = df.select(*keys, F.transform(_parts(F.col(text)), lambda p, i: F.struct(
        _section_name(p, i).alias("section"), F.lower(_section_body(p, i)).alias("body"))).alias("__parts"))

    def bodies(names: Sequence[str]) -> Column:  # in one text; no keyword spans the NUL between two
        own = F.filter("__parts", lambda s: s["section"].isin(list(names)))
        return F.array_join(F.transform(own, lambda s: s["body"]), "\0")

    x = x.select(*keys, bodies(primary).alias("__p"), bodies(secondary).alias("__s"))

    def rate(col: str, lab: str) -> Column:
        kws = sorted(set(keywords[lab]))
        return sum((F.col(col).contains(k).cast("int") for k in kws), F.lit(0)) / F.lit(len(kws))

    best = F.greatest(*[F.struct(rate("__p", lab).alias("p"), rate("__s", lab).alias("s"), F.lit(-i).alias("o"), F.lit(lab).alias("label"))
                        for i, lab in enumerate(keywords)])
    # filtered inside the generator: a filter above would be pushed below both
    # projections and repeat the splitting of sections for every keyword in it
    one = F.filter(F.array(best), lambda b: (b["p"] > 0) | (b["s"] > 0))
    return x.select(*keys, F.inline(F.transform(one, lambda b: F.struct(
        b["label"].alias("keyword_label"), b["p"].alias("primary_rate"), b["s"].alias("secondary_rate")))))


def _count_phrase(text_lower: Column, phrase: str) -> Column:
    return F.regexp_count(text_lower, F.lit("\\Q" + phrase + "\\E"))


def signal_counts(df: DataFrame, text: str = "report") -> DataFrame:
    """Mentions per signal family and the strongest family's label
    (first family on ties; no mention -> NULL)."""
    lt = F.lower(F.col(text))
    cols = {fam: sum((_count_phrase(lt, p) for p in phrases), F.lit(0)) for fam, _, phrases in SIGNAL_FAMILIES}
    x = df.withColumns({f"n_{fam}": c.cast("bigint") for fam, c in cols.items()})
    best = F.greatest(*[F.col(f"n_{fam}") for fam, _, _ in SIGNAL_FAMILIES])
    lab = F.lit(None).cast("string")
    for fam, label, _ in reversed(SIGNAL_FAMILIES):
        lab = F.when(F.col(f"n_{fam}") == best, F.lit(label)).otherwise(lab)
    return x.withColumn("signal_label", F.when(best > 0, lab))


def phrase_label(df: DataFrame, text: str = "report", keys: Sequence[str] = ("report_id",),
                 phrases: Sequence[tuple[str, Sequence[str]]] | None = None, labels: Sequence[str] | None = None) -> DataFrame:
    """``sum(weight * mentions)`` per label (a phrase's weight is shared
    by its labels), share of the total, argmax (label order on ties); reports
    with no phrase get no row. Computed on the report's own row."""
    phrases, labels = phrases or PHRASE_LABELS, list(labels or LABELS)
    lt = F.lower(F.col(text))
    x = df.select(*keys, *[_count_phrase(lt, p).alias(f"__n{i}") for i, (p, _) in enumerate(phrases)])

    def total(lab: str) -> Column:
        return sum((F.col(f"__n{i}") * F.lit(1.0 / len(labs)) for i, (_, labs) in enumerate(phrases) if lab in labs), F.lit(0.0))

    x = x.select(*keys, *[total(lab).alias(f"__s{i}") for i, lab in enumerate(labels)])
    sums = [F.col(f"__s{i}") for i in range(len(labels))]
    best = F.greatest(*[F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(lab).alias("label"))
                        for i, (s, lab) in enumerate(zip(sums, labels))])
    one = F.array(F.struct(best["label"].alias("phrase_label"), F.try_divide(best["s"], sum(sums, F.lit(0.0))).alias("share")))
    return x.select(*keys, F.inline(F.filter(one, lambda b: b["share"] > 0)))


def rule_label(text: str = "report") -> Column:
    """The ordered case-sensitive substring cascade (intended reading)."""
    t = F.col(text)
    out = F.lit(RULE_DEFAULT)
    for label, phrases in reversed(RULES):
        cond = F.lit(False)
        for p in phrases:
            cond = cond | t.contains(p)
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out


def rule_out_flag(body: str = "body") -> Column:
    """Rule-out / follow-up wording in a section."""
    return F.col(body).rlike(RULE_OUT_RE)


def explanation_checks(text: str = "text", max_chars: int = 300, keywords: Sequence[str] | None = None) -> Column:
    """Struct of checks on an explanation text."""
    kws = keywords or sorted({k for v in LABEL_KEYWORDS.values() for k in v})
    lt = F.lower(F.col(text))
    names_kw = F.lit(False)
    for k in kws:
        names_kw = names_kw | lt.contains(k)
    return F.struct(
        (F.length(F.col(text)) <= max_chars).alias("short"),
        F.col(text).rlike(r"(?i)conclusion|impression|findings?").alias("names_section"),
        names_kw.alias("names_keyword"),
    )
