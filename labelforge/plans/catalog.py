"""Query catalogue: ``name -> (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL | None)``.

Every query reads the test tables (or inputs Spark derives from them, see
``fixtures``) in full. Floating results are rounded to 9 places on both
sides so that summation order cannot change the compared value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.functions import confidence as C
from labelforge.functions import labels as LB
from labelforge.functions import text as TX
from labelforge.functions.labels import normalise_label
from labelforge.functions.text import word_count
from labelforge.operators import auroc as A
from labelforge.operators import errors as ER
from labelforge.operators import inference as INF
from labelforge.operators import metrics as M
from labelforge.operators import prepare as P
from labelforge.operators import prompts as PR
from labelforge.operators import reports as RP
from labelforge.operators import split as X
from labelforge.plans import fixtures as FX
from labelforge.plans import oracle_parts as OP
from labelforge.plans.oracle_parts import LABELS_SQL, predicted_sql, q, with_parts
from labelforge.schema import LABELS, RAW_NO_VARIANTS
from labelforge.sources import files as IO
from labelforge.sources.tables import table
from labelforge.streaming import monitor as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
R = 9


def bigint_counts(sql: str) -> str:
    """DuckDB's ``count_if`` is HUGEINT; ``count(*) FILTER (WHERE ...)`` is
    BIGINT like Spark's ``count_if``."""
    out, i = [], 0
    while True:
        j = sql.find("count_if(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        k, depth = j + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + "count(*) FILTER (WHERE " + bigint_counts(sql[j + len("count_if("):k - 1]) + ")")
        i = k


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = bigint_counts(sql)
        return fn
    return deco


def rnd(c, places: int = R):
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def rounded(df: DataFrame, cols: list[str], places: int = R) -> DataFrame:
    return df.select(*[rnd(c, places).alias(c) if c in cols else F.col(c) for c in df.columns])


# --------------------------------------------------------------------------- labels

@query("label_normalise", with_parts(["gold"], f"""
SELECT doc_id, raw_label,
       regexp_replace(raw_label, '[N|n]o\\s*', 'no', 'g') AS label_compat,
       CASE WHEN lower(regexp_replace(raw_label, '^\\s+|\\s+$', '', 'g')) IN (SELECT unnest({LABELS_SQL}))
            THEN lower(regexp_replace(raw_label, '^\\s+|\\s+$', '', 'g')) END AS label_strict
FROM gold"""))
def label_normalise(spark, sf_dir):
    g = FX.gold(spark, sf_dir)
    return g.select("doc_id", "raw_label", normalise_label("raw_label", "compat").alias("label_compat"),
                    normalise_label("raw_label", "strict").alias("label_strict"))


_HOLES = """holes AS (SELECT doc_id, CASE WHEN doc_id % 13 = 3 THEN NULL ELSE text END AS text, lang, source, n_chars,
  CASE WHEN doc_id % 17 = 5 THEN NULL ELSE true_label END AS true_label, raw_label FROM gold)"""


def _with_holes(spark, sf_dir) -> DataFrame:
    """Labelled reports, some without a label, some without a text."""
    return FX.gold(spark, sf_dir).withColumns({
        "text": F.when(F.col("doc_id") % 13 != 3, F.col("text")),
        "true_label": F.when(F.col("doc_id") % 17 != 5, F.col("true_label"))})


@query("label_counts", with_parts(["gold"], """
SELECT true_label, count(doc_id) AS n_doc_id, count(text) AS n_text, count(lang) AS n_lang, count(source) AS n_source,
       count(n_chars) AS n_n_chars, count(raw_label) AS n_raw_label
FROM holes WHERE true_label IS NOT NULL GROUP BY true_label""", _HOLES))
def label_counts(spark, sf_dir):
    return M.label_counts(_with_holes(spark, sf_dir), "true_label")


@query("label_share", with_parts(["gold"], """
SELECT true_label, n, round_even(100.0 * n / sum(n) OVER (), 2) AS ratio_pct
FROM (SELECT true_label, count(text) AS n FROM holes WHERE true_label IS NOT NULL GROUP BY true_label)""", _HOLES))
def label_share(spark, sf_dir):
    return M.label_share(_with_holes(spark, sf_dir), "true_label", "text")


@query("label_imbalance", with_parts(["gold"], f"""
SELECT max(p) AS max_pct, min(p) AS min_pct, round(max(p) - min(p), {R}) AS spread, round(max(p) / min(p), {R}) AS factor, count(*) AS n_classes
FROM (SELECT round_even(100.0 * n / sum(n) OVER (), 2) AS p
      FROM (SELECT true_label, count(text) AS n FROM holes WHERE true_label IS NOT NULL GROUP BY true_label))""", _HOLES))
def label_imbalance(spark, sf_dir):
    return rounded(M.label_imbalance(_with_holes(spark, sf_dir), "true_label", "text"), ["spread", "factor"])


@query("null_profile", """
SELECT count_if(d.doc_id IS NULL) AS null_doc_id, count_if(d.text IS NULL) AS null_text, count_if(d.lang IS NULL) AS null_lang,
       count_if(d.source IS NULL) AS null_source, count_if(d.n_chars IS NULL) AS null_n_chars, count_if(l.quality IS NULL) AS null_quality, count_if(l.toxic IS NULL) AS null_toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def null_profile(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return M.null_profile(d.join(lab, "doc_id", "left"))


@query("exact_value_counts", with_parts(["gold"], """
SELECT count_if(raw_label = 'no') AS n_eq_0, count_if(raw_label = 'No') AS n_eq_1,
       count_if(raw_label = 'no ') AS n_eq_2 FROM gold"""))
def exact_value_counts(spark, sf_dir):
    return M.exact_value_counts(FX.gold(spark, sf_dir), "raw_label", RAW_NO_VARIANTS)


# --------------------------------------------------------------------------- documents

_INSTR = q(P.DEFAULT_INSTRUCTION)
_WC = "len(regexp_extract_all(text, '[^ \\t\\n\\r\\x0B\\x0C]+'))"


@query("instruction_rows", with_parts(["gold"], f"""
SELECT doc_id, text AS input, {_INSTR} AS instruction,
       regexp_replace(raw_label, '[N|n]o\\s*', 'no', 'g') AS output FROM gold"""))
def instruction_rows(spark, sf_dir):
    g = FX.gold(spark, sf_dir)
    return P.instruction_rows(g, report="text", label="raw_label", keep=["doc_id"])


@query("training_text", with_parts(["gold"], f"""
SELECT doc_id, '### Instruction:' || chr(10) || {_INSTR} || chr(10) || chr(10) || 'Input:' || chr(10) || text
       || chr(10) || chr(10) || '### Response:' || chr(10) || regexp_replace(raw_label, '[N|n]o\\s*', 'no', 'g')
       || '</s>' AS text
FROM gold"""))
def training_text(spark, sf_dir):
    g = FX.gold(spark, sf_dir)
    rows = P.instruction_rows(g, report="text", label="raw_label", keep=["doc_id"])
    return P.training_text(rows, eos="</s>").select("doc_id", "text")


@query("length_audit", f"""
SELECT lang, count(*) AS n_rows, count_if(w > 600) AS n_over_limit, max(w) AS max_words,
       min(w) AS min_words, sum(w)::BIGINT AS total_words
FROM (SELECT lang, {_WC} AS w FROM documents) GROUP BY lang""")
def length_audit(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return P.length_audit(d, "text", 600, by=["lang"]).withColumn("max_words", F.col("max_words").cast("bigint")) \
        .withColumn("min_words", F.col("min_words").cast("bigint")).withColumn("total_words", F.col("total_words").cast("bigint"))


@query("length_quantiles", f"""
SELECT s[greatest(1, CAST(ceil(0.5 * len(s)) AS BIGINT))] AS p50, s[greatest(1, CAST(ceil(0.9 * len(s)) AS BIGINT))] AS p90,
       s[greatest(1, CAST(ceil(0.99 * len(s)) AS BIGINT))] AS p99
FROM (SELECT list_sort(list({_WC}::INTEGER)) AS s FROM documents WHERE text IS NOT NULL)""")
def length_quantiles(spark, sf_dir):
    """P10, with an accuracy at which the sketch is exact on tables of this size."""
    got = P.length_quantiles(table(spark, sf_dir, "documents"), accuracy=1_000_000)
    return got.select(*[F.col("quantiles")[i].alias(n) for i, n in enumerate(("p50", "p90", "p99"))])


@query("length_buckets", f"""
SELECT CAST(CASE WHEN w <= 0 THEN 0 ELSE length(bin(w)) END AS INTEGER) AS length_bucket, count(*) AS n_docs,
       min(w) AS min_words, max(w) AS max_words
FROM (SELECT {_WC}::BIGINT AS w FROM documents) GROUP BY 1""")
def length_buckets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(P.length_bucket("text").alias("length_bucket"), word_count("text").cast("bigint").alias("w")).groupBy("length_bucket").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min("w").alias("min_words"), F.max("w").alias("max_words"))


# --------------------------------------------------------------------------- splits

def _split_ctes(table_sql: str, id_col: str, label_col: str, test_size: str = "0.3", eval_share: str = "0.5") -> str:
    """CTEs ``e, r, c, q1, q2, s``; ``s`` holds ``(id, label, rk, split)``."""
    def lr(src: str, n: str, draw: str, out: str) -> str:
        return f"""SELECT *, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, {label_col} ASC NULLS LAST) <= d - sum(base) OVER () THEN 1 ELSE 0 END AS {out}
FROM (SELECT *, (d::HUGEINT * {n}) // tot AS base, (d::HUGEINT * {n}) % tot AS rem
      FROM (SELECT *, sum({n}) OVER () AS tot, CAST(ceil({draw} * sum({n}) OVER ()) AS BIGINT) AS d FROM {src}))"""
    return f"""e AS (SELECT {id_col}, {label_col}, md5(CAST({id_col} AS VARCHAR) || ':42') AS k FROM {table_sql}),
r AS (SELECT {id_col}, {label_col}, row_number() OVER (PARTITION BY {label_col} ORDER BY k, {id_col}) AS rk FROM e),
c AS (SELECT {label_col}, count(*) AS n FROM e GROUP BY {label_col}),
q1 AS (SELECT {label_col}, n, q_temp FROM ({lr('c', 'n', test_size, 'q_temp')})),
q2 AS (SELECT {label_col}, q_temp, q_test FROM ({lr('q1', 'q_temp', eval_share, 'q_test')})),
s AS (SELECT r.{id_col}, r.{label_col}, r.rk,
             CASE WHEN r.rk <= q2.q_test THEN 'test' WHEN r.rk <= q2.q_temp THEN 'eval' ELSE 'train' END AS split
      FROM r JOIN q2 ON r.{label_col} IS NOT DISTINCT FROM q2.{label_col})"""


def _split_sql(table_sql: str, id_col: str, label_col: str, what: str, test_size: str = "0.3",
               eval_share: str = "0.5") -> str:
    return f"WITH {_split_ctes(table_sql, id_col, label_col, test_size, eval_share)}\n{what}"


@query("stratified_split", _split_sql("events", "event_id", "event_type",
                                      "SELECT event_id, event_type, split FROM s"))
def stratified_split(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return X.stratified_split(e, "event_id", "event_type").select("event_id", "event_type", "split")


@query("split_sizes", _split_sql("events", "event_id", "event_type",
                                 "SELECT split, event_type, count(*) AS n FROM s GROUP BY ALL"))
def split_sizes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return X.split_sizes(X.stratified_split(e, "event_id", "event_type"), "event_type")


@query("split_sizes_orders", _split_sql("orders", "o_orderkey", "o_orderpriority",
                                        "SELECT split, o_orderpriority, count(*) AS n FROM s GROUP BY ALL"))
def split_sizes_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return X.split_sizes(X.stratified_split(o, "o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("stratified_kfold", _split_sql("events", "event_id", "event_type",
                                      """SELECT event_id, event_type, CAST((earlier + rk - 1) % 5 AS INTEGER) AS fold FROM s JOIN
(SELECT event_type AS t, coalesce(sum(n) OVER (ORDER BY event_type NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM c)
ON event_type IS NOT DISTINCT FROM t"""))
def stratified_kfold(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return X.stratified_kfold(e, "event_id", "event_type", k=5).select("event_id", "event_type", "fold")


# --------------------------------------------------------------------------- metrics

def _metrics_sql(src: str, keys: list[str], zero_division: float = 0.0, where: str = "") -> str:
    k = ", ".join(keys)
    kc = (k + ", ") if k else ""
    zd = float(zero_division)
    return f"""cm AS (SELECT {kc}correct, predicted, count(*) AS n FROM {src} {where} GROUP BY ALL),
cls AS (SELECT {kc}correct AS cls, n AS t, 0 AS p, CASE WHEN correct IS NOT DISTINCT FROM predicted THEN n ELSE 0 END AS tp FROM cm
        UNION ALL SELECT {kc}predicted AS cls, 0 AS t, n AS p, 0 AS tp FROM cm),
pc AS (SELECT {kc}cls, sum(tp) AS tp, sum(t) AS n_true, sum(p) AS n_pred FROM cls GROUP BY ALL),
pm AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE {zd} END AS precision,
              CASE WHEN n_true > 0 THEN tp / n_true ELSE {zd} END AS recall,
              CASE WHEN n_true + n_pred > 0 THEN 2 * tp / (n_true + n_pred) ELSE {zd} END AS f1_score FROM pc),
mm AS (SELECT {kc}round(sum(tp) / sum(n_true), {R}) AS accuracy, round(avg(precision), {R}) AS precision,
              round(avg(recall), {R}) AS recall, round(avg(f1_score), {R}) AS f1_score,
              sum(n_true)::BIGINT AS n_rows, count(*) AS n_classes FROM pm GROUP BY ALL)"""


def _metrics_df(df: DataFrame, keys: list[str], **kw) -> DataFrame:
    m = M.macro_metrics(df, keys, **kw)
    return rounded(m, ["accuracy", "precision", "recall", "f1_score"])


@query("macro_metrics", with_parts(["pred"], "SELECT * FROM mm", _metrics_sql("pred", ["prompt_id"])))
def macro_metrics(spark, sf_dir):
    return _metrics_df(FX.predictions(spark, sf_dir), ["prompt_id"])


@query("macro_metrics_drop", with_parts(["pred"], "SELECT * FROM mm", _metrics_sql("pred", ["prompt_id"], where=f"WHERE predicted IN (SELECT unnest({LABELS_SQL}))")))
def macro_metrics_drop(spark, sf_dir):
    return _metrics_df(FX.predictions(spark, sf_dir), ["prompt_id"], unparsed="drop")


@query("macro_metrics_zero1", with_parts(["pred"], "SELECT * FROM mm", _metrics_sql("pred", ["prompt_id"], 1.0)))
def macro_metrics_zero1(spark, sf_dir):
    return _metrics_df(FX.predictions(spark, sf_dir), ["prompt_id"], zero_division=1.0)


# --------------------------------------------------------------------------- folds x prompts

def _fold_predictions(spark, sf_dir) -> DataFrame:
    g = FX.gold(spark, sf_dir).select("doc_id", "true_label")
    folds = X.stratified_kfold(g, "doc_id", "true_label", k=5).select("doc_id", "true_label", "fold")
    p = FX.prompts_df(spark).select("prompt_id", "ord")
    return PR.expand(folds, p).select(
        "doc_id", "fold", "prompt_id", F.col("true_label").alias("correct"),
        FX.predicted_expr(F.col("doc_id"), F.col("prompt_id"), F.col("true_label")).alias("predicted"))


_FOLD_CTE = f"""fp AS (SELECT f.doc_id, f.fold, p.prompt_id, f.true_label AS correct,
    {predicted_sql('f.doc_id', 'p.prompt_id', 'f.true_label')} AS predicted
  FROM (SELECT doc_id, true_label, CAST((row_number() OVER (ORDER BY true_label NULLS LAST, md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) - 1) % 5 AS INTEGER) AS fold FROM gold) f
  CROSS JOIN prompts p)"""


@query("fold_metrics", with_parts(["gold", "prompts"], "SELECT * FROM mm",
                                  _FOLD_CTE + ",\n" + _metrics_sql("fp", ["fold", "prompt_id"], 1.0)))
def fold_metrics(spark, sf_dir):
    return _metrics_df(_fold_predictions(spark, sf_dir), ["fold", "prompt_id"], zero_division=1.0)


@query("fold_metrics_mean", with_parts(["gold", "prompts"], f"""
SELECT prompt_id, round(avg(accuracy), {R}) AS accuracy, round(avg(precision), {R}) AS precision,
       round(avg(recall), {R}) AS recall, round(avg(f1_score), {R}) AS f1_score, count(*) AS n_runs
FROM mm GROUP BY ROLLUP (prompt_id)""", _FOLD_CTE + ",\n" + _metrics_sql("fp", ["fold", "prompt_id"], 1.0)
    .replace(f"round(sum(tp) / sum(n_true), {R})", "sum(tp) / sum(n_true)")
    .replace(f"round(avg(precision), {R})", "avg(precision)").replace(f"round(avg(recall), {R})", "avg(recall)")
    .replace(f"round(avg(f1_score), {R})", "avg(f1_score)")))
def fold_metrics_mean(spark, sf_dir):
    m = M.macro_metrics(_fold_predictions(spark, sf_dir), ["fold", "prompt_id"], zero_division=1.0)
    out = M.mean_metrics(m, ["prompt_id"]).unionByName(M.mean_metrics(m).withColumn("prompt_id", F.lit(None).cast("string")))
    return rounded(out, ["accuracy", "precision", "recall", "f1_score"])


_PIVOT = ", ".join(f"sum(CASE WHEN predicted = {q(lab)} THEN 1 ELSE 0 END)::BIGINT AS \"{lab}\"" for lab in LABELS)


@query("confusion_matrix", with_parts(["pred"], f"SELECT prompt_id, correct, {_PIVOT} FROM pred GROUP BY prompt_id, correct"))
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(FX.predictions(spark, sf_dir), ["prompt_id"])


@query("confusion_counts", with_parts(["pred"], "SELECT prompt_id, correct, predicted, count(*) AS n FROM pred GROUP BY ALL"))
def confusion_counts(spark, sf_dir):
    return M.confusion_counts(FX.predictions(spark, sf_dir), ["prompt_id"])


@query("label_encode", with_parts(["pred"], """
SELECT prompt_id, cls, CAST(dense_rank() OVER (PARTITION BY prompt_id ORDER BY cls ASC NULLS LAST) - 1 AS BIGINT) AS code
FROM (SELECT prompt_id, correct AS cls FROM pred UNION SELECT prompt_id, predicted FROM pred)"""))
def label_encode(spark, sf_dir):
    return M.label_encode(FX.predictions(spark, sf_dir), ["prompt_id"])


@query("label_encode_all", with_parts(["resp"], f"""
SELECT cls, CAST(dense_rank() OVER (ORDER BY cls ASC NULLS LAST) - 1 AS BIGINT) AS code
FROM (SELECT correct AS cls FROM resp
      UNION SELECT CASE WHEN regexp_matches(response, '\\b({OP.ALT})\\b') THEN regexp_extract(response, '\\b({OP.ALT})\\b', 1) ELSE response END FROM resp)"""))
def label_encode_all(spark, sf_dir):
    """E12 over all runs at once, unparsed answers kept as classes (T4)."""
    r = FX.responses(spark, sf_dir).select("correct", LB.first_label("response", "raw").alias("predicted"))
    return M.label_encode(r)


@query("label_binarise", with_parts(["gold"], f"""
SELECT doc_id, label, CAST(true_label = label AS INTEGER) AS is_true
FROM (SELECT doc_id, true_label, unnest({LABELS_SQL}) AS label FROM gold)"""))
def label_binarise(spark, sf_dir):
    return M.binarise(FX.gold(spark, sf_dir).select("doc_id", "true_label"), truth="true_label").select(
        "doc_id", "label", "is_true")


# --------------------------------------------------------------------------- AUROC



def _auroc_sql(src: str, keys: list[str], target_sql: str) -> str:
    k = ", ".join(keys)
    return f"""d AS (SELECT {k}, score, sum(y) AS pos, sum(1 - y) AS neg
       FROM (SELECT *, CASE WHEN {target_sql} THEN 1 ELSE 0 END AS y FROM {src}) GROUP BY ALL),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {k} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d),
au AS (SELECT {k}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + 0.5 * neg)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) END AS auroc,
              sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg FROM c GROUP BY ALL)"""


@query("auroc_by_label", with_parts(["scores"], f"SELECT prompt_id, label, round(auroc, {R}) AS auroc, n_pos, n_neg FROM au",
                                    _auroc_sql("scores", ["prompt_id", "label"], "true_label = label")))
def auroc_by_label(spark, sf_dir):
    return rounded(A.one_vs_rest_auroc(FX.scores(spark, sf_dir), ["prompt_id"]), ["auroc"])


@query("auroc_macro", with_parts(["scores"], f"SELECT prompt_id, round(avg(auroc), {R}) AS average_auroc, count(auroc) AS n_defined FROM au GROUP BY prompt_id",
                                 _auroc_sql("scores", ["prompt_id", "label"], "true_label = label")))
def auroc_macro(spark, sf_dir):
    return rounded(A.macro_auroc(A.one_vs_rest_auroc(FX.scores(spark, sf_dir), ["prompt_id"]), ["prompt_id"]),
                   ["average_auroc"])


_POS_TARGETS = f"""tr AS (SELECT prompt_id, t, i, n, CASE WHEN n = 2 THEN i - 1 ELSE i END AS col
       FROM (SELECT prompt_id, t, row_number() OVER (PARTITION BY prompt_id ORDER BY t) - 1 AS i,
                    count(*) OVER (PARTITION BY prompt_id) AS n
             FROM (SELECT DISTINCT prompt_id, true_label AS t FROM scores WHERE true_label IS NOT NULL))),
tg AS (SELECT g.prompt_id, g.label, tr.t AS target
       FROM (SELECT DISTINCT prompt_id, label FROM scores) g
       LEFT JOIN tr ON g.prompt_id = tr.prompt_id AND list_position({LABELS_SQL}, g.label) - 1 = tr.col),
ps AS (SELECT s.*, tg.target FROM scores s JOIN tg USING (prompt_id, label) WHERE tg.target IS NOT NULL)"""


@query("auroc_positional", with_parts(["scores"], f"""
SELECT g.prompt_id, g.label, round(au.auroc, {R}) AS auroc, au.n_pos, au.n_neg
FROM (SELECT DISTINCT prompt_id, label FROM scores) g LEFT JOIN au USING (prompt_id, label)""",
    _POS_TARGETS + ",\n" + _auroc_sql("ps", ["prompt_id", "label"], "true_label = target")))
def auroc_positional(spark, sf_dir):
    return rounded(A.one_vs_rest_auroc(FX.scores(spark, sf_dir), ["prompt_id"], align="positional"), ["auroc"])


_AU_COLS = ", ".join(f"round(max(CASE WHEN label = {q(lab)} THEN auroc END), {R}) AS auroc_{lab}" for lab in LABELS)
_SC_COLS = ", ".join(f"max(CASE WHEN label = {q(lab)} THEN score END) AS \"{lab}\"" for lab in LABELS)


@query("auroc_wide_export", with_parts(["scores"], f"""
SELECT w.*, a.* EXCLUDE (prompt_id), m.average_auroc
FROM (SELECT doc_id, prompt_id, predicted AS predicted_label, true_label, {_SC_COLS} FROM scores GROUP BY ALL) w
JOIN (SELECT prompt_id, {_AU_COLS} FROM au GROUP BY prompt_id) a USING (prompt_id)
JOIN (SELECT prompt_id, round(avg(auroc), {R}) AS average_auroc FROM au GROUP BY prompt_id) m USING (prompt_id)""",
    _auroc_sql("scores", ["prompt_id", "label"], "true_label = label")))
def auroc_wide_export(spark, sf_dir):
    s = FX.scores(spark, sf_dir)
    wide = A.wide_export(s, A.one_vs_rest_auroc(s, ["prompt_id"]), ["doc_id"], ["prompt_id"])
    return rounded(wide, ["average_auroc"] + [f"auroc_{lab}" for lab in LABELS])


@query("auroc_natural", f"""
WITH x AS (SELECT 'quality' AS target, l.quality AS y, d.n_chars::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id)
           UNION ALL SELECT 'toxic', l.toxic, d.n_chars::DOUBLE FROM labels l JOIN documents d USING (doc_id)),
{_auroc_sql("x", ["target"], "y = 1")}
SELECT target, round(auroc, {R}) AS auroc, n_pos, n_neg FROM au""")
def auroc_natural(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    j = lab.join(d, "doc_id")
    long = j.select("score", F.explode(F.array(
        F.struct(F.lit("quality").alias("target"), F.col("quality").alias("y")),
        F.struct(F.lit("toxic").alias("target"), F.col("toxic").alias("y")))).alias("t")).select("score", "t.target", "t.y")
    return rounded(A.auroc(long, ["target"], "score", "y"), ["auroc"])


@query("auroc_unranked", """
SELECT target, count(*) AS n_rows, count_if(score IS NULL) AS n_no_score, count_if(y IS NULL) AS n_no_target, count_if(score IS NULL OR y IS NULL) AS n_unranked
FROM (SELECT 'quality' AS target, l.quality AS y, d.n_chars::DOUBLE AS score FROM documents d LEFT JOIN labels l USING (doc_id)
      UNION ALL SELECT 'toxic', l.toxic, d.n_chars::DOUBLE FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY target""")
def auroc_unranked(spark, sf_dir):
    """Documents that no label ranks."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    j = d.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    long = j.select("score", F.inline(F.array(
        F.struct(F.lit("quality").alias("target"), F.col("quality").alias("y")),
        F.struct(F.lit("toxic").alias("target"), F.col("toxic").alias("y")))))
    return A.unranked(long, ["target"], "score", "y")


_CONF_LONG = f"""conf AS (
  SELECT doc_id, prompt_id, label, round(CASE WHEN tot > 0 THEN score / tot ELSE score END, {R}) AS score, correct AS true_label
  FROM (SELECT *, sum(score) OVER (PARTITION BY doc_id, prompt_id) AS tot
        FROM (SELECT doc_id, prompt_id, correct, unnest([{', '.join(f"{{'label': {q(lab)}, 'score': {c}}}" for lab, c in zip(LABELS, OP.sql_conf_a('response')))}], recursive := true) FROM resp)))"""
_MENTIONS = f"list_concat(list_filter(regexp_extract_all(response, '{OP.PAT_A}', 1), lambda k: list_contains({LABELS_SQL}, k)), {LABELS_SQL})"


@query("auroc_first_appearance", with_parts(["resp"], f"""
SELECT g.prompt_id, g.label, round(au.auroc, {R}) AS auroc, au.n_pos, au.n_neg
FROM (SELECT DISTINCT prompt_id, label FROM conf) g LEFT JOIN au USING (prompt_id, label)""",
    _CONF_LONG + f""",
ord AS (SELECT prompt_id, list_filter(l, lambda v, i: list_position(l, v) = i) AS cols
        FROM (SELECT prompt_id, arg_min({_MENTIONS}, doc_id) AS l FROM resp GROUP BY prompt_id)),
""" + _POS_TARGETS.replace("FROM scores", "FROM conf").replace("JOIN tr ON", "JOIN ord USING (prompt_id) LEFT JOIN tr ON", 1).replace("LEFT JOIN ord", "JOIN ord")
    .replace(f"list_position({LABELS_SQL}, g.label)", "list_position(ord.cols, g.label)")
    + ",\n" + _auroc_sql("ps", ["prompt_id", "label"], "true_label = target")))
def auroc_first_appearance(spark, sf_dir):
    """E8 with the columns of a table built row by row: the first response of a
    prompt decides which score column meets which truth column."""
    r = FX.responses(spark, sf_dir).select("doc_id", "prompt_id", "response", F.col("correct").alias("true_label"))
    s = rounded(C.long_scores(C.with_confidences(r, "response", "s", "a", normalised=True), "s", ["doc_id", "prompt_id", "true_label"]), ["score"])
    order = A.first_mention_order(r, ["prompt_id"], "response", "doc_id")
    return rounded(A.one_vs_rest_auroc(s, ["prompt_id"], align="positional", order=order), ["auroc"])


# --------------------------------------------------------------------------- prompts



@query("prompt_expand", with_parts(["gold", "prompts"], "SELECT g.doc_id, p.prompt_id, p.ord FROM gold g CROSS JOIN prompts p"))
def prompt_expand(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return PR.expand(d, FX.prompts_df(spark)).select("doc_id", "prompt_id", "ord")


@query("prompt_render", with_parts(["resp_dec"], "SELECT doc_id, prompt_id, md5(prompt) AS prompt_md5, length(prompt)::BIGINT AS prompt_chars FROM resp_dec"))
def prompt_render(spark, sf_dir):
    r = FX.responses(spark, sf_dir, decoded=True)
    return r.select("doc_id", "prompt_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("prompt_chars"))


@query("prompt_groups", with_parts(["pred"], "SELECT CASE WHEN ord < 2 THEN 'before' ELSE 'after' END AS grp, prompt_id, count(*) AS n_rows FROM pred GROUP BY ALL"))
def prompt_groups(spark, sf_dir):
    p = PR.route_groups(FX.prompts_df(spark), FX.GROUP_SPLIT)
    pred = FX.predictions(spark, sf_dir).join(F.broadcast(p.select("prompt_id", "grp")), "prompt_id")
    return pred.groupBy("grp", "prompt_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("prompt_routing", with_parts(["pred"], """
SELECT doc_id, prompt_id, CASE WHEN ord < 2 THEN 'before' ELSE 'after' END AS grp,
       CASE WHEN ord < 2 THEN predicted ELSE upper(predicted) END AS predicted FROM pred"""))
def prompt_routing(spark, sf_dir):
    """Two prediction tables, each prompt's rows taken from its group's."""
    pred = FX.predictions(spark, sf_dir).select("doc_id", "prompt_id", "predicted")
    tables = {"before": pred, "after": pred.withColumn("predicted", F.upper("predicted"))}
    return PR.route_predictions(PR.route_groups(FX.prompts_df(spark), FX.GROUP_SPLIT), tables)


@query("metrics_on_rows", with_parts(["pred"], """
SELECT p.doc_id, prompt_id, p.correct, p.predicted, m.accuracy, m.precision, m.recall, m.f1_score FROM pred p JOIN mm m USING (prompt_id)""",
    _metrics_sql("pred", ["prompt_id"])))
def metrics_on_rows(spark, sf_dir):
    p = FX.predictions(spark, sf_dir).select("doc_id", "prompt_id", "correct", "predicted")
    return rounded(M.metrics_on_rows(p, ["prompt_id"]), ["accuracy", "precision", "recall", "f1_score"])


@query("metrics_on_first_row", with_parts(["pred"], """
SELECT p.doc_id, prompt_id, p.correct, p.predicted, CASE WHEN p.doc_id = f THEN m.accuracy END AS accuracy, CASE WHEN p.doc_id = f THEN m.precision END AS precision,
       CASE WHEN p.doc_id = f THEN m.recall END AS recall, CASE WHEN p.doc_id = f THEN m.f1_score END AS f1_score
FROM pred p JOIN mm m USING (prompt_id) JOIN (SELECT prompt_id, min(doc_id) AS f FROM pred GROUP BY prompt_id) USING (prompt_id)""",
    _metrics_sql("pred", ["prompt_id"])))
def metrics_on_first_row(spark, sf_dir):
    p = FX.predictions(spark, sf_dir).select("doc_id", "prompt_id", "correct", "predicted")
    return rounded(M.metrics_on_first_row(p, ["prompt_id"], "doc_id"), ["accuracy", "precision", "recall", "f1_score"])


_TURNS = """(SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS o FROM conversations WHERE role = 'user') p
FULL JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS o FROM conversations WHERE role = 'assistant') r
ON p.conv_id = r.conv_id AND p.o = r.o"""


def _turns(spark, sf_dir) -> DataFrame:
    """Each conversation's n-th question beside its n-th answer."""
    c = table(spark, sf_dir, "conversations")
    ask = c.where("role = 'user'").select("conv_id", F.col("turn").alias("user_turn"))
    reply = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("reply_turn"))
    return ER.align_by_occurrence(ask, reply, "conv_id", [F.col("user_turn").asc()], [F.col("reply_turn").asc()])


@query("align_occurrences", f"""
SELECT coalesce(p.conv_id, r.conv_id) AS conv_id, coalesce(p.o, r.o) AS occurrence, coalesce(p.turn, -1) AS user_turn, coalesce(r.turn, -1) AS reply_turn FROM {_TURNS}""")
def align_occurrences(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "occurrence", F.coalesce("user_turn", F.lit(-1)).alias("user_turn"),
                                        F.coalesce("reply_turn", F.lit(-1)).alias("reply_turn"))  # -1: no counterpart


@query("align_occurrences_audit", f"""
SELECT sum(m)::BIGINT AS n_matched, coalesce(sum(a) FILTER (WHERE m > 0), 0)::BIGINT AS n_surplus_predictions, coalesce(sum(b) FILTER (WHERE m > 0), 0)::BIGINT AS n_surplus_rows,
       coalesce(sum(a) FILTER (WHERE m = 0), 0)::BIGINT AS n_only_predictions, coalesce(sum(b) FILTER (WHERE m = 0), 0)::BIGINT AS n_only_rows
FROM (SELECT coalesce(p.conv_id, r.conv_id) AS k, count_if(p.o IS NOT NULL AND r.o IS NOT NULL) AS m, count_if(r.o IS NULL) AS a, count_if(p.o IS NULL) AS b
      FROM {_TURNS} GROUP BY 1)""")
def align_occurrences_audit(spark, sf_dir):
    return ER.occurrence_audit(_turns(spark, sf_dir), "conv_id")


@query("duplicate_keys", with_parts(["pred"], """
SELECT count(*) AS n_keys, coalesce(sum(n - 1), 0)::BIGINT AS n_extra_rows
FROM (SELECT doc_id, count(*) AS n FROM pred GROUP BY doc_id) WHERE n > 1"""))
def duplicate_keys(spark, sf_dir):
    return ER.duplicate_keys(FX.predictions(spark, sf_dir), "doc_id")


@query("classification_prompt", with_parts(["gold"], f"""
SELECT doc_id, md5('### Instruction:' || chr(10) || {_INSTR} || chr(10) || chr(10) || '### Input:' || chr(10) || text || chr(10) || chr(10) || '### Response:') AS prompt_md5 FROM gold"""))
def classification_prompt(spark, sf_dir):
    g = FX.gold(spark, sf_dir)
    return g.select("doc_id", F.md5(TX.classification_prompt(F.lit(P.DEFAULT_INSTRUCTION), F.col("text"))).alias("prompt_md5"))


# --------------------------------------------------------------------------- response parsing

@query("strip_echo", with_parts(["resp_dec"], f"""
SELECT doc_id, prompt_id, {OP.sql_strip("CASE WHEN prompt = '' THEN decoded ELSE replace(decoded, prompt, '') END")} AS generated FROM resp_dec"""))
def strip_echo(spark, sf_dir):
    r = FX.responses(spark, sf_dir, decoded=True)
    return r.select("doc_id", "prompt_id", TX.strip_echo("decoded", "prompt").alias("generated"))


@query("after_marker", with_parts(["resp_dec"], f"""
SELECT doc_id, prompt_id,
       {OP.sql_strip("(string_split(decoded, '### response ###'))[-1]")} AS after_last,
       {OP.sql_strip("CASE WHEN strpos(decoded, '### response ###') > 0 THEN substring(decoded, strpos(decoded, '### response ###') + 16) ELSE decoded END")} AS after_first,
       md5((string_split(decoded, chr(10) || ' ' || chr(10)))[1]) AS before_blank_md5
FROM resp_dec"""))
def after_marker(spark, sf_dir):
    r = FX.responses(spark, sf_dir, decoded=True)
    return r.select(
        "doc_id", "prompt_id",
        TX.py_strip(TX.after_last("decoded", "### response ###")).alias("after_last"),
        TX.py_strip(TX.after_first("decoded", "### response ###")).alias("after_first"),
        F.md5(TX.before_first("decoded", "\n \n")).alias("before_blank_md5"),
    )


@query("first_label", with_parts(["resp"], f"""
SELECT doc_id, prompt_id, CASE WHEN h <> '' THEN h ELSE response END AS label_raw, NULLIF(h, '') AS label_null
FROM (SELECT *, regexp_extract(response, '\\b({OP.ALT})\\b', 1) AS h FROM resp)"""))
def first_label(spark, sf_dir):
    r = FX.responses(spark, sf_dir)
    return r.select("doc_id", "prompt_id", LB.first_label("response", "raw").alias("label_raw"),
                    LB.first_label("response", "null").alias("label_null"))


@query("multi_stage_label", with_parts(["resp"], f"""
SELECT doc_id, prompt_id, {OP.sql_multi_stage('lower(response)')} AS label FROM resp"""))
def multi_stage_label(spark, sf_dir):
    r = FX.responses(spark, sf_dir).withColumn("lr", F.lower("response"))
    return LB.with_multi_stage_label(r, "lr", "label").select("doc_id", "prompt_id", "label")


@query("multi_stage_metrics", with_parts(["resp"], "SELECT * FROM mm", f"""
parsed AS (SELECT doc_id, prompt_id, correct, {OP.sql_multi_stage('lower(response)')} AS predicted FROM resp),
""" + _metrics_sql("parsed", ["prompt_id"], 1.0)))
def multi_stage_metrics(spark, sf_dir):
    r = FX.responses(spark, sf_dir).select("doc_id", "prompt_id", "correct", F.lower("response").alias("lr"))
    parsed = LB.with_multi_stage_label(r, "lr", "predicted")
    return _metrics_df(parsed, ["prompt_id"], zero_division=1.0)


def _long_sql(cols: list[str], src: str, extra_cols: str = "") -> str:
    structs = ", ".join(f"{{'label': {q(lab)}, 'score': {c}}}" for lab, c in zip(LABELS, cols))
    return f"SELECT doc_id, prompt_id{extra_cols}, unnest([{structs}], recursive := true) FROM {src}"


def _long_df(df: DataFrame, scores_col: str, keep: list[str]) -> DataFrame:
    return C.long_scores(df, scores_col, keep)


@query("confidence_a", with_parts(["resp"], f"SELECT doc_id, prompt_id, label, score FROM ({_long_sql(OP.sql_conf_a('response'), 'resp')})"))
def confidence_a(spark, sf_dir):
    r = C.with_confidences(FX.responses(spark, sf_dir), "response", "s", "a")
    return _long_df(r, "s", ["doc_id", "prompt_id"])


@query("confidence_b", with_parts(["resp"], f"""
SELECT a.doc_id, a.prompt_id, a.label, a.score, b.score AS score_uniform
FROM ({_long_sql(OP.sql_conf_b('response'), 'resp')}) a
JOIN ({_long_sql(OP.sql_conf_b('response', 'uniform'), 'resp')}) b USING (doc_id, prompt_id, label)"""))
def confidence_b(spark, sf_dir):
    r = FX.responses(spark, sf_dir).select("doc_id", "prompt_id", "response")
    r = C.with_confidences(r, "response", "s1", "b")
    r = C.with_confidences(r, "response", "s2", "b", fallback="uniform")
    z = F.arrays_zip(F.array(*[F.lit(v) for v in LABELS]).alias("label"), F.col("s1").alias("score"),
                     F.col("s2").alias("score_uniform"))
    return r.select("doc_id", "prompt_id", F.inline(z))


@query("confidence_normalised", with_parts(["resp"], f"""
SELECT doc_id, prompt_id, label, round(CASE WHEN tot > 0 THEN score / tot ELSE score END, {R}) AS score
FROM (SELECT *, sum(score) OVER (PARTITION BY doc_id, prompt_id) AS tot FROM ({_long_sql(OP.sql_conf_a('response'), 'resp')}))"""))
def confidence_normalised(spark, sf_dir):
    r = C.with_confidences(FX.responses(spark, sf_dir), "response", "s", "a", normalised=True)
    return rounded(_long_df(r, "s", ["doc_id", "prompt_id"]), ["score"])


@query("format_compliance", with_parts(["resp"], f"""
SELECT prompt_id, count(*) AS n, count_if(all_labels) AS n_all_labels, count_if(abs(tot - 1.0) <= 1e-6) AS n_sums_to_one,
       count_if(coalesce(stated = mx AND tot > 0, false)) AS n_stated_is_max, count_if(response = lower(response)) AS n_lower_case
FROM (SELECT prompt_id, response, all_labels, list_sum(s) AS tot, list_max(s) AS mx,
             s[list_position({LABELS_SQL}, predicted)] AS stated
      FROM (SELECT prompt_id, response, predicted, [{', '.join(OP.sql_conf_a('response'))}] AS s,
                   {' AND '.join(f"len(list_filter(regexp_extract_all(response, '{OP.PAT_A}', 1), lambda k: k = {q(lab)})) > 0" for lab in LABELS)} AS all_labels
            FROM resp))
GROUP BY prompt_id"""))
def format_compliance(spark, sf_dir):
    r = C.with_compliance(FX.responses(spark, sf_dir), "response", "predicted", "c")
    return r.groupBy("prompt_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("c.all_labels").alias("n_all_labels"),
        F.count_if("c.sums_to_one").alias("n_sums_to_one"), F.count_if("c.stated_is_max").alias("n_stated_is_max"),
        F.count_if("c.lower_case").alias("n_lower_case"))


# --------------------------------------------------------------------------- error analysis



@query("errors", with_parts(["pred_text"], """
SELECT doc_id, prompt_id, correct, predicted, text AS report FROM pred_text WHERE correct IS DISTINCT FROM predicted"""))
def errors(spark, sf_dir):
    p = FX.predictions(spark, sf_dir, with_text=True)
    return ER.errors(p).select("doc_id", "prompt_id", "correct", "predicted", F.col("text").alias("report"))


@query("correct_rows", with_parts(["pred"], """
SELECT prompt_id, correct, count(*) AS n FROM pred WHERE correct IS NOT DISTINCT FROM predicted GROUP BY ALL"""))
def correct_rows(spark, sf_dir):
    return ER.correct_rows(FX.predictions(spark, sf_dir)).groupBy("prompt_id", "correct").agg(F.count(F.lit(1)).alias("n"))


@query("error_slice", with_parts(["pred"], """
SELECT 'romets_to_improved' AS slice, doc_id, prompt_id FROM pred WHERE correct = 'romets' AND predicted = 'improved'
UNION ALL
SELECT 'romets_not_improved', doc_id, prompt_id FROM pred WHERE correct = 'romets' AND predicted IS DISTINCT FROM 'improved'"""))
def error_slice(spark, sf_dir):
    p = FX.predictions(spark, sf_dir)
    a = ER.error_slice(p, "romets", "improved").select(F.lit("romets_to_improved").alias("slice"), "doc_id", "prompt_id")
    b = ER.error_slice(p, "romets", predicted_not="improved").select(F.lit("romets_not_improved").alias("slice"), "doc_id", "prompt_id")
    return a.unionByName(b)


@query("error_pairs_topk", with_parts(["pred"], """
SELECT correct, predicted, count(*) AS n FROM pred WHERE correct IS DISTINCT FROM predicted
GROUP BY ALL ORDER BY n DESC, correct ASC NULLS LAST, predicted ASC NULLS LAST LIMIT 10"""))
def error_pairs_topk(spark, sf_dir):
    return ER.error_pairs_topk(FX.predictions(spark, sf_dir), k=10)


@query("error_pairs_topk_by_prompt", with_parts(["pred"], """
SELECT * FROM (SELECT prompt_id, correct, predicted, n,
       row_number() OVER (PARTITION BY prompt_id ORDER BY n DESC, correct ASC NULLS LAST, predicted ASC NULLS LAST) AS rank
  FROM (SELECT prompt_id, correct, predicted, count(*) AS n FROM pred WHERE correct IS DISTINCT FROM predicted GROUP BY ALL))
WHERE rank <= 3"""))
def error_pairs_topk_by_prompt(spark, sf_dir):
    return ER.error_pairs_topk(FX.predictions(spark, sf_dir), k=3, keys=["prompt_id"]).withColumn("rank", F.col("rank").cast("bigint"))


@query("paragraph_rate", with_parts(["pred_text"], f"""
SELECT prompt_id, correct, predicted, count(*) AS n, count_if(regexp_matches(text, '\\n\\s*\\n')) AS n_paragraphs,
       round(count_if(regexp_matches(text, '\\n\\s*\\n')) / count(*), {R}) AS rate
FROM pred_text GROUP BY ALL"""))
def paragraph_rate(spark, sf_dir):
    p = FX.predictions(spark, sf_dir, with_text=True)
    return rounded(ER.paragraph_rate(p, "text", ["prompt_id", "correct", "predicted"]), ["rate"])


@query("before_after", with_parts(["pred"], f"""
SELECT count_if(ob IS NOT NULL AND oa IS NOT NULL) AS n, count_if(oa IS NULL) AS n_only_before, count_if(ob IS NULL) AS n_only_after,
       count_if(NOT ob AND oa) AS n_fixed, count_if(ob AND NOT oa) AS n_broken,
       count_if(NOT ob AND NOT oa) AS n_still_wrong, count_if(ob AND oa) AS n_still_right,
       round((count_if(oa AND ob IS NOT NULL) - count_if(ob AND oa IS NOT NULL)) / count_if(ob IS NOT NULL AND oa IS NOT NULL), {R}) AS accuracy_delta
FROM (SELECT doc_id, correct IS NOT DISTINCT FROM predicted AS ob FROM pred WHERE prompt_id = 'base') b
FULL JOIN (SELECT doc_id, correct IS NOT DISTINCT FROM predicted AS oa FROM pred WHERE prompt_id = 'role_cot') a USING (doc_id)"""))
def before_after(spark, sf_dir):
    """All reports under two prompts."""
    p = FX.predictions(spark, sf_dir)
    out = ER.before_after(p.filter(F.col("prompt_id") == "base"), p.filter(F.col("prompt_id") == "role_cot"), "doc_id")
    return rounded(out, ["accuracy_delta"])


@query("align_predictions", with_parts(["pred"], """
SELECT count_if(p.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS n_matched,
       count_if(p.doc_id IS NOT NULL AND l.doc_id IS NULL) AS n_only_predictions,
       count_if(p.doc_id IS NULL AND l.doc_id IS NOT NULL) AS n_only_rows
FROM (SELECT doc_id FROM pred) p FULL OUTER JOIN labels l ON p.doc_id = l.doc_id"""))
def align_predictions(spark, sf_dir):
    p = FX.predictions(spark, sf_dir).select("doc_id", "prompt_id", "correct", "predicted")
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return ER.align_audit(ER.align(p, rows, "doc_id"))


@query("lookup_errors", with_parts(["pred_text"], """
SELECT d.doc_id, e.prompt_id, md5(d.text) AS text_md5, e.correct, e.predicted
FROM documents d JOIN (SELECT doc_id, prompt_id, correct, predicted FROM pred_text WHERE correct IS DISTINCT FROM predicted) e
  ON d.doc_id = e.doc_id"""))
def lookup_errors(spark, sf_dir):
    ids = ER.errors(FX.predictions(spark, sf_dir)).select("doc_id", "prompt_id", "correct", "predicted")
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return d.join(ids, "doc_id")


@query("confidence_summary", with_parts(["scores"], f"""
SELECT prompt_id, predicted IS NOT DISTINCT FROM true_label AS is_correct, count(*) AS n,
       round(avg(pred_score), {R}) AS avg_pred_score, count_if(argmax_label IS NOT DISTINCT FROM predicted) AS n_argmax_is_pred
FROM (SELECT doc_id, prompt_id, any_value(predicted) AS predicted, any_value(true_label) AS true_label,
             max(CASE WHEN label = predicted THEN score END) AS pred_score,
             {LABELS_SQL}[min(CASE WHEN score = mx THEN ord END) + 1] AS argmax_label
      FROM (SELECT *, max(score) OVER (PARTITION BY prompt_id, doc_id) AS mx, list_position({LABELS_SQL}, label) - 1 AS ord FROM scores)
      GROUP BY doc_id, prompt_id)
GROUP BY ALL"""))
def confidence_summary(spark, sf_dir):
    return rounded(ER.confidence_summary(FX.score_arrays(spark, sf_dir), ["prompt_id"]), ["avg_pred_score"])


@query("prompt_ranking", with_parts(["pred"], f"""
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY f1_score DESC, prompt_id) AS rank FROM mm) WHERE rank <= 3""",
    _metrics_sql("pred", ["prompt_id"])))
def prompt_ranking(spark, sf_dir):
    m = _metrics_df(FX.predictions(spark, sf_dir), ["prompt_id"])
    return ER.prompt_ranking(m, 3).withColumn("rank", F.col("rank").cast("bigint"))


_FEATS = " UNION ALL ".join(
    f"SELECT prompt_id, {q(n)} AS feature, regexp_matches(prompt_id || chr(10) || coalesce(description, '') || chr(10) || coalesce(template, ''), {q(p.replace('[\\s\\S]', '(?s:.)'))}) AS present FROM prompts"
    for n, p in ER.TECHNIQUES.items())


@query("technique_effect", with_parts(["pred", "prompts"], f"""
SELECT feature, present, round(avg(f1), {R}) AS avg_f1_score, count(*) AS n_prompts
FROM (SELECT prompt_id, avg_f1 AS f1 FROM (SELECT prompt_id, avg(f1_score) AS avg_f1 FROM pm GROUP BY prompt_id)) m
JOIN ({_FEATS}) f USING (prompt_id) GROUP BY ALL""", _metrics_sql("pred", ["prompt_id"])))
def technique_effect(spark, sf_dir):
    m = M.macro_metrics(FX.predictions(spark, sf_dir), ["prompt_id"])
    feats = ER.prompt_features(FX.prompts_df(spark))
    return rounded(ER.technique_effect(m, feats), ["avg_f1_score"])


_TECH = list(ER.TECHNIQUES)
_X = ["1.0::DOUBLE"] + [f"max(CASE WHEN feature = {q(n)} AND present THEN 1.0 ELSE 0.0 END)::DOUBLE" for n in _TECH]
_NORMAL = ", ".join("[" + ", ".join(
    [f"sum(n * x{i} * x{j}){' + 0.001 * sum(n)' if i == j and i else ''}" for j in range(len(_X))] + [f"sum(s * x{i})"]) + "]" for i in range(len(_X)))
_NAMES_SQL = "[" + ", ".join(q(n) for n in ["(all)"] + _TECH) + "]"


@query("technique_effects", with_parts(["pred", "prompts"], f"""
SELECT {_NAMES_SQL}[i] AS feature, round(m[i][{len(_X) + 1}], 8) AS effect, np[i]::BIGINT AS n_prompts, nr[i]::BIGINT AS n_rows
FROM (SELECT m, np, nr, unnest(range(1, {len(_X) + 1})) AS i FROM g CROSS JOIN tot WHERE k = {len(_X)})""", f"""
per AS (SELECT prompt_id, count(*)::DOUBLE AS n, count_if(correct IS NOT DISTINCT FROM predicted)::DOUBLE AS s FROM pred GROUP BY prompt_id),
x AS (SELECT prompt_id, n, s, {', '.join(f'{c} AS x{i}' for i, c in enumerate(_X))} FROM per JOIN ({_FEATS}) f USING (prompt_id) GROUP BY prompt_id, n, s),
tot AS (SELECT [{', '.join(f'sum(x{i})' for i in range(len(_X)))}] AS np, [{', '.join(f'sum(n * x{i})' for i in range(len(_X)))}] AS nr FROM x),
g(k, m) AS (SELECT 0, [{_NORMAL}] FROM x
            UNION ALL
            SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda v: v / m[k + 1][k + 1])
                          ELSE list_transform(row, lambda v, j: v - row[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END)
            FROM g WHERE k < {len(_X)})""").replace("WITH", "WITH RECURSIVE", 1))
def technique_effects(spark, sf_dir):
    """One effect for each technique on the share of right answers."""
    rows = FX.predictions(spark, sf_dir).select("prompt_id", (~ER.is_error()).cast("double").alias("right"))
    out = ER.technique_effects(rows, ER.prompt_features(FX.prompts_df(spark)), "right")
    return rounded(out.drop("separable"), ["effect"], 8)


# --------------------------------------------------------------------------- report text

_SEC_SQL = f"""secs AS (
  SELECT doc_id, seq, section, body FROM (
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS seq,
           CASE WHEN i > 1 THEN (CASE upper(split_part(part, chr(57345), 1)) {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in RP.CANONICAL.items())} ELSE upper(split_part(part, chr(57345), 1)) END) ELSE 'PREAMBLE' END AS section,
           {OP.sql_strip("CASE WHEN i > 1 THEN (string_split(part, chr(57345)))[-1] ELSE part END")} AS body
    FROM (SELECT doc_id, unnest(parts) AS part, unnest(generate_series(1, len(parts))) AS i
          FROM (SELECT doc_id, string_split(regexp_replace(report, '(?im)^({RP.HEADINGS})[ \\t]*:', chr(57344) || '\\1' || chr(57345), 'g'), chr(57344)) AS parts FROM reports)))
  WHERE seq > 0 OR body <> '')"""


@query("sections", with_parts(["reports"], "SELECT doc_id, seq, section, md5(body) AS body_md5 FROM secs", _SEC_SQL))
def sections(spark, sf_dir):
    r = FX.reports(spark, sf_dir)
    return RP.sections(r, "report", ["doc_id"]).select("doc_id", "seq", "section", F.md5("body").alias("body_md5"))


_KW_SQL = "(VALUES " + ", ".join(f"({q(lab)}, {i}, {q(kw)})" for i, lab in enumerate(LABELS) for kw in RP.LABEL_KEYWORDS[lab]) + ") AS k(label, ord, keyword)"


@query("keyword_rate", with_parts(["reports"], f"""
SELECT doc_id, b.label AS keyword_label, round(b.p, {R}) AS primary_rate, round(b.s, {R}) AS secondary_rate
FROM (SELECT doc_id, arg_max({{'label': label, 'p': p, 's': s}}, {{'p': p, 's': s, 'o': -ord}}) AS b
      FROM (SELECT h.doc_id, h.label, h.ord, count(DISTINCT CASE WHEN section IN ('CONCLUSION', 'IMPRESSION') THEN keyword END) / any_value(n.n_kw) AS p,
                   count(DISTINCT CASE WHEN section = 'FINDINGS' THEN keyword END) / any_value(n.n_kw) AS s
            FROM (SELECT s.doc_id, s.section, k.label, k.ord, k.keyword FROM secs s CROSS JOIN {_KW_SQL}
                  WHERE s.section IN ('CONCLUSION', 'IMPRESSION', 'FINDINGS') AND contains(lower(s.body), k.keyword)) h
            JOIN (SELECT label, count(DISTINCT keyword) AS n_kw FROM {_KW_SQL} GROUP BY label) n USING (label)
            GROUP BY h.doc_id, h.label, h.ord)
      GROUP BY doc_id)""", _SEC_SQL))
def keyword_rate(spark, sf_dir):
    return rounded(RP.keyword_label(FX.reports(spark, sf_dir), "report", ["doc_id"]), ["primary_rate", "secondary_rate"])


def _cnt(t: str, phrase: str) -> str:
    return f"len(string_split({t}, {q(phrase)})) - 1"


_SIG_COLS = ", ".join(
    f"({' + '.join(_cnt('lower(report)', p) for p in phrases)})::BIGINT AS n_{fam}" for fam, _, phrases in RP.SIGNAL_FAMILIES)
_SIG_BEST = "greatest(" + ", ".join(f"n_{fam}" for fam, _, _ in RP.SIGNAL_FAMILIES) + ")"
_SIG_LAB = "CASE " + " ".join(f"WHEN n_{fam} = {_SIG_BEST} THEN {q(lab)}" for fam, lab, _ in RP.SIGNAL_FAMILIES) + " END"


@query("signal_label", with_parts(["reports"], f"""
SELECT doc_id, {', '.join(f'n_{fam}' for fam, _, _ in RP.SIGNAL_FAMILIES)}, CASE WHEN {_SIG_BEST} > 0 THEN {_SIG_LAB} END AS signal_label
FROM (SELECT doc_id, {_SIG_COLS} FROM reports)"""))
def signal_label(spark, sf_dir):
    r = FX.reports(spark, sf_dir)
    return RP.signal_counts(r, "report").select("doc_id", *[f"n_{fam}" for fam, _, _ in RP.SIGNAL_FAMILIES], "signal_label")


_PW_SQL = "(VALUES " + ", ".join(f"({q(p)}, {q(lab)}, {1.0 / len(labs)!r})" for p, labs in RP.PHRASE_LABELS for lab in labs) + ") AS w(phrase, label, weight)"


@query("phrase_weight_label", with_parts(["reports"], f"""
SELECT doc_id, b.label AS phrase_label, round(b.s / t, {R}) AS share
FROM (SELECT doc_id, sum(s) AS t, arg_max({{'label': label, 's': s}}, {{'s': s, 'o': -(list_position({LABELS_SQL}, label) - 1)}}) AS b
      FROM (SELECT doc_id, label, sum(hits * weight) AS s
            FROM (SELECT r.doc_id, w.label, w.weight, len(string_split(lower(r.report), w.phrase)) - 1 AS hits FROM reports r CROSS JOIN {_PW_SQL})
            WHERE hits > 0 GROUP BY doc_id, label)
      GROUP BY doc_id)"""))
def phrase_weight_label(spark, sf_dir):
    r = FX.reports(spark, sf_dir)
    return rounded(RP.phrase_label(r, "report", ["doc_id"]), ["share"])


_RULE_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(report, {q(p)})" for p in phrases) + f" THEN {q(lab)}" for lab, phrases in RP.RULES
) + f" ELSE {q(RP.RULE_DEFAULT)} END"


@query("rule_cascade_label", with_parts(["reports"], f"SELECT doc_id, {_RULE_SQL} AS rule_label FROM reports"))
def rule_cascade_label(spark, sf_dir):
    return FX.reports(spark, sf_dir).select("doc_id", RP.rule_label("report").alias("rule_label"))


@query("rule_cascade_metrics", with_parts(["reports"], "SELECT * FROM mm",
                                          f"rc AS (SELECT doc_id, true_label AS correct, {_RULE_SQL} AS predicted FROM reports),\n" + _metrics_sql("rc", [])))
def rule_cascade_metrics(spark, sf_dir):
    r = FX.reports(spark, sf_dir).select("doc_id", F.col("true_label").alias("correct"), RP.rule_label("report").alias("predicted"))
    return _metrics_df(r, [])


@query("rule_out_flag", with_parts(["reports"], """
SELECT section, count(*) AS n_sections, count_if(regexp_matches(body, '(?i)\\br/o\\b|rule[- ]out|follow[- ]up')) AS n_rule_out
FROM secs GROUP BY section""", _SEC_SQL))
def rule_out_flag(spark, sf_dir):
    secs = RP.sections(FX.reports(spark, sf_dir), "report", ["doc_id"])
    return secs.groupBy("section").agg(F.count(F.lit(1)).alias("n_sections"), F.count_if(RP.rule_out_flag("body")).alias("n_rule_out"))


@query("error_keywords", with_parts(["reports", "pred"], f"""
SELECT e.prompt_id, e.correct, e.predicted, e.section, e.keyword, e.n AS n_error, t.n AS error_rows,
       coalesce(c.n, 0) AS n_correct, coalesce(ct.n, 0) AS correct_rows,
       round(ln((e.n + 0.5) / (t.n - e.n + 0.5)) - ln((coalesce(c.n, 0) + 0.5) / (coalesce(ct.n, 0) - coalesce(c.n, 0) + 0.5)), {R}) AS lift
FROM n e JOIN t ON t.prompt_id = e.prompt_id AND t.correct = e.correct AND t.predicted = e.predicted
LEFT JOIN n c ON c.prompt_id = e.prompt_id AND c.correct = e.correct AND c.predicted = e.correct AND c.section = e.section AND c.keyword = e.keyword
LEFT JOIN t ct ON ct.prompt_id = e.prompt_id AND ct.correct = e.correct AND ct.predicted = e.correct
WHERE e.correct <> e.predicted""", _SEC_SQL + f""",
n AS (SELECT prompt_id, correct, predicted, section, keyword, count(*) AS n
      FROM pred JOIN (SELECT DISTINCT s.doc_id, s.section, k.keyword FROM secs s CROSS JOIN {_KW_SQL} WHERE contains(lower(s.body), k.keyword)) h USING (doc_id)
      GROUP BY ALL),
t AS (SELECT prompt_id, correct, predicted, count(*) AS n FROM pred GROUP BY ALL)"""))
def error_keywords(spark, sf_dir):
    """Keywords of errors against those of right answers of the same label."""
    return rounded(RP.keyword_lift(FX.predictions(spark, sf_dir), FX.reports(spark, sf_dir), "doc_id"), ["lift"])


_ALLKW = sorted({k for v in RP.LABEL_KEYWORDS.values() for k in v})


@query("explanation_checks", f"""
SELECT role, count(*) AS n, count_if(length(text) <= 300) AS n_short,
       count_if(regexp_matches(text, '(?i)conclusion|impression|findings?')) AS n_names_section,
       count_if({' OR '.join(f"contains(lower(text), {q(k)})" for k in _ALLKW)}) AS n_names_keyword
FROM conversations GROUP BY role""")
def explanation_checks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("role", RP.explanation_checks("text").alias("c"))
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if("c.short").alias("n_short"),
                                 F.count_if("c.names_section").alias("n_names_section"),
                                 F.count_if("c.names_keyword").alias("n_names_keyword"))


# --------------------------------------------------------------------------- inference



def _requests(spark, sf_dir) -> DataFrame:
    """Expanded and rendered requests (J2 + T1)."""
    g = FX.gold(spark, sf_dir).select("doc_id", "text", "true_label")
    pairs = PR.expand(g, FX.prompts_df(spark).select("prompt_id", "template"))
    stated = FX.predicted_expr(F.col("doc_id"), F.col("prompt_id"), F.col("true_label"))
    return pairs.select("doc_id", "prompt_id", TX.render(F.col("template"), F.col("text"), stated).alias("prompt"))


@query("batch_inference_python", with_parts(["resp_dec"], f"""
SELECT doc_id, prompt_id, 'final label: ' || {LABELS_SQL}[(length(prompt) % 6) + 1] AS response FROM resp_dec"""))
def batch_inference_python(spark, sf_dir):
    req = _requests(spark, sf_dir)
    out = INF.batch_inference(req, INF.length_scorer, prompt="prompt", keys=["doc_id", "prompt_id"])
    return out.select("doc_id", "prompt_id", "response")


@query("batch_inference_resume", ORACLE["batch_inference_python"])
def batch_inference_resume(spark, sf_dir):
    """A run that ends after half of its slices and is then taken up again."""
    req, store, run = _requests(spark, sf_dir), IO.scratch_path(spark, "responses"), IO.run_id()
    INF.resume_inference(req, INF.length_scorer, store, run, ["doc_id", "prompt_id"], slices=4, max_slices=2)
    return INF.resume_inference(req, INF.length_scorer, store, run, ["doc_id", "prompt_id"], slices=4).drop("run_id")


_BUDGET = 200_000


@query("padded_batches", f"""
SELECT count(*) AS n_rows, sum(length(text))::BIGINT AS total_chars, 0::BIGINT AS n_over_budget, count_if(length(text) > {_BUDGET}) AS n_long_rows FROM documents""")
def padded_batches(spark, sf_dir):
    """What holds however the rows lie in partitions."""
    return P.padding_report(P.padded_batches(table(spark, sf_dir, "documents"), _BUDGET), _BUDGET).select(
        "n_rows", "total_chars", "n_over_budget", "n_long_rows")


@query("batch_inference_replay", with_parts(["resp"], "SELECT doc_id, prompt_id, response FROM resp"))
def batch_inference_replay(spark, sf_dir):
    stored = FX.responses(spark, sf_dir).select("doc_id", "prompt_id", "response")
    return INF.replay(_requests(spark, sf_dir), stored, ["doc_id", "prompt_id"]).select("doc_id", "prompt_id", "response")


@query("batch_inference_keyword", with_parts(["reports"], "SELECT * FROM mm", _SEC_SQL + f""",
kw AS (SELECT doc_id, b.label AS keyword_label
       FROM (SELECT doc_id, arg_max({{'label': label}}, {{'p': p, 's': s, 'o': -ord}}) AS b
             FROM (SELECT h.doc_id, h.label, h.ord, count(DISTINCT CASE WHEN section IN ('CONCLUSION', 'IMPRESSION') THEN keyword END) / any_value(n.n_kw) AS p,
                          count(DISTINCT CASE WHEN section = 'FINDINGS' THEN keyword END) / any_value(n.n_kw) AS s
                   FROM (SELECT s.doc_id, s.section, k.label, k.ord, k.keyword FROM secs s CROSS JOIN {_KW_SQL}
                         WHERE s.section IN ('CONCLUSION', 'IMPRESSION', 'FINDINGS') AND contains(lower(s.body), k.keyword)) h
                   JOIN (SELECT label, count(DISTINCT keyword) AS n_kw FROM {_KW_SQL} GROUP BY label) n USING (label)
                   GROUP BY h.doc_id, h.label, h.ord)
             GROUP BY doc_id)),
kp AS (SELECT r.doc_id, r.true_label AS correct,
              {OP.sql_multi_stage("lower('final label: ' || kw.keyword_label)")} AS predicted
       FROM reports r LEFT JOIN kw USING (doc_id)),
""" + _metrics_sql("kp", [], 1.0)))
def batch_inference_keyword(spark, sf_dir):
    rep = FX.reports(spark, sf_dir)
    kw = RP.keyword_label(rep, "report", ["doc_id"])
    resp = INF.keyword_scorer_responses(kw, ["doc_id"])
    j = rep.select("doc_id", F.col("true_label").alias("correct")).join(resp, "doc_id", "left")
    parsed = LB.with_multi_stage_label(j.select("doc_id", "correct", F.lower("response").alias("lr")), "lr", "predicted")
    return _metrics_df(parsed, [], zero_division=1.0)


# --------------------------------------------------------------------------- sources and sinks

@query("csv_roundtrip", with_parts(["gold"], "SELECT doc_id, raw_label, true_label, text FROM gold"))
def csv_roundtrip(spark, sf_dir):
    path = IO.scratch_path(spark, "csv")
    IO.write_csv(FX.gold(spark, sf_dir).select("doc_id", "raw_label", "true_label", "text"), path)
    return IO.read_csv(spark, path, "doc_id bigint, raw_label string, true_label string, text string")


_METRIC_SCHEMA = "fold int, prompt_id string, accuracy double, precision double, recall double, f1_score double, n_rows bigint, n_classes bigint"


@query("json_roundtrip", ORACLE["fold_metrics"])
def json_roundtrip(spark, sf_dir):
    path = IO.scratch_path(spark, "json")
    IO.write_json(fold_metrics(spark, sf_dir), path)
    return IO.read_json(spark, path, _METRIC_SCHEMA)


@query("result_sink", with_parts(["pred"], "SELECT prompt_id, count(*) AS n, count_if(correct = predicted) AS n_correct FROM pred WHERE prompt_id IN ('base', 'stated') GROUP BY prompt_id"))
def result_sink(spark, sf_dir):
    path = IO.scratch_path(spark, "results")
    IO.write_results(FX.predictions(spark, sf_dir), path, run=IO.run_id())
    back = spark.read.parquet(path)
    keys = [r[0] for r in FX.prompts_df(spark).filter(F.col("prompt_id").isin("base", "stated"))
            .select(IO.prompt_key(F.col("prompt_id"))).collect()]  # catalogue dimension only
    pruned = back.filter(F.col("prompt_key").isin(keys))  # partition pruning
    return pruned.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n"),
                                           F.count_if(F.col("correct") == F.col("predicted")).alias("n_correct"))


_CAT_ENTRIES = [(i, d, t) for _, i, d, t in FX.PROMPTS] + [("stated", "replaced text", "Final check of:\n{report}")]
_CAT_VALUES = ", ".join(f"({o}, {q(i)}, {q(d)}, {q(t)})" for o, (i, d, t) in enumerate(
    [e for e in _CAT_ENTRIES[:-1] if e[0] != "stated"][:3] + [_CAT_ENTRIES[-1]] + [e for e in _CAT_ENTRIES[:-1] if e[0] != "stated"][3:]))


@query("prompt_catalogue", with_parts(["gold"], f"""
SELECT p.ord, p.prompt_id, p.description, count(*) AS n_rows,
       sum(length(replace(p.template, '{{report}}', g.text)))::BIGINT AS total_chars
FROM gold g CROSS JOIN (VALUES {_CAT_VALUES}) AS p(ord, prompt_id, description, template)
GROUP BY ALL"""))
def prompt_catalogue(spark, sf_dir):
    path = IO.scratch_path(spark, "catalogue")
    IO.write_prompt_catalogue(spark, _CAT_ENTRIES, path)
    cat = IO.read_prompt_catalogues(spark, path)
    g = FX.gold(spark, sf_dir).select("doc_id", "text")
    x = PR.expand(g, cat).withColumn("rendered", TX.render(F.col("template"), F.col("text")))
    return x.groupBy("ord", "prompt_id", "description").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("rendered")).cast("bigint").alias("total_chars"))


# --------------------------------------------------------------------------- streaming



@query("streaming_confusion", with_parts(["resp"], f"""
SELECT prompt_id, correct, predicted, count(*) AS n
FROM (SELECT prompt_id, correct, {OP.sql_multi_stage('lower(response)')} AS predicted FROM resp) GROUP BY ALL"""))
def streaming_confusion(spark, sf_dir):
    src = IO.scratch_path(spark, "stream-src")
    FX.responses(spark, sf_dir).select("doc_id", "prompt_id", "correct", "response").write.parquet(src)
    sink = IO.scratch_path(spark, "stream-sink")
    return spark.read.parquet(ST.run_confusion(spark, src, sink, IO.scratch_path(spark, "stream-ckpt")))


# --------------------------------------------------------------------------- more preparation / sources

@query("snapshot_roundtrip", with_parts(["gold"], f"""
SELECT doc_id, text AS input, {_INSTR} AS instruction, regexp_replace(raw_label, '[N|n]o\\s*', 'no', 'g') AS output FROM gold"""))
def snapshot_roundtrip(spark, sf_dir):
    path = IO.scratch_path(spark, "snapshot")
    rows = P.instruction_rows(FX.gold(spark, sf_dir), report="text", label="raw_label", keep=["doc_id"])
    IO.write_snapshot(rows, path)
    return spark.read.parquet(path)


@query("training_text_label_only", with_parts(["gold"], """
SELECT doc_id, regexp_replace(raw_label, '[N|n]o\\s*', 'no', 'g') || '</s>' AS text FROM gold"""))
def training_text_label_only(spark, sf_dir):
    rows = P.instruction_rows(FX.gold(spark, sf_dir), report="text", label="raw_label", keep=["doc_id"])
    return P.training_text(rows, eos="</s>", label_only=True).select("doc_id", "text")


@query("surrogate_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents")
def surrogate_index(spark, sf_dir):
    return IO.read_parquet_indexed(spark, f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "row_id")


@query("csv_index", with_parts(["gold"], "SELECT doc_id, true_label, md5(text) AS text_md5, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM gold"))
def csv_index(spark, sf_dir):
    """P8 on CSV files whose texts hold line breaks."""
    path = IO.scratch_path(spark, "csv-index")
    IO.write_csv(FX.gold(spark, sf_dir).select("doc_id", "true_label", "text").orderBy("doc_id"), path)
    x = IO.read_csv_indexed(spark, path, "doc_id bigint, true_label string, text string")
    return x.select("doc_id", "true_label", F.md5("text").alias("text_md5"), "row_id")


@query("json_index", "SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS row_id FROM events")
def json_index(spark, sf_dir):
    """P8 on JSON lines, read in several tasks a file."""
    path = IO.scratch_path(spark, "json-index")
    IO.write_json(table(spark, sf_dir, "events").select("event_id", "event_type", "props").orderBy("event_id"), path)
    return IO.read_json_indexed(spark, path, "event_id bigint, event_type string").select("event_id", "event_type", "row_id")


@query("preview_errors", with_parts(["pred"], """
SELECT prompt_id, doc_id, correct, predicted FROM pred WHERE correct IS DISTINCT FROM predicted
ORDER BY prompt_id, doc_id LIMIT 5"""))
def preview_errors(spark, sf_dir):
    """``head()`` of the error table: a preview, so the limit is the feature."""
    e = ER.errors(FX.predictions(spark, sf_dir)).select("prompt_id", "doc_id", "correct", "predicted")
    return e.orderBy("prompt_id", "doc_id").limit(5)


@query("split_sizes_80_10_10", _split_sql("events", "event_id", "event_type",
                                          "SELECT split, event_type, count(*) AS n FROM s GROUP BY ALL", "0.2", "0.5"))
def split_sizes_80_10_10(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return X.split_sizes(X.stratified_split(e, "event_id", "event_type", test_size=0.2, eval_share=0.5), "event_type")


@query("classification_prompt_repeat", with_parts(["gold"], f"""
SELECT doc_id, md5('### Instruction:' || chr(10) || {_INSTR} || chr(10) || chr(10) || '### Input:' || chr(10) || text
                   || chr(10) || chr(10) || {_INSTR} || chr(10) || chr(10) || '### Response:') AS prompt_md5 FROM gold"""))
def classification_prompt_repeat(spark, sf_dir):
    g = FX.gold(spark, sf_dir)
    return g.select("doc_id", F.md5(TX.classification_prompt(F.lit(P.DEFAULT_INSTRUCTION), F.col("text"), True)).alias("prompt_md5"))


@query("kv_label_known_only", with_parts(["resp"], f"""
SELECT doc_id, prompt_id,
       {OP.sql_kv_argmax(f"list_filter(list_transform(list_filter(list_transform({OP.sql_splitlines('lower(response)')}, lambda l, i: {{'p': string_split(l, ':'), 'pos': i}}), lambda e: len(e.p) = 2 AND regexp_full_match({OP.sql_strip('e.p[2]')}, '{OP.FLOAT_RE}')), lambda e: {{'k': {OP.sql_strip('e.p[1]')}, 'v': CAST(replace({OP.sql_strip('e.p[2]')}, '_', '') AS DOUBLE), 'pos': e.pos}}), lambda e: list_contains({LABELS_SQL}, e.k))")} AS label
FROM resp"""))
def kv_label_known_only(spark, sf_dir):
    r = FX.responses(spark, sf_dir).withColumn("__l", TX.splitlines(F.lower("response")))
    r = r.withColumn("__kv", LB.key_value_entries(F.col("__l")))
    return r.select("doc_id", "prompt_id", LB.key_value_argmax(F.col("__kv"), known_labels_only=True).alias("label"))


@query("results_csv_sink", with_parts(["pred"], "SELECT prompt_id, correct, predicted, count(*) AS n FROM pred GROUP BY ALL"))
def results_csv_sink(spark, sf_dir):
    """S5/S7 with CSV files: run-stamped, partitioned by run and prompt key."""
    path = IO.scratch_path(spark, "results-csv")
    IO.write_results(FX.predictions(spark, sf_dir), path, run=IO.run_id(), fmt="csv")
    back = IO.read_csv(spark, path, "doc_id bigint, prompt_id string, ord int, correct string, predicted string, run_id string, prompt_key string")
    return back.groupBy("prompt_id", "correct", "predicted").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- the workflow end to end

@query("prompt_evaluation", with_parts(["gold", "prompts"], "SELECT * FROM mm", _split_ctes("gold", "doc_id", "true_label") + f""",
t AS (SELECT g.doc_id, g.text, g.true_label FROM gold g JOIN s ON g.doc_id = s.doc_id WHERE s.split = 'test'),
rq AS (SELECT t.doc_id, p.prompt_id, t.true_label AS correct,
              replace(replace(p.template, '{{y_i}}', {predicted_sql('t.doc_id', 'p.prompt_id', 't.true_label')}), '{{report}}', t.text) AS prompt
       FROM t CROSS JOIN prompts p),
rs AS (SELECT doc_id, prompt_id, correct, 'final label: ' || {LABELS_SQL}[(length(prompt) % 6) + 1] AS response FROM rq),
ev AS (SELECT prompt_id, correct, {OP.sql_multi_stage('lower(response)')} AS predicted FROM rs),
""" + _metrics_sql("ev", ["prompt_id"], 1.0)))
def prompt_evaluation(spark, sf_dir):
    """Reports -> stratified split -> test rows x prompt catalogue -> rendered
    prompts -> batch inference (Python scorer) -> multi-stage parse -> macro
    metrics per prompt: the reference's prompt-evaluation loop as one job."""
    g = FX.gold(spark, sf_dir).select("doc_id", "text", "true_label")
    test = X.stratified_split(g, "doc_id", "true_label").filter(F.col("split") == "test")
    pairs = PR.expand(test, FX.prompts_df(spark).select("prompt_id", "template"))
    stated = FX.predicted_expr(F.col("doc_id"), F.col("prompt_id"), F.col("true_label"))
    req = pairs.select("doc_id", "prompt_id", F.col("true_label").alias("correct"),
                       TX.render(F.col("template"), F.col("text"), stated).alias("prompt"))
    resp = INF.batch_inference(req, INF.length_scorer, keys=["doc_id", "prompt_id", "correct"])
    parsed = LB.with_multi_stage_label(resp.withColumn("lr", F.lower("response")), "lr", "predicted")
    return _metrics_df(parsed, ["prompt_id"], zero_division=1.0)


@query("streaming_metrics", with_parts(["resp"], "SELECT * FROM mm", f"""
parsed AS (SELECT doc_id, prompt_id, correct, {OP.sql_multi_stage('lower(response)')} AS predicted FROM resp),
""" + _metrics_sql("parsed", ["prompt_id"], 1.0)))
def streaming_metrics(spark, sf_dir):
    """Macro metrics from the streaming monitor's running confusion counts."""
    counts = streaming_confusion(spark, sf_dir)
    return _metrics_df(counts, ["prompt_id"], zero_division=1.0, counts="n")
