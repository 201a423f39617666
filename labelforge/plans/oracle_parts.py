"""DuckDB SQL for the derived inputs of ``labelforge.plans.fixtures``.

These strings mirror the Spark expressions one for one; the oracle queries
are ``WITH <needed parts> SELECT ...`` over the pre-registered views."""

from __future__ import annotations

from labelforge.plans.fixtures import CONCLUSION_PHRASES, PROMPTS
from labelforge.schema import LABELS, RAW_NO_VARIANTS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


LABELS_SQL = lst(LABELS)


def H(id_sql: str, salt_sql: str) -> str:
    return f"('0x'||substr(md5(CAST({id_sql} AS VARCHAR)||':'||{salt_sql}),1,8))::BIGINT"


def lab_at(idx_sql: str) -> str:
    return f"{LABELS_SQL}[({idx_sql})+1]"


PROMPTS_SQL = "(VALUES " + ", ".join(
    f"({o}, {q(i)}, {q(d)}, {q(t)})" for o, i, d, t in PROMPTS
) + ") AS p(ord, prompt_id, description, template)"

PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, deps: list[str], sql: str) -> None:
    PARTS[name] = (deps, sql)


part("prompts", [], f"SELECT 'fixture' AS catalogue, ord, prompt_id, description, template FROM {PROMPTS_SQL}")
part("gold", [], f"""
SELECT doc_id, text, lang, source, n_chars, true_label,
       CASE WHEN true_label = 'no' THEN {lst(RAW_NO_VARIANTS)}[({H('doc_id', "'v'")} % 3)+1] ELSE true_label END AS raw_label
FROM (SELECT doc_id, text, lang, source, n_chars, {lab_at(H('doc_id', "'t'") + ' % 6')} AS true_label FROM documents)""")


def predicted_sql(doc: str, pid: str, truth: str) -> str:
    j = H(doc, f"{pid}||'j'")
    return (f"CASE WHEN {j} % 50 = 0 THEN (CASE WHEN {j} % 100 = 0 THEN 'unclear' ELSE 'n/a' END) "
            f"WHEN {H(doc, pid)} % 10 < 8 THEN {truth} "
            f"ELSE {lab_at(H(doc, f'{pid}||' + q('e')) + ' % 6')} END")


part("pred", ["gold", "prompts"], f"""
SELECT g.doc_id, p.prompt_id, p.ord, g.true_label AS correct,
       {predicted_sql('g.doc_id', 'p.prompt_id', 'g.true_label')} AS predicted
FROM gold g CROSS JOIN prompts p""")

part("pred_text", ["gold", "prompts"], f"""
SELECT g.doc_id, p.prompt_id, p.ord, g.true_label AS correct,
       {predicted_sql('g.doc_id', 'p.prompt_id', 'g.true_label')} AS predicted,
       g.text, g.lang, g.source, g.n_chars, p.template
FROM gold g CROSS JOIN prompts p""")

part("scores", ["pred"], f"""
SELECT doc_id, prompt_id, label,
       ({H('doc_id', 'prompt_id||label')} % 1000)::DOUBLE / 1000.0 + CASE WHEN label = predicted THEN 0.3 ELSE 0.0 END AS score,
       predicted, correct AS true_label
FROM (SELECT *, unnest({LABELS_SQL}) AS label FROM pred)""")

_KV = " || chr(10) || ".join(
    f"{q(lab + ': ')} || CAST({H('doc_id', 'prompt_id||' + q(lab))} % 1000 AS VARCHAR)" for lab in LABELS
)


def response_sql() -> str:
    r = f"({H('doc_id', 'prompt_id||' + q('r'))} % 6)"
    return (f"CASE WHEN {r} = 0 THEN 'final label: ' || predicted "
            f"WHEN {r} = 1 THEN 'Reasoning done.' || chr(10) || '### output ###' || chr(10) || predicted || chr(10) || 'because of the findings' "
            f"WHEN {r} = 2 THEN {_KV} "
            f"WHEN {r} = 3 THEN predicted || ', 99.0%' "
            f"WHEN {r} = 4 THEN 'unable to decide' ELSE '' END")


part("resp", ["pred"], f"SELECT *, {response_sql()} AS response FROM pred")
part("resp_dec", ["pred_text"], f"""
SELECT *, prompt || chr(10) || '### response ###' || chr(10) || response AS decoded
FROM (SELECT *, {response_sql()} AS response,
             replace(replace(template, '{{y_i}}', predicted), '{{report}}', text) AS prompt
      FROM pred_text)""")

_PHRASES = lst(CONCLUSION_PHRASES)
part("reports", ["gold"], f"""
SELECT doc_id, true_label,
       'EXAM: ' || source || chr(10) || 'FINDINGS: ' || substring(text, 1, CAST(floor(length(text) / 2) AS INTEGER))
       || chr(10) || 'CONCLUSION: ' || substring(text, CAST(floor(length(text) / 2) AS INTEGER) + 1, length(text))
       || ' ' || {_PHRASES}[({H('doc_id', "'k'")} % {len(CONCLUSION_PHRASES)}) + 1] || '.' AS report
FROM gold""")


def with_parts(names: list[str], select: str, extra: str = "") -> str:
    """``WITH`` clause holding ``names`` and their dependencies (plus the
    ``extra`` CTE text), then ``select``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in PARTS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    body = ",\n".join([f"{n} AS ({PARTS[n][1]})" for n in order] + ([extra] if extra else []))
    return f"WITH {body}\n{select}"


# ----------------------------------------------------------------- text helpers (DuckDB spellings)

LB_RE = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]"
LB_CHARS = "[" + ", ".join(f"chr({c})" for c in (10, 13, 11, 12, 28, 29, 30, 133, 8232, 8233)) + "]"
ALT = "|".join(LABELS)
FLOAT_RE = r"[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?"


def _ws_sql() -> str:
    from labelforge.functions.text import PY_WHITESPACE

    return "||".join(f"chr({ord(ch)})" for ch in PY_WHITESPACE)


WS_SQL = _ws_sql()


def sql_strip(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


def sql_splitlines(x: str) -> str:
    parts = f"string_split_regex({x}, '{LB_RE}')"
    return (f"(CASE WHEN {x} = '' THEN []::VARCHAR[] WHEN list_contains({LB_CHARS}, right({x}, 1)) "
            f"THEN list_slice({parts}, 1, len({parts}) - 1) ELSE {parts} END)")


def sql_multi_stage(t: str) -> str:
    lines = sql_splitlines(t)
    finals = f"list_filter({lines}, lambda l: starts_with(l, 'final label:'))"
    s1 = f"(CASE WHEN len({finals}) > 0 THEN {sql_strip(f'substring(({finals})[-1], 13)')} END)"
    section = sql_strip(f"(string_split({t}, '### output ###'))[-1]")
    head = f"array_to_string(list_slice({sql_splitlines(section)}, 1, 2), ' ')"
    hit = f"lower(regexp_extract({head}, '(?i)\\b({ALT})\\b', 1))"
    s2 = f"NULLIF({hit}, '')"
    entries = (
        f"list_transform(list_filter(list_transform({lines}, lambda l, i: {{'p': string_split(l, ':'), 'pos': i}}), "
        f"lambda e: len(e.p) = 2 AND regexp_full_match({sql_strip('e.p[2]')}, '{FLOAT_RE}')), "
        f"lambda e: {{'k': {sql_strip('e.p[1]')}, 'v': CAST(replace({sql_strip('e.p[2]')}, '_', '') AS DOUBLE), 'pos': e.pos}})"
    )
    return f"coalesce({s1}, {s2}, {sql_kv_argmax(entries)})"


def sql_kv_argmax(entries: str) -> str:
    firsts = f"list_filter({entries}, lambda e: len(list_filter({entries}, lambda y: y.k = e.k AND y.pos < e.pos)) = 0)"
    folded = f"list_transform({firsts}, lambda e: {{'k': e.k, 'v': (list_filter({entries}, lambda y: y.k = e.k))[-1].v}})"
    return (f"(CASE WHEN len({folded}) > 0 THEN "
            f"(list_reduce({folded}, lambda acc, x: CASE WHEN x.v > acc.v THEN x ELSE acc END)).k END)")


PAT_A = r"(\w+)\s*[:,\s]*([\d.]+)"


def pat_b() -> str:
    return rf"({ALT})\s*[:\s/]*\s*([\d.]+)?%?"


def _pairs(t: str, pat: str) -> str:
    return (f"list_transform(regexp_extract_all({t}, '{pat}', 1), "
            f"lambda k, i: {{'k': k, 'v': (regexp_extract_all({t}, '{pat}', 2))[i]}})")


def sql_conf_a(t: str) -> list[str]:
    pairs = _pairs(t, PAT_A)
    out = []
    for lab in LABELS:
        v = f"(list_filter({pairs}, lambda p: p.k = {q(lab)}))[-1].v"
        out.append(f"(CASE WHEN {v} IS NULL THEN 0.0 WHEN regexp_full_match({v}, '\\d+\\.?\\d*|\\.\\d+') "
                   f"THEN CAST({v} AS DOUBLE) ELSE 0.0 END)")
    return out


def sql_conf_b(t: str, fallback: str = "one_hot") -> list[str]:
    pairs = _pairs(t, pat_b())
    raw = []
    for lab in LABELS:
        v = f"(list_filter({pairs}, lambda p: p.k = {q(lab)}))[-1].v"
        raw.append(f"(CASE WHEN {v} IS NULL OR {v} = '' THEN 0.0 WHEN regexp_full_match({v}, '\\d+\\.?\\d*|\\.\\d+') "
                   f"THEN CAST({v} AS DOUBLE) / 100.0 ELSE 0.0 END)")
    all_zero = " AND ".join(f"{r} = 0.0" for r in raw)
    first = "(CASE " + " ".join(
        f"WHEN regexp_matches({t}, '\\b{lab}\\b') THEN {i}" for i, lab in enumerate(LABELS)) + " END)"
    out = []
    for i, r in enumerate(raw):
        fb = f"(CASE WHEN {first} = {i} THEN 1.0 ELSE 0.0 END)" if fallback == "one_hot" else "1.0"
        out.append(f"(CASE WHEN ({all_zero}) AND {first} IS NOT NULL THEN {fb} ELSE {r} END)")
    return out
