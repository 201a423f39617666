"""Text scalars: line splitting, Python-style strip, markers, prompt rendering.

The reference runs Python ``str`` methods per row; these are the same
operations as JVM expressions (whole-stage codegen where Spark allows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line boundaries of Python's str.splitlines().
LINE_BREAKS = ["\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
LINE_SPLIT_RE = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"

# Python str.strip() with no argument strips the characters for which
# str.isspace() is true; the set is derived from that rule.
PY_WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def py_strip(c) -> Column:
    """``str.strip()``: the native character-set ``trim`` with Python's
    whitespace set (plain ``trim`` only strips spaces; a regex strip scans the
    whole text)."""
    return F.trim(_c(c), F.lit(PY_WHITESPACE))


def splitlines(c) -> Column:
    """``str.splitlines()``: no trailing empty line, ``[]`` for ``''``."""
    c = _c(c)
    parts = F.split(c, LINE_SPLIT_RE, -1)
    return (
        F.when(c == "", F.array().cast("array<string>"))
        .when(F.substring(c, -1, 1).isin(LINE_BREAKS), F.slice(parts, 1, F.size(parts) - 1))
        .otherwise(parts)
    )


def after_last(c, marker: str) -> Column:
    """``text.split(marker)[-1]``: the whole text when the marker is absent."""
    return F.substring_index(_c(c), marker, -1)


def after_first(c, marker: str) -> Column:
    """``text.split(marker, 1)[-1]`` when present, else the text."""
    return F.element_at(F.split(_c(c), "\\Q" + marker + "\\E", 2), -1)


def before_first(c, marker: str) -> Column:
    """``text.split(marker)[0]`` (e.g. cut at the first blank line ``'\\n \\n'``)."""
    return F.substring_index(_c(c), marker, 1)


def render(template, report, y_i=None) -> Column:
    """``template.format(report=..., y_i=...)``: all occurrences, ``{{`` and ``}}``
    as single braces; what is put in is never expanded. A NULL prints ``nan``:
    both columns come from ``read_csv``. Leftover placeholders are checked on
    the catalogue, not on rows."""
    brace = "\ue000"  # stands for a doubled brace while fields are looked for

    def plain(part: Column) -> Column:
        return F.replace(F.replace(part, F.lit("}}"), F.lit("}")), F.lit(brace), F.lit("{"))

    def put(part: Column, field: str, value, inner) -> Column:
        return F.call_function("array_join", F.transform(F.split(part, "\\{" + field + "\\}", -1), inner),
                               F.coalesce(_c(value), F.lit("nan")))

    marked = F.replace(_c(template), F.lit("{{"), F.lit(brace))
    inner = plain if y_i is None else lambda part: put(part, "y_i", y_i, plain)
    return put(marked, "report", report, inner)


def strip_echo(generated, prompt) -> Column:
    """``generated.replace(prompt, '').strip()``."""
    g = _c(generated)
    p = _c(prompt)
    return py_strip(F.when(p == "", g).otherwise(F.replace(g, p, F.lit(""))))


def classification_prompt(instruction, text, repeat_instruction: bool = False) -> Column:
    """Fixed classification prompt ``### Instruction / ### Input / ### Response``."""
    parts = [F.lit("### Instruction:\n"), _c(instruction), F.lit("\n\n### Input:\n"), _c(text)]
    if repeat_instruction:
        parts += [F.lit("\n\n"), _c(instruction)]
    parts.append(F.lit("\n\n### Response:"))
    return F.concat(*parts)


def word_count(c) -> Column:
    """Number of whitespace-separated tokens (``len(text.split())`` on ASCII
    whitespace)."""
    return F.regexp_count(_c(c), F.lit(r"[^ \t\n\r\x0B\x0C]+"))


def placeholders(template) -> Column:
    """Placeholders like ``{name}`` present in a template."""
    return F.array_distinct(F.regexp_extract_all(_c(template), F.lit(r"\{([A-Za-z_][A-Za-z0-9_]*)\}"), 1))
