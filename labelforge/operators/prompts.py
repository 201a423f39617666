"""Prompt catalogue operators: expansion (J2), group routing (J3), rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.functions.text import placeholders, render
from labelforge.operators.dims import attach


def expand(reports: DataFrame, prompts: DataFrame) -> DataFrame:
    """Every prompt over every report, for a catalogue of any size; Spark
    broadcasts a catalogue that it knows to be small, so report text stays put."""
    return attach(reports, prompts)


def route_groups(prompts: DataFrame, split_index: int, before: str = "before", after: str = "after") -> DataFrame:
    """Catalogue position ``< split_index`` -> ``before`` group, else ``after``."""
    return prompts.withColumn("grp", F.when(F.col("ord") < split_index, F.lit(before)).otherwise(F.lit(after)))


def route_predictions(prompts: DataFrame, by_group: dict[str, DataFrame], keys: tuple[str, ...] = ("prompt_id",)) -> DataFrame:
    """Each prompt's rows from the prediction table of its group. ``prompts``
    has ``grp``; a group's table gives only the rows of its own prompts."""
    out = None
    for grp, table in by_group.items():
        mine = prompts.filter(F.col("grp") == grp).select(*keys)
        part = table.join(mine, list(keys), "left_semi").withColumn("grp", F.lit(grp))
        out = part if out is None else out.unionByName(part)
    return out


def render_prompts(pairs: DataFrame, template: str = "template", report: str = "report",
                   y_i: str | None = None, out: str = "prompt") -> DataFrame:
    """T1 on expanded rows."""
    return pairs.withColumn(out, render(F.col(template), F.col(report), F.col(y_i) if y_i else None))


def check_placeholders(prompts: DataFrame, allowed=("report", "y_i")) -> DataFrame:
    """Catalogue rows whose template uses an unknown ``{name}`` (``str.format``
    would raise on them); checked once on the catalogue, not per row."""
    ph = placeholders(F.col("template"))
    bad = F.array_except(ph, F.array(*[F.lit(a) for a in allowed]))
    return prompts.withColumn("unknown_placeholders", bad).filter(F.size("unknown_placeholders") > 0)
