"""Report tables as LaTeX: cells are column expressions; only the few finished lines reach the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters that LaTeX reads as commands, and how they are written.
SPECIALS = {
    "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}",
}
#: What stands for no value, and the most lines of a table.
DASH, MOST_LINES = "--", 10_000


def tex(text: Column) -> Column:
    """A text with its special characters written out, each once."""
    written = F.create_map(*[F.lit(x) for pair in SPECIALS.items() for x in pair])
    return F.array_join(F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), ""), lambda c: F.coalesce(F.try_element_at(written, c), c)), "")


def tex_number(value: Column, digits: int = 3) -> Column:
    v = value.cast("double")
    shown = F.when(F.abs(v) == float("inf"), F.lit(r"$\infty$")).otherwise(F.format_string(f"%.{digits}f", F.round(v, digits)))
    return F.when(v.isNull() | F.isnan(v), F.lit(DASH)).otherwise(shown)


def tex_whole(value: Column) -> Column:
    """A whole number, thousands apart."""
    v = value.cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(DASH)).otherwise(F.replace(F.format_number(F.round(v), 0), F.lit(","), F.lit(r"\,")))


def tex_percent(value: Column, low: Column, high: Column) -> Column:
    """A share in percent, with its interval where there is one."""
    point = tex_number(100 * F.coalesce(value, F.lit(0.0)), 1)
    ends = F.concat(point, F.lit(r" \small{["), tex_number(100 * low, 1), F.lit(", "), tex_number(100 * high, 1), F.lit("]}"))
    return F.when(low.isNull() | high.isNull(), point).otherwise(ends)


def tex_stars(p: Column) -> Column:
    return F.when(p < 0.001, "$^{***}$").when(p < 0.01, "$^{**}$").when(p < 0.05, "$^{*}$").otherwise("")


def tex_line(*cells: Column) -> Column:
    return F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\"))


def bold(cell: Column, on: Column) -> Column:
    return F.when(on, F.concat(F.lit(r"\textbf{"), cell, F.lit("}"))).otherwise(cell)


def running(value: str, order: list[str], by: list[str] | None = None) -> Column:
    """Sum of a value up to each row of a report."""
    return F.sum(value).over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def rendered(lines: DataFrame, line: str, order: list[str], head: list[str], caption: str, notes: list[str] | None = None) -> str:
    """A booktabs table of the lines in order. Reports are short: more than ``MOST_LINES`` are refused, none is left out."""
    rows = [r[0] for r in lines.orderBy(*order).select(line).limit(MOST_LINES + 1).collect()]
    if len(rows) > MOST_LINES:
        raise ValueError(f"a table of over {MOST_LINES} lines")
    return "\n".join([
        *(f"% {n}" for n in notes or []), r"\begin{table}", rf"\caption{{{caption}}}", rf"\begin{{tabular}}{{{'l' * len(head)}}}", r"\toprule", " & ".join(head) + r" \\", r"\midrule",
        *rows, r"\bottomrule", r"\end{tabular}", r"\end{table}", "",
    ])
