"""Report values as lines of text: one macro a metric, from the long table of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import templates as T

# How a kind of number is printed, and what stands for a number that isn't there: never measured, or undefined.
FORMATS = {"percent": ("%.1f\\%%", 1), "loss": ("%.4f", 4), "delta": ("%+.4f", 4), "mean": ("%.1f", 1), "count": ("%.0f", 0)}
PENDING, UNDEFINED = "[PENDING]", "N/A"


def shown(value: Column, kind: Column) -> Column:
    """A number as its kind is printed, halves away from zero; shares are given as fractions. Infinite and null values are undefined."""
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    out = F.when(~F.coalesce(ok, F.lit(False)), UNDEFINED)
    for name, (form, places) in FORMATS.items():
        number = F.round(value * 100 if name == "percent" else value, places)
        out = out.when(kind == name, F.format_string(form, F.when(number == 0, 0.0).otherwise(number)))
    return out


def macro_name(*parts: Column) -> Column:
    """Letters only: ranges and signs in words, digits one by one."""
    name = F.concat(*(F.coalesce(p, F.lit("")) for p in parts))
    for mark, word in (("-", "To"), ("+", "Plus"), *zip("0123456789", "Zero One Two Three Four Five Six Seven Eight Nine".split(), strict=True)):
        name = F.replace(name, F.lit(mark), F.lit(word))
    return F.regexp_replace(name, "[^A-Za-z]", "")


def macros(metrics: DataFrame, wanted: DataFrame) -> DataFrame:
    """metrics (name, grp, value, kind) for all that are wanted (name, grp): name and line; what has no metric is pending."""
    got = wanted.join(metrics, ["name", "grp"], "left")
    value = F.when(F.col("kind").isNull(), PENDING).otherwise(shown(F.col("value"), F.col("kind")))
    name = macro_name(F.col("name"), F.col("grp"))
    return got.select(name.alias("name"), F.concat(F.lit("\\newcommand{\\"), name, F.lit("}{"), value, F.lit("}")).alias("line"))


def fragment_rows(fragments: DataFrame) -> DataFrame:
    """fragments (ord, path, content) to (ord, path, model, rows, n_tables): the body of each one's table, which counts if it has exactly one."""
    tables = T.tables(F.col("content"))
    return fragments.select("ord", "path", T.model_label(F.col("path"), F.col("content")).alias("model"), F.size(tables).alias("n_tables"), T.body_lines(F.get(tables, F.lit(0))).alias("rows"))


def grouped_table(parts: DataFrame, caption: str, label: str, columns: str, header: list[str], width: int, comments: tuple[str, ...] = ()) -> DataFrame:
    """One row `content`: a table of all parts (ord, model, rows), a heading for each model and a rule between them. Parts are fragments of a report, some lines each.

    A part without exactly one table, or whose table has no body, is an error that names its path.
    """
    fine = F.when(F.col("n_tables") != 1, F.raise_error(F.concat(F.lit("expected one table in "), "path", F.lit(", found "), F.col("n_tables").cast("string")))).when(F.size("rows") == 0, F.raise_error(F.concat(F.lit("no table body in "), "path"))).otherwise(F.col("rows"))
    group = F.concat(F.array(F.concat(F.lit(f"\\multicolumn{{{width}}}{{@{{}}l@{{}}}}{{\\textbf{{"), "model", F.lit("}} \\\\"))), fine)
    head = [*comments, *([""] if comments else []), "\\begin{table}[htbp]", "\\centering", f"\\caption{{{caption}}}", f"\\label{{{label}}}", f"\\begin{{tabular}}{{{columns}}}", *header]
    tail = ["\\bottomrule", "\\end{tabular}", "\\end{table}", ""]
    groups = parts.select("ord", F.array_join(group, "\n").alias("lines")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "lines")))["lines"], "\n\\midrule\n").alias("body"))
    return groups.select(F.concat(F.lit("\n".join(head) + "\n"), "body", F.lit("\n" + "\n".join(tail))).alias("content"))


def merged_macros(fragments: DataFrame) -> DataFrame:
    """fragments (ord, content) to (ord, nth, line): their lines in order, of macros of one name only the first."""
    lines = fragments.select("ord", F.posexplode(F.split("content", "\n")).alias("nth", "line"))
    lines = lines.withColumn("macro", F.regexp_extract(F.trim("line"), r"^\\newcommand\{\\([^}]+)\}", 1))
    named = lines.filter("macro <> ''")
    first = named.groupBy("macro").agg(F.min_by(F.struct("line"), F.struct("ord", "nth")).alias("r"), F.min(F.struct("ord", "nth")).alias("at")).select("at.ord", "at.nth", "r.line")
    return lines.filter("macro = ''").select("ord", "nth", "line").unionByName(first)


def unique_labels(content: DataFrame, context: str) -> DataFrame:
    """content (column `content`) as it is; a label that it defines twice is an error."""
    twice = T.repeated_labels(F.col("content"))
    return content.withColumn("content", F.when(F.size(twice) > 0, F.raise_error(F.concat(F.lit(f"repeated labels in {context}: "), F.array_join(twice, ", ")))).otherwise(F.col("content")))
