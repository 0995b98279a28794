"""Lint rules over symbols, params and docs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeflow.core import spread
from tomeflow.functions.strings import tab_stops


def documented_params(params: DataFrame, doc_params: DataFrame) -> DataFrame:
    """(func_id, name, n_params, documented): every pair of either side, with the number
    of parameters and whether a doc names it. Nulls are equal. One aggregation over
    counted partitions, so a task's memory does not grow with the tables."""
    sides = params.select("func_id", "name", F.lit(1).alias("__p")).union(doc_params.select("func_id", "name", F.lit(0)))
    found = spread(sides, "func_id", "name").groupBy("func_id", "name")
    return found.agg(F.sum("__p").alias("n_params"), (F.min("__p") == 0).alias("documented"))


def missing_params(params: DataFrame, doc_params: DataFrame) -> DataFrame:
    """(func_id, name) of named parameters without a doc."""
    return documented_params(params, doc_params).where("name <> '' and not documented").select("func_id", "name")


def unknown_params(params: DataFrame, doc_params: DataFrame) -> DataFrame:
    """(func_id, name) documented but not existing."""
    return documented_params(params, doc_params).where("n_params = 0").select("func_id", "name")


def param_faults(params: DataFrame, doc_params: DataFrame) -> DataFrame:
    """(rule, func_id, name), both rules in one pass."""
    fault = F.when(F.col("n_params") == 0, "unknown").when((F.col("name") != "") & ~F.col("documented"), "missing")
    return documented_params(params, doc_params).select(fault.alias("rule"), "func_id", "name").where("rule is not null")


def duplicates(doc_params: DataFrame, keys: list[str]) -> DataFrame:
    """Keys documented more than once, with their count."""
    return doc_params.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def complete_params(params: DataFrame, doc_params: DataFrame) -> DataFrame:
    """(func_id, complete): as many named parameters as documented ones and each
    of them documented."""
    named = F.col("name") != ""
    each = documented_params(params, doc_params).groupBy("func_id").agg(
        F.sum(F.when(named, F.col("n_params"))).alias("__n"), F.bool_and(F.when(named & (F.col("n_params") > 0), F.col("documented"))).alias("__all"),
        F.count_if("documented").alias("__m"),
    )
    complete = F.col("__all") & (F.col("__n") == F.col("__m")) & F.col("func_id").isNotNull()
    return each.where("__n > 0").select("func_id", complete.alias("complete"))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, and 'th' from the fourth on, the 21st too ('21th')."""
    return F.concat(n.cast("string"), F.when(n == 1, "st").when(n == 2, "nd").when(n == 3, "rd").otherwise("th"))


#: Rules in the order in which they emit.
RULES = ["undocumented", "duplicate-param", "unknown-param", "missing-param", "missing-return", "undocumented-enum-value", "unnamed-param", "broken-reference"]


def rule(rows: DataFrame, name: str, message: Column, level: str = "warning") -> DataFrame:
    """Diagnostics of one rule from rows with full_path, line and col; ``seq`` is the
    rule's place in the order of emission."""
    return rows.select("full_path", "line", "col", F.lit(level).alias("level"), F.lit(name).alias("rule"), message.alias("message"), F.lit(RULES.index(name)).alias("seq"))


def lint(symbols: DataFrame, params: DataFrame, doc_params: DataFrame, returns: DataFrame, refs: DataFrame, switches: set[str] | None = None) -> DataFrame:
    """The union of the rules that are on. ``symbols``: id, kind, name,
    qualified_name, has_doc, extraction, is_deleted, return_type, full_path, line, col;
    ``params``: func_id, pos, name;
    ``doc_params``: func_id, name; ``returns``: func_id; ``refs``: symbol_id,
    literal, target_id. Parameter and return rules look at regular documented
    functions only, and what is missing in a deleted one is no fault."""
    place = symbols.select(F.col("id").alias("__id"), F.col("name").alias("__name"), F.col("qualified_name").alias("__qualified"), "full_path", "line", "col")
    at = lambda df, key: df.join(place, F.col(key) == F.col("__id"))
    functions = symbols.where("has_doc and kind = 'function' and extraction = 0")
    documented = functions.select(F.col("id").alias("func_id"))
    defined = functions.where(~F.coalesce("is_deleted", F.lit(False)))
    judged = lambda df, of=documented: at(df.join(of, "func_id", "left_semi"), "func_id")
    filled = defined.select(F.col("id").alias("func_id"))
    rules = {
        "undocumented": lambda: rule(symbols.where("not has_doc and extraction = 0 and kind not in ('namespace', 'enum-constant')"), "undocumented", F.concat("name", F.lit(": Symbol is undocumented"))),
        "duplicate-param": lambda: rule(judged(duplicates(doc_params, ["func_id", "name"])), "duplicate-param", F.concat("__qualified", F.lit(": Duplicate parameter documentation for '"), "name", F.lit("'"))),
        "unknown-param": lambda: rule(judged(unknown_params(params, doc_params)), "unknown-param", F.concat("__qualified", F.lit(": Documented parameter '"), "name", F.lit("' does not exist"))),
        "missing-param": lambda: rule(judged(missing_params(params, doc_params), filled), "missing-param", F.concat("__qualified", F.lit(": Missing documentation for parameter '"), "name", F.lit("'"))),
        "missing-return": lambda: rule(
            defined.where("return_type <> 'void' and return_type is not null").join(returns.select(F.col("func_id").alias("__r")), F.col("id") == F.col("__r"), "left_anti"),
            "missing-return", F.concat("qualified_name", F.lit(": Missing documentation for return value"))),
        "undocumented-enum-value": lambda: rule(symbols.where("not has_doc and kind = 'enum-constant' and extraction = 0"), "undocumented-enum-value", F.concat("qualified_name", F.lit(": Missing documentation for enum value"))),
        "unnamed-param": lambda: rule(judged(params.where("name = ''")), "unnamed-param", F.concat("__qualified", F.lit(": "), ordinal(F.col("pos") + 1), F.lit(" parameter is unnamed"))),
        "broken-reference": lambda: broken_references(refs, place),
    }
    return reduce(DataFrame.unionByName, [f() for k, f in rules.items() if switches is None or k in switches])


def broken_references(refs: DataFrame, place: DataFrame) -> DataFrame:
    """Unresolved references, once for each (text, symbol name); 'std::' is ignored."""
    bad = refs.where("target_id is null and not startswith(ltrim(':', literal), 'std::')").join(place, F.col("symbol_id") == F.col("__id"))
    w = Window.partitionBy("literal", "__name").orderBy("full_path", "line", "col", "symbol_id")
    once = bad.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    return rule(once, "broken-reference", F.concat("__name", F.lit(": Failed to resolve reference to '"), "literal", F.lit("'")))


def source_lines(files: DataFrame) -> DataFrame:
    """(full_path, line, source): numbered lines from 1, without a carriage return
    before the line's end."""
    lines = F.posexplode(F.split("text", "\r?\n")).alias("__p", "source")
    return files.select(F.col("path").alias("full_path"), lines).select("full_path", (F.col("__p") + 1).alias("line"), "source")


def with_source_line(warnings: DataFrame, files: DataFrame) -> DataFrame:
    """Warnings with their ``source`` line (null if there is none) and
    ``n_lines``, the lines of the file. Wanted line numbers go to their file, which
    gives these lines only: rows follow warnings, not lines."""
    wanted = warnings.groupBy(F.col("full_path").alias("__f")).agg(F.collect_set("line").alias("__lines"))
    lines = F.split("text", "\r?\n")
    found = wanted.join(files, F.col("__f") == F.col("path")).withColumn("__text", lines)
    each = found.select("__f", F.size("__text").alias("n_lines"), F.explode(F.transform("__lines", lambda n: F.struct(n.alias("line"), F.get("__text", n.cast("int") - 1).alias("source")))).alias("__l"))
    rows = each.select(F.col("__f").alias("full_path"), F.col("__l.line").alias("line"), F.col("__l.source").alias("source"), "n_lines")
    return warnings.join(rows, ["full_path", "line"], "left")


def grouped_warnings(warnings: DataFrame, seq: str = "seq") -> DataFrame:
    """(full_path, line, col, messages): numbered texts of a location in the order
    of ``seq`` in which they were emitted, repeated ones included. Without such a
    column, or where it ties, they go by text."""
    first = [F.col(seq).alias("s")] if seq in warnings.columns else []
    texts = F.transform(F.array_sort(F.collect_list(F.struct(*first, F.col("message").alias("m")))), lambda x: x["m"])
    return warnings.groupBy("full_path", "line", "col").agg(F.transform(texts, lambda m, k: F.concat((k + 1).cast("string"), F.lit(") "), m)).alias("messages"))


#: Columns of a tab stop in reports.
REPORT_TAB = 8


def warning_report(warnings: DataFrame, files: DataFrame) -> DataFrame:
    """(full_path, line, col, text): a location's header, its messages numbered
    and indented, the source line behind a gutter with its number, tabs expanded, and a
    caret line. A line that is the file's last, or none of it, is not shown; a column
    that is not inside the line gets no caret. Before the caret a tab counts eight
    columns wherever it stands. Columns count characters."""
    g = with_source_line(grouped_warnings(warnings), files)
    source, col = F.col("source"), F.col("col")
    shown = tab_stops(source, REPORT_TAB)
    before = F.substring(source, F.lit(1), F.greatest(col - 1, F.lit(0)))
    offset = F.length(before) + (REPORT_TAB - 1) * (F.length(before) - F.length(F.replace(before, F.lit("\t"), F.lit(""))))
    gutter = F.concat(F.lit("  "), F.col("line").cast("string"), F.lit(" | "))
    under = F.concat(F.repeat(F.lit(" "), F.length(gutter) - 2), F.lit("| "))
    caret = F.concat(F.repeat(F.lit(" "), offset), F.lit("^"), F.repeat(F.lit("~"), F.greatest(F.lit(0), F.length(shown) - offset - 1)), F.lit("\n"))
    snippet = F.concat(gutter, shown, F.lit("\n"), under, F.when((col > 0) & (col < F.length(source)), caret).otherwise(""))
    visible = source.isNotNull() & (F.col("line") > 0) & (F.col("line") < F.col("n_lines"))
    head = F.concat("full_path", F.lit(":"), F.col("line").cast("string"), F.lit(":"), col.cast("string"), F.lit(":\n"))
    listed = F.array_join(F.transform("messages", lambda m: F.concat(F.lit("    "), m, F.lit("\n"))), "")
    return g.select("full_path", "line", "col", F.concat(head, listed, F.when(visible, snippet).otherwise("")).alias("text"))


def golden_diff(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """(path, added, removed) of files whose trimmed lines differ, as multisets."""
    lines = lambda df: df.select("path", F.explode(F.split("text", "\n")).alias("__l")).select("path", F.trim("__l").alias("l")).groupBy("path", "l").agg(F.count(F.lit(1)).alias("n"))
    e, p = lines(expected).withColumnRenamed("n", "ne"), lines(produced).withColumnRenamed("n", "np")
    both = e.join(p, ["path", "l"], "full").select("path", F.coalesce("ne", F.lit(0)).alias("ne"), F.coalesce("np", F.lit(0)).alias("np"))
    sums = both.groupBy("path").agg(F.sum(F.greatest(F.lit(0), F.col("np") - F.col("ne"))).alias("added"), F.sum(F.greatest(F.lit(0), F.col("ne") - F.col("np"))).alias("removed"))
    return sums.where("added > 0 or removed > 0")
