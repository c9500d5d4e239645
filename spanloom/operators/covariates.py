"""Covariates of code and classes of training dynamics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.quantiles import exact_quantiles
from spanloom.functions.text import BLANKS

#: Words and marks that branch.
BRANCHES = r"\b(?:if|for|while|case|catch|elif|except)\b|&&|\|\||\?"
NAMES = r"[A-Za-z_][A-Za-z0-9_]*"


def word_count(text: Column) -> Column:
    """K1: runs without white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), rf"{BLANKS}+"), lambda w: w != ""))


def classify(rows: DataFrame) -> DataFrame:
    """K2: easy, ambiguous or hard by the quartiles of confidence and variability over all rows; null where either is."""
    conf_lo, conf_hi = exact_quantiles(rows, "confidence", [0.25, 0.75])
    var_lo, var_hi = exact_quantiles(rows, "variability", [0.25, 0.75])
    if conf_lo is None or var_lo is None:
        return rows.withColumn("class", F.lit(None).cast("string"))
    conf, var = F.col("confidence"), F.col("variability")
    class_ = (
        F.when(conf.isNull() | var.isNull(), None)
        .when(var >= var_hi, "ambiguous")
        .when((var <= var_lo) & (conf >= conf_hi), "easy")
        .when((var <= var_lo) & (conf <= conf_lo), "hard")
        .when(var > (var_hi + var_lo) / 2, "ambiguous")
        .when(conf >= (conf_hi + conf_lo) / 2, "easy")
        .otherwise("hard")
    )
    return rows.withColumn("class", class_)


def format_code(code: Column) -> Column:
    """K3: one statement or brace per line, indented by the depth of braces; tags of sequences and blanks around dots go."""
    text = F.regexp_replace(code, "</?s>", "")
    for pattern, by in ((rf"{BLANKS}*\.{BLANKS}*", "."), (rf"{BLANKS}+", " "), (rf";{BLANKS}*", ";\n"), (rf"\{{{BLANKS}*", "{\n"), (rf"\}}{BLANKS}*", "}\n")):
        text = F.regexp_replace(text, pattern, by)

    def placed(acc: Column, line: Column) -> Column:
        bare = F.trim(line)
        depth = acc["depth"] - F.when(bare.endswith("}"), 1).otherwise(0)
        own = F.concat(F.repeat(F.lit("    "), F.greatest(depth, F.lit(0))), bare)
        return F.struct((depth + F.when(bare.endswith("{"), 1).otherwise(0)).alias("depth"), F.array_append(acc["lines"], own).alias("lines"))

    start = F.struct(F.lit(0).alias("depth"), F.expr("cast(array() as array<string>)").alias("lines"))
    return F.aggregate(F.split(text, "\n"), start, placed, lambda acc: F.regexp_replace(F.array_join(acc["lines"], "\n"), rf"\A{BLANKS}+|{BLANKS}+\z", ""))


def first_function(code: Column) -> Column:
    """The text from the first opening brace that follows a parameter list on, or the body of the first `def`; null if there
    is neither."""
    braces, indented = F.regexp_extract(code, r"(?s)\)[^;{}()]*(\{.*)", 1), F.regexp_extract(code, r"(?s)\bdef \w+\([^\n]*(.*?)(?=\n\S|\z)", 1)
    return F.when(braces != "", braces).when(indented != "", indented)


def count_matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def depth(code: Column) -> Column:
    """The greatest depth of brackets; 0 without brackets."""
    marks = F.split(F.regexp_replace(code, r"[^\[({\])}]", ""), "")
    step = lambda a, c: F.struct((a["d"] + F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)).alias("d"), F.greatest(a["m"], a["d"] + F.when(c.isin("(", "[", "{"), 1).otherwise(0)).alias("m"))
    return F.aggregate(marks, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), step, lambda a: a["m"])


def function_metrics(code: Column) -> dict[str, Column]:
    """K4, the default backend: complexity, lines and tokens of the first function; null without one."""
    body = first_function(code)
    lines = F.size(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""))
    return {"t_complexity": 1 + count_matches(body, BRANCHES), "t_nloc": lines, "t_token_counts": count_matches(body, r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]")}


def tree_metrics(code: Column) -> dict[str, Column]:
    """K5, the default backend: depth, nodes, errors (brackets without a partner) and names of the whole text."""
    unpaired = sum((F.abs(count_matches(code, rf"\{a}") - count_matches(code, rf"\{b}")) for a, b in ("()", "[]", "{}")), F.lit(0))
    names = F.array_distinct(F.regexp_extract_all(code, F.lit(NAMES), F.lit(0)))
    return {"t_ast_levels": depth(code), "t_n_ast_nodes": count_matches(code, r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"), "t_n_ast_errors": unpaired, "t_n_identifiers": F.size(names)}


def outcome(rows: DataFrame, model: str) -> DataFrame:
    """K6."""
    return rows.withColumns({"model": F.lit(model), "outcome": F.coalesce("attack_hit", F.lit(False)).cast("int")})


def relative_score(members: DataFrame, others: DataFrame, column: str) -> DataFrame:
    """K7: where a member's value lies between the least and the greatest of members and others together."""
    low, high = members.select(column).union(others.select(column)).agg(F.min(column), F.max(column)).first()
    if low is None:
        return members.withColumn(f"relative_{column}", F.lit(None).cast("double"))
    return members.withColumn(f"relative_{column}", (F.col(column) - F.lit(low)) / (F.lit(high - low) + F.lit(1e-15)))


def rule_label(path: Column) -> Column:
    """K8: the first `rule_...` of a path, or null."""
    found = F.regexp_extract(path, r"(rule_\w+)", 1)
    return F.when(found != "", found)


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


#: K9: the treatment group of each class; T0 is the one the others are held against.
GROUPS = {"easy": "T0", "hard": "T1", "ambiguous": "T2"}


def with_group(rows: DataFrame) -> DataFrame:
    group = F.lit(None).cast("string")
    for class_, name in GROUPS.items():
        group = F.when(F.col("class") == class_, name).otherwise(group)
    return rows.withColumn("group", group)


def contrast(rows: DataFrame, treatment: str, kind: str, columns: list[str]) -> DataFrame:
    """K9: rows of one type in T0 or the treatment's group, with a flag; rows with a null in any of the columns go."""
    own = rows.filter((F.col("type") == kind) & F.col("group").isin("T0", treatment))
    return own.withColumn("treated", (F.col("group") == treatment).cast("int")).dropna(subset=columns)
