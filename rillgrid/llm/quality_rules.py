"""Quality rules as a short-circuit cascade of built-in expressions."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

SAMPLE_ROWS = 2000
SAMPLE_BYTES = 16 << 20

#: Name and SQL of each rule, over the text ``t``; a document is rejected if any is true. The names in
#: braces are the counts below, which Spark and DuckDB work out each in its own way.
RULES: dict[str, str] = {
    "empty": "length(trim(t)) = 0",
    "exclaiming": "length(t) - length(replace(t, '!!', '')) > 0.2 * {words}",
    "symbols": "{symbols} > 0.3 * {words} + 3",
    "tables": "length(t) - length(replace(t, '|', '')) > 0.3 * {words} + 5",
    "long_words": "length(t) > 40 * {words}",
    "bullets": "{words} > 30 and (length(t) - length(replace(t, '\n- ', '')) + length(t) - length(replace(t, '\n* ', ''))) / 3 > 0.9 * {lines}",
    "ellipses": "(length(t) - length(replace(t, '...', ''))) / 3 > 0.5 * {lines} + 3",
    "shouting": "length(t) > 60 and {capitals} > 0.4 * length(t)",
    "no_letters": "not {letters}",
    "repeated_lines": "{lines} > 5 and {distinct_lines} < 0.5 * {lines}",
    "repeated_words": "{words} > 20 and {same_words} > 0.25 * {words}",
}
#: Words and lines are found once for all rules, by ``counted``; the rest inside the rule that asks for it.
_SPARK = {
    "words": "__words",
    "lines": "__lines",
    "symbols": "length(regexp_replace(t, '[^#*&%$]+', ''))",
    "capitals": "length(regexp_replace(t, '[^A-Z]+', ''))",
    "letters": r"(t rlike '\\p{L}')",
    "distinct_lines": "size(array_distinct(split(t, '\n', -1)))",
    # words followed by themselves
    "same_words": "size(array_remove(zip_with(__parts, slice(__parts, 2, size(__parts)), (a, b) -> coalesce(a = b and a <> '', false)), false))",
}
_DUCKDB = {
    "words": "(length(t) - length(replace(t, ' ', '')) + length(t) - length(replace(t, '\n', '')) + 1)",
    "lines": "(length(t) - length(replace(t, '\n', '')) + 1)",
    "symbols": "length(regexp_replace(t, '[^#*&%$]+', '', 'g'))",
    "capitals": "length(regexp_replace(t, '[^A-Z]+', '', 'g'))",
    "letters": r"regexp_matches(t, '\p{L}')",
    "distinct_lines": "len(list_distinct(string_split(t, '\n')))",
    "same_words": "(select count(*) from (select unnest(w[1:len(w) - 1]) a, unnest(w[2:]) b from (select string_split_regex(t, '[ \n]') w)) where a = b and a <> '')",
}


def counted(rows: DataFrame) -> DataFrame:
    """Rows with the text ``t`` and, beside it, its words, and its numbers of words and lines."""
    parts = rows.withColumn("__parts", F.split(F.replace("t", F.lit("\n"), F.lit(" ")), " ", -1))
    return parts.withColumns({"__words": F.size("__parts"), "__lines": F.length("t") - F.length(F.replace("t", F.lit("\n"))) + 1})


def _sql(body: str) -> Column:
    return F.expr(body.replace("\n", "\\n"))


def rule_columns(rules: dict[str, str] | None = None) -> dict[str, Column]:
    """Each rule as a column over ``counted`` texts; never null."""
    return {name: _sql(sql.format(**_SPARK)) for name, sql in (rules or RULES).items()}


def order_rules(docs: DataFrame, work: str, rules: dict[str, str] | None = None, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules' names by rejections gained per cost, as measured on at most about ``sample_rows`` rows.

    A rule's cost is its time over the sample, which is repeated until it holds about SAMPLE_BYTES, so that the time is well above
    that of starting a job; less the time of a rule that does nothing. Rules
    are taken greedily: each next one rejects the most, per cost, of what those before it leave.
    """
    columns = rule_columns(rules)
    total = docs.count()
    if not total:
        return list(columns)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")
    sample = written(docs.select(text).sample(False, min(1.0, sample_rows / total), 7).limit(2 * sample_rows), f"{work}/sample").coalesce(1)
    size = sample.agg(F.sum(F.octet_length("t"))).first()[0] or 1
    times = F.sequence(F.lit(1), F.lit(int(max(1, min(100, SAMPLE_BYTES // size)))))
    many = counted(sample.select("t", F.explode(times).alias("turn")))

    def cost(column: Column) -> float:
        began = time.perf_counter()
        many.agg(F.sum(column.cast("int"))).collect()
        return time.perf_counter() - began

    nothing = F.col("__words") < 0
    cost(nothing)
    idle = min(cost(nothing), cost(nothing))
    costs = {name: max(cost(column) - idle, 1e-3) for name, column in columns.items()}
    sample = counted(sample)
    mask = sum((F.shiftleft(column.cast("bigint"), k) for k, column in enumerate(columns.values())), F.lit(0).cast("bigint"))
    left = [(r["m"], r["count"]) for r in sample.groupBy(mask.alias("m")).count().collect()]
    names, order = list(columns), []
    while len(order) < len(names):
        gains = {n: sum(c for m, c in left if m >> names.index(n) & 1) / costs[n] for n in names if n not in order}
        best = max(gains, key=lambda n: (gains[n], -costs[n]))
        order.append(best)
        left = [(m, c) for m, c in left if not m >> names.index(best) & 1]
    return order


def cascade(rules: dict[str, str] | None, order: list[str]) -> Column:
    """The first rule, in the order given, that rejects a text of ``counted``; null if none does.

    A CASE stops at the first branch that holds, so later rules aren't evaluated on a rejected row.
    """
    rules = rules or RULES
    return _sql("case " + " ".join(f"when {rules[name].format(**_SPARK)} then '{name}'" for name in order) + " end")


def judge(docs: DataFrame, rules: dict[str, str] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, is_kept)``, one row per row of ``docs``.

    A document is kept if no rule rejects it, in whatever order they run. Null text counts as empty
    and is rejected; null and repeated ids are judged row by row. An empty table gives no rows. Extra columns are ignored.
    """
    order = order_rules(docs, shared_dir(docs.sparkSession), rules, sample_rows)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    return counted(rows).select("doc_id", cascade(rules, order).isNull().alias("is_kept"))


def keep_good(docs: DataFrame, rules: dict[str, str] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    order = order_rules(docs, shared_dir(docs.sparkSession), rules, sample_rows)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(F.struct(*columns).alias("__row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    return counted(named).where(cascade(rules, order).isNull()).select("__row.*")


def duckdb_sql(table: str = "documents") -> str:
    """The same decision in DuckDB's SQL."""
    tests = " or ".join(f"({sql.format(**_DUCKDB)})" for sql in RULES.values())
    return f"select doc_id, not ({tests}) as is_kept from (select doc_id, coalesce(text, '') as t from {table})"
