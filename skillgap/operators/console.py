"""A guarded read-only SQL surface over named tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from skillgap.catalog import CONSOLE_FORBIDDEN_WORDS
from skillgap.schema import stringify

#: What a query may be made of; anything else (scripts, commands, table functions, CTEs) is refused.
_ALLOWED_NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "LimitAll", "Offset", "Distinct", "SubqueryAlias",
    "Join", "Union", "Intersect", "Except", "UnresolvedHaving", "Generate", "OneRowRelation", "UnresolvedRelation",
    "UnresolvedSubqueryColumnAliases", "WithWindowDefinition", "Pivot", "Unpivot", "UnresolvedInlineTable",
}
#: Functions that run code by name or look outside the tables.
_REFUSED_FUNCTIONS = {
    "java_method", "reflect", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length",
    "current_user", "session_user", "user", "version", "current_catalog", "current_database", "current_schema",
}


def check_readonly(text: str) -> str:
    """The statement without its last semicolon; ValueError unless it is a plain SELECT."""
    statement = text.strip().rstrip(";")
    if not re.match(r"SELECT\b", statement, re.IGNORECASE):
        raise ValueError("a console statement begins with SELECT")
    for word in CONSOLE_FORBIDDEN_WORDS:
        if re.search(rf"\b{word}\b", statement, re.IGNORECASE):
            raise ValueError(f"the console does not take {word}")
    return statement


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _check_expression(expression, names: set[str]) -> None:
    kind = expression.getClass().getSimpleName()
    if kind == "UnresolvedFunction" and _items(expression.nameParts())[-1].lower() in _REFUSED_FUNCTIONS:
        raise ValueError(f"the console does not call {_items(expression.nameParts())[-1]}")
    if hasattr(expression, "plan") and kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "InSubquery"):
        if kind != "InSubquery":
            _check_plan(expression.plan(), names)
    for child in _items(expression.children()):
        _check_expression(child, names)


def _check_plan(plan, names: set[str]) -> None:
    kind = plan.getClass().getSimpleName()
    if kind not in _ALLOWED_NODES:
        raise ValueError(f"the console does not take statements with {kind}")
    if kind == "UnresolvedRelation":
        parts = _items(plan.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in names:
            raise ValueError(f"the console reads {', '.join(sorted(names))} and not {'.'.join(parts)}")
    for expression in _items(plan.expressions()):
        _check_expression(expression, names)
    for child in _items(plan.children()):
        _check_plan(child, names)


def check_statement(spark: SparkSession, statement: str, names: set[str]) -> None:
    """ValueError unless the parsed statement only reads the named tables."""
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    _check_plan(parsed, {n.lower() for n in names})


def readonly_sql(spark: SparkSession, views: dict[str, DataFrame], text: str, cap: int | None = 50) -> DataFrame:
    """At most ``cap`` rows (None: all) of a SELECT over the given tables only, every cell as text.

    The session's own views of the same names are back in place afterwards.
    """
    statement = check_readonly(text)
    check_statement(spark, statement, set(views))
    temporary = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    own = {name: spark.table(name) for name in views if name.lower() in temporary}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        found = spark.sql(statement)
    finally:
        for name in views:
            if name in own:
                own[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)
    return stringify(found if cap is None else found.limit(cap))
