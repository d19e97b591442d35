"""The guard of ad-hoc SQL: a walk over the plan that Spark's own parser makes of a statement.

What a statement reads is judged on relations as name parts, in the scope of the WITH names that hold where they stand,
and not on text: quoting, comments and spelling do not matter. Only kinds of plan nodes that are known to read nothing
else are let through, so commands, scripts, time travel and names that are made at run time are refused as well.
"""

from __future__ import annotations

from collections.abc import Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import SparkSession

EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions"
#: Plan nodes of a query, besides relations, WITH and table functions, which are judged by name.
NODES = {
    "Aggregate", "Deduplicate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "ResolvedInlineTable", "Sample", "Sort", "SubqueryAlias", "Tail",
    "Union", "UnionLoop", "Unpivot", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedOrderBy", "UnresolvedSubqueryColumnAliases", "UnresolvedTVFAliases", "Window", "WithWindowDefinition",
}
#: Expressions whose meaning is only known at run time.
UNKNOWN = {"ExpressionWithUnresolvedIdentifier", "UnresolvedPlanId"}
#: Functions that run other code than Spark's own, or read files.
FOREIGN = {"reflect", "try_reflect", "java_method", "from_avro", "to_avro", "from_protobuf", "to_protobuf"}
#: Table functions that read nothing.
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "variant_explode", "variant_explode_outer"}


def seq(x: JavaObject) -> Iterator[JavaObject]:
    it = x.iterator()
    while it.hasNext():
        yield it.next()


class Guard:
    """views: relations that may be read; functions: table functions that may be called, both in lower case."""

    def __init__(self, spark: SparkSession, views: set[str], functions: set[str] = frozenset()):
        self.gateway = spark.sparkContext._gateway
        self.parser = spark._jsparkSession.sessionState().sqlParser()
        self.views, self.functions = views, TABLE_FUNCTIONS | functions

    def statement(self, sql: str) -> None:
        self.plan(self.parser.parsePlan(sql), frozenset())

    def expression_text(self, text: str) -> None:
        self.expression(self.parser.parseExpression(text), frozenset())

    def plan(self, p: JavaObject, scope: frozenset[str]) -> None:
        kind = p.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            for name, query, _ in ((r._1(), r._2(), r._3()) for r in seq(p.cteRelations())):
                self.plan(query, scope | {name.lower()} if p.allowRecursion() else scope)
                scope = scope | {name.lower()}
            self.plan(p.child(), scope)
            return
        if kind == "UnresolvedRelation":
            parts = list(seq(p.multipartIdentifier()))
            if len(parts) != 1 or parts[0].lower() not in self.views | scope:
                raise ValueError(f"not a registered view: {'.'.join(parts)}")
        elif kind == "UnresolvedTableValuedFunction":
            parts = list(seq(p.name()))
            if len(parts) != 1 or parts[0].lower() not in self.functions:
                raise ValueError(f"not an allowed table function: {'.'.join(parts)}")
        elif kind not in NODES:
            raise ValueError(f"not allowed in a query: {kind}")
        for e in seq(p.expressions()):
            self.expression(e, scope)
        for child in seq(p.children()):
            self.plan(child, scope)

    def expression(self, e: JavaObject, scope: frozenset[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind in UNKNOWN:
            raise ValueError("names that are made at run time are not allowed")
        if kind == "UnresolvedFunction":
            parts = list(seq(e.nameParts()))
            if len(parts) != 1 or parts[0].lower() in FOREIGN:
                raise ValueError(f"not an allowed function: {'.'.join(parts)}")
        elif kind == "UnresolvedGenerator":
            if e.name().database().isDefined() or e.name().funcName().lower() in FOREIGN:
                raise ValueError(f"not an allowed function: {e.name().funcName()}")
        if is_instance_of(self.gateway, e, f"{EXPRESSIONS}.PlanExpression"):
            self.plan(e.plan(), scope)
        for child in seq(e.children()):
            self.expression(child, scope)


def temporary_views(spark: SparkSession) -> set[str]:
    return {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
