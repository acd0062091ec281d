"""Analysts' SQL: one read-only statement, over the event view alone, with the rows of their sources only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(ValueError):
    """The statement isn't one that may run."""


def _nodes(plan):
    """All nodes of a parsed plan, with those of subqueries and of WITH."""
    yield plan
    for kids in (plan.children(), plan.subqueries(), plan.innerChildren()):
        it = kids.iterator()
        while it.hasNext():
            kid = it.next()
            if "LogicalPlan" in " ".join(c.getName() for c in _classes(kid)):
                yield from _nodes(kid)


def _classes(x):
    """The class of x with all that it extends."""
    todo = [x.getClass()]
    while todo:
        c = todo.pop()
        if c is not None:
            yield c
            todo += [c.getSuperclass(), *c.getInterfaces()]


def check(spark: SparkSession, sql: str, tables: tuple[str, ...] = ("events",)) -> None:
    """Refuses what Spark's parser doesn't read as one query over the given tables and the query's own WITH."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused("not one SQL statement") from e
    nodes, own = list(_nodes(plan)), set()
    for node in nodes:
        kinds = {c.getSimpleName() for c in _classes(node)}
        if kinds & {"Command", "ParsedStatement", "UnaryCommand", "LeafCommand", "V2WriteCommand"}:
            raise Refused("only queries may run")
        if node.getClass().getSimpleName() == "UnresolvedWith":
            it = node.cteRelations().iterator()
            while it.hasNext():
                own.add(it.next()._1().lower())
    for node in nodes:
        if node.getClass().getSimpleName() == "UnresolvedRelation" and node.tableName().lower() not in {*tables, *own}:
            raise Refused(f"no table {node.tableName()}")


def scoped(spark: SparkSession, sql: str, events: Callable[[SparkSession], DataFrame], sources: list[str]) -> DataFrame:
    """The result of sql over `events`, which holds the rows of the given sources alone; none for none.

    The statement runs in a session of its own, so that its subqueries see the same rows and nothing else is in scope.
    """
    check(spark, sql)
    inner = spark.newSession()
    inner.conf.set("spark.sql.runSQLOnFiles", "false")
    found = events(inner)
    found.where(F.col("source").isin(sources) if sources else F.lit(False)).createOrReplaceTempView("events")
    return inner.sql(sql)
