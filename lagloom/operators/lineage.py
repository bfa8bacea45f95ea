"""Where a statement's columns come from, by Spark's analysed plan.

Spark resolves the statement against the session's views; every column then has an expression id, and every alias names
the ids that its expression reads. Ids are followed from the statement's output through projections, aggregates,
windows, joins, unions, subqueries and common table expressions down to the columns of named views. Nothing runs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lagloom.functions import fixed


def _each(seq: JavaObject) -> Iterator[JavaObject]:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


class _Plan:
    """Ids of columns, and the ids or the base columns (view, column) that they stem from."""

    def __init__(self, views: set[str]) -> None:
        self.views, self.read, self.base, self.cte = views, {}, {}, {}

    def _expression(self, e: JavaObject) -> set[int]:
        """The ids that an expression reads; aliases in it are noted, plans in it walked."""
        kind = e.nodeName()
        if kind == "AttributeReference":
            return {e.exprId().id()}
        ids = set()
        for child in _each(e.children()):
            ids |= self._expression(child)
        if hasattr(e, "plan") and kind.lower().endswith(("subquery", "exists")):
            ids |= self.walk(e.plan())
        if kind == "Alias":
            self.read.setdefault(e.exprId().id(), set()).update(ids)
            return {e.exprId().id()}
        return ids

    def walk(self, plan: JavaObject) -> set[int]:
        """Note what the plan's columns stem from; gives the ids of its output."""
        kind, output = plan.nodeName(), [a for a in _each(plan.output())]
        ids = [a.exprId().id() for a in output]
        if kind == "SubqueryAlias" and plan.alias().lower() in self.views:
            for a in output:
                self.base[a.exprId().id()] = (plan.alias().lower(), a.name().lower())
            return set(ids)
        if kind == "WithCTE":
            for d in _each(plan.cteDefs()):
                self.walk(d)
                self.cte[d.id()] = [a.exprId().id() for a in _each(d.output())]
        if kind == "CTERelationRef":
            for own, of in zip(ids, self.cte.get(plan.cteId(), []), strict=False):
                if own != of:
                    self.read.setdefault(own, set()).add(of)
            return set(ids)
        children = list(_each(plan.children()))
        below = [self.walk(c) for c in children if c.nodeName() != "CTERelationDef"]
        for e in _each(plan.expressions()):
            self._expression(e)
        if kind in ("Union", "Intersect", "Except", "Expand", "Generate"):
            sides = [[a.exprId().id() for a in _each(c.output())] for c in children]
            for i, own in enumerate(ids):
                # A generator's own columns may stem from any that it reads.
                of = {s[i] for s in sides if kind != "Generate" and i < len(s)} if kind != "Generate" else set() if any(own in s for s in sides) else set().union(*below)
                self.read.setdefault(own, set()).update(of - {own})
        return set(ids)

    def stems(self, ids: Iterable[int]) -> set[tuple[str, str]]:
        """Base columns behind ``ids``."""
        found, seen, todo = set(), set(), list(ids)
        while todo:
            i = todo.pop()
            if i in seen:
                continue
            seen.add(i)
            if i in self.base:
                found.add(self.base[i])
            else:
                todo += self.read.get(i, ())
        return found


def columns(spark: SparkSession, sql: str, views: Iterable[str]) -> list[tuple[str, set[tuple[str, str]]]]:
    """The statement's output columns in order, each with the (view, column) pairs of ``views`` that it stems from."""
    plan = spark.sql(sql)._jdf.queryExecution().analyzed()
    held = _Plan({v.lower() for v in views})
    held.walk(plan)
    return [(a.name().lower(), held.stems([a.exprId().id()])) for a in _each(plan.output())]


def aliases(spark: SparkSession, sql: str, views: Iterable[str]) -> list[tuple[str, set[tuple[str, str]]]]:
    """Every name that the statement gives, at any depth, with the base columns behind it."""
    plan = spark.sql(sql)._jdf.queryExecution().analyzed()
    held = _Plan({v.lower() for v in views})
    held.walk(plan)
    out = []

    def names(e: JavaObject) -> None:
        if e.nodeName() == "Alias":
            out.append((e.name().lower(), held.stems([e.exprId().id()])))
        for c in _each(e.children()):
            names(c)
        if hasattr(e, "plan") and e.nodeName().lower().endswith(("subquery", "exists")):
            nodes(e.plan())

    def nodes(p: JavaObject) -> None:
        if p.nodeName() == "SubqueryAlias" and p.alias().lower() in held.views:
            return
        for e in _each(p.expressions()):
            names(e)
        for c in _each(p.children()):
            nodes(c)

    nodes(plan)
    return out


def foreign_aliases(spark: SparkSession, sql: str, views: Iterable[str], instruments: list[str] | None = None, context: list[str] | None = None) -> list[tuple[str, str]]:
    """(context column, foreign name) for each foreign instrument's name that the statement gives to something that
    stems from a context column and from nothing of that name: ``usd_rub AS dxy``, however deep, computed or renamed in between.

    A statement that Spark can't resolve or parse has none: it could not run either.
    """
    foreign = {x.lower() for x in instruments or fixed.FOREIGN_INSTRUMENTS}
    own = {x.lower() for x in context or fixed.CONTEXT_COLUMNS}
    try:
        named = aliases(spark, sql, views)
    except (AnalysisException, ParseException):
        return []
    return sorted({(c, name) for name, stems in named if name in foreign and name not in {x for _, x in stems} for _, c in stems if c in own})


def checked(statements: DataFrame, key: str, sql: str, tables: dict[str, StructType], most: int = 10_000) -> DataFrame:
    """(key, pairs): the foreign aliases of each statement, resolved against empty views of ``tables`` (name -> schema).

    Analysis is the driver's work. Equal statements are analysed once; more than ``most`` distinct ones are an error, not
    a cut.
    """
    spark = statements.sparkSession
    distinct = [r[0] for r in statements.select(sql).filter(f"`{sql}` is not null").distinct().limit(most + 1).collect()]
    if len(distinct) > most:
        raise ValueError(f"more than {most} distinct statements")
    own = spark.newSession()
    for name, schema in tables.items():
        own.createDataFrame([], schema).createOrReplaceTempView(name)
    found = [(s, [f"{c} AS {n}" for c, n in foreign_aliases(own, s, tables)]) for s in distinct]
    told = spark.createDataFrame(found, "_sql string, pairs array<string>")
    return statements.join(told, statements[sql] == told["_sql"], "left").select(key, "pairs")
