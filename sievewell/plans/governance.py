"""Extension: who may read what in SQL. Tables are authorised, columns masked, rows filtered, and a statement's columns traced.

Every principal gets a session of its own in which each table that it may read is a view over the real one: rows
filtered, columns of restricted tags masked, denied columns left out. A statement is resolved against these views, so
aliases, joins, common table expressions, subqueries and conditions meet masked values only, wherever they stand, and
Catalyst still prunes and pushes down through the views. The analysed plan is then walked: it may rest on nothing but
these views, and a masked column may be shown, but not compared, grouped or sorted by. An expression with an error that
depends on a row could still tell of rows that the filter hides, so errors of a run are reported without their text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from . import sql_gate
from .sql_gate import Execution, UnsafeSQL

LEVELS = ("public", "internal", "confidential", "restricted")

#: How a masked column looks: a constant, nothing, or a digest that keeps equal values equal.
MASKS: dict[str, Callable[[Column, str], Column]] = {
    "stars": lambda c, kind: F.when(c.isNotNull(), F.lit("***")) if kind == "string" else F.lit(None).cast(kind),
    "null": lambda c, kind: F.lit(None).cast(kind),
    "hash": lambda c, kind: F.sha2(c.cast("string"), 256),
}

Field = tuple[str, str]


class Denied(UnsafeSQL):
    """The principal may not run the statement."""


@dataclass(frozen=True)
class Principal:
    name: str
    roles: frozenset[str] = frozenset()
    clearance: str = "public"
    teams: frozenset[str] = frozenset()
    attributes: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Asset:
    """What the catalog knows of a table. ``rows`` gives the rows that a principal may see; it gets a function that loads any real table."""

    table: str
    classification: str = "internal"
    owner_team: str = ""
    tags: dict[str, frozenset[str]] = field(default_factory=dict)
    denied: frozenset[str] = frozenset()
    rows: Callable[[DataFrame, Principal, Callable[[str], DataFrame]], DataFrame] | None = None


@dataclass(frozen=True)
class Rule:
    """Tags that a role may not see, and how they are masked. A principal sees a tag if one of its roles does."""

    hidden: dict[str, str]
    #: Roles for which no row filter holds.
    all_rows: bool = False


@dataclass(frozen=True)
class Lineage:
    """The fields that each output column, all conditions, and the whole statement rest on."""

    outputs: dict[str, frozenset[Field]]
    conditions: frozenset[Field]
    used: frozenset[Field]


_SETS = {"Union", "Intersect", "Except", "UnionLoop"}
_NO_TABLE = {"OneRowRelation", "LocalRelation", "Range"}


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _items(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


class _Walk:
    """Walks an analysed plan; ``at`` has the fields of every attribute by its expression id."""

    def __init__(self, views: set[str]):
        self.views, self.at, self.ctes = views, {}, {}
        self.conditions: set[Field] = set()
        self.used: set[Field] = set()

    def of(self, e) -> frozenset[Field]:
        """The fields that an expression rests on."""
        kind = _kind(e)
        if kind == "AttributeReference":
            return self.at.get(e.exprId().id(), frozenset())
        out = frozenset().union(*(self.of(c) for c in _items(e.children())))
        if kind in sql_gate._SUBQUERIES:
            out = out.union(*self.plan(e.plan()))
        if kind == "Alias":
            self.at[e.exprId().id()] = out
        return out

    def plan(self, p) -> list[frozenset[Field]]:
        """The fields of each output column of a plan."""
        kind = _kind(p)
        output = list(_items(p.output())) if kind != "WithCTE" else []
        if kind == "View":
            table = p.desc().identifier().table().lower()
            if table not in self.views:
                raise Denied(f"{table} is not readable")
            out = [frozenset({(table, a.name())}) for a in output]
            self.used |= set().union(*out)
        elif kind == "WithCTE":
            for d in _items(p.cteDefs()):
                self.ctes[d.id()] = self.plan(d.child())
            return self.plan(p.plan())
        elif kind == "CTERelationRef":
            out = self.ctes.get(p.cteId()) or [frozenset()] * len(output)
        elif kind in _NO_TABLE:
            out = [frozenset()] * len(output)
        else:
            kids = [self.plan(c) for c in _items(p.children())]
            if not kids:
                raise Denied("the statement reads something that is not a governed table")
            each = [self.of(e) for e in _items(p.expressions())]
            self._conditions(kind, p, each, kids)
            if kind in _SETS:
                out = [frozenset().union(*(k[i] for k in kids)) for i in range(len(output))]
            else:  # what an operator makes without a name of its own rests on all that it reads
                rest = frozenset().union(*each)
                out = [self.at.get(a.exprId().id(), rest) for a in output]
        for a, fields in zip(output, out, strict=True):
            self.at[a.exprId().id()] = fields
        return out

    def _conditions(self, kind, p, each, kids) -> None:
        if kind in ("Filter", "Join", "Sort", "AsOfJoin", "LateralJoin"):
            self.conditions.update(*each)
        elif kind == "Aggregate":
            self.conditions.update(*(self.of(e) for e in _items(p.groupingExpressions())))
        elif kind == "Window":
            self.conditions.update(*(self.of(e) for s in (p.partitionSpec(), p.orderSpec()) for e in _items(s)))
        elif kind in ("Intersect", "Except", "Distinct", "Deduplicate"):
            self.conditions.update(*(f for k in kids for f in k))


class Governor:
    """Runs statements for principals over a catalog of tables. ``load`` reads a table in a given session."""

    def __init__(self, spark: SparkSession, load: Callable[[SparkSession, str], DataFrame], assets: list[Asset], rules: dict[str, Rule]):
        self.spark, self.load, self.rules = spark, load, rules
        self.assets = {a.table.lower(): a for a in assets}
        self._sessions: dict[str, tuple[Principal, SparkSession]] = {}

    def may_read(self, who: Principal, table: str) -> bool:
        """By clearance, or as a member of the owner's team; a principal without a known role reads nothing."""
        a = self.assets.get(table.lower())
        if a is None or not any(r in self.rules for r in who.roles):
            return False
        return LEVELS.index(who.clearance) >= LEVELS.index(a.classification) or a.owner_team in who.teams

    def masked(self, who: Principal, table: str) -> dict[str, str]:
        """The masked columns of a table, each with the mask of the first of its tags (in order) that no role of the principal sees."""
        rules = [self.rules[r] for r in sorted(who.roles) if r in self.rules]
        out = {}
        for column, tags in self.assets[table.lower()].tags.items():
            for tag in sorted(tags):
                kinds = [r.hidden.get(tag) for r in rules]
                if all(kinds):
                    out[column] = kinds[0]
                    break
        return out

    def view(self, session: SparkSession, who: Principal, table: str) -> DataFrame:
        """The rows and columns of a table that a principal sees."""
        a, load = self.assets[table.lower()], lambda name: self.load(session, name)
        df = load(a.table)
        if a.rows and not any(self.rules[r].all_rows for r in who.roles if r in self.rules):
            df = a.rows(df, who, load)
        masks = self.masked(who, table)
        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        return df.select(*[MASKS[masks[c]](F.col(c), kinds[c]).alias(c) if c in masks else F.col(c) for c in df.columns if c not in a.denied])

    def session(self, who: Principal) -> SparkSession:
        """The principal's session, with a view for each table that it may read."""
        if self._sessions.get(who.name, (None, None))[0] != who:
            s = self.spark.newSession()
            for k, v in self.spark.conf.getAll.items():  # what the owner set for this session, in the new one
                if s.conf.isModifiable(k):
                    s.conf.set(k, v)
            for t in self.assets:
                if self.may_read(who, t):
                    self.view(s, who, t).createOrReplaceTempView(t)
            self._sessions[who.name] = (who, s)
        return self._sessions[who.name][1]

    def lineage(self, df: DataFrame) -> Lineage:
        walk = _Walk(set(self.assets))
        fields = walk.plan(df._jdf.queryExecution().analyzed())
        return Lineage(dict(zip(df.columns, fields, strict=True)), frozenset(walk.conditions), frozenset(walk.used))

    def query(self, who: Principal, sql: str) -> DataFrame:
        """The statement's rows as the principal may see them; raises Denied or UnsafeSQL."""
        session = self.session(who)
        sql_gate.check(session, sql)
        try:
            df = session.sql(sql)
        except Exception as e:
            raise Denied(f"it can't be resolved for {who.name}: {str(e).splitlines()[0][:200]}") from None
        masked = {(t, c) for t in self.assets if self.may_read(who, t) for c in self.masked(who, t)}
        if bad := sorted(self.lineage(df).conditions & masked):
            raise Denied("masked columns can't be compared, grouped or sorted by: " + ", ".join(f"{t}.{c}" for t, c in bad))
        return df

    def run(self, who: Principal, reply: str, settings: Settings = Settings()) -> Execution:  # noqa: B008
        """Runs the statement of a model's reply under the guards of the SQL path; refusals and failures become Execution.error."""
        session = self.session(who)
        try:
            sql = sql_gate.safe_select(session, reply)
            self.query(who, sql)
        except UnsafeSQL as e:
            return Execution(reply, error=f"refused: {e}")
        done = sql_gate.run(session, sql, settings)
        if done.error and done.error.startswith("SQL execution failed"):
            done.error = "SQL execution failed"
        return done

    def schema(self, who: Principal) -> dict[str, list[str]]:
        """What a prompt may show: the tables that the principal may read, with their columns."""
        session = self.session(who)
        return {t: session.table(t).columns for t in sorted(self.assets) if self.may_read(who, t)}
