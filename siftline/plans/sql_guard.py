"""Read-only SQL over registered tables: parsed by Spark, checked against an allow-list, capped, audited."""

from __future__ import annotations

import re
import threading
import time
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

ROW_CAP, TIMEOUT_S = 500, 10
ROLES_WITH_SQL = ("admin", "analyst")


class Rejected(ValueError):
    """The statement is not allowed; the message says why."""


@dataclass
class Result:
    rows: DataFrame
    truncated: bool
    row_limit: int


@dataclass
class Guard:
    """Runs SELECT statements over ``tables`` and keeps an audit trail."""

    spark: SparkSession
    tables: tuple[str, ...]
    row_cap: int = ROW_CAP
    timeout_s: float = TIMEOUT_S
    trail: list[dict[str, Any]] = field(default_factory=list)

    def check(self, sql: str) -> None:
        """Raises Rejected unless this is one SELECT over allowed tables with functions that compute and do nothing else.

        Tables, names of common table expressions and functions are read from the parsed tree, never from its text.
        """
        if re.search(r"/\*[!+]", sql):
            raise Rejected("executable comments and hints are not allowed")
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        except ParseException as e:
            raise Rejected(f"not one valid statement: {str(e)[:120]}") from None
        found = _Names(self.spark)
        found.walk(plan)
        commands = sorted(k for k in found.kinds if COMMANDS.search(k))
        if commands:
            raise Rejected(f"only SELECT is allowed, not {commands[0]}")
        if found.generators:
            raise Rejected(f"not an allowed table function: {sorted(found.generators)[0]}")
        allowed = {t.lower() for t in self.tables}
        shadowing = {a for a in found.aliases - allowed if self.spark.catalog.tableExists(a)}  # a CTE must not hide a closed table
        strange = sorted(k for k in found.kinds if k not in PLANS) + sorted(found.strange)
        if strange:
            raise Rejected(f"not an allowed part of a statement: {', '.join(strange)}")
        bad = sorted((found.relations - found.aliases - allowed) | shadowing)
        if bad:
            raise Rejected(f"not an allowed table: {', '.join(bad)}")
        unknown = sorted(f for f in found.functions if _group(self.spark, f) not in FUNCTION_GROUPS)
        if unknown:
            raise Rejected(f"not an allowed function: {', '.join(unknown)}")

    def check_read(self, df: DataFrame) -> None:
        """Raises Rejected unless all that the analysed statement reads is an allowed table, a value or a range of numbers."""
        allowed = {t.lower() for t in self.tables}
        names = _Names(self.spark)
        todo = [df._jdf.queryExecution().analyzed()]
        while todo:
            node = todo.pop()
            kind = node.getClass().getSimpleName()
            if kind == "View":
                if (name := node.desc().identifier().table().lower()) not in allowed:
                    raise Rejected(f"not an allowed table: {name}")
                continue
            if kind == "LogicalRelation" and node.catalogTable().isDefined() and node.catalogTable().get().identifier().table().lower() in allowed:
                continue
            under = names.all(node.children()) + names.plans_in(node)
            under += names.all(node.innerChildren()) if kind == "WithCTE" else []
            if not under and kind not in VALUES:
                raise Rejected(f"reads something other than an allowed table: {kind}")
            todo += under

    def query(self, sql: str, args: dict[str, Any] | list[Any] | None = None, role: str = "analyst", user: str = "", limit: int | None = None) -> Result:
        """Rows of an allowed statement, at most the cap, and whether there were more; run once, within the deadline."""
        entry = {"sql": sql, "params": str(args or {}), "user_id": user, "ok": False, "error": None, "created_at": time.time()}
        self.trail.append(entry)
        try:
            if role not in ROLES_WITH_SQL:
                raise Rejected(f"role {role} may not run SQL")
            self.check(sql)
            cap = min(self.row_cap, limit) if limit is not None else self.row_cap
            found = self.spark.sql(sql, args=args) if args else self.spark.sql(sql)
            self.check_read(found)
            found = coerced(found.limit(cap + 1))
            rows = self.with_deadline(self.timeout_s, found.collect)  # the cap and one more
            entry["ok"] = True
            return Result(self.spark.createDataFrame(rows[:cap], found.schema), len(rows) > cap, cap)
        except Exception as e:
            entry["error"] = str(e)[:500]
            raise

    def with_deadline(self, seconds: float, run):
        """Runs ``run()`` and cancels its Spark jobs when the time is over."""
        sc, group, late = self.spark.sparkContext, f"guard-{uuid.uuid4().hex}", threading.Event()

        def cancel() -> None:
            late.set()
            sc.cancelJobGroup(group)

        sc.setJobGroup(group, "guarded query", interruptOnCancel=True)
        timer = threading.Timer(seconds, cancel)
        timer.start()
        try:
            return run()
        except Exception:
            if late.is_set():
                raise TimeoutError(f"the statement took more than {seconds:g} s") from None
            raise
        finally:
            timer.cancel()
            for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                sc.setLocalProperty(name, None)

    def audit(self) -> DataFrame:
        schema = "sql string, params string, user_id string, ok boolean, error string, created_at double"
        return self.spark.createDataFrame([tuple(t[k] for k in ("sql", "params", "user_id", "ok", "error", "created_at")) for t in self.trail], schema)

    def write_audit(self, path: str) -> None:
        """Appends the trail to a table and starts a new one."""
        self.audit().write.mode("append").parquet(path)
        self.trail.clear()


COMMANDS = re.compile(r"Command|Create|Drop|Insert|Delete|Update|Merge|Alter|Truncate|Catalog|Describe|Show|Explain|Cache|AddJar|Analyze|SetVariable|Execute|Call|Overwrite|AppendData|Script")
#: Nodes of a parsed statement that only read, join, filter, group, order and cut; whatever else comes is rejected.
PLANS = frozenset(
    "Project Filter Aggregate UnresolvedHaving Join LateralJoin Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias "
    "UnresolvedRelation UnresolvedWith UnresolvedSubqueryColumnAliases UnresolvedInlineTable LocalRelation OneRowRelation WithWindowDefinition Window Generate Pivot Unpivot "
    "UnresolvedTVFAliases UnresolvedTableValuedFunction".split()
)
#: Expressions that are open until the statement is analysed, and may be: columns, functions, parameters in the place of a value.
OPEN = frozenset(
    "UnresolvedAttribute UnresolvedFunction UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedAlias UnresolvedExtractValue UnresolvedNamedLambdaVariable UnresolvedWindowExpression "
    "UnresolvedGenerator UnresolvedOrdinal UnresolvedRegex UnresolvedInlineTable NamedParameter PosParameter".split()
)
#: Leaves of an analysed statement that read nothing.
VALUES = frozenset("OneRowRelation LocalRelation Range CTERelationRef ResolvedInlineTable".split())
#: Groups of Spark's own functions that only compute. What calls into the JVM or tells about the session is in none of them.
FUNCTION_GROUPS = frozenset(
    f"{g}_funcs" for g in ("agg", "array", "bitwise", "collection", "conditional", "conversion", "csv", "date", "datetime", "generator", "hash", "json", "lambda", "map", "math", "predicate", "string", "struct", "url", "variant", "window")
)


def _group(spark: SparkSession, name: str) -> str:
    """The group of a function of Spark's own; "" for any other, and for one in a database."""
    jvm = spark.sparkContext._jvm.org.apache.spark.sql.catalyst
    found = jvm.analysis.FunctionRegistry.builtin().lookupFunction(jvm.FunctionIdentifier(name))
    return found.get().getGroup() if found.isDefined() else ""


class _Names:
    """What a parsed statement names: relations, common table expressions, functions, table functions, kinds of nodes."""

    def __init__(self, spark: SparkSession):
        self.relations, self.aliases, self.functions, self.generators, self.kinds, self.strange = set(), set(), set(), set(), set(), set()
        load = spark.sparkContext._jvm.java.lang.Class.forName
        self.plans = load("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
        self.holders = load("org.apache.spark.sql.catalyst.expressions.PlanExpression")

    @staticmethod
    def all(seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    def plans_in(self, node) -> list:
        """Subqueries in a node's expressions."""
        found, todo = [], self.all(node.expressions())
        while todo:
            e = todo.pop()
            if self.holders.isInstance(e):
                found.append(e.plan())
            todo += self.all(e.children())
        return found

    def walk(self, root) -> None:
        todo = [root]
        while todo:
            node = todo.pop()
            kind = node.getClass().getSimpleName()
            if self.plans.isInstance(node):
                self.kinds.add(kind)
                todo += self.all(node.expressions())
            elif re.search("Unresolved|Parameter|Identifier", kind) and kind not in OPEN:
                self.strange.add(kind)
            if kind == "UnresolvedRelation":
                self.relations.add(".".join(self.all(node.multipartIdentifier())).lower())
            elif kind == "UnresolvedWith":
                for pair in self.all(node.cteRelations()):
                    self.aliases.add(pair._1().lower())
                    todo.append(pair._2())
            elif kind == "UnresolvedFunction":
                self.functions.add(".".join(self.all(node.nameParts())).lower())
            elif kind == "UnresolvedGenerator":
                self.functions.add(node.name().unquotedString().lower())
            elif "TableValuedFunction" in kind or kind == "UnresolvedTVFAliases":
                self.generators.add(kind)
            if self.holders.isInstance(node):
                todo.append(node.plan())
            todo += self.all(node.children())


def coerced(df: DataFrame) -> DataFrame:
    """Decimals as doubles, bytes as lower-case hex."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, S.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, S.BinaryType):
            c = F.lower(F.hex(c))
        out.append(c.alias(f.name))
    return df.select(*out)


def build_select(spark: SparkSession, table: str, columns: list[str] | None = None, where: dict[str, Any] | None = None, order_by: str | None = None, limit: int = ROW_CAP) -> DataFrame:
    """Columns, equalities, one order and a bounded limit, as a DataFrame rather than as text."""
    for name in [table, *(columns or []), *(where or {}), *([order_by] if order_by else [])]:
        if not re.fullmatch(r"[A-Za-z_]\w{0,63}", name):
            raise Rejected(f"not an identifier: {name}")
    out = spark.table(table)
    for name, value in (where or {}).items():
        out = out.where(F.col(name) == F.lit(value))
    out = out.orderBy(order_by) if order_by else out
    return out.select(*columns).limit(min(limit, ROW_CAP)) if columns else out.limit(min(limit, ROW_CAP))
