"""Ad-hoc read-only SQL over the tables.

A statement is parsed, and its tree is read before anything is resolved: every node and expression must be of a listed kind,
every relation a registered table or a name of its own WITH, every function a built-in one of a listed group. What is not
listed is refused, so that names of files, sources and classes never reach the analyser.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_ROWS = 100
#: Names registered, by session.
_registered: dict[str, set[str]] = {}


def register(tables: dict[str, DataFrame]) -> None:
    """Make tables known by name to read-only statements of their session."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
        _registered.setdefault(_session(df.sparkSession), set()).add(name.lower())


def _session(spark: SparkSession) -> str:
    return spark._jsparkSession.sessionUUID()


#: Kinds of Spark's plan nodes that a query may have.
NODES = frozenset(
    """Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Union Intersect Except SubqueryAlias
    UnresolvedWith UnresolvedHaving UnresolvedRelation UnresolvedInlineTable UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction
    UnresolvedTVFAliases OneRowRelation LocalRelation Generate WithWindowDefinition Pivot Unpivot Sample""".split()
)
#: Kinds of its expressions.
EXPRESSIONS = frozenset(
    """UnresolvedAttribute AttributeReference UnresolvedStar UnresolvedAlias UnresolvedRegex UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedOrdinal
    UnresolvedSubqueryColumnAliases UnresolvedWindowExpression UnresolvedNamedLambdaVariable Alias MultiAlias Literal Cast TryCast SortOrder
    And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual In InSubquery Between IsNull IsNotNull IsUnknown IsNotUnknown
    Like ILike LikeAll LikeAny NotLikeAll NotLikeAny RLike Contains StartsWith EndsWith StringTrim StringTrimLeft StringTrimRight Substring StringLocate
    Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive BitwiseAnd BitwiseOr BitwiseXor BitwiseNot ShiftLeft ShiftRight ShiftRightUnsigned
    CaseWhen If Coalesce Concat CreateNamedStruct CreateStruct CreateArray CreateMap LambdaFunction WindowExpression WindowSpecDefinition WindowSpecReference
    SpecifiedWindowFrame UnspecifiedFrame CurrentRow UnboundedPreceding UnboundedFollowing RowFrame RangeFrame Extract TimestampAdd TimestampDiff
    CurrentDate CurrentTimestamp ScalarSubquery Exists ListQuery LateralSubquery GroupingSets Cube Rollup BaseGroupingSets MakeInterval""".split()
)
#: Groups of built-in functions; those that run code, read files or tell of the machine lie in others.
GROUPS = frozenset(
    """agg_funcs window_funcs array_funcs map_funcs struct_funcs collection_funcs lambda_funcs generator_funcs string_funcs math_funcs bitwise_funcs
    conditional_funcs predicate_funcs conversion_funcs datetime_funcs hash_funcs json_funcs""".split()
)
#: Functions that give rows.
TABLES = frozenset(["range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"])


class Refused(ValueError):
    """The statement is not a plain query over registered tables."""


def _items(seq: JavaObject) -> Iterator[JavaObject]:
    return (seq.apply(k) for k in range(seq.size()))


def _kind(x: JavaObject) -> str:
    return x.getClass().getSimpleName().rstrip("$")


class _Reader:
    def __init__(self, spark: SparkSession):
        self.known = _registered.get(_session(spark), set())
        self.catalog = spark._jsparkSession.sessionState().catalog()
        self.name_of = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier

    def _function(self, parts: list[str]) -> None:
        try:
            info = self.catalog.lookupFunctionInfo(self.name_of(parts[0])) if len(parts) == 1 else None
        except Py4JJavaError:
            info = None
        if info is None or info.getGroup() not in GROUPS or info.getSource() != "built-in":
            raise Refused(f"function {'.'.join(parts)}")

    def expression(self, e: JavaObject, names: set[str]) -> None:
        kind = _kind(e)
        if kind not in EXPRESSIONS:
            raise Refused(f"expression {kind}")
        if kind == "UnresolvedFunction":
            self._function(list(_items(e.nameParts())))
            if e.filter().isDefined():
                self.expression(e.filter().get(), names)
        elif kind == "UnresolvedGenerator":
            self._function([*([e.name().database().get()] if e.name().database().isDefined() else []), e.name().funcName()])
        elif kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            self.plan(e.plan(), names)
        elif kind == "InSubquery":
            self.expression(e.query(), names)
        for child in _items(e.children()):
            self.expression(child, names)

    def plan(self, p: JavaObject, names: set[str]) -> None:
        """names: tables that can be read here."""
        kind = _kind(p)
        if kind not in NODES:
            raise Refused(kind)
        if kind == "UnresolvedWith":
            names = set(names)
            for named in _items(p.cteRelations()):
                own = named._1().lower()
                self.plan(named._2(), names | ({own} if p.allowRecursion() else set()))
                names.add(own)
        elif kind == "UnresolvedRelation":
            parts = list(_items(p.multipartIdentifier()))
            if len(parts) != 1 or parts[0].lower() not in names or p.isStreaming():
                raise Refused(f"table {'.'.join(parts)}")
        elif kind == "UnresolvedTableValuedFunction":
            if (parts := [x.lower() for x in _items(p.name())])[1:] or parts[0] not in TABLES:
                raise Refused(f"table function {'.'.join(parts)}")
        elif kind == "WithWindowDefinition":
            for spec in _items(p.windowDefinitions().values().toSeq()):
                self.expression(spec, names)
        for e in _items(p.expressions()):
            self.expression(e, names)
        for child in _items(p.children()):
            self.plan(child, names)


def read_only(spark: SparkSession, sql: str) -> DataFrame:
    """The query's rows; ValueError for anything that is not a plain query over tables given to register()."""
    if not sql.strip():
        raise Refused("not a read-only query: empty")
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except (PySparkException, Py4JJavaError):
        raise Refused("not a read-only query: a statement that does not parse") from None
    reader = _Reader(spark)
    try:
        reader.plan(parsed, reader.known)
    except Refused as e:
        raise Refused(f"not a read-only query: {e}") from None
    return spark.sql(sql)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))


@dataclass
class CappedRows:
    rows: list[str]
    truncated: bool


def query_rows(spark: SparkSession, sql: str, rows: int = DEFAULT_ROWS) -> CappedRows:
    """At most so many rows as JSON, and whether there were more."""
    got = [r["row"] for r in as_json(read_only(spark, sql)).limit(rows + 1).collect()]
    return CappedRows(got[:rows], len(got) > rows)
