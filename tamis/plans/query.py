"""Q1–Q2 SQL over the current table, P1–P8 projections, filters and column finders."""

from __future__ import annotations

import ast
import json
import re
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from tamis.functions.fixed import EXPRESSION_FUNCTIONS, SQL_FUNCTIONS, SQL_WORDS
from tamis.operators.base import StepError, col, one_row


def _strip_comments(q: str) -> str:
    q = re.sub(r"/\*.*?\*/", " ", q, flags=re.S)
    return re.sub(r"--[^\n]*", " ", q)


def _without_literals(text: str) -> str:
    """The text with its quoted strings emptied, so that their contents are not read as code."""
    return re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"", "''", text)


def check_functions(text: str) -> None:
    """Refuse calls of functions that aren't on the list shared by queries, filters and expressions."""
    plain = _without_literals(_strip_comments(text))
    if re.search(r"`\s*\(", plain):
        raise StepError("a function name can't be quoted")
    called = {n.lower() for n in re.findall(r"([A-Za-z_][A-Za-z0-9_]*)\s*\(", plain)}
    bad = sorted(called - set(SQL_WORDS) - set(SQL_FUNCTIONS) - set(EXPRESSION_FUNCTIONS))
    if bad:
        raise StepError(f"functions not allowed: {bad}")


def relations(spark, statement: str) -> set[str]:
    """Names of the tables that a statement reads, as Spark's own parser sees them; its WITH names left out."""
    nodes = json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(statement).toJSON())
    read, own = set(), set()

    def walk(x):
        if isinstance(x, dict):
            kind = str(x.get("class", "")).rpartition(".")[2]
            if kind == "UnresolvedRelation":
                read.add(str(x.get("multipartIdentifier")).strip("[]").replace(", ", "."))
            elif kind == "UnresolvedWith":
                own.update(re.findall(r"[\[(]+([A-Za-z_][A-Za-z0-9_]*),", str(x.get("cteRelations"))))
            for v in x.values():
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)

    walk(nodes)
    return read - own


def validate_sql_query(q: str) -> str:
    """Q2: a single SELECT (or WITH … SELECT) statement that calls listed functions only."""
    body = _strip_comments(q).strip().rstrip(";").strip()
    plain = _without_literals(body)
    if ";" in plain:
        raise StepError("only one statement is allowed")
    if not re.match(r"(?is)^(select|with)\b", body):
        raise StepError("only SELECT queries are allowed")
    check_functions(body)
    return body


def run_sql(df: DataFrame, q: str, view: str = "df") -> DataFrame:
    """Q1: ``q`` over all rows of ``df``, registered as the temporary view ``df``; no other table is read."""
    body = validate_sql_query(q)
    with_names = {n.lower() for n in re.findall(r"(?i)(?:\bwith\b|,)\s*([A-Za-z_][A-Za-z0-9_]*)\s+as\s*\(", _without_literals(body))}
    other = {r for r in relations(df.sparkSession, body) if r.lower() != view.lower() and r.lower() not in with_names}
    if other:
        raise StepError(f"only the table {view!r} can be read, not {sorted(other)}")
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(body)


def select_columns(df: DataFrame, columns) -> DataFrame:
    """P1."""
    return df.select(*[col(c) for c in columns])


def filter_rows(df: DataFrame, predicate: str) -> DataFrame:
    """A Spark SQL boolean expression (``AND``, ``OR``, ``IN``, ``IS NULL``, ``LIKE``…) with listed functions.

    A predicate is parsed by Spark, so it cannot smuggle a second statement; subqueries are refused.
    """
    check_functions(predicate)
    plain = _without_literals(predicate)
    if ";" in plain or "--" in plain or "/*" in plain or re.search(r"(?i)\bselect\b", plain):
        raise StepError("a predicate is one expression without subqueries")
    return df.where(F.expr(predicate))


def _positive(fn):
    return lambda x: F.when(x > 0, fn(x))


# How each function of EXPRESSION_FUNCTIONS is computed; values outside its domain give NULL.
FUNCTIONS = {
    "log": _positive(F.ln),
    "log10": _positive(F.log10),
    "log1p": lambda x: F.when(x > -1, F.log1p(x)),
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "abs": F.abs, "round": F.round, "floor": F.floor, "ceil": F.ceil,
}
OPERATORS = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    ast.Mod: F.try_mod,
    ast.Pow: F.pow,
}


def expression(df: DataFrame, text: str) -> tuple[Column, list[str]]:
    """The column that an arithmetic expression over ``df`` stands for, and the columns that it uses.

    Operators are + - * / % ** with Python's precedence, unary signs and parentheses. A
    division or remainder by zero gives NULL. Names with other characters stand in backticks.
    """
    quoted: list[str] = []

    def hide(m):
        quoted.append(m[1])
        return f"__quoted_{len(quoted) - 1}"

    try:
        tree = ast.parse(re.sub(r"`([^`]+)`", hide, text.strip()), mode="eval").body
    except SyntaxError as error:
        raise StepError(f"not an arithmetic expression: {text!r}") from error
    used: list[str] = []

    def build(node) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in OPERATORS:
            return OPERATORS[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            hidden = re.fullmatch(r"__quoted_(\d+)", node.id)
            name = quoted[int(hidden[1])] if hidden else node.id
            if name not in df.columns:
                raise StepError(f"column not in DataFrame: {name!r}")
            used.append(name)
            return col(name)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            name = node.func.id.lower()
            if name not in FUNCTIONS:
                raise StepError(f"functions not allowed: {[node.func.id]}")
            if name == "round" and len(node.args) == 2 and isinstance(node.args[1], ast.Constant):
                return F.round(build(node.args[0]), int(node.args[1].value))
            if len(node.args) == 1:
                return FUNCTIONS[name](build(node.args[0]))
        raise StepError(f"not allowed in an expression: {ast.unparse(node)!r}")

    value = build(tree)
    if not used:
        raise StepError("expression must use at least one existing column")
    return value, list(dict.fromkeys(used))


def add_expression_column(df: DataFrame, text: str, new_col: str, check: bool = True) -> DataFrame:
    """Arithmetic over existing columns and the listed math functions.

    ``check`` runs one aggregation: an expression that gives no value for any row is refused,
    and a warning says how many rows with complete inputs have none (zero divisors, logs and
    roots outside their domain).
    """
    value, used = expression(df, text)
    if check:
        complete = F.lit(True)
        for c in used:
            complete = complete & col(c).isNotNull()
        rows, lost, given = df.agg(F.count(F.lit(1)), F.count_if(complete & value.isNull()), F.count(value)).first()
        if rows and not given:
            raise StepError("the expression gives no value for any row")
        if lost:
            warnings.warn(f"{lost} rows with complete inputs have no value for {text!r}", stacklevel=2)
    return df.withColumn(new_col, value)


def dtype_split(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, other) column names."""
    nums = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    return nums, [c for c in df.columns if c not in nums]


def page(df: DataFrame, order_by, page_number: int, page_size: int = 100, after=None) -> DataFrame:
    """P5: one page of rows in a total order.

    ``after`` holds the key values of the last row of the page before: the page then is a
    filter and a top-k, at any depth. Without it the page is found by its number.
    """
    size = max(10, min(1000, int(page_size)))
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    keys = [col(c) for c in order_by]
    if after is not None:
        values = [after] if not isinstance(after, (list, tuple)) else list(after)
        later = F.struct(*keys) > F.struct(*[F.lit(v).cast(df.schema[c].dataType) for c, v in zip(order_by, values, strict=True)])
        return df.where(later).orderBy(*keys).limit(size)
    return df.orderBy(*keys).offset(max(0, int(page_number)) * size).limit(size)


def date_like_columns(df: DataFrame) -> list[str]:
    """Typed date/time columns and text columns with a value like ``yyyy-mm-dd``."""
    out = [f.name for f in df.schema.fields if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType))]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if texts:
        row = one_row(df, *[F.bool_or(F.coalesce(col(c).rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit(False))).alias(f"t{i}") for i, c in enumerate(texts)])
        out += [c for i, c in enumerate(texts) if row[f"t{i}"]]
    return [c for c in df.columns if c in out]


def boolean_like_columns(df: DataFrame) -> list[str]:
    """Every value in {0, 1, '0', '1', true, false}; a NULL fails the test."""
    tests = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, BooleanType):
            t = c.isNotNull()
        elif isinstance(f.dataType, NumericType):
            t = c.cast("double").isin(0.0, 1.0)
        elif isinstance(f.dataType, StringType):
            t = c.isin("0", "1")
        else:
            t = F.lit(False)
        tests.append(F.bool_and(F.coalesce(t, F.lit(False))).alias(f.name))
    if not tests:
        return []
    row = one_row(df, *tests).asDict()
    return [c for c in df.columns if row[c]]


def url_columns(df: DataFrame) -> list[str]:
    """Text columns with any value starting ``http://`` or ``https://``."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not texts:
        return []
    row = one_row(df, *[F.bool_or(F.coalesce(col(c).rlike(r"^https?://"), F.lit(False))).alias(f"t{i}") for i, c in enumerate(texts)])
    return [c for i, c in enumerate(texts) if row[f"t{i}"]]
