"""Function extraction: the one stage that runs Python, because only Python can parse Python.

The UDF sees nothing but the source column, one Arrow batch at a time, and only parses; decoding and
filtering come before it, dedenting and docstring removal after it, both as native expressions.
"""

from __future__ import annotations

import ast
import sys
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.functions.batches import slices
from driftwood.functions.text import dedent, docstring_span, remove_docstring

# The parser travels to the executors by value, so that they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FOUND = T.ArrayType(T.StructType([
    T.StructField("node", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()),
    T.StructField("docstring", T.StringType()), T.StructField("opening", T.ArrayType(T.StringType())), T.StructField("statements", T.IntegerType()),
    T.StructField("code", T.StringType()),
]))
_FOUND_ARROW = pa.list_(pa.struct([
    ("node", pa.int32()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()),
    ("docstring", pa.string()), ("opening", pa.list_(pa.string())), ("statements", pa.int32()), ("code", pa.string()),
]))


def _kind(statement: ast.stmt) -> str:
    """``text``, ``dots`` or ``value`` for an expression, else the statement's name."""
    if not isinstance(statement, ast.Expr):
        return type(statement).__name__
    return {str: "text", type(...): "dots"}.get(type(getattr(statement.value, "value", None)), "value") if isinstance(statement.value, ast.Constant) else "value"


def is_trivial(opening: Column, statements: Column) -> Column:
    """Nothing but one ``pass`` or ``...`` apart from a docstring, from the kinds of the first two statements of a body
    and its number of statements."""
    bare = F.when(F.get(opening, F.lit(0)) == "text", F.get(opening, F.lit(1))).otherwise(F.get(opening, F.lit(0)))
    alone = statements == F.when(F.get(opening, F.lit(0)) == "text", 2).otherwise(1)
    return alone & F.coalesce(bare.isin("Pass", "dots"), F.lit(False))


def _encodable(text: str | None) -> bool:
    """False for escapes of half a surrogate pair, which no UTF-8 table can hold."""
    return text is None or not any("\ud800" <= ch <= "\udfff" for ch in text)


def _functions_of(source: str | None) -> list[dict] | None:
    """Functions of one source in breadth-first order, None where it does not parse."""
    if source is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines = source.split("\n")
    found = []
    for place, node in enumerate(n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)):
        docstring = ast.get_docstring(node)
        if not _encodable(docstring):
            docstring = None
        found.append({
            "node": place, "name": node.name, "start_line": node.lineno, "end_line": node.end_lineno,
            "docstring": docstring, "opening": [_kind(s) for s in node.body[:2]], "statements": len(node.body),
            "code": "\n".join(lines[node.lineno - 1:node.end_lineno]),
        })
    return found


@F.arrow_udf(_FOUND)
def parse_functions(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Hands on what it finds slice by slice: of a batch, only one slice's functions are held."""
    for batch in batches:
        for part in slices([batch]):
            yield pa.array([_functions_of(s.as_py()) for s in batch.slice(*part)], type=_FOUND_ARROW)


def parsed(df: DataFrame, source: str = "source") -> DataFrame:
    """Adds ``functions``, null where the source does not parse, so that rejects can be counted."""
    return df.withColumn("functions", parse_functions(F.col(source)))


def extract_functions(df: DataFrame, source: str = "source") -> DataFrame:
    """One row per function: name, line span, cleaned docstring, source slice, trivial flag.

    The outer form with a filter behind it: for a plain ``explode`` Spark would add a filter on the array
    before it, and so parse every source twice.
    """
    keep = [c for c in df.columns if c != source]
    return (
        parsed(df, source).select(*keep, F.explode_outer("functions").alias("_f")).select(*keep, "_f.*")
        .filter(F.col("name").isNotNull())
        .withColumn("trivial", is_trivial(F.col("opening"), F.col("statements"))).drop("opening", "statements")
    )


def has_docstring(docstring: Column) -> Column:
    return docstring.isNotNull() & (docstring != "")


def documented_functions(functions: DataFrame) -> DataFrame:
    """Functions worth mining: not trivial, documented; code dedented and without its docstring."""
    return (
        functions.filter(~F.col("trivial") & has_docstring(F.col("docstring")))
        .withColumn("code", remove_docstring(dedent(F.col("code"))))
        .filter(F.col("code").isNotNull())
    )


def located_functions(functions: DataFrame) -> DataFrame:
    """Every function with its docstring's line span in the file; null lines where it has no docstring."""
    documented = has_docstring(F.col("docstring"))
    span = docstring_span(F.col("code"))
    return (
        functions.withColumn("has_docstring", documented)
        .withColumn("_span", span)
        .withColumn("docstring_start_line", F.when(documented, F.col("_span.first_line") + F.col("start_line") - 1))
        .withColumn("docstring_end_line", F.when(documented, F.col("_span.last_line") + F.col("start_line") - 1))
        .withColumn("code", F.when(documented, remove_docstring(F.col("code"))).otherwise(F.col("code")))
        .withColumn("docstring", F.coalesce("docstring", F.lit("")))
        .drop("_span", "trivial", "node")
    )


def scatter_results(functions: DataFrame, scored: DataFrame, key: list[str]) -> DataFrame:
    """Puts the decisions of the scored functions back; a function that was not scored is not up to date."""
    decisions = scored.select(*key, F.col("out_of_date").alias("_out"))
    return (
        functions.join(decisions, key, "left")
        .withColumn("up_to_date", F.coalesce(~F.col("_out"), F.lit(False)))
        .drop("_out")
    )
