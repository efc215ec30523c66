"""Explicit schemas of every table the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


REPOSITORY_METADATA = _struct(
    full_name=_S, html_url=_S, size=_L, open_issues=_L, watchers=_L, forks=_L, stargazers_count=_L,
    contributors=T.ArrayType(_struct(contributions=_L)),
)
REPOSITORY = _struct(
    id=_S, full_name=_S, size=_L, open_issues=_L, watchers=_L, contributors=_L, forks=_L,
    contributions=_L, stars=_L,
)
FILE = _struct(id=_S, path=_S, repo=_S)
FUNCTION = _struct(id=_S, name=_S, file=_S)
VERSION = _struct(
    id=_S, commit=_S, date=_TS, code=_S, docstring=_S, code_updated=_B, docstring_updated=_B,
    code_similarity=_D, docstring_similarity=_D, function=_S, last_version=_S,
)
FILE_VERSION = _struct(repo=_S, path=_S, commit=_S, committed_at=_TS, seq=_L, content=T.BinaryType())
SAMPLE = _struct(e=_S, l=_B, c=_S, d=_S)
GENERATION = _struct(mid=_S, sample_idx=_I, item_idx=_L, text=_S)
PREDICTION_CACHE = T.MapType(_S, T.ArrayType(T.ArrayType(_S)))
TEXT_EMBEDDING = _struct(item_idx=_L, mid=_S, role=_S, sample_idx=_I, embedding=T.ArrayType(T.FloatType()))
TOKEN_PROB = _struct(mid=_S, item_idx=_L, role=_S, pos=_I, token_id=_I, prob=_D)
TOKEN_WEIGHT = _struct(token_id=_I, weight=_D)
REQUEST = _struct(mid=_S, codes=T.ArrayType(_S), docstrings=T.ArrayType(_S), test_method=_S)
RESULT = _struct(out_of_date=_B, updated_docstring=_S, docstring_score=_D, updated_docstring_score=_D)
RATING = _struct(judge=_S, answer=_S)

# Number of shards per entity.
SHARDS = {"repositories": 8, "files": 16, "functions": 32, "versions": 64}

# The columns of the wide sample table, in order.
WIDE_COLUMNS = (
    "id", "code", "docstring", "code_updated", "docstring_updated", "code_similarity",
    "docstring_similarity", "last_version", "body_begin", "function_name", "filename", "repo_name",
    "size", "open_issues", "watchers", "contributors", "forks", "contributions", "stars",
)

TEST_METHODS = ("distance", "prediction", "update")
DISTANCE_FUNCTIONS = ("cosine", "euclidean")
