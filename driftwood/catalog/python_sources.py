"""Python sources made from documents, and what must be found in them.

Ten kinds of source, by ``doc_id % 10``. ``{id}`` and ``{n}`` are the document's number and length, ``{d}``
its whole text as it may stand in a string literal. The expectations are spelled out beside the sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.catalog.registry import table
from driftwood.catalog.views import plain

SOURCES = [
    'import math\n\ndef f_{id}(x):\n    """{d}"""\n    return x + {n}\n',
    "import math\n\n@cache\ndef f_{id}(x) -> int:\n    '''\n    {d}\n\n    Second line.\n    '''\n    return x + {n}\n",
    'import math\n\ndef f_{id}(x):\n    """{d}"""\n    pass\n',
    'import math\n\ndef f_{id}(x):\n    """{d}"""\n    ...\n',
    'import math\n\ndef f_{id}(x):\n    """{d}"""\n',
    "import math\n\ndef f_{id}(x):\n    return x + {n}\n",
    'import math\n\nasync def a_{id}(x):\n    """{d}"""\n    return x\n\ndef f_{id}(\n    x,\n):\n    """Kept. {d}"""\n    return "#" * x\n',
    'import math\n\nclass A:\n    def m_{id}(self):\n        """{d}"""\n        return 1\n\nclass B:\n'
    '    def m_{id}(self):\n        """Two. {d}"""\n\n        return 2\n',
    'import math\n\ndef outer_{id}(x):\n    """{d}"""\n    def inner_{id}(y):\n        """In. {d}"""\n        return y\n    return inner_{id}(x)\n',
    "import math\n\ndef f_{id}(x:\n    return x\n",
]

# kind, node, name, start_line, end_line, docstring, trivial, docstring span in the file, code
FOUND = [
    (0, 0, "f_{id}", 3, 5, "{d}", False, 4, 4, 'def f_{id}(x):\n    """{d}"""\n    return x + {n}'),
    (1, 0, "f_{id}", 4, 10, "{d}\n\nSecond line.", False, 5, 9,
     "def f_{id}(x) -> int:\n    '''\n    {d}\n\n    Second line.\n    '''\n    return x + {n}"),
    (2, 0, "f_{id}", 3, 5, "{d}", True, 4, 4, 'def f_{id}(x):\n    """{d}"""\n    pass'),
    (3, 0, "f_{id}", 3, 5, "{d}", True, 4, 4, 'def f_{id}(x):\n    """{d}"""\n    ...'),
    (4, 0, "f_{id}", 3, 4, "{d}", False, 4, 4, 'def f_{id}(x):\n    """{d}"""'),
    (5, 0, "f_{id}", 3, 4, None, False, None, None, "def f_{id}(x):\n    return x + {n}"),
    (6, 0, "f_{id}", 7, 11, "Kept. {d}", False, 10, 10,
     'def f_{id}(\n    x,\n):\n    """Kept. {d}"""\n    return "#" * x'),
    (7, 0, "m_{id}", 4, 6, "{d}", False, 5, 5, '    def m_{id}(self):\n        """{d}"""\n        return 1'),
    (7, 1, "m_{id}", 9, 12, "Two. {d}", False, 10, 10, '    def m_{id}(self):\n        """Two. {d}"""\n\n        return 2'),
    (8, 0, "outer_{id}", 3, 8, "{d}", False, 4, 4,
     'def outer_{id}(x):\n    """{d}"""\n    def inner_{id}(y):\n        """In. {d}"""\n        return y\n    return inner_{id}(x)'),
    (8, 1, "inner_{id}", 5, 7, "In. {d}", False, 6, 6, '    def inner_{id}(y):\n        """In. {d}"""\n        return y'),
]

# kind, node, code after dedenting and removing the docstring
MINED = [
    (0, 0, "def f_{id}(x):\n    \n    return x + {n}"),
    (1, 0, "def f_{id}(x) -> int:\n    \n    return x + {n}"),
    (4, 0, "def f_{id}(x):\n    "),
    (6, 0, 'def f_{id}(\n    x,\n):\n    \n    return "#" * x'),
    (7, 0, "def m_{id}(self):\n    \n    return 1"),
    (7, 1, "    def m_{id}(self):\n        \n\n        return 2"),
    (8, 0, 'def outer_{id}(x):\n    \n    def inner_{id}(y):\n        """In. {d}"""\n        return y\n    return inner_{id}(x)'),
    (8, 1, "def inner_{id}(y):\n    \n    return y"),
]


def literal(value) -> str:
    """A value as a DuckDB literal."""
    if value is None:
        return "NULL"
    if isinstance(value, (bool, int)):
        return str(value)
    return "E'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows) + ")"


def filled(column: str) -> str:
    """SQL that fills a template's placeholders."""
    return f"replace(replace(replace({column}, '{{id}}', doc_id::VARCHAR), '{{n}}', n_chars::VARCHAR), '{{d}}', d)"


def fill(template, doc_id="doc_id", n="n_chars", d="d"):
    """The same as a column expression."""
    numbered = F.replace(F.replace(template, F.lit("{id}"), F.col(doc_id).cast("string")), F.lit("{n}"), F.col(n).cast("string"))
    return F.replace(numbered, F.lit("{d}"), F.col(d))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    template = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.col("doc_id") % 10 + 1).cast("int"))
    documents = table(spark, sf, "documents").select("doc_id", "n_chars", plain(F.col("text")).alias("d"))
    return documents.select("doc_id", fill(template).alias("source"))


PLAIN = r"""
b_plain AS (SELECT doc_id, source AS repo, n_chars, trim(regexp_replace(text, '["''\\\n\r\t]+', ' ', 'g')) AS d FROM documents)"""

EXPECTED = PLAIN + f""",
b_found AS (
  SELECT doc_id, node, {filled('name')} AS name, start_line, end_line, {filled('docstring')} AS docstring, is_trivial AS trivial,
    first_line, last_line, {filled('code')} AS code
  FROM b_plain JOIN {values(FOUND)} t(kind, node, name, start_line, end_line, docstring, is_trivial, first_line, last_line, code)
    ON kind = doc_id % 10
),
b_mined AS (
  SELECT f.doc_id, f.node, f.name, f.docstring, m.code
  FROM b_found f JOIN (SELECT doc_id, node, {filled('code')} AS code FROM b_plain JOIN {values(MINED)} t(kind, node, code) ON kind = doc_id % 10) m
    ON m.doc_id = f.doc_id AND m.node = f.node
)"""

# --- versions of one file per document -----------------------------------------------------------------

FILE = ('import math\n\ndef f_{id}(x):\n    """{doc}"""\n    return x {op} {n}\n\n'
        'def g_{id}(x):\n    """Helper."""\n    return x\n')
# seq, docstring of f, operator in f; sequence 0 is the newest
STATES = [(0, "{d}", "+"), (1, "{d}", "+"), (2, "{d}", "-"), (3, "{d} Old.", "-")]
BROKEN = "def f_{id}(x:\n\n\n    return x\n"


def file_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Five versions per file; the oldest is not UTF-8, does not parse, or is too short."""
    documents = table(spark, sf, "documents").select("doc_id", F.col("source").alias("repo"), "n_chars", plain(F.col("text")).alias("d"))
    good = [
        F.struct(F.lit(seq).cast("long").alias("seq"), fill(F.lit(FILE.replace("{doc}", doc).replace("{op}", op))).cast("binary").alias("content"))
        for seq, doc, op in STATES
    ]
    third = F.col("doc_id") % 3
    bad = (
        F.when(third == 0, F.concat(fill(F.lit(FILE)).cast("binary"), F.unhex(F.lit("FF"))))
        .when(third == 1, fill(F.lit(BROKEN)).cast("binary"))
        .otherwise(fill(F.lit("def f_{id}(x):\n    return x\n")).cast("binary"))
    )
    rows = F.array(*good, F.struct(F.lit(4).cast("long").alias("seq"), bad.alias("content")))
    ending = F.when(F.col("doc_id") % 9 == 8, ".txt").otherwise(".py")
    return documents.select("repo", F.concat(F.lit("src/"), F.col("doc_id").cast("string"), ending).alias("path"), F.explode(rows).alias("_v")).select(
        "repo", "path", F.concat(F.lit("c"), F.col("_v.seq").cast("string"), F.lit(" HEAD~"), F.col("_v.seq").cast("string")).alias("commit"),
        F.timestamp_seconds(F.lit(1704067200) - F.col("_v.seq") * 86400).alias("committed_at"), "_v.seq", "_v.content",
    )


def ratio_sql(a: str, b: str) -> str:
    """Character similarity of two text columns."""
    return f"""CASE WHEN length({a}) + length({b}) = 0 THEN 1.0::DOUBLE ELSE
      2.0::DOUBLE * coalesce(list_sum(list_transform(list_distinct(string_split({a}, '')),
        lambda ch: CASE WHEN ch = '' THEN 0 ELSE least(length({a}) - length(replace({a}, ch, '')), length({b}) - length(replace({b}, ch, ''))) END)), 0)
      / (length({a}) + length({b})) END"""


VERSIONS = PLAIN + f""",
b_keyed AS (SELECT *, md5(repo || '|src/' || doc_id || '.py') AS file FROM b_plain WHERE doc_id % 9 <> 8),
b_states AS (
  SELECT doc_id, file, 'f_' || doc_id AS name, 0 AS node, seq, 'c' || seq AS commit,
    {filled('doc')} AS docstring, {filled('code')} AS code
  FROM b_keyed, {values([(seq, doc, f"def f_{{id}}(x):{chr(10)}    {chr(10)}    return x {op} {{n}}") for seq, doc, op in STATES if seq != 1])} t(seq, doc, code)
  UNION ALL
  SELECT doc_id, file, 'g_' || doc_id, 1, 0, 'c0', 'Helper.', E'def g_' || doc_id || E'(x):\\n    \\n    return x' FROM b_keyed
),
b_linked AS (
  SELECT *, md5(file || '|' || name) AS function, md5(md5(file || '|' || name) || '|' || seq || '|' || node) AS id,
    lag(code) OVER w AS pcode, lag(docstring) OVER w AS pdoc, lag(seq) OVER w AS pseq
  FROM b_states WINDOW w AS (PARTITION BY doc_id, name ORDER BY seq)
),
b_mined_versions AS (
  SELECT id, doc_id, seq, commit, strftime(TIMESTAMP '2024-01-01' - to_days(seq::INTEGER), '%Y-%m-%dT%H:%M:%S') AS date, code, docstring,
    pcode <> code AS code_updated, pdoc <> docstring AS docstring_updated,
    CASE WHEN pcode IS NOT NULL THEN round({ratio_sql('pcode', 'code')}, 6) END AS code_similarity,
    CASE WHEN pdoc IS NOT NULL THEN round({ratio_sql('pdoc', 'docstring')}, 6) END AS docstring_similarity,
    function, CASE WHEN pseq IS NOT NULL THEN md5(function || '|' || pseq || '|' || node) END AS last_version
  FROM b_linked
)"""
