"""The given tables in the shape of the engine's inputs, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwood.catalog.registry import table
from driftwood.operators.lookup import lookup_join
from driftwood.operators.tokens import count_tokens, explode_tokens, inverse_log_frequency, token_frequencies, vocabulary, words
from driftwood.session import materialise

# --- code and docstring of each document -------------------------------------------------------------

CODE = r"""
b_code AS (
  SELECT doc_id, source, lang, n_chars, text,
    'def f_' || doc_id || E'(x):\n    # ' || source || E'\n\n\n    ' || replace(text, E'\n', E'\n    ')
      || E'\n    return x + ' || n_chars AS c,
    trim(regexp_replace(text, '["''\\\n\r\t]+', ' ', 'g')) AS d
  FROM documents
)"""


def plain(text):
    """A text that may stand inside a Python string literal."""
    return F.trim(F.regexp_replace(text, r"""["'\\\n\r\t]+""", " "))


def code(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    body = F.replace(F.col("text"), F.lit("\n"), F.lit("\n    "))
    return documents.select(
        "doc_id", "source", "lang", "n_chars", "text",
        F.concat(F.lit("def f_"), F.col("doc_id").cast("string"), F.lit("(x):\n    # "), F.col("source"), F.lit("\n\n\n    "),
                 body, F.lit("\n    return x + "), F.col("n_chars").cast("string")).alias("c"),
        plain(F.col("text")).alias("d"),
    )


LABELED = CODE + """,
b_labeled AS (SELECT b.*, l.quality = 1 AS l, l.toxic FROM b_code b JOIN labels l ON l.doc_id = b.doc_id)"""


def labeled(spark: SparkSession, sf: str) -> DataFrame:
    return code(spark, sf).join(
        table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("l"), "toxic"), "doc_id"
    )


# --- a history per conversation -----------------------------------------------------------------------
# Each turn and a copy of it: unchanged, with changed code, or with a changed docstring.

HISTORY = r"""
b_history AS (
  SELECT conv_id, 2 * turn AS seq, role || ':' || text AS code, text AS docstring FROM conversations
  UNION ALL
  SELECT conv_id, 2 * turn + 1 AS seq,
    role || ':' || text || CASE WHEN turn % 3 = 1 THEN ' # second' ELSE '' END AS code,
    text || CASE WHEN turn % 3 = 2 THEN ' More.' ELSE '' END AS docstring
  FROM conversations
)"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    kind = F.col("turn") % 3
    rows = F.array(
        F.struct((2 * F.col("turn")).alias("seq"), F.lit("").alias("more_code"), F.lit("").alias("more_doc")),
        F.struct((2 * F.col("turn") + 1).alias("seq"), F.when(kind == 1, " # second").otherwise("").alias("more_code"),
                 F.when(kind == 2, " More.").otherwise("").alias("more_doc")),
    )
    return turns.withColumn("_r", F.explode(rows)).select(
        "conv_id", "_r.seq", F.concat("role", F.lit(":"), "text", "_r.more_code").alias("code"),
        F.concat("text", "_r.more_doc").alias("docstring"),
    )


# --- repositories, files, functions, versions -----------------------------------------------------------

CHAIN = r"""
b_versions AS (
  SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d')) AS id,
    E'def f_' || l_orderkey || E'(x):\n    # ' || l_linestatus || E'\n\n\n    return x + ' || l_partkey AS code,
    l_returnflag || ' order ' || l_orderkey || ' supplier ' || l_suppkey AS docstring,
    l_quantity > 25 AS code_updated, l_discount > 0.05 AS docstring_updated,
    l_discount * 10 AS code_similarity, l_tax * 10 AS docstring_similarity,
    l_orderkey AS function,
    lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS last_version
  FROM lineitem
),
b_wide AS (
  SELECT v.id, v.code, v.docstring, v.code_updated, v.docstring_updated, v.code_similarity, v.docstring_similarity,
    CAST(v.last_version AS VARCHAR) AS last_version, o_orderpriority AS function_name, c_name AS filename, n_name AS repo_name,
    n_nationkey::BIGINT * 3 + 1 AS size, n_nationkey::BIGINT * 5 % 7 AS open_issues, n_nationkey::BIGINT % 11 AS watchers,
    n_nationkey::BIGINT * 7 % 13 + 1 AS contributors, n_nationkey::BIGINT * n_nationkey::BIGINT AS forks, n_nationkey::BIGINT * 100 AS contributions,
    n_nationkey::BIGINT * 31 % 17 + 1000 AS stars
  FROM b_versions v JOIN orders ON v.function = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
)"""


def chain_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Versions from line items, functions from orders, files from customers, repositories from nations."""
    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    # Chains are sorted before texts are made, and by the name the join goes by, so that these rows are shuffled once and without texts.
    order = W.partitionBy("function").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    linked = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("function"), "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_linestatus", "l_returnflag",
        (F.col("l_quantity") > 25).alias("code_updated"), "l_discount", "l_tax",
    ).withColumn("_previous", F.lag("l_linenumber").over(order))
    key = F.concat_ws("|", "function", "l_partkey", "l_suppkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd"))
    versions = linked.select(
        key.alias("id"),
        text("def f_", F.col("function"), "(x):\n    # ", F.col("l_linestatus"), "\n\n\n    return x + ", F.col("l_partkey")).alias("code"),
        text(F.col("l_returnflag"), " order ", F.col("function"), " supplier ", F.col("l_suppkey")).alias("docstring"),
        "code_updated", (F.col("l_discount") > 0.05).alias("docstring_updated"),
        (F.col("l_discount") * 10).alias("code_similarity"), (F.col("l_tax") * 10).alias("docstring_similarity"),
        "function", F.col("_previous").cast("string").alias("last_version"),
    )
    functions = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("file")
    )
    files = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("path"), F.col("c_nationkey").alias("repo")
    )
    k = F.col("n_nationkey").cast("long")
    repositories = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("full_name"), (k * 3 + 1).alias("size"),
        (k * 5 % 7).alias("open_issues"), (k % 11).alias("watchers"), (k * 7 % 13 + 1).alias("contributors"),
        (k * k).alias("forks"), (k * 100).alias("contributions"), (k * 31 % 17 + 1000).alias("stars"),
    )
    return versions, functions, files, repositories


# --- embeddings of code, docstring and generated docstrings --------------------------------------------
# Item i: code is vector i, docstring the next one, generation s of model m the (i + m + s)-th; a ring.

MODELS = {"base": 2, "tuned": 6}

VECTORS = """
b_items AS (
  SELECT e.vec_id AS item_idx, CAST(e.embedding AS DOUBLE[]) AS code, CAST(d.embedding AS DOUBLE[]) AS doc, e.label = d.label AS l
  FROM embeddings e JOIN embeddings d ON d.vec_id = (e.vec_id + 1) % (SELECT count(*) FROM embeddings)
),
b_gens AS (
  SELECT e.vec_id AS item_idx, m.mid, s.s AS sample_idx, CAST(g.embedding AS DOUBLE[]) AS gen
  FROM embeddings e, (VALUES ('base', 2), ('tuned', 6)) m(mid, shift), range(4) s(s), embeddings g
  WHERE g.vec_id = (e.vec_id + m.shift + s.s) % (SELECT count(*) FROM embeddings)
),
b_unit AS (
  SELECT item_idx, l, code, doc,
    list_transform(code, lambda x: x / sqrt(list_inner_product(code, code))) AS ucode,
    list_transform(doc, lambda x: x / sqrt(list_inner_product(doc, doc))) AS udoc
  FROM b_items
),
b_pairs AS (
  SELECT mid, item_idx, sample_idx, l,
    list_cosine_similarity(code, gen) AS cg, list_distance(code, gen) AS eg,
    list_cosine_similarity(ucode, ugen) AS cgu, list_distance(ucode, ugen) AS egu,
    list_cosine_similarity(code, doc) AS cd, list_distance(code, doc) AS ed,
    list_cosine_similarity(ucode, udoc) AS cdu, list_distance(ucode, udoc) AS edu
  FROM (SELECT g.mid, g.sample_idx, g.gen, list_transform(g.gen, lambda x: x / sqrt(list_inner_product(g.gen, g.gen))) AS ugen, u.*
        FROM b_gens g JOIN b_unit u USING (item_idx))
),
b_ratios AS (
  SELECT mid, item_idx, any_value(l) AS l, s.distance_function, s.normalize, s.sample_many,
    any_value(CASE WHEN distance_function = 'cosine' THEN CASE WHEN normalize THEN cdu ELSE cd END
                   ELSE CASE WHEN normalize THEN edu ELSE ed END END) AS docstring_score,
    CASE WHEN s.sample_many THEN
      quantile_disc(CASE WHEN distance_function = 'cosine' THEN CASE WHEN normalize THEN cgu ELSE cg END
                         ELSE CASE WHEN normalize THEN egu ELSE eg END END, 0.5)
    ELSE max(CASE WHEN sample_idx = 0 THEN CASE WHEN distance_function = 'cosine' THEN CASE WHEN normalize THEN cgu ELSE cg END
                         ELSE CASE WHEN normalize THEN egu ELSE eg END END END) END AS updated_docstring_score
  FROM b_pairs, (SELECT f.distance_function, n.normalize, m.sample_many FROM (VALUES ('cosine'), ('euclidean')) f(distance_function),
       (VALUES (false), (true)) n(normalize), (VALUES (false), (true)) m(sample_many)) s
  GROUP BY mid, item_idx, s.distance_function, s.normalize, s.sample_many
),
b_ratio AS (SELECT *, docstring_score / updated_docstring_score AS ratio FROM b_ratios),
b_grid AS (SELECT i AS grid_idx, i * (3.0::DOUBLE / 199) AS test_threshold FROM range(200) t(i)),
b_curve AS (
  SELECT mid, distance_function, normalize, sample_many, grid_idx, test_threshold,
    count(*) FILTER (l AND ratio <= test_threshold) AS tp, count(*) FILTER (NOT l AND NOT ratio <= test_threshold) AS tn,
    count(*) FILTER (NOT l AND ratio <= test_threshold) AS fp, count(*) FILTER (l AND NOT ratio <= test_threshold) AS fn
  FROM b_ratio, b_grid GROUP BY ALL
),
b_scored AS (
  SELECT *, 4.0::DOUBLE * tp * tn / nullif(4.0::DOUBLE * tp * tn + (tp + tn)::DOUBLE * (fp + fn), 0) AS p4,
    (tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0) AS mcc
  FROM b_curve
)"""


def embeddings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Text embeddings and labels: each vector takes its part in a handful of items."""
    vectors = table(spark, sf, "embeddings")
    n = vectors.agg(F.count(F.lit(1)).alias("n"))

    def part(mid, role, sample, shift):
        return F.struct(F.lit(mid).cast("string").alias("mid"), F.lit(role).alias("role"), F.lit(sample).alias("sample_idx"), F.lit(shift).alias("shift"))

    parts = [part(None, "code", 0, 0), part(None, "doc", 0, 1)]
    parts += [part(m, "gen", s, shift + s) for m, shift in MODELS.items() for s in range(4)]
    numbered = vectors.withColumn("_n", n.scalar()).withColumn("_p", F.explode(F.array(*parts)))
    item = F.pmod(F.col("vec_id") - F.col("_p.shift"), F.col("_n")).alias("item_idx")
    texts = numbered.select(item, "_p.mid", "_p.role", "_p.sample_idx", "embedding")
    label = vectors.select("vec_id", "label")
    successor = vectors.select(F.pmod(F.col("vec_id") - 1, n.scalar()).alias("vec_id"), F.col("label").alias("_next"))
    labels = label.join(successor, "vec_id").select(F.col("vec_id").alias("item_idx"), (F.col("label") == F.col("_next")).alias("l"))
    return texts, labels


# --- tokens -----------------------------------------------------------------------------------------

TOKENS = CODE + r""",
b_tok AS (
  SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos, len(w) AS n_tokens
  FROM (SELECT doc_id, regexp_extract_all(lower(d), '[a-z]+') AS w FROM b_code)
),
b_vocab AS (
  SELECT token, row_number() OVER (ORDER BY md5('42|' || token), token) - 1 AS token_id, n AS frequency
  FROM (SELECT token, count(*) AS n FROM b_tok GROUP BY token)
),
b_weights AS (
  SELECT token_id, token, frequency,
    1.0::DOUBLE - ln(frequency + 1 + 1e-16::DOUBLE) / (SELECT ln(max(frequency) + 1 + 1e-16::DOUBLE) FROM b_vocab) AS weight
  FROM b_vocab
),
b_probs AS (
  SELECT doc_id AS item_idx, role, pos, n_tokens, token_id, weight,
    CASE WHEN role = 'doc' THEN 1.0::DOUBLE / (2 + token_id % 97) ELSE 1.0::DOUBLE / (2 + token_id * 7 % 89) END AS prob
  FROM b_tok JOIN b_weights USING (token), (VALUES ('doc'), ('gen')) r(role)
)"""


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return explode_tokens(code(spark, sf), ["doc_id"], words(F.col("d")))


def counted_tokens(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Counts of all tokens and the vocabulary, worked out once and handed to all who need them."""
    counted = count_tokens(tokens(spark, sf))
    return counted, materialise(vocabulary(counted), "vocabulary")


def token_inputs(spark: SparkSession, sf: str, roles: tuple[str, ...] = ("doc", "gen"), weighed: bool = True) -> tuple[DataFrame, DataFrame]:
    """A model's probabilities of all tokens in each role, and the weights of the tokens; the texts are counted once.

    Tokens are words here and get their numbers from the vocabulary; where ``weighed``, they take their weights along from there.
    """
    counted, vocab = counted_tokens(spark, sf)
    weights = materialise(inverse_log_frequency(token_frequencies(counted, vocab)), "token-weights")
    probability = {"doc": F.lit(1.0) / (2 + F.col("token_id") % 97), "gen": F.lit(1.0) / (2 + F.col("token_id") * 7 % 89)}
    each = F.explode(F.array(*[F.struct(F.lit(role).alias("role"), probability[role].alias("prob")) for role in roles]))
    taken = ["weight"] if weighed else []
    numbered = lookup_join(tokens(spark, sf), weights.select("token", "token_id", "frequency", *taken), "token", "frequency")
    probabilities = numbered.select(
        F.lit("base").alias("mid"), F.col("doc_id").alias("item_idx"), "pos", "n_tokens", "token_id", *taken, each.alias("_r")
    ).select("mid", "item_idx", "_r.role", "pos", "n_tokens", "token_id", *taken, "_r.prob")
    return probabilities, weights


# --- requests, generations, ratings ------------------------------------------------------------------
# A conversation is cut into requests of 64 turns; the k-th user turn meets the k-th assistant turn,
# or null where one of them has no such turn.

REQUEST_TURNS = 64

REQUESTS = """
b_turns AS (
  SELECT conv_id, turn // 64 AS part, role, turn, text,
    row_number() OVER (PARTITION BY conv_id, turn // 64, role ORDER BY turn) - 1 AS pos
  FROM conversations
),
b_request_rows AS (
  SELECT conv_id, part, pos, u.text AS code, a.text AS docstring
  FROM (SELECT * FROM b_turns WHERE role = 'user') u FULL JOIN (SELECT * FROM b_turns WHERE role = 'assistant') a USING (conv_id, part, pos)
)"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    def side(role):
        texts = F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text"))))
        return F.transform(texts, lambda r: r["text"])

    turns = table(spark, sf, "conversations").withColumn("part", F.floor(F.col("turn") / REQUEST_TURNS))
    both = turns.groupBy("conv_id", "part").agg(side("user").alias("_u"), side("assistant").alias("_a"))
    pairs = F.arrays_zip("_u", "_a")
    return both.select("conv_id", "part", pairs.alias("_p")).select(
        "conv_id", "part", F.lit("base").alias("mid"), F.transform("_p", lambda p: p["_u"]).alias("codes"),
        F.transform("_p", lambda p: p["_a"]).alias("docstrings"), F.lit("update").alias("test_method"),
    )


# Every turn is a text: a model's n-th turn in a conversation is its sample n of that item.
GENERATIONS = """
b_gen AS (
  SELECT role AS mid, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS INTEGER) AS sample_idx, conv_id AS item_idx, text
  FROM conversations
)"""


def generations(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("conv_id", "role").orderBy("turn")) - 1
    return table(spark, sf, "conversations").select(F.col("role").alias("mid"), place.alias("sample_idx"), F.col("conv_id").alias("item_idx"), "text")


RATINGS = """
b_ratings AS (
  SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS judge,
    text || CASE d.doc_id % 7 WHEN 0 THEN ' docstring-0_better' WHEN 1 THEN ' docstring-1_better' WHEN 2 THEN ' docstring-2_better'
      WHEN 3 THEN ' none_fit' WHEN 4 THEN ' docstring-2_better' WHEN 5 THEN '' ELSE ' none_fit docstring-1_better' END AS answer
  FROM documents d JOIN labels USING (doc_id)
),
b_votes AS (
  SELECT judge, CASE WHEN contains(answer, 'docstring-0_better') THEN 'docstring-0_better' WHEN contains(answer, 'docstring-1_better') THEN 'docstring-1_better'
    WHEN contains(answer, 'docstring-2_better') THEN 'docstring-2_better' WHEN contains(answer, 'none_fit') THEN 'none_fit' END AS verdict, doc_id
  FROM b_ratings
)"""


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    marks = [" docstring-0_better", " docstring-1_better", " docstring-2_better", " none_fit", " docstring-2_better", "", " none_fit docstring-1_better"]
    mark = F.element_at(F.array(*[F.lit(m) for m in marks]), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, "first").otherwise("second").alias("judge"), F.concat("text", mark).alias("answer")
    )


