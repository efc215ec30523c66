"""Spelling variants: words one edit apart, found by a frontier of states that walks a trie held as a table of edges."""

from __future__ import annotations

import itertools
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUN = "[a-zÀ-ÿ]+"   # of a text whose A-Z are lower-cased
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)
ROOTS = (1, 2)               # the nodes at which words and reversed words begin


def counted_words(docs: DataFrame, key: str = "doc_id", least_length: int = 6, least_count: int = 5, misspelt: int = 199) -> DataFrame:
    """``word`` and ``n``: the runs of letters of all texts, A-Z lower-cased, with errors put in, that are long and frequent.

    Where ``misspelt`` divides the crc32 of ``key:run``, the run loses its code point at crc32 modulo its length; a null
    key counts as empty, a null text has no runs.
    """
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))
    # The outer form with a filter behind it, as Spark would work a plain explode's array out twice.
    each = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.explode_outer(runs).alias("run")).filter("run IS NOT NULL")
    each = each.withColumn("_hash", F.crc32(F.concat_ws(":", "_key", "run").cast("binary")))
    at = F.pmod(F.col("_hash"), F.char_length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.pmod(F.col("_hash"), F.lit(misspelt)) == 0, short).otherwise(F.col("run"))
    words = each.select(word.alias("word")).filter(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _prefix_nodes(batches):
    """Each word forwards and backwards with the numbers of the trie nodes on its path, hashes of its prefixes."""
    for batch in batches:
        words, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
        for backwards, root in enumerate(ROOTS):
            texts = [w[::-1] for w in words] if backwards else words
            nodes = [list(itertools.accumulate(map(ord, t), lambda h, c: (h * BASE + c) % PRIME, initial=root)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words), pa.array(counts, pa.int64()), pa.array([bool(backwards)] * len(words)), pa.array(texts), pa.array(nodes, pa.list_(pa.int64()))],
                names=["word", "n", "backwards", "text", "nodes"])


def trie_edges(words: DataFrame) -> DataFrame:
    """The edges of two tries, of the words and of the reversed words: ``level``, ``node``, ``char``, ``label``, ``child``,
    and the ``other`` word that ends at the child with its ``other_n``.

    A node stays only where words end or part, so an edge's label may be long and the number of levels does not grow
    with the length of words. Two prefixes of one hash would share a node; that adds ways, which are checked in the end.
    """
    paths = words.mapInArrow(_prefix_nodes, "word string, n long, backwards boolean, text string, nodes array<long>")
    chars = F.concat(F.split("text", ""), F.array(F.lit("")))
    steps = paths.select("word", "n", "backwards", F.posexplode_outer(F.arrays_zip("nodes", chars.alias("next"))).alias("pos", "step"))
    steps = materialise(steps.select("word", "n", "backwards", "pos", F.col("step.nodes").alias("node"), F.col("step.next").alias("next")), "trie-steps")
    inner = steps.filter("pos > 0")
    # The end of a word is the empty character, which comes first.
    parting = inner.groupBy("node").agg(F.min("next").alias("_least"), F.max("next").alias("_last")).filter("_least = '' OR _least <> _last")
    stays = inner.join(parting.select("node"), "node", "left_semi").select("word", "n", "backwards", "pos", "node")
    nodes = F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("path")
    path = stays.groupBy("word", "n", "backwards").agg(nodes)
    root = F.when(F.col("backwards"), F.lit(ROOTS[1])).otherwise(F.lit(ROOTS[0])).cast("long")
    path = path.withColumn("path", F.concat(F.array(F.struct(F.lit(0).alias("pos"), root.alias("node"))), "path"))
    text = F.when(F.col("backwards"), F.reverse("word")).otherwise(F.col("word"))
    edge = F.transform(
        F.sequence(F.lit(0), F.size("path") - 2),
        lambda i: F.struct(
            i.alias("level"), F.get("path", i)["node"].alias("node"), F.get("path", i + 1)["node"].alias("child"),
            F.substring(text, F.get("path", i)["pos"] + 1, F.get("path", i + 1)["pos"] - F.get("path", i)["pos"]).alias("label"),
            (i == F.size("path") - 2).alias("ends")))
    edges = path.select("word", "n", F.explode(edge).alias("edge")).select("word", "n", "edge.*")
    edges = edges.groupBy("level", "node", F.substring("label", 1, 1).alias("char")).agg(
        F.min("label").alias("label"), F.min("child").alias("child"),
        F.max(F.when(F.col("ends"), F.col("word"))).alias("other"), F.max(F.when(F.col("ends"), F.col("n"))).alias("other_n"))
    return materialise(edges, "trie-edges")


def _moved(joined: DataFrame) -> DataFrame:
    """What becomes of states that met an edge: its label is matched, or matched by one edit if the state has none yet."""
    size = F.char_length("label")
    equal = F.substring("rest", F.lit(1), size) == F.col("label")
    may_edit = (F.col("edits") == 0) & ~equal & (
        F.substring("rest", F.lit(1), F.least("exact", size)) == F.substring("label", F.lit(1), F.least("exact", size)))

    def state(used: Column, edits: Column, condition: Column) -> Column:
        return F.when(condition, F.struct(F.substring("rest", used + 1, F.char_length("rest")).alias("rest"), edits.cast("int").alias("edits")))

    def edited(used: Column) -> Column:
        # Equal lengths leave a replaced code point, others one that only one side has.
        begin = F.substring("rest", F.lit(1), used)
        return state(used, F.lit(1), may_edit & (F.char_length(begin) == used) & (F.levenshtein(begin, "label", 1) == 1))

    ways = F.array(state(size, F.col("edits"), equal), edited(size), edited(size - 1), edited(size + 1))
    moved = joined.select("word", (F.greatest(F.col("exact") - size, F.lit(0))).alias("exact"), "child", "other", "other_n", F.explode_outer(ways).alias("way"))
    left = F.char_length("way.rest")
    found = F.col("other").isNotNull() & (left + F.col("way.edits") == 1)
    # A state without edits whose rest is one code point away from the end of a word has found it, and goes on.
    return moved.filter("way IS NOT NULL").select(
        "word", F.col("way.rest").alias("rest"), "exact", F.col("child").alias("node"), F.col("way.edits").alias("edits"),
        F.when(found, F.col("other")).alias("other"), F.when(found, F.col("other_n")).alias("other_n")
    ).filter(F.col("other").isNotNull() | (F.col("edits") == 0) | (F.col("rest") != ""))


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``other`` and ``other_n`` for all words that differ by one inserted, deleted or replaced code point.

    A state is a word's rest, the node it is at and the edits made. All states of a level meet the edges of that level in
    one join; a level is written before the next. An edit lies in a word's second half or its first: forwards, the first
    half must be matched exactly, backwards the second, so states only branch where few words are left. States that may
    not branch meet the one edge of their next code point, others the edges of their node, at most one for each letter.
    """
    edges = trie_edges(words)
    half = F.floor(F.char_length("word") / 2).cast("int")
    start = F.explode(F.array(
        F.struct(F.col("word").alias("rest"), half.alias("exact"), F.lit(ROOTS[0]).cast("long").alias("node")),
        F.struct(F.reverse("word").alias("rest"), (F.char_length("word") - half).cast("int").alias("exact"), F.lit(ROOTS[1]).cast("long").alias("node"))))
    states = words.select("word", start.alias("s")).select("word", "s.*", F.lit(0).alias("edits"))
    found, level = None, 0
    while True:
        here = edges.filter(F.col("level") == level).drop("level")
        free = (F.col("edits") == 0) & (F.col("exact") == 0)
        bound = states.filter(~free).withColumn("char", F.substring("rest", 1, 1)).join(here, ["node", "char"])
        branching = states.filter(free).join(here.drop("char"), "node")
        columns = ["word", "rest", "exact", "edits", "label", "child", "other", "other_n"]
        moved = materialise(_moved(bound.select(columns).unionByName(branching.select(columns))), "trie-frontier")
        reached = moved.filter("other IS NOT NULL").select("word", "other", "other_n")
        found = reached if found is None else found.unionByName(reached)
        states = moved.filter("edits = 0 OR other IS NULL").drop("other", "other_n")
        if states.isEmpty():
            break
        level += 1
    return found.filter(F.levenshtein("word", "other", 1) == 1).distinct()


def spelling_variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """One row per word: ``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root``.

    ``words`` has distinct, non-empty words with their counts ``n``. A word's form is its near word of the largest count,
    of equals the first by code point, if that is at least ``factor`` times its own; its root is where forms lead to. A
    word without near words, or with rare ones only, has no form and is its own root. An empty table gives no rows.
    """
    words = materialise(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    ruled = words.join(near, "word", "left").withColumn("_fits", -F.col("best.n") >= F.lit(factor) * F.col("n"))
    ruled = materialise(ruled.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("_fits"), F.col("best.form")).alias("form"), F.when(F.col("_fits"), -F.col("best.n")).alias("form_n")), "word-forms")
    # Counts grow along the forms by the factor, so chains are short and a few doublings reach their ends.
    ways = materialise(ruled.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "word-roots")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = ways.join(on, "root", "left")
        ways = materialise(longer.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "word-roots")
        if ways.filter("moved").isEmpty():
            break
        ways = ways.drop("moved")
    return ruled.join(ways.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
