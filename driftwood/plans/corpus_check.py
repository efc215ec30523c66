"""The check itself: from source files to every function with the decision whether its docstring is up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame

from driftwood.operators.extract import extract_functions, located_functions, scatter_results
from driftwood.plans.scoring import scorer
from driftwood.session import materialise


def documented_items(located: DataFrame, key: list[str]) -> DataFrame:
    """The functions that can be scored: those with a docstring."""
    return located.filter("has_docstring").select(*key)


def check_corpus(files: DataFrame, key: list[str], items: DataFrame, item_key: list[str], method: str, mid: str, *inputs) -> DataFrame:
    """All functions of ``files`` with their lines, docstring, and ``up_to_date``.

    ``key`` tells functions apart; ``items`` gives the documented ones, by ``item_key``, their ``item_idx``. ``inputs`` are what the scoring ``method`` takes, keyed
    by that number, of which the results of model ``mid`` count. A function that was not scored, for want of a
    docstring or of an item, is not up to date, nor is one that the method does not decide on.
    """
    located = materialise(located_functions(extract_functions(files)), "located")
    scored = scorer(method)(*inputs).filter(f"mid = '{mid}'").select("item_idx", "out_of_date")
    decided = documented_items(located, key).join(items, item_key).join(scored, "item_idx").select(*key, "out_of_date")
    return scatter_results(located, decided, key)
