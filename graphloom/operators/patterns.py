"""Many names looked for in texts at once, by an automaton over all of them."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of names that are broadcast at a time; an automaton takes some fifty bytes for each.
CHARACTERS = 4_000_000


def name_groups(names: DataFrame) -> list[DataFrame]:
    """Distinct names, not null and not empty, in groups that are small enough to be broadcast."""
    n = names.select("name").filter("name != ''").distinct()
    size = n.agg(F.coalesce(F.sum(F.length("name") + 1), F.lit(0))).first()[0]
    groups = 1 + size // CHARACTERS
    return [n.filter(F.pmod(F.xxhash64("name"), F.lit(groups)) == i) for i in range(groups)]


def occurring(names: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """name, n_texts: in how many texts each name occurs as a part, if in any.

    Each text is read once for a group of names, however many names there are; a task gives one row for each name that it met. Empty and
    null names, and null texts, count as not occurring.
    """
    out = None
    for group in name_groups(names):
        found = _search(texts.select(F.col(text).alias("text")).filter("text is not null"), [r["name"] for r in group.collect()])
        out = found if out is None else out.unionByName(found)
    return out.groupBy("name").agg(F.sum("n").alias("n_texts"))


def _search(texts: DataFrame, names: list[str]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(tuple(names))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for name in shared.value:
            machine.add_word(name, name)
        met: Counter[str] = Counter()
        if shared.value:
            machine.make_automaton()
            for pdf in batches:
                for t in pdf["text"]:
                    met.update({name for _, name in machine.iter(t)})
        if met:
            yield pd.DataFrame({"name": pd.array(list(met), dtype=object), "n": list(met.values())})

    return texts.mapInPandas(search, "name string, n long")
