"""Connected components of a table of links, by minimum labels; nothing reaches the driver but counts.

Links are contracted first where they lie: of each batch only a star of every component is left.  Then, in rounds, the labels of both
ends of a link meet, the larger label moves to the smallest it meets, and so do all ids that carry it; labels that moved to one that moves
itself follow it.  A round is one plan and one written table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import drop_staged, sized, stage

#: Links that are contracted together, about.
TOGETHER = 1 << 18


def _stars(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Links of a table -> for each of its components the links of all its ids to the smallest."""
    n = len(pdf)
    ends = pd.concat([pdf[[*keys, "a"]].rename(columns={"a": "id"}), pdf[[*keys, "b"]].rename(columns={"b": "id"})], ignore_index=True)
    nodes = ends.drop_duplicates().sort_values([*keys, "id"], ignore_index=True)
    code = ends.merge(nodes.reset_index(names="__n"), on=[*keys, "id"], how="left")["__n"].to_numpy()
    a, b = code[:n], code[n:]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, label[end], low)
            np.minimum.at(new, end, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    out = nodes[rest].rename(columns={"id": "b"})
    out.insert(len(keys), "a", nodes["id"].to_numpy()[label[rest]])
    return out


def _contracted(links: DataFrame, keys: list[str]) -> DataFrame:
    kinds = dict(links.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= TOGETHER:
                held = [_stars(pd.concat(held, ignore_index=True), keys)]
                size = len(held[0])
                if size >= TOGETHER // 2:
                    yield held[0]
                    held, size = [], 0
        if size:
            yield _stars(pd.concat(held, ignore_index=True), keys)

    return links.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "a", "b"]))


def components(links: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """links(keys, a, b) -> (keys, id, label): label is the smallest id reachable; only ids that occur in links have a row.

    A link whose key is null, or that has a null end, is none; links may repeat.
    """
    k = list(keys)
    present = F.col("a") != F.col("b")
    for c in k:
        present = present & F.col(c).isNotNull()
    ordered = links.where(present).select(*k, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = stage(_contracted(ordered, k).distinct(), "links")
    both = links.select(*k, "a", "b").union(links.select(*k, F.col("b").alias("a"), F.col("a").alias("b")))
    state = stage(both.groupBy(*k, "a").agg(F.min("b").alias("m")).select(*k, F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    rows, row_bytes = state.count(), 32 + 16 * len(k)
    while rows:
        here = sized(state.select(*k, F.col("id").alias("a"), F.col("label").alias("la")), rows, row_bytes)
        there = sized(state.select(*k, F.col("id").alias("b"), F.col("label").alias("lb")), rows, row_bytes)
        own = sized(state.select(*k, F.col("label").alias("id"), F.col("label").alias("lc")).distinct(), rows, row_bytes)
        meet = links.join(here, [*k, "a"]).join(there, [*k, "b"]).where("la <> lb")
        # The label of a label: ids whose label's own node has a smaller one follow it.
        behind = state.join(own, [*k, "id"]).where("label <> lc").select(*k, F.col("lc").alias("high"), F.col("label").alias("low"))
        moved = meet.select(*k, F.greatest("la", "lb").alias("high"), F.least("la", "lb").alias("low")).unionByName(behind)
        moved = moved.groupBy(*k, "high").agg(F.min("low").alias("low"))
        for _ in range(2):
            further = sized(moved.select(*k, F.col("high").alias("low"), F.col("low").alias("next")), rows, row_bytes)
            moved = moved.join(further, [*k, "low"], "left").select(*k, "high", F.coalesce("next", "low").alias("low"))
        new = state.join(sized(moved.withColumnRenamed("high", "label"), rows, row_bytes), [*k, "label"], "left")
        new = stage(new.select(*k, "id", F.coalesce("low", "label").alias("label"), F.col("low").isNotNull().alias("changed")), "labels")
        drop_staged(state)
        state = new
        if not state.where("changed").limit(1).count():
            break
    drop_staged(links)
    return state.select(*k, "id", "label")
