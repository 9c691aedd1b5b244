"""Greedy one-to-one assignment of detections and vessels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.session import stable


def greedy_pairs(pairs: pd.DataFrame) -> pd.DataFrame:
    """Walk pairs by (distance, detection, vessel) and take those whose two ends are both free."""
    dets, vessels, keep = set(), set(), []
    ordered = pairs.sort_values(["distance_m", "det_id", "mmsi"], kind="stable")
    for at, det, mmsi in zip(ordered.index, ordered["det_id"], ordered["mmsi"]):
        if det not in dets and mmsi not in vessels:
            dets.add(det)
            vessels.add(mmsi)
            keep.append(at)
    return pairs.loc[keep]


def _first_for_both(pairs: DataFrame, group: str) -> DataFrame:
    """Pairs that are first for both their ends: the greedy walk takes them whatever else happens."""
    order = F.struct("distance_m", "det_id", "mmsi")
    best_d = pairs.groupBy(group, "det_id").agg(F.min(order).alias("best_d"))
    best_v = pairs.groupBy(group, "mmsi").agg(F.min(order).alias("best_v"))
    ranked = pairs.join(best_d, [group, "det_id"]).join(best_v, [group, "mmsi"])
    return ranked.filter((order == F.col("best_d")) & (order == F.col("best_v"))).select(*pairs.columns)


def _without(pairs: DataFrame, won: DataFrame, group: str) -> DataFrame:
    return pairs.join(won.select(group, "det_id"), [group, "det_id"], "left_anti").join(won.select(group, "mmsi"), [group, "mmsi"], "left_anti")


def assign_one_to_one(pairs: DataFrame, group: str = "scene_id") -> DataFrame:
    """The greedy assignment per group.

    Pairs that are first for both ends, nearly all, are taken by joins; the walk, a task a
    group, only meets what still competes after that.
    """
    pairs = stable(pairs)
    won = stable(_first_for_both(pairs, group))
    return won.union(_without(pairs, won, group).groupBy(group).applyInPandas(greedy_pairs, pairs.schema))


def assign_by_rounds(pairs: DataFrame, group: str = "scene_id", most_rounds: int = 200) -> DataFrame:
    """The same assignment for groups too large for a task: rounds of mutually first pairs.

    A pair that is first for both its ends would be taken by the greedy walk whatever else
    happens, so each round takes all of them and drops what touches their ends.
    """
    left, taken = pairs, None
    for _ in range(most_rounds):
        won = stable(_first_for_both(left, group))
        taken = won if taken is None else taken.union(won)
        left = stable(_without(left, won, group))
        if not left.limit(1).count():
            return taken
    raise RuntimeError("assignment did not settle")
