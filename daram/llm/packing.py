"""Problem 9: filling containers of fixed capacity with items, by vector best-fit.

A container has three capacities: tokens, number of documents, and attention cost (the sum of squared
lengths). Items are taken by decreasing length; each goes into the open container that, among those where
every constraint holds, leaves the smallest weighted norm of the residual vector (or, by choice, has the largest
weighted dot product of residual and item). An item above the token capacity alone is split into full
containers and a rest; nothing else is split.

The capacities besides tokens are parameters of ``assign``. By default both can bind: ``documents_factor`` (8) times the documents that
a full container of the corpus holds on average, and ``cost_share`` (0.9) of the cost of one piece that fills the
container. A piece that alone exceeds the cost capacity gets a container of its own.

Items are packed in independent groups of about ``GROUP_ROWS`` by a hash of their id and their place in the
written sizes, so the work is spread evenly whatever the sizes and however often an id is repeated, and only the
last few containers of each group stay open.

Defined results:
* null and empty texts have 0 tokens and still get a place (one piece of length 0);
* null ids are packed like any other id; repeated ids are packed each; ties go to the earlier container;
* capacities that are null or below 1 take nothing and give no rows; more than MAX_PACKS packs are an error; an empty table gives no containers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daram.session import cut, ship

GROUP_ROWS = 10_000
MAX_PACKS = 100
MAX_TASKS = 10_000
DOCUMENTS_FACTOR = 8.0
COST_SHARE = 0.9
WEIGHTS = (1.0, 0.1, 0.1)
PLACED = "pack_name string, capacity_tokens int, doc_id bigint, piece_no int, start_token bigint, n_tokens int, container bigint"


class Bins:
    """Open containers of one group, as arrays of residuals sorted by residual tokens, so that only a narrow stretch is scored."""

    def __init__(self, capacity: np.ndarray, weights: np.ndarray, rule: str):
        self.capacity, self.rule = capacity, rule
        self.scale = weights / capacity
        self.left = np.empty((3, 1024))
        self.ids = np.empty(1024, np.int64)
        self.open = self.made = 0

    def place(self, item: np.ndarray) -> int:
        """Container of an item no longer than those before it."""
        tokens = self.left[0]
        at = int(tokens[: self.open].searchsorted(item[0]))
        best = self._choose(at, item)
        if best < 0:
            rest, number = self.capacity - item, self.made
            self.made += 1
            if self.open == len(self.ids):
                self.left, self.ids = np.concatenate([self.left, np.empty_like(self.left)], axis=1), np.concatenate([self.ids, np.empty_like(self.ids)])
            best = self.open
            self.open += 1
        else:
            rest, number = self.left[:, best] - item, self.ids[best]
        to = int(self.left[0, :best].searchsorted(rest[0]))
        self.left[:, to + 1 : best + 1] = self.left[:, to:best]  # move up those in between, then put it in its new place
        self.ids[to + 1 : best + 1] = self.ids[to:best]
        self.left[:, to], self.ids[to] = rest, number
        return number

    def _choose(self, at: int, item: np.ndarray) -> int:
        """Place of the best container from ``at`` on that holds the item in every dimension, or -1. Beyond the stretch the token part of the norm alone is worse."""
        end = self.open
        if at == end:
            return -1
        if self.rule == "norm" and (self.left[:, at] >= item).all():
            bound = np.sqrt(((((self.left[:, at] - item) * self.scale)) ** 2).sum())
            end = int(self.left[0, :end].searchsorted(item[0] + bound / self.scale[0], "right"))
        rest = self.left[:, at:end] - item[:, None]
        if self.rule == "dot":
            score = -((self.left[:, at:end] * item[:, None]) * (self.scale**2)[:, None]).sum(axis=0)
        else:
            score = ((rest * self.scale[:, None]) ** 2).sum(axis=0)
        score[(rest < 0).any(axis=0)] = np.inf
        best = int(score.argmin())
        return at + best if score[best] < np.inf else -1

    def close(self, least: float) -> None:
        """Containers that can't take even the smallest item left leave the arrays."""
        keep = (self.left[0, : self.open] >= least) & (self.left[1, : self.open] >= 1)
        n = int(keep.sum())
        self.left[:, :n], self.ids[:n] = self.left[:, : self.open][:, keep], self.ids[: self.open][keep]
        self.open = n


def pack(sizes: np.ndarray, capacity: int, max_documents: int, max_cost: float, rule: str = "norm", weights=WEIGHTS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of items with the given sizes: (item, start, length, container)."""
    sizes = np.asarray(sizes, np.int64)
    full, rest = sizes // capacity, sizes % capacity
    split = np.repeat(np.arange(len(sizes)), full)
    number = np.arange(len(split)) - np.repeat(np.cumsum(full) - full, full)
    tail = np.flatnonzero((rest > 0) | (sizes == 0))
    order = tail[np.argsort(-rest[tail], kind="stable")]
    alone = int((rest[order].astype(float) ** 2 > max_cost).sum())  # the longest ones come first
    bins = Bins(np.array([capacity, max(1, max_documents), max_cost], float), np.asarray(weights), rule)
    where = np.empty(len(order), np.int64)
    where[:alone] = np.arange(alone)
    least = float(rest[order[-1]]) if len(order) else 0.0
    for i, length in enumerate(rest[order[alone:]].tolist(), alone):
        where[i] = alone + bins.place(np.array([length, 1.0, float(length) * length]))
        if i % 512 == 511:
            bins.close(least)
    item = np.concatenate([split, order])
    start = np.concatenate([number * capacity, full[order] * capacity])
    length = np.concatenate([np.full(len(split), capacity), rest[order]])
    return item, start, length, np.concatenate([alone + bins.made + np.arange(len(split)), where])


def assign(
    sizes: DataFrame, packs: DataFrame, rule: str = "norm", group_rows: int = GROUP_ROWS, max_documents: int | None = None, documents_factor: float = DOCUMENTS_FACTOR,
    cost_share: float = COST_SHARE, weights: tuple[float, float, float] = WEIGHTS,
) -> DataFrame:
    """(doc_id, n_tokens) and (pack_name, capacity_tokens; a fixed few rows) to one row per piece and pack.

    ``max_documents`` is the capacity in documents, or else ``documents_factor`` times what a full container holds on average; ``cost_share`` is that of the attention
    cost, as a share of the squared token capacity; ``weights`` are those of tokens, documents and cost in the norm or product. One shuffle of ids and sizes; every
    group is packed for all packs at once.
    """
    ship(sizes.sparkSession)
    sizes = cut(sizes.select("doc_id", "n_tokens"))
    offers = sorted({(r["pack_name"] or "", int(r["capacity_tokens"])) for r in packs.select("pack_name", "capacity_tokens").filter(F.col("capacity_tokens") >= 1).limit(MAX_PACKS + 1).collect()})
    if len(offers) > MAX_PACKS:
        raise ValueError(f"more than {MAX_PACKS} packs")
    pieces = lambda c: F.sum(F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / c)))
    whole = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"), *(pieces(c).alias(f"p{i}") for i, (_, c) in enumerate(offers))).first()  # one row
    groups = max(1, -(-whole["n"] // group_rows))
    limits = [max_documents or max(2, math.ceil(documents_factor * (whole[f"p{i}"] or 0) * c / max(1, whole["tokens"] or 0))) for i, (_, c) in enumerate(offers)]

    def fill(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable")
        tokens, ids = rows["n_tokens"].to_numpy(), rows["doc_id"].array
        parts = [pd.DataFrame(columns=[c.split(" ")[0] for c in PLACED.split(", ")])] if not offers else []
        for (name, capacity), documents in zip(offers, limits):
            item, start, length, container = pack(tokens, capacity, documents, cost_share * float(capacity) ** 2, rule, weights)
            parts.append(pd.DataFrame({
                "pack_name": name, "capacity_tokens": capacity, "doc_id": ids[item], "piece_no": start // capacity, "start_token": start, "n_tokens": length, "container": container * groups + int(key[0]),
            }))
        return pd.concat(parts)

    group = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    spread = sizes.withColumn("group_id", group).repartition(min(groups, MAX_TASKS), "group_id")  # by number, as these small rows take long: they must not be put together by their bytes
    return spread.groupBy("group_id").applyInPandas(fill, PLACED)


def usage(placed: DataFrame) -> DataFrame:
    """Containers, tokens and the share of space used per pack."""
    one = placed.groupBy("pack_name", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    return one.groupBy("pack_name", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("tokens").alias("n_tokens"), F.sum("pieces").alias("n_pieces"), F.round(F.sum("tokens") / (F.count(F.lit(1)) * F.first("capacity_tokens")), 4).alias("share_used")
    )
