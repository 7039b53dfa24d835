"""Embedding near-dedup by robust-pruned flat graphs over overlapping cluster shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agewise.llm.common import connected_components, materialise, need


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def usable(rows: pd.DataFrame) -> np.ndarray:
    """Which vectors can be compared: not null, no null or non-finite component, not zero."""
    ok = np.zeros(len(rows), dtype=bool)
    for k, v in enumerate(rows["v"]):
        if v is not None and len(v):
            x = np.asarray(v, dtype=float)
            ok[k] = np.isfinite(x).all() and x.any()
    return ok


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centres of unit rows, by cosine."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


def robust_prune(sims: np.ndarray, degree: int, alpha: float) -> list[np.ndarray]:
    """Out-neighbours of each row of a square similarity matrix: the nearest first, without those that a chosen one is
    ``alpha`` times nearer to (squared distances of unit vectors)."""
    n = len(sims)
    out = []
    reach = min(n - 1, 4 * degree)
    for p in range(n):
        near = np.argpartition(-sims[p], reach)[: reach + 1] if reach + 1 < n else np.arange(n)
        near = near[near != p]
        near = near[np.argsort(-sims[p, near], kind="stable")]
        chosen: list[int] = []
        far = 2 - 2 * sims[p, near]
        alive = np.ones(len(near), dtype=bool)
        while len(chosen) < degree and alive.any():
            k = int(alive.argmax())
            chosen.append(int(near[k]))
            alive &= alpha * (2 - 2 * sims[near[k], near]) > far
            alive[k] = False
        out.append(np.array(chosen, dtype=np.int64))
    return out


def build_graph(x: np.ndarray, degree: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the pruned edges of one shard, both ways, so that every vector can be reached from its neighbours. Parts
    that no edge joins are joined by the best edge out of each, so the graph is connected."""
    sims = x @ x.T
    lists = robust_prune(sims, degree, alpha)
    src = np.repeat(np.arange(len(x)), [len(a) for a in lists])
    dst = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
    while len(np.unique(low := smallest_reachable(len(x), np.stack([src, dst], axis=1)))) > 1:
        more = []
        for part in np.unique(low):
            own, others = np.flatnonzero(low == part), np.flatnonzero(low != part)
            out = sims[np.ix_(own, others)]
            at = np.unravel_index(out.argmax(), out.shape)
            more.append((own[at[0]], others[at[1]]))
        src, dst = (np.r_[was, [m[k] for m in more]] for k, was in enumerate((src, dst)))
    pairs = np.unique(np.stack([np.r_[src, dst], np.r_[dst, src]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def search(x: np.ndarray, src: np.ndarray, dst: np.ndarray, queries: np.ndarray, threshold: float, beam: int, slack: float) -> Iterator[tuple[int, np.ndarray]]:
    """(query, rows with at least ``threshold``): greedy search from the medoid and the query itself, then expansion of what
    is in range.

    All queries walk together: each expands the best vector of its beam that it has not expanded, until there is none. What
    it has met at ``threshold - slack`` or more starts a breadth-first walk over the vectors within that range.
    """
    n, order = len(x), np.argsort(src, kind="stable")
    dst, first = dst[order], np.searchsorted(src[order], np.arange(n + 1))
    width = int(np.diff(first).max(initial=0))
    medoid = int((x @ unit(x.sum(axis=0, keepdims=True) + 1e-12)[0]).argmax())
    table = np.full((n, max(width, 1)), -1, dtype=np.int64)
    for p in range(n):
        table[p, : first[p + 1] - first[p]] = dst[first[p] : first[p + 1]]
    q = x[queries]
    ids = np.full((len(q), beam), -1, dtype=np.int64)
    sims = np.full((len(q), beam), -np.inf)
    ids[:, 0], sims[:, 0] = medoid, q @ x[medoid]
    other = queries != medoid
    ids[other, 1], sims[other, 1] = queries[other], 1.0
    done = np.zeros((len(q), beam), dtype=bool)
    walking = np.arange(len(q))
    while len(walking):
        best = np.where(done[walking] | (ids[walking] < 0), -np.inf, sims[walking])
        pick = best.argmax(axis=1)
        on = np.isfinite(best[np.arange(len(walking)), pick])
        walking, pick = walking[on], pick[on]
        if not len(walking):
            break
        done[walking, pick] = True
        new = table[ids[walking, pick]]
        new = np.where((new[:, :, None] == ids[walking][:, None, :]).any(axis=2), -1, new)
        got = np.einsum("qd,qkd->qk", q[walking], x[np.maximum(new, 0)])
        got = np.where(new < 0, -np.inf, got)
        all_ids, all_sims = np.concatenate([ids[walking], new], axis=1), np.concatenate([sims[walking], got], axis=1)
        all_done = np.concatenate([done[walking], np.zeros(new.shape, dtype=bool)], axis=1)
        top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[walking] = np.take_along_axis(all_ids, top, axis=1)
        sims[walking] = np.take_along_axis(all_sims, top, axis=1)
        done[walking] = np.take_along_axis(all_done, top, axis=1)
    for k in range(len(q)):
        seen = np.zeros(n, dtype=bool)
        front = ids[k][(ids[k] >= 0) & (sims[k] >= threshold - slack)]
        while len(front):
            seen[front] = True
            near = np.unique(np.concatenate([dst[first[p] : first[p + 1]] for p in front]))
            near = near[~seen[near]]
            front = near[x[near] @ q[k] >= threshold - slack]
        found = np.flatnonzero(seen)
        found = found[found != queries[k]]
        yield k, found[x[found] @ q[k] >= threshold]


def smallest_reachable(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of n nodes, the smallest that the undirected pairs reach."""
    low = np.arange(n)
    while len(pairs):
        before = low.copy()
        least = np.minimum(low[pairs[:, 0]], low[pairs[:, 1]])
        np.minimum.at(low, pairs[:, 0], least)
        np.minimum.at(low, pairs[:, 1], least)
        low = low[low]
        if (low == before).all():
            break
    return low


#: A cell is split if its parts, with guests, have at most so many times its rows.
MOST_COPIES = 3


def assign(reps: DataFrame, shard_rows: int, sample_rows: int, margin: float, max_levels: int = 6) -> DataFrame:
    """(cell, rep, v, home): every vector in the shard of its nearest centre, home true, and in shards whose centre is
    within ``margin`` of that cosine.

    Cells of more than ``shard_rows`` home rows are split again and again, ``max_levels`` times at most: centres come from at
    most ``sample_rows`` rows of a cell, those of the smallest hashes. A cell whose parts would hold over ``MOST_COPIES``
    times its rows, as it holds vectors that are almost alike, is left whole.
    """
    spark = reps.sparkSession
    now = reps.select(F.col("part").alias("cell"), "rep", "v", F.lit(True).alias("home"))
    settled: list[DataFrame] = []
    for _ in range(max_levels):
        now = materialise(now, "cells")
        sizes = now.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
        big = sizes.where(F.col("homes") > shard_rows).select("cell", "n")
        todo = now.join(big, "cell")
        chance = F.col("n") * F.pmod(F.xxhash64("rep", F.lit(9)), F.lit(1 << 30)) / float(1 << 30) < sample_rows

        def centres(rows: pd.DataFrame) -> pd.DataFrame:
            x = unit(np.array(rows["v"].to_list()))
            k = int(min(64, max(2, -(-2 * rows["n"].iloc[0] // shard_rows)), len(x)))
            return pd.DataFrame({"cell": rows["cell"].iloc[0], "c": list(k_means(x, k))})

        found = materialise(todo.where(chance).groupBy("cell").applyInPandas(centres, "cell string, c array<double>"), "centres")
        if found.isEmpty():
            break
        lists = found.groupBy("cell").agg(F.sort_array(F.collect_list("c")).alias("cs"))
        settled.append(now.join(lists.select("cell"), "cell", "left_anti"))

        def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                out = []
                for cell, group in part.groupby("cell"):
                    c = np.array([np.asarray(a, dtype=float) for a in group["cs"].iloc[0]])
                    x = unit(np.array(group["v"].to_list()))
                    sims = x @ c.T
                    top = sims.max(axis=1, keepdims=True)
                    row, col = np.nonzero(sims >= top - margin)
                    out.append(
                        pd.DataFrame(
                            {
                                "parent": cell,
                                "cell": [f"{cell}/{k}" for k in col],
                                "rep": group["rep"].to_numpy()[row],
                                "v": [group["v"].iloc[r] for r in row],
                                "home": group["home"].to_numpy()[row] & (sims.argmax(axis=1)[row] == col),
                            }
                        )
                    )
                if out:
                    yield pd.concat(out)

        split = now.join(lists, "cell").select("cell", "rep", "v", "home", "cs")
        dealt = split.mapInPandas(deal, "parent string, cell string, rep long, v array<double>, home boolean")
        # only counts decide, before any copy is written
        copies = dealt.groupBy(F.col("parent").alias("cell")).agg(F.count("*").alias("m")).join(big, "cell")
        whole = materialise(copies.where(F.col("m") > MOST_COPIES * F.col("n")).select("cell"), "whole")
        settled.append(now.join(whole, "cell"))
        now = dealt.join(whole.withColumnRenamed("cell", "parent"), "parent", "left_anti").drop("parent")
    else:
        settled.append(materialise(now, "cells"))
        return _union(settled)
    settled.append(now)
    return _union(settled)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def near_vectors(
    rows: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    shard_rows: int = 1500,
    sample_rows: int = 4096,
    margin: float = 0.08,
    degree: int = 24,
    alpha: float = 1.2,
    beam: int = 24,
    slack: float = 0.03,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``rows``.

    Vectors are compared within equal, not null labels by cosine in double precision, and linked at ``threshold``. Equal
    vectors of a label are one node with a count, linked to each other. Nodes are dealt to overlapping cluster shards
    (:func:`assign`); each shard builds a robust-pruned graph; the adjacency lists of all shards are united, and in each shard
    every vector at home there is searched for over the united lists, from itself and the shard's medoid. Links found are verified by
    their cosines, so none is false; :func:`audit_recall` measures how many are found. Shards of more than twice
    ``shard_rows`` vectors have no graph: all their pairs are compared, a pair of blocks of vectors at a time.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with nothing.
    Vectors of unequal lengths are never compared. A null id counts as another vector, is never the smallest and has a null
    component_id if it is alone. Ids are taken to be unique; repeated ones are other vectors. An empty table gives no rows.
    """
    need(rows, [id_col, vector_col, label_col])
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("l"))
    v = F.col("v")
    norm2 = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.coalesce(F.col("l").isNotNull() & (F.size(v) > 0) & ~bad & (norm2 > 0), F.lit(False))
    part = F.concat(F.size(v).cast("string"), F.lit(":"), F.col("l"))
    # a zero of either sign is the same component
    clean = F.transform(v, lambda x: x + 0.0)
    base = materialise(base.select("id", F.when(ok, clean).alias("v"), F.when(ok, part).alias("part")), "vectors")
    copies = base.where(F.col("part").isNotNull()).groupBy("part", "v").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    reps = materialise(copies.withColumn("rep", F.monotonically_increasing_id()), "reps")
    every = materialise(assign(reps, shard_rows, sample_rows, margin).join(reps.select("rep", "n"), "rep"), "dealt")
    large = every.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > 2 * shard_rows)
    large = materialise(large.withColumn("blocks", F.ceil(F.col("size") / shard_rows).cast("int")), "large")
    dealt = every.join(large.select("cell"), "cell", "left_anti")

    def graph(group: pd.DataFrame) -> pd.DataFrame:
        x, ids = unit(np.array(group["v"].to_list())), group["rep"].to_numpy()
        src, dst = build_graph(x, degree, alpha)
        return pd.DataFrame({"a": ids[src], "b": ids[dst]})

    lists = dealt.groupBy("cell").applyInPandas(graph, "a long, b long").groupBy("a").agg(F.collect_set("b").alias("bs"))
    lists = materialise(lists, "lists")
    with_lists = dealt.join(lists, dealt["rep"] == lists["a"], "left").select("cell", "rep", "v", "home", "n", "bs")

    def links(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep").reset_index(drop=True)
        ids, x, n = group["rep"].to_numpy(), unit(np.array(group["v"].to_list())), group["n"].to_numpy()
        lens = [0 if b is None else len(b) for b in group["bs"]]
        src = np.repeat(np.arange(len(ids)), lens)
        far = np.concatenate([np.asarray(b) for b in group["bs"] if b is not None]) if sum(lens) else np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(ids, far), len(ids) - 1)
        here = ids[at] == far
        home = np.flatnonzero(group["home"].to_numpy())
        inside = group["home"].to_numpy()
        # links to vectors at home here are counted, by whichever end's search met them; those to guests are given, as the pairs
        # of different shards are united in both directions later
        guests, met = [], np.zeros((len(ids), len(ids)), dtype=bool)
        for k, found in search(x, src[here], at[here], home, threshold, beam, slack):
            met[home[k], found[inside[found]]] = True
            guests.append(ids[found[~inside[found]]])
        met |= met.T
        low = smallest_reachable(len(ids), np.argwhere(met))
        return pd.DataFrame({"rep": ids[home], "inner": met[home] @ n, "low": ids[low[home]] if len(home) else [], "guests": guests})

    def block_links(group: pd.DataFrame) -> pd.DataFrame:
        asked, rows = group[group["query"]], group[~group["query"]]
        a, b = asked["rep"].to_numpy(), rows["rep"].to_numpy()
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "inner": [], "low": [], "guests": []})
        near = unit(np.array(asked["v"].to_list())) @ unit(np.array(rows["v"].to_list())).T >= threshold
        near &= a[:, None] != b[None, :]
        inside, n = rows["home"].to_numpy(), rows["n"].to_numpy()
        own = near & inside
        ids = np.unique(np.r_[a, b])
        row, col = np.nonzero(own)
        low = smallest_reachable(len(ids), np.stack([np.searchsorted(ids, a[row]), np.searchsorted(ids, b[col])], axis=1))
        guests = [b[x] for x in near & ~inside]
        return pd.DataFrame({"rep": a, "inner": own @ n, "low": ids[low[np.searchsorted(ids, a)]], "guests": guests})

    schema = "rep long, inner long, low long, guests array<long>"
    found = with_lists.groupBy("cell").applyInPandas(links, schema)
    held = every.join(large, "cell").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(11)), F.col("blocks")).cast("int"))
    turn = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asked = held.where("home").select("cell", F.col("own").alias("i"), turn.alias("j"), "rep", "v", "n", "home", F.lit(True).alias("query"))
    against = held.select("cell", turn.alias("i"), F.col("own").alias("j"), "rep", "v", "n", "home", F.lit(False).alias("query"))
    blocks = asked.unionByName(against).groupBy("cell", "i", "j").applyInPandas(block_links, schema)
    found = materialise(found.unionByName(blocks), "found")
    counts = found.groupBy("rep").agg(F.sum("inner").alias("inner"))
    across = found.select("rep", F.explode("guests").alias("other"))
    across = materialise(across.unionByName(across.select(F.col("other").alias("rep"), F.col("rep").alias("other"))).distinct(), "across")
    outer = across.join(reps.select(F.col("rep").alias("other"), "n"), "other").groupBy("rep").agg(F.sum("n").alias("outer"))
    # each vector and the smallest that links inside its shard reach from it, and the links between shards
    edges = found.select(F.col("rep").alias("src"), F.col("low").alias("dst"))
    edges = edges.unionByName(across.select(F.col("rep").alias("src"), F.col("other").alias("dst")))
    comp = connected_components(edges)
    nodes = reps.join(counts, "rep", "left").join(outer, "rep", "left").join(comp, reps["rep"] == comp["node"], "left")
    nodes = nodes.select("part", "v", "rep", "least", F.coalesce("component", "rep").alias("comp"), (F.col("n") - 1 + F.coalesce("inner", F.lit(0)) + F.coalesce("outer", F.lit(0))).alias("n_links"))
    nodes = materialise(nodes, "nodes")
    least = nodes.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "comp").select("part", "v", "n_links", "component_id")
    done = base.where(F.col("part").isNotNull()).join(named, ["part", "v"]).select("id", "n_links", "component_id")
    alone = base.where(F.col("part").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = done.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def audit_recall(rows: DataFrame, found: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, every: int = 20) -> DataFrame:
    """One row (true_links, found_links, recall): the links of the vectors whose id is divisible by ``every``, by comparing
    these with all rows of their label in blocks, against ``n_links`` of ``found``."""
    base = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("l"))
    base = base.where(F.col("l").isNotNull())

    def clean(part: pd.DataFrame) -> pd.DataFrame:
        return part[usable(part)]

    def count(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = clean(left), clean(right)
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "n": []})
        sims = unit(np.array([np.asarray(v) for v in left["v"]])) @ unit(np.array([np.asarray(v) for v in right["v"]])).T
        same = left["id"].to_numpy()[:, None] == right["id"].to_numpy()[None, :]
        return pd.DataFrame({"id": left["id"].to_numpy(), "n": ((sims >= threshold) & ~same).sum(axis=1)})

    blocks = 16
    asked = base.where(F.col("id") % every == 0).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    against = base.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    true = asked.groupBy("l", "b").cogroup(against.groupBy("l", "b")).applyInPandas(count, "id long, n long")
    true = true.groupBy("id").agg(F.sum("n").alias("n")).join(found.select(F.col(id_col).alias("id"), "n_links"), "id")
    sums = true.agg(F.sum("n").alias("true_links"), F.sum(F.least("n", "n_links")).alias("found_links"))
    return sums.withColumn("recall", F.when(F.col("true_links") > 0, F.col("found_links") / F.col("true_links")).otherwise(1.0))
