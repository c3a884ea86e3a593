"""Embedding near-duplicates over hierarchical navigable small-world graphs.

Distinct vectors are dealt into shards and each shard gets a graph.  A recall audit of the
new graph compares sampled searches with all of the shard and doubles the beam until it
passes; that beam is the shard's.  Every vector is searched in every shard, block by block,
and all neighbours within the threshold are followed from the beam.  Searches number
vectors times shards, so shards are as large as a task can hold.  Cosines are verified in
double precision, counted, and joined into components.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.components import connected, merge_labels
from opinara.llm.shared import written
from opinara.llm.vectors import matrix, packed

SHARD_ROWS = 32_768
BLOCK_ROWS = 4_096  # at least; as many blocks as cores are enough
FOLLOWED = 4_096  # nodes whose neighbours are compared at once: some 100 MB of vectors
LINKS = 12  # kept by a node on an upper level; twice as many on the lowest
SINGLE = 1e-5  # what single precision may miss, verified afterwards
MARGIN = 0.02  # below the threshold, in which searches still go on


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32)


class Graph:
    """Levels of neighbour lists over unit vectors; node 0 is the entry."""

    def __init__(self, x: np.ndarray, links: int = LINKS, beam: int = 40, seed: int = 11):
        self.x, self.links = x, links
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(rng.random(len(x)) + 1e-12) / math.log(links)).astype(int) if len(x) else np.zeros(0, int)
        if len(x):
            level[0] = level.max()
        self.level = level
        self.near = [np.full((len(x), links * (1 if l else 2)), -1, np.int32) for l in range(int(level.max(initial=0)) + 1)]
        done = min(len(x), 64)
        self._insert(0, done, beam)
        while done < len(x):
            end = min(len(x), done + min(1024, max(64, done // 2)))
            self._insert(done, end, beam)
            done = end
        self._reach_all()

    def _reach_all(self) -> None:
        """In a tight group neighbour lists overflow and a node may be in none.  Every node
        that its nearest neighbour does not list gets two links: from that one of its six
        nearest neighbours which has the fewest such links, and likewise from one that is
        itself listed."""
        near = self.near[0]
        first = np.maximum(near[:, 0], 0)
        lost = np.flatnonzero((near[:, 0] >= 0) & ~(near[first] == np.arange(len(near))[:, None]).any(axis=1))
        given: dict[int, list[int]] = {}
        alone = set(lost.tolist())
        for v in lost.tolist():
            close = [p for p in near[v].tolist() if p >= 0]
            for some in (close[:6], [p for p in close if p not in alone][:6]):
                if some:
                    p = min(some, key=lambda p: len(given.get(p, ())))
                    if v not in given.setdefault(p, []):
                        given[p].append(v)
        extra = np.full((len(near), max(map(len, given.values()), default=0)), -1, np.int32)
        for p, vs in given.items():
            extra[p, :len(vs)] = vs
        self.near[0] = np.hstack([near, extra])

    def _insert(self, start: int, end: int, beam: int) -> None:
        """Link the nodes from ``start``: to what a search of the graph so far finds and to one another."""
        q, here = self.x[start:end], np.arange(start, end)
        entry = np.zeros((len(q), 1), np.int64)
        for l in range(len(self.near) - 1, -1, -1):
            mine = self.level[here] >= l
            wide = np.flatnonzero(mine)
            found = np.full((len(q), beam), -1, np.int64)
            if start:
                found[:, :1] = self.search(q, entry, 1, l)[0] if l and not mine.all() else entry[:, :1]
                if len(wide):
                    found[wide] = self.search(q[wide], entry[wide], beam, l)[0]
            if len(wide):
                sims = q[wide] @ q[wide].T
                sims[np.arange(len(wide)), np.arange(len(wide))] = -np.inf
                few = min(beam, len(wide) - 1)
                mates = here[wide][np.argsort(-sims, axis=1)[:, :few]] if few > 0 else np.zeros((len(wide), 0), np.int64)
                self._link(l, here[wide], np.hstack([found[wide], mates]))
            entry = found[:, :1] if start else np.zeros((len(q), 1), np.int64)

    def _link(self, l: int, nodes: np.ndarray, found: np.ndarray) -> None:
        width = self.near[l].shape[1]
        self.near[l][nodes] = self._diverse(nodes, found, width)
        src, dst = np.repeat(nodes, width), self.near[l][nodes].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        for at in range(0, len(targets), 1024):
            t, f, c = targets[at:at + 1024], first[at:at + 1024], count[at:at + 1024]
            more = np.full((len(t), int(c.max())), -1, np.int64)
            row = np.repeat(np.arange(len(t)), c)
            more[row, np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)] = src[np.repeat(f, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
            self.near[l][t] = self._diverse(t, np.hstack([self.near[l][t], more]), width)

    def _diverse(self, nodes: np.ndarray, found: np.ndarray, width: int) -> np.ndarray:
        """Of the candidates, those closer to the node than to one already taken, nearest
        first; free places go to the nearest of the others."""
        found = np.where(found == nodes[:, None], -1, found)
        found = np.sort(found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        sim = np.einsum("nd,ncd->nc", self.x[nodes], self.x[found])
        sim[found < 0] = -np.inf
        keep = np.argsort(-sim, axis=1)[:, :3 * width]
        found, sim = np.take_along_axis(found, keep, 1), np.take_along_axis(sim, keep, 1)
        among = self.x[found] @ self.x[found].transpose(0, 2, 1)
        taken, blocked = np.zeros(found.shape, bool), np.full(found.shape, -np.inf)
        for c in range(found.shape[1]):
            ok = (found[:, c] >= 0) & (blocked[:, c] < sim[:, c]) & (taken.sum(axis=1) < width)
            taken[:, c] = ok
            blocked[ok] = np.maximum(blocked[ok], among[ok, c])
        rank = np.argsort(np.where(taken, 0, np.where(found >= 0, 1, 2)), axis=1, kind="stable")[:, :width]
        out = np.take_along_axis(found, rank, 1)
        return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)

    def search(self, q: np.ndarray, entry: np.ndarray, beam: int, l: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the beams of all queries, best first, on level ``l``."""
        n, near = len(q), self.near[l]
        ids, sims = np.full((n, beam), -1, np.int64), np.full((n, beam), -np.inf, np.float32)
        shown = np.zeros((n, beam), bool)
        seen = np.zeros((n, len(self.x)), bool)
        w = min(beam, entry.shape[1])
        ids[:, :w] = entry[:, :w]
        ok = ids[:, :w] >= 0
        sims[:, :w] = np.where(ok, np.einsum("nd,ncd->nc", q, self.x[ids[:, :w]]), -np.inf)
        seen[np.arange(n)[:, None], np.where(ok, ids[:, :w], 0)] = True
        live = np.arange(n)
        while len(live):
            rest = np.where(shown[live] | (ids[live] < 0), -np.inf, sims[live])
            live = live[rest.max(axis=1) > -np.inf]
            if not len(live):
                break
            rest = np.where(shown[live] | (ids[live] < 0), -np.inf, sims[live])
            pick = np.argpartition(-rest, min(step, beam) - 1, axis=1)[:, :min(step, beam)]
            real = np.take_along_axis(rest, pick, 1) > -np.inf
            shown[live[:, None], pick] = True
            nodes = np.where(real, np.take_along_axis(ids[live], pick, 1), 0)
            new = np.where(real[:, :, None], near[nodes], -1).reshape(len(live), -1)
            new[seen[live[:, None], new] | (new < 0)] = -1
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new = np.sort(new, axis=1)[:, ::-1]
            new = new[:, :max(1, int((new >= 0).sum(axis=1).max()))]
            row, col = np.nonzero(new >= 0)
            s = np.full(new.shape, -np.inf, np.float32)
            s[row, col] = np.einsum("rd,rd->r", q[live[row]], self.x[new[row, col]])
            seen[live[row], new[row, col]] = True
            ids2, sims2 = np.hstack([ids[live], new]), np.hstack([sims[live], s])
            shown2 = np.hstack([shown[live], np.zeros(new.shape, bool)])
            top = np.argpartition(-sims2, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], shown[live] = (np.take_along_axis(a, top, 1) for a in (ids2, sims2, shown2))
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def beams(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(q), 1), np.int64)
        for l in range(len(self.near) - 1, 0, -1):
            entry = self.search(q, entry, 1, l)[0]
        return self.search(q, entry, beam, 0)

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs with a cosine of ``least`` or more: those in the beam, and
        all that links between such nodes lead to."""
        rows, nodes = [], []
        for at in range(0, len(q), 512):
            part = q[at:at + 512]
            if beam >= len(self.x):  # a beam as wide as the shard holds all of it
                r, n = np.nonzero(part @ self.x.T >= least)
                rows.append(r + at)
                nodes.append(n)
                continue
            ids, sims = self.beams(part, beam)
            seen = np.zeros((len(part), len(self.x)), bool)
            r, c = np.nonzero(sims >= least - MARGIN)
            n = ids[r, c]
            seen[r, n] = True
            while len(r):
                hit = np.einsum("rd,rd->r", part[r], self.x[n]) >= least
                rows.append(r[hit] + at)
                nodes.append(n[hit])
                nr, nn = [], []
                for k in range(0, len(r), FOLLOWED):
                    rr, nb = np.repeat(r[k:k + FOLLOWED], self.near[0].shape[1]), self.near[0][n[k:k + FOLLOWED]].ravel()
                    fresh = (nb >= 0) & ~seen[rr, nb]
                    pair = np.unique(rr[fresh] * len(self.x) + nb[fresh])
                    rr, nb = pair // len(self.x), pair % len(self.x)
                    seen[rr, nb] = True
                    ok = np.einsum("rd,rd->r", part[rr], self.x[nb]) >= least - MARGIN
                    nr.append(rr[ok])
                    nn.append(nb[ok])
                r, n = np.concatenate(nr), np.concatenate(nn)
        return (np.concatenate(rows), np.concatenate(nodes)) if rows else (np.zeros(0, np.int64),) * 2

    def audit(self, q: np.ndarray, least: float, beam: int, sample: int, seed: int) -> float:
        """Recall of sampled queries, and of nodes disturbed to just above the threshold."""
        rng = np.random.default_rng(seed)
        own = q[rng.permutation(len(q))[:sample]]
        base = self.x[rng.permutation(len(self.x))[:sample]]
        noise = rng.normal(size=base.shape).astype(np.float32)
        noise -= (noise * base).sum(axis=1, keepdims=True) * base
        noise /= np.maximum(1e-9, np.sqrt((noise * noise).sum(axis=1, keepdims=True)))
        c = min(1.0, least + (1 - least) * 0.1)
        probes = np.vstack([own, c * base + math.sqrt(1 - c * c) * noise])
        true = probes @ self.x.T >= least
        r, n = self.within(probes, least, beam)
        return float(true[r, n].sum() / max(1, true.sum()))

    def audited(self, least: float, recall: float, beam: int, sample: int, seed: int) -> int:
        """The smallest of the beams ``beam``, twice that, ... whose audit reaches ``recall``;
        one as wide as the shard holds all of it."""
        rounds = 0
        while beam < len(self.x) and self.audit(self.x, least, beam, sample, seed + rounds) < recall:
            beam, rounds = 2 * beam, rounds + 1
        return min(beam, max(1, len(self.x)))

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *self.near)
        return out.getvalue()

    @classmethod
    def unpack(cls, x: np.ndarray, raw: bytes) -> Graph:
        g = cls.__new__(cls)
        g.x = x
        with np.load(io.BytesIO(raw)) as z:
            g.near = [z[k] for k in z.files]
        return g


def near_vectors(df: DataFrame, key: str, vec: str, least: float = 0.95, recall: float = 0.99, beam: int = 32, sample: int = 256,
                 shard_rows: int = SHARD_ROWS, block_rows: int | None = None) -> DataFrame:
    """(key, n_links, component, kept) for every row: how many other vectors have a cosine
    of ``least`` or more, the smallest key reachable over such links, and whether that is
    the row's own key.

    Equal vectors are one node with a weight, so a group of copies costs one search.
    Vectors that are null, zero, hold null or non-finite components or differ in length
    from the others, and rows without a key, link with nothing; a null key has a null
    component and is not kept.  A repeated key counts once (see ``packed``).
    """
    rows = written(packed(df, key, vec, zero=False))
    nodes = written(rows.groupBy("v").agg(F.min("key").alias("node"), F.count("*").alias("w")))
    n = max(1, nodes.count())
    # a shard's graph travels once a block: no smaller blocks than keep the cores busy
    block_rows = block_rows or min(SHARD_ROWS, max(BLOCK_ROWS, n // (2 * df.sparkSession.sparkContext.defaultParallelism)))
    shards, blocks = -(-n // shard_rows), -(-n // block_rows)
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(blocks)).cast("int"))

    def build(f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(h=pd.util.hash_array(f["node"].to_numpy().astype(np.uint64))).sort_values(["h", "node"])
        graph = Graph(unit(matrix(f["v"])))
        width = graph.audited(least - SINGLE, recall, beam, sample, 7919 + int(f["shard"].iloc[0]))
        return pd.DataFrame({"shard": [f["shard"].iloc[0]], "ids": [f["node"].to_numpy().tobytes()], "ws": [f["w"].to_numpy().tobytes()],
                             "vs": [b"".join(f["v"])], "graph": [graph.pack()], "beam": [width]})

    def gather(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node")
        return pd.DataFrame({"block": [f["block"].iloc[0]], "qids": [f["node"].to_numpy().tobytes()], "qs": [b"".join(f["v"])]})

    graphs = written(dealt.groupBy("shard").applyInPandas(build, "shard int, ids binary, ws binary, vs binary, graph binary, beam int"))
    asked = dealt.groupBy("block").applyInPandas(gather, "block int, qids binary, qs binary")
    every = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = asked.select(F.col("block").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("in"), "qids", "qs")
    cells = pairs.join(every, (F.col("of") == F.col("block")) & (F.col("in") == F.col("shard"))).select("of", "shard", "qids", "qs", "ids", "ws", "vs", "graph", "beam")

    def search(frames):
        for f in frames:
            for c in f.itertuples(index=False):
                yield _cell(c, least)

    found = written(cells.mapInPandas(search, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = connected(found.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.select("node", "w", "v").join(links, "node", "left").join(reached, "node", "left")
    own = rows.join(named, "v").select(F.col("key").alias("_id"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"),
                                       F.coalesce("component", "node").alias("c"))
    out = df.select(F.col(key).cast("long").alias(key)).join(own, F.col(key) == F.col("_id"), "left")
    component = F.coalesce("c", F.col(key))
    return out.select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col(key), F.lit(False)).alias("kept"))


def _cell(c, least: float) -> pd.DataFrame:
    """Search one block in one shard: links of each query, and a spanning set of the links."""
    ids, ws, qids = (np.frombuffer(b, np.int64) for b in (c.ids, c.ws, c.qids))
    xs, qs = np.frombuffer(c.vs, np.float64).reshape(len(ids), -1), np.frombuffer(c.qs, np.float64).reshape(len(qids), -1)
    graph, q = Graph.unpack(unit(xs), c.graph), unit(qs)
    r, n = graph.within(q, least - SINGLE, c.beam)
    qn, xn = np.sqrt((qs * qs).sum(axis=1)), np.sqrt((xs * xs).sum(axis=1))
    true = np.concatenate([np.einsum("rd,rd->r", qs[r[k:k + 65536]], xs[n[k:k + 65536]]) / (qn[r[k:k + 65536]] * xn[n[k:k + 65536]])
                           for k in range(0, len(r), 65536)] or [np.zeros(0)]) >= least
    true &= qids[r] != ids[n]
    r, n = r[true], n[true]
    links = np.bincount(r, ws[n], len(qids)).astype(np.int64)
    both = np.unique(np.concatenate([qids, ids]))
    labels = merge_labels(np.arange(len(both)), np.searchsorted(both, qids[r]), np.searchsorted(both, ids[n]))
    root = both[labels]
    count = np.zeros(len(both), np.int64)
    count[np.searchsorted(both, qids)] = links
    keep = (count > 0) | (root != both)
    return pd.DataFrame({"node": both[keep], "links": count[keep], "root": root[keep]})
