"""Approximate nearest neighbours by cosine: a navigable small-world graph a shard, results merged.

Equal vectors are one entry of the index with their least ids (as many as an answer can need), so a vector that
fills a third of the table is no hot spot and copies don't wall a graph in.  Entries are dealt to shards of
a fixed size by hash.  A task builds the graph of a shard: entries get levels at random (by hash) and stand in
descending order of level, so those of a level are the first rows; a level's neighbours are one flat array,
-1 where there are fewer.  Entries go in by batches, which search the graph so far (and meet each other
exactly), keep neighbours that are not nearer to one kept already, and are linked back.  The graphs are
a table in the shared folder.

Queries meet each shard in blocks of a fixed size; a task searches one graph for one block, all
queries in step.  What it finds is measured again in double precision on the given vectors.  A window merges the shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .batches import narrow
from .scratch import stored

#: Entries of a shard, and queries that meet a shard in one task.
SHARD, QUERIES = 16_384, 16_384
#: Neighbours above the lowest level (twice as many there), and rows kept in a search while building and asking.
LINKS, BUILD, SEARCH = 16, 64, 192
_STEP = 512
_GRAPH = T.StructType([T.StructField(c, t) for c, t in (("dim", T.IntegerType()), ("shard", T.IntegerType()), ("vectors", T.BinaryType()), ("ids", T.BinaryType()), ("many", T.BinaryType()), ("levels", T.ArrayType(T.BinaryType())))])


def _pick(near: np.ndarray, sims: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """(rows, most): of candidates ``near`` (best first, -1: none) those that are no nearer to a kept one than to their row; then the best of the rest."""
    n, width = near.shape
    step = max(1, (1 << 24) // (width * (x.shape[1] + width)))
    if n > step:
        return np.concatenate([_pick(near[i : i + step], sims[i : i + step], x, most) for i in range(0, n, step)])
    v = x[near]
    cross = np.matmul(v, v.transpose(0, 2, 1))
    free, count, kept = near >= 0, np.zeros(n, np.int64), np.zeros((n, width), bool)
    for j in range(width):
        take = free[:, j] & (count < most)
        kept[take, j] = True
        count += take
        free[take] &= cross[take, j] <= sims[take]
    order = np.argsort(np.where(kept, 0, np.where(near >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.full((n, most), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(near, order, axis=1)
    return out


def _beam(x: np.ndarray, links: np.ndarray, asked: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sims), best first: a search of one level for all ``asked`` vectors in step, from ``entry`` (-1: none), keeping ``width``."""
    n = len(asked)
    seen = np.zeros((n, len(links)), bool)
    row = np.arange(n)[:, None]
    best = np.full((n, width), -1, np.int32)
    sims = np.full((n, width), -np.inf, np.float32)
    entry = entry[:, :width]
    seen[np.broadcast_to(row, entry.shape)[entry >= 0], entry[entry >= 0]] = True
    best[:, : entry.shape[1]] = entry
    sims[:, : entry.shape[1]] = np.where(entry >= 0, np.matmul(x[entry], asked[:, :, None])[:, :, 0], -np.inf)
    open_ = np.isfinite(sims)
    live = np.arange(n)
    while len(live):
        score = np.where(open_[live], sims[live], -np.inf)
        spot = score.argmax(axis=1)
        more = np.isfinite(score[np.arange(len(live)), spot])
        live, spot = live[more], spot[more]
        if not len(live):
            break
        open_[live, spot] = False
        near = links[best[live, spot]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[np.broadcast_to(live[:, None], near.shape)[fresh], near[fresh]] = True
        s = np.where(fresh, np.matmul(x[near], asked[live][:, :, None])[:, :, 0], -np.inf)
        all_sims = np.concatenate([sims[live], s], axis=1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        sims[live] = np.take_along_axis(all_sims, top, axis=1)
        best[live] = np.take_along_axis(np.concatenate([best[live], np.where(fresh, near, -1)], axis=1), top, axis=1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], axis=1), top, axis=1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(best, order, axis=1), np.take_along_axis(sims, order, axis=1)


class Graph:
    """The levels of a shard over unit vectors ``x``, whose first rows are those of the higher levels."""

    def __init__(self, x: np.ndarray, levels: list[np.ndarray]) -> None:
        self.x, self.levels = x, levels

    @classmethod
    def built(cls, x: np.ndarray, sizes: list[int], width: int = BUILD) -> "Graph":
        """``sizes``: rows of each level, the lowest (all of them) first."""
        made = cls(x, [np.full((n, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k, n in enumerate(sizes)])
        start = 0
        while start < len(x):
            # A batch stands on one top level, and is no larger than what is there already.
            stop = min([start + min(_STEP, max(start, 16)), *[n for n in sizes if n > start]])
            made._add(start, stop, width)
            start = stop
        return made

    def _add(self, start: int, stop: int, width: int) -> None:
        x, batch = self.x, np.arange(start, stop, dtype=np.int32)
        mine = x[start:stop]
        among = mine @ mine.T
        np.fill_diagonal(among, -np.inf)
        entry = np.zeros((len(batch), 1), np.int32) if start else np.full((len(batch), 1), -1, np.int32)
        for level in range(len(self.levels) - 1, -1, -1):
            links = self.levels[level]
            have = min(start, len(links))
            if have:
                near, sims = _beam(x, links[:have], mine, entry, width if len(links) > start else 8)
                entry = near
            else:
                near, sims = np.full((len(batch), 1), -1, np.int32), np.full((len(batch), 1), -np.inf, np.float32)
            if len(links) <= start:  # the batch isn't on this level
                continue
            k = min(width, len(batch))
            peer = np.argpartition(-among, k - 1, axis=1)[:, :k]
            own = np.take_along_axis(among, peer, axis=1)
            near = np.concatenate([near, np.where(np.isfinite(own), batch[peer], -1)], axis=1)
            sims = np.concatenate([sims, own], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
            near, sims = np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1)
            chosen = _pick(near, sims, x, LINKS)
            links[start:stop, : chosen.shape[1]] = chosen
            self._link_back(links, batch, chosen)

    def _link_back(self, links: np.ndarray, batch: np.ndarray, chosen: np.ndarray) -> None:
        row, place = np.nonzero(chosen >= 0)
        to, back = chosen[row, place], batch[row]
        fresh = ~(links[to] == back[:, None]).any(axis=1)
        to, back = to[fresh], back[fresh]
        if not len(to):
            return
        s = np.einsum("ij,ij->i", self.x[to], self.x[back])
        order = np.lexsort((-s, to))
        to, back = to[order], back[order]
        nth = np.arange(len(to)) - np.searchsorted(to, to, side="left")
        room = links.shape[1]
        to, back, nth = to[nth < room], back[nth < room], nth[nth < room]
        target, at = np.unique(to, return_inverse=True)
        more = np.full((len(target), int(nth.max()) + 1), -1, np.int32)
        more[at, nth] = back
        both = np.concatenate([links[target], more], axis=1)
        count = (both >= 0).sum(axis=1)
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
        fits = count <= room
        links[target[fits]] = packed[fits][:, :room]
        for i in range(0, int((~fits).sum()), 4 * _STEP):
            full, near = target[~fits][i : i + 4 * _STEP], packed[~fits][i : i + 4 * _STEP]
            sims = np.where(near >= 0, np.matmul(self.x[near], self.x[full][:, :, None])[:, :, 0], -np.inf)
            order = np.argsort(-sims, axis=1, kind="stable")
            links[full] = _pick(np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1), self.x, room)

    def search(self, asked: np.ndarray, most: int, width: int = SEARCH) -> np.ndarray:
        """(queries, most) rows, best first, -1 where there are fewer."""
        out = np.full((len(asked), most), -1, np.int32)
        for i in range(0, len(asked), _STEP):
            part = asked[i : i + _STEP]
            near = np.zeros((len(part), 1), np.int32)
            for level in range(len(self.levels) - 1, -1, -1):
                near, _ = _beam(self.x, self.levels[level], part, near, 8 if level else max(width, most))
            out[i : i + _STEP, : near.shape[1]] = near[:, :most]
        return out


def _unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors for the search (scaled first, so that no square overflows)."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]).astype(np.float32)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, in double precision."""
    top = np.abs(a).max(axis=1, keepdims=True), np.abs(b).max(axis=1, keepdims=True)
    large = (np.maximum(*top) > 1e100) | (np.minimum(*top) < 1e-100)  # whose squares would leave the range
    a, b = np.where(large, a / top[0], a), np.where(large, b / top[1], b)
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v, dim) of the rows that take part: with an id, and a vector of finite components that aren't all zero."""
    rows = narrow(df, id=vec_id, v=vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    return kept.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.size("v").alias("dim"))


def entries(rows: DataFrame, copies: int) -> DataFrame:
    """(v, dim, ids): each distinct vector with its ``copies`` least ids.

    A map task sends ``copies`` rows of a vector at most.
    """
    same = W.partitionBy("key", "v").orderBy("id")
    few = rows.withColumn("key", F.xxhash64("v")).withColumn("place", F.dense_rank().over(same)).filter(F.col("place") <= copies)
    return few.groupBy("key", "v").agg(F.first("dim").alias("dim"), F.sort_array(F.collect_set("id")).alias("ids")).drop("key")


def index(rows: DataFrame, copies: int, per_shard: int = SHARD, width: int = BUILD) -> DataFrame:
    """The graphs of all shards (``_GRAPH``), stored; ``rows`` as ``usable`` gives them.  Vectors of different lengths are in different shards."""
    known = stored(entries(rows, copies), "entries")
    sizes = {r["dim"]: r["n"] for r in known.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row a length
    shards = F.lit(1)
    for dim, n in sizes.items():
        shards = F.when(F.col("dim") == dim, -(-n // per_shard)).otherwise(shards)
    dealt = known.withColumn("h", F.xxhash64(F.element_at("ids", 1))).withColumn("shard", F.pmod(F.col("h"), shards).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
        # The level by a hash of the id: a share 1 / LINKS of each level is on the next.
        h = table.column("h").combine_chunks().to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        level = (-np.log((h >> np.uint64(11)).astype(np.float64) / (1 << 53) + 1e-17) / np.log(LINKS)).astype(np.int64)
        order = np.lexsort((h, -level))
        table, level = table.take(pa.array(order)), level[order]
        vectors = _matrix(table.column("v"), dim)
        sizes = [int((level >= k).sum()) for k in range(int(level[0]) + 1)]
        graph = Graph.built(_unit(vectors), sizes, width)
        ids = table.column("ids").combine_chunks()
        values = [dim, shard, vectors.tobytes(), ids.flatten().to_numpy().astype(np.int64).tobytes(), np.diff(ids.offsets.to_numpy()).astype(np.int64).tobytes(), [x.tobytes() for x in graph.levels]]
        return pa.table([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary())), strict=True)], names=_GRAPH.names)

    return stored(dealt.groupBy("dim", "shard").applyInArrow(build, _GRAPH), "graphs")


def search(df: DataFrame, every: int = 50, top: int = 5, vec_id: str = "vec_id", vector: str = "embedding", per_shard: int = SHARD, per_block: int = QUERIES, width: int = SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by ``every`` the ``top`` other rows of largest cosine found, ties by lesser id.

    Rows whose id or vector is null, or whose vector is empty, zero or holds a null or a number that isn't finite, take no part. Vectors of
    different lengths don't meet.  A row isn't its own neighbour, nor is another row of its id; repeated rows count once. Fewer
    candidates than ``top`` give fewer rows; no rows give none.
    """
    rows = usable(df, vec_id, vector)
    graphs = index(rows, top + 1, per_shard)
    asked = rows.filter(F.col("id") % every == 0)
    # A query goes to each shard of its length; a graph to each block of queries.
    blocks = max(1, -(-asked.count() // per_block))
    shards = graphs.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    a = asked.join(F.broadcast(shards), "dim").select("dim", F.explode("shards").alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v")
    b = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = T.StructType([T.StructField(c, t) for c, t in (("query_id", T.LongType()), ("vec_id", T.LongType()), ("score", T.DoubleType()))])

    def ask(queries: pa.Table, graph: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if queries.num_rows and graph.num_rows:
            g = graph.slice(0, 1).to_pylist()[0]
            vectors = np.frombuffer(g["vectors"]).reshape(-1, g["dim"])
            levels = [np.frombuffer(x, np.int32) for x in g["levels"]]
            many, ids = np.frombuffer(g["many"], np.int64), np.frombuffer(g["ids"], np.int64)
            x = _unit(vectors)
            sizes = [len(many)] + [len(v) // LINKS for v in levels[1:]]
            made = Graph(x, [v.reshape(n, -1) for v, n in zip(levels, sizes, strict=True)])
            own, v = queries.column("id").combine_chunks().to_numpy(), _matrix(queries.column("v"), g["dim"])
            parts = [_answers(made, vectors, many, ids, own[i : i + _STEP], v[i : i + _STEP], top, width) for i in range(0, len(own), _STEP)]
            out = [np.concatenate(p) for p in zip(*parts, strict=True)]
        return pa.table([pa.array(c) for c in out], names=found.names)

    pairs = a.groupBy("dim", "shard", "block").cogroup(b.groupBy("dim", "shard", "block")).applyInArrow(ask, found)
    merged = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _answers(graph: Graph, vectors: np.ndarray, many: np.ndarray, ids: np.ndarray, own: np.ndarray, asked: np.ndarray, top: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the ``top`` of a shard for some queries; ``ids``: ``many[i]`` of entry i, one after the other."""
    near = graph.search(_unit(asked), 4 * top, width)
    row, place = np.nonzero(near >= 0)
    entry = near[row, place]
    score = _cosines(asked[row], vectors[entry])
    first = np.cumsum(many) - many
    each = np.repeat(np.arange(len(entry)), many[entry])
    nth = np.arange(len(each)) - np.repeat(np.cumsum(many[entry]) - many[entry], many[entry])
    row, score, other = row[each], score[each], ids[first[entry][each] + nth]
    kept = other != own[row]
    row, score, other = row[kept], score[kept], other[kept]
    order = np.lexsort((other, -score, row))
    row, score, other = row[order], score[order], other[order]
    best = np.arange(len(row)) - np.searchsorted(row, row, side="left") < top
    return own[row[best]], other[best], score[best]
