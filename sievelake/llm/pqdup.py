"""Near-duplicate embeddings: inverted lists, residual product codes, table-lookup distances, exact rerank.

Rows of one vector are one node, so copies cost nothing. Nodes are scaled to length 1. A bounded sample (``SAMPLE``
nodes of each dimension) trains cells by k-means, sub-cells of the residuals (shared by all cells; cell and sub-cell
make a list) and the codebooks of what remains, in ``PARTS`` subspaces. Every node is indexed: its list, its codes, its
quantisation error. Every node is also a query.

Two vectors of cosine at least ``COSINE`` lie within r = sqrt(2 - 2 COSINE). A cell c can hold a partner p of q only if
(d(q,c)^2 - d(q,c*)^2) / 2 |c - c*| <= (p - q) . u, with c* the cell of q and u the direction from c* to c, since p lies on
c's side of the bisector; sub-cells likewise within a cell. p - q is at most r along u, which is certain. But it is as long as
that only if partners differ along u, so what is probed is all that ``SURE`` standard deviations reach: r times the share that u has of
the residuals' spread, the greater of that measured near c* and of all residuals, and never more than r. Where vectors vary in few
directions (8 or fewer) that is the certain bound; where in all of 64 alike, a pair is missed at odds of about 1 in 700. Tests and README
give recall against brute force.

In a list, the asymmetric distance from the query to a code errs by at most the stored error; what may lie within r is reranked by
exact cosine. Of two lists only one asks the other (the next half of the lists, in a circle). Neighbouring lists make a
block of about ``PART_ROWS`` nodes, to which a query goes once; a longer list is cut into parts by hashes, and so are the queries of a
block, by their counted number, so that a hot list is many tasks. A task gives each of its nodes its number of links and one
edge of a spanning forest, never the pairs. Lists grow in number with the table, to (SAMPLE / 16)^2.

Nulls and edge cases: null, empty, zero-length and non-finite vectors have no links and are classes of their own, and so
are rows with a null id, whose vectors still count for others; each dimension is indexed by itself, one after another; identical vectors are linked; rows that
share an id are rows like others; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

COSINE, SAMPLE, LIST_ROWS, PARTS, CODES, PART_ROWS, ASK_ROWS, SURE = 0.95, 20_000, 256, 8, 64, 4_096, 16_384, 3.0
_CELL_SAMPLE = 16  # nodes of the sample for each cell, at least
_SLACK = 1e-4  # float32 rounding


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    g = np.random.default_rng(seed)
    k = min(k, len(x))
    centre = x[g.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centre)
        size = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            total = np.bincount(near, x[:, d], k)
            centre[:, d] = np.where(size > 0, total / np.maximum(size, 1), centre[:, d])
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centre**2).sum(1) / 2
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = (half - x[a : a + 4096] @ centre.T).argmin(1)
    return out


def _spread(ends: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Share of the residuals' spread that lies along the direction between each two ends."""
    out = np.zeros((len(ends), len(ends)))
    if not len(rest):
        return out
    p = ends.astype(np.float64) @ rest.T.astype(np.float64)
    gram = p @ p.T / max(float((rest.astype(np.float64) ** 2).sum()), 1e-30)
    own = np.diag(gram)
    far = ((ends[:, None].astype(np.float64) - ends[None]) ** 2).sum(2) if len(ends) <= 256 else _far(ends)
    return ((own[:, None] + own - 2 * gram).clip(0) / np.maximum(far, 1e-30)).clip(0, 1)


def _far(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.float64)
    s = (c**2).sum(1)
    return (s[:, None] + s - 2 * c @ c.T).clip(0)


@dataclass
class Index:
    cells: np.ndarray
    subs: np.ndarray
    books: np.ndarray  # (parts, codes, width)
    near: np.ndarray  # cell of each residual
    rest: np.ndarray  # residuals of the sample, after the sub-cell
    sure: float = SURE
    _reach: dict = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "_reach": {}}

    @property
    def lists(self) -> int:
        return len(self.cells) * len(self.subs)

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, sub-cell and residual of each vector."""
        cell = nearest(x, self.cells)
        rest = x - self.cells[cell]
        sub = nearest(rest, self.subs)
        return cell, sub, rest - self.subs[sub]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and quantisation error of each vector."""
        cell, sub, rest = self.split(x)
        rest = rest.reshape(len(x), len(self.books), -1)
        codes = np.stack([nearest(rest[:, p], b) for p, b in enumerate(self.books)], 1).astype(np.uint8)
        error = np.sqrt(sum(((rest[:, p] - b[codes[:, p]]) ** 2).sum(1) for p, b in enumerate(self.books)))
        return cell * len(self.subs) + sub, codes, error

    def _limits(self, ends: np.ndarray, cell: int, radius: float) -> np.ndarray:
        """How far 2 (p - q) . (c - c*) may go for partners between each two ends; near a cell, or everywhere (-1)."""
        key = len(ends), cell, ends is self.cells
        if key not in self._reach:
            if len(self._reach) > 64:
                self._reach.clear()
            share = _spread(ends, self.rest)
            if cell >= 0:
                share = np.maximum(share, _spread(ends, self.rest[self.near == cell]))
            self._reach[key] = 2 * radius * np.minimum(1, self.sure * np.sqrt(share)) * np.sqrt(_far(ends)) + _SLACK
        return self._reach[key]

    def _asks(self, x: np.ndarray, ends: np.ndarray, cells: np.ndarray, radius: float) -> np.ndarray:
        """Whether each query, near one of the cells, must look beyond its nearest end into each other one."""
        out = np.zeros((len(x), len(ends)), bool)
        c = ends.astype(np.float64)
        d = (c**2).sum(1) - 2 * x.astype(np.float64) @ c.T
        own = d.argmin(1)
        for cell in np.unique(cells):
            at = np.flatnonzero(cells == cell)
            limit = self._limits(ends, int(cell), radius)
            out[at] = d[at] - d[at, own[at]][:, None] <= limit[own[at]]
        return out

    def probes(self, x: np.ndarray, own: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) of all lists that each query, of list ``own``, has to ask: it may hold partners, and isn't the one that asks."""
        count = len(self.subs)
        query, cell = np.nonzero(self._asks(x, self.cells, own // count, radius))
        q, l = [], []
        for c in np.unique(cell):
            at = query[cell == c]
            i, sub = np.nonzero(self._asks(x[at] - self.cells[c], self.subs, np.full(len(at), c), radius))
            q.append(at[i])
            l.append(c * count + sub)
        q, l = np.concatenate(q), np.concatenate(l)
        step = (l - own[q]) % self.lists
        ok = (2 * step < self.lists) | (2 * step == self.lists) & (own[q] < l)
        order = np.lexsort((l[ok], q[ok]))
        return q[ok][order], l[ok][order]

    def distances(self, query: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances from the codes of a list (rows) to queries (columns), by table lookup."""
        rest = query - self.cells[list_ // len(self.subs)] - self.subs[list_ % len(self.subs)]
        rest = rest.reshape(len(query), len(self.books), -1)
        total = np.zeros((len(codes), len(query)), np.float32)
        for p, b in enumerate(self.books):
            r = rest[:, p]
            table = (b**2).sum(1)[:, None] - 2 * b @ r.T + (r**2).sum(1)
            total += table[codes[:, p]]
        return np.sqrt(total.clip(0))


def _vectors(column, dim: int) -> np.ndarray:
    """Rows of a list column as an array of unit vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def train(rows: DataFrame, n: int, dim: int, sample: int, list_rows: int, sure: float = SURE) -> Index:
    x = _vectors(rows.orderBy(F.xxhash64("v"), "i").limit(sample).select("v").toArrow()["v"], dim)  # a bounded sample
    lists, most = max(1, -(-n // list_rows)), max(1, len(x) // _CELL_SAMPLE)
    cells = kmeans(x, min(most, math.ceil(math.sqrt(lists))))
    near = nearest(x, cells)
    rest = x - cells[near]
    subs = kmeans(rest, min(most, -(-lists // len(cells))))
    rest = rest - subs[nearest(rest, subs)]
    parts = next(p for p in (PARTS, 4, 2, 1) if dim % p == 0)
    cut = rest.reshape(len(x), parts, -1)
    return Index(cells, subs, np.stack([kmeans(cut[:, p], CODES) for p in range(parts)]), near, rest, sure)


def _links(nodes: DataFrame, n: int, dim: int, vkind: str, cosine: float, sample: int, list_rows: int, part_rows: int, ask_rows: int, sure: float) -> DataFrame:
    """(i, r, links): nodes (i, v, n) of one dimension that have links in a task, a node they are linked to (or themselves), and how many rows."""
    spark = nodes.sparkSession
    index = spark.sparkContext.broadcast(train(nodes, n, dim, sample, list_rows, sure))  # bounded by the sample
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))

    def encode(batches):
        for batch in batches:
            near, codes, error = index.value.encode(_vectors(batch.column("v"), dim))
            flat = pa.array(codes.ravel())
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, flat.buffers()[1]]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *batch.columns, codes, pa.array(error.astype(np.float32))], ["l", "i", "v", "n", "c", "e"])

    coded = C.save(nodes.mapInArrow(encode, f"l int, i long, v {vkind}, n long, c binary, e float"))
    sizes = np.zeros(index.value.lists, np.int64)  # as many as lists, which the sample bounds
    got = coded.groupBy("l").agg(F.count("*").alias("n")).toArrow()
    sizes[got["l"].to_numpy()] = got["n"].to_numpy()
    first, parts, room = [], [], 0
    for l, size in enumerate(sizes.tolist()):
        if not first or size > room:
            first.append(l)
            parts.append(max(1, -(-size // part_rows)))
            room = part_rows
        room -= size
    block_of = np.repeat(np.arange(len(first)), np.diff([*first, len(sizes)])).astype(np.int32)
    block = spark.sparkContext.broadcast(block_of)

    def probed(batch):
        """Per query and block: where, and its lists."""
        q, l = index.value.probes(_vectors(batch.column("v"), dim), batch.column("l").to_numpy().astype(np.int64), radius)
        g = block.value[l]
        begin = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (g[1:] != g[:-1]))) if len(q) else np.zeros(0, np.int64)
        return q[begin], g[begin], np.append(begin, len(q)), l

    def ask(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                at, g, edge, l = probed(part)
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(l.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(g), *(part.column(x).take(pa.array(at)) for x in ("l", "i", "v", "n")), lists], ["g", "l", "i", "v", "n", "ls"])

    def tell(batches):
        total = np.zeros(len(first), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                total += np.bincount(probed(batch.slice(a, 1024))[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["g", "n"])

    asked_by = np.zeros(len(first), np.int64)
    got = coded.select("l", "v").mapInArrow(tell, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    asked_by[got["g"].to_numpy()] = got["n"].to_numpy()
    asking = np.maximum(1, -(-asked_by // ask_rows))
    table = pd.DataFrame({"l": np.arange(len(sizes), dtype=np.int32), "g": block_of, "parts": np.array(parts, np.int32)[block_of], "asking": asking[block_of].astype(np.int32)})
    lists = F.broadcast(spark.createDataFrame(table, "l int, g int, parts int, asking int"))  # a row for each list
    blocks = F.broadcast(spark.createDataFrame(table.drop_duplicates("g").drop(columns="l"), "g int, parts int, asking int"))
    part = lambda of: F.pmod(F.xxhash64("i"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    members = coded.join(lists, "l").select("g", "l", "i", "v", "n", "c", "e", part("parts").alias("s"), every("asking").alias("u"))
    asked = coded.select("l", "i", "v", "n").mapInArrow(ask, f"g int, l int, i long, v {vkind}, n long, ls array<int>")
    asked = asked.join(blocks, "g").select("g", "l", "i", "v", "n", "ls", every("parts").alias("s"), part("asking").alias("u"))

    def match(q: pa.Table, m: pa.Table) -> pa.Table:
        names = ["i", "r", "links"]
        if not len(q) or not len(m):
            return pa.table([pa.array([], pa.int64())] * 3, names)
        m = m.sort_by("l")
        ml, mi, mn = (m[c].to_numpy() for c in ("l", "i", "n"))
        ql, qi, qn = (q[c].to_numpy() for c in ("l", "i", "n"))
        x, y = _vectors(q["v"], dim), _vectors(m["v"], dim)
        codes = np.frombuffer(b"".join(m["c"].to_pylist()), np.uint8).reshape(len(mi), -1)
        within = radius + m["e"].to_numpy() + _SLACK
        asks = q["ls"].combine_chunks()
        ask, al = np.repeat(np.arange(len(qi)), asks.value_lengths().to_numpy()), asks.flatten().to_numpy()
        order = np.argsort(al, kind="stable")
        ask, al = ask[order], al[order]
        nodes, place = np.unique(np.concatenate([qi, mi]), return_inverse=True)
        pq, pm = place[: len(qi)], place[len(qi) :]
        forest, links = C.Forest(len(nodes)), np.zeros(len(nodes), np.int64)
        for list_ in np.unique(ml):
            of = ask[np.searchsorted(al, list_) : np.searchsorted(al, list_, "right")]
            b, end = np.searchsorted(ml, list_), np.searchsorted(ml, list_, "right")
            for s in range(0, len(of), 2048):
                some = of[s : s + 2048]
                for a in range(b, end, 512):
                    e = min(a + 512, end)
                    j, k = np.nonzero(index.value.distances(x[some], int(list_), codes[a:e]) <= within[a:e, None])
                    j, k = j + a, some[k]
                    ok = np.where(ql[k] == list_, qi[k] < mi[j], True)  # in one list both ends ask
                    j, k = j[ok], k[ok]
                    for t in range(0, len(j), 65_536):
                        jj, kk = j[t : t + 65_536], k[t : t + 65_536]
                        ok = np.einsum("ij,ij->i", x[kk].astype(np.float64), y[jj].astype(np.float64)) >= cosine
                        u, v = pq[kk[ok]], pm[jj[ok]]
                        links += np.bincount(u, mn[jj[ok]], len(nodes)).astype(np.int64) + np.bincount(v, qn[kk[ok]], len(nodes)).astype(np.int64)
                        forest.join(u, v)
        at = np.flatnonzero(links)
        return pa.table([pa.array(nodes[at]), pa.array(nodes[forest.parent[at]]), pa.array(links[at])], names)

    found = C.save(asked.groupBy("g", "s", "u").cogroup(members.groupBy("g", "s", "u")).applyInArrow(match, "i long, r long, links long"))
    C.discard(coded)
    return found


def similar(table: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, sample: int = SAMPLE, list_rows: int = LIST_ROWS, part_rows: int = PART_ROWS, ask_rows: int = ASK_ROWS, sure: float = SURE) -> DataFrame:
    """(vec_id, class_id, links) of each row: the least id of the rows it is linked to through others, and how many other rows are within the cosine."""
    kind, vkind = table.schema[key].dataType.simpleString(), table.schema[vector].dataType.simpleString()
    v = F.col("v")
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    good = v.isNotNull() & (F.size("v") > 0) & norm.isNotNull() & (norm > 0) & (norm < float("inf"))
    hashes = F.when(good, F.xxhash64("v")), F.when(good, F.xxhash64(F.lit(1), v))
    rows = table.select(F.col(key).alias("k"), F.col(vector).alias("v")).withColumns({"h": hashes[0], "h2": hashes[1]})
    nodes = rows.where("h is not null").groupBy("h", "h2").agg(F.first("v").alias("v"), F.min("k").alias("k"), F.count("*").alias("n"))
    nodes = C.save(nodes.withColumn("i", F.monotonically_increasing_id()))
    # a row for each dimension
    dims = nodes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where("n > 1").orderBy("d").collect()
    parts = [_links(nodes.where(F.size("v") == r.d).select("i", "v", "n"), r.n, r.d, vkind, cosine, sample, list_rows, part_rows, ask_rows, sure) for r in dims]
    spark = table.sparkSession
    found = parts[0] if parts else spark.createDataFrame([], "i long, r long, links long")
    for more in parts[1:]:
        found = found.union(more)
    label = C.components(found.where("i <> r").select(F.col("i").alias("a"), F.col("r").alias("b")))
    links = found.groupBy("i").agg(F.sum("links").alias("links"))
    named = nodes.drop("v").join(links, "i", "left").join(label.select(F.col("node").alias("i"), F.col("component").alias("c")), "i", "left")
    named = C.save(named.withColumn("c", F.coalesce("c", "i")))
    least = named.groupBy("c").agg(F.min("k").alias("class_id"))
    fate = named.join(least, "c").select("h", "h2", "class_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    fate = C.save(fate)
    C.discard(nodes, named, label, *parts)
    out = rows.drop("v").join(C.small(fate, 40), ["h", "h2"], "left")
    own = F.col("k").isNull() | F.col("class_id").isNull()
    return out.select(F.col("k").alias(key), F.when(own, F.col("k")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
