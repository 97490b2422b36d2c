"""Most similar vectors by multiprobe p-stable hashing with exact reranking.

Unit vectors are hashed by h(v) = floor((a.v + b) / w) with normal a (2-stable). A table's bucket is the value of k such
functions. A query looks into its own bucket and into perturbed ones, in the order of their estimated success: a step of one
function costs the squared distance to the wall that it crosses. Candidates of all tables are merged and reranked by their
exact cosine.

A bucket belongs to a cell, the value of its first few functions. Vectors are shuffled by cell, not by bucket, because most
probes of a query share a cell, so a query is sent a few times a table instead of once a probe. Cells above a size limit are
parted into their buckets, and a bucket above it becomes a grid of blocks, each of which pairs a share of its vectors with a
share of its queries. Equal vectors form a class that is hashed once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.shingles import distinct, mix
from quarrylens.session import staged

CELL_ROWS = 60_000  # vectors that a task holds at once, about
SEND_COST = 4000  # sending a vector to a table costs as much as so many comparisons
SAMPLE = 2000  # vectors that the hashing is fitted on, at most
MOST_PENDING = 4_000_000  # pairs that a task gathers before it drops the lesser ones
MOST_CELLS = 1_000_000  # large cells that are listed for all tasks, at most


@dataclass(frozen=True)
class Hashing:
    dim: int
    tables: int = 4
    functions: int = 10
    probes: int = 12
    width: float = 2.0
    cell_functions: int = 4
    seed: int = 7

    def draw(self):
        r = np.random.default_rng(self.seed)
        n = self.tables * self.functions
        a = r.standard_normal((self.dim, n)).astype(np.float32)
        b = r.uniform(0, self.width, n).astype(np.float32)
        odd = r.integers(1, 2**62, (3, n), dtype=np.int64) | 1
        return a, b, odd[0], odd[1]

    def family(self) -> list[tuple[int, ...]]:
        """Perturbation sets over the walls by rank (0 the nearest of the 2 x functions), in the order of the squared distances that
        are expected for these ranks; four times as many as are probed, of which each query takes its best. A heap gives them: a
        set is followed by the one with its last rank moved on, and by the one with the next rank added. A set with both walls
        of one function crosses nothing and is passed over."""
        f, most = self.functions, 4 * self.probes
        j = np.arange(1, 2 * f + 1, dtype=float)
        r = 2 * f + 1 - j
        far = (f + 1.0) * (f + 2) * 4
        cost = np.where(j <= f, j * (j + 1) / far, 1 - r / (f + 1) + r * (r + 1) / far)
        out: list[tuple[int, ...]] = [()]
        heap = [(cost[0], (0,))] if self.probes > 1 else []
        while heap and len(out) < most:
            c, s = heapq.heappop(heap)
            if all(2 * f - 1 - x not in s for x in s):
                out.append(s)
            last = s[-1]
            if last + 1 < 2 * f:
                heapq.heappush(heap, (c - cost[last] + cost[last + 1], (*s[:-1], last + 1)))
                heapq.heappush(heap, (c + cost[last + 1], (*s, last + 1)))
        return out


def hash_batch(x: np.ndarray, h: Hashing):
    """For each table: home bucket, home cell, probed buckets and cells (n x probes), by estimated success."""
    a, b, kb, kc = h.draw()
    y = (x @ a + b) / np.float32(h.width)
    whole = np.floor(y)
    frac, whole = y - whole, whole.astype(np.int64)
    fam, walls = h.family(), 2 * h.functions
    member = np.zeros((len(fam), walls), np.float32)
    ranks = np.full((len(fam), max(1, max(map(len, fam)))), walls)  # the rank after the last is no step
    for i, s in enumerate(fam):
        member[i, list(s)] = 1
        ranks[i, : len(s)] = s
    m, none = min(h.probes, len(fam)), np.zeros((len(x), 1), np.int64)
    out = []
    with np.errstate(over="ignore"):
        for t in range(h.tables):
            s = slice(t * h.functions, (t + 1) * h.functions)
            kbt, kct = kb[s], np.where(np.arange(h.functions) < h.cell_functions, kc[s], 0)
            bucket, cell = (whole[:, s] * kbt).sum(1), (whole[:, s] * kct).sum(1) + t
            if m == 1:
                out.append((bucket, cell, bucket[:, None], cell[:, None]))
                continue
            score = np.concatenate([frac[:, s] ** 2, (1 - frac[:, s]) ** 2], 1)
            order = np.argsort(score, 1)
            total = np.take_along_axis(score, order, 1) @ member.T
            pick = np.argpartition(total, m - 1, 1)[:, :m] if m < len(fam) else np.tile(np.arange(len(fam)), (len(x), 1))
            pick = np.take_along_axis(pick, np.argsort(np.take_along_axis(total, pick, 1), 1), 1)
            probes = []
            for home, keys in ((bucket, kbt), (cell, kct)):
                step = np.concatenate([np.concatenate([-keys, keys])[order], none], 1)
                probed = np.repeat(home[:, None], m, 1)
                for w in range(ranks.shape[1]):
                    probed += np.take_along_axis(step, ranks[pick, w], 1)
                probes.append(probed)
            out.append((bucket, cell, *probes))
    return out


def fit(sample: np.ndarray, n: int, min_cosine: float, recall: float = 0.97, cell_rows: int = CELL_ROWS, seed: int = 7, max_probes: int = 64, mutual: bool = True, query_share: float = 1.0) -> Hashing:
    """Choose the parameters from a bounded sample of unit vectors (at most SAMPLE are looked at) and the number n of all.

    For buckets of about 60 to 4,000 unrelated vectors, and numbers of probes that double, the tables are counted that reach
    the recall for a pair at min_cosine, by simulation. Of these settings the cheapest is taken: a table costs sending every
    vector once, and comparing what a query finds in it. cell_functions: so many that a cell holds about cell_rows.
    """
    r = np.random.default_rng(seed)
    s = sample[:SAMPLE].astype(np.float64)
    dim = s.shape[1] if s.ndim == 2 else 1
    if len(s) < 2 or n < 120:
        return Hashing(dim, tables=1, functions=1, probes=3, width=8.0, cell_functions=0, seed=seed)
    width = 2.0
    p = float(np.clip(_same_slot(s, width, r), 0.02, 0.95))
    m = 1500  # pairs at min_cosine in random directions
    x, o = r.standard_normal((2, m, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    o -= (o * x).sum(1)[:, None] * x
    o /= np.maximum(np.linalg.norm(o, axis=1)[:, None], 1e-12)
    y = min_cosine * x + (1 - min_cosine**2) ** 0.5 * o
    s32 = s.astype(np.float32)
    best = None
    for rows in (60, 250, 1000, 4000):
        functions = int(np.clip(np.ceil(np.log(max(n / rows, 2)) / np.log(1 / p)), 2, 24))
        cells = int(np.clip(np.ceil(np.log(max(1, n / cell_rows)) / np.log(1 / p)), 0, functions))
        probes = 4
        while probes <= max_probes:
            h = Hashing(dim, 1, functions, probes, width, cells, seed)
            (hx, _, px, cx), (hy, _, py, _) = hash_batch(x.astype(np.float32), h)[0], hash_batch(y.astype(np.float32), h)[0]
            hit = float(np.mean((px == hy[:, None]).any(1) | (mutual & (py == hx[:, None]).any(1))))
            tables = int(np.ceil(np.log(1 - recall) / np.log(1 - min(max(hit, 1e-3), 0.999))))
            sent = 1 + query_share * float(np.mean([len(set(c)) for c in cx[:200].tolist()]) - 1)
            homes, _, own, _ = hash_batch(s32, h)[0]
            met = n * float(np.mean([np.isin(homes, q).mean() for q in own[:100]]))
            cost = tables * (SEND_COST * sent + query_share * met)
            if best is None or cost < best[0]:
                best = (cost, replace(h, tables=tables))
            probes *= 2
    return best[1]


def _same_slot(s: np.ndarray, width: float, r: np.random.Generator) -> float:
    """How often a function puts two vectors of the sample into one slot: a place in the slot, moved by a normal step."""
    i, j = r.integers(0, len(s), (2, 4000))
    d = np.linalg.norm(s[i] - s[j], axis=1)
    d = d[d > 0.3] if (d > 0.3).any() else np.array([1.4])
    place, step = r.uniform(0, 1, (64, len(d))), r.standard_normal((64, len(d))) * d / width
    return float(np.mean(np.abs(place + step - 0.5) < 0.5))


def usual_reach(sample: np.ndarray, n: int, k: int, share: float = 0.3) -> float:
    """A cosine that the k-th neighbour of all but a share of the vectors reaches, by the sample's own neighbours at the rank that
    k of n has there (its first, where that is less than one: then the estimate is low, and the hashing more careful)."""
    s = sample[:SAMPLE]
    if len(s) < 3:
        return 0.5
    c = s @ s.T
    np.fill_diagonal(c, -1)
    r = int(np.clip(round(k * len(s) / max(n, 1)), 1, len(s) - 1))
    return float(np.clip(np.quantile(np.sort(c, 1)[:, -r], share), 0.1, 0.95))


def _usable(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the usable vectors, these as a matrix): dim values, none null or not finite, not all zero."""
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(col), dim), False).to_numpy(zero_copy_only=False))
    x = col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)  # null becomes NaN
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[ok], x[ok] + np.float32(0)  # without negative zeros


def _nodes(x: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(v.tobytes()) for v in x], np.uint64).view(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def vector_rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v of the rows with an id and a vector."""
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")


def with_node(rows: DataFrame, dim: int, *keep: str) -> DataFrame:
    """The named columns of the usable rows, and node, a hash of their vector."""
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep) + ", node bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _usable(b.column(0), dim)
            i = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k + 1).take(i) for k in range(len(keep))), pa.array(_nodes(x), pa.int64())], [*keep, "node"])

    return rows.select(F.col("v").alias("vec"), *keep).mapInArrow(run, schema)


def members_of(rows: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(members, rows): id and node of every usable id, and the rows to index. Of several vectors under one id the one with the
    greatest hash counts; only where there are such ids, the rows are joined with their members, else vectors stay where they
    are read."""
    m = staged(with_node(rows, dim, "id").groupBy("id").agg(F.max("node").alias("node"), F.min("node").alias("least")), "knn-members")
    members = m.select("id", "node")
    if not m.filter("least <> node").isEmpty():
        rows = staged(with_node(rows, dim, "id", "v").join(members, ["id", "node"], "left_semi").select("id", "v"), "knn-rows")
    return members, rows


def least_ids(members: DataFrame, k: int) -> DataFrame:
    """node, ids: the k + 1 least ids of each distinct vector."""
    order = Window.partitionBy("node").orderBy("id")
    least = members.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    return least.groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _as_cell(bucket: np.ndarray) -> np.ndarray:
    """A cell for one bucket alone, used where a cell is too large."""
    return mix(bucket.view(np.uint64) + np.uint64(11)).view(np.int64)


def _to_wire(x: np.ndarray) -> tuple[bool, bytes]:
    """Vectors that are stored with three decimals as int16, if nothing is lost; their bytes by place, compressed."""
    q = np.rint(x.astype(np.float64) * 1000)
    thin = bool(len(x)) and np.abs(q).max() < 2**15 and np.array_equal((q / 1000).astype(np.float32), x)
    v = q.astype(np.int16) if thin else np.ascontiguousarray(x, np.float32)
    planes = v.view(np.uint8).reshape(-1, v.itemsize).T
    return thin, pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _from_wire(thin: bool, data: bytes, size: int) -> np.ndarray:
    width = 2 if thin else 4
    raw = np.frombuffer(pa.decompress(data, decompressed_size=size * width, codec="zstd", asbytes=True), np.uint8).reshape(width, -1)
    v = np.ascontiguousarray(raw.T)
    return (v.view(np.int16).ravel() / 1000).astype(np.float32) if thin else v.view(np.float32).ravel()


def _batches(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """node, vectors, whether it asks; copies in one task come once (again where only a later one asks)."""
    seen: set[int] = set()
    asked: set[int] = set()
    for b in batches:
        at, x = _usable(b.column(0), dim)
        asks = b.column(1).to_numpy(zero_copy_only=False).astype(bool)[at]
        node, keep = _nodes(x), []
        for i, (v, q) in enumerate(zip(node.tolist(), asks.tolist())):
            if v not in seen or (q and v not in asked):
                keep.append(i)
                seen.add(v)
                if q:
                    asked.add(v)
        if keep:
            yield node[keep], x[keep], asks[keep]


def _short(bucket: np.ndarray) -> np.ndarray:
    """16 bits of a bucket, enough within a cell: buckets that fall together cost comparisons, never a neighbour."""
    return (mix(bucket.view(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def _send(rows: DataFrame, h: Hashing, blocks) -> DataFrame:
    """Blobs by (cell, block): vectors, their home buckets, and the buckets that queries probe. Needs v, is_query."""
    dim = h.dim
    fields = ["cell bigint", "block int", "node binary", "thin boolean", "vec binary", "ic binary", "ib binary", "qc binary", "qb binary"]
    names = [f.split()[0] for f in fields]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.bool_(), *[pa.binary()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, dense = blocks.value
        for node, raw, asks in _batches(batches, dim):
            for bucket, cell, pb, pc_ in hash_batch(_unit(raw).astype(np.float32), h):
                out, n = [], len(node)
                who = np.repeat(np.flatnonzero(asks), pb.shape[1])
                kind = np.concatenate([np.zeros(n, np.int8), np.ones(len(who), np.int8)])
                i = np.concatenate([np.arange(n), who])
                bk, c = np.concatenate([bucket, pb[asks].ravel()]), np.concatenate([cell, pc_[asks].ravel()])
                if len(wide):
                    c = np.where(np.isin(c, wide), _as_cell(bk), c)
                block = np.zeros(len(c), np.int64)
                if len(dense):  # a dense bucket is a grid: index rows take a row of blocks, queries a column
                    at = np.minimum(np.searchsorted(dense[:, 0], c), len(dense) - 1)
                    side = np.where(dense[at, 0] == c, dense[at, 1], 1)
                    own = (mix(node[i].view(np.uint64) + kind.astype(np.uint64)) % side.astype(np.uint64)).astype(np.int64)
                    kind, i, bk, c, own, n_side = (np.repeat(z, side) for z in (kind, i, bk, c, own, side))
                    other = np.arange(len(c)) - np.repeat(np.cumsum(side) - side, side)
                    block = np.where(kind == 0, own * n_side + other, other * n_side + own)
                o = np.lexsort((i, kind, block, c))
                kind, i, bk, c, block = kind[o], i[o], _short(bk[o]), c[o], block[o]
                cut = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (block[1:] != block[:-1])]))
                for lo, hi in zip(cut, [*cut[1:], len(c)]):
                    used, inv = np.unique(i[lo:hi], return_inverse=True)
                    z = int((kind[lo:hi] == 0).sum())
                    ic, qc = (np.bincount(x, minlength=len(used)).astype(np.uint16).tobytes() for x in (inv[:z], inv[z:]))
                    out.append((int(c[lo]), int(block[lo]), node[used].tobytes(), *_to_wire(raw[used]), ic, bk[lo : lo + z].tobytes(), qc, bk[lo + z : hi].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    return rows.select("v", "is_query").mapInArrow(run, ", ".join(fields))


def _best(code: np.ndarray, s: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (query x n + neighbour) with their similarity in single precision those that may be among a query's k best, once
    each."""
    o = np.argsort(code, kind="stable")
    code, s = code[o], s[o]
    new = np.concatenate([[True], code[1:] != code[:-1]]) if len(code) else np.zeros(0, bool)
    code, s = code[new], s[new]
    q = code // n
    o = np.lexsort((-s, q))
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(q)]]))
    kth = s[o][first + np.minimum(size, k) - 1]
    keep = s >= np.repeat(kth, size) - np.float32(1e-5)
    return code[keep], s[keep]


def _rerank(f: pd.DataFrame, dim: int, k: int, least: float, chunk: int = 2048) -> pd.DataFrame:
    """The k nearest of each query in one cell block, among the members of the buckets it probes there."""
    cat = lambda c, d: np.concatenate([np.zeros(0, d), *[np.frombuffer(x, d) for x in f[c]]])
    node, first, inv = np.unique(cat("node", np.int64), return_index=True, return_inverse=True)
    raw = np.concatenate([np.zeros(0, np.float32), *[_from_wire(w, v, len(n) // 8 * dim) for w, v, n in zip(f["thin"], f["vec"], f["node"])]]).reshape(-1, dim)[first]
    norm = np.concatenate([np.zeros(0), *[np.linalg.norm(raw[a : a + 8192].astype(np.float64), axis=1) for a in range(0, len(raw), 8192)]])
    x32 = (raw / norm[:, None]).astype(np.float32)

    def side(counts: str, keys: str) -> tuple[np.ndarray, np.ndarray]:
        d, kk = np.repeat(inv, cat(counts, np.uint16)), cat(keys, np.uint16)
        both = distinct(kk.astype(np.int64) * max(len(node), 1) + d)
        return both % max(len(node), 1), both // max(len(node), 1)

    (ii, ib), (qi, qb) = side("ic", "ib"), side("qc", "qb")
    start = np.flatnonzero(np.concatenate([[True], ib[1:] != ib[:-1]])) if len(ib) else np.zeros(0, np.int64)
    stop = np.concatenate([start[1:], [len(ib)]])[: len(start)]
    ql, qh = np.searchsorted(qb, ib[start], "left"), np.searchsorted(qb, ib[start], "right")
    n = max(len(node), 1)
    found, pending = [(np.zeros(0, np.int64), np.zeros(0, np.float32))], 0
    for a, z, lo, hi in zip(start, stop, ql, qh):
        m = ii[a:z]
        for c in range(lo, hi, chunk):
            q = qi[c : min(hi, c + chunk)]
            for e in range(0, len(m), 4 * chunk):
                mm = m[e : e + 4 * chunk]
                s = x32[q] @ x32[mm].T
                hit = np.flatnonzero(s.ravel() >= np.float32(least - 1e-4))
                if not len(hit):
                    continue
                r, g = hit // len(mm), hit % len(mm)
                n_hits = np.bincount(r, minlength=len(q))
                if n_hits.max() > k + 1:  # only the k best, and the query itself, which may be among them
                    many = np.flatnonzero(n_hits > k + 1)
                    floor = np.full(len(q), -2.0, np.float32)
                    floor[many] = np.partition(s[many], len(mm) - k - 1, 1)[:, len(mm) - k - 1] - np.float32(1e-5)
                    best = s[r, g] >= floor[r]
                    r, g = r[best], g[best]
                one, other = q[r], mm[g]
                fit_ = one != other
                found.append(((one * n + other)[fit_], s[r, g][fit_]))
                pending += len(found[-1][0])
                if pending > MOST_PENDING:  # what can't be among the best is dropped from time to time, which bounds the memory
                    found, pending = [_best(*(np.concatenate(x) for x in zip(*found)), n, k)], 0
    pairs, _ = _best(*(np.concatenate(x) for x in zip(*found)), n, k)
    pairs = np.stack([pairs // n, pairs % n], 1)
    cos = [np.zeros(0)]
    for e in range(0, len(pairs), 50_000):
        p = pairs[e : e + 50_000]
        u, v = raw[p[:, 0]].astype(np.float64), raw[p[:, 1]].astype(np.float64)
        cos.append(np.einsum("nd,nd->n", u, v) / (norm[p[:, 0]] * norm[p[:, 1]]))
    cos = np.concatenate(cos)
    ok = cos >= least
    pairs, cos = pairs[ok], cos[ok]
    o = np.lexsort((-cos, pairs[:, 0]))  # keep k for each query, and what ties with the last of them
    pairs, cos = pairs[o], cos[o]
    lo, end = (np.searchsorted(pairs[:, 0], pairs[:, 0], x) for x in ("left", "right"))
    top = cos >= cos[np.minimum(lo + k - 1, end - 1)] - 1e-12 if len(cos) else np.zeros(0, bool)
    return pd.DataFrame({"q": node[pairs[top, 0]], "n": node[pairs[top, 1]], "cos": cos[top]})


def nearest_classes(rows: DataFrame, h: Hashing, k: int, least: float = -1.0, mutual: bool = True, cell_rows: int = CELL_ROWS) -> DataFrame:
    """q, n, cos: for each distinct vector that asks (rows: v, is_query) the candidates among which its k nearest are. mutual: a
    pair found from either side serves both (right where every vector asks).

    Cells above 2 x cell_rows vectors are listed for all tasks: 16 bytes for that many vectors. Were there more than MOST_CELLS
    of them (beyond 10^11 vectors), only the largest are parted.
    """
    spark, dim = rows.sparkSession, h.dim

    def counted(wide: np.ndarray | None):
        """Rows by cell; or, given the large cells, by each of their buckets."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, x, _ in _batches(batches, dim):
                homes = hash_batch(_unit(x).astype(np.float32), replace(h, probes=1))
                c = [cell if wide is None else _as_cell(bucket[np.isin(cell, wide)]) for bucket, cell, *_ in homes]
                c, n = np.unique(np.concatenate(c), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64())], ["cell", "n"])

        return rows.select("v", F.lit(False).alias("is_query")).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))

    sizes = staged(counted(None), "knn-cells")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(2 * cell_rows, total // MOST_CELLS)
    wide = np.array(sorted(r.cell for r in sizes.filter(F.col("n") > limit).collect()), np.int64)
    dense = np.zeros((0, 2), np.int64)
    if len(wide):
        dense = np.array(sorted((r.cell, -(-r.n // limit)) for r in counted(wide).filter(F.col("n") > limit).collect()), np.int64).reshape(-1, 2)
    sent = _send(rows, h, spark.sparkContext.broadcast((wide, dense)))
    pairs = sent.groupBy("cell", "block").applyInPandas(lambda f: _rerank(f, dim, k, least), "q bigint, n bigint, cos double")
    if mutual:
        pairs = pairs.select(F.explode(F.array(F.struct("q", "n", "cos"), F.struct(F.col("n").alias("q"), F.col("q").alias("n"), "cos"))).alias("p")).select("p.*")
    return pairs.groupBy("q", "n").agg(F.max("cos").alias("cos"))


def _sample(rows: DataFrame, n: int, dim: int) -> np.ndarray:
    """At most SAMPLE unit vectors: those whose ids hash least."""
    space = 1 << 40
    h = F.expr(f"pmod(xxhash64(id), {space}L)")
    few = rows.withColumn("h", h).filter(F.col("h") < min(space, 2 * SAMPLE * space // max(n, 1))).groupBy("id", "h").agg(F.max("v").alias("v"))
    got = sorted(few.collect(), key=lambda r: (r.h, r.id))
    _, x = _usable(pa.array([r.v for r in got], pa.list_(pa.float32())), dim)
    return _unit(x[:SAMPLE])


def most_similar(
    df: DataFrame, id_col: str = "id", vec_col: str = "openai_embedding", dim: int = 128, k: int = 10, min_cosine: float | None = None, query_filter=None, hashing: Hashing | None = None, recall: float = 0.97
) -> DataFrame:
    """id, other, cosine, rank: for each usable vector its k most similar others (ties: the lesser id), found by hashing.

    Usable: dim values, none null or not finite, not all zero. Rows with a null id are left out; of several vectors under one id
    the one with the greatest hash counts.
    min_cosine: only neighbours at least so similar are wanted, and the hashing is fitted for them; else for the k-th neighbour
    of most vectors. query_filter: a condition on the column id that limits the queries, never the indexed rows.
    Copies of a vector are ranked like any other row, with cosine 1; a class of copies of any size gives each of its members
    k rows. The hashing is fitted on at most SAMPLE vectors; every row is indexed.
    """
    cell_rows = CELL_ROWS if min_cosine is not None else CELL_ROWS // 4  # without a threshold more is compared, so in smaller shares
    members, rows = members_of(vector_rows(df, id_col, vec_col), dim)
    asks = members.filter(query_filter) if query_filter is not None else members
    rows = rows.withColumn("is_query", F.lit(True) if query_filter is None else F.coalesce(query_filter, F.lit(False)))
    ids = staged(least_ids(members, k), "knn-ids")
    n, n_ids = ids.count(), members.count()
    if hashing is None:
        s = _sample(rows, n_ids, dim)
        hashing = fit(s, n, usual_reach(s, n, k) if min_cosine is None else min_cosine, recall, cell_rows, max_probes=64 if min_cosine is not None else 256, mutual=query_filter is None, query_share=min(1.0, asks.count() / max(n, 1)))
    near = nearest_classes(rows, hashing, k, -1.0 if min_cosine is None else min_cosine, mutual=query_filter is None, cell_rows=cell_rows)
    lead = ids.select(F.col("node").alias("n"), "ids")
    order = Window.partitionBy("q").orderBy(F.desc("cos"), F.col("ids")[0])
    near = near.join(lead, "n").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select(F.col("q").alias("node"), "ids", "cos")
    own = ids.filter("size(ids) > 1").select("node", "ids", F.lit(1.0).alias("cos"))
    lists = near.unionByName(own).groupBy("node").agg(F.collect_list(F.struct("cos", "ids")).alias("l"))  # at most k + 1 lists of k + 1 ids
    each = asks.join(lists, "node").select("id", F.explode("l").alias("l")).select("id", "l.cos", F.explode("l.ids").alias("other")).filter("id <> other")
    top = Window.partitionBy("id").orderBy(F.desc("cos"), "other")
    return each.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k).select("id", "other", F.col("cos").alias("cosine"), "rank")
