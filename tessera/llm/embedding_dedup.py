"""Near-duplicate vectors by product quantisation.

Vectors of one label lie in inverted lists around coarse centres. A vector probes every list that is
likely to hold a neighbour within the threshold: the distance to the plane between the two centres
decides. A difference of the threshold's length without a preferred direction goes DEVIATIONS times
its deviation towards a plane once in 30,000 links; in 16 dimensions or fewer no link can be lost. In a list, residual subspace codes give asymmetric table-lookup distances; with
the stored error of each code they bound the true distance, and what the bound leaves is ranked by
exact cosine in double precision. Equal vectors are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.session import settle, ship

THRESHOLD = 0.93
#: Sampled vectors that centres and codebooks are fitted on; mean list; members of a block.
FIT, LIST, BLOCK = 16_384, 512, 2048
PARTS, CODES, DEVIATIONS = 16, 64, 4
#: Length of the difference of unit vectors at the threshold, with room for rounding.
RADIUS = float(np.sqrt(2 - 2 * THRESHOLD)) + 1e-9


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of k clusters; deterministic in the order of x."""
    if k >= len(x):
        return x.copy()
    centres = x[np.random.default_rng(5).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """vec_id, label, dim, key and vec; the last three null for vectors that link with nothing."""
    for rows in batches:
        dims, keys, vecs = [], [], []
        for label, v in zip(rows["label"], rows["embedding"], strict=True):
            x = None if v is None or label != label or label is None else np.array([np.nan if e is None else e for e in v] if getattr(v, "dtype", object) == object else v, np.float64)
            if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                dims.append(None)
                keys.append(None)
                vecs.append(None)
                continue
            x = x + 0.0  # negative zero is zero
            dims.append(len(x))
            vecs.append(x.tobytes())
            keys.append(xxhash.xxh3_128_digest(f"{label}:".encode() + vecs[-1]))
        out = rows[["vec_id", "label"]].assign(dim=pd.array(dims, "Int32"), key=keys, vec=vecs)
        yield out


def unit(vecs: pd.Series) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float64) for v in vecs])
    x = x / np.abs(x).max(1, keepdims=True)  # before squaring: neither overflow nor underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Index:
    """Coarse centres per (label, dim) and one set of residual codebooks per dim."""

    def __init__(self, sample: pd.DataFrame, counts: dict[tuple, int]):
        self.centres: dict[tuple, np.ndarray] = {}
        self.books: dict[int, list[np.ndarray]] = {}
        residuals: dict[int, list[np.ndarray]] = {}
        for (label, dim), rows in sample.groupby(["label", "dim"]):
            x = unit(rows.sort_values("id")["vec"])
            lists = min(-(-counts.get((label, dim), 1) // LIST), max(1, len(x) // 8))
            if lists > 1:
                self.centres[label, dim] = kmeans(x, lists)
            c = self.of(label, dim)
            residuals.setdefault(dim, []).append(x - c[self.nearest(x, c)])
        for dim, rs in residuals.items():
            self.books[dim] = [kmeans(r, CODES) for r in np.array_split(np.concatenate(rs), min(PARTS, dim), axis=1)]

    def of(self, label, dim: int) -> np.ndarray:
        return self.centres.get((label, dim), np.zeros((1, dim)))

    @staticmethod
    def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)

    def codes(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and how far each lies from what its code says."""
        books = self.books.get(r.shape[1]) or [np.zeros((1, p.shape[1])) for p in np.array_split(r[:1], min(PARTS, r.shape[1]), axis=1)]
        out, off = np.zeros((len(r), len(books)), np.int64), np.zeros(len(r))
        for i, (part, book) in enumerate(zip(np.array_split(r, len(books), axis=1), books, strict=True)):
            out[:, i] = self.nearest(part, book)
            off += ((part - book[out[:, i]]) ** 2).sum(1)
        return out, np.sqrt(off)

    def tables(self, r: np.ndarray) -> list[np.ndarray]:
        """Squared distances of query residuals to every code of each subspace."""
        books = self.books.get(r.shape[1]) or [np.zeros((1, p.shape[1])) for p in np.array_split(r[:1], min(PARTS, r.shape[1]), axis=1)]
        return [((p**2).sum(1)[:, None] - 2 * p @ b.T + (b**2).sum(1)).astype(np.float32) for p, b in zip(np.array_split(r, len(books), axis=1), books, strict=True)]

    def probes(self, x: np.ndarray, label, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and a matrix of the lists from its own on that it must search."""
        c = self.of(label, dim)
        squares, places = (c**2).sum(1), np.arange(len(c))
        apart = np.sqrt(np.maximum(squares[:, None] + squares - 2 * c @ c.T, 0))
        own, must = np.zeros(len(x), np.int64), np.zeros((len(x), len(c)), bool)
        far = 2 * (RADIUS * min(1.0, DEVIATIONS / np.sqrt(dim)) + 1e-6)
        for a in range(0, len(x), 2048):
            d = squares - 2 * x[a : a + 2048] @ c.T  # less the vectors' own lengths
            mine = own[a : a + 2048] = d.argmin(1)
            plane = d - np.take_along_axis(d, mine[:, None], 1)
            must[a : a + 2048] = (plane <= far * apart[mine] + 1e-9) & (places >= mine[:, None])
        return own, must


def _route(index: Index, blocks: dict[tuple, int]):
    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for (label, dim), rows in whole.groupby(["label", "dim"]):
                x = unit(rows["vec"])
                own, must = index.probes(x, label, dim)
                mine = rows.assign(cell=own, own=own, member=True)
                n = np.array([blocks.get((label, dim, c), 1) for c in range(must.shape[1])])
                mine["block"] = rows["id"].map(lambda i: xxhash.xxh32_intdigest(str(i))).to_numpy() % n[own]
                yield mine
                q, c = np.nonzero(must)
                asks = rows.iloc[q].assign(cell=c, own=own[q], member=False)
                times = n[c]
                asks = asks.iloc[np.repeat(np.arange(len(asks)), times)]
                asks["block"] = np.concatenate([np.arange(t) for t in times]) if len(times) else 0
                yield asks

    return route


ROUTED = "id long, m long, label int, dim int, vec binary, cell int, own int, member boolean, block int"


def _search(index: Index):
    def search(key, rows: pd.DataFrame) -> pd.DataFrame:
        label, dim, cell, _ = key
        members, asks = rows[rows["member"]].sort_values("id"), rows[~rows["member"]].sort_values("id")
        if not len(members) or not len(asks):
            return pd.DataFrame({"id": [], "links": [], "least": []})
        y, x = unit(members["vec"]), unit(asks["vec"])
        c = index.of(label, dim)[cell]
        codes, off = index.codes(y - c)
        yid, xid, ym, xm = (t.to_numpy() for t in (members["id"], asks["id"], members["m"], asks["m"]))
        inner = asks["own"].to_numpy() == cell  # such pairs are met from both ends
        lx, ly = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        least_x, least_y, edges = xid.copy(), yid.copy(), []
        for a in range(0, len(x), 512):
            part = slice(a, a + 512)
            d = 0
            for i, t in enumerate(index.tables(x[part] - c)):
                d = d + t[:, codes[:, i]]
            q, p = np.nonzero(d <= (RADIUS + off.astype(np.float32) + 1e-3) ** 2)
            if not len(q):
                continue
            q = q + a
            hit = np.concatenate([(x[q[s : s + 65536]] * y[p[s : s + 65536]]).sum(1) for s in range(0, len(q), 65536)]) >= THRESHOLD
            q, p = q[hit], p[hit]
            apart = xid[q] != yid[p]
            q, p = q[apart], p[apart]
            np.add.at(lx, q, ym[p])
            cross = ~inner[q]
            np.add.at(ly, p[cross], xm[q[cross]])
            edges.append((q, p))
        if edges:  # least ids spread along links within the block
            q, p = (np.concatenate(e) for e in zip(*edges, strict=True))
            at = {i: n for n, i in enumerate(np.unique(np.concatenate((xid, yid))))}
            ids = np.array(list(at))
            u, v = np.searchsorted(ids, xid[q]), np.searchsorted(ids, yid[p])
            least = np.arange(len(ids))
            while True:
                new = least.copy()
                np.minimum.at(new, u, least[v])
                np.minimum.at(new, v, least[u])
                new = new[new]
                if (new == least).all():
                    break
                least = new
            least_x, least_y = ids[least[np.searchsorted(ids, xid)]], ids[least[np.searchsorted(ids, yid)]]
        out = pd.DataFrame({"id": np.concatenate((xid, yid)), "links": np.concatenate((lx, ly)), "least": np.concatenate((least_x, least_y))})
        return out[(out["links"] > 0) | (out["least"] != out["id"])]

    return search


def near_vectors(df: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Only vectors of one label and length are compared. Null labels, and vectors that are null,
    empty, zero or hold null or non-finite parts, link with nothing. Equal vectors link with each
    other; repeated rows count as rows. A null vec_id links with nothing, has no component and
    stays. Empty tables give no rows; other columns are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col("vec_id").cast("long"), F.col("label").cast("int").alias("label"), "embedding")
    vectors = settle(rows.mapInPandas(_vectors, "vec_id long, label int, dim int, key binary, vec binary"))
    good = vectors.where("key is not null and vec_id is not null")
    classes = settle(good.groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("m"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec")))
    # one row per label that fills more than one list reaches the driver, and a bounded sample
    per = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    counts = {(r["label"], r["dim"]): r["n"] for r in per.where(F.col("n") > LIST).collect()}
    n = classes.count()
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, FIT / max(n, 1)) * (1 << 30))
    sample = classes.where(draw).select("id", "label", "dim", "vec").toPandas()
    index = Index(sample, counts)
    plain = classes.select("id", "m", "label", "dim", "vec")
    cells = {}
    if counts:

        def cell(batches):
            for whole in batches:
                for (label, dim), part in whole.groupby(["label", "dim"]):
                    own, _ = index.probes(unit(part["vec"]), label, dim)
                    yield pd.DataFrame({"label": label, "dim": dim, "cell": own})

        sizes = plain.mapInPandas(cell, "label int, dim int, cell int").groupBy("label", "dim", "cell").count()
        cells = {(r[0], r[1], r[2]): -(-r[3] // BLOCK) for r in sizes.where(F.col("count") > BLOCK).collect()}
    routed = plain.mapInPandas(_route(index, cells), ROUTED)
    found = routed.groupBy("label", "dim", "cell", "block").applyInPandas(_search(index), "id long, links long, least long")
    found = settle(found)
    label = components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    info = classes.select("key", "id", "m").join(links, "id", "left").join(label, F.col("id") == F.col("node"), "left")
    info = settle(info.select("key", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "id").alias("component")))
    out = vectors.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(info, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), g AS (
  SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT a AS node, a AS reach FROM p UNION SELECT r.node, p.b FROM r JOIN p ON r.reach = p.a
), k AS (
  SELECT node, min(reach) AS component FROM r GROUP BY node
), n AS (
  SELECT a, count(*) AS n FROM p GROUP BY a
)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(k.component, v.vec_id) AS component_id,
       coalesce(k.component, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN k ON k.node = v.vec_id
"""
