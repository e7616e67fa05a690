"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with equal shingle sets collapse to one representative. Each of TREES sorted orders holds
every representative by DEPTH values of its signature; the orders are range-partitioned, so a
crowded region spreads over many tasks. Neighbours with a long common prefix are candidates; the
prefix they need grows with the crowd of their region. Candidates whose signatures agree well enough
are confirmed on the full shingle sets, first each document's best ones, then those that would join
two components. In a crowd most neighbours of a document are not its partners, so candidates also
lead to the most linked partners of their ends, round by round until a round links nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import claim, documents, holds, sub_batches, unused, whole_text
from tessera.llm.components import components
from tessera.session import discard, settle, ship, shuffle_partitions

TREES, DEPTH = 16, 8
#: Least common prefix; rows of a region above which a longer one is needed; neighbours on a side.
SHALLOW, CROWD, NEAR = 2, 48, 3
#: Sorted rows that are looked at together.
BLOCK = 16_384
#: Signature agreement that a candidate needs, far below any link's: at 0.8 it is 5 deviations off.
AGREE = 0.62
#: Candidates of a document that are confirmed first.
BEST = 2
_RNG = np.random.default_rng(20240229)
FACTORS = _RNG.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_WORDS = Words()
holds("minhash", _WORDS.clear)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's k-word shingles.

    Words are what white space separates, with A-Z in lower case. A text of fewer than k words has
    their whole sequence as its one shingle; one without words has none.
    """
    if len(_WORDS) > 200_000:
        _WORDS.clear()
    out = []
    for text in texts:
        words = text.encode("utf-8", "replace").lower().split()
        ids = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
        n = len(words)
        if n == 0:
            out.append(ids)
            continue
        size = min(k, n)
        h = np.full(n - size + 1, size, np.uint64)
        for i in range(size):
            h = h * _MIX + ids[i : n - size + 1 + i]
            h ^= h >> np.uint64(29)
        h = _finish(h)
        h.sort()
        out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets, one row each, as big-endian 32-bit numbers."""
    sig = np.empty((len(sets), len(FACTORS)), ">u4")
    a = 0
    while a < len(sets):
        b, size = a, 0
        while b < len(sets) and (b == a or size + len(sets[b]) <= 24_000):
            size += len(sets[b])
            b += 1
        flat = np.concatenate(sets[a:b])
        starts = np.cumsum([0, *map(len, sets[a : b - 1])])
        room = np.empty_like(flat)
        for p, factor in enumerate(FACTORS):
            np.multiply(flat, factor, out=room)
            sig[a:b, p] = np.minimum.reduceat(room, starts) >> np.uint64(32)
        a = b
    return sig


def _sign(k: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("minhash")
        for rows in batches:
            texts = rows["text"].tolist()
            for a, b in sub_batches(texts, 1_000_000):
                sets = shingle_sets(texts[a:b], k)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig, key = [None] * len(sets), [None] * len(sets)
                for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                    sig[i] = row.tobytes()
                    key[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                yield pd.DataFrame({"doc_id": rows["doc_id"].iloc[a:b].array, "n_shingles": [len(s) for s in sets], "set_key": key, "sig": sig})

    return sign


def _pairs(rows: pd.DataFrame, start: int = 0, stop: int | None = None) -> pd.DataFrame:
    """Candidates among rows sorted by tree, key and id, whose first row is from start to stop."""
    n = len(rows)
    keys = np.frombuffer(b"".join(rows["key"]), ">u4").reshape(n, DEPTH)
    tree, ids, size = rows["tree"].to_numpy(), rows["id"].to_numpy(), rows["n"].to_numpy()
    same = np.logical_and.accumulate(keys[1:] == keys[:-1], axis=1)
    lcp = np.where(tree[1:] == tree[:-1], same.sum(1), 0)  # of a row and the next
    need = np.full(n, DEPTH)
    for d in range(DEPTH - 1, SHALLOW - 1, -1):
        region = np.concatenate(([0], np.cumsum(lcp < d)))
        need[np.bincount(region)[region] <= CROWD] = d
    left, right = [], []
    common, here = lcp, np.zeros(n, bool)
    here[start:stop] = True
    for off in range(1, NEAR + 1):
        if n <= off:
            break
        if off > 1:
            common = np.minimum(common[:-1], lcp[off - 1 :])
        small, large = np.minimum(size[:-off], size[off:]), np.maximum(size[:-off], size[off:])
        hit = (common >= np.minimum(need[:-off], need[off:])) & (5 * small >= 4 * large) & here[:-off]
        left.append(ids[:-off][hit])
        right.append(ids[off:][hit])
    a = np.concatenate(left) if left else np.zeros(0, np.int64)
    b = np.concatenate(right) if right else np.zeros(0, np.int64)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


ORDERED = "kind int, a long, b long, tree int, key binary, id long, n long"


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidate pairs (kind 0) of a sorted partition, and its outermost rows (kind 1).

    Rows go in blocks of BLOCK with CROWD rows before and CROWD + NEAR behind, which settle whether a
    region is crowded: the pairs are those of the whole partition, however its rows come in.
    """
    claim("neighbours")
    columns = ["kind", "a", "b", "tree", "key", "id", "n"]

    def found(rows: pd.DataFrame, start: int, stop: int) -> pd.DataFrame:
        out = _pairs(rows, start, stop)
        return pd.DataFrame({"kind": 0, "a": out["a"], "b": out["b"], "tree": 0, "key": None, "id": -1, "n": 0})

    held, done, waiting, size, edge = None, 0, [], 0, None
    for rows in batches:
        if not len(rows):
            continue
        if edge is None or len(edge) < NEAR:
            edge = (rows if edge is None else pd.concat([edge, rows], ignore_index=True)).head(NEAR)
        waiting.append(rows)
        size += len(rows)
        if size >= BLOCK + CROWD + NEAR:
            held = pd.concat([*([] if held is None else [held]), *waiting], ignore_index=True)
            waiting, size = [], 0
            while len(held) - done >= BLOCK + CROWD + NEAR:
                yield found(held.iloc[: done + BLOCK + CROWD + NEAR], done, done + BLOCK)
                drop = max(0, done + BLOCK - CROWD)
                held, done = held.iloc[drop:].reset_index(drop=True), done + BLOCK - drop
    if held is not None or waiting:
        held = pd.concat([*([] if held is None else [held]), *waiting], ignore_index=True)
        yield found(held, done, len(held))
        yield pd.concat([edge, held.tail(NEAR)]).assign(kind=1, a=-1, b=-1)[columns]


def _stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    whole = list(batches)
    if whole:
        yield _pairs(pd.concat(whole, ignore_index=True).drop_duplicates(["tree", "id"]))


def candidates(reps: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, from reps of id, n and sig."""
    n = shuffle_partitions(reps.sparkSession)
    rows = reps.select("id", "n", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig")
    width = 4 * DEPTH
    rows = rows.select("tree", F.expr(f"substring(sig, tree * {width} + 1, {width})").alias("key"), "id", "n")
    ordered = rows.repartitionByRange(n, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    found = settle(ordered.mapInPandas(_neighbours, ORDERED))
    edge = found.where("kind = 1").select("tree", "key", "id", "n")
    # at most 2 * NEAR rows of each partition meet in one task
    across = edge.repartition(1).sortWithinPartitions("tree", "key", "id").mapInPandas(_stitch, "a long, b long")
    return found.where("kind = 0").select("a", "b").unionByName(across).where("a <> b").distinct()


def _agreement(x: pd.Series, y: pd.Series) -> pd.Series:
    claim("compared")
    a = np.frombuffer(b"".join(x), ">u4").reshape(len(x), -1)
    b = np.frombuffer(b"".join(y), ">u4").reshape(len(y), -1)
    return pd.Series((a == b).mean(1))


def _linked(x: pd.Series, y: pd.Series) -> pd.Series:
    claim("compared")
    out = []
    for p, q in zip(x, y, strict=True):
        a, b = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
        both = len(np.intersect1d(a, b, assume_unique=True))
        out.append(100 * both >= 80 * (len(a) + len(b) - both))
    return pd.Series(out, dtype=bool)


def agreement(x: str, y: str):
    return F.pandas_udf(_agreement, "double")(x, y)


def linked(x: str, y: str):
    return F.pandas_udf(_linked, "boolean")(x, y)


def _sets(k: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("minhash")
        for rows in batches:
            texts = rows["text"].tolist()
            for a, b in sub_batches(texts, 1_000_000):
                sets = [s.tobytes() for s in shingle_sets(texts[a:b], k)]
                yield pd.DataFrame({"id": rows["doc_id"].iloc[a:b].array, "set": sets})

    return make


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    with_a = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    both = settle(with_a).join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    return settle(both.where(linked("sa", "sb")).select("a", "b"))


def _apart(scored: DataFrame, label: DataFrame) -> DataFrame:
    """Candidates whose ends are in different components."""
    la, lb = (label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    both = scored.select("a", "b").join(la, "a", "left").join(lb, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _merged(label: DataFrame, more: DataFrame) -> DataFrame:
    """The labels once ``more`` links join some components."""
    la, lb = (label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    both = more.join(la, "a", "left").join(lb, "b", "left")
    up = settle(components(both.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))))
    new = up.select(F.col("node").alias("component"), F.col("component").alias("least"))
    grown = label.join(new, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    return grown.unionByName(up.join(label, "node", "left_anti").select("node", "component"))


def _hubs(links: DataFrame) -> DataFrame:
    """node and hub of every linked document: the most linked one of itself and its partners."""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct()
    degree = settle(ends.groupBy("node").agg(F.count(F.lit(1)).alias("d")))
    around = settle(ends.join(degree.select(F.col("node").alias("other"), "d"), "other"))
    near = around.select("node", "d", "other").unionByName(degree.select("node", "d", F.col("node").alias("other")))
    hub = settle(near.groupBy("node").agg(F.max(F.struct("d", (-F.col("other")).alias("m"))).alias("best")).select("node", (-F.col("best.m")).alias("hub")))
    for table in (degree, around):
        discard(table)
    return hub


def _touched(pairs: DataFrame, hub: DataFrame, before: DataFrame) -> DataFrame:
    """The pairs with an end whose hub is not the one it had before."""
    moved = settle(hub.join(before, ["node", "hub"], "left_anti").select("node"))
    by = [pairs.join(moved.select(F.col("node").alias(x)), x, "left_semi").select("a", "b") for x in "ab"]
    out = settle(by[0].unionByName(by[1]).distinct())
    discard(moved)
    return out


def _through_hubs(pairs: DataFrame, hub: DataFrame, label: DataFrame, tried: DataFrame) -> DataFrame:
    """Untried pairs between components: an end of a candidate, or its hub, and the other end's hub.

    So the copies of one original, which in a crowd meet one another rather than the original, pass it
    on. There are at most three pairs for each candidate, however large a crowd is.
    """
    ha, hb = (hub.select(F.col("node").alias(x), F.col("hub").alias(f"h{x}")) for x in "ab")
    apart = _apart(pairs, label).join(ha, "a", "left").join(hb, "b", "left")
    each = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("a", "hb"), ("ha", "b"), ("ha", "hb"))))
    met = apart.select(F.explode(each).alias("p")).where("p.x is not null and p.y is not null")
    met = met.select(F.least("p.x", "p.y").alias("a"), F.greatest("p.x", "p.y").alias("b")).distinct()
    return settle(met.join(tried, ["a", "b"], "left_anti"))


def near_duplicates(df: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Null and empty texts, and texts of white space, have no shingles and link with nothing. Rows
    that share an id count as one document. Rows without an id link with nothing, have no component
    and stay. Repeated texts are one class. Empty tables give no rows; other columns are ignored.
    """
    ship(df.sparkSession)
    rows = df.select("doc_id", whole_text().alias("text"))
    signed = settle(rows.mapInPandas(_sign(k), "doc_id long, n_shingles long, set_key binary, sig binary"))
    known = signed.where("doc_id is not null and set_key is not null")
    reps = settle(known.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))
    sig = reps.select("id", "sig").dropDuplicates(["id"])
    pairs = candidates(reps)
    scored = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("xa")), "a")
    scored = scored.join(sig.select(F.col("id").alias("b"), F.col("sig").alias("xb")), "b")
    scored = settle(scored.select("a", "b", agreement("xa", "xb").alias("s")).where(F.col("s") >= AGREE))
    wanted = scored.select(F.col("a").alias("doc_id")).unionByName(scored.select(F.col("b").alias("doc_id"))).distinct()
    # merged at every size, so that small inputs plan like large ones
    sets = settle(rows.where("doc_id is not null").join(wanted.hint("merge"), "doc_id", "left_semi").mapInPandas(_sets(k), "id long, set binary"))
    # each document's best candidates first
    ends = scored.select(F.explode(F.array("a", "b")).alias("e"), "a", "b", "s")
    rank = F.row_number().over(Window.partitionBy("e").orderBy(F.desc("s"), "a", "b"))
    best = settle(ends.withColumn("r", rank).where(F.col("r") <= BEST).select("a", "b").distinct())
    links, tried = _confirm(best, sets), best
    label = settle(components(links))
    # then whatever would still join two components; ends that meet in one never part again
    apart = settle(_apart(scored, label))
    fresh = settle(apart.join(best, ["a", "b"], "left_anti"))
    used, hub = [sets, scored, best, apart], None
    while fresh.take(1):
        more = _confirm(fresh, sets)
        tried = tried.unionByName(fresh)
        used += [fresh, more]
        if more.take(1):
            links = links.unionByName(more)
            used.append(label)
            label = settle(_merged(label, more))
        elif hub is not None:
            break
        before, hub = hub, _hubs(links)
        # between ends that kept their hubs all has been tried
        pairs = apart if before is None else _touched(apart, hub, before)
        used += [hub, pairs]
        fresh = _through_hubs(pairs, hub, label, tried)
    for table in [*used, fresh]:
        discard(table)
    whole = reps.select("set_key", F.col("id").alias("rep")).join(label, F.col("rep") == F.col("node"), "left")
    whole = settle(whole.select("set_key", F.coalesce("component", "rep").alias("component")))
    out = signed.join(whole, "set_key", "left")
    # of one id with several texts, the smallest component stands for all
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, k: int = 5) -> DataFrame:
    """The rows whose document stays, with the columns as they were.

    Five words to a shingle are the rule for stages of a pipeline; four are what the contract of the
    query asks for. One changed word spoils k shingles, so five link a little less than four.
    """
    name = unused(df, "__gone")
    gone = near_duplicates(df, k).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return df.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS sh
  FROM w
), c AS (
  SELECT min(doc_id) AS rep, list_sort(sh) AS sh, len(any_value(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh)
), x AS (
  SELECT rep, n, unnest(sh) AS g FROM c
), p AS (
  SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r AS (
  SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a
), k AS (
  SELECT node, min(reach) AS component FROM r GROUP BY node
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(k.component, c.rep, s.doc_id) AS component_id,
       s.doc_id = coalesce(k.component, c.rep, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.sh = list_sort(s.sh) AND len(s.sh) > 0 LEFT JOIN k ON k.node = c.rep
"""
