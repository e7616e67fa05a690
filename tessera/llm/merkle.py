"""Merkle manifest of a dataset, with a proof for every document.

Documents are leaves, a tree for each source; the sources' roots are the leaves of one more tree. The
sorted leaves are range-partitioned, so that a source of any size spreads over many partitions, and
each partition knows the index of its first leaf. It keeps a mountain range, a stack of open runs for
each level: a run that fills up to the fanout carries into its parent, as a digit does in addition,
and leaves a node record. What a partition can't close, at its unaligned ends and the peaks that
stay open, goes to a distributed merge that closes runs level by level; the last run of a level is
hashed as short as it is, without padding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, is_remainder
from tessera.session import settle, ship, shuffle_partitions

FANOUT = 16
#: Leaves of a sorted partition, which a task holds to prove them; rows of an output batch.
ROWS, OUT = 250_000, 8192
#: Fields of a document, in the order of its leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = "tree string, total long, level int, at long, digest string, loose boolean"


def _hash(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def leaf(**values: Column) -> Column:
    """The digest of a document: each field - if null, else its UTF-8 byte count, a colon and itself."""
    texts = (values[name].cast("string") for name in FIELDS)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


@dataclass
class Forest:
    """Trees over settled leaves: where each part of a tree begins, the runs that were merged, all roots."""

    placed: DataFrame  # tree, key, digest, altered, part
    segments: DataFrame  # tree, part, first, n, total: the leaves of a tree in one partition
    records: DataFrame  # nodes that partitions closed, and the loose ones they could not
    runs: DataFrame  # tree, level, run, children: of nodes below the ones that the merge closed
    tops: DataFrame  # tree, digest, total
    fanout: int

    def nodes(self) -> DataFrame:
        """tree, level, at, digest of every node above the leaves."""
        own = self.records.where("level > 0 and not loose").select("tree", "level", "at", "digest")
        merged = self.runs.select("tree", (F.col("level") + 1).alias("level"), F.col("run").alias("at"), F.sha2("children", 256).alias("digest"))
        return own.unionByName(merged)


def _streamed(rows: DataFrame) -> DataFrame:
    """Each tree's part of a partition in one task, its first row (kind 0) before its leaves in order."""
    order = ("part", F.col("tree").asc_nulls_first(), "kind", F.col("key").asc_nulls_first(), "digest")
    return rows.repartition("part", "tree").sortWithinPartitions(*order)


def _cut(kinds: pd.Series) -> Iterator[tuple[int, int]]:
    """(start, end) of rows of one segment in a batch; a segment's first row is its kind 0."""
    starts = [i for i, kind in enumerate(kinds) if kind == 0]
    if not starts or starts[0]:
        starts.insert(0, 0)
    yield from zip(starts, [*starts[1:], len(kinds)], strict=True)


class Range:
    """The mountain range of one segment: open runs by level, and records of what closes or stays loose."""

    def __init__(self, tree, total: int, first: int, fanout: int):
        self.tree, self.total, self.fanout = tree, total, fanout
        self.next = first
        self.open: list[list[bytes]] = [[]]
        self.after = [first]  # index after the last open node of each level

    def push(self, digest: bytes, out: list) -> None:
        level, at = 0, self.next
        self.next += 1
        while True:
            if level == len(self.open):
                self.open.append([])
                self.after.append(at)
            run = self.open[level]
            run.append(digest)
            self.after[level] = at + 1
            if (at + 1) % self.fanout:
                return
            if len(run) < self.fanout:  # it began in another partition
                self.flush(level, out)
                return
            digest = _hash(b"".join(run))
            run.clear()
            level, at = level + 1, at // self.fanout
            out.append((self.tree, self.total, level, at, digest.decode(), False))

    def flush(self, level: int, out: list) -> None:
        run = self.open[level]
        first = self.after[level] - len(run)
        out.extend((self.tree, self.total, level, first + i, d.decode(), True) for i, d in enumerate(run))
        run.clear()

    def close(self, out: list) -> None:
        for level in range(len(self.open)):
            self.flush(level, out)


def _raiser(fanout: int):
    names = [c.split()[0] for c in NODE.split(", ")]

    def raise_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = None, []
        for batch in batches:
            digests = batch["digest"].tolist()
            for a, b in _cut(batch["kind"]):
                if batch["kind"].iat[a] == 0:
                    if now:
                        now.close(out)
                    now = Range(batch["tree"].iat[a], int(batch["total"].iat[a]), int(batch["first"].iat[a]), fanout)
                    a += 1
                for d in digests[a:b]:
                    now.push(d.encode(), out)
                if len(out) >= OUT:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if now:
            now.close(out)
        if out:
            yield pd.DataFrame(out, columns=names)

    return raise_ranges


def plant(leaves: DataFrame, fanout: int = FANOUT) -> Forest:
    """Trees over leaves (tree, key, digest, altered), ordered by key, nulls first, and then by digest.

    Equal leaves may repeat without bound; a number of the row deals them out.
    """
    spark = leaves.sparkSession
    ship(spark)
    rows = leaves.count()
    parts = max(1, min(shuffle_partitions(spark), rows // 1024), -(-rows // ROWS))
    dealt = leaves.withColumn("row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(parts, F.col("tree").asc_nulls_first(), F.col("key").asc_nulls_first(), "digest", "row")
    placed = settle(dealt.drop("row").withColumn("part", F.spark_partition_id()))

    before, whole = Window.partitionBy("tree").orderBy("part"), Window.partitionBy("tree")
    segments = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    segments = settle(segments.select("tree", "part", "n", (F.sum("n").over(before) - F.col("n")).alias("first"), F.sum("n").over(whole).alias("total")))

    heads = segments.select("part", "tree", F.lit(0).alias("kind"), "first", "total", F.lit(None).cast(placed.schema["key"].dataType).alias("key"), F.lit(None).cast("string").alias("digest"))
    body = placed.select("part", "tree", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("total"), "key", "digest")
    stream = _streamed(heads.unionByName(body)).select("tree", "kind", "first", "total", "digest")
    records = settle(stream.mapInPandas(_raiser(fanout), NODE))

    runs, tops, raised = [], [], None
    most, level = segments.agg(F.max("total")).first()[0] or 0, 0
    while most and (not level or fanout ** (level - 1) < most):
        now = records.where(F.col("loose") & (F.col("level") == level)).select("tree", "total", "at", "digest")
        if raised is not None:
            now = now.unionByName(raised)
        several = F.col("total") > fanout**level  # else one node is left: the root
        tops.append(now.where(~several).select("tree", "digest", "total"))
        run = now.where(several).groupBy("tree", "total", F.expr(f"at div {fanout}").alias("run"))
        children = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda c: c["digest"]), "")
        runs.append(settle(run.agg(children.alias("children")).withColumn("level", F.lit(level))))
        raised = runs[-1].select("tree", "total", F.col("run").alias("at"), F.sha2("children", 256).alias("digest"))
        level += 1
    if not tops:
        none = spark.createDataFrame([], "tree string, digest string, total long, level int, run long, children string")
        tops, runs = [none.select("tree", "digest", "total")], [none]
    merged = [r.select("tree", "level", "run", "children") for r in runs]
    return Forest(placed, segments, records, _all(merged), _all(tops), fanout)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _borders(forest: Forest) -> DataFrame:
    """tree, part, edges, runs: the merged runs that a segment's first and last nodes are in, two a level at most."""
    powers = [forest.fanout**k for k in range(62) if forest.fanout**k < 1 << 62]
    power = F.get(F.array(*(F.lit(p).cast("long") for p in powers)), F.col("level") + 1)
    height = F.aggregate(F.array(*(F.lit(p).cast("long") for p in powers)), F.lit(0), lambda n, p: n + (F.col("total") > p).cast("int"))
    each = forest.segments.where("total > 1").select("tree", "part", "first", (F.col("first") + F.col("n") - 1).alias("last"), F.explode(F.sequence(F.lit(0), height - 1)).alias("level"))
    each = each.withColumn("power", power).select("tree", "part", "level", F.explode(F.array_distinct(F.array(F.expr("first div power"), F.expr("last div power")))).alias("run"))
    r = forest.runs.select(F.col("tree").alias("r_tree"), F.col("level").alias("r_level"), F.col("run").alias("r_run"), "children")
    found = each.join(r, each["tree"].eqNullSafe(r["r_tree"]) & (each["level"] == r["r_level"]) & (each["run"] == r["r_run"]))
    return found.groupBy("tree", "part").agg(F.collect_list(F.concat_ws(":", "level", "run", "children")).alias("edges"))


class Segment:
    """A tree's leaves in one partition, with all it takes to prove them."""

    def __init__(self, first: int, total: int, fanout: int, edges):
        self.first, self.fanout = first, fanout
        self.edges = {}
        for edge in edges if edges is not None else ():
            level, run, children = edge.split(":")
            self.edges[int(level), int(run)] = children.encode()
        self.height = 0
        while fanout**self.height < total:
            self.height += 1
        self.leaves: list[bytes] = []

    def close(self) -> None:
        """Work out the nodes above the leaves that lie within the segment."""
        self.levels, first, now = [], self.first, self.leaves
        for _ in range(self.height):
            self.levels.append((first, now))
            begin, end = -(-first // self.fanout), (first + len(now)) // self.fanout
            now = [_hash(b"".join(now[(r * self.fanout - first) : (r + 1) * self.fanout - first])) for r in range(begin, end)]
            first = begin
        self.last = [(-1, [])] * self.height

    def step(self, level: int, at: int) -> tuple[bytes, bytes]:
        """The digests left and right of a node in its run."""
        run, place = at // self.fanout, at % self.fanout * 64
        joined = self.edges.get((level, run))
        if joined is None:
            first, digests = self.levels[level]
            joined = b"".join(digests[run * self.fanout - first : (run + 1) * self.fanout - first])
        return joined[:place], joined[place + 64 :]

    def steps(self, at: int, level: int = 0) -> list[tuple[bytes, bytes]]:
        """Of each level from this one on; neighbours share what lies above them."""
        if level == self.height:
            return []
        if self.last[level][0] != at:
            self.last[level] = (at, [self.step(level, at), *self.steps(at // self.fanout, level + 1)])
        return self.last[level][1]


def fold(digest: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to; a node alone in its run is hashed alone."""
    for left, right in steps:
        digest = _hash(left + digest + right)
    return digest


PROOF = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, tree string"
STEPS = "key string, digest string, left array<string>, right array<string>"


def _prover(fanout: int, full: bool):
    """Rows of PROOF, or of STEPS for the trees' own tree."""
    names = [c.split()[0] for c in (PROOF if full else STEPS).split(", ")]

    def finish(seg: Segment, head: dict, keys: list, altered: list) -> Iterator[pd.DataFrame]:
        seg.close()
        above = list(zip(map(str.encode, head["left"]), map(str.encode, head["right"]), strict=True)) if full else []
        siblings = b"".join(a + b for a, b in above)
        out = []
        for i, (key, mine, other) in enumerate(zip(keys, seg.leaves, altered, strict=True)):
            steps = seg.steps(seg.first + i)
            if full:
                proof = _hash(b"".join(a + b for a, b in steps) + siblings)
                folded = fold(fold(other.encode() if other else mine, steps), above)
                out.append((key, mine.decode(), head["subroot"], head["root"], proof.decode(), folded.decode(), head["tree"]))
            else:
                out.append((key, mine.decode(), [a.decode() for a, _ in steps], [b.decode() for _, b in steps]))
            if len(out) >= OUT:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    def prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg, head, keys, altered = None, {}, [], []
        for batch in batches:
            columns = {c: batch[c].tolist() for c in ("name", "digest", "altered")}
            for a, b in _cut(batch["kind"]):
                if batch["kind"].iat[a] == 0:
                    if seg:
                        yield from finish(seg, head, keys, altered)
                    head = batch.iloc[a].to_dict()
                    seg, keys, altered = Segment(int(head["first"]), int(head["total"]), fanout, head["edges"]), [], []
                    a += 1
                keys += columns["name"][a:b]
                altered += columns["altered"][a:b]
                seg.leaves += map(str.encode, columns["digest"][a:b])
        if seg:
            yield from finish(seg, head, keys, altered)

    return prove


def prove(forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """PROOF of every leaf, given subroot, root, left and right of each tree; without, STEPS."""
    key = forest.placed.schema["key"].dataType
    borders = _borders(forest).select(F.col("tree").alias("b_tree"), F.col("part").alias("b_part"), "edges")
    heads = forest.segments.join(borders, F.col("tree").eqNullSafe(F.col("b_tree")) & (F.col("part") == F.col("b_part")), "left")
    extra = {"edges": "array<string>"}
    if above is not None:
        extra |= {"subroot": "string", "root": "string", "left": "array<string>", "right": "array<string>"}
        heads = heads.join(above.withColumnRenamed("tree", "a_tree"), F.col("tree").eqNullSafe(F.col("a_tree")))
    none = {"key": key, "name": "string", "digest": "string", "altered": "string"}
    heads = heads.select("part", "tree", F.lit(0).alias("kind"), "first", "total", *(F.lit(None).cast(t).alias(c) for c, t in none.items()), *extra)
    body = forest.placed.select("part", "tree", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("total"), "key", F.col("key").cast("string").alias("name"), "digest", "altered", *(F.lit(None).cast(t).alias(c) for c, t in extra.items()))
    stream = _streamed(heads.unionByName(body)).drop("part", "key")
    return stream.mapInPandas(_prover(forest.fanout, above is not None), PROOF if above is not None else STEPS)


def grow(df: DataFrame, fanout: int = FANOUT) -> tuple[Forest, Forest]:
    """The trees of the sources over their documents, and the tree over the sources' roots.

    Of documents whose id's crc32 is divisible by 5 an altered copy is hashed beside, A-Z of the text lower-cased.
    """
    fields = {name: F.col(name) for name in FIELDS}
    struck = is_remainder("doc_id", 5, 0) & F.col("text").rlike("[A-Z]")
    altered = F.when(struck, leaf(**fields | {"text": F.translate("text", UPPER, LOWER)}))
    trees = plant(df.select(F.col("source").alias("tree"), F.col("doc_id").alias("key"), leaf(**fields).alias("digest"), altered.alias("altered")), fanout)
    roots = trees.tops.select(F.lit("sources").alias("tree"), F.col("tree").alias("key"), "digest", F.lit(None).cast("string").alias("altered"))
    return trees, plant(roots, fanout)


def prove_documents(df: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and source of every document.

    Null fields count as -, null ids and sources come first, rows with one id are ordered by their
    digests, equal rows are leaves as often as they occur. A proof without siblings is the hash of
    nothing. Empty tables give no rows; columns other than FIELDS are ignored.
    """
    trees, sources = grow(df, fanout)
    top = sources.tops.first()  # one row, as long as there is a document
    root = F.lit(top["digest"] if top else None).cast("string").alias("root")
    steps = settle(prove(sources))
    above = steps.select(F.col("key").alias("tree"), F.col("digest").alias("subroot"), root, "left", "right")
    proved = prove(trees, above)
    return proved.select(
        F.col("key").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), F.col("tree").alias("source")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return prove_documents(documents(spark, sf_dir))


_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: list_concat([ascii(ch)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
 lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""


def _leaf_sql(text: str) -> str:
    fields = [*(f"{name}::VARCHAR" for name in FIELDS[:-1]), text]
    return f"sha256({' || '.join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields)})"


def _levels_sql(name: str, height: int) -> str:
    """Nodes of each level with what stands left and right of them, from a table name0 (tree, i, n, h)."""
    out = []
    for k in range(height):
        at = f"(PARTITION BY tree, i // {FANOUT} ORDER BY i ROWS BETWEEN"
        out.append(f"{name}{k}x AS (SELECT tree, i, n, coalesce(string_agg(h, '') OVER {at} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER {at} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})")
        out.append(f"{name}{k + 1} AS (SELECT tree, i // {FANOUT} AS i, (n + {FANOUT - 1}) // {FANOUT} AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM {name}{k} GROUP BY tree, i // {FANOUT}, n)")
    return ",\n".join(out)


def sql(height: int = 5, above: int = 3) -> str:
    """For up to 16^height documents of a source and 16^above sources."""
    joins = [f"JOIN d{k}x AS a{k} ON a{k}.tree IS NOT DISTINCT FROM d.tree AND a{k}.i = d.i // {FANOUT**k}" for k in range(height)]
    joins += [f"JOIN s{k}x AS b{k} ON b{k}.i = s.i // {FANOUT**k}" for k in range(above)]
    steps, folded = [f"a{k}" for k in range(height)] + [f"b{k}" for k in range(above)], ["coalesce(d.altered, d.h) AS f0"]
    names = ", ".join(f"{x}.{c} AS {x}{c}" for x in steps for c in "nlr")
    chain = [f"f{k + 1} AS (SELECT *, CASE WHEN {x}n > 1 THEN sha256({x}l || f{k} || {x}r) ELSE f{k} END AS f{k + 1} FROM f{k})" for k, x in enumerate(steps)]
    proof = " || ".join(f"{x}l || {x}r" for x in steps)
    return f"""WITH h AS (SELECT source AS tree, doc_id, {_leaf_sql("text")} AS h, CASE WHEN {_CRC32} % 5 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS altered FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM h),
d0 AS (SELECT tree, i, n, h FROM d), {_levels_sql("d", height)},
s AS (SELECT tree AS name, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i FROM d{height}),
s0 AS (SELECT 0 AS tree, i, count(*) OVER () AS n, h FROM s), {_levels_sql("s", above)},
f0 AS (SELECT d.tree AS source, d.doc_id, d.h AS leaf, s.h AS subroot, (SELECT h FROM s{above}) AS root, {folded[0]}, {names} FROM d JOIN s ON s.name IS NOT DISTINCT FROM d.tree {" ".join(joins)}),
{", ".join(chain)}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, f{len(steps)} AS folded_root, f{len(steps)} = root AS verified, source FROM f{len(steps)}"""


SQL = sql()
