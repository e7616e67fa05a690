"""The manifest against a plain recursion over lists, and against SQL."""

import random
import zlib
from hashlib import sha256

import pytest
from oracle import SF_DIR, same, sql_rows

pytest.importorskip("tessera.llm")
from tessera.llm import merkle  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DRAW = random.Random(13)


def digest(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(doc, text):
    values = [doc["doc_id"], doc["source"], doc["lang"], doc["n_chars"], text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fanout):
    """The root and, for each leaf, the (left, right) lists of siblings of each level."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, i in enumerate(at):
            run, p = runs[i // fanout], i % fanout
            steps[k].append((run[:p], run[p + 1 :]))
        at, nodes = [i // fanout for i in at], [digest("".join(r)) for r in runs]
    return nodes[0], steps


def plain(docs, fanout):
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    by = {}
    for d in docs:
        by.setdefault(d["source"], []).append(d)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    roots, rows = [], []
    for name in names:
        ordered = sorted(by[name], key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, plain_leaf(d, d["text"])))
        top, steps = climb([plain_leaf(d, d["text"]) for d in ordered], fanout)
        roots.append(top)
        rows.append((ordered, steps))
    root, above = climb(roots, fanout) if roots else (None, [])
    out = []
    for top, upper, (ordered, steps) in zip(roots, above, rows, strict=True):
        for d, own in zip(ordered, steps, strict=True):
            path = own + upper
            hit = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0 and d["text"] is not None
            folded = plain_leaf(d, d["text"].translate(lower) if hit else d["text"])
            for left, right in path:
                folded = digest("".join(left) + folded + "".join(right))
            proof = digest("".join(x for left, right in path for x in left + right))
            out.append((d["doc_id"], plain_leaf(d, d["text"]), top, root, proof, folded, folded == root, d["source"]))
    return out


def docs_of(sizes):
    """(source, documents of it): ids mixed over the sources."""
    ids = DRAW.sample(range(10 * sum(sizes.values()) + 10), sum(sizes.values()))
    return [
        {"doc_id": ids.pop(), "text": DRAW.choice(["Aé", "low", "UP Down ß", "", None]), "lang": DRAW.choice(["en", None]), "source": s, "n_chars": DRAW.choice([None, 3, -1])}
        for s, n in sizes.items()
        for _ in range(n)
    ]


CASES = {
    "lone": {"a": 1},
    "fanout and one more": {"a": 16, "b": 17, None: 1, "": 2},
    "powers": {"a": 256, "b": 257, "é": 255},
    "hot": {"a": 700, **{f"s{i}": 1 + i % 3 for i in range(60)}},
}
KEY = lambda r: tuple(map(str, r))


def frame(spark, docs):
    return spark.createDataFrame([tuple(d[c.split()[0]] for c in SCHEMA.split(", ")) for d in docs], SCHEMA)


@pytest.mark.parametrize("name, fanout, rows", [("lone", 16, 250_000), ("fanout and one more", 16, 37), ("powers", 16, 37), ("powers", 3, 10), ("hot", 16, 250_000), ("hot", 3, 10)])
def test_proofs_against_plain_recursion(spark, monkeypatch, name, fanout, rows):
    monkeypatch.setattr(merkle, "ROWS", rows)  # many partitions, whose ends fall anywhere
    docs = docs_of(CASES[name])
    got = merkle.prove_documents(frame(spark, docs), fanout).collect()
    assert sorted(map(KEY, got)) == sorted(map(KEY, plain(docs, fanout)))
    hit = {d["doc_id"] for d in docs if d["text"] and zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0 and d["text"].translate(str.maketrans(merkle.UPPER, merkle.LOWER)) != d["text"]}
    assert {r["doc_id"] for r in got if not r["verified"]} == hit


def test_query_matches_sql(spark):
    same(merkle.query(spark, SF_DIR).toPandas(), sql_rows(merkle.SQL))


def test_sources_beyond_one_partition(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS", 50)
    docs = docs_of({f"s{i}": 1 for i in range(300)})
    got = merkle.prove_documents(frame(spark, docs)).collect()
    assert sorted(map(KEY, got)) == sorted(map(KEY, plain(docs, 16)))


def test_repeated_rows_null_ids_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS", 25)
    one = {"doc_id": 7, "text": "Same", "lang": "en", "source": "a", "n_chars": 4}
    docs = [dict(one) for _ in range(120)] + [one | {"text": "Other"}, one | {"doc_id": None}, one | {"doc_id": None, "text": None}]
    docs += [one | {"doc_id": 9, "text": "Word " * 400_000}, one | {"doc_id": 1, "source": None, "lang": None, "n_chars": None, "text": None}]
    got = merkle.prove_documents(frame(spark, docs)).collect()
    assert sorted(map(KEY, got)) == sorted(map(KEY, plain(docs, 16)))


def test_empty_and_clashing_columns(spark):
    assert merkle.prove_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    names = "leaf tree part key digest altered kind first total root at level run".split()
    docs = docs_of({"a": 20, "b": 2})
    rows = frame(spark, docs)
    for name in names:
        rows = rows.selectExpr("*", f"'x' AS {name}")
    assert sorted(map(KEY, merkle.prove_documents(rows).collect())) == sorted(map(KEY, plain(docs, 16)))


def test_manifest_holds_every_node(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS", 60)
    docs = docs_of({"a": 300, "b": 5, "c": 1})
    trees, sources = merkle.grow(frame(spark, docs))
    got = {(r["tree"], r["level"], r["at"]): r["digest"] for r in trees.nodes().collect()}
    expect = {}
    for s in "abc":
        now = [plain_leaf(d, d["text"]) for d in sorted((d for d in docs if d["source"] == s), key=lambda d: d["doc_id"])]
        level = 0
        while len(now) > 1:
            level += 1
            now = [digest("".join(now[i : i + 16])) for i in range(0, len(now), 16)]
            expect |= {(s, level, i): d for i, d in enumerate(now)}
    assert got == expect and trees.nodes().count() == len(expect)
    assert [r["level"] for r in sources.nodes().collect()] == [1]
