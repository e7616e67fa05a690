"""Alignment against whole texts encoded by the libraries and plain loops over token pairs."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

pytest.importorskip("tessera.llm")
P = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tessera.llm import alignment  # noqa: E402
from tessera.llm.token_counts import byte_letters  # noqa: E402

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
DRAW = random.Random(11)
SPACES = [" ", " ", " ", "  ", "   ", "\n", "\t ", " \n", " ", "  ", " \x1c", "\r\n\r\n  "]
WORDS = ["the", "and", "Don't", "it's", "naïve", "Straße", "3.14", "2024,", "(x)", "...", "日本語", "한국", "🙂🙂", "<|endoftext|>", "<s>", "<0x41>", "\x00", "é", "ﬁx", "--", "a" * 70, "'s", "ÅB"]
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "\n", "the the", "the  the", " the", "x▁y", "▁", "the ▁ end", "w " * 300 + "w", "</s> <unk>", "�", "a\x85b c",
    " ".join(["the"] * 5000), "z" * 30_000, " " * 6000 + "x", *("".join(DRAW.choice(WORDS) + DRAW.choice(SPACES) for _ in range(DRAW.randrange(1, 60))) for _ in range(150)),
]


def plain():
    """Each text's result, worked out token by token."""
    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    byte = {c: b for b, c in enumerate(byte_letters())}

    def piece(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()

    docs, links = [], Counter()
    for text in TEXTS:
        if not text:
            docs.append(None)
            continue
        ids_a, ids_b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
        bytes_a = [bytes(byte[c] for c in a_side.id_to_token(i)) for i in ids_a]
        bytes_b = [piece(i) for i in ids_b]
        raw = (" " + text).encode()
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            docs.append(None)
            continue
        owner_a = [k for k, t in enumerate(bytes_a) for _ in t]
        owner_b = [k for k, t in enumerate(bytes_b) for _ in t]
        own = sorted(set(zip(owner_a, owner_b, strict=True)))
        cuts = [p for p in range(len(raw)) if p + 1 == len(raw) or (owner_a[p] != owner_a[p + 1] and owner_b[p] != owner_b[p + 1])]
        groups, i, j = [], 0, 0
        for p in cuts:
            groups.append((ids_a[i : owner_a[p] + 1], ids_b[j : owner_b[p] + 1]))
            i, j = owner_a[p] + 1, owner_b[p] + 1
        pairs = [(ids_a[x], ids_b[y]) for x, y in own]
        links.update(pairs)
        docs.append((len(ids_a), len(ids_b), groups, pairs))
    most = defaultdict(int)
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    out = []
    for doc in docs:
        if doc is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, pairs = doc
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((n_a, n_b, len(groups), len(pairs), sum(links[p] == most[p[1]] for p in pairs), sum(links[p] for p in pairs), sha256(text.encode()).hexdigest()))
    return out, links, [doc and doc[2] for doc in docs]


COLUMNS = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@pytest.fixture(scope="module")
def expected():
    return plain()


@pytest.mark.parametrize("chars, docs, remembered", [(3_000_000, 50_000, 150_000), (700, 7, 40)])
def test_documents_against_plain_loops(spark, monkeypatch, expected, chars, docs, remembered):
    for name, value in (("CHARS", chars), ("DOCS", docs), ("REMEMBERED", remembered)):
        monkeypatch.setattr(alignment, name, value)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_documents(rows, A, B).collect()}
    assert [got[i] for i in range(len(TEXTS))] == expected[0]
    assert sum(e[0] > 0 for e in expected[0]) > 100 and sum(e[0] == 0 for e in expected[0]) > 4


def test_blocks_stay_small_in_one_process(expected):
    """The worker's own code, with a block for every few documents and a memory that is cleared."""
    import pandas as pd

    one = alignment.Aligner(A, B)
    frames = [alignment._block(one, [str(i)], [t or ""]) for i, t in enumerate(TEXTS)]
    counts = pd.concat(frames)["doc_groups"].explode().tolist()
    assert counts == [e[-1] for e in expected[0]]
    one.clear()
    again = alignment._block(one, [str(i) for i in range(len(TEXTS))], [t or "" for t in TEXTS])
    assert list(again["doc_groups"][0]) == counts


def test_pair_counts_and_maxima(spark, expected):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = alignment.pair_counts(rows, A, B).collect()
    links = expected[1]
    assert {(r["a"], r["b"]): r["n"] for r in got} == dict(links)
    for side in (0, 1):
        most = defaultdict(int)
        for p, n in links.items():
            most[p[side]] = max(most[p[side]], n)
        assert all(r[("best_a", "best_b")[side]] == (r["n"] == most[r[side]]) for r in got)


def test_groups_with_offsets(spark, expected):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for i, groups in rows.select("doc_id", alignment.groups_of(A, B)("text")).collect():
        assert [(g["a"], g["b"]) for g in groups] == (expected[2][i] or [])
        assert not groups or (groups[0]["start"] == -1 and groups[-1]["end"] == len(TEXTS[i].encode()) and all(x["end"] == y["start"] for x, y in zip(groups, groups[1:], strict=False)))


def test_repeats_nulls_empty_and_clashing(spark):
    schema = "doc_id long, text string, block string, a long, b long, n long, place int, found string"
    assert alignment.align_documents(spark.createDataFrame([], schema), A, B).count() == 0
    rows = [(i, t, "x", 1, 2, 3, 4, "f") for i, t in ((1, "so it goes"), (1, "so it goes"), (None, "so it goes"), (2**60 + 1, "so"), (3, None))]
    got = alignment.align_documents(spark.createDataFrame(rows, schema), A, B).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(["1", "1", "None", str(2**60 + 1), "3"])
    assert len({tuple(r[c] for c in COLUMNS) for r in got if r["n_a"] == 3}) == 1
    assert {r["count_sum"] for r in got if r["n_links"] == 3} == {4 + 3 + 3}


def test_blocks_lie_in_small_row_groups(spark, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(alignment, "DOCS", 1)
    monkeypatch.setitem(alignment.LARGE_ROWS, "parquet.block.size", "2048")
    rows = spark.createDataFrame([(i, f"text number {i} " * 20) for i in range(30)], "doc_id long, text string").coalesce(1)
    made = alignment._aligned(rows, A, B)
    groups = [pq.ParquetFile(p.removeprefix("file:")) for p in made.inputFiles()]
    assert sum(f.num_row_groups for f in groups) > 5  # a task writes, and a reader holds, a few blocks at a time
