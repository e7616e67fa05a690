"""Alignment of two tokenizers over a corpus.

Two pointers walk the cumulative token ends of both tokenizers over the same bytes: where one ends a
link ends, where both end a group does. The walk goes over segments, the stretches between which no
token of either side can reach, so a segment is encoded and walked once and met many times. Spark counts
the linked pairs of ids over the corpus and joins counts and each side's maxima back, block by block.

Blocks of documents stay in a settled table: each has its distinct pairs, and its documents as numbers
of segments. What is shuffled are a block's distinct pairs and, once, the block. A block is megabytes, so
no task holds many: they lie in small row groups, and each meets its pairs in a group of its own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import claim, documents, holds, whole_text
from tessera.llm.packing import LONG_SPACE, Encoder
from tessera.llm.token_counts import byte_letters
from tessera.session import settle, ship

#: Characters and documents of a block; segments that a worker remembers; longest segment that it does.
CHARS, DOCS, REMEMBERED, WORD = 3_000_000, 50_000, 150_000, 64
#: Writer's options for rows of megabytes: by default a hundred are held before their size is looked at, and a
#: reader takes a whole row group.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4"}
#: Characters of segments that are encoded together.
JOINED = 4000
#: A space after a character that isn't white: tokens of neither side go on from before it.
BREAK = regex.compile(r"(?<=\S) (?!\Z)")
#: Spaces where splitting at each of them would not be the same as BREAK.
ODD = regex.compile(r"\A |\s |\s\Z")


class ByteSide:
    """Ids and token bytes of a byte-level vocabulary of the tokenizers library, special strings as plain text."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.encoder.library.encode_special_tokens = True
        byte = {c: b for b, c in enumerate(byte_letters())}
        vocab = self.encoder.library.get_vocab()
        self.tokens = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        #: whether spaces only begin tokens of the splitter
        self.breaks = self.encoder.fast is not None

    def __call__(self, text: str) -> list[int]:
        text = " " + text
        if self.encoder.fast is None or LONG_SPACE.search(text):
            return self.encoder.library.encode(text, add_special_tokens=False).ids
        return self.encoder.fast.encode_ordinary(text)


class PieceSide:
    """Ids and piece bytes of a sentencepiece model, which puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.breaks = all("▁" not in p.lstrip("▁") for p in pieces)

    def __call__(self, text: str) -> list[int]:
        return self.model.encode(text)


@dataclass
class Walk:
    """What the two pointers find over a run of bytes whose tokens are a and b."""

    link_a: np.ndarray  # tokens of a link, in order
    link_b: np.ndarray
    link_end: np.ndarray  # byte where it ends
    group_end: np.ndarray


def walk(ends_a: np.ndarray, ends_b: np.ndarray) -> Walk:
    """Merge two ascending rows of token ends that have the same last end.

    Every end, of either side, ends the overlap of just one token of each side: the first that does
    not end before it. So the merged ends are the links, and ends of both sides are the groups.
    """
    both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # two sorted runs: one merge
    twice = both[1:] == both[:-1]
    ends = np.delete(both, np.flatnonzero(twice)) if twice.any() else both
    return Walk(np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), ends, both[:-1][twice])


class Aligner:
    """Segments of texts with their links, groups and counts, remembered by number."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteSide(path_a), PieceSide(path_b)
        self.size_a, self.size_b = (np.array([len(t) for t in side.tokens]) for side in (self.a, self.b))
        self.breaks = self.a.breaks and self.b.breaks
        # an id with what may follow it: the next id of its side, the other side, the next group or the end
        self.names = np.array([f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(max(len(self.size_a), len(self.size_b)))], dtype=object)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.new: list[str] = []
        self.texts: list[str] = []  # groups, as text
        self.counts = np.zeros((0, 4), "i8")  # a, b, groups, links; -1 where the bytes differ
        self.starts = np.zeros(1, "i8")
        self.pairs = np.zeros(0, "i8")  # id of a, id of b as one number

    def segments(self, text: str) -> list[str]:
        if not self.breaks:
            return [text]
        return BREAK.split(text) if ODD.search(text) else text.split(" ")

    def numbers(self, text: str) -> list[int]:
        """Numbers of a text's segments; new ones are still to be learned."""
        known, out = self.known, []
        for s in self.segments(text):
            n = known.get(s)
            if n is None:
                n = len(self.texts) + len(self.new)
                self.new.append(s)
                if len(s) <= WORD:
                    known[s] = n
            out.append(n)
        return out

    def learn(self) -> None:
        """Encode and walk the new segments: short ones together, as no token reaches from one into the next."""
        todo, size, counts, pairs = [], 0, [], []
        for s in [*self.new, None]:
            alone = s is None or len(s) > WORD or not self.breaks or s[-1:].isspace() or not s
            if todo and (alone or size > JOINED):
                self._learn(todo, counts, pairs)
                todo, size = [], 0
            if s is not None:
                todo.append(s)
                size += len(s)
                if alone:
                    self._learn(todo, counts, pairs)
                    todo, size = [], 0
        self.new = []
        if counts:
            self.counts = np.concatenate([self.counts, *counts])
            self.starts = np.concatenate([[0], np.cumsum(np.maximum(self.counts[:, 3], 0))])
            self.pairs = np.concatenate([self.pairs, *pairs])

    def _learn(self, words: list[str], counts: list, pairs: list) -> None:
        text = " ".join(words)
        ids_a, ids_b = self.a(text), self.b(text)
        raw = b" " + text.encode()
        if b"".join(map(self.a.tokens.__getitem__, ids_a)) != raw or b"".join(map(self.b.tokens.__getitem__, ids_b)) != raw:
            if len(words) > 1:
                for w in words:
                    self._learn([w], counts, pairs)
            else:
                self.texts.append("")
                counts.append(np.full((1, 4), -1))
            return
        a, b = np.array(ids_a), np.array(ids_b)
        ends_a, ends_b = self.size_a[a].cumsum(), self.size_b[b].cumsum()
        found = walk(ends_a, ends_b)
        word_ends = np.cumsum([1 + len(w.encode()) for w in words])
        within = [np.diff(np.searchsorted(ends, word_ends, "right"), prepend=0) for ends in (ends_a, ends_b, found.group_end, found.link_end)]
        counts.append(np.stack(within, 1))
        pairs.append((a[found.link_a] << 32) | b[found.link_b])
        self.texts += self._group_texts(a, b, ends_a, ends_b, found.group_end, within[0] + within[1])

    def _group_texts(self, a, b, ends_a, ends_b, group_ends, tokens) -> list[str]:
        """a1,a2|b1;a3|b2 of each word: tokens of both sides in the order of their groups, each with its mark."""
        through_a, through_b = (np.searchsorted(ends, group_ends, "right") for ends in (ends_a, ends_b))
        group_a, group_b = (np.searchsorted(group_ends, ends) for ends in (ends_a, ends_b))
        place_a = np.arange(len(a)) + np.concatenate([[0], through_b])[group_a]
        place_b = np.arange(len(b)) + through_a[group_b]
        mark_a, mark_b = np.zeros(len(a), "i8"), np.zeros(len(b), "i8")
        mark_a[through_a - 1], mark_b[through_b - 1] = 1, 2
        n = len(self.names) // 4
        out = np.empty(len(a) + len(b), "i8")
        out[place_a], out[place_b] = a + n * mark_a, b + n * mark_b
        stops = np.cumsum(tokens)
        out[stops - 1] += n  # the last of a word: no mark, documents put the ; between words
        parts = self.names[out].tolist()
        return ["".join(parts[i:j]) for i, j in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


holds("alignment", aligner.cache_clear)

BLOCK = "block long, pair_a array<int>, pair_b array<int>, pair_n array<long>, word_sizes binary, word_pairs binary, doc_ids array<string>, doc_counts binary, doc_groups array<string>, doc_words binary"


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[0], starts[0] + 1, ... of all stretches, one after another."""
    if not len(sizes):
        return np.zeros(0, "i8")
    shift = starts - np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.repeat(shift, sizes) + np.arange(int(sizes.sum()))


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as low halves, then high ones, which are mostly zero and compress."""
    wide = numbers.astype("<u4")
    return (wide & 0xFFFF).astype("<u2").tobytes() + (wide >> 16).astype("<u2").tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    halves = np.frombuffer(planes, "<u2").astype("i8")
    n = len(halves) // 2
    return halves[:n] | (halves[n:] << 16)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, so many each time."""
    upto = np.concatenate([np.zeros((1, values.shape[1]), "i8"), np.cumsum(values, 0)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def _block(one: Aligner, ids: list, texts: list) -> pd.DataFrame:
    if len(one.texts) > REMEMBERED:
        one.clear()
    rows = [one.numbers(t) if t else [] for t in texts]
    one.learn()
    sizes = np.array([len(r) for r in rows], "i8")
    words = np.array([n for r in rows for n in r], "i8")
    doc = np.repeat(np.arange(len(rows)), sizes)
    bad = np.zeros(len(rows), bool)
    bad[doc[one.counts[words, 3] < 0]] = True
    words, sizes = words[~bad[doc]], np.where(bad, 0, sizes)
    counts = np.column_stack([_sums(one.counts[words], sizes), sizes])
    groups, join = [], ";".join
    for r, n in zip(rows, sizes.tolist(), strict=True):
        groups.append(hashlib.sha256(join([one.texts[w] for w in r]).encode()).hexdigest() if n else "")
    # the block's own numbers for its segments, the most frequent first, and for its pairs
    used, words, often = np.unique(words, return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")
    rank = np.empty(len(order), "i8")
    rank[order] = np.arange(len(order))
    used, often, words = used[order], often[order], rank[words]
    links = one.counts[used, 3]
    pairs = one.pairs[_ragged(one.starts[used], links)]
    distinct, which = np.unique(pairs, return_inverse=True)
    n = np.zeros(len(distinct), "i8")
    np.add.at(n, which, np.repeat(often, links))
    out = {
        "block": uuid.uuid4().int >> 65, "pair_a": (distinct >> 32).astype("i4"), "pair_b": (distinct & 0xFFFFFFFF).astype("i4"), "pair_n": n, "word_sizes": _planes(links), "word_pairs": _planes(which),
        "doc_ids": ids, "doc_counts": counts.astype("<i8").tobytes(), "doc_groups": groups, "doc_words": _planes(words),
    }
    return pd.DataFrame({k: [v] for k, v in out.items()})


def _blocks(path_a: str, path_b: str):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("alignment")
        one = aligner(path_a, path_b)
        ids, texts, chars = [], [], 0
        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                if texts and (chars + len(text) > CHARS or len(texts) >= DOCS):
                    yield _block(one, ids, texts)
                    ids, texts, chars = [], [], 0
                ids.append(i)
                texts.append(text)
                chars += len(text)
        if texts:
            yield _block(one, ids, texts)

    return make


DOC = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_best_a long"


def _documents(blocks: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """Documents of a block whose pairs have come back with their counts and whether these are a side's highest."""
    out = []
    for _, row in blocks.iterrows():
        pair = np.zeros((len(found), 3), "i8")
        pair[found["place"].to_numpy()] = found[["n", "best_b", "best_a"]].to_numpy("i8")
        sizes, which = _numbers(row["word_sizes"]), _numbers(row["word_pairs"])
        word = _sums(pair[which], sizes)
        counts = np.frombuffer(row["doc_counts"], "<i8").reshape(-1, 5)
        total = _sums(word[_numbers(row["doc_words"])], counts[:, 4])
        made = {"doc_id": list(row["doc_ids"])} | {c: counts[:, k] for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
        out.append(pd.DataFrame(made | {"n_best": total[:, 1], "count_sum": total[:, 0], "groups_sha256": list(row["doc_groups"]), "n_best_a": total[:, 2]}))
    return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in DOC.split(", ")])


def _aligned(df: DataFrame, path_a: str, path_b: str) -> DataFrame:
    ship(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("string").alias("doc_id"), whole_text().alias("text"))
    return settle(rows.mapInPandas(_blocks(path_a, path_b), BLOCK), **LARGE_ROWS)


def _pairs(blocks: DataFrame) -> DataFrame:
    zipped = F.arrays_zip("pair_a", "pair_b", "pair_n")
    return blocks.select("block", F.posexplode(zipped).alias("place", "p")).select("block", "place", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n"))


def _counted(blocks: DataFrame) -> DataFrame:
    """a, b, n, best_a, best_b: counts of linked ids over all blocks, and whether they are the highest of an id of a or b."""
    counts = settle(_pairs(blocks).groupBy("a", "b").agg(F.sum("n").alias("n")))
    highest = [counts.groupBy(side).agg(F.max("n").alias(f"most_{side}")) for side in "ab"]
    joined = counts.join(highest[0], "a").join(highest[1], "b")
    return joined.select("a", "b", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b"))


def pair_counts(df: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """a, b, n, best_a, best_b of every pair of ids that a link of the corpus holds: how the vocabularies map."""
    return _counted(_aligned(df, path_a, path_b))


def align_documents(df: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document: tokens of both sides, groups, links, and how its links fare in the corpus.

    Texts that are null or empty, and those whose token bytes of a side are not a space and the text,
    have no tokens, zeros and an empty groups_sha256. Repeated rows count as often as they occur and
    get equal results, null ids stay null, empty tables give no rows, columns other than doc_id and text
    are ignored.
    """
    blocks = _aligned(df, path_a, path_b)
    counted = settle(_counted(blocks))
    found = _pairs(blocks).drop("n").join(counted, ["a", "b"]).select(F.col("block").alias("of_block"), "place", "n", "best_b", "best_a")
    kept = blocks.drop("pair_a", "pair_b", "pair_n")
    out = kept.groupBy("block").cogroup(found.groupBy("of_block")).applyInPandas(_documents, DOC)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


GROUPS = "array<struct<start:long,end:long,a:array<int>,b:array<int>>>"


def groups_of(path_a: str, path_b: str):
    """A vectorised function of a text column: its groups, with byte offsets in the text and ids; the space before it is byte -1."""

    def give(texts: pd.Series) -> pd.Series:
        claim("alignment")
        one, out = aligner(path_a, path_b), []
        for text in texts:
            ids_a, ids_b = (one.a(text), one.b(text)) if text else ([], [])
            raw = b" " + (text or "").encode()
            if any(b"".join(map(side.tokens.__getitem__, ids)) != raw for side, ids in ((one.a, ids_a), (one.b, ids_b))):
                out.append([])
                continue
            ends_a, ends_b = one.size_a[ids_a].cumsum(), one.size_b[ids_b].cumsum()
            stops = walk(ends_a, ends_b).group_end
            cut_a, cut_b = (np.searchsorted(ends, stops, "right").tolist() for ends in (ends_a, ends_b))
            out.append([
                {"start": s - 1, "end": e - 1, "a": ids_a[i:j], "b": ids_b[k:m]}
                for s, e, i, j, k, m in zip([0, *stops[:-1].tolist()], stops.tolist(), [0, *cut_a], cut_a, [0, *cut_b], cut_b)
            ])
        return pd.Series(out)

    return F.pandas_udf(give, GROUPS)


def query(spark, sf_dir: str, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    return align_documents(documents(spark, sf_dir), public_tokenizers.path(a), public_tokenizers.path(b))
