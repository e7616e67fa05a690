"""Best-fit packing of token sequences, improved by swap-based local search.

Documents become token pieces of at most CAPACITY. Pools of pieces are packed by best fit, longest
first; then any two underfull bins exchange pieces one-for-one, two-for-one or one-for-two, or move them,
whenever that raises the sum of squared fills, so the emptiest bins run empty. A search ends when no
exchange is left or a lower bound shows that no packing has fewer bins. Bins that stay underfull are opened again and their pieces packed in the next, smaller round of pools.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import claim, documents, holds, whole_text
from tessera.llm.token_counts import byte_letters
from tessera.session import settle, ship

CAPACITY = 2048
#: Mean pieces of a pool; fill below which a bin is opened again; items of a bin, the largest, that may go in twos.
POOL, FULL, PAIRED = 4096, 0.97, 8
END = np.zeros(1, "<u4").tobytes()
#: Fixed value: the splitter of byte-level vocabularies.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs that a backtracking splitter may give up on.
LONG_SPACE = regex.compile(r"\s{5000}")


class Encoder:
    """Token ids of whole texts as little-endian bytes, as the tokenizers library gives them.

    tiktoken merges by the same ranks several times faster, where the vocabulary is plain byte-level:
    ids in the order of merges and the usual splitter. Texts with special strings or very long runs
    of white space, and all texts of other vocabularies, go to the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        spec = json.load(open(path, encoding="utf-8"))
        self.fast = _fast(spec) if _is_plain(spec) else None

    def plain(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special) or LONG_SPACE.search(text):
            return self.plain(text)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def _is_plain(spec: dict) -> bool:
    """Whether ids follow the order of merges after the bytes, with nothing else done to the text."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    usual = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    odd = spec.get("normalizer") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout") or model.get("ignore_merges")
    return model.get("type", "BPE") == "BPE" and usual and not odd and all(model["vocab"].get(m) == 256 + i for i, m in enumerate(merged)) and sorted(model["vocab"][c] for c in byte_letters()) == [*range(256)]


def _fast(spec: dict):
    import tiktoken

    byte = {c: b for b, c in enumerate(byte_letters())}
    names = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in names}
    return tiktoken.Encoding("vocabulary", pat_str=SPLITTER, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


holds("packing", encoder.cache_clear)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    starts = [0, *range(head, n, capacity)] if head else list(range(0, n, capacity))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def piece_maker(path: str):
    """A vectorised function of a text column that returns array<struct<start, length, ids_crc32>>."""

    def make(texts: pd.Series) -> pd.Series:
        claim("packing")
        encode, out = encoder(path), []
        for text in texts:
            ids = encode(text or "") + END
            out.append([{"start": a, "length": n, "ids_crc32": zlib.crc32(ids[4 * a : 4 * (a + n)])} for a, n in cut(len(ids) // 4)])
        return pd.Series(out)

    return F.pandas_udf(make, "array<struct<start:long,length:long,ids_crc32:long>>")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest item first, into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # sorted rooms that some bin has
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect.bisect_left(rooms, sizes[i])
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= sizes[i]
        if not by_room[room]:
            bisect.insort(rooms, room)
        by_room[room].append(b)
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Bins that any packing needs: items above half a bin can't share one, and for each least size
    the items between it and half a bin must go beside those that leave room, or in bins of their own."""
    x = np.sort(np.asarray(sizes, np.int64))
    if not len(x):
        return 0
    sums = np.concatenate(([0], np.cumsum(x)))
    half = int(np.searchsorted(x, capacity // 2, "right"))  # from here on items exceed half a bin
    first = np.unique(np.searchsorted(x[:half], np.concatenate(([0], x[:half]))))  # small items from here on count
    beside = np.maximum(half, np.searchsorted(x, capacity - x[np.minimum(first, len(x) - 1)], "right"))
    beside = np.where(first < half, beside, half)
    spare = (beside - half) * capacity - (sums[beside] - sums[half])
    rest = -(-(sums[half] - sums[first] - spare) // capacity)
    return int((len(x) - half + np.maximum(rest, 0)).max())


class Search:
    """Underfull bins as rows of a matrix of what each can give back: nothing, one item, two items."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.sizes, self.capacity = [list(b) for b in bins], sizes, capacity
        self.singles = max(map(len, bins)) + 2
        self.pairs = min(self.singles, PAIRED) * (min(self.singles, PAIRED) - 1) // 2
        self.back = np.full((len(bins), 1 + self.singles + self.pairs), 4 * capacity, np.int32)  # 4 bins: never
        self.fill = np.zeros(len(bins), np.int64)
        for b in range(len(bins)):
            self.renew(b)

    def items(self, b: int) -> list[int]:
        return sorted(self.bins[b], key=lambda i: -self.sizes[i])

    def twos(self, items: list[int]) -> list[tuple[int, int]]:
        return list(combinations(items[:PAIRED], 2))

    def renew(self, b: int) -> None:
        if len(self.bins[b]) > self.singles:  # a bin has got more items than any had
            more = len(self.bins[b]) + 8 - self.singles
            self.back = np.insert(self.back, [1 + self.singles] * more, 4 * self.capacity, axis=1)
            self.singles += more
            widest = min(self.singles, PAIRED) * (min(self.singles, PAIRED) - 1) // 2
            self.back = np.pad(self.back, ((0, 0), (0, widest - self.pairs)), constant_values=4 * self.capacity)
            self.pairs = widest
        items = self.items(b)
        row = self.back[b]
        row[:] = 4 * self.capacity  # never gives room
        row[0] = 0
        row[1 : 1 + len(items)] = [self.sizes[i] for i in items]
        twos = self.twos(items)
        row[1 + self.singles : 1 + self.singles + len(twos)] = [self.sizes[i] + self.sizes[j] for i, j in twos]
        self.fill[b] = sum(self.sizes[i] for i in items)

    def best(self, low: int, others: np.ndarray) -> tuple[int, list[int], list[int]] | None:
        """The exchange with one of the others that raises the sum of squared fills most: the other bin,
        what it gets and what it gives."""
        items = self.items(low)
        room, ahead = (self.capacity - self.fill[others]).astype(np.int32)[:, None], self.fill[others] - self.fill[low]
        gives = {self.sizes[i]: [i] for i in items}
        for i, j in self.twos(items):
            gives.setdefault(self.sizes[i] + self.sizes[j], [i, j])
        best, out = 0, None
        back = self.back[others]
        least = back + room  # a gift may be this long at most
        for size, give in gives.items():
            # two go for one or for nothing, one goes for up to two
            width = back.shape[1] if len(give) == 1 else 1 + self.singles
            at = np.flatnonzero((back[:, :width] < size) & (least[:, :width] >= size))
            if not len(at):
                continue
            row, column = np.divmod(at, width)
            gain = size - back[row, column].astype(np.int64)
            worth = gain * (ahead[row] + gain)
            i = int(worth.argmax())
            if worth[i] > best:
                best, out = int(worth[i]), (int(row[i]), int(column[i]), give)
        if out is None:
            return None
        row, column, give = out
        high = int(others[row])
        theirs = self.items(high)
        if column == 0:
            back_items = []
        elif column <= self.singles:
            back_items = [theirs[column - 1]]
        else:
            back_items = list(self.twos(theirs)[column - 1 - self.singles])
        return high, give, back_items

    def run(self, enough: int) -> list[list[int]]:
        left, changed = sum(map(bool, self.bins)), True
        touched = set(range(len(self.bins)))
        while changed and left > enough:
            changed, before, touched = False, touched, set()
            for low in np.argsort(self.fill, kind="stable").tolist():
                while self.bins[low] and left > enough:
                    others = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
                    others = others[others != low]
                    if low not in before and low not in touched:  # only against bins that have changed
                        others = others[np.isin(others, [*before, *touched])]
                    found = self.best(low, others) if len(others) else None
                    if found is None:
                        break
                    high, give, back = found
                    self.bins[low] = [i for i in self.bins[low] if i not in give] + back
                    self.bins[high] = [i for i in self.bins[high] if i not in back] + give
                    self.renew(low)
                    self.renew(high)
                    touched |= {low, high}
                    changed = True
                left = sum(map(bool, self.bins)) if changed else left
        return [b for b in self.bins if b]


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Exchange one for one, one for two, two for one, or move, between any two underfull bins while that
    raises the sum of squared fills; ends when no exchange does, or no packing can have fewer bins."""
    enough = lower_bound(sizes, capacity)
    return Search(bins, sizes, capacity).run(enough) if len(bins) > enough else bins


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(sizes, capacity), sizes, capacity)


PACKED = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long, pool long, bin int, offset long, underfull boolean"


def pack_pool(rows: pd.DataFrame) -> pd.DataFrame:
    """Bins of one pool. The order of rows doesn't matter: they are sorted first."""
    rows = rows.sort_values(["doc_id", "copy", "piece"], kind="stable", na_position="last").reset_index(drop=True)
    sizes = rows["length"].tolist()
    bins = pack(sizes)
    where, offset, under = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
    for b, items in enumerate(bins):
        at = 0
        for i in items:
            where[i], offset[i] = b, at
            at += sizes[i]
        under[items] = at < FULL * CAPACITY
    return rows.assign(bin=where, offset=offset, underfull=under)


def pieces_of(df: DataFrame, path: str) -> DataFrame:
    """doc_id, copy, piece, start, length and ids_crc32 of every document's pieces.

    ``copy`` tells repeated rows with one id apart, by an arbitrary number.
    """
    rows = df.select("doc_id", F.monotonically_increasing_id().alias("copy"), whole_text().alias("text"))
    made = rows.select("doc_id", "copy", F.posexplode(piece_maker(path)("text")).alias("piece", "p"))
    return made.select("doc_id", "copy", "piece", "p.start", "p.length", "p.ids_crc32")


def pack_documents(df: DataFrame, path: str, pool: int = POOL) -> DataFrame:
    """A row for each piece with the sequence that holds it and its place there.

    Null texts count as empty; every document has at least its end token, so every row gives a
    piece. Repeated rows are packed as often as they occur, null ids like others. Empty tables give
    no rows; columns other than doc_id and text are ignored.
    """
    ship(df.sparkSession)
    todo = settle(pieces_of(df, path))
    rows, done, rounds = todo.count(), [], 0
    while True:
        pools = max(1, -(-rows // pool))
        keyed = todo.withColumn("pool", F.pmod(F.xxhash64("doc_id", "copy", "piece", F.lit(rounds)), F.lit(pools)))
        keyed = keyed.withColumn("bin", F.lit(0)).withColumn("offset", F.lit(0).cast("long")).withColumn("underfull", F.lit(False))
        packed = settle(keyed.groupBy("pool").applyInPandas(pack_pool, PACKED).withColumn("round", F.lit(rounds)))
        rest = packed.where("underfull").count() if pools > 1 else 0
        if rest == 0 or 2 * rest > rows:  # nothing left to mend, or pools can't mend it
            done.append(packed)
            break
        done.append(packed.where("not underfull"))
        todo, rows, rounds = packed.where("underfull").select(*todo.columns), rest, rounds + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    # a pool has fewer than 2^24 bins, a round fewer than 2^32 pools
    number = (F.col("round").cast("long") * (1 << 56)) + F.col("pool") * (1 << 24) + F.col("bin")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset")


def query(spark, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path(vocabulary))
