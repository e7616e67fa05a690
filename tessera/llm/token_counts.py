"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a word form a doubly linked list; a heap yields the adjacent pair of lowest rank,
leftmost first, until none is left. The count is the initial symbols less the merges; identifiers
are never made.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import cached_property, lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents, whole_text
from tessera.session import ship

#: Words whose counts a worker remembers before it starts afresh.
REMEMBERED = 400_000
LIMIT = 2048
#: Fixed values of the vocabulary's own splitter, with white space as Unicode defines it.
WHITE = r"\t-\r \x85\xa0  -     　"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter of each byte, in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


def lowered(text: str) -> str:
    """Canonically composed, and lower case letter by letter."""
    if text.isascii():
        return text.lower()
    return "".join(map(str.lower, unicodedata.normalize("NFC", text)))


class WordCounter(dict):
    """Token counts by word, worked out at the first call for a word."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        ids, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.final = [ids[c + self.suffix] for c in letters]
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.special)))
        self.path = path
        self.pieces: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Symbols of a piece after all merges."""
        data = piece.encode("utf-8", "replace")
        ids = [self.inner[b] for b in data]
        n = len(ids)
        ids[-1] = self.final[data[-1]]
        merges, heap = self.merges, []
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        after[-1] = -1
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:  # one of the two has merged meanwhile
                continue
            ids[i], ids[j] = new, -1
            left -= 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((new, ids[k])):
                    heapq.heappush(heap, (found[0], i, new, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], new))):
                heapq.heappush(heap, (found[0], h, ids[h], new, found[1]))
        return left

    @cached_property
    def library(self):
        """Normalises and cuts words with code points that Python's Unicode tables don't have: other tables may."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def cut_word(self, word: str) -> list[str]:
        if word.isascii() or all(unicodedata.category(c) != "Cn" for c in word):
            return PIECES.findall(lowered(word))
        plain = self.library.normalizer.normalize_str(word)
        return [plain[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def __missing__(self, word: str) -> int:
        total, pieces = 0, self.pieces
        for piece in self.cut_word(word):
            n = pieces.get(piece)
            if n is None:
                n = pieces[piece] = self.merged(piece)
            total += n
        self[word] = total
        return total

    def count(self, text: str) -> int:
        if "<|" in text and (found := self.cut.findall(text)):
            return len(found) + sum(map(self.count, filter(None, self.cut.split(text))))
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        if ODD_SPACE.search(text):  # white space to str.split, but not to the vocabulary
            return sum(map(self.merged, self.cut_word(text)))
        return sum(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def token_counter(path: str):
    """A vectorised function of a text column that returns its tokens."""

    def count(texts: pd.Series) -> pd.Series:
        one = counter(path)
        return pd.Series([one.count(t) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, "long")


def count_tokens(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    Null texts count as empty: no bytes, no tokens. Repeated rows get equal counts, null ids stay
    null, empty tables give no rows, other columns are ignored.
    """
    ship(df.sparkSession)
    rows = df.select("doc_id", whole_text().alias("text"))
    counted = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), token_counter(path)("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


def query(spark, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path(vocabulary))
