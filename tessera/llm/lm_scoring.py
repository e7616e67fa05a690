"""Language-model scoring by subword lattice likelihood.

A word's lattice has an edge for every piece of an existing vocabulary, weighed by the vocabulary's
own scores, and a forward recursion in log space sums over all segmentations. The whole word is one
more edge, weighed by its count in the training texts; with N training tokens of V kinds, c of them
this word and a lattice probability L its marginal probability is (c + V L) / (N + V). So the given
scores weigh in proportion to how often training texts bring a new word, at every size. A document's
score is the sum over its words and its end.

No unigram vocabulary is at hand: the scores of the BPE model are ranks, and become a Zipf law.

Words are routed to shards by hash, in compressed blobs with the documents they occur in. Words with
at least one in HOT training tokens, of which there are HOT at most, are resolved where the document
is read, so no shard gathers a word that is everywhere.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents, id_remainder, is_remainder, whole_text
from tessera.session import discard, settle, ship, shuffle_partitions

HOT = 20_000
#: Characters and rows of a batch, and distinct words that a task counts before it sends them.
CHARS, ROWS, WORDS = 8_000_000, 50_000, 500_000
#: Shift of the Zipf law of ranks.
SHIFT = 2.7
MARK = "▁"


class Pieces:
    """A sentencepiece vocabulary: pieces by text, byte pieces, and probabilities p from its scores."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.end = model.eos_id()
        self.ids = {model.id_to_piece(i): i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        rank = np.zeros(n)
        scores = np.array([model.get_score(i) for i in range(n)])
        usable = np.array([*self.ids.values()])
        rank[usable] = scores[usable].max() - scores[usable]
        rest = [i for i in [*self.bytes, self.end] if i not in set(self.ids.values())]
        rank[rest] = rank.max() + 1 + np.arange(len(rest))
        weight = np.zeros(n)
        use = np.concatenate((usable, rest)).astype(int)
        weight[use] = 1 / (rank[use] + SHIFT)
        self.p = weight / weight.sum()


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """Marginal log probabilities of words over all segmentations, many words side by side."""

    def __init__(self, vocabulary: Pieces):
        logs = np.log(np.maximum(vocabulary.p, 1e-300))
        self.logs, self.end = logs, float(logs[vocabulary.end])
        self.byte = [float(logs[i]) for i in vocabulary.bytes]
        # a trie whose edges are sorted by (state, code point)
        states, edges, self.piece = {"": 0}, {}, [-1]
        for text, i in vocabulary.ids.items():
            for n in range(1, len(text) + 1):
                if text[:n] not in states:
                    states[text[:n]] = len(states)
                    edges[states[text[: n - 1]] << 21 | ord(text[n - 1])] = states[text[:n]]
                    self.piece.append(-1)
            self.piece[states[text]] = i
        self.piece = np.array(self.piece)
        self.keys = np.array(sorted(edges), np.int64)
        self.next = np.array([edges[k] for k in self.keys.tolist()], np.int64)

    def spelled(self, char: str) -> float:
        return sum(self.byte[b] for b in char.encode("utf-8", "replace"))

    def _edges(self, points: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and log probability of every piece at every place; ``left`` characters are left there."""
        at, state, found = np.arange(len(points)), np.zeros(len(points), np.int64), []
        alone = np.ones(len(points), bool)  # characters that no piece is
        n = 0
        while len(at):
            key = state << 21 | points[at + n]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            go = self.keys[edge] == key
            at, state = at[go], self.next[edge[go]]
            n += 1
            piece = self.piece[state]
            ends = piece >= 0
            found.append((at[ends], np.full(int(ends.sum()), n), self.logs[piece[ends]]))
            if n == 1:
                alone[at[ends]] = False
            more = left[at] > n
            at, state = at[more], state[more]
        odd = np.flatnonzero(alone)
        cost = {c: self.spelled(chr(c)) for c in np.unique(points[odd]).tolist()}
        found.append((odd, np.ones(len(odd), np.int64), np.array([cost[c] for c in points[odd].tolist()])))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _some(self, words: list[str]) -> np.ndarray:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        first = np.cumsum(sizes) - sizes
        offset = np.arange(len(points)) - np.repeat(first, sizes)
        start, length, logp = self._edges(points, np.repeat(sizes, sizes) - offset)
        # node i + w stands before character i, of word w
        begin = start + np.repeat(np.arange(len(words)), sizes)[start]
        end, depth = begin + length, offset[start] + length
        order = np.lexsort((begin, end, depth))
        begin, end, logp, depth = begin[order], end[order], logp[order], depth[order]
        a = np.zeros(len(points) + len(words))
        lead = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1])))
        level = np.searchsorted(depth[lead], np.arange(1, int(sizes.max()) + 2))
        lead = np.append(lead, len(end))
        for x, y in zip(level[:-1], level[1:], strict=True):
            heads = lead[x:y]
            ways = a[begin[heads[0] : lead[y]]] + logp[heads[0] : lead[y]]
            top = np.maximum.reduceat(ways, heads - heads[0])
            a[end[heads]] = top + np.log(np.add.reduceat(np.exp(ways - np.repeat(top, np.diff(lead[x : y + 1]))), heads - heads[0]))
        return a[first + sizes + np.arange(len(words))]

    def words(self, words: list[bytes]) -> np.ndarray:
        """Log probabilities of words."""
        texts = [MARK + w.decode("utf-8") for w in words]
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        out, a = np.zeros(len(texts)), 0
        while a < len(order):
            b, chars = a, 0
            while b < len(order) and (b == a or chars + len(texts[order[b]]) <= 200_000):
                chars += len(texts[order[b]])
                b += 1
            out[order[a:b]] = self._some([texts[i] for i in order[a:b]])
            a = b
        return out


@lru_cache(maxsize=1)
def _lattice(path: str) -> Lattice:
    return Lattice(pieces(path))


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def _blob(*parts) -> bytes:
    """Byte strings and arrays, each with its length before it."""
    raw = [p if isinstance(p, bytes) else np.ascontiguousarray(p).tobytes() for p in parts]
    return zstandard.compress(b"".join(len(r).to_bytes(8, "little") + r for r in raw), 1)


def _parts(blob: bytes, *kinds) -> list:
    raw, at, out = zstandard.decompress(blob), 0, []
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        part = raw[at + 8 : at + 8 + n]
        out.append(part if kind is bytes else np.frombuffer(part, kind))
        at += 8 + n
    return out


def _split(raw: bytes) -> list[bytes]:
    return raw.split(b"\n") if raw else []


def _shard_of(words: list[bytes], shards: int) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(shards)).astype(np.int64)


def _send_counts(shards: int):
    """Word counts of the training texts of a task, by shard."""

    def blobs(counts: Counter[bytes]) -> pd.DataFrame:
        words = list(counts)
        n = np.fromiter(counts.values(), np.int64, len(words))
        shard = _shard_of(words, shards)
        order = np.argsort(shard, kind="stable")
        out = [(s, _blob(b"\n".join([words[i] for i in order[x:y]]), n[order[x:y]])) for s, x, y in _cuts(shard[order])]
        return pd.DataFrame(out, columns=["shard", "blob"])

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()
        for rows in batches:
            for text in rows["text"]:
                counts.update(tokens(text))
                if len(counts) > WORDS:
                    yield blobs(counts)
                    counts.clear()
        if counts:
            yield blobs(counts)

    return send


def _cuts(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of each run."""
    at = np.flatnonzero(np.diff(sorted_values, prepend=-1))
    for a, b in zip(at, [*at[1:], len(sorted_values)][: len(at)], strict=True):
        yield int(sorted_values[a]), int(a), int(b)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens, distinct words and counts of a shard."""
    counts: Counter[bytes] = Counter()
    for rows in batches:
        for blob in rows["blob"]:
            raw, n = _parts(blob, bytes, np.int64)
            for w, c in zip(_split(raw), n.tolist(), strict=True):
                counts[w] += c
    if counts:
        n = np.fromiter(counts.values(), np.int64, len(counts))
        yield pd.DataFrame({"tokens": [int(n.sum())], "words": [len(counts)], "blob": [_blob(b"\n".join(counts), n)]})


def _frequent(least: float):
    def frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for blob in rows["blob"]:
                raw, n = _parts(blob, bytes, np.int64)
                if len(n) and n.max() >= least:
                    words = _split(raw)
                    at = np.flatnonzero(n >= least)
                    yield pd.DataFrame({"word": [words[i] for i in at], "n": n[at]})

    return frequent


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Model:
    """What scoring needs of the training texts: tokens n, kinds v, ends, and at most HOT words with their counts."""

    def __init__(self, path: str, n: int, v: int, ends: int, hot: dict[bytes, int], shards: int):
        self.path, self.n, self.v, self.ends, self.hot, self.shards = path, n, v, ends, hot, shards

    def score(self, count: np.ndarray, log_lattice: np.ndarray) -> np.ndarray:
        """log10 (count + v L) / (n + v) for lattice probabilities L; v counts as 1 without training."""
        v = max(self.v, 1)
        with np.errstate(divide="ignore"):
            return (np.logaddexp(np.log(count), math.log(v) + log_lattice) - math.log(self.n + v)) / math.log(10)


def _send_words(model: Model):
    """Rows of (batch, shard, kind, blob): words with their documents for each shard (kind 0), and
    what is known of a batch's documents without them (kind 1)."""

    def rows_of(batch: int, ids: list, held: np.ndarray, texts: list[str], hot: dict) -> pd.DataFrame:
        n_docs, numbers = len(texts), _Numbers()
        lists = [np.fromiter(map(numbers.__getitem__, tokens(t)), np.int64) for t in texts]
        length = np.fromiter(map(len, lists), np.int64, n_docs)
        pairs, times = np.unique(np.concatenate(lists) * n_docs + np.repeat(np.arange(n_docs), length), return_counts=True)
        number, doc = pairs // n_docs, pairs % n_docs
        words = list(numbers)
        trained = np.bincount(number, weights=times * ~held[doc], minlength=len(words)).astype(np.int64)
        is_hot = np.fromiter(map(hot.__contains__, words), bool, len(words))
        values = np.array([hot[w] for w, h in zip(words, is_hot, strict=True) if h]).reshape(-1, 2)
        place = np.cumsum(is_hot) - 1
        near = is_hot[number]
        base, score = (np.bincount(doc[near], weights=times[near] * values[place[number[near]], i], minlength=n_docs) for i in (0, 1))
        known = np.bincount(doc[near], weights=times[near], minlength=n_docs)
        null = np.array([i is None for i in ids])
        head = _blob(np.array([0 if i is None else i for i in ids], np.int64), null, held, length + 1, known, base, score)
        out = [(batch, batch % model.shards, 1, head)]
        rare = np.flatnonzero(~is_hot)
        shard = _shard_of([words[i] for i in rare], model.shards)
        order = rare[np.argsort(shard, kind="stable")]
        start = np.searchsorted(number, np.arange(len(words) + 1))
        for s, x, y in _cuts(np.sort(shard)):
            mine = order[x:y]
            sizes = start[mine + 1] - start[mine]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) - np.repeat(ends - sizes - start[mine], sizes)
            out.append((batch, s, 0, _blob(b"\n".join([words[i] for i in mine]), trained[mine], sizes, doc[at].astype(np.uint16), times[at].astype(np.int32))))
        return pd.DataFrame(out, columns=["batch", "shard", "kind", "blob"])

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = list(model.hot)
        counts = np.array([model.hot[w] for w in frequent], float)
        scores = model.score(counts, _lattice(model.path).words(frequent)) if frequent else counts
        hot = dict(zip(frequent, zip(np.log10(counts + 1).tolist(), scores.tolist(), strict=True), strict=True))
        batch = TaskContext.get().partitionId() << 32
        ids, held, texts, chars = [], [], [], 0
        for rows in batches:
            for i, h, t in zip(rows["doc_id"].astype(object).where(rows["doc_id"].notna(), None), rows["held_out"], rows["text"], strict=True):
                ids.append(i)
                held.append(h)
                texts.append(t)
                chars += len(t)
                if chars >= CHARS or len(texts) >= ROWS:
                    yield rows_of(batch, ids, np.array(held, bool), texts, hot)
                    ids, held, texts, chars, batch = [], [], [], 0, batch + 1
        if texts:
            yield rows_of(batch, ids, np.array(held, bool), texts, hot)

    return send


SENT = "batch long, shard long, kind int, blob binary"


def _score_shard(model: Model):
    """Sums over a shard's words for each batch's documents; other rows pass."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, opened = _Numbers(), []
        for rows in batches:
            yield rows[rows["kind"] == 1]
            for row in rows[rows["kind"] == 0].itertuples():
                raw, trained, *rest = _parts(row.blob, bytes, np.int64, np.int64, np.uint16, np.int32)
                words = _split(raw)
                opened.append((row.batch, row.shard, np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), trained, row.blob))
        if not opened:
            return
        count = np.zeros(len(numbers), np.int64)
        for _, _, at, trained, _ in opened:
            np.add.at(count, at, trained)
        words = list(numbers)
        values = np.log10(count + 1.0), model.score(count.astype(float), _lattice(model.path).words(words)), (count > 0).astype(float)
        for batch, shard, at, _, blob in opened:
            _, _, sizes, doc, times = _parts(blob, bytes, np.int64, np.int64, np.uint16, np.int32)
            of = np.repeat(at, sizes)
            base, score, known = (np.bincount(doc, weights=times * v[of]) for v in values)
            some = np.unique(doc)
            out = _blob(some, known[some].astype(np.int32), base[some], score[some])
            yield pd.DataFrame([(batch, shard, 0, out)], columns=["batch", "shard", "kind", "blob"])

    return score


def _gather(model: Model):
    end = _lattice(model.path).end

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["kind", "shard"], ascending=[False, True])
        ids, null, held, length, known, base, score = map(np.copy, _parts(rows["blob"].iloc[0], np.int64, bool, bool, np.int64, float, float, float))
        for blob in rows["blob"].iloc[1:]:
            at, k, b, s = _parts(blob, np.uint16, np.int32, float, float)
            known[at] += k
            base[at] += b
            score[at] += s
        base += math.log10(model.ends + 1)
        known += model.ends > 0
        base -= length * math.log10(model.n + model.v + 1)
        score += float(model.score(np.array([float(model.ends)]), np.array([end]))[0])
        out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": held, "n_tokens": length, "n_known": known.astype(np.int64), "train_tokens": model.n, "base_score": base, "score": score})
        out.loc[null, "doc_id"] = pd.NA
        return out

    return gather


def score_documents(df: DataFrame, path: str, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    ``held_out`` is a column of the rows that teach nothing. Null texts count as empty: one token,
    the end. Rows without an id are held out if the column is null for them, and are scored like
    others; repeated rows are rows of their own. Without training texts all counts are zero and the
    lattice alone decides. Empty tables give no rows; other columns are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    shards = shuffle_partitions(spark)  # a shard is a partition, so shards grow with the input as partitions do
    n_train = rows.where("not held_out").count()

    def by_shard(table: DataFrame) -> DataFrame:
        return table.repartitionById(shards, F.col("shard").cast("int"))

    sent = rows.where("not held_out").select("text").mapInPandas(_send_counts(shards), "shard long, blob binary")
    counts = settle(by_shard(sent).mapInPandas(_merge, "tokens long, words long, blob binary"))
    n, v = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    n, v = n + n_train, v + (n_train > 0)
    hot = counts.mapInPandas(_frequent(max(1.0, n / HOT)), "word binary, n long").collect()  # HOT rows at most
    discard(counts)
    model = Model(path, n, v, n_train, {bytes(r["word"]): r["n"] for r in hot}, shards)
    scored = by_shard(rows.mapInPandas(_send_words(model), SENT)).mapInPandas(_score_shard(model), SENT)
    return scored.groupBy("batch").applyInPandas(
        _gather(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def query(spark, sf_dir: str, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    out = score_documents(documents(spark, sf_dir), public_tokenizers.path(vocabulary), id_remainder("doc_id", 7) == 2)
    return out.withColumn("held_out", F.when(F.col("doc_id").isNull(), False).otherwise(is_remainder("doc_id", 7, 2)))
