"""Substring deduplication with repeated-phrase automata.

Documents travel in compressed batches. A window of WINDOW words is known by its minimiser, the
least hash among the ANCHOR-word phrases inside, so equal windows share it and neighbouring windows
with one minimiser in one place form a segment, of WINDOW - ANCHOR + 1 windows at most. First only minimisers are exchanged, one for each batch that has
it; a batch then sends the segments whose minimiser occurs in several documents, each distinct text
once with the least and greatest document that holds it. A shard confirms word by word which passages
recur, compiles them into one Aho-Corasick automaton over its own word alphabet, and streams every
segment of every document through it; what the automaton finds is what goes. Windows of a minimiser
that is in more than HOT documents travel one by one, by their own hash, so no shard gathers all the
places of a common phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import claim, documents, whole_text
from tessera.session import settle, ship, shuffle_partitions

WINDOW, ANCHOR = 13, 5
#: Characters of a batch; documents above which a minimiser's windows travel one by one.
CHARS, HOT = 4_000_000, 4096
#: Parts of a shard, by minimiser, and words of the parts that share one automaton.
PARTS, AUTOMATON = 256, 300_000
NEVER = np.iinfo(np.int64).max
_P = np.uint64(0x9E3779B97F4A7C15)


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def phrase_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on, for all places that have k."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _P + words[i : i + n]
        h ^= h >> np.uint64(29)
    return _mix(h)


def _window_min(h: np.ndarray, k: int) -> np.ndarray:
    """Where the least of the k values from each place on is, the first one if there are several."""
    have, out = 1, np.arange(len(h))
    while have < k:
        step = min(have, k - have)
        left, right = out[: len(out) - step], out[step:]
        out = np.where(h[right] < h[left], right, left)
        have += step
    return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def pack(*parts) -> bytes:
    """Byte strings, and arrays by planes of bytes, each with its length before it."""
    raw = []
    for p in parts:
        if not isinstance(p, bytes):
            p = np.ascontiguousarray(p)
            p = p.view(np.uint8).reshape(-1, p.itemsize).T.tobytes()
        raw.append(len(p).to_bytes(8, "little") + p)
    return zstandard.compress(b"".join(raw), 3)


def unpack(blob: bytes, *kinds) -> list:
    raw, at, out = zstandard.decompress(blob), 0, []
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        part = raw[at + 8 : at + 8 + n]
        if kind is not bytes:
            planes = np.frombuffer(part, np.uint8).reshape(np.dtype(kind).itemsize, -1)
            part = np.ascontiguousarray(planes.T).view(kind).ravel()
        out.append(part)
        at += 8 + n
    return out


class Batch:
    """Numbered words of some texts, and the segments of their windows in order."""

    def __init__(self, texts: list[bytes], ids: np.ndarray):
        numbers = Numbers()
        lists = [np.fromiter(map(numbers.__getitem__, t.split()), np.int32) for t in texts]
        self.vocabulary = list(numbers)
        self.lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        self.words = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        self.doc = np.repeat(ids, self.lengths)
        owner = np.repeat(np.arange(len(lists)), self.lengths)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.vocabulary), np.uint64, len(self.vocabulary))[self.words]
        spans = max(0, len(self.words) - WINDOW + 1)
        at = np.flatnonzero(owner[:spans] == owner[WINDOW - 1 :][:spans])
        phrases = phrase_hashes(self.hashes, ANCHOR)
        least = _window_min(phrases, WINDOW - ANCHOR + 1)[at] if len(at) else at
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
        cut = np.flatnonzero(new)
        self.start, self.count, self.key = at[cut], np.diff(np.append(cut, len(at))), phrases[least[cut]]

    def anchors(self, shards: int):
        """Distinct minimisers by shard and hash: shard, hash, number of each segment's, least document, documents."""
        keys, of = np.unique(self.key, return_inverse=True)
        shard = keys % np.uint64(shards)
        order = np.lexsort((keys, shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        of = place[of]
        doc = self.doc[self.start]
        by = np.lexsort((doc, of))
        other = np.ones(len(by), bool)
        other[1:] = (of[by][1:] != of[by][:-1]) | (doc[by][1:] != doc[by][:-1])
        docs = np.bincount(of[by][other], minlength=len(keys))
        first = np.searchsorted(of[by], np.arange(len(keys)))
        return shard[order].astype(np.int64), keys[order], of, doc[by][first] if len(by) else doc, docs


def _cuts(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of each run."""
    at = np.flatnonzero(np.diff(sorted_values, prepend=-1))
    for a, b in zip(at, [*at[1:], len(sorted_values)][: len(at)], strict=True):
        yield int(sorted_values[a]), int(a), int(b)


ROWS = "batch long, shard long, kind int, blob binary"
TEXTS, ANCHORS, OWN, PASSAGES = range(4)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["batch", "shard", "kind", "blob"])


def open_texts(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids, which of them are null, and texts."""
    ids, null, sizes, raw = unpack(blob, np.int64, bool, np.int64, bytes)
    ends = np.cumsum(sizes).tolist()
    return ids, null, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def taught(null: np.ndarray, texts: list[bytes]) -> list[bytes]:
    """The texts; those without an id are left out of all comparisons."""
    return [b"" if gone else t for gone, t in zip(null.tolist(), texts, strict=True)]


def _send_anchors(shards: int):
    """Batches of texts, and the minimisers of each for every shard."""

    def rows_of(number: int, ids: list, texts: list[bytes]) -> pd.DataFrame:
        null = np.array([i is None for i in ids])
        known = np.array([i if i is not None else 0 for i in ids], np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        out = [(number, -1, TEXTS, pack(known, null, sizes, b"".join(texts)))]
        shard, keys, _, doc, docs = Batch(taught(null, texts), known).anchors(shards)
        for s, a, b in _cuts(shard):
            out.append((number, s, ANCHORS, pack(keys[a:b], doc[a:b], np.minimum(docs[a:b], 65535).astype(np.uint16))))
        return _rows(out)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("substring_anchors")
        number = TaskContext.get().partitionId() << 32
        ids, texts, chars = [], [], 0
        for rows in batches:
            for i, t in zip(rows["doc_id"].astype(object).where(rows["doc_id"].notna(), None), rows["text"], strict=True):
                ids.append(i)
                texts.append(t.encode("utf-8", "replace"))
                chars += len(t)
                if chars >= CHARS:
                    yield rows_of(number, ids, texts)
                    ids, texts, chars, number = [], [], 0, number + 1
        if ids:
            yield rows_of(number, ids, texts)

    return send


def _find_recurring(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each blob of minimisers whether each is in one document (0), several (1) or many (2)."""
    rows = [r for b in batches for r in zip(b["batch"], b["shard"], b["blob"], strict=True)]
    if not rows:
        return
    opened = [unpack(blob, np.uint64, np.int64, np.uint16) for _, _, blob in rows]
    keys, doc, docs = (np.concatenate(x) for x in zip(*opened, strict=True))
    order = np.argsort(keys, kind="stable")
    lead = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    doc, docs = doc[order], docs[order].astype(np.int64)
    n = np.add.reduceat(docs, lead)
    several = (np.minimum.reduceat(doc, lead) < np.maximum.reduceat(doc, lead)) | (np.maximum.reduceat(docs, lead) > 1)
    state = np.empty(len(keys), np.uint8)
    state[order] = np.repeat((several * (1 + (n > HOT))).astype(np.uint8), np.diff(np.append(lead, len(keys))))
    at = 0
    for (batch, shard, _), (mine, *_) in zip(rows, opened, strict=True):
        yield _rows([(batch, shard, ANCHORS, pack(state[at : at + len(mine)]))])
        at += len(mine)


def _send_passages(shards: int):
    """Segments of recurring minimisers, each distinct one of a batch once, and the batch's own notes
    (kind OWN) of where each is."""

    def send(batch: int, blob: bytes, replies: pd.DataFrame) -> pd.DataFrame:
        claim("substring_passages")
        ids, null, texts = open_texts(blob)
        mine = Batch(taught(null, texts), ids)
        if not len(mine.start):
            return _rows([])
        _, _, of, _, _ = mine.anchors(shards)
        state = np.concatenate([unpack(b, np.uint8)[0] for b in replies.sort_values("shard")["blob"]])[of]
        whole, hot = np.flatnonzero(state == 1), np.flatnonzero(state == 2)
        single = _ranges(mine.start[hot], mine.count[hot])
        start = np.concatenate((mine.start[whole], single))
        count = np.concatenate((mine.count[whole], np.ones(len(single), np.int64)))
        key = np.concatenate((mine.key[whole], phrase_hashes(mine.hashes, WINDOW)[single] if len(single) else np.zeros(0, np.uint64)))
        raw, doc = mine.words, mine.doc[start]
        numbers = Numbers()
        ends = (start + count + WINDOW - 1).tolist()
        rep = np.fromiter((numbers[raw[a:b].tobytes()] for a, b in zip(start.tolist(), ends, strict=True)), np.int64, len(start))
        if not len(rep):
            return _rows([])
        by = np.lexsort((doc, rep))
        lead = np.flatnonzero(np.concatenate(([True], rep[by][1:] != rep[by][:-1])))
        low, high, first = np.minimum.reduceat(doc[by], lead), np.maximum.reduceat(doc[by], lead), by[lead]
        out = [(batch, batch % shards, OWN, pack(start, count, rep))]
        shard = (key[first] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        for s, a, b in _cuts(shard[order]):
            these = order[a:b]
            said = b"\n".join([b" ".join([mine.vocabulary[w] for w in raw[start[i] : ends[i]].tolist()]) for i in first[these].tolist()])
            part = key[first[these]] // np.uint64(shards) % np.uint64(PARTS)
            out.append((batch, s, PASSAGES, pack(said, these.astype(np.int32), part.astype(np.uint8), low[these], high[these])))
        return _rows(out)

    def group(texts: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        return send(int(texts["batch"].iloc[0]), texts["blob"].iloc[0], replies) if len(texts) and len(replies) else _rows([])

    return group


def compile_automaton(spelled: list[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, word in enumerate(spelled):
        automaton.add_word(word, i)
    automaton.make_automaton()
    return automaton


class Alphabet:
    """Two letters for each word, so that no node of an automaton has many children."""

    def __init__(self, size: int):
        self.base = int(np.ceil(np.sqrt(max(1, size))))

    def spell(self, codes: np.ndarray) -> str:
        """Words by number; -1 is a gap that matches nothing."""
        pair = np.stack((codes // self.base, self.base + codes % self.base), -1) + 1
        pair = np.where((codes < 0)[:, None], 0, pair)
        return (pair + 0x800 * (pair >= 0xD800)).astype("<u4").tobytes().decode("utf-32-le")


def locate(passages: list[list[int]], low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """For each window of distinct passages (lists of word numbers) the smallest document that an
    automaton finds it in, or NEVER. Documents low to high hold a passage.

    Patterns are the passages that several documents hold, and the windows that another passage of a
    smaller document shares; the automaton streams all passages.
    """
    sizes = np.fromiter(map(len, passages), np.int64, len(passages))
    words = np.fromiter((w for p in passages for w in p), np.int64, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    windows = sizes - WINDOW + 1
    at = _ranges(first, windows)
    of = np.repeat(np.arange(len(passages)), windows)
    rows = np.ascontiguousarray(words[at[:, None] + np.arange(WINDOW)].astype(np.int32))
    whole = rows.view(f"V{4 * WINDOW}").ravel()
    by = np.argsort(whole, kind="stable")  # by all their words
    lead = np.flatnonzero(np.concatenate(([True], (rows[by][1:] != rows[by][:-1]).any(1))))
    least, most = np.minimum.reduceat(low[of[by]], lead), np.maximum.reduceat(low[of[by]], lead)
    shared = np.flatnonzero(least < most)
    recurring = np.flatnonzero(low < high)
    alphabet = Alphabet(int(words.max()) + 1)
    text = alphabet.spell(words)
    starts, lengths = np.concatenate((first[recurring], at[by[lead[shared]]])), np.concatenate((sizes[recurring], np.full(len(shared), WINDOW)))
    earliest = np.concatenate((low[recurring], least[shared]))
    # of equal patterns the earliest document counts
    patterns: dict[str, int] = {}
    for i, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
        word = text[2 * a : 2 * (a + n)]
        if word not in patterns or earliest[i] < earliest[patterns[word]]:
            patterns[word] = i
    found = np.full(len(words), NEVER)
    if patterns:
        chosen = np.fromiter(patterns.values(), np.int64, len(patterns))
        automaton = compile_automaton(list(patterns))
        # a gap between two passages
        gapped = np.insert(words, first, -1)
        place = np.insert(np.arange(len(words)), first, -1)
        for a, b in _stretches(first + np.arange(len(first)), len(gapped)):
            hits = np.array(list(automaton.iter(alphabet.spell(gapped[a:b]))), np.int64).reshape(-1, 2)
            which = chosen[hits[:, 1]]
            begin, n = place[a + hits[:, 0] // 2] - lengths[which] + 1, lengths[which] - WINDOW + 1
            np.minimum.at(found, _ranges(begin, n), np.repeat(earliest[which], n))
    return np.split(found[at], np.cumsum(windows)[:-1])


def _stretches(starts: np.ndarray, end: int, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Stretches of whole passages, of about ``most`` words."""
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + most)))
        yield int(starts[a]), int(starts[b]) if b < len(starts) else end
        a = b


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each batch's passages the documents that make their windows go; its notes pass."""
    claim("substring_search")
    sent, known, of, low, high = [], Numbers(), [], [], []
    for rows in batches:
        yield _rows([r for r in zip(rows["batch"], rows["shard"], rows["kind"], rows["blob"], strict=True) if r[2] == OWN])
        for batch, shard, kind, blob in zip(rows["batch"], rows["shard"], rows["kind"], rows["blob"], strict=True):
            if kind != PASSAGES:
                continue
            raw, ref, part, least, most = unpack(blob, bytes, np.int32, np.uint8, np.int64, np.int64)
            which = np.fromiter(map(known.__getitem__, raw.split(b"\n")), np.int64, len(ref))
            sent.append((batch, shard, ref, which))
            of.append(part)
            low.append(least)
            high.append(most)
    if not sent:
        return
    which = np.concatenate([w for *_, w in sent])
    part, least, most = np.zeros(len(known), np.uint8), np.full(len(known), NEVER), np.full(len(known), np.iinfo(np.int64).min)
    part[which] = np.concatenate(of)  # equal passages have equal minimisers
    np.minimum.at(least, which, np.concatenate(low))
    np.maximum.at(most, which, np.concatenate(high))
    passages, found = list(known), {}
    known.clear()
    for group in _groups(part, np.fromiter((p.count(b" ") + 1 for p in passages), np.int64, len(passages))):
        numbers = Numbers()
        for i, windows in zip(group.tolist(), locate([[numbers[w] for w in passages[i].split(b" ")] for i in group.tolist()], least[group], most[group]), strict=True):
            if (windows < NEVER).any():
                found[i] = windows.copy()
    for batch, shard, ref, which in sent:
        go = np.fromiter(map(found.__contains__, which.tolist()), bool, len(which))
        if go.any():
            parts = [found[i] for i in which[go].tolist()]
            yield _rows([(batch, shard, PASSAGES, pack(ref[go], np.fromiter(map(len, parts), np.int64, len(parts)), np.concatenate(parts)))])


def _groups(part: np.ndarray, words: np.ndarray) -> Iterator[np.ndarray]:
    """Passages of whole parts, in groups of about AUTOMATON words."""
    order = np.argsort(part, kind="stable")
    held, size = [], 0
    for _, a, b in _cuts(part[order].astype(np.int64)):
        more = int(words[order[a:b]].sum())
        if held and size + more > AUTOMATON:
            yield np.concatenate(held)
            held, size = [], 0
        held.append(order[a:b])
        size += more
    if held:
        yield np.concatenate(held)


def _strip(texts: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
    """doc_id, n_words, n_removed and kept_text of a batch's documents."""
    if not len(texts):
        return pd.DataFrame({"doc_id": [], "n_words": [], "n_removed": [], "kept_text": []})
    ids, null, raw = open_texts(texts["blob"].iloc[0])
    lists = [t.split() for t in raw]
    counted = np.where(null, 0, np.fromiter(map(len, lists), np.int64, len(lists)))  # words that were compared
    gone = np.zeros(int(counted.sum()) + 1, np.int64)
    notes = replies[replies["kind"] == OWN]
    answers = replies[replies["kind"] == PASSAGES]
    if len(notes) and len(answers):
        start, count, rep = unpack(notes["blob"].iloc[0], np.int64, np.int64, np.int64)
        opened = [unpack(b, np.int32, np.int64, np.int64) for b in answers["blob"]]
        ref, sizes, earliest = (np.concatenate(x) for x in zip(*opened, strict=True))
        offset = np.full(rep.max() + 1, -1)
        offset[ref] = np.cumsum(sizes) - sizes
        hit = offset[rep] >= 0
        at = _ranges(start[hit], count[hit])
        at = at[earliest[_ranges(offset[rep[hit]], count[hit])] < np.repeat(ids, counted)[at]]
        np.add.at(gone, at, 1)
        np.add.at(gone, at + WINDOW, -1)
    gone = np.cumsum(gone)[:-1] > 0
    ends = np.cumsum(counted)
    n_words, n_removed, kept = [], [], []
    for words, known, end in zip(lists, counted.tolist(), ends.tolist(), strict=True):
        out = gone[end - known : end]
        removed = int(out.sum())
        n_words.append(len(words))
        n_removed.append(removed)
        kept.append(b" ".join([w for w, g in zip(words, out.tolist(), strict=True) if not g] if removed else words).decode("utf-8"))
    doc_id = pd.array(ids, "Int64")
    doc_id[null] = pd.NA
    return pd.DataFrame({"doc_id": doc_id, "n_words": n_words, "n_removed": n_removed, "kept_text": kept})


def remove_repeats(df: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (remaining words, joined by one space) of every row.

    Texts that are null, empty or shorter than a window keep all they have. Rows without an id keep
    their words and take none from others. Rows with one id never take from each other. Empty tables
    give no rows; other columns are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    shards = shuffle_partitions(spark)  # a shard is a partition, so shards grow with the input as partitions do
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    sent = settle(rows.mapInPandas(_send_anchors(shards), ROWS))
    texts = sent.where(F.col("kind") == TEXTS).select("batch", "blob")

    def by_shard(table: DataFrame, search) -> DataFrame:
        return table.repartitionById(shards, F.col("shard").cast("int")).mapInPandas(search, ROWS)

    recurring = by_shard(sent.where(F.col("kind") == ANCHORS), _find_recurring)
    passages = texts.groupBy("batch").cogroup(recurring.groupBy("batch")).applyInPandas(_send_passages(shards), ROWS)
    found = by_shard(passages, _search)
    return texts.groupBy("batch").cogroup(found.groupBy("batch")).applyInPandas(_strip, "doc_id long, n_words long, n_removed long, kept_text string")


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d WHERE len(words) >= 13)
), f AS (
  SELECT g, min(doc_id) AS least FROM w GROUP BY g
), r AS (
  SELECT doc_id, list_distinct(flatten(list(range(w.i, w.i + 13)))) AS gone FROM w JOIN f USING (g) WHERE f.least < w.doc_id GROUP BY doc_id
), k AS (
  SELECT d.doc_id, d.words, coalesce(r.gone, []) AS gone FROM d LEFT JOIN r ON r.doc_id = d.doc_id
), t AS (
  SELECT doc_id, words, gone, list_sort(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i))) AS stay FROM k
)
SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_transform(stay, lambda i: words[i]), ' '), '')) AS kept_sha256
FROM t
"""
