"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is laid out as one dense transition table.
A text is parsed greedily into longest matches against each automaton; the language that needs the
fewest bits per character wins, where a phrase names a place in the language's own sample or a letter.
Texts are parsed whole: segments of SEGMENT characters advance through the tables side by side, and
then each is parsed on from where its predecessor really ended until both parses agree.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import claim, documents, holds, id_remainder, is_remainder, sub_batches, unused
from tessera.session import settle, ship

#: Bound of the labelled sample: about DOCS rows a language and CHARS in all; of a row LINE characters
#: of its letters, or more where the language would not come to CHARS.
DOCS, LINE, CHARS = 96, 600, 20_000
SEGMENT, LANES = 256, 4096
#: Languages up to which their shares of the sample are broadcast.
LANGUAGES = 10_000
#: Parses that go on one by one.
FEW = 48
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    points = np.arange(0x110000, dtype="<u4")
    points[0xD800:0xE000] = 0
    return np.char.isalpha(points.view("<U1"))


def squeeze(text: str) -> str:
    """Lower-case letters, with one space for each run of anything else."""
    return "".join(c if c.isalpha() else " " for c in text.lower()).strip()


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the start."""
    move: list[dict[str, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in text:
        new = len(move)
        move.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in move[p]:
            move[p][c] = new
            p = link[p]
        if p != -1:
            q = move[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                clone = len(move)
                move.append(dict(move[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p != -1 and move[p].get(c) == q:
                    move[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return move


class Parser:
    """Phrase counts of texts against all languages of a model, a dict of language to text."""

    def __init__(self, model: dict[str, str]):
        self.langs = sorted(model)
        seen = sorted({c for t in model.values() for c in t} - {" "})
        # 0 pads, 1 is a space, 2 a letter that no language has
        self.width = len(seen) + 3
        self.bits = np.array([[math.log2(len(model[k]) + self.width)] for k in self.langs])
        self.classes = np.where(_letters(), 2, 1).astype(np.uint16)
        for i, c in enumerate(seen):
            for form in {c, *(u for u in (c.upper(), c.title()) if len(u) == 1)}:
                if len(form.lower()) == 1 and form.lower() == c:
                    self.classes[ord(form)] = i + 3
        at = {" ": 1} | {c: i + 3 for i, c in enumerate(seen)}
        tables, self.roots, base = [], [], 0
        for lang in self.langs:
            moves = automaton(model[lang])
            root = np.full(self.width, base, dtype=np.int64)
            for c, t in moves[0].items():
                root[at[c]] = base + t
            # a missing move ends the phrase and starts the next one with this character, which is a
            # phrase of its own if no text of the language has it; the low bits count ended phrases
            alone = root == base
            table = np.tile(root * self.width * 4 + 1 + alone, (len(moves), 1))
            table[0, alone] -= 1
            for s, move in enumerate(moves):
                for c, t in move.items():
                    table[s, at[c]] = (base + t) * self.width * 4
            table[:, 0] = (base + np.arange(len(moves))) * self.width * 4
            tables.append(table)
            self.roots.append(base * self.width)
            base += len(moves)
        self.table = np.concatenate(tables).astype(np.int32 if base * self.width < 2**29 else np.int64).ravel() if tables else None
        self.flat = memoryview(self.table) if tables else None

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: phrases of each language, parsed characters, letters."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4")
        classes = self.classes[raw]
        owner = np.repeat(np.arange(len(texts)), lengths)
        letters = np.bincount(owner[classes > 1], minlength=len(texts))
        space = classes == 1
        stay = np.ones(len(classes), bool)
        if len(classes):
            stay[1:] = ~(space[1:] & space[:-1] & (owner[1:] == owner[:-1]))
        classes, owner = classes[stay], owner[stay]
        chars = np.bincount(owner, minlength=len(texts))
        starts = np.cumsum(chars) - chars
        place = np.arange(len(classes)) - starts[owner]
        parts = -(-chars // SEGMENT)
        lane = (np.cumsum(parts) - parts)[owner] + place // SEGMENT
        grid = np.zeros((SEGMENT, int(parts.sum())), np.uint16)
        grid[place % SEGMENT, lane] = classes
        of = np.repeat(np.arange(len(texts)), parts)
        root = np.array(self.roots, self.table.dtype)[:, None]
        last = np.repeat(root, grid.shape[1], 1)  # states in which the segments end
        ends = np.zeros(last.shape, np.int64)
        for a in range(0, grid.shape[1], LANES):
            cols = np.ascontiguousarray(grid[:, a : a + LANES]).astype(self.table.dtype)
            state, some = last[:, a : a + LANES].copy(), np.zeros((len(root), cols.shape[1]), self.table.dtype)
            for row in cols:
                state += row
                step = self.table.take(state)
                some += step & 3
                state = step >> 2
            ends[:, a : a + LANES], last[:, a : a + LANES] = some, state
        self._join(grid, of, root, last, ends)
        ends[:, np.append(of[1:] != of[:-1], True)[: len(of)]] += (last != root)[:, np.append(of[1:] != of[:-1], True)[: len(of)]]
        phrases = np.stack([np.bincount(of, weights=e, minlength=len(texts)) for e in ends])
        return phrases, chars, letters

    def _join(self, grid: np.ndarray, of: np.ndarray, root: np.ndarray, last: np.ndarray, ends: np.ndarray) -> None:
        """Corrects ``last`` and ``ends`` of segments parsed from the root: a segment starts in the state in
        which its predecessor ends, and from where both parses are in one state they are the same."""
        used = np.repeat(root, grid.shape[1], 1)
        follows = np.zeros(grid.shape[1] + 1, bool)
        follows[1:-1] = of[1:] == of[:-1]
        lang, lane = np.nonzero(follows[:-1] & (np.roll(last, 1, axis=1) != root))
        true, old = last[lang, lane - 1], used[lang, lane]
        used[lang, lane] = true
        at = 0
        while at < SEGMENT and len(lang) > FEW:
            chars = grid[at, lane].astype(self.table.dtype)
            a, b = self.table.take(true + chars), self.table.take(old + chars)
            ends[lang, lane] += (a & 3).astype(np.int64) - (b & 3)  # each pair occurs once
            apart = a >> 2 != b >> 2
            lang, lane, true, old = lang[apart], lane[apart], a[apart] >> 2, b[apart] >> 2
            at += 1
        # the few that are still apart go one by one
        moved = []
        for i, k, t, r in zip(lang.tolist(), lane.tolist(), true.tolist(), old.tolist(), strict=True):
            t, r, gain = self._walk(grid[at:, k].tolist(), t, r)
            ends[i, k] += gain
            if t != r:
                last[i, k] = t
                moved.append((k, i))
        for k, i in sorted(moved):
            t, k = int(last[i, k]), k + 1
            while follows[k] and t != used[i, k]:
                old, used[i, k] = int(used[i, k]), t
                t, r, gain = self._walk(grid[:, k].tolist(), t, old)
                ends[i, k] += gain
                if t == r:
                    break
                last[i, k] = t
                k += 1

    def _walk(self, chars: list[int], t: int, r: int) -> tuple[int, int, int]:
        """Both states after the characters, or where they meet, and how many more phrases the first has ended."""
        gain, table = 0, self.flat
        for c in chars:
            a, b = table[t + c], table[r + c]
            gain += (a & 3) - (b & 3)
            t, r = a >> 2, b >> 2
            if t == r:
                break
        return t, r, gain

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        for a, b in sub_batches(texts, 500_000):
            phrases, chars, letters = self.counts(texts[a:b])
            bits = phrases * self.bits / np.maximum(chars, 1)
            best = bits.argmin(0)
            weight = np.exp2(8 * (bits.min(0) - bits))
            score = 1 / weight.sum(0)
            for i in np.flatnonzero(letters):
                langs[a + i], scores[a + i] = self.langs[best[i]], float(score[i])
        return langs, scores


@lru_cache(maxsize=1)
def _parser(model: tuple) -> Parser:
    return Parser(dict(model))


holds("language_id", _parser.cache_clear)


def _stretch(most: Column) -> Column:
    """At most so many characters of the text, from anywhere in it, by its draw."""
    spare = F.greatest(F.length("text") - most, F.lit(0)) + 1
    return F.substring(F.col("text"), (F.pmod("draw", spare) + 1).cast("int"), most)


def fit(rows: DataFrame) -> dict[str, str]:
    """Labelled text of each language, from columns doc_id, lang and text.

    The sample is bounded by DOCS, LINE and CHARS for each language; rows are drawn by a hash of their id.
    Rows without an id, a language or a letter teach nothing.
    """
    known = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = known.select("lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("draw"), F.col("text"))
    share = known.groupBy("lang").agg((F.lit(float(DOCS << 30)) / F.count(F.lit(1))).alias("most"))
    share = settle(share)
    few = share.count() <= LANGUAGES
    drawn = known.join(F.broadcast(share) if few else share, "lang").where(F.col("draw") < F.col("most"))
    letters = F.trim(F.regexp_replace("text", r"[^\p{L}]+", " "))
    drawn = drawn.select("lang", "draw", letters.alias("text")).select("lang", "draw", _stretch(F.lit(CHARS)).alias("text"))
    # rows from short to long: the level to which all can be cut so that CHARS remain
    ascending = Window.partitionBy("lang").orderBy(F.length("text"), "draw", "text")
    before = F.coalesce(F.sum(F.length("text") + 1).over(ascending.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.count(F.lit(1)).over(Window.partitionBy("lang")) - F.row_number().over(ascending) + 1
    level = F.max("level").over(Window.partitionBy("lang"))
    cut = drawn.withColumn("level", F.ceil((CHARS - before) / left)).withColumn("level", F.greatest(level, F.lit(LINE)).cast("int"))
    texts: dict[str, list] = {}
    for lang, draw, text in cut.select("lang", "draw", _stretch(F.col("level"))).collect():
        texts.setdefault(lang, []).append((draw, squeeze(text)))
    whole = {k: " ".join(t for _, t in sorted(v) if t)[:CHARS] for k, v in texts.items()}
    return {k: t for k, t in whole.items() if t}


def predictor(model: dict[str, str]):
    """A vectorised function of a text column that returns struct<lang_pred, score>."""
    key = tuple(sorted(model.items()))

    def predict(texts: pd.Series) -> pd.DataFrame:
        claim("language_id")
        langs, scores = _parser(key).predict([t if t is not None else "" for t in texts])
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return F.pandas_udf(predict, "lang_pred string, score double")


def identify(df: DataFrame, model: dict[str, str], name: str = "__lang") -> DataFrame:
    """``df`` with a struct column ``name`` of lang_pred and score.

    Null, empty and letterless texts are `und` with score 0, as is everything if the model is
    empty. Ties go to the language that comes first by code point. Repeated rows get equal results,
    empty tables give no rows, and columns of other names pass through.
    """
    ship(df.sparkSession)
    return df.withColumn(name, predictor(model)(F.col("text")))


def keep_identified(df: DataFrame) -> DataFrame:
    """The rows whose text has a language, with the columns as they were; a null lang becomes the
    language found. Without any labelled text nothing can be told, and all rows stay as they are."""
    learn = df.where(F.coalesce(id_remainder("doc_id", 5) != 0, F.lit(False)))
    model = fit(learn.select("doc_id", "lang", "text"))
    if not model:
        return df
    name = unused(df, "__lang")
    found = identify(df, model, name).where(F.col(f"{name}.lang_pred") != UNDETERMINED)
    return found.withColumn("lang", F.coalesce("lang", f"{name}.lang_pred")).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learn = docs.where(F.coalesce(id_remainder("doc_id", 5) != 0, F.lit(False)))
    model = fit(learn.select("doc_id", "lang", "text"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", is_remainder("doc_id", 5, 0).alias("held_out"), "__lang.lang_pred", "__lang.score")
