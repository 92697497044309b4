"""Language identification by cross-parsing: how few phrases of a language's labelled text make up this text?

Each language has a suffix automaton of a bounded sample of its labelled rows; it accepts exactly that sample's
substrings. A text is parsed greedily into longest matches, and the language whose parse needs the fewest phrases, each
priced at the bits of a position in its sample, wins. Texts are letters in lower case, with one blank for all between;
a letter that a sample lacks is a phrase of its own.

Whole texts are parsed. To step through many places at once, a text is cut into lanes: all lanes are parsed from their
starts, and then from where the last phrase of the lane before ends up to where both parses meet. Greedy parses from two
places soon meet, so after that nearly every lane is known; the others are parsed one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import combed, is_held_out, slices, table

#: The labelled rows that a language's automaton is made of: at most TEXTS, and no further one once they hold LETTERS.
TEXTS, LETTERS = 64, 16_000
#: Distinct values of lang that are taken for languages; more are refused.
LANGUAGES = 1_000
#: Letters of a lane. It changes speed alone.
LANE = 256
#: Bits a letter beyond which no learned language explains a text (for filters).
MOST_BITS = 6.5
#: Columns that are added.
NEW = ("lang_pred", "score", "bits", "phrases")

_LOW = (1 << 32) - 1


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings, for each state by symbol. State 0 is the start."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class Parser:
    """The automata of all languages in one table. samples: (language, text) pairs, one for each language."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.languages = [x for x, _ in samples]
        seen = sorted({c for _, text in samples for c in text.lower() if c.isalpha()})
        self.unknown = len(seen) + 1  # blank is 0, letters that no sample has are one symbol
        self.symbol = np.where(_letters(), self.unknown, 0).astype(np.int32)
        self.symbol[[ord(c) for c in seen]] = np.arange(1, len(seen) + 1)
        steps, self.start, root, bits = [], [], [], []
        for _, text in samples:
            symbols = self.squeezed([text])[0].tolist()
            first = len(steps)
            own = suffix_automaton(symbols)
            # a phrase begins with the step from the start, which is not in the table, so that beginnings are misses there
            root.append([first + own[0].get(c, 0) for c in range(self.unknown + 1)])
            steps += [{}] + [{c: n + first for c, n in row.items()} for row in own[1:]]
            self.start.append(first)
            bits.append(np.log2(len(symbols) + 2))
        self.bits = np.array(bits)
        self.base, self.table = combed(steps) if steps else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.table = np.concatenate((self.table, np.full(self.unknown + 1, -1)))
        self.root = np.array(root, np.int64).ravel()
        self.lists = None

    def squeezed(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts one after the other, and each text's count; one blank for any run of non-letters."""
        each = [points(t or "") for t in texts]
        size = np.array([len(x) for x in each])
        s = self.symbol[np.concatenate(each)] if size.sum() else np.zeros(0, np.int32)
        owner = np.repeat(np.arange(len(each)), size)
        keep = s > 0
        keep[1:] |= (s[:-1] > 0) & (owner[1:] == owner[:-1])
        return s[keep], np.bincount(owner[keep], minlength=len(each))

    def lanes(self, s: np.ndarray, language: np.ndarray, begin: np.ndarray, end: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Phrases of parses from begin that begin before end; nth[language, place] becomes the number of the one that begins there."""
        order = np.argsort(begin - end, kind="stable")  # long ones first
        begin, language, size = begin[order], language[order], (end - begin)[order]
        state, count, row = np.array(self.start)[language], np.zeros(len(begin), np.int32), language * (self.unknown + 1)
        flat, place = nth.ravel(), language * len(s) + begin
        running = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
        for k, m in enumerate(running):
            c = s[begin[:m] + k]
            got = self.table[self.base[state[:m]] + c]
            new = np.flatnonzero(got >> 32 != state[:m])
            got &= _LOW
            got[new] = self.root[row[new] + c[new]]
            state[:m] = got
            count[new] += 1
            flat[place[new] + k] = count[new]
        out = np.empty(len(order), np.int32)
        out[order] = count
        self.states = np.empty(len(order), np.int64)
        self.states[order] = state
        return out

    def onward(self, s: np.ndarray, language: np.ndarray, state: np.ndarray, begin: np.ndarray, end: np.ndarray, limit: np.ndarray, nth: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Goes on from begin in these states: (phrases that begin before end, where the parse stops, whether that is a known beginning).

        A parse stops where a phrase begins at or behind end, at limit, or where nth knows a beginning; -1: not within LANE letters.
        """
        count, stop, known = np.zeros(len(begin), np.int64), np.full(len(begin), -1), np.zeros(len(begin), bool)
        go, at, row = np.arange(len(begin)), begin.copy(), language * (self.unknown + 1)
        for _ in range(LANE):
            over = at >= limit[go]
            stop[go[over]] = at[over]
            go, at, state, row = go[~over], at[~over], state[~over], row[~over]
            if not len(go):
                break
            c = s[at]
            got = self.table[self.base[state] + c]
            new = got >> 32 != state
            out = new & (at >= end[go])
            if nth is not None:
                met = new & ~out & (nth[language[go], at] > 0)
                known[go[met]] = True
                out |= met
            stop[go[out]] = at[out]
            count[go[new & ~out]] += 1
            state = np.where(new, self.root[row + c], got & _LOW)
            go, at, state, row = go[~out], at[~out] + 1, state[~out], row[~out]
        return count, stop, known

    def one(self, s: list[int], language: int, begin: int, end: int, limit: int) -> tuple[int, int]:
        """The same for one parse, to its end."""
        if self.lists is None:
            self.lists = self.base.tolist(), self.table.tolist(), self.root.tolist()
        base, table_, root = self.lists
        state, count, row, at = self.start[language], 0, language * (self.unknown + 1), begin
        while at < limit:
            got = table_[base[state] + s[at]]
            if got >> 32 == state:
                state = got & _LOW
            else:
                if at >= end:
                    break
                state, count = root[row + s[at]], count + 1
            at += 1
        return count, at

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, languages) phrases needed, and each text's number of symbols, and of letters that no sample has."""
        s, size = self.squeezed(texts)
        n, none = len(self.languages), np.bincount(np.repeat(np.arange(len(texts)), size)[s == self.unknown], minlength=len(texts))
        per = -(-size // LANE)
        owner = np.repeat(np.arange(len(texts)), per)
        if not n or not len(owner):
            return np.zeros((len(texts), n), np.int64), size, none
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        stop = np.cumsum(size)[owner]
        start = stop - size[owner] + nth * LANE
        end, first = np.minimum(start + LANE, stop), nth == 0
        entry = np.repeat(start[None, :], n, 0)
        grid = lambda x: np.broadcast_to(x, (n, len(owner))).ravel()
        language = np.repeat(np.arange(n), len(owner))
        begins = np.zeros((n, len(s)), np.int16)  # at most LANE
        count = self.lanes(s, language, grid(start), grid(end), begins).reshape(n, -1).astype(np.int64)
        _, leave, _ = self.onward(s, language, self.states, grid(end), grid(end), grid(stop))
        leave = leave.reshape(n, -1)
        # from where the lane before ends up to where both parses meet; a lane that a phrase passes over has none of its own
        real = np.concatenate((entry[:, :1], leave[:, :-1]), 1)
        real[:, first] = start[first]
        a, b = np.nonzero((real != entry) & (real >= 0) & (real < end))
        more, at, met = self.onward(s, a, np.array(self.start)[a], real[a, b], end[b], stop[b], begins)
        entry = np.where(real >= 0, real, entry)
        over = entry >= end
        count[over], leave[over] = 0, entry[over]
        count[a, b] = np.where(met, more + count[a, b] - begins[a, np.minimum(at, len(s) - 1)] + 1, more)
        leave[a, b] = np.where(met, leave[a, b], at)
        # what still does not begin where the lane before ends, one lane after the other
        real = np.concatenate((entry[:, :1], leave[:, :-1]), 1)
        real[:, first] = start[first]
        for k, i in sorted({(int(k), int(owner[b])) for k, b in zip(*np.nonzero((real != entry) | (leave < 0)), strict=True)}):
            a, b = np.searchsorted(owner, (i, i + 1))
            at, low = int(start[a]), int(start[a])
            own = s[low : stop[a]].tolist()
            for j in range(a, b):
                if at >= end[j]:
                    count[k, j] = 0
                elif at != entry[k, j] or leave[k, j] < 0:
                    count[k, j], at = self.one(own, k, at - low, int(end[j]) - low, len(own))
                    at += low
                else:
                    at = int(leave[k, j])
        return np.stack([np.bincount(owner, c, len(texts)) for c in count], 1).astype(np.int64), size, none

    def best(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language or und, score, bits a symbol, phrases) of each text. Ties go to the first language by name.

        A letter that no sample has costs the same in all languages.
        """
        count, size, none = self.phrases(texts)
        if not self.languages:
            return ["und"] * len(texts), *(np.zeros(len(texts)) for _ in range(2)), np.zeros(len(texts), np.int64)
        bits = ((count - none[:, None]) * self.bits + none[:, None] * self.bits.max()) / np.maximum(1, size)[:, None]
        k = bits.argmin(1)
        least = bits[np.arange(len(k)), k]
        score = 1 / np.exp(-(bits - least[:, None]) * np.sqrt(size)[:, None]).sum(1)
        empty = size == 0
        return ["und" if x else self.languages[j] for x, j in zip(empty, k, strict=True)], np.where(empty, 0.0, score), np.where(empty, 0.0, least), np.where(empty, 0, count[np.arange(len(k)), k])


@lru_cache(2)
def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


def learn(docs: DataFrame) -> tuple[tuple[str, str], ...]:
    """The whole texts of a bounded sample of rows for each language, from docs(doc_id, text, lang) that are not held out.

    The rows with the least hashes of doc_id, those of more than LETTERS last; null and empty texts and null lang are
    left out. At least one row of each language is taken, however long.
    """
    known = docs.where(~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    known = known.select("lang", F.length("text").alias("n"), F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("x"))
    order = [F.col("n") > LETTERS, "h", "x", "n"]
    ranked = known.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= TEXTS)
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    chosen = ranked.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < LETTERS).groupBy("lang", "h", "x").agg(F.min("rank").alias("rank"))
    if chosen.select("lang").distinct().count() > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values")
    texts = docs.where(~is_held_out(F.col("doc_id"))).withColumns({"h": F.xxhash64("doc_id"), "x": F.xxhash64("text")}).join(F.broadcast(chosen), ["lang", "h", "x"])
    one = texts.groupBy("lang", "rank").agg(F.min("text").alias("text"))
    joined = one.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x.text), " ").alias("text"))
    return tuple(sorted((r.lang, r.text) for r in joined.collect()))


def languages(docs: DataFrame, samples: tuple[tuple[str, str], ...]) -> DataFrame:
    """docs with lang_pred, score (0 to 1), bits (a letter, by the winner) and phrases added; clashing columns are replaced.

    Null texts and texts without letters are `und` with score 0, as is every text if no language was learned.
    Repeated rows stay, empty tables stay empty.
    """
    known = docs.sparkSession.sparkContext.broadcast(samples)
    docs = docs.drop(*NEW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(known.value)
        for batch in slices(batches, "text", (4 << 20) // max(4, len(p.languages))):
            name, score, bits, phrases = p.best(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name, pa.string()), pa.array(score), pa.array(bits), pa.array(phrases)], [*batch.schema.names, *NEW])

    schema = docs.selectExpr("*", "'' AS lang_pred", "0D AS score", "0D AS bits", "0L AS phrases").schema
    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = languages(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
