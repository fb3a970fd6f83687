"""Language identification by cross-parsing entropy with suffix automata.

For each language a suffix automaton is built over a bounded sample of labelled documents, one Spark task a language.
A text is parsed greedily into the longest phrases that occur in that sample; the language whose parse needs the fewest
phrases, weighed by the bits that a phrase costs (log2 of the sample's length), wins.  The transitions of all automata
lie in one hashed table, so that any alphabet fits; parsing is a walk through it, done in numpy for thousands of pieces
of text and all languages at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scorewright.llm._shared import give_back, short_batches

#: The bounded sample: distinct documents of each language, and the characters of a passage taken of each, at a place that
#: depends on the text's hash.  A language's automaton has at most twice their product of states.
SAMPLE_ROWS, PASSAGE = 24, 1500
#: Symbols of a piece; each piece of a text is parsed on its own, with one phrase more at most.
SEGMENT, LANES = 1024, 2048
UNKNOWN = "und"
_SPACE, _LETTERS = 1, 2
_FREE = np.int64(-1)
_SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def symbols_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of lower-cased texts, runs of other characters than letters as one space, and their number by text."""
    lower = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lower), np.int64, len(lower))
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.int32)
    out = np.where(letters()[points], points, _SPACE)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != _SPACE) | (out[:-1] != _SPACE)
    if len(texts) > 1:
        ends = np.cumsum(sizes)
        keep[(ends - sizes)[sizes > 0]] = True
        upto = np.concatenate(([0], np.cumsum(keep)))
        return out[keep], upto[ends] - upto[ends - sizes]
    return out[keep], np.array([keep.sum()] * len(texts), np.int64)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts all substrings; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
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


def transitions(text: str) -> tuple[np.ndarray, int]:
    """(state, symbol, next state) rows of the automaton of a sample, and the number of its symbols."""
    symbols = symbols_of([text])[0]
    step = suffix_automaton(symbols.tolist())
    return np.array([(s, c, to) for s, moves in enumerate(step) for c, to in moves.items()], np.int64).reshape(-1, 3), len(symbols)


class Table:
    """Transitions of all automata in one hashed table with two slots a key; states of a language follow those of the one before.

    Symbols are numbered by their order among those of all samples; 0 stands for all others, which no automaton takes.
    """

    def __init__(self, parts: dict[str, tuple[np.ndarray, int]]) -> None:
        self.langs = sorted(lang for lang, (moves, _) in parts.items() if len(moves))
        self.bits = np.array([np.log2(parts[lang][1] + 1) for lang in self.langs])
        self.alphabet = np.unique(np.concatenate([np.empty(0, np.int64), *[parts[lang][0][:, 1] for lang in self.langs]]))
        self.width = len(self.alphabet) + 1
        states = [int(parts[lang][0][:, [0, 2]].max()) + 1 for lang in self.langs]
        self.roots = np.cumsum([0, *states])[:-1].astype(np.int64)
        moves = [parts[lang][0] + [[base, 0, base]] for lang, base in zip(self.langs, self.roots)]
        moves = np.concatenate(moves) if moves else np.empty((0, 3), np.int64)
        moves[:, 1] = np.searchsorted(self.alphabet, moves[:, 1]) + 1
        #: Where a phrase begins: the state after one symbol; for one that the sample lacks, a state that leads nowhere.
        self.begin = np.full((self.width, len(self.langs)), sum(states))
        for k, root in enumerate(self.roots):
            own = moves[moves[:, 0] == root]
            self.begin[own[:, 1], k] = own[:, 2]
        keys, bits = moves[:, 0] * self.width + moves[:, 1], max(4, (9 * len(moves) // 4).bit_length())
        while not self._fill(keys, moves[:, 2], bits):
            bits += 1

    def _fill(self, keys: np.ndarray, to: np.ndarray, bits: int) -> bool:
        """Place every key in one of its two slots; the last to ask for a slot gets it, the one before moves to its other."""
        self.shift = np.uint64(64 - bits)
        slots = np.stack([self._slot(keys, by) for by in _SPREAD])
        owner, choice, left = np.full(1 << bits, -1), np.zeros(len(keys), np.int64), np.arange(len(keys))
        for _ in range(1000):
            if not len(left):
                self.keys, self.to = np.where(owner >= 0, np.append(keys, 0)[owner], _FREE), np.append(to, -1)[owner].astype(np.int32)
                return True
            at = slots[choice[left], left]
            before = owner[at]
            owner[at] = left
            left = np.concatenate([left[owner[at] != left], np.unique(before[before >= 0])])
            choice[left] ^= 1
        return False

    def _slot(self, keys: np.ndarray, by: np.uint64) -> np.ndarray:
        return ((keys.view(np.uint64) * by) >> self.shift).view(np.int64)

    def walk(self, keys: np.ndarray) -> np.ndarray:
        """Next states of (state * width + symbol), -1 where there is no transition."""
        slot = self._slot(keys, _SPREAD[0])
        out = self.to.take(slot)
        miss = np.flatnonzero(self.keys.take(slot) != keys)
        other = keys[miss]
        slot = self._slot(other, _SPREAD[1])
        out[miss] = np.where(self.keys.take(slot) == other, self.to.take(slot), -1)
        return out

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by text and language, symbols by text)."""
        symbols, sizes = symbols_of(texts)
        at = np.searchsorted(self.alphabet, symbols)
        numbered = np.where(self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == symbols, at + 1, 0)
        lanes = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), lanes)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        starts = np.repeat(np.cumsum(sizes) - sizes, lanes) + within * SEGMENT
        lengths = np.minimum(SEGMENT, np.repeat(sizes, lanes) - within * SEGMENT)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        order = np.argsort(-lengths, kind="stable")
        for lo in range(0, len(order), LANES):
            pick = order[lo : lo + LANES]
            first, length = starts[pick], lengths[pick]
            live = np.searchsorted(-length, -np.arange(int(length[0])), side="left")  # lanes longer than each place
            state, n = self.begin[numbered[first]], np.ones((len(pick), len(self.langs)), np.int32)
            for place, m in enumerate(live[1:].tolist(), 1):
                symbol = numbered[first[:m] + place]
                next_ = self.walk((state[:m] * self.width + symbol[:, None]).ravel()).reshape(m, -1)
                new = next_ < 0  # a phrase begins
                n[:m] += new
                np.copyto(next_, self.begin.take(symbol, 0), where=new)
                state[:m] = next_
            np.add.at(out, owner[pick], n)
        return out, sizes

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        live = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not live or not self.langs:
            return langs, scores
        counts, _ = self.phrases([texts[i] for i in live])
        cost = counts * self.bits
        best = np.argsort(cost, axis=1, kind="stable")
        for j, i in enumerate(live):
            langs[i] = self.langs[best[j, 0]]
            least = cost[j, best[j, 0]]
            scores[i] = 1.0 if len(self.langs) == 1 else 1 - least / max(cost[j, best[j, 1]], 1e-9)
        return langs, scores


class Model:
    """Samples by language and the table of their automata."""

    def __init__(self, samples: dict[str, str], parts: dict[str, tuple[np.ndarray, int]] | None = None) -> None:
        self.samples = samples
        self.table = Table(parts if parts is not None else {lang: transitions(text) for lang, text in samples.items()})


def fit(docs: DataFrame, learn: Column | None = None, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``rows`` distinct texts of each language (lowest hashes), of each a passage of PASSAGE characters.

    Rows without text or label, or for which ``learn`` is not true, are never seen.
    """
    fine = F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")
    labelled = docs.where(fine if learn is None else fine & learn).select(F.col(lang).alias("lang"), F.xxhash64(F.lit(7), text).alias("h"), F.col(text).alias("text"))
    distinct = labelled.select("lang", "h").distinct()
    first = distinct.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("n") <= rows).select("lang", "h")
    chosen = docs.sparkSession.createDataFrame(first.collect(), "lang string, h long")  # ``rows`` a language at most
    picked = labelled.join(F.broadcast(chosen), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text"))
    spare = F.greatest(F.char_length("text") - PASSAGE, F.lit(0))
    picked = picked.withColumn("text", F.substr("text", (F.pmod("h", spare + 1) + 1).cast("int"), F.lit(PASSAGE)))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        sample = " ".join(group.sort_values("h")["text"])
        moves, n = transitions(sample)
        give_back()
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "sample": [sample], "moves": [moves.astype(np.int32).tobytes()], "n": [n]})

    built = picked.groupBy("lang").applyInPandas(build, "lang string, sample string, moves binary, n long").collect()
    return Model({r["lang"]: r["sample"] for r in built}, {r["lang"]: (np.frombuffer(r["moves"], np.int32).astype(np.int64).reshape(-1, 3), r["n"]) for r in built})


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to every row of ``docs``, reading nothing but the whole text.

    A null text, or one without any letter, gets ``und`` and 0.  The score is 1 minus the ratio of the best and the
    second-best cost (ties: 0, to the smaller label); 1 with a single language.  Columns with clashing names are
    replaced, repeated rows are judged alike.
    """
    short_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model.table)  # bounded: three transitions at most a sampled symbol

    def one(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = shipped.value
        for batch in texts:
            langs, scores, part, size = [], [np.empty(0)], [], 0
            for t in batch.tolist():  # about a million characters at a time
                if size + len(t or "") > 1_000_000:
                    a, b = table.predict(part)
                    langs, scores, part, size = langs + a, [*scores, b], [], 0
                part.append(t)
                size += len(t or "")
            a, b = table.predict(part)
            yield pd.DataFrame({"lang_pred": pd.Series(langs + a, dtype=object), "score": np.concatenate([*scores, b])})
        give_back()

    judge = F.pandas_udf(one, "lang_pred string, score double")
    return docs.drop("lang_pred", "score").withColumn("_judged", judge(F.col(text))).select("*", "_judged.*").drop("_judged")
