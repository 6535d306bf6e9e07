"""Language identification by cross-parsing.

Every language has a suffix automaton of some of its labelled text. A text is parsed from left to right
into the longest phrases that occur in that labelled text. The fewer phrases, weighted by the bits one
phrase costs, the nearer the language. Many texts are parsed side by side in numpy, and what the longest
go on with, when few are left, one by one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm.arrow import bounded_batches, in_batches, once_per_worker

SAMPLES = 64  # texts per language whose middles are learned from
SNIPPET = 1500  # code points taken from each of them
LANGUAGE_CHARS = 32_768  # most that is learned per language
ALL_CHARS = 262_144  # and over all languages
HELD_OUT = 2  # remainder of crc32 modulo 4
UNKNOWN = "und"
COLUMNS = 200  # letters with a column in the tables; the edges of all others are looked up one by one
LANES = 32  # texts that are parsed side by side; fewer are parsed one by one


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept out of the learning; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> dict[str, list[str]]:
    """Middles of at most SAMPLES different texts per language, the same ones in every run.

    Two passes: the least hash per language and slot, which is a small table however many rows there
    are, then the texts with those hashes. Copies of a text share a hash and are learned once.
    """
    rows = docs.filter(~held_out(id_col)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash")
    ).filter("lang IS NOT NULL AND text <> ''")
    slots = rows.groupBy("lang", F.pmod("hash", F.lit(SAMPLES)).alias("slot")).agg(F.min("hash").alias("hash"))
    chosen = [r["hash"] for r in slots.select("hash").distinct().collect()]
    middle = F.greatest(F.lit(1), (F.length("text") / 2).cast("int") - SNIPPET // 2)
    texts = rows.filter(F.col("hash").isin(chosen)).select("lang", "hash", F.substring("text", middle, F.lit(SNIPPET)).alias("text"))
    sample: dict[str, list[str]] = {}
    for r in texts.groupBy("lang", "hash").agg(F.min("text").alias("text")).orderBy("lang", "hash").collect():
        sample.setdefault(r["lang"], []).append(r["text"])
    return sample


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the root."""
    edges: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in symbols:
        new = len(edges)
        edges.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p != -1:
            q = edges[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p != -1 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return edges


class Model:
    """One table of transitions for the automata of all languages.

    The most frequent letters have columns in it. The edges of other letters are few and kept by state
    and symbol, so that an alphabet of thousands of letters makes no wide table and loses no letter.
    """

    def __init__(self, sample: dict[str, list[str]]):
        self.languages = sorted(sample)
        limit = min(LANGUAGE_CHARS, ALL_CHARS // max(1, len(self.languages)))
        texts = [" ".join(sample[k]).lower() for k in self.languages]
        counts: dict[str, int] = {}
        for text in texts:
            for c in text:
                if c.isalpha():
                    counts[c] = counts.get(c, 0) + 1
        alphabet = sorted(sorted(counts), key=counts.get, reverse=True)
        self.width = min(len(alphabet), COLUMNS) + 1  # the space and the letters with columns
        self.unseen = len(alphabet) + 1  # any letter that no language has
        self.symbol = np.where(_letters(), self.unseen, 0).astype(np.int32)
        for i, c in enumerate(alphabet):
            self.symbol[ord(c)] = i + 1
        tables, roots, self.bits, offset = [], [], [], 0
        self.rare: dict[tuple[int, int], int] = {}
        for text in texts:
            symbols = self.symbols(text)[0].tolist()[:limit]
            edges = suffix_automaton(symbols)
            table = np.full((len(edges), self.width), -1, np.int32)
            for state, out in enumerate(edges):
                for c, to in out.items():
                    if c < self.width:
                        table[state, c] = (offset + to) * self.width
                    else:
                        self.rare[(offset + state) * self.width, c] = (offset + to) * self.width
            roots.append(offset * self.width)
            tables.append(table)
            self.bits.append(np.log2(max(2, len(symbols))))
            offset += len(edges)
        self.table = np.concatenate(tables).reshape(-1) if tables else np.empty(0, np.int32)
        self.roots = np.array(roots, np.int32)

    def symbols(self, text: str) -> tuple[np.ndarray, int]:
        """Symbols of a text, runs of other characters made one space, and how many are letters."""
        codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        s = self.symbol[codes]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        return s[keep], int(np.count_nonzero(s))

    def _edges(self, states: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where the states (a row per language) go with the symbols, -1 for nowhere."""
        if (narrow := c < self.width).all():
            return self.table[states + c]
        to = self.table[states + np.where(narrow, c, 0)]
        for at in np.flatnonzero(~narrow).tolist():
            to[:, at] = [self.rare.get((s, int(c[at])), -1) for s in states[:, at].tolist()]
        return to

    def _rest(self, symbols: list[int], state: int, root: int) -> int:
        """Phrases that begin in the rest of one text, parsed from a state on."""
        table, width, rare, count = memoryview(self.table), self.width, self.rare.get, 0
        for c in symbols:
            to = table[state + c] if c < width else rare((state, c), -1)
            if to < 0:
                count += 1
                if state != root:
                    to = table[root + c] if c < width else rare((root, c), -1)
                state = to if to >= 0 else root
            else:
                if state == root:
                    count += 1
                state = to
        return count

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases per text and language; a symbol that a language lacks is a phrase.

        A phrase begins where the state before a symbol is the root, or the symbol leads nowhere.
        """
        out = np.zeros((len(self.languages), len(texts)), np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        most = int(lengths[min(LANES, len(order)) - 1]) if len(order) else 0  # as long as LANES texts go on
        if not self.languages or not lengths.sum():
            return out.T
        flat = np.concatenate([texts[i] for i in order.tolist()])
        start = np.cumsum(lengths) - lengths
        active = np.searchsorted(-lengths, -np.arange(most), side="left")  # texts longer than j
        roots = self.roots[:, None]
        state = np.repeat(roots, len(order), axis=1)
        count = np.zeros(state.shape, np.int64)
        for j in range(most):
            n = active[j]
            c = flat[start[:n] + j]
            here = state[:, :n]
            to = self._edges(here, c)
            begins = here == roots
            miss = to < 0
            if miss.any():
                begins |= miss
                first = self._edges(np.broadcast_to(roots, here.shape), c)
                to = np.where(miss, np.where(first < 0, roots, first), to)
            count[:, :n] += begins
            state[:, :n] = to
        for at in range(int(np.searchsorted(-lengths, -most, side="left"))):
            rest = flat[start[at] + most : start[at] + lengths[at]].tolist()
            for k, root in enumerate(self.roots.tolist()):
                count[k, at] += self._rest(rest, int(state[k, at]), root)
        out[:, order] = count
        return out.T

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score, and bits per symbol beyond the first phrase, of each text.

        The score is the runner-up's cost as a share of both costs: 0.5 is a tie, 1 is sure.
        """
        coded = [self.symbols(text or "") for text in texts]
        some = np.array([n > 0 for _, n in coded], bool)
        lengths = np.maximum(1, [len(s) for s, _ in coded])
        if not self.languages:
            some[:] = False
        cost = self.phrases([s if ok else s[:0] for (s, _), ok in zip(coded, some, strict=True)]) * np.array(self.bits)
        languages, scores, bits = [], [], []
        for ok, row, length in zip(some, cost, lengths, strict=True):
            if not ok:
                languages.append(UNKNOWN), scores.append(0.0), bits.append(0.0)
                continue
            best = int(np.argmin(row))
            second = float(np.min(np.delete(row, best))) if len(row) > 1 else float("inf")
            languages.append(self.languages[best])
            scores.append(1.0 if second == float("inf") else second / (second + float(row[best])))
            bits.append((float(row[best]) - self.bits[best]) / float(length))
        return languages, scores, bits


@once_per_worker
def _model(sample: tuple) -> Model:
    return Model({language: list(texts) for language, texts in sample})


def identified(docs: DataFrame, sample: dict[str, list[str]], keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns of every row with lang_pred, score and excess (bits per symbol beyond the first phrase).

    A text that is null or has no letters is ``und`` with score 0; so is everything when nothing was
    learned. Ties go to the language first in the alphabet. A kept column's name must not be one of
    the three. Only the text is looked at.
    """
    learned = tuple((k, tuple(v)) for k, v in sorted(sample.items()))

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        languages, scores, bits = _model(learned).predict(texts)
        return pa.RecordBatch.from_arrays([
            *batch.columns[:-1], pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64()),
        ], names=[*batch.schema.names[:-1], "lang_pred", "score", "excess"])

    bounded_batches(docs.sparkSession)
    chosen = docs.select(*keep, F.col(text_col).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(in_batches(predict), f"{fields}, lang_pred string, score double, excess double")


def language_predictions(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and excess of every row, learned from rows that aren't held out.

    A null id isn't held out. Repeated rows come out repeated; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return identified(rows, labelled_sample(docs, id_col, text_col, lang_col), ["doc_id", "held_out"])


def known_language(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """The rows whose text is in one of the learned languages, with their own columns.

    Rejected are texts without letters, and noise: texts that no language codes better than letters drawn
    at random would be, the phrase they begin with not counted. So the less text there is the more it
    takes, with no length at which the rule begins.
    """
    sample = labelled_sample(docs, id_col, text_col, lang_col)
    letters = {c for texts in sample.values() for t in texts for c in t.lower() if c.isalpha()}
    noise = float(np.log2(len(letters) + 1))
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = f"c{docs.columns.index(text_col)}"
    found = identified(rows, sample, rows.columns, at)
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("excess") < noise))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
