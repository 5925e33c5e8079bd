"""Language identification by cross-parsing: longest matches in suffix automata of labelled text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text

#: Bounds of the labelled sample: documents and symbols of each language.
SAMPLE_DOCS = 96
SAMPLE_SYMBOLS = 30_000
#: A document of the sample is cut after so many characters.
SAMPLE_DOC_CHARS = 4_000
#: Texts are parsed in blocks of so many symbols, side by side; no phrase crosses a block's end.
BLOCK = 512
#: Parts of a batch, in characters, that are parsed at once.
CHUNK = 1 << 20


def fold(held_part: Column) -> Column:
    return F.crc32(id_text(held_part)) % 5


def labelled_sample(docs: DataFrame, doc_id: str, text: str, lang: str) -> dict[str, list[str]]:
    """For each language, beginnings of documents in the order of their hash, at most SAMPLE_DOCS different ones.

    The least hashes are chosen before any text is shuffled, and each once, so that texts that repeat neither crowd out
    others nor decide whether a language is learned.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(F.col(doc_id)) != 0)).select(F.col(lang).cast("string").alias("l"), F.substring(F.col(text), 1, SAMPLE_DOC_CHARS).alias("t"))
    known = known.filter(F.length("t") >= 1).withColumn("h", F.xxhash64("t"))
    least = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    chosen = known.select("l", "h").distinct().withColumn("k", least).filter(F.col("k") <= SAMPLE_DOCS)
    # SAMPLE_DOCS rows of two numbers for each language
    ranked = known.join(F.broadcast(chosen), ["l", "h"]).groupBy("l", "k").agg(F.min("t").alias("t"))
    out: dict[str, list[str]] = {}
    for row in ranked.select("l", "k", "t").orderBy("l", "k").collect():
        out.setdefault(row["l"], []).append(row["t"])
    return out


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of each state of the smallest automaton that accepts every substring."""
    to: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for s in symbols:
        now = len(to)
        to.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in to[p]:
            to[p][s] = now
            p = link[p]
        if p >= 0:
            q = to[p][s]
            if size[q] == size[p] + 1:
                link[now] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(s) == q:
                    to[p][s] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return to


class CrossParser:
    """One automaton of each language as a table of moves.

    Symbol 0 stands for any run of characters that are no letters, 1 for a letter that no sample has, the last for
    padding. Where the samples have over LETTERS letters, the SINGLE most frequent have a symbol each, and the others
    are written as two or more digits, each with symbols of its own for every place. A language's table has columns for
    its own symbols, for all others (column 0) and for padding. A move is twice the next state, plus one where a phrase
    ends and the next begins with this symbol.
    """

    LETTERS, SINGLE = 250, 100

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        texts = {k: " ".join(samples[k]).lower() for k in self.languages}
        seen = Counter()
        for t in texts.values():
            seen.update(t)
        letters = sorted(c for c in seen if c.isalpha())
        self.code = np.zeros(0x110000, np.uint8)
        for plane in range(0, 0x30000, 0x10000):
            for c in range(plane, plane + 0x10000):
                if chr(c).isalpha():
                    self.code[c] = 1
        self.digits, self.radix = 0, 0
        if len(letters) > self.LETTERS:
            single = set(sorted(letters, key=lambda c: (-seen[c], c))[: self.SINGLE])
            others = [c for c in letters if c not in single]
            letters = sorted(single)
            self.digits = 2
            while self.digits * (radix := math.ceil(len(others) ** (1 / self.digits) + 1e-9)) > self.LETTERS - self.SINGLE:
                self.digits += 1
            self.radix = radix
            self.number = np.full(0x110000, -1, np.int32)
            self.number[[ord(c) for c in others]] = np.arange(len(others))
        for k, c in enumerate(letters, 2):
            self.code[ord(c)] = k
        self.first_digit = len(letters) + 2
        self.pad = self.first_digit + self.digits * self.radix
        self.moves, self.columns, self.widths, self.bits = [], [], [], []
        for k in self.languages:
            symbols = self.symbols(texts[k])[:SAMPLE_SYMBOLS]
            own = np.unique(symbols)
            column = np.zeros(self.pad + 1, np.uint8)
            column[own] = np.arange(1, len(own) + 1)
            column[self.pad] = len(own) + 1
            states = suffix_automaton(column[symbols].tolist())
            table = np.full((len(states), len(own) + 2), -1, np.int64)
            for s, to in enumerate(states):
                if to:
                    table[s, list(to)] = list(to.values())
            root = np.where(table[0] >= 0, table[0], 0)
            table = np.where(table >= 0, table * 2, root[None, :] * 2 + 1)
            table[:, -1] = np.arange(len(states)) * 2
            self.moves.append(table.astype(np.int32).ravel())
            self.columns.append(column)
            self.widths.append(len(own) + 2)
            self.bits.append(math.log2(max(2, len(symbols))))

    def symbols(self, text: str) -> np.ndarray:
        at = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.code[at]
        if self.digits and len(s):
            number = self.number[at]
            coded = number >= 0
            size = np.where(coded, self.digits, 1)
            start = (np.cumsum(size) - size)[coded]
            s = np.repeat(s, size)
            for k in range(self.digits):
                s[start + k] = self.first_digit + k * self.radix + number[coded] // self.radix ** (self.digits - 1 - k) % self.radix
        if len(s):
            s = s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))]
        return s

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases by language and text, symbols of each text, whether it has a letter)."""
        coded = [self.symbols(t) if t else np.zeros(0, np.uint8) for t in texts]
        lengths = np.array([len(s) for s in coded], np.int64)
        letters = np.array([bool(s.any()) for s in coded], bool)
        out = np.zeros((len(self.languages), len(texts)), np.int64)
        blocks = -(-lengths // BLOCK)
        if not blocks.sum():
            return out, lengths, letters
        first = np.append(0, np.cumsum(blocks))
        grid = np.full((first[-1], BLOCK), self.pad, np.uint8)
        for k, s in enumerate(coded):
            grid[first[k] : first[k + 1]].ravel()[: len(s)] = s
        owner = np.repeat(np.arange(len(texts)), blocks)
        steps = np.ascontiguousarray(grid.T)
        for lang, (moves, column, width) in enumerate(zip(self.moves, self.columns, self.widths)):
            state = np.zeros(first[-1], np.int32)
            ends = np.zeros(first[-1], np.int32)
            for symbol in column.astype(np.int32)[steps]:
                move = moves[state * np.int32(width) + symbol]
                ends += move & 1
                state = move >> 1
            # the phrase that a block's end leaves open counts too
            np.add.at(out[lang], owner, ends + 1)
        return out, lengths, letters


_PARSERS: dict[int, CrossParser] = {}


def _parser(samples: dict[str, list[str]]) -> CrossParser:
    key = hash(tuple((k, tuple(v)) for k, v in sorted(samples.items())))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = CrossParser(samples)
    return _PARSERS[key]


def identify_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document.

    One suffix automaton for each language is built from a bounded sample of labelled documents whose
    crc32(id) mod 5 is not 0 (the rest is held out). Every whole text is cut into longest matches with each automaton;
    the fewest phrases per symbol, times the bits that point to one, win (ties: the first name). score is the runner-up's
    share of both costs, 0.5 for a tie; 1 if there is one language.

    A text that is null, empty or without letters gives 'und' with score 0, as does any if no document is labelled.
    Repeated rows are judged each; other columns are ignored; an empty table gives an empty result.
    """
    samples = labelled_sample(docs, doc_id, text, lang)
    slim = docs.select(F.col(doc_id).alias("doc_id"), (fold(F.col(doc_id)) == 0).alias("held_out"), F.col(text).alias("t"))
    if not samples:
        return slim.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples)
        names = np.array([*parser.languages, "und"], object)
        for batch in batches:
            texts = batch.column("t").to_pylist()
            best = np.full(len(texts), len(names) - 1)
            score = np.zeros(len(texts))
            first = 0
            while first < len(texts):
                last, room = first, CHUNK
                while last < len(texts) and (last == first or room > 0):
                    room -= len(texts[last] or "")
                    last += 1
                found, lengths, letters = parser.phrases(texts[first:last])
                cost = found * np.array(parser.bits)[:, None] / np.maximum(lengths, 1)
                order = np.argsort(cost, axis=0, kind="stable")
                low = np.take_along_axis(cost, order, 0)
                share = low[1] / np.maximum(low[0] + low[1], 1e-12) if len(low) > 1 else np.ones(last - first)
                best[first:last] = np.where(letters, order[0], len(names) - 1)
                score[first:last] = np.where(letters, share, 0.0)
                first = last
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}  # automata can't be expressed in SQL; held-out accuracy is tested
QUERIES = {"op4_language_id": op4_language_id}
