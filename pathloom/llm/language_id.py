"""Language identification by prediction by partial matching (PPM).

A language's model is a set of byte context trees up to `order` bytes deep, counted once and then
frozen. The code length of a byte after a context seen n times with d distinct followers is
-log2(c / (n + d)) if it followed c times (method C); otherwise an escape of -log2(d / (n + d)) is
paid and the context is shortened by its oldest byte, down to a uniform code over 256 bytes. A
context that a language never saw costs nothing to leave. A text's score in a language is the
exact sum over all of its bytes; the language with the shortest code wins.

For scoring, the trees of all languages are laid out as one table an order, from a string of
order + 1 bytes to the code lengths in every language with all escapes resolved; strings that no
language saw pay the escapes of their context and are looked up one order lower.

The models are trained on at most `sample_docs` labelled documents a language, those whose hashed
ids are smallest, whole texts each.

Defined results: null and empty texts, and all texts where no labelled document can be had, get
a null language, no bits and a margin of 0. Ties go to the first language by name. Rows with a
null or repeated doc_id, null declared language or any other null are scored as any other row. A
table with one language gives that language. A very long text is coded whole, a block at a time. Columns
named as one of the result's are replaced by it. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from pathloom.llm import common, textvec

ADDED = "lang_id string, code_bits double, bits_per_byte double, margin double"


@dataclass(frozen=True)
class LanguageParams:
    order: int = 4
    sample_docs: int = 200


def grams(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the last byte, value) of each string of k + 1 bytes inside one text."""
    if len(data) <= k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.zeros(len(data) - k, np.uint64)
    for j in range(k + 1):
        value = (value << np.uint64(8)) | data[j : len(data) - k + j].astype(np.uint64)
    whole = np.ones(len(value), bool)
    for edge in range(1, k + 1):
        at = offsets[1:-1] - edge
        whole[at[(at >= 0) & (at < len(whole))]] = False
    return np.flatnonzero(whole) + k, value[whole]


class Trees:
    """The frozen statistics of one language: followers and contexts by order."""

    def __init__(self, texts: list[str], order: int):
        ((_, data, offsets),) = textvec.chunks(pa.array(texts or [""], pa.large_string()), 1 << 62)
        self.cost, self.escape = [], []
        for k in range(order + 1):
            seen, count = np.unique(grams(data, offsets, k)[1], return_counts=True)
            context, first, distinct = np.unique(seen >> np.uint64(8), return_index=True, return_counts=True)
            total = np.add.reduceat(count, first) if len(first) else count
            of = np.repeat(np.arange(len(context)), distinct)
            self.cost.append((seen, -np.log2(count / (total + distinct)[of])))
            self.escape.append((context, -np.log2(distinct / (total + distinct))))


def pick(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: float) -> np.ndarray:
    names, values = table
    if not len(names):
        return np.full(len(keys), default)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return np.where(names[at] == keys, values[at], default)


class Coder:
    """The trees of all languages as tables for lookup."""

    def __init__(self, trees: dict[str, Trees], order: int):
        self.names, self.order = sorted(trees), order
        self.strings, self.costs, self.contexts, self.escapes = [], [], [], []
        lower_keys, lower = np.zeros(0, np.uint64), np.zeros((0, len(self.names)))
        for k in range(order + 1):
            keys = np.unique(np.concatenate([trees[n].cost[k][0] for n in self.names]))
            contexts = np.unique(keys >> np.uint64(8))
            escape = np.stack([pick(trees[n].escape[k], contexts, 0.0) for n in self.names], axis=1)
            if k:  # a string's suffix was seen wherever the string was
                below = lower[np.searchsorted(lower_keys, keys & np.uint64((1 << 8 * k) - 1))]
            else:
                below = np.full((len(keys), len(self.names)), 8.0)
            own = np.stack([pick(trees[n].cost[k], keys, np.nan) for n in self.names], axis=1)
            costs = np.where(np.isnan(own), escape[np.searchsorted(contexts, keys >> np.uint64(8))] + below, own)
            for kind, names in ((self.strings, keys), (self.contexts, contexts)):
                table = textvec.HashTable()
                table.put(textvec.mix(names + np.uint64(k + 1)), np.arange(len(names)))
                kind.append(table)
            self.costs.append(costs.astype(np.float32))
            self.escapes.append(escape.astype(np.float32))
            lower_keys, lower = keys, costs

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[texts, languages] of bits; a long text goes a block at a time, each after the bytes of its context."""
        block = max(textvec.BLOCK_BYTES, self.order)
        if len(offsets) != 2 or len(data) <= block:
            return self._code_lengths(data, offsets)
        total = self._code_lengths(data[:block], np.array([0, block]))
        for base in range(block, len(data), block):
            piece = data[base - self.order : base + block]
            total += self._code_lengths(piece, np.array([0, len(piece)]), begins=False)
        return total

    def _code_lengths(self, data: np.ndarray, offsets: np.ndarray, begins: bool = True) -> np.ndarray:
        """As code_lengths(); without `begins`, the first bytes are context only."""
        total = np.zeros((len(offsets) - 1, len(self.names)))
        if not len(data):
            return total

        def add(at, costs):
            if len(at):
                rows = np.searchsorted(offsets, at, side="right") - 1
                start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                total[rows[start]] += np.add.reduceat(costs, start, axis=0, dtype=np.float64)

        at, value = grams(data, offsets, self.order)
        for k in range(self.order, -1, -1):
            found = self.strings[k].get(textvec.mix(value + np.uint64(k + 1)))
            hit = found >= 0
            add(at[hit], self.costs[k][found[hit]])
            at, value = at[~hit], value[~hit]
            known = self.contexts[k].get(textvec.mix((value >> np.uint64(8)) + np.uint64(k + 1)))
            add(at[known >= 0], self.escapes[k][known[known >= 0]])
            if k:  # one byte less of context; the k-th byte of each text now has all the context that there is
                first = offsets[:-1][(np.diff(offsets) >= k) & begins]
                begin = np.zeros(len(first), np.uint64)
                for j in range(k):
                    begin = (begin << np.uint64(8)) | data[first + j].astype(np.uint64)
                at = np.concatenate([at, first + (k - 1)])
                value = np.concatenate([value & np.uint64((1 << 8 * k) - 1), begin])
                order = np.argsort(at)
                at, value = at[order], value[order]
        add(at, np.full((len(at), len(self.names)), 8.0, np.float32))
        return total


def train(docs: DataFrame, p: LanguageParams = LanguageParams()) -> dict[str, list[str]]:
    """The sampled texts by language; at most sample_docs a language reach the driver.

    The limit by rank holds in each task before the shuffle, so ids and languages stay where they are."""
    ids = docs.filter("lang is not null and doc_id is not null").filter("coalesce(n_chars, 1) > 0" if "n_chars" in docs.columns else "true").select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("n", F.dense_rank().over(order)).filter(F.col("n") <= p.sample_docs).select("doc_id", "lang").distinct()
    some = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).filter("text is not null")
    rows = some.groupBy("lang", "doc_id").agg(F.min_by("text", common.row_key()).alias("text")).collect()  # one text an id
    out: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.doc_id, r.text)):
        out.setdefault(row.lang, []).append(row.text)
    return out


def identify(docs: DataFrame, sample: dict[str, list[str]], p: LanguageParams = LanguageParams(), drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with lang_id, its code length in bits, bits a byte, and by how many bits a byte the next language is worse."""
    sent = docs.sparkSession.sparkContext.broadcast(Coder({n: Trees(t, p.order) for n, t in sample.items()}, p.order) if sample else None)

    def make():
        coder = sent.value

        def compute(batch):
            n = batch.num_rows
            best, bits, each, margin = np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n)
            for row, data, offsets in textvec.chunks(batch.column(batch.schema.get_field_index("text")), 1 << 20):
                size = np.diff(offsets)
                if coder is None:
                    continue
                lengths = coder.code_lengths(data, offsets)
                s = slice(row, row + len(size))
                best[s] = np.where(size > 0, lengths.argmin(axis=1), -1)
                bits[s] = lengths.min(axis=1)
                each[s] = bits[s] / np.maximum(size, 1)
                if lengths.shape[1] > 1:
                    two = np.partition(lengths, 1, axis=1)
                    margin[s] = (two[:, 1] - two[:, 0]) / np.maximum(size, 1)
            none = best < 0
            names = np.array([*(coder.names if coder else []), ""], object)[best]
            return {
                "lang_id": pa.array(names, pa.string(), mask=none),
                "code_bits": pa.array(bits, mask=none),
                "bits_per_byte": pa.array(each, mask=none),
                "margin": pa.array(margin),
            }

        return compute

    return common.mapped(docs, ADDED, make, drop)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, train(docs), drop=("text",))
