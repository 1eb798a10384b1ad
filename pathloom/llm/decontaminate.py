"""Benchmark decontamination: a broadcast hash set of normalised test n-grams and token windows over the training text.

Words are the tokens of textvec. An item's grams are its runs of `gram` words, or the item itself
where it is shorter; single words are no evidence, so items under `least` words are left out.
Every window of every document is looked up; a hit is verified word for word against the item and
extended to the longest common run. Runs of one item with at most `gram` words between them count together:
they must have at least `run` words or half of the item's words. The words of counted runs are removed from the text, with all that lies between
them; where they are at least `drop_share` of the document's words, the document goes.

The items are collected and broadcast only while they have at most `broadcast_chars` characters.
Beyond that, documents are first matched with items by a shuffled join of gram hashes, of which only those
in a bitmap of the items' grams (2^27 bits, whatever the benchmark) leave the documents, and are then
searched with the items so found: the same result for any size of the benchmark.

Defined results: null and empty texts have no windows and stay as they are; an item without text
is ignored; repeated items count once, under the smallest item_id; an item without item_id is searched
like others and reported as null, after all ids; rows with null or repeated doc_id are treated row by
row. Ties between items on one run go to the smallest item_id. A very long text is searched whole. Columns
named as one of the result's are replaced by it. An empty benchmark leaves all documents unchanged; empty
documents give an empty result.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import common, textvec

ADDED = "benchmark_items array<long>, words_removed int, contaminated boolean, dropped boolean"


@dataclass(frozen=True)
class DecontaminateParams:
    gram: int = 8
    least: int = 4
    run: int = 13
    drop_share: float = 0.5
    broadcast_chars: int = 16 << 20


BITMAP = 1 << 27


def by_id(item: int | None) -> tuple:
    return (item is None, item or 0)


class Items:
    """Grams of the benchmark: sorted hashes with the item and place of each, by window size."""

    def __init__(self, rows: list[tuple[int | None, str]], p: DecontaminateParams):
        best: dict[tuple, int | None] = {}
        for item, text in sorted(rows, key=lambda r: by_id(r[0])):
            words = tuple(split(text))
            if len(words) >= p.least:
                best.setdefault(words, item)
        self.words, self.ids = list(best), list(best.values())
        self.sizes = sorted({min(p.gram, len(w)) for w in self.words})
        self.grams = {}
        for n in self.sizes:
            mine = [k for k, w in enumerate(self.words) if min(p.gram, len(w)) == n]
            data, offsets = joined([" ".join(self.words[k]) for k in mine])
            starts, ends, rows_ = textvec.tokens(data, offsets)
            first, hashes = textvec.windows(textvec.span_hashes(data, starts, ends), rows_, n)
            order = np.argsort(hashes, kind="stable")
            begin = np.searchsorted(rows_, np.arange(len(mine)))
            item = np.array(mine, np.int64)[rows_[first]]
            self.grams[n] = hashes[order], item[order], (first - begin[rows_[first]])[order]
            small = np.zeros(1 << 20, bool)
            small[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.grams[n] += (small,)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ((_, data, offsets),) = textvec.chunks(pa.array(texts or [""], pa.large_string()), 1 << 62)
    return data, offsets


def split(text: str | None) -> list[str]:
    data, offsets = joined([(text or "").lower()])
    starts, ends, _ = textvec.tokens(data, offsets)
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(starts, ends)]


def candidates(hashes: np.ndarray, rows: np.ndarray, items: Items):
    """(first word, window size, first and last place in the sorted grams) of windows that hit."""
    for n in items.sizes:
        first, found = textvec.windows(hashes, rows, n)
        grams, item, place, small = items.grams[n]
        near = np.flatnonzero(small[(found >> np.uint64(44)).astype(np.int64)])
        a, b = (np.searchsorted(grams, found[near], side=s) for s in ("left", "right"))
        hit = np.flatnonzero(b > a)
        yield from ((int(first[near[k]]), n, range(a[k], b[k])) for k in hit)


def clean(column, items: Items, p: DecontaminateParams):
    """For each text: (text or None if unchanged, item ids, words removed, words in all)."""
    out: list[tuple] = [(None, [], 0, 0)] * len(column)
    for row, data, offsets in textvec.chunks(textvec.lower(column)):
        starts, ends, rows = textvec.tokens(data, offsets)
        hashes = textvec.span_hashes(data, starts, ends)
        total = np.bincount(rows, minlength=len(offsets) - 1)
        hits: dict[int, list] = {}
        for at, n, range_ in candidates(hashes, rows, items):
            hits.setdefault(int(rows[at]), []).append((at, n, range_))
        raw = data.tobytes() if hits else b""
        for r, found in hits.items():
            lo, hi = np.searchsorted(rows, [r, r + 1])
            word = lambda k: raw[starts[k] : ends[k]].decode(errors="replace")  # noqa: B023, E731
            verified: dict[int, set[tuple[int, int]]] = {}
            until: dict[tuple[int, int], int] = {}  # by item and alignment, where the last run ended
            for at, n, range_ in sorted(found, key=lambda x: x[:2]):
                for g in range_:
                    item, place = int(items.grams[n][1][g]), int(items.grams[n][2][g])
                    want, line = items.words[item], (item, at - place)
                    if at < until.get(line, -1) or any(word(at + j) != want[place + j] for j in range(n)):
                        continue
                    a, b = at, at + n
                    while a > lo and a - at + place > 0 and word(a - 1) == want[a - at + place - 1]:
                        a -= 1
                    while b < hi and b - at + place < len(want) and word(b) == want[b - at + place]:
                        b += 1
                    until[line] = b
                    verified.setdefault(item, set()).add((a, b))
            runs: dict[tuple[int, int], int | None] = {}
            for item, own in verified.items():
                for group, n in neighbours(sorted(own), p.gram):
                    if n >= p.run or 2 * n >= len(items.words[item]):
                        for run in group:
                            runs[run] = min(runs.get(run, items.ids[item]), items.ids[item], key=by_id)
            if runs:
                text, cut = column[row + r].as_py(), []
                for a, b in sorted(runs):
                    if cut and a <= cut[-1][1]:
                        cut[-1][1] = max(cut[-1][1], b)
                    else:
                        cut.append([a, b])
                removed = sum(b - a for a, b in cut)
                exact = text.encode()
                same = len(exact) == offsets[r + 1] - offsets[r]
                if not same:  # lower case took other room: the words' places in the text as written
                    s2, e2 = places(text)
                base = offsets[r]
                parts, at = [], 0
                for a, b in cut:
                    x, y = (starts[a] - base, ends[b - 1] - base) if same else (s2[a - lo], e2[b - 1 - lo])
                    parts.append(exact[at:x])
                    at = y
                parts.append(exact[at:])
                out[row + r] = (b"".join(parts).decode(errors="ignore"), sorted(set(runs.values()), key=by_id), removed, int(total[r]))
    return out


def neighbours(runs: list[tuple[int, int]], gap: int):
    """Groups of sorted runs with at most `gap` words between one and the next, and the words that each covers."""
    group, n, end = [], 0, None
    for a, b in runs:
        if end is not None and a - end > gap:
            yield group, n
            group, n, end = [], 0, None
        group.append((a, b))
        n += max(0, b - max(a, end if end is not None else a))
        end = b if end is None else max(end, b)
    if group:
        yield group, n


def places(text: str) -> tuple[list[int], list[int]]:
    """Byte places of the words in a text whose lower case has another length, character by character."""
    low, at = [], []
    byte = 0
    for ch in text:
        size = len(ch.encode())
        x = ch.lower().encode() if len(ch.lower()) == 1 else ch.encode()
        low.append(x)
        at.extend([(byte, byte + size)] * len(x))
        byte += size
    data = np.frombuffer(b"".join(low), np.uint8)
    starts, ends, _ = textvec.tokens(data, np.array([0, len(data)], np.int64))
    return [at[s][0] for s in starts], [at[e - 1][1] for e in ends]


def decisions(column, items: Items, p: DecontaminateParams) -> dict:
    found = clean(column, items, p)
    drop = [bool(items) and removed >= p.drop_share * total for _, items, removed, total in found]
    texts = column.to_pylist()
    return {
        "text": pa.array([t if new is None else new for t, (new, *_) in zip(texts, found)], pa.string()),
        "benchmark_items": pa.array([items for _, items, _, _ in found], pa.list_(pa.int64())),
        "words_removed": pa.array([n for _, _, n, _ in found], pa.int32()),
        "contaminated": pa.array([bool(items) for _, items, _, _ in found]),
        "dropped": pa.array(drop),
    }


def annotate(docs: DataFrame, benchmark: DataFrame, p: DecontaminateParams = DecontaminateParams()) -> DataFrame:
    """docs with text cleaned and the decisions; nothing is dropped yet."""
    items = benchmark.filter("text is not null").select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    order = docs.columns
    added = "text string, " + ADDED
    if size <= p.broadcast_chars:
        rows = [(r[0], r[1]) for r in items.collect()]
        sent, name = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

        def make():
            made = textvec.latest("items", name, lambda: Items(sent.value, p))  # once a worker
            return lambda batch: decisions(batch.column(batch.schema.get_field_index("text")), made, p)

        out = common.mapped(docs, added, make)
    else:
        out = common.mapped(with_items(docs, items, p), added, lambda: lambda batch: by_row(batch, p), drop=("__pl_ids", "__pl_texts"))
    return out.select(*[f"`{c}`" for c in order if c.lower() not in {"benchmark_items", "words_removed", "contaminated", "dropped"}], "benchmark_items", "words_removed", "contaminated", "dropped")


def by_row(batch, p: DecontaminateParams) -> dict:
    """All items of a batch are searched in all of its texts: what a text matches, the join has found for it."""
    ids, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__pl_ids", "__pl_texts"))
    some = {pair for i, t in zip(ids, texts) if i for pair in zip(i, t)}
    return decisions(batch.column(batch.schema.get_field_index("text")), Items(list(some), p), p)


def item_grams(items: DataFrame, p: DecontaminateParams) -> DataFrame:
    """(i, n, g): size and hash of every window of gram words of an item, or of the whole where it is shorter."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in textvec.chunks(textvec.lower(batch.column(1))):
                starts, ends, of = textvec.tokens(data, offsets)
                hashes = textvec.span_hashes(data, starts, ends)
                count = np.minimum(np.bincount(of, minlength=len(offsets) - 1), p.gram)
                for n in range(p.least, p.gram + 1):
                    first, found = textvec.windows(hashes, of, n)
                    own = count[of[first]] == n
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[first[own]] + row)), pa.array(np.full(int(own.sum()), n, np.int32)), gram_keys(found[own], n)], names=["i", "n", "g"])

    return items.select("i", "text").mapInArrow(run, "i long, n int, g long").distinct()


def gram_keys(hashes: np.ndarray, n: int) -> pa.Array:
    return pa.array((hashes + np.uint64(n)).view(np.int64))


def document_grams(docs: DataFrame, grams: DataFrame, p: DecontaminateParams) -> DataFrame:
    """(k, g) of the documents' windows that may be an item's: of the sizes that items have and in the bitmap of their hashes."""
    sizes = [r.n for r in grams.select("n").distinct().collect()]
    bit = F.pmod("g", F.lit(BITMAP)) + 1
    parts = grams.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    bits = np.zeros(BITMAP // 8, np.uint8)
    for r in parts.toLocalIterator():  # at most 4096 rows of 4 kB, for any number of grams
        bits[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        known = sent.value
        for batch in batches:
            for row, data, offsets in textvec.chunks(textvec.lower(batch.column(1))):
                starts, ends, of = textvec.tokens(data, offsets)
                hashes = textvec.span_hashes(data, starts, ends)
                for n in sizes:
                    first, found = textvec.windows(hashes, of, n)
                    at = (found + np.uint64(n)) & np.uint64(BITMAP - 1)
                    may = (known[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[first[may]] + row)), gram_keys(found[may], n)], names=["k", "g"])

    return docs.select("k", "text").mapInArrow(run, "k long, g long").distinct()


def with_items(docs: DataFrame, items: DataFrame, p: DecontaminateParams) -> DataFrame:
    """docs with the ids and texts of items with which they share a gram, by a shuffled join."""
    common.bounded_batches(docs.sparkSession)
    keyed = docs.withColumn("__pl_key", F.xxhash64("text"))
    # one item_id may have several texts; two that share a hash are both searched
    texts = items.withColumn("i", F.xxhash64("item_id", "text")).distinct()
    own = common.stored(item_grams(texts, p))
    hits = document_grams(keyed.filter("text is not null").select(F.col("__pl_key").alias("k"), "text"), own, p)
    found = hits.join(own, "g").select("k", "i").distinct().join(texts, "i")
    lists = found.groupBy("k").agg(F.collect_list(F.struct("item_id", "text")).alias("own")).select("k", F.col("own.item_id").alias("__pl_ids"), F.col("own.text").alias("__pl_texts"))
    return keyed.join(lists, F.col("__pl_key") == F.col("k"), "left").drop("__pl_key", "k")


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: DecontaminateParams = DecontaminateParams()) -> DataFrame:
    """The documents that stay, without benchmark passages; n_chars, where there is one, is the new length."""
    out = annotate(docs, benchmark, p).filter("not dropped").drop("dropped")
    return out.withColumn("n_chars", F.when(F.col("contaminated"), F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
