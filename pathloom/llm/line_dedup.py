"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is 128 bits of hash of its text with outer white space removed; its shard is a part
of the key. The state of a LineStore has three tables:

    places   shard, k1, k2, doc_id, h, pos   where each line stands; refs, their count and first by key
    gone     doc_id, h                       documents deleted since, with the time of it
    filters  shard, n_keys, slots            a cuckoo filter over the shard's live keys

Inserting documents appends their places and probes the filters of their shards: a line that a filter has not
seen is certainly new; only lines it may have seen are looked up in the exact table, so that a key enters a
filter once. Deleting appends to `gone`; keys of which no place is left leave the filters. Nothing written
before is written again, but by compact(). insert(A+B) followed by delete(B) equals insert(A).

Within one batch the same filter, filled in reading order while a shard streams through, passes
only lines that may be repeats; these are held against the exact table, which decides.

Result for a document: its text without lines that stand at an earlier (doc_id, line number)
anywhere in the table. Lines under `min_chars` characters, blank ones too, always stay: they are
structure rather than copied text.

Defined results: a null text stays null with no lines; an empty text stays empty. Rows without a
doc_id are returned unchanged and count for nothing. Repeated rows of one document are one
document and get the same text. Different texts under one doc_id are ordered by a hash of the
text. Ties can't occur beyond that. A very long text is cut into lines like any other. A column named
lines_removed is replaced by the result's. An empty table gives an empty result. In a LineStore,
inserting a document again changes nothing, and so does deleting one that isn't in it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import common

SLOTS = 4
SALT = 0x5A17
WHOLE = 2**31 - 1
SPACE = " \t\x0b\f\r"


@dataclass(frozen=True)
class LineDedupParams:
    min_chars: int = 12
    chars_per_shard: int = 64 << 20
    load: float = 0.85


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket; whole arrays of keys at a time.

    Partial-key hashing: the second bucket is the first XOR a hash of the fingerprint. A key
    inserted n times needs n deletions, so callers insert a key once. When no place is found
    within `kicks` rounds, the filter raises Full and its owner rebuilds it, larger, from the
    exact table.
    """

    class Full(Exception):
        pass

    def __init__(self, capacity: int = 0, load: float = 0.85, slots: np.ndarray | None = None):
        if slots is None:
            need = max(1, int(np.ceil(max(capacity, 1) / load / SLOTS)))
            slots = np.zeros((1 << max(1, (need - 1).bit_length()), SLOTS), np.uint16)
        self.slots = slots

    @classmethod
    def of(cls, keys: np.ndarray, load: float = 0.85) -> Cuckoo:
        capacity = len(keys)
        while True:
            try:
                made = cls(capacity, load)
                made.insert(keys)
                return made
            except cls.Full:
                capacity = 2 * capacity + SLOTS

    def _place(self, keys: np.ndarray):
        print_ = ((keys >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (keys & np.uint64(len(self.slots) - 1)).astype(np.int64)
        return print_, first, self._other(first, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ ((print_.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(7)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, a, b = self._place(keys)
        p = print_[:, None]
        return (self.slots[a] == p).any(axis=1) | (self.slots[b] == p).any(axis=1)

    def insert(self, keys: np.ndarray, kicks: int = 400) -> None:
        print_, at, other = self._place(keys)
        self._fill(*self._fill(print_, at, other)[:2], None)  # the first bucket, then the second
        waiting, buckets = self._left
        rng = np.random.default_rng(len(self.slots))
        for _ in range(kicks):
            if not len(waiting):
                return
            _, one = np.unique(buckets, return_index=True)  # one eviction a bucket and round
            rest = np.setdiff1d(np.arange(len(buckets)), one)
            slot = rng.integers(0, SLOTS, len(one))
            out = self.slots[buckets[one], slot].copy()
            self.slots[buckets[one], slot] = waiting[one]
            waiting = np.concatenate([out, waiting[rest]])
            buckets = np.concatenate([self._other(buckets[one], out), buckets[rest]])
            self._fill(waiting, buckets, None)
            waiting, buckets = self._left
        raise self.Full

    def _fill(self, print_, at, other):
        """Places what finds a free slot in its bucket; what doesn't is left (at `other` if given)."""
        order = np.argsort(at, kind="stable")
        s = at[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        rank = np.arange(len(s)) - start
        free = self.slots[s] == 0
        fits = rank < free.sum(axis=1)
        slot = np.argsort(~free[fits], axis=1, kind="stable")[np.arange(int(fits.sum())), rank[fits]]
        self.slots[s[fits], slot] = print_[order[fits]]
        left = order[~fits]
        self._left = (print_[left], (at if other is None else other)[left])
        return self._left + (None,)

    def delete(self, keys: np.ndarray) -> None:
        """Keys must have been inserted; removes one fingerprint for each."""
        print_, a, b = self._place(keys)
        for p, x, y in zip(print_, a, b):
            for bucket in (x, y):
                hit = np.flatnonzero(self.slots[bucket] == p)
                if len(hit):
                    self.slots[bucket, hit[0]] = 0
                    break


def lines_of(docs: DataFrame, p: LineDedupParams, shards: int, whole: bool = False) -> DataFrame:
    """doc_id, h (of the text), pos, shard, k1, k2 of every line that counts; repeated rows once a row.

    With `whole`, a text that isn't blank counts as a line too, in the last place."""
    line, last = F.btrim("__pl_line", F.lit(SPACE)), F.size("__pl_lines") - 1
    parts = F.split("text", "\n", -1)
    if whole:
        parts = F.concat(parts, F.array("text"))
    lines = (
        docs.filter("doc_id is not null and text is not null")
        .select("doc_id", common.row_key().alias("h"), parts.alias("__pl_lines"))
        .select("doc_id", "h", last.alias("last"), F.posexplode("__pl_lines").alias("pos", "__pl_line"))
    )
    if whole:
        at_end = F.col("pos") == F.col("last")
        pos = F.when(at_end, F.lit(WHOLE)).otherwise(F.col("pos"))
        line = F.when(at_end & (line != ""), F.concat(F.lit("\n"), "__pl_line")).otherwise(line)
    else:
        pos = F.col("pos")
    return (
        lines.select("doc_id", "h", pos.alias("pos"), line.alias("__pl_line"))
        .filter((F.length("__pl_line") >= p.min_chars) | (F.col("pos") == WHOLE) & (F.length("__pl_line") > 1))
        .select("doc_id", "h", "pos", F.xxhash64("__pl_line").alias("k1"), F.xxhash64(F.lit(SALT), "__pl_line").alias("k2"))
        .withColumn("shard", F.pmod(F.col("k2"), F.lit(shards)).cast("int"))
    )


def shards_for(docs: DataFrame, p: LineDedupParams) -> int:
    """So many that a shard's filter and stream stay small at any size; it reads lengths only where the table has them."""
    size = F.sum("n_chars") if "n_chars" in docs.columns else F.sum(F.length("text"))
    return max(8, int((docs.agg(size).first()[0] or 0) // p.chars_per_shard) + 1)


def counted(lines: DataFrame) -> DataFrame:
    """The exact table of a batch: partial counts on the map side, so a line in a million documents costs a row a task."""
    place = F.struct("doc_id", "h", "pos")
    return lines.groupBy("shard", "k1", "k2").agg(F.count(F.lit(1)).alias("n_refs"), F.min(place).alias("first"))


def screened(lines: DataFrame, p: LineDedupParams) -> DataFrame:
    """Lines that may be repeats: each shard streams in reading order through a cuckoo filter that keeps what it has seen."""

    def run(batches):
        at, filter_, stored = None, None, []  # rows come shard by shard, so one filter is held at a time
        for batch in batches:
            shard = batch.column(0).to_numpy()
            keys = batch.column(1).to_numpy().view(np.uint64)
            maybe = np.zeros(len(keys), bool)
            edges = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]]) if len(shard) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                if shard[a] != at:
                    at, filter_, stored = shard[a], Cuckoo(1 << 14, p.load), []
                _, first = np.unique(keys[a:b], return_index=True)
                seen = np.ones(b - a, bool)
                seen[first] = False
                known = filter_.contains(keys[a:b])
                new = keys[a:b][~seen & ~known]
                maybe[a:b] = seen | known
                stored.append(new)
                if sum(map(len, stored)) > p.load * filter_.slots.size:
                    filter_ = Cuckoo.of(np.concatenate(stored), p.load / 3)
                else:
                    try:
                        filter_.insert(new)
                    except Cuckoo.Full:
                        filter_ = Cuckoo.of(np.concatenate(stored), p.load / 2)
            if maybe.any():
                yield batch.filter(pa.array(maybe))

    columns = ["shard", "k1", "k2", "doc_id", "h", "pos"]
    return (
        lines.select(*columns)
        .repartition("shard")
        .sortWithinPartitions("shard", "doc_id", "h", "pos")
        .mapInArrow(run, "shard int, k1 long, k2 long, doc_id long, h long, pos int")
    )


def repeats(docs: DataFrame, p: LineDedupParams, whole: bool = False) -> DataFrame:
    """doc_id, h and the sorted line numbers that are repeats of earlier lines; WHOLE where the text is, with `whole`."""
    lines = lines_of(docs, p, shards_for(docs, p), whole)
    exact = counted(lines).filter("n_refs > 1").select("k1", "k2", "first")
    return (
        screened(lines, p)
        .join(exact, ["k1", "k2"])
        .filter(F.struct("doc_id", "h", "pos") > F.col("first"))
        .groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("pos")).alias("__pl_cut"))
    )


def deduplicate(docs: DataFrame, p: LineDedupParams = LineDedupParams(), whole: bool = False) -> DataFrame:
    """docs with text as the module says, n_chars set to its length where there is one, and lines_removed; with `whole`,
    also whole_copy: whether an earlier document has just this text."""
    cut = repeats(docs, p, whole).select(F.col("doc_id").alias("__pl_id"), F.col("h").alias("__pl_h"), "__pl_cut")
    docs = common.without(docs, ["lines_removed", "whole_copy"] if whole else ["lines_removed"])
    joined = docs.withColumn("__pl_key", common.row_key()).join(cut, (F.col("doc_id") == F.col("__pl_id")) & (F.col("__pl_key") == F.col("__pl_h")), "left")
    # the array of one binds the lines; array_except hashes, so a text of many lines and cuts takes time linear in both
    kept = F.expr("transform(array(split(text, '\n', -1)), ls -> array_join(transform(array_except(sequence(0, size(ls) - 1), __pl_cut), i -> ls[i]), '\n'))[0]")
    text = F.when(F.col("__pl_cut").isNull(), F.col("text")).otherwise(kept)
    out = [text.alias(c) if c == "text" else joined[f"`{c}`"] for c in docs.columns]
    copied = F.coalesce(F.array_contains("__pl_cut", WHOLE), F.lit(False))
    removed = F.coalesce(F.size("__pl_cut"), F.lit(0)) - (copied.cast("int") if whole else F.lit(0))
    result = joined.select(*out, removed.alias("lines_removed"), *[copied.alias("whole_copy")] * whole)
    return result.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else result


def something_left(p: LineDedupParams = LineDedupParams()) -> Column:
    """Of a result of deduplicate: no line was removed, or one that counts remains. A copy keeps at most its short lines."""
    return (F.col("lines_removed") == 0) | F.exists(F.split("text", "\n", -1), lambda x: F.length(F.trim(x)) >= p.min_chars)


PLACES = "shard int, k1 long, k2 long, doc_id long, h long, pos int, at int"
KEY = ["shard", "k1", "k2"]
PLACE = ["doc_id", "h", "pos"]


class LineStore:
    """The state, held as tables in the shared folder; insert, delete and compact return a new state and leave the old one."""

    def __init__(self, spark: SparkSession, shards: int, p: LineDedupParams, at: int = 0, segments=(), gone=(), filters=()):
        """segments, gone: tables written so far; filters: (table, the shards for which it is the newest)."""
        self.spark, self.shards, self.p, self.at = spark, shards, p, at
        self.segments, self.gone, self._filters = segments, gone, filters

    @classmethod
    def empty(cls, spark: SparkSession, shards: int = 64, p: LineDedupParams = LineDedupParams()) -> LineStore:
        return cls(spark, shards, p)

    def places(self, shards: list[int] | None = None) -> DataFrame:
        """The live places, of some shards only where these are named; a place that was inserted twice is one."""
        every = reduce(DataFrame.unionByName, self.segments, self.spark.createDataFrame([], PLACES))
        if shards is not None:
            every = every.filter(F.col("shard").isin(shards))
        if self.gone:
            left = reduce(DataFrame.unionByName, self.gone).groupBy("doc_id", "h").agg(F.max("at").alias("left"))
            every = every.join(left, ["doc_id", "h"], "left").filter("left is null or at > left")
        return every.select(*KEY, *PLACE).distinct()

    @property
    def refs(self) -> DataFrame:
        """shard, k1, k2, n_refs, first: the exact table."""
        return counted(self.places())

    @property
    def filters(self) -> DataFrame:
        parts = [df.filter(F.col("shard").isin(own)) for df, own in self._filters]
        return reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], "shard int, n_keys long, slots binary"))

    def _next(self, segments=None, gone=None, filters=None) -> LineStore:
        keep = lambda new, old: old if new is None else new
        return LineStore(self.spark, self.shards, self.p, self.at + 1, keep(segments, self.segments), keep(gone, self.gone), keep(filters, self._filters))

    def _lines(self, docs: DataFrame) -> DataFrame:
        return lines_of(docs, self.p, self.shards).select(*KEY, *PLACE).distinct()

    def _probe(self, keys: DataFrame, touched: list[int]) -> DataFrame:
        """Distinct keys, each with whether its shard's filter may know it; a shard's keys are distinct and evenly spread."""

        def run(keys, filters):
            import pandas as pd

            known = np.zeros(len(keys), bool)
            if len(filters) and len(keys):
                known = Cuckoo(slots=np.frombuffer(filters.slots.iloc[0], np.uint16).reshape(-1, SLOTS).copy()).contains(keys.k1.to_numpy().view(np.uint64))
            return pd.DataFrame({"shard": keys.shard, "k1": keys.k1, "k2": keys.k2, "known": known})

        own = self.filters.filter(F.col("shard").isin(touched))
        return keys.groupBy("shard").cogroup(own.groupBy("shard")).applyInPandas(run, "shard int, k1 long, k2 long, known boolean")

    def _changed(self, after: LineStore, changes: DataFrame) -> LineStore:
        """`after` with filters in which the changes (shard, k1, step: 1 added, -1 removed) are made; only their shards are
        written, and only those that are full are made anew, larger, from the exact table."""
        load = self.p.load

        def run(changes, filters):
            import pandas as pd

            shard = changes.shard.iloc[0] if len(changes) else filters.shard.iloc[0]
            plus, minus = (changes[changes.step == k].k1.to_numpy().view(np.uint64) for k in (1, -1))
            n = int(filters.n_keys.iloc[0] if len(filters) else 0) + len(plus) - len(minus)
            try:
                if len(filters) and n > load * len(filters.slots.iloc[0]) / 2:
                    raise Cuckoo.Full
                made = Cuckoo(slots=np.frombuffer(filters.slots.iloc[0], np.uint16).reshape(-1, SLOTS).copy()) if len(filters) else Cuckoo(n, load)
                made.delete(minus)
                made.insert(plus)
                slots = made.slots.tobytes()
            except Cuckoo.Full:
                slots = None
            return pd.DataFrame({"shard": [shard], "n_keys": [n], "slots": [slots]})

        def again(keys):
            import pandas as pd

            return pd.DataFrame({"shard": [keys.shard.iloc[0]], "n_keys": [len(keys)], "slots": [Cuckoo.of(keys.k1.to_numpy().view(np.uint64), load).slots.tobytes()]})

        schema = "shard int, n_keys long, slots binary"
        changes = common.stored(changes)
        shards = [r.shard for r in changes.select("shard").distinct().collect()]
        if not shards:
            return after
        own = self.filters.filter(F.col("shard").isin(shards))
        made = common.stored(changes.groupBy("shard").cogroup(own.groupBy("shard")).applyInPandas(run, schema))
        full = [r.shard for r in made.filter("slots is null").select("shard").collect()]
        parts = [(df, [s for s in of if s not in set(shards)]) for df, of in self._filters] + [(made, [s for s in shards if s not in set(full)])]
        if full:
            parts.append((common.stored(after.places(full).select(*KEY).distinct().groupBy("shard").applyInPandas(again, schema)), full))
        return LineStore(self.spark, self.shards, self.p, after.at, after.segments, after.gone, tuple(x for x in parts if x[1]))

    def insert(self, docs: DataFrame) -> LineStore:
        segment = common.stored(self._lines(docs).withColumn("at", F.lit(self.at + 1)).repartition("shard").sortWithinPartitions("shard", "k1"))
        keys = segment.select(*KEY).distinct()
        touched = [r.shard for r in keys.select("shard").distinct().collect()]
        probed = common.stored(self._probe(keys, touched))
        maybe = probed.filter("known").select(*KEY)
        mistaken = maybe.join(self.places(touched).select(*KEY).distinct(), KEY, "left_anti")  # the filter's false positives are new after all
        added = probed.filter("not known").select(*KEY).unionByName(mistaken)
        return self._changed(self._next(segments=(*self.segments, segment)), added.select("shard", "k1", F.lit(1).alias("step")))

    def delete(self, gone: DataFrame, remaining: DataFrame | None = None) -> LineStore:
        """Without the documents `gone`. The state knows all places, so the remaining documents needn't be read and may be left out."""
        lines = common.stored(self._lines(gone))
        touched = [r.shard for r in lines.select("shard").distinct().collect()]
        left = common.stored(lines.select("doc_id", "h").distinct().withColumn("at", F.lit(self.at + 1)))
        after = self._next(gone=(*self.gone, left))
        had = self.places(touched).join(left, ["doc_id", "h"], "left_semi").select(*KEY).distinct()
        dead = had.join(after.places(touched).select(*KEY).distinct(), KEY, "left_anti")
        return self._changed(after, dead.select("shard", "k1", F.lit(-1).alias("step")))

    def compact(self) -> LineStore:
        """The same state with its places in one table, those of deleted documents left behind."""
        every = self.places().withColumn("at", F.lit(self.at)).repartition("shard").sortWithinPartitions("shard", "k1")
        return self._next(segments=(common.stored(every),), gone=())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, text, i AS pos, trim(parts[i + 1], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents), unnest(range(len(parts))) AS u(i)
), marked AS (
  SELECT doc_id, pos, length(line) >= 12 AND row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 AS again FROM lines
), kept AS (
  SELECT l.doc_id, coalesce(string_agg(p.part, chr(10) ORDER BY l.pos) FILTER (WHERE NOT l.again), '') AS text, CAST(count(*) FILTER (WHERE l.again) AS INTEGER) AS lines_removed
  FROM marked l JOIN (SELECT doc_id, i AS pos, parts[i + 1] AS part FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(len(parts))) AS u(i)) p USING (doc_id, pos)
  GROUP BY l.doc_id
)
SELECT d.doc_id, k.text, d.lang, d.source, CAST(length(k.text) AS BIGINT) AS n_chars, k.lines_removed FROM documents d JOIN kept k USING (doc_id)
"""
