"""Near dedup by b-bit MinHash.

Shingles are runs of `shingle` words, the tokens of textvec (one shingle of all words where there are fewer). Each of
`hashes` hash functions gives a minimum over them. Bands of `rows` full minima make the buckets
in which candidates meet; only then the minima are cut to their lowest `bits` bits and packed.
Two packed signatures agree in a share of places that is, for resemblance J, about
J + (1 - J) / 2^bits, so J is estimated as (share - 2^-bits) / (1 - 2^-bits), with the share
counted as bits of one integer after an XOR.

All members of a bucket are compared with its first one. Whoever is not like it is compared with
every member of the bucket, so each document with a partner in a bucket joins a partner's group:
the groups are those of all pairs, at linear cost where a bucket holds one kind of document. In a bucket
of more than `block` members the second comparison is made apart, blocks of the unlike against blocks of
all, spread over the cluster; a task holds two blocks, whatever the bucket's size.
Documents with equal signatures are folded into one beforehand. Groups are connected components,
found by alternating large-star and small-star steps, stored after each step.

Defined results: documents without words, and rows without a doc_id, have no partners and always
stay. Repeated rows of one doc_id are one document and one row stays of them; different texts
under one doc_id are one document with several signatures. Of a group, the smallest doc_id stays.
A very long text is shingled whole. Other columns are carried along untouched, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from pathloom.llm import common, textvec


@dataclass(frozen=True)
class NearParams:
    shingle: int = 3
    hashes: int = 160
    rows: int = 4
    bits: int = 4
    threshold: float = 0.5
    block: int = 4096
    seed: int = 11


def shingles(text, p: NearParams):
    """Yields (first row, rows, shingle hashes, row of each) a chunk; rows are in order."""
    for row, data, offsets in textvec.chunks(textvec.lower(text)):
        n = len(offsets) - 1
        starts, ends, rows = textvec.tokens(data, offsets)
        hashes = textvec.span_hashes(data, starts, ends)
        first, found = textvec.windows(hashes, rows, p.shingle)
        of = rows[first]
        counts = np.bincount(rows, minlength=n)
        few = np.flatnonzero((counts > 0) & (counts < p.shingle))
        if len(few):  # one shingle of all words
            begin = np.searchsorted(rows, few)
            whole = np.array([textvec.mix(np.bitwise_xor.reduce(hashes[b : b + c] * np.arange(1, 2 * c, 2, dtype=np.uint64), keepdims=True))[0] for b, c in zip(begin, counts[few])], np.uint64)
            of, found = np.concatenate([of, few]), np.concatenate([found, whole])
            order = np.argsort(of, kind="stable")
            of, found = of[order], found[order]
        yield row, n, found, of


def minima(found: np.ndarray, of: np.ndarray, p: NearParams) -> tuple[np.ndarray, np.ndarray]:
    """(rows with shingles, [rows, hashes] of 32-bit minima)."""
    rng = np.random.default_rng(p.seed)
    a = rng.integers(0, 1 << 31, p.hashes, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, p.hashes, dtype=np.uint64).astype(np.uint32)
    start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    x = (found >> np.uint64(32)).astype(np.uint32)
    low = found.astype(np.uint32)
    out = np.empty((len(start), p.hashes), np.uint32)
    if len(start):
        y = np.empty_like(x)
        for k in range(p.hashes):
            np.bitwise_xor(x, b[k], out=y)
            np.multiply(y, a[k], out=y)
            np.add(y, low, out=y)
            out[:, k] = np.minimum.reduceat(y, start)
    return of[start], out


def packed(mins: np.ndarray, bits: int) -> np.ndarray:
    """[rows, bytes]: plane after plane, the lowest `bits` bits of every minimum."""
    planes = [np.packbits((mins >> np.uint32(k)) & np.uint32(1), axis=1) for k in range(bits)]
    size = -(-planes[0].shape[1] // 8) * 8
    return np.concatenate([np.pad(x.astype(np.uint8), ((0, 0), (0, size - x.shape[1]))) for x in planes], axis=1)


def similarity(a: np.ndarray, b: np.ndarray, p: NearParams) -> np.ndarray:
    """The corrected estimate, from the places in which all planes agree."""
    words = (a ^ b).view(np.uint64).reshape(len(a), p.bits, -1)
    differ = np.bitwise_count(np.bitwise_or.reduce(words, axis=1)).sum(axis=1)
    share, chance = 1 - differ / p.hashes, 0.5**p.bits
    return np.maximum(0, (share - chance) / (1 - chance))


def signatures(docs: DataFrame, p: NearParams) -> DataFrame:
    """doc_id, signature, buckets (one a band) of every document with words and an id."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for row, n, found, of in shingles(batch.column(1), p):
                have, mins = minima(found, of, p)
                bands = p.hashes // p.rows
                buckets = np.zeros((len(have), bands), np.uint64)
                for r in range(p.rows):
                    buckets = buckets * np.uint64(textvec.P) + mins[:, : bands * p.rows].reshape(len(have), bands, p.rows)[:, :, r]
                buckets = textvec.mix(buckets * np.uint64(64) + np.arange(bands, dtype=np.uint64)[None, :])
                sig = packed(mins, p.bits)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(have + row)),
                        pa.array([s.tobytes() for s in sig], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(len(have) + 1, dtype=np.int32) * bands, pa.array(buckets.view(np.int64).ravel())),
                    ],
                    names=["doc_id", "sig", "buckets"],
                )

    common.bounded_batches(docs.sparkSession)
    return docs.filter("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, sig binary, buckets array<long>")


def compared(members: DataFrame, p: NearParams) -> DataFrame:
    """Edges a < b with their estimate, from rows (bucket, doc_id, sig) that hold whole buckets in order.

    Of a bucket of over `block` members, those unlike its first come out too, as bucket, a, sig without b, for crossed()."""

    def made(bucket, a, b, est, sig):
        null = pa.nulls(len(a))
        edge = sig is None
        columns = [null.cast(pa.int64()) if edge else pa.array(bucket), pa.array(a), pa.array(b) if edge else null.cast(pa.int64()), pa.array(est) if edge else null.cast(pa.float64()), null.cast(pa.binary()) if edge else pa.array([x.tobytes() for x in sig], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "a", "b", "est", "sig"])

    def star(bucket, ids, sig, first_id, first_sig):
        est = similarity(sig, np.broadcast_to(first_sig, sig.shape).copy(), p)
        like = est >= p.threshold
        yield made(None, np.minimum(first_id, ids)[like & (ids != first_id)], np.maximum(first_id, ids)[like & (ids != first_id)], est[like & (ids != first_id)], None)
        if not like.all():
            yield made(np.full(int((~like).sum()), bucket), ids[~like], None, None, sig[~like])

    def edges(bucket, ids, sig):
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.concatenate([start[1:], [len(bucket)]])
        large = ends - start > p.block
        for k in np.flatnonzero(large):
            s = slice(start[k], ends[k])
            yield from star(bucket[start[k]], ids[s], sig[s], ids[start[k]], sig[start[k]])
        some = np.repeat(~large, ends - start)
        bucket, ids, sig = bucket[some], ids[some], sig[some]
        if not len(bucket):
            return
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.concatenate([start[1:], [len(bucket)]])
        first = np.repeat(start, ends - start)
        est = similarity(sig, sig[first], p)
        good = (est >= p.threshold) & (ids != ids[first])
        found = [(ids[first][good], ids[good], est[good])]
        for k in np.flatnonzero(est < p.threshold):  # unlike the first: held against everyone in the bucket
            b = np.searchsorted(start, k, side="right") - 1
            found.append(hits(sig[k], ids[k], sig[start[b] : ends[b]], ids[start[b] : ends[b]], p))
        yield made(None, *[np.concatenate(x) for x in zip(*found)], None)

    def run(batches):
        bucket, ids, sig, big = np.zeros(0, np.int64), np.zeros(0, np.int64), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            now, who = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if big:  # a bucket that is too large to be held goes by as it comes, against its first
                more = int(np.searchsorted(now, big[0], side="right"))
                if more:
                    yield from star(big[0], who[:more], raw[:more], *big[1:])
                if more == len(now):
                    continue
                now, who, raw, big = now[more:], who[more:], raw[more:], None
            bucket, ids = np.concatenate([bucket, now]), np.concatenate([ids, who])
            sig = raw if sig is None else np.concatenate([sig, raw])
            whole = int(np.searchsorted(bucket, bucket[-1]))
            if whole:
                yield from edges(bucket[:whole], ids[:whole], sig[:whole])
                bucket, ids, sig = bucket[whole:], ids[whole:], sig[whole:]
            if len(bucket) > p.block:
                big = bucket[0], ids[0], sig[0].copy()
                yield from star(bucket[0], ids, sig, *big[1:])
                bucket, ids, sig = bucket[:0], ids[:0], None
        if len(bucket):
            yield from edges(bucket, ids, sig)

    return members.mapInArrow(run, "bucket long, a long, b long, est double, sig binary")


def hits(one: np.ndarray, id_: int, sig: np.ndarray, ids: np.ndarray, p: NearParams):
    """(a, b, estimate) of one signature's partners among others."""
    est = similarity(np.broadcast_to(one, sig.shape).copy(), sig, p)
    hit = np.flatnonzero((est >= p.threshold) & (ids != id_))
    return np.minimum(id_, ids[hit]), np.maximum(id_, ids[hit]), est[hit]


def crossed(unlike: DataFrame, members: DataFrame, p: NearParams) -> DataFrame:
    """Edges of the unlike members (bucket, doc_id, sig) of large buckets with any member, a block of each in a task."""

    def cell(few, many):
        import pandas as pd

        found = []
        if len(few) and len(many):
            x, y = (np.frombuffer(b"".join(d.sig), np.uint8).reshape(len(d), -1) for d in (few, many))
            found = [hits(x[k], few.doc_id.iloc[k], y, many.doc_id.to_numpy(), p) for k in range(len(x))]
        a, b, est = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0)] * 3
        return pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64), "est": est})

    def block(side: str):
        return F.pmod(F.xxhash64("doc_id", F.lit(side)), F.col(side)).cast("int")

    def blocks(side: str):
        return F.explode(F.sequence(F.lit(0), F.col(side) - 1)).alias(side)

    rows = unlike.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / p.block).cast("int").alias("rows"))
    columns = members.join(rows, "bucket", "left_semi").groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / p.block).cast("int").alias("columns"))
    sizes = common.stored(rows.join(columns, "bucket"))  # a row a large bucket
    few = unlike.join(sizes, "bucket").select("bucket", "doc_id", "sig", block("rows").alias("rows"), blocks("columns"))
    many = members.join(sizes, "bucket").select("bucket", "doc_id", "sig", block("columns").alias("columns"), blocks("rows"))
    at = ["bucket", "rows", "columns"]
    return few.groupBy(*at).cogroup(many.groupBy(*at)).applyInPandas(cell, "a long, b long, est double")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, root) for every node of the edges (a, b) but the roots: the root is the component's smallest."""
    edges = common.stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        # large star: a node's larger neighbours go to its smallest neighbour or itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = common.stored(moved.filter("u <> v").distinct())
        same = [x.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first() for x in (edges, new)]
        common.discard(edges)
        edges = new
        if same[0] == same[1]:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))


def pairs(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """keeper_id, doc_id and the best estimate with which doc_id was joined, for each document that goes."""
    sigs = common.stored(signatures(docs, p))
    folded = sigs.groupBy("sig", "buckets").agg(F.min("doc_id").alias("__pl_rep"))
    reps = folded.select(F.col("__pl_rep").alias("doc_id"), "sig", F.explode("buckets").alias("bucket"))
    shared = reps.select("bucket", "doc_id").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).filter("n > 1")
    # a document with one partner meets it in many buckets; its signature travels once a bucket in which it isn't alone
    one = folded.select(F.col("__pl_rep").alias("doc_id"), "sig")
    members = shared.select("bucket", "doc_id").join(one, "doc_id").select("bucket", "doc_id", "sig")
    same = sigs.join(folded, ["sig", "buckets"]).filter("doc_id <> __pl_rep").select(F.col("__pl_rep").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("est"))
    found = common.stored(compared(members.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "sig"), p))
    every = found.filter("b is not null").select("a", "b", "est").unionByName(same)
    unlike = found.filter("b is null").select("bucket", F.col("a").alias("doc_id"), "sig")
    if not unlike.isEmpty():
        every = every.unionByName(crossed(unlike, members, p))
    edges = common.stored(every.groupBy("a", "b").agg(F.max("est").alias("est")))
    roots = components(edges)
    best = edges.select("est", F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.max("est").alias("similarity"))
    return roots.join(best, "doc_id").select(F.col("root").alias("keeper_id"), "doc_id", F.round("similarity", 6).alias("similarity"))


def deduplicate(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """The documents that stay, each once."""
    gone = pairs(docs, p).select(F.col("doc_id").alias("__pl_gone"))
    kept = docs.join(gone, docs["doc_id"] == gone["__pl_gone"], "left_anti")
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    again = common.stored(ids.filter("n > 1").select(F.col("doc_id").alias("__pl_again")))
    if again.isEmpty():  # read from the ids alone; texts of ids that stand once are not moved for it
        return kept
    same = kept["doc_id"] == again["__pl_again"]
    nth = Window.partitionBy("doc_id", common.row_key()).orderBy(F.lit(1))
    repeated = kept.join(again, same, "left_semi").withColumn("__pl_n", F.row_number().over(nth)).filter("__pl_n = 1").drop("__pl_n")
    return kept.join(again, same, "left_anti").unionByName(repeated)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(common.table(spark, sf_dir, "documents"))
