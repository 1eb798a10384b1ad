"""Packing by minimum bin slack.

A document's length is its number of tokens under a public byte-level BPE vocabulary and one
separator. A document longer than a window is cut into full windows and a rest. Rests are packed
shard by shard: the longest piece left opens a window, and a bitset dynamic programme over the
multiset of remaining lengths finds which sums can be reached in the room left; the largest is
taken, and its counts of each length are traced back. The pattern is used as often as the counts
allow before the next is sought. No window is longer than `window`, no piece is left out.

Shards hold about `docs_per_shard` documents by hash, so their number follows the table and each
is packed by one task from lengths alone.

Token counts are exact: a text is only cut, for counting, where the vocabulary's own splitting
pattern always cuts (before a lone space, around a lone line end, where a run of letters ends), and each distinct cut part is
tokenised once a worker. Parts are told apart by 64-bit hashes.

Defined results: null and empty texts have no tokens and are in no window. Rows without a doc_id
and repeated rows are packed like any other, a piece a row. Equal lengths are taken in order of
doc_id, then of a hash of the text. An empty table gives an empty result. Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import common, textvec

SCHEMA = "window_id long, position int, window_offset int, doc_id long, piece int, first_token long, n_tokens int, window_tokens int"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class PackParams:
    window: int = 2048
    docs_per_shard: int = 8192
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = PATTERN
    cached_parts: int = 2_000_000


def encoder(p: PackParams):
    import tiktoken

    with open(p.vocabulary, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=p.pattern, mergeable_ranks=ranks, special_tokens={})


def byte_kinds() -> np.ndarray:
    """1 for ASCII characters that aren't white space; 2 for bytes of others, that may be; 0 for white space and controls."""
    kind = np.zeros(256, np.uint8)
    kind[33:127] = 1
    kind[128:] = 2
    return kind


def ascii_letters() -> np.ndarray:
    table = np.zeros(256, bool)
    table[65:91] = table[97:123] = True
    return table


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of parts that are tokenised independently of each other."""
    kind = textvec.shared("kinds", byte_kinds)[data]
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = kind == 1
    # letters such as é: two bytes led by C3 to DF, none of which is white space
    lead = (data >= 0xC3) & (data <= 0xDF)
    solid[1:-1] |= lead
    solid[2:-1] |= (kind[1:] == 2) & (data[1:] < 0xC0) & lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    lone = solid[:-2] & solid[2:] & ~edge[:-1] & ~edge[1:]
    space, line = lone & (data == 32), lone & (data == 10)
    cut = edge
    cut[:-1] |= space | line
    cut[1:] |= line
    # a letter's run ends before ASCII digits and marks, whatever they begin
    letter = textvec.shared("letters", ascii_letters)[data]
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut[1:-1] |= letter[:-1] & (kind[1:] == 1) & ~letter[1:]
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


def token_counts(column, p: PackParams) -> np.ndarray:
    """Tokens of each text."""
    state = textvec.shared(("tokens", p.vocabulary, p.pattern), lambda: [encoder(p), textvec.HashTable()])
    out = np.zeros(len(column), np.int64)
    for row, data, offsets in textvec.chunks(column):
        if not len(data):
            continue
        starts, ends = parts(data, offsets)
        hashes = textvec.span_hashes(data, starts, ends)
        counts = state[1].get(hashes)
        missing = np.flatnonzero(counts < 0)
        if len(missing):
            new, at, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            raw, encode = data.tobytes(), state[0].encode_ordinary
            found = np.array([len(encode(raw[starts[k] : ends[k]].decode())) for k in missing[at]], np.int32)
            if state[1].n + len(new) > p.cached_parts:
                state[1] = textvec.HashTable()
            state[1].put(new, found)
            counts[missing] = found[back]
        before = np.concatenate([[0], np.cumsum(counts)])
        edges = np.searchsorted(starts, offsets)
        out[row : row + len(offsets) - 1] = before[edges[1:]] - before[edges[:-1]]
    return out


def fill(counts: np.ndarray, room: int) -> list[int]:
    """The lengths, with repeats, whose sum is the largest that is at most room; counts[n] pieces have length n.

    Bit s of `reach` tells whether sum s can be had; longer lengths come first and the search ends
    when the room itself is reached. Counts are split into powers of two, so a length costs the
    logarithm of its count.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for n in np.flatnonzero(counts[: room + 1])[::-1]:
        left, k = min(int(counts[n]), room // int(n)), 1
        while left:
            take = min(k, left)
            more = (reach | reach << int(n) * take) & mask
            if more != reach:
                steps.append((reach, int(n), take))
                reach = more
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    chosen: list[int] = []
    for before, n, take in reversed(steps):
        if not before >> best & 1:
            chosen += [n] * take
            best -= n * take
    return chosen


def bins(lengths: np.ndarray, window: int) -> list[list[int]]:
    """Indices of `lengths` (all from 1 to window) by window; equal lengths go in their order."""
    counts = np.bincount(lengths, minlength=window + 1)
    order = np.argsort(lengths, kind="stable")
    next_ = np.concatenate([[0], np.cumsum(counts)])[:-1]
    out = []
    longest = window
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return out
        counts[longest] -= 1
        pattern = [longest, *fill(counts, window - longest)]
        counts[longest] += 1
        sizes, uses = np.unique(pattern, return_counts=True)
        for _ in range(int((counts[sizes] // uses).min())):
            made = []
            for n in pattern:
                made.append(int(order[next_[n]]))
                next_[n] += 1
            out.append(made)
            counts[sizes] -= uses


def pack_shard(rows: pd.DataFrame, p: PackParams) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "h"], kind="stable", na_position="first").reset_index(drop=True)
    shard, size = int(rows.shard.iloc[0]), rows.n.to_numpy()
    whole, rest = size // p.window, size % p.window
    some = np.flatnonzero(rest)
    made = bins(rest[some], p.window)
    doc = np.concatenate([np.repeat(np.arange(len(size)), whole), some[np.array([k for b in made for k in b], np.int64)]]).astype(np.int64)
    full = int(whole.sum())
    nth = np.arange(full) - np.repeat(np.cumsum(whole) - whole, whole)
    piece = np.concatenate([nth, whole[doc[full:]]])
    n = np.concatenate([np.full(full, p.window), rest[doc[full:]]])
    width = np.array([1] * full + [len(b) for b in made], np.int64)
    window = np.repeat(np.arange(len(width)), width)
    first = np.cumsum(width) - width
    before = np.cumsum(n) - n
    return pd.DataFrame(
        {
            "window_id": (np.int64(shard) << 32) + window,
            "position": np.arange(len(n)) - first[window],
            "window_offset": before - before[first][window] if len(n) else before,
            "doc_id": rows.doc_id.iloc[doc].to_numpy(),
            "piece": piece,
            "first_token": piece * p.window,
            "n_tokens": n,
            "window_tokens": np.add.reduceat(n, first)[window] if len(n) else n,
        }
    )


def lengths(docs: DataFrame, p: PackParams, shards: int) -> DataFrame:
    """doc_id, h, n (tokens and a separator) and shard of each document with tokens."""

    def run(batches):
        for batch in batches:
            n = token_counts(batch.column(2), p)
            some = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n + 1)], names=["doc_id", "h", "n"]).filter(some)

    common.bounded_batches(docs.sparkSession)
    counted = docs.filter("length(text) > 0").select("doc_id", common.row_key().alias("h"), "text").mapInArrow(run, "doc_id long, h long, n long")
    return counted.withColumn("shard", F.pmod(F.xxhash64("doc_id", "h"), F.lit(shards)).cast("int"))


def pack(docs: DataFrame, p: PackParams = PackParams()) -> DataFrame:
    """A row a piece: its window, its place there, its document and the tokens of it."""
    shards = -(-docs.count() // p.docs_per_shard) or 1
    rows = lengths(docs, p, shards).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.groupBy("shard").applyInPandas(lambda x: pack_shard(x.astype({"doc_id": "Int64"}), p), SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
