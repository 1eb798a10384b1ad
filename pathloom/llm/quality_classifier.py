"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    y(x) = b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j
         = b + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2 ]

so a document costs time linear in its features. A document is acceptable where it is labelled
of high quality and not toxic; the score is the probability of that.

Features: the distinct words of the whole text (hashed), bins of structure statistics, and
language and source. The model is fitted on at most `sample_rows` labelled documents, those whose
hashed ids are smallest, one row of each id; features in fewer than `min_docs`, or a share `min_share`, of them carry no weight.

Defined results: a null text counts as empty; an empty text has only its structure and metadata
features. Null lang or source is a value of its own. A document without an id is scored as any
other. Repeated rows get equal scores. Labels with a null quality are unused, a null toxic counts
as 0; where no labels, or only one class, can be had, every score is the base rate (1 without
labels) and all are kept. A very long text is read whole, as one piece. Columns named as one of the
result's are replaced by it. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import common, textvec


@dataclass(frozen=True)
class QualityParams:
    sample_rows: int = 20_000
    word_bits: int = 18
    factors: int = 8
    min_docs: int = 4
    min_share: float = 0.002
    epochs: int = 14
    batch: int = 128
    rate: float = 0.12
    l2: float = 1e-4
    word_value: float = 0.5
    keep_from: float = 0.5
    seed: int = 7


def distinct_words(rows: np.ndarray, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leading bits of the hash) of each row's distinct words; 40 bits of the hash tell words apart."""
    keys = (rows.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))
    keys.sort()
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    keys = keys[first]
    return (keys >> np.uint64(40)).astype(np.int64), ((keys & np.uint64((1 << 40) - 1)) >> np.uint64(40 - bits)).astype(np.int64)


def structure(data: np.ndarray, offsets: np.ndarray, starts, ends, rows, hashes, distinct: np.ndarray) -> np.ndarray:
    """Binned statistics of each row: [rows, statistics] of small integers."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    lut = textvec.shared("classes", byte_classes)
    code = lut[data]
    odd = np.flatnonzero(code)
    at = np.searchsorted(offsets, odd, side="right") - 1
    counts = np.bincount(at * 8 + code[odd], minlength=8 * n).reshape(n, 8)

    def share(k):
        return counts[:, k] / np.maximum(size, 1)

    words = np.bincount(rows, minlength=n)
    again = np.zeros(n)
    if len(hashes) > 1:
        same = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
        again = np.bincount(rows[1:][same], minlength=n)
    length = np.bincount(rows, weights=ends - starts, minlength=n)
    many = np.maximum(words, 1)
    shares = [share(k) for k in range(1, 7)]
    cols = [np.log2(1 + words), 10 * np.sqrt(distinct / many), 20 * np.sqrt(again / many), np.minimum(length / many, 30)]
    cols += [np.minimum(30, 40 * np.sqrt(s)) for s in shares]
    cols.append(np.log2(1 + size / (1 + shares[-1] * size)))
    return np.stack(cols, axis=1).astype(np.int64)


def byte_classes() -> np.ndarray:
    """1 upper case, 2 digits, 3 strange symbols, 4 exclamations, 5 bars, 6 line ends; else 0."""
    out = np.zeros(256, np.uint8)
    for k, s in enumerate([range(65, 91), range(48, 58), map(ord, "#$%&*@^~_=+<>\\{}[]"), [ord("!")], [ord("|")], [10]], 1):
        out[list(s)] = k
    return out


def features(batch: pa.RecordBatch, p: QualityParams):
    """Yields (first row, indptr, feature ids, values), the same for training and scoring."""
    text, word_space = batch.column(batch.schema.get_field_index("text")), 1 << p.word_bits
    meta = []
    for k, name in enumerate(("lang", "source")):
        at = batch.schema.get_field_index(name)
        seen: dict = {}
        values = batch.column(at).cast(pa.string()).to_pylist() if at >= 0 else [None] * batch.num_rows
        codes = [seen.setdefault(v, len(seen)) for v in values]
        raw = [f"{name}={v}".encode() for v in seen]
        joined, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw])
        ids = textvec.span_hashes(joined, ends - [len(x) for x in raw], ends) if raw else np.zeros(0, np.uint64)
        meta.append((word_space + 8192 + (ids % np.uint64(8192)).astype(np.int64))[np.array(codes, np.int64)])
    cased = list(textvec.chunks(text))
    for row, data, offsets in cased:
        n = len(offsets) - 1
        low = textvec.lower(text.slice(row, n))
        ((_, lowered, low_offsets),) = textvec.chunks(low, 1 << 62)
        starts, ends, rows = textvec.words(lowered, low_offsets)
        hashes = textvec.span_hashes(lowered, starts, ends)
        of, ids = distinct_words(rows, hashes, p.word_bits)
        count = np.bincount(of, minlength=n)
        stats = structure(data, offsets, starts, ends, rows, hashes, count)
        k = stats.shape[1]
        fixed = word_space + np.arange(k) * 64 + np.minimum(stats, 63)
        dense = np.concatenate([fixed, np.stack([m[row : row + n] for m in meta], axis=1)], axis=1)
        indptr = np.concatenate([[0], np.cumsum(count + dense.shape[1])])
        idx, val = np.empty(indptr[-1], np.int32), np.ones(indptr[-1], np.float32)
        before = np.concatenate([[0], np.cumsum(count)])
        at = indptr[of] + np.arange(len(of)) - before[of]
        idx[at], val[at] = ids, p.word_value
        idx[(indptr[:-1] + count)[:, None] + np.arange(dense.shape[1])] = dense
        yield row, indptr, idx, val


@dataclass
class Model:
    bias: float
    ids: np.ndarray  # feature ids that carry weight, sorted
    w: np.ndarray
    v: np.ndarray

    def dense(self, space: int):
        w, v = np.zeros(space, np.float32), np.zeros((space, self.v.shape[1]), np.float32)
        w[self.ids], v[self.ids] = self.w, self.v
        return w, v


def raw_score(bias, w, v, indptr, idx, val) -> np.ndarray:
    """The sum-of-squares identity, for all rows at once; every row has features."""
    live = np.flatnonzero(w[idx] != 0)
    i, x = idx[live], val[live]
    counts = np.searchsorted(live, indptr)
    xv = v[i] * x[:, None]

    def sums(a):
        total = np.concatenate([np.zeros((1,) + a.shape[1:]), np.cumsum(a, axis=0, dtype=np.float64)])
        return total[counts[1:]] - total[counts[:-1]]

    return bias + sums(w[i] * x) + 0.5 * (sums(xv) ** 2 - sums(xv**2)).sum(axis=1)


def fit(indptr: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, p: QualityParams) -> Model:
    """Adagrad on logistic loss in mini-batches; deterministic."""
    if not len(y) or y.min() == y.max():
        rate = float(np.clip(y.mean() if len(y) else 1, 1e-6, 1 - 1e-6))
        return Model(float(np.log(rate / (1 - rate))), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros((0, p.factors), np.float32))
    ids, where, df = np.unique(idx, return_inverse=True, return_counts=True)
    live = df >= max(p.min_docs, p.min_share * len(y))
    name = np.cumsum(live) - 1
    keep = live[where]
    owner = np.repeat(np.arange(len(y)), np.diff(indptr))[keep]
    idx, val, ids = name[where[keep]], val[keep], ids[live]
    indptr = np.searchsorted(owner, np.arange(len(y) + 1))
    rng = np.random.default_rng(p.seed)
    w, v = np.zeros(len(ids)), rng.normal(0, 0.02, (len(ids), p.factors))
    gw, gv = np.full(len(ids), 1e-2), np.full(v.shape, 1e-2)
    rate = y.mean()
    bias, gb = float(np.log(rate / (1 - rate))), 1e-2
    for epoch in range(p.epochs):
        step = p.rate / (1 + 0.15 * epoch)
        order = rng.permutation(len(y))
        for a in range(0, len(order), p.batch):
            docs = order[a : a + p.batch]
            sizes = indptr[docs + 1] - indptr[docs]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(indptr[docs] - (ends - sizes), sizes)
            i, x, of = idx[at], val[at], np.repeat(np.arange(len(docs)), sizes)
            xv = v[i] * x[:, None]
            total = np.zeros((len(docs), p.factors))
            full = np.flatnonzero(sizes)
            total[full] = np.add.reduceat(xv, (ends - sizes)[full], axis=0)
            squares = np.zeros(len(docs))
            squares[full] = np.add.reduceat((xv**2).sum(axis=1), (ends - sizes)[full])
            z = bias + np.bincount(of, weights=w[i] * x, minlength=len(docs)) + 0.5 * ((total**2).sum(axis=1) - squares)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[docs]) / 1.0
            if len(i):  # else none of these documents has a feature that carries weight
                by = np.argsort(i, kind="stable")
                si = i[by]
                first = np.flatnonzero(np.concatenate([[True], si[1:] != si[:-1]]))
                u = si[first]
                gx = (g[of] * x)[by]
                dw = np.add.reduceat(gx, first) / len(docs) + p.l2 * w[u]
                dv = np.add.reduceat(gx[:, None] * (total[of] - xv)[by], first, axis=0) / len(docs) + p.l2 * v[u]
                gw[u] += dw**2
                gv[u] += dv**2
                w[u] -= step * dw / np.sqrt(gw[u])
                v[u] -= step * dv / np.sqrt(gv[u])
            db = g.mean()
            gb += db**2
            bias -= step * db / np.sqrt(gb)
    return Model(bias, ids.astype(np.int64), w.astype(np.float32), v.astype(np.float32))


def labelled(docs: DataFrame, labels: DataFrame, p: QualityParams) -> DataFrame:
    """The bounded sample: documents with y. Repeated labels of one id count once (the worst holds)."""
    y = F.least(F.col("quality"), 1 - F.coalesce(F.col("toxic"), F.lit(0)))
    picked = (
        labels.filter("quality is not null and doc_id is not null")
        .groupBy("doc_id").agg(F.min(y.cast("int")).alias("__pl_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample_rows)
    )
    have = [c for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    # at most sample_rows pairs of numbers, whatever the size of the tables
    some = docs.select(*have).join(F.broadcast(picked), "doc_id")
    # one row an id: of a repeated one, that whose text has the smallest hash
    row = F.struct(*[c for c in have if c != "doc_id"], "__pl_y")
    return some.groupBy("doc_id").agg(F.min_by(row, F.struct(common.row_key(), *[F.col(c) for c in ("lang", "source") if c in have])).alias("r")).select("doc_id", "r.*")


def train(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> Model:
    def run(batches):
        for batch in batches:
            y = batch.column(batch.schema.get_field_index("__pl_y")).to_numpy(zero_copy_only=False)
            doc = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            for row, indptr, idx, val in features(batch, p):
                n = len(indptr) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc[row : row + n], pa.int64()),
                        pa.array(y[row : row + n], pa.int32()),
                        pa.array([idx[a:b].tobytes() for a, b in zip(indptr[:-1], indptr[1:])], pa.binary()),
                        pa.array([(val[a:b] != 1).sum() for a, b in zip(indptr[:-1], indptr[1:])], pa.int32()),
                    ],
                    names=["doc_id", "y", "idx", "words"],
                )

    rows = labelled(docs, labels, p).mapInArrow(run, "doc_id long, y int, idx binary, words int").toArrow().to_pydict()
    order = sorted(range(len(rows["y"])), key=lambda k: (rows["doc_id"][k], rows["idx"][k]))
    parts = [np.frombuffer(rows["idx"][k], np.int32) for k in order]
    indptr = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    idx = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    val = np.ones(len(idx), np.float32)
    for k, a in zip(order, indptr):
        val[a : a + rows["words"][k]] = p.word_value
    return fit(indptr, idx, val, np.array([rows["y"][k] for k in order], float), p)


def classify(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams(), drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with quality_score (probability of being acceptable) and keep."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, p))

    def make():
        m = model.value
        w, v = m.dense((1 << p.word_bits) + 16384)
        w[m.ids] = np.where(w[m.ids] == 0, 1e-30, w[m.ids])

        def compute(batch):
            out = np.empty(batch.num_rows)
            for row, indptr, idx, val in features(batch, p):
                out[row : row + len(indptr) - 1] = raw_score(m.bias, w, v, indptr, idx, val)
            score = 1 / (1 + np.exp(-np.clip(out, -50, 50)))
            return {"quality_score": pa.array(score), "keep": pa.array(score >= p.keep_from)}

        return compute

    return common.mapped(docs, "quality_score double, keep boolean", make, drop)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), drop=("text",))
