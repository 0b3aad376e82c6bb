"""Toxicity by non-negative positive-unlabelled learning (operator 7).

Confirmed toxic examples stand against unlabelled text, of which a share, the class prior, is toxic as well. The risk of
a linear model is estimated as ``prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)])``: what unlabelled
text says about the clean class, corrected for its toxic share, which must not become negative. Features are whether a
text holds a word, or a word that begins with the same four, five or six bytes, once at least and twice at least, hashed.

Fitting takes a bounded sample (``most_positive``, ``most_unlabelled``, ``most_features``: documented parameters); features of both
signs are taken, those first whose rates in the two samples differ most in standard deviations. There is no least difference: a ridge penalty whose weight
falls with that difference keeps what differs by chance small, at every size of the sample. Scoring takes every whole text. Labels are learnt only from documents whose crc32 of the id as text leaves no remainder of 1 by 3.

Defined results: null and empty texts score the bias alone; without positive examples every score is the prior. A null
doc_id is never held out. Repeated labels count as toxic if any is. Labels of unknown documents are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm import _words as W
from veritab.llm._session import attach, checkpointed
from veritab.llm._shards import texts_of

BITS = 20
THRESHOLD = 0.7
LEADS = (4, 5, 6)


def features(size: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Distinct pairs of a document and a hashed feature, as document << BITS | feature, of texts that lie end to end."""
    ends = np.cumsum(size).astype(np.int64)
    text = W.LOWER[data]
    first, last, own = W.word_bounds(text, ends - size, ends)
    doc = np.repeat(np.arange(len(size)), np.diff(own))
    sums = W.prefix(W.CODES[text])
    found = [(doc, W.span(sums, first, last))]
    for n in LEADS:
        long = last - first > n
        found.append((doc[long], W.mix(W.span(sums, first[long], first[long] + n) ^ np.uint64(n))))
    mask = np.uint64((1 << BITS) - 1)
    once, many = np.unique(np.concatenate([d << BITS | (h & mask).astype(np.int64) for d, h in found]), return_counts=True)
    again = once[many > 1]
    twice = (W.mix((again & int(mask)).astype(np.uint64) ^ np.uint64(2 << 40)) & mask).astype(np.int64)
    return np.unique(np.concatenate([once, again >> BITS << BITS | twice]))


def _blocks(size: np.ndarray, data: np.ndarray, block: int = 1 << 19):
    """Ranges of texts of about ``block`` bytes: (first, sizes, bytes)."""
    ends, first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64), 0
    while first < len(size):
        last = min(len(size), max(first + 1, int(np.searchsorted(ends, ends[first] + block, "right")) - 1))
        yield first, size[first:last], data[ends[first] : ends[last]]
        first = last


@dataclass
class Model:
    """Weights of hashed features, and the bias."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: pd.Series) -> np.ndarray:
        table = np.zeros(1 << BITS)
        table[self.feature] = self.weight
        size, data = texts_of(pa.array(texts, pa.large_string()))
        out = np.full(len(size), self.bias)
        for first, sizes, part in _blocks(size, data):
            pairs = features(sizes, part)
            weight = table[pairs & ((1 << BITS) - 1)]
            out[first : first + len(sizes)] += np.bincount(pairs >> BITS, weight, len(sizes))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def non_negative_risk(g: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The two parts of the risk of outputs ``g`` under the logistic loss, toxic and corrected clean, and the slope to descend along.

    Where the corrected clean risk is below zero, a step goes against its gradient alone, as the method prescribes.
    """
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    p = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
    toxic = prior * np.logaddexp(0, -g)[positive].sum() / n_p
    loss = np.logaddexp(0, g)
    clean = loss[~positive].sum() / n_u - prior * loss[positive].sum() / n_p
    up, down = np.where(positive, prior * (p - 1) / n_p, 0.0), np.where(positive, -prior * p / n_p, p / n_u)
    return float(toxic), float(clean), up + down if clean >= 0 else -down


def non_negative_fit(rows: np.ndarray, columns: np.ndarray, positive: np.ndarray, scale: np.ndarray, prior: float, steps: int = 600, rate: float = 0.1, ridge: float = 3e-6) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam over all examples. ``rows``, ``columns``: which example has which feature.

    A feature's weight is ``scale`` times what the ridge penalty holds small, so features of small scale have little weight.
    """
    u, b = np.zeros(len(scale)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for t in range(1, steps + 1):
        slope = non_negative_risk(b + np.bincount(rows, (u * scale)[columns], len(positive)), positive, prior)[2]
        grad = np.append(np.bincount(columns, slope[rows], len(scale)) * scale + ridge * u, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        u, b = u - step[:-1], b - step[-1]
    return u * scale, b


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, seed: int = 5, most_positive: int = 4000, most_unlabelled: int = 12000, most_features: int = 4096, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model learnt from documents that aren't held out. The samples are the documents first in a seeded order of ids."""
    attach(docs.sparkSession)
    known = labels.where(labels[label_col].isNotNull()).groupBy(labels[id_col].cast("long").alias("id")).agg(F.max(labels[label_col].cast("int")).alias("toxic")).where(~held_out(F.col("id")))
    flat = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    prior = min(max(float(known.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]), 1e-6), 0.5)
    order = [F.xxhash64(F.lit(seed), "id"), F.col("id")]
    there = flat.select("id").where(F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
    positive = known.where("toxic = 1").join(there, "id", "left_semi").select("id", F.lit(1).alias("positive")).orderBy(*order).limit(most_positive)
    unlabelled = there.orderBy(*order).limit(most_unlabelled).withColumn("positive", F.lit(0))
    chosen = positive.unionByName(unlabelled)  # bounded by the two parameters
    # A document may stand on both sides: what is unlabelled holds positives too. Of rows that share an id one is taken.
    sample = checkpointed(flat.join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.max("text").alias("text")).join(F.broadcast(chosen), "id").repartition(8, "id"))

    def count(batches):
        seen = np.zeros((2, 1 << BITS), np.int64)
        many = [0, 0]
        for pdf in batches:
            for side in (0, 1):
                own = pdf.text[pdf.positive == side]
                many[side] += len(own)
                for _, size, part in _blocks(*texts_of(pa.array(own, pa.large_string()))):
                    seen[side] += np.bincount(features(size, part) & ((1 << BITS) - 1), minlength=1 << BITS)
        at = np.flatnonzero(seen.sum(axis=0))
        yield pd.DataFrame({"n": [many], "at": [at], "unlabelled": [seen[0][at]], "positive": [seen[1][at]]})

    total, many = np.zeros((2, 1 << BITS)), np.zeros(2)
    for r in sample.select("text", "positive").mapInPandas(count, "n array<long>, at array<long>, unlabelled array<long>, positive array<long>").toPandas().itertuples():  # 8 rows
        total[0][r.at] += r.unlabelled
        total[1][r.at] += r.positive
        many += np.array(r.n)
    if not many[1] or not many[0]:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    rate_p, rate_u = total[1] / many[1], total[0] / many[0]
    # How many standard deviations lie between the rates; counts are smoothed, so that rare features don't stand out by chance.
    apart = np.abs(rate_p - rate_u) / np.sqrt((rate_p + rate_u + 1 / many.sum()) / many[1])
    some = np.flatnonzero(total.sum(axis=0) >= 3)
    kept = np.sort(some[np.argsort(-apart[some], kind="stable")[:most_features]])
    scale = (apart[kept] / max(apart[kept].max(initial=0), 1e-12)) ** 2
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))

    def gather(batches):
        for pdf in batches:
            for first, size, part in _blocks(*texts_of(pa.array(pdf.text, pa.large_string()))):
                pairs = features(size, part)
                pairs = pairs[place[pairs & ((1 << BITS) - 1)] >= 0]
                cuts = np.searchsorted(pairs >> BITS, np.arange(len(size) + 1))
                own = pdf.iloc[first : first + len(size)]
                yield pd.DataFrame({"id": own.id, "positive": own.positive, "own": [place[pairs[a:b] & ((1 << BITS) - 1)].astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})

    got = sample.mapInPandas(gather, "id long, positive int, own array<int>").toArrow().sort_by([("positive", "ascending"), ("id", "ascending")])
    del total, rate_p, rate_u, apart, some  # the driver holds the sample's features and the weights, no more
    own, positive = got.column("own").combine_chunks(), got.column("positive").to_numpy() == 1
    rows, columns = np.repeat(np.arange(len(own)), pc.list_value_length(own).to_numpy(zero_copy_only=False)), own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    del got, own
    w, b = non_negative_fit(rows, columns, positive, scale, prior)
    return Model(kept, w, b)


def score(model: Model):
    """A column function of texts: the score of each."""

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts))

    return toxicity


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = fitted(docs, labels, id_col=id_col, text_col=text_col, **options)
    scored = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col]).alias("held_out"), score(model)(docs[text_col].cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
