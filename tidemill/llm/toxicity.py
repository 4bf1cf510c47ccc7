"""Toxicity by weak supervision.

Voters are lexicons of words and word beginnings, mined by their document
frequencies in a bounded sample of labelled texts; a voter that meets one of
its marks in a text votes toxic, else it abstains. From the votes of all texts to learn
from, and no labels, a generative model estimates for each voter how often it
votes in toxic and in other texts, and how voters go together within a class:
a voter that says what others say counts for less. Its posterior labels train
a linear classifier on votes and measures of form, which gives the score.

Each text is read once for its votes, a number of 64 bits, and nothing is
shuffled but counts. EM rounds run over the distinct vote patterns as Spark
jobs that return sums of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontamination import _trimmed
from .lm_scoring import held_out
from .tables import keep
from .text import Texts, signed, span_hashes, texts

VOTERS = 64  # one bit each
MARKS = 8192  # of all voters together
SAMPLE = 30_000  # labelled texts to mine from, and texts to fit the classifier on
BEGINNINGS = (4, 5, 6, 7)  # bytes
_AGAIN = np.uint64(0xA6A1)
ROUNDS = 12
_FORM = ("upper", "shout", "signs", "size")
_UPPER, _SIGN = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_SIGN[[ord(c) for c in "#*$%&|<>"]] = True


def _marks(part: Texts, only: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, lexicon of each, text of each) of words, beginnings of words and beginnings met again; a lexicon is a shortest beginning.

    ``only``: sorted hashes to look for, of marks as they are before they are met again.
    """
    own = np.repeat(np.arange(len(part)), part.counts)
    if not len(own):
        return
    sizes, words = part.ends - part.starts, span_hashes(part.data, part.starts, part.ends)
    least = np.where(sizes > BEGINNINGS[0], span_hashes(part.data, part.starts, part.starts + np.minimum(sizes, BEGINNINGS[0])) ^ np.uint64(BEGINNINGS[0]), words)
    yield _only(words, least, own, only)
    for size in BEGINNINGS:
        long = sizes > size
        if long.any():
            starts = part.starts[long]
            keys, lexicon, of = _only(span_hashes(part.data, starts, starts + size) ^ np.uint64(size), least[long], own[long], only)
            yield keys, lexicon, of
            order = np.lexsort((keys, of))  # a beginning that a text has again says more
            keys, lexicon, of = keys[order], lexicon[order], of[order]
            again = np.flatnonzero((keys[1:] == keys[:-1]) & (of[1:] == of[:-1]))
            if len(again):
                yield keys[again] ^ _AGAIN, lexicon[again], of[again]


def _only(keys: np.ndarray, lexicon: np.ndarray, own: np.ndarray, only: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if only is None:
        return keys, lexicon, own
    at = np.searchsorted(only, keys)
    at[at == len(only)] = 0
    hit = np.flatnonzero(only[at] == keys)
    return keys[hit], lexicon[hit], own[hit]


def sampled(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic) of the ``sample`` labelled doc_ids of the smallest hash; where a doc_id has several labels, their mean decides."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    return known.agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def mine(docs: DataFrame, few: DataFrame, voters: int = VOTERS, least: int = 4, precision: float = 0.95) -> list[tuple[int, int]]:
    """(hash, voter) of marks: the lexicons with the most frequent marks, each with its marks.

    A mark is in ``least`` sampled toxic texts, and ``precision`` of the sampled texts that have it are toxic.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for part in texts(batch.column("text"), lower=True):
                part = _trimmed(part)
                found = list(_marks(part))
                if not found:
                    continue
                keys, lexicon, own = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((own, keys))
                keys, lexicon, own = keys[order], lexicon[order], own[order]
                once = np.append(True, (keys[1:] != keys[:-1]) | (own[1:] != own[:-1]))
                keys, lexicon, bad = keys[once], lexicon[once], toxic[part.first + own[once]]
                cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                total = np.diff(np.append(cuts, len(keys)))
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys[cuts])), pa.array(signed(lexicon[cuts])), pa.array(total), pa.array(np.add.reduceat(bad, cuts))], names=["key", "lexicon", "n", "toxic"])

    counts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", F.col("toxic").cast("bigint").alias("toxic")).mapInArrow(count, "key bigint, lexicon bigint, n bigint, toxic bigint")
    counts = counts.groupBy("key", "lexicon").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    good = keep(counts.where((F.col("toxic") >= least) & (F.col("toxic") >= precision * F.col("n"))), "marks")
    best = good.groupBy("lexicon").agg(F.max("toxic").alias("most")).orderBy(F.desc("most"), "lexicon").limit(voters)
    found = best.join(good, "lexicon").orderBy(F.desc("most"), "lexicon", F.desc("toxic"), "key").select("key", "lexicon").limit(MARKS).collect()
    order = {x: k for k, x in enumerate(dict.fromkeys(r.lexicon for r in found))}
    return [(r.key, order[r.lexicon]) for r in found]


def votes(docs: DataFrame, marks: list[tuple[int, int]]) -> DataFrame:
    """doc_id, held_out (kept as given), votes (bit k: voter k) and measures of form of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, voter = np.array(marks, dtype=np.int64).reshape(-1, 2).T
        known = np.ascontiguousarray(known).view(np.uint64)
        order = np.argsort(known)
        known, voter = known[order], voter[order].astype(np.uint64)
        only = np.unique(np.concatenate([known, known ^ _AGAIN]))
        for batch in batches:
            for raw, whole in zip(texts(batch.column("text")), texts(batch.column("text"), lower=True)):
                part = _trimmed(whole)
                bits = np.zeros(len(part), dtype=np.uint64)
                for keys, _, own in _marks(part, only) if len(known) else ():
                    at = np.searchsorted(known, keys)
                    at[at == len(known)] = 0
                    hit = known[at] == keys
                    np.bitwise_or.at(bits, own[hit], np.uint64(1) << voter[at[hit]])
                size = np.maximum(1, np.diff(raw.offsets))
                share = [_per_text(raw, flags) / size for flags in (_UPPER[raw.data], raw.data == ord("!"), _SIGN[raw.data])]
                cols = [pa.array(signed(bits)), *(pa.array(x) for x in share), pa.array(np.log1p(raw.counts))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(raw.first, len(raw)) for c in ("doc_id", "held_out")), *cols], names=["doc_id", "held_out", "votes", *_FORM])

    kinds = "doc_id bigint, held_out boolean, votes bigint, " + ", ".join(f"{c} double" for c in _FORM)
    return docs.mapInArrow(run, kinds)


def _per_text(part: Texts, flags: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[part.offsets[1:]] - total[part.offsets[:-1]]


def _bits(column: np.ndarray, voters: int) -> np.ndarray:
    return (column.view(np.uint64)[:, None] >> np.arange(voters, dtype=np.uint64) & np.uint64(1)).astype(np.float64)


@dataclass
class LabelModel:
    """Of other and toxic texts: how many get a vote at all, and from which voters; which voters go together; the share of toxic texts."""

    rates: np.ndarray  # 2, voters
    covered: np.ndarray  # 2
    correlation: np.ndarray  # voters, voters
    prior: float

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        weight = 1 / (1 + np.maximum(0, self.correlation - np.eye(len(self.correlation))).sum(1))
        r, c = np.clip(self.rates, 1e-6, 1), np.clip(self.covered, 1e-6, 1 - 1e-6)
        given = r / c[:, None]  # a vote's rate among texts that get any
        gain = cast @ (weight * np.log(given[1] / given[0]))
        gain += np.where(cast.any(1), np.log(c[1] / c[0]), np.log((1 - c[1]) / (1 - c[0])))
        return 1 / (1 + np.exp(-np.clip(gain + np.log(self.prior / (1 - self.prior)), -50, 50)))


def fit_label_model(patterns: DataFrame, voters: int, rounds: int = ROUNDS) -> LabelModel:
    """EM over (votes, toxic, n) patterns, from the guess that any vote means toxic.

    Where toxic is known it stands: without such anchors, voters that never
    vote together could be of either class.
    """
    wide_size = voters + 2

    def sums(model: LabelModel | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, wide_size, wide_size))
            for batch in batches:
                cast = _bits(batch.column("votes").to_numpy(), voters)
                some = cast.any(1).astype(float)
                told = batch.column("toxic").fill_null(-1).to_numpy()
                toxic = np.where(told >= 0, told, some if model is None else model.posterior(cast))
                wide = np.hstack([cast, some[:, None], np.ones((len(cast), 1))])
                for y, share in enumerate((1 - toxic, toxic)):
                    total[y] += (wide * (share * batch.column("n").to_numpy())[:, None]).T @ wide
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

        rows = patterns.mapInArrow(run, "sums binary").collect()
        return sum((np.frombuffer(r.sums).reshape(2, wide_size, wide_size) for r in rows), np.zeros((2, wide_size, wide_size)))

    model = None
    for _ in range(rounds):
        total = sums(model)
        n = total[:, -1, -1]
        rates = (total[:, :-1, -1] + 0.01) / (n[:, None] + 1)
        rates, covered = rates[:, :-1], rates[:, -1]
        both = total[1, :voters, :voters] / max(n[1], 1e-9)
        spread = np.sqrt(np.clip(rates[1] * (1 - rates[1]), 1e-9, None))
        correlation = np.clip((both - np.outer(rates[1], rates[1])) / np.outer(spread, spread), -1, 1)
        np.fill_diagonal(correlation, 1)
        model = LabelModel(rates, covered, correlation, float(np.clip(n[1] / max(n.sum(), 1), 1e-4, 0.5)))
    return model


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the constant, which has no penalty."""
    wide = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(wide.shape[1])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(wide @ w, -30, 30)))
        slope = wide.T @ (target - p) - penalty * w
        bend = (wide * (p * (1 - p))[:, None]).T @ wide + np.diag(penalty + 1e-9)
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _features(rows: pa.RecordBatch | pa.Table, voters: int) -> np.ndarray:
    form = np.stack([rows.column(c).to_numpy() for c in _FORM], 1)
    return np.hstack([_bits(rows.column("votes").to_numpy(), voters), form])


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3, folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on) and votes (how many voters) of every row.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic (0 or 1; where a
    doc_id has several, their mean decides); other columns are not read.
    Nothing is learned from held-out rows. A null or empty text has no votes
    and the score of a text without any. Rows that repeat a doc_id are scored
    each. Without labels to learn from there are no voters and every score is 0.
    """
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out("doc_id", folds, fold).alias("held_out"))
    few = keep(sampled(labels.where(~held_out("doc_id", folds, fold)), sample), "labelled")
    marks = mine(read.where("not held_out"), few)
    cast = keep(votes(read, marks), "votes")
    n = 1 + max((k for _, k in marks), default=-1)
    if n:
        learn = cast.where("not held_out")
        told = learn.join(F.broadcast(few), "doc_id", "left")
        model = fit_label_model(keep(told.groupBy("votes", "toxic").agg(F.count(F.lit(1)).alias("n")), "patterns"), n)
        few = learn.orderBy(F.xxhash64("doc_id"), "doc_id", "votes").limit(sample).select("votes", *_FORM).toArrow().combine_chunks()
        x = _features(few, n)
        weights = fit_linear(x, model.posterior(x[:, :n]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if n:
                z = _features(b, n) @ weights[:-1] + weights[-1]
                found = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            else:
                found = np.zeros(b.num_rows)
            many = np.bitwise_count(b.column("votes").to_numpy().view(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(found), pa.array((found >= threshold).astype(np.int32)), pa.array(many)],
                names=["doc_id", "held_out", "score", "predicted", "votes"],
            )

    return cast.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, votes int")
