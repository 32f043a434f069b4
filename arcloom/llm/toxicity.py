"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from a linear model
over its words and their beginnings; a document's is their noisy-or,
1 - prod(1 - p). Only document labels train it, and the sentences whose own
probability is high are the offending ones.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, in_parts, load

BITS = 18
#: Documents that training may look at: a bound, whatever the size of the tables.
SAMPLE = 6000
STEPS, RATE, DECAY, BIAS = 100, 0.1, 1e-3, -6.0
#: Documents whose features are counted at once.
TOGETHER = 250
#: A feature is learnt if its odds differ by so many standard errors, and if that many training documents have it.
ERRORS, LEAST_DOCS = 5.5, 3
#: It starts at its log odds less so many standard errors.
SURE = 6.0
#: Added to a document's log odds. This, ERRORS, SURE and the features were chosen by cross-validation within the training rows.
SHIFT = 0.7
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]+")


def features(word: str) -> list[int]:
    """Hashed: the word, and its first 3 to 8 letters where more follow."""
    parts = [f"={word}", *(f"^{word[:k]}" for k in range(3, 9) if len(word) > k)]
    return [xxhash.xxh3_64_intdigest(p) & ((1 << BITS) - 1) for p in parts]


def tokens(text: str) -> list[str]:
    """Words, lower-cased one by one (a text's length can change by that), and ends of sentences."""
    return [t.lower() for t in TOKEN.findall(text)]


def is_end(token: str) -> bool:
    return token[0] in ".!?\n"


def evidence(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    """Twice the log likelihood ratio of a feature's counts in toxic and clean documents: a square of standard errors."""
    total, out = n_bad + n_good, 0.0
    for a, n in ((bad, n_bad), (good, n_good), (n_bad - bad, n_bad), (n_good - good, n_good)):
        both = bad + good if a is bad or a is good else total - bad - good
        out = out + np.where(a > 0, a * np.log(np.maximum(a, 1e-9) * total / (n * np.maximum(both, 1e-9))), 0.0)
    return 2 * out


def train(docs: list[str], labels: np.ndarray) -> np.ndarray:
    """Weights (2**BITS and a bias at the end), by Adam over all documents at once.

    Weights are not negative: a sentence offends by what it holds, nothing in it makes up
    for that. They start at the features' log odds and only sure ones are learnt.
    """
    ids: dict[str, int] = {}
    words, sentence_of, doc_of = array("i"), array("i"), array("i")
    sentence = -1
    for d, text in enumerate(docs):
        opened = False
        for t in tokens(text):
            if is_end(t):
                opened = False
                continue
            if not opened:
                sentence, opened = sentence + 1, True
                doc_of.append(d)
            words.append(ids.setdefault(t, len(ids)))
            sentence_of.append(sentence)
    w = np.zeros((1 << BITS) + 1)
    w[-1] = BIAS
    if not words or not len(np.unique(labels)) > 1:
        return w
    words, sentence_of, doc_of = (np.frombuffer(x, np.int32) for x in (words, sentence_of, doc_of))
    n_words, per_word, feats = len(ids), array("i"), array("q")
    for x in ids:
        listed = features(x)
        per_word.append(len(listed))
        feats.extend(listed)
    of_word, feats = np.repeat(np.arange(n_words), per_word), np.frombuffer(feats, np.int64)
    y = labels.astype(bool)
    # how many documents of either label have each feature
    pairs = np.unique(doc_of[sentence_of].astype(np.int64) * n_words + words)
    order = np.argsort(of_word, kind="stable")
    first, sorted_feats = np.searchsorted(of_word[order], np.arange(n_words + 1)), feats[order]
    docs_of, words_of = pairs // n_words, pairs % n_words
    bad, good = np.zeros(1 << BITS), np.zeros(1 << BITS)
    # some documents at a time, as all words' features together take many times the texts' size
    cuts = np.searchsorted(docs_of, np.arange(0, len(docs) + TOGETHER, TOGETHER))
    for a, b in zip(cuts, cuts[1:], strict=False):
        d, x = docs_of[a:b], words_of[a:b]
        counts = np.diff(first)[x]
        spread = np.repeat(first[x] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        both = np.unique(np.repeat(d, counts) << BITS | sorted_feats[spread])
        d, f = both >> BITS, both & ((1 << BITS) - 1)
        bad, good = bad + np.bincount(f, y[d], 1 << BITS), good + np.bincount(f, ~y[d], 1 << BITS)
    odds = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((good + 0.5) / ((~y).sum() + 1))
    learnt = (odds > 0) & (bad + good >= LEAST_DOCS) & (evidence(bad, good, y.sum(), (~y).sum()) >= ERRORS**2)
    w[:-1][learnt] = np.maximum(odds - SURE * np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5)), 0.1)[learnt]
    of_word, feats = of_word[learnt[feats]], feats[learnt[feats]]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        score = np.bincount(of_word, w[feats], n_words)
        z = np.clip(np.bincount(sentence_of, score[words], sentence + 1) + w[-1], -30, 30)
        total = np.maximum(np.bincount(doc_of, np.logaddexp(0, z), len(docs)), 1e-9)
        slope = np.where(y, -np.exp(-total) / -np.expm1(-total), 1.0)
        dz = slope[doc_of] / (1 + np.exp(-z)) / len(docs)
        g = np.empty_like(w)
        g[:-1] = np.bincount(feats, np.bincount(words, dz[sentence_of], n_words)[of_word], 1 << BITS)
        g[-1] = dz.sum()
        g[:-1] += DECAY * w[:-1] / len(docs)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w[:-1] = np.maximum(w[:-1], 0)
    return w


class Scores(dict):
    """Token (in any case) to score; the ends of sentences have NaN. Bounded."""

    def __init__(self, weights: np.ndarray, most: int = 400_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, token: str) -> float:
        if len(self) >= self.most:
            self.clear()
        self[token] = s = float("nan") if is_end(token) else float(sum(self.weights[k] for k in features(token.lower())))
        return s


def sentence_scores(text: str, scores: Scores) -> tuple[np.ndarray, np.ndarray]:
    """Each sentence's logit and its first token's index."""
    found = TOKEN.findall(text)
    s = np.fromiter(map(scores.__getitem__, found), float, len(found))
    word = ~np.isnan(s)
    starts = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])))
    if not len(starts):
        return np.empty(0), starts
    return np.add.reduceat(np.where(word, s, 0.0), starts) + scores.weights[-1], starts


def score(text: str, scores: Scores) -> tuple[float, list[dict]]:
    """The document's probability, and the sentences (code points of text) that alone reach 0.5."""
    z, starts = sentence_scores(text, scores)
    clean = np.logaddexp(0, np.clip(z, -30, 30)).sum()  # -log of the probability that no sentence offends
    p = float(-np.expm1(-clean) / (-np.expm1(-clean) + np.exp(-clean - SHIFT)))
    bad = np.flatnonzero(z >= 0)
    if not len(bad):
        return p, []
    at = [(m.start(), m.end(), is_end(m[0])) for m in TOKEN.finditer(text)]
    ends = np.append(starts[1:], len(at))
    out = []
    for k in bad:
        last = int(ends[k]) - 1
        while at[last][2]:
            last -= 1
        out.append({"start": at[starts[k]][0], "end": at[last][1], "score": float(1 / (1 + np.exp(-z[k])))})
    return p, out


def fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, labels = [], []
    for batch in batches:
        docs += [x or "" for x in batch.column("text").to_pylist()]
        labels += batch.column("label").to_pylist()
    batch = None  # docs has its texts
    order = sorted(range(len(docs)), key=lambda k: (docs[k], labels[k]))
    weights = train([docs[k] for k in order], np.array([labels[k] for k in order]))
    docs = order = None
    give_back()
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary())], ["weights"])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most `sample` labelled documents that aren't held out, picked by a hash of doc_id.

    Rows with a null doc_id or label are not used; of an id with several labels the largest
    counts, and of several texts under an id the one with the least hash. The bound holds at
    every size, so one task trains. Without both labels, or any rows, the model is its bias.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    # a first cut by the hash leaves a few more than `sample` at any size, so that sorting them is small
    n = known.count()
    place = F.xxhash64("doc_id").bitwiseAND(F.lit(2**63 - 1)) / F.lit(2.0**63)
    near = known.where(place <= F.lit(min(1.0, (1.2 * sample + 200) / max(n, 1))))
    if n > sample and not near.limit(sample).count() == sample:
        near = known
    picked = near.orderBy(place, "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), F.struct(F.xxhash64("text"), "text")).alias("r")).select("r.*")
    out = rows.coalesce(1).mapInArrow(fit_batches, "weights binary").first()
    if out is None:  # no partition, so no task ran
        return train([], np.empty(0, int))
    return np.frombuffer(out[0], np.float32).astype(float)


def score_toxicity(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Adds score (double), predicted (int) and offending (array of start, end, score) to docs.

    Only `text` is an input; a null or empty text scores 0. Columns of those names are
    replaced; repeated rows score alike; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    kept = docs.drop("score", "predicted", "offending")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(sent.value.astype(float))
        for batch in in_parts(batches):
            rows = [score(x or "", scores) for x in batch.column("text").to_pylist()]
            p = np.array([x[0] for x in rows])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([x[1] for x in rows], span)], [*batch.schema.names, "score", "predicted", "offending"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return kept.mapInArrow(batches_of, ", ".join([*fields, "score double, predicted int, offending array<struct<start:int,end:int,score:double>>"]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))
