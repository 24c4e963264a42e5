"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is logistic in its words and
their beginnings (compounds and endings share them); the document's is the noisy-or of its sentences, 1 - prod(1 - p).  The weights are trained from
document labels alone, by gradient ascent on the noisy-or likelihood, and then tell which
sentences offend.

Training takes a bounded sample of labelled rows (``max_rows``, of at most ``max_chars``
characters each); every text is scored whole.  Defined results: a null or empty text is a
bag without sentences and gets score 0; without labelled rows of both kinds every score
is 0; repeated rows get equal scores, ties at the threshold count as toxic; an id that labels mark
both ways is toxic, and a null id is neither trained on nor held out; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import bounded_batches, held_out, pick

#: Runs up to a full stop, question or exclamation mark (Latin, Arabic, Devanagari, CJK, Ethiopic,
#: Armenian) or a line's end.
SENTENCE = re.compile(r"[^.!?\n\u0589\u061F\u06D4\u0964\u0965\u1362\u1367\u203C-\u203D\u2047-\u2049\u3002\uFE52\uFE56\uFE57\uFF01\uFF0E\uFF1F\uFF61]+")
WORD = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.3
#: Lengths of the beginnings that are features beside the words.
STEMS = (4, 5, 7)
#: Features that training takes whatever their z-scores.
SURE = 100
#: Words whose known features a worker remembers.
REMEMBERED = 200_000


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the runs without an end of a sentence or line that aren't blank."""
    return [m.span() for m in SENTENCE.finditer(text) if not m[0].isspace()]


@dataclass
class ToxicityModel:
    bias: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)
    memo: dict[str, list[str]] = field(default_factory=dict, repr=False)

    def sentence(self, found: set[str]) -> float:
        z = self.bias + sum(self.weights[f] for f in found)
        return float(1 / (1 + np.exp(-max(-60.0, min(60.0, z)))))

    def known(self, words: set[str]) -> dict[str, list[str]]:
        """The features with a weight, of those words that have any."""
        memo, out = self.memo, {}
        for w in words:
            got = memo.get(w)
            if got is None:
                if len(memo) >= REMEMBERED:
                    memo.clear()
                got = memo[w] = [f for f in features(w) if f in self.weights]
            if got:
                out[w] = got
        return out

    def score(self, text: str | None, sentence_threshold: float = 0.5) -> tuple[float, int, list[tuple[int, int, float]]]:
        """The document's score, its number of sentences, and the offending spans."""
        if not text or not self.weights:
            return 0.0, len(sentences(text)) if text else 0, []
        lower = text.lower()
        if len(lower) != len(text):  # lower-casing would move the spans
            lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        spans = sentences(lower)
        known = self.known(set(WORD.findall(lower)))
        plain = float(np.log1p(-self.sentence(set())))
        none, out = 0.0, []
        for a, b in spans:
            found = {f for w in known.keys() & set(WORD.findall(lower, a, b)) for f in known[w]} if known else ()
            if not found:
                none += plain
                continue
            p = self.sentence(found)
            none += float(np.log1p(-min(p, 1 - 1e-12)))
            if p >= sentence_threshold:
                out.append((a, b, p))
        return min(1.0, max(0.0, -float(np.expm1(none)))), len(spans), out


def fit(
    rows: list[tuple[str, int]], most: int = 2000, least: int = 8, rounds: int = 250, penalty: float = 1e-3, clear: float = 4.0, hidden: float = 0.3, shrink: float = 0.93
) -> ToxicityModel:
    """Trains on (text, label) rows.  The features are those that part the labels best,
    by a z-score of their document frequencies: at most ``most``, and beyond the first ``SURE``
    only those with a score of ``clear``, which thousands of chance scores seldom reach.

    A bag that one sentence explains teaches the others nothing, so a word that mostly stands beside
    stronger ones would keep a small weight.  Each round therefore hides a seeded ``hidden`` share of the
    features, and the weights, learnt with fewer in sight, are shrunk at the end.  ``penalty``, ``clear``, ``hidden`` and
    ``shrink`` were chosen by threefold cross-validation inside the training fold."""
    rows = sorted(rows)
    labels = np.array([y for _, y in rows], np.float64)
    if not len(rows) or labels.min() == labels.max():
        return ToxicityModel()
    # Two passes over the texts, so that features are held as numbers only.
    df, hot = Counter(), Counter()
    for text, y in rows:
        found = {f for w in set(WORD.findall(text.lower())) for f in features(w)}
        df.update(found)
        if y:
            hot.update(found)
    base = labels.mean()
    z = {f: (hot[f] - n * base) / np.sqrt(n * base * (1 - base)) for f, n in df.items() if n >= least}
    chosen = [f for k, f in enumerate(sorted(sorted(z), key=lambda f: -abs(z[f]))[:most]) if k < SURE or abs(z[f]) >= clear]
    index = {f: i for i, f in enumerate(chosen)}
    feature, sentence, doc = array("q"), array("q"), array("q")
    for d, (text, _) in enumerate(rows):
        text = text.lower()
        for a, b in sentences(text):
            got = sorted({index[f] for w in set(WORD.findall(text, a, b)) for f in features(w) if f in index})
            feature.extend(got)
            sentence.extend([len(doc)] * len(got))
            doc.append(d)
    feature, sentence, doc = (np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for x in (feature, sentence, doc))
    n = len(doc)
    w, bias = np.zeros(len(chosen)), -5.0
    m, v, beta = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), (0.9, 0.99)
    rng = np.random.default_rng(42)
    for k in range(1, rounds + 1):
        seen = rng.random(len(chosen)) >= hidden
        logit = np.clip(bias + np.bincount(sentence, (w * seen)[feature], n), -30, 30)
        p = 1 / (1 + np.exp(-logit))
        none = np.bincount(doc, np.log1p(-p), len(rows))
        bag = np.clip(-np.expm1(none), 1e-9, 1)
        # The gradient of the bag's log-likelihood by a sentence's logit.
        pull = np.where(labels == 1, np.exp(none) / bag, -1.0)[doc] * p
        grad = np.append(np.bincount(feature, pull[sentence], len(chosen)) * seen, pull.sum()) / len(rows)
        grad[:-1] -= penalty * w / 10
        m = beta[0] * m + (1 - beta[0]) * grad
        v = beta[1] * v + (1 - beta[1]) * grad**2
        move = 0.1 * (m / (1 - beta[0] ** k)) / (np.sqrt(v / (1 - beta[1] ** k)) + 1e-8)
        w, bias = w + move[:-1], bias + move[-1]
    return ToxicityModel(float(bias), {c: float(x) for c, x in zip(chosen, w * shrink, strict=True) if abs(x) >= 0.05})


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_chars: int = 20_000) -> ToxicityModel:
    """Fits on at most about max_rows labelled rows outside the held-out fold, chosen by a hash."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = marks.count()
    marks = marks.where(pick(F.lit(min(1.0, max_rows / max(1, total))), F.col("doc_id")))
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, max_chars) & ~held_out())
    # An id that many rows have counts once: one text for each, the least by digest.
    texts = texts.where(pick(F.lit(min(1.0, max_rows / max(1, total))), F.col("doc_id")))
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("digest"), "text")).alias("t")).select("doc_id", "t.text")
    rows = texts.join(marks, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    return fit([(r["text"], r["toxic"]) for r in rows.toLocalIterator()])


def scores(spark: SparkSession, docs: DataFrame, model: ToxicityModel, text: str = "text", sentence_threshold: float = 0.5) -> F.Column:
    """struct<score, n_sentences, offending array<struct<start, end, p>>> of each whole text."""
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)  # at most ``most`` weights

    @F.arrow_udf("struct<score:double,n_sentences:long,offending:array<struct<start:long,end:long,p:double>>>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for batch in texts:
            got = [own.score(t, sentence_threshold) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), pa.array([[{"start": a, "end": b, "p": p} for a, b, p in g[2]] for g in got], kind)],
                names=["score", "n_sentences", "offending"],
            )

    return run.asNondeterministic()(docs[text])


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences and the offending sentences' spans."""
    docs = docs.select("doc_id", "text")
    model = train(spark, docs, labels, max_rows)
    found = docs.select("doc_id", held_out().alias("held_out"), scores(spark, docs, model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.score").alias("score"), (F.col("found.score") >= THRESHOLD).cast("int").alias("predicted"), "found.n_sentences", "found.offending")
