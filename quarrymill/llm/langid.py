"""Language identification by hierarchical discrimination.

A text's letters become a vector of hashed letter trigrams.  One-versus-rest linear
support vector machines predict the language family; within the family, one-versus-one
machines separate each pair of languages.  Training needs text and language only and
takes a bounded sample of labelled rows, ``per_language`` of each language and ``ROWS`` in all;
the driver gets their sparse vectors, ``ENTRIES`` places in all, and trains on those as they
are.  No text is too long to be learned from, and every text is scored whole, in blocks of
bounded size.

Defined results: a null text, or one without a letter (Unicode category L), gives ``und`` with
score 0; with no labelled row at all, every text gives ``und``; with one learned language, every
text with a letter gives it.  Ties go to the first family, and then language, by name.  Equal
texts get equal results, whatever else their rows hold; columns of other names are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import bounded_batches, held_out, pick

# Language codes (ISO 639-1) by family.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "celtic": "br cy ga gd gv kw",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "indo-aryan": "as bn gu hi mr ne or pa si ur",
    "dravidian": "kn ml ta te",
    "turkic": "az kk ky tk tr uz",
    "semitic": "am ar he mt",
    "sinitic": "zh yue",
}

BITS = 13
SIZE = 1 << BITS
#: Bytes of a text that are counted at once.
BLOCK = 1 << 20
LETTER = regex.compile(r"\p{L}")
#: Most labelled rows that are trained on, and most places of their vectors (6 bytes each).
ROWS, ENTRIES = 40_000, 16_000_000
#: ASCII that is no letter becomes a blank; bytes of other characters stay.
_KEEP = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def family_of(lang: str) -> str:
    """The family of a language code; an unknown code is a family of its own."""
    base = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if base in codes.split()), f"own:{lang}")


def trigram_counts(text: str) -> np.ndarray:
    """Counts of the hashed trigrams of a text's lower-cased letters, words set off by blanks."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_KEEP).split()) + b" "
    counts = np.zeros(SIZE, np.int64)
    for at in range(0, len(data) - 2, BLOCK):
        a = np.frombuffer(data[at : at + BLOCK + 2], np.uint8).astype(np.uint32)
        code = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=SIZE)
    return counts


def vector(text: str) -> np.ndarray:
    """Square roots of the trigrams' shares: a vector of length 1."""
    counts = trigram_counts(text)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


@dataclass
class Rows:
    """Sparse rows: where each starts, and the places and values of all; a 1 for the bias is understood."""

    start: np.ndarray
    place: np.ndarray
    value: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        """The product with a vector of SIZE + 1."""
        sums = np.concatenate(([0.0], np.cumsum(w[self.place] * self.value, dtype=np.float64)))
        return (sums[self.start[1:]] - sums[self.start[:-1]] + w[-1]).astype(np.float32)

    def gathered(self, v: np.ndarray) -> np.ndarray:
        """The transposed product with a vector of the rows."""
        each = np.repeat(v, np.diff(self.start)) * self.value
        return np.append(np.bincount(self.place, each, SIZE), v.sum()).astype(np.float32)

    def only(self, rows: np.ndarray) -> Rows:
        """The rows marked by a boolean each."""
        size = np.diff(self.start)
        inside = np.repeat(rows, size)
        return Rows(np.concatenate(([0], np.cumsum(size[rows]))), self.place[inside], self.value[inside])


def fit_svm(x: Rows, y: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """A linear support vector machine with squared hinge loss, by accelerated gradient
    descent; classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    # With the bias the rows have length sqrt(2), so the gradient's Lipschitz constant is at most 4 + penalty.
    step, w, last = 1 / (4 + penalty), np.zeros(SIZE + 1, np.float32), np.zeros(SIZE + 1, np.float32)
    for k in range(rounds):
        ahead = w + (k / (k + 3)) * (w - last)
        slack = np.maximum(0, 1 - y * x.times(ahead))
        grad = penalty * ahead - 2 * x.gathered(weight * slack * y)
        last, w = w, (ahead - step * grad).astype(np.float32)
    return w


@dataclass
class LanguageModel:
    """families: the names; langs: of each family; top: weights by family; pairs: by pair."""

    families: list[str] = field(default_factory=list)
    langs: list[list[str]] = field(default_factory=list)
    top: np.ndarray | None = None
    pairs: list[list[tuple[int, int, np.ndarray]]] = field(default_factory=list)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.families or not LETTER.search(text):
            return "und", 0.0
        x = np.append(vector(text), np.float32(1))
        share = 1.0
        f = 0
        if len(self.families) > 1:
            z = 1 / (1 + np.exp(-3 * (self.top @ x).astype(np.float64)))
            f = int(z.argmax())
            share = float(z[f] / z.sum())
        votes = np.zeros(len(self.langs[f]))
        for i, j, w in self.pairs[f]:
            p = 1 / (1 + np.exp(-3 * float(w @ x)))
            votes[i] += p
            votes[j] += 1 - p
        best = int(votes.argmax())
        inner = votes[best] / max(1, len(votes) - 1) if len(votes) > 1 else 1.0
        return self.langs[f][best], float(min(1.0, max(0.0, share * inner)))


def sparse(v: np.ndarray, most: int = SIZE) -> bytes:
    """A vector's places and values; the greatest ``most`` of them."""
    at = np.flatnonzero(v)
    if len(at) > most:
        at = np.sort(at[np.argsort(-v[at], kind="stable")[:most]])
    return at.astype(np.uint16).tobytes() + v[at].astype(np.float16).tobytes()


def fit(labelled: list[tuple[str, bytes]]) -> LanguageModel:
    """Trains on rows of a language and a sparse vector."""
    labelled = sorted(labelled)
    names = sorted({lang for lang, _ in labelled})
    if not names:
        return LanguageModel()
    sizes = [len(raw) // 4 for _, raw in labelled]
    x = Rows(
        np.concatenate(([0], np.cumsum(sizes))), np.concatenate([np.frombuffer(raw, np.uint16, n) for n, (_, raw) in zip(sizes, labelled, strict=True)]),
        np.concatenate([np.frombuffer(raw, np.float16, n, 2 * n) for n, (_, raw) in zip(sizes, labelled, strict=True)]).astype(np.float32),
    )
    y = np.array([names.index(lang) for lang, _ in labelled])
    kin = [family_of(n) for n in names]
    families = sorted(set(kin))
    own = [[i for i, k in enumerate(kin) if k == f] for f in families]
    top = None
    if len(families) > 1:
        top = np.stack([fit_svm(x, np.where(np.isin(y, members), 1, -1).astype(np.float32)) for members in own])
    pairs = []
    for members in own:
        made = []
        for (i, a), (j, b) in combinations(enumerate(members), 2):
            rows = np.isin(y, (a, b))
            made.append((i, j, fit_svm(x.only(rows), np.where(y[rows] == a, 1, -1).astype(np.float32))))
        pairs.append(made)
    return LanguageModel(families, [[names[i] for i in members] for members in own], top, pairs)


def train(spark: SparkSession, docs: DataFrame, per_language: int = 500) -> LanguageModel:
    """Fits on about ``per_language`` rows of each language (fewer where languages are many),
    chosen by a hash: a bounded sample, sent to the driver as sparse vectors."""
    bounded_batches(spark)
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # Rows alike in id and text count once, and are drawn once.
    rows = rows.withColumn("own", F.xxhash64("doc_id", "text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("own").alias("count")).orderBy(F.desc("count"), "lang").limit(ROWS).collect()  # a row for each language
    if not counts:
        return LanguageModel()
    each = max(1, min(per_language, ROWS // len(counts)))
    shares = spark.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in counts], "lang string, share double")
    sample = rows.join(F.broadcast(shares), "lang").where(pick(F.col("share"), F.col("own"))).groupBy("lang", "own").agg(F.min("text").alias("text"))
    most = max(64, min(SIZE, ENTRIES // (2 * each * len(counts))))

    @F.arrow_udf("binary")
    def features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            out = []
            for text in batch.to_pylist():
                if not LETTER.search(text):
                    out.append(b"")
                    continue
                out.append(sparse(vector(text), most))
            yield pa.array(out, pa.binary())

    rows = sample.select("lang", features("text").alias("x")).where(F.octet_length("x") > 0)
    return fit([(r["lang"], bytes(r["x"])) for r in rows.toLocalIterator()])


def predict(spark: SparkSession, docs: DataFrame, model: LanguageModel, text: str = "text") -> F.Column:
    """A column struct<lang_pred, score> for the whole text of each row of docs."""
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)  # weights only: bounded by the number of languages

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held.value
        for batch in texts:
            got = [own.predict(text) for text in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["lang_pred", "score"])

    return run.asNondeterministic()(docs[text])


def identify(spark: SparkSession, docs: DataFrame, per_language: int = 500) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    docs = docs.select("doc_id", "text", "lang")
    found = predict(spark, docs, train(spark, docs, per_language))
    return docs.select("doc_id", held_out().alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")
