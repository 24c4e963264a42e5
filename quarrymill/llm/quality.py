"""Quality rules on tokeniser fertility.

The base rules count words, symbols, repeated lines and repeated word windows.  The method
then measures, with a public vocabulary, a text's characters per token, the share of byte
fallback among its tokens and the entropy of its tokens, and rejects what lies outside two
kinds of bands:

* fixed ones by script (the script of most of its letters), wide, for any corpus;
* fitted ones by language, or by script where a text has no language or a rare one.  Over all
  documents that pass the base rules the fit takes the median characters per token and the
  quartiles of the deviation from it times the square root of the tokens (short texts deviate
  more), and the quartiles of the entropy among texts of about as many tokens (by powers of
  two).  A text's deviations are counted in these widths; too little of both together (their
  length as a vector) is beyond ``REJECT``, too much of one beyond twice that.

A group is fitted from ``LEAST`` documents, at most ``GROUPS`` languages are, and a power of two
from ``LEAST_SIZED``; where there is no fit, the fixed bands stand alone.  Quartiles come from
counts of rounded values, so they are exact and reruns agree.

Words are tokenised by themselves, each with its leading blank; a worker remembers up to
REMEMBERED words.  Every count is exact and over the whole text: repeated windows are found
by ranks of doubled length (1, 2, 4, 8 words), not by hashes.

Defined results: null is a text without words; a text without words fails the base rules and
has chars_per_token, fallback_share and entropy 0; a text without letters has script "none",
whose band no run of numbers or signs meets; a table without the column lang is fitted by
script; repeated rows get equal results; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import Scratch, bounded_batches
from quarrymill.llm.pieces import VOCABULARY, read_vocabulary

# Wide bands by script: least and most characters per token, most byte fallback,
# least entropy in bits (of a text of ENTROPY_FROM tokens or more; less for a shorter one).
BANDS = {
    "latin": (1.2, 12.0, 0.20, 3.0),
    "cyrillic": (1.0, 12.0, 0.20, 3.0),
    "greek": (0.7, 12.0, 0.40, 3.0),
    "han": (0.4, 6.0, 0.70, 3.0),
    "kana": (0.4, 6.0, 0.60, 3.0),
    "hangul": (0.3, 6.0, 0.90, 3.0),
    "arabic": (0.6, 12.0, 0.50, 3.0),
    "hebrew": (0.6, 12.0, 0.50, 3.0),
    "other": (0.2, 12.0, 1.00, 2.0),
    "none": (1.6, 12.0, 0.20, 3.0),
}
ENTROPY_FROM = 64
#: Widths of the fitted bands.
REJECT = 4.5
#: Documents of a group, and of a power of two of tokens in it, from which bands are fitted.
LEAST, LEAST_SIZED = 100, 40
#: Most languages that are fitted: those of more than a GROUPS-th of the documents.
GROUPS = 1000
#: Least widths of characters per token (times the root of the tokens) and of entropy.
WIDTH, BITS = 0.3, 0.05
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Blank, \t, \n, \v, \f, \r.
BLANKS = " \t\n\x0b\x0c\r"
REMEMBERED = 200_000
_PREFIX = {"LATIN": "latin", "CYRILLIC": "cyrillic", "GREEK": "greek", "CJK": "han", "HIRAGANA": "kana", "KATAKANA": "kana", "HANGUL": "hangul", "ARABIC": "arabic", "HEBREW": "hebrew"}
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_LETTER = re.compile(r"[^\W\d_]")
_SCRIPTS: dict[str, str] = {}


def script_of_letter(char: str) -> str:
    if char not in _SCRIPTS:
        _SCRIPTS[char] = _PREFIX.get(unicodedata.name(char, "?").split()[0], "other")
    return _SCRIPTS[char]


def script_of(letters: Counter) -> str:
    """The script of most letters; ties go by name."""
    by = Counter()
    for c, n in letters.items():
        if _LATIN.match(c):
            by["latin"] += n
        elif _LETTER.match(c):
            by[script_of_letter(c)] += n
    return min(by, key=lambda s: (-by[s], s)) if by else "none"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of 8 which the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    size = 1
    while size < WINDOW:
        pair = rank[:-size] * (int(rank.max()) + 1) + rank[size:]
        size *= 2
        if size == WINDOW:
            rank = pair[:n]
        else:
            rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(rank, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[inverse] > 1)
    if not len(twice):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: str) -> tuple[list[bytes], int, int, int, int]:
    """words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(BLANKS):
            seen.add(line)
    return words, len(text) - sum(text.count(c) for c in BLANKS), sum(text.count(c) for c in SYMBOLS), again, repeated_words(words)


class Fertility:
    def __init__(self, raw: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        self.memo: dict[bytes, list[int]] = {}

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the text's words and how often each stands."""
        counts, memo = Counter(words), self.memo
        if len(memo) > REMEMBERED:
            memo.clear()
        new = [w for w in counts if w not in memo]
        if new:
            memo.update(zip(new, self.sp.encode([w.decode("utf-8", "replace") for w in new], num_threads=1), strict=True))
        lists = [memo[w] for w in counts]
        flat = np.array([i for ids in lists for i in ids], np.int64)
        times = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), np.fromiter(map(len, lists), np.int64, len(lists)))
        ids, inverse = np.unique(flat, return_inverse=True)
        return ids, np.bincount(inverse, times, len(ids))

    def measure(self, words: list[bytes], chars: int) -> tuple[int, float, float, float]:
        """Tokens, characters per token, share of byte fallback, entropy in bits."""
        if not words:
            return 0, 0.0, 0.0, 0.0
        ids, times = self.tokens(words)
        n = int(times.sum())
        share = times / n
        return n, chars / n, float(times[self.is_byte[ids]].sum() / n), max(0.0, float(-(share * np.log2(share)).sum()))


_METERS: dict[int, Fertility] = {}


def verdict(script: str, n: int, per: float, fallback: float, entropy: float, bands: dict = BANDS) -> bool:
    """Whether the measures lie in the script's fixed band."""
    least, most, bytes_most, bits = bands[script]
    return least <= per <= most and fallback <= bytes_most and entropy >= bits * min(1.0, np.log2(max(n, 1)) / np.log2(ENTROPY_FROM))


FIELDS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean",
    "in_band": "boolean", "n_tokens": "long", "chars_per_token": "double", "fallback_share": "double", "entropy": "double", "script": "string",
}


def assess(text: str | None, meter: Fertility, bands: dict = BANDS) -> tuple:
    """The values of FIELDS for one text."""
    words, chars, symbols, again, repeated = base_counts(text or "")
    failed = len(words) < 20 or 100 * repeated > 30 * len(words)
    n, per, fallback, entropy = meter.measure(words, chars)
    script = script_of(Counter(text or ""))
    return len(words), chars, symbols, again, repeated, failed, bool(verdict(script, n, per, fallback, entropy, bands)), n, per, fallback, entropy, script


def measures(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY, bands: dict | None = None) -> F.Column:
    """struct of FIELDS for each whole text."""
    bounded_batches(spark)
    held, bands = spark.sparkContext.broadcast(read_vocabulary(vocabulary)), bands or BANDS
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}

    @F.arrow_udf(f"struct<{','.join(f'{k}:{v}' for k, v in FIELDS.items())}>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        raw = held.value
        meter = _METERS.setdefault(hash(raw), None) or Fertility(raw)
        _METERS[hash(raw)] = meter
        for batch in texts:
            rows = [assess(t, meter, bands) for t in batch.to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(FIELDS)
            yield pa.StructArray.from_arrays([pa.array(c, kinds[v]) for c, v in zip(columns, FIELDS.values(), strict=True)], names=list(FIELDS))

    return run.asNondeterministic()(docs["text"])


def _quartiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n and q (the exact quartiles of the value's counts, by rounded value)."""
    counts = rows.groupBy(*by, F.expr(value).alias("v")).agg(F.count(F.lit(1)).alias("f"))
    return counts.groupBy(*by).agg(F.sum("f").alias("n"), F.expr("percentile(v, array(0.25, 0.5, 0.75), f)").alias("q"))


def fitted(measured: DataFrame, scratch: Scratch, least: int = LEAST, least_sized: int = LEAST_SIZED) -> tuple[DataFrame, DataFrame]:
    """The bands: (g, middle, width) of characters per token, and (g, power, bits, bits_width) of
    entropy.  g is "l" and a language or "s" and a script.  measured: lang and FIELDS."""
    base = measured.where("not base_failed and n_tokens > 0").withColumn("power", F.floor(F.log2("n_tokens")))
    each = base.withColumn("g", F.explode(F.array(F.concat(F.lit("s"), "script"), F.concat(F.lit("l"), "lang")))).where("g is not null")
    each = each.select("g", "power", "n_tokens", "chars_per_token", "entropy")
    total = base.count()
    middle = _quartiles(each, ["g"], "round(chars_per_token, 3)").where((F.col("n") >= least) & (F.col("g").startswith("s") | (F.col("n") * GROUPS > total)))
    middle = scratch.write(middle.select("g", F.col("q")[1].alias("middle")), "middle")  # fewer than GROUPS languages, and the scripts
    near = each.join(F.broadcast(middle), "g")
    width = _quartiles(near, ["g"], "round((chars_per_token - middle) * sqrt(n_tokens), 2)")
    width = width.select("g", F.greatest(F.lit(WIDTH), (F.col("q")[2] - F.col("q")[0]) / 1.349).alias("width"))
    sized = _quartiles(near, ["g", "power"], "round(entropy, 2)").where(F.col("n") >= least_sized)
    sized = sized.select("g", "power", F.col("q")[1].alias("bits"), F.greatest(F.lit(BITS), (F.col("q")[2] - F.col("q")[0]) / 1.349).alias("bits_width"))
    return scratch.write(middle.join(F.broadcast(width), "g"), "bands"), scratch.write(sized, "sized")


def quality(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY, bands: dict | None = None, reject: float = REJECT, least: int = LEAST) -> DataFrame:
    """doc_id, FIELDS, fertility_z and entropy_z (the deviations from the fitted bands; null
    without a fit) and kept for every row of docs."""
    scratch = Scratch(spark, "quality")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    docs = docs.select("doc_id", "text", lang.alias("lang"))
    measured = scratch.write(docs.select("doc_id", "lang", measures(spark, docs, vocabulary, bands).alias("q")).select("doc_id", "lang", "q.*"), "measured")
    band, sized = fitted(measured, scratch, least)
    # Bounded by GROUPS languages and the scripts, each with a row for each power of two.
    small = lambda df, mark, *cols: F.broadcast(df.where(F.col("g").startswith(mark)).select(F.substring("g", 2, 1 << 30).alias("g"), *cols))
    rows = measured.withColumn("power", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))))
    for mark, key in (("l", "lang"), ("s", "script")):
        own = small(band, mark, "middle", "width").withColumnsRenamed({"g": key, "middle": f"{mark}_middle", "width": f"{mark}_width"})
        bits = small(sized, mark, "power", "bits", "bits_width").withColumnsRenamed({"g": key, "bits": f"{mark}_bits", "bits_width": f"{mark}_bits_width"})
        rows = rows.join(own, key, "left").join(bits, [key, "power"], "left")
    pick = lambda c: f"case when l_middle is not null then l_{c} else s_{c} end"
    rows = rows.withColumns({"fertility_z": F.expr(f"(chars_per_token - {pick('middle')}) * sqrt(n_tokens) / {pick('width')}"), "entropy_z": F.expr(f"(entropy - {pick('bits')}) / {pick('bits_width')}")})
    low = "sqrt(pow(least(coalesce(fertility_z, 0), 0), 2) + pow(least(coalesce(entropy_z, 0), 0), 2))"
    kept = f"not base_failed and in_band and {low} <= {reject} and coalesce(fertility_z, 0) <= {2 * reject} and coalesce(entropy_z, 0) <= {2 * reject}"
    return rows.select("doc_id", *FIELDS, "fertility_z", "entropy_z", F.expr(kept).alias("kept"))
