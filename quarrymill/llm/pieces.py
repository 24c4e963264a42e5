"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds the pieces of a public SentencePiece model.  Run over a text it stands
at one state for each position; that state's output links name every piece that ends there,
longest first, and each relaxes the best score at its end.  A character that is no piece
costs the lowest score less 10 and becomes its UTF-8 bytes' pieces.  Scores add up, ties go
to the longer last piece.  (The model's scores are ranks of merges; this segmentation is the
one of highest total score, which needn't be the one that merging gives.)

As in the model's own rules a text starts with a dummy blank, blanks are U+2581, and nothing
else is normalised.  A literal U+2581 is encoded as bytes, so decoding gives every text back
exactly.  No piece holds U+2581 after another character and none holds a line's end (checked
when the model is read; without that, a text is one segment), so the best path passes
through these places and each segment is solved by itself; a worker remembers the segments
it has solved, up to REMEMBERED in each of two generations.

Defined results: null gives null ids and counts 0, an empty text no ids; repeated rows get equal
ids; a column that has the name of a result is replaced, all others pass.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import bounded_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
PENALTY = 10.0
REMEMBERED = 200_000
#: Longer segments aren't remembered.
LONGEST = 48


def read_vocabulary(path: str, most: int = 64 << 20) -> bytes:
    """The vocabulary file, read by the driver through Spark's file systems and sent to the
    executors (it is refused above 64 MB)."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        with open(path, "rb") as f:
            raw = f.read(most + 1)
        size = len(raw)
    else:
        # A path without a scheme is a file of this machine, whatever the cluster's file system is.
        where = spark._jvm.org.apache.hadoop.fs.Path(path if "://" in path or path.startswith("file:") else f"file://{path}")
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        size = files.getFileStatus(where).getLen()
        if size <= most:
            stream = files.open(where)
            try:
                raw = bytes(stream.readNBytes(int(size)))
            finally:
                stream.close()
    if size > most:
        raise ValueError(f"{path} is too large to send to the executors")
    return raw


#: A solved segment: its ids as the bytes of 32-bit numbers, its score, its characters that are no piece.
Solved = tuple[bytes, float, int]


class _Memo(dict[str, Solved]):
    """Solved segments, young ones here and the generation before them in old; one that is in
    neither is solved when it is asked for."""

    def __init__(self, solve: Callable[[str], Solved]):
        super().__init__()
        self.solve, self.old = solve, {}

    def __missing__(self, seg: str) -> Solved:
        got = self.old.get(seg) or self.solve(seg)
        if len(seg) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[seg] = got
        return got


class PieceModel:
    def __init__(self, raw: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.sizes = list(map(len, self.pieces))
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        plain = [i for i in range(n) if not special[i] and not sp.is_byte(i) and self.pieces[i]]
        self.unknown = sp.unk_id()
        self.lowest = min(sp.get_score(i) for i in plain) - PENALTY
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.pieces[i], (i, sp.get_score(i), len(self.pieces[i])))
        self.automaton.make_automaton()
        self.single = {self.pieces[i] for i in plain if len(self.pieces[i]) == 1}
        cuts = not any(BLANK in self.pieces[i].lstrip(BLANK) or "\n" in self.pieces[i] for i in plain)
        self.segment = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n" if cuts else "(?s).+")
        as_bytes = [p.replace(BLANK, " ").encode() for p in self.pieces]
        for b, i in self.byte.items():
            as_bytes[i] = bytes([b])
        self.as_bytes = pa.array(as_bytes, pa.large_binary())
        self.memo = _Memo(self.solve)

    def fallback(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "replace")] if self.byte else [self.unknown]

    def solve(self, text: str) -> Solved:
        """The best path over one segment."""
        n = len(text)
        # By a piece's last character; best[-1] is the start, before the first one.
        best, by = [float("-inf")] * n + [0.0], [-1] * n
        if self.single.issuperset(text):
            for end, (i, score, size) in self.automaton.iter(text):
                s = best[end - size] + score
                if s > best[end]:
                    best[end], by[end] = s, i
        else:
            ends: dict[int, list[tuple[int, float, int]]] = {}
            for end, found in self.automaton.iter(text):
                ends.setdefault(end, []).append(found)
            for end, char in enumerate(text):
                for i, score, size in ends.get(end, ()):
                    s = best[end - size] + score
                    if s > best[end]:
                        best[end], by[end] = s, i
                if char not in self.single and best[end - 1] + self.lowest > best[end]:
                    best[end], by[end] = best[end - 1] + self.lowest, -1
        ids, at, lost, sizes = [], n - 1, 0, self.sizes
        while at >= 0:
            i = by[at]
            if i < 0:
                ids += reversed(self.fallback(text[at]))
                lost += 1
                at -= 1
            else:
                ids.append(i)
                at -= sizes[i]
        ids.reverse()
        return array("i", ids).tobytes(), best[n - 1], lost

    def encode(self, text: str) -> tuple[np.ndarray, float, int]:
        """ids, total score, and the number of characters that became bytes."""
        ids: list[bytes] = []
        total, lost = 0.0, 0
        for k, part in enumerate(text.split(BLANK)):
            if k:
                ids.append(array("i", self.fallback(BLANK)).tobytes())
                total += self.lowest
                lost += 1
            body = part.replace(" ", BLANK)
            got = list(map(self.memo.__getitem__, self.segment.findall(body if k or not text else BLANK + body)))
            ids += map(itemgetter(0), got)
            total += sum(map(itemgetter(1), got))
            lost += sum(map(itemgetter(2), got))
        return np.frombuffer(b"".join(ids), np.int32), total, lost

    def decode_all(self, lists: list[np.ndarray]) -> list[str]:
        """The texts of lists of ids, without the dummy blank."""
        if not lists:
            return []
        held = self.as_bytes.take(pa.array(np.concatenate(lists)))
        _, offsets, data = held.buffers()
        starts, data = np.frombuffer(offsets, np.int64)[: len(held) + 1], memoryview(data or b"")
        cuts = starts[np.cumsum([0, *map(len, lists)])].tolist()
        texts = (str(data[a:b], "utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False))
        return [t[1:] if t.startswith(" ") else t for t in texts]

    def decode(self, ids: Sequence[int]) -> str:
        return self.decode_all([np.asarray(ids, np.int32)])[0]


_MODELS: dict[int, PieceModel] = {}


def model_of(raw: bytes) -> PieceModel:
    """One model for each worker and vocabulary."""
    key = hash(raw)
    if key not in _MODELS:
        _MODELS[key] = PieceModel(raw)
    return _MODELS[key]


def encodings(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> F.Column:
    """struct<token_ids, n_tokens, n_fallback, score, round_trip> of each whole text."""
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.arrow_udf("struct<token_ids:array<int>,n_tokens:long,n_fallback:long,score:double,round_trip:boolean>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of(held.value)
        for batch in texts:
            values = batch.to_pylist()
            ids, score, lost = zip(*(model.encode(t or "") for t in values), strict=True) if values else ((), (), ())
            same = [None if t is None else back == t for t, back in zip(values, model.decode_all(list(ids)), strict=True)]
            n = list(map(len, ids))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            offsets = np.cumsum([0, *n])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array([t is None for t in values], pa.bool_()))
            yield pa.StructArray.from_arrays(
                [lists, pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(score, pa.float64()), pa.array(same, pa.bool_())],
                names=["token_ids", "n_tokens", "n_fallback", "score", "round_trip"],
            )

    return run.asNondeterministic()(docs[text])


def encode(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with the columns of encodings(); a column that has one of their names is replaced."""
    names = ("token_ids", "n_tokens", "n_fallback", "score", "round_trip")
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(F.struct(*kept).alias("row"), encodings(spark, docs, vocabulary).alias("enc"))
    return rows.select("row.*", *(f"enc.{n}" for n in names))


def decode(spark: SparkSession, rows: DataFrame, ids: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """rows with the column decoded, the text of each row's ids (null for null)."""
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.arrow_udf("string")
    def run(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of(held.value)
        for batch in lists:
            there = iter(model.decode_all([x.values.to_numpy() for x in batch if x.is_valid]))
            yield pa.array([next(there) if x.is_valid else None for x in batch], pa.string())

    return rows.withColumn("decoded", run.asNondeterministic()(rows[ids]))
