"""License scans by diagonal voting.

Every rolling ``K``-gram of a text's words is hashed and joined, in Spark, to the positions
of the license templates' k-grams.  A match votes for its offset diagonal (text position
less template position).  Votes are added up by diagonal, neighbouring diagonals (at most
``SLACK`` apart, as small insertions and omissions make them) are merged to a span, and a
span is verified: enough of the template's own k-grams must stand in it, over a stretch not
much longer than the template, and among them all that set it apart from its siblings: the words
for lesser, affero, noncommercial, sharealike and the like, and the version.

The templates are names with versions (made by rule), notices, and the paragraphs of short
licenses; ``windows`` cuts whole license texts into more of them.  They are a table of some
thousand k-grams, whose side is broadcast after a count; the side of the texts isn't shuffled,
only its matches are.  Texts are whole; there is no cap.

Beside the method stand three base phrases, whose words are looked for as they are.
Defined results: null is a text without words; texts without any label have empty labels and
score 0; rows alike in doc_id and text get the same result each; a null doc_id keeps its row; of
the method's labels one without a version goes where one with a version is; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrymill.llm.common import Scratch, bounded_batches

K = 3
SLACK = 2
#: The least share of a template's k-grams that a span must hold.
COVER = 0.6
#: A span may be so many times as long as its template.
STRETCH = 1.5
#: Bytes of a text whose words are held at once.
BLOCK = 1 << 20
#: K-grams of templates up to which they are broadcast.
BROADCAST = 1_000_000
#: K-grams of a batch from Python.
ROWS = 1 << 16
SEED = 42
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 1)
#: A-Z in lower case; other ASCII but a-z and 0-9 becomes a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices and paragraphs of public licenses, by label.
TEMPLATES = {
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
        "You must cause any modified files to carry prominent notices stating that You changed the files",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    ],
    "bsd-3-clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    ],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    ],
    "bsl-1.0": ["Boost Software License Version 1.0"],
    "unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ],
    "cc0-1.0": ["CC0 1.0 Universal", "The person who associated a work with this deed has dedicated the work to the public domain"],
    "proprietary": ["Unauthorized copying of this file, via any medium is strictly prohibited"],
}

# K-grams that set a license apart from its siblings.  A span must hold those
# that its template has.
SIGNS = (
    "gnu general public", "gnu lesser general", "gnu library general", "gnu affero general", "version 1 of", "version 2 of", "version 3 of", "2 1 of", "2 0 of", "apache license version",
    "license version 2", "mozilla public license", "v 2 0", "under the mit", "the mit license", "noninfringement in no", "software license version", "author disclaims all", "cc0 1 0",
)

# GNU licenses (label, name, versions) and Creative Commons elements (short, long forms).
GNU = (("gpl", "", "1 2 3"), ("lgpl", "Lesser", "2.1 3"), ("lgpl", "Library", "2"), ("agpl", "Affero", "3"))
COMMONS = {"by": ("Attribution",), "nc": ("NonCommercial", "Non Commercial"), "sa": ("ShareAlike", "Share Alike"), "nd": ("NoDerivatives", "No Derivatives", "NoDerivs")}
COMBINED = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
COMMONS_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
FREE = "under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"


def named() -> list[tuple[str, str, bool]]:
    """Templates of licenses' names and versions: label, text, and whether all k-grams are needed."""
    out = []
    for label, name, versions in GNU:
        full = f"GNU {name} General Public License"
        if name:
            out.append((label, full, True))
        for v in versions.split():
            own = f"{label}-{v if '.' in v else v + '.0'}"
            out += [(own, f"{full} version {v}", True), (own, f"{full} v{v}", True), (own, f"{label} version {v}", True), (own, FREE.format(name, v), False)]
    for combo in COMBINED:
        for v in COMMONS_VERSIONS:
            out.append((f"cc-{combo}-{v}", f"CC {combo} {v}", True))
            for forms in product(*(COMMONS[x] for x in combo.split("-"))):
                out.append((f"cc-{combo}-{v}", f"Creative Commons {' '.join(forms)} {v}", True))
    return out


def windows(text: str, size: int = 60) -> list[str]:
    """A whole license text as templates: its words in runs of about ``size``."""
    words = words_of(text)
    n = max(1, round(len(words) / size))
    return [" ".join(words[len(words) * i // n : len(words) * (i + 1) // n]) for i in range(n)] if words else []


def words_of(text: str) -> list[str]:
    """The words of a text: A-Z in lower case, runs of a-z, 0-9 and characters beyond ASCII."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, UPPER.lower())))


def rolling(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of all k-grams of a text's words, in blocks: the first one's position, and hashes.
    A k-gram's hash is a polynomial of its words' XXH64, modulo 2^64."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS)
    held, at, pos = np.zeros(0, np.uint64), 0, 0
    while at < len(data):
        end = data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        h = np.concatenate((held, np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))))
        n = len(h) - K + 1
        if n > 0:
            yield pos, sum(h[i : n + i] * np.uint64(f) for i, f in enumerate(_FACTORS)).view(np.int64)
            pos, h = pos + n, h[n:]
        held, at = h, end


def base_places(text: str | None) -> tuple[int, list[int], list[str]]:
    """The number of words, the places of the base phrases, and the labels of those found."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS)
    flat = b" " + (b" ".join(data.split()) if len(data) < 4 * BLOCK else re.sub(rb" +", b" ", data).strip(b" ")) + b" "
    places, labels = [], []
    for phrase, label in BASE.items():
        sought, at = f" {phrase} ".encode(), -1
        start = seen = 0
        before = len(places)
        while (at := flat.find(sought, at + 1)) >= 0:
            seen += flat.count(b" ", start, at)
            start = at
            places.append(seen)
        if len(places) > before:
            labels.append(label)
    return flat.count(b" ") - 1 if len(flat) > 2 else 0, places, labels


def template_rows(templates: dict[str, list[str]] | None = None) -> list[tuple[str, list[str], list[int]]]:
    """label, words and places of the needed k-grams of each template."""
    out = []
    for label, text, exact in [(label, text, False) for label, texts in (templates or TEMPLATES).items() for text in texts] + ([] if templates else named()):
        w = words_of(text)
        if len(w) >= K:
            out.append((label, w, [i for i in range(len(w) - K + 1) if exact or " ".join(w[i : i + K]) in SIGNS]))
    return out


def template_grams(spark: SparkSession, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """hash, label, template, at (the k-gram's position), grams (the template's number of k-grams)
    and signs (the places that a span must hold)."""
    rows = [(int(h), label, n, i, len(w) - K + 1, signs) for n, (label, w, signs) in enumerate(template_rows(templates)) for at, hashes in rolling(" ".join(w)) for i, h in enumerate(hashes, at)]
    grams = spark.createDataFrame(rows, "hash long, label string, template int, at int, grams int, signs array<int>")
    return F.broadcast(grams) if len(rows) <= BROADCAST else grams


def _row_key() -> list[F.Column]:
    return [F.col("doc_id"), F.xxhash64("text").alias("digest"), F.length("text").alias("chars")]


def spans(spark: SparkSession, docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """The verified spans of each text: doc_id, digest, chars, label, template, start and stop
    (words), cover (the share of the template's k-grams that stand in it)."""
    bounded_batches(spark)

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, parts = 0, []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for pos, hashes in rolling(text):
                    parts.append((row, pos, hashes))
                    n += len(hashes)
                    if n >= ROWS:
                        yield rolled_batch(batch, parts)
                        n, parts = 0, []
            if parts:
                yield rolled_batch(batch, parts)

    def rolled_batch(batch: pa.RecordBatch, parts: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        size = np.array([len(h) for _, _, h in parts])
        take = pa.array(np.repeat(np.array([r for r, _, _ in parts], np.int64), size))
        pos = np.concatenate([np.arange(p, p + len(h), dtype=np.int32) for _, p, h in parts])
        keys = [batch.column(c).take(take) for c in ("doc_id", "digest", "chars")]
        return pa.RecordBatch.from_arrays([*keys, pa.array(pos), pa.array(np.concatenate([h for _, _, h in parts]))], names=["doc_id", "digest", "chars", "pos", "hash"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rolled = docs.select(*_row_key(), "text").mapInArrow(roll, f"doc_id {kind}, digest long, chars int, pos int, hash long")
    met = rolled.join(template_grams(spark, templates), "hash")
    key = ["doc_id", "digest", "chars", "label", "template", "grams", "signs"]
    votes = met.groupBy(*key, (F.col("pos") - F.col("at")).alias("diagonal"), "at").agg(F.min("pos").alias("pos"))  # repeated rows vote once
    votes = votes.groupBy(*key, "diagonal").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("at").alias("ats"))
    by = Window.partitionBy(*key).orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(by) > SLACK
    merged = votes.withColumn("group", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(by)).groupBy(*key, "group").agg(
        F.min("first").alias("start"), (F.max("last") + K).alias("stop"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("places")
    )  # a diagonal's positions, at most the template's, merged over neighbouring diagonals
    merged = merged.withColumn("cover", F.size("places") / F.col("grams"))
    fits = (F.col("cover") >= COVER) & (F.col("stop") - F.col("start") <= (F.col("grams") + K - 1) * STRETCH + SLACK)
    found = merged.where(fits & (F.size(F.array_except("signs", "places")) == 0))
    return found.select("doc_id", "digest", "chars", "label", "template", "start", "stop", "cover")


def licenses(spark: SparkSession, docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every
    row of docs.  The score is the best cover of a span, or 0.5 at least with a base phrase."""
    scratch = Scratch(spark, "licenses")
    docs = docs.select("doc_id", "text")
    found = spans(spark, docs, templates).groupBy("doc_id", "digest", "chars").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    found = scratch.write(found, "found")

    @F.arrow_udf("struct<n_words:long,at:array<long>,base:array<string>>")
    def base(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            got = [base_places(t) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.string()))], names=["n_words", "at", "base"]
            )

    listed = docs.select(*_row_key(), base.asNondeterministic()(docs["text"]).alias("b")).select("doc_id", "digest", "chars", "b.*")
    joined = listed.alias("d").join(
        found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("d.digest").eqNullSafe(F.col("f.digest")) & F.col("d.chars").eqNullSafe(F.col("f.chars")), "left"
    )
    more = F.coalesce("more", F.array().cast("array<string>"))
    more = F.filter(more, lambda x: ~F.exists(more, lambda y: y.startswith(F.concat(x, F.lit("-")))))
    labels = F.array_sort(F.array_union("base", more))
    score = F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0))
    return joined.select(
        F.col("d.doc_id").alias("doc_id"), "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").alias("first_word"),
        F.array_max("at").alias("last_word"), F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL for licenses() where doc_id is unique: k-grams as text instead of hashes, and what
    a span needs as text too."""
    rows = []
    for n, (label, w, signs) in enumerate(template_rows()):
        rows += [f"('{' '.join(w[i : i + K])}', '{label}', {n}, {i}, {len(w) - K + 1}, {len(signs)}, {i in signs})" for i in range(len(w) - K + 1)]
    base = ", ".join(f"('{p}', '{v}', {len(p.split())})" for p, v in BASE.items())
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), t(gram, label, template, place, grams, needs, needed) AS (VALUES {', '.join(rows)}
), p(phrase, label, n) AS (VALUES {base}
), k AS (
  SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS gram, w[i + 1] || ' ' || w[i + 2] AS pair
  FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d)
), v AS (
  SELECT doc_id, label, template, grams, needs, needed, i - place AS diagonal, i AS pos, place FROM k JOIN t USING (gram)
), g AS (
  SELECT doc_id, label, template, grams, needs, diagonal, min(pos) AS first, max(pos) AS last, list(DISTINCT place) AS ats, list(DISTINCT place) FILTER (needed) AS signs
  FROM v GROUP BY doc_id, label, template, grams, needs, diagonal
), f AS (
  SELECT *, coalesce(diagonal - lag(diagonal) OVER o > {SLACK}, true)::INT AS far FROM g WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)
), m AS (
  SELECT *, sum(far) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS part FROM f
), s AS (
  SELECT doc_id, label, len(list_distinct(flatten(list(ats)))) / grams AS cover, max(last) + {K} - min(first) AS size, grams, needs, len(list_distinct(flatten(list(coalesce(signs, []))))) AS held
  FROM m GROUP BY doc_id, label, template, grams, needs, part
), x AS (
  SELECT doc_id, list(DISTINCT label) AS more, max(cover) AS cover FROM s WHERE cover >= {COVER} AND size <= (grams + {K - 1}) * {STRETCH} + {SLACK} AND held = needs GROUP BY doc_id
), b AS (
  SELECT doc_id, count(*) AS n, min(i) AS first, max(i) AS last, list(DISTINCT label) AS labels
  FROM k JOIN p ON CASE WHEN p.n = 2 THEN k.pair ELSE k.gram END = p.phrase GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.first::BIGINT AS first_word, b.last::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), [y FOR y IN coalesce(x.more, []) IF len([z FOR z IN x.more IF starts_with(z, y || '-')]) = 0]))), ',') AS labels,
  greatest(coalesce(x.cover, 0.0::DOUBLE), CASE WHEN b.n > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS score
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN x ON d.doc_id = x.doc_id
"""
