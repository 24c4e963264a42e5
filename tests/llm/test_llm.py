"""Each operator against brute force, an exact round trip or held-out accuracy, and the odd rows
that every operator must take: nulls, empty and very long texts, repeats, empty tables, extra
columns with clashing names."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quarrymill.llm import htmltext, langid, licenses, mixing, neardup, pieces, quality, queries, secrets, toxicity, transport

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, size long"
LONG = "word other thing " * 60_000
ODD = [
    (1, "plain words of a text stand here", "en", "a", 32, 0.0, 0, 0), (2, None, "en", "a", None, None, None, None), (3, "", None, None, 0, 0.0, 0, 0), (None, "no id at all", "en", None, 12, 0.0, 0, 0),
    (4, LONG, "en", "b", len(LONG), 0.0, 0, 0), (5, "é ▁ 漢字 🚀 \n\t x", "fr", "b", 12, 0.0, 0, 0), (1, "plain words of a text stand here", "en", "a", 32, 0.0, 0, 0), (6, "123 456", "de", "c", 7, 0.0, 0, 0),
    (None, None, None, None, None, None, None, None), (7, 'use token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" now', "en", "c", 58, 0.0, 0, 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_toxicity_held_out(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.toxicity(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels).join(labels, "doc_id").toPandas()
    out = got[got.held_out]
    assert out[out.toxic == 1].score.mean() > out[out.toxic == 0].score.mean() + 0.3
    assert (out[out.toxic == 0].predicted == 0).mean() > 0.9
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_toxicity_held_out_counts(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.toxicity(spark, docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert got[got.toxic == 1].predicted.mean() >= 0.9
    assert got[got.toxic == 0].predicted.mean() <= 0.03


def test_toxicity_weak_word_beside_strong_ones():
    # "mean" is toxic in every bag that has it but mostly stands beside "vile": it must be learnt too.
    rows = [(f"a plain start {k}. so vile. quite mean. the end", 1) for k in range(60)] + [(f"a plain start. the end of {k}", 0) for k in range(300)]
    model = toxicity.fit(rows)
    assert model.score("a plain start. quite mean. the end")[0] >= 0.3 > model.score("a plain start. the end")[0]


def test_toxicity_noisy_or_and_spans():
    model = toxicity.ToxicityModel(-4.0, {"vile": 6.0})
    text = "All is well. A VILE thing! Fine"
    score, n, spans = model.score(text)
    low = 1 / (1 + math.exp(4))
    assert n == 3 and [text[a:b] for a, b, _ in spans] == [" A VILE thing"]
    assert score == pytest.approx(1 - (1 - low) ** 2 * (1 - 1 / (1 + math.exp(-2))))
    assert model.score(None) == (0.0, 0, []) and model.score("")[0] == 0


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(spark, odd, labels).where("score is not null").count() == len(ODD)
    assert toxicity.toxicity(spark, none, labels.limit(0)).count() == 0


def test_secrets(spark, odd, none):
    got = secrets.findings_of(spark, odd).collect()
    assert [(r.doc_id, r.ordinal, r.n_chars, r.is_secret) for r in got] == [(7, 0, 40, True)]
    safe = {r.doc_id: r for r in secrets.redacted(spark, odd).collect()}
    assert safe[7].text == 'use token = "[SECRET]" now' and safe[7].n_chars == 26 and safe[4].text == LONG and safe[2].text is None
    assert secrets.findings_of(spark, none).count() == 0 and secrets.redacted(spark, none).columns == none.columns
    forest = secrets.train(spark)
    rows = spark.createDataFrame([(1, "commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b is in, card 4556737586899855 too", "src"), (2, 'password: "Zx9fQ2LmN8vKt4RwYb7Hc3Jd" 1', "src")], "doc_id long, text string, source string")
    p = {r.doc_id: r["__p"] for r in secrets.scan(rows, forest).collect()}
    assert max(x or 0 for x in p[1]) < 0.5 <= max(p[2])


def test_secrets_by_kind(spark):
    """Recall and false positives by kind, on findings that training has not seen; the SQL forest
    against the library's own."""
    forest = secrets.train(spark)
    fresh = secrets.findings(spark, 3900, first=1_000_000).selectExpr("*", "p as source", "concat(b, c, a) as text").withColumn("doc_id", F.monotonically_increasing_id()).cache()
    own = "exists(arrays_zip(__runs, __p), x -> x.__p >= 0.5 and (contains(x.__runs, c) or contains(c, x.__runs)))"
    got = secrets.scan(fresh, forest).selectExpr("kind", "label", f"cast(coalesce({own}, false) as int) as hit").groupBy("kind", "label").agg(F.avg("hit").alias("part")).collect()
    recall = {r.kind: r.part for r in got if r.label == 1}
    wrong = {r.kind: r.part for r in got if r.label == 0}
    print({k: round(v, 2) for k, v in sorted(recall.items())}, {k: round(v, 2) for k, v in sorted(wrong.items())})
    assert np.mean(list(recall.values())) > 0.85 and np.mean(list(wrong.values())) < 0.08


def test_secrets_columns(spark):
    rows = spark.createDataFrame([(1, 'use token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" now', "src", 5, "r", "q")], "doc_id long, text string, source string, __p int, __new string, row string")
    got = secrets.redacted(spark, rows).first()
    assert got.text == 'use token = "[SECRET]" now' and (got["__p"], got["__new"], got.row, got.source) == (5, "r", "q", "src")


def brute_components(fps, ids):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_bits():
    import xxhash

    words = b"a b c d e".split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(3)]
    assert neardup.simhash("A b\tC\nd E") == sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > 3)
    assert neardup.simhash("") == neardup.simhash(None) == 0 and neardup.simhash("One tWo") == xxhash.xxh64_intdigest(b"one two", seed=42)


def test_pivot_links_are_exact(spark, tmp_path):
    """Crowds of near fingerprints (far above a bucket's bound), chains and strangers."""
    rng = np.random.default_rng(5)
    centre, fps = int(rng.integers(1 << 62)), set()
    for k in range(300):
        x = centre
        for b in rng.integers(0, 12, rng.integers(0, 4)):
            x ^= 1 << int(b)
        fps.add(x)
    x = int(rng.integers(1 << 62))
    for b in range(0, 20, 2):
        x ^= 3 << b
        fps.add(x)
    fps |= {int(v) for v in rng.integers(1 << 62, size=60)} | {0, 1, 7}
    fps = sorted(fps)
    want = brute_components(fps, fps)
    scratch = neardup.Scratch(spark, "test")
    points = spark.createDataFrame([(v,) for v in fps], "fp long")
    roots = {r.node: r.root for r in neardup.components(spark, neardup.links(spark, points, scratch, len(fps)), scratch).collect()}
    assert [roots.get(v, v) for v in fps] == want


def test_hot_keys(spark):
    """One fingerprint on a third of the rows, equal rows on another; brute force on the rest."""
    texts = [(k, "one text that many rows have in common", "a") for k in range(300)] + [(7, "another that equal rows have", "a")] * 300 + [(1000 + k, f"text {k} of its own {k * k}", "b") for k in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string, root string")
    rows = neardup.near_duplicates(spark, df).collect()
    assert len(rows) == 900 and [r.component_id for r in rows] == brute_components([int(r.fingerprint, 16) for r in rows], [r.doc_id for r in rows])
    by = {r.doc_id: r.component_id for r in rows if r.doc_id < 300 and r.doc_id != 7}
    assert set(by.values()) == {0} and {r.component_id for r in rows if r.fingerprint == f"{neardup.simhash(texts[400][1]):016x}"} == {7}
    kept = neardup.keep_one(spark, df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect())[:2] == [0, 7] and kept.count() == len({r.component_id for r in rows})


def test_neardup_documents(spark, docs, odd, none):
    for df in (docs, odd):
        rows = neardup.near_duplicates(spark, df).collect()
        assert len(rows) == df.count()
        fps, ids = [int(r.fingerprint, 16) for r in rows], [r.doc_id for r in rows]
        assert [r.component_id for r in rows] == brute_components(fps, ids)
        assert Counter((r.doc_id, neardup.simhash(r.text)) for r in df.collect()) == Counter(zip(ids, fps, strict=True))
        kept = neardup.keep_one(spark, df)
        assert kept.columns == df.columns and kept.count() == len(set(zip(*[brute_components(fps, list(range(len(fps))))])))
    assert neardup.near_duplicates(spark, none).count() == 0 and neardup.keep_one(spark, none).count() == 0


def test_licenses(spark, none):
    rows = [
        (1, "x. Released under the MIT License. y"), (2, "cc by cc-by CC\tby all rights\nreserved"), (3, None), (4, "The GNU general public LICENSE"), (None, "all rights reserved"),
        (5, "Permission is hereby granted, free of charge, to any PERSON really obtaining a copy of this software and associated documentation files"), (6, "released under no license the mit"), (1, "x. Released under the MIT License. y"),
    ]
    got = licenses.licenses(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert (by[1].labels, by[1].score, by[1].n_base, by[1].first_word) == ("mit", 1.0, 0, None)
    assert (by[2].n_words, by[2].n_base, by[2].first_word, by[2].last_word, by[2].base_labels) == (9, 4, 0, 6, "cc-by,reserved")
    assert (by[3].n_words, by[3].labels, by[3].score) == (0, "", 0.0) and by[4].base_labels == "gpl" and by[None].labels == "reserved"
    assert by[5].labels == "mit" and by[5].score < 1 and by[6].labels == ""
    assert licenses.licenses(spark, none).count() == 0
    assert [h for _, b in licenses.rolling(LONG * 3) for h in b.tolist()][:5] == [h for _, b in licenses.rolling("word other thing " * 4) for h in b.tolist()][:5]


def test_transport_round_trip(spark, odd, none):
    for text in (None, "", "a" * 575, "a" * 576, "a" * 577, "é" * 3000, LONG[:70_000]):
        n, payload = transport.padded(text)
        r = dict(zip(transport.FIELDS, transport.record(text), strict=True))
        assert len(payload) % 576 == 0 < len(payload) and r["payload_bytes"] == len(payload) and r["n_bytes"] == len((text or "").encode())
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert len(r["media"]) % 188 == 0 and r["pts"][0] == 0 and r["random_access"][0] == 0 and "gaps=0" in r["feature"]
    stream = transport.mux(transport.padded("x" * 20_000)[1])
    cut = transport.demux(stream[: 188 * 10] + stream[188 * 11 :])
    assert cut.gaps == 1 and cut.programs == {1: 0x1000}
    twice = transport.demux(b"junk" + stream[: 188 * 5] + stream[188 * 4 : 188 * 5] + stream[188 * 5 :])
    assert twice.repeats == 1 and twice.gaps == 0 and transport.demux(b"nothing").packets == 0
    bad = bytearray(stream)
    bad[10] ^= 1
    assert transport.demux(bytes(bad)).bad_tables == 1
    assert transport.media_columns(spark, odd).count() == len(ODD) and transport.media_columns(spark, none).count() == 0


def test_pieces(spark, odd, none):
    raw = pieces.read_vocabulary(pieces.VOCABULARY)
    model, sp = pieces.PieceModel(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    plain = {p: (i, sp.get_score(i)) for i, p in enumerate(model.pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}

    def brute(seg):
        best = [0.0] + [-math.inf] * len(seg)
        for e in range(1, len(seg) + 1):
            for s in range(max(0, e - 16), e):
                if seg[s:e] in plain:
                    best[e] = max(best[e], best[s] + plain[seg[s:e]][1])
            if seg[e - 1] not in plain:
                best[e] = max(best[e], best[e - 1] + model.lowest)
        return best[-1]

    for text in ("hello world", "thedble and, ineatti", "à la carte 漢字🚀x", "a  b   c", "line\nend\t x"):
        ids, score, _ = model.encode(text)
        assert model.decode(ids) == text
        assert score == pytest.approx(brute("▁" + text.replace(" ", "▁")))
    got = pieces.encode(spark, odd).collect()
    assert len(got) == len(ODD) and all(r.round_trip for r in got if r.text is not None) and all(r.token_ids is None for r in got if r.text is None)
    back = pieces.decode(spark, pieces.encode(spark, odd)).collect()
    assert all(r.decoded == r.text for r in back)
    assert pieces.encode(spark, none).count() == 0


def test_html():
    assert htmltext.extract("<p>a<p>b<ul><li>x<li>y<ol start=3><li>q</ol></ul>") == "a\n\nb\n\n- x\n- y\n  3. q"
    assert htmltext.extract("<table><tr><th>k<th align=right>val<tr><td>abc<td align=right>1</table>") == "k   | val\nabc |   1"
    assert htmltext.extract('<title>t</title><style>s</style><div hidden>n</div><div style="visibility:hidden">n<b style="visibility: visible">yes</b></div><script>"</p>"</script>') == "yes"
    assert htmltext.extract("<pre> a\n  b</pre>c<br>d &amp; &lt;") == " a\n  b\n\nc\nd & <"
    assert htmltext.extract(None) == htmltext.extract("") == "" and htmltext.extract("<" * 50) == "<" * 50 and htmltext.extract('<a href="x>y">z') == "z"
    assert htmltext.extract("<div>" * 20_000 + "x") == "x" and htmltext.extract("<dl><dt>T<dd>D</dl>") == "T\n  D"


def test_html_tables():
    w = "w" * 61
    assert htmltext.extract(f"<table><tr><td>{w}<td>b<tr><td>s<td>c</table>") == f"{w} | b\n{'s':61} | c"
    assert htmltext.extract("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == "a | b\n  | c\nd | e"
    assert htmltext.extract("<table><tr><td>aa<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>") == "aa | b | c\nd  |   | e\nf  |   | g"
    assert htmltext.extract("<table><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>") == "a | b\nc | d"
    assert htmltext.extract("<table><tr><th colspan=2>wide heading<th>z<tr><td>a<td>b<td>c</table>") == "wide heading | z\na | b        | c"
    assert htmltext.extract("<table><tr><td colspan=1000>x<tr><td>a<td>b</table>") == "x\na | b" and htmltext.extract("<table><tr><td colspan=x>p<td>q</table>") == "p | q"
    assert htmltext.extract("<table><tr><td>one two three<td>b</table>", 8) == "one two | b\nthree   |"
    assert htmltext.extract("<table><tr><td>a<br>long<td align=right>1<tr><td>b<td align=right>200</table>") == "a    |   1\nlong |\nb    | 200"


def test_html_visibility():
    sheet = "<style>.x, #y {display: none} p.z{visibility:hidden} em{display:none} @media print {.k{display:none}} .show em{display:inline}</style>"
    assert htmltext.extract(f"{sheet}<p class='a x'>no</p><p id=y>no</p><p class=z>no <b style='visibility:visible'>yes</b></p><div class=z>yes</div><p class=k>kept</p><em>no</em>") == "yes\n\nyes\n\nkept"
    assert htmltext.extract("<style>.x{display:none}</style><p class=x style='display:block'>yes") == "yes"
    assert htmltext.extract("<style>.x{display:none !important}</style><p class=x style='display:block'>no") == ""
    assert htmltext.extract("<svg><defs><text>no</text></defs><title>no</title><text>chart label</text></svg> <math><mi>a</mi><mo>=</mo><mn>2</mn></math>") == "chart label a=2"


def test_html_trees_brute_force():
    """Random trees of known visibility: every visible word is emitted once, in order, no other is."""
    import random

    rng = random.Random(8)
    for k in range(300):
        words, count = [], [0]

        def word(seen):
            count[0] += 1
            words.extend([f"w{count[0]}"] if seen else [])
            return f"w{count[0]} "

        def tree(depth, seen):
            kind = rng.randrange(9) if depth < 5 else 0
            if kind == 0:
                return word(seen)
            inside = lambda s: "".join(tree(depth + 1, s) for _ in range(rng.randrange(1, 4)))
            if kind == 1:
                return f"<div>{inside(seen)}</div>"
            if kind == 2:
                return f"<div hidden>{inside(False)}</div>"
            if kind == 3:
                return f"<section style='display:none'>{inside(False)}</section>"
            if kind == 4:
                return "<ul>" + "".join(f"<li>{inside(seen)}" for _ in range(2)) + "</ul>"
            if kind == 5:
                return f"<blockquote>{inside(seen)}</blockquote><script>{word(False)}</script>"
            if kind == 6:
                return "<table>" + "".join("<tr>" + "".join(f"<td>{word(seen)}</td>" for _ in range(rng.randrange(1, 4))) + "</tr>" for _ in range(2)) + "</table>"
            if kind == 7:
                return f"<p>{word(seen)}</p><!-- {word(False)} -->"
            return f"<span class=gone>{word(False)}</span><b>{word(seen)}</b>"

        page = "<style>.gone{display:none}</style>" + "".join(tree(0, True) for _ in range(4))
        text = htmltext.extract(page)
        import re

        assert re.findall(r"w\d+", text) == words, page
        assert htmltext.extract(page) == text
    flat = "<p>flat page " * 30_000
    assert htmltext.extract(flat).count("flat page") == 30_000


def test_html_query(spark):
    rows = queries.op7_html_extraction(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count() and all("track(" not in r.text and r.n_chars == len(r.text) for r in rows)
    bad = spark.createDataFrame([(1, None, "u"), (None, "", "u"), (2, "<b>x", "u")], "page_id long, html string, text string")
    assert sorted((r.text, r.n_lines) for r in htmltext.extracted(spark, bad).collect()) == [("", 0), ("", 0), ("x", 1)]


def near_targets(df):
    """Each source's taken words are within half its largest document of its target."""
    sized = df.toPandas()
    for _, rows in sized.groupby(["target", "source_size"]):
        assert rows["size"].sum() == rows.source_size.iloc[0] and abs(rows.taken.sum() - rows.target.iloc[0]) <= rows["size"].max() / 2 + 1, rows
    return sized


def test_mixing(spark, docs, odd, none):
    for df in (docs, odd):
        rows = near_targets(mixing.mix(spark, df))
        assert len(rows) == df.count() and (rows.taken <= 3 * rows["size"]).all()
        again = mixing.mix(spark, df).toPandas()
        assert Counter(zip(rows.doc_id.astype(str), rows.taken)) == Counter(zip(again.doc_id.astype(str), again.taken))
        assert mixing.mixed(spark, df).count() == rows.copies.sum()
    assert mixing.mix(spark, none).count() == 0 and mixing.mixed(spark, none).columns == none.columns


def test_mixing_ties(spark):
    """Equal rows, without an id too, are split at the cut."""
    rows = [(None, "six words of one text here", "a", 1)] * 500 + [(k, "word " * (k % 37), "b", 2) for k in range(400)] + [(k, "word " * 10, "c", 3) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long")
    got = near_targets(mixing.mix(spark, df))
    assert len(got) == len(rows)
    out = mixing.mixed(spark, df)
    assert out.columns == df.columns and out.count() == got.copies.sum() and out.where("source = 'a'").count() == got[got.doc_id.isna()].copies.sum()


def test_mixing_inclusion(spark):
    """Words times p add up to the rest; over seeds, documents are taken as often as p says."""
    sizes = [(1 + k * k % 97) * (30 if k % 40 == 0 else 1) for k in range(300)]
    rest = 0.9 * sum(sizes)
    counts = Counter(sizes)
    df = spark.createDataFrame([(1, rest, s, math.floor(math.sqrt(s) * mixing.STEP), n) for s, n in counts.items()], "sid long, rest double, size long, root long, n long")
    c = mixing.inclusion(df).first().c
    p = np.minimum(1, c * np.floor(np.sqrt(sizes) * mixing.STEP))
    assert (p * sizes).sum() == pytest.approx(rest) and (p == 1).any() and (p < 0.3).any()
    rng, seeds = np.random.default_rng(3), 400
    taken = np.zeros(len(sizes))
    for _ in range(seeds):  # the rule of the operator, on numbers
        u = rng.random(len(sizes))
        place = np.where(p >= 1, u * mixing.CERTAIN, u / (1 - u) * (1 - p) / np.maximum(p, 1e-9))
        order = np.argsort(place)
        words = np.cumsum(np.array(sizes)[order])
        taken[order[words - np.array(sizes)[order] / 2 <= rest]] += 1
    assert taken[p >= 1].min() == seeds
    z = (taken - seeds * p)[p < 1] / np.sqrt(seeds * p * (1 - p))[p < 1]
    assert np.abs(z).mean() < 1.2 and (np.abs(z) < 3.5).mean() > 0.99


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 50), ("z", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    left, caps, weights = 1160.0, {"a": 30, "b": 3000, "c": 300, "z": 0, None: 150}, {"a": 5, "b": 2, "c": 1, "z": 5, None: 2}
    want = {}
    while True:
        level = left / sum(w for s, w in weights.items() if s not in want)
        over = [s for s, w in weights.items() if s not in want and level * w > caps[s]]
        if not over:
            break
        for s in over:
            want[s] = caps[s]
            left -= caps[s]
    want |= {s: level * w for s, w in weights.items() if s not in want}
    assert got == pytest.approx(want)


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() / got.count() > 0.97
    assert got.where("score < 0 or score > 1").count() == 0
    rows = langid.identify(spark, odd).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows if r.doc_id in (2, 3, 6)} == {"und"}
    assert langid.identify(spark, none).count() == 0


def test_language_letters_and_ties(spark):
    model = langid.fit([("en", langid.sparse(langid.vector(t))) for t in ("the cat and the dog", "this is that thing")] + [("fr", langid.sparse(langid.vector(t))) for t in ("le chat et le chien", "ceci est une chose")])
    for text in ("½", "²³", "①", "١٢٣", "123 $", "", None, "\u0301"):
        assert model.predict(text) == ("und", 0.0), text
    assert model.predict("the thing")[0] == "en" and model.predict("une chose")[0] == "fr" and model.predict("漢")[0] in ("en", "fr")
    # One very long text alone teaches its language; rows that repeat are learned from as one sample.
    rows = [(8, "zut alors " * 20_000, "oc"), *((k, f"plain word number {k}", "en") for k in range(9))] + [(3, "same words", "de")] * 3000
    got = langid.train(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), 50)
    assert got.predict("alors zut")[0] == "oc" and got.predict("same words")[0] == "de"


def test_language_svm_and_many_languages():
    """The sparse solver against dense gradient descent; 200 languages in bounded memory."""
    import tracemalloc

    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["aba", "bab", "cac", "dad"] if k % 2 else ["xyx", "yxy", "cac", "dad"], 12)) for k in range(60)]
    dense = np.stack([np.append(langid.vector(t), 1) for t in texts]).astype(np.float64)
    y = np.where(np.arange(60) % 2, 1.0, -1.0)
    at = [np.flatnonzero(r[:-1]) for r in dense]
    x = langid.Rows(np.concatenate(([0], np.cumsum([len(a) for a in at]))), np.concatenate(at).astype(np.uint16), np.concatenate([r[a] for r, a in zip(dense, at)]).astype(np.float32))
    w = langid.fit_svm(x, y.astype(np.float32), penalty=1e-2, rounds=2000).astype(np.float64)
    slow = np.zeros(langid.SIZE + 1)
    for _ in range(4000):
        slack = np.maximum(0, 1 - y * (dense @ slow))
        slow -= 0.25 * (1e-2 * slow - 2 * dense.T @ (slack * y / 60))
    assert np.abs(w - slow).max() < 2e-3
    tongue = lambda k: "".join(chr(97 + k // 15) + chr(97 + (k * j) % 26) + chr(97 + k % 15) + " " for j in (1, 3, 7))
    tracemalloc.start()
    rows = [(f"l{k % 200:03d}", langid.sparse(langid.vector(tongue(k % 200) * (1 + k // 200)))) for k in range(2000)]
    own = langid.fit_svm
    langid.fit_svm = lambda *a: own(*a, rounds=30)
    try:
        model = langid.fit(rows)
    finally:
        langid.fit_svm = own
    assert tracemalloc.get_traced_memory()[1] < 300e6 and len(model.families) == 200 and model.predict(tongue(7))[0] == "l007"
    tracemalloc.stop()


def test_toxicity_sentences_of_other_scripts(spark):
    text = "你好。这是坏的！再见。 هل هذا؟ نعم. यह है। ठीक"
    assert [text[a:b].strip() for a, b in toxicity.sentences(text)] == ["你好", "这是坏的", "再见", "هل هذا", "نعم", "यह है", "ठीक"]
    # A label whose id a thousand rows have is one training row.
    docs = spark.createDataFrame([(1, "vile thing")] * 1000 + [(k, f"good day number {k}") for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] + [(k, 0) for k in range(2, 40)], "doc_id long, toxic int")
    assert toxicity.toxicity(spark, docs, labels).count() == 1038


def brute_noisy_or(model, text):
    """The document's score by plain loops over sentences and words."""
    none = 1.0
    for a, b in toxicity.sentences(text.lower()):
        words = set(toxicity.WORD.findall(text.lower()[a:b]))
        found = {f for w in words for f in [w, *(f"{w[:k]}*" for k in (4, 5, 7) if len(w) > k)]}
        z = model.bias + sum(model.weights.get(f, 0) for f in found)
        none *= 1 - 1 / (1 + math.exp(-z))
    return 1 - none


def test_toxicity_brute_force(spark, docs):
    """The query's scores on whole texts against plain loops with the same model."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(spark, docs, labels)
    got = {r.doc_id: r.score for r in toxicity.toxicity(spark, docs, labels).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == pytest.approx(brute_noisy_or(model, r.text or ""), abs=1e-9)


def test_transport_times():
    """Presentation times, clock references, and times beyond 33 bits."""
    payload = transport.padded("t" * 50_000)[1]
    r = dict(zip(transport.FIELDS, transport.record("t" * 50_000), strict=True))
    step = transport.UNIT * transport.UNITS
    want = [at * 90_000 // 8000 for at in range(0, len(payload), step)]
    assert r["pts"] == want and r["random_access"] == want[:: transport.RANDOM_ACCESS]
    media, clocks = transport.mux(payload), []
    for k in range(0, len(media), 188):
        p = media[k : k + 188]
        if p[3] & 0x20 and p[4] >= 7 and p[5] & 0x10:
            clocks.append(int.from_bytes(p[6:10], "big") << 1 | p[10] >> 7)
    assert clocks == want
    for pts in (0, 1, (1 << 33) - 1, 1 << 32, 123_456_789):
        raw = b"\0\0\1\xbd" + (8 + 4).to_bytes(2, "big") + bytes([0x84, 0x80, 5]) + transport._time(pts) + b"data"
        assert transport._elementary(True, [raw]) == transport.Elementary(pts, True, b"data")


def test_transport_odd(spark, odd):
    """Every odd row's payload against plain Python; repeated rows are alike."""
    got = transport.media_columns(spark, odd).collect()
    text = {r.doc_id: r.text for r in odd.where("doc_id is not null").collect()}
    for r in got:
        if r.doc_id is not None:
            raw = (text[r.doc_id] or "").encode()
            payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
            assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id == 1}) == 1


def test_quality(spark, odd, none):
    import random

    rng = random.Random(3)
    for _ in range(60):
        words = [rng.choice("ab c d").strip() or "q" for _ in range(rng.randrange(60))]
        grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        in_two = {k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
        assert quality.repeated_words([w.encode() for w in words]) == len(in_two)
    w, chars, symbols, again, _ = quality.base_counts("a #b\n\n \na #b\né\x0b|\n ")
    assert (len(w), chars, symbols, again) == (6, 8, 3, 1)
    rows = {r.doc_id: r for r in quality.quality(spark, odd).collect()}
    assert rows[4].base_failed and not rows[4].kept and rows[2].n_words == 0 and rows[2].base_failed and rows[6].script == "none"
    meter = quality.Fertility(pieces.read_vocabulary(pieces.VOCABULARY))
    n, per, fallback, bits = meter.measure([b"the", b"the", "漢🚀".encode()], 8)
    assert n == 2 + len(meter.sp.encode("漢🚀")) and per == pytest.approx(8 / n) and fallback > 0 and bits > 0
    assert not quality.verdict("latin", 100, 0.5, 0.9, 1.0) and quality.quality(spark, none).count() == 0


def junk(kind, text, k):
    """A text of the kind, as long as a clean one."""
    import base64
    import random

    rng, n = random.Random(k), max(40, min(400, len(text.split())))
    if kind == "mojibake":
        return "".join(c if rng.random() < 0.7 else "é" for c in text).encode().decode("latin-1")
    if kind == "base64":
        return " ".join(base64.b64encode(hashlib.sha512(f"{k} {i}".encode()).digest()).decode()[: rng.randrange(20, 70)] for i in range(n // 2 + 20))
    if kind == "numbers":
        return " ".join(str(rng.randrange(10**6)) for _ in range(n))
    return " ".join("".join(rng.choice("asdfghjklqwertyuiopzxcvbnm") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def test_quality_bands(spark):
    """Planted junk in the corpus is rejected, clean documents (labelled 1) are kept."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select(F.col("doc_id").alias("id"), "quality")
    rows = [r for r in docs.collect() if r.text and 40 <= len(r.text.split()) <= 2000][:160]
    kinds = ["mojibake", "base64", "numbers", "keys"]
    bad = spark.createDataFrame([(-1 - k, junk(kinds[k % 4], r.text, k), r.lang, kinds[k % 4]) for k, r in enumerate(rows)], "doc_id long, text string, lang string, kind string")
    both = docs.select("doc_id", "text", "lang").unionByName(bad.drop("kind"))
    got = quality.quality(spark, both).cache()
    lost = {r.kind: r.part for r in got.join(bad.select("doc_id", "kind"), "doc_id").groupBy("kind").agg(F.avg((~F.col("kept")).cast("int")).alias("part")).collect()}
    assert min(lost.values()) >= 0.9, lost
    clean = got.join(labels, got.doc_id == labels.id).where("not base_failed")
    assert clean.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0] >= 0.99
    assert clean.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0] <= 0.3
    assert got.where("kept and base_failed").count() == 0
    # Medians and quartiles against numpy.
    some = quality.fitted(spark.createDataFrame([(None, "latin", False, n, c, e) for n, c, e in [(100, 2.0 + k / 100, 5 + k / 50) for k in range(120)]], "lang string, script string, base_failed boolean, n_tokens long, chars_per_token double, entropy double"), quality.Scratch(spark, "t"))
    band, sized = some[0].first(), some[1].first()
    x = np.round(2.0 + np.arange(120) / 100, 3)
    z = np.round((x - np.median(x)) * 10, 2)
    assert band.g == "slatin" and band.middle == pytest.approx(np.median(x)) and band.width == pytest.approx(np.subtract(*np.percentile(z, [75, 25])) / 1.349, abs=1e-9)
    assert sized.power == 6 and sized.bits == pytest.approx(np.median(5 + np.arange(120) / 50))


def brute_base(text):
    """The base counts by plain loops."""
    blank = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in text + " ":
        if c in blank:
            words += [word] if word else []
            word = ""
        else:
            word += c
    lines = [x for x in text.split("\n")]
    dup = sum(1 for i, x in enumerate(lines) if any(c not in blank for c in x) and x in lines[:i])
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    in_two = {k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(in_two)


def test_quality_base_counts(spark, docs):
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\t#|é\u2028\xa0x\r") for _ in range(rng.randrange(400))) for _ in range(200)] + [r.text for r in docs.collect() if r.text and len(r.text) < 6000]
    for t in texts:
        w, *rest = quality.base_counts(t)
        assert (len(w), *rest) == brute_base(t)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = docs
    for name, stage in cp.STAGES:
        out = stage(spark, step, SF)
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "simhash_neardup":
            assert step.count() == neardup.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/language_id")).select("component_id").distinct().count()
        if name == "secret_scans":
            assert step.where("text rlike 'token = \"[0-9a-f]{40}'").count() == 0
    assert step.where("not round_trip").count() == 0 and step.where(F.size("token_ids") == 0).count() == 0
    # Odd rows pass all stages.
    step = spark.createDataFrame(ODD, DOC)
    for name, stage in cp.STAGES:
        stage(spark, step, SF).write.parquet(f"{tmp_path}/odd_{name}")
        step = spark.read.parquet(f"{tmp_path}/odd_{name}")
    assert step.count() > 0
