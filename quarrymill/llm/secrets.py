"""Secret scans with a random forest; DataFrame and SQL functions only.

Candidates are runs of ``LEAST`` or more token characters ("=" only ends one, as padding, so
that a name and its value are two), and values of ``LEAST_KEYED`` or more characters of any
kind that are assigned to a name with a key word; quoted ones go to their quote and may hold
blanks, others end at a blank, quote, comma or semicolon.  Each has features: length, transitions between character
classes, distinct characters, shares of digits and capitals, coverage by a dictionary, known
prefixes, signs in the row's path, and words next to it; these are taken from the text itself,
earlier candidates included.  A random forest trained from labelled findings gives the probability that it is a
secret; below ``THRESHOLD`` it counts as a false positive.

The forest is trained by Spark's own library on labelled findings, at most ``MOST_LABELLED``:
those that the caller gives, or ``findings()``, which makes them by rule from public token formats
and their look-alikes, between words, key names and seeded noise of signs.  It is then written as
one SQL expression, so a scan is a narrow projection of the texts: nothing is shuffled, and
redaction happens in the row.

Defined results: a null or empty text has no candidates and is returned as it is; a null
path has no signs; repeated rows get equal results; candidates are numbered from 0; a probability
of THRESHOLD counts as a secret; columns of any name pass.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import pick

LEAST = 16
LEAST_KEYED = 4
_KEY = r"(?i:token|secret|passw(?:or)?d|passphrase|pwd|api[_ -]?key|auth|bearer|credential|private[_ -]?key|access[_ -]?key|client[_ -]?key)[A-Za-z0-9_\-]{0,24}[\x22\x27]?[ \t]{0,4}(?:[:=]=?|=>)[ \t]{0,4}"
#: A keyed value in quotes, one without, or a run.  Cheap looks behind come first.
CANDIDATE = (
    rf"(?<=[\x22\x27:=> \t])(?:(?<=[\x22\x27])(?<=[:=>][ \t]{{0,4}}[\x22\x27])(?<={_KEY}[\x22\x27])[^\x22\x27\r\n]{{4,}}+(?=[\x22\x27])"
    rf"|(?<=[:=> \t])(?<=[:=>][ \t]{{0,4}})(?<={_KEY})[^\s\x22\x27,;:=>][^\s\x22\x27,;]{{3,}}+)"
    r"|(?<![A-Za-z0-9_+/\-])[A-Za-z0-9_+/\-]{16,}+(?:={1,2}(?![A-Za-z0-9_+/=\-]))?"
)
#: Characters of a candidate's surroundings that are looked at.
NEAR = 48
#: The fewest characters of any candidate.
SHORTEST = LEAST_KEYED
THRESHOLD = 0.5
REDACTED = "[SECRET]"
#: Labelled findings that are trained on at most, chosen by a hash.
MOST_LABELLED = 100_000

# Words whose letters in a candidate speak against a random token.
DICTIONARY = (
    "about account action address admin after again agent alpha android apple application archive array asset async author backup balance banner base before beta "
    "binary block board body bottom branch bridge browser buffer build button cache call camera cancel card carrier catalog category center chain change channel "
    "chapter chart check child city class client close cloud cluster code color column command commit common company component config connect console contact "
    "container content context control cookie copy core count country create current custom data database date debug default delete demo deploy design detail "
    "device dialog digest display document domain download draft driver dummy east edition editor email empty enable engine entry error event example export "
    "extension factory feature field file filter final folder font footer form format frame free from function game general global group guide handler hash head "
    "health height hello help high home host house html http icon image import index info input install instance integer item java javascript job join journal "
    "json kernel label language large last latest layer layout level library license light limit line link linux list local location lock login logo long lower "
    "machine mail main manager manual map market master match media member memory menu message meta method metric middle mobile mode model module money monitor "
    "month mouse movie music name native network news next node north note number object office offset online open option orange order output owner package page "
    "panel paper parent park part path pattern payment people phone photo place plan plugin point policy port post power press price print private process product "
    "profile program project protocol public python query queue random range rate read record region release remote report request resource response rest result "
    "review right road root route rule sample scale schema school screen script search section select sequence serial server service session setting shape share "
    "sheet short simple size skin small social source south space spring stack standard start state static status step stop storage store stream street string "
    "style subject summary support system table target task team template test text theme thread time title token tool total trace track train transfer tree type "
    "update upload upper user utils value vector version video view village water week west white width window word work world write year zone"
).split()

#: Features by name, as SQL over a candidate @c, the text before it @b, the text after it @a
#: and a path @p.
FEATURES = {
    "length": "log2(cast(length(@c) as double))",
    "transitions": r"regexp_count(@c, '[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+') / cast(length(@c) as double)",
    "distinct": "size(array_distinct(split(@c, ''))) / cast(least(length(@c), 64) as double)",
    "digits": "regexp_count(@c, '[0-9]') / cast(length(@c) as double)",
    "capitals": "regexp_count(@c, '[A-Z]') / cast(length(@c) as double)",
    "hexadecimal": "cast(@c rlike '^([0-9a-f]+|[0-9A-F]+)$' as double)",
    "consonants": "regexp_count(lower(@c), '[bcdfghjklmnpqrstvwxz]{4}') / cast(length(@c) as double)",
    "vowels": "regexp_count(lower(@c), '[aeiouy]') / cast(length(@c) as double)",
    "letters": "cast(@c rlike '^([a-z]+|[A-Z]+|[A-Z][a-z]+)$' as double)",
    "blanks": r"regexp_count(@c, '[ \t]') / cast(length(@c) as double)",
    "punctuation": r"regexp_count(@c, '[^A-Za-z0-9 \t_+/=.\-]') / cast(length(@c) as double)",
    "separators": r"regexp_count(@c, '[_+/=\\-]') / cast(length(@c) as double)",
    "dictionary": "1 - length(regexp_replace(lower(@c), '" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + "', '')) / cast(length(@c) as double)",
    "prefix": r"cast(@c rlike '^(AKIA|ASIA|AIza|gh[opsu]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|pk_live_|eyJ|npm_|SG)' as double)",
    "asked": r"cast(@b rlike '(?i)(token|secret|passw|pwd|api[_ -]?key|apikey|auth|bearer|credential|private[_ -]?key|access[_ -]?key|client[_ -]?key)[^A-Za-z0-9]{0,12}$' as double)",
    "near": r"cast(@b rlike '(?i)(token|secret|passw|pwd|api[_ -]?key|apikey|auth|bearer|credential|private|access[_ -]?key)' as double)",
    "harmless": r"cast(@b rlike '(?i)(commit|sha-?[0-9]*|md5|checksum|hash|uuid|guid|digest|etag|integrity|order|invoice|card|phone|isbn|serial|build|revision|trace|request|session id)[^A-Za-z0-9]{0,12}$' as double)",
    "assigned": r"cast(@b rlike '[=:][^A-Za-z0-9]{0,8}$' as double)",
    "quoted": r"cast(@b rlike '[\"\']$' and @a rlike '^[\"\']' as double)",
    "placeholder": r"cast(lower(@c) rlike 'example|sample|dummy|changeme|placeholder|xxxx|0000000|1234567|abcdef' as double)",
    "test_path": r"cast(coalesce(@p, '') rlike '(?i)(test|example|sample|fixture|mock|docs?/|readme)' as double)",
    "code_path": r"cast(coalesce(@p, '') rlike '(?i)\\.(py|js|ts|java|go|rb|env|ya?ml|json|toml|ini|cfg|conf|properties|sh)$' as double)",
}


def _over(row: str) -> dict[str, str]:
    """FEATURES over columns or a lambda's struct."""
    out = {}
    for name, sql in FEATURES.items():
        for x in "cbap":
            sql = sql.replace(f"@{x}", row + x)
        out[name] = sql
    return out


def findings(spark: SparkSession, rows: int = 6000, first: int = 0) -> DataFrame:
    """Labelled findings (c, b, a, p, label, kind) from public token formats and their look-alikes,
    by a rule: the row's number, from first, chooses a format (kind) and, through digests, its
    characters.  One row in four has noise around its assignment: one to three of a sign, as soiled
    texts have."""
    choose = lambda seed, values: f"element_at(split('{'@'.join(values)}', '@'), cast(1 + pmod(xxhash64(id, {seed}), {len(values)}) as int))"
    asked = "token secret api_key apikey password passwd auth_token access_key client_secret SECRET_KEY bearer".split() + ["Authorization: Bearer"]
    calm = "commit sha1 sha256 md5 checksum uuid etag digest build revision order trace request integrity".split()
    glue = [' = "', " = ", ': "', ": ", "=", '="', " := ", " "]
    signs = "! # $ % & * | ~ ^ < > + ; , ?".split()
    table = spark.range(first, first + rows).selectExpr("id", "concat(sha1(concat('a', id)), sha1(concat('b', id))) as h", *(f"{choose(k, DICTIONARY)} as w{k}" for k in range(6)))
    syllables = "nicht schaft lich keit ung zu ein ver sch en tion ment eau ha ing th er re st on auf gen nth ight str".split()
    table = table.withColumn("long", F.expr(f"concat({', '.join(choose(40 + k, syllables) for k in range(5))}, 'erstand')"))
    table = table.selectExpr(
        "*", "regexp_replace(base64(unhex(concat(h, h))), '[\\r\\n=]', '') as b64", "upper(translate(h, '0189', 'KQXZ')) as caps", "translate(h, 'abcdef', '480215') as digits",
        "translate(h, '0123456789abcdef', 'kQzWvTbXmRjNpLcG') as mixed", "translate(h, '0123456789', 'gkmpqvwxyz') as low", "translate(upper(h), '0123456789', 'GKMPQVWXYZ') as high",
        "concat(substring(w4, 1, 1), substring(w5, 2, 2), substring(w1, 2, 9), substring(w2, 1, 9), w0, 'er') as words",
        f"{choose(29, [': ', '= ', ' = ', '=', ': '])} as plain", f"{choose(30, ['!', '.', '$', '#', '%', '&', '*', '?'])} as mark",
        f"{choose(21, asked)} as asked", f"{choose(22, calm)} as calm", f"{choose(23, glue)} as assign", f"repeat({choose(33, signs)}, cast(1 + pmod(xxhash64(id, 34), 3) as int)) as noise", f"repeat({choose(35, signs)}, cast(pmod(xxhash64(id, 36), 4) as int)) as more", f"concat(w0, ' ', w1, ' ', w2, {choose(24, ['. ', ' ', ', '])}) as prose",
        "substring(h, 1, cast(element_at(array(32, 40, 40, 40, 64), cast(1 + pmod(xxhash64(id, 25), 5) as int)) as int)) as hexes",
    )
    table = table.withColumn("glue", F.expr("case when pmod(xxhash64(id, 37), 4) = 0 then concat(noise, ' =', more, ' \"') else assign end"))
    # Each format: candidate, words before, label.
    kinds = [
        ("hexes", "concat(prose, asked, glue)", 1),
        ("hexes", "concat(prose, asked, glue)", 1),
        ("upper(hexes)", "concat(upper(prose), upper(asked), glue)", 1),
        ("substring(b64, 1, cast(24 + pmod(xxhash64(id, 26), 40) as int))", "concat(prose, asked, glue)", 1),
        ("concat('AKIA', substring(caps, 1, 16))", "concat(prose, glue)", 1),
        ("concat('ghp_', substring(b64, 1, 36))", "prose", 1),
        ("concat('sk_live_', substring(b64, 1, 24))", "concat(prose, asked, glue)", 1),
        ("concat('xoxb-', substring(digits, 1, 11), '-', substring(b64, 1, 24))", "prose", 1),
        ("concat('eyJ', b64)", "concat(prose, asked, ' ')", 1),
        ("hexes", "concat(prose, calm, glue)", 0),
        ("hexes", "prose", 0),
        ("upper(hexes)", "concat(upper(prose), upper(calm), glue)", 0),
        ("substring(digits, 1, 16)", "prose", 0),
        ("substring(digits, 1, cast(16 + pmod(xxhash64(id, 27), 5) as int))", "concat(prose, calm, glue)", 0),
        ("concat(substring(h, 1, 8), '-', substring(h, 9, 4), '-4', substring(h, 13, 3), '-a', substring(h, 17, 3), '-', substring(h, 21, 12))", "concat(prose, calm, glue)", 0),
        ("concat(w3, '_', w4, '_', w5, '_', substring(digits, 1, 3), '_', w0)", "concat(prose, asked, glue)", 0),
        ("concat(w3, '/', w4, '-', w5, '/', w0, '-', substring(digits, 1, 4))", "prose", 0),
        ("concat('20', substring(digits, 1, 2), '-', '11-', '0', substring(digits, 3, 1), 'T', substring(digits, 4, 6))", "prose", 0),
        ("concat(w3, 'example', substring(digits, 1, 6), 'token')", "concat(prose, asked, glue)", 0),
        ("concat('xxxxxxxxxxxxxxxx', substring(digits, 1, 4))", "concat(prose, asked, glue)", 0),
        ("concat(substring(b64, 1, 80), substring(b64, 1, 80))", "concat(prose, 'data:image/png;base64,')", 0),
        ("concat('sha512-', b64, b64)", "concat(prose, 'integrity', glue)", 0),
        # Without a digit, short, or with punctuation.
        ("substring(mixed, 1, cast(12 + pmod(xxhash64(id, 31), 24) as int))", "concat(prose, asked, ' = \"')", 1),
        ("substring(low, 1, cast(14 + pmod(xxhash64(id, 31), 20) as int))", "concat(prose, asked, plain)", 1),
        ("concat('AKIA', substring(high, 1, 16))", "prose", 1),
        ("substring(b64, 1, cast(8 + pmod(xxhash64(id, 32), 8) as int))", "concat(prose, asked, ': \"')", 1),
        ("substring(b64, 1, cast(8 + pmod(xxhash64(id, 32), 8) as int))", "concat(prose, asked, plain)", 1),
        ("concat(substring(b64, 1, 5), mark, substring(b64, 7, 4), mark, substring(digits, 1, 2))", "concat(prose, asked, plain)", 1),
        ("concat(substring(mixed, 1, 6), mark, substring(b64, 7, 5))", "concat(prose, asked, ' = \"')", 1),
        ("long", "prose", 0),
        ("long", "concat(prose, w3, ' | ')", 0),
        ("case when id % 2 = 0 then initcap(long) else upper(long) end", "prose", 0),
        ("words", "prose", 0),
        ("upper(words)", "prose", 0),
        ("words", "concat(prose, asked, plain)", 0),
        ("w3", "concat(prose, asked, plain)", 0),
        ("concat(w3, ' ', w4, ' ', w5)", "concat(prose, asked, ': \"')", 0),
        ("concat('get_', w3, '(', w4, ')')", "concat(prose, asked, plain)", 0),
        ("concat('$', '{', upper(w3), '_', upper(w4), '}')", "concat(prose, asked, plain)", 0),
        ("concat(w3, '.', w4, '.', w5)", "concat(prose, asked, plain)", 0),
        ("concat(w3, '|', w4, '-', w5, '|', w1)", "prose", 0),
    ]
    of = lambda k: "case " + " ".join(f"when id % {len(kinds)} = {i} then {x[k]}" for i, x in enumerate(kinds)) + " end"
    paths = "src/main.py config/app.yml deploy/.env web crawl src0 lib/client.js server/settings.json tests/test_main.py docs/readme.md".split()
    table = table.selectExpr("id", f"{of(0)} as c", f"{of(1)} as b", f"{of(2)} as label", f"cast(id % {len(kinds)} as int) as kind")
    # Look-alikes also come from tests and documentation.
    table = table.withColumn("p", F.expr(f"case when label = 1 then {choose(28, paths[:-2])} else {choose(28, paths)} end"))
    quote = "case when b rlike '\"$' then '\"' else ' ' end"
    return table.selectExpr("c", f"right(b, {NEAR}) as b", f"{quote} as a", "p", "cast(label as double) as label", "kind")


def _tree_sql(tree: str) -> str:
    """The CASE expression of a tree's debug string, over the fields of x."""
    names = list(FEATURES)
    lines = [line.strip() for line in tree.splitlines()[1:] if line.strip()]

    def node(at: int) -> tuple[str, int]:
        line = lines[at]
        if line.startswith("Predict:"):
            return f"{float(line.split()[1]):.1f}D", at + 1
        feature, bound = line[line.index("feature ") + 8 : -1].split(" <= ")
        yes, at = node(at + 1)
        no, at = node(at + 1)  # skips the Else line
        return f"CASE WHEN x.{names[int(feature)]} <= {float(bound)!r}D THEN {yes} ELSE {no} END", at

    return node(0)[0]


def forest_sql(model: RandomForestClassificationModel) -> str:
    """The share of the forest's trees that say secret, as SQL over the fields of x."""
    trees = [_tree_sql(t.toDebugString) for t in model.trees]
    return f"round(({' + '.join(trees)}) / {float(len(trees))}D, 6)"


def train(spark: SparkSession, labelled: DataFrame | None = None, trees: int = 24, depth: int = 6) -> str:
    """Trains the forest on labelled findings (c, b, a, p, label) and returns its SQL.  Their
    texts are scanned as any text is: candidates within c have its label, others 0."""
    rows = findings(spark) if labelled is None else labelled
    if labelled is not None and (total := rows.count()) > MOST_LABELLED:
        rows = rows.where(pick(F.lit(MOST_LABELLED / total), "c", "b", "a", "p"))
    # Cached step by step, as each takes its columns many times; one partition order, so that
    # reruns draw the same rows.
    texts = rows.selectExpr("cast(label as double) as whole", "c as sought", "p", "concat(coalesce(b, ''), c, coalesce(a, '')) as __text").coalesce(1).cache()
    split = candidates(texts, "p", "__text").selectExpr("whole", "sought", "inline(__found)").cache()
    label = F.expr("case when contains(c, sought) or contains(sought, c) then whole else 0D end").alias("label")
    rows = split.select(label, array_to_vector(F.expr(f"array({', '.join(_over('').values())})")).alias("features")).cache()
    if rows.agg(F.count_distinct("label")).first()[0] < 2:
        raise ValueError("labelled findings of both kinds are needed")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=32, seed=42, featureSubsetStrategy="sqrt")
    model = forest.fit(rows)
    for held in (rows, split, texts):
        held.unpersist()
    return forest_sql(model)


def candidates(docs: DataFrame, path: str = "source", text: str = "text") -> DataFrame:
    """docs with __runs (the candidates), __parts (the texts between them) and __found (each
    candidate c, the NEAR characters before it b and after it a, and the path p)."""
    pattern = CANDIDATE.replace("\\", "\\\\")
    docs = docs.withColumn("__runs", F.expr(f"case when `{text}` is null then array() else regexp_extract_all(`{text}`, '{pattern}', 0) end"))
    # Most texts have few candidates.
    docs = docs.withColumn("__parts", F.expr(f"case when size(__runs) > 0 then split(`{text}`, '{pattern}', -1) end"))
    # So many earlier candidates are NEAR characters long at least.
    many = -(-NEAR // SHORTEST)
    earlier = f"transform(slice(__runs, greatest(1, i - {many - 1}), least(i, {many})), (e, k) -> concat(right(__parts[greatest(0, i - {many}) + k], {NEAR}), right(e, {NEAR})))"
    before = f"right(concat(array_join({earlier}, ''), right(__parts[i], {NEAR})), {NEAR})"
    after = f"left(concat(left(__parts[i + 1], {NEAR}), coalesce(get(__runs, i + 1), '')), {NEAR})"
    return docs.withColumn("__found", F.expr(f"case when size(__runs) > 0 then transform(__runs, (r, i) -> named_struct('c', r, 'b', {before}, 'a', {after}, 'p', cast(`{path}` as string))) end"))


def scan(docs: DataFrame, forest: str, path: str = "source", text: str = "text") -> DataFrame:
    """docs with __parts (the texts between candidates), __runs (the candidates) and __p (each
    candidate's probability)."""
    features = ", ".join(f"'{k}', {v}" for k, v in _over("z.").items())
    docs = candidates(docs, path, text).withColumn("__x", F.expr(f"transform(__found, z -> named_struct({features}))"))
    return docs.withColumn("__p", F.expr(f"transform(__x, x -> {forest})")).drop("__x", "__found")


def findings_of(spark: SparkSession, docs: DataFrame, labelled: DataFrame | None = None, path: str = "source") -> DataFrame:
    """A row for each candidate: doc_id, ordinal, n_chars, probability, is_secret, and the
    candidate's SHA-256 (not itself)."""
    scanned = scan(docs.select("doc_id", "text", path), train(spark, labelled), path)
    # The outer explode: from an inner one Spark infers a filter, which computes the scan again
    # for each candidate.
    rows = scanned.select("doc_id", F.posexplode_outer(F.arrays_zip("__runs", "__p")).alias("ordinal", "x")).where("x.__p is not null")
    return rows.select(
        "doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.length("x.__runs").cast("long").alias("n_chars"), F.col("x.__p").alias("probability"),
        (F.col("x.__p") >= THRESHOLD).alias("is_secret"), F.sha2("x.__runs", 256).alias("value_sha256"),
    )


def redacted(spark: SparkSession, docs: DataFrame, labelled: DataFrame | None = None, path: str = "source") -> DataFrame:
    """docs with every secret replaced by REDACTED; texts without one are left alone, and
    n_chars, if there, is the new length where the text changed."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", F.col(path).alias("path"))
    scanned = scan(rows, train(spark, labelled), "path")
    safe = f"transform(__runs, (r, i) -> case when coalesce(__p[i], 0) >= {THRESHOLD} then '{REDACTED}' else r end)"
    scanned = scanned.withColumn("__secret", F.expr(f"coalesce(exists(__p, x -> x >= {THRESHOLD}), false)"))
    scanned = scanned.withColumn("__safe", F.expr(f"case when __secret then {safe} end"))
    built = "array_join(zip_with(__parts, concat(__safe, array('')), (s, r) -> concat(s, r)), '')"
    scanned = scanned.withColumn("__new", F.expr(f"case when __secret then {built} else text end"))
    own = {"text": F.col("__new"), "n_chars": F.when(F.col("__secret"), F.length("__new").cast("long")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(0))}
    return scanned.select(*(own.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
