"""Column expressions over text: cleaning, comments, literals and counts of constructs in
database program code.  All run inside the JVM; patterns are literals, so each is compiled
once a task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the constructs that are counted.
IDENT = r"[A-Za-z_][A-Za-z0-9_$#]*"
LITERAL = r"'(?:[^']|'')*'"
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
CURSORS = {"CURSOR_EXPLICIT": rf"(?i)\bCURSOR\s+{IDENT}\s+IS\b", "CURSOR_FORLOOP": rf"(?i)\bFOR\s+{IDENT}\s+IN\s*[\(\w]", "CURSOR_REF": r"(?i)\bSYS_REFCURSOR\b"}
BRANCH_WORDS = ("IF", "ELSIF", "CASE", "LOOP", "WHILE", "FOR")
TX_CONTROL = r"(?i)\b(COMMIT|ROLLBACK|SAVEPOINT)\b"
AUTONOMOUS = r"(?i)PRAGMA\s+AUTONOMOUS_TRANSACTION"
VENDOR = {
    "CONNECT_BY": r"(?i)\bCONNECT\s+BY\b",
    "MERGE": r"(?i)\bMERGE\s+INTO\b",
    "ANALYTIC": r"(?i)\)\s*OVER\s*\(",
    "BULK_COLLECT": r"(?i)\bBULK\s+COLLECT\b",
    "FORALL": r"(?i)\bFORALL\b",
    "UTL": r"(?i)\bUTL_[A-Z0-9_]*\s*\.",
    "DBMS": r"(?i)\bDBMS_[A-Z0-9_]*\s*\.",
}
EXCEPTION = r"(?i)\bEXCEPTION\b"
WHEN_OTHERS = r"(?i)\bWHEN\s+OTHERS\b"
GOTO = r"(?i)\bGOTO\b"
DB_LINK = r"\b[A-Za-z_][A-Za-z0-9_$#.]*@([A-Za-z_][A-Za-z0-9_$#]*)\b"
DYNAMIC = r"(?is)EXECUTE\s+IMMEDIATE\s+(.+?)(?=\s+INTO\s|\s+USING\s|;)"
ALL_LITERAL = rf"(?s)^\s*{LITERAL}(?:\s*\|\|\s*{LITERAL})*\s*$"
STATEMENT = r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|MERGE|TRUNCATE)\b"
TABLE_NAME = r"[A-Za-z0-9_$#.]+"
SUBPROGRAM = r"(?i)^\s*(?:PROCEDURE|FUNCTION)\s+([A-Z_][A-Z0-9_$#]*)"
DECLARED = rf"(?i)^\s*({IDENT})\s+(?:CONSTANT\s+)?[A-Za-z]"
NOT_DECLARED = ("BEGIN", "END", "IS", "AS", "PACKAGE", "BODY")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_any(c: Column | str) -> Column:
    """Trims all Unicode white space."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def clean_str(c: Column | str) -> Column:
    """Null, blank and the text nan (any case) become '', the rest is trimmed."""
    t = F.coalesce(trim_any(col(c).cast("string")), F.lit(""))
    return F.when(F.lower(t) == "nan", "").otherwise(t)


def is_code_line(c: Column | str, comment: str = "--") -> Column:
    """Not blank and not a line comment."""
    t = trim_any(F.coalesce(col(c), F.lit("")))
    return (t != "") & ~t.startswith(comment)


def strip_comments(c: Column | str) -> Column:
    """Block comments become a blank, line comments go (also a -- inside a literal)."""
    return F.regexp_replace(F.regexp_replace(col(c), BLOCK_COMMENT, " "), r"--[^\n]*", "")


def strip_comments_keep_lines(c: Column | str) -> Column:
    """As strip_comments, but a block comment leaves its line ends, so that lines keep their numbers."""
    parts = F.split(col(c), r"(?s)(?=/\*)|(?<=\*/)", -1)
    kept = F.transform(parts, lambda p: F.when(p.startswith("/*") & p.endswith("*/") & (F.length(p) >= 4), F.regexp_replace(p, r"[^\n]", "")).otherwise(p))
    return F.regexp_replace(F.array_join(kept, ""), r"--[^\n]*", "")


def mask_strings(c: Column | str) -> Column:
    return F.regexp_replace(col(c), LITERAL, "''")


def clean_code(c: Column | str) -> Column:
    return mask_strings(strip_comments(c))


def count(c: Column | str, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(col(c), F.lit(pattern)), F.lit(0)).cast("long")


def count_word(c: Column | str, word: str) -> Column:
    return count(c, rf"(?i)\b{word}\b")


def branch_count(c: Column | str) -> Column:
    """Occurrences of the branching words; END IF and END LOOP count as well."""
    return sum((count_word(c, w) for w in BRANCH_WORDS), F.lit(0).cast("long"))


def flag(condition: Column) -> Column:
    """Y or N; null is N."""
    return F.when(F.coalesce(condition, F.lit(False)), "Y").otherwise("N")


def extract_all(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def db_links(c: Column | str) -> Column:
    """Names after @, one for each match."""
    return extract_all(c, DB_LINK, 1)


def dynamic_sql(c: Column | str) -> Column:
    """Expressions of EXECUTE IMMEDIATE: array of (expr, kind), LITERAL if only literals are joined."""
    found = extract_all(c, DYNAMIC, 1)
    return F.transform(found, lambda e: F.struct(e.alias("expr"), F.when(e.rlike(ALL_LITERAL), "LITERAL").otherwise("VARIABLE").alias("kind")))


def dynamic_variables(expr: Column) -> Column:
    """Identifiers outside literals, without USING and INTO, joined by ';' with repeats."""
    names = extract_all(F.regexp_replace(expr, LITERAL, " "), IDENT, 0)
    return F.array_join(F.filter(names, lambda n: ~F.upper(n).isin("USING", "INTO")), ";")


def unquote_literals(expr: Column) -> Column:
    """The text inside an expression's literals, with doubled quotes single."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(expr, "''", "\u0001"), "'", ""), "\u0001", "'")


def statements(c: Column | str) -> Column:
    """Static statements: array of (dml, body), by chunks between semicolons."""
    chunks = F.transform(F.split(col(c), ";"), lambda s: F.struct(F.upper(F.regexp_extract(s, STATEMENT, 1)).alias("dml"), trim_any(F.regexp_extract(s, rf"(?s){STATEMENT}.*$", 0)).alias("body")))
    return F.filter(chunks, lambda s: s["dml"] != "")


def statement_tables(body: Column, dml: Column) -> Column:
    """Tables of a statement: all of FROM and JOIN lists for SELECT, else the first target."""
    name = TABLE_NAME
    lists = extract_all(body, rf"(?i)\b(?:FROM|JOIN)\s+({name}(?:\s*,\s*{name})*)", 1)
    many = F.flatten(F.transform(lists, lambda x: F.transform(F.split(x, ","), lambda t: trim_any(t))))
    one = lambda p: F.filter(F.array(F.regexp_extract(body, p, 1)), lambda t: t != "")
    gone = F.when(body.rlike(rf"(?i)\bFROM\s+{name}"), one(rf"(?i)\bFROM\s+({name})")).otherwise(one(rf"(?i)\bDELETE\s+({name})"))
    return (
        F.when(dml == "SELECT", many).when(dml == "INSERT", one(rf"(?i)\bINTO\s+({name})")).when(dml == "UPDATE", one(rf"(?i)\bUPDATE\s+({name})"))
        .when(dml == "DELETE", gone).when(dml == "MERGE", one(rf"(?i)\bMERGE\s+INTO\s+({name})")).when(dml == "TRUNCATE", one(rf"(?i)\bTABLE\s+({name})"))
        .otherwise(F.array().cast("array<string>"))
    )


def nesting(c: Column | str, opening: str = r"\(", closing: str = r"\)", mark: str = r"\bSELECT\b") -> Column:
    """The greatest bracket depth at a mark (depth never below 0) and the number of marks."""
    tokens = extract_all(c, rf"(?i){opening}|{closing}|{mark}")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most"), F.lit(0).alias("marks"))

    def step(s: Column, t: Column) -> Column:
        depth = F.when(t.rlike(rf"(?i)^{opening}$"), s["depth"] + 1).when(t.rlike(rf"(?i)^{closing}$"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        is_mark = t.rlike(rf"(?i)^{mark}$")
        return F.struct(depth.alias("depth"), F.when(is_mark, F.greatest(s["most"], s["depth"])).otherwise(s["most"]).alias("most"), (s["marks"] + is_mark.cast("int")).alias("marks"))

    return F.aggregate(tokens, start, step)


def quoted(c: Column) -> Column:
    """A text as a literal part of a regular expression."""
    return F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))


def strip_overload(c: Column | str) -> Column:
    return F.upper(F.regexp_replace(col(c), r"#\d+$", ""))


def safe_id(c: Column | str) -> Column:
    """Every character that isn't ASCII alphanumeric becomes _."""
    return F.regexp_replace(col(c), r"[^A-Za-z0-9]", "_")


def round2(c: Column) -> Column:
    """Rounds to two places, halves to even, as numpy does."""
    return F.rint(c * 100) / 100
