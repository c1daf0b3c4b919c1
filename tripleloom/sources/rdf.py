"""RDF text as triples, and back.

N-Triples has one statement a line, so it is read and written by Spark's text
source, split anywhere.  Turtle is not splittable: each file is one task of a
small parser (prefixes, base, ``a``, predicate and object lists, blank nodes,
collections of neither kind; numbers, booleans, long strings).
"""

from __future__ import annotations

import re
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.graph import RDF_TYPE, Graph

XSD = "http://www.w3.org/2001/XMLSchema#"
TRIPLES = "s string, p string, o string, o_is_literal boolean, o_datatype string, o_lang string"
_STATEMENT = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*\.\s*(?:#.*)?$'
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        return chr(int(x[1:], 16)) if x[0] in "uU" else _ESCAPES.get(x, x)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text)


def sniff(lines: DataFrame) -> tuple[bool, bool]:
    """Whether every line that is neither empty nor a comment starts like a statement and ends with a full stop, and there is one; and whether all are statements.  One pass."""
    t = F.regexp_replace("value", r"^\s+|\s+$", "")
    x = lines.select(t.alias("t")).filter((F.col("t") != "") & ~F.col("t").startswith("#"))
    shape = (F.col("t").startswith("<") | F.col("t").startswith("_:")) & F.col("t").endswith(".")
    r = x.agg(F.count(F.lit(1)).alias("n"), F.min(shape.cast("int")).alias("shape"), F.min(F.col("t").rlike(_STATEMENT).cast("int")).alias("whole")).first()
    return bool(r.n and r["shape"]), bool(r.n and r["whole"])


def looks_like_ntriples(lines: DataFrame) -> bool:
    return sniff(lines)[0]


def _unescaped(c: F.Column) -> F.Column:
    """Escapes undone without Python for the common ones; the rest row by row only where a backslash-u is."""
    plain = c
    mark = ""
    for a, b in (("\\\\", mark), ('\\"', '"'), ("\\'", "'"), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), (mark, "\\")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.when(F.instr(c, "\\") == 0, c).otherwise(F.when(c.rlike(r"\\[uU]"), _slow(c)).otherwise(plain))


@F.pandas_udf(StringType())
def _slow(x):
    return x.map(lambda t: t if t is None else unescape(t))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Statements of the files; a line that is none raises when it is read."""
    from ..plans.session import ship

    ship(spark)
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    g = lambda i: F.regexp_extract("value", _STATEMENT, i)
    bad = F.raise_error(F.concat(F.lit("not an N-Triples statement: "), "value"))
    x = lines.select(F.when(F.col("value").rlike(_STATEMENT), F.struct(g(1).alias("s"), g(2).alias("p"), g(3).alias("o"))).otherwise(bad).alias("t")).select("t.*")
    node = lambda c: F.when(F.col(c).startswith("<"), _unescaped(F.expr(f"substring({c}, 2, length({c}) - 2)"))).otherwise(F.col(c))
    lit = F.col("o").startswith('"')
    tail = F.regexp_extract("o", r'(\^\^<[^>]*>|@[A-Za-z0-9-]+)$', 1)
    tail = F.when(F.col("o").endswith('"'), F.lit("")).otherwise(tail)
    body = F.expr("substring(o, 2, length(o) - 2 - length(tail))")
    x = x.withColumn("tail", tail)
    return x.select(
        node("s").alias("s"), F.col("p"), F.when(lit, _unescaped(body)).otherwise(node("o")).alias("o"), lit.alias("o_is_literal"),
        F.when(lit & F.col("tail").startswith("^^"), F.expr("substring(tail, 4, length(tail) - 4)")).alias("o_datatype"),
        F.when(lit & F.col("tail").startswith("@"), F.expr("substring(tail, 2)")).alias("o_lang"),
    )


_TOKEN = re.compile(
    r'''\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<str>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^'\\]|\\.|'(?!''))*\'\'\'|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')'''
    r"""|(?P<dir>@(?:prefix|base)\b|(?i:PREFIX|BASE)\b)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<bnode>_:[\w.-]*\w)"""
    r"""|(?P<num>[+-]?(?:\d+\.?\d*[eE][+-]?\d+|\d*\.\d+|\d+))|(?P<name>[\w.-]*:(?:[\w:%-]|\.(?=[\w:%-])|\\.)*)|(?P<word>true|false|a)\b|(?P<mark>[.;,\[\]()])""",
    re.S,
)


def parse_turtle(text: str) -> list[tuple]:
    """Triples of a Turtle document; ValueError where it isn't one."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not Turtle at {text[at : at + 40]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    prefixes: dict[str, str] = {}
    base, out, i, fresh = "", [], 0, 0

    def peek() -> tuple[str, str]:
        return tokens[i] if i < len(tokens) else ("end", "")

    def take(kind: str | None = None, value: str | None = None) -> str:
        nonlocal i
        k, v = peek()
        if (kind and k != kind) or (value and v != value):
            raise ValueError(f"not Turtle: {v!r} where {value or kind} is due")
        i += 1
        return v

    def iri(v: str) -> str:
        v = unescape(v[1:-1])
        return v if re.match(r"[A-Za-z][\w+.-]*:", v) else base + v

    def name(v: str) -> str:
        p, _, rest = v.partition(":")
        if p not in prefixes:
            raise ValueError(f"unknown prefix: {p!r}")
        return prefixes[p] + re.sub(r"\\(.)", r"\1", rest)

    def blank() -> str:
        nonlocal fresh
        fresh += 1
        return f"_:gen{fresh}"

    def resource() -> str:
        k, v = peek()
        if k == "iri":
            return iri(take())
        if k == "name":
            return name(take())
        if k == "bnode":
            return take()
        if v == "[":
            take()
            b = blank()
            if peek()[1] != "]":
                predicates(b)
            take("mark", "]")
            return b
        if v == "(":
            take()
            items = []
            while peek()[1] != ")":
                items.append(thing())
            take()
            rdf = RDF_TYPE.rpartition("#")[0] + "#"
            head = (f"{rdf}nil", False, None, None)
            for x in reversed(items):
                b = blank()
                out.append((b, f"{rdf}first", *x))
                out.append((b, f"{rdf}rest", *head))
                head = (b, False, None, None)
            return head[0]
        raise ValueError(f"not Turtle: {v!r} is no node")

    def thing() -> tuple:
        k, v = peek()
        if k == "str":
            take()
            body = unescape(v[3:-3] if v[:3] in ('"""', "'''") and len(v) >= 6 else v[1:-1])
            if peek()[0] == "lang":
                return body, True, None, take()[1:]
            if peek()[0] == "type":
                take()
                return body, True, resource(), None
            return body, True, None, None
        if k == "num":
            take()
            return v, True, XSD + ("double" if "e" in v.lower() else "decimal" if "." in v else "integer"), None
        if k == "word" and v != "a":
            take()
            return v, True, XSD + "boolean", None
        return resource(), False, None, None

    def predicates(s: str) -> None:
        while True:
            if peek() == ("word", "a"):
                take()
                p = RDF_TYPE
            else:
                p = resource()
            while True:
                out.append((s, p, *thing()))
                if peek()[1] != ",":
                    break
                take()
            while peek()[1] == ";":
                take()
                if peek()[1] in (".", "]", ";") or peek()[0] == "end":
                    continue
                break
            else:
                return
            if peek()[1] in (".", "]"):
                return

    while peek()[0] != "end":
        k, v = peek()
        if k == "dir":
            take()
            if "prefix" in v.lower():
                p = take("name")
                prefixes[p.rstrip(":")] = iri(take("iri"))
            else:
                base = iri(take("iri"))
            if v.startswith("@"):
                take("mark", ".")
            continue
        square = v == "["
        s = resource()
        if not (square and peek()[1] == "."):
            predicates(s)
        take("mark", ".")
    return out


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples of Turtle files, a task for each file.

    Blank nodes belong to their file: where there are several, a hash of the file's
    address is part of their names.
    """
    from ..plans.session import ship

    ship(spark)
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    several = files.select("file").distinct().limit(2).count() > 1

    def run(batches):
        import pandas as pd

        for b in batches:
            for text, file in zip(b["value"], b["file"], strict=True):
                rows = parse_turtle(text)
                if several:
                    tag = f"_:f{md5(file.encode()).hexdigest()[:10]}."
                    own = lambda x, t=tag: t + x[2:] if x.startswith("_:") else x
                    rows = [(own(s), p, o if lit else own(o), lit, *more) for s, p, o, lit, *more in rows]
                yield pd.DataFrame(rows, columns=["s", "p", "o", "o_is_literal", "o_datatype", "o_lang"])

    return files.mapInPandas(run, TRIPLES)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of the files, in whichever of the two formats their contents are; ValueError if in neither."""
    shape, whole = sniff(spark.read.text(path))
    if shape:
        if not whole:
            raise ValueError(f"{path} has lines that are no N-Triples statements")
        return read_ntriples(spark, path)
    x = read_turtle(spark, path)
    try:
        x.count()
    except Exception as e:
        raise ValueError(f"{path} holds neither N-Triples nor Turtle") from e
    return x


def load(spark: SparkSession, path: str) -> Graph:
    return Graph(read_triples(spark, path))


def _quoted(c: F.Column) -> F.Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def lines(triples: DataFrame) -> DataFrame:
    """One N-Triples statement per row; a language tag goes before a datatype."""
    have = set(triples.columns)
    null = F.lit(None).cast("string")
    lang = F.col("o_lang") if "o_lang" in have else null
    kind = F.col("o_datatype") if "o_datatype" in have else null
    lit = F.col("o_is_literal") if "o_is_literal" in have else F.lit(False)
    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    tail = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(kind.isNotNull(), F.concat(F.lit("^^<"), kind, F.lit(">"))).otherwise(F.lit(""))
    o = F.when(lit, F.concat(_quoted(F.col("o")), tail)).otherwise(node("o"))
    return triples.select(F.concat_ws(" ", node("s"), F.concat(F.lit("<"), "p", F.lit(">")), o, F.lit(".")).alias("value"))


def save(triples: DataFrame, path: str, fmt: str = "turtle", mode: str = "errorifexists") -> None:
    """Write statements as text; N-Triples is Turtle too, so both formats are written line by line."""
    if fmt.lower() not in ("turtle", "ttl", "nt", "n-triples", "ntriples"):
        raise ValueError(f"unknown format: {fmt}")
    lines(triples).write.mode(mode).text(path)
