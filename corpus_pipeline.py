"""A corpus pipeline of five stages.

Each stage takes all that the one before it kept and returns the columns of
``documents``; the last returns the packed pieces.  :func:`run` writes each
stage's rows as Parquet into the shared folder and reads them again, so a lost
executor costs the running stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm import langid, linededup, mixing, nearjoin, packing, shared


def _aside(docs: DataFrame) -> DataFrame:
    """Id and text, and all other columns in one named ``row``, so that their names meet no operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(True)).alias("row"))


def _back(x: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again; ``n_chars`` counts the text as it is now."""
    out = []
    for f in docs.schema:
        c = F.col(f.name) if f.name in ("doc_id", "text") else F.col("row").getField(f.name)
        out.append((F.length("text").cast(f.dataType) if f.name == "n_chars" else c).alias(f.name))
    return x.select(*out)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are null, have no letter, or are in no language that the network knows go.

    A language is known by its pairs of bytes; the bound lies below its held-out
    texts, or all languages' where it has fewer than 20; with too few of these, or
    to learn from, it rejects nothing.  Where no row states a language there is no
    network, and only the first two go.  Empty texts have no letter; very long ones
    are read whole; rows with equal or null ids are judged each by its text.
    Columns pass through, whatever their names; an empty table gives an empty one.
    """
    net = langid.fit(docs)
    if net is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return _back(langid.identify(_aside(docs), net, known=langid.fit_known(docs)).filter(F.col("_lang") != langid.UNKNOWN), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold go, except from their last holder; texts of which nothing is left go too.

    Null ids are below all others and of rows with equal ids all are the last
    holder together; null and empty texts lose nothing and stay.  Columns pass
    through, whatever their names; an empty table gives an empty one.
    """
    x = linededup.drop_lines(_aside(docs))
    return _back(x.filter((F.col("_n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays, the first by id.

    Null ids are the first; of repeated rows one stays; texts without words (null,
    empty) are one group.  Columns pass through, whatever their names; an empty
    table gives an empty one.
    """
    keyed = nearjoin.keyed(_aside(docs))
    gone, _ = shared.write(nearjoin.near_duplicates(keyed).filter("not kept").select(F.col("rid").alias("_rid")), "pipeline-near")
    # 8 bytes a row up to a million rows; beyond that both sides are shuffled
    gone = F.broadcast(gone) if gone.count() <= 1_000_000 else gone
    return _back(keyed.join(gone, "_rid", "left_anti"), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are used as often as their rates say: not at all, once, or more often.

    The budget is the one that uses clean documents once as a whole; scarcer
    domains are repeated or left short.  A rate's fraction is drawn by the hash of
    the id, so that the domains' totals are the fitted ones but for the draw; rows
    with equal ids are drawn alike, a null id has a hash too.  Null and empty texts
    have no tokens and the prior's rate.  Columns pass through, whatever their
    names; an empty table gives an empty one.
    """
    x = mixing.mix(_aside(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"), whole="clean").filter("_copies > 0")
    return _back(x.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    Null and empty texts are their end id; rows with equal or null ids are packed
    each for itself; very long texts lie in many sequences.  Other columns are
    ignored; an empty table gives no piece.
    """
    return packing.pack(docs).select("sequence_id", F.expr("inline(pieces)"))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", packed),
]

#: Training, MinHash and tokenising are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = shared.write(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
