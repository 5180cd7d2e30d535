"""A corpus pipeline of five stages over `documents`, each written to the shared folder and read again.

quality classifier (rejected documents go), word n-gram Jaccard join (one document of each group
stays), personal data (replaced in the texts), mixing to target weights (documents are drawn for whole
or partial epochs), byte-level BPE (ids of each drawn text, and whether they spell it again).

Defined cases: the first four stages keep the columns of their input, whatever their names and however
many, and need only doc_id, text, lang and source. Null and empty texts: scored like any text, linked
with nothing, without personal data, 0 words for mixing (so drawn with their leaf's whole epochs), no
ids; lossless compares a null text as an empty one. Very long texts are taken whole by every stage.
Repeated rows: equal scores; one of the rows with equal id and text stays in the join; where a document
is drawn for several epochs its row is repeated. Ties: the smallest id of a group stays; equal places in
the mixing order go by id. Rows with a null id are kept by the join, as they link with nothing. An empty
table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trafficloom.llm import bpe, mixing, pii_anchors, quality_cnn, setjoin
from trafficloom.llm.common import materialise, read_table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_cnn.keep_good(docs, read_table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setjoin.keep_one(docs, setjoin.Likeness(words=5, num=80, den=100))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_anchors.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep_mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_checked(docs.select("doc_id", "lang", "source", "text")).drop("text")


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", deduplicate),
    ("PII", redact),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokenize),
]

ORACLE_SQL = None  # no stage of these can be expressed in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return docs
