"""A corpus through five operators: quality, language, near-duplicates,
decontamination, encoding.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``: a stage
drops the documents that its operator rejects.  Models are learned from the
documents that the stage gets (the first from the whole table), with the folds
and parameters of the operators' own queries.

Rows with null ids or texts, repeated rows and empty tables pass as the
operators define; ``near_duplicates`` keeps exactly one row of each group.  A
stage hands its operator the columns that it reads and the whole row as one
struct, so columns of any name come out as they went in.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import lang_id, quality
from faultline.llm.bpe import encode_texts
from faultline.llm.common import fold, keep_first, read_table, remove, ship
from faultline.llm.decontaminate import find_benchmark
from faultline.llm.simhash import near_duplicates
from faultline.session import checkpoint_dir


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *names)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = quality.learn(docs, read_table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return quality.classify(_packed(docs, "text"), model).where("predicted = 1").select("row.*")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go."""
    ship(spark)
    prototypes = lang_id.learn(docs.where(fold("doc_id", 3) != 1))
    return lang_id.identify(_packed(docs, "text"), prototypes, out="lang").where(F.col("lang") != lang_id.UNKNOWN).select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_first(_packed(docs, "doc_id", "text"), lambda rows: near_duplicates(rows, shingle=3, max_distance=2, keep=("_key",))).select("row.*")


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    found = find_benchmark(_packed(docs, "text"), read_table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    encoded = encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", keep_quality), ("language", keep_languages), ("near_duplicates", keep_one_of_each),
          ("decontaminate", keep_uncontaminated), ("bpe", encode)]

#: The first stages are trained models and graph components, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  What a stage returns is kept in the shared
    checkpoint folder until the next one has written its own; what the last one
    reads stays, as its result is computed when it is used."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
