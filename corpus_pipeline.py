"""A corpus pipeline: documents of known language, one of each group of near copies, without test items, mixed to
target weights, as token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes what a stage returns as Parquet in
the shared folder and gives it to the next one. All stages but the last return the columns of ``documents``. Null and
empty texts end at the first stage, as they have no language. Repeated rows and empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import decontaminate, langid, mixing, queries, simhash, token_store
from rowloom.llm.components import written
from rowloom.llm.text import id_bucket

# Near copies of the pipeline: fingerprints of six windows of 24 words find candidates, which must also agree on five-word
# shingles. At a Jaccard similarity of 0.8 to 0.9 seven windows in ten differ in at most two bits, whether words were
# changed, added or cut off, so nearly all pairs have one. On the shingles 0.8 moves 39 of 256 bits; 50 leaves room for
# chance.
NEAR_BITS = 2
NEAR_TRIES = 6
NEAR_WINDOW = 24
SHINGLES = simhash.Fingerprint(words=5, count=4)
SHINGLE_BITS = 50


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    n, held = queries.LANGUAGE_FOLD
    model = langid.train(docs.filter(id_bucket(F.col("doc_id"), n) != held))
    return langid.keep_known(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    found = simhash.classes(docs.select("doc_id", "text"), words=1, tries=NEAR_TRIES, max_bits=NEAR_BITS,
                            window=NEAR_WINDOW, check=SHINGLES, check_bits=SHINGLE_BITS)
    return simhash.representatives(docs, written(found, "classes"))


def without_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.clean(docs, queries.read(spark, sf_dir, "benchmark"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    plan = mixing.mix_sizes(queries.weighted(sized, queries.read(spark, sf_dir, "labels")), weight="draw_weight")
    return mixing.mixed(docs, plan)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids in binary shards, as read back from them."""
    manifest = token_store.write_tokens(docs.select("doc_id", "text"), queries.vocabulary())
    return token_store.read_tokens(manifest)


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", without_tests),
    ("mixing to target weights", to_weights),
    ("token-ID output", token_ids),
]

# The stages learn models, hash shingles and tokenize, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage works on what the one before it kept."""
    docs = queries.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
