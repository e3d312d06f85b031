"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing, SentencePiece; each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import minhash, mixing, pieces, secrets, toxicity
from framelake.llm.common import WRITTEN, cut, drop_since, table

#: Columns that the operators see; all others travel along in one struct, so that their names can't clash with ours.
CORE = ("doc_id", "text", "lang", "source", "n_chars")
REST = "pipeline_rest"
#: Shares of tokens after toxic documents are gone. Mixing only adds repeats here, so clean documents stay: good ones come about
#: two and a half times, since a tenth of the tokens are poor.
TARGETS = {"good": 0.95, "poor": 0.05}


def _packed(docs: DataFrame) -> DataFrame:
    rest = [c for c in docs.columns if c not in CORE]
    core = [docs[c] for c in CORE if c in docs.columns]
    return docs.select(*core, F.struct(*[docs[c] for c in rest]).alias(REST)) if rest else docs.select(*core)


def _unpacked(packed: DataFrame, like: DataFrame) -> DataFrame:
    return packed.select(*[F.col(c) if c in CORE else F.col(f"{REST}.`{c}`").alias(c) for c in like.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go.

    Null and empty texts score as texts without hits and stay; repeated rows stay or go together; whole texts are scored.
    """
    packed = _packed(docs)
    scored = toxicity.score(packed, toxicity.learned(packed, table(spark, sf_dir, "labels"), toxicity.fold() != 0))
    return _unpacked(scored.where("score < 0.5"), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one of the least doc_id.

    Null texts are classes of their own and stay; equal texts, empty ones too, are one class; of repeated rows one stays.
    """
    return _unpacked(minhash.keep_one(_packed(docs)), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values judged live are masked; what many owners share stays.

    All rows stay, null and empty texts as they are, repeated rows alike; n_chars follows the text where it isn't null.
    """
    packed = _packed(docs)
    found = secrets.scan_secrets(packed, F.concat_ws("/", "source", "lang"), F.col("source"), keep_text=True)
    masked = secrets.redact(found)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return _unpacked(masked, docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a domain that falls short of its share come more than once.

    Every row stays once at least; null and empty texts, which have no tokens, follow their posterior; repeated rows alike.
    """
    return _unpacked(mixing.repeated(mixing.mix(_packed(docs), table(spark, sf_dir, "labels"), TARGETS, keep=True)), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, for each row; a null text is encoded as an empty one."""
    return pieces.digests(pieces.tokenize(_packed(docs).select("doc_id", "text"), pieces.model_path()))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_copies), ("secrets", redact_secrets), ("mixing", mix_domains), ("pieces", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each reads what the one before wrote. Tables that no later stage reads are removed as soon as that is so."""
    docs = table(spark, sf_dir, "documents")
    start = len(WRITTEN)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        drop_since(spark, start, docs)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A scored model, banding and piece tables are beyond SQL; tests hold the pipeline against plain versions.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
