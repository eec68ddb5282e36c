"""The corpus pipeline: quality rules, near-duplicate join, repeated passages, decontamination, tokens.

Every stage is written as Parquet and read again as the next one's documents; a stage after the first therefore begins by
removing the tables that the stages before it, of the same run, needed for their results and its documents do not read. A run is known by its thread and
its inputs' folder; tables of other runs and of operators called elsewhere stay. Extra columns, whatever their names, go
through all stages but the last.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import bpe, decontam, jaccard, quality, repeats
from pagemill.llm.runtime import materialize, read_table, recorded, remove, tables_of

_LEFT: dict[tuple[int, str], list[str]] = {}


def stage(first: bool) -> Callable:
    """A stage that records its tables, and drops those of earlier stages of its run."""

    def wrap(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
        @wraps(f)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            key = (threading.get_ident(), sf_dir)
            if first:
                _LEFT[key] = []
            left = _LEFT.setdefault(key, [])
            read = tables_of(docs)
            kept = [p for p in left if p.rsplit("/", 1)[1] in read]
            remove(spark, [p for p in left if p not in kept])
            left[:] = kept
            with recorded(left):
                return f(spark, docs, sf_dir)

        return run_stage

    return wrap


@stage(first=True)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules' posterior keeps; each row has its own verdict, null and empty texts go."""
    return quality.filter_quality(docs)


@stage(first=False)
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the row with the smallest id; rows without an id come last."""
    return jaccard.keep_first(docs, size=5, num=80, den=100)


@stage(first=False)
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that lie in strings of 100 bytes which stand earlier."""
    return repeats.without_repeats(docs)


@stage(first=False)
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the benchmark does not contaminate, rows without an id judged like all others."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


@stage(first=False)
def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, number of tokens, digests of the ids and of the text decoded from them; null counts as empty."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe_round_trip),
]

#: SQL can express neither the join's components nor the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; an empty table gives an empty result."""
    docs, before = read_table(spark, sf_dir, "documents"), []
    for k, (_, step) in enumerate(STAGES):
        made: list[str] = []
        with recorded(made):
            frame = step(spark, docs, sf_dir)
        written: list[str] = []
        with recorded(written):
            docs = materialize(frame, f"stage-{k}")
        remove(spark, made + before)
        before = written
    return docs
