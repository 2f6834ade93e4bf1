"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from . import decontaminate, exact_dedup, fill_middle, warc
from .alignment import cross_alignment
from .lines import line_dedup
from .pieces import encoded_digests, token_counts
from .shared import table
from .sharding import shards_by_bytes
from .simhash import near_duplicates
from .spotsigs import edited_and_next
from .token_files import token_files_digest
from .toxicity import toxicity



def op9_decontaminate(spark, sf_dir):
    return decontaminate.digest(decontaminate.passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES = {
    "op1_toxicity": lambda spark, sf_dir: toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op2_sharding": lambda spark, sf_dir: shards_by_bytes(table(spark, sf_dir, "documents")),
    "op3_token_files": lambda spark, sf_dir: token_files_digest(table(spark, sf_dir, "documents")),
    "op5_line_dedup": lambda spark, sf_dir: line_dedup(table(spark, sf_dir, "documents")),
    "op6_simhash": lambda spark, sf_dir: near_duplicates(table(spark, sf_dir, "documents")),
    "op7_warc": lambda spark, sf_dir: warc.revisits(table(spark, sf_dir, "pages")),
    "op8_spotsigs": lambda spark, sf_dir: edited_and_next(table(spark, sf_dir, "documents")),
    "op9_decontaminate": op9_decontaminate,
    "op4_sentencepiece": lambda spark, sf_dir: encoded_digests(table(spark, sf_dir, "documents")),
    "op10_token_counts": lambda spark, sf_dir: token_counts(table(spark, sf_dir, "documents")),
    "op11_exact_dedup": lambda spark, sf_dir: exact_dedup.exact_classes(table(spark, sf_dir, "documents")),
    "op13_alignment": lambda spark, sf_dir: cross_alignment(table(spark, sf_dir, "documents")),
    "op12_fill_middle": lambda spark, sf_dir: fill_middle.digests(fill_middle.examples(table(spark, sf_dir, "documents"))),
}

ORACLE_SQL: dict[str, str] = {"op7_warc": warc.SQL, "op9_decontaminate": decontaminate.SQL, "op11_exact_dedup": exact_dedup.SQL, "op12_fill_middle": fill_middle.SQL}
