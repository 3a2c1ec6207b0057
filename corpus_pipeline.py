"""From raw documents to token digests, a stage at a time.

Every stage takes ``(spark, docs, sf_dir)``, works on all documents that the
stage before has kept and returns a DataFrame; each is written as Parquet and
read again as the next one's documents. All but the last return the columns of
documents as they came.

* quality_rules: documents that the rules or their host's verdict reject go.
* simhash_near_duplicates: of each group of texts that share 0.8 of their
  five-word shingles the one with the smallest doc_id stays.
* suffix_array_dedup: strings of 200 bytes that occur more than once are cut
  out of every text; documents with no word left go.
* source_mixing: every document comes as often as the mix takes it, up to
  twice, not at all if never.
* byte_bpe: each remaining row's tokens: doc_id, n_tokens, ids_sha256,
  decoded_sha256.

An empty table passes through all stages; nulls and repeated rows are treated
as the operators say. A stage deletes what the one before has stored for its own
use, so that one's result has to be written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slatebed.llm.bpe import op1_byte_bpe
from slatebed.llm.common import as_stage, stored, table
from slatebed.llm.mixing import mixed
from slatebed.llm.quality import keep_good
from slatebed.llm.simhash import keep_one_per_component
from slatebed.llm.substrings import cut_repeats

STAGES = [
    ("quality_rules", lambda spark, docs, sf_dir: as_stage(spark, lambda: keep_good(docs))),
    ("simhash_near_duplicates", lambda spark, docs, sf_dir: as_stage(spark, lambda: keep_one_per_component(docs))),
    ("suffix_array_dedup", lambda spark, docs, sf_dir: as_stage(spark, lambda: cut_repeats(docs))),
    ("source_mixing", lambda spark, docs, sf_dir: as_stage(spark, lambda: mixed(docs))),
    ("byte_bpe", lambda spark, docs, sf_dir: as_stage(spark, lambda: op1_byte_bpe(docs))),
]

#: Hashes, components and suffix arrays are beyond SQL; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
