"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and encoding, each over all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; n_chars is brought up to date where texts change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import bpe, line_dedup, minhash_dedup, mixing, quality_rules
from gneiss.llm import textkit as tk
from gneiss.llm.common import stage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Blocks of the mix: long enough to read on.
BLOCK = 512


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, by models of all runs of all given texts; of rows that share a doc_id, those
    that fail. Null and empty texts fail the base rules. Repeated rows are judged each; columns other than those of documents
    are dropped."""
    return quality_rules.judge(docs, carry=COLUMNS, unit="characters").where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go, of one or two lines where these are long or the whole text; a document that loses
    all its lines goes with them. Null and empty texts have no lines and stay as they are; rows without a doc_id lose only
    what they repeat themselves, and take nothing from others."""
    out = line_dedup.dedup_lines(docs, "lang", "source", "n_chars", least=line_dedup.LEAST)
    changed = F.col("n_removed") > 0
    return out.where("n_removed = 0 or n_removed < n_lines").withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id and then the smallest hash of its
    text. Texts are told apart, not ids: rows that share a doc_id go only where their texts are linked, rows without a
    doc_id or without words never. Of rows that are equal in doc_id and text, the one of the smallest lang, source and
    n_chars stays."""
    docs = docs.select(*COLUMNS)
    keyed = docs.withColumn("near_key", F.xxhash64("text"))
    rows, _ = minhash_dedup.near_duplicates(keyed, "near_key")
    group = rows.where("doc_id is not null and n_shingles > 0").groupBy("group_id", "doc_id", "near_key").agg(F.count("*").alias("times"))
    first = group.groupBy("group_id").agg(F.min(F.struct("doc_id", "near_key", "times")).alias("x")).select("x.*")
    bare = rows.where("doc_id is not null and n_shingles = 0").select("doc_id", "near_key", F.lit(1).cast("long").alias("times")).distinct()
    found = keyed.join(first.unionByName(bare), ["doc_id", "near_key"])
    once = found.where("times = 1").select(*COLUMNS)
    least = found.where("times > 1").groupBy("doc_id", "near_key").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("x")).select("doc_id", "x.*")
    return docs.where("doc_id is null").unionByName(once).unionByName(least.select(*COLUMNS))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document as often as the mix reads it whole, and once more for each list of spans, as they stand in the text."""
    for batch in batches:
        for c in tk.chunks(batch["text"]):
            starts, ends, firsts = tk.words(c)
            rows, texts = [], []
            for i in range(c.hi - c.lo):
                a, row = firsts[i], c.lo + i
                rows += [row] * batch["passes"][row].as_py()
                texts += [batch["text"][row].as_py()] * batch["passes"][row].as_py()
                for spans in batch["parts"][row].as_py():
                    rows.append(row)
                    texts.append("\n".join(c.data[starts[a + s] : ends[a + e - 1]].tobytes().decode() for s, e in spans))
            taken = pa.array(rows, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(taken), pa.array(texts, type=pa.string()), batch["lang"].take(taken), batch["source"].take(taken), pa.array([len(t) for t in texts], type=pa.int64())], names=list(COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each whole reading of a document and one for the blocks read once more. Null and empty texts have
    no words and are not read. Rows that share a doc_id, null among them, are told apart by their texts; what the mix takes
    of rows equal in both is read from one of them."""
    docs = docs.select(*COLUMNS)
    taken = mixing.mix(docs, block=BLOCK).where("taken > 0").groupBy(F.struct("doc_id").alias("of"), "mark").agg(F.sum("passes").alias("passes"), F.collect_list(F.when(F.size("spans") > 0, F.col("spans"))).alias("parts"), F.count("*").alias("copies"))
    marked = docs.withColumns({"of": F.struct("doc_id"), "mark": mixing.mark()})
    once = marked.join(taken.where("copies = 1"), ["of", "mark"])
    more = marked.join(taken.where("copies > 1"), ["of", "mark"]).dropDuplicates(["of", "mark"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "n_chars") + ", n_chars bigint"
    return once.unionByName(more).drop("of", "mark", "copies").mapInArrow(_cut, schema)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids of the mix; null and empty texts have none."""
    return bpe.encode(docs, bpe.vocabulary(), "lang", "source")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_dedup", near), ("mixing", mixed), ("bpe", encoded)]
#: SQL has no Kneser-Ney model, winnowed runs over kept rows, quotients or merges: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
