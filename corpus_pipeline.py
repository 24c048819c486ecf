"""From documents to packed sequences: five stages, each one operator over all that the last one kept.

Every stage but the last returns the columns of documents. Each is written as Parquet to the shared
folder and read again, so that a lost executor costs no more than the stage that is running.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import decontamination, language, line_dedup, packing, queries, simhash
from cuemill.llm.shared import keep


def _wrapped(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, lang): rows but for their text in one column, so that none of their names meets an operator's own."""
    row = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text"], F.lit(0).alias("unused")).alias("row")
    return docs.select(row, *[docs[c] for c in ("doc_id", "text", "lang") if c in docs.columns])


def _unwrapped(wrapped: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    return wrapped.select(*[(changed[c] if c in changed else F.col("text") if c == "text" else F.col("row")[f"c{k}"]).alias(c) for k, c in enumerate(columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told: those without letters or too close to call go.

    So do null and empty texts; texts of any length are read whole, repeated rows fare alike, ties
    are too close to call. An empty table stays empty, and columns of any name come through.
    """
    work = _wrapped(docs)
    model = language.train(work.where(~language.held_out(F.col("doc_id"))))
    known = language.identify(work, model, keep_cols=["row", "text"]).where((F.col("lang_pred") != language.UNKNOWN) & ~F.col("ambiguous"))
    return _unwrapped(known, docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are 4/5 alike to an earlier one go, and with them documents that have none left; n_chars follows.

    Null and wordless texts stay as they are, texts of any length are read whole. Rows alike in
    doc_id and text are one document and fare alike. Columns of any name come through.
    """
    left = line_dedup.dedup_lines(_wrapped(docs)).where("n_removed = 0 or n_removed < n_lines")
    return _unwrapped(left, docs.columns, n_chars=F.length("text").cast("long"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by fingerprints of shingles of five words.

    Null and wordless texts are one group; the smallest doc_id stays, a null one last, and repeated
    rows once. Texts of any length are read whole, columns of any name come through.
    """
    return simhash.keep_one(docs, shingle=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and wordless texts stay; texts of any length are scanned whole, repeated rows each by
    itself. With an empty benchmark all stay. Columns of any name come through.
    """
    found = decontamination.find_contamination(_wrapped(docs), queries.read(spark, sf_dir, "benchmark"), keep_cols=["row", "text"])
    return _unwrapped(found.where(F.size("spans") == 0), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null or empty text is its end id, every row a document of its own."""
    return packing.pack(docs, queries.tokenizer_path(queries.PACK_VOCABULARY))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", simhash_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Language identification and packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
