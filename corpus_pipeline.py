"""The corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm.op1_decontaminate import drop_leaking
from emberlog.llm.op2_quality import keep_good
from emberlog.llm.op4_line_dedup import drop_repeated_lines
from emberlog.llm.op5_packing import pack_documents
from emberlog.llm.op9_jaccard_join import one_of_each
from emberlog.llm.shared import stored, table

#: Each function takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [("quality rules", keep_good), ("line dedup", drop_repeated_lines), ("n-gram jaccard join", one_of_each), ("benchmark decontamination", drop_leaking), ("best-fit packing", pack_documents)]

#: The model, the chosen paths and the tokenizer are beyond SQL; tests compare with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next.

    Null and empty texts have no words and go with the first stage; repeated rows are copies, of which one stays; texts of any length are
    taken whole; an empty table gives no rows. Stages carry all columns of the documents, whatever their names.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
