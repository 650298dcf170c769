import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_df(spark, rows, extra=""):
    """A documents table from (doc_id, text) pairs, with an extra column of a clashing name if asked for."""
    full = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F
        df = df.withColumn(extra, F.lit("x"))
    return df
