"""Small tables for the edge cases every operator must define."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} und{i % 13}" for i in range(40_000))


def documents(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows, a null id, and extra columns with names the operators use inside."""
    texts = [None, "", "   ", "one", "one", "a b c d e f g h i j k l", "a b c d e f g h i j k l", LONG, LONG + " tail", "x\x00y É ß 漢字 🙂"]
    ids = [0, 1, 2, 3, 3, 5, 6, 7, 8, None]
    df = documents(spark, texts, ids)
    for name in ("fp", "component", "rank", "block", "n", "score", "_key", "piece", "length", "node", "a", "b", "root", "start", "label", "_id", "_hash", "_kinds", "kinds", "_text_hash", "text_hash", "_doc_id", "_row", "_n", "spans"):
        df = df.withColumn(name, F.lit(name))
    return df


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def no_rows(df):
    return df.limit(0)
