"""Small documents with every awkward case, shared by the tests of the operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

TEXTS = {
    0: "the quick brown fox jumps over the lazy dog.\nA second line here, with more words than five.",
    1: None,
    2: "",
    3: "   \n\t ",
    4: "word",
    5: "the quick brown fox jumps over the lazy dog.\nA second line here, with more words than five.",
    6: "É déjà vu — naïve café 𝔘𝔫𝔦 👍🏽 end.\r\nx  y   z\n\n\n tail ",
    7: "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 300,
    8: "A second line here, with more words than five.\nthe quick brown fox jumps over the lazy dog.",
    9: "<|endoftext|> special <|startoftext|> strings",
    12: "z" * 5000,
}


def rows():
    out = [(k, t, None if k == 0 else "en", None if k == 4 else "s", None if t is None else len(t)) for k, t in TEXTS.items()]
    return out


def frame(spark, extra: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), SCHEMA)
    if extra:  # columns whose names an operator might use itself
        for name in ("range", "shard", "kind", "n", "h", "ids", "component_id", "score", "words", "label"):
            df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
