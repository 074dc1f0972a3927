"""Small tables with what operators must survive: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("fp", T.StringType()),  # names that operators use themselves
        T.StructField("key", T.IntegerType()),
        T.StructField("score", T.StringType()),
        T.StructField("tokens", T.StringType()),
    ]
)
EN = "the cat sat on the mat and the dog ran to the barn with all of its friends in the morning rain "
DE = "der hund und die katze sind mit dem alten mann in das haus gegangen weil es sehr kalt war "


def rows():
    texts = [
        (1, EN * 3, "en", "src1"),
        (2, EN * 3 + "again", "en", "src1"),
        (3, EN * 3, "en", "src10"),
        (4, DE * 3, "de", "src2"),
        (5, None, "en", None),
        (6, "", None, "src2"),
        (7, " \t\n ", "de", "src10"),
        (8, "one two", "en", "src1"),
        (8, "one two", "en", "src1"),  # a repeated row
        (9, "12345 !!! ...", "en", "src3"),
        (10, DE + "x" * 50_000 + " " + EN * 400, "de", "src3"),
        (11, "The Cat  sat\n\n on the mat \n", "en", "src4"),
        (12, "l'été où déjà <|endoftext|> vu 你好 😀 ½ x² \u00a0 \u3000end ", "fr", "src4"),
        (13, DE * 2, "de", "src1"),
        (14, EN * 2, "en", "src2"),
        (None, "no id at all", "en", "src5"),
    ]
    return [(i, t, la, s, len(t or ""), "clash", 7, "clash", "clash") for i, t, la, s in texts]


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)
