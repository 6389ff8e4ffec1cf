"""Small tables with the cases that every operator must handle."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

LONG = " ".join(f"word{k % 977} of{k % 31}" for k in range(60_000))
TEXTS = [
    "plain words of an ordinary text, nothing else to see here",
    None,
    "",
    "   \n\t \x0b ",
    "Same line\nSame line\nother\n\nSame line\n \n \n",
    "a b c a b c a b c d e f a b",
    "é à ü ñandú été ÉTÉ naïve 　 wide space",
    "<|endoftext|> special <|endoftext|> strings x<|endoftext|>",
    "x" * 3000,
    "SPDX-License-Identifier: MIT OR (GPL-2.0-only WITH Classpath-exception-2.0 AND Apache-2.0)\nall rights reserved. All  Rights-Reserved",
    "licensed cc by and CC-BY, under the General Public License general public license",
    LONG,
    "a b c a b c a b c d e f a b",
    "# $ % & | < > * symbols ## ** |||",
    "x" + " " * 1_000_000 + "y",
    "\n" * 1_000_000,
    "ab" * 500_000,
    "SPDX-License-Identifier: MIT AND (\nSPDX-License-Identifier: CC-BY-NC-4.0",
]


def table(spark, texts=TEXTS, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in zip(ids, texts)], SCHEMA).repartition(3)


def clashing(spark, texts=TEXTS):
    """As table, with further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = table(spark, texts)
    for name in ("id", "key", "row", "y", "n_words", "length", "label", "score", "payload", "digest", "piece", "rep", "word"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def rows(df, *order):
    got = [r.asDict() for r in df.collect()]
    return sorted(got, key=lambda r: tuple((r[c] is not None, r[c]) for c in order)) if order else got
