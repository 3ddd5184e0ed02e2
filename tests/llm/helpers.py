"""Small tables with every awkward case, shared by the tests of the training-data operators."""

from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

SF = "/root/testdata/sf0.001"
LONG = ("alpha beta gamma delta " * 20_000) + "end"

#: Names that the operators use inside.
CLASHING = ["id", "sha", "n", "fp", "key", "bin", "kept", "shard", "part", "node", "component", "__n", "__kept", "__id", "label", "y", "lid"]

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()),
                   StructField("n_chars", LongType()), *[StructField(c, StringType()) for c in CLASHING], StructField("size", BooleanType())])


def docs(spark, rows):
    """documents with clashing extra columns from (doc_id, text[, lang])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None, *["x"] * len(CLASHING), None) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def awkward():
    """(doc_id, text): nulls, empty and long texts, ties, repeated rows and ids."""
    return [(1, "The quick brown fox jumps"), (2, "the QUICK brown fox jumps"), (3, None), (4, ""), (5, " \t\n"), (None, "orphan text here"), (None, None),
            (6, LONG), (7, LONG), (8, "one"), (9, "one two"), (9, "one two"), (9, "another text of nine"), (10, "Ünïcode ÀÉ words ñandú"), (11, "one")]


def sort_key(row):
    return tuple((x is not None, x) for x in row)
