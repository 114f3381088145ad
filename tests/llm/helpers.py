"""Documents that are awkward in every way, for all operators."""

AWKWARD = [
    (1, "Alpha beta gamma. Delta epsilon zeta.\nEta theta iota kappa.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \n\t ", "de"),
    (5, "Alpha beta gamma. Delta epsilon zeta.\nEta theta iota kappa.", "en"),
    (5, "Alpha beta gamma. Delta epsilon zeta.\nEta theta iota kappa.", "en"),
    (5, "a different text with the same id", "fr"),
    (None, "no id here, but a mail: jane.doe@example.com and +1 (212) 555-0199", "en"),
    (None, None, None),
    (7, "été à l'école <|endoftext|> \x1f tab\there 日本語 😀  double  spaces \xa0 nbsp", "fr"),
    (8, "word " * 60_000, "en"),
    (9, "12345 !!! ???", None),
    (10, "x" * 5000, "en"),
]
SCHEMA = "doc_id bigint, text string, lang string"


def frame(spark, rows=None, extra=True):
    """The documents with the columns of the table, and some whose names clash with what operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD if rows is None else rows, SCHEMA)
    df = df.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
    clashing = ("fp", "row", "ids", "key", "n", "count", "bucket", "digest", "rank", "copy")
    return df.withColumns({c: F.lit("clash") for c in clashing}) if extra else df
