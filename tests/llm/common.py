"""Documents with everything odd in them."""

DOC_TYPE = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use themselves.
CLASHES = ("keep", "bitmap", "sig", "copies", "bin_id", "line_hash", "quality_keep", "mix_key", "near_copy_id", "h", "key")

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [
    (1, "one two three four five\nsame line here now\n\nlast", "en", "a", 10),
    (2, "same line here now\nother line of two", "en", "a", 10),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", "en", "b", 3),
    (6, LONG, "en", "b", len(LONG)),
    (7, "un deux trois quatre cinq six", None, "b", 29),
    (7, "un deux trois quatre cinq six", None, "b", 29),
    (None, "no id at all here", "en", None, 17),
    (9, "wörter ünd zeichen ß ⊕ 深層学習", "de", "c", 30),
]


def odd(spark, clashes=True):
    df = spark.createDataFrame(ODD, DOC_TYPE)
    if clashes:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("extra") for c in CLASHES})
    return df


def empty(spark):
    return spark.createDataFrame([], DOC_TYPE)


def typed(row):
    return tuple(row)
