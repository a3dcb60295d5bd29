"""Documents that every operator must stand, and small helpers."""

LONG = "Und the ligne, número 7 | " * 6000  # about 156,000 characters

EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "É"), (6, "..., !!! 123"), (7, "The cat sat on the mat."),
    (8, "The cat sat on the mat."), (8, "The cat sat on the mat."), (9, LONG), (10, "x" * 30000),
    (11, "a<|endoftext|>b <|startoftext|>"), (12, "ΑΣ ΟΔΟΣ İ ß 中文 👍🏽 é \x1c\u0085 x"), (None, "no id here"), (13, "\n\n\n"),
]
# Names that operators use within, as other columns of the input.
CLASHING = "doc_id long, text string, n long, digest string, spaced string, words string, slot int, block int, ids string"


def edge_documents(spark, rows=EDGE):
    return spark.createDataFrame([(i, t, 1, "d", "s", "w", 2, 3, "q") for i, t in rows], CLASHING)


def no_documents(spark):
    return spark.createDataFrame([], CLASHING)


def by_id(df):
    """Rows as sorted tuples, null first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


def prose(rng, n, vocabulary=400):
    return [f"w{int(x)}" for x in rng.integers(0, vocabulary, n)]
