"""Small documents with the cases that every operator must define."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, shard int"

ODD = [
    (1, "Plain words, and a second sentence.\nA second line of it."),
    (2, None),
    (3, ""),
    (4, "Plain words, and a second sentence.\nA second line of it."),
    (None, "A row without an id"),
    (5, "Ärger über ΣΣ café é 你好 12 345 <|endoftext|> end\x1c\x85!"),
    (6, "x" * 3000 + " " + "long " * 2000),
    (6, "x" * 3000 + " " + "long " * 2000),
    (7, " \n\t "),
]


def odd(spark, rows=None):
    """Documents with null, empty, repeated and long texts, a null id and columns whose names clash with results."""
    return spark.createDataFrame([(i, t, None, None, None, "k", 1, 2) for i, t in (ODD if rows is None else rows)], SCHEMA)
