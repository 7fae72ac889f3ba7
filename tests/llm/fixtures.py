"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

WORDS = [f"word{i}" for i in range(400)]


def prose(start, n):
    return " ".join(WORDS[(start * 7 + i * i + i) % 400] for i in range(n))


COPY = prose(3, 60)
DOCS = [
    (1, "The Cat\nsat on the mat", "en"), (2, "the cat\nsat on the mat", "en"), (3, None, None), (4, "", "en"), (5, COPY, "en"), (6, COPY, "en"),
    (6, COPY, "en"), (7, COPY.replace(COPY.split()[9], "other"), "en"), (8, "Ünïcode äöü ß 你好 🙂 a  b\t\tc\n\n d", "de"), (9, "x" * 3000, "en"),
    (10, prose(11, 3000), "fr"), (None, "no id here", "en"), (None, None, None), (11, "!!! 123 ???", "en"), (12, prose(50, 40) + " " + COPY, "en"),
    (13, COPY + " " + prose(90, 20), "en"), (14, "the CAT\nsat on the mat", "en"),
]
#: doc_id, text, lang and columns that the operators use as names of their own
SCHEMA = "doc_id long, text string, lang string, norm string, hash int, shard string, fp string, key string, row int, root int, id int"


def docs(spark, rows=DOCS):
    return spark.createDataFrame([(*r, "n", 1, "s", "f", "k", 2, 3, 4) for r in rows], SCHEMA).repartition(3)
