"""Documents with every odd case, and helpers shared by the tests of corpus operators."""

from __future__ import annotations

import re

BASE = " ".join(f"w{i % 37}x{i}" for i in range(90))
ODD = [
    (0, BASE, "en", "a", 1),
    (1, BASE + " more", "en", None, 2),
    (2, BASE, None, "b", 3),
    (3, None, "en", "b", None),
    (4, "", "fr", "b", 0),
    (5, " \n\t ", "fr", "b", 0),
    (6, "one", "de", "c", 3),
    (7, "one two", "de", "c", 7),
    (8, "ONE two", "de", "c", 7),
    (9, "### $$$ %%% &&& ***", "en", "c", 19),
    (10, "same same same\nsame same same\nsame same same", "en", "c", 44),
    (11, "Ünïcödé " * 30 + "日本語 😀", "en", "c", 244),
    (11, "Ünïcödé " * 30 + "日本語 😀", "en", "c", 244),
    (None, "no id here at all", "en", "c", 17),
    (12, "long " * 30000 + "end", "en", "c", 150003),
    (13, "x" * 70000, "en", "c", 70000),
    (14, "<|endoftext|> a b <|endoftext|>", "en", "c", 31),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark, rows=None):
    """The odd documents, with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD if rows is None else rows, SCHEMA)
    return df.withColumns({"id": F.lit(1), "key": F.lit("k"), "label": F.lit(9), "rep": F.lit(None).cast("string"), "score": F.lit(0.1), "kept": F.lit(False)})


def labels(spark):
    rows = [(i, i % 2, 0) for i in range(0, 12)] + [(3, None, None), (5, 7, 0), (None, 1, 0), (1, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(text, lower=False):
    t = text or ""
    if lower:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    return re.findall(r"[^\x20\x09-\x0D]+", t)
