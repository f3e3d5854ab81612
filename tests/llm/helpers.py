"""Fixture tables with nulls, empty and long texts, ties and repeated rows."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, _h int"

LONG = " ".join(f"w{k % 997}x{k % 89}" for k in range(30_000))
EDGE_TEXTS = [
    None, "", " ", "\n\n", "one", "one two three four", "one two three four five", "one two three four five six",
    "a b c d e a b c d e f g h i j k l m n o p", "line one here\nline one here\nother\n\n\nline one here", "# $ % & | < > * x",
    "non breaking and em　wide spaces  double   triple \ttab\x1cfs \x7fdel", "été \U0001f600 naïve <|endoftext|> tail", LONG, LONG + " end", "x" * 3000, "same text again" * 40, "same text again" * 40,
]


def edge_documents(spark):
    """Edge cases as documents, with extra columns whose names clash with those used inside."""
    rows = [(k, t, "en", "s", None if t is None else len(t), "x", 1) for k, t in enumerate(EDGE_TEXTS)]
    rows += [(None, "null id text with some words in it for good measure ok", None, None, None, None, None), (3, EDGE_TEXTS[7], "en", "s", 1, "x", 1), (3, EDGE_TEXTS[7], "en", "s", 1, "x", 1)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def real_documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
