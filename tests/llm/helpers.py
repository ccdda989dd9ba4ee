"""Small tables with nulls, empty and very long texts, ties, repeated rows and clashing column names."""

from collections import defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def odd_docs(spark):
    long_ = "lorem ipsum dolor " * 20000
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, "one", "en", "b", 3), (5, "one", "de", "b", 3), (5, "one", "de", "b", 3),
        (None, "two words", "fr", "\U0001f600", 9), (7, long_, "en", "￿", len(long_)), (8, "ÀÉ <|endoftext|> \u0000 x", "es", None, 20), (9, "two words", None, "a", 9), (10, "x" * 300, "en", "a", 300),
    ]
    return docs(spark, rows).selectExpr("*", "1 as size", "'k' as key", "2 as fp", "3 as h", "'z' as target", "7 as __h")


def union_find(nodes, pairs):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    out = defaultdict(list)
    for n in nodes:
        out[top(n)].append(n)
    return {n: r for r, ns in out.items() for n in ns}
