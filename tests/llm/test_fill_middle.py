"""Fill-in-the-middle against plain cuts of whole texts."""

import hashlib
import re

import pytest

from gridspan.llm import fill_middle


def plain(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows(df):
    made = fill_middle.fill_in_middle(df)
    made = made.withColumn("restored", fill_middle.restore(made["fim_output"], made["fim_form"]))
    return sorted((tuple(r) for r in made.select("doc_id", "text", "fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output", "restored").collect()), key=repr)


def want(df):
    return sorted(((r["doc_id"], r["text"], *plain(r["doc_id"], r["text"]), r["text"] or "") for r in df.select("doc_id", "text").collect()), key=repr)


def test_table(documents):
    assert rows(documents) == want(documents)


def test_odd_rows(odd_docs, empty_docs):
    assert rows(odd_docs) == want(odd_docs)
    assert fill_middle.fill_in_middle(odd_docs).columns[: len(odd_docs.columns)] == odd_docs.columns
    assert rows(empty_docs) == []


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 63, 64, 65, 96, 1000])
def test_cuts_at_block_edges(spark, n):
    texts = ["ab " * n, "x" * n, " " * n, "𝒳<" * n, "<P" * n + "<S", "a<M>" if n == 1 else "é\n" * n]
    df = spark.createDataFrame([(i * 1000 + k, t) for i in range(9) for k, t in enumerate(texts)] + [(None, None), (None, "null ids draw alike"), (5, "twice"), (5, "twice")], "doc_id long, text string")
    assert rows(df) == want(df)


def test_long_text(spark):
    df = spark.createDataFrame([(i, "word, " * 150_000 + str(i)) for i in range(3)], "doc_id long, text string")
    assert rows(df) == want(df)
