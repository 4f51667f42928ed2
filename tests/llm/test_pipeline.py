"""The pipeline's stages, chained by its own run, against plain versions."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers

import corpus_pipeline
from gridspan.llm.quality_bands import Bands

from .test_jaccard_join import naive
from .test_queries import naive_pii


def plain_quality(text):
    import zstandard

    bands, data = Bands(), text.encode()
    ratio = lambda part: len(part) / len(zstandard.ZstdCompressor(level=bands.level).compress(part))
    words = data.split()
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {p for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    if len(words) < bands.least_words or 100 * len(repeated) > bands.most_repeated * len(words):
        return False
    size = bands.chunk_bytes
    chunks = [data[i : i + size] for i in range(0, len(data) - size + 1, size)]
    if chunks and len(data) % size:
        chunks.append(data[-size:])
    bad = [not bands.chunk[0] <= ratio(c) <= bands.chunk[1] for c in chunks]
    low, high = bands.limits(len(data))
    return low <= ratio(data) <= high and sum(bad) <= bands.bad_chunks * len(bad)


def plain_redact(text):
    spans = [(int(a), int(b), kind) for kind, found in naive_pii(text).items() for _, a, b in (s.split(":") for s in found)]
    for m in re.finditer(r"\bDE[0-9]{2}(?: ?[0-9]{4}){4} ?[0-9]{2}\b", text):
        plain = m[0].replace(" ", "")
        if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            spans.append((*m.span(), "iban"))
    joined = []
    for start, end, kind in sorted(spans):
        if joined and start < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end, kind])
    for start, end, kind in reversed(joined):
        text = f"{text[:start]}<{kind.upper()}>{text[end:]}"
    return text


def test_stages(spark, documents, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    some = [tuple(r) for r in documents.select(corpus_pipeline.COLUMNS).where("doc_id is not null").orderBy("doc_id").limit(120).collect()]
    good = [r for r in some if plain_quality(r[1])]
    private = " a.b@c.de 10.0.0.1 card 4111 1111 1111 1111 tel +49 (30) 1234-5678 iban DE89 3704 0044 0532 0130 00 EUR 5"
    longest = max(r[0] for r in some)
    more = [(longest + 1 + k, t) for k, t in enumerate([good[0][1], good[1][1] + private, good[2][1] + " end", good[3][1].upper(), "x " * 300, "", None])]
    docs = some + [(i, t, "en", "own", len(t or "")) for i, t in more]
    spark.createDataFrame(docs, documents.select(corpus_pipeline.COLUMNS).schema).write.parquet(str(tmp_path / "documents.parquet"))

    seen, write = {}, corpus_pipeline.written
    monkeypatch.setattr(corpus_pipeline, "written", lambda df, name: seen.setdefault(name, write(df, name)))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert list(seen) == ["pipeline-quality", "pipeline-near_duplicates", "pipeline-personal_data"]
    assert all(df.columns == corpus_pipeline.COLUMNS for df in seen.values())
    got = [sorted(tuple(r) for r in df.collect()) for df in seen.values()]

    want = sorted(r for r in docs if plain_quality(r[1] or ""))
    assert got[0] == want and len(good) < len(want) < len(docs)
    first = {i for i, _, component in naive([r[:2] for r in want]) if i == component}
    before, want = want, [r for r in want if r[0] in first]
    assert got[1] == want and len(want) < len(before)
    before, want = want, [(i, t := plain_redact(text), lang, source, len(t)) for i, text, lang, source, _ in want]
    assert got[2] == want and want != before

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    ids = {r[0]: np.array([*tok.encode(r[1], add_special_tokens=False).ids, 2], "<u4") for r in want}
    covered, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p["ids_crc32"] == zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes())
        covered[p["doc_id"]] += range(p["start"], p["start"] + p["length"])
        sequences[p["sequence_id"]] += range(p["offset"], p["offset"] + p["length"])
    assert {i: sorted(c) for i, c in covered.items()} == {i: list(range(len(x))) for i, x in ids.items()}
    assert all(sorted(s) == list(range(len(s))) and len(s) <= 4096 for s in sequences.values())


def test_run_on_odd_tables(spark, documents, tmp_path):
    """An empty table, null and repeated ids, null texts and columns of clashing names go through whole."""
    good = [r["text"] for r in documents.where("doc_id is not null").orderBy("doc_id").select("text").limit(60).collect() if r["text"] and plain_quality(r["text"])][:4]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string, start int, quality_report int"
    odd = [(None, good[0]), (None, good[0]), (None, good[1]), (7, good[2]), (7, good[2]), (7, good[3]), (8, None), (None, None), (9, "")]
    for name, rows in (("empty", []), ("odd", odd)):
        folder = tmp_path / name
        folder.mkdir()
        spark.createDataFrame([(i, t, None, None, None, "c", 1, 2) for i, t in rows], schema).write.parquet(str(folder / "documents.parquet"))
        pieces = corpus_pipeline.run(spark, str(folder)).collect()
        assert sum(p["start"] == 0 for p in pieces) == (4 if rows else 0)
        # One row of each group of copies stays; its id may be null or that of another text.
        assert sorted((p["doc_id"] for p in pieces if p["start"] == 0), key=repr) == ([7, 7, None, None] if rows else [])
