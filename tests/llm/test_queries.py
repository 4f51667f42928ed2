"""Each query against a plain version of its contract, on whole small tables and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridspan.llm import byte_bpe, chat_format, histogram_sort, imatch, license_scan, packing, pii, quality_bands, unigram_counts
from gridspan.llm import queries as q
from gridspan.llm.vocab import byte_bpe as load_bpe
from gridspan.llm.vocab import read_ranks

sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module", params=["table", "odd"])
def docs(request, documents, odd_docs):
    return documents if request.param == "table" else odd_docs


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def lines(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((i, np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in pairs(docs))
    pieces = packing.pack_documents(docs).collect()
    by_sequence, tokens = defaultdict(list), Counter()
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
        assert len(p["ids"]) == 4 * p["length"] > 0
    for members in by_sequence.values():
        at = 0
        for p in sorted(members, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096 and at & (at - 1) == 0, "every sequence is full"
    for (doc_id, ids), n in want.items():
        for start in {p["start"] for p in pieces if p["doc_id"] == doc_id}:
            tokens[doc_id] += sum(1 for p in pieces if p["doc_id"] == doc_id and p["start"] == start and ids[4 * start : 4 * (start + p["length"])] == p["ids"]) > 0
        assert sum(p["length"] for p in pieces if p["doc_id"] == doc_id) == sum(len(i) // 4 * m for (d, i), m in want.items() if d == doc_id), n


def test_packing_special_strings(spark):
    from tokenizers import Tokenizer

    texts = ["a<|endoftext|>b", "<|startoftext|> x", "<|end oftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for spell in (False, True):
        tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        tok.encode_special_tokens = spell
        got = defaultdict(bytes)
        for p in packing.pack_documents(df, spell_special=spell).orderBy("doc_id", "start").collect():
            got[p["doc_id"]] += p["ids"]
        assert got == {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in enumerate(texts)}


def test_memos_are_bounded(monkeypatch):
    from gridspan.llm import vocab

    monkeypatch.setattr(vocab, "MEMO_BYTES", 100_000)
    memo = vocab.WordMemo(public_tokenizers.path("word_bpe_49k.json"))
    want = {w: memo.compute(w) for w in [f"w{i}".encode() for i in range(900)]}
    for w, ids in [*want.items()] * 2:
        assert memo[w] == ids
        assert (len(memo) + len(memo.older)) * memo.entry_bytes <= 100_000
    memo[b"x" * 65]
    assert b"x" * 65 not in memo


def test_only_marks_and_odd_words_take_the_whole_chain(monkeypatch):
    from gridspan.llm import vocab

    memo = vocab.WordMemo(public_tokenizers.path("word_bpe_49k.json"))
    taken, whole = [], memo._whole
    monkeypatch.setattr(memo, "_whole", lambda text: taken.append(text) or whole(text))
    for text in ["Word$$$ word,*** WORD!! Élan&&& don't a_b,", "T\u0308a H\u0331, I\u0307 <|ENDOFTEXT|> a,\u0301 x<|endoftext|>. A.b"]:
        assert memo.encode(text.encode()) == whole(text)
    assert taken[:6] == ["$$$", ",***", "!!", "&&&", "don't", "a_b,"]


def test_packing_rest_and_groups():
    packer = packing.TierPacker((4, 8))
    for i, n in enumerate([8, 7, 5, 3, 3, 2, 1, 20]):
        packer.add(i, b"\1\0\0\0" * n)
    windows = [*packer.full(), *packer.rest()]
    assert all(sum(p[0] for p in pieces) == size for size, pieces in windows)
    assert sum(size for size, _ in windows) == 49
    groups = packing.step_groups(windows, 16)
    used = defaultdict(int)
    for (size, _), (group, _) in zip(windows, groups, strict=True):
        used[group] += size
    assert max(used.values()) <= 16
    with pytest.raises(ValueError):
        packing.pack_documents(None, tiers=(3,))


def test_byte_bpe(docs):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for i, t in pairs(docs):
        ids = enc.encode_ordinary(t)
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), t.encode()))
    encoded = byte_bpe.encode_documents(docs)
    decoded = byte_bpe.decode_documents(encoded)
    assert lines(decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long"), "ids", "decoded")) == sorted(((i, n, bytearray(a), bytearray(b)) for i, n, a, b in want), key=repr)


def test_bpe_offsets_and_pieces(spark):
    text = "é𝒳 日本 naïve  end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = byte_bpe.encode_documents(df, offsets=True).first()
    table = load_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).table
    at = 0
    for i, start, end in zip(np.frombuffer(row["ids"], "<u4"), row["token_start"], row["token_end"], strict=True):
        assert len(text.encode()[:at].decode("utf-8", "ignore")) == start
        at += len(table[i])
        assert end == len(text.encode()[:at].decode("utf-8", "ignore")) + (text.encode()[:at].decode("utf-8", "ignore").encode() != text.encode()[:at])
    out = byte_bpe.decode_documents(byte_bpe.encode_documents(df), pieces=True).first()
    assert "".join(out["pieces"]) == text


def test_bpe_runs_against_tiktoken():
    import random

    import tiktoken

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe, rng = load_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), random.Random(3)
    parts = [t.decode() for t in ranks if all(c < 128 for c in t)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(3000)] + [c * n for c in "-=_*# .\n\taxA0é" for n in range(1, 90)]
    for t in texts:
        assert bpe.encode(t) == np.array(enc.encode_ordinary(t), "<u4").tobytes(), t


def test_histogram_sort(docs):
    rows = histogram_sort.histogram_shards(docs, 24).collect()
    assert Counter((r["doc_id"], r["text"] or "") for r in rows) == Counter(pairs(docs))
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += len((r["text"] or "").encode()) + 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(24))
    biggest = max(len((r["text"] or "").encode()) for r in rows) + 8
    share = sum(sizes.values()) / 24
    assert max(sizes.values()) <= share * 1.001 + biggest
    assert all(sizes[k] >= share * 0.999 - 2 * biggest for k in range(24))


def test_histogram_sort_keeps_order_over_many_partitions(spark, documents):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        few = documents.select("doc_id", "text")
        copies = few.unionByName(few.where("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 10**9)).unionByName(few.where("doc_id < 5").withColumn("doc_id", F.lit(None).cast("long")))
        rows = histogram_sort.histogram_shards(copies, 24).select("shard", "slot", "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("high")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    rows.sort(key=lambda r: (r["shard"], r["slot"]))
    keys = [(r["high"], r["doc_id"] is not None, r["doc_id"]) for r in rows]
    assert keys == sorted(keys), "slots go in the order of keys through all shards"
    starts = [r["text"] for k, r in enumerate(rows) if k == 0 or rows[k - 1]["text"] != r["text"]]
    assert len(starts) == len(set(starts)), "equal texts are consecutive"


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077", "spark.sql.warehouse.dir": "/tmp/own"})

    with pytest.raises(ValueError):
        histogram_sort.shared_path(Session, "x")
    Session.conf["spark.checkpoint.dir"] = "/shared"
    assert histogram_sort.shared_path(Session, "x").startswith("/shared/x-")


def test_histogram_sort_divides_a_group_of_copies(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("own "), F.col("id"))).alias("text"))
    sizes = [r[0] for r in histogram_sort.histogram_shards(df, 24).groupBy("shard").agg(F.sum(F.octet_length("text") + 8)).select(F.col("sum((octet_length(text) + 8))")).collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 2 * 20


def naive_unigram(model, word):
    best, longest = [(0.0, 0)], max(map(len, model.scores))
    for end in range(1, len(word) + 1):
        options = [(best[b][0] + model.scores[word[b:end]], best[b][1] - 1) for b in range(max(0, end - longest), end) if word[b:end] in model.scores]
        n = len(word[end - 1].encode())
        options.append((best[end - 1][0] + n * model.byte, best[end - 1][1] - n))
        best.append(max(options))
    return -best[-1][1]


def test_unigram_counts(docs):
    model = unigram_counts.Unigram(public_tokenizers.path("piece_bpe_32k.model"))
    known = {}
    want = []
    for i, t in pairs(docs):
        words = t.encode().split()
        for w in words:
            if w not in known:
                known[w] = naive_unigram(model, unigram_counts.BLANK + w.decode())
        want.append((i, len(words), sum(known[w] for w in words)))
    assert lines(unigram_counts.count_tokens(docs)) == sorted(want, key=repr)


PHRASES = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}


def test_license_scan(docs):
    want = []
    for i, t in pairs(docs):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        places = [(at, label) for phrase, label in PHRASES.items() for at in range(len(words)) if tuple(words[at : at + len(phrase)]) == phrase]
        starts = [at for at, _ in places]
        want.append((i, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    got = license_scan.scan_licenses(docs)
    assert lines(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == sorted(want, key=repr)
    for r in got.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def naive_spans(words, templates, k=3):
    """Spans by plain search: every diagonal, the band from it on, and its longest alignment by dynamic programming."""
    out = set()
    for t in templates:
        own = t.text.split()
        size, room = len(own), license_scan.room_of(t)
        votes = defaultdict(set)
        for w in range(len(words) - k + 1):
            for at in range(size - k + 1):
                if words[w : w + k] == own[at : at + k]:
                    votes[w - at].add(at)
        full = {d for d, ats in votes.items() if len(ats) == size - k + 1}
        out |= {(t.label, d, d + size - 1, t.base, 1.0) for d in full}
        ranks = {}
        for d in votes if room else ():
            cells = {(e + i, i) for e, ats in votes.items() if d <= e <= d + room for at in ats for i in range(at, at + k)}
            best = {}
            for w, i in sorted(cells):
                best[w, i] = 1 + max((n for (v, j), n in best.items() if v < w and j < i), default=0)
            matched = max(best.values())
            if matched >= size - room:
                ranks[d] = (matched, d in full, -d), min(w for w, _ in cells), max(w for w, _ in cells)
        reach = max(map(license_scan.room_of, templates))
        for d, (rank, first, last) in ranks.items():
            if d not in full and rank == max(r for e, (r, *_) in ranks.items() if abs(e - d) <= reach):
                out.add((t.label, first, last, t.base, rank[0] / size))
    return out


def edited_notices(seed=4, n=120):
    import random

    rng = random.Random(seed)
    every = license_scan.BASE_PHRASES + license_scan.NOTICES
    texts = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(1, 4)):
            own = rng.choice(every).text.split()
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 2)] = [rng.choice(["foo", "the", "license", "any"]) for _ in range(rng.randint(0, 2))] or own[at : at + 1]
            words += own + [rng.choice(["x", "is", "bar"]) for _ in range(rng.randint(0, 3))]
        texts.append(" ".join(words))
    return texts


def test_license_spans_equal_plain_search(spark):
    mit = next(t.text for t in license_scan.NOTICES if t.label == "mit").split()
    filler = [w for i in range(0, len(mit), 3) for w in (*mit[i : i + 3], "foo", "bar", "baz")]
    texts = edited_notices() + [" ".join(filler), " ".join(mit[9:] + mit[:9]), " ".join(mit * 40), " ".join(mit[:4] * 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.scan_licenses(df).collect():
        want = naive_spans(texts[r["doc_id"]].split(), license_scan.BASE_PHRASES + license_scan.NOTICES)
        assert {tuple(s) for s in r["spans"]} == want, texts[r["doc_id"]]
        assert r["labels"] == ",".join(sorted({s[0] for s in want})) and r["score"] == max((s[4] for s in want), default=0)


def test_license_scan_merges_and_verifies(spark):
    mit = next(t.text for t in license_scan.NOTICES if t.label == "mit").split()
    filler = " ".join(w for i in range(0, len(mit), 3) for w in (*mit[i : i + 3], "foo", "bar", "baz"))
    text = "x y permission is hereby granted free of any charge to any person obtaining one copy of this software and associated documentation files z"
    rows = [(1, text, 5), (2, "permission is hereby granted", 5), (3, "this work is licensed under the GNU General Public License, version 3.", 5), (4, filler, 5), (5, " ".join(mit[10:] + mit[:10]), 5), (6, None, 5), (1, text, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word int")
    got = sorted((r["doc_id"], r["labels"]) for r in license_scan.scan_licenses(df).collect())
    assert got == [(1, "mit"), (1, "mit"), (2, ""), (3, "gpl,gpl-3"), (4, ""), (5, ""), (6, "")]


def test_chat_format(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    talks = defaultdict(list)
    for r in rows:
        talks[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    talks[-7] = [(0, "user", q.HOSTILE), (1, "assistant", q.HOSTILE)]
    want = []
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()), len(loss), sha(loss.encode())))
    got = q.op7_chat_format(spark, sf_dir)
    assert lines(got.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == sorted(want, key=repr)
    assert {r["conv_id"]: r["valid"] for r in got.collect()}[-7]


def test_chat_format_order_and_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, None, None), (3, 0, "system", "s"), (3, 1, "user", "<|im_end|>\n&lt;[x]"), (3, 2, "assistant", "&amp;<|im_start|>"), (None, 1, "assistant\nx", "t"), (4, 0, "user", "same"), (4, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.format_conversations(df).withColumn("turns", chat_format.read_turns(F.col("formatted"))).collect()}
    assert [got[c]["valid"] for c in (1, 2, 3, None, 4)] == [False, False, True, False, False]
    assert [got[c]["error_turn"] for c in (1, 2, 3, None, 4)] == [1, 0, None, 0, 1]
    assert [tuple(t) for t in got[3]["turns"]] == [("system", "s"), ("user", "<|im_end|>\n&lt;[x]"), ("assistant", "&amp;<|im_start|>")]
    assert [tuple(t) for t in got[None]["turns"]] == [("assistant\nx", "t")]
    assert [tuple(t) for t in got[2]["turns"]] == [("", "")]
    assert chat_format.format_conversations(df.limit(0)).count() == 0
    assert "&lt;[x]" in got[3]["formatted"] and "<\\|im_end|>\n&lt;" in got[3]["formatted"], "only control strings are escaped"


def test_chat_escapes_are_undone(spark):
    import random

    rng, t = random.Random(2), chat_format.ChatTemplate()
    parts = ["<", "[", "\\", "|im_end|>", "|im_start|>", "/INST]", "INST]", "s>", "/s>", "&", "amp;", "#10;", "\n", "x"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, text string")
    for r in df.withColumns({"e": chat_format.escape(F.col("text"), t), "h": chat_format.escape(F.col("text"), t, header=True)}).withColumns({"back": chat_format.unescape(F.col("e"), t), "hback": chat_format.unescape(F.col("h"), t, header=True)}).collect():
        assert r["back"] == r["hback"] == r["text"]
        assert not any(c in r["e"] or c in r["h"] for c in t.controls) and "\n" not in r["h"]
        assert r["e"] == r["text"] or re.search(r"[<\[]\\*(\||/?INST|/?s>)", r["text"])
    with pytest.raises(ValueError):
        chat_format.escape(F.col("x"), chat_format.ChatTemplate(controls=("<|im_start|>", "<|im_end|>", "<a<b>")))


def test_quality_counts(docs):
    want = []
    for i, t in pairs(docs):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        n = Counter(windows)
        repeated = len({p for k, w in enumerate(windows) if n[w] > 1 for p in (k, k + 1, k + 2)})
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, repeated, len(words) < 50 or 100 * repeated > 50 * len(words)))
    got = quality_bands.score_quality(docs).select("doc_id", *[f"quality_report.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")])
    assert lines(got) == sorted(want, key=repr)


def test_quality_keeps_clean_rejects_junk(spark, sf_dir, documents):
    judged = quality_bands.score_quality(documents).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("not quality_report.base_failed")
    rates = {r["quality"]: r["kept"] for r in judged.groupBy("quality").agg(F.avg(F.col("quality_report.kept").cast("int")).alias("kept")).collect()}
    assert rates[1] == 1.0
    junk = spark.createDataFrame([(1, "BUY NOW!! " * 300), (2, " ".join(hashlib.sha512(bytes([i, j])).hexdigest()[:7] for i in range(9) for j in range(99)))], "doc_id long, text string")
    assert [r["kept"] for r in quality_bands.score_quality(junk).orderBy("doc_id").select("quality_report.kept").collect()] == [False, False]
    kept = quality_bands.keep_good(documents)
    assert kept.columns == documents.columns


def test_quality_verdicts_equal_plain_ones(docs):
    from .test_pipeline import plain_quality

    got = sorted((r["doc_id"], r["kept"]) for r in quality_bands.score_quality(docs.where("doc_id is not null")).select("doc_id", "quality_report.kept").collect())
    assert got == sorted((i, plain_quality(t)) for i, t in pairs(docs) if i is not None)


def test_quality_bands_tell_junk_from_clean(spark):
    # Scale 0.01: none of its texts was used to fit the limits.
    tables = "/root/testdata/sf0.01"
    judged = quality_bands.score_quality(spark.read.parquet(f"{tables}/documents.parquet")).join(spark.read.parquet(f"{tables}/labels.parquet"), "doc_id").where("not quality_report.base_failed")
    rows = [(r["quality"], r["n_bytes"], r["quality_report"]) for r in judged.select("quality", F.octet_length("text").alias("n_bytes"), "quality_report").collect()]
    clean, junk = [r for r in rows if r[0] == 1], [r for r in rows if r[0] == 0]
    assert all(v["kept"] for _, _, v in clean) and len(clean) > 300
    assert sum(v["in_band"] for _, _, v in junk) < len(junk) / 3
    assert not any(v["kept"] for _, n, v in junk if n > 2048)


def test_quality_limits_join_up():
    bands = quality_bands.Bands()
    for n, low, high in bands.whole:
        assert bands.limits(n) == pytest.approx((low, high)) and bands.limits(n + 1) == pytest.approx((low, high), abs=0.01)
    assert bands.limits(0) == bands.limits(1) == bands.whole[0][1:] and bands.limits(10**9) == bands.whole[-1][1:]


def test_quality_chunks_reach_to_the_end(documents):
    import base64
    import random

    import zstandard

    bands, compress = quality_bands.Bands(), zstandard.ZstdCompressor(level=3).compress
    text = next(r["text"] for r in documents.where("lang = 'en' and n_chars > 12000").orderBy("doc_id").collect() if quality_bands.measure(r["text"].encode(), bands, compress)[-1]).encode()
    noise, tail = base64.b64encode(random.Random(1).randbytes(6000)), b"all rights are reserved by us " * 200
    bad = lambda data: quality_bands.measure(data, bands, compress)[6]
    assert bad(text[:8000]) == bad(text[:4500]) == bad(text[:2048]) == 0
    for end in (noise, tail):
        assert bad(text[:4000] + end[:4000]) == 0.5
        assert bad(text[:4096] + end[:3900]) > bands.bad_chunks
        assert bad(text[:2048] + end[:1500]) == 0.5
        assert bad(end[:2048]) == 1 and bad(end[:2047]) == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def naive_pii(t):
    out = {}
    for kind, pattern in PII.items():
        spans = []
        for m in re.finditer(pattern, t):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
        out[kind] = spans
    return out


def test_personal_data(docs):
    want = []
    for i, t in pairs(docs):
        found = naive_pii(t)
        want.append((i, *[len(found[k]) for k in PII], ",".join(s for k in PII for s in found[k])))
    spans = F.col("pii_spans")
    got = pii.find_personal_data(docs).select("doc_id", *[pii.count_of(spans, k) for k in pii.BASE], pii.span_list(spans, pii.BASE))
    assert lines(got) == sorted(want, key=repr)


def test_personal_data_in_long_runs(spark):
    """Runs that no match takes in, a megabyte each, and matches that follow one another at once."""
    import time

    n = 1_000_000
    long = ["x@y.org " + "a" * n, "1.2.3.4 " + "7" * n, "x@y.org " + "a1+" * (n // 3) + "@", "a@" * (n // 2), "1.2." * (n // 4), "+1" + "(" * n, "QUJD" * (n // 4) + "= m@x.de", "4 " * (n // 2) + "a"]
    short = ["a@b.c+x@y.z", "a@b.c.d+e@f.g+h@i", "1.2.3.45.6.7.8", "1.1.1.1.1.1.1.1.1", "999.1.1.1.1.1.1", "1.2.3.4a@b.c5.6.7.8", "..a@b..c@d.e", "a@b@c.d", "12.3.4.5@6.7.8.9", "+@a.b", "é1.2.3.4é%@é.é"]
    texts = short + long
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    began = time.time()
    got = dict(pii.find_personal_data(df).select("doc_id", pii.span_list(F.col("pii_spans"), pii.BASE)).collect())
    assert time.time() - began < 60, "cost is linear in a run"
    plain = lambda t: [s for k in PII for s in naive_pii(t)[k]]
    for i, t in enumerate(short):
        assert got[i] == ",".join(plain(t)), t
    # Plain patterns are quadratic too: they run on shorter texts of the same kind.
    for i, t in enumerate(long[:2]):
        assert got[len(short) + i] == ",".join(s for s in plain(t.replace("a" * n, "a" * 2000).replace("7" * n, "7" * 2000)) if not s.startswith("card"))


def test_personal_data_checks_and_redaction(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00 or DE88 3704 0044 0532 0130 00", "call +1 (389) 555-5010 or a@b.cc, é 4111-1111-1111-1111!", None, "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["pii_spans"] for r in pii.find_personal_data(df).collect()}
    assert [s["kind"] for s in spans[0]] == ["iban"] and texts[0][spans[0][0]["start"] : spans[0][0]["end"]] == "DE89 3704 0044 0532 0130 00"
    assert all(0 < s["score"] <= 1.3 for v in spans.values() for s in v)
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert red[1] == "call <PHONE> or <EMAIL>, é <CARD>!" and red[2] is None and red[3] == "nothing"
    assert red[0] == "iban <IBAN> or DE88 3704 0044 0532 0130 00"


def test_personal_data_in_texts_of_very_many_spans(spark):
    import random
    import time

    rng = random.Random(9)
    parts = ["u{}@ex.com", "10.0.{}.7", "+49 30 12345{}", "4111 1111 1111 1111", "é", "😀 mail", "word{}", "a.b@c.de.f", "1.2.3.{}"]
    texts = ["".join(rng.choice(parts).format(rng.randrange(300)) + rng.choice([" ", "  ", "\n"]) for _ in range(n)) for n in (3, 255, 256, 257, 513, 6000)]
    df = spark.createDataFrame([*enumerate(texts), (99, " ".join(f"u{i}@x.yz" for i in range(50_000)))], "doc_id long, text string").withColumns({"__pii_spans": F.lit(1), "pii_spans": F.lit("x")})
    began = time.time()
    spans = {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["score"]) for s in r["pii_spans"]] for r in pii.find_personal_data(df).collect()}
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert time.time() - began < 60 and len(spans[99]) == 50_000 and red[99] == " ".join(["<EMAIL>"] * 50_000)
    context = {k.name: k for k in pii.KINDS}
    for i, t in enumerate(texts):
        assert [f"{k}:{a}:{b}" for k, a, b, _ in spans[i] if k != "iban"] == [s for found in naive_pii(t).values() for s in found]
        for kind, a, b, score in spans[i][:: max(1, len(spans[i]) // 50)]:
            near = (t[max(0, a - pii.NEAR) : a] + " " + t[b : b + pii.NEAR]).lower()
            k = context[kind]
            assert score == pytest.approx(k.base_score + (pii.CHECKED if kind in ("card", "iban") else 0) + (pii.CONTEXT if re.search(k.context, near) else 0))
    from .test_pipeline import plain_redact

    assert {i: red[i] for i in range(len(texts))} == {i: plain_redact(t) for i, t in enumerate(texts)}
    assert pii.redact(df).columns == df.columns


def test_personal_data_accounts_before_upper_case_words(spark):
    numbers = ["ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "SE45 5000 0000 0583 9825 7466", "PL61109010140000071219812874", "NO93 8601 1117 947", "DE89 3704 0044 0532 0130 00", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
    ends = ["", " BIC", " EUR 250", " BIC BBRUBEBB", " 1234 ABCD", ", paid", " BE68 5390 0754 7034"]
    rows = [(k, n + e, n, e) for k, (n, e) in enumerate((n, e) for n in numbers for e in ends)] + [(-1, "BE69 5390 0754 7034 EUR", "", ""), (-2, "ZZ59 1234 5678 9012 3456", "ZZ59 1234 5678 9012 3456", "")]
    red = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for k, text, number, end in rows:
        assert red[k] == (text if k == -1 else "<IBAN>" + end.replace("BE68 5390 0754 7034", "<IBAN>")), text


def plain_prints(texts):
    """Fingerprints by plain counting, and their likeness."""
    import xxhash

    edges = ".,;:!?()[]{}|\"'"
    words_of = lambda t: {w for w in (c.strip(edges.encode()).lower() for c in t.encode().split()) if w}
    sets = [words_of(t) for t in texts]
    counts = Counter(w for s in sets for w in s)
    term = lambda w: xxhash.xxh64_intdigest(w, imatch.SEED) - (1 << 63)
    lexicon = {term(w) for w, n in counts.items() if imatch.LEAST * len(texts) <= n <= imatch.MOST * len(texts)}
    sizes = max(1, len(lexicon).bit_length())

    def holds(x, k):
        full = (1 << 64) - 1
        z = (x + (imatch.SEED + k) * 0x9E3779B97F4A7C15) & full
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & full
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & full
        return (z >> 32) % (2 ** (1 + k // imatch.COPIES)) == 0

    def fingerprint(t):
        own = sorted({term(w) for w in words_of(t)})
        known = [x for x in own if x in lexicon]
        out = []
        for k in range(imatch.COPIES * sizes):
            chosen = [x for x in known if holds(x, k)] if known else own if k < imatch.COPIES else []
            out.append(hashlib.blake2b(b"".join(x.to_bytes(8, "little", signed=True) for x in chosen), digest_size=4).hexdigest() if chosen else "00000000")
        return out

    def likeness(a, b):
        if a == b:
            return 1.0
        none, step = "00000000", imatch.COPIES
        used = [x != none or y != none for x, y in zip(a, b, strict=True)]
        sparse = max([k for k in range(0, len(a), step) if 2 * sum(used[k : k + step]) >= step], default=0)
        seen = [k for k in range(max(0, sparse - imatch.DENSER * step), len(a)) if used[k]]
        return sum(a[k] == b[k] for k in seen) / len(seen) if seen else 0.0

    return fingerprint, likeness


def test_imatch(spark, docs):
    high = {r["text"]: r["high"] for r in docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("high")).collect()}
    rows = sorted(pairs(docs), key=lambda x: (x[0] is not None, x[0], high[x[1]]))
    fingerprint, likeness = plain_prints([t for _, t in rows])
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in imatch.compare_with_edits(docs).collect()}
    own = {t: fingerprint(t) for t in dict(rows).values()} | {t: fingerprint(t) for _, t in rows}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        r = got[(i, len(t), sha(edited.encode()))]
        assert r["fingerprint"] == "".join(own[t]) and r["edited_fingerprint"] == "".join(fingerprint(edited))
        assert (r["near_edited"], r["near_next"]) == (likeness(own[t], fingerprint(edited)), likeness(own[t], own[after]))


def test_imatch_tells_edits_from_neighbours(documents):
    r = imatch.compare_with_edits(documents).where("n_chars > 400").agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert r[0] > 5 * r[1]


def test_imatch_terms_are_sorted_arrays_counted_without_a_dictionary(spark):
    import xxhash

    term = lambda w: xxhash.xxh64_intdigest(w, imatch.SEED) - (1 << 63)
    got = imatch._memo.terms(b"(One) two, ONE\x0b... two\x1cthree \xc3\x89. !")
    assert got.dtype == np.int64 and got.tolist() == sorted(map(term, (b"one", b"two", b"two\x1cthree", b"\xc3\x89")))
    docs = spark.createDataFrame([("a b a",), ("B, c",), (None,), ("",)], "text string")
    assert {r["term"]: r["n"] for r in imatch.term_frequencies(docs).collect()} == {term(b"a"): 1, term(b"b"): 2, term(b"c"): 1}


def test_imatch_finds_near_copies_of_any_length():
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40_000)]
    of = imatch.Fingerprinter(np.sort(np.array(list(imatch._memo.terms(" ".join(vocabulary).encode())))))
    for n in (60, 400, 3000, 9000):
        near, far = [], []
        for _ in range(20):
            text, other = (" ".join(rng.choices(vocabulary, k=n)) for _ in range(2))
            near.append(imatch.likeness(of(text.encode()), of(imatch.edited_text(text, other).encode())))
            far.append(imatch.likeness(of(text.encode()), of(other.encode())))
        assert near.count(0) <= 1 and sum(near) > 0.25 * 20 and sum(near) > 4 * sum(far), n


def test_imatch_near_edited_by_length(spark):
    length = F.when(F.col("n_chars") < 2000, 0).when(F.col("n_chars") < 8000, 1).otherwise(2).alias("class")
    rows = imatch.compare_with_edits(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("n_chars >= 400").groupBy(length).agg(F.avg("near_edited").alias("near"), F.avg((F.col("near_edited") == 0).cast("int")).alias("lost"), F.avg("near_next").alias("next"))
    classes = {r["class"]: r for r in rows.collect()}
    assert len(classes) == 3
    for r in classes.values():
        assert r["near"] > 0.25 and r["lost"] < 0.06 and r["near"] > 5 * r["next"]


def test_empty_tables(empty_docs):
    assert packing.pack_documents(empty_docs).count() == 0
    assert byte_bpe.decode_documents(byte_bpe.encode_documents(empty_docs)).count() == 0
    assert histogram_sort.histogram_shards(empty_docs, 24).count() == 0
    assert unigram_counts.count_tokens(empty_docs).count() == 0
    assert license_scan.scan_licenses(empty_docs).count() == 0
    assert quality_bands.score_quality(empty_docs).count() == 0
    assert pii.redact(empty_docs).count() == 0
    assert imatch.compare_with_edits(empty_docs).count() == 0
