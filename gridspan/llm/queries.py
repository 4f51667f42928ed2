"""The queries of this subpackage: thin digests of what its operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, fill_middle, histogram_sort, imatch, jaccard_join, license_scan, packing, pii, quality_bands, unigram_counts, vector_codes, vector_search


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_documents(spark, sf_dir))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode_documents(_documents(spark, sf_dir))
    decoded = byte_bpe.decode_documents(encoded)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    sharded = histogram_sort.histogram_shards(_documents(spark, sf_dir), 24)
    return sharded.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(_documents(spark, sf_dir))


def op5_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.count_tokens(_documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_documents(spark, sf_dir)).drop("spans")


#: A conversation that says nothing but control strings.
HOSTILE = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    formatted = chat_format.format_conversations(turns.unionByName(extra))
    read = formatted.withColumns({"turns": chat_format.read_turns(F.col("formatted")), "loss": chat_format.loss_text(F.col("segments"))})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op8_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_bands.score_quality(_documents(spark, sf_dir))
    report = F.col("quality_report")
    return scored.select("doc_id", *[report[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks")])


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_documents(spark, sf_dir))
    spans = F.col("pii_spans")
    return found.select(
        "doc_id",
        *[pii.count_of(spans, k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.span_list(spans, pii.BASE), 256).alias("base_sha256"),
        pii.span_list(spans).alias("spans"),
        F.array_max(F.transform(spans, lambda s: s["score"])).alias("top_score"),
    )


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_with_edits(_documents(spark, sf_dir))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(_documents(spark, sf_dir))
    return made.select(
        "doc_id",
        F.col("fim_n").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restore(F.col("fim_output"), F.col("fim_form")), 256).alias("restored_sha256"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    summed = vector_codes.with_label_error(coded)
    return summed.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_hierarchical_packing, op2_byte_bpe, op3_histogram_sort, op4_jaccard_join, op5_unigram_counts, op6_license_scan, op7_chat_format, op8_quality_bands, op9_personal_data, op10_imatch, op11_fill_middle, op12_vector_codes, op13_nearest_neighbours)}

#: Words and sets of shingles, links through the shingles that two documents share, and what links reach.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS sh FROM w
), c AS (
    SELECT md5(array_to_string(list_sort(sh), chr(10))) AS cls, any_value(sh) AS sh, len(any_value(sh)) AS n, min(doc_id) AS least FROM s WHERE len(sh) > 0 GROUP BY 1
), e AS (SELECT cls, n, unnest(sh) AS x FROM c
), p AS (
    SELECT a.cls AS a, b.cls AS b FROM e a JOIN e b ON a.x = b.x AND a.cls <> b.cls AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
    GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r AS (
    SELECT cls AS a, cls AS b FROM c UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), k AS (SELECT r.a AS cls, min(c.least) AS component_id FROM r JOIN c ON c.cls = r.b GROUP BY 1)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN k ON len(s.sh) > 0 AND k.cls = md5(array_to_string(list_sort(s.sh), chr(10)))
"""

#: A conversation's turns in order; a control string inside a text counts one character more.
CHAT_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
    SELECT *, len(regexp_extract_all(text, '[<\[]\\*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|/?s>|/?INST\])')) AS escapes FROM t
), c AS (
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(length('<|im_start|>') + length(role) + 1 + length(text) + escapes + length('<|im_end|>') + 1) AS formatted_chars,
        string_agg(role, ' ' ORDER BY turn, role, text) AS roles
    FROM s GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars,
    regexp_full_match(roles, '(system )?user assistant( (user|tool) assistant)*') AS valid
FROM c
"""

#: Units of a text, and the text cut by their ordinals.
FILL_SQL = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), d AS (
    SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
            WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM t
), p AS (
    SELECT *, array_to_string(u[1:least(c1, c2)], '') AS prefix, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle, array_to_string(u[greatest(c1, c2) + 1:n], '') AS suffix FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""


def _codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS, scale: int = vector_codes.SCALE) -> str:
    """All distances in every round; the nearest entry by (distance, index) in one number."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
    SELECT p.vec_id, p.label, p.part, p.v, min(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * {entries} + c.entry) AS best
    FROM p JOIN c{k} c ON c.part = p.part GROUP BY p.vec_id, p.label, p.part, p.v
)""")
        if k < rounds:
            steps.append(f"""s{k} AS (
    SELECT part, (best % {entries})::BIGINT AS entry, unnest(v) AS x, unnest(range(len(v))) AS pos FROM a{k}
), m{k} AS (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS v FROM (SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM s{k} GROUP BY ALL) GROUP BY part, entry
), c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.entry = c.entry)""")
    return f"""
WITH k AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (SELECT vec_id, label, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS v FROM k, range({parts}) r(part)
), f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < {entries}
), c0 AS MATERIALIZED (SELECT p.part, f.entry, p.v FROM p JOIN f ON f.vec_id = p.vec_id
), {", ".join(steps)}, e AS (
    SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', (best % {entries})::BIGINT), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY vec_id
), l AS (SELECT label, sum(error)::BIGINT AS label_error FROM e GROUP BY label)
SELECT e.vec_id, e.code, e.error, l.label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
FROM e JOIN l ON l.label IS NOT DISTINCT FROM e.label
"""


ORACLES: dict[str, str] = {"op4_jaccard_join": JACCARD_SQL, "op7_chat_format": CHAT_SQL, "op11_fill_middle": FILL_SQL, "op12_vector_codes": _codes_sql()}
