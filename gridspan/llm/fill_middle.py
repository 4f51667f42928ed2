"""Fill-in-the-middle by relational units.

A text's units are runs of ASCII letters and single other code points. Units become rows, running sums of their
lengths give each unit's place, cut requests meet units by ordinal, and the places per document cut the text.

Units are exploded on two levels, so that a document costs rows in proportion to its length over BLOCK: first blocks of
BLOCK units, each a row, with running sums over the document; a request meets the block that spans its ordinal and
explodes only that block's units, with running sums inside it. Per document only block lengths and the two requested
blocks are shuffled, by the hash of the row; windows, joins and sums after that exchange move nothing. Texts move once,
to meet their places. Equal rows are counted as one until then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Units, markers, and the percentages of transformed documents and of suffix-first ones among them.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SUFFIX_FIRST = 90, 20
SALT = "1:"
#: Units of one block. Loops are possessive: no text is too long for them.
BLOCK = 32
BLOCK_PATTERN = f"(?:[A-Za-z]++|[^A-Za-z]){{1,{BLOCK}}}+"


def units_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def draws(identity: Column) -> list[Column]:
    """Four numbers below 2**32 that depend on a document's id alone; a null id is an empty string."""
    digits = F.sha2(F.concat(F.lit(SALT), F.coalesce(identity.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _cut_plan(docs: DataFrame, keys: list[str], id_col: str, text: Column) -> DataFrame:
    """A row for each different document: its number of units, form, block lengths, and two requests with their blocks."""
    h1, h2, h3, h4 = draws(F.col(id_col))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    blocks = docs.select(*keys, text.alias("text"), *[h.alias(f"h{i + 1}") for i, h in enumerate((h1, h2, h3, h4))], F.regexp_extract_all(text, F.lit(BLOCK_PATTERN), F.lit(0)).alias("blocks"))
    n = F.when(F.size("blocks") == 0, 0).otherwise((F.size("blocks") - 1) * BLOCK + F.size(units_of(F.element_at("blocks", -1)))).cast("long")
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= RATE)
    counted = blocks.select(*keys, "h1", "h2", "blocks", n.alias("n"), F.when(plain, "plain").when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm").alias("form"))
    cut = lambda h: F.when(F.col("form") == "plain", 0).otherwise(F.col(h) % (F.col("n") + 1))
    cuts = counted.select(*keys, "blocks", "n", "form", F.least(cut("h1"), cut("h2")).alias("low"), F.greatest(cut("h1"), cut("h2")).alias("high"))

    def request(which: int, at: Column) -> Column:
        ordinal = F.floor(at / BLOCK).cast("int")
        return F.struct(F.lit(which).alias("cut"), at.alias("at"), (at % BLOCK).cast("int").alias("rest"), F.coalesce(F.get("blocks", ordinal), F.lit("")).alias("block"))

    # Blocks behind the later cut say nothing; an empty one at the end stands for the place after the last unit.
    upto = F.slice(F.concat(F.transform("blocks", F.length), F.array(F.lit(0))), F.lit(1), F.floor(F.col("high") / BLOCK).cast("int") + 1)
    facts = F.struct("n", "form", upto.alias("lengths"), F.array(request(0, F.col("low")), request(1, F.col("high"))).alias("requests"))
    return cuts.select(*keys, facts.alias("facts")).groupBy(*keys).agg(F.first("facts").alias("facts"))


def cut_offsets(docs: DataFrame, keys: list[str], id_col: str, text: Column) -> DataFrame:
    """keys, n, form, and the code points before the earlier and before the later cut of each different document."""
    plan = _cut_plan(docs, keys, id_col, text)
    before = lambda *by: Window.partitionBy(*keys, *by).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    blocks = plan.select(*keys, F.posexplode("facts.lengths").alias("ordinal", "length"))
    blocks = blocks.select(*keys, (F.col("ordinal") * F.lit(BLOCK).cast("long")).alias("first"), F.coalesce(F.sum("length").over(before()), F.lit(0)).alias("start"))
    requests = plan.select(*keys, "facts.n", "facts.form", F.inline("facts.requests"))
    met = requests.join(blocks, keys).where((F.col("first") <= F.col("at")) & (F.col("at") < F.col("first") + BLOCK))
    units = met.select(*keys, "n", "form", "cut", "rest", "start", F.posexplode(F.slice(F.concat(units_of(F.col("block")), F.array(F.lit(""))), F.lit(1), F.col("rest") + 1)).alias("ordinal", "unit"))
    placed = units.withColumn("inside", F.coalesce(F.sum(F.length("unit")).over(before("cut")), F.lit(0))).where("ordinal = rest")
    at = lambda which: F.max(F.when(F.col("cut") == which, F.col("start") + F.col("inside")))
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), F.max("form").alias("form"), at(0).alias("low"), at(1).alias("high"))


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus fim_n, fim_form, fim_prefix_chars, fim_middle_chars (code points; null if plain) and fim_output.

    The draws follow from the id alone. A null text counts as empty; empty texts and texts that hold a marker stay plain, as
    their own output. Null ids draw alike. Repeated rows get equal results each. A cut may fall anywhere, so prefix, middle and
    suffix may be empty. Very long texts are cut whole. Columns of those names are replaced; all others stay, whatever their
    names. An empty table stays empty.
    """
    out = ["fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output"]
    docs = docs.drop(*out)
    keys = [f"__key{i}_{uuid.uuid4().hex[:8]}" for i in range(2)]
    low, high = (f"__{c}_{uuid.uuid4().hex[:8]}" for c in ("low", "high"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    prints = [F.xxhash64(F.lit(i), F.col(id_col).isNull(), F.col(id_col), text) for i in range(2)]
    keyed = docs.withColumns(dict(zip(keys, prints, strict=True)))
    offsets = cut_offsets(docs.select(*[p.alias(k) for k, p in zip(keys, prints, strict=True)], id_col, text_col), keys, id_col, text)
    facts = offsets.select(*keys, F.col("n").alias("fim_n"), F.col("form").alias("fim_form"), F.col("low").alias(low), F.col("high").alias(high))
    part = lambda start, n: F.substring(text, (start + 1).cast("int"), n.cast("int"))
    prefix, middle = part(F.lit(0), F.col(low)), part(F.col(low), F.col(high) - F.col(low))
    suffix = part(F.col(high), F.length(text) - F.col(high))
    cut = F.col("fim_form") != "plain"
    made = (
        F.when(F.col("fim_form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("fim_form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(text)
    )
    joined = keyed.join(facts, keys, "left")
    return joined.withColumns({"fim_prefix_chars": F.when(cut, F.col(low)).cast("long"), "fim_middle_chars": F.when(cut, F.col(high) - F.col(low)).cast("long"), "fim_output": made}).drop(*keys, low, high)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. Cut texts hold no marker, and no marker overlaps itself or another, so the first of each is the one put there."""

    def after(value: Column, marker: str) -> Column:
        return F.substring(value, F.instr(value, marker) + len(marker), F.length(value))

    def until(value: Column, marker: str) -> Column:
        return F.substring(value, F.lit(1), F.instr(value, marker) - 1)

    first, second = after(output, PREFIX), after(output, SUFFIX)
    psm = F.concat(until(first, SUFFIX), after(second, MIDDLE), until(second, MIDDLE))
    spm = F.concat(until(first, MIDDLE), after(first, MIDDLE), until(second, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
