"""Log lines as rows: patterns to typed columns, for batch and streaming text alike.

A live line is cut at its own separators, from the outside in: the last brackets hold times and rate, what stands before them
the counts and the share; the rest is a narrative of readings ``Name (amount (share))`` and of metrics, either
``Loss (Model(rate) : Metric(weight) : value ...)`` or ``Metric SPLIT : name: value | name: value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.functions.arrays import let, running


def parse(lines: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """A column per field, of the first group of its pattern; null where a line has none."""
    found = {name: F.nullif(F.regexp_extract(column, pattern, 1), F.lit("")).try_cast(kind) for name, (pattern, kind) in fields.items()}
    return lines.withColumns(found)


def read(spark: SparkSession, path: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    return parse(spark.read.text(path), "value", fields)


#: The words of a live line that tell its parts.
STAGES, SCORED, LOSS = ("Training", "Validation", "Prediction"), "Metric", "Loss ("
MEMORY, GPU, CPU = "Memory", "Memory GPU", "CPU"
LABEL_CHARS = 40


def plain(line: Column) -> Column:
    """Without terminal control sequences: parameter bytes, intermediate bytes and a final byte, as ECMA-48 has them."""
    return F.regexp_replace(line, r"\x1B\[[0-?]*[ -/]*[@-~]", "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _before_last(text: Column, mark: str) -> Column:
    """What stands before the last ``mark``; null without one."""
    return F.when(F.contains(text, F.lit(mark)), F.substring(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, mark, -1)) - len(mark)))


def _number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def progress(text: Column) -> Column:
    """struct(narrative, percent, step, total, elapsed, remaining, rate, rate_unit); all but the narrative null where the line has no progress."""

    def cut(text: Column, left: Column, rest: Column) -> Column:
        times = F.split(F.substring_index(F.substring_index(text, "[", -1), "]", 1), ",")
        share = F.substring_index(F.translate(rest, ":", " "), " ", -1)
        counts = F.split(F.substring_index(F.substring_index(left, "%", -1), "|", -1), "/")
        return let(times, lambda times: let(F.split(F.get(times, F.lit(0)), "<"), lambda clock: let(F.trim(F.get(times, F.lit(1))), lambda speed: let(share, lambda share: let(counts, lambda counts: read(text, rest, clock, speed, share, counts))))))

    def read(text: Column, rest: Column, clock: Column, speed: Column, share: Column, counts: Column) -> Column:
        whole = lambda i: F.trim(F.get(counts, F.lit(i))).try_cast("bigint")
        unit = F.ltrim(speed, F.lit("0123456789."))
        found = F.struct(
            _number(share).alias("percent"),
            whole(0).alias("step"),
            whole(1).alias("total"),
            F.trim(F.get(clock, F.lit(0))).alias("elapsed"),
            F.trim(F.get(clock, F.lit(1))).alias("remaining"),
            _number(F.substring(speed, F.lit(1), F.length(speed) - F.length(unit))).alias("rate"),
            F.trim(unit).alias("rate_unit"),
        )

        def checked(found: Column) -> Column:
            sure = (F.size(counts) == 2) & (F.size(clock) == 2) & found["percent"].isNotNull() & found["step"].isNotNull() & found["total"].isNotNull() & found["rate"].isNotNull() & found["rate_unit"].isin("it/s", "s/it")
            return F.when(sure, found)

        def named(found: Column) -> Column:
            narrative = F.when(found.isNull(), text).otherwise(F.substring(rest, F.lit(1), F.length(rest) - F.length(share)))
            return F.struct(narrative.alias("narrative"), *[found[c].alias(c) for c in ("percent", "step", "total", "elapsed", "remaining", "rate", "rate_unit")])

        return let(let(found, checked), named)

    # Each part is bound once: Spark computes a repeated expression again wherever a lambda holds it.
    return let(text, lambda text: let(_before_last(text, "["), lambda left: let(_before_last(left, "%"), lambda rest: cut(text, left, rest))))


def readings(text: Column) -> Column:
    """array of struct(name, amount): what stands before each opening parenthesis, and after it up to the next parenthesis."""

    def cells(pieces: Column) -> Column:
        name = lambda p: F.trim(F.element_at(F.split(p, "[)|:]"), -1))
        return F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p, i: F.struct(name(p).alias("name"), F.trim(F.substring_index(F.get(pieces, i + 1), ")", 1)).alias("amount")))

    return let(F.split(text, r"\("), cells)


def _reading(cells: Column, name: str, nested: int, unit: str) -> Column:
    """The amount of the first reading of a name, or that of the parenthesis ``nested`` further on, without its unit."""
    ends = F.transform(cells, lambda c: F.endswith(F.concat(F.lit(" "), c["name"]), F.lit(f" {name}")))
    amount = lambda at: F.when(at > 0, F.get(cells, at - 1 + nested)["amount"])
    return let(let(F.array_position(ends, F.lit(True)).cast("int"), amount), lambda amount: F.when(F.endswith(amount, F.lit(unit)), _number(F.rtrim(amount, F.lit(unit)))))


def balanced(text: Column, prefix: str) -> Column:
    """What stands between the parenthesis that ends ``prefix`` and the one that closes it; null without either."""

    def of(rest: Column) -> Column:
        # What stands before each closing parenthesis: its opening ones deepen, the closing one leads back; the first that leads below the start is the end.
        def met(a: Column, piece: Column) -> Column:
            depth = a["depth"] + F.length(piece) - F.length(F.translate(piece, "(", "")) - 1
            end = F.coalesce(a["end"], F.when(depth < 0, a["chars"] + F.length(piece)))
            return F.struct(depth.alias("depth"), (a["chars"] + F.length(piece) + 1).alias("chars"), end.alias("end"))

        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("chars"), F.lit(None).cast("int").alias("end"))
        closed = lambda pieces: F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, met)["end"]
        return let(let(F.split(rest, r"\)"), closed), lambda end: F.when(end.isNotNull(), F.substring(rest, F.lit(1), end)))

    return let(text, lambda text: F.when(F.contains(text, F.lit(prefix)), let(F.substring(text, F.instr(text, prefix) + len(prefix), F.length(text)), of)))


def model_metrics(body: Column) -> Column:
    """array of struct(model, lr, metric, weight, value). A name with a number in parentheses is a metric if a number follows, else the model of those behind it."""
    name = lambda w: F.substring_index(w, "(", 1)
    inside = lambda w: _number(F.rtrim(F.substring_index(w, "(", -1), F.lit(")")))
    is_name = lambda w: F.contains(w, F.lit("("))

    def of(words: Column) -> Column:
        value = lambda i: F.when(~is_name(F.get(words, i + 1)), _number(F.get(words, i + 1)))
        model = F.struct(F.lit(None).cast("string").alias("model"), F.lit(None).cast("double").alias("lr"))
        models = F.transform(words, lambda w, i: F.when(is_name(w) & value(i).isNull(), F.struct(name(w).alias("model"), inside(w).alias("lr"))))
        last = running(models, model, lambda a, m: F.coalesce(m, a))
        made = F.zip_with(F.transform(words, lambda w, i: F.struct(w.alias("word"), value(i).alias("value"))), last, lambda w, m: F.struct(m["model"].alias("model"), m["lr"].alias("lr"), name(w["word"]).alias("metric"), inside(w["word"]).alias("weight"), w["value"].alias("value"), is_name(w["word"]).alias("named")))
        return F.transform(F.filter(made, lambda m: m["named"] & m["value"].isNotNull() & m["model"].isNotNull()), lambda m: m.dropFields("named"))

    none = F.array().cast("array<struct<model:string,lr:double,metric:string,weight:double,value:double>>")
    return let(body, lambda body: F.when(body.isNull(), none).otherwise(let(F.filter(_words(body), lambda w: w != ":"), of)))


def scores(narrative: Column) -> Column:
    """array of struct(key, value) of ``name: value`` cells between bars; a name may hold colons itself."""
    cells = F.transform(F.split(narrative, r"\|"), lambda c: F.rtrim(F.trim(c), F.lit(": ")))
    pairs = F.transform(cells, lambda c: F.struct(F.trim(_before_last(c, ":")).alias("key"), _number(F.substring_index(c, ":", -1)).alias("value")))
    return F.filter(pairs, lambda p: (F.length(p["key"]) > 0) & p["value"].isNotNull())


def live(lines: DataFrame, column: str) -> DataFrame:
    """``lines`` plus stage, label, step, total, percent, elapsed, remaining, rate, rate_unit, memory, CPU and GPU readings, lr, and metrics (a map): for batches and streams alike.

    Lines without progress and metrics have nulls and an empty map; a null line has no label either. Metrics are named
    model:metric, in evaluations as logged; of one name the last stays.
    """
    # Columns, not repeated expressions: what several parts need is computed once a line.
    lines = lines.withColumn("__text", plain(F.col(column)))
    text, words, evaluation = F.col("__text"), F.col("__words"), F.col("__scored")
    lines = lines.withColumns({"__head": F.substring_index(text, ":", 1), "__words": _words(F.substring_index(text, ":", 1))})
    lines = lines.withColumn("__scored", F.coalesce((F.try_element_at(words, F.lit(-2)) == SCORED) & F.contains(text, F.lit(":")), F.lit(False)))
    label = F.when(evaluation, F.concat(F.lit(f"{SCORED} "), F.upper(F.element_at(words, -1)))).otherwise(F.substring(F.trim("__head"), 1, LABEL_CHARS))
    stage = F.when(evaluation, "Evaluation").when(F.try_element_at(words, F.lit(-1)).isin(*STAGES), F.element_at(words, -1)).otherwise(label)
    hidden = lines.withColumns({"__progress": progress(text), "__cells": readings(text), "__models": model_metrics(balanced(text, LOSS)), "stage": stage, "label": label})
    said = F.col("__progress.narrative")
    scored = scores(F.substring(said, F.instr(said, ":") + 1, F.length(said)))
    trained = F.transform("__models", lambda m: F.struct(F.concat(m["model"], F.lit(":"), m["metric"]).alias("key"), m["value"].alias("value")))
    hidden = hidden.withColumn("__entries", F.when(evaluation, scored).otherwise(trained))
    entries = F.col("__entries")

    def latest(entries: Column) -> Column:
        return F.map_from_entries(F.filter(entries, lambda e, i: ~F.array_contains(F.transform(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"]), e["key"])))

    cells = F.col("__cells")
    return hidden.withColumns(
        {
            **{c: F.col(f"__progress.{c}") for c in ("percent", "step", "total", "elapsed", "remaining", "rate", "rate_unit")},
            "memory_gb": _reading(cells, MEMORY, 0, "G"),
            "memory_percent": _reading(cells, MEMORY, 1, " %"),
            "memory_gpu_gb": _reading(cells, GPU, 0, "G"),
            "memory_gpu_percent": _reading(cells, GPU, 1, " %"),
            "cpu_percent": _reading(cells, CPU, 0, " %"),
            "lr": F.get("__models", F.lit(0))["lr"],
            "metrics": F.when(entries.isNull(), F.create_map().cast("map<string,double>")).otherwise(let(entries, latest)),
        }
    ).drop("__text", "__head", "__words", "__progress", "__cells", "__models", "__scored", "__entries")
