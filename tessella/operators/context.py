"""Grounded question context: one line per asserted field, fenced, or a fixed refusal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import blank_to_null, number_text

NOTHING = "No asserted field of this document supports an answer."
OPEN, CLOSE = "<<<fields", "fields>>>"


def asserted(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("status") == "found") & (F.col("value_num").isNotNull() | F.col("value_text").isNotNull() | F.col("value_bool").isNotNull()))


def context(rows: DataFrame) -> DataFrame:
    """``document_id, context, n_fields`` over asserted rows; quotes cannot close the fence."""
    value = F.coalesce("value_text", number_text(F.col("value_num")), F.col("value_bool").cast("string"))
    page = F.coalesce(blank_to_null(F.col("printed_page")), F.col("pdf_page").cast("string"), F.lit("unknown"))
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit(CLOSE), F.lit("fields> > >")), F.lit("\n"), F.lit(" "))
    line = F.concat(
        F.col("field_name"), F.lit(": "), safe(value), F.lit(" | layer "), F.coalesce("document_layer", F.lit("unknown")), F.lit(" | page "), page,
        F.lit(" | confidence "), F.format_string("%.2f", F.col("confidence")), F.lit(' | "'), safe(F.col("evidence")), F.lit('"'),
    )
    item = F.struct("field_name", "document_layer", line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n")
    return asserted(rows).groupBy("document_id").agg(F.concat(F.lit(OPEN + "\n"), body, F.lit("\n" + CLOSE)).alias("context"), F.count(F.lit(1)).alias("n_fields"))


def gate(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """Questions (document_id, question) with a prompt, or with the fixed answer
    where nothing is asserted and no model needs to be asked."""
    out = questions.join(context(rows), "document_id", "left")
    ask = F.col("context").isNotNull()
    return out.select("document_id", "question", ask.alias("ask_model"), F.when(ask, F.concat(F.col("context"), F.lit("\n\nQuestion: "), F.col("question"))).alias("prompt"), F.when(~ask, F.lit(NOTHING)).alias("answer"))
