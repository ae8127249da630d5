"""The ten operators as registered queries, with DuckDB SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import chat_format, jaccard_join, licences, mixing, packing, quality_model, quality_rules, repeats, secrets, vector_search
from tessella.llm.common import bounded_batches
from tessella.sources.tables import table


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents labelled good and not toxic."""
    return table(spark, sf_dir, "labels").where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")


def vocabulary() -> str:
    """Path of the public byte-level BPE file."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, in a session whose Python batches are bounded."""
    bounded_batches(spark)
    return table(spark, sf_dir, "documents")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    out = quality_model.score(docs, quality_model.fit(docs, labels, metadata=["n_chars"]), metadata=["n_chars"])
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = chat_format.read_back(chat_format.format_turns(chat_format.canonical(rows.unionByName(more))))
    return out.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        chat_format.digest(F.col("read_turns")).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(documents(spark, sf_dir))


def op4_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(documents(spark, sf_dir)).drop("removed")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(documents(spark, sf_dir), trusted(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("licences", ",").alias("licences"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "found.n_assign", "found.n_access", "found.n_hex", "found.base_sha256", "found.spans")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def packed(docs: DataFrame) -> DataFrame:
    """Pieces with the digest of their ids."""
    out = packing.pack(docs, vocabulary())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_chat_format": op2_chat_format,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_repeat_removal": op4_repeat_removal,
    "op5_quality_rules": op5_quality_rules,
    "op6_mixing": op6_mixing,
    "op7_license_scan": op7_license_scan,
    "op8_secret_scan": op8_secret_scan,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_packing": op10_packing,
}

_ESCAPED = "regexp_replace({0}, '" + chat_format.ESCAPE_CONSUMING + "', '\\1\\\\\\2', 'g')"
_TURNS = """t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')"""


def _licence_sql() -> str:
    """Every known sentence looked for on its own in each sentence, then the rules as a chain of steps."""
    clean = "trim(regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
    clean = f"' ' || regexp_replace({clean}, '(^| )(not|never) ([^ ]+ )?under ', '\\1\\2 ', 'g') || ' '"
    marked = "regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n\\s*\\n', chr(1), 'g')"
    table = ", ".join(f"{{'i': '{k}', 's': ' {s} '}}" for k, s in licences.SENTENCES.items())
    at = f"list_transform(list_filter([{table}], lambda k: contains(y, k.s)), lambda k: {{'p': strpos(y, k.s), 'i': k.i}})"
    named = f"flatten(list_transform(list_transform(string_split({marked}, chr(1)), lambda x: {clean}), lambda y: list_transform(list_sort({at}), lambda h: h.i)))"
    steps = [f"WITH c AS (SELECT doc_id, {named} AS ids FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))", "s0 AS (SELECT doc_id, len(ids) AS n, '|' || array_to_string(ids, '||') || '|' AS q, []::VARCHAR[] AS l FROM c)"]
    for k, (name, wanted) in enumerate(licences.RULES):
        found = ".*?".join(f"\\|{x}\\|" for x in wanted)
        parts = "(.*?)".join(f"\\|{x}\\|" for x in wanted)
        rest = "".join(f"\\{i}" for i in range(1, len(wanted)))
        steps.append(f"s{k + 1} AS MATERIALIZED (SELECT doc_id, n, CASE WHEN q = '||' THEN q ELSE regexp_replace(q, '{parts}', '{rest}', 'g') END AS q, CASE WHEN q <> '||' AND regexp_matches(q, '{found}') THEN list_append(l, '{name}') ELSE l END AS l FROM s{k})")
    return ",\n".join(steps) + f"\nSELECT doc_id, n::BIGINT AS n_sentences, array_to_string(list_sort(list_distinct(l)), ',') AS licences FROM s{len(licences.RULES)}"


#: SQL cannot say a trained model, 64-bit hashed counts, hashed rounding, connected
#: components, byte strings at every offset within reasonable time, match offsets or a
#: tokenizer; those queries are tested against brute force.
ORACLES: dict[str, str] = {
    "op2_chat_format": f"""WITH {_TURNS} SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + {len(chat_format.TURN + chat_format.BODY + chat_format.END)})::BIGINT AS formatted_chars FROM t GROUP BY 1""",
    "op7_license_scan": _licence_sql(),
    "op9_exact_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) SELECT query_id, n::INT AS rank, vec_id, score FROM r WHERE n <= 5""",
}
