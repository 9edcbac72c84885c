"""The queries of this subpackage with production parameters, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikiloom.llm.common import crc_fold, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wikiloom.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 4) == 2
    model = train(docs.filter(~held_out), "doc_id", "text", "lang")
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wikiloom.llm.licenses import license_report

    return license_report(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wikiloom.llm.toxicity import toxicity, train

    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 5) == 0
    index = train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity(docs, index).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wikiloom.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def with_tools(turns: DataFrame) -> DataFrame:
    """All turns, those of the assistant with calls and each followed by a tool's message; both derived from the turn's number.

    The table has no calls of its own, so the query couldn't show links, levels and faults on it. Call `a<n>` searches for
    the text's beginning, at times with a limit under the minimum. Call `b<n>` (each fifth `b0`, so that identifiers come
    twice) needs the one two turns before, which may not exist, or (each seventh) itself; each third names an unknown
    tool. Results answer `a<n>` or `b<n>` or nothing that was asked. Texts stay whole, as the messages' content.
    """
    n, said = F.col("turn"), F.coalesce("text", F.lit(""))
    b = F.when(n % 5 == 0, "b0").otherwise(F.concat(F.lit("b"), n))
    need = F.when(n % 7 == 0, b).otherwise(F.concat(F.lit("b"), n - 2))
    search = F.to_json(F.struct(F.left(said, F.lit(20)).alias("query"), (n % 4).alias("limit")))
    compute = F.to_json(F.struct(F.lit("x").alias("expression"), F.struct(need.alias("$ref")).alias("uses")))
    calls = F.array(
        F.struct(F.concat(F.lit("a"), n).alias("id"), F.lit("search").alias("name"), search.alias("arguments")),
        F.struct(b.alias("id"), F.when(n % 3 == 1, "lookup").otherwise("calculate").alias("name"), compute.alias("arguments")),
    )
    helper = F.col("role") == "assistant"
    asked = turns.select("conv_id", "turn", "role", F.when(helper, F.to_json(F.struct(said.alias("content"), calls.alias("tool_calls")))).otherwise(F.col("text")).alias("text"))
    answered = F.when(n % 2 == 0, F.concat(F.lit("a"), n)).when(n % 4 == 3, F.concat(F.lit("b"), n)).otherwise(F.concat(F.lit("z"), n))
    told = F.to_json(F.struct(answered.alias("tool_call_id"), F.concat(F.lit("found "), n).alias("content")))
    return asked.unionByName(turns.filter(helper).select("conv_id", "turn", F.lit("tool").alias("role"), told.alias("text")))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wikiloom.llm.chat import chat_messages

    return chat_messages(with_tools(table(spark, sf_dir, "conversations")))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wikiloom.llm.embeddings import embedding_duplicates

    return embedding_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wikiloom.llm.secrets import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wikiloom.llm.decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wikiloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wikiloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wikiloom.llm.infill import fill_in_middle, restored

    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return cut.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wikiloom.llm.alignment import aligned

    out = aligned(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wikiloom.llm.bpe import encoded

    out = encoded(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_licenses, op3_toxicity, op4_token_counts, op5_chat_format, op6_embedding_dedup, op7_secrets, op8_decontamination, op9_minhash, op10_packing, op11_fill_in_middle, op12_alignment, op13_bpe, pipeline)}


def oracle_sql() -> dict[str, str]:
    from wikiloom.llm.oracles import SQL

    return dict(SQL)
