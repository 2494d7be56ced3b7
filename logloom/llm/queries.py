"""The registered queries of this subpackage: (spark, folder of tables) -> DataFrame."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import (
    decontaminate, edits, exact_dedup, filter_audit, line_runs, mixing, near_dedup, nearest,
    part_codes, quality, sentencepiece, token_frames, tool_calls)
from logloom.llm.common import table
from logloom.session import configure

END_ID = 1
#: Weights over training time whose integrals are 3, 1 and 2.
CURRICULUM = [[(0, 4.5), (1, 1.5)], [(0, 1), (1, 1)], [(0, 1), (1, 3)]]
SHARE, MOST = 1.5, 2.0

#: Tool, parameter, type, required.
TOOLS = [("search", "query", "string", True), ("search", "limit", "integer", False),
         ("read", "source", "string", True), ("read", "max_chars", "integer", True),
         ("rate", "score", "number", True), ("rate", "final", "boolean", False)]


def tool_messages(conversations: DataFrame) -> DataFrame:
    """Conversations whose assistant calls tools, about the text, and users answer.

    With faults by turn and conversation: repeated and unknown ids, unknown tools,
    missing, extra and mistyped arguments, references to later calls and circles.
    """
    arguments = """CASE (conv_id + turn + k) % 4
      WHEN 0 THEN to_json(named_struct('query', substring_index(text, ' ', 3), 'limit',
        if(conv_id % 5 = 0, '3', NULL), 'page', if(conv_id % 11 = 0, turn, NULL)))
      WHEN 1 THEN to_json(named_struct('source', '$t' || turn || '-' || (k
        + if(conv_id % 6 = 0, 1, -1)), 'max_chars', if(turn % 5 = 1, NULL, length(text))))
      WHEN 2 THEN if(conv_id % 13 = 0, '[0.5]', '{"score": ' || length(text) || '.5, "final" : '
        || (turn % 4 = 1) || '}')
      ELSE to_json(named_struct('source', '$t' || if(turn > 2, turn - 2, turn) || '-0',
        'max_chars', k)) END"""
    name = """CASE (conv_id + turn + k) % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'read'
      WHEN 2 THEN if(conv_id % 17 = 0, 'erase', 'rate') ELSE 'read' END"""
    made = f"""transform(sequence(0, CAST(turn % 3 AS INT)), k -> named_struct(
      'id', 't' || turn || '-' || if(conv_id % 19 = 0, 0, k), 'name', {name},
      'arguments', {arguments}))"""
    return conversations.selectExpr(
        "conv_id", "turn", "role", "text",
        f"CASE WHEN role = 'assistant' THEN {made} END AS calls",
        "CASE WHEN role = 'user' AND turn > 1 THEN 't' || if(conv_id % 7 = 0, turn, turn - 1) "
        "|| '-0' END AS result_for")


def document_edits(docs: DataFrame) -> DataFrame:
    """Up to five edits per document, at places drawn by its id and length."""
    def drawn(name):
        return F.xxhash64("doc_id", "seq", F.lit(name))

    texts = F.array(*map(F.lit, ["", " edited", "word", " two words ", "\n", ".", "a new line.\n"]))
    return docs.select("doc_id", F.length("text").alias("n"), F.explode(F.sequence(
        F.lit(0), F.pmod(F.xxhash64("doc_id"), F.lit(6)) - 1)).alias("seq")) \
        .where("seq >= 0").select(
            "doc_id", "seq", F.pmod(drawn("at"), F.coalesce("n", F.lit(0)) + 1).alias("at"),
            F.pmod(drawn("removed"), F.lit(60)).alias("removed"),
            texts[F.pmod(drawn("text"), F.lit(7)).cast("int")].alias("inserted"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def schedule(sources: DataFrame) -> DataFrame:
    return mixing.cycled(sources, CURRICULUM)


def op1_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    return line_runs.remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", "removed_lines", "text")


def op2_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    return tool_calls.events(tool_messages(table(spark, folder, "conversations")), TOOLS)


def op3_edited_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return edits.counted(docs, document_edits(docs), tokenizer("word_bpe_49k.json"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.fit(docs, labels)
    return docs.select(
        "doc_id", (quality.part(F.col("doc_id")) == quality.HELD_OUT).alias("held_out"),
        quality.score(F.col("text"), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    # the round trip is told by 128 bits of each text, so that texts go to Python once
    def marks(text):
        text = F.coalesce(text, F.lit(""))
        return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))

    docs = table(spark, folder, "documents").select(
        "doc_id", "text", marks(F.col("text")).alias("marks"))
    pieces = tokenizer("piece_bpe_32k.model")
    coded = sentencepiece.decode(sentencepiece.encode(docs, pieces), pieces)
    return coded.select("doc_id", F.size("ids").alias("n_tokens"), "ids",
                        (F.col("marks") == marks(F.col("text"))).alias("round_trip"))


def op6_token_frames(spark: SparkSession, folder: str) -> DataFrame:
    where = token_frames.fresh_folder(spark)
    index = token_frames.write(table(spark, folder, "documents"), where,
                               tokenizer("word_bpe_49k.json"), END_ID)
    return token_frames.read(index, where).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mixing.plan(docs, schedule, SHARE, MOST).select(
        "doc_id", "size", "source_size", "target", "taken", F.round("position", 6)
        .alias("position"))


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, folder, "documents"))


def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


def op11_part_codes(spark: SparkSession, folder: str) -> DataFrame:
    codes, books = part_codes.encode(table(spark, folder, "embeddings"))
    return part_codes.with_label_errors(codes).select(
        "vec_id", "label", "code", "error", "label_error",
        F.lit(part_codes.digest(books)).alias("codebooks_sha256"))


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, folder, "documents"),
                                       table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def bound(query):
    return lambda spark, folder: query(configure(spark), folder)


QUERIES = {name: bound(query) for name, query in [
    ("op1_line_runs", op1_line_runs),
    ("op2_tool_calls", op2_tool_calls),
    ("op3_edited_counts", op3_edited_counts),
    ("op4_quality", op4_quality),
    ("op5_sentencepiece", op5_sentencepiece),
    ("op6_token_frames", op6_token_frames),
    ("op7_nearest", op7_nearest),
    ("op8_mixing", op8_mixing),
    ("op9_exact_dedup", op9_exact_dedup),
    ("op10_near_dedup", op10_near_dedup),
    ("op11_part_codes", op11_part_codes),
    ("op12_decontamination", op12_decontamination),
    ("op13_filter_audit", op13_filter_audit),
]}
