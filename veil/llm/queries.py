"""The queries opN_<name>, one for each operator of this subpackage, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The default place of a public tokenizer file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veil.llm.chat import format_chats, formatted, loss_text, read_turns

    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    chats = format_chats(turns).select("conv_id", "n_turns", "valid", formatted().alias("formatted"), loss_text().alias("loss"))
    back = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chats.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(back, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
shown AS (
  SELECT *, replace(replace(replace(text, '\', '\e'), '### ', '\h## '), '</turn>', '\t/turn>') AS body,
    CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
      ELSE '=' || replace(replace(replace(replace(role, '\', '\e'), '### ', '\h## '), '</turn>', '\t/turn>'), ':', '\c') END AS label,
    CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS kind FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length('### ' || label || ': ' || body || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(kind, '' ORDER BY turn, role, text), 's?(ua)*(ua|u)') AS valid
FROM shown GROUP BY conv_id
"""


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veil.llm.topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op5_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veil.llm.resharding import rewritten

    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(32))
    rows = rewritten(table(spark, sf_dir, "documents"), old, 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veil.llm.token_store import read_digests, write_store

    docs = table(spark, sf_dir, "documents")
    return read_digests(spark, write_store(docs, tokenizer_path("byte_bpe_50k.json"), 2), docs)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veil.llm.packing import digests, pack_documents

    return digests(pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 0, 2048))


def op6_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veil.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("body", 256).alias("kept_sha256"))


OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d)),
twice AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
starts AS (SELECT doc_id, i FROM w SEMI JOIN twice USING (s)),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM starts)),
spans AS (SELECT doc_id, min(i) AS low, max(i) + 200 AS high FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS after FROM spans),
cut AS (
  SELECT doc_id, sum(high - low) AS gone, count(*) AS n_spans, max(high) AS last, string_agg(substr(h, CAST(2 * after + 1 AS BIGINT), CAST(2 * (low - after) AS BIGINT)), '' ORDER BY low) AS head
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


def op7_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veil.llm.pieces import decode, encode

    path = tokenizer_path("piece_bpe_32k.model")
    back = decode(encode(table(spark, sf_dir, "documents"), path, seed=7), path)
    return back.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("decoded_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veil.llm.repetition import quality

    return quality(table(spark, sf_dir, "documents")).drop("longest_repeat")


def _windows(n: int) -> str:
    """Words of a text that lie in n-word windows found twice or more in it, by document."""
    return f"""(SELECT doc_id, count(DISTINCT p) AS c FROM (
      SELECT doc_id, unnest(range(i, i + {n})) AS p FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS times FROM (
          SELECT doc_id, i, array_to_string(words[i:i + {n - 1}], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - {n - 2})) AS i FROM w))) WHERE times > 1) GROUP BY doc_id)"""


#: The longest repeat is over 50 words if some 51-word window is found twice.
OP8_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(a.c, 0) AS n_repeat_words, coalesce(b.c, 0) AS covered_words, coalesce(l.c, 0) AS long_words
  FROM w LEFT JOIN {_windows(3)} a USING (doc_id) LEFT JOIN {_windows(6)} b USING (doc_id) LEFT JOIN {_windows(51)} l USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, base_failed, NOT base_failed AND 100 * covered_words <= 40 * n_words AND long_words = 0 AS kept FROM f
"""


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veil.llm.near_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("row")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veil.llm.toxicity import held_out, scored, trained

    docs = table(spark, sf_dir, "documents")
    model = trained(docs, table(spark, sf_dir, "labels"), ~held_out())
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_format, op2_token_store, op3_best_fit_packing, op4_exact_top_k, op5_reshard, op6_repeat_removal, op7_sampled_pieces, op8_quality_rules, op9_near_duplicates, op10_toxicity)}
ORACLE_SQL: dict[str, str] = {"op1_chat_format": OP1_SQL, "op4_exact_top_k": OP4_SQL, "op6_repeat_removal": OP6_SQL, "op8_quality_rules": OP8_SQL, "op9_near_duplicates": OP9_SQL}
