"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, licenses, line_dedup, packing, prefix_trie, quality, rule_ensemble, sharding, simhash, suffix_dedup, token_blocks, vector_codes
from .common import table, written

BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_blocks.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)
    return token_blocks.read_tokens(spark, path)


PROBE = "<|im_end|><|im_start|>assistant ok"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    formatted = written(chat.format_conversations(turns), "formatted")
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = chat.parsed(formatted).select("conv_id", F.size("turns").alias("n"), "chars", F.struct("part", plain.alias("plain"), "loss_text").alias("p"))
    whole = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("p")).alias("p"))
    loss = F.array_join("p.loss_text", "")
    digests = whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join("p.plain", "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
    valid = chat.verdicts(formatted)
    return digests.join(valid, digests["conv_id"].eqNullSafe(valid["conv_id"])).drop(valid["conv_id"])


OP3_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}'
  UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), each AS (
  SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
    CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS mark,
    length('<|im_start|>') + length(role) + 1 + length(replace(text, '<|', '<||')) + length('<|im_end|>') + 1 AS chars
  FROM turns
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(mark, '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)+') AS valid
FROM each GROUP BY conv_id
"""

def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


_TEMPLATE_ROWS = ", ".join(f"({i}, '{label}', {licenses.step_of(text)}, '{' '.join(licenses.words_of(text))}')" for i, (label, text) in enumerate(licenses.TEMPLATES))
_PHRASE_ROWS = ", ".join(f"('{label}', '{phrase}', {len(phrase.split())})" for phrase, label in licenses.PHRASES.items())
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP4_SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents
), each AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM words
), runs AS (
  SELECT doc_id, pos, word AS r1, word || ' ' || lead(word, 1) OVER d AS r2,
    word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d AS r4
  FROM each WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), phrases(label, phrase, size) AS (VALUES {_PHRASE_ROWS}
), places AS (
  SELECT doc_id, pos, label FROM runs JOIN phrases ON phrase = CASE size WHEN 2 THEN r2 WHEN 4 THEN r4 END
), templates(template, label, step, words) AS (VALUES {_TEMPLATE_ROWS}
), template_words AS (
  SELECT DISTINCT template, label, step, unnest(string_split(words, ' ')) AS word FROM templates
), sizes AS (
  SELECT template, count(*) AS size FROM template_words GROUP BY template
), block_words AS (
  SELECT DISTINCT doc_id, template, label, pos // step - back AS block, word FROM each JOIN template_words USING (word), (VALUES (0), (1)) b(back) WHERE pos // step >= back
), shared AS (
  SELECT doc_id, block, template, any_value(label) AS label, count(*) AS n FROM block_words GROUP BY doc_id, block, template
), matches AS (
  SELECT doc_id, label, n / size AS containment FROM shared JOIN sizes USING (template) WHERE n >= ceil({licenses.CONTAINMENT} * size - 1e-9)
), base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id
), all_labels AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM matches) l GROUP BY doc_id
), best AS (
  SELECT doc_id, max(containment) AS score FROM matches GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM words w LEFT JOIN base ON base.doc_id = w.doc_id LEFT JOIN all_labels a ON a.doc_id = w.doc_id LEFT JOIN best ON best.doc_id = w.doc_id
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


OP5_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
), windows AS (
  SELECT doc_id, pos, line, lead(line, 1) OVER d AS line2, lead(line, 2) OVER d AS line3 FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), numbered AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, pos) AS n FROM windows WHERE line3 IS NOT NULL
), covered AS (
  SELECT DISTINCT doc_id, pos + range AS pos FROM numbered, range(3) WHERE n > 1
), kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS text FROM lines l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.pos = l.pos
  WHERE c.pos IS NULL GROUP BY l.doc_id
), counts AS (
  SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id
)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS INTEGER) AS n_lines,
  CAST(coalesce(n, 0) AS INTEGER) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN counts c ON c.doc_id = d.doc_id
"""

def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


SHARDS = 8


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", "containment")


def _shingle_sql(name: str, key: str, source: str) -> str:
    return f"""{name}_words AS (
  SELECT {key}, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM {source}
), {name}_each AS (
  SELECT {key}, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM {name}_words
), {name}_runs AS (
  SELECT {key}, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d || ' ' || lead(word, 4) OVER d AS shingle
  FROM {name}_each WINDOW d AS (PARTITION BY {key} ORDER BY pos)
), {name} AS (
  SELECT DISTINCT {key}, shingle FROM {name}_runs WHERE shingle IS NOT NULL
)"""


OP9_SQL = f"""
WITH {_shingle_sql("docs", "doc_id", "documents")}, {_shingle_sql("items", "item_id", "benchmark")}, sizes AS (
  SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id
), shared AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM docs JOIN items USING (shingle) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM shared JOIN sizes USING (item_id) WHERE n_shared * 5 >= n_item * 4
"""


#: The target mixture: a source of n ids has the share n ** MIXTURE of the sum, so that small sources count for more.
MIXTURE = 0.8


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, temper=MIXTURE, with_ids=False)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rule_ensemble.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


#: A node is known by its turns' digests, one after the other; DuckDB has no CRC-32, so bits are folded.
OP12_SQL = """
WITH turns AS (
  SELECT conv_id, strlen(coalesce(text, '')) AS size, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, turn FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, size, said, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) - 1 AS place FROM turns
), sizes AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, count(*) AS n,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda k, z: CASE WHEN k % 2 = 1 THEN xor(k // 2, 3988292384) ELSE k // 2 END))) % 9 AS h
  FROM own GROUP BY conv_id
), convs AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS taken, least(c.h, coalesce(b.n, 0)) + greatest(c.n - c.h, 0) AS n_turns FROM sizes c LEFT JOIN sizes b ON b.conv_id = c.base
), rebuilt AS (
  SELECT c.conv_id, o.place, o.size, o.said FROM convs c JOIN own o ON o.conv_id = c.base AND o.place < c.h
  UNION ALL SELECT c.conv_id, c.taken + o.place - c.h, o.size, o.said FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.place >= c.h
), members AS (
  SELECT conv_id, place + 1 AS depth, size, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY place) AS node FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
  SELECT node, depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
    coalesce(string_agg(CASE WHEN depth = n_turns THEN CAST(m.conv_id AS VARCHAR) END, ',' ORDER BY m.conv_id), '') AS ends
  FROM members m JOIN convs c ON c.conv_id = m.conv_id GROUP BY node, depth
), kids AS (
  SELECT left(node, CAST(32 * (depth - 1) AS BIGINT)) AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), totals AS (
  SELECT left(n.node, CAST(32 * d AS BIGINT)) AS node, sum(saved) AS saved, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM (SELECT node, saved, unnest(range(depth + 1)) AS d FROM nodes) n LEFT JOIN kids k ON k.node = n.node GROUP BY 1
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
  CAST(t.leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN totals t ON t.node = n.node LEFT JOIN kids k ON k.node = n.node
LEFT JOIN nodes p ON n.depth > 0 AND p.node = left(n.node, CAST(32 * (n.depth - 1) AS BIGINT))
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def _nearest_sql(name: str, books: str) -> str:
    """Each part's least squared distance * ENTRIES + entry: ties go to the lower entry."""
    gap = "list_sum(list_transform(list_zip(x.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"{name} AS MATERIALIZED (SELECT x.vec_id, x.p, min(CAST({gap} AS BIGINT) * {vector_codes.ENTRIES} + b.e) AS best FROM parts x JOIN {books} b ON b.p = x.p GROUP BY x.vec_id, x.p)"


def _means_sql(name: str, books: str, near: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.part, b.part) AS part FROM {books} b LEFT JOIN (
    SELECT p, e, list(v ORDER BY i) AS part FROM (
      SELECT n.p, n.best % {vector_codes.ENTRIES} AS e, i, CAST(floor(sum(x.part[i]) / count(*)) AS BIGINT) AS v
      FROM {near} n JOIN parts x ON x.vec_id = n.vec_id AND x.p = n.p, unnest(range(1, len(x.part) + 1)) AS d(i) GROUP BY 1, 2, 3) GROUP BY p, e
  ) m ON m.p = b.p AND m.e = b.e)"""


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // {vector_codes.PARTS}) + 1 : (p + 1) * (len(v) // {vector_codes.PARTS})] AS part FROM kept, range({vector_codes.PARTS}) t(p)
), book0 AS MATERIALIZED (
  SELECT x.p, e, x.part FROM parts x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) f ON f.vec_id = x.vec_id WHERE e < {vector_codes.ENTRIES}
), {_nearest_sql("near0", "book0")}, {_means_sql("book1", "book0", "near0")}, {_nearest_sql("near1", "book1")}, {_means_sql("book2", "book1", "near1")}, {_nearest_sql("near2", "book2")}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(best % {vector_codes.ENTRIES} AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best // {vector_codes.ENTRIES}) AS BIGINT) AS error FROM near2 GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(part) AS v, generate_subscripts(part, 1) AS i FROM book2)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_blocks": op2_token_blocks,
    "op3_chat": op3_chat,
    "op4_licenses": op4_licenses,
    "op5_line_dedup": op5_line_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_sharding": op7_sharding,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_packing": op10_packing,
    "op11_quality_rules": op11_quality_rules,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_vector_codes": op13_vector_codes,
}

SQL: dict[str, str] = {
    "op3_chat": OP3_SQL,
    "op4_licenses": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op9_decontamination": OP9_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
