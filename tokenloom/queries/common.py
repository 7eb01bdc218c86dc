"""Shared parts of the registered queries: output shaping and SQL building blocks.

The SQL sides say the same in other words: one global window where Spark works in two levels, one row
per token where Spark works on pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 256
BATCH = 4
SEED = 42
VOCAB = 120000


def digest(ids: str | Column) -> Column:
    """Order-sensitive digest of an array; both engines form the same text."""
    return F.md5(F.concat_ws(",", F.transform(ids, lambda x: x.cast("string"))))


def widen(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint."""
    return df.select(*[F.col(n).cast("bigint") if t == "int" else F.col(n) for n, t in df.dtypes])


def sql_digest(ids: str) -> str:
    return f"md5(coalesce(array_to_string({ids}, ','), ''))"


PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"

CRC = """
crc_bits(i, k, v) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS tab FROM crc_bits WHERE k = 8)
"""


def sql_tokens(name: str, source: str, key: str, text: str) -> str:
    """`name(key, pos, token)`: one row per token."""
    return f"""
{name} AS (
  SELECT {key}, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos
  FROM (SELECT {key}, regexp_extract_all({text}, '{PATTERN}') AS toks FROM {source}))
"""


def sql_encode(name: str, source: str, key: str, text: str) -> str:
    """`name(key, ids)`: CRC-32 token ids per row, an empty list where there is no token."""
    return (
        sql_tokens(f"{name}_tok", source, key, text)
        + f""",
{name}_types AS (SELECT DISTINCT token FROM {name}_tok),
{name}_code AS (
  SELECT token, 1 + xor(list_reduce(
      list_transform(range(1, strlen(token) + 1),
        lambda i: ('0x' || substr(hex(encode(token)), (2 * i - 1)::BIGINT, 2))::BIGINT),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {VOCAB} AS tid
  FROM {name}_types, crc_table),
{name}_some AS (
  SELECT {key}, list(tid ORDER BY pos) AS ids FROM {name}_tok JOIN {name}_code USING (token) GROUP BY {key}),
{name} AS (
  SELECT s.{key}, coalesce(e.ids, []::BIGINT[]) AS ids FROM {source} s LEFT JOIN {name}_some e USING ({key}))
"""
    )


F1 = """
f1 AS (
  SELECT id, instruction, input, output FROM (
    SELECT conv_id * 100 + turn AS id, role,
      lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS instruction,
      max(CASE WHEN role = 'system' THEN text END) OVER (PARTITION BY conv_id) AS input,
      text AS output
    FROM conversations) WHERE role = 'assistant')
"""

F1_TEXT = """
f1_text AS (
  SELECT id, coalesce(instruction, '') || coalesce(input, '') || coalesce(output, '') AS body,
    coalesce(instruction, '') || coalesce(input, '') AS prompt
  FROM f1)
"""

F2 = """
f2 AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS instruction,
    substr(text, length(split_part(text, chr(10), 1)) + 2) AS output,
    split_part(text, chr(10), 1) || substr(text, length(split_part(text, chr(10), 1)) + 2) AS body
  FROM documents)
"""

F3 = f"""
{CRC}, {F2}, {sql_encode("f2_ids", "f2", "id", "body")},
f3 AS (
  SELECT f2.id, whole AS input_ids, len(regexp_extract_all(instruction, '{PATTERN}')) AS prompt_length
  FROM f2 JOIN (
    SELECT id, list_append(ids, CASE WHEN id % 97 = 0 THEN 126348 ELSE 126081 END) AS whole FROM f2_ids) USING (id)
  UNION ALL VALUES (-1, []::BIGINT[], 0), (-2, NULL, 3), (-3, [11, 12, 126081], 8), (-4, [13, 14, 126348], NULL), (-5, NULL, NULL)),
f3_clean AS (
  SELECT id, coalesce(input_ids, []::BIGINT[]) AS input_ids, coalesce(prompt_length, 0) AS prompt_length FROM f3)
"""


def sql_streams(epochs: int = 1, shard: str = "0") -> str:
    """`placed`: every example of every stream with ordinal and offsets, by global windows."""
    return f"""
{F3},
ordered AS (
  SELECT epoch, id, input_ids, prompt_length, len(input_ids) AS n,
    md5(({SEED} + epoch)::VARCHAR || ':' || id::VARCHAR) AS order_key
  FROM f3_clean, (SELECT range AS epoch FROM range({epochs}))),
sharded AS (SELECT *, {shard} AS shard FROM ordered),
placed AS (
  SELECT *, row_number() OVER w AS ordinal,
    sum(n) OVER w AS e, sum(n) OVER w - n AS s
  FROM sharded
  WINDOW w AS (PARTITION BY epoch, shard ORDER BY order_key ROWS UNBOUNDED PRECEDING))
"""


def sql_blocks(block: int = BLOCK, **kwargs) -> str:
    """`blocks`: complete blocks with ids and labels, from one row per token."""
    return f"""
{sql_streams(**kwargs)},
token_rows AS (
  SELECT epoch, shard, s, prompt_length, unnest(input_ids) AS tok, generate_subscripts(input_ids, 1) AS i FROM placed),
cells AS (
  SELECT epoch, shard, tok, CASE WHEN i <= prompt_length THEN -100 ELSE tok END AS label,
    s + i - 1 AS p, (s + i - 1) // {block} AS chunk_id FROM token_rows),
blocks AS (
  SELECT epoch, shard, chunk_id, list(tok ORDER BY p) AS input_ids, list(label ORDER BY p) AS labels
  FROM cells GROUP BY ALL HAVING count(*) = {block})
"""


def select(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{body.strip()}"
