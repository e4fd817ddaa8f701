"""The registered queries of this subpackage and, where SQL can express them, their SQL.

op1, op2, op3, op7 to op10 and op12 depend on learnt weights, a hash or tokenizers that DuckDB lacks, or on templates; op4 on keyed hashes
and retries; op11 on eigenvectors. They are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainage.llm.common import table
from chainage.llm.language_bayes import identify
from chainage.llm.license_templates import scan_licenses
from chainage.llm.lm_interpolation import score_documents
from chainage.llm.merkle_manifest import checked_documents
from chainage.llm.packing import pack_documents
from chainage.llm.pii_surrogates import pseudonymise
from chainage.llm.quality_gbdt import classify
from chainage.llm.quality_llr import judge
from chainage.llm.simhash_pivots import near_duplicates
from chainage.llm.token_viterbi import count_tokens
from chainage.llm.warc_chunks import archived
from chainage.llm.whitening import whiten
from chainage.llm.winnowing import contamination
from corpus_pipeline import run


def op1_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    return score_documents(table(spark, sf, "documents"))


def op2_quality_gbdt(spark: SparkSession, sf: str) -> DataFrame:
    return classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op3_simhash_pivots(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


def op4_pii_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    return pseudonymise(table(spark, sf, "documents"))


def op5_winnowing(spark: SparkSession, sf: str) -> DataFrame:
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("key")


def op6_warc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return archived(table(spark, sf, "pages")).select(
        F.col("record").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


def op7_token_viterbi(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_license_templates(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licenses(table(spark, sf, "documents"))


def op9_quality_llr(spark: SparkSession, sf: str) -> DataFrame:
    return judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """The operator's ``deviation`` has 38 digits; one that no 64-bit number holds is null here."""
    rows = whiten(table(spark, sf, "embeddings"))
    return rows.withColumns(
        {"vec_id": F.col("vec_id").cast("bigint"), "deviation": F.col("deviation").try_cast("bigint")}
    )


def op12_language_bayes(spark: SparkSession, sf: str) -> DataFrame:
    return identify(table(spark, sf, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return checked_documents(table(spark, sf, "documents"))


def queries() -> dict:
    own = [
        op1_interpolation, op2_quality_gbdt, op3_simhash_pivots, op4_pii_surrogates, op5_winnowing,
        op6_warc_chunks, op7_token_viterbi, op8_license_templates, op9_quality_llr, op10_packing,
        op11_whitening, op12_language_bayes, op13_merkle_manifest,
    ]
    return {q.__name__: q for q in own} | {"pipeline": run}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format('coalesce({}, chr(32))')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark),
item_window AS (
  SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS span
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM item WHERE len(w) > 0)
),
doc AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format('text')} AS w FROM documents),
place AS (
  SELECT rid, p, n, array_to_string(w[p : p + n - 1], ' ') AS span
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc, (SELECT DISTINCT n FROM item_window) WHERE len(w) >= n)
),
met AS (SELECT rid, p, place.n, item FROM place JOIN item_window USING (span)),
hit AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS place FROM met) GROUP BY rid),
listed AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item FROM met) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (rid) LEFT JOIN listed USING (rid)
"""

OP6 = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= 100
"""



def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


#: CRC-32 bit by bit: 0xEDB88320 is its reversed polynomial.
_CRC = """xor(list_reduce(
    list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
    lambda crc, byte: list_reduce(
      list_prepend(xor(crc, byte), [CAST(z AS UBIGINT) FOR z IN range(8)]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))
  ), CAST(4294967295 AS UBIGINT))"""


def _tree(name: str, leaves: str) -> str:
    """Nodes ``grp, lvl, idx, h, n`` of a tree per group; ``leaves`` selects ``grp, idx, h, n``."""
    return f"""{name}(grp, lvl, idx, h, n) AS (
  SELECT grp, 0, idx, h, n FROM ({leaves})
  UNION ALL
  SELECT grp, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2
  FROM {name} WHERE n > 1 GROUP BY grp, lvl, idx // 2, n
)"""


OP13 = f"""
WITH RECURSIVE leaf AS MATERIALIZED (
  SELECT doc_id, lang AS grp, {_leaf('n_chars')} AS h,
    CASE WHEN ({_CRC}) % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS shown
  FROM documents
),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM leaf
),
{_tree('node', 'SELECT grp, idx, h, n FROM ranked')},
sub AS MATERIALIZED (
  SELECT grp, h, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM node WHERE n = 1
),
{_tree('crown', 'SELECT 0 AS grp, idx, h, n FROM sub')},
walk(doc_id, grp, leaf, lvl, idx, n, seen, fold) AS (
  SELECT doc_id, grp, h, 0, idx, n, '', shown FROM ranked
  UNION ALL
  SELECT w.doc_id, w.grp, w.leaf, w.lvl + 1, w.idx // 2, (w.n + 1) // 2, w.seen || coalesce(s.h, ''),
    sha256(CASE WHEN w.idx % 2 = 0 THEN w.fold || coalesce(s.h, '') ELSE s.h || w.fold END)
  FROM walk w LEFT JOIN node s ON s.grp IS NOT DISTINCT FROM w.grp AND s.lvl = w.lvl AND s.idx = xor(w.idx, 1)
  WHERE w.n > 1
),
climb(doc_id, leaf, subroot, lvl, idx, n, seen, fold) AS (
  SELECT w.doc_id, w.leaf, sub.h, 0, sub.idx, sub.n, w.seen, w.fold
  FROM walk w JOIN sub ON w.grp IS NOT DISTINCT FROM sub.grp WHERE w.n = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.lvl + 1, c.idx // 2, (c.n + 1) // 2, c.seen || coalesce(s.h, ''),
    sha256(CASE WHEN c.idx % 2 = 0 THEN c.fold || coalesce(s.h, '') ELSE s.h || c.fold END)
  FROM climb c LEFT JOIN crown s ON s.lvl = c.lvl AND s.idx = xor(c.idx, 1)
  WHERE c.n > 1
)
SELECT doc_id, leaf, subroot, crown.h AS root, sha256(seen) AS proof_sha256, fold AS folded_root, fold = crown.h AS verified
FROM climb JOIN crown ON crown.n = 1 WHERE climb.n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_winnowing": OP5, "op6_warc_chunks": OP6, "op13_merkle_manifest": OP13}
