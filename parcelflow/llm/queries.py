"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collision_search import nearest
from .conversation_repair import repaired
from .decontaminate import contaminated, contaminated_sql
from .exact_progressive import decisions
from .hard_negatives import mined, mined_sql
from .jump_shard import jump_shards
from .langid_ecoc import identify
from .packing import packed
from .pii_crf import personal_data
from .secret_ownership import secrets
from .shared import table
from .simhash_bk import near_duplicates
from .stages import run
from .substring_lsm import WindowIndex
from .url_trust import judge_urls, judge_urls_sql


#: Parts of the table that op3 appends one after the other; all are looked at, and the result is that of the whole table.
OP3_BATCHES = 3


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by rules and link graph; null urls have an empty host and are allowed, an empty table gives none."""
    return judge_urls(table(spark, sf_dir, "pages"))


def op2_langid_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; null and letterless texts are ``und``, repeated rows get the same."""
    return identify(table(spark, sf_dir, "documents"))


def op3_substring_lsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated windows, from an index that gets the table in batches; null texts have no words."""
    docs = table(spark, sf_dir, "documents")
    index = WindowIndex(spark, words=35, fan_in=2)  # the third batch meets a compacted run
    for batch in range(OP3_BATCHES):
        index.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(OP3_BATCHES)) == batch))
    return index.remove_repeats(docs)


def op4_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; null counts as empty, repeated rows are each reported."""
    return personal_data(table(spark, sf_dir, "documents"))


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards by its id; a null id is the key 0, repeated rows have slots of their own."""
    return jump_shards(table(spark, sf_dir, "documents"), 8)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items that they contain; null and wordless texts contain none and are contained nowhere."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of 2048; a null text is its end token alone, repeated rows are packed each."""
    return packed(table(spark, sf_dir, "documents"))


def op8_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component; null and wordless texts have fingerprint zero and link like any other."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_exact_progressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stands for its text; null equals empty, of repeated rows one is kept."""
    return decisions(table(spark, sf_dir, "documents"))


def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; null counts as empty, repeated rows get the same result each."""
    return secrets(table(spark, sf_dir, "documents"))


def op11_gnat_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth id, against all rows; rows without label or with a broken vector take no part."""
    return mined(table(spark, sf_dir, "embeddings"))


def op12_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth id, against all rows; null, zero and broken vectors take no part."""
    return nearest(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired; nulls count as one space, an empty table gives none."""
    return repaired(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_url_trust, op2_langid_ecoc, op3_substring_lsm, op4_pii_skip_chain, op5_jump_shards, op6_decontaminate, op7_best_fit_packing, op8_simhash_bk, op9_exact_progressive, op10_secret_ownership, op11_gnat_negatives, op12_collision_search, op13_conversation_repair)
    return {f.__name__: f for f in ops} | {"pipeline": run}


_OP3 = r"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, unnest(range(1, len(ws) - 33)) as i, ws from w where len(ws) >= 35),
g as (select doc_id, i, sha256(array_to_string(list_slice(ws, i, i + 34), ' ')) as h from s),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by h) as n from g) where n > 1),
p as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as j from w where len(ws) > 0),
m as (select p.doc_id, p.j, p.word, max(r.i) over (partition by p.doc_id order by p.j rows unbounded preceding) as last
  from p left join r on r.doc_id = p.doc_id and r.i = p.j),
k as (select doc_id, count(*) filter (where last >= j - 34) as gone, string_agg(word, ' ' order by j) filter (where last is null or last < j - 34) as kept
  from m group by 1)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(gone, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k on k.doc_id = w.doc_id"""

_OP9 = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
  doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256 from t"""


def oracle_sql() -> dict[str, str]:
    """Not in SQL: trained classifiers (2, 4), CRC-32 (5, 13), tokenizers (7), XXH64 (8), spans of patterns (10), approximate search (12), pipeline."""
    return {"op1_url_trust": judge_urls_sql(), "op3_substring_lsm": _OP3, "op6_decontaminate": contaminated_sql(), "op9_exact_progressive": _OP9, "op11_gnat_negatives": mined_sql()}
