"""Queries over the driver's tables, one per operator, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm import bpe, chat, html_text, minhash, mixing, quality_model, quality_rules, suffix_dedup, token_counts, topk
from provlake.llm._shared import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_report(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), 2048)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.topk(rows, rows.where("vec_id % 50 = 0"), 5)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_digest(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), columns=["doc_id", "source", "lang"])


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.preferences(chat.alternatives(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",").alias(c)
    return made.select(*[spans(c) if c.endswith("_mask") else F.col(c) for c in made.columns])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered_words", "longest_repeat")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_bpe, op2_token_counts, op3_near_duplicates, op4_html_text, op5_topk, op6_suffix_dedup, op7_mixing, op8_quality_model, op9_preferences, op10_quality_rules)
    return {f.__name__: f for f in named}


_OP5 = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, r.vec_id, max(cast(list_inner_product(cast(q.e as double[]), cast(r.e as double[])) as bigint)) as score
  from (select * from v where vec_id % 50 = 0) q join v r on q.vec_id <> r.vec_id and len(q.e) = len(r.e) group by 1, 2)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify rank <= 5
"""

_OP9 = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from c),
l as (select conv_id, max(k) as n from o where role = 'assistant' group by 1),
r as (select o.conv_id, text as reply from o join l on o.conv_id = l.conv_id and k = n),
t as (select conv_id as pair_id, true as side, k, role, text from o
  union all select o.conv_id, false, k, role, text from o join l on o.conv_id = l.conv_id and k < n
  union all select l.conv_id, false, n, 'assistant', reply from l join r on r.conv_id = xor(l.conv_id, 1)),
k as (select pair_id, side, k, regexp_replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g') as role,
  regexp_replace(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g') as text from t),
p as (select pair_id, count(*) filter (side) as nc, count(*) filter (not side) as nr from k group by 1),
d as (select c.pair_id, min(c.k) - 1 as n from k c join k r on c.pair_id = r.pair_id and c.k = r.k and c.side and not r.side and (c.role <> r.role or c.text <> r.text) group by 1),
n as (select p.pair_id, coalesce(d.n, least(nc, nr)) as n, nc, nr from p left join d using (pair_id)),
x as (select k.*, n.n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as shown from k join n using (pair_id)),
y as (select *, sum(length(shown)) over (partition by pair_id, side order by k) as stop from x where k > n),
m as (select pair_id,
  coalesce(string_agg(shown, '' order by k) filter (side), '') as chosen, coalesce(string_agg(shown, '' order by k) filter (not side), '') as rejected,
  coalesce(string_agg(cast(cast(stop - length(text) - 8 as bigint) as varchar) || '-' || cast(cast(stop as bigint) as varchar), ',' order by k) filter (side and role = 'assistant'), '') as chosen_mask,
  coalesce(string_agg(cast(cast(stop - length(text) - 8 as bigint) as varchar) || '-' || cast(cast(stop as bigint) as varchar), ',' order by k) filter (not side and role = 'assistant'), '') as rejected_mask
  from y group by 1),
q as (select pair_id, string_agg(shown, '' order by k) as prompt from x where k <= n and side group by 1)
select n.pair_id, cast(n.n as int) as n_prompt_turns, cast(nc - n.n as int) as n_chosen_turns, cast(nr - n.n as int) as n_rejected_turns, coalesce(prompt, '') as prompt,
  coalesce(chosen, '') as chosen, coalesce(rejected, '') as rejected, coalesce(chosen_mask, '') as chosen_mask, coalesce(rejected_mask, '') as rejected_mask, nc > 0 and nr > 0 as complete
from n left join m using (pair_id) left join q using (pair_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_topk": _OP5, "op9_preferences": _OP9}
