"""Queries over the whole tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcflow.llm import audit, chat, decontaminate, fingerprint, html_text, katz, language, mixing, neardup, pieces, spelling, substrings, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(by: int) -> Column:
    """CRC-32 of the id as text, modulo `by`."""
    return F.crc32(F.col("doc_id").cast("string")) % by


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs, learn=_remainder(4) != 2)
    found = language.identify(docs, model)
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), F.col("lang").alias("lang_pred"), "score", F.size("spans").cast("long").alias("n_spans"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_and_follow(_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    found = pieces.encode_texts(_table(spark, sf_dir, "documents"), model_path or public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = katz.score_documents(_table(spark, sf_dir, "documents"), learn=_remainder(7) != 2)
    return found.select("doc_id", (_remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def _ranges(mask: str) -> Column:
    return F.array_join(F.transform(mask, lambda m: F.concat_ws("-", m["begin"].cast("string"), m["end"].cast("string"))), ",").alias(mask)


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.format_preferences(chat.echo_pairs(_table(spark, sf_dir, "conversations")), "conv_id")
    return found.select("conv_id", "prompt_turns", "prompt", "chosen", _ranges("chosen_mask"), "chosen_turns", "rejected", _ranges("rejected_mask"), "rejected_turns")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), learn=_remainder(4) != 2)
    found = toxicity.score_texts(docs, model)
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", "predicted")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language, op2_fingerprints, op3_sentencepiece, op4_neardup, op5_decontamination, op6_substrings, op7_language_model, op8_html_text, op9_preferences, op10_toxicity, op11_spelling, op12_filter_audit, op13_mixing)}


PREFERENCES_SQL = """
with turns as (
  select conv_id, list({'role': role, 'text': text} order by turn nulls first, role, text) t
  from (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null) group by conv_id),
places as (select *, list_filter(range(len(t)), lambda i: t[i + 1].role = 'assistant') a from turns),
pairs as (select conv_id, t, a[(((conv_id % len(a)) + len(a)) % len(a)) + 1] p from places where len(a) > 0),
sides as (select conv_id, t as c, list_concat(t[1:p], [{'role': 'assistant', 'text': case when p > 0 then t[p].text else '' end}]) as r from pairs),
matched as (select *, least(len(c), len(r)) as m, list_position(list_transform(range(least(len(c), len(r))), lambda i: c[i + 1] = r[i + 1]), false) as f from sides),
divided as (select conv_id, coalesce(nullif(f, 0) - 1, m) as n, c, r from matched),
rest as (select conv_id, n, c[1:n] as p, c[n + 1:] as c, r[n + 1:] as r from divided),
shown as (
  select conv_id, n, list_transform(p, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) as ps,
    c, list_transform(c, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) as cs,
    r, list_transform(r, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) as rs from rest)
select conv_id, n::bigint as prompt_turns, coalesce(array_to_string(ps, ''), '') as prompt,
  coalesce(array_to_string(cs, ''), '') as chosen,
  coalesce(array_to_string(list_transform(list_filter(range(len(c)), lambda i: c[i + 1].role = 'assistant'), lambda i: (length(array_to_string(cs[1:i], '')) + length(c[i + 1].role) + 5)::varchar || '-' || (length(array_to_string(cs[1:i + 1], '')) - 1)::varchar), ','), '') as chosen_mask,
  len(c)::bigint as chosen_turns,
  coalesce(array_to_string(rs, ''), '') as rejected,
  coalesce(array_to_string(list_transform(list_filter(range(len(r)), lambda i: r[i + 1].role = 'assistant'), lambda i: (length(array_to_string(rs[1:i], '')) + length(r[i + 1].role) + 5)::varchar || '-' || (length(array_to_string(rs[1:i + 1], '')) - 1)::varchar), ','), '') as rejected_mask,
  len(r)::bigint as rejected_turns
from shown
"""

_BLANKS = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z alone.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION_SQL = f"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
windows as (select distinct item_id, k, array_to_string(w[i + 1:i + k], ' ') as v from (select item_id, w, least(10, len(w)) as k, unnest(range(len(w) - least(10, len(w)) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct k from windows),
starts as (select doc_id, w, k, unnest(range(len(w) - k + 1)) as i from d, sizes where len(w) >= k),
found as (select doc_id, i, s.k, item_id from starts s join windows x on x.k = s.k and x.v = array_to_string(w[i + 1:i + s.k], ' ')),
hits as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from found) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from found) group by doc_id)
select doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""

SUBSTRINGS_SQL = f"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '{_BLANKS}'), []) w from documents),
windows as (select doc_id, i, md5(array_to_string(w[i + 1:i + 20], ' ')) as v from (select doc_id, w, unnest(range(len(w) - 19)) as i from d where len(w) >= 20)),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by v order by doc_id, i) as k from windows) where k > 1),
gone as (select doc_id, list(distinct j) as g, count(distinct j) as n from (select doc_id, unnest(range(i, i + 20)) as j from again) group by doc_id),
kept as (select doc_id, string_agg(x, ' ' order by j) as t from (select doc_id, unnest(w) as x, unnest(range(len(w))) as j from d) left join (select doc_id, unnest(g) as j, true as out from gone) using (doc_id, j) where out is null group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join gone using (doc_id) left join kept using (doc_id)
"""

NEARDUP_SQL = f"""
with recursive d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '{_BLANKS}'), []) w from documents),
s as materialized (select doc_id, md5(array_to_string(w[i + 1:i + least(5, len(w))], ' ')) as v from (select doc_id, w, unnest(range(greatest(len(w) - 4, 1))) as i from d where len(w) > 0) group by all),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
f as materialized (select v, count(*) as f from s group by v),
-- A pair at the threshold shares one of a set's rarest shingles: all but three quarters of it, and one more.
p as materialized (select doc_id, v from (select s.doc_id, s.v, n.n, row_number() over (partition by s.doc_id order by f.f, s.v) as k from s join f using (v) join n using (doc_id)) where k <= n - ceil(0.75 * n) + 1),
c as materialized (select distinct a.doc_id as a, b.doc_id as b from p a join p b on a.v = b.v and a.doc_id < b.doc_id),
l as materialized (select a, b from (select c.a, c.b, count(*) as i from c join s x on x.doc_id = c.a join s y on y.doc_id = c.b and y.v = x.v group by c.a, c.b) join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 75 * (na.n + nb.n - i)),
e as materialized (select a, b from l union select b, a from l),
r(doc_id, m) as (select doc_id, doc_id from documents union select e.b, r.m from r join e on e.a = r.doc_id where r.m < e.b)
select doc_id, coalesce(n, 0)::bigint as n_shingles, m as component_id, m = doc_id as kept
from (select doc_id, min(m) as m from r group by doc_id) left join n using (doc_id)
"""


AUDIT_SQL = f"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select doc_id, part, text, regexp_extract_all(text, '{_BLANKS}') as w from d),
least_of as (select text, min(doc_id) as least from d group by text),
f as (
  select doc_id, part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text))::int
    + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int as mask
  from w join least_of using (text)),
l as (select doc_id, max(quality) as good, max(toxic) as toxic from labels group by doc_id),
m as (select part, mask, count(*) as n, count(*) filter (good = 1) as good, count(*) filter (toxic = 1) as toxic from f left join l using (doc_id) group by part, mask),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as c, unnest([1, 2, 4, 8, 16]) as bit),
orders as (
  select a.c || b.c || c.c || d.c || e.c as o from letters a, letters b, letters c, letters d, letters e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps as (
  select o, step, bit, coalesce((select sum(y.bit) from letters y where contains(substr(o, 1, step - 1), y.c)), 0)::int as before
  from orders, range(1, 6) r(step), letters x where x.c = substr(o, step, 1)),
told as (
  select part, o as filter_order, step::int as step, bit,
    sum(case when mask & before = 0 and mask & bit = 0 then n else 0 end)::bigint as kept,
    sum(case when mask & before = 0 and mask & bit <> 0 then n else 0 end)::bigint as removed,
    sum(case when mask & before <> 0 and mask & bit <> 0 then n else 0 end)::bigint as redundant,
    sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
    sum(case when mask & before = 0 and mask & bit <> 0 then good else 0 end)::bigint as good_lost,
    sum(case when mask & before = 0 and mask & bit <> 0 then toxic else 0 end)::bigint as toxic_lost
  from m, steps group by part, o, step, bit)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from told
"""

MIXING_SQL = f"""
with recursive d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{_BLANKS}')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from d group by source),
-- Sources above their limit get it, and what is left is shared anew by the others' weights.
rounds(k, source, source_size, weight, full_up) as (
  select 0, source, source_size, weight, false from s
  union all
  select k + 1, source, source_size, weight, full_up or weight * (1.5 * all_size - 2 * full_size) > 2.0 * source_size * open_weight
  from (select *, sum(source_size) over () as all_size, sum(case when full_up then source_size else 0 end) over () as full_size, sum(case when full_up then 0 else weight end) over () as open_weight from rounds)
  where k < (select count(*) from s)),
t as (
  select source, source_size,
    case when full_up then 2.0 * source_size else (1.5 * sum(source_size) over () - 2.0 * sum(case when full_up then source_size else 0 end) over ())::double * weight::double / (sum(case when full_up then 0 else weight end) over ())::double end::double as target
  from rounds where k = (select count(*) from s)),
turns as (select doc_id, d.source, size, source_size, target, copy, ('0x' || substr(md5(concat_ws(':', 42, copy, doc_id)), 1, 15))::ubigint::bigint as key from d join t on t.source is not distinct from d.source, range(2) r(copy)),
queue as (select *, coalesce(sum(size) over (partition by source order by copy, key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as before from turns),
served as (select *, greatest(0, least(size, ceil(target)::bigint - before)) as words from queue),
timed as (select *, least(1.0::double, (before + words)::double / target) as finish from served where words > 0),
mixed as (select *, coalesce(sum(words) over (order by finish, source nulls first, copy, key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as position from timed),
taken as (select doc_id, sum(greatest(0, least(words, (select floor(1.5 * sum(size))::bigint from d) - position)))::bigint as taken from mixed group by doc_id)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from d join t on t.source is not distinct from d.source left join taken using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_neardup": NEARDUP_SQL, "op5_decontamination": CONTAMINATION_SQL, "op6_substrings": SUBSTRINGS_SQL, "op9_preferences": PREFERENCES_SQL, "op12_filter_audit": AUDIT_SQL, "op13_mixing": MIXING_SQL}
