"""One query per operator of this package over the whole given tables, and its SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import (
    audit, decontamination, extraction, mixing, near_dedup, packing, quality, repair, repeats, sharding, topk,
    toxicity, warc,
)
from tracewell.llm.common import byte_length, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARD_BYTES = 1 << 20

# The mixture: weights by level, names that are not listed, share of all tokens, epochs at most.
DOMAIN_SQL = """case when source in ('src0', 'src1', 'src2', 'src3') then 'web'
  when source in ('src4', 'src5', 'src6', 'src7', 'src8', 'src9') then 'reference' else 'forum' end"""
DOMAIN_WEIGHTS = {"web": 5, "reference": 3, "forum": 2}
LANG_WEIGHTS = {"en": 6, "de": 2}
SOURCE_WEIGHTS = {"src0": 4}
MIX_SHARE = (7, 10)
MIX_EPOCHS = 2
MIX_SEED = "7"


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_mixture(spark, d):
    return mixing.mix(table(spark, d, "documents"), F.expr(DOMAIN_SQL), mixture_weights(),
                      MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def mixture_weights():
    return {"domain": mixing.weight_of(DOMAIN_WEIGHTS, "domain", 1),
            "lang": mixing.weight_of(LANG_WEIGHTS, "lang", 1),
            "source": mixing.weight_of(SOURCE_WEIGHTS, "source", 1)}


def _weights_sql(weights: dict[str, int], column: str) -> str:
    arms = " ".join(f"when '{k}' then {v}" for k, v in weights.items())
    return f"(case {column} {arms} else 1 end)"


def _level_sql(nodes: str, parent: str, name: str) -> str:
    """Shares of ``nodes`` (parent columns, name, cap, weight, budget) as SQL."""
    by = f"partition by {parent} " if parent else ""
    order = f"{by}order by cap / weight, {name}"
    return f"""(select *, case when filled then cap else
        (rest * upto) // whole - (rest * (upto - weight)) // whole end::bigint as tokens from (
      select *, budget::hugeint - coalesce(sum(cap) filter (filled) over ({by}), 0) as rest,
        sum(weight::hugeint) filter (not filled) over ({by}) as whole,
        coalesce(sum(weight::hugeint) filter (not filled) over (
          {order} rows between unbounded preceding and current row), 0) as upto from (
        select *, cap::hugeint * sum(weight) over ({order} rows between current row and unbounded following)
          <= weight::hugeint * (budget - coalesce(sum(cap) over (
            {order} rows between unbounded preceding and 1 preceding), 0)) as filled from {nodes})))"""


ORACLES["op1_mixture"] = f"""
with docs as materialized (
  select doc_id, {DOMAIN_SQL} as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
    coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0) as n_tokens from documents),
rows_ as materialized (select * from docs where n_tokens > 0),
leaves as materialized (select domain, lang, source, sum(n_tokens)::bigint as capacity,
  (sum(n_tokens) * {MIX_EPOCHS})::bigint as cap, {_weights_sql(SOURCE_WEIGHTS, 'source')} as weight
  from rows_ group by 1, 2, 3),
langs as materialized (select domain, lang, sum(cap)::bigint as cap,
  {_weights_sql(LANG_WEIGHTS, 'lang')} as weight from leaves group by 1, 2),
tops as materialized (select domain, sum(cap)::bigint as cap,
  {_weights_sql(DOMAIN_WEIGHTS, 'domain')} as weight from langs group by 1),
budget as materialized (select least(sum(capacity) * {MIX_SHARE[0]} // {MIX_SHARE[1]}, sum(cap))::bigint as budget
  from leaves),
one as materialized (select * from {_level_sql('(select * from tops, budget)', '', 'domain')}),
two as materialized (select * from {_level_sql(
    '(select l.*, o.tokens as budget from langs l join one o using (domain))', 'domain', 'lang')}),
three as materialized (select * from {_level_sql(
    '(select l.*, t.tokens as budget from leaves l join two t using (domain, lang))',
    'domain, lang', 'source')}),
plan as materialized (select domain, lang, source, tokens // capacity as whole, tokens % capacity as part
  from three where tokens > 0),
epochs as (select r.*, p.part, e.epoch, e.epoch < p.whole as every
  from rows_ r join plan p using (domain, lang, source), lateral (
    select unnest(range(0, p.whole + 1)) as epoch) e),
ordered as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source, epoch
    order by ('0x' || substr(md5('{MIX_SEED}:' || epoch || ':' || doc_id), 1, 15))::bigint, doc_id
    rows between unbounded preceding and 1 preceding), 0) as start from epochs)
select doc_id, domain, lang, source, n_tokens, epoch,
  (case when every then n_tokens else least(n_tokens, part - start) end)::bigint as taken
from ordered where every or start < part"""


@query
def op10_shards(spark, d):
    rows = table(spark, d, "documents").select("doc_id", byte_length("text").alias("n_bytes"))
    return sharding.assign_shards(rows, SHARD_BYTES, size=F.col("n_bytes"))


ORACLES["op10_shards"] = f"""
with rows_ as materialized (
  select doc_id, coalesce(strlen(text), 0) as n_bytes,
    ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint as h from documents),
levels as materialized (select h, n_bytes, d, h >> (60 - d) as p from rows_, range(0, 61) t(d)),
leaves as (select h, min(d) as leaf from levels join (
    select d, p from levels group by 1, 2 having sum(n_bytes) <= {SHARD_BYTES}) using (d, p) group by 1)
select doc_id, n_bytes, leaf || '-' || (h >> (60 - leaf)) as shard_id from rows_ join leaves using (h)"""


@query
def op4_decontaminate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = decontamination.find_matches(docs, table(spark, d, "benchmark"), keep=["doc_id"])
    return decontamination.judge(found).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES["op4_decontaminate"] = f"""
with docs as materialized (select doc_id, {_WORDS_SQL} as w from documents),
items as (select coalesce(item_id::varchar, '') as id, {_WORDS_SQL} as w from benchmark),
windows as materialized (select distinct id, n, array_to_string(w[i:i + n - 1], ' ') as s from (
  select id, w, least(len(w), 13) as n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i
  from items where len(w) > 0)),
sizes as (select distinct n from windows),
places as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s from (
  select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n)),
hits as materialized (select p.doc_id, p.i, p.n, w.id from places p join windows w using (n, s)),
covered as (select doc_id, count(distinct k) as n_hit from (
  select doc_id, unnest(range(i, i + n)) as k from hits) group by 1),
named as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, id from hits) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join covered using (doc_id) left join named using (doc_id)"""


@query
def op3_near_dedup(spark, d):
    return near_dedup.near_duplicates(table(spark, d, "documents"))


ORACLES["op3_near_dedup"] = r"""
with recursive docs as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as materialized (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5
    then [array_to_string(w, ' ')] else
    [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end) as s from docs),
items as materialized (select doc_id, len(s) as n, unnest(s) as h from sets),
pairs as (select a.doc_id as a, b.doc_id as b, a.n as n, b.n as m, count(*) as common
  from items a join items b on a.h = b.h and a.doc_id < b.doc_id group by all),
links as materialized (select a, b from pairs where 100 * common >= 75 * (n + m - common)),
edges as materialized (select a, b from links union all select b, a from links),
reach as (select a as node, b as other from edges
  union select r.node, e.b from reach r join edges e on e.a = r.other),
least_ as (select node, min(other) as other from reach group by 1)
select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce(other, doc_id)) as component_id,
  least(doc_id, coalesce(other, doc_id)) = doc_id as kept
from sets left join least_ on node = doc_id"""


@query
def op2_quality(spark, d):
    return quality.classify(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op7_toxicity(spark, d):
    return toxicity.score_documents(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op8_repeats(spark, d):
    return repeats.remove_repeats(table(spark, d, "documents")).drop("spans")


@query
def op9_topk(spark, d):
    rows = table(spark, d, "embeddings")
    return topk.top_k(rows, rows.filter("vec_id % 50 = 0"))


ORACLES["op9_topk"] = """
with rows_ as materialized (select vec_id, [floor(256 * x::double) for x in embedding] as v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scores as (select q.vec_id as query_id, r.vec_id, list_dot_product(q.v, r.v)::bigint as score
  from rows_ q join rows_ r on q.vec_id % 50 = 0 and q.vec_id <> r.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank,
  vec_id, score from scores
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5"""


@query
def op6_warc(spark, d):
    path = warc.write_archives(table(spark, d, "pages"))
    return warc.read_archives(spark, path, with_html=False).drop("url", "html")


ORACLES["op6_warc"] = """
with rows_ as materialized (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes,
  sha256(coalesce(html, '')) as payload_digest from pages),
firsts as (select payload_digest, min(page_id) as head from rows_ where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
  case when head is not null and head is distinct from page_id then 'revisit' else 'response' end as record_type,
  case when head is distinct from page_id then head end as refers_to
from rows_ left join firsts using (payload_digest)"""


@query
def op5_extract(spark, d):
    return extraction.extract(table(spark, d, "pages"))


@query
def op11_audit(spark, d):
    return audit.audit_filters(table(spark, d, "documents"), table(spark, d, "labels"))


ORACLES["op11_audit"] = r"""
with rows_ as materialized (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
fails as materialized (select part, (len(w) < 50)::int as a, (100 * len(list_distinct(w)) < 65 * len(w))::int as b,
  (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::int as c,
  regexp_matches(t, '[#$%&*|]')::int as d, coalesce(min(doc_id) over (partition by t) < doc_id, false)::int as e,
  coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from rows_ left join marks using (doc_id)),
counts as materialized (select part, a + 2 * b + 4 * c + 8 * d + 16 * e as m, count(*) as n, sum(good) as good,
  sum(toxic) as toxic from fails group by 1, 2),
letters as (select unnest(range(0, 5)) as k),
orders as materialized (select [a.k, b.k, c.k, d.k, e.k] as o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps as materialized (select array_to_string([substr('ABCDE', k::int + 1, 1) for k in o], '') as filter_order, step,
  1 << o[step] as f, coalesce(list_sum([1 << k for k in o[1:step - 1]]), 0)::bigint as s
  from orders, range(1, 6) t(step)),
sums as materialized (select part, filter_order, step, f,
  coalesce(sum(n) filter (m & (s | f) = 0), 0) as kept, coalesce(sum(n) filter (m & s = 0 and m & f > 0), 0) as removed,
  coalesce(sum(n) filter (m & s > 0 and m & f > 0), 0) as redundant,
  coalesce(sum(n) filter (m = f), 0) as unique_fails,
  coalesce(sum(good) filter (m & s = 0 and m & f > 0), 0) as good_lost,
  coalesce(sum(toxic) filter (m & s = 0 and m & f > 0), 0) as toxic_lost from counts, steps group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed,
  redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
  toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from sums"""


@query
def op12_packing(spark, d):
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(table(spark, d, "documents"), files[0], ranks=files[1], pattern=public_tokenizers.PATTERN)


@query
def op13_repair(spark, d):
    return repair.repair_damaged(table(spark, d, "conversations"))


def _edited(state: str, cost: str, letter: str, lines: str) -> str:
    return f"case when {state} is not null then {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'l': {state}.l || {lines}}} end"


def _inserts_sql(rows: str) -> str:
    """Inserts before a row; states 0 to 3 are start, s, u, a, each with its least cost and audit."""
    for _ in range(3):
        before = ", ".join(_edited(f"s{i}", "5", "I", "['user:']") for i in (0, 1, 3))
        after = _edited("s2", "5", "I", "['assistant:']")
        rows = f"(select * replace (list_min([s2, {before}]) as s2, list_min([s3, {after}]) as s3) from {rows})"
    return rows


def _kept(state: int, initial: str) -> str:
    return f"case when not must and initial = '{initial}' then {_edited(f's{state}', 'cut', 'K', '[line]')} end"


def _recast(state: int, role: str) -> str:
    return f"case when not must then {_edited(f's{state}', '1 + cut', 'R', f"['{role}:' || text]")} end"


_LEAST = {0: [], 1: [_kept(0, "s")], 2: [_kept(i, "u") for i in (0, 1, 3)] + [_recast(i, "user") for i in (0, 1, 3)],
          3: [_kept(2, "a"), _recast(2, "assistant")]}

ORACLES["op13_repair"] = rf"""
with recursive codes as (select list(list_reduce([i] || range(8), lambda v, k:
    case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end) order by i) as codes from range(256) t(i)),
keyed as materialized (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k
  from conversations),
fates as materialized (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  xor(list_reduce([4294967295] || list_transform(range(1, len(k) + 1), lambda i: ascii(substr(k, i, 1))), lambda crc, b:
    xor(crc >> 8, codes[(xor(crc, b) & 255) + 1])), 4294967295) % 20 as fate from keyed, codes),
damaged as (select conv_id, turn, case when fate = 4 then 'user' else role end as role,
  case when fate = 1 then '' when fate = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from fates, range(case fate when 0 then 0 when 3 then 2 else 1 end)),
numbered as materialized (select *, row_number() over (partition by conv_id order by turn nulls first, role,
  sha256(text)) as i from damaged),
judged as materialized (select *, substr(role, 1, 1) as initial, role || ':' || text as line,
  not regexp_matches(text, '[^ \t-\r]') as blank,
  row_number() over (partition by conv_id, role, text order by i) > 1 as again,
  not regexp_matches(text, '[.!?][ \t-\r]*\z') as short,
  lag(substr(role, 1, 1)) over (partition by conv_id order by i) as previous from numbered),
rows_ as materialized (select *, blank or again as must, case when short then 5 else 0 end as cut from judged),
paths as (
  select conv_id, 0::bigint as i, {{'c': 0::bigint, 'a': '', 'l': []::varchar[]}} as s0,
    null::struct(c bigint, a varchar, l varchar[]) as s1, null::struct(c bigint, a varchar, l varchar[]) as s2,
    null::struct(c bigint, a varchar, l varchar[]) as s3 from (select distinct conv_id from rows_)
  union all
  select conv_id, i, {", ".join(
      f"list_min([{', '.join([_edited(f's{s}', '2', 'D', '[]::varchar[]'), *options])}])" for s, options in _LEAST.items())}
  from {_inserts_sql('''(select p.conv_id, r.i, p.s0, p.s1, p.s2, p.s3, r.initial, r.line, r.text, r.must, r.cut
    from paths p join rows_ r on p.conv_id is not distinct from r.conv_id and r.i = p.i + 1)''')}),
sums as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
  count(*) filter (blank) as blank, count(*) filter (again and not blank) as duplicate,
  count(*) filter (short and not again and not blank) as truncated,
  count(*) filter (previous is not null and previous || initial not in ('su', 'ua', 'au')) as illegal
  from rows_ group by 1),
best as (select conv_id, i as n, list_min([s0, s3]) as s from {_inserts_sql('paths')})
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank,
  coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(s.c, 0)::bigint as cost, coalesce(s.a, '') as audit,
  sha256(coalesce(array_to_string(s.l, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join sums using (conv_id) left join best b on b.conv_id = o.conv_id and b.n = sums.n"""
