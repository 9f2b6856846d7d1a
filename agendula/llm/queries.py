"""The registered queries opN_<name> and, where SQL can express one, its SQL."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fim, langid, license, mix, quality, shard, simhash, sptok, topk, toxicity, vcode, warc, winnow


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sptok.digests(_read(spark, folder, "documents"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op3_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op4_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix.mix_words(_read(spark, folder, "documents"))


def op5_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return winnow.fingerprints(_read(spark, folder, "documents"))


def op6_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return topk.top_k(rows)


def op7_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_read(spark, folder, "pages"))


def op8_lpt_shards(spark: SparkSession, folder: str) -> DataFrame:
    out = shard.shard_documents(_read(spark, folder, "documents"))
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, folder, "documents"))


def op10_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predict(_read(spark, folder, "documents"))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vcode.codes(_read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"))


def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license.scan(_read(spark, folder, "documents"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fim.digests(_read(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_toxicity, op3_line_quality, op4_source_mix, op5_winnowing, op6_exact_top_k, op7_warc_archive, op8_lpt_shards, op9_simhash, op10_language_mixture, op11_vector_codes, op12_license_scan, op13_fill_in_middle)}

_MIX_SQL = """
with recursive docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 12))::bigint as a,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 13, 12))::bigint as b
  from documents),
sums as (select source, sum(size)::bigint as source_size from docs group by source),
ranked as (
  select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w,
         sum(source_size) over () as all_size
  from sums),
leveled as (
  select *, (all_size * 1.5::double - coalesce(sum(source_size) over (order by source_size::double / w, source nulls last
             rows between unbounded preceding and 1 preceding), 0) * 2.0::double)
            / sum(w) over (order by source_size::double / w, source nulls last rows between current row and unbounded following) as level
  from ranked),
goal as (
  select source, source_size,
         coalesce(least(source_size * 2.0::double, w * (select level from leveled where level * w <= source_size * 2.0::double
                        order by source_size::double / w, source nulls last limit 1)), source_size * 2.0::double) as target
  from leveled),
rates as (
  select *, floor(case when source_size > 0 then target / source_size else 0 end)::bigint as base,
         (case when source_size > 0 then target / source_size else 0 end) as rate
  from goal),
drawn as (
  select d.doc_id, d.size, r.source, r.source_size, r.target, r.base, j.j,
         case when ((d.a + d.b * j.j) % 281474976710656) < (r.rate - r.base) * 281474976710656.0::double then 1 else 0 end as more
  from docs d join rates r on d.source is not distinct from r.source cross join range(32) j(j)),
chosen as (
  select source, min_by(j, (off, j)) as j
  from (select source, j, abs(sum(size * base) + sum(size * more) - max(target)) as off from drawn group by source, j)
  group by source)
select d.doc_id, d.size, d.source_size, d.target, (d.size * (d.base + d.more))::bigint as taken
from drawn d join chosen c on d.source is not distinct from c.source and d.j = c.j
"""

_TOP_K_SQL = """
with e as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from e q join e c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from scored qualify rank <= 20
"""

_WARC_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as raw from pages),
d as (select page_id, octet_length(raw)::bigint as payload_bytes, sha1(raw) as payload_digest, max(page_id) over (partition by raw) as last_id from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id is distinct from last_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id is distinct from last_id then last_id end as refers_to
from d
"""



def _codes_sql() -> str:
    """Rounds of assignment and of means, written out one after another."""
    ctes = [
        f"""kept as materialized (
  select row_number() over (order by vec_id nulls last) as r, vec_id, label, list_transform(embedding, lambda x: floor({vcode.SCALE} * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"width as (select max(len(v)) // {vcode.PARTS} as w from kept)",
        f"parts as materialized (select r, p, v[p * w + 1 : p * w + w] as s from kept, width, range({vcode.PARTS}) t(p))",
        f"book0 as materialized (select p, r - 1 as e, s as c from parts where r <= {vcode.ENTRIES})",
    ]
    for n in range(vcode.ROUNDS + 1):
        squared = "list_dot_product(s, s) - 2 * list_dot_product(s, c) + list_dot_product(c, c)"
        ctes.append(f"near{n} as materialized (select r, p, any_value(s) as s, min((({squared})::bigint, e)) as best from parts join book{n} using (p) group by r, p)")
        if n < vcode.ROUNDS:
            ctes.append(f"one{n} as (select p, best[2] as e, unnest(s) as x, unnest(range(len(s))) as i from near{n})".replace("best[2]", "struct_extract(best, 2)"))
            ctes.append(f"mean{n} as (select p, e, i, floor(sum(x) / count(*)) as m from one{n} group by p, e, i)")
            ctes.append(f"new{n} as (select p, e, list(m order by i) as c from mean{n} group by p, e)")
            ctes.append(f"book{n + 1} as materialized (select b.p, b.e, coalesce(n.c, b.c) as c from book{n} b left join new{n} n using (p, e))")
    last = vcode.ROUNDS
    return f"""with {", ".join(ctes)},
coded as (
  select r, string_agg(lpad(lower(to_hex(struct_extract(best, 2))), 2, '0'), '' order by p) as code, sum(struct_extract(best, 1))::bigint as error
  from near{last} group by r),
digest as (select sha256(string_agg(array_to_string(list_transform(c, lambda x: x::bigint::varchar), ','), ',' order by p, e)) as codebooks_sha256 from book{last})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from kept join coded using (r), digest
"""


def _license_sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    short = [(label, license.split(text), 2, "true") for text, label in license.PHRASES]
    long = [(label, license.split(text), license.K, "false") for label, text in license.NOTICES]
    rows = ", ".join(f"({t}, '{label}', {quoted(w)}, {k}, {phrase})" for t, (label, w, k, phrase) in enumerate([*short, *long]))
    return f"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{license.WORD}') as w from documents),
templates(t, label, w, k, phrase) as (values {rows}),
runs as (select t, label, k, phrase, len(w) as n, i as seat, array_to_string(w[i + 1 : i + k], ' ') as gram from templates, lateral (select unnest(range(len(w) - k + 1)) as i)),
grams as (select r, i as pos, k, array_to_string(w[i + 1 : i + k], ' ') as gram from docs, lateral (select unnest(range(len(w))) as i), (values (2), ({license.K})) ks(k)),
diagonals as (
  select r, t, label, k, phrase, n, pos - seat as diagonal, min(pos) as low, max(pos) + k as high, list(distinct seat) as seats
  from grams join runs using (k, gram) group by r, t, label, k, phrase, n, pos - seat),
held as (select *, list_distinct(flatten(list_transform(seats, lambda a: range(a, a + k)))) as held from diagonals),
marked as (
  select *, case when phrase or coalesce(diagonal - lag(diagonal) over (partition by r, t order by diagonal) > {license.GAP}, true) then 1 else 0 end as new from held),
numbered as (select *, sum(new) over (partition by r, t order by diagonal rows unbounded preceding) as run from marked),
merged as (
  select r, t, label, phrase, min(low) as start,
         greatest(max(len(held) / n), len(list_distinct(flatten(list(held)))) / greatest(any_value(n), max(high) - min(low))) as score
  from numbered group by r, t, label, phrase, run),
rated as (
  select r, count(*) filter (phrase and score >= 1) as n_base, min(start) filter (phrase and score >= 1) as first_word, max(start) filter (phrase and score >= 1) as last_word,
         string_agg(distinct label, ',' order by label) filter (phrase and score >= 1) as base_labels,
         string_agg(distinct label, ',' order by label) filter (score >= case when phrase then 1 else {license.LEAST} end) as labels,
         max(score) filter (not phrase or score >= 1) as score
  from merged group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from docs left join rated using (r)
"""


_FIM_SQL = """
with keyed as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as key from documents),
hashed as (
  select *, ('0x' || key[1:8])::bigint % (n + 1) as a, ('0x' || key[9:16])::bigint % (n + 1) as b, ('0x' || key[17:24])::bigint % 100 as c, ('0x' || key[25:32])::bigint % 100 as d from keyed),
cut as (
  select *, least(a, b) as low, greatest(a, b) as high,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or c >= 90 then 'plain' when d < 20 then 'spm' else 'psm' end as form
  from hashed),
parts as (select *, substring(text, 1, low) as prefix, substring(text, low + 1, high - low) as middle, substring(text, high + 1) as suffix from cut)
select doc_id, n, form, case when form <> 'plain' then low end as prefix_chars, case when form <> 'plain' then high - low end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from parts
"""


def _crc_step(c: str, x: str) -> str:
    """One step of CRC-32 by half a byte ``x`` (its low four bits), as SQL."""

    def half(n: int) -> int:
        for _ in range(4):
            n = n >> 1 ^ 0xEDB88320 * (n & 1)
        return n

    table = ", ".join(f"{half(i)}::ubigint" for i in range(16))
    return f"xor([{table}][(xor({c}, {x}) & 15)::int + 1], ({c}) >> 4)"


def _shards_sql(shards: int = 16) -> str:
    """The schedule group by group: a recursion over groups by falling size, with the loads as a list."""
    ones = "4294967295::ubigint"
    return f"""
with recursive docs as materialized (
  select doc_id, raw, sha256(raw) as key, octet_length(raw) + 1 as size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(raw), '..'), lambda b: ('0x' || b)::ubigint), lambda c, b: {_crc_step(_crc_step("c", "b"), "(b >> 4)")}, {ones}), {ones}) as crc
  from (select doc_id, encode(coalesce(text, '')) as raw from documents)),
groups as materialized (
  select key, sum(size)::bigint as weight, row_number() over (order by sum(size) desc, key) as n, row_number() over (partition by sum(size) order by key) - 1 as place from docs group by key),
steps as (
  select 0::bigint as n, 0::bigint as weight, list_transform(range({shards}), lambda x: 0::bigint) as loads, -1::bigint as shard
  union all
  select g.n, g.weight, list_transform(s.loads, lambda x, i: case when i = s.least then x + g.weight else x end), s.least - 1
  from (select n, loads, list_position(loads, list_min(loads)) as least from steps) s join groups g on g.n = s.n + 1),
taken as (select weight, shard, count(*) as c from steps where n > 0 group by weight, shard),
ends as (select weight, shard, sum(c) over (partition by weight order by shard) as till, sum(c) over (partition by weight order by shard) - c as since from taken),
placed as (select key, e.shard from groups g join ends e on g.weight = e.weight and g.place >= e.since and g.place < e.till)
select doc_id, size::bigint as size, crc::bigint as text_crc32, 'bytes' as law, shard::int as shard,
       (row_number() over (partition by shard order by doc_id nulls first) - 1)::bigint as slot, null::int as grown_shard
from docs join placed using (key)
"""


#: Fixed values of XXH64: its five primes.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _u(n: int) -> str:
    return f"{n % (1 << 64)}::uhugeint"


def _mod(e: str) -> str:
    """Modulo 2^64; products of two such values fit 128 bits."""
    return f"(({e}) & {_u(-1)})"


def _turn(e: str, r: int) -> str:
    return f"(({e}) * {_u(1 << r)} & {_u(-1)} | ({e}) // {_u(1 << 64 - r)})"


def _xxh64_ctes(source: str, seed: int = 42) -> str:
    """CTEs from ``source`` (column s, distinct) to ``hashed`` (s, h): XXH64 of s in UTF-8, in 128-bit arithmetic."""
    lane = lambda at, n: "('0x' || " + " || ".join(f"substr(hx, 2 * ({at}) + {2 * j + 1}, 2)" for j in reversed(range(n))) + ")::ubigint::uhugeint"
    mixed = lambda e: _mod(_turn(_mod(e), 31) + f" * {_u(_P1)}")
    step = lambda k, r, a, b: f"{{'k': {k}, 'r': {_u(1 << r)}, 's': {_u(1 << 64 - r)}, 'a': {_u(a)}, 'b': {_u(b)}}}"
    starts = (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)
    stripes = ", ".join(f"list_reduce(list_transform(range(n // 32), lambda i: {lane(f'32 * i + {8 * j}', 8)}), lambda v, x: {mixed(f'v + x * {_u(_P2)}')}, {_u(v)}) as v{j}" for j, v in enumerate(starts))
    joined = _mod(" + ".join(_turn(f"v{j}", r) for j, r in enumerate((1, 7, 12, 18))))
    for j in range(4):
        joined = _mod(f"xor({joined}, {mixed(f'v{j} * {_u(_P2)}')}) * {_u(_P1)} + {_u(_P4)}")
    eights = f"list_transform(range(n % 32 // 8), lambda i: {step(mixed(lane('n // 32 * 32 + 8 * i', 8) + f' * {_u(_P2)}'), 27, _P1, _P4)})"
    fours = f"list_transform(range(n % 8 // 4), lambda i: {step(_mod(lane('n // 8 * 8', 4) + f' * {_u(_P1)}'), 23, _P2, _P3)})"
    singles = f"list_transform(range(n % 4), lambda i: {step(_mod(lane('n // 4 * 4 + i', 1) + f' * {_u(_P5)}'), 11, _P1, 0)})"
    return f"""
hexed as materialized (select s, hex(encode(s)) as hx, octet_length(encode(s)) as n from {source}),
striped as materialized (select *, {stripes} from hexed),
begun as (select s, hx, n, (case when n >= 32 then {joined} else {_u(seed + _P5)} end + n::uhugeint) & {_u(-1)} as h from striped),
tailed as (
  select s, list_reduce(flatten([{eights}, {fours}, {singles}]),
    lambda v, o: ((xor(v, o.k) * o.r & {_u(-1)} | xor(v, o.k) // o.s) * o.a + o.b) & {_u(-1)}, h) as h from begun),
first as (select s, xor(h, h // {_u(1 << 33)}) * {_u(_P2)} & {_u(-1)} as h from tailed),
second as (select s, xor(h, h // {_u(1 << 29)}) * {_u(_P3)} & {_u(-1)} as h from first),
hashed as (select s, xor(h, h // {_u(1 << 32)})::ubigint as h from second)"""


def _simhash_sql() -> str:
    """Fingerprints by a sum a bit; links by comparing all distinct fingerprints; components by reachability."""
    votes = ", ".join(f"sum((h >> {b}) & 1) * 2 > count(*) as b{b}" for b in range(64))
    fingerprint = " + ".join(f"case when b{b} then {1 << b}::uhugeint else 0 end" for b in range(64))
    return f"""
with recursive docs as (
  select doc_id, row_number() over () as r,
         regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
shingles as (select r, array_to_string(w[i + 1 : i + 3], ' ') as s from docs, lateral (select unnest(range(case when len(w) = 0 then 0 else greatest(len(w) - 2, 1) end)) as i)),
wanted as (select distinct s from shingles), {_xxh64_ctes("wanted")},
votes as (select r, {votes} from shingles join hashed using (s) group by r),
marked as (select doc_id, coalesce({fingerprint}, 0)::ubigint as f from docs left join votes using (r)),
prints as materialized (select f, min(doc_id) as first_id from marked group by f),
links as materialized (select a.f as f, b.f as g from prints a join prints b on bit_count(xor(a.f, b.f)) <= 3),
reach as (select f, g from links union select reach.f, links.g from reach join links on reach.g = links.f),
least as (select reach.f, min(p.first_id) as component_id from reach join prints p on p.f = reach.g group by reach.f)
select doc_id, lpad(lower(to_hex(f)), 16, '0') as fingerprint, component_id from marked join least using (f)
"""


#: The others have none: the rolling hash of op5 and the windows over it were not written in SQL, and models and tokenizers are no SQL.
#: tests/llm holds them against brute force, round trips or held-out labels.
SQL = {
    "op4_source_mix": _MIX_SQL,
    "op6_exact_top_k": _TOP_K_SQL,
    "op7_warc_archive": _WARC_SQL,
    "op8_lpt_shards": _shards_sql(),
    "op9_simhash": _simhash_sql(),
    "op11_vector_codes": _codes_sql(),
    "op12_license_scan": _license_sql(),
    "op13_fill_in_middle": _FIM_SQL,
}
