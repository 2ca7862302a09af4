"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from . import langid, mixing, quality
from .ann import nearest
from .common import shared_dir, table, written
from .conversations import digests, repair
from .html_text import extract
from .media import read_media, store_texts
from .order import looked_up
from .packing import pack
from .simhash import near_duplicates
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .trie import trie, turns_of
from .warc import captures, page_of, read_archives, resolved, write_archives

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_suffix_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs, kept_as=None).drop("text")


@query
def op2_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def _fold(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


@query
def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(_fold(4) == 2, F.lit(False)))
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model, keep_text=False)


@query
def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(_fold(5) == 0, F.lit(False)))
    labels = table(spark, sf_dir, "labels").filter(F.coalesce(_fold(5) != 0, F.lit(True)))
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model, keep_text=False)
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


@query
def op10_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op5_ann(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: fixed values: the mixture of op4 and of the pipeline
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2}


def domain_of(source):
    """Four domains by the number in a source's name; d0 for a source without one."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), (F.when(number == "", "0").otherwise(number).cast("bigint") % 4).cast("string"))


def mixture(docs, total, epochs, seed):
    weights = (mixing.weight_of("domain", DOMAIN_WEIGHTS, 1), mixing.weight_of("lang", LANG_WEIGHTS, 1), F.lit(1).cast("bigint"))
    return mixing.mix(docs, total, epochs, seed, domain=domain_of(F.col("source")), weights=weights)


@query
def op4_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixture(docs, F.expr("tokens * 3 div 2"), 2, 7)


def _parted_sql(nodes: str, parent: str, name: str) -> str:
    """DuckDB: the children's shares of `budget`."""
    order = f"partition by {parent} order by cast(cap as double) / weight, {name}"
    filled = f"""select *, cast(cap as hugeint) * sum(weight) over ({order} rows between current row and unbounded following)
        <= cast(weight as hugeint) * (budget - coalesce(sum(cap) over ({order} rows between unbounded preceding and 1 preceding), 0)) as filled from {nodes}"""
    return f"""select *, case when filled then cap else cast((cast(budget - coalesce(sum(case when filled then cap end) over (partition by {parent}), 0) as hugeint) * weight)
        // sum(case when not filled then weight end) over (partition by {parent}) as bigint) end as share from ({filled})"""


def _case_sql(column: str, weights: dict) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in weights.items()) + " else 1 end"


ORACLES["op4_mixing"] = f"""
with lean as (
  select doc_id, (coalesce(strlen(text), 0) + 3) // 4 as n_tokens, coalesce(lang, '') as lang, coalesce(source, '') as source,
         'd' || (coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') as bigint), 0) % 4) as domain
  from documents),
leaves as (
  select domain, lang, source, cast(sum(n_tokens) as bigint) as tokens, cast(sum(n_tokens) * 2 as bigint) as cap, 1 as weight from lean group by all),
langs as (
  select domain, lang, cast(sum(cap) as bigint) as cap, {_case_sql("lang", LANG_WEIGHTS)} as weight from leaves group by domain, lang),
domains as (
  select 0 as root, domain, cast(sum(cap) as bigint) as cap, {_case_sql("domain", DOMAIN_WEIGHTS)} as weight,
         (select cast(sum(tokens) * 3 // 2 as bigint) from leaves) as budget from langs group by domain),
d as ({_parted_sql("domains", "root", "domain")}),
lb as (select l.*, d.share as budget from langs l join d using (domain)),
l as ({_parted_sql("lb", "domain", "lang")}),
sb as (select s.*, l.share as budget from leaves s join l using (domain, lang)),
s as ({_parted_sql("sb", "domain, lang", "source")}),
bought as (
  select domain, lang, source, share // greatest(tokens, 1) as whole, share % greatest(tokens, 1) as rest from s),
spots as (
  select lean.*, whole, rest, md5('7:' || whole || ':' || coalesce(cast(doc_id as varchar), '')) as spot from lean join bought using (domain, lang, source)),
runs as (
  select *, sum(n_tokens) over (partition by domain, lang, source order by spot) as upto from spots),
times as (
  select *, whole + case when upto <= rest then 1 else 0 end as times from runs)
select doc_id, domain, lang, source, n_tokens, cast(unnest(range(times)) as integer) as epoch from times where times > 0
"""


@query
def op9_media(spark, sf_dir):
    stored = store_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = stored.withColumns({"media_bytes": F.octet_length("media").cast("bigint"), "media_sha256": F.sha2("media", 256)})
    read = read_media(digests, with_tensor=False)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def damaged(conversations):
    """Conversations as op11 damages them, by a checksum of each row's place."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20)).alias("_code")).filter("_code <> 0")
    harmed = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"role": F.when(F.col("_code") == 4, "user").otherwise(F.col("role")), "text": harmed})
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_code") == 3, 2).otherwise(1)))).drop("col")


@query
def op11_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damaged(conversations))
    every = conversations.select(F.col("conv_id").alias("_conv")).distinct()
    same = lambda c: F.col("_conv").eqNullSafe(F.col(c))
    hashed = digests(found.messages).select(F.col("conv_id").alias("_hashed"), "sha256")
    rows = every.join(found.summary, same("conv_id"), "left").join(hashed, same("_hashed"), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(F.col("_conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def grafted(turns, ids):
    """op13's conversations: the first h turns of conversation c - c % 5 before c's own turns after its first h; h is a checksum of c."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9))
    every = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("_base"), h.alias("_h"))
    first = turns.filter("place <= 8").select(F.col("conv_id").alias("_base"), "place", "digest", "bytes")
    taken = every.join(first, "_base").filter("place <= _h").select("conv_id", "place", "digest", "bytes")
    size = first.groupBy("_base").agg(F.count("*").alias("_size"))  # of the first eight
    start = every.join(size, "_base", "left").select("conv_id", "_h", F.least("_h", F.coalesce("_size", F.lit(0))).alias("_given"))
    own = looked_up(turns, start, ["conv_id"], F.floor(F.col("place") / 4096)).filter("place > _h")
    return taken.unionByName(own.select("conv_id", (F.col("place") - F.col("_h") + F.col("_given")).alias("place"), "digest", "bytes"))


@query
def op13_prefix_trie(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = written(turns_of(conversations), "turns")
    ids = turns.select("conv_id").distinct()
    return trie(grafted(turns, ids), ids)


def _checksum_sql(text: str) -> str:
    """DuckDB: CRC-32 of an ASCII text; fixed values: the polynomial and the mask."""
    one = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, case when d & 1 = 1 then 3988292384 else 0 end))"
    letters = f"list_transform(range(1, length({text}) + 1), lambda i: cast(ascii(({text})[i]) as bigint))"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {letters}), lambda c, b: {one}), 4294967295)"


ORACLES["op13_prefix_trie"] = f"""
with own as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as place
  from conversations where conv_id is not null),
every as (select conv_id, conv_id - conv_id % 5 as base, {_checksum_sql("cast(conv_id as varchar)")} % 9 as h from (select distinct conv_id from own)),
rows as (
  select e.conv_id, 0 as part, o.place, o.role, o.text from every e join own o on o.conv_id = e.base and o.place <= e.h
  union all select e.conv_id, 1, o.place, o.role, o.text from every e join own o on o.conv_id = e.conv_id and o.place > e.h),
numbered as (select *, row_number() over (partition by conv_id order by part, place) as d from rows),
whole as (select e.conv_id, coalesce(list({{'r': role, 't': text}} order by d) filter (where d is not null), []) as seq from every e left join numbered n using (conv_id) group by e.conv_id),
members as (select conv_id, len(seq) as n, d, seq[1:d] as prefix, case when d > 0 then strlen(seq[d].t) else 0 end as bytes from (select conv_id, seq, unnest(range(len(seq) + 1)) as d from whole)),
nodes as (select prefix, d, min(conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes,
  sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where n = d), '')) as ends_sha256 from members group by prefix, d),
kids as (select prefix[1:d - 1] as prefix, d - 1 as d, count(*) as n_children from nodes where d > 0 group by all),
full_nodes as (select n.*, coalesce(k.n_children, 0) as n_children from nodes n left join kids k on k.prefix = n.prefix and k.d = n.d),
below as (select n.prefix, n.d, sum((m.n_convs - 1) * m.bytes) as saved, count(*) filter (where m.n_children = 0) as n_leaves
  from full_nodes n join full_nodes m on m.d >= n.d and m.prefix[1:n.d] = n.prefix group by n.prefix, n.d)
select n.conv_id, cast(n.d as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, b.n_leaves, cast(b.saved as bigint) as saved_tokens, n.ends_sha256
from full_nodes n join below b on b.prefix = n.prefix and b.d = n.d left join full_nodes p on p.d = n.d - 1 and p.prefix = n.prefix[1:n.d - 1]
"""


@query
def op12_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(captures(pages), path)
    read = written(resolved(read_archives(spark, path)), "records")
    kind = pages.schema["page_id"].dataType
    id_of = lambda c: page_of(F.col(c)).cast(kind)
    return read.select(id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_of("refers_to").alias("refers_to"), "digest_ok")


_BASE32 = """array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
  1 + ((cast('0x' || substr(sha1(coalesce(html, '')), 1 + 5 * (i // 4), 5) as bigint) >> (15 - 5 * (i % 4))) & 31)]), '')"""
ORACLES["op12_warc"] = f"""
select page_id, strlen(coalesce(html, '')) as payload_bytes, {_BASE32} as payload_digest, case when n = 1 then 'response' else 'revisit' end as record_type, case when n > 1 then top end as refers_to, true as digest_ok
from (select *, row_number() over (partition by coalesce(html, '') order by page_id desc nulls last, url desc nulls last) as n, max(page_id) over (partition by coalesce(html, '')) as top from pages)
"""
