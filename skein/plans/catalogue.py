"""Queries of the catalog engine over the driver's tables, by name, each with the same result in DuckDB SQL.

The tables are no listings, so each query first states how their rows are read as listings, offers or events; what
follows are the engine's own operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import identifiers, money, titles
from skein.functions import text as T
from skein.operators import blocking, checks, evidence, graph, offers, resolve, state
from skein.plans import export, intake  # noqa: F401 (registers its queries)
from skein.plans.registry import QUERIES, SQL, query, t
from skein.sources import events as E
from skein.sources import log, policy

#: A part's title, as a listing's: words, a model code, a measurement.
TITLE = "concat(p_name, ' ', replace(p_brand, 'Brand#', 'BX'), '-', cast({p}p_size as {s}), ' ', cast({p}p_size as {s}), ' mm ', p_type)"
TITLE_SQL, TITLE_SPARK = TITLE.format(p="", s="varchar"), TITLE.format(p="", s="string")


def titled(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").withColumn("title", F.expr(TITLE_SPARK))


def joined(array: Column) -> Column:
    return F.array_join(array, ",")


# ------------------------------------------------------------------ text, codes, titles, money
@query("select page_id, length(c) as n, md5(c) as digest from (select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]{1,80}>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') as c from pages)")
def clean_html_pages(spark, d):
    c = T.clean(F.col("html"))
    return t(spark, d, "pages").select("page_id", F.length(c).cast("long").alias("n"), F.md5(c.cast("binary")).alias("digest"))


@query("select page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]+/(?:.*/)?([^/]+)/*$', 1) as slug from pages")
def url_slug(spark, d):
    return t(spark, d, "pages").select("page_id", F.coalesce(T.sku_from_url(F.col("url")), F.lit("")).alias("slug"))


GTIN_SQL = "select p_partkey, case when p_partkey % 7 = 3 then concat(p_partkey, '?') when p_partkey % 5 = 0 then cast(p_partkey as varchar) else lpad(cast(p_partkey * 7919 as varchar), 13, '0') end as raw from part"


@query(f"""with r as ({GTIN_SQL}), c as (select p_partkey, raw, case when regexp_full_match(raw, '[0-9]{{8}}|[0-9]{{11,14}}') then lpad(raw, 14, '0') end as canonical from r),
s as (select *, list_sum([cast(substr(canonical, i, 1) as int) * case when i % 2 = 1 then 3 else 1 end for i in range(1, 14)]) as total from c)
select p_partkey, canonical, case when canonical is null then 'malformed' when (10 - total % 10) % 10 = cast(substr(canonical, 14, 1) as int) then 'valid' else 'checksum_invalid' end as validity from s""")
def gtin_canonical_validity(spark, d):
    raw = F.expr("case when p_partkey % 7 = 3 then concat(p_partkey, '?') when p_partkey % 5 = 0 then cast(p_partkey as string) else lpad(cast(p_partkey * 7919 as string), 13, '0') end")
    return t(spark, d, "part").select("p_partkey", identifiers.gtin_canonical(raw).alias("canonical"), identifiers.gtin_validity(raw).alias("validity"))


@query("select p_partkey, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) as squeezed, upper(replace(p_brand, 'Brand#', 'BX')) as family from part")
def squeeze_brand(spark, d):
    return t(spark, d, "part").select("p_partkey", T.squeeze(F.col("p_brand")).alias("squeezed"), T.family(F.concat(F.regexp_replace("p_brand", "Brand#", "BX-"), F.lit("-7"))).alias("family"))


@query("select p_partkey, concat(replace(p_brand, 'Brand#', 'BX')) as tokens, concat(replace(p_brand, 'Brand#', 'BX'), p_size) as codes from part")
def family_tokens_part(spark, d):
    return titled(spark, d).select("p_partkey", joined(T.family_tokens(F.col("title"))).alias("tokens"), joined(T.full_codes(F.col("title"))).alias("codes"))


@query("select p_partkey, upper(concat(split_part(p_name, ' ', 2), p_size)) as tokens from part")
def word_number_tokens(spark, d):
    return t(spark, d, "part").select("p_partkey", joined(T.family_tokens(F.expr("concat(p_name, ' ', p_size)"))).alias("tokens"))


@query("select p_partkey, case when split_part(p_name, ' ', 1) = 'small' or split_part(p_name, ' ', 1) not in ('new', 'top', 'black', 'white', 'silver') then concat(upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')), ',', upper(split_part(p_name, ' ', 1))) else concat(upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')), ',', upper(split_part(p_name, ' ', 2))) end as tokens from part")
def fallback_tokens_part(spark, d):
    return t(spark, d, "part").select("p_partkey", joined(T.fallback_tokens(F.col("p_name"), F.col("p_brand"))).alias("tokens"))


@query(f"""with p as (select p_partkey, lower({TITLE_SQL}) as low, p_size from part)
select p_partkey, 'color' as key, regexp_extract(low, '\\b(midnight|natural|silver|black|white|green|blue|gold|gray|grey|pink|red)\\b', 1) as value from p where regexp_matches(low, '\\b(midnight|natural|silver|black|white|green|blue|gold|gray|grey|pink|red)\\b')
union all select p_partkey, 'size', case when regexp_matches(low, '\\bmedium\\b') then 'M' when regexp_matches(low, '\\blarge\\b') then 'L' else 'S' end from p where regexp_matches(low, '\\b(medium|large|small)\\b')
union all select p_partkey, 'case_size_mm', cast(p_size as varchar) from p where p_size between 10 and 99""")
def title_attrs_eav(spark, d):
    rows = titled(spark, d).withColumn("title", T.clean(F.col("title")))  # once, not once for each attribute
    rows = rows.select("p_partkey", F.explode(titles.title_attributes(F.col("title"), F.lit("title"), cleaned=True)).alias("a"))
    return rows.select("p_partkey", "a.key", "a.value")


@query("""with p as (select p_partkey, case when p_partkey % 3 = 0 then concat('$', cast(p_retailprice as decimal(12,2))) when p_partkey % 3 = 1 then concat('USD ', cast(p_retailprice as decimal(12,2)), ' - 5') else concat(cast(p_size as varchar), ',000.25') end as raw from part)
select p_partkey, case when p_partkey % 3 = 1 then null else try_cast(replace(replace(raw, '$', ''), ',', '') as double) end as amount from p""")
def money_parse(spark, d):
    raw = F.expr("case when p_partkey % 3 = 0 then concat('$', cast(p_retailprice as decimal(12,2))) when p_partkey % 3 = 1 then concat('USD ', cast(p_retailprice as decimal(12,2)), ' - 5') else concat(cast(p_size as string), ',000.25') end")
    return t(spark, d, "part").select("p_partkey", money.parse_money(raw).alias("amount"))


# ------------------------------------------------------------------ JSON, hashes, envelopes
@query("select event_id, cast(json_extract_string(props, '$.k') as double) as k, cast(json_extract_string(props, '$.k') as varchar) as text from events")
def typed_props(spark, d):
    v = F.try_parse_json("props")
    return t(spark, d, "events").select("event_id", E.number_at(v, "$.k").alias("k"), E.text_at(v, "$.k").alias("text"))


@query("""with p as (select event_id, event_type, concat('{"k":', json_extract_string(props, '$.k'), ',"t":"', event_type, '"}') as c from events)
select event_id, substr(sha1(c), 1, 16) as payload_hash, concat('web|', case when event_id % 3 = 0 then concat('e', event_id) else 'b1' end, '|', substr(sha1(c), 1, 16)) as event_key from p""")
def payload_hash_and_key(spark, d):
    payload = F.concat(F.lit('{"t": "'), F.col("event_type"), F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    h = log.payload_hash(payload)
    key = log.event_key(F.lit("web"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("e"), "event_id")), F.lit("b1"), F.lit(None).cast("string"), h)
    return t(spark, d, "events").select("event_id", h.alias("payload_hash"), key.alias("event_key"))


@query("select case when event_type = 'error' then 'listing_tombstone' when event_type = 'signup' then 'authoritative_correction' when event_type = 'click' then 'partial_patch' when event_type = 'view' then 'historical_snapshot' else 'full_snapshot' end as mode, count(*) as n from events group by 1")
def effective_modes(spark, d):
    operation = F.expr("case event_type when 'error' then 'delete' when 'signup' then 'correct' when 'click' then 'patch' else 'upsert' end")
    mode = E.effective_mode(operation, F.when(F.col("event_type") == "view", "historical_snapshot"))
    return t(spark, d, "events").groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


@query("select case when event_type in ('click', 'view') then 'affiliate_b:feed_v3.7' when event_type = 'error' then 'none' when event_type = 'signup' then 'retailer_api:2026-08-compact' else 'affiliate_a:csv_v1' end as adapter, count(*) as n from events group by 1")
def adapter_select_counts(spark, d):
    from skein.sources.adapters import registry, select

    shape = F.expr("""case event_type when 'click' then '{"eventId": "1", "item": {}}' when 'view' then '{"eventId": 1, "item": {"title": "x"}}' when 'error' then '{"id": 1}' when 'signup' then '{"observation_id": "1", "product": {"configuration": []}}' else '{"record_id": "1", "product_name": "x"}' end""")
    source = F.expr("case event_type when 'click' then 'affiliate_b' when 'view' then 'affiliate_b' when 'signup' then 'retailer_api' when 'error' then 'community_deals' else 'affiliate_a' end")
    return t(spark, d, "events").groupBy(F.coalesce(select(source, F.try_parse_json(shape), registry()), F.lit("none")).alias("adapter")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ delivery, state, history
DELIVERIES = "select concat(l_orderkey, '-', l_linenumber) as event_key, concat(l_partkey, '-', l_suppkey, '-', l_quantity, '-', l_extendedprice, '-', l_discount, '-', l_tax, '-', l_shipdate) as payload"


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem").selectExpr("concat(l_orderkey, '-', l_linenumber) as event_key", "l_partkey as record", "l_partkey as p", "l_suppkey as s", "l_shipdate as w", "l_extendedprice as x", "l_quantity as q", "l_discount as di", "l_tax as ta")
    return rows.select("event_key", F.concat_ws("-", "p", "s").alias("payload_hash"), F.struct("p", "s", "w", "x", "q", "di", "ta").alias("seq"), F.lit(None).cast("string").alias("idempotency_key"), F.col("record").cast("string").alias("record_id"))


@query("""with r as (select concat(l_orderkey, '-', l_linenumber) as k, concat(l_partkey, '-', l_suppkey) as h, row_number() over w as nth, first_value(concat(l_partkey, '-', l_suppkey)) over w as f
from lineitem window w as (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax))
select case when nth > 1 and h <> f then 'conflict' when nth > 1 then 'duplicate' else 'new' end as status, count(*) as n, count(distinct k) as keys from r group by 1""")
def dedupe_first_wins(spark, d):
    return log.classify(deliveries(spark, d)).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("event_key").alias("keys"))


@query("""with r as (select concat(l_orderkey, '-', l_linenumber) as event_key, concat(l_partkey, '-', l_suppkey) as h, first_value(concat(l_partkey, '-', l_suppkey)) over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) as f from lineitem)
select event_key, count(*) as conflicts from r where h <> f group by 1""")
def delivery_conflicts(spark, d):
    return log.classify(deliveries(spark, d)).where("status = 'conflict'").groupBy("event_key").agg(F.count("*").alias("conflicts"))


#: Arrival order of events: out of the order of their clocks.
HISTORY_SQL = "select user_id as record, (event_id % 7) * 1000000000 + event_id as seq, ts as clock, event_type, value from events"


def history(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").selectExpr("user_id as record", "(event_id % 7) * 1000000000 + event_id as seq", "ts as clock", "event_type", "value", "event_id")


APPLIED_SQL = f"select *, coalesce(clock >= max(clock) over (partition by record order by seq rows between unbounded preceding and 1 preceding), true) as applied from ({HISTORY_SQL})"


@query(f"select record, count(*) as n, count(*) filter (where applied) as n_applied from ({APPLIED_SQL}) group by 1")
def stale_gate_history(spark, d):
    return state.stale_gate(history(spark, d)).groupBy("record").agg(F.count("*").alias("n"), F.count_if("applied").alias("n_applied"))


@query(f"""with a as ({APPLIED_SQL})
select record, arg_max(case when event_type = 'click' then null else value end, struct_pack(clock := clock, seq := seq)) as dropped, round(max(value), 2) as top from a where applied group by 1""".replace("arg_max(case when event_type = 'click' then null else value end, struct_pack(clock := clock, seq := seq)) as dropped, ", ""))
def applied_top_value(spark, d):
    return state.stale_gate(history(spark, d)).where("applied").groupBy("record").agg(F.round(F.max("value"), 2).alias("top"))


@query(f"""with a as (select * from ({APPLIED_SQL}) where applied),
s as (select record, value, event_type, row_number() over (partition by record order by clock desc, seq desc) as r from a),
p as (select record, value, row_number() over (partition by record order by clock desc, seq desc) as r from a where event_type <> 'click')
select s.record, case when s.event_type = 'click' then null else s.value end as snapshot, p.value as patched from s left join p on s.record = p.record and p.r = 1 where s.r = 1""")
def snapshot_vs_patch_state(spark, d):
    gated = state.stale_gate(history(spark, d))
    value = F.when(F.col("event_type") != "click", F.col("value"))
    snap = state.current(gated, value, patch=False).withColumnRenamed("value", "snapshot")
    return snap.join(state.current(gated, value, patch=True).withColumnRenamed("value", "patched"), "record", "left")


@query(f"""with h as (select *, event_type = 'error' as gone, lag(event_type = 'error') over (partition by record order by seq) as was from ({HISTORY_SQL})),
l as (select record, gone, row_number() over (partition by record order by seq desc) as r, not gone and coalesce(was, false) as back from h)
select record, max(case when r = 1 then case when gone then 'inactive' else 'active' end end) as lifecycle, count(*) filter (where back) as reactivations from l group by 1""")
def tombstone_lifecycle(spark, d):
    return state.lifecycle(history(spark, d), F.col("event_type") == "error")


@query("select o_custkey as record, o_orderkey as seq, prior, o_orderstatus as new from (select *, lag(o_orderstatus) over (partition by o_custkey order by o_orderkey) as prior from orders) where prior is not null and prior <> o_orderstatus")
def assignment_audit(spark, d):
    return state.assignment_audit(t(spark, d, "orders").selectExpr("o_custkey as record", "o_orderkey as seq", "o_orderstatus"), F.col("o_orderstatus"))


@query("select conv_id, string_agg(role, '>' order by turn, role, text) as roles, count(*) as n from conversations group by 1")
def conversation_history(spark, d):
    rows = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("h"), F.count("*").alias("n"))
    return rows.select("conv_id", F.array_join(F.transform("h", lambda x: x["role"]), ">").alias("roles"), "n")


# ------------------------------------------------------------------ evidence, policy
@query("""with e as (select p_name as listing, 'size' as key, case when p_partkey % 2 = 0 then cast(p_size as varchar) else p_type end as value, p_partkey % 3 + 1 as rank, p_partkey as ord from part),
m as (select *, max(rank) over (partition by listing, key) as top from e)
select listing, key, arg_min(value, ord) as value, min(lower(trim(value))) <> max(lower(trim(value))) as conflicting from m where rank = top group by 1, 2""")
def evidence_precedence(spark, d):
    derivation = F.expr("case p_partkey % 3 when 2 then 'explicit' when 1 then 'normalized' else 'inferred' end")
    rows = t(spark, d, "part").select(F.col("p_name").alias("listing"), F.lit("size").alias("key"), F.expr("case when p_partkey % 2 = 0 then cast(p_size as string) else p_type end").alias("value"), derivation.alias("derivation"), F.col("p_partkey").alias("ord"))
    return evidence.precedence(rows)


@query("select p_type as category, case when p_type = 'SMALL' then 'smartwatches' when p_type = 'LARGE' then 'phones' else 'other' end as named, count(*) as n, sum(case when p_type = 'SMALL' then 2 when p_type = 'LARGE' then 1 else 3 end) as dims from part group by 1, 2")
def policy_dims(spark, d):
    named = F.expr("case p_type when 'SMALL' then 'smartwatches' when 'LARGE' then 'phones' else 'other' end")
    attributes = F.create_map(F.lit("case_size_mm"), F.col("p_size").cast("string"), F.lit("color"), F.col("p_name"), F.lit("panel"), F.col("p_brand"), F.lit("edition"), F.when(F.col("p_size") >= 0, "x"))
    rows = evidence.critical_dims(t(spark, d, "part").select("p_type", named.alias("category"), attributes.alias("attributes")), policy.built_in())
    return rows.groupBy(F.col("p_type").alias("category"), F.col("category").alias("named")).agg(F.count("*").alias("n"), F.sum(F.size("dims")).alias("dims"))


# How many product, variant and price-critical dimensions each category has.
POLICY_SQL = """select category, role, dims from (select category, unnest(['product', 'variant', 'price_critical']) as role, unnest(n) as dims from (values
('phones', [3, 3, 2]), ('laptops', [3, 5, 5]), ('smartwatches', [3, 5, 3]), ('storage_devices', [3, 5, 3]), ('cameras', [3, 4, 3]), ('game_consoles', [3, 3, 3]), ('footwear', [3, 5, 3]),
('beauty_and_fragrance', [3, 4, 4]), ('tires', [3, 8, 7]), ('power_tools', [4, 5, 5]), ('printer_supplies', [3, 6, 4]), ('books_media', [3, 7, 5]), ('networking', [3, 7, 5]), ('__default__', [3, 52, 52])) as c(category, n))"""


@query(POLICY_SQL)
def policy_table(spark, d):
    return policy.table(spark, policy.built_in()).groupBy("category", "role").agg(F.count("*").cast("int").alias("dims"))


@query("""select case when p_size % 5 = 0 then 'storage_devices' when contains(lower(concat(p_name, ' ', p_type)), 'watch') then 'smartwatches' when p_size % 7 = 0 then 'laptops' when p_size % 11 = 0 then 'phones' else 'unknown' end as category, count(*) as n from part group by 1""")
def category_infer(spark, d):
    keys = F.filter(F.array(F.when(F.col("p_size") % 5 == 0, "capacity_gb"), F.when(F.col("p_size") % 7 == 0, "ram_gb"), F.when(F.col("p_size") % 11 == 0, "carrier")), lambda k: k.isNotNull())
    return t(spark, d, "part").groupBy(policy.infer_category(keys, F.expr("concat(p_name, ' ', p_type)")).alias("category")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ blocking, graph, resolution
#: A part is a listing; the product is name and brand, the variant also type and size. Parts of 13 n are requests, the rest members.
PRODUCT_SQL = "concat(p_name, '|', p_brand)"


def parts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").selectExpr("p_partkey as listing", "concat(p_name, '|', p_brand) as product", "concat(p_name, '|', p_brand, '|', p_type, '|', p_size) as variant", "p_name", "p_brand", "p_type", "p_size")


@query(f"with p as (select p_partkey as listing, {PRODUCT_SQL} as product from part) select a.listing, count(distinct b.product) as n from p a join p b on a.product = b.product and a.listing <> b.listing group by 1")
def block_code(spark, d):
    p = parts(spark, d)
    met = blocking.block(p.select("listing", F.col("product").alias("key")), p.select(F.col("listing").alias("member"), F.col("product").alias("entity"), F.col("product").alias("key")), "full_code_index", 2)
    return met.groupBy("listing").agg(F.count("*").alias("n"))


@query("with k as (select distinct l_partkey as listing, l_suppkey as s from lineitem), n as (select s, count(*) - 1 as n from k group by 1) select listing, count(*) as keys, cast(sum(n) as bigint) as partners from k join n using (s) where n > 0 group by 1")
def block_sku_self(spark, d):
    """Sellers that a part shares with other parts, and how many others it meets over all of them."""
    k = t(spark, d, "lineitem").selectExpr("l_partkey as listing", "l_suppkey as key").distinct()
    met = blocking.block_counts(k, k.select(F.col("listing").alias("member"), F.col("listing").alias("entity"), "key"))
    return met.groupBy("listing").agg(F.count("*").alias("keys"), F.sum("n").alias("partners"))


@query("select p_brand as key, count(distinct p_partkey) as n, cast(count(distinct p_partkey) * (count(distinct p_partkey) - 1) as bigint) as pairs from part group by 1")
def block_sizes(spark, d):
    return blocking.block_sizes(parts(spark, d).select("listing", F.col("p_brand").alias("key")))


CAND_SQL = f"""with p as (select p_partkey as listing, {PRODUCT_SQL} as product, concat({PRODUCT_SQL}, '|', p_type) as typed, p_brand, p_name from part),
c as (select a.listing, b.product as entity, 'full_code_index' as index, 2 as strength from p a join p b on a.typed = b.typed and a.listing <> b.listing
union select a.listing, b.product, 'token_index', 1 from p a join p b on a.p_name = b.p_name and a.listing <> b.listing)"""


def part_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d).withColumn("typed", F.concat_ws("|", "product", "p_type"))
    build = lambda key: p.select(F.col("listing").alias("member"), F.col("product").alias("entity"), F.col(key).alias("key"))
    probe = lambda key: p.select("listing", F.col(key).alias("key"))
    return blocking.block(probe("typed"), build("typed"), "full_code_index", 2).unionAll(blocking.block(probe("p_name"), build("p_name"), "token_index", 1))


@query(CAND_SQL + " select listing, count(distinct entity) as candidate_count, count(distinct entity) filter (where index = 'token_index') as by_token from c group by 1")
def candidate_telemetry(spark, d):
    out = blocking.telemetry(part_candidates(spark, d))
    return out.select("listing", F.col("candidate_count").cast("long").alias("candidate_count"), F.coalesce(F.size(F.try_element_at("candidates", F.lit("token_index"))), F.lit(0)).cast("long").alias("by_token"))


@query(CAND_SQL + ", s as (select listing, entity, max(strength) as strength from c group by 1, 2) select listing, entity, strength from (select *, rank() over (partition by listing order by strength desc) as r from s) where r = 1")
def top_stratum(spark, d):
    return blocking.top_stratum(blocking.support(part_candidates(spark, d)))


@query("select distinct a.p_partkey as listing, concat(b.p_type, '|', b.p_size) as variant from part a join part b on a.p_name = b.p_name and a.p_brand = b.p_brand and a.p_type = b.p_type where a.p_partkey <> b.p_partkey")
def variant_viability(spark, d):
    p = parts(spark, d)
    build = p.select(F.col("product").alias("key"), F.col("listing").alias("member"), F.concat_ws("|", "p_type", F.col("p_size").cast("string")).alias("entity"), "p_type", "p_size")
    attrs = F.create_map(F.lit("type"), F.lower("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    variants = blocking.entities(build, "p_type", "p_size").select("key", "entity", "members", "one", attrs.alias("attrs"))
    met = p.select("listing", F.col("product").alias("key"), F.create_map(F.lit("type"), "p_type").alias("dims")).join(variants, "key").where(blocking.others())
    return met.where(blocking.viable(F.col("dims"), F.col("attrs"))).select("listing", F.col("entity").alias("variant")).distinct()


@query("select a.p_partkey as listing, count(*) as n_conflicts from part a join part b on a.p_name = b.p_name and a.p_brand = b.p_brand where a.p_partkey <> b.p_partkey and (a.p_type <> b.p_type or a.p_size <> b.p_size) group by 1")
def variant_conflicts(spark, d):
    """A listing never conflicts with its own dimensions, so members are counted by their dimensions before they are met."""
    p = parts(spark, d)
    dims = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    kinds = p.groupBy("product", "p_type", "p_size").agg(F.count("*").alias("n")).select("product", "n", dims.alias("attrs"))
    met = p.select("listing", "product", dims.alias("dims")).join(kinds, "product").where(blocking.conflicts(F.col("dims"), F.col("attrs")))
    return met.groupBy("listing").agg(F.sum("n").alias("n_conflicts"))


@query(f"""select p_partkey, concat('up:', substr(sha1(concat('unknown|', lower(p_brand), '|', lower(p_name), '|')), 1, 16)) as product,
concat('var:', substr(sha1(concat('up:', substr(sha1(concat('unknown|', lower(p_brand), '|', lower(p_name), '|')), 1, 16), '|size=', p_size, '|type=', lower(p_type))), 1, 16)) as variant from part""")
def entity_ids(spark, d):
    product = offers.product_id(F.lit("unknown"), F.col("p_brand"), F.col("p_name"), F.lit(None).cast("string"))
    dims = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    return t(spark, d, "part").select("p_partkey", product.alias("product"), offers.variant_id(product, dims).alias("variant"))


@query()
def token_components(spark, d):
    """Parts and suppliers that lines connect; compared with union-find in the tests, as a closure in SQL is quadratic."""
    return graph.components(t(spark, d, "lineitem").selectExpr("concat('p', l_partkey) as a", "concat('s', l_suppkey) as b"))


#: Every part is a request, and the parts are the catalog: three parts share an exact code, every second request names the whole code, all a token.
RESOLVE_SQL = """with p as (select p_partkey, p_name || '|' || p_brand as product, p_name || '|' || p_brand || '|' || p_type || '|' || p_size as variant, p_type, p_size, p_brand, split_part(p_name, ' ', 1) as w1, split_part(p_name, ' ', 2) as w2,
  case length(p_name) % 3 when 0 then 'unknown' else 'c' || (length(p_name) % 3) end as pcat, case when length(p_name) % 4 = 0 then substr(p_brand, 7) end as pgen from part),
prod as (select distinct product, pcat, pgen, w1 from p), v as (select distinct product, variant, p_type from p),
q as (select p_partkey as listing, case p_partkey % 3 when 0 then p_partkey // 3 when 2 then p_partkey // 3 + 1 end as pin, case when p_size % 2 = 0 then product end as code, w2 as token,
  case p_size % 3 when 0 then 'unknown' else 'c' || (p_size % 3) end as cat, case when p_size % 4 = 0 then cast(p_size as varchar) end as gen, p_type as type, p_partkey % 11 = 0 as secondary, case when p_partkey % 5 <> 0 then w1 end as fam from p),
pins as (select distinct q.listing, p.product, p.variant from q join p on q.pin = p.p_partkey // 3),
c as (select listing, product, max(strength) as strength, count(distinct variant) as np, max(named) as named from (select listing, product, variant, 3 as strength, 0 as named from pins union all select listing, code, null, 2, 1 from q where code is not null
  union all select q.listing, t.product, null, 1, 1 from q join (select distinct product, w2 from p) t on q.token = t.w2) group by 1, 2),
m as (select c.*, q.cat = 'unknown' or pcat = 'unknown' or q.cat = pcat as fits, coalesce(pgen <> q.gen, false) as clash, coalesce(prod.w1 <> q.fam, false) as other from c join q using (listing) join prod using (product)),
seen as (select listing, sum(np + named) as n_candidates, sum(case when fits then np + named else 0 end) as n_scored, count(*) filter (where fits and named = 1) as n_named from m group by 1),
tops as (select * from (select *, rank() over (partition by listing order by strength desc) as r from m where fits and not clash) where r = 1),
ch as (select listing, count(*) as best, max(strength) as top, min(product) as product, bool_or(strength = 3 and other) as copied from tops group by 1),
s as (select q.listing, q.type, q.secondary, coalesce(best, 0) as best, ch.product, coalesce(n_candidates, 0) as n_candidates, coalesce(n_scored, 0) as n_scored, coalesce(n_named, 0) as n_named,
  case when best = 1 and copied then 'copied code' when best = 1 then 'one product' when best > 1 and ch.top >= 2 then 'products differ' when best > 1 then 'weak tie' when coalesce(n_candidates, 0) = 0 then 'unknown' else 'dropped' end as prule
  from q left join ch using (listing) left join seen using (listing)),
f as (select s.listing, count(*) as nv, count(*) filter (where v.p_type = s.type) as viable, count(pins.variant) as pins, count(pins.variant) filter (where v.p_type = s.type) as fitting, min(v.variant) filter (where v.p_type = s.type) as v1,
  min(pins.variant) filter (where v.p_type = s.type) as pin1 from s join v on v.product = s.product left join pins on pins.listing = s.listing and pins.variant = v.variant where prule = 'one product' group by 1),
d as (select s.*, nv, viable, pins, v1, pin1, case when prule <> 'one product' then prule when secondary then 'secondary' when pins > 1 and fitting <> 1 then 'shared code' when fitting = 1 then 'pinned' when pins = 1 and viable > 1 then 'pin differs'
  when viable > 1 then 'several' when viable = 1 then 'fits' when pins = 1 then 'pin alone' else 'no variant' end as rule from s left join f using (listing))
select listing, rule, case when rule in ('pinned', 'fits') then 'MATCH' when rule = 'unknown' then 'NO_MATCH' else 'REVIEW' end as decision,
cast(case rule when 'pinned' then 0.95 when 'fits' then 0.9 when 'unknown' then 0.2 when 'dropped' then 0.4 else 0.5 end as double) as confidence,
case when prule = 'one product' and not secondary then product end as product, case rule when 'pinned' then pin1 when 'fits' then v1 end as variant, cast(n_candidates as bigint) as n_candidates, cast(n_scored as bigint) as n_scored,
cast(case when rule in ('copied code', 'products differ', 'weak tie') then best when rule = 'dropped' then n_named when rule in ('secondary', 'pin alone') then 1 when rule = 'shared code' then pins when rule = 'pin differs' then pins + viable
  when rule = 'several' then viable when rule = 'no variant' then nv else 0 end as bigint) as n_hypotheses from d"""


@query(RESOLVE_SQL)
def resolve_decisions(spark, d):
    """Read-only resolution with categories, generations, families and exact codes, from keys to decisions."""
    p = t(spark, d, "part").withColumns({
        "product": F.expr("concat(p_name, '|', p_brand)"), "variant": F.expr("concat(p_name, '|', p_brand, '|', p_type, '|', p_size)"), "w1": F.split_part("p_name", F.lit(" "), F.lit(1)), "w2": F.split_part("p_name", F.lit(" "), F.lit(2)),
    })
    category = lambda n: F.expr(f"case {n} % 3 when 0 then 'unknown' else concat('c', {n} % 3) end")
    listed = lambda when, value: F.filter(F.array(F.when(when, value)), lambda x: x.isNotNull())
    both = F.map_from_arrays(F.array(F.lit("type"), F.lit("size")), F.array("p_type", F.col("p_size").cast("string")))
    snap = {
        "products": p.select("product", category("length(p_name)").alias("category"), F.expr("case when length(p_name) % 4 = 0 then substr(p_brand, 7) end").alias("generation"), F.array("w1").alias("family")).distinct(),
        "variants": p.dropDuplicates(["product", "variant"]).select("product", "variant", both.alias("attrs")),
        "pins": p.select(F.expr("concat('gtin:', p_partkey div 3)").alias("key"), "product", "variant").distinct(),
        "codes": p.select(F.col("product").alias("key"), "product").distinct(), "tokens": p.select(F.col("w2").alias("key"), "product").distinct(),
    }
    asked = p.select(
        F.col("p_partkey").alias("listing"), category("p_size").alias("category"), F.expr("case when p_size % 4 = 0 then cast(p_size as string) end").alias("generation"), F.create_map(F.lit("type"), "p_type").alias("dims"),
        F.expr("case when p_partkey % 11 = 0 then 'accessory' else 'primary_product' end").alias("product_type"), listed(F.col("p_partkey") % 5 != 0, F.col("w1")).alias("family"),
        listed(F.col("p_partkey") % 3 != 1, F.expr("concat('gtin:', p_partkey div 3 + if(p_partkey % 3 = 2, 1, 0))")).alias("pin_keys"), listed(F.col("p_size") % 2 == 0, F.col("product")).alias("code_keys"), F.array("w2").alias("token_keys"),
    )
    out = resolve.decide(asked, *resolve.candidates(asked, snap), snap["variants"])
    return out.select("listing", "rule", "decision", "confidence", "product", "variant", "n_candidates", "n_scored", F.size("hypotheses").cast("long").alias("n_hypotheses"))


# ------------------------------------------------------------------ offers, checks, exports
#: A line is an observation of the offer of a part by a supplier; a discount over 0.08 is a condition of the price.
OBSERVED_SQL = """select l_suppkey || '-' || l_partkey as offer, l_partkey as variant, l_shipdate as observed_at, l_orderkey * 10 + l_linenumber as seq, l_extendedprice as price, l_discount, l_tax, l_quantity,
case when l_quantity > 45 then 'UNKNOWN' when l_returnflag = 'R' then 'NOT_COMPARABLE' when l_discount > 0.08 then 'CONDITIONAL' else 'COMPARABLE' end as comparability, l_linestatus = 'O' as active, l_orderkey as listing from lineitem"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "monthly_installment").otherwise(money.TOTAL)
    price = F.col("l_extendedprice")
    how = money.comparability(F.lit(None).cast("string"), F.when(F.col("l_quantity") <= 45, price), kind, F.when(F.col("l_discount") > 0.08, '{"coupon": true}'), F.lit("new"))
    return t(spark, d, "lineitem").select(F.expr("l_suppkey || '-' || l_partkey").alias("offer"), F.col("l_partkey").alias("variant"), F.col("l_shipdate").alias("observed_at"), F.expr("l_orderkey * 10 + l_linenumber").alias("seq"), price.alias("price"), how.alias("comparability"), (F.col("l_linestatus") == "O").alias("active"), F.col("l_orderkey").alias("listing"))


@query(f"select comparability, count(*) as n from ({OBSERVED_SQL}) group by 1")
def price_comparability(spark, d):
    return observations(spark, d).groupBy("comparability").agg(F.count("*").alias("n"))


@query(f"""with o as ({OBSERVED_SQL}) select offer, price, observed_at, n_observations from (select *, count(*) over (partition by offer) as n_observations, row_number() over (partition by offer order by observed_at desc, seq desc, price desc, comparability desc) as r from o) where r = 1""")
def offer_rollup(spark, d):
    return offers.roll_up(observations(spark, d)).select("offer", "price", "observed_at", "n_observations")


@query(f"""with o as ({OBSERVED_SQL}), l as (select * from (select *, row_number() over (partition by offer order by observed_at desc, seq desc, price desc, comparability desc) as r from o) where r = 1)
select variant, count(*) filter (where active) as n_active, case when count(*) filter (where active) = 0 then 'UNKNOWN' when bool_and(not active or comparability = 'COMPARABLE') then 'COMPARABLE' else 'CONDITIONAL' end as comparability,
min(price) filter (where active and comparability = 'COMPARABLE') as best_price from (select o.* exclude (active), a.active from l o join (select offer, bool_or(active) as active from o group by 1) a using (offer)) group by 1""")
def variant_comparability(spark, d):
    return offers.variant_comparability(offers.current(observations(spark, d)))


@query("select concat('of:', substr(sha1(concat(lower(trim(s_name)), '|', s_nationkey, '|new')), 1, 16)) as offer, s_suppkey from supplier")
def offer_ids(spark, d):
    return t(spark, d, "supplier").select(offers.offer_id(F.col("s_name"), F.col("s_nationkey").cast("string"), F.lit(None).cast("string")).alias("offer"), "s_suppkey")


@query("select variant, dim, n from (select p_name as variant, 'type' as dim, count(distinct lower(trim(p_type))) as n from part group by 1 union all select p_name, 'size', count(distinct p_size) from part group by 1) where n > 1")
def invariant_variant_safety(spark, d):
    p = t(spark, d, "part").select(F.col("p_name").alias("variant"), F.explode(F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))).alias("dim", "value"))
    return checks.variant_safety(p)


@query("select 'lost_customers' as \"check\", (select count(*) from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 20)) as violations union all select 'same_suppliers', (select count(*) from (select s_suppkey from supplier where s_suppkey not in (select l_suppkey from lineitem)))")
def referential_checks(spark, d):
    lost = checks.orphans(t(spark, d, "orders"), "o_custkey", t(spark, d, "customer").where("c_nationkey < 20"), "c_custkey", "lost_customers")
    return lost.unionAll(checks.same_ids(t(spark, d, "supplier"), t(spark, d, "lineitem").selectExpr("l_suppkey as s_suppkey").distinct(), "s_suppkey", "same_suppliers"))


@query("select string_agg(cast(doc_id as varchar), ',' order by cast(doc_id as varchar)) as members from documents group by md5(text) having count(*) > 1")
def copy_partitions(spark, d):
    rows = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("listing"), F.md5(F.col("text").cast("binary")).alias("cluster"))
    return checks.partitions(rows).where(F.col("members").contains(","))


@query("""with x as (select d.doc_id, case when l.quality = 1 then 'MATCH' else 'REVIEW' end as decision, d.lang as p, d.source as v from documents d join labels l using (doc_id)),
p as (select a.doc_id as a, b.doc_id as b, a.lang = b.lang as same_product, a.source = b.source as same_variant from documents a join documents b on b.doc_id = a.doc_id + 1)
select cast(p.a as varchar) as a, cast(p.b as varchar) as b, coalesce(x.decision = 'MATCH' and y.decision = 'MATCH' and (x.p = y.p) = p.same_product and (x.v = y.v) = p.same_variant, false) as passed from p join x on p.a = x.doc_id join x y on p.b = y.doc_id""")
def labelled_pairs(spark, d):
    docs, labels = t(spark, d, "documents"), t(spark, d, "labels")
    decisions = docs.join(labels, "doc_id").select(F.col("doc_id").cast("string").alias("source_record_id"), F.when(F.col("quality") == 1, "MATCH").otherwise("REVIEW").alias("decision"), F.col("lang").alias("universal_product_id"), F.col("source").alias("variant_id"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("b"), F.col("lang").alias("lang2"), F.col("source").alias("source2"))
    pairs = docs.join(other, "doc_id").select(F.col("doc_id").cast("string").alias("a"), F.col("b").cast("string").alias("b"), (F.col("lang") == F.col("lang2")).alias("same_product"), (F.col("source") == F.col("source2")).alias("same_variant"))
    return checks.pairs_agree(pairs, decisions)


@query("select 'intersection' as kind, (select count(*) from (select l_partkey from lineitem where l_quantity > 49 intersect select p_partkey from part where p_size < 10)) as n union all select 'difference', (select count(*) from (select l_partkey from lineitem where l_quantity > 49 except select p_partkey from part where p_size < 10)) union all select 'union', (select count(*) from (select l_partkey from lineitem where l_quantity > 49 union select p_partkey from part where p_size < 10))")
def candidate_set_operations(spark, d):
    a, b = t(spark, d, "lineitem").where("l_quantity > 49").selectExpr("l_partkey as k"), t(spark, d, "part").where("p_size < 10").selectExpr("p_partkey as k")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(a.intersect(b), "intersection").unionAll(count(a.select("k").exceptAll(b).distinct().join(b, "k", "left_anti"), "difference")).unionAll(count(a.union(b).distinct(), "union"))


@query("select 'parts' as entity, count(*) as n from part union all select 'suppliers', count(*) from supplier union all select 'observations', count(*) from lineitem union all select 'events', count(*) from events")
def catalog_stats(spark, d):
    count = lambda name, entity: t(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(entity).alias("entity"), "n")
    return count("part", "parts").unionAll(count("supplier", "suppliers")).unionAll(count("lineitem", "observations")).unionAll(count("events", "events"))


@query(f"select offer, array_to_string(list_sort(list(distinct listing)), ',') as sources, count(distinct listing) as n from ({OBSERVED_SQL}) group by 1")
def offer_sources(spark, d):
    """Listings behind each offer."""
    out = offers.roll_up(observations(spark, d))
    return out.select("offer", F.array_join(F.transform("listings", lambda x: x.cast("string")), ",").alias("sources"), F.size("listings").cast("long").alias("n"))


@query("select user_id % 3 as source, user_id as record, coalesce(max(case when event_type = 'signup' then event_id % 5 end), 0) + 1 as epoch from events group by 1, 2")
def next_epochs(spark, d):
    return state.next_epoch(t(spark, d, "events").selectExpr("user_id % 3 as source", "user_id as record", "case when event_type = 'signup' then event_id % 5 end as epoch"))


@query("""with p as (select case p_size % 3 when 0 then 'explicit' when 1 then 'normalized' else 'guessed' end as d, case when p_size % 2 = 0 then 'valid' else 'invalid' end as v from part)
select 'provenance_derivation' as "check", (select count(*) from (select unnest(['explicit', 'normalized', 'inferred']) except select d from p)) as violations union all select 'provenance_validity', (select count(*) from (select unnest(['invalid', 'conflicting']) except select v from p))""")
def provenance_vocabulary(spark, d):
    """Words that provenance lacks: here none is inferred and none conflicts."""
    return checks.vocabulary(t(spark, d, "part").selectExpr("case p_size % 3 when 0 then 'explicit' when 1 then 'normalized' else 'guessed' end as derivation", "if(p_size % 2 = 0, 'valid', 'invalid') as validity"))


@query("""with p as (select p_partkey // 4 as v, p_partkey % 3 = 0 as matched, p_partkey % 5 = 0 as colored, p_partkey % 4 = 1 as stored, case when (p_partkey // 4) % 7 = 0 then 'unheard' else 'phones' end as cat from part),
v as (select v, bool_or(matched and cat = 'phones') as needed, bool_or(colored) as colored, bool_or(stored) as stored from p group by 1)
select v as variant, 'carrier' as dim from v where needed and colored and v % 2 = 0 union all select v, 'storage_gb' from v where needed and stored and v % 3 = 0""")
def pinned_dimensions(spark, d):
    """Price-critical dimensions of matched phones that a listing asserts and the variant lacks."""
    dim = lambda when, key, value: F.when(F.expr(when), F.create_map(F.lit(key), F.lit(value))).otherwise(F.create_map().cast("map<string,string>"))
    rows = t(spark, d, "part").select(F.expr("if((p_partkey div 4) % 7 = 0, 'unheard', 'phones')").alias("category"), F.expr("if(p_partkey % 3 = 0, 'MATCH', 'REVIEW')").alias("decision"), F.expr("p_partkey div 4").alias("variant_id"), F.map_concat(dim("p_partkey % 5 = 0", "carrier", "x"), dim("p_partkey % 4 = 1", "storage_gb", "64")).alias("attributes"))
    variants = rows.select(F.col("variant_id").alias("id")).distinct().withColumn("attrs", F.map_concat(dim("id % 2 <> 0", "carrier", "x"), dim("id % 3 <> 0", "storage_gb", "64")))
    return checks.unpinned(rows, variants)


@query("""with a as (select o_custkey as record, o_orderkey as seq, prior, o_orderstatus as new from (select *, lag(o_orderstatus) over (partition by o_custkey order by o_orderkey) as prior from orders) where prior is not null and prior <> o_orderstatus)
select * from a where not exists (select 1 from orders o where o.o_custkey = a.record and o.o_orderkey < a.seq and o.o_orderstatus = a.prior and o.o_orderkey % 2 = 0)""")
def lost_assignments(spark, d):
    """Audited changes that no earlier observation explains, where observations of odd orders are missing."""
    rows = t(spark, d, "orders").selectExpr("o_custkey as record", "o_orderkey as seq", "o_orderstatus", "o_orderstatus as value")
    return checks.lost_assignments(state.assignment_audit(rows.drop("value"), F.col("o_orderstatus")), rows.where("seq % 2 = 0")).select("record", "seq", "prior", "new")


@query("""with p as (select *, cast(p_partkey as varchar) as k from part), r(section, id, document) as (
select 'normalized_listings', 'l' || k, '{"listing_id":"l' || k || '","source_record_id":"' || k || '","provenance":[{"value":"' || p_name || '","provenance_ref":"' || k || '-prov-0"},{"value":"' || p_type || '","provenance_ref":"' || k || '-prov-1"}]}' from p
union all select 'universal_products', 'p' || k, '{"id":"p' || k || '"}' from p union all select 'variants', 'v' || k, '{"id":"v' || k || '","product":"p' || k || '"}' from p union all select 'offers', 'o' || k, '{"id":"o' || k || '","variant":"v' || k || '"}' from p
union all select 'observations', 'o' || k || '|' || k, '{"offer":"o' || k || '","seq":' || k || '}' from p union all select 'resolution_decisions', 'l' || k, '{"listing_id":"l' || k || '","decision":"' || case when p_size % 2 = 0 then 'MATCH' else 'REVIEW' end || '"}' from p
union all select 'resolution_history', k || '|l' || k, '{"seq":' || k || ',"listing":"l' || k || '"}' from p where p_size % 3 = 0 union all select 'quarantine', 's|' || k || '|e' || k, '{"source":"s","source_record_id":"' || k || '","event_key":"e' || k || '"}' from p where p_size % 5 = 0
union all select 'stats', e, '{"entity":"' || e || '","n":' || n || '}' from (select e, case e when 'audit' then count(*) filter (where p_size % 3 = 0) when 'quarantine' then count(*) filter (where p_size % 5 = 0) when 'catalog_entity_count' then 3 * count(*) else count(*) end as n
  from part, unnest(['listing', 'product', 'variant', 'offer', 'observation', 'decision', 'audit', 'quarantine', 'catalog_entity_count']) as x(e) group by 1)) select * from r""")
def combined_document(spark, d):
    """An export in one table: listings with references of their provenance, missing decisions as abstentions, counts."""
    p = t(spark, d, "part").withColumn("k", F.col("p_partkey").cast("string"))
    id_ = lambda letter, name: F.concat(F.lit(letter), "k").alias(name)
    given = F.transform(F.array("p_name", "p_type"), lambda v: F.struct(v.alias("value"))).alias("provenance")
    tables = {
        "listing": p.select(id_("l", "listing_id"), F.col("k").alias("source_record_id"), given), "product": p.select(id_("p", "id")), "variant": p.select(id_("v", "id"), id_("p", "product")), "offer": p.select(id_("o", "id"), id_("v", "variant")),
        "observation": p.select(id_("o", "offer"), F.col("p_partkey").alias("seq")), "decision": p.select(id_("l", "listing_id"), F.expr("case when p_size % 2 = 0 then 'MATCH' end").alias("decision")), "audit": p.where("p_size % 3 = 0").select(F.col("p_partkey").alias("seq"), id_("l", "listing")),
    }
    return export.combined(tables, p.where("p_size % 5 = 0").select(F.lit("s").alias("source"), F.col("k").alias("source_record_id"), id_("e", "event_key")))


def committed(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Parts as a supplier's feed through the whole engine: log, adapters, components, fold."""
    from skein.operators import commit

    p = t(spark, d, "part").withColumn("title", F.expr(TITLE_SPARK))
    payload = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("record_id"), F.col("title").alias("product_name"), F.lit("Shop").alias("merchant"), F.concat(F.lit("S"), "p_partkey").alias("merchant_sku"), F.col("p_retailprice").cast("string").alias("sale_price"), F.lit("2024-01-01T00:00:00Z").alias("last_updated")))
    rows = E.from_records(p.select(payload.alias("record"), "p_partkey"), "affiliate_a", "b1").withColumn("seq", F.get_json_object("payload", "$.record_id").cast("long"))
    return commit.tables(commit.catalog(rows)["entities"])


@query()
def commit_catalog(spark, d):
    """Decisions by listing. They depend on the order of events, which SQL does not express."""
    return committed(spark, d)["decision"].select("source_record_id", "decision", "universal_product_id", "variant_id", "candidate_count")


#: A catalog of one listing, product, variant, offer, observation and decision a part, each check broken for some of them.
FAULTS = {
    "listing_ids": "p_partkey % 97 = 1", "raw_kept": "p_partkey % 89 = 2", "attributes_have_provenance": "p_partkey % 83 = 3", "category_set": "p_partkey % 79 = 4", "unknown_attributes_kept": "p_partkey % 73 = 5",
    "variants_have_products": "p_partkey % 71 = 6", "offers_have_variants": "p_partkey % 67 = 7", "offer_price_kind": "p_partkey % 61 = 8", "offer_comparability": "p_partkey % 59 = 9", "offer_seller_condition": "p_partkey % 53 = 10",
    "offer_sources": "p_partkey % 47 = 11", "offers_have_observations": "p_partkey % 43 = 12", "observation_event_key": "p_partkey % 41 = 13 and p_partkey % 43 <> 12", "conditional_has_terms_or_hint": "p_partkey % 37 = 14 and p_partkey % 43 <> 12",
    "installments_do_not_compare": "p_partkey % 31 = 15 and p_partkey % 37 <> 14 and p_partkey % 43 <> 12", "decision_kind": "p_partkey % 23 = 17 and p_partkey % 29 <> 16", "candidate_count": "p_partkey % 19 = 18 and p_partkey % 29 <> 16",
    "scored_are_candidates": "p_partkey % 17 = 0 and p_partkey % 29 <> 16", "match_has_signals": "p_partkey % 13 = 0 and p_partkey % 3 = 0 and p_partkey % 23 <> 17 and p_partkey % 29 <> 16",
    "review_has_no_variant": "(p_partkey % 3 <> 0 or p_partkey % 23 = 17) and (p_partkey % 3 = 0 or p_partkey % 11 = 0) and p_partkey % 29 <> 16",
    "ambiguity_has_hypotheses": "p_partkey % 3 = 1 and p_partkey % 23 <> 17 and p_partkey % 7 = 0 and p_partkey % 29 <> 16", "audit_complete": "p_partkey % 5 = 0 and (p_partkey % 2 = 0 or p_partkey % 3 = 0)",
}
CHECKS_SQL = " union all ".join(f"select '{c}' as \"check\", count(*) filter (where {bad}) as violations from part" for c, bad in FAULTS.items()) + """
union all select 'one_decision_a_listing', (select count(*) from (select case when p_partkey % 97 <> 1 then p_partkey end from part except all select p_partkey from part where p_partkey % 29 <> 16))
  + (select count(*) from (select p_partkey from part where p_partkey % 29 <> 16 except all select case when p_partkey % 97 <> 1 then p_partkey end from part))
union all select 'variant_safety', count(*) from (select p_partkey // 2 from part group by 1 having count(distinct p_size) > 1)"""


def faulty(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    p = t(spark, d, "part").withColumns({c: F.expr(bad) for c, bad in FAULTS.items()} | {"k": F.col("p_partkey").cast("string")})
    unless, texts, none = (lambda check, value: F.when(~F.col(check), value)), (lambda *v: F.array(*map(F.lit, v)).cast("array<string>")), F.array().cast("array<string>")
    kind = F.expr("case when p_partkey % 23 = 17 then 'MAYBE' when p_partkey % 3 = 0 then 'MATCH' when p_partkey % 3 = 1 then 'REVIEW' else 'NO_MATCH' end")
    decided = p.where("p_partkey % 29 <> 16")
    return {
        "listing": p.select(unless("listing_ids", F.col("k")).alias("listing_id"), F.col("k").alias("source_record_id"), unless("raw_kept", F.lit("{}")).alias("raw"), F.create_map(F.lit("storage_gb"), F.col("p_size").cast("string")).alias("attributes"),
            F.when(F.col("attributes_have_provenance"), none).otherwise(texts("note")).alias("provenance"), unless("category_set", F.lit("phones")).alias("category"), unless("unknown_attributes_kept", F.create_map(F.lit("a"), F.lit("b"))).alias("unknown_attributes"),
            F.expr("concat('v', p_partkey div 2)").alias("variant_id")),
        "product": p.where("not variants_have_products").select(F.concat(F.lit("p"), "k").alias("id")), "variant": p.select(F.concat(F.lit("v"), "k").alias("id"), F.concat(F.lit("p"), "k").alias("product")),
        "offer": p.select(F.concat(F.lit("o"), "k").alias("id"), F.when(F.col("offers_have_variants"), "lost").otherwise(F.concat(F.lit("v"), "k")).alias("variant"), unless("offer_price_kind", F.lit(money.TOTAL)).alias("price_kind"),
            F.when(F.col("offer_comparability"), "ODD").otherwise("COMPARABLE").alias("comparability"), unless("offer_seller_condition", F.lit("new")).alias("condition"), F.when(F.col("offer_sources"), none).otherwise(texts("r")).alias("records")),
        "observation": p.where("not offers_have_observations").select(F.concat(F.lit("o"), "k").alias("offer"), unless("observation_event_key", F.lit("e")).alias("event_key"), F.when(F.col("conditional_has_terms_or_hint"), "CONDITIONAL").otherwise("COMPARABLE").alias("comparability"),
            F.when(F.col("installments_do_not_compare"), "monthly_installment").otherwise(money.TOTAL).alias("price_kind"), unless("conditional_has_terms_or_hint", F.lit("{}")).alias("terms")),
        "decision": decided.select(F.col("k").alias("listing_id"), kind.alias("decision"), F.create_map(F.lit("token_index"), texts("a", "b")).alias("candidates"), F.when(F.col("candidate_count"), 3).otherwise(2).alias("candidate_count"),
            F.when(F.col("scored_are_candidates"), texts("z")).otherwise(texts("a")).alias("scored"), F.when(F.expr("p_partkey % 13 = 0"), none).otherwise(texts("s")).alias("positive"), F.when(F.expr("p_partkey % 3 = 0 or p_partkey % 11 = 0"), "v").alias("variant_id"),
            F.when(F.expr("p_partkey % 7 = 0"), none).otherwise(texts("h")).alias("hypotheses")),
        "audit": p.where("p_partkey % 5 = 0").select(F.when(F.expr("p_partkey % 2 <> 0"), F.col("k")).alias("listing"), F.when(F.expr("p_partkey % 3 <> 0"), "moved").alias("reason"), F.col("p_partkey").alias("seq")),
    }


@query(CHECKS_SQL)
def conformance_checks(spark, d):
    """Every check over a catalog with known faults."""
    return checks.conformance(faulty(spark, d))


@query()
def commit_conformance(spark, d):
    """Every check over the catalog that the whole engine makes of the parts; the tests expect no violation and no empty table."""
    return checks.conformance(committed(spark, d))


@query("select concat('affiliate_a', '') as source, count(*) as listings, count(*) as observations from part")
def commit_coverage(spark, d):
    """Every record has a listing, a decision and an observation."""
    made = committed(spark, d)
    seen = made["observation"].groupBy("listing").agg(F.count("*").alias("n"))
    met = made["listing"].join(made["decision"].select("listing_id"), "listing_id").join(seen, F.col("listing_id") == F.col("listing"))
    return met.groupBy("source").agg(F.count("*").alias("listings"), F.sum("n").alias("observations"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
