"""Queries over transports, envelopes and schema adapters: parts and events written as payloads, and what is read from them.

Payloads are templates of JSON text with expressions over the table's columns; the SQL states what each must give.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import identifiers
from skein.functions import text as T
from skein.operators.evidence import title_evidence
from skein.operators.graph import checkpointed
from skein.plans.registry import query, t
from skein.sources import events as E
from skein.sources import log
from skein.sources.adapters import extract

# Codes that a part carries: one blank, one malformed, one whole and one with a false check digit; a doubtful model number.
EAN = "case p_partkey % 4 when 0 then '' when 1 then '12345' when 2 then '4006381333931' else '4006381333930' end"
MPN = "case when p_partkey % 6 = 0 then 'M?1' else concat('m-', p_partkey) end"


def template(text: str) -> Column:
    """JSON text whose ``{{expression}}`` parts are filled in."""
    parts = re.split(r"\{\{(.*?)\}\}", text)
    return F.concat(*(F.expr(f"cast({p} as string)") if i % 2 else F.lit(p) for i, p in enumerate(parts)))


TEXTS = "record_id seller title brand condition availability product_type content_origin source_updated_at observed_at url merchant_sku".split()
PRICE = "amount list_price currency price_kind comparability terms validity raw source_field".split()
READ = ["p_partkey", "adapter", *TEXTS, "codes", "attrs", "nulls", *PRICE]


def read(spark: SparkSession, d: str, source: str, text: str) -> DataFrame:
    """What the adapters make of one payload a part; of attributes, those that the payload states outright."""
    x = checkpointed(extract(t(spark, d, "part").select("p_partkey", F.lit(source).alias("source"), template(text).alias("payload"))))
    lines = lambda array, *names: F.transform(array, lambda e: F.concat_ws(":", *(F.coalesce(e[n], F.lit("-")) for n in names)))
    stated = F.filter("x.attrs", lambda a: a["derivation"] == "explicit")
    shown = {
        "codes": F.array_join(lines(F.col("x.identifiers"), "ns", "canonical", "scope", "validity", "source_field"), ","),
        "attrs": F.array_join(F.array_sort(lines(stated, "key", "kind", "value", "source_field")), ","), "nulls": F.coalesce(F.array_join(F.array_sort("x.nulls"), ","), F.lit("")),
    }
    return x.select("p_partkey", "adapter", *(F.col(f"x.{c}") for c in TEXTS), *(v.alias(k) for k, v in shown.items()), *(F.col(f"x.money.{c}") for c in PRICE))


def wanted(sku: str | None, sku_field: str, gtin_field: str, mpn_field: str, mpn_first: bool = False, sku_scope: str = "merchant_offer", gtin_scope: str = "exact_variant", mpn_scope: str = "exact_variant", more: str = "", **values: str) -> str:
    """SQL of the rows that an adapter must give."""
    number = f"'merchant_sku:' || {sku} || ':{sku_scope}:valid:{sku_field},'" if sku else "''"
    gtin = f"case p_partkey % 4 when 0 then '' when 1 then 'gtin:-:{gtin_scope}:malformed:{gtin_field},' when 2 then 'gtin:04006381333931:{gtin_scope}:valid:{gtin_field},' else 'gtin:04006381333930:{gtin_scope}:checksum_invalid:{gtin_field},' end"
    mpn = f"case when p_partkey % 6 = 0 then 'mpn:-:{mpn_scope}:malformed:{mpn_field},' else 'mpn:M' || p_partkey || ':{mpn_scope}:valid:{mpn_field},' end"
    codes = " || ".join([number, *([mpn, gtin] if mpn_first else [gtin, mpn]), more or "''"])
    given = {"p_partkey": "p_partkey", "title": "p_name", "codes": f"rtrim({codes}, ',')", "attrs": "''", "nulls": "''", "condition": "'new'", "currency": "'USD'", "validity": "'valid'", "product_type": "'primary_product'", "price_kind": "'total_purchase_price'"} | values
    kind = lambda c: "double" if c in ("amount", "list_price") else "bigint" if c == "p_partkey" else "varchar"
    return "select " + ", ".join(f"cast({given.get(c, 'null')} as {kind(c)}) as {c}" for c in READ) + " from part"


@query(wanted(
    "'S' || p_partkey", "merchant_sku", "ean", "manufacturer_part_number", adapter="'affiliate_a:csv_v1'", record_id="'A' || p_partkey", title="p_name || ' ' || p_type", seller="'Shop ' || p_size", availability="'in stock'", content_origin="case when p_partkey % 2 = 0 then 'feed' end",
    condition="case when p_partkey % 8 = 0 then 'used' else 'new' end", source_updated_at="'2024-01-01T00:00:00Z'", observed_at="'2024-01-01T00:00:00Z'", url="'http://shop/x/' || p_partkey", merchant_sku="'S-' || p_partkey",
    amount="case p_partkey % 3 when 0 then p_size * 1000 + 0.5 when 2 then p_size end", list_price="p_size + 1.5", price_kind="case when p_partkey % 7 = 0 then 'monthly_installment' else 'total_purchase_price' end",
    terms="case p_partkey % 3 when 1 then '{\"promotion_text\":\"Free case\"}' when 2 then '{\"coupon\":true}' end", validity="case when p_partkey % 3 = 1 then 'invalid' else 'valid' end", raw="case p_partkey % 3 when 0 then '$' || p_size || ',000.50' when 1 then 'call us' else cast(p_size as varchar) end", source_field="'sale_price'",
))
def adapt_csv(spark, d):
    used = "if(p_partkey % 8 = 0, '\"condition\": \"used\", ', '')"
    return read(spark, d, "affiliate_a", '{"record_id": "A{{p_partkey}}", "product_name": "<b>{{p_name}}</b>  {{p_type}}", "merchant": "Shop {{p_size}}", "merchant_sku": "S-{{p_partkey}}", {{' + used + '}}"ean": "{{' + EAN + '}}", "manufacturer_part_number": "{{' + MPN + '}}", '
        "\"sale_price\": \"{{case p_partkey % 3 when 0 then concat('$', p_size, ',000.50') when 1 then 'call us' else string(p_size) end}}\", \"retail_price\": \"{{p_size + 1}}.50\", \"price_kind\": \"{{if(p_partkey % 7 = 0, 'monthly_installment', 'total_purchase_price')}}\", "
        r"""{{case p_partkey % 3 when 0 then '"promotion_text": "", ' when 1 then '"promotion_text": "Free case", ' else '"promotion_text": "{\\"coupon\\": true}", ' end}}"availability": "in stock", "upstream_origin": "{{if(p_partkey % 2 = 0, ' feed ', '  ')}}", "deep_link": "http://shop/x/{{p_partkey}}", "last_updated": "2024-01-01T00:00:00Z"}""")


@query(wanted(
    "'IT' || p_partkey", "item.merchantItemId", "item.identifiers.globalTradeItemNumber", "item.identifiers.manufacturerCode", gtin_scope="family", more="'style_code:ST' || p_partkey || ':style_colorway:valid:item.variant.style_code,'", adapter="'affiliate_b:feed_v3.7'", record_id="'F' || p_partkey", seller="'Net'",
    condition="'used'", availability="'low'", product_type="'accessory'", content_origin="'mirror'", source_updated_at="'2024-02-02'", observed_at="'2024-02-02'", url="'http://net/' || p_partkey", merchant_sku="'it-' || p_partkey", nulls="'size'",
    attrs="'boxed:boolean:true:item.variant.boxed,color:string:' || p_type || ':item.variant.color,dims:struct:{\"w\":1}:item.variant.dims,pack:number:' || p_size || ':item.variant.pack,style_code:string:st ' || p_partkey || ':item.variant.style_code,weight:number:' || p_size || '.5:item.variant.weight'",
    amount="p_size + 0.25", list_price="p_size + 1", currency="'EUR'", comparability="'conditional'", terms="'{\"code\":\"X' || p_partkey || '\"}'", raw="p_size || '.25'", source_field="'pricing.current'",
))
def adapt_feed(spark, d):
    return read(spark, d, "affiliate_b", '{"eventId": "F{{p_partkey}}", "advertiser": {"name": "Net"}, "trackingUrl": "http://net/{{p_partkey}}", "item": {"title": "{{p_name}}", "merchantItemId": "it-{{p_partkey}}", "identifiers": {"globalTradeItemNumber": "{{' + EAN + '}}", "manufacturerCode": "{{' + MPN + '}}"}, '
        '"variant": {"condition": "used", "color": "{{p_type}}", "pack": {{p_size}}, "weight": {{p_size}}.5, "boxed": true, "style_code": "st {{p_partkey}}", "size": null, "dims": {"w": 1}}}, "pricing": {"current": {{p_size}}.25, "original": {{p_size + 1}}, "currencyCode": "EUR", "promotion": {"code": "X{{p_partkey}}"}}, '
        '"semantics": {"productType": "accessory", "priceKind": "total_purchase_price", "comparabilityHint": "conditional", "identifierScopes": {"gtin": "family"}}, "contentLineage": "mirror", "stock": {"status": "low", "capturedAt": "2024-02-02"}}')


@query(wanted(
    "'C' || p_partkey", "sku", "product.barcode", "product.model", sku_scope="configurable_offer", adapter="'retailer_api:v1'", record_id="'R' || p_partkey", seller="'Store'", brand="p_brand", condition="'open'", availability="'A1'", content_origin="'first_party'", source_updated_at="'2024-03-03'", observed_at="'2024-03-03'",
    url="'http://store/p/' || p_partkey", merchant_sku="'c-' || p_partkey", attrs="'ram_gb:number:' || p_size || ':product.specifications.ram_gb'", nulls="'color'", amount="p_size", list_price="p_size + 5", comparability="''", terms="case when p_partkey % 2 = 1 then '{\"member\":true}' end", raw="p_size", source_field="'offer.price.amount'",
))
def adapt_retail(spark, d):
    return read(spark, d, "retailer_api", '{"observation_id": "R{{p_partkey}}", "store": {"display_name": "Store"}, "sku": "c-{{p_partkey}}", "product": {"name": "{{p_name}}", "brand": "{{p_brand}}", "barcode": "{{' + EAN + '}}", "model": "{{' + MPN + '}}", "specifications": {"ram_gb": {{p_size}}, "color": null, "condition": "open"}}, '
        '"product_url": "http://store/p/{{p_partkey}}", "observed_at": "2024-03-03", "offer": {"price": {"amount": {{p_size}}, "currency": "USD"}, "listPrice": {{p_size + 5}}, "availabilityCode": "A1", "terms": {{if(p_partkey % 2 = 0, \'{}\', \'{"member": true}\')}}}, '
        '"semantics": {"product_type": "primary_product", "content_origin": "first_party", "price_kind": "total_purchase_price", "comparability_hint": "", "identifier_scopes": {"merchant_sku": "configurable_offer"}}}')


@query(wanted(
    "'K' || p_partkey", "sku", "product.identity.codes.gtin", "product.identity.model", mpn_first=True, adapter="'retailer_api:2026-08-compact'", record_id="'K' || p_partkey", title="case when p_partkey % 3 = 0 then p_name else p_name || ' plus' end", seller="'Store'", brand="p_brand", condition="'refurbished'", availability="'yes'",
    content_origin="'first_party'", source_updated_at="'2024-04-04'", observed_at="'2024-04-04'", url="'http://store/k/' || p_partkey", merchant_sku="'k-' || p_partkey", attrs="'color:string:' || p_type || ':product.configuration[color],ram_gb:number:' || p_size || ':product.configuration[ram_gb]'",
    amount="cast(p_size * 100 + 99 as double) / 100", list_price="cast(p_size * 1000 + 999 as double) / 100", terms="'{\"bundle\":1}'", raw="p_size * 100 + 99", source_field="'offer.money.minorAmount'",
))
def adapt_compact(spark, d):
    return read(spark, d, "retailer_api", '{"schema_version": "2026-08-compact", "observation_id": "K{{p_partkey}}", "store": {"display_name": "Store"}, "sku": "k-{{p_partkey}}", "product": {"displayName": "{{if(p_partkey % 3 = 0, \'  \', concat(p_name, \' plus\'))}}", "name": "{{p_name}}", "identity": {"brand": "{{p_brand}}", "model": "{{' + MPN + '}}", '
        '"codes": {"GTIN": "{{' + EAN + '}}", "other": "1"}}, "configuration": [{"key": "color", "value": "{{p_type}}"}, {"key": "ram_gb", "value": {{p_size}}}, {"key": "condition", "value": "refurbished"}, {"key": "size", "value": null}]}, "product_url": "http://store/k/{{p_partkey}}", "observed_at": "2024-04-04", '
        '"offer": {"money": {"minorAmount": {{p_size}}99, "currency": "USD"}, "compareAtMinorAmount": {{p_size}}999, "availability": "yes", "context": {"bundle": 1}}, "semantics": {"productType": "primary_product", "priceKind": "total_purchase_price", "contentOrigin": "first_party"}}')


@query(wanted(
    None, "", "partial_identifiers.gtin", "partial_identifiers.mpn", adapter="'community_deals:v1'", record_id="'C' || p_partkey", seller="'M'", availability="'maybe'", content_origin="'user'", source_updated_at="'2024-05-05'", observed_at="'2024-05-05'", url="'http://deals/' || p_partkey",
    merchant_sku="case when p_partkey % 5 <> 0 then 'h-' || p_partkey end", attrs="'user_confidence:number:0.' || (p_partkey % 9 + 1) || ':user_confidence'", amount="case when p_partkey % 4 <> 0 then p_size end", list_price="p_size + 2", price_kind="'after_rebate'", comparability="'CONDITIONAL'",
    terms="'{\"rebate\":5,\"requirements\":' || case when p_partkey % 2 = 0 then '\"members only\"' else '{\"tier\":2}' end || case when p_partkey % 3 = 0 then '}' else ',\"coupon_code\":\"SAVE\"}' end", validity="case when p_partkey % 4 = 0 then 'invalid' else 'valid' end",
    raw="case when p_partkey % 4 = 0 then 'ask' else cast(p_size as varchar) end", source_field="'reported_price'",
).replace("rtrim('' ||", "rtrim(case when p_partkey % 5 <> 0 then 'merchant_sku:H' || p_partkey || ':merchant_offer:valid:merchant_hint_sku,' else '' end ||"))
def adapt_report(spark, d):
    return read(spark, d, "community_deals", '{"report_id": "C{{p_partkey}}", "title": "{{p_name}}", "merchant": "M", "merchant_hint_sku": "{{if(p_partkey % 5 = 0, \' \', concat(\'h-\', p_partkey))}}", "partial_identifiers": {"gtin": "{{' + EAN + '}}", "mpn": "{{' + MPN + '}}"}, "posted_at": "2024-05-05", "url": "http://deals/{{p_partkey}}", '
        '"availability_claim": "maybe", "reported_price": {{if(p_partkey % 4 = 0, \'"ask"\', string(p_size))}}, "usual_price": {{p_size + 2}}, "price_kind": "after_rebate", "comparability_hint": "CONDITIONAL", "offer_context": {"rebate": 5}, '
        r'''"requirements": "{{if(p_partkey % 2 = 0, 'members only', '{\\"tier\\": 2}')}}", "coupon_code": "{{if(p_partkey % 3 = 0, '', 'SAVE')}}", "user_confidence": 0.{{p_partkey % 9 + 1}}, "product_type": "primary_product", "content_origin": "user"}''')


@query(wanted(
    "'IT' || p_partkey", "page_url", "partial_identifiers.gtin", "partial_identifiers.mpn", mpn_scope="family", adapter="'extension_observations:0.9.x'", record_id="'X' || p_partkey", seller="'M'", availability="'in'", content_origin="'ext'", source_updated_at="'2024-06-06'", observed_at="'2024-06-06'",
    url="'http://shop/a/it-' || p_partkey || '?x=1'", merchant_sku="'it-' || p_partkey", attrs="'color:string:' || p_type || ':dom.selectedOptions.color'", amount="p_size * 1000 + 100", comparability="'COMPARABLE'", terms="'{\"card\":\"x\"}'", raw="'$' || p_size || ',100.00'", source_field="'dom.priceText'",
))
def adapt_capture(spark, d):
    return read(spark, d, "extension_observations", '{"capture_id": "X{{p_partkey}}", "merchant": "M", "page_url": "http://shop/a/it-{{p_partkey}}?x=1", "observed_at": "2024-06-06", "content_origin": "ext", "dom": {"title": "{{p_name}}", "selectedOptions": {"color": "{{p_type}}"}, "priceText": "${{p_size}},100.00", '
        '"priceKind": "total_purchase_price", "stockText": "in"}, "semantic_hints": {"productType": "primary_product", "comparability": "COMPARABLE", "identifierScopes": {"mpn": "family"}}, "partial_identifiers": {"gtin": "{{' + EAN + '}}", "mpn": "{{' + MPN + '}}"}, "offer_context": {"card": "x"}}')


@query(wanted(
    "case when p_partkey % 2 = 0 then 'B' else 'A' end || p_partkey", "url", "identifiers.gtin", "identifiers.mpn", adapter="'browser_resolve:v1'", record_id="'resolve-request'", brand="p_brand", condition="'used'", url="case when p_partkey % 2 = 0 then 'http://page/b-' else 'http://u/a-' end || p_partkey",
    merchant_sku="case when p_partkey % 2 = 0 then 'b-' else 'a-' end || p_partkey", attrs="'color:string:' || p_type || ':metadata.color'", amount="case when p_partkey % 3 = 0 then 7.5 else p_size end", raw="case when p_partkey % 3 = 0 then '$7.50' else cast(p_size as varchar) end", source_field="'price'",
).replace(":valid:url,' ||", ":valid:url,' || 'mpn:' || case when p_partkey % 6 = 0 then '-:exact_variant:malformed' else 'M' || p_partkey || ':exact_variant:valid' end || ':metadata.model,' ||"))
def adapt_browser(spark, d):
    return read(spark, d, "browser_resolve", '{"url": "{{if(p_partkey % 2 = 0, \' \', concat(\'http://u/a-\', p_partkey))}}", "page_url": "http://page/b-{{p_partkey}}", "title": "{{p_name}}", "price": "{{if(p_partkey % 3 = 0, \'\', string(p_size))}}", "observed_price": "$7.50", '
        '"metadata": {"brand": "{{p_brand}}", "model": "{{' + MPN + '}}", "condition": "used", "color": "{{p_type}}"}, "identifiers": {"gtin": "{{' + EAN + '}}", "mpn": "{{' + MPN + '}}"}}')


# ------------------------------------------------------------------ titles, values, codes
@query("""with p as (select *, (array[64, 128, 1024])[p_partkey % 3 + 1] as gb, 10 + p_size as n, p_partkey % 2 = 0 as even from part)
select p_partkey, u.key as key, u.kind as kind, u.value as value, u.raw as raw, u.derivation as derivation from p, unnest([
{'key': 'storage_gb', 'kind': 'number', 'value': case when gb = 1024 then '1000' else cast(gb as varchar) end, 'raw': gb || 'GB', 'derivation': 'normalized'}, {'key': 'storage_gb', 'kind': 'number', 'value': '2000', 'raw': '2 TB', 'derivation': 'normalized'},
{'key': 'ram_gb', 'kind': 'number', 'value': '8', 'raw': '8 gb ram', 'derivation': 'normalized'},
{'key': 'volume_ml', 'kind': 'number', 'value': case when even then cast(n as varchar) else '50' end, 'raw': case when even then n || ' ml' else '1.7 fl oz' end, 'derivation': case when even then 'normalized' else 'inferred' end},
{'key': 'size_us', 'kind': 'string', 'value': case when even then '9.5' else '10' end, 'raw': case when even then 'US 9.5' else 'us 10' end, 'derivation': 'normalized'},
{'key': 'department', 'kind': 'string', 'value': case when even then 'mens' else 'womens' end, 'raw': case when even then 'men''s' else 'women''s' end, 'derivation': 'normalized'},
{'key': 'screen_in', 'kind': 'number', 'value': case when even then '15.6' else '27' end, 'raw': case when even then '15.6 inch' else '27-inch' end, 'derivation': 'normalized'},
{'key': case when even then 'screen_in' end, 'kind': 'number', 'value': '15.6', 'raw': '15.6 inch', 'derivation': 'normalized'},
{'key': 'case_size_mm', 'kind': 'number', 'value': cast(n as varchar), 'raw': n || 'mm', 'derivation': 'normalized'},
{'key': case when even then 'bundle' end, 'kind': 'string', 'value': '3_pack', 'raw': '3-pack', 'derivation': 'normalized'},
{'key': 'bundle', 'kind': 'string', 'value': 'gift_set', 'raw': 'gift set', 'derivation': 'normalized'},
{'key': 'edition', 'kind': 'string', 'value': case when even then 'digital' else 'disc' end, 'raw': case when even then 'digital' else 'disc/optical' end, 'derivation': 'normalized'},
{'key': 'generation', 'kind': 'number', 'value': cast(2010 + p_size as varchar), 'raw': cast(2010 + p_size as varchar), 'derivation': 'normalized'},
{'key': 'formulation', 'kind': 'string', 'value': case when even then 'eau_de_parfum' else 'eau_de_toilette' end, 'raw': case when even then 'eau de parfum' else 'eau de toilette' end, 'derivation': 'normalized'},
{'key': 'color', 'kind': 'string', 'value': case when even then 'ocean blue' else 'black' end, 'raw': case when even then 'ocean blue' else 'blk' end, 'derivation': 'normalized'}]) as x(u) where u.key is not null""")
def title_measures(spark, d):
    """Every attribute that a title can state, with the words it is read from."""
    gb = "element_at(array(64, 128, 1024), cast(p_partkey % 3 + 1 as int))"
    even = template("red {{" + gb + "}}GB 16gb 8 gb ram 2 TB {{10 + p_size}} ml US 9.5 men's 15.6 inch {{10 + p_size}}mm 3-pack gift set digital {{2010 + p_size}} EDP ocean blue")
    odd = template("blk {{" + gb + "}}GB 8 gb ram 2 TB 1.7 fl oz us 10 women's 27-inch {{10 + p_size}}mm set with travel disc {{2010 + p_size}} eau de toilette")
    rows = title_evidence(t(spark, d, "part"), F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd), F.lit("title"), "p_partkey")
    return rows.select("p_partkey", "a.key", "a.kind", "a.value", "a.raw", "a.derivation")


@query("""select p_partkey, case when p_partkey % 2 = 0 then 'black' else lower(p_type) end as color, lower(p_type) || '_' || replace(p_name, ' ', '_') as other, case p_partkey % 3 when 0 then cast(p_size as varchar) when 1 then p_size || '.5' else '-' || p_size end as number from part""")
def canon_values(spark, d):
    """Canonical colours and other values, and numbers as text."""
    color = T.canonical_value(F.lit("color"), F.expr("if(p_partkey % 2 = 0, ' BLK', concat(p_type, ' '))"))
    number = T.plain_number(F.expr("case p_partkey % 3 when 0 then double(p_size) when 1 then p_size + 0.5D else -double(p_size) end"))
    return t(spark, d, "part").select("p_partkey", color.alias("color"), T.canonical_value(F.lit("type"), F.expr("concat(p_type, ' ', p_name, ' ')")).alias("other"), number.alias("number"))


@query("""select p_partkey, cast(case when p_partkey % 4 >= 2 then 1 else 0 end as bigint) as gtins, cast(case when p_partkey % 6 = 0 then 0 else 1 end as bigint) as mpns, p_partkey % 4 = 3 as failed, p_partkey % 5 = 0 as configurable from part""")
def usable_codes(spark, d):
    """Codes that may be looked up, whether a check digit fails, whether the number names several configurations."""
    code = lambda ns, raw, scope="null": F.expr(f"named_struct('ns', '{ns}', 'raw', {raw}, 'scope', cast({scope} as string), 'field', '{ns}')")
    given = F.filter(F.array(code("gtin", EAN), code("mpn", MPN), code("merchant_sku", "cast(p_partkey as string)", "if(p_partkey % 5 = 0, 'configurable_offer', null)")), lambda c: c["raw"] != "")
    rows = t(spark, d, "part").select("p_partkey", F.transform(given, identifiers.from_code).alias("ids"))
    n = lambda ns: F.size(identifiers.usable(F.col("ids"), ns)).cast("long")
    return rows.select("p_partkey", n("gtin").alias("gtins"), n("mpn").alias("mpns"), identifiers.has_checksum_failure(F.col("ids")).alias("failed"), identifiers.configurable(F.col("ids")).alias("configurable"))


# ------------------------------------------------------------------ transports, envelopes, deliveries
@query("""select s_suppkey, cast(o as int) as ord, case when o = 0 then '{"id":' || s_suppkey || '}' else '{"id":"b","name":"' || s_name || '"}' end as record from supplier, unnest([0, 1]) as x(o) where s_suppkey % 5 < 3""")
def unwrap_records(spark, d):
    """Records of documents: under a known key, bare, and none in documents that hold no array or do not parse."""
    array = '[{"id": {{s_suppkey}}}, {"name": "{{s_name}}", "id": "b"}]'
    shapes = ['{"note": "x", "items": ' + array + "}", array, '{"deals": ' + array + ', "items": {}}', '{"rows": ' + array + "}", "[{"]
    doc = F.coalesce(*(F.when(F.col("s_suppkey") % 5 == i, template(s)) for i, s in enumerate(shapes)))
    return E.unwrap(t(spark, d, "supplier").select("s_suppkey", doc.alias("value"))).select("s_suppkey", "ord", "record")


ENVELOPES = """{{case event_type when 'click' then '{"event_id": 7, "payload": ' when 'view' then '{"operation": "patch", "update_mode": "partial_patch", "batch_id": "b9", "payload": ' when 'error' then '{"event_id": "e", "payload": null, "was": ' else '{"id": ' end}}{"k": {{event_id}}}}"""


@query("select case when event_type in ('click', 'view') then event_type else 'other' end as kind, event_type in ('click', 'view', 'error') as shaped, count(*) as n from events group by 1, 2")
def event_shapes(spark, d):
    """Which records are events with an envelope of their own; a null payload is there all the same."""
    kind = F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("other")
    return t(spark, d, "events").select(kind.alias("kind"), E.event_shaped(template(ENVELOPES)).alias("shaped")).groupBy("kind", "shaped").agg(F.count("*").alias("n"))


@query("""select payload, case when event_type = 'click' then '7' end as event_id, case when event_type = 'click' then 'upsert' else 'patch' end as operation, case when event_type = 'view' then 'partial_patch' end as update_mode, case when event_type = 'view' then 'b9' else 'b1' end as batch_id, 'withdraw' as null_semantics
from (select event_type, '{"k":' || event_id || '}' as payload from events where event_type in ('click', 'view')) union all select 'rejected', null, cast(count(*) as varchar), null, null, null from events where event_type not in ('click', 'view')""")
def event_envelopes(spark, d):
    """Envelopes of events with their defaults; events without a payload are rejected and counted."""
    taken, rejected = E.from_events(t(spark, d, "events").select(template(ENVELOPES).alias("record")), "b1")
    none = F.lit(None).cast("string")
    lost = rejected.agg(F.count("*").cast("string").alias("operation")).select(F.lit("rejected").alias("payload"), none.alias("event_id"), "operation", none.alias("update_mode"), none.alias("batch_id"), none.alias("null_semantics"))
    return taken.select("payload", "event_id", "operation", "update_mode", "batch_id", "null_semantics").unionAll(lost)


@query("""select 'request' as source, 'b1' as batch_id, 'upsert' as operation, 'withdraw' as null_semantics, 'explicit' as update_mode, p_name as payload, count(*) as n from part group by p_name""")
def request_envelopes(spark, d):
    """Records under one envelope: defaults where the request says nothing."""
    rows = E.from_records(t(spark, d, "part").selectExpr("p_name as record"), "request", "b1", update_mode="explicit")
    return rows.groupBy("source", "batch_id", "operation", "null_semantics", "update_mode", "payload").agg(F.count("*").alias("n"))


DELIVERED = ["l_orderkey * 100 + l_linenumber as seq", "l_partkey", "l_suppkey % 3 as h", "l_orderkey % 2 = 0 as named", "l_orderkey // 10 as request"]


@query(f"""with r as (select {", ".join(DELIVERED)}, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) as nth, l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_quantity from lineitem),
s as (select *, lag(h) over (partition by request order by seq, l_partkey) as prior from r where named and nth = 1)
select request, count(*) filter (where h = prior) as repeated, count(*) as n from s group by 1""")
def idempotent_deliveries(spark, d):
    """Deliveries that repeat the payload last stored under their idempotency key."""
    rows = t(spark, d, "lineitem").selectExpr(*(c.replace("//", "div") for c in DELIVERED), "concat(l_orderkey, '-', l_linenumber) as event_key", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    given = rows.select("event_key", F.col("h").cast("string").alias("payload_hash"), F.struct("seq", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity").alias("seq"), F.when(F.col("named"), F.concat(F.lit("r"), "request")).alias("idempotency_key"), F.lit("r").alias("record_id"), "request")
    once = F.row_number().over(Window.partitionBy("event_key").orderBy("seq"))
    out = log.classify(given.withColumn("nth", once)).where("nth = 1 and idempotency_key is not null")
    return out.groupBy("request").agg(F.count_if(F.col("status") == "duplicate").alias("repeated"), F.count("*").alias("n"))


@query("""with e as (select *, case event_type when 'click' then 'conflict' when 'view' then 'duplicate' else 'new' end as status from events), q as (select *, case when status = 'conflict' then 'event_id_payload_conflict' when status = 'duplicate' then null when event_type = 'error' then 'no_adapter_for_schema' when event_id % 3 = 0 then 'missing_source_record_id' end as reason from e)
select coalesce(reason, 'none') as reason, count(*) as received, count(*) filter (where status = 'new' and reason is null) as accepted, count(*) filter (where status = 'duplicate') as duplicates, count(*) filter (where reason is not null) as quarantined, count(*) filter (where status = 'new' and reason is null and event_type = 'signup') as corrected from q group by 1""")
def ingest_counters(spark, d):
    """Why deliveries are quarantined, and the counters of each reason."""
    rows = t(spark, d, "events").withColumn("status", F.expr("case event_type when 'click' then 'conflict' when 'view' then 'duplicate' else 'new' end")).withColumn("mode", F.when(F.col("event_type") == "signup", "authoritative_correction"))
    x = F.struct(F.expr("case event_id % 6 when 0 then null when 3 then ' ' else 'r' end").alias("record_id"))
    rows = checkpointed(rows.withColumn("reason", log.reason(F.col("status"), F.when(F.col("event_type") != "error", "a"), x)))
    kinds = ["none", "event_id_payload_conflict", "no_adapter_for_schema", "missing_source_record_id"]
    each = [log.counters(rows.where(F.coalesce("reason", F.lit("none")) == k)).select(F.lit(k).alias("reason"), "*") for k in kinds]
    return each[0].unionAll(each[1]).unionAll(each[2]).unionAll(each[3]).where("received > 0")
