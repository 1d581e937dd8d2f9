"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from skein.llm.ann import op9_ann
from skein.llm.embed_dedup import op10_embed_dedup
from skein.llm.language import op5_language
from skein.llm.mixing import op3_mixing
from skein.llm.packing import op2_packing
from skein.llm.quality import op4_quality
from skein.llm.secrets import op6_secrets
from skein.llm.sharding import op7_sharding
from skein.llm.simhash import op1_simhash
from skein.llm.suffix_dedup import op8_suffix_dedup


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_packing, op3_mixing, op4_quality, op5_language, op6_secrets, op7_sharding, op8_suffix_dedup, op9_ann, op10_embed_dedup)}


#: Without floating-point results; the links' cosines are SQL's own.
OP10 = """with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
r as (select vec_id as node, vec_id as reach from embeddings union select r.node, p.b from r join p on r.reach = p.a),
c as (select node, min(reach) as component_id from r group by 1), n as (select a, count(*) as n from p group by 1)
select vec_id, coalesce(n.n, 0) as n_links, c.component_id, vec_id = c.component_id as kept from embeddings join c on c.node = vec_id left join n on n.a = vec_id"""


def oracle_sql() -> dict[str, str]:
    """Of the ten, SQL expresses operator 10's result within reason; the others have models, tokenizers, hashes or floats of their own."""
    return {"op10_embed_dedup": OP10}
