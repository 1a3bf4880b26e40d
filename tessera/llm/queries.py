"""The queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.encoding import encode
from tessera.llm.mojibake import restore
from tessera.llm.near_duplicates import NearParams, link_counts, near_duplicates, same_file
from tessera.llm.neighbours import nearest_vectors, similar_pairs
from tessera.llm.packing import fill_containers
from tessera.llm.pairs import defective, languages
from tessera.llm.scans import find_noise, repair_pages
from tessera.llm.splitting import SplitParams, split_fields
from tessera.llm.survivors import best_representatives, pdf_candidates
from tessera.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(nearest_vectors(table(spark, sf_dir, "chunk_vectors"), "vec_id", "dense", k=10), 0.9)


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of the stated query set, every vector whose id is divisible by 20, against all vectors."""
    near = nearest_vectors(table(spark, sf_dir, "chunk_vectors"), "vec_id", "dense", k=10).filter("id % 20 = 0")
    return near.select(F.col("id").alias("vec_id"), "neighbour", F.round("cosine", 6).alias("cosine"), "rank")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"section_nodes": ("node_id", {"text": 1330}), "chunks": ("chunk_id", {"text": 1330, "parent_text": 4900})}
    out = []
    for name, (key, limits) in parts.items():
        pieces = split_fields(table(spark, sf_dir, name), [key], {f: SplitParams(n) for f, n in limits.items()})
        out.append(pieces.select(F.lit(name).alias("item_table"), F.col(key).alias("item_id"), "field", "piece_no", "start", "end", "text"))
    return reduce(DataFrame.unionByName, out)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).filter("piece_no = 0").select("item_table", "item_id", "field").distinct()


def p3_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pdf_candidates(*(table(spark, sf_dir, t) for t in ("pdf_candidates", "source_pages", "doc_families")))
    return best_representatives(rows, "path", "cand_id", "trust", "fetched_at", ["family", "protocol", "doc_date"])


def p3_undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivors if every fifth row had lost its timestamp; which values are usable is judged before."""
    rows = pdf_candidates(*(table(spark, sf_dir, t) for t in ("pdf_candidates", "source_pages", "doc_families")))
    rows = rows.withColumn("fetched_at", F.when(F.col("cand_id") % 5 != 0, F.col("fetched_at")))
    return best_representatives(rows, "path", "cand_id", "trust", "fetched_at", ["family", "protocol", "doc_date"]).withColumnRenamed("id", "cand_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_survivors(spark, sf_dir).select("group_id", "field", F.col("id").alias("cand_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    alike, meta = NearParams(threshold=0.75), table(spark, sf_dir, "document_meta")
    parts = {
        "chunk": near_duplicates(table(spark, sf_dir, "chunks"), "chunk_id", "text", 40, alike),
        "note": near_duplicates(meta, "doc_id", "version_note", 20, alike),
        "file": same_file(meta, "doc_id", "sha256", alike),
    }
    return reduce(DataFrame.union, [df.select(F.lit(kind).alias("kind"), F.col("a").alias("key_a"), F.col("b").alias("key_b")) for kind, df in parts.items()])


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(table(spark, sf_dir, "chunks"), "chunk_id", "text", 40, NearParams(threshold=0.75))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = languages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return defective(table(spark, sf_dir, "answers"), "answer_id", "question", "answer", model)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_noise(table(spark, sf_dir, "parsed_documents"), "doc_id", "page_texts")


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_pages(table(spark, sf_dir, "parsed_documents"), "doc_id", "page_texts")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = encode(table(spark, sf_dir, "documents"), "doc_id", "text", sizes_only=True)
    return fill_containers(sizes, "doc_id", "n_tokens", 2048)


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_restored(spark, sf_dir).select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_pieces, p3_found, p3_survivors, p3_undated, p4_found, p4_links, p5_found, p6_found, p6_repaired, p7_ids, p8_containers, p9_found, p9_restored)}


_SPACES = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(5760)||" + "||".join(f"chr({p})" for p in (*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

_P1 = """
with v as (select vec_id, list_transform(dense, lambda e: cast(e as double)) as d from chunk_vectors
  where len(dense) = 64 and len(list_filter(dense, lambda e: e is not null and isfinite(e))) = 64 and len(list_filter(dense, lambda e: e <> 0)) > 0),
u as (select vec_id, d, sqrt(list_dot_product(d, d)) as l from v),
s as (select a.vec_id, b.vec_id as neighbour, round(list_dot_product(a.d, b.d) / a.l / b.l, 12) as c from u a, u b where ASKED and a.vec_id <> b.vec_id),
near as (select vec_id, neighbour, c, cast(row_number() over (partition by vec_id order by c desc, neighbour) as int) as rank from s qualify rank <= 10)
"""

_P1_NEIGHBOURS = _P1.replace("ASKED", "a.vec_id % 20 = 0") + "select vec_id, neighbour, round(least(c, 1), 6) as cosine, rank from near"
_P1_FOUND = _P1.replace("ASKED", "true") + "select distinct least(vec_id, neighbour) as vec_a, greatest(vec_id, neighbour) as vec_b from near where c >= 0.9"

_P2 = f"""
select distinct item_table, item_id, field from (
  select 'section_nodes' as item_table, node_id as item_id, 'text' as field, text as t, 1330 as most from section_nodes
  union all select 'chunks', chunk_id, 'text', text, 1330 from chunks
  union all select 'chunks', chunk_id, 'parent_text', parent_text, 4900 from chunks
) where length(trim(t, {_SPACES})) > most
"""

_P3 = rf"""
with paths as (
  select *, regexp_replace('/' || url_decode(replace(regexp_replace(regexp_replace(trim(url, {_SPACES}),
    '^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*', ''), '[?#].*$', '', 's'), '+', '%2B')), '/+', '/', 'g') as path from pdf_candidates
), rows_ as (
  select path, cand_id, fetched_at, coalesce((select max(coalesce(trust, 0)) from source_pages p where p.source_page = c.source_page), 0) as trust,
    case when lower(trim(family, {_SPACES})) in (select lower(trim(family_key)) from doc_families) then lower(trim(family, {_SPACES})) end as family,
    case when protocol between 10 and 9999 then cast(protocol as varchar) end as protocol,
    case when doc_date between date '2000-01-01' and cast(fetched_at as date) then cast(doc_date as varchar) end as doc_date
  from paths c where url is not null
), groups as (
  select path, min(cand_id) as group_id from rows_ group by path having count(distinct cand_id) > 1
), fields as (
  select path, cand_id, fetched_at, trust, 'family' as field, family as value from rows_ where family is not null
  union all select path, cand_id, fetched_at, trust, 'protocol', protocol from rows_ where protocol is not null
  union all select path, cand_id, fetched_at, trust, 'doc_date', doc_date from rows_ where doc_date is not null
)
"""

_P3_SURVIVORS = _P3 + """
select group_id, field, id, value from (
  select g.group_id, f.field, f.cand_id as id, f.value, row_number() over (partition by g.path, f.field order by trust desc, fetched_at desc nulls last, f.cand_id desc) as n
  from fields f join groups g on f.path = g.path
) where n = 1
"""

_P3_UNDATED = _P3 + """, l as (select distinct path, field, value, cand_id, trust, case when cand_id % 5 <> 0 then fetched_at end as tm from fields),
seen as (select path, field, value, max(tm) as last from l where tm is not null group by all),
steps as (select field, value as v, lead(value) over (partition by path, field order by last, value) as w from seen),
votes as (select field, v, w, sum(n) as n from (select field, v, w, 1 as n from steps where w is not null union all select field, w, v, -1 from steps where w is not null) group by all having sum(n) > 0),
top as (select l.* from l join (select path, field, max(trust) as trust from l group by all) using (path, field, trust)),
vals as (select path, field, value, max(tm) as tm, arg_max(cand_id, {'tm': coalesce(tm, timestamp '1000-01-01'), 'id': cand_id}) as cand_id, bool_or(tm is null) as undated from top group by all),
easy as (select path, field, cand_id, value from vals qualify row_number() over (partition by path, field order by tm desc, cand_id desc) = 1 and not bool_or(undated) over (partition by path, field)),
hard as (select * from vals qualify bool_or(undated) over (partition by path, field)),
both_ as (select a.path, a.field, a.value as v, b.value as w, a.tm as at_v, b.tm as at_w from hard a join hard b on a.path = b.path and a.field = b.field and a.value <> b.value),
asked as (select distinct field, v, w from both_),
ways as (select a.*, 1 as hop, n from asked a join votes using (field, v, w) union all
  select a.field, a.v, a.w, 2, max(least(x.n, y.n)) from asked a join votes x on x.field = a.field and x.v = a.v and x.w <> a.w join votes y on y.field = a.field and y.v = x.w and y.w = a.w group by all),
way as (select field, v, w, min(hop) as hop, arg_min(n, hop) as n from ways group by all),
known as (select a.field, a.v, a.w from way a left join way b on a.field = b.field and a.v = b.w and a.w = b.v where b.hop is null or a.hop < b.hop or (a.hop = b.hop and a.n > b.n)),
edges as (select b.* from both_ b left join known k using (field, v, w) where case when at_v is not null and at_w is not null then at_v < at_w else k.field is not null end),
ranked as (select h.*, (select count(*) from edges e where e.path = h.path and e.field = h.field and e.v = h.value) as after, (select count(*) from edges e where e.path = h.path and e.field = h.field and e.w = h.value) as before from hard h),
best as (select path, field, cand_id, value from easy union all select path, field, cand_id, value from ranked qualify row_number() over (partition by path, field order by after, before desc, tm desc nulls last, cand_id desc) = 1)
select group_id, field, cand_id, value from best join groups using (path)
"""

_P4 = r"""
with t as (select distinct 'chunk' as kind, chunk_id as id, text, 40 as least from chunks where chunk_id is not null union all select distinct 'note', doc_id, version_note, 20 from document_meta where doc_id is not null),
w as (select kind, id, text, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as w, least from t where text is not null),
s as (select *, len(w) as n from w where len(w) >= least),
"""

_P4_FOUND = _P4 + r"""
alike as (select a.kind, a.id as key_a, b.id as key_b from s a join s b on a.kind = b.kind and a.id < b.id and a.n >= 0.75 * b.n and b.n >= 0.75 * a.n
  where len(list_intersect(a.w, b.w)) >= 0.75 * (a.n + b.n - len(list_intersect(a.w, b.w)))),
h as (select distinct doc_id as id, regexp_replace(trim(lower(sha256)), '^[^0-9a-z]*sha-?256[^0-9a-f]*', '') as bare from document_meta where doc_id is not null),
f as (select id, case when length(regexp_replace(bare, '[^0-9a-f]', '', 'g')) = 64 then regexp_replace(bare, '[^0-9a-f]', '', 'g') else bare end as v from h where bare is not null)
select * from alike union all select 'file', a.id, b.id from f a join f b on a.v = b.v and a.id < b.id where a.v <> ''
"""

_P4_LINKS = _P4 + r"""
c as (select min(id) as class_id, text, any_value(w) as w, any_value(n) as n, count(*) as copies from s where kind = 'chunk' group by text),
l as (select a.class_id, count(*) as links from c a join c b on a.class_id <> b.class_id and a.n >= 0.75 * b.n and b.n >= 0.75 * a.n where len(list_intersect(a.w, b.w)) >= 0.75 * (a.n + b.n - len(list_intersect(a.w, b.w))) group by 1)
select s.id as chunk_id, c.class_id, c.copies, coalesce(l.links, 0) as links from s join c using (text) left join l using (class_id) where s.kind = 'chunk'
"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": _P4_FOUND, "p4_links": _P4_LINKS, "p1_found": _P1_FOUND, "p1_neighbours": _P1_NEIGHBOURS, "p2_found": _P2, "p3_found": f"select group_id, field, id as cand_id from ({_P3_SURVIVORS})", "p3_survivors": _P3_SURVIVORS, "p3_undated": _P3_UNDATED}
