"""The queries over the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.functions import links as L
from tessera.functions import text as T
from tessera.functions.space import _POINTS, trimmed
from tessera.operators import answering, catalog, chunking, cleaning, evaluation, history, ranking, reporting, search, store, structure
from tessera.runtime import spool, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

WS = "||".join(f"chr({p})" for p in _POINTS)
#: Unicode white space as a class of the oracle's regular expressions.
US = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql.replace("{WS}", WS).replace("{US}", US)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q2_search(spark, sf_dir)


# Scalar functions


@query(r"""select doc_id, array_to_string(list_transform(string_split(translate(text, chr(160)||chr(13), ' '||chr(10)), chr(10)),
  lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'), {WS})), chr(10)) as text from documents""")
def f1_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


_JOIN = r"regexp_replace({}, '([а-яёa-z])-[\s\x{a0}]*\n[\s\x{a0}]*([а-яё])', '\1\2', 'g')"


@query(f"""with p as (select distinct doc_id, unnest(page_texts) as t, generate_subscripts(page_texts, 1) as page_no from parsed_documents)
select doc_id, page_no, {_JOIN.replace('{}', _JOIN.replace('{}', "replace(coalesce(t, ''), chr(173), '')"))} as text from p""")
def f2_hyphenation(spark, d):
    pages = cleaning.pages_of(table(spark, d, "parsed_documents").dropDuplicates(["doc_id"]))
    return pages.select("doc_id", F.col("page_no").cast("long").alias("page_no"), T.fix_hyphenation(F.col("text")).alias("text"))


@query("""select distinct node_id, case when nullif(number, '') is not null and level >= 1 then 'п. ' || number
  when nullif(number, '') is not null then 'Раздел ' || number else coalesce(nullif(title, ''), node_id) end as label from section_nodes""")
def f6_labels(spark, d):
    return table(spark, d, "section_nodes").select("node_id", structure.node_label().alias("label")).distinct()


@query("""select distinct chunk_id, concat_ws(', ', doc_title, 'п. ' || nullif(clause, ''), 'стр. ' || nullif(page, 0)) as ref,
  cast(floor(length(text) / 3.5) as int) as tokens, left(coalesce(nullif(parent_text, ''), text), 600) as snippet from chunks""")
def f7_references(spark, d):
    c = table(spark, d, "chunks")
    return c.select("chunk_id", T.reference(F.col("doc_title"), F.col("clause"), F.col("page")).alias("ref"), T.token_estimate(F.col("text")).alias("tokens"), T.snippet(F.col("parent_text"), F.col("text")).alias("snippet")).distinct()


@query("""select chunk_id, h[1:8]||'-'||h[9:12]||'-5'||h[14:16]||'-'||substr('89ab', cast(('0x'||h[17:17])::int & 3 as int) + 1, 1)||h[18:20]||'-'||h[21:32] as point_id, md5(text) as content_hash from (
  select distinct chunk_id, text, sha1(unhex('6a9c1e00000040008000000000000000') || encode(chunk_id)) as h from chunks)""")
def f13_point_ids(spark, d):
    return table(spark, d, "chunks").select("chunk_id", T.uuid5(F.col("chunk_id")).alias("point_id"), F.md5("text").alias("content_hash")).distinct()


@query(r"""with l as (select doc_id, translate(lower(trim(title, {WS})), 'абвгдеёзийклмнопрстуфцыэ', 'abvgdeeziyklmnoprstufcye') as t from documents),
d as (select doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(t, 'ж', 'zh'), 'х', 'h'), 'ч', 'ch'), 'щ', 'sch'), 'ш', 'sh'), 'ъ', ''), 'ь', ''), 'ю', 'yu'), 'я', 'ya') as t from l)
select doc_id, coalesce(nullif(left(trim(regexp_replace(regexp_replace(t, '[^a-z0-9-]+', '_', 'g'), '_+', '_', 'g'), '_'), 60), ''), 'document') as slug from d""")
def f16_slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", T.slugify(F.col("title")).alias("slug"))


@query(r"""with n as (select distinct cand_id, url, regexp_extract(regexp_replace(url, '[?#].*$', '', 's'), '([^/]*)$', 1) as tail from pdf_candidates),
f as (select cand_id, coalesce(try(url_decode(replace(tail, '+', '%2B'))), tail) as name from n)
select distinct cand_id, name, cast(nullif(regexp_extract(name, '(?i)protokol[_\-\s]*(\d{2,4})', 1), '') as int) as protocol,
  coalesce(list_filter(list_transform(regexp_extract_all(name, '\d{2}[._\-]\d{2}[._\-]\d{4}'), lambda x: try_cast(x[7:10]||'-'||x[4:5]||'-'||x[1:2] as date)), lambda x: year(x) between 2000 and 2100)[1],
    list_filter(list_transform(regexp_extract_all(name, '\d{4}[._\-]\d{2}[._\-]\d{2}'), lambda x: try_cast(x[1:4]||'-'||x[6:7]||'-'||x[9:10] as date)), lambda x: year(x) between 2000 and 2100)[1],
    list_filter(list_transform(regexp_extract_all(name || ' ', '\d{2}[._\-]\d{2}[._\-]\d{2}\D'), lambda x: try_cast('20'||x[7:8]||'-'||x[4:5]||'-'||x[1:2] as date)), lambda x: year(x) between 2000 and 2100)[1]) as named_date from f""")
def f17_link_facts(spark, d):
    name = L.file_name(F.col("url"))
    return table(spark, d, "pdf_candidates").select("cand_id", name.alias("name"), L.protocol(name).alias("protocol"), L.date_in(name).alias("named_date")).distinct()


@query(r"""select distinct chunk_id, case when regexp_full_match(effective_date, '\d{4}-\d{2}-\d{2}') then try_cast(effective_date as date) end as day,
  case when effective_date is null then '' when len(string_split(effective_date, '-')) = 3 then array_to_string(list_reverse(string_split(effective_date, '-')), '.') else effective_date end as shown,
  case doc_type when 'rules' then 'Правила' when 'tariff' then 'Тарифы' when 'charter' then 'Устав' when 'regulation' then 'Регламент' else doc_type end as label from chunks""")
def f21_dates(spark, d):
    day = F.col("effective_date")
    return table(spark, d, "chunks").select("chunk_id", T.iso_date(day).alias("day"), T.short_date(day).alias("shown"), T.type_label(F.col("doc_type")).alias("label")).distinct()


@query("""select doc_id, day(effective_date) || ' ' || (['января','февраля','марта','апреля','мая','июня','июля','августа','сентября','октября','ноября','декабря'])[month(effective_date)]
  || ' ' || year(effective_date) || ' г.' as day from documents""")
def f24_long_dates(spark, d):
    return table(spark, d, "documents").select("doc_id", T.long_date(F.col("effective_date")).alias("day"))


@query(r"""with m as (select distinct answer_id, answer, regexp_extract_all(answer, '\[(\d+)\]', 1) as m from answers)
select answer_id, case when answer is not null then list_transform(list_filter(list_transform(range(1, len(m) + 1), lambda i: case when list_position(m, m[i]) = i then m[i] end), lambda x: x is not null), lambda x: cast(x as int)) end as markers,
  coalesce(trim(answer, {WS}) <> '' and (starts_with(rtrim(lower(trim(answer, {WS})), '.'), 'в предоставленных документах ответ не на') or
    (length(trim(answer, {WS})) < 180 and not regexp_matches(answer, '\[\d+\]') and regexp_matches(lower(answer), 'не найден|не содержится|нет информации|не указан|отсутствует в|не предоставлен|невозможно ответить|нет ответа|не приводится'))), false) as refused,
  trim(regexp_replace(regexp_replace(trim(regexp_replace(answer, '\[\s*\d+(\s*[,\-–]\s*\d+)*\s*\]', '', 'g'), {WS}), '^({US}|[•\-–—▸])+', ''), '{US}+', ' ', 'g'), {WS}) as bullet from m""")
def f25_markers(spark, d):
    a = F.col("answer")
    return table(spark, d, "answers").select("answer_id", T.markers(a).alias("markers"), T.is_refusal(a, DEFAULT.refusal).alias("refused"), T.clean_bullet(a).alias("bullet")).distinct()


@query("""with z as (select vec_id, list_filter(list_transform(range(1, least(len(sparse_indices), len(sparse_values)) + 1), lambda i: {'k': sparse_indices[i], 'v': cast(sparse_values[i] as double)}), lambda p: p.k is not null) as z from chunk_vectors),
one as (select vec_id, list_filter(z, lambda p: p.v > 0 and not isnan(p.v) and p.v = list_max(list_transform(list_filter(z, lambda o: o.k = p.k), lambda o: o.v))) as p from z)
select vec_id, list_sum(list_transform(list_distinct(p), lambda x: x.v)) as total, len(list_distinct(p)) as kept from one""")
def f41_sparse_weights(spark, d):
    """Of a token that repeats, the greatest weight counts."""
    rows = table(spark, d, "chunk_vectors")
    pairs = F.filter(F.arrays_zip(F.col("sparse_indices").alias("k"), F.col("sparse_values").alias("v")), lambda p: p["k"].isNotNull())
    best = F.transform(F.array_distinct(F.transform(pairs, lambda p: p["k"])), lambda k: F.struct(k.cast("string").alias("k"), F.array_max(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"].cast("double"))).alias("v")))
    weights = F.map_from_entries(best)
    kept = F.map_values(T.positive_weights(weights))
    total = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, v: s + v))
    size = F.when(F.col("sparse_indices").isNotNull(), F.size(kept)).cast("long")
    return rows.select("vec_id", total.alias("total"), size.alias("kept"))


# Cleaning and structure

_LINES = """with docs as (select distinct doc_id, page_texts from parsed_documents where doc_id is not null),
pages as (select doc_id, unnest(page_texts) as t, generate_subscripts(page_texts, 1) as page_no from docs),
arr as (select doc_id, page_no, string_split(coalesce(t, ''), chr(10)) as a from pages),
lines as (select doc_id, page_no, unnest(a) as line, generate_subscripts(a, 1) - 1 as line_no from arr),
rep as (select doc_id, s as line from (select distinct doc_id, page_no, trim(line, {WS}) as s from lines) join (select doc_id as pd, count(distinct page_no) as n from lines group by 1) on pd = doc_id
  where length(s) >= 8 and not regexp_full_match(s, '\\d+') and n >= 4 group by doc_id, s, n having count(*) >= greatest(2, floor(n * 0.5)))"""


def _lines(spark, d):
    return cleaning.lines_of(cleaning.pages_of(table(spark, d, "parsed_documents").filter("doc_id is not null").dropDuplicates(["doc_id"])))


@query(_LINES + " select doc_id, line from rep")
def g1_repeated_lines(spark, d):
    return cleaning.repeated_lines(_lines(spark, d))


@query(_LINES + r""", edges as (select *, trim(line, {WS}) as s, min(case when trim(line, {WS}) <> '' then line_no end) over (partition by doc_id, page_no) as lo,
  max(case when trim(line, {WS}) <> '' then line_no end) over (partition by doc_id, page_no) as hi from lines)
select doc_id, page_no, line_no, e.line from edges e where not (regexp_full_match(s, '\d{1,4}') and (line_no = lo or line_no = hi)) and not exists (select 1 from rep r where r.doc_id = e.doc_id and r.line = e.s)""")
def pred_p4_running_lines(spark, d):
    lines = _lines(spark, d)
    out = cleaning.strip_running_lines(lines, cleaning.repeated_lines(lines))
    return out.select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.col("line_no").cast("long").alias("line_no"), "line")


@query("""select doc_id, string_agg(coalesce(t, ''), chr(10) || chr(10) order by page_no) as full_text from (
  select doc_id, unnest(page_texts) as t, generate_subscripts(page_texts, 1) as page_no from (select distinct doc_id, page_texts from parsed_documents where doc_id is not null)) group by doc_id""")
def g4_full_text(spark, d):
    return cleaning.full_text(cleaning.pages_of(table(spark, d, "parsed_documents").filter("doc_id is not null").dropDuplicates(["doc_id"])))


def _numbered(spark, d):
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull())
    pages = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page_no"), F.regexp_replace("text", "\r\n?", "\n").alias("text"))
    return structure.clause_lines(structure.without_contents(cleaning.lines_of(pages)))


_CLAUSES = r"""with raw as (select cast(doc_id as varchar) as doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) as a from documents where text is not null),
l as (select doc_id, unnest(a) as line, generate_subscripts(a, 1) as pos from raw),
k as (select doc_id, line, row_number() over (partition by doc_id order by pos) as seq from l where trim(line, {WS}) <> ''),
c as (select *, regexp_extract(line, '^(\d{1,2}(?:\.\d{1,2}){0,5})\.\s*(.*)$', 1) as num from k where not regexp_matches(line, '\.{4,}')),
s as (select *, case when num <> '' and instr(num, '.') = 0 then cast(num as int) end as sec from c),
m as (select *, max(sec) over (partition by doc_id order by seq rows between unbounded preceding and 1 preceding) as top from s),
o as (select doc_id, seq, case when num <> '' and not coalesce(sec < top, false) then num end as number from m),
clauses as (select doc_id, seq, number, len(string_split(number, '.')) - 1 as level, count(number) over (partition by doc_id order by seq) as clause_no from o)"""


@query(_CLAUSES + " select doc_id, cast(seq as int) as seq, number, cast(level as int) as level, clause_no from clauses")
def pred_p8_clause_lines(spark, d):
    return _numbered(spark, d).select("doc_id", "seq", "number", "level", "clause_no")


@query(_CLAUSES + """ select doc_id, clause_no, number, (select max(b.clause_no) from clauses b where b.doc_id = a.doc_id and b.number is not null and b.clause_no < a.clause_no and b.level = a.level - 1
  and not exists (select 1 from clauses x where x.doc_id = a.doc_id and x.number is not null and x.clause_no > b.clause_no and x.clause_no < a.clause_no and x.level < b.level)
  and b.clause_no = (select max(y.clause_no) from clauses y where y.doc_id = a.doc_id and y.number is not null and y.clause_no < a.clause_no and y.level <= a.level - 1)) as parent_no
from clauses a where number is not null""")
def a4_parents(spark, d):
    rows = _numbered(spark, d).filter(F.col("number").isNotNull()).select("doc_id", "clause_no", "number", "level", "appendix")
    return structure.parents(rows).select("doc_id", "clause_no", "number", "parent_no")


_STRUCTURE = r"""with recursive raw as (select cast(doc_id as varchar) as doc_id, list_transform(string_split(translate(text, chr(160)||chr(13), ' '||chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'), {WS})) as a from documents where text is not null),
l as (select doc_id, unnest(a) as line, generate_subscripts(a, 1) as pos from raw), k as (select doc_id, line, row_number() over (partition by doc_id order by pos) as seq from l where trim(line, {WS}) <> ''),
c as (select *, nullif(regexp_extract(line, '^(\d{1,2}(?:\.\d{1,2}){0,5})\.\s*(.*)$', 1), '') as num, trim(regexp_extract(line, '^(\d{1,2}(?:\.\d{1,2}){0,5})\.\s*(.*)$', 2), {WS}) as rest from k where not regexp_matches(line, '\.{4,}')),
m as (select *, max(case when instr(num, '.') = 0 then cast(num as int) end) over (partition by doc_id order by seq rows between unbounded preceding and 1 preceding) as top from c),
o as (select *, case when not coalesce(instr(num, '.') = 0 and cast(num as int) < top, false) then num end as number from m),
g as (select *, count(number) over (partition by doc_id order by seq) as no from o),
n as (select doc_id, no, max(number) as number, len(string_split(max(number), '.')) - 1 as level, trim(string_agg(case when number is not null then nullif(rest, '') else trim(line, {WS}) end, ' ' order by seq), {WS}) as text from g group by 1, 2),
h as (select doc_id, no, number, level, coalesce(text, '') as text, split_part(regexp_replace(coalesce(text, ''), '([.;]){US}', '\1' || chr(1)), chr(1), 1) as head, case when no = 0 then (select max(no) from n x where x.doc_id = n.doc_id) + 1 else no end as id_no from n where no > 0 or length(coalesce(text, '')) >= 40),
t as (select doc_id, no, number, case when no = 0 then 0 else level end as level, text, doc_id || '#' || id_no || ':' || coalesce(number, 'preamble') as node_id, coalesce(case when text <> '' and trim(head, {WS}) <> '' and length(trim(head, {WS})) <= 140
  and (not regexp_matches(trim(head, {WS}), '[.;,:]$') or (head = upper(head) and head <> lower(head))) then trim(head, {WS}) end, case when number is null then 'Вводная часть' end) as title from h),
p as (select *, case when number is null then title when level >= 1 then 'п. ' || number || coalesce('. ' || title, '') else 'Раздел ' || number || coalesce('. ' || title, '') end as label from t),
last as (select a.*, (select max(b.no) from p b where b.doc_id = a.doc_id and b.number is not null and b.no < a.no and b.level < a.level) as before from p a),
up as (select a.*, b.node_id as parent_id, b.no as parent_no from last a left join p b on b.doc_id = a.doc_id and b.no = a.before and b.level = a.level - 1 and a.number is not null),
path as (select doc_id, no, [label] as path, parent_no from up union all select path.doc_id, path.no, [up.label] || path.path, up.parent_no from path join up on up.doc_id = path.doc_id and up.no = path.parent_no)
select u.node_id, u.doc_id, cast(u.level as int) as level, u.number, u.title, u.text, 1 as page_start, 1 as page_end, u.parent_id, path.path as path_titles, u.no as ord from up u join path using (doc_id, no) where path.parent_no is null"""


@query(_STRUCTURE)
def q6_structure(spark, d):
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull())
    pages = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page_no"), T.normalize_whitespace(F.col("text")).alias("text"))
    return structure.parse_structure(pages)


_FOLD = r"""list_reduce(list_transform(string_split(regexp_replace({t}, '([.;:])[\s\x{a0}\x{85}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+', '\1' || chr(1), 'g'), chr(1)), lambda s: {'cur': s, 'w': []::varchar[]}),
  lambda a, b: case when a.cur <> '' and length(a.cur) + length(b.cur) + 1 > 1330 then {'cur': trim(right(a.cur, 224) || ' ' || b.cur, {WS}), 'w': list_append(a.w, trim(a.cur, {WS}))}
    else {'cur': trim(a.cur || ' ' || b.cur, {WS}), 'w': a.w} end, {'cur': '', 'w': []::varchar[]})"""


@query("with t as (select distinct node_id, trim(text, {WS}) as t from section_nodes where length(trim(text, {WS})) >= 24), f as (select node_id, t, " + _FOLD.replace("{t}", "t") + """ as r from t)
select node_id, case when length(t) <= 1330 then [t] when trim(r.cur, {WS}) <> '' then list_append(r.w, r.cur) else r.w end as windows from f""")
def a8_windows(spark, d):
    rows = table(spark, d, "section_nodes").select("node_id", trimmed(F.col("text")).alias("t")).distinct().filter(F.length("t") >= 24)
    return rows.select("node_id", chunking.sentence_windows(F.col("t"), DEFAULT.child_chars, DEFAULT.overlap_chars).alias("windows"))


_LABEL = "case when nullif({0}.number, '') is not null and {0}.level >= 1 then 'п. ' || {0}.number when nullif({0}.number, '') is not null then 'Раздел ' || {0}.number else coalesce(nullif({0}.title, ''), {0}.node_id) end"


@query(f"""with n as (select distinct * from section_nodes)
select a.node_id, left(concat_ws(chr(10), case when coalesce(b.text, '') <> '' and length(coalesce(a.text, '')) < 800 then {_LABEL.format('b')} || ': ' || trim(left(b.text, 600), {{WS}}) end,
  {_LABEL.format('a')} || ': ' || coalesce(a.text, '')), 4900) as parent_text from n a left join n b on a.doc_id = b.doc_id and a.parent_id = b.node_id""")
def j1_parent_context(spark, d):
    return chunking.parent_context(table(spark, d, "section_nodes").distinct(), DEFAULT.parent_chars).select("node_id", "parent_text")


_WINDOWS = "case when length(t) <= 1330 then [t] when trim(r.cur, {WS}) <> '' then list_append(r.w, r.cur) else r.w end"
_CHUNKS = f"""with m as (select doc_id, x.* from (select doc_id, arg_max({{'title': title, 'doc_type': doc_type, 'source_url': source_url, 'effective_date': effective_date}}, registered_at) as x from document_meta group by 1)),
n as (select distinct * from section_nodes), lab as (select *, {_LABEL.format('n')} as label from n),
par as (select a.*, left(concat_ws(chr(10), case when coalesce(b.text, '') <> '' and length(coalesce(a.text, '')) < 800 then b.label || ': ' || trim(left(b.text, 600), {{WS}}) end, a.label || ': ' || coalesce(a.text, '')), 4900) as parent_text
  from lab a left join lab b on a.doc_id = b.doc_id and a.parent_id = b.node_id),
t as (select par.*, trim(par.text, {{WS}}) as t, m.title as doc_title, m.doc_type, m.source_url, strftime(m.effective_date, '%Y-%m-%d') as effective_date from par join m using (doc_id) where length(trim(par.text, {{WS}})) >= 24),
f as (select *, {_FOLD.replace('{t}', 't')} as r from t), w as (select *, {_WINDOWS} as ws from f),
c as (select *, unnest(ws) as win, generate_subscripts(ws, 1) - 1 as i from w),
own as (select node_id || ':' || i as chunk_id, doc_id, doc_title, concat_ws(' ▸ ', nullif(doc_title, ''), case when instr(doc_title, path_titles[1]) = 0 then nullif(path_titles[1], '') end, nullif(label, '')) || ': ' || win as text, parent_text, parent_id,
  array_to_string(path_titles, ' > ') as section_path, case when level >= 1 then number end as clause, page_start as page, cast(floor(length(win) / 3.5) as int) as token_count, doc_type, source_url, effective_date from c),
pd as (select doc_id, any_value(page_texts) as a from parsed_documents where doc_id is not null group by 1), pg as (select doc_id, trim(unnest(a), {{WS}}) as t, generate_subscripts(a, 1) as page_no from pd where doc_id not in (select doc_id from own)),
pf as (select *, {_FOLD.replace('{t}', 't')} as r from pg where length(t) >= 24), pw as (select *, {_WINDOWS} as ws from pf), pc as (select *, unnest(ws) as win, generate_subscripts(ws, 1) - 1 as i from pw)
select * from own union all select doc_id || '#p' || page_no || ':' || i, doc_id, m.title, m.title || ': ' || win, win, null, 'стр. ' || page_no, null, cast(page_no as int), cast(floor(length(win) / 3.5) as int), m.doc_type, m.source_url, strftime(m.effective_date, '%Y-%m-%d') from pc join m using (doc_id)"""


@query(_CHUNKS)
def q8_chunks(spark, d):
    meta = table(spark, d, "document_meta").groupBy("doc_id").agg(F.max_by(F.struct("title", "doc_type", "source_url", "effective_date"), "registered_at").alias("x")).select("doc_id", "x.*")
    pages = cleaning.pages_of(table(spark, d, "parsed_documents").dropDuplicates(["doc_id"]))
    return chunking.chunk_documents(meta, table(spark, d, "section_nodes").distinct(), pages)


# Search, ranking, answers


def _questions(spark, d):
    """The query set of searches: every row whose id is divisible by 20."""
    rows = table(spark, d, "answers").select(F.col("answer_id").alias("question_id"), "question").distinct()
    return rows.filter((F.col("question_id") % 20 == 0) & F.col("question").isNotNull())


def _chunks(spark, d, of=None, broadcast_rows=1_000_000):
    """The chunks, or those of the stored rows `of`: their ids, sent around after a check of their number, are matched before
    any text is shuffled."""
    rows = table(spark, d, "chunks").filter(F.col("chunk_id").isNotNull() & (F.length("text") > 0))
    if of is not None:
        ids = of.select("chunk_id").distinct()
        rows = rows.join(F.broadcast(ids) if of.count() <= broadcast_rows else ids, "chunk_id", "left_semi")
    return rows.dropDuplicates(["chunk_id"])


_SEARCH = r"""with ch as (select chunk_id, any_value(text) as text, any_value(doc_id) as doc_id, any_value(clause) as clause from chunks where chunk_id is not null and length(text) > 0 group by 1),
n as (select count(*) as n from ch),
post as (select chunk_id, term, count(*) as tf from (select chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) as term from ch) group by 1, 2),
df as (select term, count(*) as df from post group by 1),
raw as (select chunk_id, term, (1 + ln(tf)) * ln(1 + (select n from n)::double / df) as w from post join df using (term)),
norm as (select chunk_id, sqrt(sum(w * w)) as l from raw group by 1),
q as (select distinct answer_id as question_id, question from answers where answer_id % 20 = 0 and question is not null),
qt as (select question_id, term, 1 + ln(count(*)) as w from (select question_id, unnest(regexp_extract_all(lower(question), '[\p{L}\p{Nd}]+')) as term from q) group by 1, 2),
hit as (select question_id, chunk_id, round(sum(qt.w * raw.w / l), 9) as score from qt join raw using (term) join norm using (chunk_id) group by 1, 2),
top as (select *, row_number() over (partition by question_id order by score desc, chunk_id) as rank from hit qualify rank <= 50)"""


def _hits(spark, d):
    chunks = _chunks(spark, d)
    weights = search.document_weights(search.postings(chunks, "chunk_id", "text"), "chunk_id", chunks.count())
    return search.sparse_search(_questions(spark, d), weights, DEFAULT.retrieve_top_k)


@query(_SEARCH + " select question_id, chunk_id, score, cast(rank as int) as rank from top")
def q2_search(spark, d):
    return _hits(spark, d)


_CONTEXTS = _SEARCH + r""", s as (select question_id, chunk_id, doc_id, clause, rank as fused_rank, len(list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{Nd}]+'))) as nq,
  len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{Nd}]+')), regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'))) as shared from top join q using (question_id) join ch using (chunk_id)),
r as (select *, round(ln((shared + 0.5) / (nq - shared + 0.5)), 9) as score from s),
o as (select *, row_number() over (partition by question_id order by score desc, fused_rank, chunk_id) as rn, count(*) filter (score >= 0) over (partition by question_id) as passed from r),
k as (select *, row_number() over (partition by question_id, doc_id, coalesce(nullif(clause, ''), chunk_id) order by rn) as copy from o),
f as (select *, row_number() over (partition by question_id order by rn) - 1 as i from k where (copy = 1 and score >= 0) or (passed = 0 and rn = 1 and score >= -4)),
h as (select *, count(*) over (partition by question_id) as n from f where i < 6),
ctx as (select question_id, chunk_id, score, cast(case when i % 2 = 0 then i // 2 else n - 1 - (i - 1) // 2 end as int) as position from h)"""


@query(_CONTEXTS + " select question_id, chunk_id, score, position from ctx")
def q1_contexts(spark, d):
    hits = spool(_hits(spark, d), "hits")
    ranked = ranking.rerank(hits, _questions(spark, d), _chunks(spark, d, hits), lambda q, p: F.round(ranking.overlap_logit(q, p), 9))
    return ranking.select_contexts(ranked).select("question_id", "chunk_id", "score", "position")


_VECTORS = """v as (select vec_id, chunk_id, list_transform(dense, lambda e: cast(e as double)) as d from chunk_vectors where len(dense) > 0 and len(list_filter(dense, lambda e: e is not null and isfinite(e))) = len(dense) and len(list_filter(dense, lambda e: e <> 0)) > 0),
u as (select vec_id, chunk_id, d, sqrt(list_dot_product(d, d)) as l from v)"""


@query(f"""with {_VECTORS}, s as (select a.vec_id as question_id, b.vec_id, round(list_dot_product(a.d, b.d) / a.l / b.l, 6) as score from u a join u b on len(a.d) = len(b.d) where a.vec_id % 20 = 0)
select question_id, vec_id, score, cast(row_number() over (partition by question_id order by score desc, vec_id) as int) as rank from s qualify rank <= 10""")
def j5_dense_search(spark, d):
    rows = table(spark, d, "chunk_vectors").select("vec_id", "dense")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "dense")
    return search.dense_search(asked, rows, 10, "vec_id", places=6)


_HYBRID = f"""with ch as (select chunk_id, any_value(text) as text from chunks where chunk_id is not null and length(text) > 0 group by 1),
post as (select chunk_id, term, 1 + ln(count(*)) as raw from (select chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+')) as term from ch) group by 1, 2),
w as (select chunk_id, term, raw / sqrt(sum(raw * raw) over (partition by chunk_id)) as w from post), df as (select term, count(*) as df from post group by 1),
q as (select distinct answer_id as question_id, question from answers where answer_id % 20 = 0 and question is not null),
qt as (select question_id, term, tf * ln(1 + (select count(*) from ch)::double / df) as a from (select question_id, term, 1 + ln(count(*)) as tf from (select question_id, unnest(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{Nd}}]+')) as term from q) group by 1, 2) join df using (term)),
sp as (select question_id, chunk_id, row_number() over (partition by question_id order by score desc, chunk_id) as rank from (select question_id, chunk_id, round(sum(a * w), 9) as score from qt join w using (term) group by 1, 2) qualify rank <= 50),
{_VECTORS}, cv as (select chunk_id, arg_min(d, vec_id) as d, arg_min(l, vec_id) as l from u where chunk_id is not null group by 1),
de as (select question_id, chunk_id, row_number() over (partition by question_id order by score desc, chunk_id) as rank from (select q.question_id, cv.chunk_id, round(list_dot_product(u.d, cv.d) / u.l / cv.l, 9) as score from q join u on u.vec_id = q.question_id join cv on len(cv.d) = len(u.d)) qualify rank <= 50),
f as (select question_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) as score from (select * from sp union all select * from de) group by 1, 2)
select question_id, chunk_id, score, cast(row_number() over (partition by question_id order by score desc, chunk_id) as int) as rank from f qualify rank <= """


def _hybrid(spark, d, k):
    """Questions carry the vector of the same number; a chunk has the vector of the smallest vec_id."""
    chunks, vectors = _chunks(spark, d), table(spark, d, "chunk_vectors").filter(search.unit(F.col("dense")).isNotNull())
    asked = _questions(spark, d).join(vectors.select(F.col("vec_id").alias("question_id"), "dense"), "question_id", "left")
    own = vectors.filter(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.min_by("dense", "vec_id").alias("dense"))
    sparse = search.sparse_search(asked, search.text_weights(chunks, "chunk_id", "text"), DEFAULT.retrieve_top_k, documents=chunks.count())
    return search.fuse([sparse, search.dense_search(asked, own, DEFAULT.retrieve_top_k)], k)


@query(_HYBRID + "20")
def a10_fusion(spark, d):
    return _hybrid(spark, d, 20)


@query(_HYBRID + "50")
def q2_hybrid(spark, d):
    chunks, vectors = _chunks(spark, d), table(spark, d, "chunk_vectors").filter(search.unit(F.col("dense")).isNotNull())
    asked = _questions(spark, d).join(vectors.select(F.col("vec_id").alias("question_id"), "dense"), "question_id", "left")
    own = vectors.filter(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.min_by("dense", "vec_id").alias("dense"))
    return search.hybrid_search(asked, search.text_weights(chunks, "chunk_id", "text"), own, documents=chunks.count())


@query("""select chunk_id, doc_id, doc_type from (select distinct chunk_id, doc_id, doc_type from chunks) where doc_type in ('rules', 'tariff')""")
def pred_p3_facets(spark, d):
    return search.facets(table(spark, d, "chunks"), doc_types=["rules", "tariff"]).select("chunk_id", "doc_id", "doc_type").distinct()


@query("""select distinct answer_id, case when q is null then 'retrieve'
  when regexp_matches(q, 'о чем|про что|чему посвящ|кратко[ем]м? содержан|о содержании|как(ая|ие) тем[аы]|тематик|суть документ') and regexp_matches(q, 'документ|файл|материал|корпус|база знан') then 'about'
  when regexp_matches(q, '(список|перечень|сколько|что за) документ|(список|перечень) нормативн|какие нормативные документ|список файл|какие файл') or (regexp_matches(q, 'документ|файл|нормативн')
    and regexp_matches(q, 'в базе|базе знаний|в системе|загружен|доступн|у тебя|у вас|ты знаешь|ты работаешь|с какими документ|содержит|проиндексирован|в тебе|по каким документ|твоя база|твоей базе'))
    or regexp_matches(q, 'что в (базе|системе)|что ты (умеешь|знаешь|можешь)|чем ты можешь (помочь|быть полезен)|о чем ты можешь|что вы знаете|на какие вопросы|о чем я могу|что я могу спросить|что можно (спросить|узнать)|какие вопросы можно') then 'meta'
  else 'retrieve' end as route from (select answer_id, ' ' || replace(lower(question), 'ё', 'е') || ' ' as q from answers)""")
def pred_p11_routes(spark, d):
    return table(spark, d, "answers").select("answer_id", answering.route(F.col("question")).alias("route")).distinct()


@query(r"""with a as (select distinct answer_id, answer, citations from answers where answer is not null and len(citations) > 0),
m as (select answer_id, citations, list_filter(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: cast(x as int)), lambda x: x between 1 and len(citations)) as v from a),
u as (select answer_id, citations, case when len(v) > 0 then list_filter(list_transform(range(1, len(v) + 1), lambda i: case when list_position(v, v[i]) = i then v[i] end), lambda x: x is not null) else range(1, len(citations) + 1) end as v from m)
select answer_id as question_id, cast(i - 1 as int) as ord, '[' || v[i] || ']' as marker, citations[v[i]].doc_id as doc_id from (select *, unnest(range(1, len(v) + 1)) as i from u)""")
def q3_citations(spark, d):
    rows = table(spark, d, "answers").filter(F.col("answer").isNotNull() & (F.size("citations") > 0)).select(F.col("answer_id").alias("question_id"), "answer", "citations").distinct()
    contexts = rows.select("question_id", F.posexplode("citations").alias("position", "c")).select("question_id", "position", "c.doc_id", F.lit("").alias("text"), F.lit("").alias("parent_text"))
    return answering.citations(rows, contexts).select("question_id", "ord", "marker", "doc_id")


_WRITTEN = _CONTEXTS + r""", body as (select question_id, position, regexp_replace(text, '^(?:[^:]*▸)?[^:▸]*:{US}+', '') as b from ctx join ch using (chunk_id) where position < 3),
written as (select question_id, string_agg(split_part(regexp_replace(b, '([.!?]){US}+(\p{Lu})', '\1' || chr(1) || '\2'), chr(1), 1) || ' [' || (position + 1) || ']', ' ' order by position) as answer from body group by 1)"""


@query(_WRITTEN + r""" select question_id, answer, trim(answer) <> '' and not (starts_with(rtrim(lower(trim(answer, {WS})), '.'), 'в предоставленных документах ответ не на') or (length(trim(answer, {WS})) < 180
  and not regexp_matches(answer, '\[\d+\]') and regexp_matches(lower(answer), 'не найден|не содержится|нет информации|не указан|отсутствует в|не предоставлен|невозможно ответить|нет ответа|не приводится'))) as grounded from written""")
def q4_answers(spark, d):
    contexts = spool(q1_contexts(spark, d), "contexts")
    contexts = contexts.join(_chunks(spark, d, contexts).select("chunk_id", "text"), "chunk_id")
    return answering.extractive_answers(contexts).withColumn("grounded", answering.grounded(F.col("answer"), DEFAULT.refusal))


@query("""with g as (select distinct answer_id as question_id, case when length(trim(answer, {WS})) > 0 then 'fact' else 'unanswerable' end as type, coalesce(grounded, false) as grounded, citations[-1].doc_id as doc, citations[-1].clause as clause, citations[1].doc_id as c_doc, citations[1].clause as c_clause from answers),
j as (select question_id, type, grounded = (type <> 'unanswerable') as ok, case when type <> 'unanswerable' and doc is not null then coalesce(c_doc = doc, false) end as dh, case when type <> 'unanswerable' and clause is not null then coalesce(c_clause = clause, false) end as ch from g)
select count(*) as total, count(*) filter (type <> 'unanswerable') as answerable, round(avg(ok::int), 3) as grounding_accuracy, round(avg(dh::int), 3) as doc_hit_rate, round(avg(ch::int), 3) as clause_hit_rate from j""")
def g5_evaluation(spark, d):
    """Whatever has an answer counts as answerable, by the document cited last; the answer counts with what it cites first."""
    rows = table(spark, d, "answers").select(F.col("answer_id").alias("question_id"), "answer", "grounded", "citations").distinct()
    last, first = F.try_element_at("citations", F.lit(-1)), F.get("citations", F.lit(0))
    type_ = F.when(F.length(trimmed(F.col("answer"))) > 0, "fact").otherwise("unanswerable")
    golden = rows.select("question_id", type_.alias("type"), last["doc_id"].alias("doc"), last["clause"].alias("clause"))
    cited = rows.filter(F.size("citations") > 0).select("question_id", first["doc_id"].alias("doc_id"), first["clause"].alias("clause"))
    return evaluation.summarize(evaluation.judge(golden, rows, cited))


# Catalog, tables, reports


@query("""with c as (select distinct cand_id, url, link_text, protocol, doc_date, regexp_replace(trim(url), '[?#].*$', '', 's') as clean from pdf_candidates),
n as (select *, concat_ws(' ', coalesce(try(url_decode(replace(regexp_extract(clean, '([^/]*)$', 1), '+', '%2B'))), regexp_extract(clean, '([^/]*)$', 1)), link_text) as named from c),
m as (select n.*, (select min(family_key) from doc_families f where regexp_matches(named, '(?i)' || f.pattern) or regexp_matches(clean, '(?i)' || f.pattern)) as family from n)
select cand_id, family, cast(row_number() over (partition by family order by coalesce(protocol, 0) desc, coalesce(doc_date, date '0001-01-01') desc, cand_id) as int) as version, count(*) over (partition by family) as versions from m where family is not null""")
def a16_versions(spark, d):
    rows = table(spark, d, "pdf_candidates").select("cand_id", "url", "link_text", "protocol", "doc_date").distinct()
    families = table(spark, d, "doc_families").withColumn("ord", F.col("family_key"))
    return catalog.rank_versions(catalog.match_families(rows, families, "cand_id"), ["cand_id"]).select("cand_id", "family", "version", "versions")


@query("""with m as (select doc_id, title, max(registered_at) as at from document_meta group by 1, 2), s as (select doc_id, title, 'scraped' as origin from m where doc_id like 'r%')
select doc_id, title, origin, 0 as part from s union all select doc_id, title, 'existing', 1 from m where doc_id not in (select doc_id from s)""")
def w9_manifest(spark, d):
    m = table(spark, d, "document_meta").groupBy("doc_id", "title").agg(F.max("registered_at").alias("seq"))
    scraped = m.filter(F.col("doc_id").startswith("r")).withColumn("origin", F.lit("scraped"))
    return catalog.merge_manifest(scraped, m.withColumn("origin", F.lit("existing"))).select("doc_id", "title", "origin", "part")


@query("""with n as (select distinct doc_id, upper(doc_title) as doc_title from chunks where doc_type = 'rules')
select distinct chunk_id, doc_id, doc_title from chunks where doc_id not in (select doc_id from n where doc_id is not null) union all select doc_id || '#new', doc_id, doc_title from n""")
def w4_replace_documents(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "doc_id", "doc_title", "doc_type")
    new = c.filter("doc_type = 'rules'").select("doc_id", F.upper("doc_title").alias("doc_title")).distinct()
    new = new.select(F.concat("doc_id", F.lit("#new")).alias("chunk_id"), "doc_id", "doc_title")
    return store.replaced(c.drop("doc_type").distinct(), new, "doc_id")


@query("select count(distinct doc_id) as documents, count(*) as chunks from chunks")
def g6_index_summary(spark, d):
    return store.index_summary(table(spark, d, "chunks"))


@query("""with m as (select distinct doc_id, title, doc_type, n_pages, effective_date, summary from document_meta), l as (select *, case doc_type when 'rules' then 'Правила' when 'tariff' then 'Тарифы' when 'charter' then 'Устав' when 'regulation' then 'Регламент' else doc_type end as label from m)
select doc_id, '• ' || title || ' — ' || concat_ws(', ', label, case when n_pages > 0 then n_pages || ' стр.' end, 'ред. ' || strftime(effective_date, '%d.%m.%Y')) as line,
  '• ' || title || ' (' || label || case when n_pages > 0 then ', ' || n_pages || ' стр.' else '' end || ')' || coalesce(' — ' || nullif(summary, ''), '') as about from l""")
def g7_corpus_lines(spark, d):
    m = table(spark, d, "document_meta").select("doc_id", "title", "doc_type", "n_pages", "effective_date", "summary").distinct()
    lines = answering.corpus_listing(m).select("doc_id", "title", "line")
    return lines.join(answering.corpus_summaries(m).select("doc_id", F.col("line").alias("about")), "doc_id").select("doc_id", "line", "about")


@query("""with l as (select user_id, event_type, arg_max(value, ts) as v from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1 group by 1, 2)
select cast(user_id as varchar) as doc_id, round(sum(case event_type when 'click' then 0.25 when 'view' then 0.25 when 'purchase' then 0.5 else 0 end * 1.0)::double, 6) as progress from l group by 1""")
def g14_progress(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.col("event_type").alias("stage"), F.lit("done").alias("status"), F.lit(1).alias("done"), F.lit(1).alias("total"), "ts")
    return history.progress(e, {"click": 0.25, "view": 0.25, "purchase": 0.5})


_PARAGRAPHS = r"list_filter(list_transform(string_split(regexp_replace(answer, '\n{2,}', chr(1), 'g'), chr(1)), lambda x: trim(x, {WS})), lambda x: x <> '')"


@query(r"""with a as (select distinct answer_id as question_id, question, answer, citations from answers where answer is not null),
p as (select question_id, """ + _PARAGRAPHS + r""" as ps from a),
c as (select question_id, answer, unnest(citations) as c, generate_subscripts(citations, 1) - 1 as pos from a),
b as (select question_id, 0 as section, 0 as pos, 'title' as kind, 'Справка' as text from a union all select question_id, 1, 0, 'subject', question from a
  union all select question_id, 2, generate_subscripts(ps, 1) - 1, 'paragraph', unnest(ps) from p
  union all select question_id, 3, pos, 'extract', case when length(answer) > 500 then left(answer, 500) || '…' else answer end from c
  union all select question_id, 4, pos, 'source', concat_ws(' | ', c.marker, c.doc_id, c.clause, cast(c.page as varchar), case when length(answer) > 500 then left(answer, 500) || '…' else answer end) from c
  union all select question_id, 5, 0, 'disclaimer', 'Ответ составлен автоматически по приведённым источникам.' from a)
select question_id, cast(row_number() over (partition by question_id order by section, pos) - 1 as int) as ord, kind, text from b""")
def w14_report_blocks(spark, d):
    rows = table(spark, d, "answers").filter(F.col("answer").isNotNull()).select(F.col("answer_id").alias("question_id"), "question", "answer", "citations").distinct()
    cited = rows.select("question_id", "answer", F.posexplode("citations").alias("ord", "c")).select("question_id", "ord", "c.marker", F.col("c.doc_id").alias("doc_title"), "c.clause", "c.page", F.col("answer").alias("snippet"))
    return reporting.report_blocks(rows.drop("citations"), cited, "Справка", extracts=True)


@query(r"""with a as (select distinct answer_id as question_id, answer from answers where answer is not null),
p as (select question_id, """ + _PARAGRAPHS + r"""[1:5] as ps from a), s as (select question_id, cast(generate_subscripts(ps, 1) - 1 as int) as slide_no, unnest(ps) as p from p),
t as (select question_id, slide_no, string_split(trim(regexp_replace(p, '{US}+', ' ', 'g')), ' ') as words,
  list_filter(list_transform(string_split(regexp_replace(p, '([.!?]){US}+', '\1' || chr(1), 'g'), chr(1)), lambda x: left(trim(regexp_replace(regexp_replace(trim(regexp_replace(x, '\[\s*\d+(\s*[,\-–]\s*\d+)*\s*\]', '', 'g'), {WS}),
    '^({US}|[•\-–—▸])+', ''), '{US}+', ' ', 'g'), {WS}), 160)), lambda x: x <> '')[1:4] as raw from s),
v as (select question_id, slide_no, words, list_filter(list_transform(raw, lambda x: trim(x, {WS})), lambda x: x <> '') as bullets from t)
select question_id, slide_no, 'bullets' as layout, left(case when len(words) > 5 then array_to_string(words[1:5], ' ') || '…' else array_to_string(words, ' ') end, 60) as title, bullets, []::varchar[][] as rows from v where len(bullets) > 0""")
def w15_slides(spark, d):
    rows = table(spark, d, "answers").filter(F.col("answer").isNotNull()).select(F.col("answer_id").alias("question_id"), "answer").distinct()
    none = spark.createDataFrame([], "question_id long, deck string")
    return reporting.whole_deck(none, rows)


@query(r"""with a as (select distinct answer_id, """ + _PARAGRAPHS + r""" as ps from answers where answer is not null), n as (select answer_id, cast(greatest(1, len(ps)) as int) as n, coalesce(list_sum(list_transform(ps, lambda x: length(x))), 0) as total from a)
select answer_id, case when total <= 160 and n <= 3 then 20 when total <= 320 and n <= 4 then 18 when total <= 520 then 16 else 14 end as points from n""")
def f36_font_sizes(spark, d):
    rows = table(spark, d, "answers").filter(F.col("answer").isNotNull()).select("answer_id", T.paragraphs(F.col("answer")).alias("bullets")).distinct()
    return rows.select("answer_id", reporting.font_size(F.col("bullets")).alias("points"))


@query(r"""with l as (select doc_id, regexp_replace(title, '^{US}*(?i:это|этот|данный|настоящий|представленный)?{US}*(?i:документ){US}*(—|–|-|:|(?i:представляет собой)|(?i:это))?{US}*', '') as t from (select doc_id, 'Этот документ — ' || title as title from documents))
select doc_id, coalesce(nullif(upper(left(trim(t, {WS}), 1)) || substr(trim(t, {WS}), 2), ''), 'Этот документ — ' || (select any_value(title) from documents x where x.doc_id = l.doc_id)) as title from l""")
def f29_leadins(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_leadin(F.concat(F.lit("Этот документ — "), "title")).alias("title"))


@query("""with c as (select distinct answer_id, citations from answers where len(citations) > 0), x as (select answer_id as question_id, unnest(citations) as c, generate_subscripts(citations, 1) - 1 as ord from c)
select question_id, cast(ord // 2 as bigint) as page_no, list(concat_ws(' ', c.marker, c.doc_id) order by ord) as items from x group by 1, 2""")
def a19_source_slides(spark, d):
    rows = table(spark, d, "answers").filter(F.size("citations") > 0).select(F.col("answer_id").alias("question_id"), "citations").distinct()
    cited = rows.select("question_id", F.posexplode("citations").alias("ord", "c")).select("question_id", "ord", "c.marker", F.col("c.doc_id").alias("doc_title"))
    return reporting.source_slides(cited, 2)


@query("""select p.doc_id, any_value(m.title) as title, any_value(n.nodes) as nodes, any_value(len(p.page_texts)) as pages, any_value(p.parser) as parser, any_value(len(coalesce(p.warnings, []))) as warnings
from (select distinct doc_id, title from document_meta) m join (select distinct doc_id, page_texts, parser, warnings from parsed_documents) p using (doc_id)
left join (select doc_id, count(*) as nodes from (select distinct node_id, doc_id from section_nodes) group by 1) n using (doc_id) group by 1""")
def w7_parse_summary(spark, d):
    meta = table(spark, d, "document_meta").select("doc_id", "title").distinct()
    parsed = table(spark, d, "parsed_documents").dropDuplicates(["doc_id"])
    nodes = table(spark, d, "section_nodes").select("node_id", "doc_id").distinct()
    n = nodes.groupBy("doc_id").agg(F.count("*").alias("nodes_or_null"))
    rows = store.parse_summary(meta.join(parsed.select("doc_id"), "doc_id", "left_semi"), nodes, parsed)
    return rows.drop("nodes").join(n, "doc_id", "left").select("doc_id", "title", F.col("nodes_or_null").alias("nodes"), F.col("pages").cast("long").alias("pages"), "parser", F.col("warnings").cast("long").alias("warnings"))


# More tables and listings


@query("""select distinct doc_id, title, coalesce(parser, '') like '%ocr%' as scanned, case when len(list_filter(coalesce(warnings, []), lambda w: contains(lower(w), 'docling'))) > 0 then 'docling'
  when len(list_filter(coalesce(warnings, []), lambda w: contains(lower(w), 'ocr'))) > 0 then 'pymupdf+ocr' else 'pymupdf' end as read_by
from parsed_documents join (select distinct doc_id, title from document_meta) using (doc_id)""")
def h12_documents(spark, d):
    parsed = table(spark, d, "parsed_documents").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))
    rows = parsed.join(table(spark, d, "document_meta").select("doc_id", "title").distinct(), "doc_id")
    return rows.select("doc_id", "title", F.contains(F.coalesce("parser", F.lit("")), F.lit("ocr")).alias("scanned"), cleaning.parser_label(F.col("warnings")).alias("read_by")).distinct()


@query("""select doc_id, cast(count(*) as bigint) as lines, cast(count(*) filter (trim(line, {WS}) <> '') as bigint) as full_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from documents where text is not null) group by doc_id""")
def a1_lines(spark, d):
    pages = table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", F.lit(1).alias("page_no"), "text")
    return cleaning.lines_of(pages).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(trimmed(F.col("line")) != "").alias("full_lines"))


@query("""with v as (select cand_id, family, row_number() over (partition by family order by coalesce(protocol, 0) desc, coalesce(doc_date, date '0001-01-01') desc, cand_id) as n, trust from
  (select distinct cand_id, lower(trim(family)) as family, protocol, doc_date, source_page, n_bytes from pdf_candidates) c left join source_pages p using (source_page) where family is not null and n_bytes > 1000000)
select family, cand_id from v where n = 1""")
def a18_latest_available(spark, d):
    rows = table(spark, d, "pdf_candidates").select("cand_id", F.lower(F.trim("family")).alias("family"), "protocol", "doc_date", "n_bytes").distinct()
    ranked = catalog.rank_versions(rows, ["cand_id"]).withColumn("available", F.coalesce(F.col("n_bytes") > 1_000_000, F.lit(False)))
    return catalog.latest_available(ranked).select("family", "cand_id")


@query("""select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1 order by ts desc, user_id limit 50""")
def a20_sessions(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "ts")
    newest = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("x")).select("user_id", "x.event_id", "x.ts")
    return history.latest_sessions(newest, "user_id", "ts")


@query("""with m as (select distinct doc_id, title from document_meta), n as (select doc_id, upper(title) as title from m where doc_id like 'c%')
select doc_id, title, 0 as part from m where doc_id not in (select doc_id from n) union all select doc_id, title, 1 from n""")
def w8_manifest_upsert(spark, d):
    m = table(spark, d, "document_meta").select("doc_id", "title").distinct().withColumn("seq", F.lit(0))
    new = m.filter(F.col("doc_id").startswith("c")).withColumn("title", F.upper("title"))
    return catalog.upsert_manifest(m, new).select("doc_id", "title", "part")


@query("""with c as (select chunk_id, any_value(doc_id) as doc_id from chunks group by 1), n as (select distinct chunk_id, model as doc_id from chunk_vectors where chunk_id is not null and model is not null),
one as (select chunk_id, min(doc_id) as doc_id from n group by 1)
select chunk_id, doc_id from c where chunk_id not in (select chunk_id from one) union all select chunk_id, doc_id from one""")
def w2_upsert(spark, d):
    old = table(spark, d, "chunks").groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"))
    new = table(spark, d, "chunk_vectors").filter("chunk_id is not null and model is not null").groupBy("chunk_id").agg(F.min("model").alias("doc_id"))
    return store.replaced(old, new, "chunk_id")


@query("""select vec_id, doc_id, doc_type, len(dense) as dims from chunk_vectors join (select distinct chunk_id, doc_id, doc_type from chunks) using (chunk_id)""")
def j4_chunk_vectors(spark, d):
    chunks = table(spark, d, "chunks").select("chunk_id", "doc_id", "doc_type").distinct()
    vectors = table(spark, d, "chunk_vectors").select("vec_id", "chunk_id", F.when(F.col("dense").isNotNull(), F.size("dense")).cast("long").alias("dims"))
    return vectors.join(chunks, "chunk_id").select("vec_id", "doc_id", "doc_type", "dims")


@query(r"""select distinct answer_id, list_transform(string_split(answer, chr(10)), lambda x: case when trim(x, {WS}) = '' then 'blank' when regexp_matches(trim(x, {WS}), '^#{1,6}\s') then 'heading'
  when regexp_matches(trim(x, {WS}), '^[-*•]\s') then 'bullet' when regexp_matches(trim(x, {WS}), '^\d+[.)]\s') then 'numbered' else 'paragraph' end) as kinds from answers where answer is not null""")
def f40_markdown(spark, d):
    rows = table(spark, d, "answers").filter(F.col("answer").isNotNull())
    return rows.select("answer_id", F.transform(F.split("answer", "\n"), T.markdown_kind).alias("kinds")).distinct()


@query(r"""select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\n{2,}', chr(1), 'g'), chr(1)), lambda x: trim(x, {WS})), lambda x: x <> '') as paragraphs from documents where text is not null""")
def f38_paragraphs(spark, d):
    return table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", T.paragraphs(F.col("text")).alias("paragraphs"))


@query(_CONTEXTS + r""", full_ as (select chunk_id, any_value(doc_title) as doc_title, any_value(parent_text) as parent_text from chunks group by 1),
b as (select question_id, string_agg('[' || (position + 1) || '] Документ: ' || doc_title || chr(10) || coalesce(nullif(parent_text, ''), text), chr(10) || chr(10) order by position) as blocks from ctx join ch using (chunk_id) join full_ using (chunk_id) group by 1)
select question_id, 'ВОПРОС: ' || question || chr(10) || chr(10) || 'ФРАГМЕНТЫ ДОКУМЕНТОВ:' || chr(10) || coalesce(blocks, '') || chr(10) || chr(10) ||
  'Отвечай строго по фрагментам; если ответа нет, верни ровно "В предоставленных документах ответ не найден." После каждого факта ставь ссылку [N].' as prompt from q join b using (question_id)""")
def f27_prompts(spark, d):
    contexts = spool(q1_contexts(spark, d), "contexts")
    contexts = contexts.join(_chunks(spark, d, contexts).select("chunk_id", "doc_title", "text", "parent_text"), "chunk_id")
    return answering.prompts(_questions(spark, d), contexts)


@query(_WRITTEN + r""", e as (select question_id, ['contexts'] || list_transform(regexp_extract_all(answer, '\S+\s*'), lambda w: 'token') || ['done'] as t,
  [cast(n as varchar)] || regexp_extract_all(answer, '\S+\s*') || [answer] as p from written join (select question_id, count(*) as n from ctx group by 1) using (question_id))
select question_id, cast(generate_subscripts(t, 1) - 1 as int) as seq, unnest(t) as type, unnest(p) as payload from e""")
def q5_answer_events(spark, d):
    contexts = spool(q1_contexts(spark, d), "contexts")
    written = answering.extractive_answers(contexts.join(_chunks(spark, d, contexts).select("chunk_id", "text"), "chunk_id"))
    return answering.answer_events(written, contexts)
