"""Queries of the text operators by name, over their whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playloom.llm import bpe, exact_dedup, html_text, jaccard, mixing, packing, pii, quality, repair, secrets, spelling, topk, url_filter
from playloom.shared import table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.annotate(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.annotate(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.annotate(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.annotate(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.annotate(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.annotate(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.annotate(table(spark, sf_dir, "conversations"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.annotate(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_jaccard": op4_jaccard,
    "op5_secrets": op5_secrets,
    "op6_html": op6_html,
    "op7_mixing": op7_mixing,
    "op8_pii": op8_pii,
    "op9_bpe": op9_bpe,
    "op10_quality": op10_quality,
    "op11_spelling": op11_spelling,
    "op12_repair": op12_repair,
    "op13_packing": op13_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as v from embeddings
            where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), pairs as (
            select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
            from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)
        ), ranked as (
            select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from pairs
        )
        select query_id, rank, vec_id, score from ranked where rank <= 5""",
    "op2_exact_dedup": r"""
        with k as (
            select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256, length(coalesce(text, '')) as n
            from documents
        ), w as (
            select doc_id, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
                   count(*) over (partition by text_sha256) as group_size, text_sha256
            from k
        )
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from w""",
    "op3_url_filter": r"""
        with c as (
            select page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) as h0,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
            from pages
        ), h as (
            select page_id, path, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from c
        ), r as (
            select *, case
                when '.' || host like '%.www.example.com' and starts_with(path, '/en/') then 'www.example.com/en/'
                when '.' || host like '%.example.com' and starts_with(path, '/en/') then 'example.com/en/'
                when '.' || host like '%.net' and starts_with(path, '/es/') then 'net/es/'
                when '.' || host like '%.net' and starts_with(path, '/fr/') then 'net/fr/'
                when '.' || host like '%.com' and starts_with(path, '/') then 'com/' end as rule
            from h
        )
        select page_id, host, path, rule, case
            when rule in ('www.example.com/en/', 'com/') then 'allow' when rule is not null then 'block'
            when starts_with(host || path, 'ads.') or contains(host || path, '/ads/') or contains(host || path, '/adserver/')
                or contains(host || path, '/banners/') then 'block' else 'allow' end as verdict
        from r""",
    "op11_spelling": r"""
        with recursive bits as (
            select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i::bigint)) as t
        ), runs as (
            select coalesce(doc_id::varchar, '') as d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run
            from documents
        ), keyed as (
            select d, run, count(*) as k, hex(encode(d || ':' || run)) as x from runs where length(run) >= 6 group by d, run
        ), hashed as (
            select run, k, xor(list_reduce(
                list_transform(range(length(x) // 2), lambda i: (instr('123456789ABCDEF', substr(x, 2 * i + 1, 1)) * 16 + instr('123456789ABCDEF', substr(x, 2 * i + 2, 1)))::bigint),
                lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::bigint), 4294967295) as h
            from keyed, bits
        ), damaged as (
            select case when h % 199 = 0 then left(run, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, k from hashed
        ), w as (
            select word, sum(k)::bigint as n from damaged where length(word) >= 6 group by word having sum(k) >= 5
        ), cut as (
            select word, n, i, left(word, i - 1) || substr(word, i + 1) as less, left(word, i - 1) || '*' || substr(word, i + 1) as wild
            from (select word, n, unnest(range(1, length(word) + 1)) as i from w)
        ), near as (
            select c.word, v.word as other, v.n as m from cut c join w v on v.word = c.less
            union select v.word, c.word, c.n from cut c join w v on v.word = c.less
            union select a.word, b.word, b.n from cut a join cut b on a.wild = b.wild and a.word <> b.word
        ), ranked as (
            select word, other, m, count(*) over (partition by word) as n_near, row_number() over (partition by word order by m desc, other) as place from near
        ), rows_ as (
            select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when m >= 5 * w.n then other end as form, case when m >= 5 * w.n then m end as form_n
            from w left join ranked r on r.word = w.word and place = 1
        ), chain as (
            select word, word as at, form from rows_
            union all
            select c.word, c.form, r.form from chain c join rows_ r on r.word = c.form
        )
        select r.word, r.form, c.at as root, r.n, r.n_near, r.form_n from rows_ r join chain c on c.word = r.word and c.form is null""",
    "op12_repair": r"""
        with recursive bits as (
            select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i::bigint)) as t
        ), convs as (
            select conv_id, row_number() over (order by conv_id) as c from (select distinct conv_id from conversations)
        ), named as (
            select c, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, hex(encode(coalesce(v.conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) as x
            from conversations v join convs on convs.conv_id is not distinct from v.conv_id
        ), hashed as (
            select *, xor(list_reduce(
                list_transform(range(length(x) // 2), lambda i: (instr('123456789ABCDEF', substr(x, 2 * i + 1, 1)) * 16 + instr('123456789ABCDEF', substr(x, 2 * i + 2, 1)))::bigint),
                lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::bigint), 4294967295) % 20 as h
            from named, bits
        ), damaged as (
            select c, turn, case when h = 4 then 'user' else role end as role, case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                   unnest(range(case when h = 3 then 2 else 1 end)) as copy
            from hashed where h <> 0
        ), placed as (
            select *, left(role, 1) as initial, row_number() over (partition by c order by turn nulls first, role, sha256(text), copy) as pos from damaged
        ), judged as (
            select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by c, role, text order by pos) > 1 as again,
                   not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as cut, lag(initial) over (partition by c order by pos) || initial as pair
            from placed
        ), counted as (
            select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank, count(*) filter (where again and not blank) as duplicate,
                   count(*) filter (where cut and not again and not blank) as truncated, count(*) filter (where pair is not null and pair not in ('su', 'ua', 'au')) as illegal, max(pos) as last
            from judged group by c
        ), inserts(state, due, cost, letters) as (
            values (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (2, 2, 6, 'II'), (3, 3, 0, ''), (3, 2, 3, 'I'), (3, 3, 6, 'II')
        ), edits(due, initial, to_state, cost, letter) as (
            values (0, 's', 1, 0, 'K'), (0, 'u', 2, 0, 'K'), (1, 'u', 2, 0, 'K'), (2, 'a', 3, 0, 'K'), (3, 'u', 2, 0, 'K'), (0, null, 2, 3, 'R'), (1, null, 2, 3, 'R'), (2, null, 3, 3, 'R'), (3, null, 2, 3, 'R'),
                   (0, null, 0, 4, 'D'), (1, null, 1, 4, 'D'), (2, null, 2, 4, 'D'), (3, null, 3, 4, 'D')
        ), step as (
            select c, 0::bigint as pos, 0 as state, {'cost': 0::bigint, 'audit': ''} as best from counted
            union all
            select j.c, j.pos, e.to_state, min({'cost': best.cost + i.cost + e.cost + case when j.cut and e.letter <> 'D' then 3 else 0 end, 'audit': best.audit || i.letters || e.letter})
            from step s join judged j on j.c = s.c and j.pos = s.pos + 1 join inserts i on i.state = s.state join edits e on e.due = i.due
            where (e.letter = 'D' or not (j.blank or j.again)) and (e.initial is null or e.initial = j.initial)
            group by j.c, j.pos, e.to_state
        ), cheapest as (
            select s.c, min({'cost': best.cost + i.cost, 'audit': best.audit || i.letters}) as best
            from step s join counted n on n.c = s.c and n.last = s.pos join inserts i on i.state = s.state where i.due in (0, 3) group by s.c
        ), letters as (
            select c, substr(best.audit, i, 1) as letter, i from (select c, best, unnest(range(1, length(best.audit) + 1)) as i from cheapest)
        ), aligned as (
            select *, count(*) filter (where letter <> 'I') over (partition by c order by i) as pos from letters
        ), kept as (
            select a.c, a.i, a.letter, j.role, j.text, j.initial, row_number() over (partition by a.c order by a.i) as n
            from aligned a left join judged j on j.c = a.c and j.pos = a.pos where a.letter <> 'D'
        ), begun as (
            select *, max(case when n = 1 and letter = 'K' and initial = 's' then 1 else 0 end) over (partition by c) as shift from kept
        ), hashed_text as (
            select c, sha256(string_agg(case when letter = 'K' then role when (n - shift) % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end, chr(10) order by i)) as h
            from begun group by c
        )
        select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
               coalesce(best.cost, 0) as cost, coalesce(best.audit, '') as audit, coalesce(h, sha256('')) as repaired_sha256
        from convs left join counted on counted.c = convs.c left join cheapest on cheapest.c = convs.c left join hashed_text on hashed_text.c = convs.c""",
}
