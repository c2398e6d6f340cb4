"""SQL twins for DuckDB of the queries that SQL can express."""

SQL = {
    "op1_ngram_jaccard": r"""
        with recursive d as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
            from documents),
        s as (
            select distinct doc_id, array_to_string(list_slice(w, i, i + 2), ' ') as gram
            from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0)),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.gram = b.gram and a.doc_id < b.doc_id group by all),
        l as (
            select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 90 * (x.n + y.n - common)),
        e as (select a, b from l union all select b, a from l),
        r as (select doc_id as node, doc_id as reached from d union select r.node, e.b from r join e on e.a = r.reached)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(reached) from r where node = d.doc_id) as component_id
        from d left join n on n.doc_id = d.doc_id""",
    "op4_warc_revisits": r"""
        with c as (
            select page_id, visit, url, '"' || substr(md5(coalesce(html, '')), 1, 12) || '"' as old, '"' || substr(md5(coalesce(html, '') || '2'), 1, 12) || '"' as new,
                   page_id % 3 = 0 and visit = 2 as renewed
            from pages, unnest(range(5)) as v(visit) where not (page_id % 10 = 9 and visit = 0)),
        r as (
            select page_id * 5 + visit as record_id, case when visit = 0 or renewed then 'response' else 'revisit' end as kind,
                   case when visit % 2 = 1 then regexp_replace(url, '^https?://', 'HTTP://WWW.') || '#again' else url end as url,
                   page_id * 10 + visit * 1000003 as at,
                   case when visit = 1 and page_id % 2 = 0 then 'W/' || old when visit = 4 then null when renewed then new else old end as etag,
                   'day ' || case when renewed then page_id % 28 + 2 else page_id % 28 + 1 end as modified, 'visit ' || visit as date_,
                   case when visit = 0 or renewed then '1' else '0' end as length_, visit::varchar as x
            from c),
        b as (select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from r),
        k as (
            select *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www[0-9]*\.', ''), ':(80|443)$', '')
                      || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') as stem,
                   list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' and not starts_with(p, 'utm_'))) as parameters
            from b),
        u as (select *, stem || case when len(parameters) > 0 then '?' || array_to_string(parameters, '&') else '' end as url_key from k),
        f as (select * from u where kind = 'response'),
        j as (
            select u.*, f.record_id as ref, f.etag as ref_etag, f.modified as ref_modified, f.date_ as ref_date, f.length_ as ref_length, f.x as ref_x
            from u left join f on u.kind = 'revisit' and u.url_key = f.url_key and f.at < u.at
            qualify row_number() over (partition by u.record_id order by f.at desc nulls last, f.record_id desc) = 1),
        s as (
            select *, case when kind = 'response' then 'response' when ref is null then 'orphan'
                           when etag is not null and ref_etag is not null then case when regexp_replace(etag, '^W/', '') <> regexp_replace(ref_etag, '^W/', '') then 'changed' else 'resolved' end
                           when modified <> ref_modified then 'changed' else 'resolved' end as state
            from j)
        select record_id, url_key, kind, state, ref as ref_id,
               concat_ws(chr(10), 'content-length: ' || case when state = 'resolved' then ref_length else length_ end, 'content-type: text/html', 'date: ' || date_,
                         'etag: ' || case when state = 'resolved' then coalesce(etag, ref_etag) else etag end,
                         'last-modified: ' || case when state = 'resolved' then ref_modified else modified end, 'x-visit: ' || case when state = 'resolved' then ref_x else x end) as headers
        from s""",
    "op5_substring_dedup": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        v as (
            select doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') as words
            from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
        m as (select doc_id, i, min(doc_id) over (partition by words) as low from v),
        c as (select distinct doc_id, unnest(range(i, i + 13)) as j from m where low < doc_id),
        x as (select doc_id, unnest(range(1, len(w) + 1)) as j, unnest(w) as word from d),
        k as (
            select doc_id, count(*) as n_words, count(c.j) as n_removed, string_agg(word, ' ' order by x.j) filter (c.j is null) as kept
            from x left join c using (doc_id, j) group by doc_id)
        select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from d left join k on k.doc_id = d.doc_id""",
    "op6_exact_dedup": r"""
        with d as (
            select doc_id, length(coalesce(text, '')) as n_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as plain
            from documents),
        g as (
            select *, count(*) over (partition by plain) as group_size,
                   first_value(doc_id) over (partition by plain order by n_points desc, doc_id nulls last) as keep_id
            from d)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(plain) as text_sha256, cast(n_points as integer) as n_points
        from g""",
    "op7_source_mix": r"""
        with d as (
            select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size
            from documents),
        s as (
            select source, cast(sum(size) as bigint) as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight
            from d group by source),
        l as (
            select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over f, 0)) / (sum(weight) over () - coalesce(sum(weight) over f, 0)) as level
            from s window f as (order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
        t as (
            select source, source_size,
                   least(cast(3 * source_size as double), max(level) over () * weight) as target
            from l),
        r as (
            select d.doc_id, d.source, d.size, t.source_size, t.target,
                   row_number() over (partition by d.source order by d.size, d.doc_id) - 1 as rank,
                   case when t.source_size > 0 then t.target / t.source_size else 0.0 end as share
            from d join t on d.source is not distinct from t.source),
        o as (
            select source, k, cast(('0x' || substr(md5('7|' || coalesce(source, chr(0) || 'null') || '|' || k), 1, 13)) as bigint) / 4503599627370496.0 as offset_
            from s, unnest(range(16)) as draws(k)),
        c as (
            select r.*, o.k, case when size > 0 then cast(least(floor(offset_ + share * (rank + 1)) - floor(offset_ + share * rank), 3) as bigint) else 0 end as copies
            from r join o on r.source is not distinct from o.source),
        b as (
            select source, k from c group by source, k, target
            qualify row_number() over (partition by source order by abs(sum(copies * size) - target), k) = 1)
        select doc_id, c.source, size, source_size, target, copies, copies * size as taken
        from c join b on c.source is not distinct from b.source and c.k = b.k""",
    "op10_suffix_dedup": r"""
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        v as (
            select doc_id, i, substring(h, 2 * i + 1, 100) as bytes
            from (select doc_id, h, unnest(range(len(h) // 2 - 49)) as i from d where len(h) >= 100)),
        m as (select doc_id, i, min(doc_id) over (partition by bytes) as low from v),
        f as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from m where low < doc_id),
        g as (select doc_id, i, sum(case when before is null or i > before + 50 then 1 else 0 end) over (partition by doc_id order by i) as span from f),
        s as (select doc_id, span, min(i) as begin_, max(i) + 50 as end_ from g group by doc_id, span),
        t as (select *, coalesce(lag(end_) over (partition by doc_id order by span), 0) as from_ from s),
        k as (
            select doc_id, sum(end_ - begin_) as n_removed, count(*) as n_spans, max(end_) as last_,
                   string_agg(substring(h, 2 * from_ + 1, 2 * (begin_ - from_)), '' order by span) as kept
            from t join d using (doc_id) group by doc_id)
        select d.doc_id, len(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
               sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last_, 0) + 1))) as kept_sha256
        from d left join k on k.doc_id = d.doc_id""",
    "op11_hard_negatives": r"""
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
            from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
            from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
        p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
        n as (
            select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as rank, vec_id as negative_id, positive_score, score as negative_score
            from p join s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
        select * from n where rank <= 3""",
    "op13_secret_scan": r"""
        with d as (select row_number() over () as row, doc_id, source, lang, coalesce(text, '') as text from documents),
        m as (
            select row, 0 as kind, regexp_split_to_array(text, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?(?:[A-Za-z0-9+/_.=-]+)') as p,
                   regexp_extract_all(text, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?(?:[A-Za-z0-9+/_.=-]+)') as x,
                   regexp_extract_all(text, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) as v from d
            union all select row, 1, regexp_split_to_array(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') from d
            union all select row, 2, regexp_split_to_array(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+') from d
            union all select row, 3, regexp_split_to_array(text, '[A-Za-z0-9+/_=-]{20,}'), regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}'), regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}') from d),
        s as (select row, kind, list_transform(p, lambda a: len(a)) as p, list_transform(x, lambda a: len(a)) as x, v, unnest(range(1, len(x) + 1)) as k from m),
        u as (
            select row, kind, cast(list_sum(p[1:k]) + coalesce(list_sum(x[1:k - 1]), 0) as bigint) as start, x[k] as size, v[k] as value
            from s where len(v[k]) >= case kind when 0 then 8 when 1 then 16 when 2 then 32 else 20 end),
        l as (
            select *, start + size as end_,
                   len(value) >= 20 and regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]') and len(list_distinct(string_split(value, ''))) >= 10 as random
            from u),
        c as (
            select * from l where kind < 3
            union all select * from l where kind = 3 and random and not exists (select 1 from l b where b.row = l.row and b.kind < 3 and b.start < l.end_ and l.start < b.end_)),
        f as (
            select value, count(distinct {'a': source}) <= 3 and count(distinct {'a': source, 'b': lang}) <= 6 as specific
            from c join d using (row) where random group by value),
        j as (
            select row, kind, start, end_, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || start || ':' || end_ as span,
                   random and not coalesce(specific, false) as example
            from c left join f using (value) where kind < 3 or specific),
        g as (
            select row, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, count(*) filter (kind = 3) as n_live,
                   count(*) filter (example) as n_example, string_agg(span, ',' order by start, kind) filter (kind < 3) as base, string_agg(span, ',' order by start, kind) as spans
            from j group by row)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example,
               sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
        from d left join g using (row)""",
}
