"""SQL that gives the same rows as the queries of this package, where SQL can express them."""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op1_line_dedup": f"""
        with docs as (
            select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents
        ), lines as (
            select doc_id, unnest(parts) as line, unnest(generate_series(1, len(parts))) as place from docs
        ), items as (
            select doc_id, place, trim(line, {_BLANKS}) as item,
                   row_number() over (partition by doc_id order by place) as k
            from lines where trim(line, {_BLANKS}) <> ''
        ), runs as (
            select doc_id, k, place,
                   case when lead(item, 2) over w is not null
                        then item || chr(10) || lead(item) over w || chr(10) || lead(item, 2) over w end as run
            from items window w as (partition by doc_id order by k)
        ), later as (
            select doc_id, k, place, run is not null and row_number() over (
                partition by run order by doc_id, k) > 1 as again from runs
        ), gone as (
            select doc_id, place, bool_or(again) over (
                partition by doc_id order by k rows between 2 preceding and current row) as removed from later
        ), kept as (
            select l.doc_id, l.place, l.line, coalesce(g.removed, false) as removed, g.place is not null as item
            from lines l left join gone g on g.doc_id = l.doc_id and g.place = l.place
        )
        select doc_id, cast(sum(cast(item as integer)) as bigint) as n_lines,
               cast(sum(cast(removed as integer)) as bigint) as n_removed,
               sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not removed), '')) as kept_sha256
        from kept group by doc_id
    """,
    "op5_exact_dedup": r"""
        with digests as (
            select doc_id,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
            from documents
        )
        select doc_id, min(doc_id) over (partition by text_sha256) as keep_id,
               count(*) over (partition by text_sha256) as group_size,
               doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256
        from digests
    """,
    "op7_substring_dedup": r"""
        with docs as (
            select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
            from documents
        ), starts as (
            select doc_id, unnest(generate_series(1, len(words) - 49)) as start, words from docs where len(words) >= 50
        ), windows as (
            select doc_id, start, array_to_string(list_slice(words, start, start + 49), ' ') as content from starts
        ), owned as (
            select doc_id, start, min(doc_id) over (partition by content) < doc_id as again from windows
        ), marks as (
            select doc_id, list(start) as starts from owned where again group by doc_id
        ), words as (
            select d.doc_id, unnest(d.words) as word, unnest(generate_series(1, len(d.words))) as place
            from docs d join marks using (doc_id) where len(d.words) > 0
        ), covered as (
            select w.doc_id, w.place, w.word,
                   coalesce(max(case when o.again then o.start end) over (
                       partition by w.doc_id order by w.place rows between unbounded preceding and current row), -99)
                   > w.place - 50 as removed
            from words w left join owned o on o.doc_id = w.doc_id and o.start = w.place
        ), cut as (
            select doc_id, cast(sum(cast(removed as integer)) as bigint) as n_removed,
                   coalesce(string_agg(word, ' ' order by place) filter (where not removed), '') as kept
            from covered group by doc_id
        )
        select d.doc_id, cast(len(d.words) as bigint) as n_words, coalesce(c.n_removed, 0) as n_removed,
               sha256(coalesce(c.kept, array_to_string(d.words, ' '))) as kept_sha256
        from docs d left join cut c using (doc_id)
    """,
    "op13_conversation_trie": r"""
        with turns as (
            select conv_id, turn, coalesce(text, '') as text,
                   sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest
            from conversations where conv_id is not null
        ), placed as (
            select conv_id, digest, text, row_number() over (
                partition by conv_id order by turn nulls first, digest) as place
            from turns
        ), digits as (
            select conv_id, unnest(string_split(cast(conv_id as varchar), '')) as c,
                   unnest(generate_series(1, len(cast(conv_id as varchar)))) as k
            from (select distinct conv_id from turns)
        ), places as (
            select conv_id, list(cast(ascii(c) as bigint) order by k) as codes from digits group by conv_id
        ), hashed as (
            select conv_id, list_reduce(list_prepend(4294967295, codes), lambda a, b: list_reduce(
                [xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
                lambda p, q: case when p % 2 = 1 then xor(p // 2, 3988292384) else p // 2 end)) as crc
            from places
        ), convs as (
            select conv_id, conv_id - conv_id % 20 as base,
                   case when conv_id % 20 = 0 then 0 else xor(crc, 4294967295) % 4 end as skipped
            from hashed
        ), lent as (
            select c.conv_id, p.place as depth, p.digest, p.text
            from convs c join placed p on p.conv_id = c.base and p.place <= c.skipped
        ), heads as (
            select conv_id, count(*) as head from lent group by conv_id
        ), steps as (
            select * from lent
            union all
            select c.conv_id, p.place - c.skipped + coalesce(h.head, 0), p.digest, p.text
            from placed p join convs c using (conv_id) left join heads h using (conv_id) where p.place > c.skipped
            union all
            select conv_id, 0, '', '' from convs
        ), paths as (
            select conv_id, cast(depth as bigint) as depth, text,
                   string_agg(digest, '') over (partition by conv_id order by depth) as path,
                   max(depth) over (partition by conv_id) = depth as last
            from steps
        ), nodes as (
            select depth, path, min(conv_id) as conv_id, count(*) as n_convs,
                   any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) as words,
                   string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where last) as ends
            from paths group by depth, path
        ), kin as (
            select n.depth, n.path, n.conv_id, p.path as parent_path, m.conv_id as parent_conv_id
            from nodes n join paths p on p.conv_id = n.conv_id and p.depth = n.depth - 1
            join nodes m on m.depth = p.depth and m.path = p.path
        ), born as (
            select depth - 1 as depth, parent_path as path, count(*) as n_children from kin group by all
        ), whole as (
            select n.*, coalesce(b.n_children, 0) as n_children, k.parent_conv_id
            from nodes n left join born b using (depth, path) left join kin k using (depth, path)
        ), subtrees as (
            select p.depth, p.path, count(*) filter (where u.n_children = 0) as n_leaves,
                   cast(sum((u.n_convs - 1) * u.words) as bigint) as saved_tokens
            from whole u join paths p on p.conv_id = u.conv_id and p.depth <= u.depth
            group by p.depth, p.path
        )
        select w.conv_id, w.depth, w.parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens,
               sha256(coalesce(w.ends, '')) as ends_sha256
        from whole w join subtrees s using (depth, path)
    """,
}
