"""DuckDB twins of the corpus queries that SQL can express."""

TWINS: dict[str, str] = {}

TWINS["op1_decontaminate"] = r"""
with word_lists as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
item_lists as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
windows as (
    select distinct item_id, least(len(w), 10) size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') gram
    from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from item_lists where len(w) > 0)),
sizes as (select distinct size from windows),
grams as (
    select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') gram
    from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) i from word_lists, sizes where len(w) >= size)),
hits as (select doc_id, item_id, i, size from grams join windows using (size, gram)),
words_hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + size)) p from hits) group by 1),
found as (
    select doc_id, count(*) n_items, string_agg(item, ',' order by item) items
    from (select distinct doc_id, item_id::varchar item from hits where item_id is not null) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
    sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from word_lists left join words_hit using (doc_id) left join found using (doc_id)
"""

TWINS["op3_mix"] = r"""
with sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
        ('0x' || substr(md5('mix' || doc_id::varchar), 1, 12))::bigint::double / 281474976710656.0 place from documents),
totals as (select source, sum(size)::bigint words from sized group by 1),
budget as (select sum(words)::double all_words from totals),
weighed as (
    select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end weight,
        words::double * 3 most from totals),
ranked as (
    select *, coalesce(sum(most) over r, 0) full_before, sum(weight) over () - coalesce(sum(weight) over r, 0) weight_left
    from weighed window r as (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding)),
filled as (select *, most * weight_left <= weight * (all_words - full_before) as is_full from ranked, budget),
shares as (
    select source, words, case when is_full then most else
        (all_words - coalesce(sum(most) filter (is_full) over (), 0)) * weight / sum(weight) filter (not is_full) over () end target from filled),
queued as (
    select s.*, words, target, sum(size) over (partition by s.source order by place, doc_id, size rows unbounded preceding) reached
    from sized s join shares t on s.source is not distinct from t.source),
copies as (
    select doc_id, source, place, size, (n * words + reached)::double / target finish
    from queued, range(3) r(n) where size > 0 and target > 0),
running as (
    select *, sum(size) over (order by finish, coalesce(source, ''), source is null, place, size rows unbounded preceding) upto from copies),
taken as (select doc_id, source, place, sum(size) taken from running, budget where upto <= all_words group by 1, 2, 3)
select doc_id, size, words source_size, target, coalesce(taken, 0)::bigint taken
from queued left join taken using (doc_id, place)
"""

TWINS["op8_ngram_join"] = r"""
with recursive word_lists as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') w from documents),
grams as (
    select distinct doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') gram
    from (select doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) i from word_lists where len(w) > 0)),
sizes as (select doc_id, count(*) n from grams group by 1),
common as (
    select x.doc_id a, y.doc_id b, count(*) n from grams x join grams y on x.gram = y.gram and x.doc_id <> y.doc_id group by 1, 2),
links as (
    select a, b from common c join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c.n >= 80 * (x.n + y.n - c.n)),
reach as (
    select doc_id a, doc_id b from documents
    union select r.a, l.b from reach r join links l on r.b = l.a),
least_reached as (select a doc_id, min(b) component_id from reach group by 1)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id from least_reached left join sizes using (doc_id)
"""

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"""
_ID = r"""((?i:client_?id|access_?key_?id|account(?:_?id)?|user(?:_?name)?|login))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9@._-]+)"""
_VALUE = r"""((?i:pass|pwd|key|auth|credential|signature))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"""
_ENDPOINT = r"""(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\x00-\x20\x22\x27<>]+"""
_KINDS = (
    (1, "assign", _ASSIGN, 2, 8, "secret"), (2, "access", "AKIA[A-Z0-9]+", 0, 16, "identifier"), (3, "hex", "[0-9a-f]+", 0, 32, "secret"),
    (4, "id", _ID, 2, 3, "identifier"), (5, "value", _VALUE, 2, 8, "secret"), (6, "endpoint", _ENDPOINT, 0, 8, "endpoint"),
    (7, "break", r"\n[\x20\t\r]*\n", 0, 0, "break"),
)
_MATCHES = " union all ".join(
    f"select doc_id, {n} ord, '{kind}' kind, '{part}' part, {least} least, regexp_extract_all(text, '{pattern}') found, "
    f"regexp_extract_all(text, '{pattern}', {group}) held, regexp_split_to_array(text, '{pattern}') gaps from texts"
    for n, kind, pattern, group, least, part in _KINDS)
TWINS["op2_secrets"] = f"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
matches as ({_MATCHES}),
pieces as (
    select doc_id, ord, kind, part, least, nth, length(gaps[nth]) gap, length(found[nth]) size, length(held[nth]) held
    from (select *, unnest(range(1, len(found) + 1)) nth from matches where len(found) > 0)),
placed as (
    select *, sum(gap + size) over (partition by doc_id, kind order by nth)::bigint as stop from pieces),
parts as (select doc_id, ord, kind, part, stop - size as start, stop from placed where held >= least),
scoped as (
    select *, sum((kind = 'break')::int) over (partition by doc_id order by start, stop rows unbounded preceding) as scope_no from parts),
linked as (
    select w.doc_id, w.ord, w.kind, w.start, w.stop from scoped w join scoped o
    on w.doc_id = o.doc_id and w.scope_no = o.scope_no and o.part <> w.part and o.start <= w.stop + 300 and o.stop >= w.start - 300
    where w.ord between 4 and 6 and o.kind <> 'break' group by all having count(distinct o.part) = 2),
every as (
    select doc_id, ord, kind, start, stop from parts where ord <= 3 union all select doc_id, ord, kind, start, stop from linked),
written as (
    select doc_id, count(*) filter (ord = 1) n_assign, count(*) filter (ord = 2) n_access, count(*) filter (ord = 3) n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) filter (ord <= 3) base,
        string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) spans
    from every group by 1)
select doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex,
    sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from texts left join written using (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TWINS["op11_collocations"] = rf"""
with pieces as (
    select coalesce(lang, 'und') lang, regexp_extract_all(unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') w
    from documents),
places as (select lang, w, unnest(range(1, len(w) + 1)) i from pieces),
f1 as (select lang, w[i] x, count(*) n from places group by all),
f2 as (select lang, w[i] x, w[i + 1] y, count(*) n from places where i < len(w) group by all),
f3 as (select lang, w[i] x, w[i + 1] y, w[i + 2] z, count(*) n from places where i + 1 < len(w) group by all having n >= 10),
totals as (select lang, sum(n)::bigint n from f1 group by 1),
around as (
    select lang, x, y, max(n) longest from (select lang, x, y, n from f3 union all select lang, y, z, n from f3) group by all),
cuts as (
    select p.lang, p.x || ' ' || p.y phrase, p.n a, 1 k, l.n l, r.n r
    from f2 p join f1 l on l.lang = p.lang and l.x = p.x join f1 r on r.lang = p.lang and r.x = p.y
    left join around s on s.lang = p.lang and s.x = p.x and s.y = p.y
    where p.n >= 10 and coalesce(100 * longest < 50 * p.n, true)
    union all
    select p.lang, p.x || ' ' || p.y || ' ' || p.z, p.n, 1, l.n, r.n
    from f3 p join f1 l on l.lang = p.lang and l.x = p.x join f2 r on r.lang = p.lang and r.x = p.y and r.y = p.z
    union all
    select p.lang, p.x || ' ' || p.y || ' ' || p.z, p.n, 2, l.n, r.n
    from f3 p join f2 l on l.lang = p.lang and l.x = p.x and l.y = p.y join f1 r on r.lang = p.lang and r.x = p.z),
scored as (
    select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint score from cuts),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from lowest join totals using (lang) qualify rank <= 2000
"""

# crc32: every byte is mixed in, then eight steps to the right (the marks of 256)
_CRC32 = """list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar || ':' || run, ''),
        lambda c: flatten(list_transform(case when unicode(c) < 128 then [unicode(c)] else [195, unicode(c) - 64] end,
        lambda b: [b::bigint, 256, 256, 256, 256, 256, 256, 256, 256]))))),
        lambda crc, b: case when b < 256 then xor(crc, b) else xor(crc >> 1, 3988292384 * (crc & 1)) end)"""

TWINS["op12_spelling"] = rf"""
with recursive runs as (
    select doc_id, run, count(*) times
    from (select doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) run from documents) where length(run) >= 6 group by all),
hashed as (select run, times, xor({_CRC32}, 4294967295) h from runs),
written as (
    select times, case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word from hashed),
words as (select word, sum(times)::bigint n from written where length(word) >= 6 group by 1 having sum(times) >= 5),
places as (select word, n, unnest(range(1, length(word) + 1)) i from words),
cut as (select word, n, i, left(word, (i - 1)::int) || substr(word, (i + 1)::int) rest from places),
near as (
    select a.word, a.n, b.word near, b.n near_n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
    union select a.word, a.n, b.word, b.n from words a join cut b on a.word = b.rest
    union select b.word, b.n, a.word, a.n from words a join cut b on a.word = b.rest),
best as (select word, count(*) n_near, max(near_n) form_n, arg_min(near, (-near_n, near)) form from near group by 1),
formed as (
    select w.word, w.n, coalesce(n_near, 0) n_near, case when form_n >= 5 * w.n then form end form, case when form_n >= 5 * w.n then form_n end form_n
    from words w left join best using (word)),
chain as (
    select word, word reached, 0 step from formed union all
    select c.word, f.form, step + 1 from chain c join formed f on f.word = c.reached where f.form is not null),
roots as (select word, arg_max(reached, step) root from chain group by 1)
select word, n, n_near::bigint n_near, form, form_n, root from formed join roots using (word)
"""
