"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

SQL: dict[str, str] = {}

_OP7_LEVEL = """
{name}_g as (select {keys}, sum(n) n, sum(k) k, {prior} p from {source} group by {keys}{more}),
{name}_m as (select 1 / least(greatest(coalesce(sum(power(k - n * p, 2) - n * p * (1 - p)) / nullif(sum(n * (n - 1) * p * (1 - p)), 0), 0.5), 0.001), 0.999) - 1 m from {name}_g),
{name} as (select {name}_g.*, (k + m * p) / (n + m) rate, n + m w from {name}_g, {name}_m),
"""

SQL["op7_url_filters"] = (
    r"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end r from pages),
parsed as (select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path from u),
said as (select doc_id page_id, min(case when quality = 1 and coalesce(toxic, 0) = 0 then 1 else 0 end) good from labels
    where quality is not null and doc_id is not null group by doc_id),
counted as (select host, count(good) n, coalesce(sum(good), 0) k from parsed left join said using (page_id) group by host),
split as (select *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') l from counted),
hosts as (select host, n, k, array_to_string(l[greatest(len(l) - 1, 1):], '.') as domain, l[len(l)] as suffix from split),
whole as (select case when sum(n) > 0 then (sum(k) + 1) / (sum(n) + 1) else 1.0 end p from hosts),
"""
    + _OP7_LEVEL.format(name="s", keys="suffix", prior="any_value(whole.p)", source="hosts, whole", more="")
    + _OP7_LEVEL.format(name="d", keys="d.domain, d.suffix", prior="s.rate", source="hosts d join (select suffix, rate from s) s using (suffix)", more=", s.rate").replace("sum(n) n", "sum(d.n) n").replace("sum(k) k", "sum(d.k) k").replace("d.suffix", "d.suffix")
    + _OP7_LEVEL.format(name="h", keys="h.host", prior="d.rate", source="hosts h join (select domain, suffix, rate from d) d using (domain, suffix)", more=", d.rate").replace("sum(n) n", "sum(h.n) n").replace("sum(k) k", "sum(h.k) k")
    + r"""
judged as (select page_id, host, path, rate + 1.645 * sqrt(rate * (1 - rate) / (w + 1)) as upper, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
    from parsed join h using (host))
select page_id, host, path, rule, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
    when upper < 0.5 then 'block' else 'allow' end as verdict from judged
"""
)

SQL["op13_line_dedup"] = r"""
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
lines as (select doc_id, unnest(range(len(ls))) pos, unnest(ls) line from split),
keyed as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from lines),
firsts as (select k, min(doc_id) f from keyed where length(k) >= 10 group by k having count(distinct doc_id) > 1)
select doc_id, count(*) n_lines, count(*) filter (f is not null and doc_id <> f) n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (f is null or doc_id = f), '')) kept_sha256
from keyed left join firsts using (k) group by doc_id
"""

SQL["op12_phrases"] = r"""
with low as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
pieces as (select lang, unnest(string_split_regex(t, '[.,;:!?\n\x0b\x0c\r]')) p from low),
worded as (select lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') ws from pieces),
starts as (select lang, ws, unnest(range(1, len(ws) + 1)) i from worded),
counts as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') phrase, count(*) f from starts, (values (1), (2), (3), (4)) t(k) where i + k - 1 <= len(ws) group by all),
totals as (select lang, sum(f)::bigint n from counts where k = 1 group by lang),
cand as (select lang, k, phrase, string_split(phrase, ' ') ws, f a from counts where k > 1 and f >= 30),
cuts as (select lang, phrase, a, c, array_to_string(ws[1:c], ' ') lp, array_to_string(ws[c + 1:], ' ') rp from (select *, unnest(range(1, k)) c from cand)),
scored as (select cuts.lang, cuts.phrase, a, c, x.f l, y.f r, ((2000000::hugeint * a) // (x.f::hugeint + y.f))::bigint score from cuts
    join counts x on x.lang = cuts.lang and x.phrase = lp join counts y on y.lang = cuts.lang and y.phrase = rp),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
inner_ as (select lang, a, array_to_string(ws[i:i + m - 1], ' ') phrase from (select *, unnest(range(1, k - m + 2)) i from (select *, unnest(range(2, k)) m from cand))),
around as (select lang, phrase, max(a) most from inner_ group by all),
stay as (select lowest.* from lowest left join around using (lang, phrase) where most is null or 100 * most::hugeint < 80 * a::hugeint)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from stay join totals using (lang)
qualify rank <= 2000
"""
