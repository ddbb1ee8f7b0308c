"""DuckDB SQL for the queries, from the tables alone: another way to the same rows."""

from __future__ import annotations

SQL: dict[str, str] = {}

EV = "ev as (select event_id pos, value v, event_id // 100 tile from events)"
BIN = "case when v < 0 or v >= 4294967295 then null when v >= 500 then 10 else cast(floor(v / 50) as integer) end"
FIELDS = "n, round(sum, 4) sum, min, max, round(m1, 10) m1, round(sign(m2) * power(abs(m2), 1.0 / 2), 4) m2r, round(sign(m3) * power(abs(m3), 1.0 / 3), 4) m3r, round(sign(m4) * power(abs(m4), 1.0 / 4), 4) m4r"


def _moments(source: str, group: str, name: str = "mom") -> str:
    """CTEs: moments of v in each group of source."""
    return (
        f"{name}_a as (select {group}, sum(v) / count(*) m1 from {source} group by {group}), "
        f"{name} as (select {group}, count(*)::double n, sum(v)::double sum, min(v)::double as min, max(v)::double as max, any_value(m1) m1, "
        f"sum(power(v - m1, 2)) m2, sum(power(v - m1, 3)) m3, sum(power(v - m1, 4)) m4 from {source} join {name}_a using ({group}) group by {group})"
    )


STD = "m1 mean, case when m2 > 0 and n > 1 then sqrt(m2 / (n - 1)) else 0 end std, case when m2 > 0 then sqrt(n) * m3 / power(m2, 1.5) else 0 end skew, case when m2 > 0 then n * m4 / (m2 * m2) - 3 else -3 end kurt"

SQL["tile_moments"] = f"with {EV}, {_moments('ev', 'tile')} select tile, {FIELDS} from mom"
SQL["sparse_tile_moments"] = f"""with kinds as (select distinct event_type track from events),
dense as (select track, event_id // 100 tile, case when event_type = track then value else 0.0 end v, event_type = track as here from events, kinds),
{_moments("dense", "track, tile")}
select track, tile, {FIELDS} from mom where (track, tile) in (select (track, tile) from dense where here)"""
SQL["running_moments"] = f"with {EV}, {_moments('ev', 'tile')}, s as (select tile, n, {STD} from mom) select tile, n::bigint n, round(mean, 6) mean, round(std, 6) std, round(skew, 6) skew, round(kurt, 6) kurt from s"
SQL["standardized_moments"] = f"with {EV}, {_moments('ev', 'tile')}, s as (select tile, {STD} from mom) select tile, round(mean, 6) mean, round(std, 6) std, round(skew, 6) skew, round(kurt, 6) kurt from s"
SQL["window_skew_kurt"] = f"with {EV}, {_moments('ev', 'tile')}, s as (select tile, {STD} from mom) select tile, round(skew, 6) skew, round(kurt, 6) kurt from s"
SQL["window_range_var_std"] = f"""with {EV}, s as (select tile, count(*) n, max(v) - min(v) r, coalesce(var_samp(v), 0) x from ev group by tile)
select tile, round(r, 4) as "range", round(r * n, 2) range_scaled, round(x, 4) var, round(sqrt(x), 6) std from s"""


def _pyramid(branch: int) -> str:
    return f"""levels as (select (100 * power({branch}, k))::bigint as "window" from range(0, 12) t(k), (select max(event_id) + 1 len from events) where k = 0 or 100 * power({branch}, k) <= len),
lev as (select "window", event_id // "window" tile, value v from events, levels), {_moments("lev", '"window", tile', "pyr")}"""


for _name, _b in (("pyramid_levels", 10), ("rebranch_pyramid", 4)):
    SQL[_name] = f'with {_pyramid(_b)} select "window", tile, {FIELDS} from pyr'
SQL["overlapping_merge"] = f"""with {EV}, spread as (select tile - k tile, v from ev, range(0, 5) t(k) where tile - k >= 0 and tile - k + 4 <= (select max(tile) from ev)), {_moments("spread", "tile")} select tile, {FIELDS} from mom"""
SQL["chunk_collapse"] = f"with whole as (select 'events' seq, 'value' track, value v from events), {_moments('whole', 'seq, track')} select seq, track, {FIELDS} from mom"


def _sliding(width: int, key: str) -> str:
    c = "(select avg(value) from events)"
    w = f"over (order by event_id rows between current row and {width - 1} following)"
    x = f"(value - {c})"
    return f"""with s as (select event_id pos, count(*) {w} k, min(value) {w} as min, max(value) {w} as max, {c} c, sum({x}) {w} s1, sum(power({x}, 2)) {w} s2, sum(power({x}, 3)) {w} s3, sum(power({x}, 4)) {w} s4 from events),
mom as (select pos {key}, k::double n, s1 + k * c sum, min, max, s1 / k + c m1, s2 - s1 * s1 / k m2, s3 - 3 * s1 / k * s2 + 2 * power(s1 / k, 2) * s1 m3,
s4 - 4 * s1 / k * s3 + 6 * power(s1 / k, 2) * s2 - 3 * power(s1 / k, 3) * s1 m4 from s where k = {width}) select {key}, {FIELDS} from mom"""


SQL["sliding_moments"] = _sliding(100, "pos")
SQL["sliding_binary_merge"] = _sliding(40, "tile")
SQL["sliding_target_merge"] = _sliding(60, "tile")
SQL["sliding_minmax"] = """with s as (select event_id pos, count(*) over w k, min(value) over w as min, max(value) over w as max from events window w as (order by event_id rows between current row and 99 following))
select pos, min, max from s where k = 100"""

_B = f"b as (select event_id pos, event_id // 100 tile, {BIN.replace('v ', 'value ').replace('(v ', '(value ')} bin from events)"
SQL["tile_spectrum"] = f"with {_B} select tile, bin, count(*) cnt from b where bin is not null group by all"
SQL["merged_spectrum"] = f"with {_B} select tile // 10 tile, bin, count(*) cnt from b where bin is not null group by all"
SQL["overlapping_spectrum"] = f"with {_B} select tile - k tile, bin, count(*) cnt from b, range(0, 5) t(k) where bin is not null and tile - k >= 0 and tile - k + 4 <= (select max(tile) from b) group by all"
SQL["sliding_spectrum"] = f"with {_B} select pos - k pos, bin, count(*) cnt from b, range(0, 100) t(k) where bin is not null and pos - k >= 0 and pos - k + 99 <= (select max(pos) from b) group by all"
SQL["sliding_spectrum_merge"] = f"with {_B} select pos - k tile, bin, count(*) cnt from b, range(0, 60) t(k) where bin is not null and pos - k >= 0 and pos - k + 59 <= (select max(pos) from b) group by all"
_T = f"{_B}, t as (select pos, tile, bin from_bin, lead(bin) over (order by pos) to_bin from b), st as (select * from t where from_bin is not null and to_bin is not null)"
SQL["tile_transitions"] = f"with {_T} select tile, from_bin, to_bin, count(*) cnt from st group by all"
SQL["inner_transitions"] = f"with {_T} select tile, from_bin, to_bin, count(*) cnt from st where (pos + 1) // 100 = tile group by all"
SQL["merged_transitions"] = f"with {_T} select tile // 10 tile, from_bin, to_bin, count(*) cnt from st group by all"
SQL["sliding_transitions"] = f"with {_T} select pos - k pos, from_bin, to_bin, count(*) cnt from st, range(0, 99) r(k) where pos - k >= 0 and pos - k + 99 <= (select max(pos) from b) group by all"

_lev = """levels as (select (100 * power(10, k))::bigint as "window" from range(0, 12) t(k), (select max(event_id) + 1 len from events) where k = 0 or 100 * power(10, k) <= len)"""
SQL["spectrum_pyramid"] = f"""with {_B}, {_lev} select "window", pos // "window" tile, bin, count(*) cnt from b, levels where bin is not null group by all"""
SQL["transition_pyramid"] = f"""with {_T}, {_lev} select "window", pos // "window" tile, from_bin, to_bin, count(*) cnt from st, levels group by all"""
_kinds = f"k as (select event_type track, event_id pos, {BIN.replace('v ', 'value ').replace('(v ', '(value ')} bin from events), kt as (select track, bin from_bin, lead(bin) over w to_bin, lead(pos) over w - pos gap from k window w as (partition by track order by pos))"
SQL["collapsed_counts"] = f"""with {_kinds} select track, -1 from_bin, bin to_bin, count(*) cnt from k where bin is not null group by all
union all select track, from_bin, to_bin, count(*) cnt from kt where gap = 1 and from_bin is not null and to_bin is not null group by all"""
_end = """size as (select max(event_id) + 1 len from events), tail as (select tile, least(100, len - tile * 100) - {less} width from (select len, (len - 1) // 100 - k tile from size, range(0, 10) t(k)) where tile >= 0),
judged as (select tile, width, coalesce(n, 0) >= width good from tail left join (select tile, sum(cnt) n from c group by tile) using (tile)),
bad as (select tile, width from judged where tile > coalesce((select max(tile) from judged where good), -1))"""
SQL["clean_spectrum_end"] = f"""with {_B}, c as (select tile, bin, count(*) cnt from b where bin is not null and pos < (select max(event_id) + 1 - 250 from events) group by all), {_end.format(less=0)}
select * from c where tile not in (select tile from bad) union all select tile, 0, width from bad where width > 0"""
SQL["clean_transition_end"] = f"""with {_T}, c as (select tile, from_bin, to_bin, count(*) cnt from st where (pos + 1) // 100 = tile and pos + 1 < (select max(event_id) + 1 - 250 from events) group by all), {_end.format(less=1)}
select * from c where tile not in (select tile from bad) union all select tile, 0, 0, width from bad where width > 0"""
SQL["dense_spectra"] = f"""with {_B}, c as (select tile, bin, count(*) cnt from b where bin is not null group by all), t as (select distinct tile from c)
select tile, string_agg(coalesce(cnt, 0)::varchar, ',' order by j) counts from (select * from t, range(0, 11) r(j)) left join (select tile, bin j, cnt from c) using (tile, j) group by tile"""
SQL["dense_matrices"] = f"""with {_T}, c as (select tile, to_bin i, from_bin j, count(*) cnt from st group by all), tt as (select distinct tile from c),
r as (select tile, i, string_agg(coalesce(cnt, 0)::varchar, ',' order by j) x from (select * from tt, range(0, 11) a(i), range(0, 11) r(j)) left join c using (tile, i, j) group by tile, i)
select tile, string_agg(x, ';' order by i) counts from r group by tile"""
SQL["flat_chunks"] = f"""with {_B} select tile // 10 chunk, tile, bin, count(*) cnt from b where bin is not null and tile % 10 = 2 group by all"""
SQL["selected_moments"] = f"with {EV}, {_moments('ev', 'tile')}, s as (select tile, {STD} from mom) select tile, round(kurt, 6) kurt, round(mean, 6) mean, round(mean, 6) again from s"
SQL["dataset_attributes"] = f"""with {_B}, size as (select max(event_id) + 1 len from events), f as (select 'moments' feature, tile, 1 j from b group by tile union all select 'spectrum', tile, 1 from b where bin is not null group by tile)
select 's' sm, 'all' rg, 'events' seq, 'value' track, feature, 100 as "window", min(tile) first_tile, count(*) tiles, count(*) = (any_value(len) + 99) // 100 tile, 100 window_root, 10 window_branch, any_value(len) len, 500 max_depth,
case when feature = 'moments' then (select count(*)::double from events) end total_n, case when feature = 'moments' then (select round(sum(value), 2) from events) end total_sum,
case when feature = 'moments' then 'none' else '0,50,100,150,200,250,300,350,400,450,500,4294967295' end bins, case when feature = 'moments' then 0 else 11 end bin_count from f, size group by feature"""

READS = """reads as (select 's' || (l_suppkey % 4) sm, 'rg' || l_linenumber rg, l_returnflag || l_linestatus seq, date_diff('day', date '1995-01-01', l_shipdate::date) pos,
date_diff('day', date '1995-01-01', l_shipdate::date) + l_quantity::integer ref_end, l_quantity::integer rlen, 7 * round(l_tax * 100)::integer mapq, l_orderkey % 401 - 200 tlen,
round(l_discount * 100) <= 5 proper, l_partkey % 37 = 0 alone, l_partkey % 2 = 1 rev, l_suppkey % 2 = 1 mate_rev, l_linenumber = 6 secondary, l_orderkey % 10 = 0 elsewhere
from lineitem where l_partkey % 101 <> 0 and l_linenumber <> 7)"""
CLASSES = """cls as (select *, not proper and not elsewhere and not alone discordant, rev = mate_rev same, rev <> mate_rev and ((rev and tlen > 0) or (not rev and tlen < 0)) outward from reads),
pp as (select *, unnest(range(pos, pos + rlen)) p from cls)"""
SQL["coverage_total"] = f"with {READS} select seq, p pos, count(*) total from (select seq, unnest(range(pos, ref_end)) p from reads) group by all"
SQL["coverage_runs"] = f"""with {READS}, e as (select sm, seq, pos p, 1 d from reads union all select sm, seq, ref_end, -1 from reads), s as (select sm, seq, p, sum(d) d from e group by all),
r as (select sm, seq, p as "start", lead(p) over w as "end", (sum(d) over w)::bigint total from s window w as (partition by sm, seq order by p)) select * from r where total > 0"""
SQL["coverage_moments"] = f"""with {READS}, len as (select seq, max(ref_end) len from reads group by seq), spine as (select seq, unnest(range(0, len)) pos from len),
d as (select seq, p pos, count(*) c from (select seq, unnest(range(pos, ref_end)) p from reads) group by all), dense as (select seq, pos // 100 tile, coalesce(c, 0) v from spine left join d using (seq, pos)),
{_moments("dense", "seq, tile")} select seq, tile, {FIELDS} from mom where max > 0"""
_n = lambda c, x="1": f"coalesce(sum({x}) filter (where {c}), 0)::bigint"
SQL["flag_tracks"] = f"with {READS}, {CLASSES} select seq, p pos, {_n('proper')} proper_pair, {_n('discordant')} discordant, {_n('not secondary')} as primary, {_n('secondary')} alternate from pp group by all"
SQL["strand_tracks"] = f"""with {READS}, {CLASSES} select seq, p pos, sum(case when rev then -1 else 1 end)::bigint fwd_rev_diff, {_n("same")} orient_same, {_n("outward")} orient_out,
{_n("not same and not outward and alone")} orient_um, {_n("not same and not outward and not alone and elsewhere")} orient_chr from pp group by all"""
_mean = lambda x, c: f"round((1 + {_n(c, x)}) / (1 + {_n(c)}) - 1, 6)"
SQL["mapq_tlen_tracks"] = f"with {READS}, {CLASSES} select seq, p pos, " + ", ".join(f"{_mean(x, c)} {x}{s}" for s, c in (("", "true"), ("_pp", "proper"), ("_dis", "discordant")) for x in ("mapq", "tlen")) + " from pp group by all"
SQL["projected_tlen_tracks"] = f"""with {READS}, {CLASSES}, len as (select l_returnflag || l_linestatus seq, max(date_diff('day', date '1995-01-01', l_shipdate::date) + l_quantity::integer) len from lineitem group by all),
plain as (select seq, p, count(*) n, {_n("proper")} n_pp, {_n("discordant")} n_dis from pp group by all),
wide as (select *, unnest(range(case when tlen < 0 then greatest(0, pos + tlen) else pos end, case when tlen > 0 then least(ref_end + tlen, len) else ref_end end)) p from cls join len using (seq) where tlen <> 0),
c as (select seq, p, {_n("proper")} a, {_n("discordant")} b, {_n("same")} c, {_n("outward")} d from wide group by all)
select seq, p pos, round((1 + a) / (1 + coalesce(n_pp, 0)) - 1, 6) tlen_pp_rd, round((1 + b) / (1 + coalesce(n_dis, 0)) - 1, 6) tlen_dis_rd, round((1 + c) / (1 + coalesce(n, 0)) - 1, 6) orient_same_rd,
round((1 + d) / (1 + coalesce(n, 0)) - 1, 6) orient_out_rd from c left join plain using (seq, p)"""
SQL["gc_rd_md_tracks"] = """with r as (select l_returnflag || l_linestatus seq, date_diff('day', date '1995-01-01', l_shipdate::date) pos, l_quantity::integer n, 7 * round(l_tax * 100)::integer mapq, l_linenumber = 6 secondary,
left(translate(md5(l_orderkey || '/' || l_linenumber), '0123456789abcdef', 'ACGTACGTACGTACGT'), l_quantity::integer) s from lineitem where l_linenumber <> 7),
pp as (select seq, unnest(range(pos, pos + length(s))) p, mapq, secondary, length(regexp_replace(s, '[^GC]', '', 'g')) / length(s) gc from r),
g as (select seq, p pos, count(*) n, sum(mapq) q, count(*) filter (where not secondary) pri, sum(gc) gc from pp group by all),
o as (select *, 2 * (1 + pri) * (1 + gc) / (1 + n) rd from g) select seq, pos, floor(gc * 1e6 + 0.5001) / 1e6 gc, floor(rd * 1e6 + 0.5001) / 1e6 rd, floor(rd * greatest(0, least(1, ((1 + q) / (1 + n) - 1) / 60)) * 1e6 + 0.5001) / 1e6 md from o"""
_reads_bases = """r as (select l_returnflag || l_linestatus seq, date_diff('day', date '1995-01-01', l_shipdate::date) pos,
left(translate(md5(l_orderkey || '/' || l_linenumber), '0123456789abcdef', 'ACGTACGTACGTACGT'), l_quantity::integer) s from lineitem where l_linenumber <> 7)"""
_two = [a + b for a in "ACGT" for b in "ACGT"]
SQL["dinucleotide_tracks"] = f"""with {_reads_bases}, c as (select *, {", ".join(f"(length(s) - length(replace(s, '{p}', ''))) / 2 / length(s) as {p[0]}_{p[1]}" for p in _two)} from r),
pp as (select *, unnest(range(pos, pos + length(s))) p from c) select seq, p pos, {", ".join(f"floor(sum({p[0]}_{p[1]}) * 1e5 + 0.5001) / 1e5 {p[0].lower()}_{p[1].lower()}" for p in _two)} from pp group by all"""
SQL["cigar_tracks"] = """with r as (select l_returnflag || l_linestatus seq, date_diff('day', date '1995-01-01', l_shipdate::date) pos, l_quantity::bigint q, l_suppkey % 45 f, l_partkey % 45 b, l_orderkey % 50 m,
['I', 'D', 'N', 'X'][(l_linenumber % 4 + 1)::integer] o from lineitem where l_linenumber <> 7),
e as (select *, case when o = 'I' then 0 else m end w from r),
s as (select seq, 'clipped' track, pos a, pos + f z from e where f >= 18 union all select seq, 'right_anchor', pos, pos + f from e where f >= 36 and b = 0
union all select seq, 'left_anchor', pos + f + 2 * q + w, pos + f + 2 * q + w + b from e where b >= 36 and f = 0 union all select seq, 'left_clipped', pos, pos + f from e where f >= 18
union all select seq, 'clipped', pos + f + 2 * q + w, pos + f + 2 * q + w + b from e where b >= 18 union all select seq, 'right_clipped', pos + f + 2 * q + w, pos + f + 2 * q + w + b from e where b >= 18
union all select seq, 'insertion', pos + f + q - 1, pos + f + q from e where o = 'I' and m > 0 union all select seq, 'deletion', pos + f + q, pos + f + q + m from e where o = 'D' and m > 0
union all select seq, 'big_del', pos + f + q, pos + f + q + m from e where o = 'D' and m >= 36 union all select seq, 'splice', pos + f + q, pos + f + q + m from e where o = 'N' and m > 0
union all select seq, 'substitution', pos + f + q, pos + f + q + m from e where o = 'X' and m > 0)
select seq, track, count(*) n, sum(z - a)::bigint bases, sum(a)::bigint starts from s group by all"""
_BAM = """r as (select l_orderkey || '/' || l_linenumber as name, l_returnflag || l_linestatus seq, date_diff('day', date '1995-01-01', l_shipdate::date) pos, l_quantity::bigint q, l_suppkey % 45 f, l_partkey % 45 b,
l_orderkey % 50 m, ['I', 'D', 'N', 'X'][(l_linenumber % 4 + 1)::integer] o, l_linenumber k, l_orderkey, l_tax, case when l_linenumber = 7 then 1024 else 0 end flag from lineitem),
c as (select *, case when f > 0 then f || 'S' else '' end || q || 'M' || case when m > 0 then m || o else '' end || q || '=' || case when b > 0 then b || 'H' else '' end cigar,
pos + 2 * q + case when o = 'I' then 0 else m end ref_end, f + 2 * q + case when o in ('I', 'X') then m else 0 end rlen from r)"""
SQL["bam_reads"] = f"""with {_BAM} select name, seq, pos, ref_end, flag, 7 * round(l_tax * 100)::integer mapq, seq mate_seq, pos mate_pos, l_orderkey % 401 - 200 tlen, cigar,
left(translate(repeat(md5(name), 7), '0123456789abcdef', 'ACGTACGTACGTACGN'), rlen) bases, case when k = 3 then 'none' else 'rg' || k end rg, rlen from c"""
SQL["bam_region"] = f"""with {_BAM}, i as (select 's' || (k % 2) sm, greatest(pos, 500) s, least(ref_end, 900) e from c where seq = 'NO' and pos < 900 and ref_end > 500 and k not in (3, 7)),
e as (select sm, s p, 1 d from i union all select sm, e, -1 from i), n as (select sm, p, sum(d) d from e group by all),
t as (select sm, p as "start", lead(p) over w as "end", (sum(d) over w)::bigint as depth from n window w as (partition by sm order by p)) select * from t where depth > 0"""
_REF = """ref as (select seq, line, translate(md5(seq || '/' || line), '0123456789abcdef', 'ACGTACGTACGTACGN') t from (select seq, unnest(range(0, n // 32 + 1)) line from
(select l_returnflag || l_linestatus seq, max(date_diff('day', date '1995-01-01', l_shipdate::date)) + 200 n from lineitem group by all)))"""
SQL["sliced_reference"] = f"""with {_REF}, whole as (select seq, string_agg(t, '' order by line) b from ref group by seq)
select seq, k slice, k * 100 as "start", substr(b, (k * 100 + 1)::bigint, 100) bases from (select *, unnest(range(0, (length(b) - 1) // 100 + 1)) k from whole)"""
SQL["exact_substitutions"] = f"""with {_BAM}, {_REF}, line as (select seq, line * 32 + k pos, t[(k + 1)::bigint] x from (select *, unnest(range(0, 32)) k from ref)),
d as (select *, translate(repeat(md5(name), 7), '0123456789abcdef', 'ACGTACGTACGTACGN') bases, case when o <> 'I' then m else 0 end w, case when o in ('I', 'X') then m else 0 end v from c where k <> 7),
s as (select seq, pos a, f z, q n, bases from d union all select seq, pos + q, f + q, m, bases from d where o = 'X' union all select seq, pos + q + w, f + q + v, q, bases from d),
b as (select seq, a + k pos, bases[(z + k + 1)::bigint] y from (select *, unnest(range(0, n)) k from s))
select seq, pos, count(*) substitution from b join line using (seq, pos) where x <> y group by all"""
SQL["duplicate_marks"] = """with i as (select l_returnflag || l_linestatus seq, l_orderkey || '/' || l_linenumber as name, 'rg' || (l_linenumber % 2) rg, date_diff('day', date '1995-01-01', l_shipdate::date) + 50 d,
l_partkey % 4 c, l_quantity::bigint n, l_suppkey % 2 = 1 back, l_orderkey % 40 q, l_linenumber k from lineitem),
r as (select name, rg, seq, d + c pos, 0 flag, d five, false rev, case when q >= 15 then q * (c + n) else 0 end s from i union all
select name, rg, seq, d + 200 - c - n, case when back then 16 else 0 end, case when back then d + 199 else d + 200 - c - n end, back, case when q >= 15 then q * (c + n) else 0 end from i where k % 3 > 0),
t as (select rg, name, min((seq, five, rev)) a, max((seq, five, rev)) b, sum(s) s, count(*) n from r group by all),
p as (select *, row_number() over (partition by rg, a, b order by s desc, name) i from t where n > 1), ends as (select rg, a from p union select rg, b from p),
l as (select *, row_number() over (partition by rg, a order by s desc, name) i, (rg, a) in (select (rg, a) from ends) taken from t where n = 1),
lost as (select rg, name from p where i > 1 union select rg, name from l where i > 1 or taken)
select name, rg, seq, pos, flag + case when (rg, name) in (select (rg, name) from lost) then 1024 else 0 end flag from r"""
_ACGT = "'0123456789abcdef', 'ACGTACGTACGTACGT'"
_smap = ", ".join(f"count(*) filter ({side} and {'same' if kind == 'same' else 'not same'}) {name}smap_{kind}" for name, side in (("left_", "side"), ("right_", "not side"), ("", "true")) for kind in ("same", "diff"))
SQL["smap_tracks"] = f"""with ref as (select seq, string_agg(translate(md5(seq || '/' || line), {_ACGT}), '' order by line) b from (select seq, unnest(range(0, n // 32 + 1)) line from
(select l_returnflag || l_linestatus seq, max(date_diff('day', date '1995-01-01', l_shipdate::date)) + 200 n from lineitem group by all)) group by seq),
r as (select l_returnflag || l_linestatus seq, date_diff('day', date '1995-01-01', l_shipdate::date) pos, l_quantity::bigint q, 20 + l_suppkey % 13 n, (l_orderkey * 37 + l_partkey * 11) % 2400 t, l_partkey % 3 = 0 flip,
l_linenumber % 2 = 1 side, case when l_partkey % 2 = 1 then -1 else 1 end strand from lineitem where l_linenumber <> 7),
piece as (select r.*, substr(b, (t + 1)::bigint, n::bigint) p from r join ref using (seq)),
clip as (select seq, side, strand, case when side then pos + n else pos + q end a, case when flip then reverse(translate(p, 'ACGT', 'TGCA')) else p end x from piece),
frag as (select distinct seq, x from clip), two as (select seq, x, 1 s, x y from frag union all select seq, x, -1, reverse(translate(x, 'ACGT', 'TGCA')) from frag),
words as (select seq, x, s, o, substr(y, (o + 1)::bigint, 12) w from (select *, unnest(range(0, length(y) - 11)) o from two)),
idx as (select seq, p, substr(b, (p + 1)::bigint, 12) w from (select *, unnest(range(0, length(b) - 11, 4)) p from ref)),
hit as (select words.*, p, p - o d from words join idx using (seq, w)),
opened as (select *, case when d - lag(d) over (partition by seq, x, s order by d) <= 8 then 0 else 1 end fresh from hit),
chained as (select *, sum(fresh) over (partition by seq, x, s order by d) c from opened),
chain as (select seq, x, s, c, min(p) f, max(p) + 12 e, count(*) k from chained group by all),
score as (select seq, x, s, c, count(distinct o + j) m from chained, range(0, 12) u(j) group by all),
ranked as (select *, row_number() over w i, lead(m) over w m2 from chain join score using (seq, x, s, c) window w as (partition by seq, x order by m desc, s desc, f)),
best as (select *, greatest(0, least(60, floor(40 * (1 - coalesce(m2, 0) / m) * least(1, k / 10) * ln(m)))) quality from ranked where i = 1),
far as (select clip.seq, side, a, case when s < 0 then e else f end z, s = strand same from clip join best using (seq, x) where quality > 20 and abs(case when s < 0 then e else f end - a + 1) > m),
spread as (select seq, side, same, unnest(range(least(a, z), greatest(a, z))) pos from far)
select seq, pos, {_smap} from spread group by all"""
_pair = lambda p: f"round((length(t) - length(replace(t, '{p}', ''))) / 2 / length(t), 8) as \"{p.lower()}\""
SQL["dinucleotide_fraction"] = f"with d as (select doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') t from documents where length(text) > 0) select doc_id, {', '.join(map(_pair, ('EN', 'TI', 'OU', 'ES')))} from d"
SQL["read_group_merge"] = f"with {READS} select seq, string_agg(distinct sm, '-' order by sm) sm, string_agg(distinct rg, '-' order by rg) rgs, count(*) n from reads group by seq"
SQL["region_scan"] = f"""with {READS} select sm, rg, greatest(pos, 500) as "start", least(pos + rlen, 600) as "end", mapq from reads where seq = 'NO' and pos < 600 and pos + rlen > 500"""

GENES = "genes as (select p_name || '#' || p_partkey gene, ['AF', 'AO', 'NF', 'NO', 'RF', 'RO'][(p_partkey % 6 + 1)::integer] seq, p_partkey % 2400 s, p_partkey % 2400 + p_size e from part)"
OVER = "reads r join genes g on r.seq = g.seq and r.pos < g.e and r.ref_end > g.s"
SQL["overlap_join"] = f"with {READS}, {GENES} select gene, count(*) n, sum(least(r.ref_end, g.e) - greatest(r.pos, g.s))::bigint bases from {OVER} group by gene"
SQL["overlap_pairs"] = f"""with {GENES}, every as (select * from genes union all select 'all of ' || seq, seq, 0, max(e) from genes group by seq)
select a.gene, b.gene other, greatest(a.s, b.s) as "start", least(a.e, b.e) as "end" from every a join genes b on a.seq = b.seq and a.s < b.e and b.s < a.e where a.s < a.e and b.s < b.e"""
SQL["missing_keys"] = f"""with {READS}, {GENES} select gene, seq, s as "start", e as "end" from genes where gene not in (select gene from {OVER} where r.mapq = 56 and r.rlen < 4)"""
SQL["gene_lookup"] = f"""with {READS}, {GENES}, len as (select seq, max(l_end) len from (select l_returnflag || l_linestatus seq, date_diff('day', date '1995-01-01', l_shipdate::date) + l_quantity::integer l_end from lineitem) group by seq)
select gene, seq, greatest(0, s - greatest(0, round_even((e - s) * 0.5, 0)::bigint)) as "start", least(e + greatest(0, round_even((e - s) * 0.5, 0)::bigint), len) as "end" from genes join len using (seq)"""
SQL["gene_search"] = f"""with {GENES} select gene, seq, s as "start", e as "end" from genes where contains(upper(gene), '1A') or contains(upper(gene), '7')"""
SQL["coord_parse"] = f"""with {GENES} select gene, case when s % 5 = 0 then gene else seq end seq, case when s % 5 <> 0 then s end as "start", case when s % 5 <> 0 then e end as "end" from genes"""

RANGES = """len as (select max(event_id) + 1 len from events), ranges as (select p_partkey range_id, p_partkey * 7919 % len s, least(len, p_partkey * 7919 % len + 100 + p_partkey * p_size * 13 % len) e from part, len)"""
CHOICE = """rated as (select range_id, s, e, "window" w, (e - s) / "window" n from ranges, levels), chosen as (select range_id, s, e, w from rated
qualify row_number() over (partition by range_id order by case when n <= 16 then 0 else 1 end, case when n <= 16 then abs(n - 8) else n end, w) = 1)"""
SQL["pan_zoom"] = f"""with {RANGES}, r as (select *, 100 * floor(ceil((e - s) / 100) * 0.1 + 0.5)::bigint d, floor((e - s) / 2 + 0.5)::bigint h from ranges, len),
z as (select *, floor(h * 0.8 + 0.5)::bigint a, floor(h * 1.2 + 0.5)::bigint b from r)
select range_id, case when e + d <= len then s + d else s end right_start, case when e + d <= len then e + d else e end right_end, case when s - d >= 0 then s - d else s end left_start, case when s - d >= 0 then e - d else e end left_end,
case when s + h - a >= 0 then s + h - a else s end into_start, case when s + h - a >= 0 then s + h + a else e end into_end, case when s + h - b >= 0 then s + h - b else s end out_of_start, case when s + h - b >= 0 then s + h + b else e end out_of_end from z"""
SQL["store_round_trip"] = f"with {_pyramid(10)} select sm, \"window\", tile, {FIELDS} from pyr, (select unnest(['s', 't']) sm)"
SQL["store_range_read"] = f"with {EV}, {_moments('ev', 'tile')} select tile, {FIELDS} from mom where tile >= 12 and tile < 88"
SQL["store_attributes"] = f"""with {_pyramid(10)} select sm, 'all' rg, 'events' seq, 'value' track, 'moments' feature, "window", min(tile) first_tile, count(*) tiles, (select max("window") from levels) window_root,
(select max(event_id) + 1 from events) len, 10 window_branch from pyr, (select unnest(['s', 't']) sm) group by sm, "window\""""
SQL["store_odd_keys"] = f"""with {EV}, {_moments('ev', 'tile')} select sm, rg, tile, n, round(case when tile % 3 = 0 then sum + 1 else sum end, 4) sum
from mom, (select unnest(['none', '', '0012', '7', '~0']) sm), (select unnest(['none', '1']) rg)"""
SQL["catalog_listing"] = f"""with {_pyramid(10)} select sm, 'all' rg, 'events' seq, 'value' track, 'moments' feature, "window", count(distinct tile // 1000000) slices from pyr, (select unnest(['s', 't']) sm) group by sm, "window\""""
SQL["base_windows"] = """select distinct l_returnflag || l_linestatus seq, 100 as "window" from lineitem where l_partkey % 101 <> 0 and l_linenumber <> 7"""
SQL["json_export"] = f"""with {EV}, s as (select tile, count(*)::double n, min(v) as min, max(v) as max from ev group by tile) select to_json({{'seq': 'events', 'track': 'value', 'tile': tile, 'n': n, 'min': min, 'max': max}})::varchar as json from s"""
SQL["lod_select"] = f"""with {RANGES}, {_pyramid(10)}, {CHOICE} select range_id, s as "start", e as "end", w as "window" from chosen"""
SQL["range_query"] = f"""with {RANGES}, {_pyramid(10)}, {CHOICE} select range_id, "window", tile, n, round(sum, 4) sum, min, max, round(m1, 6) m1 from chosen join pyr on "window" = w and tile >= s // w and tile < ceil(e / w)"""
SQL["catalog_query"] = f"""with {READS} select distinct sm, rg, seq, 'total' track, 'moments' feature, 100 as "window" from reads where sm in ('s0', 's1')"""
SQL["windows_by_sequence"] = f"""with {_pyramid(10)} select 'events' seq, string_agg("window"::varchar, ',' order by "window") windows, true uniform from levels"""
_depth = lambda s: f"(select seq, p pos, count(*) v from (select seq, unnest(range(pos, ref_end)) p from reads where sm = '{s}') group by all)"
SQL["diff_subtract"] = f"with {READS} select seq, pos, (coalesce(a.v, 0) - coalesce(b.v, 0))::double as value from {_depth('s0')} a full join {_depth('s1')} b using (seq, pos)"
SQL["diff_fold"] = f"with {READS} select seq, pos, round(greatest(1, coalesce(a.v, 0)) / greatest(1, coalesce(b.v, 0)) - 1, 6)::double as value from {_depth('s0')} a full join {_depth('s1')} b using (seq, pos)"
_scaled = lambda c: f"round(({c} - min({c}) over p) / coalesce(nullif(max({c}) over p - min({c}) over p, 0), 1), 6) {c}"
SQL["normalize_minmax"] = f'with {_pyramid(10)}, s as (select "window", tile, {STD} from pyr) select "window", tile, {", ".join(map(_scaled, ("mean", "std", "skew", "kurt")))} from s window p as (partition by "window")'
SQL["moment_correlation"] = f"""with {READS}, len as (select seq, max(ref_end) len from reads group by seq), spine as (select sm, seq, unnest(range(0, len)) pos from len, (select unnest(['s0', 's1']) sm)),
d as (select sm, seq, p pos, count(*) c from (select sm, seq, unnest(range(pos, ref_end)) p from reads) group by all), dense as (select sm, seq, pos // 100 tile, coalesce(c, 0) v from spine left join d using (sm, seq, pos)),
{_moments("dense", "sm, seq, tile")}, a as (select * from mom where sm = 's0' and max > 0), b as (select * from mom where sm = 's1' and max > 0)
select seq, round(corr(a.sum, b.sum), 6) as sum, round(corr(a.max, b.max), 6) as max, round(corr(a.m1, b.m1), 6) m1, round(corr(a.m2, b.m2), 6) m2 from a join b using (seq, tile) group by seq"""
SQL["clean_end"] = f"""with size as (select max(event_id) + 1 len from events), ev as (select event_id // 100 tile, value v from events, size where event_id < len - 250), {_moments("ev", "tile")},
w as (select mom.*, (len - 1) // 100 - tile back, case when tile = (len - 1) // 100 then len - tile * 100 else 100 end::double width from mom, size),
g as (select coalesce(min(back), 10) good from w where back < 10 and n >= width), f as (select w.*, n < width and back < good bad from w, g),
o as (select tile, case when bad then width else n end n, case when bad then 0 else sum end sum, case when bad then 0 else min end as min, case when bad then 0 else max end as max, case when bad then 0 else m1 end m1,
case when bad then 0 else m2 end m2, case when bad then 0 else m3 end m3, case when bad then 0 else m4 end m4 from f) select tile, {FIELDS} from o"""
SQL["check"] = f"""with {_T}, m as (select tile, count(*) n from b group by tile), s as (select tile, count(bin) s from b group by tile), i as (select tile, count(*) t from st where (pos + 1) // 100 = tile group by tile)
select 'events' seq, 'value' track, bool_and(n = 100) moments_ok, bool_and(s = 100) spectrum_ok, bool_and(coalesce(t, 0) = 99) transitions_ok from m join s using (tile) left join i using (tile)"""
SQL["top_k_coverage"] = f"with {READS} select sm, rg, sum(rlen)::bigint bases, count(*) n from reads group by all order by bases desc, sm, rg limit 10 offset 2"
SQL["seq_dictionary"] = "select l_returnflag || l_linestatus seq, max(date_diff('day', date '1995-01-01', l_shipdate::date) + l_quantity::integer) len from lineitem group by all"


def _set(member: str) -> str:
    return f"""with {GENES}, i as (select seq, case when length(gene) % 2 = 0 then 'a' else 'b' end side, s * 3 s, s * 3 + e - s e from genes),
p as (select distinct seq, side, unnest(range(s, e + 1)) x from i), m as (select seq, x from p group by seq, x having {member}),
k as (select seq, x, x - row_number() over (partition by seq order by x) g from m) select seq, min(x) as "start", max(x) as "end" from k group by seq, g"""


SQL["interval_intersect"] = _set("count(*) = 2")
SQL["interval_union"] = _set("true")
SQL["interval_diff1"] = _set("min(side) = 'a' and max(side) = 'a'")
SQL["interval_diff2"] = _set("min(side) = 'b'")
SQL["edit_distance"] = "select a.p_partkey, levenshtein(a.p_name, b.p_name) distance from part a join part b on b.p_partkey = a.p_partkey + 1"
SQL["weighted_edit_distance"] = "select a.p_partkey, levenshtein(a.p_name, b.p_name)::double distance from part a join part b on b.p_partkey = a.p_partkey + 1"
SQL["merge_stores"] = f"with {READS} select sm, seq, count(*) n from reads where sm in ('s0', 's1', 's2') group by all"
SQL["rename_sample"] = f"with {READS} select 'cohort' sm, rg, seq, n from (select sm, rg, seq, count(*) n from reads group by all)"
SQL["log_stage"] = "select o_custkey, max(case when o_orderstatus = 'F' then o_orderkey % 8 end)::integer stage, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') ended from orders group by o_custkey"
SQL["read_group_lines"] = r"select distinct '@RG\tID:rg' || l_linenumber || '\tSM:s' || (l_suppkey % 4) || '\tLB:lib\tPL:ILLUMINA' line from lineitem"
SQL["focal_order"] = "select s_suppkey, abs(s_suppkey - 17) distance from supplier"
SQL["running_coverage"] = "select event_id pos, round(sum(value) over (order by event_id), 4) total from events"
SQL["time_windows"] = """with e as (select time_bucket(interval '1 hour', ts) t, event_type, value v from events), a as (select t, event_type, avg(v) m1 from e group by all),
m as (select t, event_type, count(*)::double n, sum(v) sum, min(v) as min, max(v) as max, any_value(m1) m1, sum(power(v - m1, 2)) m2 from e join a using (t, event_type) group by all)
select strftime(t, '%Y-%m-%d %H:%M:%S') as "start", event_type, n, round(sum, 4) sum, min, max, round(m1, 6) m1, round(sqrt(m2), 4) m2r from m"""

SQL["stream_merge"] = SQL["time_windows"]
SQL["weighted_pick"] = """with w as (select l_suppkey, count(*) w from lineitem group by all), r as (select *, sum(w) over (order by md5(l_suppkey::varchar), l_suppkey) hi from w),
d as (select k draw, ('0x' || left(md5('7/' || k), 15))::bigint % (select sum(w) from w) u from range(0, (select count(*) from part)) t(k))
select l_suppkey, count(*) times, min(draw) as "first", sum(draw)::bigint numbers from d join r on u >= hi - w and u < hi group by all"""
SQL["sql_coverage"] = SQL["coverage_total"]
SQL["sql_tiles"] = f"with {READS} select seq, p // 100 tile, count(distinct i) reads, count(*) bases from (select seq, row_number() over () i, unnest(range(pos, ref_end)) p from reads) group by all"
SQL["sql_cigar"] = """with r as (select l_returnflag || l_linestatus seq, date_diff('day', date '1995-01-01', l_shipdate::date) pos, l_quantity::bigint q, l_suppkey % 45 f, l_partkey % 45 b, l_orderkey % 50 m, l_linenumber % 4 o from lineitem where l_linenumber <> 7),
e as (select *, case when o = 0 then 0 else m end w from r),
s as (select seq, 4 op, pos a, pos + f z from e where f > 0 union all select seq, 5, pos + f + 2 * q + w, pos + f + 2 * q + w + b from e where b > 0 union all select seq, 2, pos + f + q, pos + f + q + m from e where o = 1 and m > 0)
select seq, op, a start_at, z end_at, count(*) n from s group by all"""
SQL["sql_merged_moments"] = f"""with ev as (select event_id // 1000 tile, value v from events), {_moments('ev', 'tile')}, s as (select *, {STD} from mom)
select tile, n, round(sum, 4) sum, min, max, round(mean, 6) mean, round(std, 6) std, round(skew, 6) skew, round(kurt, 6) kurt, case when m1 < 40 then 0 when m1 < 50 then 1 when m1 < 60 then 2 when m1 < 500 then 3 end::integer bin from s"""

_R = "r as (select 's' || (l_suppkey % 4) sm, 'rg' || l_linenumber rg, l_returnflag || l_linestatus seq, date_diff('day', date '1995-01-01', l_shipdate::date) + l_quantity::integer e, l_quantity::integer n, 7 * round(l_tax * 100)::integer q from lineitem)"
SQL["sam_header"] = f"""with {_R}, g as (select distinct sm, sm || '.' || rg id from r) select 'sequence' kind, seq as name, max(e)::varchar held from r group by seq union all select 'sample', sm, string_agg(id, ',' order by id) from g group by sm"""
SQL["sam_text"] = """select l_orderkey || '/' || l_linenumber as name, l_returnflag || l_linestatus seq, date_diff('day', date '1995-01-01', l_shipdate::date) pos, date_diff('day', date '1995-01-01', l_shipdate::date) + l_quantity::integer + 2 ref_end,
l_linenumber * 16 flag, case when l_linenumber % 2 = 0 then 'a' else 'b' end sm, l_returnflag || l_linestatus mate_seq, 3 ops from lineitem"""
SQL["cohort_table"] = """select s_name sample, 'n' || s_nationkey population, 'rg' || l_linenumber rg, 'lib' library, 'ILLUMINA' platform, count(*) / 4 coverage from lineitem join supplier on s_suppkey = l_suppkey group by s_name, s_nationkey, l_linenumber"""
SQL["run_statistics"] = f"with {_R} select sm sample, rg, 'ILLUMINA' platform, 'lib' library, round(sum(n) / 1000, 6) coverage, max(q) mapq from r group by sm, rg"
SQL["genes_json"] = f"with {GENES} select gene, k ord, seq, s + 1000 * k as start, e + 1000 * k as end from genes, range(0, 2) t(k) where s < e".replace("as start", 'as "start"').replace("as end", 'as "end"')
SQL["fastq_records"] = """with r as (select l_returnflag || l_linestatus seq, date_diff('day', date '1995-01-01', l_shipdate::date) pos, 'rg' || (7 * round(l_tax * 100)::integer % 3) rg,
left(translate(md5(l_orderkey || '/' || l_linenumber), '0123456789abcdef', 'ACGTACGTACGTACGT'), l_quantity::integer) s from lineitem),
f as (select rg, '@' || seq || ':' || pos || chr(10) || s || chr(10) || '+' || chr(10) || repeat('I', length(s)) v from r) select rg, count(*) n, sum(length(v))::bigint size, max(v) as last from f group by rg"""
