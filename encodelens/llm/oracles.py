"""DuckDB SQL for the rows of the queries."""

#: Words are cut out by one pattern; windows of 8 words are counted per document, and their words marked.
QUALITY = r"""
with d as (
  select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as lines,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents
), t as (
  select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as pos from d
), w as (
  select doc_id, pos, lag(word) over o = word as same, case when lead(word, 7) over o is not null then concat_ws(' ',
    word, lead(word, 1) over o, lead(word, 2) over o, lead(word, 3) over o, lead(word, 4) over o, lead(word, 5) over o,
    lead(word, 6) over o, lead(word, 7) over o) end as gram
  from t window o as (partition by doc_id order by pos)
), st as (
  select doc_id, count(*) filter (where same) as n_stutter from w group by doc_id
), g as (
  select doc_id, pos, count(*) over (partition by doc_id, gram) as n from w where gram is not null
), m as (
  select doc_id, count(distinct pos + k) as n_repeat_words
  from (select doc_id, pos from g where n > 1), (select unnest(range(0, 8)) as k) group by doc_id
), b as (
  select doc_id, text, words, len(words) as n_words,
         length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) as n_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as n_dup_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_stutter, 0) as n_stutter
  from d left join m using (doc_id) left join st using (doc_id)
), c as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
         length(regexp_replace(text, '\PL', '', 'g')) as n_letters,
         length(regexp_replace(text, '\P{Lu}', '', 'g')) as n_upper,
         length(text) - length(replace(text, '!', '')) as n_marks
  from b
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
       not base_failed and not (5 * n_symbols > n_words or 5 * n_marks > n_words or word_chars < 2 * n_words
         or word_chars > 15 * n_words or 2 * n_dup_lines > n_lines or 10 * n_stutter > 3 * n_words
         or 2 * n_letters < word_chars or 2 * n_upper > n_letters) as kept
from c
"""

LINE_DEDUP = r"""
with d as (select doc_id, source, text, string_split(coalesce(text, ''), chr(10)) as lines from documents
), l as (
  select doc_id, source, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as pos from d
), w as (
  select *, regexp_matches(line, '[^\x20\x09-\x0D]') as word from l
), n as (
  select w.source, line, count(distinct coalesce(d.text, '')) as pages from w join d using (doc_id) where word group by all
), t as (
  select source, count(distinct coalesce(text, '')) as total from documents group by all
), bad as (
  select n.source, n.line from n join t on n.source is not distinct from t.source where pages >= 5 and pages > 0.05 * total
), k as (
  select w.*, w.word and bad.line is not null as cut
  from w left join bad on w.line = bad.line and w.source is not distinct from bad.source
), s as (
  select doc_id, sum(word::int) as n_lines, sum(cut::int) as n_dropped,
         coalesce(string_agg(line, chr(10) order by pos) filter (where not cut), '') as kept
  from k group by doc_id
)
select s.doc_id, s.n_lines::bigint as n_lines, s.n_dropped::bigint as n_dropped,
       case when d.text is null then null else sha256(s.kept) end as text_sha256
from s join d using (doc_id)
"""

#: The tilt of each source is found by halving its bracket 60 times, as digits of a sum; then documents are ranked.
MIXING = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), s as (
  select source, sum(size)::double as total, row_number() over (order by source is null, source) as no from d group by source
), w as (
  select source, total, ((no - 1) % 3 + 1)::double as weight, 3.0 * total as most, sum(total) over () as everything, no from s
), r as (
  select *, (everything - coalesce(sum(most) over (order by most / weight, no rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by most / weight, no rows between current row and unbounded following) as level_here
  from w
), l as (
  select *, max(case when level_here * weight <= most then level_here end) over () as level from r
), t as (
  select source, total, least(most, coalesce(level * weight, most)) as target from l
), h as (
  select source, list({'s': size::double, 'n': n::double}) as m from (select source, size, count(*) as n from d where size > 0 group by all) group by source
), b as (
  select t.source, total, target, m, -greatest(ln(total / target), 0) - 1e-9 as lo from t join h on t.source is not distinct from h.source where total > 0
), z as (
  select source, list_reduce(list_prepend(lo, list_transform(range(1, 61), lambda k: (ln(3) + 1e-9 - lo) / 2 ** k)), lambda acc, x:
    case when list_sum(list_transform(m, lambda y: y.n * y.s * case when (acc + x) * y.s >= ln(3) then 3 else exp((acc + x) * y.s) end)) <= target
         then acc + x else acc end) as tilt
  from b
), q as (
  select d.doc_id, d.source, d.size, total, target,
         case when size = 0 then 1 when tilt * size >= ln(3) then 3 else exp(tilt * size) end as rate,
         ('0x' || substr(md5(concat(doc_id, ':', size)), 1, 13))::bigint / 4503599627370496.0 as u
  from d join t on d.source is not distinct from t.source left join z on d.source is not distinct from z.source
), v as (
  select *, floor(rate) as whole, case when size > 0 and rate < 3 then u - (rate - floor(rate)) end as v,
         target - sum(floor(rate) * size) over (partition by source) as extra
  from q
), x as (
  select doc_id, source, v, size, abs(sum(size) over (partition by source order by v, doc_id, size) - extra) as gap, extra from v where v is not null
), c as (
  select source, arg_min({'v': v, 'i': doc_id, 's': size}, {'gap': gap, 'v': v, 'i': doc_id}) as cut from x where gap < abs(extra) group by source
)
select doc_id, v.source, size, total::bigint as source_size, target,
       ((whole + case when v is not null and {'v': v, 'i': doc_id, 's': size} <= cut then 1 else 0 end) * size)::bigint as taken
from v left join c on v.source is not distinct from c.source
"""


def _curve_sql() -> str:
    """CTEs from `levels` (cell, l0 to l3, of 16 levels each) to `curve` (cell, place): the steps of the curve, one by one."""
    parts, at = [], "levels"
    for b in (3, 2, 1):
        low = (1 << b) - 1
        for i in range(4):
            name = f"h{b}{i}"
            if i == 0:
                new = f"case when (l0 >> {b}) & 1 = 1 then xor(l0, {low}) else l0 end as l0, l1, l2, l3"
            else:
                one = f"(l{i} >> {b}) & 1 = 1"
                swap = f"xor(l0, l{i}) & {low}"
                first = f"case when {one} then xor(l0, {low}) else xor(l0, {swap}) end as l0"
                rest = ", ".join(f"case when {one} then l{j} else xor(l{j}, {swap}) end as l{j}" if j == i else f"l{j}" for j in (1, 2, 3))
                new = f"{first}, {rest}"
            parts.append(f"{name} as (select cell, {new} from {at})")
            at = name
    parts.append(f"g as (select cell, l0, xor(l0, l1) as l1, xor(xor(l0, l1), l2) as l2, xor(xor(xor(l0, l1), l2), l3) as l3 from {at})")
    turn = "xor(xor(case when (l3 >> 3) & 1 = 1 then 7 else 0 end, case when (l3 >> 2) & 1 = 1 then 3 else 0 end), case when (l3 >> 1) & 1 = 1 then 1 else 0 end)"
    parts.append(f"t as (select cell, xor(l0, t) as l0, xor(l1, t) as l1, xor(l2, t) as l2, xor(l3, t) as l3 from (select *, {turn} as t from g))")
    place = " + ".join(f"((l{i} >> {b}) & 1) * {1 << (4 * b + 3 - i)}" for b in (3, 2, 1, 0) for i in range(4))
    parts.append(f"curve as (select cell, {place} as place from t)")
    return ",\n".join(parts)


def _level_sql(c: str) -> tuple[str, str]:
    """How many hex digits a string column's least and greatest value share, and a value's level between them by six bytes behind those."""
    shared = f"(select coalesce(max(n), 0) from (select unnest(range(1, least(length(lo_{c}), length(hi_{c})) + 1)) as n, lo_{c} as x, hi_{c} as y from ends) where substr(x, 1, n) = substr(y, 1, n))"
    number = lambda v: f"('0x' || rpad(substr({v}, skip_{c} + 1, 12), 12, '0'))::bigint"
    return shared, f"case when {c} is null or {number(f'hi_{c}')} = {number(f'lo_{c}')} then 0 else least(greatest(floor(({number(f'hex_{c}')} - {number(f'lo_{c}')}) * 16 / ({number(f'hi_{c}')} - {number(f'lo_{c}')} + 1)), 0), 15) end::int"


def _shards() -> str:
    (skip_a, level_a), (skip_b, level_b) = _level_sql("a"), _level_sql("b")
    table = "[" + ", ".join(str(_crc(n)) for n in range(256)) + "]"
    return rf"""
with rows0 as (
  select doc_id, coalesce(text, '') as body, source as a, lang as b, hex(encode(coalesce(source, ''))) as hex_a, hex(encode(coalesce(lang, ''))) as hex_b from documents
), sized as (
  select *, octet_length(encode(body)) + 8 as size,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: ('0x' || x)::bigint)),
      lambda acc, x: xor(acc >> 8, ({table})[(xor(acc, x) & 255) + 1])), 4294967295::bigint) as text_crc32
  from rows0
), ends as (
  select hex(encode(min(a))) as lo_a, hex(encode(max(a))) as hi_a, hex(encode(min(b))) as lo_b, hex(encode(max(b))) as hi_b, min(doc_id)::double as lo, max(doc_id)::double as hi, count(*) as n from rows0
), skips as (select {skip_a} // 2 * 2 as skip_a, {skip_b} // 2 * 2 as skip_b), placed as (
  select doc_id, size, text_crc32, ('0x' || substr(md5(concat(doc_id, ':', text_crc32)), 1, 7))::bigint % 256 as part, n, least(greatest(length(bin(size)) - 4, 0), 15)::int as l0, {level_a} as l1, {level_b} as l2,
    coalesce(floor((doc_id::double - lo) * 16 / (hi - lo + 1)), 0)::int as l3 from sized, ends, skips
), celled as (select *, ((l0 * 16 + l1) * 16 + l2) * 16 + l3 as cell from placed), levels as (select distinct cell, l0, l1, l2, l3 from celled),
{_curve_sql()}, ranked as (
  select c.*, row_number() over (order by place, part, doc_id, size, text_crc32) - 1 as rank from celled c join curve using (cell)
)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'rows' as law, (rank * 24 // n)::int as shard, (rank - ((rank * 24 // n) * n + 23) // 24)::bigint as slot, null::int as grown_shard from ranked
"""


def _crc(n: int) -> int:
    for _ in range(8):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


SHARDS = _shards()

#: Every kept term of a language meets every ordered pair of its sources.
DIVERGENCE = r"""
with d as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words
  from documents
), t as (
  select lang, source, doc_id, unnest(words) as term from d
), k as (
  select lang, term, count(*) as total from t group by all having count(distinct doc_id) >= 3
), c as (
  select lang, source, term, count(*) as n from t group by all
), v as (
  select lang, count(*) as terms, sum(total) as everything from k group by lang
), g as (
  select s.lang, s.source, coalesce((select sum(n) from c join k using (lang, term) where c.lang = s.lang and c.source = s.source), 0) as total
  from (select distinct lang, source from d) s
), p as (
  select g.lang, g.source, k.term, coalesce(n, 0) as n, 1 + 1000000000::hugeint * (coalesce(n, 0) + 1) // (g.total + terms) as p,
         1 + 1000000000::hugeint * (k.total + 1) // (everything + terms) as q
  from g join k using (lang) join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
), s as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
), term as (
  select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value from p where n > 0 and p > q
), r as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (from pair union all from term)
)
select lang, source, part, item, value, rank::int as rank from r where part = 'pair' or rank <= 200
"""

_WHOLE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

NEGATIVES = f"""
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and {_WHOLE}
), s as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, list_inner_product(a.v, b.v)::bigint as score
  from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
), n as (
  select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
         row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank
  from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

TOP_K = f"""
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings where {_WHOLE}
), s as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 5
"""
