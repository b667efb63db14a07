"""SQL for DuckDB of the views and candidate tables that the registered queries share."""

from __future__ import annotations

from kinweave.functions.text import ALIAS_MARKERS, LEET, LEGAL_SUFFIXES, NULL_TOKENS, SKELETON, TLDS

TOKEN = r"[^\p{L}\p{N}_\x{0900}-\x{0DFF}\x{200c}\x{200d}]+"
EDGE = r"[^\p{L}\p{N}_]"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def norm(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '{TOKEN}', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda t: t <> '' and t not in ({quoted(NULL_TOKENS)}))"


def unleet(t: str) -> str:
    return rf"case when regexp_matches({t}, '\p{{L}}') and regexp_matches({t}, '\p{{N}}') then translate({t}, '{LEET[0]}', '{LEET[1]}') else {t} end"


def without_markers(x: str) -> str:
    # no look-around here, so a marker takes its borders along; the second pass finds one right behind another
    for _ in range(2):
        x = rf"regexp_replace({x}, '(?i)(^|{EDGE})(?:{'|'.join(ALIAS_MARKERS)})({EDGE}|$)', '\1 \2', 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(?i)\.(?:{'|'.join(TLDS)})({EDGE}|$)', ' \1', 'g')"
    return f"replace({x}, '@', ' ')"


def name_tokens(x: str) -> str:
    return f"list_transform({tokens(without_markers(x))}, lambda u: {unleet('u')})"


def core(seq: str) -> str:
    return f"list_filter({seq}, lambda c: c not in ({quoted(LEGAL_SUFFIXES)}))"


def stripped(t: str) -> str:
    return f"case when ltrim({t}, '0') = '' then '0' else ltrim({t}, '0') end"


def tolerant(t: str) -> str:
    return f"list_distinct(case when length({t}) > 3 then [{stripped(t)}, {stripped(f'substr({t}, 2)')}] else [{stripped(t)}] end)"


def numeric(toks: str) -> str:
    return rf"list_distinct(flatten(list_transform(list_filter({toks}, lambda d: regexp_full_match(d, '\p{{N}}+')), lambda d: {tolerant('d')})))"


def skeleton(t: str) -> str:
    s = f"regexp_replace(translate({t}, '{SKELETON[0]}', '{SKELETON[1]}'), '[aeiou]+', '', 'g')"
    return f"list_transform([{s}], lambda s: array_to_string(list_filter(string_split(s, ''), lambda x, i: i = 1 or string_split(s, '')[i - 1] <> x), ''))[1]"


def skeletons(toks: str) -> str:
    return f"list_distinct(list_filter(list_transform({toks}, lambda k: {skeleton('k')}), lambda k: length(k) >= 2))"


def ngrams(x: str) -> str:
    s = f"replace({norm(x)}, ' ', '')"
    passes = [f"regexp_extract_all(substr({s}, {i}), '.{{3}}')" for i in (1, 2, 3)]
    return f"case when {s} = '' then [] when length({s}) < 3 then [{s}] else list_distinct(list_concat(list_concat({passes[0]}, {passes[1]}), {passes[2]})) end"


def script(x: str) -> str:
    latin, indic = f"length(regexp_replace({x}, '[^A-Za-z]', '', 'g'))", rf"length(regexp_replace({x}, '[^\x{{0900}}-\x{{0DFF}}]', '', 'g'))"
    return f"case when {latin} = 0 and {indic} = 0 then 'none' when {latin} >= {indic} then 'latin' else 'indic' end"


def name_keys(s: str, c: str) -> str:
    two = [(1, 2), (2, 1)]
    three = [(1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1)]
    orders = lambda ps: "[" + ", ".join("'#' || " + " || ".join(f"{c}[{i}]" for i in p) for p in ps) + "]"
    single = f"case when {s}[1] like '%com' and length({s}[1]) > 6 then ['#' || {s}[1], '#' || substr({s}[1], 1, length({s}[1]) - 3)] else ['#' || {s}[1]] end"
    runs = f"list_transform(range(2, least(len({s}), 6) + 1), lambda r: '#' || array_to_string({s}[1:r], ''))"
    joined = f"case when len({s}) = 0 then [] when len({s}) = 1 then {single} else list_concat({runs}, case when len({c}) = 2 then {orders(two)} when len({c}) = 3 then {orders(three)} else [] end) end"
    return f"list_distinct(list_concat(list_concat({s}, {joined}), list_transform({skeletons(s)}, lambda z: '~' || z)))"


def jaccard(a: str, b: str) -> str:
    return f"case when len({a}) = 0 or len({b}) = 0 then 0.0 else cast(len(list_intersect({a}, {b})) as double) / len(list_distinct(list_concat({a}, {b}))) end"


def containment(a: str, b: str) -> str:
    return f"case when len({a}) = 0 or len({b}) = 0 then 0.0 else cast(len(list_intersect({a}, {b})) as double) / least(len({a}), len({b})) end"


def without(a: str, b: str) -> str:
    """Elements of a that b lacks."""
    return f"list_filter({a}, lambda e: not list_contains({b}, e))"


def flag(x: str) -> str:
    return f"cast(coalesce({x}, false) as double)"


def disjoint(a: str, b: str) -> str:
    return flag(f"len({a}) > 0 and len({b}) > 0 and len(list_intersect({a}, {b})) = 0")


def sorted_set(toks: str) -> str:
    return f"array_to_string(list_sort(list_distinct({toks})), ' ')"


# the name is the first sentence or line (no look-ahead here: what follows it is matched and left out), the address the rest
_FIRST = r"^([ \t\n\x0B\f\r]*[^\n]*?)(?:([.!?]+)[ \t\n\x0B\f\r]|\n|\z)"
ER = f"""er as (select code, source, country, name, substr(t, length(name) + 1) as address from (
  select (doc_id % 3 + 1) * 1000000000 + doc_id as code, cast(doc_id % 3 + 1 as integer) as source, coalesce(lang, '') as country,
   coalesce(text, '') as t, regexp_extract(coalesce(text, ''), '{_FIRST}', 1) || regexp_extract(coalesce(text, ''), '{_FIRST}', 2) as name from documents))"""

VIEWS = f"""{ER},
 seqs as materialized (select *, {name_tokens('name')} as nseq, {tokens('address')} as aseq from er),
 v as materialized (select code, source, country, name, address, nseq, aseq, {core('nseq')} as cseq, list_distinct(nseq) as ntok, list_distinct({core('nseq')}) as core, list_distinct(aseq) as atok,
   {numeric('list_distinct(aseq)')} as num, {ngrams('name')} as ntri, {ngrams('address')} as atri, {script('name')} as script,
   {skeletons(core('nseq'))} as skel, {skeletons("list_filter(list_distinct(aseq), lambda q: not regexp_full_match(q, '[0-9]+'))")} as askel from seqs)"""

TRUTH = """truth as (select s1, t.code as cand from (select country, lower(name) as k, min(code) as s1 from er where source = 1 group by 1, 2) s
  join (select country, lower(name) as k, code from er where source > 1) t using (country, k))"""


def channel(x: str, toks: str, k: int, gen_cap: int = 200_000, cap: int = 200_000) -> str:
    """CTEs of a channel: q_, t_, df_ (token counts), w_ (weights), b_ (best pairs)."""
    return f"""q_{x} as (select code as s1, country, unnest({toks}) as token from v where source = 1),
 t_{x} as (select code as cand, country, unnest({toks}) as token from v where source > 1),
 df_{x} as (select country, token, count(*) as df from t_{x} group by 1, 2),
 n_{x} as (select country, count(*) as n from v where source > 1 group by 1),
 w_{x} as (select country, token, df, ln(1 + n / df) as idf, pow(ln(1 + n / df), 2) as w from df_{x} join n_{x} using (country) where df <= {cap}),
 b_{x} as (select *, row_number() over (partition by s1 order by score desc, cand) - 1 as rank from (
   select country, s1, cand, count(*) as shared, round(sum(w), 6) as score from q_{x} join w_{x} using (country, token) join t_{x} using (country, token)
   group by 1, 2, 3 having count(*) filter (where df <= {gen_cap}) > 0) where shared >= 2 or score >= 6 qualify rank < {k})"""


ALL_TOKENS, NAME_TOKENS = "list_distinct(list_concat(ntok, atok))", name_keys("nseq", "cseq")


def rescored(x: str, pairs: str) -> str:
    return f"(select s1, cand, count(*) as shared, round(sum(w), 6) as score from {pairs} join q_{x} using (country, s1) join w_{x} using (country, token) join t_{x} using (country, cand, token) group by 1, 2)"


def pairs(topk: int = 50, name_topk: int = 25, gen_cap: int = 200_000) -> str:
    """CTEs up to `pairs`, the candidate table of both channels."""
    return f"""{VIEWS}, {channel('a', ALL_TOKENS, topk, gen_cap)}, {channel('n', NAME_TOKENS, name_topk, gen_cap)},
 u as (select country, s1, cand from b_a union select country, s1, cand from b_n),
 pairs as materialized (select country, s1, cand, score, shared, row_number() over (partition by s1 order by score desc, nscore desc, cand) - 1 as rank, nscore, nshared, nrank from (
   select u.country, u.s1, u.cand, coalesce(x.score, 0) as score, coalesce(x.shared, 0) as shared, coalesce(y.score, 0) as nscore, coalesce(y.shared, 0) as nshared, coalesce(b.rank, 999) as nrank
   from u left join {rescored('a', 'u')} x using (s1, cand) left join {rescored('n', 'u')} y using (s1, cand) left join b_n b using (s1, cand)))"""


SCORED = "scored as (select country, s1, cand, rank, round(score / (score + 50), 6) as p from pairs)"

CONTENTION = """meta as (select cand, max(score) as t_best, case when count(*) > 1 then list_sort(list(score), 'DESC')[2] else 0 end as t_second, count(*) as t_claims from pairs group by 1)"""

VIEWED = """viewed as materialized (select p.country, s1, cand, a.name as a_name, b.name as b_name, a.core as a_core, b.core as b_core, a.ntok as a_ntok, b.ntok as b_ntok, a.atok as a_atok, b.atok as b_atok,
   a.num as a_num, b.num as b_num, a.ntri as a_ntri, b.ntri as b_ntri, a.atri as a_atri, b.atri as b_atri, a.script as a_script, b.script as b_script, a.skel as a_skel, b.skel as b_skel,
   a.askel as a_askel, b.askel as b_askel from pairs p join v a on a.code = s1 join v b on b.code = cand)"""
