"""The registered queries over the record view of `documents`, each with its SQL for DuckDB where SQL can express it.

A query names its columns and their kinds once; both sides cast to those, and doubles are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import text
from kinweave.operators import aliases, blocking, decide, expand, features, metrics, models, validate, workflow
from kinweave.plans import duck
from kinweave.plans.staging import made, scratch_path, staged, swept, written
from kinweave.sources import er_view, tsv
from kinweave.sources import pairs as pair_files
from kinweave.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_SPARK = {"long": "bigint", "double": "double", "string": "string", "boolean": "boolean"}
_DUCK = {"long": "bigint", "double": "double", "string": "varchar", "boolean": "boolean"}


def _six(x: Column) -> Column:
    """x to six places as SQL rounds it: the product in doubles, halves away from zero. F.round takes the decimal digits
    instead, so a half that the product just misses (323 / 640) goes up there; numbers without a fraction stay."""
    return F.when(F.abs(x) < 2.0**52 / 1e6, F.round(x * 1e6, 0) / 1e6).otherwise(x)


def query(columns: str, sql: str | None = None):
    """columns: `name kind` pairs, comma-separated; sql: what yields at least these columns."""
    kinds = [c.split() for c in columns.split(",")]

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.select(*[(_six(F.col(c).cast("double")) if k == "double" else F.col(c).cast(_SPARK[k])).alias(c) for c, k in kinds])

        QUERIES[f.__name__] = run
        if sql is not None:
            cols = ", ".join(f"round(cast({c} as double), 6) as {c}" if k == "double" else f"cast({c} as {_DUCK[k]}) as {c}" for c, k in kinds)
            # what comes before the last top-level SELECT are CTEs
            ORACLE[f.__name__] = f"select {cols} from ({sql})"
        return f

    return add


def _records(spark, sf_dir):
    return er_view.records(spark, sf_dir)


_tables: dict[tuple, DataFrame] = {}


def _kept(spark, sf_dir, name, make):
    """A table that many queries start from, made once for a session and kept by Spark until its cache is cleared."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        _tables[key] = make()
    return made(_tables[key])


def clear_tables() -> None:
    """Forget the tables that queries share, so that each is made again for the next query."""
    _tables.clear()


def _views(spark, sf_dir):
    """The views are several times the documents, so a query computes the columns that it reads and keeps none."""
    return blocking.record_views(_records(spark, sf_dir))


def _written_pairs(spark, sf_dir):
    """The candidate table in the shared folder, a fraction of the packed blocks and tokens that it is made of."""
    steps = []
    out = written(blocking.block(_views(spark, sf_dir), steps=steps))
    swept(spark, steps)
    return out


def _pairs(spark, sf_dir):
    return _kept(spark, sf_dir, "pairs", lambda: _written_pairs(spark, sf_dir))


def _scored(pairs: DataFrame) -> DataFrame:
    """A stand-in for a model's probability that SQL can repeat."""
    return pairs.withColumn("p", F.round(F.col("score") / (F.col("score") + 50), 6))


def _truth(spark, sf_dir):
    return er_view.true_links(_records(spark, sf_dir))


def _entities(spark, sf_dir):
    return _records(spark, sf_dir).where("source = 1").select(F.col("code").alias("s1"), "country")


def _join(c) -> F.Column:
    return F.array_join(c, " ")


def _set(c) -> F.Column:
    return text.sorted_set(c)


# ---- records and text ------------------------------------------------------------------------------------------------


@query("code long, source long, entity_id string, back long, key long", f"with {duck.ER} select code, source, 'S' || source || '-' || (code % 1000000000) as entity_id, code as back, ((code % 1000000000) << 32) | code as key from er")
def er_records(spark, sf_dir):
    r = _records(spark, sf_dir)
    return r.select("code", "source", "entity_id", text.encode_id(F.col("entity_id")).alias("back"), text.pair_key(F.col("code"), F.col("code")).alias("key"))


@query("code long, norm string, toks string", f"with {duck.ER} select code, {duck.norm('address')} as norm, array_to_string({duck.tokens('address')}, ' ') as toks from er")
def normalize_tokens(spark, sf_dir):
    a = F.col("address")
    return _records(spark, sf_dir).select("code", text.normalize(a).alias("norm"), _join(text.tokens(a)).alias("toks"))


@query("token string, plain string, n long", f"with {duck.ER}, t as (select unnest({duck.tokens('name')}) as token from er union all select unnest({duck.tokens('address')}) from er union all select unnest({duck.tokens('p_name')}) from part) select token, {duck.unleet('token')} as plain, count(*) as n from t group by 1, 2")
def unleet_tokens(spark, sf_dir):
    r = _records(spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    t = r.select(F.explode(text.tokens(F.col("name"))).alias("token")).unionAll(r.select(F.explode(text.tokens(F.col("address"))))).unionAll(part.select(F.explode(text.tokens(F.col("p_name")))))
    return t.groupBy("token", text.unleet(F.col("token")).alias("plain")).agg(F.count("*").alias("n"))


@query("code long, names string, core string", f"with {duck.VIEWS} select code, array_to_string(nseq, ' ') as names, array_to_string(cseq, ' ') as core from v")
def core_tokens(spark, sf_dir):
    n = text.name_tokens(F.col("name"))
    return _records(spark, sf_dir).select("code", _join(n).alias("names"), _join(text.core_tokens(n)).alias("core"))


@query("code long, numbers string", f"with {duck.ER} select code, {duck.sorted_set(duck.numeric(duck.tokens('text')))} as numbers from (select code, name || address as text from er)")
def numeric_tokens(spark, sf_dir):
    return _records(spark, sf_dir).select("code", _set(text.numeric_tokens(text.tokens(F.concat("name", "address")))).alias("numbers"))


@query("script string, n long", f"with {duck.ER} select script, count(*) as n from (select {duck.script('name')} as script from er) group by 1")
def script_of(spark, sf_dir):
    return _records(spark, sf_dir).groupBy(text.script_of(F.col("name")).alias("script")).agg(F.count("*").alias("n"))


@query("code long, grams string", f"with {duck.ER} select code, {duck.sorted_set(duck.ngrams('name'))} as grams from er")
def char_trigrams(spark, sf_dir):
    return _records(spark, sf_dir).select("code", _set(text.char_ngrams(F.col("name"))).alias("grams"))


@query("token string, skeleton string", f"with {duck.VIEWS}, t as (select distinct unnest(ntok) as token from v) select token, {duck.skeleton('token')} as skeleton from t")
def skeleton_latin(spark, sf_dir):
    t = _records(spark, sf_dir).select(F.explode(text.name_tokens(F.col("name"))).alias("token")).distinct()
    return t.select("token", text.skeleton(F.col("token")).alias("skeleton"))


@query("code long, keys string", f"with {duck.VIEWS} select code, {duck.sorted_set(duck.NAME_TOKENS)} as keys from v")
def name_keys_latin(spark, sf_dir):
    return _records(spark, sf_dir).select("code", _set(text.name_keys(text.name_tokens(F.col("name")))).alias("keys"))


@query("code long, core string, skel string, compact string, initials string", f"with {duck.VIEWS} select code, {duck.sorted_set('core')} as core, {duck.sorted_set('skel')} as skel, array_to_string(cseq, '') as compact, array_to_string(list_sort(list_transform(core, lambda t: substr(t, 1, 1))), '') as initials from v")
def name_keys3(spark, sf_dir):
    v = _views(spark, sf_dir)
    return v.select("code", _set(F.col("core")).alias("core"), F.col("skstr").alias("skel"), "compact", text.initials(F.col("core")).alias("initials"))


@query("code long, toks string", f"with {duck.VIEWS} select code, array_to_string(list_transform(ntok, lambda t: case t when 'la' then 'the' when 'der' then 'the' when 'el' then 'the' else t end), ' ') as toks from (select code, nseq as ntok from v)")
def canonical_tokens(spark, sf_dir):
    m = F.create_map(*[F.lit(x) for k in ("la", "der", "el") for x in (k, "the")])
    return _records(spark, sf_dir).select("code", _join(text.canonical(text.name_tokens(F.col("name")), m)).alias("toks"))


@query("code long, toks string", f"with {duck.ER} select code, {duck.norm('name || address')} as toks from er")
def normalize_unicode(spark, sf_dir):
    from kinweave.functions import unicode

    r = _records(spark, sf_dir).select("code", F.concat("name", "address").alias("text"))
    return unicode.with_normalized(r, "text", "toks").select("code", "toks")


#: Tokens that the data lacks, and how they sound.
_INDIC = (("शिव", "shiva"), ("प्रोडक्ट्स", "proddakttsa"), ("राम", "raama"), ("ಕನ್ನಡ", "kannadda"), ("१२", "12"))


@query("token string, roman string", f"with {duck.ER} select distinct token, token as roman from (select unnest({duck.name_tokens('name || address')}) as token from er) union select * from (values {', '.join(map(repr, _INDIC))}) t(token, roman)")
def romanized(spark, sf_dir):
    from kinweave.functions import unicode

    tokens = _records(spark, sf_dir).select(F.explode(text.name_tokens(F.concat("name", "address"))).alias("token"))
    return unicode.romanized_tokens(tokens.union(spark.createDataFrame([(t,) for t, _ in _INDIC], "token string")))


# ---- blocking --------------------------------------------------------------------------------------------------------


@query("country string, token string, df long, idf double", f"with {duck.VIEWS}, {duck.channel('a', duck.ALL_TOKENS, 50)} select country, token, df, idf from w_a")
def token_df_idf(spark, sf_dir):
    return blocking.weighted(blocking.token_weights(blocking.channel_tokens(_views(spark, sf_dir), "all")))


_PAIR = "country string, s1 long, cand long, shared long, score double, rank long"


def _channel(spark, sf_dir, which, **caps):
    """Coded tokens and weights of a channel, each kept, as a query reads them several times."""
    c = _kept(spark, sf_dir, f"{which}_codes", lambda: blocking.coded(blocking.channel_tokens(_views(spark, sf_dir), which)))
    return c, staged(blocking.weighted(blocking.token_weights(c), **caps))


@query(_PAIR, f"with {duck.VIEWS}, {duck.channel('a', duck.ALL_TOKENS, 50)} select * from b_a")
def block_all_topk(spark, sf_dir):
    return blocking.channel_pairs(*_channel(spark, sf_dir, "all"), blocking.TOPK, common=False)


@query(_PAIR, f"with {duck.VIEWS}, {duck.channel('n', duck.NAME_TOKENS, 25)} select * from b_n")
def block_name_topk(spark, sf_dir):
    return blocking.channel_pairs(*_channel(spark, sf_dir, "name"), blocking.NAME_TOPK, common=False)


@query(_PAIR, f"with {duck.VIEWS}, {duck.channel('a', duck.ALL_TOKENS, 50, 40)} select * from b_a")
def block_two_tiers(spark, sf_dir):
    return blocking.channel_pairs(*_channel(spark, sf_dir, "all", gen_cap=40), blocking.TOPK)


_TABLE = "country string, s1 long, cand long, score double, shared long, rank long, nscore double, nshared long, nrank long"


@query(_TABLE, f"with {duck.pairs()} select * from pairs")
def block_union(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query("cand long, t_best double, t_second double, t_claims long", f"with {duck.pairs()}, {duck.CONTENTION} select * from meta")
def target_contention(spark, sf_dir):
    return blocking.contention(_pairs(spark, sf_dir))


@query(_TABLE, f"with {duck.pairs()} select * from pairs where s1 % 10 = 0")
def stored_sample(spark, sf_dir):
    return blocking.stored_sample(_pairs(spark, sf_dir), _entities(spark, sf_dir).where("s1 % 10 = 0"))


@query("which string, n long", f"with {duck.pairs()} select 'union' as which, count(*) as n from u union all select 'intersect', count(*) from (select s1, cand from b_a intersect select s1, cand from b_n) union all select 'all_only', count(*) from (select s1, cand from b_a except select s1, cand from b_n) union all select 'name_only', count(*) from (select s1, cand from b_n except select s1, cand from b_a)")
def channel_sets(spark, sf_dir):
    a, n = (staged(blocking.channel_pairs(*_channel(spark, sf_dir, x), k, common=False).select("s1", "cand")) for x, k in (("all", 50), ("name", 25)))
    count = lambda df, which: df.agg(F.lit(which).alias("which"), F.count("*").alias("n"))
    return count(a.union(n).distinct(), "union").union(count(a.intersect(n), "intersect")).union(count(a.subtract(n), "all_only")).union(count(n.subtract(a), "name_only"))


# ---- features --------------------------------------------------------------------------------------------------------

_CONTEXT_SQL = f"""with {duck.pairs()}, {duck.CONTENTION},
 x as (select *, max(score) over s as top, max(nscore) over s as ntop, count(*) over s as size, coalesce(lead(score) over (partition by s1 order by rank), 0) as nxt,
   case when score >= t_best - 1e-4 then 0 when score >= t_second - 1e-4 then 1 else 2 end as rev from pairs join meta using (cand) window s as (partition by s1))
 select s1, cand, score as block_score, shared as n_shared, rank, score / greatest(top, 1e-6) as score_ratio_top, score - nxt as score_gap_next, size as n_candidates, cast(cand >= 3000000000 as double) as is_s3,
   score / greatest(t_best, 1e-6) as target_best_ratio, t_claims as target_n_claims, rev as rev_rank, least(score / greatest(case when rev = 0 then t_second else t_best end, 1e-6), 10) as target_margin,
   nscore as name_block_score, nshared as name_block_shared, nrank as name_block_rank, nscore / greatest(ntop, 1e-6) as name_block_ratio_top from x"""


@query("s1 long, cand long, " + ", ".join(f"{c} double" for c in features.CONTEXT), _CONTEXT_SQL)
def context_features(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return features.context(p, blocking.contention(p))


_LIST_SQL = f"""with {duck.pairs()}, {duck.SCORED},
 x as (select *, row_number() over (partition by s1 order by p desc, cand) as r, max(p) over (partition by s1) as pmax, count(*) over (partition by s1) as n from scored),
 y as (select *, coalesce(max(case when r = 2 then p end) over (partition by s1), 0) as p2 from x)
 select s1, cand, p as p1, r - 1 as p1_rank, p - case when r = 1 then p2 else pmax end as p1_gap, pmax as ent_pmax, p2 as ent_p2nd, sum(p) over (partition by s1) as ent_psum,
   count(*) filter (where p >= 0.5) over (partition by s1) as ent_n50, n as ent_n, cast(row_number() over (partition by s1, cand // 1000000000 order by p desc, cand) = 1 as double) as best_in_source from y"""


@query("s1 long, cand long, " + ", ".join(f"{c} double" for c in features.LIST), _LIST_SQL)
def list_features(spark, sf_dir):
    return features.list_features(_scored(_pairs(spark, sf_dir)))


def _viewed(spark, sf_dir, columns):
    v = _views(spark, sf_dir)
    return features.with_views(_pairs(spark, sf_dir).select("country", "s1", "cand"), v, columns)


_VIEWED = f"with {duck.pairs()}, {duck.VIEWED}"
_D = duck
_SETS_SQL = f"""{_VIEWED}, y as (select *, {_D.containment('a_core', 'b_core')} as cc, {_D.containment('a_atok', 'b_atok')} as ac from viewed)
 select s1, cand, {_D.jaccard('a_core', 'b_core')} as name_core_jacc, cc as name_core_cont, {_D.jaccard('a_ntok', 'b_ntok')} as name_all_jacc, {_D.jaccard('a_ntri', 'b_ntri')} as name_tri_jacc,
   {_D.flag('len(a_core) > 0 and list_sort(a_core) = list_sort(b_core)')} as name_sorted_eq,
   {_D.flag("len(a_core) > 0 and len(b_core) > 0 and list_sort(list_transform(a_core, lambda t: substr(t, 1, 1))) = list_sort(list_transform(b_core, lambda t: substr(t, 1, 1)))")} as name_initials_eq,
   cast(least(length(a_name), length(b_name)) as double) / greatest(length(a_name), length(b_name), 1) as name_len_ratio, len(list_intersect(a_core, b_core)) as name_core_shared,
   {_D.jaccard('a_skel', 'b_skel')} as name_skel_jacc, {_D.containment('a_skel', 'b_skel')} as name_skel_cont, {_D.jaccard('a_atok', 'b_atok')} as addr_jacc, ac as addr_cont, {_D.jaccard('a_atri', 'b_atri')} as addr_tri_jacc,
   {_D.containment('a_num', 'b_num')} as addr_num_cont, {_D.flag('list_has_any(a_num, b_num)')} as addr_num_any, {_D.containment('a_askel', 'b_askel')} as addr_skel_cont, {_D.disjoint('a_num', 'b_num')} as num_conflict,
   len({_D.without('b_core', 'a_core')}) as extra_core, len({_D.without('a_core', 'b_core')}) as missing_core, {_D.disjoint('a_core', 'b_core')} as core_disjoint,
   {_D.flag('len(b_atok) = 0')} as addr_empty_cand, {_D.flag('len(a_atok) = 0')} as addr_empty_s1, {_D.flag("b_script = 'indic'")} as cand_script_indic,
   {_D.flag("a_script <> b_script and a_script <> 'none' and b_script <> 'none'")} as script_mismatch, {_D.flag('cc >= 0.8 and ac < 0.2')} as name_only_evidence, {_D.flag('ac >= 0.8 and cc < 0.2')} as addr_only_evidence from y"""
_SET_NAMES = "name_core_jacc name_core_cont name_all_jacc name_tri_jacc name_sorted_eq name_initials_eq name_len_ratio name_core_shared name_skel_jacc name_skel_cont addr_jacc addr_cont addr_tri_jacc addr_num_cont addr_num_any addr_skel_cont num_conflict extra_core missing_core core_disjoint addr_empty_cand addr_empty_s1 cand_script_indic script_mismatch name_only_evidence addr_only_evidence".split()


@query("s1 long, cand long, " + ", ".join(f"{c} double" for c in _SET_NAMES), _SETS_SQL)
def text_set_features(spark, sf_dir):
    return features.text_sets(_pairs(spark, sf_dir).select("country", "s1", "cand"), _views(spark, sf_dir))


@query("s1 long, cand long, name_ratio double, name_token_set double, name_partial double, name_skel_ratio double, name_compact_partial double, addr_token_set double")
def fuzzy_features(spark, sf_dir):
    return features.text_fuzzy(_pairs(spark, sf_dir).select("country", "s1", "cand"), _views(spark, sf_dir))


_RUNS = lambda s: f"list_distinct(flatten(list_transform({s}_atok, lambda t: regexp_extract_all(t, '[0-9]+'))))"
_TOLS = lambda s: f"list_distinct(flatten(list_transform({s}_runs, lambda d: {_D.tolerant('d')})))"
_ONLY = lambda s, o: f"len(list_filter({s}_runs, lambda d: not list_has_any({_D.tolerant('d')}, {o}_tol)))"
_BARE = lambda s: f"list_distinct(list_transform({s}_runs, lambda d: ltrim(d, '0')))"
_MIXED = lambda s: rf"list_filter({s}_atok, lambda t: regexp_matches(t, '\p{{N}}') and regexp_matches(t, '\p{{L}}'))"
_KNOWN = "len(a_atok) > 0 and len(b_atok) > 0"
_NUMBER_SQL = f"""{_VIEWED}, r as (select s1, cand, a_atok, b_atok, {_RUNS('a')} as a_runs, {_RUNS('b')} as b_runs, {_MIXED('a')} as a_mixed, {_MIXED('b')} as b_mixed from viewed),
 t as (select *, {_TOLS('a')} as a_tol, {_TOLS('b')} as b_tol from r), o as (select *, {_ONLY('a', 'b')} as a_only, {_ONLY('b', 'a')} as b_only from t)
 select s1, cand, case when {_KNOWN} then len(list_intersect({_BARE('a')}, {_BARE('b')})) else 0 end as num_exact_shared, case when {_KNOWN} then a_only else 0 end as num_a_only, case when {_KNOWN} then b_only else 0 end as num_b_only,
   case when {_KNOWN} then {_D.flag('list_has_any(a_tol, b_tol) and a_only > 0 and b_only > 0')} else 0 end as unit_conflict, case when {_KNOWN} then {_D.flag('list_has_any(a_mixed, b_mixed)')} else 0 end as alnum_match,
   case when {_KNOWN} then {_D.disjoint('a_mixed', 'b_mixed')} else 0 end as alnum_conflict from o"""


@query("s1 long, cand long, num_exact_shared double, num_a_only double, num_b_only double, unit_conflict double, alnum_match double, alnum_conflict double", _NUMBER_SQL)
def number_evidence(spark, sf_dir):
    return features.number_evidence(_viewed(spark, sf_dir, ("atok",)))


_C2 = f"{_VIEWED}, c as (select s1, cand, {_D.core('a_ntok')} as a, {_D.core('b_ntok')} as b from viewed)"


@query("s1 long, cand long, core2_jacc double, core2_cont double, core2_extra double, core2_missing double, core2_disjoint double", f"{_C2} select s1, cand, {_D.jaccard('a', 'b')} as core2_jacc, {_D.containment('a', 'b')} as core2_cont, len({_D.without('b', 'a')}) as core2_extra, len({_D.without('a', 'b')}) as core2_missing, {_D.disjoint('a', 'b')} as core2_disjoint from c")
def core2_features(spark, sf_dir):
    return features.core2(_viewed(spark, sf_dir, ("ntok",)))


_COUNTS = f"counts as (select country, {_D.sorted_set('core')} as name_key, count(*) as n from v where source = 1 and len(core) > 0 group by 1, 2)"


@query("country string, name_key string, n long", f"with {duck.VIEWS}, {_COUNTS} select * from counts")
def name_counts(spark, sf_dir):
    return features.name_counts(_views(spark, sf_dir))


_AMB_SQL = f"""{_VIEWED}, {_COUNTS}, w as (select viewed.*, coalesce(x.n, 0) as a_n, coalesce(y.n, 0) as b_n, len(list_intersect(a_atok, b_atok)) as sh from viewed
   left join counts x on x.country = viewed.country and x.name_key = {_D.sorted_set('a_core')} left join counts y on y.country = viewed.country and y.name_key = {_D.sorted_set('b_core')})
 select s1, cand, ln(1 + a_n) as s1_core_name_frequency, ln(1 + b_n) as cand_core_name_frequency, cast(least(a_n, b_n) as double) / greatest(a_n, b_n, 1) as core_name_count_ratio, len(a_atok) as addr_tokens_s1, len(b_atok) as addr_tokens_cand,
   cast(sh as double) / greatest(len(a_atok), 1) as addr_coverage_s1, cast(sh as double) / greatest(len(b_atok), 1) as addr_coverage_cand, len({_D.without('b_atok', 'a_atok')}) as addr_unshared_cand, len(a_num) as addr_numbers_s1, len(b_num) as addr_numbers_cand,
   len({_D.without('b_num', 'a_num')}) as addr_numbers_unshared_cand, {_D.disjoint(_D.without('a_atok', 'a_num'), _D.without('b_atok', 'b_num'))} as addr_alpha_disjoint from w"""
_AMB = "s1_core_name_frequency cand_core_name_frequency core_name_count_ratio addr_tokens_s1 addr_tokens_cand addr_coverage_s1 addr_coverage_cand addr_unshared_cand addr_numbers_s1 addr_numbers_cand addr_numbers_unshared_cand addr_alpha_disjoint".split()


@query("s1 long, cand long, " + ", ".join(f"{c} double" for c in _AMB), _AMB_SQL)
def ambiguity_features(spark, sf_dir):
    v = _views(spark, sf_dir)
    return features.ambiguity(_pairs(spark, sf_dir), v, features.name_counts(v))


def _candidates(spark, sf_dir):
    """The whole candidate table with p, and its views."""
    v = _views(spark, sf_dir)
    return _scored(_pairs(spark, sf_dir)), v


def _prev(i: int) -> str:
    return f"e{i - 1}" if i else "e"


_RANKED = f"with {duck.pairs()}, {duck.SCORED}, r as materialized (select s1, cand, p, row_number() over (partition by s1 order by p desc, cand) - 1 as pos from scored)"


@query("s1 long, cand long, other long, p double, q double, pos long", f"{_RANKED} select a.s1, a.cand, b.cand as other, a.p, b.p as q, b.pos from r a join (select * from r where pos < 8 and p >= 0.3) b on a.s1 = b.s1 and a.cand <> b.cand where a.p >= 0.02")
def coherence_pairs(spark, sf_dir):
    return features.supporters(_candidates(spark, sf_dir)[0])


@query("s1 long, cand long, " + ", ".join(f"{c} double" for c in features.COHERENCE))
def coherence_features(spark, sf_dir):
    return features.coherence(*_candidates(spark, sf_dir))


@query("s1 long, cand long, " + ", ".join(f"{c} double" for c in features.JOINT))
def joint_features(spark, sf_dir):
    return features.joint(*_candidates(spark, sf_dir))


# ---- truth, decisions, metrics ---------------------------------------------------------------------------------------


@query("s1 long, cand long", f"with {duck.ER}, {duck.TRUTH} select * from truth")
def true_links(spark, sf_dir):
    return _truth(spark, sf_dir)


_ALL = f"with {duck.pairs()}, {duck.SCORED}, {duck.TRUTH}"
_LINKS = "links as (select s1, cand, p from scored where p >= 0.6 qualify row_number() over (partition by cand order by p desc, s1) = 1)"


@query("s1 long, cand long, y long", f"{_ALL} select scored.s1, scored.cand, cast(truth.s1 is not null as integer) as y from scored left join truth using (s1, cand)")
def label_pairs(spark, sf_dir):
    return models.labelled(_pairs(spark, sf_dir), _truth(spark, sf_dir))


@query("s1 long, cand long, p double", f"{_ALL}, {_LINKS} select * from links")
def one_to_one_assign(spark, sf_dir):
    return decide.assign(_scored(_pairs(spark, sf_dir)), 0.6)


_THR = "case country when 'en' then least(0.7 + 0.1, 0.995) when 'de' then least(0.65 + 0.1, 0.995) else least(0.9 + 0.1, 0.995) end"


@query("s1 long, cand long, p double, threshold double", f"{_ALL} select s1, cand, p, {_THR} as threshold from scored where p >= {_THR} qualify row_number() over (partition by cand order by p desc, s1) = 1")
def country_thresholds(spark, sf_dir):
    t = spark.createDataFrame([("en", 0.7), ("de", 0.65)], "country string, threshold double")
    p = decide.with_thresholds(_scored(_pairs(spark, sf_dir)), t, 0.9, shift=0.1)
    return decide.assign(p, F.col("threshold"))


_F05 = """counts as (select e.code as s1, e.country, count(distinct l.cand) as predicted, count(distinct t.cand) as actual, count(distinct case when t2.cand is not null then l.cand end) as hits
   from (select code, country from er where source = 1) e left join links l on l.s1 = e.code left join truth t on t.s1 = e.code left join truth t2 on t2.s1 = l.s1 and t2.cand = l.cand group by 1, 2),
 f as (select *, case when predicted = 0 and actual = 0 then 1.0 when hits = 0 then 0.0 else 1.25 * (hits / predicted) * (hits / actual) / (0.25 * (hits / predicted) + hits / actual) end as f05 from counts)"""


def _decided(spark, sf_dir):
    return staged(decide.assign(_scored(_pairs(spark, sf_dir)), 0.6))


@query("entities long, macro_f05 double", f"{_ALL}, {_LINKS}, {_F05} select count(*) as entities, avg(f05) as macro_f05 from f")
def macro_f05(spark, sf_dir):
    return metrics.macro_f05(_entities(spark, sf_dir), _decided(spark, sf_dir), _truth(spark, sf_dir))


@query("outcome string, entities long, false_links long, missed_links long", f"""{_ALL}, {_LINKS}, {_F05} select case when predicted = hits and actual = hits then 'perfect' when predicted > hits and actual > hits then 'both' when actual > hits then 'missed_only' when actual = 0 then 'false_only_singleton' else 'false_only' end as outcome,
 count(*) as entities, sum(predicted - hits) as false_links, sum(actual - hits) as missed_links from f group by 1""")
def error_taxonomy(spark, sf_dir):
    return metrics.taxonomy(metrics.entity_counts(_entities(spark, sf_dir), _decided(spark, sf_dir), _truth(spark, sf_dir)))


@query("cohort string, entities long, macro_f05 double, false_links long, missed_links long, false_singleton_merges long", f"""{_ALL}, {_LINKS}, {_F05}, c as (select 'all' as cohort, * from f union all select 'linked', * from f where actual > 0 union all select 'english', * from f where country = 'en')
 select cohort, count(*) as entities, avg(f05) as macro_f05, sum(predicted - hits) as false_links, sum(actual - hits) as missed_links, count(*) filter (where actual = 0 and predicted > 0) as false_singleton_merges from c group by 1""")
def cohort_metrics(spark, sf_dir):
    e = _entities(spark, sf_dir)
    c = metrics.entity_counts(e, _decided(spark, sf_dir), _truth(spark, sf_dir)).join(e, "s1")
    return metrics.cohorts(c, {"all": F.lit(True), "linked": F.col("actual") > 0, "english": F.col("country") == "en"})


_GRID = "[" + ", ".join(str(t) for t in sorted(set(decide.GRID))) + "]"


def _sweep_sql(by: str) -> str:
    group = f"{by}, " if by else ""
    return f"""{_ALL}, g as (select unnest({_GRID}) as threshold), e as (select code as s1, country from er where source = 1),
 k as (select s1, cand, threshold from scored join g on p >= threshold qualify row_number() over (partition by {group}threshold, cand order by p desc, s1) = 1),
 h as (select k.s1, threshold, count(*) as predicted, count(truth.cand) as hits from k left join truth using (s1, cand) group by 1, 2), t as (select s1, count(*) as actual from truth group by 1),
 c as (select {group}e.s1, threshold, coalesce(predicted, 0) as predicted, coalesce(hits, 0) as hits, coalesce(actual, 0) as actual from e cross join g left join h using (s1, threshold) left join t using (s1))
 select {group}threshold, avg(case when predicted = 0 and actual = 0 then 1.0 when hits = 0 then 0.0 else 1.25 * (hits / predicted) * (hits / actual) / (0.25 * (hits / predicted) + hits / actual) end) as macro_f05 from c group by all"""


@query("threshold double, macro_f05 double", _sweep_sql(""))
def threshold_sweep(spark, sf_dir):
    return metrics.sweep(staged(_scored(_pairs(spark, sf_dir)).select("s1", "cand", "p")), _entities(spark, sf_dir), _truth(spark, sf_dir))


@query("country string, threshold double, macro_f05 double", f"select country, threshold, macro_f05 from ({_sweep_sql('country')}) qualify row_number() over (partition by country order by round(macro_f05, 9) desc, threshold) = 1")
def tuned_thresholds(spark, sf_dir):
    s = metrics.sweep(staged(_scored(_pairs(spark, sf_dir)).select("s1", "cand", "p")), _entities(spark, sf_dir), _truth(spark, sf_dir), by="country")
    return metrics.best_threshold(s, "country")


@query("threshold double", f"{_ALL} select coalesce(quantile_cont(p, 0.001), 0) as threshold from (select scored.p from scored join truth using (s1, cand) where p >= 0.5)")
def prefilter_quantile(spark, sf_dir):
    p = models.labelled(_scored(_pairs(spark, sf_dir)), _truth(spark, sf_dir))
    return metrics.prefilter_threshold(p.select(F.col("p").alias("p1"), ((F.col("y") == 1) & (F.col("p") >= 0.5)).alias("accepted")))


@query("k long, hits long, links long, pairs long, recall double", f"{_ALL}, k as (select unnest([1, 5, 10, 20, 50]) as k), l as (select truth.*, rank from truth left join pairs using (s1, cand)) select k, (select count(*) from l where rank < k) as hits, (select count(*) from l) as links, (select count(*) from pairs where rank < k) as pairs, cast((select count(*) from l where rank < k) as double) / greatest((select count(*) from l), 1) as recall from k")
def recall_at_k(spark, sf_dir):
    return metrics.recall_at(_pairs(spark, sf_dir), _truth(spark, sf_dir))


@query("links long, by_name long, by_either long, missed long", f"{_ALL} select count(*) as links, count(*) filter (where nrank < 999) as by_name, count(nrank) as by_either, count(*) - count(nrank) as missed from truth left join pairs using (s1, cand)")
def channel_recall(spark, sf_dir):
    return metrics.channel_recall(_pairs(spark, sf_dir), _truth(spark, sf_dir))


@query("s1 long, cand long", f"{_ALL} select s1, cand from truth anti join pairs using (s1, cand)")
def anti_missed(spark, sf_dir):
    return metrics.missed_links(_truth(spark, sf_dir), _pairs(spark, sf_dir))


@query("s1 long, country string", f"{_ALL} select code as s1, country from er where source = 1 and exists (select 1 from truth where truth.s1 = er.code)")
def semi_linked(spark, sf_dir):
    return _entities(spark, sf_dir).join(_truth(spark, sf_dir), "s1", "left_semi")


@query("kept long, links long, ceiling double", f"{_ALL} select (select count(*) from truth semi join pairs using (s1, cand)) as kept, (select count(*) from truth) as links, cast((select count(*) from truth semi join pairs using (s1, cand)) as double) / greatest((select count(*) from truth), 1) as ceiling")
def recall_ceiling(spark, sf_dir):
    return metrics.recall_ceiling(models.labelled(_pairs(spark, sf_dir), _truth(spark, sf_dir)), _truth(spark, sf_dir))


@query("entities long, macro_f05 double", f"{_ALL}, links as (select scored.s1, scored.cand from scored join truth using (s1, cand)), {_F05} select count(*) as entities, avg(f05) as macro_f05 from f")
def oracle_f05(spark, sf_dir):
    return metrics.macro_f05(_entities(spark, sf_dir), metrics.oracle_links(models.labelled(_pairs(spark, sf_dir), _truth(spark, sf_dir))), _truth(spark, sf_dir))


@query("mean double, low double, high double")
def bootstrap_interval(spark, sf_dir):
    c = metrics.f05(metrics.entity_counts(_entities(spark, sf_dir), _decided(spark, sf_dir), _truth(spark, sf_dir)))
    return metrics.bootstrap(c.select("s1", F.col("f05").alias("delta")))


@query("s1 long, cand long, p double")
def best_k_decode(spark, sf_dir):
    return decide.decode_expected(_candidates(spark, sf_dir)[0].select("s1", "cand", "p"), 0.1)


@query("prior double", f"{_RANKED}, e as (select 0 as i, cast(0.3 as double) as prior), {', '.join(f'e{i} as (select avg(p * (prior / 0.3) / (p * (prior / 0.3) + (1 - p) * ((1 - prior) / 0.7))) as prior from r, {_prev(i)})' for i in range(20))} select prior from e19")
def em_prior(spark, sf_dir):
    return spark.createDataFrame([(metrics.em_prior(_candidates(spark, sf_dir)[0], 0.3),)], "prior double")


# ---- lists, checks, subsets ------------------------------------------------------------------------------------------


@query("source1_entity_id string, candidate_entity_ids string", f"{_ALL} select 'S1-' || (e.code % 1000000000) as source1_entity_id, coalesce(string_agg('S' || (cand // 1000000000) || '-' || (cand % 1000000000), ',' order by rank), '') as candidate_entity_ids from (select code from er where source = 1) e left join pairs on s1 = e.code group by e.code")
def candidate_lists(spark, sf_dir):
    return tsv.candidate_lists(_entities(spark, sf_dir), _pairs(spark, sf_dir))


_ID = "'S' || (cand // 1000000000) || '-' || (cand % 1000000000)"


@query("source1_entity_id string, matched_entity_ids string", f"{_ALL}, {_LINKS} select 'S1-' || (e.code % 1000000000) as source1_entity_id, coalesce(string_agg({_ID}, ',' order by {_ID}), '') as matched_entity_ids from (select code from er where source = 1) e left join links on s1 = e.code group by e.code")
def matching_lists(spark, sf_dir):
    return tsv.matching_lists(_entities(spark, sf_dir), _decided(spark, sf_dir))


@query("source1_entity_id string, matched_entity_ids string", f"{_ALL}, {_LINKS} select 'S1-' || (s1 % 1000000000) as source1_entity_id, string_agg({_ID}, ',' order by {_ID}) as matched_entity_ids from links where p >= 0.9 group by s1")
def confident_links(spark, sf_dir):
    return tsv.confident_links(_decided(spark, sf_dir), F.col("p"), 0.9)


_VALIDATE_SQL = f"""with {duck.ER}, lists as (select 'S1-' || doc_id as id, case when doc_id % 7 = 0 then 'S2-' || (doc_id + 1) || ',S2-' || (doc_id + 1) when doc_id % 7 = 1 then 'S1-' || doc_id when doc_id % 7 = 2 then 'X-1' when doc_id % 7 = 3 then 'S3-' || (doc_id * 1000) else '' end as ids
   from documents where doc_id % 3 < 2 union all select 'S1-' || doc_id, '' from documents where doc_id % 50 = 0),
 items as (select id, item from (select id, unnest(string_split(ids, ',')) as item from lists) where item <> ''),
 need as (select 'S1-' || (code % 1000000000) as id from er where source = 1), known as (select 'S' || source || '-' || (code % 1000000000) as item from er),
 x as (select 'duplicate_s1' as rule, id as example from lists group by id having count(*) > 1 union all select 'duplicate_id', id || ':' || item from items group by id, item having count(*) > 1
   union all select 'self_match', id || ':' || item from items where item like 'S1-%' union all select 'wrong_prefix', id || ':' || item from items where not regexp_matches(item, '^S[123]-')
   union all select 'missing_s1', id from need anti join lists using (id) union all select 'extra_s1', id from (select distinct id from lists) anti join need using (id) union all select 'unknown_id', id || ':' || item from items anti join known using (item)),
 r as (select rule, example, row_number() over (partition by rule order by example) as r from (select distinct rule, example from x))
 select rule, 'error' as level, (select count(*) from x where x.rule = r.rule) as offenders, string_agg(example, ' ' order by example) filter (where r.r <= 5) as examples from r group by rule"""


@query("rule string, level string, offenders long, examples string", _VALIDATE_SQL)
def validator_findings(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d, m = F.col("doc_id"), F.col("doc_id") % 7
    s = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    ids = F.when(m == 0, F.concat_ws(",", s("S2-", d + 1), s("S2-", d + 1))).when(m == 1, s("S1-", d)).when(m == 2, F.lit("X-1")).when(m == 3, s("S3-", d * 1000)).otherwise("")
    lists = docs.where("doc_id % 3 < 2").select(s("S1-", d).alias("source1_entity_id"), ids.alias("matched_entity_ids")).unionAll(docs.where("doc_id % 50 = 0").select(s("S1-", d), F.lit("")))
    r = _records(spark, sf_dir)
    return validate.findings(lists, r.where("source = 1").select("entity_id"), r.select("entity_id"))


@query("code long, country string", f"with {duck.ER} select code, country from er where country = 'de'")
def country_subset(spark, sf_dir):
    return tsv.country_subset(_records(spark, sf_dir), "de")


_DEV_SQL = f"""with {duck.ER}, {duck.TRUTH}, first as (select distinct s1 from truth order by s1 limit 20), t as (select distinct cand from truth semi join first using (s1)),
 other as (select code from er where source > 1 and code % 20 = 0 and code not in (select cand from t) order by code limit 30)
 select code, source from er where code in (select s1 from first) or code in (select cand from t) or code in (select code from other)"""


@query("code long, source long", _DEV_SQL)
def dev_subset(spark, sf_dir):
    return tsv.dev_subset(_records(spark, sf_dir), _truth(spark, sf_dir), 20, 30)


@query("s1 long, cand long, part long", f"{_ALL} select s1, cand, case when s1 % 4 = 0 then 2 else 1 end as part from pairs")
def manifest_override(spark, sf_dir):
    p = staged(_pairs(spark, sf_dir).select("s1", "cand"))
    return decide.latest([p.withColumn("part", F.lit(1)), p.where("s1 % 4 = 0").withColumn("part", F.lit(2))])


# ---- aliases, expansion ----------------------------------------------------------------------------------------------

_MINE_SQL = f"""with {duck.VIEWS}, {duck.TRUTH}, linked as (select code as s1, nseq, list_distinct(list_concat(nseq, aseq)) as al from v where code in (select s1 from truth)),
 pr as (select s1, a.nseq as a_seq, a.al as a_all, b.nseq as b_seq, list_distinct(list_concat(b.nseq, b.aseq)) as b_all from truth join linked a using (s1) join v b on b.code = cand),
 pv as (select *, list_filter(a_all, lambda t: regexp_matches(t, '[a-z]')) as a_latin, list_filter(b_all, lambda t: length(t) >= 2 and not regexp_full_match(t, '\\p{{N}}+') and (not regexp_matches(t, '[a-z]') or (length(t) <= 4 and not list_contains(a_all, t)))) as vs from pr),
 vc as (select variant, count(*) as var_count from (select unnest(vs) as variant from pv) group by 1),
 tg as (select variant, unnest(a_latin) as canonical, 1 as w from (select a_latin, unnest(vs) as variant from pv)),
 al as (select b_seq[i] as variant, a_seq[i] as canonical, 3 as w from (select *, unnest(range(1, len(b_seq) + 1)) as i from pv where len(a_seq) = len(b_seq) and len(vs) > 0) where list_contains(vs, b_seq[i]) and regexp_matches(a_seq[i], '[a-z]') and b_seq[i] <> a_seq[i]),
 co as (select variant, canonical, sum(w) as count from (select * from tg union all select * from al) group by 1, 2),
 cc as (select canonical, count(*) as can_count from (select unnest(list_filter(al, lambda t: regexp_matches(t, '[a-z]'))) as canonical from linked) group by 1),
 s as (select co.variant, co.canonical, co.count, co.count / var_count as consistency, co.count / (var_count * (cc.can_count / (select count(*) from linked))) as lift, regexp_matches(co.variant, '[a-z]') as latin, coalesce(own.can_count, 0) as as_word, var_count
   from co join vc using (variant) join cc using (canonical) left join cc own on own.canonical = co.variant)
 select variant, canonical, lift * consistency as score, count from s where count >= 3 and not (latin and as_word > 0.5 * var_count) and consistency >= 0.3 and lift >= 4
 qualify row_number() over (partition by variant order by round(lift * consistency, 6) desc, canonical) = 1"""


def _mined(spark, sf_dir):
    r = _records(spark, sf_dir)
    seqs = r.select("code", "source", text.name_tokens(F.col("name")).alias("name_seq"), text.tokens(F.col("address")).alias("addr_seq"))
    cooc, variants, canonicals = aliases.evidence(seqs.where("source = 1"), _truth(spark, sf_dir), seqs)
    n = _truth(spark, sf_dir).select("s1").distinct().count()
    return aliases.score(cooc, variants, canonicals, n, latin_factor=1)  # the data has Latin variants alone


@query("variant string, canonical string, score double, count long", _MINE_SQL)
def alias_mine(spark, sf_dir):
    return _mined(spark, sf_dir)


_BASE = "base as (select * from (values ('la', 'the', 9.0, 5), ('der', 'the', 8.0, 4), ('inge', 'ing', 7.0, 3)) t(variant, canonical, score, count))"
_BOOT = "boot as (select * from (values ('la', 'x', 1.0, 1), ('rd', 'road', 2.0, 3), ('st', 'der', 3.0, 3), ('a1', 'able', 4.0, 3), ('bd', 'cd', 5.0, 3), ('av', 'a', 5.0, 3), ('ave', 'avenue', 6.0, 9)) t(variant, canonical, score, count))"


def _lexicons(spark):
    schema = "variant string, canonical string, score double, count long"
    base = spark.createDataFrame([("la", "the", 9.0, 5), ("der", "the", 8.0, 4), ("inge", "ing", 7.0, 3)], schema)
    boot = spark.createDataFrame([("la", "x", 1.0, 1), ("rd", "road", 2.0, 3), ("st", "der", 3.0, 3), ("a1", "able", 4.0, 3), ("bd", "cd", 5.0, 3), ("av", "a", 5.0, 3), ("ave", "avenue", 6.0, 9)], schema)
    return base, boot


@query("variant string, canonical string, score double, count long", f"with {_BASE}, {_BOOT} select * from base union all select * from boot where variant not in (select variant from base) and canonical not in (select variant from base)")
def alias_merge(spark, sf_dir):
    return aliases.merge(*_lexicons(spark))


@query("variant string, canonical string, score double, count long", f"with {_BASE}, {_BOOT} select * from base union all select * from boot where variant not in (select variant from base) and not regexp_matches(variant, '[0-9]') and length(canonical) >= 2 and substr(variant, 1, 1) = substr(canonical, 1, 1)")
def alias_curate(spark, sf_dir):
    return aliases.curate(*_lexicons(spark))


_EXPAND_SQL = f"""with {duck.pairs()}, links as (select s1, cand as member, round(score / (score + 50), 6) as p from pairs where round(score / (score + 50), 6) >= 0.6),
 ks as (select country, code, unnest(['core', 'skel', 'compact']) as kind, unnest([{_D.sorted_set('core')}, {_D.sorted_set('skel')}, array_to_string(cseq, '')]) as value from v),
 kk as (select * from ks where length(value) >= 3), rare as (select country, kind, value, count(*) as freq from kk where code >= 2000000000 group by 1, 2, 3 having count(*) <= 20),
 ms as (select code as s1, code as member, 1.0 as p from v where source = 1 union all select * from links),
 fd as (select ms.s1, ms.member, ms.p, a.kind, freq, b.code as cand from ms join kk a on a.code = ms.member join rare using (country, kind, value) join kk b on b.country = a.country and b.kind = a.kind and b.value = a.value and b.code >= 2000000000 and b.code <> ms.member),
 nw as (select * from fd anti join (select s1, cand from pairs) using (s1, cand)),
 ag as (select s1, cand, {", ".join(f"max(cast(s1 {'=' if side == 's1' else '<>'} member and kind = '{k}' as integer)) as hit_{k}_{side}" for side in ("s1", "m") for k in expand.KINDS)},
   count(distinct case when s1 <> member then member end) as n_member_hits, min(freq) as min_freq, coalesce(max(case when s1 <> member then p end), 0) as best_member_p from nw group by 1, 2)
 select * from ag qualify row_number() over (partition by s1 order by min_freq, cand) <= 30"""


def _expanded(spark, sf_dir, pairs=None, v=None):
    pairs, v = _candidates(spark, sf_dir) if pairs is None else (pairs, v)
    seeds = pairs.where("p >= 0.6").select("s1", F.col("cand").alias("member"), "p")
    return expand.generate(v, seeds, pairs), pairs, seeds, v


@query("s1 long, cand long, hit_core_s1 long, hit_skel_s1 long, hit_compact_s1 long, hit_core_m long, hit_skel_m long, hit_compact_m long, n_member_hits long, min_freq long, best_member_p double", _EXPAND_SQL)
def key_expand(spark, sf_dir):
    return _expanded(spark, sf_dir)[0]


@query("s1 long, cand long, n_member_hits double, log_min_freq double, best_member_p double, ent_n_pred double, ent_pmax double, ent_psum double, is_s3 double, mem_name_max double, mem_tri_max double, mem_addr_max double, mem_conflict_min double")
def expansion_features(spark, sf_dir):
    found, pairs, seeds, v = _expanded(spark, sf_dir, *_candidates(spark, sf_dir))
    out = expand.features(found, pairs, seeds.withColumnRenamed("member", "cand"))
    return out.join(expand.member_similarities(found, seeds, v), ["s1", "cand"])


@query("s1 long, cand long, p double", f"select s1, cand, p from (select *, round(n_member_hits / (n_member_hits + 1), 6) as p from ({_EXPAND_SQL})) where p >= 0.5 and cand not in (select cand from (with {duck.pairs()} select cand from pairs where round(score / (score + 50), 6) >= 0.6)) qualify row_number() over (partition by cand order by p desc, s1) = 1")
def expansion_accept(spark, sf_dir):
    found, _, seeds, _ = _expanded(spark, sf_dir)
    scored = found.withColumn("p", F.round(F.col("n_member_hits") / (F.col("n_member_hits") + 1), 6))
    return decide.accept_expansion(scored.select("s1", "cand", "p"), seeds.withColumnRenamed("member", "cand"), 0.5)


# ---- models, streams -------------------------------------------------------------------------------------------------


@query("s1 long, cand long, p double")
def classifier_pairs(spark, sf_dir):
    return models.demo(_pairs(spark, sf_dir), _truth(spark, sf_dir))


_BASE_FEATURES = ["score", "shared", "rank", "nscore", "nshared", "nrank"]


def _matrix(spark, sf_dir):
    """Labelled candidate pairs with base features: the input of the learned operators."""
    return _kept(spark, sf_dir, "matrix", lambda: written(models.labelled(_pairs(spark, sf_dir), _truth(spark, sf_dir))))


@query("s1 long, cand long, y long, fold long, p double")
def out_of_fold_scores(spark, sf_dir):
    return _oof(spark, sf_dir)[0]


@query("s1 long, cand long, p double, q double")
def calibrated_scores(spark, sf_dir):
    """Out-of-fold scores, calibrated by the other half of the entities."""
    scored = _oof(spark, sf_dir)[0]
    halves = [scored.where(models.fold_of("s1", 2, 11) == k) for k in (0, 1)]
    parts = [workflow.calibrated(b.select("s1", "cand", "p"), workflow.isotonic(a)).withColumnRenamed("p", "q") for a, b in (halves, halves[::-1])]
    return scored.select("s1", "cand", "p").join(parts[0].unionByName(parts[1]), ["s1", "cand"])


@query("s1 long, cand long, p double")
def trained_links(spark, sf_dir):
    data = _matrix(spark, sf_dir)
    bundle = models.train(data, _entities(spark, sf_dir), _truth(spark, sf_dir), _BASE_FEATURES, context=["score", "rank"])
    return models.predict(bundle, data, shift=0.01)


def _oof(spark, sf_dir):
    """The labelled matrix, its views, and each pair's p from models that never saw its entity."""
    v = _views(spark, sf_dir)
    return _kept(spark, sf_dir, "out_of_fold", lambda: written(models.out_of_fold(_matrix(spark, sf_dir), _BASE_FEATURES))), v


@query("country string, s1 long, cand long, p1 double, p double")
def second_stage_scores(spark, sf_dir):
    """The second stage, trained on out-of-fold p1 and scored for the held-out entities it wasn't fitted on, and all others."""
    data, v = _oof(spark, sf_dir)
    second = workflow.train_second(data, v, _entities(spark, sf_dir), _truth(spark, sf_dir), _BASE_FEATURES)
    first = models.Bundle(models.fit(data, _BASE_FEATURES), _BASE_FEATURES)
    return workflow.predict_second(first, second, data.drop("p"), v)[1]


@query("s1 long, cand long, p double, new boolean")
def expansion_links(spark, sf_dir):
    """Links of out-of-fold scores with the generated ones that a trained expansion model accepts."""
    data, v = _oof(spark, sf_dir)
    scored = data.select("s1", "cand", "p")
    links = staged(decide.assign(scored, workflow.SEED_P))
    model = workflow.train_expansion(scored, v, _entities(spark, sf_dir), _truth(spark, sf_dir))
    return links.withColumn("new", F.lit(False)) if model is None else workflow.predict_expansion(model, scored, links, v)


@query("s1 long, cand long, p double")
def refitted_links(spark, sf_dir):
    """Thresholds and prefilter measured on held-out entities, the model fitted again on all pairs."""
    data = _matrix(spark, sf_dir)
    bundle = models.train(data, _entities(spark, sf_dir), _truth(spark, sf_dir), _BASE_FEATURES, context=["score", "rank"])
    kept = staged(models.prefiltered(data, bundle.prefilter).drop("p1"))
    return models.predict(workflow.refit(bundle, kept, bundle.prefilter_digest), kept, manifest_digest=bundle.prefilter_digest)


_AUDIT_SQL = f"""{_ALL}, a as (select *, rank < 20 as keep from scored),
 e0 as (select distinct s1 from scored join v on v.code = cand where len(v.atok) = 0),
 l as (select 'unfiltered' as variant, s1, cand from a where p >= 0.6 qualify row_number() over (partition by cand order by p desc, s1) = 1
   union all select 'prefiltered', s1, cand from a where p >= 0.6 and keep qualify row_number() over (partition by cand order by p desc, s1) = 1),
 g as (select * from (values ('unfiltered'), ('prefiltered')) t(variant)),
 n as (select g.variant, e.code as s1, (select count(*) from truth where truth.s1 = e.code) as actual from (select code from er where source = 1) e cross join g),
 h as (select l.variant, l.s1, count(*) as predicted, count(truth.cand) as hits from l left join truth using (s1, cand) group by 1, 2),
 c as (select n.*, coalesce(predicted, 0) as predicted, coalesce(hits, 0) as hits, e0.s1 is not null as empty from n left join h using (variant, s1) left join e0 on e0.s1 = n.s1),
 f as (select *, case when predicted = 0 and actual = 0 then 1.0 when hits = 0 then 0.0 else 1.25 * (hits / predicted) * (hits / actual) / (0.25 * (hits / predicted) + hits / actual) end as f05 from c)
 select variant, avg(f05) as macro_f05, count(*) filter (where actual = 0 and predicted > 0) as false_singleton_merges, sum(predicted - hits) as false_links, sum(actual - hits) as missed_links,
  coalesce(avg(f05) filter (where empty), 0) as empty_f05, count(*) filter (where empty) as empty_entities from f group by variant"""


@query("variant string, macro_f05 double, false_singleton_merges long, false_links long, missed_links long, empty_f05 double, empty_entities long", _AUDIT_SQL)
def prefilter_audit(spark, sf_dir):
    pairs, v = _candidates(spark, sf_dir)
    scored = pairs.join(v.select(F.col("code").alias("cand"), (F.size("atok") == 0).cast("int").alias("addr_empty_cand")), "cand").withColumn("keep", F.col("rank") < 20)
    return workflow.audit(staged(scored.select("s1", "cand", "p", "keep", "addr_empty_cand")), 0.6, _entities(spark, sf_dir), _truth(spark, sf_dir))


@query("country string, rate double, macro_f05 double")
def rate_grid(spark, sf_dir):
    """Macro F0.5 of expected-F0.5 decoding at every rate of unseen links, by country."""
    return metrics.rate_sweep(_candidates(spark, sf_dir)[0].select("s1", "cand", "p"), _entities(spark, sf_dir), _truth(spark, sf_dir))


@query("s1 long, cand long, y long, " + ", ".join(f"{c} double" for c in (*features.CONTEXT, *_SET_NAMES)), f"{_ALL} select x.*, y.* exclude (s1, cand), cast(truth.cand is not null as integer) as y from ({_CONTEXT_SQL}) x join ({_SETS_SQL}) y using (s1, cand) left join truth using (s1, cand)")
def built_matrix(spark, sf_dir):
    """The labelled pair matrix, written with its manifest and read again (context and text sets; SQL has no fuzzy ratios)."""
    v = _views(spark, sf_dir)
    pairs = _pairs(spark, sf_dir)
    path = scratch_path(spark, "built")
    pair_files.save_matrix(workflow.build(pairs, blocking.contention(pairs), v, _truth(spark, sf_dir)), _entities(spark, sf_dir), [*features.CONTEXT, *_SET_NAMES, *workflow.FUZZY], path)
    return pair_files.load_matrix(spark, path)


# ---- files -----------------------------------------------------------------------------------------------------------


def _lines(df: DataFrame, path: str, columns: str) -> str:
    """df as a file of tab-separated lines with a header."""
    tsv.write_tsv(df.selectExpr(*columns.split(";")), path)
    return path


@query("code long, source long, entity_id string, name string, address string, country string", "select 1000000000 + s_suppkey as code, 1 as source, 'S1-' || s_suppkey as entity_id, s_name as name, '' as address, cast(s_nationkey as varchar) as country from supplier union all select 2000000000 + c_custkey, 2, 'S2-' || c_custkey, c_name, c_mktsegment, cast(c_nationkey as varchar) from customer union all select 3000000000 + p_partkey, 3, 'S3-' || p_partkey, p_name, p_brand || ' ' || p_type, 'none' from part")
def source_records(spark, sf_dir):
    """Three source files, written as lines and read again."""
    path = scratch_path(spark, "sources")
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    _lines(t("supplier"), f"{path}/all_source1.tsv", "concat('S1-', s_suppkey) as entity_id;s_name as name;'' as address;cast(s_nationkey as string) as country")
    _lines(t("customer"), f"{path}/all_source2.tsv", "concat('S2-', c_custkey) as entity_id;c_name as name;c_mktsegment as address;cast(c_nationkey as string) as country")
    _lines(t("part"), f"{path}/all_source3.tsv", "concat('S3-', p_partkey) as entity_id;p_name as name;concat(p_brand, ' ', p_type) as address;'none' as country")
    return tsv.read_sources(spark, path, "all")


@query("s1 long, cand long", "select 1000000000 + c_nationkey as s1, 2000000000 + c_custkey as cand from customer")
def link_lists(spark, sf_dir):
    """Lists of customers by nation as a ground-truth file, read as links."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("1000000000L + c_nationkey as s1", "2000000000L + c_custkey as cand")
    path = scratch_path(spark, "links")
    tsv.write_tsv(tsv.matching_lists(c.select("s1").distinct(), c), path)
    return tsv.read_links(spark, path)[0]


@query("entity_id string", "select distinct 'S2-' || c_custkey as entity_id from customer")
def id_set(spark, sf_dir):
    path = scratch_path(spark, "ids")
    _lines(spark.read.parquet(f"{sf_dir}/customer.parquet"), path, "concat(' S2-', c_custkey, ' ') as entity_id;c_name as name;'' as address;'' as country")
    return tsv.read_ids(spark, path)


@query("variant string, canonical string, score double, count long", "select lower(p_name) as variant, min(p_brand) as canonical, 0.5 as score, 7 as count from part group by 1")
def alias_file(spark, sf_dir):
    """A lexicon written as lines and read again."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.lower("p_name").alias("variant")).agg(F.min("p_brand").alias("canonical"))
    path = scratch_path(spark, "aliases")
    part.select(F.concat_ws("\t", "variant", "canonical", F.lit("0.5"), F.lit("7"))).write.text(path)
    return tsv.read_aliases(spark, path)


@query(_TABLE, f"with {duck.pairs()} select * from pairs")
def pair_sidecar(spark, sf_dir):
    """The candidate table, written as a sidecar and read again with its contention."""
    p = _pairs(spark, sf_dir)
    path = scratch_path(spark, "run.tsv")
    pair_files.save_pairs(p, blocking.contention(p), path)
    pairs, meta = pair_files.load_pairs(spark, path)
    return pairs.join(meta.select("cand"), "cand", "left_semi")


@query("code long, toks string", f"with {duck.VIEWS} select code, {_D.sorted_set(duck.ALL_TOKENS)} as toks from v")
def token_cache(spark, sf_dir):
    path = scratch_path(spark, "cache")
    pair_files.save_tokens(blocking.channel_tokens(_views(spark, sf_dir), "all"), path)
    return pair_files.load_tokens(spark, path).select("code", _set(F.col("toks")).alias("toks"))


@query("s1 long, cand long, part long", f"{_ALL} select s1, cand, case when s1 % 4 = 0 then 2 else 1 end as part from pairs where s1 % 4 <> 0 or s1 % 8 = 0")
def manifest_files(spark, sf_dir):
    """Two matrices with manifests; the second names every fourth entity and has rows of every eighth alone."""
    p = staged(_pairs(spark, sf_dir).select("country", "s1", "cand"))
    e = _entities(spark, sf_dir)
    paths = [scratch_path(spark, f"part{i}") for i in (1, 2)]
    pair_files.save_matrix(p.withColumn("part", F.lit(1)), e, ["part"], paths[0])
    pair_files.save_matrix(p.where("s1 % 8 = 0").withColumn("part", F.lit(2)), e.where("s1 % 4 = 0"), ["part"], paths[1])
    return pair_files.load_latest(spark, paths)


@query("variant string, canonical string, score double, count long")
def alias_bootstrap(spark, sf_dir):
    """Aliases mined from confident links of unlabelled data, added to a base lexicon."""
    sure = _decided(spark, sf_dir).where("p >= 0.7").select("s1", "cand")
    seqs = _records(spark, sf_dir).select("code", "source", text.name_tokens(F.col("name")).alias("name_seq"), text.tokens(F.col("address")).alias("addr_seq"))
    return aliases.merge(_lexicons(spark)[0], aliases.mine(seqs.where("source = 1"), sure, seqs, latin_factor=1, min_count=2))


@query("cand long, t_best double, t_claims long", f"with {duck.pairs()}, {duck.CONTENTION} select cand, t_best, t_claims from meta")
def stream_contention(spark, sf_dir):
    return incremental.contention_of_stream(_pairs(spark, sf_dir))


@query("s1 long, cand long, shared long, score double", f"with {duck.VIEWS}, {duck.channel('a', duck.ALL_TOKENS, 50)} select s1, cand, count(*) as shared, round(sum(w), 6) as score from q_a join w_a using (country, token) join t_a using (country, token) group by 1, 2 having count(*) >= 2")
def stream_candidates(spark, sf_dir):
    """Entities arrive as a stream of files and meet the standing postings."""
    c = _kept(spark, sf_dir, "all_tokens", lambda: blocking.channel_tokens(_views(spark, sf_dir), "all"))
    w = staged(blocking.weighted(blocking.token_weights(c)))
    path = scratch_path(spark, "arriving")
    c.where("source = 1").select(F.col("code").alias("s1"), "country", "toks").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("s1 long, country string, toks array<string>").option("maxFilesPerTrigger", 64).parquet(f"{path}/in")
    return incremental.candidates_into(stream, staged(blocking.postings(c, False)), w, path).where("shared >= 2")
