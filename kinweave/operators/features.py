"""Features of candidate pairs. All but the fuzzy ratios and what builds on them are built-in functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinweave.functions import fuzzy, packed, text

CONTEXT = ("block_score", "n_shared", "rank", "score_ratio_top", "score_gap_next", "n_candidates", "is_s3", "target_best_ratio", "target_n_claims", "rev_rank", "target_margin", "name_block_score", "name_block_shared", "name_block_rank", "name_block_ratio_top")
LIST = ("p1", "p1_rank", "p1_gap", "ent_pmax", "ent_p2nd", "ent_psum", "ent_n50", "ent_n", "best_in_source")
COHERENCE = ("coh_n_strong", "coh_name_max", "coh_name_tri_pw", "coh_addr_max", "coh_numconf_frac", "coh_support", "coh_top_name")
JOINT = ("joint_max", "joint_support_p", "joint_no_addr")
STRONG_P, MAX_STRONG, MIN_P = 0.3, 8, 0.02
EPS = 1e-4
#: Records of a block, and letters of a block, about; a task has two blocks packed in memory and one view of them unpacked.
CHUNK, LETTERS = 1 << 15, 1 << 26
#: What s1 and cand are in a candidate table.
ENTITY_TARGET = ("source = 1", "source > 1")
FUZZY = {"ratio": lambda pairs: [fuzzy.ratio(*p) for p in pairs], "token_set": lambda pairs: [fuzzy.token_set_ratio(*p) for p in pairs], "partial": fuzzy.partial_ratios}


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _some(c: Column) -> Column:
    return F.size(c) > 0


def _disjoint(a: Column, b: Column) -> Column:
    return _flag(_some(a) & _some(b) & (F.size(F.array_intersect(a, b)) == 0))


def context(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    """CONTEXT for every pair of a candidate table; meta: blocking.contention() of all pairs."""
    own = W.partitionBy("s1")
    p = pairs.join(meta, "cand")
    p = p.withColumn("top", F.max("score").over(own)).withColumn("ntop", F.max("nscore").over(own)).withColumn("size", F.count("*").over(own))
    p = p.withColumn("next", F.coalesce(F.lead("score").over(own.orderBy("rank")), F.lit(0.0)))
    p = p.withColumn("rev", F.when(F.col("score") >= F.col("t_best") - EPS, 0).when(F.col("score") >= F.col("t_second") - EPS, 1).otherwise(2))
    other = F.when(F.col("rev") == 0, F.col("t_second")).otherwise(F.col("t_best"))
    floor = lambda c: F.greatest(c, F.lit(1e-6))
    return p.select(
        "country", "s1", "cand", F.col("score").alias("block_score"), F.col("shared").alias("n_shared"), "rank",
        (F.col("score") / floor(F.col("top"))).alias("score_ratio_top"), (F.col("score") - F.col("next")).alias("score_gap_next"), F.col("size").alias("n_candidates"),
        _flag(F.col("cand") >= 3 * text.CODE).alias("is_s3"), (F.col("score") / floor(F.col("t_best"))).alias("target_best_ratio"), F.col("t_claims").alias("target_n_claims"),
        F.col("rev").alias("rev_rank"), F.least(F.col("score") / floor(other), F.lit(10.0)).alias("target_margin"),
        F.col("nscore").alias("name_block_score"), F.col("nshared").alias("name_block_shared"), F.col("nrank").alias("name_block_rank"),
        (F.col("nscore") / floor(F.col("ntop"))).alias("name_block_ratio_top"),
    )


def compared(pairs: DataFrame, views: DataFrame, sets: tuple[str, ...] = (), values: tuple[str, ...] = (), ratios: tuple[tuple[str, str, str], ...] = (), sides: tuple[str, str] = ENTITY_TARGET, notes: DataFrame | None = None) -> DataFrame:
    """pairs (s1, cand, and country if records of one country alone are asked for) beside both records' views.

    values: views that come along as a_ and b_; sets: views of distinct elements, of which come the sizes a_n_ and b_n_ and
    the number n_ of shared elements; ratios: (name, view, FUZZY's function). sides: the records that s1 and cand may be.
    notes: source, country, code, key and a column more, which comes along as a_ and b_ for the records whose views have
    that code and key, and is null for others; rows of one code and key are alike.

    Records of a country are dealt into blocks and packed, and a task compares the pairs of two blocks: what is stored is
    the packed records, once for each block of the other side, and never a record's views for each of its pairs.
    """
    land = F.col("country") if "country" in pairs.columns else F.lit("")
    noted = {} if notes is None else {f.name: to_arrow_type(f.dataType) for f in notes.schema if f.name not in ("source", "country", "code", "key")}
    columns = list(dict.fromkeys([*sets, *values, *[c for _, c, _ in ratios], *["key"] * bool(noted)]))
    own = F.explode(F.array_compact(F.array(F.when(F.expr(sides[0]), True), F.when(F.expr(sides[1]), False))))
    size = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(F.length("name") + F.length("address")) / LETTERS)).cast("int")
    sizes = views.where("code is not null").select(land.alias("land"), own.alias("own"), "name", "address").groupBy("land", "own").agg(size.alias("parts"))
    parts = lambda x: F.coalesce(F.max(F.when(F.col("own") == x, F.col("parts"))), F.lit(1))
    # countries of one block need no row here, so there are as many as blocks at most
    blocks = F.broadcast(sizes.groupBy("land").agg(parts(True).alias("lows"), parts(False).alias("highs")).where("lows > 1 or highs > 1"))
    lows, highs = F.coalesce("lows", F.lit(1)), F.coalesce("highs", F.lit(1))
    dealt = lambda key, n: F.pmod(F.xxhash64(F.col(key).cast("long")), n).cast("int")

    def packs(rows: DataFrame, note: bool, columns: list[str]) -> DataFrame:
        """rows packed, once for each block of the other side."""
        rows = rows.where("code is not null").select(land.alias("land"), own.alias("own"), F.col("code").cast("long").alias("code"), *columns).join(blocks, "land", "left")
        rows = rows.select("land", "own", dealt("code", F.when(F.col("own"), lows).otherwise(highs)).alias("block"), F.when(F.col("own"), highs).otherwise(lows).alias("others"), "code", *columns)
        out = rows.mapInArrow(packed.packer(["land", "own", "block", "others"]), "land string, own boolean, block int, others int, payload binary")
        out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        low, high = F.when(F.col("own"), F.col("block")).otherwise(F.col("other")), F.when(F.col("own"), F.col("other")).otherwise(F.col("block"))
        none = F.lit(None).cast("long")
        return out.select("land", low.alias("low"), high.alias("high"), "own", F.lit(note).alias("note"), none.alias("s1"), none.alias("cand"), "payload")

    given = packs(views, False, columns)
    if notes is not None:
        given = given.unionByName(packs(notes, True, ["key", *noted]))
    asked = pairs.select(land.alias("land"), F.col("s1").cast("long"), F.col("cand").cast("long")).where("s1 is not null and cand is not null").join(blocks, "land", "left")
    asked = asked.select("land", dealt("s1", lows).alias("low"), dealt("cand", highs).alias("high"), F.lit(None).cast("boolean").alias("own"), F.lit(False).alias("note"), "s1", "cand", F.lit(None).cast("binary").alias("payload"))

    counts = [f"{n}_{s} int" for s in sets for n in ("a_n", "b_n", "n")]
    kept = [f"{side}_{c} {(notes if c in noted else views).schema[c].dataType.simpleString()}" for c in [*values, *noted] for side in "ab"]
    schema = ", ".join([*["country string"] * ("country" in pairs.columns), "s1 long, cand long", *counts, *kept, *[f"{n} double" for n, _, _ in ratios]])
    asks = [(n, c, FUZZY[f]) for n, c, f in ratios]

    def search(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, packs = [], {(own, note): [] for own in (True, False) for note in (True, False)}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rows.append(t.filter(pa.compute.is_null(t.column("own"))).select(["s1", "cand"]))
            for (own, note), payloads in packs.items():
                payloads += list(t.filter(pa.compute.and_(pa.compute.equal(t.column("own"), own), pa.compute.equal(t.column("note"), note))).column("payload"))
        rows = pa.concat_tables(rows)
        if len(rows) and packs[True, False] and packs[False, False]:
            a, b = (packed.Side(packs[own, False], packs[own, True], noted) for own in (True, False))
            for out in packed.compare(rows, a, b, list(sets), [*values, *noted], asks):
                if schema.startswith("country"):
                    out.insert(0, ("country", pa.array([key[0].as_py()] * len(out[0][1]), pa.string())))
                yield pa.RecordBatch.from_arrays([x for _, x in out], names=[n for n, _ in out])

    return given.unionByName(asked).groupBy("land", "low", "high").applyInArrow(search, schema)


def with_views(pairs: DataFrame, views: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """pairs with the named views of the entity (a_) and of the candidate (b_)."""
    return compared(pairs, views, values=columns)


def _ab(c: str) -> tuple[Column, Column]:
    return F.col(f"a_{c}"), F.col(f"b_{c}")


TEXT_SETS = ("core", "ntok", "ntri", "skel", "atok", "atri", "num", "askel")
TEXT_RATIOS = (("name_ratio", "nstr", "ratio"), ("name_token_set", "nstr", "token_set"), ("name_partial", "nstr", "partial"), ("name_skel_ratio", "skstr", "ratio"), ("name_compact_partial", "compact", "partial"), ("addr_token_set", "astr", "token_set"))


def _counts(s: str) -> tuple[Column, Column, Column]:
    return F.col(f"a_n_{s}"), F.col(f"b_n_{s}"), F.col(f"n_{s}")


def _jaccard(s: str) -> Column:
    a, b, both = _counts(s)
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(both / (a + b - both))


def _containment(s: str) -> Column:
    a, b, both = _counts(s)
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(both / F.least(a, b))


def _apart(s: str) -> Column:
    a, b, both = _counts(s)
    return _flag((a > 0) & (b > 0) & (both == 0))


def text_sets(pairs: DataFrame, views: DataFrame, fuzzy_too: bool = False) -> DataFrame:
    """The 26 text features that are set arithmetic; with fuzzy_too, the six fuzzy ones beside them."""
    v = views.withColumn("letters", F.length("name")).withColumn("first", text.initials(F.col("core")))
    viewed = compared(pairs, v.withColumn("no_skel", F.col("skstr") == "").withColumn("no_compact", F.col("compact") == ""), TEXT_SETS, ("letters", "script", "first", *["no_skel", "no_compact"] * fuzzy_too), TEXT_RATIOS * fuzzy_too)
    name_cont, addr_cont = _containment("core"), _containment("atok")
    (ca, cb, core), (ta, tb, _) = _counts("core"), _counts("atok")
    (la, lb), (sa, sb), (ia, ib) = _ab("letters"), _ab("script"), _ab("first")
    return viewed.select(
        "s1", "cand",
        _jaccard("core").alias("name_core_jacc"), name_cont.alias("name_core_cont"), _jaccard("ntok").alias("name_all_jacc"), _jaccard("ntri").alias("name_tri_jacc"),
        _flag((ca > 0) & (core == ca) & (core == cb)).alias("name_sorted_eq"), _flag((ca > 0) & (cb > 0) & (ia == ib)).alias("name_initials_eq"),
        (F.least(la, lb) / F.greatest(la, lb, F.lit(1))).alias("name_len_ratio"), core.alias("name_core_shared"),
        _jaccard("skel").alias("name_skel_jacc"), _containment("skel").alias("name_skel_cont"),
        _jaccard("atok").alias("addr_jacc"), addr_cont.alias("addr_cont"), _jaccard("atri").alias("addr_tri_jacc"),
        _containment("num").alias("addr_num_cont"), _flag(F.col("n_num") > 0).alias("addr_num_any"), _containment("askel").alias("addr_skel_cont"),
        _apart("num").alias("num_conflict"), (cb - core).alias("extra_core"), (ca - core).alias("missing_core"),
        _apart("core").alias("core_disjoint"), _flag(tb == 0).alias("addr_empty_cand"), _flag(ta == 0).alias("addr_empty_s1"),
        _flag(sb == "indic").alias("cand_script_indic"), _flag((sa != sb) & (sa != "none") & (sb != "none")).alias("script_mismatch"),
        _flag((name_cont >= 0.8) & (addr_cont < 0.2)).alias("name_only_evidence"), _flag((addr_cont >= 0.8) & (name_cont < 0.2)).alias("addr_only_evidence"),
        *(_ratios() if fuzzy_too else []),
    )


def _ratios() -> list[Column]:
    """The six fuzzy features, 0 where a side has no skeleton or no letters left."""
    zero = lambda c, none: F.when(F.col(f"a_{none}") | F.col(f"b_{none}"), 0.0).otherwise(F.col(c)).alias(c)
    return [F.col("name_ratio"), F.col("name_token_set"), F.col("name_partial"), zero("name_skel_ratio", "no_skel"), zero("name_compact_partial", "no_compact"), F.col("addr_token_set")]


def text_fuzzy(pairs: DataFrame, views: DataFrame) -> DataFrame:
    """The six fuzzy text features."""
    v = views.withColumn("no_skel", F.col("skstr") == "").withColumn("no_compact", F.col("compact") == "")
    return compared(pairs, v, values=("no_skel", "no_compact"), ratios=TEXT_RATIOS).select("s1", "cand", *_ratios())


def list_features(scored: DataFrame) -> DataFrame:
    """LIST for pairs (s1, cand, p): places and sums within an entity's list of probabilities."""
    own = W.partitionBy("s1")
    order = own.orderBy(F.desc("p"), "cand")
    p = scored.withColumn("r", F.row_number().over(order)).withColumn("pmax", F.max("p").over(own)).withColumn("n", F.count("*").over(own))
    p = p.withColumn("p2", F.coalesce(F.max(F.when(F.col("r") == 2, F.col("p"))).over(own), F.lit(0.0)))
    first = F.row_number().over(W.partitionBy("s1", text.source_of(F.col("cand"))).orderBy(F.desc("p"), "cand")) == 1
    return p.select(
        "s1", "cand", F.col("p").alias("p1"), (F.col("r") - 1).alias("p1_rank"), (F.col("p") - F.when(F.col("r") == 1, F.col("p2")).otherwise(F.col("pmax"))).alias("p1_gap"),
        F.col("pmax").alias("ent_pmax"), F.col("p2").alias("ent_p2nd"), F.sum("p").over(own).alias("ent_psum"), F.sum((F.col("p") >= 0.5).cast("int")).over(own).alias("ent_n50"),
        F.col("n").alias("ent_n"), _flag(first).alias("best_in_source"),
    )


def supporters(scored: DataFrame) -> DataFrame:
    """s1, cand, p, other, q, pos, and country if it is there: each active candidate beside the entity's strong ones (MAX_STRONG at most)."""
    ranked = scored.withColumn("pos", F.row_number().over(W.partitionBy("s1").orderBy(F.desc("p"), "cand")) - 1)
    strong = ranked.where((F.col("pos") < MAX_STRONG) & (F.col("p") >= STRONG_P)).select("s1", F.col("cand").alias("other"), F.col("p").alias("q"), "pos")
    own = [c for c in ("country", "s1", "cand", "p") if c in scored.columns]
    return scored.where(F.col("p") >= MIN_P).select(*own).join(strong, "s1").where("cand != other")


def _supported(scored: DataFrame, views: DataFrame) -> DataFrame:
    """supporters() with the likeness of both records, which two records have once, however many entities list them."""
    pairs = supporters(scored).withColumn("low", F.least("cand", "other")).withColumn("high", F.greatest("cand", "other"))
    both = pairs.select(*[c for c in ("country", "low", "high") if c in pairs.columns]).distinct()
    ratios = (("name_sim", "nstr", "token_set"), ("addr_sim", "astr", "token_set"))
    like = compared(both.withColumnsRenamed({"low": "s1", "high": "cand"}), views.withColumn("addressed", F.size("atok") > 0), ("ntri", "num"), ("addressed",), ratios, ("source > 1", "source > 1"))
    like = like.select(F.col("s1").alias("low"), F.col("cand").alias("high"), "name_sim", "addr_sim", _jaccard("ntri").alias("tri"), _apart("num").alias("conflict"), (F.col("a_addressed") & F.col("b_addressed")).alias("addresses"))
    return pairs.join(like, ["low", "high"]).select("s1", "cand", "q", "pos", "name_sim", "addr_sim", "tri", "conflict", "addresses")


def coherence(scored: DataFrame, views: DataFrame) -> DataFrame:
    """COHERENCE for pairs (s1, cand, p): agreement with the entity's other strong candidates.

    Inactive pairs have -1 and zeros, active ones without others zeros.
    """
    sums = _supported(scored, views).groupBy("s1", "cand").agg(
        F.count("*").alias("coh_n_strong"), F.max("name_sim").alias("coh_name_max"), (F.sum(F.col("tri") * F.col("q")) / F.sum("q")).alias("coh_name_tri_pw"), F.max("addr_sim").alias("coh_addr_max"),
        F.avg("conflict").alias("coh_numconf_frac"), F.sum(((F.col("name_sim") >= 0.8) & (F.col("q") >= 0.5)).cast("int")).alias("coh_support"), F.min_by("name_sim", "pos").alias("coh_top_name"),
    )
    out = scored.select("s1", "cand", "p").join(sums, ["s1", "cand"], "left")
    none = F.when(F.col("p") < MIN_P, -1.0).otherwise(0.0)
    return out.select("s1", "cand", *[F.coalesce(F.col(c).cast("double"), none if c == "coh_n_strong" else F.lit(0.0)).alias(c) for c in COHERENCE])


def joint(scored: DataFrame, views: DataFrame) -> DataFrame:
    """JOINT: the supporter that agrees best on name and address at once; an empty address is no evidence."""
    both = _supported(scored, views).where("addresses").withColumn("both", F.least("name_sim", "addr_sim"))
    best = both.groupBy("s1", "cand").agg(F.max("both").alias("best"), F.max_by("q", F.struct("both", -F.col("pos"))).alias("q"))
    out = scored.select("s1", "cand", "p").join(best, ["s1", "cand"], "left")
    idle = F.col("p") < MIN_P
    return out.select("s1", "cand", F.when(idle, -1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("joint_max"), F.when(F.col("best") > 0, F.col("q")).otherwise(0.0).alias("joint_support_p"), F.when(F.col("best").isNull(), 1.0).otherwise(0.0).alias("joint_no_addr"))


def _digit_runs(toks: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(toks, lambda t: F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0)))))


def _tolerant_set(runs: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(runs, text.tolerant)))


def number_evidence(viewed: DataFrame) -> DataFrame:
    """What the numbers of two addresses say, of pairs with the view `atok`; all 0 if an address is empty."""
    v = viewed
    for s in "ab":
        v = v.withColumn(f"{s}_runs", _digit_runs(F.col(f"{s}_atok"))).withColumn(f"{s}_tol", _tolerant_set(F.col(f"{s}_runs")))
        v = v.withColumn(f"{s}_bare", F.array_distinct(F.transform(f"{s}_runs", lambda t: F.ltrim(t, F.lit("0")))))
        v = v.withColumn(f"{s}_mixed", F.filter(f"{s}_atok", lambda t: t.rlike(r"\p{N}") & t.rlike(r"\p{L}")))
    only = lambda s, o: F.size(F.filter(f"{s}_runs", lambda t: ~F.arrays_overlap(text.tolerant(t), F.col(f"{o}_tol"))))
    v = v.withColumn("a_only", only("a", "b")).withColumn("b_only", only("b", "a"))
    known = _some(F.col("a_atok")) & _some(F.col("b_atok"))
    keep = lambda c, n: F.when(known, c.cast("double")).otherwise(0.0).alias(n)
    return v.select(
        "s1", "cand", keep(F.size(F.array_intersect("a_bare", "b_bare")), "num_exact_shared"), keep(F.col("a_only"), "num_a_only"), keep(F.col("b_only"), "num_b_only"),
        keep(_flag(F.arrays_overlap("a_tol", "b_tol") & (F.col("a_only") > 0) & (F.col("b_only") > 0)), "unit_conflict"),
        keep(_flag(F.arrays_overlap("a_mixed", "b_mixed")), "alnum_match"), keep(_disjoint(*_ab("mixed")), "alnum_conflict"),
    )


def core2(viewed: DataFrame) -> DataFrame:
    """Features of the names' tokens without legal suffixes, the suffixes taken out after aliases; view `ntok`."""
    v = viewed.select("s1", "cand", *[text.core_tokens(F.col(f"{s}_ntok")).alias(f"{s}_c2") for s in "ab"])
    a, b = _ab("c2")
    return v.select("s1", "cand", text.jaccard(a, b).alias("core2_jacc"), text.containment(a, b).alias("core2_cont"), F.size(F.array_except(b, a)).alias("core2_extra"), F.size(F.array_except(a, b)).alias("core2_missing"), _disjoint(a, b).alias("core2_disjoint"))


def name_counts(views: DataFrame) -> DataFrame:
    """country, name_key, n: how many entities have each sorted core name; empty names count for none."""
    key = text.sorted_set(F.col("core"))
    return views.where("source = 1").select("country", key.alias("name_key")).where("name_key != ''").groupBy("country", "name_key").agg(F.count("*").alias("n"))


def ambiguity(pairs: DataFrame, views: DataFrame, counts: DataFrame) -> DataFrame:
    """How common both names are and how the addresses cover each other; pairs with country; counts: name_counts().

    `num` has the numbers of `atok` without leading zeros, so a token that both have is in both `num` or in neither, and
    what isn't in `num` needs no set of its own.
    """
    key = text.sorted_set(F.col("core"))
    keys = views.select("source", "country", "code", key.alias("name_key"))
    # few entities share a name, so this is a row for a record; other records' names count for none
    known = keys.join(counts, ["country", "name_key"]).select("source", "country", "code", F.xxhash64("name_key").alias("key"), F.col("n").cast("long").alias("n")).distinct()
    views = views.withColumn("key", F.xxhash64(key)).withColumn("plain", F.array_intersect("atok", "num"))
    viewed = compared(pairs.select("country", "s1", "cand"), views, ("atok", "num", "plain"), notes=known)
    (la, lb, shared), (da, db, digits), (xa, xb, plain) = _counts("atok"), _counts("num"), _counts("plain")
    na, nb = (F.coalesce(c, F.lit(0)) for c in _ab("n"))
    return viewed.select(
        "s1", "cand", F.log1p(na).alias("s1_core_name_frequency"), F.log1p(nb).alias("cand_core_name_frequency"), (F.least(na, nb) / F.greatest(na, nb, F.lit(1))).alias("core_name_count_ratio"),
        la.alias("addr_tokens_s1"), lb.alias("addr_tokens_cand"), (shared / F.greatest(la, F.lit(1))).alias("addr_coverage_s1"), (shared / F.greatest(lb, F.lit(1))).alias("addr_coverage_cand"),
        (lb - shared).alias("addr_unshared_cand"), da.alias("addr_numbers_s1"), db.alias("addr_numbers_cand"), (db - digits).alias("addr_numbers_unshared_cand"),
        _flag((la > xa) & (lb > xb) & (shared == plain)).alias("addr_alpha_disjoint"),
    )


def ablated(features: DataFrame, columns: list[str]) -> DataFrame:
    """Named features at zero; an unknown name is an error."""
    if unknown := set(columns) - set(features.columns):
        raise ValueError(f"unknown features: {sorted(unknown)}")
    return features.withColumns({c: F.lit(0.0) for c in columns}) if columns else features


def projected(features: DataFrame, names: list[str]) -> DataFrame:
    """The keys and the named features in their order; a missing name is an error."""
    if missing := [c for c in names if c not in features.columns]:
        raise ValueError(f"missing features: {missing}")
    return features.select("s1", "cand", *names)
