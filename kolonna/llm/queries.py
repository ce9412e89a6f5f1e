"""Queries of this subpackage's operators over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kolonna.llm import distinct, leaks, overlaps, packing, percentiles, spans
from kolonna.plans.registry import Registry, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

NAMED = "site_id <> '' and date <> ''"


# --- percentiles -------------------------------------------------------------------------------------------------------


def site_date_sketches(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.percentile_sketches(table(spark, folder, "pix"), ["site_id", "date"], "amount")


@query(f"""
    select site_id, date from pix where {NAMED} group by site_id, date
    having count(amount) >= 30 and quantile_disc(amount, 0.9) >= 8 * quantile_disc(amount, 0.5)""")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = percentiles.sketch_percentiles(site_date_sketches(spark, folder), {"p50": 0.5, "p90": 0.9})
    return found.where(f"{NAMED} and n >= 30 and p90 >= 8 * p50").select("site_id", "date")


@query()
def p1_site_date_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.sketch_percentiles(site_date_sketches(spark, folder), {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99})


@query()
def p1_site_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Sites put together from the sketches of their days."""
    whole = percentiles.merge_sketches(site_date_sketches(spark, folder), ["site_id"])
    return percentiles.sketch_percentiles(whole, {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99})


@query()
def p1_date_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Days put together from the sketches of their sites."""
    whole = percentiles.merge_sketches(site_date_sketches(spark, folder), ["date"])
    return percentiles.sketch_percentiles(whole, {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99})


SHARES = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}


@query(" union all ".join(f"""
    select {by} as grouping, {site} as site_id, {date} as date, count(amount) as n, min(amount) as least, max(amount) as most, true as near from pix group by all""" for by, site, date in (("'site_date'", "site_id", "date"), ("'site'", "site_id", "null"), ("'date'", "null", "date"))))
def p1_rank_errors(spark: SparkSession, folder: str) -> DataFrame:
    """The percentiles of sites, dates and both, held against the rows: do their ranks lie within three times the bound of those asked?

    A group of up to k values is exact. Next to it the number, the least and the greatest of the values.
    """
    rows, fine, parts = table(spark, folder, "pix"), site_date_sketches(spark, folder), []
    for name, keys in (("site_date", ["site_id", "date"]), ("site", ["site_id"]), ("date", ["date"])):
        states = fine if len(keys) == 2 else percentiles.merge_sketches(fine, keys)
        asked = percentiles.sketch_percentiles(states, SHARES | {"least": 0.0, "most": 1.0})
        values = rows.select(*[F.col(k).alias(f"of_{k}") for k in keys], "amount")
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"of_{k}"))
        ranks = [f(F.when(c, 1)).alias(f"{p}_{end}") for p in SHARES for f, c, end in ((F.count, F.col("amount") < F.col(p), "below"), (F.count, F.col("amount") <= F.col(p), "upto"))]
        found = asked.join(values, on).groupBy(*keys, "n", "least", "most").agg(*ranks)
        near = F.lit(True)
        for p, q in SHARES.items():
            rank = F.greatest(F.lit(1.0), F.ceil(F.round(F.lit(q) * F.col("n"), 6)).cast("double"))
            off = F.when(F.col("n") > percentiles.K, F.col("n") * (3 * 1.7 / percentiles.K)).otherwise(0.0)
            near = near & ((F.col("n") == 0) | ((F.col(f"{p}_below") < rank + off) & (F.col(f"{p}_upto") >= rank - off)))
        shown = [F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in ("site_id", "date")]
        parts.append(found.select(F.lit(name).alias("grouping"), *shown, "n", "least", "most", near.alias("near")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- distinct counts ---------------------------------------------------------------------------------------------------


def site_date_bitmaps(spark: SparkSession, folder: str) -> DataFrame:
    return distinct.distinct_bitmaps(table(spark, folder, "impressions"), ["site_id", "date"], "ad_id")


@query(f"""
    select site_id, date from impressions where {NAMED} group by site_id, date
    having count(ad_id) >= 30 and count(distinct ad_id) >= 0.6 * count(ad_id)""")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = distinct.distinct_estimates(site_date_bitmaps(spark, folder))
    return found.where(f"{NAMED} and n_rows >= 30 and n_distinct >= 0.6 * n_rows").select("site_id", "date")


@query()
def p2_distinct_cube(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct ads of each (site, date), site, date and of everything, all from the same partial results."""
    sets = [["site_id", "date"], ["site_id"], ["date"], []]
    return distinct.distinct_estimates(distinct.merge_bitmaps_cube(site_date_bitmaps(spark, folder), ["site_id", "date"], sets))


@query("""
    select grouping(site_id, date) as grouping_id, site_id, date, count(ad_id) as n_rows, count(distinct ad_id) as exact, true as near from impressions group by grouping sets ((site_id, date), (site_id), (date), ())""")
def p2_cube_errors(spark: SparkSession, folder: str) -> DataFrame:
    """The estimates of all groupings next to exact counts: within four standard errors (or one)."""
    keys = ["site_id", "date"]
    found = p2_distinct_cube(spark, folder).select("site_id", "date", "grouping_id", "n_rows", "n_distinct")
    rows = table(spark, folder, "impressions").select(*keys, "ad_id").distinct()
    exact = rows.groupingSets([[F.col("site_id"), F.col("date")], [F.col("site_id")], [F.col("date")], []], "site_id", "date").agg(F.grouping_id().alias("grouping_id"), F.count_distinct("ad_id").alias("exact"))
    joined = found.join(exact.withColumnsRenamed({k: f"of_{k}" for k in (*keys, "grouping_id")}), F.expr("grouping_id = of_grouping_id and site_id <=> of_site_id and date <=> of_date"))
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), 4 * distinct.error_bound() * F.col("exact"))
    return joined.select("grouping_id", *keys, "n_rows", "exact", near.alias("near"))


# --- overlaps ----------------------------------------------------------------------------------------------------------

AUDIENCE = "site_id <> '' and token <> '' and token <> '0000000000000000'"
PAIRS = f"""
    with a as (select distinct site_id, token from (select site_id, token from impressions union all select site_id, token from pix) where {AUDIENCE}),
    n as (select site_id, count(*) as n from a group by site_id having count(*) >= 40),
    b as (select site_id, token, n from a join n using (site_id)),
    p as (select x.site_id as site_id_a, y.site_id as site_id_b, x.n as size_a, y.n as size_b, count(*) as shared from b x join b y on x.token = y.token and x.site_id < y.site_id group by all)
    select {{}} from p where shared >= 0.25 * (size_a + size_b - shared)"""


def audience(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "impressions").select("site_id", "token").unionByName(table(spark, folder, "pix").select("site_id", "token")).where(AUDIENCE)


def audience_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return overlaps.set_overlaps(audience(spark, folder), "site_id", "token", 0.25, 40).withColumnsRenamed({"set_a": "site_id_a", "set_b": "site_id_b"})


@query(PAIRS.format("site_id_a, site_id_b"))
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return audience_overlaps(spark, folder).select("site_id_a", "site_id_b")


@query(PAIRS.format("*"))
def p4_overlap_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return audience_overlaps(spark, folder)


@query(f"""
    with a as (select distinct site_id, token from (select site_id, token from impressions union all select site_id, token from pix) where {AUDIENCE}),
    b as (select site_id, token, count(*) over (partition by site_id) as n from a)
    select x.site_id as site_id_a, y.site_id as site_id_b, x.n as size_a, y.n as size_b, count(*) as shared from b x join b y on x.token = y.token and x.site_id < y.site_id group by all""")
def p4_all_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of sites that share a token, however few and however small the sites."""
    return overlaps.all_overlaps(audience(spark, folder), "site_id", "token").withColumnsRenamed({"set_a": "site_id_a", "set_b": "site_id_b"})


@query(f"""
    with i as (select distinct site_id, token from impressions where {AUDIENCE}), p as (select distinct site_id, token from pix where {AUDIENCE}),
    s as (select site_id from i union select site_id from p), b as (select site_id, count(*) as n from i join p using (site_id, token) group by site_id)
    select site_id, coalesce(n, 0) as shared from s left join b using (site_id)""")
def p4_site_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Of each site, how many visitors of its impressions are among those of its pixels: pairs that are given."""
    parts = [table(spark, folder, t).where(AUDIENCE).select("site_id", F.concat(F.lit(f"{t} "), "site_id").alias("set"), "token") for t in ("impressions", "pix")]
    both = parts[0].unionByName(parts[1])
    sites = both.select("site_id").distinct()
    pairs = sites.select(F.concat(F.lit("impressions "), "site_id").alias("a"), F.concat(F.lit("pix "), "site_id").alias("b"))
    counted = overlaps.given_overlaps(both, "set", "token", pairs)
    return counted.select(F.expr("substring(set_a, 13)").alias("site_id"), "shared")


# --- containers --------------------------------------------------------------------------------------------------------

CAPACITY, TOKENS = 6000, 2048


@query(f"select doc_id from documents where octet_length(encode(text)) > {CAPACITY}")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), CAPACITY, packing.byte_counter)
    return packed.where(f"piece = 0 and doc_size > {CAPACITY}").select("doc_id")


def token_containers(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    counter = packing.bpe_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(table(spark, folder, "documents"), TOKENS, counter)


@query()
def p6_token_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every text, in tokens of a public tokenizer, and its container."""
    return token_containers(spark, folder)


@query()
def p6_token_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full each container is."""
    return packing.container_fill(token_containers(spark, folder), TOKENS)


@query(f"""
    with d as (select doc_id, octet_length(encode(coalesce(text, ''))) as doc_size from documents)
    select doc_id, doc_size, doc_size as covered, cast(greatest(1, ceil(doc_size / {CAPACITY}.0)) as bigint) as pieces, greatest(0, least(doc_size, {CAPACITY})) as longest from d""")
def p6_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """What the containers hold of each text: all of it, in one piece unless it is longer than a container."""
    packed = packing.pack(table(spark, folder, "documents"), CAPACITY, packing.byte_counter)
    size = F.col("end") - F.col("start")
    return packed.groupBy("doc_id", "doc_size").agg(F.sum(size).alias("covered"), F.count_distinct("piece").alias("pieces"), F.max(size).alias("longest"))


# --- leaked evaluation passages ----------------------------------------------------------------------------------------

PLAIN = "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
LEAKS = f"""
    with w as (select item_id, string_split({PLAIN}, ' ') as w from eval_items),
    g as (select item_id, w, unnest(range(1, len(w) - 10)) as i from w),
    grams as (select distinct item_id, ' ' || array_to_string(w[i:i + 11], ' ') || ' ' as gram from g),
    d as (select doc_id, ' ' || {PLAIN} || ' ' as t from documents),
    leaks as (select distinct doc_id, item_id from d join grams on contains(t, gram))"""


def leaked(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@query(f"{LEAKS} select * from leaks")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(spark, folder).select("doc_id", "item_id")


@query(f"""
    with d as (select doc_id, string_split({PLAIN}, ' ') as w from documents), x as (select item_id, string_split({PLAIN}, ' ') as w from eval_items),
    dg as (select doc_id, i - 1 as dp, array_to_string(w[i:i + 11], ' ') as gram from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d)),
    xg as (select item_id, i - 1 as ip, array_to_string(w[i:i + 11], ' ') as gram from (select item_id, w, unnest(range(1, len(w) - 10)) as i from x)),
    h as (select doc_id, item_id, dp, ip, dp - ip as diagonal, dp - row_number() over (partition by doc_id, item_id, dp - ip order by dp) as run from dg join xg using (gram)),
    m as (select doc_id, item_id, cast(count(*) + 11 as integer) as matched_words, min(dp) as doc_word, min(ip) as item_word from h group by doc_id, item_id, diagonal, run)
    select * from m qualify row_number() over (partition by doc_id, item_id order by matched_words desc, doc_word, item_word) = 1""")
def p7_longest_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The longest verbatim match of each affected document and item, and where it begins."""
    return leaked(spark, folder)


@query(f"{LEAKS} select doc_id, lang, source, n_chars from documents where doc_id not in (select doc_id from leaks)")
def p7_clean_documents(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of the corpus once every affected document is removed."""
    return leaks.without_leaks(table(spark, folder, "documents"), leaked(spark, folder)).select("doc_id", "lang", "source", "n_chars")


# --- shared spans ------------------------------------------------------------------------------------------------------

WINDOWS = """
    with s as (select doc_id, text, unnest(range(1, length(text) - 298)) as i from documents where length(text) >= 300),
    w as (select doc_id, i, hash(substr(text, i, 300)) as h from s),
    d as (select distinct doc_id, h from w),
    many as (select h from d group by h having count(*) > 1)"""


def windows(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_windows(table(spark, folder, "documents"))


@query(f"""{WINDOWS}, m as (select d.* from d join many using (h))
    select distinct x.doc_id as doc_id_a, y.doc_id as doc_id_b from m x join m y on x.h = y.h and x.doc_id < y.doc_id""")
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_pairs(windows(spark, folder))


@query(f"""{WINDOWS}, sets as (select distinct docs from (select h, list(doc_id order by doc_id) as docs from d where h in (select h from many) group by h))
    select doc_id, first_doc, docs, count(*) as classes from (select unnest(docs) as doc_id, docs[1] as first_doc, cast(len(docs) as bigint) as docs from sets) group by all""")
def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with the classes it is in: the sets of documents that have a span in common, without making pairs."""
    return spans.shared_classes(windows(spark, folder))


@query(f"""{WINDOWS}, p as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from w where h in (select h from many)),
    c as (select doc_id, sum(least(300, coalesce(i - before, 300))) as n, count(*) filter (before is null or i - before > 300) as stretches from p group by doc_id)
    select doc_id, length(text) as chars, cast(coalesce(n, 0) as bigint) as shared_chars, coalesce(stretches, 0) as stretches, case when length(text) > 0 then coalesce(n, 0) / length(text) else 0.0 end as share
    from documents left join c using (doc_id)""")
def p8_shared_share(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each document also stands elsewhere."""
    return spans.shared_shares(table(spark, folder, "documents"), windows(spark, folder))


@query(f"""{WINDOWS}, p as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from w where h in (select h from many)),
    g as (select doc_id, i, sum(case when before is null or i - before > 300 then 1 else 0 end) over (partition by doc_id order by i) as g from p)
    select doc_id, min(i) - 1 as start, max(i) + 299 as "end" from g group by doc_id, g""")
def p8_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """The stretches of each document that also stand elsewhere."""
    return spans.shared_stretches(windows(spark, folder))
