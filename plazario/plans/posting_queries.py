"""Registered queries over postings and companies, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plazario.common import spread, table
from plazario.functions import dates, posting, text, urls
from plazario.operators import companies, dedupe, labels
from plazario.operators.rules import any_hit
from plazario.plans import pipeline
from plazario.sources import pages, store

TODAY = "2026-09-01"
BASE = "https://jobs.example"
QUERIES, SQL = {}, {}


def _today() -> F.Column:
    return F.lit(TODAY).cast("date")


def query(sql: str | None = None):
    """Register a function as a query, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- SQL fragments ---------------------------------------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def s_fold(x: str) -> str:
    source, target, many = text.fold_tables()
    for c, plain in many:
        x = f"replace({x}, {_q(c)}, {_q(plain)})"
    return f"lower(strip_accents(translate({x}, {_q(source)}, {_q(target)})))"


def s_basic(x: str) -> str:
    return f"trim(regexp_replace(replace({s_fold(x)}, '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def s_text(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({s_fold(x)}, '[^a-z0-9\\s\\-+/]', ' ', 'g'), '\\s+', ' ', 'g'))"


def s_title(x: str) -> str:
    out = f"regexp_replace({s_fold(x)}, '([a-z]{{3,}})\\s*/\\s*[ao]\\b', '\\1', 'g')"
    for noise in text.TITLE_NOISE:
        out = f"regexp_replace({out}, {_q(noise)}, ' ', 'g')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


def s_core(x: str) -> str:
    words = "[" + ", ".join(map(_q, text.LEVEL_WORDS)) + "]"
    return f"array_to_string(list_sort(list_filter(string_split({s_title(x)}, ' '), lambda w: length(w) > 1 and not list_contains({words}, w))), ' ')"


def s_company(x: str) -> str:
    alts = text._suffix_pattern(text.LEGAL_SUFFIXES)
    return f"case when regexp_matches({s_basic(x)}, '^(?:{alts})(?: (?:{alts}))*$') then {s_basic(x)} else regexp_replace({s_basic(x)}, '(?: (?:{alts}))+$', '') end"


def s_slug(x: str) -> str:
    return f"nullif(regexp_extract({x}, '/company/([^?#]*?)/*(?:[?#].*)?$', 1), '')"


def s_any(x: str, patterns: list[str]) -> str:
    """RE2 has no look-behind: the boundary is consumed instead."""
    p = "|".join(f"(?:{p})" for p in patterns).replace("(?<![a-z])", "(?:^|[^a-z])").replace("(?![a-z])", "(?:$|[^a-z])")
    return f"coalesce(regexp_matches({x}, {_q(p)}), false)"


def s_marks(x: str, marks: list[str]) -> str:
    return f"regexp_matches({x}, {_q('|'.join(marks))})"


def s_bucket(place: str, mode: str) -> str:
    p, m = f"coalesce({s_basic(place)}, '')", f"coalesce({s_basic(mode)}, '')"
    spain, remote = s_marks(p, posting.SPAIN_MARKS), f"({s_marks(p, posting.REMOTE_MARKS)} or {s_marks(m, posting.REMOTE_MARKS)})"
    return f"case when {s_marks(p, posting.MADRID_MARKS)} then 'MADRID' when {remote} and ({spain} or {p} = '') then 'REMOTE_ES' when {spain} then 'REST_ES' when {p} <> '' then 'OUTSIDE_ES' else 'UNKNOWN' end"


def s_level() -> str:
    cols = f"select job_id, coalesce(title_raw, '') as raw, coalesce({s_title('title_raw')}, '') as t, coalesce({s_text('description_text')}, '') as d, coalesce({s_fold('li_seniority_field')}, '') as f from postings"
    senior = f"({s_any('t', labels.SENIOR)} or {s_any('raw', labels.ROMAN)})"
    arms = [
        (f"not {s_any('t', labels.DESIGN)}", "NOT_DESIGN", 0.9), (s_any("t", labels.OTHER_DESIGN), "NOT_DESIGN", 0.9), (s_any("t", labels.LEAD), "LEAD", 0.95), (f"{senior} and {s_any('t', labels.JUNIOR)}", "SENIOR", 0.5),
        (senior, "SENIOR", 0.95), (s_any("t", labels.JUNIOR), "JUNIOR", 0.95), (s_any("d", labels.TEXT_SENIOR), "SENIOR", 0.8), (f"{s_any('d', labels.TEXT_JUNIOR)} or {s_any('f', labels.FIELD_JUNIOR)}", "JUNIOR_BY_DESC", 0.6),
        (s_any("d", labels.TEXT_MID), "MID", 0.7), (s_any("t", labels.WEAK_JUNIOR), "MID", 0.5),
    ]
    label = "case " + " ".join(f"when {c} then '{x}'" for c, x, _ in arms) + " else 'MID' end"
    sure = "case " + " ".join(f"when {c} then {v}" for c, _, v in arms) + " else 0.4 end"
    return f"select job_id, {label} as level, cast({sure} as double) as confidence from ({cols})"


_ORDER = "(posted_at is not null) desc, coalesce(posted_at, date '0001-01-01') desc, (source = 'session') desc, length(coalesce(description_text, '')) desc, seq asc"


def s_merge(key: str) -> str:
    return f"""with r as (select *, row_number() over (partition by {key} order by {_ORDER}) as rn from postings where trim({key}) <> '')
select {key}, max(case when rn = 1 then job_id end) as job_id, cast(sum(n_sightings) as bigint) as n_sightings, count(*) as n_rows from r group by {key}"""


# ---- normalisers -----------------------------------------------------------------------------------------------------------------


@query(f"select doc_id, {s_basic('text')} as norm from documents")
def norm_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.basic_norm("text").alias("norm"))


@query(f"select doc_id, {s_text('text')} as norm from documents")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_text("text").alias("norm"))


@query(f"select job_id, {s_fold('title_raw')} as folded from postings")
def accent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "postings").select("job_id", text.folded("title_raw").alias("folded"))


@query(f"select job_id, {s_title('title_raw')} as title_norm, {s_core('title_raw')} as title_core from postings")
def title_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "postings").select("job_id", text.normalize_title("title_raw").alias("title_norm"), text.title_core("title_raw").alias("title_core"))


@query(f"select distinct company_name_raw, {s_company('company_name_raw')} as norm from postings where company_name_raw is not null")
def company_suffix_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "postings", "company_name_raw").where("company_name_raw is not null").distinct()
    return names.select("company_name_raw", text.company_norm("company_name_raw").alias("norm"))


@query(f"select job_id, coalesce({s_slug('company_linkedin_url')}, nullif({s_company('company_name_raw')}, ''), lower(company_name_raw)) as company_key from postings")
def company_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "postings").select("job_id", posting.company_key("company_linkedin_url", "company_name_raw").alias("company_key"))


@query(
    f"select job_id, substr(sha1(concat_ws('|', coalesce(company_key, ''), coalesce({s_core('title_raw')}, ''), coalesce(location_bucket, ''))), 1, 16) as dedupe_key, "
    "length(coalesce(title_raw, '') || chr(10) || coalesce(description_text, '')) as haystack_chars from postings"
)
def dedupe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "postings")
    return p.select("job_id", posting.dedupe_key("company_key", "title_raw", "location_bucket").alias("dedupe_key"), F.length(posting.haystack("title_raw", "description_text")).cast("bigint").alias("haystack_chars"))


def _s_relative() -> str:
    t, unit, amount = "t", "regexp_extract(t, " + _q(dates.RELATIVE) + ", 2)", "cast(nullif(regexp_extract(t, " + _q(dates.RELATIVE) + ", 1), '') as double)"
    days = "case " + " ".join(f"when {unit} = '{u}' then round_even({amount} * {d} + {d / 2 if d >= 7 else 0}, 0)" for u, (d, _) in dates.UNITS.items()) + " end"
    sure = "case " + " ".join(f"when {unit} = '{u}' then {c}" for u, (_, c) in dates.UNITS.items()) + " else 0.5 end"
    now = f"regexp_matches({t}, {_q(dates.JUST_NOW)})"
    return (
        f"select job_id, cast(date '{TODAY}' - cast(case when {now} then 0 else {days} end as integer) as date) as posted_on, cast(case when t is null then 0.5 when {now} then 1.0 else {sure} end as double) as confidence "
        f"from (select job_id, {s_fold('posted_text')} as t from postings)"
    )


@query(_s_relative())
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    date, sure = dates.posted("t", F.lit(None).cast("string"), _today())
    return table(spark, sf_dir, "postings").select("job_id", text.folded("posted_text").alias("t")).select("job_id", date.alias("posted_on"), sure.alias("confidence"))


@query(f"select job_id, posted_at as exact, cast(date '{TODAY}' - posted_at as integer) as days from postings")
def iso_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.col("posted_at").cast("string")
    return table(spark, sf_dir, "postings").select("job_id", dates.iso_date(iso).alias("exact"), dates.days_since(dates.iso_date(iso), _today()).alias("days"))


@query(f"select job_id, {s_bucket('location_raw', 'workplace_type')} as bucket from postings")
def location_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "postings").select("job_id", posting.location_bucket("location_raw", "workplace_type").alias("bucket"))


@query(
    "with w as (select company_name_raw, list_filter(regexp_split_to_array(trim(company_name_raw), '\\s+'), lambda x: regexp_matches(x, '^[\\p{L}\\p{N}]')) as ws from (select distinct company_name_raw from deliveries where company_name_raw is not null)) "
    "select company_name_raw, upper(case when len(ws) = 0 then '?' when len(ws) = 1 then substr(ws[1], 1, 2) else substr(ws[1], 1, 1) || substr(ws[2], 1, 1) end) as monogram from w"
)
def monograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "deliveries", "company_name_raw").where("company_name_raw is not null").distinct()
    return names.select("company_name_raw", text.monogram("company_name_raw").alias("monogram"))


# ---- labels ----------------------------------------------------------------------------------------------------------------------


@query(s_level())
def seniority_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "postings", "job_id", "title_raw", "description_text", "li_seniority_field"))
    return labels.with_level(p, "title_raw", "description_text", "li_seniority_field").select("job_id", F.col("level.label").alias("level"), F.col("level.confidence").alias("confidence"))


def _s_role() -> str:
    base = "case " + " ".join(f"when {s_any('t', labels.ROLES[k])} then '{k}'" for k in ("UXUI", "PRODUCT", "UX", "UI")) + " else 'OTRO' end"
    ai = s_any("t", labels.ROLES["AI"])
    return f"select job_id, case when {ai} then 'AI' else {base} end as role, case when {ai} and {base} <> 'OTRO' then {base} end as second from (select job_id, coalesce({s_fold('title_raw')}, '') as t from postings)"


@query(_s_role())
def role_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "postings").select("job_id", labels.role(F.col("title_raw")).alias("r")).select("job_id", F.col("r.label").alias("role"), F.col("r.second").alias("second"))


@query(f"select level, count(*) as n from ({s_level()}) group by level")
def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seniority_labels(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"))


@query("select count(*) as seen, true as balanced, true as every_identifier_is_kept_or_merged from postings")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over the postings as single sightings: what came in against what its layers hold, and every identifier found again in them."""
    raw = table(spark, sf_dir, "postings").withColumns({"n_sightings": F.lit(1), "merged_ids": F.array().cast("array<string>")})
    run = pipeline.process(raw, _today())
    held = run.labelled.select(F.explode(F.array_append("merged_ids", F.col("job_id"))).alias("job_id")).distinct()
    lost = raw.where(F.trim("job_id") != "").select("job_id").distinct().join(held, "job_id", "left_anti").agg((F.count("*") == 0).alias("every_identifier_is_kept_or_merged"))
    return run.reconcile().select("seen", "balanced").join(lost)


@query(f"select job_id, len(list_distinct(list_filter([{', '.join(f'regexp_extract(t, {_q(p)})' for p in labels.AI_TEXT)}], lambda x: x <> ''))) as n_ai from (select job_id, coalesce({s_text('title_raw || chr(10) || description_text')}, {s_text('title_raw')}, {s_text('description_text')}, '') as t from postings)")
def ai_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "postings").select("job_id", labels.ai_mentions(F.col("title_raw"), F.col("description_text")).cast("bigint").alias("n_ai"))


def _s_hits(x: str, patterns: list[str]) -> str:
    """The first match of every pattern that matches; a boundary that is looked at is consumed and taken off."""

    def one(p: str) -> str:
        bounded = p.startswith("(?<![a-z])") or p.endswith("(?![a-z])")
        inner = p.removeprefix("(?<![a-z])").removesuffix("(?![a-z])")
        before, after = ("(?:^|[^a-z])" if p.startswith("(?<![a-z])") else ""), ("(?:$|[^a-z])" if p.endswith("(?![a-z])") else "")
        return f"trim(regexp_extract({x}, {_q(f'{before}({inner}){after}' if bounded else f'({inner})')}, 1))"

    return f"list_filter([{', '.join(map(one, patterns))}], lambda h: h <> '')"


@query(f"select job_id, case when t is not null then list_concat(list_concat({_s_hits('t', labels.LEAD)}, {_s_hits('t', labels.SENIOR)}), {_s_hits('t', labels.JUNIOR)}) end as hits from (select job_id, {s_title('title_raw')} as t from postings)")
def level_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "postings").select("job_id", labels.level_hits(F.col("title_raw")).alias("hits"))


# ---- merging ---------------------------------------------------------------------------------------------------------------------


def _merged(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    p = table(spark, sf_dir, "postings").withColumn("n_rows", F.lit(1).cast("bigint"))
    p = p.where(F.trim(key) != "")
    n = p.groupBy(key).agg(F.count("*").alias("n_rows"))
    return dedupe.merge(p.drop("n_rows"), key).select(key, *([] if key == "job_id" else ["job_id"]), F.col("n_sightings").cast("bigint").alias("n_sightings")).join(n, key)


@query(s_merge("dedupe_key"))
def merge_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "dedupe_key")


@query("""with u as (select * from postings union all select * from new_batches), r as (select *, row_number() over (partition by job_id order by """ + _ORDER + """, run_id) as rn from u where trim(job_id) <> '')
select job_id, max(case when rn = 1 then posted_at end) as posted_at, cast(sum(n_sightings) as bigint) as n_sightings from r group by job_id""")
def merge_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = table(spark, sf_dir, "postings"), table(spark, sf_dir, "new_batches")
    return dedupe.merge(p.unionByName(n).where(F.trim("job_id") != ""), "job_id").select("job_id", "posted_at", F.col("n_sightings").cast("bigint").alias("n_sightings"))


_STAYS = """case when a.posted_at is not null and b.posted_at is not null and a.posted_at <> b.posted_at then a.posted_at > b.posted_at
when a.source is distinct from b.source then coalesce(a.source, '') = 'session' else length(coalesce(a.description_text, '')) >= length(coalesce(b.description_text, '')) end"""


def _s_joined(w: str, l: str) -> str:
    ids = f"list_sort(list_distinct(list_concat(list_append({w}.merged_ids, {l}.job_id), {l}.merged_ids)))"
    return f"struct_pack(job_id := {w}.job_id, posted_at := {w}.posted_at, source := {w}.source, description_text := coalesce(nullif({w}.description_text, ''), {l}.description_text), merged_ids := {ids}, n_sightings := {w}.n_sightings + {l}.n_sightings)"


@query(f"""with g as (select dedupe_key, list(struct_pack(job_id := job_id, posted_at := posted_at, source := source, description_text := description_text, merged_ids := coalesce(merged_ids, []::varchar[]), n_sightings := cast(n_sightings as bigint)) order by seq) as rows
from postings where trim(dedupe_key) <> '' group by dedupe_key),
r as (select dedupe_key, list_reduce(rows, lambda a, b: case when {_STAYS} then {_s_joined('a', 'b')} else {_s_joined('b', 'a')} end) as w from g)
select dedupe_key, w.job_id, w.merged_ids, w.n_sightings from r""")
def fold_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.fold(table(spark, sf_dir, "postings"), "dedupe_key")


@query()
def fuzzy_title_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "postings").select("seq", F.coalesce("company_key", F.lit("")).alias("company_key"), F.coalesce("location_bucket", F.lit("")).alias("location_bucket"), text.normalize_title("title_raw").alias("title"))
    return dedupe.title_groups(p, "company_key", "location_bucket", "title")


@query(f"select norm, array_to_string(list_sort(list(distinct company_key)), '|') as company_keys from (select {s_company('company_name_raw')} as norm, company_key from postings) where norm <> '' and company_key is not null group by norm having count(distinct company_key) > 1")
def alias_suspicions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "postings").withColumn("norm", text.company_norm("company_name_raw"))
    return dedupe.alias_suspicions(p, "norm", "company_key", "company_name_raw").select("norm", F.array_join("company_keys", "|").alias("company_keys"))


# ---- companies -------------------------------------------------------------------------------------------------------------------


@query("select company_key, arg_max(company_name_raw, struct_pack(n := n, c := company_name_raw)) as display_name, max(n) as n_display from (select company_key, company_name_raw, count(*) as n from postings where trim(company_name_raw) <> '' and company_key is not null group by all) group by company_key")
def common_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies.common_spelling(table(spark, sf_dir, "postings").where("company_key is not null"), "company_key", "company_name_raw")


@query(f"""select company_key, count(*) as n_jobs, max(posted_at) as latest, coalesce(min(cast(date '{TODAY}' - posted_at as integer)), 9999) as days_min, arg_max(job_id, struct_pack(d := coalesce(posted_at, date '0001-01-01'), s := -seq)) as best_job_id,
array_to_string(list_sort(list(distinct location_bucket) filter (where location_bucket is not null)), '|') as buckets from postings where company_key is not null group by company_key""")
def company_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = companies.rollup(table(spark, sf_dir, "postings").where("company_key is not null"), _today())
    return r.select("company_key", "n_jobs", "latest", "days_min", "best_job_id", F.array_join("buckets", "|").alias("buckets"))


@query("select company_key, array_to_string(list_sort(list(distinct i)), '|') as industries from (select company_key, unnest(li_industries) as i from postings where company_key is not null) where i is not null group by company_key")
def industry_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies.industries(table(spark, sf_dir, "postings").where("company_key is not null")).select("company_key", F.array_join("industries", "|").alias("industries"))


def _norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "postings", "company_name_raw").select(text.company_norm("company_name_raw").alias("norm")).where("norm <> ''").distinct()


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.array().cast("array<string>")
    return companies.spelling_rows(table(spark, sf_dir, "deny_entries"), [F.array("norm"), F.coalesce("alias_norms", no)])


_S_NORMS = f"(select distinct norm from (select {s_company('company_name_raw')} as norm from postings) where norm <> '')"
_S_SPELL = "(select distinct entry_id, norm from (select entry_id, norm from deny_entries union all select entry_id, unnest(alias_norms) from deny_entries) where norm <> '')"


@query(f"select n.norm, min(s.entry_id) as entry_id from {_S_NORMS} n join {_S_SPELL} s on n.norm = s.norm group by n.norm")
def deny_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies.exact_matches(_norms(spark, sf_dir), _spellings(spark, sf_dir))


@query(f"select p.slug, min(e.entry_id) as entry_id from (select distinct lower({s_slug('company_linkedin_url')}) as slug from postings) p join (select entry_id, lower(unnest(slugs)) as slug from deny_entries) e on p.slug = e.slug group by p.slug")
def deny_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    slugs = table(spark, sf_dir, "postings").select(F.lower(urls.company_slug("company_linkedin_url")).alias("slug")).where("slug is not null").distinct()
    return companies.slug_matches(slugs, table(spark, sf_dir, "deny_entries"))


@query(f"select n.norm, max(a.sector) as sector from {_S_NORMS} n join (select {s_company('name')} as norm, sector from allow_entries union all select {s_company('x')}, sector from (select unnest(aliases) as x, sector from allow_entries)) a on n.norm = a.norm group by n.norm")
def allow_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "allow_entries").select("sector", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("x")).select("sector", text.company_norm("x").alias("norm"))
    return _norms(spark, sf_dir).join(a, "norm").groupBy("norm").agg(F.max("sector").alias("sector"))


@query(f"select n.norm, min(e.entry_id) as entry_id from {_S_NORMS} n join deny_entries e on len(e.tokens) >= 2 and list_has_all(string_split(n.norm, ' '), e.tokens) group by n.norm")
def token_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies.subset_matches(_norms(spark, sf_dir), table(spark, sf_dir, "deny_entries"))


@query()
def fuzzy_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = companies.exact_matches(_norms(spark, sf_dir), _spellings(spark, sf_dir))
    entries = table(spark, sf_dir, "deny_entries").where("not exact_only").select("entry_id")
    return companies.fuzzy_matches(_norms(spark, sf_dir).join(sure, "norm", "left_anti"), _spellings(spark, sf_dir).join(entries, "entry_id", "left_semi"))


def _s_phrases() -> str:
    parts = []
    for label, (weight, phrases) in companies.PHRASES.items():
        n = " + ".join(f"cast(contains(t, {_q(p.replace(',', '').replace('-', ' '))}) as integer)" for p in phrases)
        parts.append(f"({n}) * {weight} as {label.lower()}")
    return f"select job_id, {', '.join(parts)} from (select job_id, {s_text('description_text')} as t from postings where description_text is not null)"


@query(_s_phrases())
def phrase_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "postings", "job_id", "description_text").where("description_text is not null")).select("job_id", text.normalize_text("description_text").alias("t"))
    return p.select("job_id", *[v.cast("int").alias(k.lower()) for k, v in companies.phrase_scores(F.col("t")).items()])


_SECTORS = ["Banking", "Insurance", "Retail", "Utilities", "Real Estate", "Education"]


@query(f"select job_id, list_filter(li_industries, lambda x: list_contains([{', '.join(map(_q, _SECTORS))}], x))[1] as industry from postings")
def declared_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "postings").select("job_id", companies.first_in_list(F.col("li_industries"), _SECTORS).alias("industry"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "postings").where("company_key is not null").select("company_key", "posted_at", "location_bucket", "posted_confidence", "li_industries", F.datediff(_today(), F.col("posted_at")).alias("days"))
    fit = F.when(F.col("location_bucket") == "MADRID", 1.0).when(F.col("location_bucket") == "REMOTE_ES", 0.85).when(F.col("location_bucket") == "REST_ES", 0.4).when(F.col("location_bucket") == "UNKNOWN", 0.3).otherwise(0.0)
    c = p.groupBy("company_key").agg(F.max(companies.recency(F.col("days"), F.coalesce("posted_confidence", F.lit(0.5)))).alias("recency"), F.max(fit).alias("place"), F.count("*").alias("n"), F.max("posted_at").alias("latest"), F.min("location_bucket").alias("bucket"))
    volume = F.when(F.col("n") >= 3, 1.0).when(F.col("n") == 2, 0.7).otherwise(0.3)
    score, strong, weak = companies.weighted([("recency", 40, F.col("recency")), ("place", 35, F.col("place")), ("volume", 25, volume)])
    return c.select("company_key", "bucket", "latest", score.alias("score"), F.array_join(strong, "|").alias("strong"), weak.alias("weak"))


_S_FACTORS = f"""(with p as (select company_key, posted_at, location_bucket, coalesce(posted_confidence, 0.5) as conf, cast(date '{TODAY}' - posted_at as integer) as days from postings where company_key is not null),
c as (select company_key, max((case when days is null then 0.5 when days <= 3 then 1.0 when days <= 7 then 0.9 when days <= 14 then 0.7 when days <= 30 then 0.4 else 0.15 end)::double * conf + 0.5::double * (1 - conf)) as recency,
max((case location_bucket when 'MADRID' then 1.0 when 'REMOTE_ES' then 0.85 when 'REST_ES' then 0.4 when 'UNKNOWN' then 0.3 else 0.0 end)::double) as place, count(*) as n, max(posted_at) as latest, min(location_bucket) as bucket from p group by company_key),
v as (select *, (case when n >= 3 then 1.0 when n = 2 then 0.7 else 0.3 end)::double as volume from c) select * from v)"""
_S_SCORED = f"(select company_key, bucket, latest, round_even(round_even(40.0::double * recency, 2) + round_even(35.0::double * place, 2) + round_even(25.0::double * volume, 2), 1) as score from {_S_FACTORS})"


@query(f"select company_key, score from {_S_SCORED}")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("company_key", "score")


@query(f"""with v as (select company_key, [struct_pack(p := round_even(40.0::double * recency, 2), o := 0, n := 'recency', x := recency, l := 40.0::double * (1 - recency)),
struct_pack(p := round_even(35.0::double * place, 2), o := -1, n := 'place', x := place, l := 35.0::double * (1 - place)), struct_pack(p := round_even(25.0::double * volume, 2), o := -2, n := 'volume', x := volume, l := 25.0::double * (1 - volume))] as c from {_S_FACTORS})
select company_key, array_to_string(list_transform(list_reverse_sort(list_filter(c, lambda i: i.x >= 0.6))[1:2], lambda i: i.n), '|') as strong,
case when list_reverse_sort(list_transform(c, lambda i: struct_pack(l := i.l, o := i.o, n := i.n, x := i.x)))[1].x < 0.5 then list_reverse_sort(list_transform(c, lambda i: struct_pack(l := i.l, o := i.o, n := i.n, x := i.x)))[1].n end as weak from v""")
def score_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("company_key", "strong", "weak")


@query(f"select company_key, bucket, row_number() over (partition by bucket order by latest desc nulls last, score desc, company_key) as rank from {_S_SCORED}")
def rank_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies.ranked(_scored(spark, sf_dir), "reciente").select("company_key", "bucket", "rank")


@query(f"select company_key, bucket, row_number() over (partition by bucket order by score desc, company_key) as rank from {_S_SCORED}")
def rank_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies.ranked(_scored(spark, sf_dir), "prioridad").select("company_key", "bucket", "rank")


# ---- facets, links, scans --------------------------------------------------------------------------------------------------------


@query("select 'bucket' as facet, location_bucket as value, count(*) as n from postings where location_bucket is not null group by all union all select 'industry', i, count(*) from (select distinct job_id, unnest(li_industries) as i from postings) where i is not null group by i")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "postings").select(F.array_compact(F.array("location_bucket")).alias("bucket"), F.array_compact(F.coalesce("li_industries", F.array().cast("array<string>"))).alias("industry"))
    return companies.facet_counts(p, ["bucket", "industry"])


@query(f"select job_id from postings where location_bucket in ('MADRID', 'REMOTE_ES') and list_has_any(li_industries, ['Banking', 'Retail']) and date '{TODAY}' - posted_at <= 120")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "postings").select("job_id", F.array("location_bucket").alias("bucket"), F.col("li_industries").alias("industry"), F.datediff(_today(), F.col("posted_at")).alias("days_min"))
    return companies.facet_filter(p, {"bucket": ["MADRID", "REMOTE_ES"], "industry": ["Banking", "Retail"], "unset": []}, 120).select("job_id")


@query(f"""select job_id, regexp_replace(company_linkedin_url, '[?#].*$', '') as plain_url, {s_slug('company_linkedin_url')} as slug, sha1(url) as url_key,
case when regexp_matches(lower({s_slug('company_linkedin_url')}), '{urls.SLUG}') then '{BASE}/company/' || lower({s_slug('company_linkedin_url')}) || '/jobs/' end as jobs_url from postings""")
def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = urls.company_slug("company_linkedin_url")
    return table(spark, sf_dir, "postings").select("job_id", urls.strip_query("company_linkedin_url").alias("plain_url"), slug.alias("slug"), urls.url_key("url").alias("url_key"), urls.company_jobs_url(BASE, slug).alias("jobs_url"))


@query(f"select job_id, '{BASE}/jobs/search/?keywords=' || replace({s_company('company_name_raw')}, ' ', '+') || '&geo=7' as search_url from postings where {s_company('company_name_raw')} <> ''")
def search_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "postings").select("job_id", text.company_norm("company_name_raw").alias("norm")).where("norm <> ''")
    return p.select("job_id", urls.search_url(f"{BASE}/jobs/search/", [("keywords", F.col("norm")), ("geo", F.lit(7)), ("mode", F.lit(None).cast("string"))]).alias("search_url"))


_CODES = "case cast(seq % 9 as integer) when 0 then null when 1 then 429 when 2 then 404 when 3 then 403 when 4 then 500 else 200 end"
_FINAL = f"case cast(seq % 7 as integer) when 0 then '{BASE}/login' when 1 then '{BASE}/company/unavailable' else company_linkedin_url end"


@query(f"""select seq, case when code is null then 'sin respuesta' when code in (403, 429, 999) then 'bloqueado' when code >= 400 then 'muerto' when contains(final, '/login') or contains(final, 'authwall') then 'bloqueado'
when regexp_extract(url, '/company/([^/?#]+)', 1) <> '' and not contains(final, '/company/' || regexp_extract(url, '/company/([^/?#]+)', 1)) then 'redirigido' else 'ok' end as verdict
from (select seq, company_linkedin_url as url, {_CODES} as code, coalesce(nullif({_FINAL}, ''), company_linkedin_url) as final from postings where company_linkedin_url is not null)""")
def link_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "postings").where("company_linkedin_url is not null").select("seq", F.col("company_linkedin_url").alias("url"), F.expr(_CODES).alias("code"), F.expr(_FINAL).alias("final"))
    return p.select("seq", urls.link_verdict("url", "code", "final").alias("verdict"))


@query("select job_id from new_batches where job_id not in (select job_id from postings where job_id is not null)")
def unseen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.unseen(table(spark, sf_dir, "new_batches"), table(spark, sf_dir, "postings")).select("job_id")


@query("select d.seq, coalesce(nullif(p.url, ''), d.url) as url, p.job_id is null as missing from deliveries d left join postings p on d.job_id = p.job_id")
def detail_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "deliveries").select("seq", "job_id", "url", F.array().cast("array<string>").alias("parse_warnings"))
    over = pages.overlay(d, table(spark, sf_dir, "postings").select("job_id", "url", F.array().cast("array<string>").alias("parse_warnings")))
    return over.select("seq", "url", F.array_contains("parse_warnings", "detail not found").alias("missing"))


@query("select max(run_id) as run_id from deliveries")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "deliveries").agg(F.max("run_id").alias("run_id"))


_CAP = 1000


@query(f"""with f as (select job_id, min(struct_pack(a := cast(seq // 700 as integer), b := cast(seq % 7 as integer), c := cast(seq as integer))) as pos from deliveries group by job_id)
select job_id from (select job_id, row_number() over (order by pos.a, pos.b, pos.c, job_id) as r from f) where r <= {_CAP}""")
def page_major_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "deliveries").select("job_id", F.floor(F.col("seq") / 700).cast("int").alias("page"), (F.col("seq") % 7).cast("int").alias("query_order"), F.col("seq").cast("int").alias("position"))
    return store.fair_cap(d, _CAP)


@query("select job_id, location_bucket as location, source as company from postings where location_bucket is not null and source is not null")
def page_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of result pages: pages are written from the postings, parsed, and must give the postings back."""
    p = table(spark, sf_dir, "postings").where("location_bucket is not null and source is not null")
    html = F.format_string(
        "<ul><li><div class=\"base-card x\" data-entity-urn=\"urn:posting:%s\"><a class=\"base-card__full-link\" href=\"/jobs/view/%s?x=1\">a &amp; b</a><img src='x'><h3>t<br></h3><h4 class=\"base-search-card__subtitle\"> %s </h4>"
        "<span class=\"job-search-card__location\">\n %s</span><time datetime=\"2026-01-01\">hoy</time></div></ul><script>var a = '<li>';</script>", "job_id", "job_id", "source", "location_bucket",
    )
    return pages.extract_cards(p.select("seq", html.alias("html")), "seq", "html").select("job_id", "location", "company")


@query(f"select level, count(*) as n, count(*) filter (where role = 'AI') as n_ai from ({s_level()}) a join ({_s_role()}) b using (job_id) group by level")
def market_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "postings")
    v = labels.with_level(spread(p.select("title_raw", "description_text", "li_seniority_field")), "title_raw", "description_text", "li_seniority_field").select(F.col("level.label").alias("level"), any_hit(F.coalesce(text.folded("title_raw"), F.lit("")), labels.ROLES["AI"]).alias("ai"))
    return v.groupBy("level").agg(F.count("*").alias("n"), F.count_if("ai").alias("n_ai"))


@query("select n_name as query_name, cast(p as integer) as page from nation, range(3) r(p)")
def scan_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.rotation(table(spark, sf_dir, "nation").select(F.col("n_name").alias("query_name")), 3)


_CAPTIONS = {"MADRID": "Madrid", "REMOTE_ES": "Remoto", "REST_ES": "Resto de España"}


@query(f"""select job_id, case location_bucket when 'MADRID' then 'Madrid' when 'REMOTE_ES' then 'Remoto' when 'REST_ES' then 'Resto de España' else location_bucket end as place, upper(substring(title_raw, 1, 1)) || substring(title_raw, 2) as title,
cast(d as varchar) || case when d = 1 then ' día' else ' días' end as age, replace('{{"t":"' || replace(coalesce(company_key, '-'), '"', '\\"') || '"}}', '<', '\\u003c') as island, lower(case when li_seniority_field = 'JUNIOR_BY_DESC' then 'JUNIOR' else li_seniority_field end) as level_key,
case when ltrim(trim(company_key), '@') <> '' then 'https://icons.example/' || ltrim(trim(company_key), '@') end as icon from (select *, cast(date '{TODAY}' - posted_at as integer) as d from postings)""")
def display_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page shows of a posting: captions, age, a value that may stand in a script, the key of its level in a filter, an icon's address."""
    p = table(spark, sf_dir, "postings").withColumn("d", F.datediff(_today(), F.col("posted_at")))
    island = text.script_safe_json(F.struct(F.coalesce("company_key", F.lit("-")).alias("t")))
    return p.select("job_id", posting.caption("location_bucket", _CAPTIONS).alias("place"), text.upper_first("title_raw").alias("title"), posting.days_caption("d").alias("age"), island.alias("island"), posting.filter_key("li_seniority_field").alias("level_key"), urls.favicon_url("https://icons.example/", "company_key").alias("icon"))


@query(f"""select company_key, arg_max(reason, struct_pack(w := w, o := -seq)) as best_reason, max(w) as best from (select seq, company_key, coalesce(posted_confidence, 0.0) as w,
case when location_bucket = 'MADRID' then 'near' when location_bucket is null then 'unknown' else 'far' end as reason from postings where company_key is not null) group by company_key""")
def best_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest factor of a company's postings with its reason, the earliest posting on ties."""
    p = table(spark, sf_dir, "postings", "seq", "company_key", "posted_confidence", "location_bucket").where("company_key is not null")
    reason = F.when(F.col("location_bucket") == "MADRID", "near").when(F.col("location_bucket").isNull(), "unknown").otherwise("far")
    w = F.coalesce("posted_confidence", F.lit(0.0))
    return p.groupBy("company_key").agg(F.max_by(reason, F.struct(w, -F.col("seq"))).alias("best_reason"), F.max(w).alias("best"))


@query("""with p as (select * from postings where company_key is not null), n as (select company_key, company_name_raw, count(*) as n from p where company_name_raw is not null group by all),
d as (select company_key, arg_max(company_name_raw, struct_pack(n := n, c := company_name_raw)) as display_name from n group by company_key)
select company_key, any_value(display_name) as display_name, list_sort(list(distinct company_name_raw) filter (where company_name_raw <> display_name)) as aliases, arg_min(company_logo_url, seq) filter (where company_logo_url <> '') as logo,
arg_min(company_linkedin_url, seq) filter (where company_linkedin_url <> '') as url, cast(sum(length(description_text)) as bigint) as text_length from p left join d using (company_key) group by company_key""")
def company_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display name, its other spellings, and the first logo and address of each company."""
    p = table(spark, sf_dir, "postings").where("company_key is not null")
    return companies.identity(p)


@query("""select seq, job_id, company_key, row_number() over (partition by company_key order by posted_at desc nulls last, seq) as place from postings where company_key is not null""")
def postings_in_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a company's postings are shown: newest first."""
    p = table(spark, sf_dir, "postings", "seq", "job_id", "company_key", "posted_at").where("company_key is not null")
    return companies.in_order(p, "company_key", [F.desc_nulls_last("posted_at"), F.col("seq")], "place").drop("posted_at")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
