"""The thin queries opN_<name> over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampline.llm import curriculum, decontaminate, dedup_runs, gif, licenses, quality, simhash, surrogates, token_counts, wrappers
from ampline.llm.common import small_batches, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    media = gif.media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = lambda c: F.octet_length(c).cast("long")
    counts = F.transform("frames", lambda f: F.array_join(f["histogram"].cast("array<string>"), ","))
    return media.select(
        "doc_id", F.coalesce(size("text"), F.lit(0).cast("long")).alias("n_bytes"), size("payload").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), size("media").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.array_join(counts, ";").alias("feature"), "frames",
    )


def op3_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_runs.remove_long_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_bytes=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    sha = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), "contaminated")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = quality.held_out(F.col("doc_id"))
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"), ~held)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), secret_key(spark))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def op9_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order in which they are first trained on; those that the mix leaves out last."""
    plan = curriculum.curriculum(table(spark, sf_dir, "documents"), ["doc_id"])
    first = F.round(F.get("positions", F.lit(0)), 9) + F.lit(0.0)
    return plan.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", first.alias("first_position"))


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op8_licenses: the places of the base phrases."""
    return op8_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op2_gif_media: the payload that is read back."""
    return op2_gif_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wrappers.extract_main(table(spark, sf_dir, "pages").select("page_id", "url", "html"), out="text")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def secret_key(spark: SparkSession) -> str:
    """Key of the surrogates: ampline.pii.key of the session; a fixed one for trials where unset."""
    return spark.conf.get("ampline.pii.key", "trial")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_gif_media, op3_long_repeats, op4_decontamination, op5_simhash, op6_quality, op7_surrogates, op8_licenses, op9_curriculum, op10_main_text, license_base_places, media_payloads)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op4_decontamination": f"""
with d as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
bw as (select distinct item, least(13, len(w)) as k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as win
       from (select item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
ks as (select distinct k from bw),
dw as (select r, k, i, array_to_string(w[i:i + k - 1], ' ') as win
       from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
h as (select dw.r, dw.i, dw.k, bw.item from dw join bw on dw.k = bw.k and dw.win = bw.win),
n as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from h) group by r),
it as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join n on d.r = n.r left join it on d.r = it.r""",
    "license_base_places": rf"""
with d as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
ph as (select * from (values (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) p(phrase, label)),
h as (select r, label, i - 1 as i from (select r, w, phrase, label, unnest(range(1, len(w) - len(phrase) + 2)) as i from d, ph) where w[i:i + len(phrase) - 1] = phrase),
g as (select r, count(*) as n, min(i) as a, max(i) as b, string_agg(distinct label, ',' order by label) as labels from h group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_base, cast(a as bigint) as first_word, cast(b as bigint) as last_word, coalesce(labels, '') as base_labels
from d left join g on d.r = g.r""",
    "media_payloads": """
with d as (select doc_id, coalesce(text, '') as t, strlen(coalesce(text, '')) as n from documents), p as (select *, cast(greatest(192, ceil(n / 192.0) * 192) as bigint) as k from d)
select doc_id, cast(n as bigint) as n_bytes, k as payload_bytes, sha256(t || repeat(' ', k - n)) as payload_sha256 from p""",
    "op9_curriculum": r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
                  cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ' ' || coalesce(text, '')), 1, 15) as bigint) as o from documents),
s as (select source, cast(sum(size) as bigint) as ss, row_number() over (order by source is null, source) - 1 as turn from d group by source),
w as (select *, [5.0::double, 2.0::double, 1.0::double][cast(turn % 3 + 1 as int)] as wt, [-0.5::double, 0.0::double, 0.5::double][cast(turn % 3 + 1 as int)] as slope, ss * 2.0::double as cap from s),
f as (select *, (sum(ss) over () * 1.5::double - coalesce(sum(cap) over q, 0)) / (sum(wt) over () - coalesce(sum(wt) over q, 0)) as level
      from w window q as (order by cap / wt, source is null, source rows between unbounded preceding and 1 preceding)),
o as (select min_by(level, turn) as level from (select level, row_number() over (order by cap / wt, source is null, source) as turn from f where not cap <= level * wt)),
t as (select f.source, ss, slope, case when cap <= f.level * wt or o.level is null then cap else least(cap, o.level * wt) end as target from f, o),
p as (select d.doc_id, d.size, t.*, coalesce(sum(size) over (partition by d.source order by d.o range between unbounded preceding and 1 preceding), 0) as b from d join t on d.source is not distinct from t.source),
c as (select *, floor(case when ss = 0 then 0 else target / ss end + 1e-12) as k from p),
n as (select *, least(k + case when b + size / 2.0 <= target - k * ss and size > 0 then 1 else 0 end, 2) as copies from c),
u as (select *, least(1.0, case when target = 0 then 0.0 else b / target end) as part, 1 - slope as e from n)
select doc_id, size, ss as source_size, round(target, 6) as target, cast(copies * size as bigint) as taken,
       case when copies > 0 then round(greatest(0.0, least(1.0, case when slope = 0 then part else (sqrt(greatest(e * e + 4 * slope * part, 0.0)) - e) / (2 * slope) end)), 9) + 0.0 end as first_position
from u""",
}
