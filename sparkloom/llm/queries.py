"""One query per operator, over the whole table it is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import chat_format, classifier, decontaminate, divergence, forced_bpe, hard_negatives, langid, mixing, quality_rules, simhash, suffix_dedup, url_filter, warc
from sparkloom.llm.common import fold, table
from sparkloom.runtime import scratch_path


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), min_bytes=50)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    extra = spark.sql("select -1L as conv_id, posexplode(array('user', 'assistant')) as (turn, role)").withColumn("text", F.lit(text))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra.withColumn("turn", F.col("turn").cast("long")))
    read = chat_format.digests(chat_format.format_turns(rows))
    return read.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date made from their number."""
    return pages.select("page_id", "url", F.expr("date_add(date '2024-01-01', cast(page_id * 37 % 366 as int))").alias("fetched"))


def list_changes(pages: DataFrame) -> DataFrame:
    """A change log made from the hosts and first path segments of all pages: which of them, and when, by digits of their MD5."""
    url = F.col("url")
    named = pages.select(url_filter.host(url).alias("host"), url_filter.path(url).alias("path")).where("host is not null")
    number = lambda c: F.conv(F.substring(F.md5(c.cast("binary")), 1, 4), 16, 10).cast("int")
    day = lambda c: F.expr(f"date_add(date '2024-01-01', {c})")
    hosts = named.select(F.col("host").alias("pattern")).distinct().withColumn("v", number(F.col("pattern"))).where("v % 5 = 0")
    log = hosts.select("pattern", F.lit("malware").alias("category"), F.lit("add").alias("action"), day("v % 180").alias("changed"))
    log = log.unionByName(hosts.select("pattern", F.lit("malware").alias("category"), F.lit("remove").alias("action"), day("v % 180 + 60 + v % 90").alias("changed")))
    log = log.unionByName(hosts.where("v % 2 = 1").select("pattern", F.lit("malware").alias("category"), F.lit("add").alias("action"), day("v % 180 + 200").alias("changed")))
    paths = named.where(F.size("path") > 0).select(F.concat("host", F.lit("/"), F.col("path")[0]).alias("pattern")).distinct().withColumn("v", number(F.col("pattern"))).where("v % 3 = 0")
    log = log.unionByName(paths.select("pattern", F.lit("spam").alias("category"), F.lit("add").alias("action"), day("v % 300").alias("changed")))
    parents = named.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("pattern"))
    parents = parents.where("pattern <> ''").distinct().withColumn("v", number(F.col("pattern")))
    return log.unionByName(parents.select("pattern", F.lit("adult").alias("category"), F.lit("add").alias("action"), day("v % 366").alias("changed"))).unionByName(
        parents.select("pattern", F.lit("adult").alias("category"), F.lit("remove").alias("action"), day("v % 366 + 10").alias("changed")))


def op3_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.evaluate(captures(pages), list_changes(pages))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = fold("doc_id", 4)
    found = langid.identify_with_own_labels(docs, remainder != 2)
    return found.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages"))


def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    legacy, made = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    warc.write_arc(pages, legacy)
    warc.write_warc(warc.convert(warc.read_arc(spark, [legacy])), made)
    return warc.index(warc.read_warc(spark, [made]))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents")).taken()
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    scored = classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=~held)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = forced_bpe.encode(table(spark, sf_dir, "documents"), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return read.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), anchors=F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (
    op1_suffix_array_dedup,
    op2_chat_formatting,
    op3_temporal_url_lists,
    op4_language_mixture,
    op5_compression_bands,
    op6_arc_to_warc,
    op7_benchmark_decontamination,
    op8_simhash_near_dedup,
    op9_source_mixing,
    op10_quality_classifier,
    op11_forced_boundary_bpe,
    op12_source_divergence,
    op13_hard_negatives,
)}


# Hosts, paths and patterns as in url_filter, in DuckDB's words.
_HOST = r"""nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', '')), '')"""
_PATH = r"""list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '')"""
_NUMBER = "cast('0x' || substr(md5(pattern), 1, 4) as int)"

ORACLES: dict[str, str] = {
    "op1_suffix_array_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
k as (select doc_id, c, substr(h, 256 * c + 1, 354) as part from (select doc_id, h, unnest(range(0, (length(h) + 255) // 256)) as c from d)),
p as (select doc_id, 128 * c + i as i, substr(part, 2 * i + 1, 100) as g from (select doc_id, c, part, unnest(range(0, least(128, length(part) // 2))) as i from k)),
m as (select g, min(doc_id) as first from p where length(g) = 100 group by g having min(doc_id) < max(doc_id)),
f as (select p.doc_id, p.i, substr(p.g, 1, 2) as byte, coalesce(m.first < p.doc_id, false) as hit from p left join m on m.g = p.g),
c as (select doc_id, i, byte, max(cast(hit as int)) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from f),
s as (select *, lag(gone, 1, 0) over (partition by doc_id order by i) as before from c),
r as (
  select doc_id, sum(gone) as n_removed, sum(case when gone = 1 and before = 0 then 1 else 0 end) as n_spans,
    string_agg(byte, '' order by i) filter (where gone = 0) as kept
  from s group by doc_id)
select d.doc_id, cast(length(d.h) // 2 as bigint) as n_bytes, cast(coalesce(r.n_removed, 0) as bigint) as n_removed, cast(coalesce(r.n_spans, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(r.kept, ''))) as kept_sha256
from d left join r on r.doc_id = d.doc_id""",
    "op2_chat_formatting": r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown as (
  select *, length(regexp_replace(text, '(<\\*(?:s>|/s>|<SYS>>|</SYS>>)|\[\\*(?:INST\]|/INST\]|ROLE\]|/ROLE\]))', '\1+', 'g')) as escaped from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(3 + sum(escaped + case role when 'user' then 13 when 'system' then 15 when 'assistant' then 4 else 17 + length(role) end) as bigint) as formatted_chars
from shown group by conv_id""",
    "op3_temporal_url_lists": f"""
with named as (
  select page_id, cast(date '2024-01-01' + cast(page_id * 37 % 366 as int) as date) as fetched, {_HOST} as host, {_PATH} as path from pages),
hosts as (select pattern, {_NUMBER} as v from (select distinct host as pattern from named where host is not null)),
paths as (select pattern, {_NUMBER} as v from (select distinct host || '/' || path[1] as pattern from named where host is not null and len(path) > 0)),
parents as (select pattern, {_NUMBER} as v from (select distinct regexp_extract(host, '([^.]+\\.[^.]+)$', 1) as pattern from named where host is not null) where pattern <> ''),
changes as (
  select pattern, 'malware' as category, 'add' as action, v % 180 as day from hosts where v % 5 = 0
  union all select pattern, 'malware', 'remove', v % 180 + 60 + v % 90 from hosts where v % 5 = 0
  union all select pattern, 'malware', 'add', v % 180 + 200 from hosts where v % 5 = 0 and v % 2 = 1
  union all select pattern, 'spam', 'add', v % 300 from paths where v % 3 = 0
  union all select pattern, 'adult', 'add', v % 366 from parents
  union all select pattern, 'adult', 'remove', v % 366 + 10 from parents),
daily as (select pattern, category, day, max(action) as action from changes group by all),
steps as (select *, lead(day) over (partition by pattern, category order by day) as until from daily),
asked as (
  select page_id, fetched, unnest(list_distinct(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, 999), '.')),
    list_transform(range(1, least(len(path), 2) + 1), lambda i: host || '/' || array_to_string(list_slice(path, 1, i), '/'))))) as pattern
  from named where host is not null and fetched is not null),
hit as (
  select a.page_id, a.pattern, s.category, cast(date '2024-01-01' + cast(s.day as int) as date) as valid_from,
    row_number() over (partition by a.page_id order by length(a.pattern) desc, a.pattern desc, s.category, s.day) as place
  from asked a join steps s on s.pattern = a.pattern and s.action = 'add'
    and a.fetched >= date '2024-01-01' + cast(s.day as int) and (s.until is null or a.fetched < date '2024-01-01' + cast(s.until as int)))
select n.page_id, n.host, n.fetched, h.page_id is not null as blocked, h.pattern, h.category, h.valid_from
from named n left join hit h on h.page_id = n.page_id and h.place = 1""",
    "op6_arc_to_warc": """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as bytes from pages),
d as (select page_id, cast(bytes as bigint) as bytes, sha256(html) as digest from p),
f as (select digest, min(page_id) as first from d where bytes >= 100 group by digest)
select d.page_id, d.bytes as payload_bytes, d.digest as payload_digest,
  case when d.bytes >= 100 and d.page_id > f.first then 'revisit' else 'response' end as record_type,
  case when d.bytes >= 100 and d.page_id > f.first then f.first end as refers_to
from d left join f on f.digest = d.digest""",
    "op7_benchmark_decontamination": r"""
with doc as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as i from item where len(w) > 0)),
lens as (select distinct n from win),
pos as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from doc, lens where len(w) >= n),
hit as (select p.doc_id, p.i, p.n, p.s from (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as s from pos) p where p.s in (select s from win)),
covered as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hit) group by doc_id),
of as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct h.doc_id, w.item_id from hit h join win w on w.s = h.s) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(c.n_hit, 0) as bigint) as n_hit, cast(coalesce(o.n_items, 0) as bigint) as n_items,
  sha256(coalesce(o.ids, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= len(d.w) as contaminated
from doc d left join covered c on c.doc_id = d.doc_id left join of o on o.doc_id = d.doc_id""",
    "op12_source_divergence": r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as row,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
kept as (select lang, term, count(*) as n from d group by lang, term having count(distinct row) >= 10),
grp as (select distinct coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
cnt as (select d.lang, d.source, d.term, count(*) as n from d join kept k on k.lang = d.lang and k.term = d.term group by all),
vs as (select g.lang, (select count(*) from kept k where k.lang = g.lang) as v, (select coalesce(sum(n), 0) from kept k where k.lang = g.lang) as size from (select distinct lang from grp) g),
gs as (select g.lang, g.source, vs.v, coalesce(sum(c.n), 0) as size from grp g join vs on vs.lang = g.lang left join cnt c on c.lang = g.lang and c.source = g.source group by all),
price as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 2) // (g.size + 2 * g.v) as p,
    1 + cast(1000000000 as hugeint) * (k.n + 2) // (vs.size + 2 * vs.v) as q
  from gs g join kept k on k.lang = g.lang join vs on vs.lang = g.lang left join cnt c on c.lang = g.lang and c.source = g.source and c.term = k.term),
sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from price a join price b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
found as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from price where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from found)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= 10""",
    "op13_hard_negatives": """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where label is not null and vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
pos as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
neg as (
  select p.anchor_id, p.positive_id, s.vec_id as negative_id, p.positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
  from pos p join s on s.anchor_id = p.anchor_id and not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from neg where rank <= 10""",
}
