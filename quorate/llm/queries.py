"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.llm import chats, divergence, embeddings, langid, lines, manifest, mixing, ngram_join, packing, quality, rules, shards, url_filter
from quorate.llm.common import n_words, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


WORDS_SQL = r"len(regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+'))"

MIX_SQL = rf"""
with d as (select doc_id, source, {WORDS_SQL.format('text')} as size, md5(coalesce(cast(doc_id as varchar), '')) as key from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ((row_number() over (order by source is null, source) - 1) % 3 + 1)::bigint as weight,
             row_number() over (order by source is null, source) as turn from s),
l as (select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over (order by source_size / weight::double, turn rows between unbounded preceding and 1 preceding), 0))::double
               / sum(weight) over (order by source_size / weight::double, turn rows between current row and unbounded following) as level from w),
f as (select level from l where level * weight <= 3 * source_size order by source_size / weight::double, turn limit 1),
t as (select source, source_size, coalesce(least((3 * source_size)::double, (select level from f) * weight), 0.0) as target from l),
b as (select *, round(target)::bigint as budget from t),
r as (select *, case when source_size > 0 then budget // source_size else 0 end as rounds from b),
p as (select d.*, r.source_size, r.target, r.budget, r.rounds,
             sum(size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and current row) - size as before_it
      from d join r on d.source is not distinct from r.source)
select doc_id, source, size::bigint as size, source_size::bigint as source_size, target,
       (rounds * size + greatest(0, least(size, budget - rounds * source_size - before_it)))::bigint as taken
from p
"""

EMBEDDING_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select vec_id as id, vec_id as root from v union select r.id, l.b from reach r join links l on l.a = r.root),
comp as (select id, min(root) as component_id from reach group by id),
n as (select a as id, count(*) as n_links from links group by a)
select e.vec_id, coalesce(n.n_links, 0)::bigint as n_links, coalesce(c.component_id, e.vec_id) as component_id, e.vec_id = coalesce(c.component_id, e.vec_id) as kept
from embeddings e left join n on n.id = e.vec_id left join comp c on c.id = e.vec_id
"""

URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DOMAINS = tuple(f"{n}.example.{t}" for n in LISTED_NAMES for t in ("com", "net", "org"))

URL_SQL = rf"""
with p as (select page_id, case when url like '%://%' then url end as url from pages),
h as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from p),
r as (select *, case when (host = 'example.org' or suffix(host, '.example.org')) and prefix(path, '/en/1') then 'example.org/en/1'
                     when (host = 'example.org' or suffix(host, '.example.org')) and prefix(path, '/es/') then 'example.org/es/'
                     when (host = 'com' or suffix(host, '.com')) and prefix(path, '/de/') then 'com/de/'
                     when (host = 'com' or suffix(host, '.com')) and prefix(path, '/fr/') then 'com/fr/'
                     when (host = 'org' or suffix(host, '.org')) and prefix(path, '/') then 'org/' end as rule from h)
select page_id, host, path, rule,
       case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
            when regexp_matches(host, '(^|\.)({'|'.join(LISTED_NAMES)})\.example\.(com|net|org)$') then 'block' else 'allow' end as verdict
from r
"""

CHAT_SQL = """
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls last, role nulls first, text nulls first) as pos,
                  role, text from conversations where conv_id is not null),
k as (select *, concat(coalesce(to_json(role)::varchar, 'null'), coalesce(to_json(text)::varchar, 'null')) as piece from t),
p as (select conv_id, pos, string_agg(piece, ',') over (partition by conv_id order by pos rows between unbounded preceding and current row) as prefix,
             max(pos) over (partition by conv_id) as last from k),
w as (select prefix, pos, min(conv_id) as conv_id, count(*) as n_copies from p where pos = last group by prefix, pos),
m as (select w.* from w where not exists (select 1 from p where p.prefix = w.prefix and p.pos = w.pos and p.pos < p.last))
select m.conv_id, ((t.pos - 1) // 512)::int as part, m.pos::bigint as n_turns, m.n_copies::bigint as n_copies,
       string_agg(concat('<|im_start|>', coalesce(t.role, ''), chr(10), coalesce(t.text, ''), '<|im_end|>', chr(10)), '' order by t.pos) as rendered
from m join t on t.conv_id = m.conv_id group by m.conv_id, (t.pos - 1) // 512, m.pos, m.n_copies
"""

JOIN_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
                          else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) end as sh from w),
c as (select md5(array_to_string(list_sort(sh), chr(10))) as cls, any_value(len(sh)) as n, any_value(sh) as sh, min(doc_id) as least from s where len(sh) > 0 group by 1),
e as (select cls, least, n, unnest(sh) as x from c),
f as (select e.x, e.least as id, e.n from e),
pairs as (select a.id as a, b.id as b, count(*) as i, any_value(a.n) as na, any_value(b.n) as nb from f a join f b on a.x = b.x and a.id < b.id
          and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by 1, 2),
links as (select a, b from pairs where 100 * i >= 90 * (na + nb - i)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select least as id, least as root from c union select r.id, l.b from reach r join both_ways l on l.a = r.root),
comp as (select id, min(root) as component_id from reach group by id)
select s.doc_id, len(s.sh)::bigint as n_shingles, case when len(s.sh) = 0 then s.doc_id else comp.component_id end as component_id
from s left join c on c.cls = md5(array_to_string(list_sort(s.sh), chr(10))) and len(s.sh) > 0 left join comp on comp.id = c.least
"""


@query("op1_shards")
def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_texts(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return packing.pack(docs, n_words(F.col("text")), F.col("source"), text_cluster(F.col("text")))


def text_cluster(text):
    """Documents equal up to case and blanks are one cluster; texts without words are in none."""
    plain = F.trim(F.regexp_replace(F.translate(text, url_filter.UPPER, url_filter.LOWER), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain != "", F.md5(plain.cast("binary")))


@query("op3_fuzzy_lines")
def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


@query("op4_ngram_join", JOIN_SQL)
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(read(spark, sf_dir, "documents"), ngram_join.Join(words=3, num=90, den=100))
    return found.select("doc_id", "n_shingles", "component_id")


@query("op5_mix_sources", MIX_SQL)
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), n_words(F.col("text")))


@query("op6_near_vectors", EMBEDDING_SQL)
def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


@query("op7_url_filter", URL_SQL)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(d,) for d in LISTED_DOMAINS], "key string")
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES, listed)


@query("op8_chats", CHAT_SQL)
def op8_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.format_chats(read(spark, sf_dir, "conversations"))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op10_rules")
def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))

AUDIT_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
t as (select r, lang, source, unnest(ts) as term from d),
v as (select lang, term, count(*) as n from t group by lang, term having count(distinct r) >= 10),
l as (select lang, count(*) as v, sum(n) as n from v group by lang),
g as (select distinct lang, source from d),
c as (select g.lang, g.source, v.term, v.n as lang_n, coalesce(x.n, 0) as n from g join v on v.lang = g.lang
      left join (select lang, source, term, count(*) as n from t group by 1, 2, 3) x on x.lang = g.lang and x.source = g.source and x.term = v.term),
s as (select *, sum(n) over (partition by lang, source) as total from c),
p as (select s.lang, s.source, s.term, s.n, (1 + 1000000000::hugeint * (s.n + 2) // (s.total + 2 * l.v))::bigint as p,
             (1 + 1000000000::hugeint * (s.lang_n + 2) // (l.n + 2 * l.v))::bigint as q from s join l on l.lang = s.lang),
pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
          from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
allp as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
         left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from p where n > 0 and p > q),
r as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from (select * from allp union all select * from terms))
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 10
"""


@query("op11_divergence", AUDIT_SQL)
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def manifest_sql(levels: int = 6) -> str:
    """Trees of up to 16 ** levels leaves, level by level; a tree that has come to one node stays as it is."""
    field = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    row = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bits = "list_transform(range(0, 8 * strlen(doc_id::varchar)), lambda i: case when i % 8 = 0 then ord(substr(doc_id::varchar, (i // 8 + 1)::int, 1)) else 0 end::bigint)"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {bits}), lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))))"
    parts = [f"""
d as (select row_number() over () as r, doc_id, coalesce('+' || source, '') as tree, {row('text')} as leaf,
             case when doc_id is not null and ({crc}) % 5 = 0 then {row(lower)} else {row('text')} end as seen from documents),
a0 as (select tree, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, leaf as h, r from d),
w0 as (select r, tree, i as spot, '' as proof from a0)"""]

    def climb(a: str, w: str, to: str) -> None:
        for k in range(levels):
            parts.append(f"""
{a}n{k} as (select tree, i, h, count(*) over (partition by tree) as n, i // 16 as run,
  coalesce(string_agg(h, '') over (partition by tree, i // 16 order by i rows between unbounded preceding and 1 preceding), '') as l,
  coalesce(string_agg(h, '') over (partition by tree, i // 16 order by i rows between 1 following and unbounded following), '') as g from {a}{k}),
{w}{k + 1} as (select w.r, w.tree, case when n > 1 then spot // 16 else spot end as spot, case when n > 1 then proof || l || g else proof end as proof,
  case when n > 1 then sha256(l || f || g) else f end as f from {w}{k}f w join {a}n{k} on {a}n{k}.tree = w.tree and {a}n{k}.i = w.spot),
{w}{k + 1}f as (select * from {w}{k + 1}),
{a}{k + 1} as (select tree, run as i, case when max(n) > 1 then sha256(string_agg(h, '' order by i)) else any_value(h) end as h from {a}n{k} group by tree, run)""")

    parts.append("\nw0f as (select w0.*, d.seen as f from w0 join d using (r))")
    climb("a", "w", "sub")
    parts.append(f"""
b0 as (select '' as tree, row_number() over (order by tree) - 1 as i, h, tree as name from a{levels}),
v0f as (select w.r, '' as tree, b0.i as spot, w.proof, w.f from w{levels} w join b0 on b0.name = w.tree)""")
    climb("b", "v", "root")
    return "with" + ",".join(parts) + f"""
select d.doc_id, d.leaf, s.h as subroot, t.h as root, sha256(v.proof) as proof_sha256, v.f as folded_root, v.f = t.h as verified
from d join v{levels} v on v.r = d.r join a{levels} s on s.tree = d.tree cross join b{levels} t"""


@query("op12_manifest", manifest_sql())
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 5 divides the unsigned crc32 of the decimal id, the text is lower-cased after the manifest was made."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lowered = F.translate(F.col("text"), url_filter.UPPER, url_filter.LOWER)
    return manifest.audit(read(spark, sf_dir, "documents"), ("doc_id", "source", "lang", "n_chars", "text"), "source", {"text": lowered}, tampered)


@query("op13_langid")
def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))
