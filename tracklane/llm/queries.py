"""The registered queries of this subpackage and, where SQL can express them, their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.llm import bpe, chat, divergence, minhash, packing, pii, quality, secrets, subspace, tokenfiles, toxicity, trie, vafile
from tracklane.llm.labels import held_out
from tracklane.llm.vocab import public_file
from tracklane.session import settle, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CONTROL_TALK = "</s>[INST] ok [/INST]"


@query("op1_chat_prefixes", sql=rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{CONTROL_TALK}'), (-1, 1, 'assistant', '{CONTROL_TALK}')
), shown as (
  select *, length('<s>[INST]  [/INST] </s>') + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g')) as chars
  from turns
), prefixes as (
  select *, sum(chars) over w as prefix_chars, row_number() over w as k, count(*) over (partition by conv_id) as n
  from shown window w as (partition by conv_id order by turn, role, text rows unbounded preceding)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(case when role = 'assistant' or k = n then prefix_chars else 0 end)::bigint as formatted_chars
from prefixes group by conv_id
""")
def chat_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = [(-1, 0, "user", CONTROL_TALK), (-1, 1, "assistant", CONTROL_TALK)]
    extra = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.expand(turns))


@query("op2_cost_packing")
def cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digest(packing.pack(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json"), added=True))


def packing_digest(packed: DataFrame) -> DataFrame:
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op3_prefix_bpe")
def prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_file("byte_bpe_50k.tiktoken")
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _closure(links: str, nodes: str) -> str:
    """SQL for the smallest id that each of ``nodes`` reaches over ``links`` (a, b), both ways round."""
    return f"""
reached as (
  select id as a, id as b from {nodes}
  union
  select r.a, l.b from reached r join {links} l on l.a = r.b
), lowest as (select a as id, min(b) as component_id from reached group by a)"""


@query("op4_subspace_links", sql=f"""
with recursive usable as (
  select vec_id as id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null and list_bool_or(list_transform(embedding, lambda x: x <> 0))
    and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), links as (
  select p.id as a, q.id as b from usable p join usable q on p.label = q.label and p.id <> q.id and len(p.v) = len(q.v)
  where list_dot_product(p.v, q.v) / (sqrt(list_dot_product(p.v, p.v)) * sqrt(list_dot_product(q.v, q.v))) >= 0.93
), nodes as (select vec_id as id from embeddings), {_closure("links", "nodes")}
select e.vec_id, (select count(*) from links where a = e.vec_id) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join lowest on e.vec_id = lowest.id
""")
def subspace_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace.links(table(spark, sf_dir, "embeddings"))


def _judged(docs: DataFrame, at_least: float) -> DataFrame:
    return docs.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= at_least).cast("int").alias("predicted"))


@query("op5_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))), 0.5)


@query("op6_vafile_topk", sql="""
with ints as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), ranked as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score,
    row_number() over (partition by q.vec_id order by list_dot_product(q.v, c.v) desc, c.vec_id) as rank
  from ints q join ints c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0
)
select query_id, rank, vec_id, score from ranked where rank <= 5
""")
def vafile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op7_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))), 0.3)


@query("op8_markov_secrets")
def markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *map(of_kind, secrets.KINDS[:3]), F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"),
        secrets.as_text(F.col("found")).alias("spans"),
    )


@query("op9_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfiles.write(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json"), folder, added=True)
    return tokenfiles.checksums(spark, folder)


@query("op10_minhash_join", sql=f"""
with recursive words as (
  select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), shingles as (
  select distinct id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) end) as s from words
), sizes as (select id, count(*) as n from shingles group by id),
links as (
  select a, b from (
    select p.id as a, q.id as b, count(*) as both_ from shingles p join shingles q on p.s = q.s and p.id <> q.id group by all
  ) join sizes x on x.id = a join sizes y on y.id = b where 100 * both_ >= 80 * (x.n + y.n - both_)
), nodes as (select doc_id as id from documents), {_closure("links", "nodes")}
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join lowest on d.doc_id = lowest.id left join sizes on d.doc_id = sizes.id
""")
def minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), minhash.NearCopies(words=4))


@query("op11_conversation_trie", sql=r"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null
), bytes as (  -- CRC-32 bit by bit: each byte is put in, then eight shifts (-1)
  select conv_id, count(*) as n, list_concat([4294967295], flatten(list_transform(string_split(conv_id::varchar, ''),
    lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))) as b from turns group by conv_id
), heads as (
  select conv_id, n, conv_id - conv_id % 20 as root,
    xor(list_reduce(b, lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295) % 4 as h from bytes
), leads as (select c.conv_id, c.root, c.h, least(c.h, coalesce(r.n, 0)) as lead from heads c left join heads r on r.conv_id = c.root),
steps as (
  select l.conv_id, t.pos as depth, t.role, t.text from leads l join turns t on t.conv_id = l.root and t.pos <= l.lead
  union all select l.conv_id, t.pos - l.h + l.lead, t.role, t.text from leads l join turns t on t.conv_id = l.conv_id and t.pos > l.h
), keys as (
  select conv_id, depth, text, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
    over (partition by conv_id order by depth rows unbounded preceding)) as k from steps
  union all select conv_id, 0, '', '' from leads
), paths as (select *, lead(k) over (partition by conv_id order by depth) is null as ends from keys),
nodes as (
  select k, depth, min(conv_id) as m, count(*) as n, len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) as words,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends
  from paths group by k, depth
), up as (  -- each node and all that it lies below, itself included, along the path of its smallest member
  select x.k, x.depth, x.n, x.words, p.k as above, p.depth as above_depth from nodes x join paths p on p.conv_id = x.m and p.depth <= x.depth
), parents as (select u.k, u.depth, a.m as parent, a.k as parent_k from up u join nodes a on a.k = u.above and a.depth = u.above_depth where u.above_depth = u.depth - 1),
kids as (select parent_k as k, depth - 1 as depth, count(*) as n_children from parents group by all),
below as (
  select above as k, above_depth as depth, sum((u.n - 1) * u.words) as saved, count(*) filter (where c.k is null) as n_leaves
  from up u left join kids c on c.k = u.k and c.depth = u.depth group by all
)
select x.m as conv_id, x.depth, p.parent as parent_conv_id, x.n as n_convs, coalesce(c.n_children, 0) as n_children, b.n_leaves,
  b.saved::bigint as saved_tokens, x.ends as ends_sha256
from nodes x join below b using (k, depth) left join parents p using (k, depth) left join kids c using (k, depth)
""")
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(*trie.rebuilt(table(spark, sf_dir, "conversations")))


TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


@query("op12_source_divergence", sql=rf"""
with docs as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as doc, translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), found as (select lang, source, doc, unnest(regexp_extract_all(text, '{TERM}')) as term from docs),
counts as (select lang, source, term, count(*)::hugeint as n from found group by all),
kept as (select lang, term, count(*)::hugeint as lang_n from found group by all having count(distinct doc) >= 3),
groups as (select distinct lang, source from docs),
of_lang as (select lang, count(*)::hugeint as v, sum(lang_n)::hugeint as lang_total from kept group by lang),
totals as (
  select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as total from groups g
  left join (select c.* from counts c join kept using (lang, term)) c using (lang, source) group by all
), shares as (
  select t.lang, t.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (t.total + l.v) as p,
    1 + (1000000000::hugeint * (k.lang_n + 1)) // (l.lang_total + l.v) as q
  from totals t join kept k using (lang) join of_lang l using (lang) left join counts c on c.lang = t.lang and c.source = t.source and c.term = k.term
), pairs as (
  select a.lang, a.source, b.source as item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join shares x on x.lang = a.lang and x.source = a.source
  left join shares y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all
), ranked as (
  select lang, source, 'pair' as part, item, coalesce(value, 0)::bigint as value from pairs
  union all select lang, source, 'term', term, (((p - q) * (p - q)) // q)::bigint from shares where n > 0 and p > q
), numbered as (
  select *, row_number() over (partition by lang, source, part order by value desc, item collate "C") as rank from ranked
)
select lang, source, part, item, value, rank from numbered where part = 'pair' or rank <= 200
""")
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_boosted_pii")
def boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = settle(pii.candidates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind_no"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    return pii.select(found, pii.train(found)).select(
        "doc_id", *map(of_kind, range(pii.BASE)), F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"),
        pii.as_text(F.col("spans")).alias("spans"),
    )
