"""The registered queries of this subpackage, with DuckDB forms where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm import (exact_dedup, fingerprints, html_text, jaccard_join, language, line_dedup, packing, pieces,
                        prefix_trie, sharding, toxicity, url_lists, whitening)
from laurel.llm.tables import table

ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

DEDUP_SQL = """
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
           from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept,
  sha256(t) as text_sha256
from n window g as (partition by t)"""

URL_SQL = r"""
with captures as (
  select page_id, date '2024-01-01' + cast(page_id % 366 as integer) as fetched,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') as host
  from pages),
changes as (
  select case when page_id % 2 = 0 then host else array_to_string(string_split(host, '.')[-2:], '.') end as entry,
    date '2024-01-01' + cast((page_id * 7 + 3) % 366 as integer) as day, page_id as seq,
    case page_id % 5 when 0 then 'block' when 1 then 'block' when 2 then 'allow' else 'remove' end as action
  from captures where host is not null),
daily as (select entry, day, arg_max(action, seq) as action from changes group by all),
periods as (
  select entry, day as since, lead(day) over (partition by entry order by day) as until, action from daily),
named as (
  select page_id, fetched, unnest(list_transform(range(1, len(string_split(host, '.')) + 1),
    lambda i: array_to_string(string_split(host, '.')[i:], '.'))) as entry
  from captures where host is not null),
best as (
  select n.page_id, p.entry, p.since, p.action
  from named n join periods p on p.entry = n.entry and n.fetched >= p.since and (p.until is null or n.fetched < p.until)
  where p.action <> 'remove'
  qualify row_number() over (partition by n.page_id order by length(p.entry) desc) = 1)
select c.page_id, c.host, c.fetched, b.entry, b.since, coalesce(b.action, 'none') as verdict
from captures c left join best b using (page_id)"""

LINE_SQL = """
with rows as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from rows),
keys as (
  select *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key
  from lines),
shared as (
  select key, max(doc_id) as keeper from keys where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (select k.*, s.key is not null and k.doc_id is distinct from s.keeper as gone from keys k left join shared s using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by r, doc_id"""

TRIE_SQL = """
with own as (
  select conv_id, coalesce(text, '') as text,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as token,
    row_number() over (partition by conv_id order by turn nulls first, token) as rn
  from conversations where conv_id is not null),
ids as (
  select distinct conv_id, conv_id - conv_id % 100 as family,
    xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) % 6 as h
  from own),
rebuilt as (
  select i.conv_id, 0 as part, o.rn, o.token, o.text from ids i join own o on o.conv_id = i.family and o.rn <= i.h
  union all
  select i.conv_id, 1, o.rn, o.token, o.text from ids i join own o on o.conv_id = i.conv_id and o.rn > i.h),
placed as (
  select conv_id, length(text) as chars, row_number() over w as depth,
    md5(string_agg(token, '') over w) as path, count(*) over (partition by conv_id) as turns
  from rebuilt window w as (partition by conv_id order by part, rn)),
members as (
  select conv_id, depth, path, chars, turns = depth as ends from placed
  union all
  select i.conv_id, 0, '', 0, not exists (select 1 from placed p where p.conv_id = i.conv_id) from ids i),
nodes as (
  select depth, path, min(conv_id) as conv_id, count(*) as n_convs, max(chars) as chars,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from members group by depth, path),
placed_nodes as (
  select n.*, p.path as above from nodes n left join members p on p.conv_id = n.conv_id and p.depth = n.depth - 1),
children as (select depth - 1 as depth, above as path, count(*) as n_children from placed_nodes where depth > 0 group by all),
full_nodes as (
  select n.*, coalesce(c.n_children, 0) as n_children from placed_nodes n left join children c on c.depth = n.depth and c.path = n.path),
sums as (
  select m.depth, m.path, count(*) filter (where n_children = 0) as n_leaves, sum((n_convs - 1) * n.chars)::bigint as saved_tokens
  from full_nodes n join members m on m.conv_id = n.conv_id and m.depth <= n.depth group by m.depth, m.path)
select n.conv_id, n.depth, a.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
from full_nodes n join sums s on s.depth = n.depth and s.path = n.path
left join nodes a on a.depth = n.depth - 1 and a.path = n.above"""


def query(name: str, sql: str | None = None):
    def add(fn):
        ENTRIES[name] = (fn, sql)
        return fn

    return add


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_byte_shards")
def byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards_by_bytes(table(spark, sf_dir, "documents"), 8)


@query("op3_content_sort", DEDUP_SQL)
def content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_sort(table(spark, sf_dir, "documents"))


@query("op4_least_squares_packing")
def least_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op6_set_relation_join")
def set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_classes(table(spark, sf_dir, "documents"))


@query("op2_boosted_toxicity")
def boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op9_string_kernel")
def string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identified(docs, language.fit(docs))


@query("op10_block_tree")
def block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


@query("op5_improbable_features")
def improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprints.fingerprints(docs, fingerprints.rarity(docs))


@query("op8_temporal_lists", URL_SQL)
def temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture, every page also as a dated change of its host's or domain's list entry."""
    start = F.lit("2024-01-01").cast("date")
    captures = (table(spark, sf_dir, "pages").select("page_id", "url")
                .withColumn("fetched", F.date_add(start, (F.col("page_id") % 366).cast("int"))))
    hosts = captures.withColumn("host", url_lists.host_of("url"))
    action = F.element_at(F.array(*map(F.lit, ("block", "block", "allow", "remove", "remove"))),
                          (F.col("page_id") % 5 + 1).cast("int"))
    changes = hosts.select(
        F.when(F.col("page_id") % 2 == 0, F.col("host")).otherwise(url_lists.registered_domain("host")).alias("entry"),
        F.date_add(start, ((F.col("page_id") * 7 + 3) % 366).cast("int")).alias("day"),
        F.col("page_id").alias("seq"), action.alias("action"))
    return url_lists.verdicts(captures, changes)


@query("op7_piece_lattice")
def piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, the SHA-256 of the text that they decode to, and whether that is the document's own text."""
    docs = table(spark, sf_dir, "documents")
    model = pieces.PieceTable.load(tokenizer_file("piece_bpe_32k.model"))
    found = pieces.encode(docs, model).withColumn("decoded_sha256", F.sha2(pieces.decoded(F.col("ids"), model), 256))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "decoded_sha256",
                        (F.col("decoded_sha256") == F.col("text_sha256")).alias("same_text"))


@query("op11_line_dedup", LINE_SQL)
def shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op12_splitter_skeleton", TRIE_SQL)
def splitter_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))
    return trie.withColumn("depth", F.col("depth").cast("long"))


@query("op13_jacobi_davidson")
def jacobi_davidson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.usable(table(spark, sf_dir, "embeddings"))
    return whitening.whitened(rows, whitening.fit_whitening(rows))
