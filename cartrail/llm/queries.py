"""The operators as named queries over whole tables, and some of them in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartrail.llm import (
    chunk_bpe,
    fp_tree_search,
    kk_shards,
    language_gru,
    line_dedup,
    maxscore,
    page_crf,
    quality_qda,
    reply_trees,
    simhash_decon,
    simhash_dedup,
    spelling_variants,
    warc_fixity,
)
from cartrail.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

TOP = 5
QUERY_EVERY = 50


def _documents(operator) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def _pages(operator) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "pages"))


def op4_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.scaled(table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(vectors, vectors.filter(f"vec_id % {QUERY_EVERY} = 0"), TOP)


def op9_simhash_decon(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_decon.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", "similarity")


def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_trees.chat_report(table(spark, sf_dir, "conversations"))


def op13_fp_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp_tree_search.ranking(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_merkle_fixity": _pages(warc_fixity.audit_pages),
    "op2_kk_shards": _documents(kk_shards.shard_documents),
    "op3_line_dedup": _documents(lambda docs: line_dedup.repeated_units(docs).drop("_th")),
    "op4_quality_qda": op4_quality_qda,
    "op5_language_gru": _documents(language_gru.language_report),
    "op6_chunk_bpe": _documents(chunk_bpe.encoding_report),
    "op7_maxscore": op7_maxscore,
    "op8_page_crf": _pages(page_crf.main_texts),
    "op9_simhash_decon": op9_simhash_decon,
    "op10_simhash_dedup": _documents(simhash_dedup.near_copy_report),
    "op11_reply_trees": op11_reply_trees,
    "op12_spelling_variants": _documents(spelling_variants.variant_report),
    "op13_fp_tree_search": op13_fp_tree_search,
}

_FIXITY = """
with hashed as (
  select page_id, url, strlen(coalesce(html, '')) as length, coalesce(html, '') as html,
         cast('0x' || substr(md5(cast(page_id as varchar)), 1, 8) as bigint) as h
  from pages),
copied as (
  select page_id, url, length, h,
         sha256(coalesce(url, '') || chr(10) || length || chr(10) || html) as digest,
         case when h % 97 = 1 then substr(html, 1, greatest(length(html) - 1, 0))
              when h % 97 = 2 then '#' || html else html end as other
  from hashed),
rows as (
  select page_id, url, length, digest,
         sha256(coalesce(url, '') || chr(10) || strlen(other) || chr(10) || other) as other,
         h % 101 = 3 as lost, count(*) as copies
  from copied group by all),
placed as (
  select *, cast('0x' || substr(md5(coalesce(cast(page_id as varchar), '~') || '|' || coalesce(url, '~')
                 || '|' || digest), 1, 8) as bigint)
            % (select (count(*) + 1023) // 1024 from pages) as file
  from rows),
laid as (
  select *, coalesce(sum(length * copies) over (partition by file order by page_id, url, digest
            rows between unbounded preceding and 1 preceding), 0)::bigint as "offset"
  from placed)
select page_id, url, length, copies, file, "offset", "offset" // 65536 as range,
       digest as digest_a, case when lost then null else other end as digest_b,
       case when lost then 'missing' else 'changed' end as state
from laid where lost or digest <> other
"""

_LINES = r"""
with split as (
  select doc_id, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as k
  from documents),
placed as (
  select doc_id, k, line,
         coalesce(sum(length(line) + 1) over (partition by doc_id order by k
                  rows between unbounded preceding and 1 preceding), 0) as pos
  from split),
pieces as (
  select doc_id, k, pos, unnest(regexp_extract_all(line, '[^.!?]+[.!?]*|[.!?]+')) as piece,
         generate_subscripts(regexp_extract_all(line, '[^.!?]+[.!?]*|[.!?]+'), 1) as p
  from placed),
cut as (
  select doc_id, piece,
         pos + coalesce(sum(length(piece)) over (partition by doc_id, k order by p
              rows between unbounded preceding and 1 preceding), 0) as start,
         lower(trim(regexp_replace(piece, '\s+', ' ', 'g'))) as unit
  from pieces),
sentences as (select *, len(string_split(unit, ' ')) as words from cut where unit <> ''),
tokens as (
  select doc_id, start, unnest(regexp_extract_all(piece, '\s*\S+(?:\s+$)?')) as token,
         generate_subscripts(regexp_extract_all(piece, '\s*\S+(?:\s+$)?'), 1) as t
  from sentences where words >= 32),
normal as (select *, lower(regexp_replace(token, '\s+', '', 'g')) as word from tokens),
dealt as (
  select *, coalesce(sum(case when md5(word)[1] in ('0', '1') then 1 else 0 end) over (partition by doc_id, start
         order by t rows between unbounded preceding and 1 preceding), 0) as part from normal),
parts as (
  select doc_id, start, part, sum(length(token)) as n_chars, string_agg(word, ' ' order by t) as unit,
         count(*) as words from dealt group by all),
base as (
  select *, row_number() over w as nth, sum(words) over w as upto from (
    select doc_id, start, length(piece) as n_chars, unit, words from sentences where words < 32
    union all
    select doc_id, start + coalesce(sum(n_chars) over (partition by doc_id, start order by part
           rows between unbounded preceding and 1 preceding), 0), n_chars, unit, words from parts)
  window w as (partition by doc_id order by start)),
runs as (
  select a.doc_id, a.nth as low, min(b.nth) as high from base a join base b
  on a.doc_id = b.doc_id and b.nth between a.nth and a.nth + 7 and b.upto - a.upto + a.words >= 8
  where a.words < 8 group by all
  union
  select a.doc_id, max(b.nth), a.nth from base a join base b
  on a.doc_id = b.doc_id and b.nth between a.nth - 7 and a.nth and a.upto - b.upto + b.words >= 8
  where a.words < 8 group by all),
units as (
  select doc_id, start, n_chars, unit from base where words >= 8
  union all
  select r.doc_id, min(start), max(start + n_chars) - min(start), string_agg(unit, ' ' order by nth)
  from runs r join base b on r.doc_id = b.doc_id and b.nth between low and high group by r.doc_id, low, high),
ranked as (
  select *, first_value(doc_id) over w as kept_doc_id, first_value(start) over w as kept_start,
         first_value(start + n_chars) over w as kept_end
  from units window w as (partition by unit order by doc_id, start)),
clipped as (
  select *, case when doc_id = kept_doc_id then greatest(start, kept_end) else start end as first
  from ranked where doc_id <> kept_doc_id or start <> kept_start)
select distinct doc_id, first::int as start, (start + n_chars - first)::int as n_chars, kept_doc_id,
       kept_start::int as kept_start
from clipped where start + n_chars > first
"""

_TOP = """
with vectors as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as vector
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, v.vec_id, list_dot_product(q.vector, v.vector)::bigint as score
  from vectors q join vectors v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0),
ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank,
         vec_id, score
  from scored)
select * from ranked where rank <= 5
"""

_DECON = r"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') as w
  from documents),
item_words as (
  select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') as w
  from benchmark),
items as (
  select item_id, len(w) as n_words,
         list_transform(range(1, len(w) - 3), lambda k: array_to_string(list_slice(w, k, k + 4), ' ')) as shingles
  from item_words where len(w) >= 5),
each as (
  select item_id, len(shingles) as size, unnest(shingles) as s, generate_subscripts(shingles, 1) - 1 as j
  from items),
spots as (select item_id, size, s, min(j) as j, count(*) as weight from each group by all),
spread as (select s, count(*) as df from spots group by s),
ordered as (
  select *, coalesce(sum(weight) over (partition by item_id order by df, j
            rows between unbounded preceding and 1 preceding), 0) as before
  from spots join spread using (s)),
rare as (select * from ordered where before <= floor(size * 0.2 + 1e-9)),
grams as (
  select doc_id, w, unnest(range(0, len(w) - 4)) as pos from words where len(w) >= 5),
windows as (
  select distinct doc_id, items.item_id, n_words, shingles, w,
         greatest(0, least(pos - j, len(w) - n_words)) as start_word
  from grams join rare on rare.s = array_to_string(list_slice(w, pos + 1, pos + 5), ' ')
  join items on items.item_id = rare.item_id),
cut as (
  select doc_id, item_id, n_words, start_word, shingles,
         list_slice(w, start_word + 1, start_word + n_words) as part
  from windows),
both_sides as (
  select *, list_transform(range(1, len(part) - 3), lambda k: array_to_string(list_slice(part, k, k + 4), ' ')) as own
  from cut),
shared as (
  select *, list_sum(list_transform(list_distinct(own), lambda s:
            least(len(list_filter(own, lambda x: x = s)), len(list_filter(shingles, lambda x: x = s)))))::double as both_have
  from both_sides),
compared as (
  select *, both_have / (len(own) + len(shingles) - both_have) as similarity from shared)
select doc_id, item_id, start_word::int as start_word, n_words::int as n_words, round(similarity, 6) as similarity
from compared where similarity >= 0.8
qualify row_number() over (partition by doc_id, item_id order by similarity desc, start_word) = 1
"""

_CHAT = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, turn, role, '<|im_end|><|im_start|>assistant ok'
  from (values (0, 'user'), (1, 'assistant')) as probe(turn, role)),
sized as (
  select *, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
            + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_start|><|im_end|>') + 2 as size
  from turns)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(size)::bigint as formatted_chars
from sized group by conv_id
"""

_VARIANTS = """
with recursive
crc as (
  select list_transform(range(256), lambda n: list_reduce(range(8),
           lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as t),
runs as (
  select coalesce(doc_id::varchar, '') as d,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[A-Za-zÀ-ÿ]+')) as run
  from documents),
counted as (select d, run, count(*) as times, hex(encode(d || ':' || run)) as x from runs where length(run) >= 5 group by d, run),
summed as (
  select run, times, xor(4294967295, list_reduce(
           list_transform(range(length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::bigint),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) as h
  from counted, crc),
spelled as (
  select case when h % 97 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2)
              else run end as word, times
  from summed),
words as (
  select word, sum(times)::bigint as n from spelled group by word having sum(times) >= 3 and length(word) >= 5),
shorter as (
  select word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) as rest
  from (select word, n, unnest(range(1, length(word) + 1)) as p from words)),
pairs as (
  select a.word, b.word as other, b.n as other_n
  from shorter a join shorter b on a.rest = b.rest and a.p = b.p and a.word <> b.word
  union
  select s.word, w.word, w.n from shorter s join words w on s.rest = w.word
  union
  select w.word, s.word, s.n from shorter s join words w on s.rest = w.word),
near as (
  select word, count(*) as n_near, arg_min(other, (-other_n, other)) as best, max(other_n) as best_n
  from pairs group by word),
formed as (
  select word, n, coalesce(n_near, 0) as n_near,
         case when best_n >= 2 * n then best end as form, case when best_n >= 2 * n then best_n end as form_n
  from words left join near using (word)),
chain as (
  select word, word as at from formed
  union
  select chain.word, formed.form from chain join formed on formed.word = chain.at where formed.form is not null),
ends as (
  select chain.word, chain.at as root from chain join formed on formed.word = chain.at where formed.form is null)
select word, form, root, n, n_near, form_n from formed join ends using (word)
"""

_RANKED = r"""
with terms as (
  select rowid as doc, doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as rowid, doc_id, text from documents)),
counts as (select doc, doc_id, term, count(*) as tf from terms group by all),
lengths as (select doc, sum(tf) as n from counts group by doc),
corpus as (select count(*) as docs, sum(n) as length from lengths),
spread as (
  select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w
  from counts, corpus group by term, docs),
asked as (
  select distinct item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
scored as (
  select item_id, doc, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))))::bigint as score
  from asked join counts using (term) join spread using (term) join lengths using (doc), corpus
  group by item_id, doc, doc_id having score > 0),
ranked as (
  select item_id, doc_id, score,
         row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank
  from scored)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""

ORACLE: dict[str, str] = {
    "op1_merkle_fixity": _FIXITY,
    "op3_line_dedup": _LINES,
    "op7_maxscore": _TOP,
    "op9_simhash_decon": _DECON,
    "op11_reply_trees": _CHAT,
    "op12_spelling_variants": _VARIANTS,
    "op13_fp_tree_search": _RANKED,
}
