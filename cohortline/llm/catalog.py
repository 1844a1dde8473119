"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, langid, lm, ngramjoin, packing, quality, rowpattern, tokencount, topk, toxicity, warc
from .simhash import near_duplicates


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items, and which."""
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for the text of every document whose id is divisible by 50."""
    docs = read(spark, sf_dir, "documents")
    return topk.search(docs, docs.where("doc_id % 50 = 0"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, before and after private words are masked."""
    return tokencount.count(read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality votes for all documents."""
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, read back and assembled."""
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores and offending spans of all documents."""
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed in sequences of 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents by a model of nine tenths of them."""
    return lm.score(read(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    return langid.identify(read(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in all documents."""
    return alignment.align(read(spark, sf_dir, "documents"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents linked by a Jaccard of 0.85 or more of their four-word shingles."""
    return ngramjoin.classes(read(spark, sf_dir, "documents"))


def op13_row_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of a fall and a rise, or several, in each client's clicks."""
    found = rowpattern.matches(read(spark, sf_dir, "clicks"))
    return found.select("client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", F.sha2("labels", 256).alias("labels_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_decontamination, op3_topk, op4_token_counts, op5_quality, op6_warc, op7_toxicity, op8_packing, op9_lm_scores, op10_language, op11_alignment, op12_ngram_join, op13_row_pattern)
    return {f.__name__: f for f in found}


def _grams(key: str, table: str) -> str:
    """SQL for the distinct five-word shingles of a table's texts."""
    return f"""
select distinct {key}, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g
from (select {key}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from {table})"""


OP2_SQL = f"""
with dg as ({_grams("doc_id", "documents")}), ig as ({_grams("item_id", "benchmark")}),
n as (select item_id, count(*) as shingles from ig group by item_id)
select doc_id, item_id, count(*) as shared, shingles, count(*)::double / shingles as containment
from dg join ig using (g) join n using (item_id)
group by doc_id, item_id, shingles having count(*) >= ceil(shingles * 0.8 - 1e-9)
"""


OP3_SQL = r"""
with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as t from documents),
tf as (select doc_id, t, count(*) as tf from w group by doc_id, t),
size as (select d.doc_id, coalesce(sum(tf), 0) as size from documents d left join tf using (doc_id) group by d.doc_id),
total as (select count(*) as n, avg(size) as mean from size),
idf as (select t, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf, total group by t, n),
s as (select q.doc_id as query_id, tf.doc_id, round(sum(idf * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * size.size / total.mean))), 6) as score
  from tf q join tf using (t) join idf using (t) join size on size.doc_id = tf.doc_id, total where q.doc_id % 50 = 0 group by all)
select query_id, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank, doc_id, score
from s qualify rank <= 10
"""


OP6_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as payload_digest from p),
lead as (select payload_digest, payload_bytes, max(page_id) as leader from d where payload_bytes >= 1000 group by all)
select page_id, payload_bytes, payload_digest, case when leader <> page_id then 'revisit' else 'response' end as record_type,
  case when leader <> page_id then leader end as refers_to
from d left join lead using (payload_digest, payload_bytes)
"""


OP12_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
n as (select d.doc_id, count(g) as n from documents d left join s using (doc_id) group by d.doc_id),
e as (select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  where 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r as (select doc_id, doc_id as other from n union select r.doc_id, e.b from r join e on r.other = e.a)
select doc_id, n as n_shingles, component_id from n join (select doc_id, min(other) as component_id from r group by doc_id) using (doc_id)
"""


OP13_SQL = """
with r as (select distinct * from clicks where client_id is not null and ts is not null),
o as (select *, cast(floor(100 * value + 0.5) as bigint) as cents, row_number() over (partition by client_id order by ts, click_id) as k from r),
l as (select *, lag(cents) over w as before, coalesce(ts - lag(ts) over w <= interval 30 minutes, false) as close from o window w as (partition by client_id order by k)),
c as (select *, coalesce(kind = 'click', false) as click, case when close and kind <> 'error' then case when cents < before then 'D' when cents > before then 'U' end end as letter from l),
g as (select *, sum(case when letter is null then 1 else 0 end) over (partition by client_id order by k) as run from c),
runs as (select client_id, run, min(k) as k0, list(coalesce(letter, '-') order by k) as letters, list(cents order by k) as cents, list(click order by k) as click, list(click_id order by k) as ids from g group by all having len(letters) > 2),
p as (select client_id, run - 1 as run, cents as p_cents, click_id as p_id from g where letter is null and close and click and cents is not null),
s as (select runs.*, p_cents, p_id, unnest(range(1, len(letters)::bigint)) as i from runs left join p using (client_id, run)),
m as (select *, regexp_extract(array_to_string(letters[i + 1:], ''), '^(D+U+)+') as body from s where cents[i] is not null and letters[i + 1] = 'D'),
e as (select *, i + length(body) as j from m where body <> ''),
f as (select *, case when j < len(letters) then click[j + 1] and cents[j + 1] >= cents[i] else coalesce(p_cents >= cents[i], false) end as more, j = len(letters) as whole from e)
select client_id, row_number() over (partition by client_id order by k0 + i) as match_no, ids[i] as first_id, case when more then case when whole then p_id else ids[j + 1] end else ids[j] end as last_id,
  cast(1 + length(body) + more::int as bigint) as n_rows, cast(list_sum(cents[i:j]) + case when more then case when whole then p_cents else cents[j + 1] end else 0 end as bigint) as sum_cents,
  sha256('A' || body || case when more then 'P' else '' end) as labels_sha256
from f
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3_SQL, "op2_decontamination": OP2_SQL, "op6_warc": OP6_SQL, "op12_ngram_join": OP12_SQL, "op13_row_pattern": OP13_SQL}
