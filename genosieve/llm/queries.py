"""The registered queries over the operators of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from genosieve.llm import align, fim, licenses, media, packing, pieces, quality, repeats, simhash, tokenfile, toxicity, url_filter, warc
from genosieve.llm.common import table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = media.write_archives(table(spark, sf_dir, "documents"))
    return media.describe(media.read_archives(spark, folder))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read(spark, tokenfile.write(table(spark, sf_dir, "documents")))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(warc.captures(table(spark, sf_dir, "pages")))
    return warc.index(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every whole text and decodes the ids again; the digest is of the decoded text."""
    found = pieces.decode(pieces.encode(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("text_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.apply_policy(quality.evaluate(table(spark, sf_dir, "documents")))
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failure_bits")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.templates_table(spark))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents")).drop("groups")


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = repeats.remove(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media, op2_simhash, op3_tokens, op4_urls, op5_warc, op6_pieces, op7_quality, op8_licenses, op9_packing, op10_toxicity, op11_fim, op12_align, op13_repeats)} | {"pipeline": _pipeline}


_OP4 = """
with p as (
  select page_id, url, case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end as rest from pages
), q as (
  select page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p
), r(rule_host, rule_path, rule_verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), best as (
  select page_id, arg_max(rule_host || rule_path, length(rule_host) * 10000 + length(rule_path)) as rule,
         arg_max(rule_verdict, length(rule_host) * 10000 + length(rule_path)) as verdict
  from q join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by page_id
)
select q.page_id, q.host, q.path, best.rule, coalesce(best.verdict, 'allow') as verdict from q left join best using (page_id)
"""


_OP5 = """
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, payload, sha1(payload) as h, max(page_id) over (partition by payload) as top from p),
b as (select *, list_transform(range(8), lambda g: ('0x' || substr(h, (5 * g + 1)::int, 5))::int) as five from d)
select page_id, strlen(payload)::bigint as payload_bytes,
       array_to_string(list_transform(five, lambda v: substr(a, (v >> 15) + 1, 1) || substr(a, ((v >> 10) & 31) + 1, 1) || substr(a, ((v >> 5) & 31) + 1, 1) || substr(a, (v & 31) + 1, 1)), '') as payload_digest,
       case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to
from b, (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' as a)
"""

_OP7 = """
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as words from d),
lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1),
windows as (select doc_id, i, list_slice(words, i, i + 7) as win from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from w)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as n from windows) where n > 1),
covered as (select doc_id, count(distinct place) as n_repeat_words from (select doc_id, unnest(range(i, i + 8)) as place from again) group by 1),
m as (
  select doc_id, len(words)::bigint as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper,
         length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as n_letters, (length(t) - length(replace(t, '!!', ''))) // 2 as n_bangs, length(t) - length(replace(t, '|', '')) as n_bars
  from w left join lines using (doc_id) left join covered using (doc_id)
), f as (
  select *, (n_words < 20)::bigint + 2 * (n_repeat_words * 100 > n_words * 30)::bigint + 4 * (n_words > 0 and (word_chars < n_words * 2 or word_chars > n_words * 20))::bigint + 8 * ((n_symbols - n_bars) * 100 > n_words * 25)::bigint
            + 16 * (n_upper * 100 > n_letters * 60)::bigint + 32 * (n_bangs * 100 > n_words * 25)::bigint + 64 * (n_lines > 3 and n_dup_lines * 100 > n_lines * 50)::bigint + 128 * (n_bars * 100 > n_words * 25)::bigint as failure_bits
  from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failure_bits & 3) <> 0 as base_failed, failure_bits = 0 as kept, failure_bits from f
"""

_OP11 = """
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (
  select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as lines, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
         ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d
), c as (select *, len(lines)::bigint as n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as b from u),
p as (
  select *, array_to_string(lines[1:a], '') as prefix, array_to_string(lines[a + 1:b], '') as middle, array_to_string(lines[b + 1:], '') as suffix,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from c
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(t) as restored_sha256
from p
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_urls": _OP4, "op5_warc": _OP5, "op7_quality": _OP7, "op11_fim": _OP11}
