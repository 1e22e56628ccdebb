"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from . import byte_bpe, common, decontaminate, embedding_whitening, exact_dedup, sharding, simhash, spelling, suffix_dedup, token_counts, token_output, toxicity, url_filter, warc


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(common.table(spark, sf_dir, "documents"))


def op1_toxicity(spark, sf_dir):
    return toxicity.toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op2_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(common.table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, out=byte_bpe.DIGESTS)


def op4_token_counts(spark, sf_dir):
    return token_counts.token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_token_output(spark, sf_dir):
    return token_output.token_output(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(common.table(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    return simhash.near_dedup(common.table(spark, sf_dir, "documents"))


#: Fixed by the query's contract: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(common.table(spark, sf_dir, "pages"), rules)


def op9_decontamination(spark, sf_dir):
    return decontaminate.contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op10_warc(spark, sf_dir):
    return warc.round_trip(common.table(spark, sf_dir, "pages"))


def op11_spelling(spark, sf_dir):
    return spelling.spelling_variants(common.table(spark, sf_dir, "documents"))


def op12_whitening(spark, sf_dir):
    return embedding_whitening.whiten(common.table(spark, sf_dir, "embeddings"))


def op13_sharding(spark, sf_dir):
    return sharding.assign(common.table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_token_output": op5_token_output,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_simhash": op7_simhash,
    "op8_url_filter": op8_url_filter,
    "op9_decontamination": op9_decontamination,
    "op10_warc": op10_warc,
    "op11_spelling": op11_spelling,
    "op12_whitening": op12_whitening,
    "op13_sharding": op13_sharding,
}

ORACLE = {
    "op8_url_filter": r"""
        with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                          regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') as path from pages),
             r(h, q, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
             u as (select distinct host, path from p),
             f as (select host, path, h || q as rule, v,
                          row_number() over (partition by host, path order by length(h || q) desc, length(h) desc) as n
                   from u join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q))
        select page_id, p.host as host, p.path as path, rule, coalesce(v, 'allow') as verdict
        from p left join (select * from f where n = 1) f on p.host = f.host and p.path = f.path""",
    "op3_exact_dedup": r"""
        with n as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as h from documents),
             g as (select h, min(doc_id) as keep_id, count(*) as group_size from n group by h)
        select n.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, n.doc_id = g.keep_id as kept, n.h as text_sha256
        from n join g using (h)""",
    "op9_decontamination": r"""
        with d as (select row_number() over () as r, doc_id,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
                   from documents),
             b as (select item_id,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
                   from benchmark),
             s as (select distinct least(10, len(w)) as k from b where len(w) > 0),
             bw as (select item_id, k, array_to_string(w[i + 1 : i + k], ' ') as x
                    from (select item_id, w, least(10, len(w)) as k, unnest(range(0, len(w) - least(10, len(w)) + 1)) as i from b where len(w) > 0)),
             dw as (select r, k, i, array_to_string(w[i + 1 : i + k], ' ') as x
                    from (select r, w, k, unnest(range(0, len(w) - k + 1)) as i from d, s where len(w) >= k)),
             hit as (select distinct r, i, dw.k, item_id from dw join bw on dw.x = bw.x and dw.k = bw.k),
             pos as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from hit) group by r),
             its as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items
                     from hit group by r)
        select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
               cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 as contaminated
        from d left join pos using (r) left join its using (r)""",
}
