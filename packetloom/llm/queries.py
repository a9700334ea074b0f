"""Registered queries of this package: thin calls of its operators over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import byte_bpe, decontaminate, dialogue_repair, html_text, jaccard_join, language_id, minhash_dedup, nearest, substring_dedup, suffix_dedup, token_alignment, token_files, url_lists
from packetloom.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return html_text.extract(pages).select("page_id", "text")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as source:
        definition = source.read()
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), definition, 1, path)
    return token_files.token_digests(token_files.read_tokens(spark, path))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _hex(column: str, start: int) -> Column:
    """Two hex digits of a digest as a number."""
    return F.conv(F.substring(column, start, 2), 16, 10).cast("int")


def captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time: the tables hold none, so it follows from page_id over one year."""
    day = (F.col("page_id") * 7919 % 366).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched_at"))


def list_log(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts, domains and first path segments of the pages, by their digests.

    Each listed value is added, removed after 20 to 147 days and, for some, added again.
    """
    host = url_lists.url_host(F.col("url"))
    segment = F.split(url_lists.url_path(F.col("url")), "/")[0]
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    pick = lambda kind, name, value: pages.select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), value.alias("value")).distinct()
    values = pick("host", "block", host).unionByName(pick("domain", "block", domain)).unionByName(pick("prefix", "allow", F.concat(host, F.lit("/"), segment)))
    digest = values.where("value is not null and value != ''").withColumn("d", F.md5(F.concat_ws(":", "kind", "value").cast("binary")))
    listed = digest.where("substring(d, 1, 1) < '8'")
    first = F.date_add(F.lit("2024-01-01").cast("date"), _hex("d", 2))
    gone = F.date_add(first, 20 + _hex("d", 4) % 128)
    again = F.date_add(gone, 10 + _hex("d", 6) % 64)
    event = lambda action, dated: F.struct(F.lit(action).alias("action"), dated.alias("dated"))
    log = F.when(F.substring("d", 8, 1) < "8", F.array(event("add", first), event("remove", gone), event("add", again))).otherwise(F.array(event("add", first), event("remove", gone)))
    return listed.withColumn("e", F.explode(log)).select("list", "kind", "value", "e.action", "e.dated")


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_lists.evaluate(captures(pages), list_log(pages)).select("page_id", "verdict", "entry", "n_active")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_and_decode(spark, table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dialogue_repair.turns(table(spark, sf_dir, "conversations"))
    return dialogue_repair.digests(rows, dialogue_repair.damaged(rows))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as source:
        definition = source.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as source:
        model = source.read()
    return token_alignment.digests(table(spark, sf_dir, "documents"), definition, model)


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_token_files": op2_token_files,
    "op3_decontaminate": op3_decontaminate,
    "op4_url_lists": op4_url_lists,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_nearest": op6_nearest,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_language_id": op10_language_id,
    "op11_minhash_dedup": op11_minhash_dedup,
    "op12_dialogue_repair": op12_dialogue_repair,
    "op13_token_alignment": op13_token_alignment,
}

#: Whole-table SQL twins for DuckDB.
ORACLES: dict[str, str] = {
    "op3_decontaminate": r"""
        with b as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from benchmark),
        bs as (select distinct item_id, least(len(w), 5) k, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') s
               from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) i from b where len(w) > 0)),
        bn as (select item_id, count(*) n from bs group by 1),
        d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents),
        ds as (select distinct doc_id, k, array_to_string(w[i:i + k - 1], ' ') s
               from (select doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) i from d, (select distinct k from bs) where len(w) >= k)),
        hit as (select doc_id, item_id, count(*) c from ds join bs using (k, s) group by 1, 2)
        select doc_id, item_id, n as n_item, c as n_shared, c / n as containment from hit join bn using (item_id) where c >= 0.8 * n - 1e-9
    """,
    "op4_url_lists": r"""
        with p as (
            select page_id, url, date '2024-01-01' + (page_id * 7919 % 366)::int as at,
                   rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '.') as host,
                   split_part(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/', 1) as seg from pages),
        v as (select distinct 'block' list, 'host' kind, host as value from p union select 'block', 'domain', regexp_extract(host, '([^.]+\.[^.]+)$', 1) from p
              union select 'allow', 'prefix', host || '/' || seg from p),
        d as (select *, md5(kind || ':' || value) d from v where value is not null and value <> ''),
        n as (select *, ('0x' || d[2:3])::int a, ('0x' || d[4:5])::int b, ('0x' || d[6:7])::int c from d where d[1] < '8'),
        t as (select list, kind, value, d, date '2024-01-01' + a as f, date '2024-01-01' + a + 20 + b % 128 as g, date '2024-01-01' + a + 20 + b % 128 + 10 + c % 64 as r from n),
        iv as (select list, kind, value, f as since, g as until from t union all select list, kind, value, r, null from t where d[8] < '8'),
        m as (
            select p.page_id, iv.list, iv.kind, iv.value from p join iv on p.at >= iv.since and (iv.until is null or p.at < iv.until) and host <> ''
             and ((iv.kind = 'host' and iv.value = host) or (iv.kind = 'domain' and (host = iv.value or ends_with(host, '.' || iv.value)))
               or (iv.kind = 'prefix' and iv.value = host || '/' || seg))),
        o as (select *, row_number() over (partition by page_id order by length(value) desc, list = 'allow' desc, list desc, kind || ':' || value desc) k,
                     count(*) over (partition by page_id) c from m)
        select p.page_id, coalesce(o.list, 'none') as verdict, o.kind || ':' || o.value as entry, coalesce(c, 0) as n_active
        from p left join o on o.page_id = p.page_id and k = 1
    """,
    "op8_substring_dedup": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
        v as (select doc_id, w[i] as word, i from (select doc_id, w, unnest(generate_series(1, len(w))) i from d)),
        g as (select doc_id, i, array_to_string(w[i:i + 12], ' ') s from (select doc_id, w, unnest(generate_series(1, len(w) - 12)) i from d)),
        m as (select s, min(doc_id) lo from g group by s),
        h as (select doc_id, i from g join m using (s) where lo < doc_id),
        c as (select distinct doc_id, unnest(generate_series(i, i + 12)) i from h),
        k as (select doc_id, string_agg(word, ' ' order by i) t, count(*) n from v anti join c using (doc_id, i) group by doc_id)
        select d.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
        from d left join k using (doc_id)
    """,
    "op12_dialogue_repair": r"""
        with recursive t as (
            select coalesce('=' || conv_id, '') k, conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') x,
                   list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ord(c)::bigint),
                               lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))) crc from conversations),
        d as (select *, (4294967295 - crc) % 20 m from t),
        e as (
            select k, turn, case when m = 4 then 'user' else r end r,
                   case when m = 1 then '' when m = 2 then regexp_replace(x, '[.!?]', '', 'g') else x end x,
                   unnest(range(case when m = 3 then 2 else 1 end)) copy from d where m <> 0),
        o as (select *, row_number() over (partition by k order by turn nulls first, r, md5(x)) i from e),
        f as (
            select k, i, turn, r, x, substr(r, 1, 1) c, row_number() over (partition by k, r, x order by i) > 1 again,
                   not regexp_matches(x, '[^\x20\x09-\x0D]') blank, not regexp_matches(x, '[.!?][\x20\x09-\x0D]*\z') cut from o),
        g as (
            select *, case when blank then 'blank' when again then 'duplicate' when cut then 'truncated' else '' end fault,
                   lag(c) over (partition by k order by i) || c pair from f),
        sums as (
            select k, count_if(fault = 'blank') blank, count_if(fault = 'duplicate') duplicate, count_if(fault = 'truncated') truncated,
                   count_if(pair not in ('su', 'ua', 'au')) illegal,
                   coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, max(i) n from g group by k),
        w as (
            select k, 0::bigint i, {'c': 0, 'a': '', 'o': ''} s0, {'c': 1000000, 'a': '', 'o': ''} s1, {'c': 3, 'a': 'I', 'o': chr(10) || 'user:'} s2,
                   {'c': 6, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'} s3 from sums
            union all
            select k, i, p0, p1, q2, list_min([p3, {'c': q2.c + 3, 'a': q2.a || 'I', 'o': q2.o || chr(10) || 'assistant:'}]) from (
                select k, i, p0, p1, p3, list_min([p2, {'c': p0.c + 3, 'a': p0.a || 'I', 'o': p0.o || chr(10) || 'user:'},
                    {'c': p1.c + 3, 'a': p1.a || 'I', 'o': p1.o || chr(10) || 'user:'}, {'c': p3.c + 3, 'a': p3.a || 'I', 'o': p3.o || chr(10) || 'user:'}]) q2 from (
                    select k, i, {'c': s0.c + 4, 'a': s0.a || 'D', 'o': s0.o} p0,
                        list_min([{'c': s1.c + 4, 'a': s1.a || 'D', 'o': s1.o}, {'c': s0.c + t + case when c = 's' then 0 else 1000000 end, 'a': s0.a || 'K', 'o': s0.o || line}]) p1,
                        list_min([{'c': s2.c + 4, 'a': s2.a || 'D', 'o': s2.o}]
                            || list_transform([s0, s1, s3], lambda s: {'c': s.c + t + case when c = 'u' then 0 else 1000000 end, 'a': s.a || 'K', 'o': s.o || line})
                            || list_transform([s0, s1, s3], lambda s: {'c': s.c + t + 3, 'a': s.a || 'R', 'o': s.o || chr(10) || 'user:' || x})) p2,
                        list_min([{'c': s3.c + 4, 'a': s3.a || 'D', 'o': s3.o}, {'c': s2.c + t + case when c = 'a' then 0 else 1000000 end, 'a': s2.a || 'K', 'o': s2.o || line},
                            {'c': s2.c + t + 3, 'a': s2.a || 'R', 'o': s2.o || chr(10) || 'assistant:' || x}]) p3
                    from (select w.k, g.i, s0, s1, s2, s3, c, x, chr(10) || r || ':' || x line,
                                 case when fault in ('blank', 'duplicate') then 1000000 when fault = 'truncated' then 3 else 0 end t
                          from w join g on g.k = w.k and g.i = w.i + 1)))),
        z as (select k, list_min([s0, s3]) s from w join sums using (k) where w.i = n),
        ids as (select distinct k, conv_id from t)
        select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
               coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(s.c, 0)::bigint as cost,
               coalesce(s.a, '') as audit, sha256(coalesce(substr(s.o, 2), '')) as repaired_sha256
        from ids left join sums using (k) left join z using (k)
    """,
}
