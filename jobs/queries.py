"""The jobs as registered queries: each runs twice into one new folder and returns what then stands there."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from jobs import prepare_stack, screen_texts
from stackwright.plans.registry import query
from stackwright.staging import fresh_path


def config(job: str) -> dict:
    return json.loads(Path(__file__).with_name(f"{job}.json").read_text())


@query("""
    with p as (select vec_id, label, i as pixel, i // 8 - 4 as x, i % 8 - 4 as y, embedding[i + 1]::double as v from embeddings, (select unnest(range(64)) as i)),
    f as (select vec_id, label, pixel, x*x + y*y > 6.0516 as corner, v - avg(v) filter (x*x + y*y > 6.0516) over (partition by vec_id) as v from p),
    s as (select 1.4826 * median(abs(v)) filter (corner) as std from f),
    o as (select vec_id, row_number() over (order by ((vec_id + 17) * 2654435761) % 4294967296, vec_id) - 1 as place, count(*) over () - 100 as n from embeddings),
    b as (select vec_id, place, place - 100 as q, n, greatest(1, n // 50) as k from o),
    c as (select *, n // k as base, (k - n % k) * (n // k) as small from b)
    select vec_id, label, pixel, round(v / std, 6) as v, place, case when place < 100 then 'test' else 'train' end as split,
           case when place < 100 then 0 when q < small then q // base else k - n % k + (q - small) // (base + 1) end as batch
    from f join c using (vec_id), s""")
def job1_prepare_stack(spark, d):
    """One row per pixel of the prepared images."""
    output = fresh_path(spark, "job1")
    for _ in range(2):
        prepare_stack.run(spark, f"{d}/embeddings.parquet", output, **config("prepare_stack"))
    rows = prepare_stack.prepared(spark, output).select("vec_id", "label", "place", "split", "batch", F.posexplode("image").alias("pixel", "v"))
    return rows.withColumn("v", F.round("v", 6))


@query(r"""
    with r as (select doc_id, lang, source, length(coalesce(text, '')) as n_chars, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n_words,
                      case when coalesce(text, '') = '' then 0 else length(text) - length(replace(text, chr(10), '')) + case when text like '%' || chr(10) then 0 else 1 end end as n_lines,
                      md5(coalesce(text, '')) as text_md5 from documents),
    m as (select lang as g, median(n_words) as mean from r group by 1),
    b as (select g, mean, 1.4826 * median(abs(n_words - mean)) as std from r join m on lang is not distinct from g group by 1, 2)
    select doc_id, lang, source, n_chars, n_words, n_lines, text_md5, mean, round(std, 6) as std, abs(n_words - mean) > 3 * std as unusual
    from r join b on lang is not distinct from g""")
def job2_screen_texts(spark, d):
    output = fresh_path(spark, "job2")
    for _ in range(2):
        # the last letter in brackets makes a pattern of the name, which streams take for a file as for a folder
        screen_texts.run(spark, f"{d}/documents.parque[t]", f"{output}/out", f"{output}/log", **config("screen_texts"))
    return screen_texts.screened(spark, f"{output}/out").drop("part", "batch").withColumn("std", F.round("std", 6))
