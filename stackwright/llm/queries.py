"""One query per corpus operator, with production parameters, over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.llm import bpe, decontam, exact, fillmiddle, langid, minhash, pii, quality, sentencepieces, substrings, tokencount, tokenfile
from stackwright.llm.common import LOWER, UPPER, crc_mod


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    profiles = langid.learn(docs.select("doc_id", "text", "lang"), ~held_out)
    return langid.predict(docs, profiles, "doc_id", held_out.alias("held_out"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(_docs(spark, sf_dir), tokenizer_path())
    return coded.select(
        "doc_id", "n_tokens",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(_docs(spark, sf_dir), tokenizer_path(), end_id=2)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    rules = quality.learn(docs, labels, ~held_out)
    return quality.score(docs, rules).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(_docs(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.dedup(_docs(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(_docs(spark, sf_dir), size=4)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_docs(spark, sf_dir), tokenizer_path(), limit=512)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_docs(spark, sf_dir))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fillmiddle.fill_in_middle(_docs(spark, sf_dir))
    hashes = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = sentencepieces.round_trip(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), packed=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


#: Units of the fill-in-middle operator, for the SQL below (fixed value).
UNIT = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+"
QUERIES = {f.__name__: f for f in (op1_language_id, op2_bpe_codec, op3_token_files, op4_quality, op5_substring_dedup, op6_exact_dedup, op7_near_dedup, op8_token_counts, op9_decontaminate, op10_personal_data, op11_fill_in_middle, op12_sentencepiece)}
ORACLES: dict[str, str] = {
    "op6_exact_dedup": f"""
        with t as (select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) as text_sha256 from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id is not distinct from max(doc_id) over w as kept, text_sha256
        from t window w as (partition by text_sha256)""",
    "op11_fill_in_middle": f"""
        with t as (select doc_id, coalesce(text, '') as x, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
        u as (select doc_id, x, regexp_extract_all(x, '{UNIT}') as w,
                     [('0x' || h[8 * k + 1 : 8 * k + 8])::ubigint::bigint for k in range(4)] as h from t),
        c as (select *, len(w)::bigint as n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1))::bigint as a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1))::bigint as b,
                     case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h[3] % 100 >= 50 then 'plain'
                          when h[4] % 100 < 80 then 'spm' else 'psm' end as form from u),
        p as (select *, array_to_string(w[1 : a], '') as prefix, array_to_string(w[a + 1 : b], '') as middle, array_to_string(w[b + 1 : n], '') as suffix from c)
        select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
               sha256(case form when 'plain' then x when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(x) as restored_sha256
        from p""",
}
