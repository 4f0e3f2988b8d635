"""The queries of the operators over the test tables, and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm import (
    embedding_dedup,
    exact_dedup,
    html_text,
    importance,
    jaccard,
    language_id,
    license_scan,
    mixing,
    packing,
    secret_scan,
    suffix_dedup,
    vector_codes,
    warc,
)
from corpuskit.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Path of the vocabulary that packing counts in."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out(doc_id):
    """Whether a document is kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def language_model(documents):
    return language_id.fit_languages(documents.where(~held_out(F.col("doc_id"))))


def op1_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    found = language_id.identify_languages(documents, language_model(documents))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def op2_license_scan(spark, sf_dir):
    """A row per document and license found."""
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.explode("matches").alias("m")).select("doc_id", "m.*")


def op3_best_fit_packing(spark, sf_dir):
    packed = packing.pack(
        table(spark, sf_dir, "documents"), vocabulary(), keep={"ids_crc32": F.crc32("ids")})
    return packed.withColumnRenamed("id", "doc_id")


def op4_exact_dedup(spark, sf_dir):
    marked = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return marked.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op5_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.link_embeddings(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op6_ngram_jaccard_join(spark, sf_dir):
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n_shingles").cast("bigint").alias("n_shingles"), "component_id")


def op7_mixing(spark, sf_dir):
    """Weights follow the sizes of the sources to the power of 0.7, which lifts small sources."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), temper=0.7)
    return mixed.select(F.col("id").alias("doc_id"), "source", "block", "release", "deadline", "slot", "exact", "before", "n_chars")


def op8_suffix_array_dedup(spark, sf_dir):
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", F.expr("n_bytes - octet_length(kept)").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.octet_length("kept").cast("bigint").alias("n_kept"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op9_secret_scan(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    found = secret_scan.scan_secrets(documents, secret_scan.fit_formats(documents))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.KINDS))
    return found.select(
        F.col("id").alias("doc_id"), *[count(kind) for kind in secret_scan.KINDS],
        F.sha2(F.concat_ws(",", F.transform(base, text)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", text)).alias("spans"))


def op10_warc(spark, sf_dir):
    folder = scratch_path(spark, "warc")
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(\d+)$", 1), F.lit("")).cast("bigint")
    return warc.read_archives(spark, manifest, folder).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"))


def op11_html_extraction(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op12_vector_codes(spark, sf_dir):
    found = vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", "codebooks_sha256")


def op13_importance_resampling(spark, sf_dir):
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds as steps: distances of every part to every entry of its codebook, then means."""
    steps = [f"""
        kept as materialized (
            select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        parts as materialized (
            select vec_id, label, p.range as part, v[p.range * len(v) // {parts} + 1 : (p.range + 1) * len(v) // {parts}] as v
            from kept, range({parts}) p),
        book0 as materialized (
            select part, (row_number() over (partition by part order by vec_id) - 1)::int as entry, v from parts
            qualify row_number() over (partition by part order by vec_id) <= {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
        near{r} as materialized (
            select vec_id, part, min(d * {entries} + entry) as found from (
                select x.vec_id, x.part, e.entry,
                    list_sum(list_transform(list_zip(x.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
                from parts x join book{r} e using (part)) group by all)""")
        if r < rounds:
            steps.append(f"""
        means{r} as (
            select part, entry, list(m order by pos) as v from (
                select part, found % {entries} as entry, pos, floor(sum(c)::double / count(*))::bigint as m from (
                    select n.part, n.found, unnest(v) as c, generate_subscripts(v, 1) as pos
                    from near{r} n join parts using (vec_id, part)) group by all) group by all),
        book{r + 1} as materialized (
            select part, entry, coalesce(m.v, b.v) as v from book{r} b left join means{r} m using (part, entry))""")
    return f"""
        with {",".join(steps)},
        coded as (
            select vec_id, string_agg(printf('%02x', found % {entries}), '' order by part) as code, sum(found // {entries})::bigint as error
            from near{rounds} group by vec_id),
        books as (
            select sha256(string_agg(c::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from (
                select part, entry, unnest(v) as c, generate_subscripts(v, 1) as pos from book{rounds}))
        select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256
        from coded join kept using (vec_id), books"""


QUERIES = {f.__name__: f for f in [
    op1_language_id, op2_license_scan, op3_best_fit_packing, op4_exact_dedup, op5_embedding_near_dedup,
    op6_ngram_jaccard_join, op7_mixing, op8_suffix_array_dedup, op9_secret_scan, op10_warc,
    op11_html_extraction, op12_vector_codes, op13_importance_resampling]}

ORACLE = {
    "op4_exact_dedup": r"""
        with hashed as (
            select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
            from documents)
        select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
            doc_id = min(doc_id) over same as kept, text_sha256
        from hashed window same as (partition by text_sha256)""",
    "op10_warc": """
        with hashed as (
            select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
            from pages),
        firsts as (select *, min(page_id) over (partition by payload_digest) as first from hashed)
        select page_id, payload_bytes, payload_digest,
            case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= 100 and page_id <> first then first end as refers_to
        from firsts""",
    # The article of the given pages by its markup, apart from the densities by which the operator finds it.
    "op11_html_extraction": r"""
        with articles as (
            select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) as article from pages),
        cut as (
            select page_id, url, regexp_split_to_array(regexp_replace(article, '<br>', ' ', 'g'), '</?(?:h1|p)>') as raw
            from articles),
        bare as (select page_id, url, list_transform(raw, lambda b: regexp_replace(b, '<[^>]*>', '', 'g')) as raw from cut),
        decoded as (
            select page_id, url, list_transform(raw, lambda b: replace(replace(replace(replace(replace(
                b, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&')) as raw
            from bare),
        plain as (
            select page_id, url, array_to_string(list_filter(list_transform(
                raw, lambda b: trim(regexp_replace(b, '[\s\x{A0}]+', ' ', 'g'))), lambda b: b <> ''), chr(10) || chr(10)) as text
            from decoded)
        select page_id, url, text, length(text) as n_chars from plain""",
    "op12_vector_codes": _codes_sql(),
    "op13_importance_resampling": r"""
        with table_of_crc as (
            select list(c order by b) as t from (
                select b.range as b, list_reduce(list_prepend(b.range, range(8)),
                    lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as c
                from range(256) b)),
        words_of as (
            select 0 as side, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
            union all
            select 1, item_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
        each as (select side, doc_id, unnest(words) as word from words_of),
        counted as (select side, doc_id, word, count(*) as n from each group by all),
        hashed as (
            select word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
                range(1, octet_length(encode(word)) + 1), lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::bigint)),
                lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 10000 as bucket
            from (select distinct word from counted), table_of_crc),
        buckets as (
            select b.range as bucket, coalesce(sum(n) filter (where side = 0), 0) as s, coalesce(sum(n) filter (where side = 1), 0) as t
            from range(10000) b left join hashed on hashed.bucket = b.range left join counted using (word) group by 1),
        gains as (
            select bucket, floor(1000 * ln(((t + 1)::double * (sum(s) over () + 10000)::double)
                / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from buckets),
        weights as (
            select doc_id, sum(n * gain)::bigint as weight, sum(n)::bigint as n_features
            from counted join hashed using (word) join gains using (bucket) where side = 0 group by doc_id),
        scored as (
            select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
                coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double)
                    / 4294967296::double)))::bigint as score
            from documents left join weights using (doc_id)),
        placed as (
            select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place,
                sum((n_features >= 20)::int) over () as fits
            from scored)
        select doc_id, n_features, weight, score,
            case when n_features >= 20 and place <= 10 * fits // 100 then place end as rank
        from placed""",
}
