"""The registered queries of the training-data operators, at production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash_dedup import fingerprint_hex, near_duplicate_groups

    found = near_duplicate_groups(_table(spark, sf_dir, "documents"), width=3, bits=2)
    return found.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.langid import fit, predicted
    from tidemark.llm.shared import crc_of_id
    from tidemark.llm.tokens import default_path

    docs = _table(spark, sf_dir, "documents")
    remainder = crc_of_id(F.col("doc_id")) % 3
    model = fit(docs.where(remainder != 1), default_path("piece_bpe_32k.model"))
    found = docs.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), predicted(F.col("text"), model, spark).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.exact_dedup import equal_text_groups

    found = equal_text_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sentencepiece_lattice import encode
    from tidemark.llm.tokens import default_path

    found = encode(_table(spark, sf_dir, "documents"), default_path("piece_bpe_32k.model"), with_ids=False)
    return found.select("doc_id", "n_ids", "ids_crc32", "round_trip")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack_documents
    from tidemark.llm.tokens import default_path

    return pack_documents(_table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"), room=4096)


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.licences import licences

    docs = _table(spark, sf_dir, "documents")
    # documents have no paths: a source is a tree of one to three levels, and every fiftieth file is named as a licence file
    folder = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    depth = F.pmod(F.col("doc_id"), F.lit(3))
    name = F.when(F.pmod(F.col("doc_id"), F.lit(50)) == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", folder(1000), F.when(depth > 0, folder(100)), F.when(depth > 1, folder(10)), name)
    return licences(docs.withColumn("path", path))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.line_dedup import duplicate_lines

    found = duplicate_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("dropped").cast("bigint").alias("n_dropped"), "dropped")


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.html_main import main_text

    found = _table(spark, sf_dir, "pages").select("page_id", "url", main_text(F.col("html"), spark).alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.lm_scoring import score
    from tidemark.llm.shared import crc_of_id

    held = crc_of_id(F.col("doc_id")) % 5 == 1
    found = score(_table(spark, sf_dir, "documents"), held)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ann import search

    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.divergence import audit

    return audit(_table(spark, sf_dir, "documents"), least_docs=10, top=10)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.spelling import variant_groups

    return variant_groups(_table(spark, sf_dir, "documents"), factor=10)


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.cap_filters import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), least=0.93)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_licence_scan": op6_licence_scan,
    "op7_line_dedup": op7_line_dedup,
    "op8_html_main_text": op8_html_main_text,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_source_divergence": op11_source_divergence,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}

SQL: dict[str, str] = {
    "op2_exact_dedup": """
        with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        g as (select t, max(doc_id) as keep_id, count(*) as group_size from n group by t)
        select doc_id, keep_id, group_size, row_number() over (partition by n.t order by doc_id desc nulls last) = 1 as kept, sha256(n.t) as text_sha256
        from n join g on n.t = g.t
    """,
    "op11_source_divergence": r"""
        with d as (select row_number() over () as id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
        t as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+')) as term from d),
        kept as (select lang, term, count(*) as n from t group by all having count(distinct id) >= 10),
        c as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by all),
        g as (select distinct lang, source from d),
        v as (select lang, count(*) as v, sum(n) as total from kept group by lang),
        gv as (select lang, source, v, (select coalesce(sum(n), 0) from c where c.lang = g.lang and c.source = g.source) as total from g join v using (lang)),
        p as (select gv.lang, gv.source, kept.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (gv.total + 2 * v) as p,
                1 + (1000000000::hugeint * (kept.n + 2)) // ((select total from v where v.lang = gv.lang) + 2 * v) as q
            from gv join kept using (lang) left join c on c.lang = gv.lang and c.source = gv.source and c.term = kept.term),
        pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
            left join (select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s
                on s.lang = a.lang and s.source = a.source and s.item = b.source),
        both_parts as (select lang, source, 'pair' as part, item, value::bigint as value from pairs
            union all select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from p where n > 0 and p > q)
        select * from (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from both_parts) where part = 'pair' or rank <= 10
    """,
    "op12_spelling_variants": r"""
        with recursive steps as (select i, 0 as k, i as c from range(256) r(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where k < 8),
        crc_table as (select i, c, printf('%02X', i) as hx from steps where k = 8),
        found as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
        runs as (select row_number() over () as id, run, n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as h from (select doc_id, run, count(*) as n from found where length(run) >= 7 group by all)),
        crc(id, k, c) as (select id, 0, 4294967295::bigint from runs
            union all select r.id, k + 1, xor(t.c, crc.c >> 8) from crc join runs r on r.id = crc.id and 2 * k < length(h) join crc_table b on b.hx = substr(h, 2 * k + 1, 2) join crc_table t on t.i = xor(crc.c, b.i) & 255),
        sums as (select id, xor(max_by(c, k), 4294967295) as h from crc group by id),
        spoilt as (select case when s.h % 31 = 0 then substr(run, 1, (s.h % length(run))::int) || substr(run, (s.h % length(run))::int + 2) else run end as word, n from runs join sums s using (id)),
        words as (select word, sum(n)::bigint as n from spoilt where length(word) >= 7 group by word having sum(n) >= 2),
        cut as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as d from (select word, n, unnest(range(length(word))) as i from words)),
        near as (select distinct a.word, b.word as other, b.n from cut a join cut b on a.d = b.d and a.i = b.i and a.word <> b.word
            union select c.word, w.word, w.n from cut c join words w on c.d = w.word
            union select w.word, c.word, c.n from cut c join words w on c.d = w.word),
        best as (select word, count(*) as n_near, max(n) as best_n from near group by word),
        formed as (select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.best_n >= 10 * w.n then (select min(other) from near x where x.word = w.word and x.n = b.best_n) end as form, case when b.best_n >= 10 * w.n then b.best_n end as form_n from words w left join best b using (word)),
        follow(word, root, k) as (select word, word, 0 from formed union all select f.word, s.form, k + 1 from follow f join formed s on s.word = f.root and s.form is not null)
        select f.word, f.form, r.root, f.n, f.n_near, f.form_n from formed f join (select word, max_by(root, k) as root from follow group by word) r using (word)
    """,
    "op13_embedding_near_dedup": """
        with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where vec_id is not null and label is not null and len(embedding) > 0
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(vec_id, seen) as (select vec_id, vec_id from embeddings union select r.vec_id, l.b from reach r join links l on r.seen = l.a),
        roots as (select vec_id, min(seen) as component_id from reach group by vec_id)
        select vec_id, (select count(*) from links l where l.a = vec_id) as n_links, component_id, vec_id = component_id as kept from roots
    """,
}
