"""The queries of the training-data operators and the SQL that expresses them, where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, shared_path, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out(n: int, rest: int) -> Column:
    """A row without an id is never held out."""
    return F.coalesce(crc_mod("doc_id", n) == rest, F.lit(False)).alias("held_out")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup

    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_tokens, write_tokens

    manifest = write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), shared_path(spark, "tokens"), tokenizer_path())
    return read_tokens(spark, manifest)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_components

    return similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=85)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_of

    found = language_of(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out(4, 2), "lang_pred", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import matches

    return matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .lattice_lm import lattice_scores

    return lattice_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality_scores

    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import digests

    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import ranked

    return ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), top=50)


def op13_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .odd_sketch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=85)


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_token_files, op3_ngram_jaccard, op4_language_id, op5_decontaminate, op6_source_mix, op7_html_text, op8_lattice_lm, op9_quality_classifier, op10_quality_rules, op11_fill_middle, op12_lexical_search, op13_odd_sketches)}
#: The other operators learn, hash or simulate beyond SQL; tests compare them with brute-force versions.
_LINKED = r"""
    with recursive words as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
    sets as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < {width} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' ')) end) as g from words),
    sizes as (select doc_id, cast(len(g) as bigint) as n from sets),
    each as (select doc_id, unnest(g) as g from sets),
    pairs as (select a.doc_id as a, b.doc_id as b, count(*) as both_have from each a join each b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
    links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * both_have >= 85 * (x.n + y.n - both_have)),
    edges as (select a, b from links union all select b, a from links),
    reach as (select doc_id, doc_id as c from sizes union select reach.doc_id, edges.b from reach join edges on edges.a = reach.c)
    select s.doc_id, s.n as n_shingles, min(r.c) as component_id{more} from sizes s join reach r using (doc_id) group by s.doc_id, s.n"""
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard": _LINKED.format(width=4, more=""),
    "op13_odd_sketches": _LINKED.format(width=3, more=", min(r.c) = s.doc_id as kept"),
    "op11_fill_middle": r"""
    with units as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u, sha256('42:' || doc_id) as h from documents),
    drawn as (select *, len(u) as n, [cast('0x' || substr(h, 8 * k + 1, 8) as bigint) for k in range(4)] as r from units),
    placed as (select *, least(r[1] % (n + 1), r[2] % (n + 1)) as a, greatest(r[1] % (n + 1), r[2] % (n + 1)) as b from drawn),
    cut as (select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or r[3] % 100 >= 50 then 'plain' when r[4] % 100 < 80 then 'spm' else 'psm' end as form,
        array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from placed)
    select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
        sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from cut""",
    "op12_lexical_search": r"""
    with cut as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
    docs as (select row_number() over () as row_id, doc_id, t, len(t) as n from cut where len(t) > 0),
    corpus as (select count(*) as big_n, cast(sum(n) as bigint) as big_l from docs),
    wanted as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
    each as (select row_id, unnest(t) as term from docs),
    tf as (select row_id, term, count(*) as tf from each where term in (select term from wanted) group by row_id, term),
    df as (select term, count(*) as df from tf group by term),
    w as (select term, cast(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) as bigint) as w from df, corpus),
    gain as (select tf.row_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l)))) as g from tf join w using (term) join docs using (row_id), corpus),
    scores as (select item_id, row_id, cast(sum(g) as bigint) as score from wanted join gain using (term) group by item_id, row_id),
    placed as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from scores join docs using (row_id) where score > 0)
    select * from placed where rank <= 50""",
}
