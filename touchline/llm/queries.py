"""The registered queries of this package: each runs its operator over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import alignment, annforest, capfilters, divergence, fmdedup, html, langid, mixing, packing, quality, simhash, suffixdedup, toxicity
from touchline.llm.runtime import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annforest.search(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digests(table(spark, sf_dir, "documents"), text=True)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), vocabulary()))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.components(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.format_string("%016x", "fingerprint").alias("fingerprint"), "component_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmdedup.digests(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.clusters(table(spark, sf_dir, "embeddings"))


QUERIES = (op1_html_extraction, op2_ann_forest, op3_toxicity, op4_suffix_dedup, op5_language_id, op6_quality_rules, op7_packing, op8_mixing, op9_simhash, op10_substring_dedup, op11_tokenizer_alignment, op12_source_divergence, op13_cap_filters)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (SELECT id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8) q),
twice AS (SELECT id, g FROM win GROUP BY id, g HAVING count(*) > 1),
rep AS (SELECT id, count(DISTINCT x) AS n FROM (SELECT win.id, unnest(range(i, i + 8)) AS x FROM win JOIN twice USING (id, g)) q GROUP BY id),
line AS (SELECT id, doc_id, source, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT *, unnest(string_split(text, chr(10))) AS l FROM d) q),
real AS (SELECT *, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM line WHERE len(lw) > 0),
dup AS (SELECT id, count(*) - count(DISTINCT l) AS n FROM real GROUP BY id),
host AS (SELECT source, greatest(10.0, 0.005 * count(*)) AS most FROM d GROUP BY source),
often AS (SELECT o.source, norm FROM (SELECT source, norm, count(DISTINCT id) AS docs FROM real GROUP BY source, norm) o JOIN host h ON o.source IS NOT DISTINCT FROM h.source WHERE docs > most),
lost AS (SELECT id, sum(len(lw)) AS n FROM real r JOIN often o ON r.source IS NOT DISTINCT FROM o.source AND r.norm = o.norm GROUP BY id),
f AS (SELECT d.doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_boiler_words
  FROM d LEFT JOIN rep USING (id) LEFT JOIN dup USING (id) LEFT JOIN lost USING (id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_boiler_words <= 0.5 * n_words AS kept FROM f"""

OP8 = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size, CAST('0x' || left(md5('1|' || CAST(doc_id AS VARCHAR)), 15) AS BIGINT) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, 3.0 * CAST(source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
f AS (SELECT *, cap / weight AS r, (total - (sum(cap) OVER o - cap)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
g AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT arg_min(t, r) FROM f WHERE t <= r), 0)) AS target FROM f),
p AS (SELECT d.*, source_size, target, CAST(round(target) AS BIGINT) AS budget, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size > 0 THEN budget // source_size * size + least(greatest(budget % source_size - before, 0), size) ELSE 0 END AS BIGINT) AS taken FROM p"""

OP10 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20) q),
late AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) q WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(range(i, i + 20)) AS x FROM late) q),
per AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS x FROM d WHERE doc_id IN (SELECT doc_id FROM per)),
kept AS (SELECT word.doc_id, string_agg(v, ' ' ORDER BY word.x) AS t FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.x = word.x WHERE gone.x IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256 FROM d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)"""


OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(size, 0) AS size, coalesce(lang_total, 0) AS lang_total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS size, sum(n) AS lang_total FROM k GROUP BY lang) USING (lang)),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (total + 2 * size) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (lang_total + 2 * size) AS q FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS v FROM cell x JOIN cell y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) q ON q.lang = a.lang AND q.s = a.source AND q.t = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM cell WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10"""

OP13 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT r, vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pair AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT r, r AS other FROM v UNION SELECT reach.r, pair.b FROM reach JOIN pair ON reach.other = pair.a),
c AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.other = v.r GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS n FROM pair GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, component_id IS NULL) AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": OP6, "op8_mixing": OP8, "op10_substring_dedup": OP10, "op12_source_divergence": OP12, "op13_cap_filters": OP13}
