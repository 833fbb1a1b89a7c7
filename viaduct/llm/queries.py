"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.llm import audio, decontam, jaccard, langid, licenses, linededup, packing, repeats, tokenbin, urlfilter
from viaduct.session import materialize, small_batches

RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out():
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")), F.lit(3)) == 1


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs, ~held_out())
    return langid.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_read(spark, sf_dir, "pages"), RULES)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op4_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digest(materialize(audio.store(_read(spark, sf_dir, "documents")), "media"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.read_tokens(spark, tokenbin.write_tokens(_read(spark, sf_dir, "documents")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(_read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_url_filter, op3_jaccard_join, op4_media_audio, op5_token_output, op6_license_scan, op7_suffix_repeats, op8_decontamination, op9_best_fit_packing, op10_line_dedup)}
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED = rf"regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+')"
_templates = ", ".join(f"({n}, '{label}', '{text}')" for n, (text, label) in enumerate(licenses.TEMPLATES.items()))
_phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in licenses.PHRASES.items())

ORACLE_SQL: dict[str, str] = {
    "op3_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {SPACED} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
        e AS (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
        c(node, root) USING KEY (node) AS (SELECT u, least(u, min(v)) FROM e GROUP BY u
          UNION SELECT e.v, min(c.root) FROM c JOIN e ON e.u = c.node LEFT JOIN recurring.c p ON p.node = e.v WHERE c.root < p.root GROUP BY e.v)
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id""",
    "op6_license_scan": f"""
        WITH w AS (SELECT doc_id, {ALNUM} AS w FROM documents),
        ph(phrase, label, m) AS (VALUES {_phrases}),
        pl AS (SELECT doc_id, i, label FROM (SELECT doc_id, w, m, phrase, label, unnest(range(0, len(w) - m + 1)) AS i FROM w, ph WHERE list_contains(w, 'license')) WHERE array_to_string(w[i + 1 : i + m], ' ') = phrase),
        base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM pl GROUP BY doc_id),
        t AS (SELECT id, label, string_split(text, ' ') AS tw FROM (VALUES {_templates}) AS v(id, label, text)),
        tg AS (SELECT id, o, array_to_string(tw[o + 1 : o + {licenses.K}], ' ') AS g FROM (SELECT id, tw, unnest(range(0, len(tw) - {licenses.K - 1})) AS o FROM t)),
        dg AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + {licenses.K}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - {licenses.K - 1})) AS i FROM w)),
        d AS (SELECT DISTINCT doc_id, id, i - o AS d FROM dg JOIN tg USING (g)),
        g AS (SELECT doc_id, id, d, sum(f) OVER (PARTITION BY doc_id, id ORDER BY d) AS island FROM (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY doc_id, id ORDER BY d) <= {licenses.NEAR} THEN 0 ELSE 1 END AS f FROM d)),
        q AS (SELECT doc_id, id, island, label, len(tw) AS n, unnest(list_filter(range(0, len(tw)), lambda x: x + d >= 0 AND w[x + d + 1] = tw[x + 1])) AS x FROM g JOIN w USING (doc_id) JOIN t USING (id)),
        sp AS (SELECT doc_id, label, count(DISTINCT x) / n AS share FROM q GROUP BY doc_id, id, island, label, n HAVING count(DISTINCT x) / n >= {licenses.LEAST}),
        more AS (SELECT doc_id, max(share) AS share FROM sp GROUP BY doc_id),
        ls AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM sp UNION ALL SELECT doc_id, label FROM pl) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
        FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id) LEFT JOIN ls USING (doc_id)""",
    "op8_decontamination": f"""
        WITH dw AS (SELECT doc_id, {ALNUM} AS w FROM documents), bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {ALNUM} AS w FROM benchmark),
        win AS (SELECT DISTINCT item, m, array_to_string(w[i + 1 : i + m], ' ') AS g FROM (SELECT item, w, least(13, len(w)) AS m, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS i FROM bw WHERE len(w) > 0)),
        dg AS (SELECT doc_id, i, m, array_to_string(w[i + 1 : i + m], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM dw, (SELECT DISTINCT m FROM win))),
        hit AS (SELECT doc_id, i, m, item FROM dg JOIN win USING (m, g)),
        cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
}
