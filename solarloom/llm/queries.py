"""The queries ``opN_<name>`` and ``pipeline`` and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark, sf_dir):
    from .toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_quality_rules(spark, sf_dir):
    from .quality import BASE, quality_rules

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, _table(spark, sf_dir, "labels")).select("doc_id", *BASE, "base_failed", "kept")


def op3_quotation_linking(spark, sf_dir):
    from .quotations import link_quotations

    return link_quotations(_table(spark, sf_dir, "conversations")).drop("text")


def op4_language_profiles(spark, sf_dir):
    from .languages import identify_language

    return identify_language(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    from .contamination import decontaminate

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, _table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_url_rules(spark, sf_dir):
    from .url_rules import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op7_packing(spark, sf_dir):
    import public_tokenizers

    from .packing import pack_tokens

    return pack_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_suffix_array_dedup(spark, sf_dir):
    from .suffix_arrays import suffix_array_dedup

    return suffix_array_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_substring_dedup(spark, sf_dir):
    from .suffix_trees import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op10_simhash(spark, sf_dir):
    from .simhash import simhash_components

    return simhash_components(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark, sf_dir):
    from .filter_audit import audit_filters

    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark, sf_dir):
    from .periodic_runs import detect_runs

    return detect_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"), planted=True).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op13_minhash(spark, sf_dir):
    from .minhash import minhash_components

    return minhash_components(_table(spark, sf_dir, "documents"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
it AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, CAST(len(ws) - k + 2 AS BIGINT)), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS gram FROM (SELECT *, least(len(ws), 10) AS k FROM it WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dg AS (SELECT doc_id, k, unnest(range(1, CAST(len(ws) - k + 2 AS BIGINT))) AS i, unnest(list_transform(range(1, CAST(len(ws) - k + 2 AS BIGINT)), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS gram FROM d, ks WHERE len(ws) >= k),
hit AS (SELECT doc_id, dg.k, i, item_id FROM dg JOIN iw ON dg.k = iw.k AND dg.gram = iw.gram),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)"""

OP6_SQL = f"""WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT *, '.' || host AS h, CASE
  WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || path, '(?s)^([^/]*spam[^/]*/.*|[^/]*cheap-[^/]*/.*|.*/login[^/]*|.*\\.exe|.*/ads/.*)$') THEN 'block' ELSE 'allow' END AS verdict FROM f"""

OP9_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, CAST(len(ws) - 33 AS BIGINT))) AS i, unnest(list_transform(range(1, CAST(len(ws) - 33 AS BIGINT)), lambda i: md5(array_to_string(ws[i : i + 34], ' ')))) AS h FROM d WHERE len(ws) >= 35),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM w JOIN twice USING (h)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, CAST(len(ws) + 1 AS BIGINT))) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS said FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP11_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body),
  regexp_matches(body, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY body), false)] AS fails FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 3, 4, 5]) AS i),
orders AS (SELECT c AS o, [i] AS idx FROM letters UNION ALL SELECT o || c, list_append(idx, i) FROM orders, letters WHERE len(idx) < 5 AND NOT list_contains(idx, i)),
steps AS (SELECT o AS filter_order, step, o[step] AS filter, idx[step] AS own, idx[1 : step - 1] AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE len(idx) = 5),
x AS (SELECT part, filter_order, step, filter, n, good, toxic, fails[own] AS hit, list_bool_or(list_prepend(false, list_transform(earlier, lambda e: fails[e]))) AS gone, len(list_filter(fails, lambda b: b)) = 1 AS lone FROM m, steps),
r AS (SELECT part, filter_order, step, filter, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN hit AND lone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r"""


def oracle_sql():
    """SQL can't express the learned scores (1, 2, 4), the tokenizer (7) or
    XXH64 (10); byte windows (8), the chains of quotations (3), runs (12) and
    all pairs of sets (13) are tested against brute force and literal cases."""
    return {"op11_filter_audit": OP11_SQL, "op5_decontamination": OP5_SQL, "op6_url_rules": OP6_SQL, "op9_substring_dedup": OP9_SQL}
