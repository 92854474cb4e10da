"""The queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_extract, idfile, merkle, packing, pii, quality, resample, rules, sharding, simhash, warc, winnow


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_documents(_read(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_read(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(_read(spark, sf_dir, "documents"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.token_id_round_trip(_read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_read(spark, sf_dir, "documents"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_verdicts(_read(spark, sf_dir, "documents")).drop("n_lines")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_read(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("n_words")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_fingerprints(_read(spark, sf_dir, "documents"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
w AS (SELECT *, octet_length(encode(h)) AS n, max(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 1000 AND page_id <> m THEN m END AS refers_to FROM w"""


def _op10_sql() -> str:
    mean, var, noise = (lambda r: f"avg({r} / n)"), (lambda r: f"var_pop({r} / n)"), (lambda r: f"avg({r} / n * (1 - {r} / n) / n)")
    moments = ", ".join(f"{mean(r)} AS {r}_m, {var(r)} AS {r}_v, {noise(r)} AS {r}_z" for r in rules.RULES)
    strength = ", ".join(
        f"CASE WHEN {r}_m <= 0 OR {r}_m >= 1 THEN NULL ELSE least(greatest({r}_m * (1 - {r}_m) / greatest({r}_v - {r}_z, 1e-12) - 1, 1), CASE WHEN hosts > 1 THEN 1e6 ELSE 1 END) END AS {r}_s" for r in rules.RULES
    )
    prior = ", ".join(f"coalesce({r}_m * {r}_s, 1e-3 + {r}_m) AS {r}_a, coalesce((1 - {r}_m) * {r}_s, 1e-3 + 1 - {r}_m) AS {r}_b" for r in rules.RULES)
    rates = ", ".join(f"({r} + {r}_a) / (n + {r}_a + {r}_b) AS {r}_p" for r in rules.RULES)
    bad = " OR ".join(f"{r}_p - 2 * sqrt({r}_p * (1 - {r}_p) / (n + {r}_a + {r}_b + 1)) > greatest({rules.LEAST_RATE}, {rules.TIMES} * {r}_a / ({rules.TIMES} * {r}_a + {r}_b))" for r in rules.RULES)
    return f"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(8) AS s(k) WHERE c > 1 GROUP BY doc_id),
s AS (SELECT doc_id, host, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
 (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN c USING (doc_id)),
h AS (SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (n_words < 20) AS few_words, count(*) FILTER (100 * n_repeat_words > 30 * n_words) AS repetition,
 count(*) FILTER (10 * n_symbols > n_words) AS symbols, count(*) FILTER (3 * n_dup_lines > n_lines) AS repeated_lines FROM s GROUP BY host),
m AS (SELECT count(*) AS hosts, {moments} FROM h), m2 AS (SELECT *, {strength} FROM m), m3 AS (SELECT {prior} FROM m2),
q AS (SELECT *, {rates} FROM h, m3), v AS (SELECT host, {bad} AS rejected FROM q)
SELECT doc_id, s.host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT rejected AS kept FROM s JOIN v ON s.host IS NOT DISTINCT FROM v.host"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, bit by bit."""
    byte = f"(strpos('0123456789ABCDEF', substr(hex({text}), 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex({text}), 2 * i + 2, 1)) - 1"
    step = "list_reduce(range(8), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(c, b))"
    return f"xor(list_reduce(list_transform(range(len(hex({text})) // 2), lambda i: ({byte})::BIGINT), lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"


def _op11_sql() -> str:
    part = lambda v: f"coalesce(octet_length(encode({v}::VARCHAR)) || ':' || {v}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    f = merkle.FANOUT
    return f"""
WITH RECURSIVE d AS (SELECT *, {_crc32_sql("doc_id::VARCHAR")} % 2 = 0 AS even FROM documents),
l AS (SELECT doc_id, source, {leaf("text")} AS leaf, {leaf("CASE WHEN even THEN replace(text, chr(10), '') ELSE text END")} AS forged FROM d),
k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l),
t AS (SELECT source, 0 AS level, i, n, leaf AS h FROM k UNION ALL SELECT source, level + 1, i // {f}, (n + {f - 1}) // {f}, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY source, level, i // {f}, n),
s AS MATERIALIZED (SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, i, n, subroot AS h FROM s UNION ALL SELECT level + 1, i // {f}, (n + {f - 1}) // {f}, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // {f}, n),
w AS MATERIALIZED (SELECT k.*, s.subroot, s.i AS at, (SELECT h FROM u WHERE n = 1) AS root, row_number() OVER () AS row FROM k JOIN s ON s.source IS NOT DISTINCT FROM k.source),
p AS (SELECT row, level AS step, string_agg(h, '' ORDER BY i) FILTER (i < own) AS l, string_agg(h, '' ORDER BY i) FILTER (i > own) AS r
 FROM (SELECT w.row, t.level, t.i, t.h, w.i // pow({f}, t.level)::BIGINT AS own FROM w JOIN t ON t.source IS NOT DISTINCT FROM w.source AND t.n > 1) WHERE i // {f} = own // {f} GROUP BY row, level),
q AS (SELECT row, 1000 + level AS step, string_agg(h, '' ORDER BY i) FILTER (i < own) AS l, string_agg(h, '' ORDER BY i) FILTER (i > own) AS r
 FROM (SELECT w.row, u.level, u.i, u.h, w.at // pow({f}, u.level)::BIGINT AS own FROM w JOIN u ON u.n > 1) WHERE i // {f} = own // {f} GROUP BY row, level),
a AS MATERIALIZED (SELECT row, coalesce(l, '') AS l, coalesce(r, '') AS r, row_number() OVER (PARTITION BY row ORDER BY step) AS step, count(*) OVER (PARTITION BY row) AS steps FROM (FROM p UNION ALL FROM q)),
c AS (SELECT row, 0::BIGINT AS step, forged AS h FROM w UNION ALL SELECT c.row, a.step, sha256(l || h || r) FROM c JOIN a ON a.row = c.row AND a.step = c.step + 1),
o AS (SELECT row, arg_max(h, step) AS folded FROM c GROUP BY row), b AS (SELECT row, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM a GROUP BY row)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM w JOIN o USING (row) LEFT JOIN b USING (row)"""


def _op12_sql() -> str:
    k, upper = resample.BUCKETS, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    found = lambda table, doc_id: f"SELECT {doc_id} AS doc, unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '{word}')) AS w FROM {table}"
    hexed = "0123456789abcdef"
    digits = " + ".join(f"(strpos('{hexed}', substr(x, {j + 1}, 1)) - 1) * {16 ** (7 - j)}" for j in range(8))
    return f"""
WITH f AS MATERIALIZED ({found("documents", "doc_id")}), g AS MATERIALIZED ({found("benchmark", "NULL")}),
v AS MATERIALIZED (SELECT w, {_crc32_sql("w")} % {k} AS b FROM (SELECT w FROM f UNION SELECT w FROM g)),
n AS (SELECT b, s, t, sum(s) OVER () AS s_all, sum(t) OVER () AS t_all FROM (SELECT b, count(*) FILTER (own = 1) AS s, count(*) FILTER (own = 0) AS t FROM (SELECT w, 1 AS own FROM f UNION ALL SELECT w, 0 FROM g) JOIN v USING (w) GROUP BY b)),
m AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (s_all + {k})::DOUBLE / ((s + 1)::DOUBLE * (t_all + {k})::DOUBLE)))::BIGINT AS gain FROM n),
r AS (SELECT doc, count(*) AS n, sum(gain)::BIGINT AS total FROM f JOIN v USING (w) JOIN m USING (b) GROUP BY doc),
e AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight, sha256('{resample.SEED}:' || doc_id) AS x FROM documents LEFT JOIN r ON doc = doc_id),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((({digits})::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {resample.LEAST_WORDS} ORDER BY score DESC, doc_id) AS k, count(*) FILTER (n_features >= {resample.LEAST_WORDS}) OVER () AS able FROM z)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN n_features >= {resample.LEAST_WORDS} AND k <= {resample.PERCENT} * able // 100 THEN k END::BIGINT AS rank FROM o"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html, op2_packing, op3_sharding, op4_warc, op5_simhash, op6_token_ids, op7_quality, op8_decontamination, op9_pii, op10_rules, op11_merkle, op12_resampling, op13_fingerprints)}


def oracle_sql() -> dict[str, str]:
    """Fingerprints, tokenizer ids, learned models and positions of matches are beyond SQL; the tests hold those queries against plain versions."""
    return {"op4_warc": OP4_SQL, "op10_rules": _op10_sql(), "op11_merkle": _op11_sql(), "op12_resampling": _op12_sql()}
