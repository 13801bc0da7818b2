"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthgrid.llm import decontaminate as dc
from monthgrid.llm import bpe, fim, fingerprints, importance, language, licenses, lines, nearest, neardup, secrets, substring, tokenfiles
from monthgrid.llm.common import read, ship

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    names = "MAP {" + ", ".join(f"{_quoted(s)}: {_quoted(i)}" for s, i in licenses.SENTENCES.items()) + "}"
    steps, left = [], "seq0"
    for i, (name, run) in enumerate(licenses.RULES):
        tag = "<" + "><".join(run) + ">"
        steps.append(f"s{i + 1} AS (SELECT *, replace(seq{i}, {_quoted(tag)}, '<#>') AS seq{i + 1}, "
                     f"CASE WHEN contains(seq{i}, {_quoted(tag)}) THEN {_quoted(name)} END AS h{i} FROM s{i})")
        left = f"seq{i + 1}"
    hits = ", ".join(f"h{i}" for i in range(len(licenses.RULES)))
    last = f"s{len(licenses.RULES)}"
    return f"""
WITH cut AS (
  SELECT doc_id, list_filter(list_transform(
      string_split_regex(coalesce(text, ''), '[\\n\\r]+|[.!?;:]+(?:[ \\t\\n\\r\\f]+|\\z)'),
      lambda s: trim(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'))), lambda s: s <> '') AS found
  FROM documents),
named AS (SELECT doc_id, found, list_transform(found, lambda s: coalesce({names}[s], '?')) AS ids FROM cut),
s0 AS (
  SELECT doc_id, len(found) AS n_sentences, list_filter(ids, lambda x: x <> '?') AS known,
         regexp_replace(CASE WHEN len(ids) = 0 THEN '' ELSE '<' || array_to_string(ids, '><') || '>' END, '(<\\?>)+', '<?>', 'g') AS seq0
  FROM named),
{", ".join(steps)},
listed AS (SELECT *, [{hits}] AS hits,
  CASE WHEN len(known) = 0 THEN []
       ELSE list_filter(string_split(regexp_replace({left}, '^<|>$', '', 'g'), '><'), lambda x: x NOT IN ('', '?', '#')) END AS rest
  FROM {last})
SELECT doc_id, n_sentences, len(known)::BIGINT AS n_known, array_to_string(known, ',') AS sentence_ids,
       array_to_string(list_filter(list_transform(range(len(hits)), lambda i:
           CASE WHEN list_position(hits, hits[i + 1]) = i + 1 THEN hits[i + 1] END), lambda x: x IS NOT NULL), ',') AS licenses,
       array_to_string(rest, ',') AS unclaimed
FROM listed"""


@query("op1_license_scan", _license_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        "doc_id", "n_sentences", F.size("sentence_ids").cast("bigint").alias("n_known"),
        *[F.array_join(c, ",").alias(c) for c in ("sentence_ids", "licenses", "unclaimed")],
    )


def _secret_sql() -> str:
    parts = []
    for i, r in enumerate(secrets.RULES):
        p = _quoted(r.pattern)
        parts.append(f"""
  SELECT blob, {i} AS kind, '{r.name}' AS name, i,
         length(string_split_regex(text, {p})[i]) AS before,
         length(regexp_extract_all(text, {p}, 0)[i]) AS whole, length(regexp_extract_all(text, {p}, {r.group})[i]) AS checked
  FROM (SELECT blob, text, unnest(range(1, len(string_split_regex(text, {p})) + 1)) AS i FROM blobs WHERE regexp_matches(text, {p}))""")
    least = " ".join(f"WHEN '{r.name}' THEN {r.min_chars}" for r in secrets.RULES)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS blob FROM documents),
blobs AS (SELECT DISTINCT blob, text FROM docs),
pieces AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT *, sum(before + coalesce(whole, 0)) OVER (PARTITION BY blob, kind ORDER BY i) AS stop FROM pieces),
kept AS (SELECT blob, kind, name, stop - whole AS start, stop FROM placed WHERE whole IS NOT NULL AND checked >= CASE name {least} END),
per_blob AS (
  SELECT blob, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
         string_agg(name || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind) AS spans
  FROM kept GROUP BY blob)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per_blob USING (blob)"""


@query("op5_secret_scan", _secret_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read(spark, sf_dir, "documents"), ["doc_id"])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["rule"] == kind)).cast("bigint")
    return found.withColumn("text_spans", text).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2("text_spans", 256).alias("base_sha256"), F.col("text_spans").alias("spans"),
    )


DECONTAMINATION_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, n, item_id FROM doc_windows JOIN item_windows USING (n, win)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
           FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (doc_id) LEFT JOIN listed USING (doc_id)"""


@query("op8_decontaminate", DECONTAMINATION_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dc.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.size("hits").cast("bigint")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


NEAR_DUPLICATE_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
           GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id, doc_id = m AS kept
FROM docs LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)"""


@query("op2_minhash_near_dedup", NEAR_DUPLICATE_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


SUBSTRING_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM docs WHERE len(w) >= 13)),
firsts AS (SELECT g, min(doc_id) AS d FROM windows GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM windows JOIN firsts USING (g) WHERE doc_id > d),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(ps, i)), ' ') END) AS kept_sha256
FROM docs LEFT JOIN lists USING (doc_id)"""


@query("op4_substring_dedup", SUBSTRING_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    profiles = language.learn(docs.where(F.coalesce(~held_out, F.lit(True))))
    found = language.identify(docs, profiles, ["doc_id"])
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op10_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare_with_edits(read(spark, sf_dir, "documents"))
    prints = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return found.select("doc_id", "n_chars", "edited_sha256", *prints, "near_edited", "near_next")


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(read(spark, sf_dir, "documents"), ["doc_id"], RANKS, PATTERN, decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenfiles.round_trip(read(spark, sf_dir, "documents"), WORDS)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


LINE_SQL = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS raw FROM documents),
lines AS (
  SELECT doc_id, i, trim(raw[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT doc_id, raw, unnest(range(1, len(raw) + 1)) AS i FROM docs)),
full_lines AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE line <> ''),
pairs AS (SELECT a.doc_id, a.k, a.line AS x, b.line AS y FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.k = a.k + 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, k) AS r FROM pairs),
long_lines AS (SELECT doc_id, k, row_number() OVER (PARTITION BY line ORDER BY doc_id, k) AS r FROM full_lines
               WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 20),
gone AS (SELECT doc_id, k + o AS k FROM ranked, (VALUES (0), (1)) t(o) WHERE r > 1 UNION SELECT doc_id, k FROM long_lines WHERE r > 1),
cut AS (SELECT doc_id, list(i) AS gone FROM gone JOIN full_lines USING (doc_id, k) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM full_lines GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN coalesce(text, '')
              ELSE array_to_string(list_filter(raw, lambda x, i: NOT list_contains(gone, i)), chr(10)) END) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id) LEFT JOIN counts USING (doc_id)"""


@query("op7_line_dedup", LINE_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")
    )


@query("op11_nearest_neighbours")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


IMPORTANCE_SQL = r"""
WITH RECURSIVE steps(b, i, c) AS (
  SELECT b, 0, b FROM range(256) t(b) UNION ALL
  SELECT b, i + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE i < 8),
crc AS (SELECT list(c ORDER BY b) AS effect FROM steps WHERE i = 8),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
doc_features AS (
  SELECT doc_id, f, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS f FROM docs UNION ALL
        SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM docs)) GROUP BY doc_id, f),
item_features AS (
  SELECT f, count(*) AS n
  FROM (SELECT unnest(w) AS f FROM items UNION ALL
        SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM items)) GROUP BY f),
distinct_features AS (SELECT f FROM doc_features UNION SELECT f FROM item_features),
octets AS (
  SELECT f, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT) AS bytes
  FROM distinct_features),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c // 256, effect[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM octets, crc),
raw_counts AS (SELECT bucket, sum(n)::DOUBLE AS s FROM doc_features JOIN hashed USING (f) GROUP BY bucket),
aim_counts AS (SELECT bucket, sum(n)::DOUBLE AS t FROM item_features JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(s) FROM raw_counts), 0) AS s_all, coalesce((SELECT sum(t) FROM aim_counts), 0) AS t_all),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((coalesce(s, 0) + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN raw_counts USING (bucket) LEFT JOIN aim_counts USING (bucket), totals),
sums AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total
         FROM doc_features JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, floor(coalesce(total / n_features, 0))::BIGINT AS weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM docs LEFT JOIN sums USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)"""


@query("op12_importance_resampling", IMPORTANCE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


FILL_IN_MIDDLE_SQL = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
dice AS (
  SELECT doc_id, text, length(text) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (length(text) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (length(text) + 1) AS b,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS d FROM hashed),
formed AS (
  SELECT doc_id, text, n, least(a, b) AS low, greatest(a, b) AS high,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM dice),
cut AS (SELECT *, substr(text, 1, low) AS p, substr(text, low + 1, high - low) AS m, substr(text, high + 1) AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut"""


@query("op13_fill_in_middle", FILL_IN_MIDDLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.fill_in_middle(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.col("n_units").alias("n"), "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"),
    )
