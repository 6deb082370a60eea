"""The operators' queries over the whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsumugi.llm import chat, decontam, fingerprints, language, licenses, mixing, neardup, quality, spelling, substrings, tokens, trie, urls
from tsumugi.llm.common import stored, table

MAX_TOKENS = 4096
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_near(fingerprints.edited_fingerprints(table(spark, sf_dir, "documents")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.fit(docs, table(spark, sf_dir, "labels"))
    found = quality.score_documents(docs, machine, ["doc_id"])
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), ["page_id"])


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_groups(table(spark, sf_dir, "documents"), neardup.Blocked(shingle=3, radius=2))
    return found.select("doc_id", F.lower(F.hex("print")).alias("fingerprint"), "component_id")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    return found.withColumn("over_limit", found["n_tokens"] > MAX_TOKENS)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], rows.schema)
    return chat.digests(chat.format_turns(rows.unionByName(extra), ["conv_id", "turn"]))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.with_shared_heads(trie.sequences(table(spark, sf_dir, "conversations"))))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs.where(~language.held_out(F.col("doc_id")))), ["doc_id"])
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped_variants(stored(spelling.word_counts(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_fingerprints, op2_quality_classifier, op3_url_filters, op4_simhash_near_dedup, op5_source_mixing, op6_license_scans, op7_decontamination, op8_token_counts, op9_substring_dedup, op10_chat_formatting, op11_prefix_trie, op12_language_id, op13_spelling_variants)}

ORACLES: dict[str, str] = {}

#: Host and path of a url; rules as (name, host, path, verdict).
ORACLES["op3_url_filters"] = r"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
r(name, rhost, rpath, rverdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
m AS (SELECT page_id, max_by(name, length(name)) AS rule, max_by(rverdict, length(name)) AS v FROM p JOIN r
      ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, host, path, rule, CASE WHEN v IS NOT NULL THEN v
  WHEN regexp_matches(lower(host || path), '(^|[.-])((spam|link)[-_]?farm[0-9]*|cheap[-_]?pills?|online[-_]?(casino|pharmacy|poker)|free[-_]?(porn|xxx|sex)|adult[-_]?(cams?|chat|videos?)|payday[-_]?loans?|click[-_]?bait)([.-]|/|$)')
    OR regexp_matches(lower(host || path), '(^|[./-])(porn|xxx|casino|viagra|warez|malware|phishing|doubleclick)([./-]|$)')
    OR regexp_matches(lower(host || path), '^([^/]*[.-])?(adult|ads|adserver|bets|betting|spam|tracker)([.-]|/|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN m USING (page_id)
"""

ORACLES["op7_decontamination"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM b WHERE len(ws) >= 5)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS n_items, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment FROM c JOIN n USING (item_id)
WHERE 5 * n_shared >= 4 * n_shingles QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_shared / n_shingles DESC, item_id) = 1
"""


def _license_sql() -> str:
    quoted = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(licenses.TEMPLATES))
    pairs = lambda ws: f"list_distinct(list_transform(range(1, len({ws})), lambda i: {ws}[i] || ' ' || {ws}[i + 1]))"
    words = lambda text: f"regexp_extract_all(lower({text}), '[a-z0-9]+')"
    t = licenses.THRESHOLD
    return f"""
WITH t AS (SELECT template, license, {pairs('ws')} AS own FROM (SELECT template, license, {words('text')} AS ws FROM (VALUES {quoted}) v(template, license, text))),
ti AS (SELECT template, license, len(own) AS size, unnest(own) AS bigram FROM t),
l AS (SELECT doc_id, string_split(text, chr(10)) AS ls, text FROM documents),
p AS (SELECT doc_id, i - 1 AS line, ls[i] AS passage FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)
      UNION ALL SELECT doc_id, -1, text FROM l WHERE len(ls) > 1),
o AS (SELECT doc_id, line, {pairs('ws')} AS own FROM (SELECT doc_id, line, {words('passage')} AS ws FROM p)),
x AS (SELECT doc_id, line, len(own) AS n, unnest(own) AS bigram FROM o),
s AS (SELECT doc_id, line, template, license, 2 * count(*) / (n + size) AS dice FROM x JOIN ti USING (bigram) GROUP BY doc_id, line, template, license, n, size),
b AS (SELECT * FROM s WHERE dice >= {t} - 1e-9 QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, template) = 1)
SELECT doc_id, license, CAST(count(*) FILTER (line >= 0) AS BIGINT) AS n_passages, CAST(coalesce(min(line) FILTER (line >= 0), -1) AS INTEGER) AS first_line, max(dice) AS dice FROM b GROUP BY doc_id, license
"""


ORACLES["op6_license_scans"] = _license_sql()

ORACLES["op9_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, i, array_to_string(ws[i:i+49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
m AS (SELECT k, min(doc_id) AS d FROM k GROUP BY k HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT doc_id, i, unnest(range(50)) AS o FROM k JOIN m USING (k) WHERE doc_id > d)),
x AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
r AS (SELECT x.doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (g.i IS NULL) AS kept FROM x LEFT JOIN g USING (doc_id, i) GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)
"""

ORACLES["op10_chat_formatting"] = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of a string, bit by bit, from the hexadecimal digits of its UTF-8."""
    bits = f"flatten(list_transform(range(1, 2 * strlen({text}) + 1, 2), lambda p: list_transform(range(8), lambda k: ((strpos('0123456789ABCDEF', substr(hex({text}), p + 1 - k // 4, 1)) - 1) >> (k % 4)) & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))))"


ORACLES["op11_prefix_trie"] = rf"""
WITH t AS (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
           FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list({{'h': h, 'w': w}} ORDER BY turn NULLS FIRST, h) AS ts FROM t GROUP BY conv_id),
k AS (SELECT conv_id, ts, {_crc32_sql("conv_id::VARCHAR")} % 4 AS n FROM s),
r AS (SELECT k.conv_id, list_concat(coalesce(b.ts, [])[1:n], k.ts[n + 1:]) AS ts FROM k LEFT JOIN s b ON b.conv_id = k.conv_id - k.conv_id % 20),
a AS (SELECT conv_id, len(ts) AS size, d, md5(array_to_string([x.h for x in ts[1:d]], '')) AS id, CASE WHEN d > 0 THEN md5(array_to_string([x.h for x in ts[1:d - 1]], '')) END AS up, ts[d].w AS w
      FROM (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS d FROM r)),
n AS (SELECT d, id, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(w), 0) AS w, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '') AS ends FROM a GROUP BY d, id),
c AS (SELECT d - 1 AS d, up AS id, count(*) AS n_children FROM n GROUP BY d, up),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (d, id)),
u AS (SELECT o.d, o.id, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.w) AS saved FROM m JOIN a i ON i.conv_id = m.conv_id AND i.d = m.d
      JOIN a o ON o.conv_id = m.conv_id AND o.d <= m.d GROUP BY o.d, o.id)
SELECT m.conv_id, m.d AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN u USING (d, id) LEFT JOIN m p ON p.d = m.d - 1 AND p.id = m.up
"""

ORACLES["op13_spelling_variants"] = rf"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
d AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS t, run, count(*) AS k FROM r WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, k, {_crc32_sql("t")} AS h FROM d),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n
      FROM h GROUP BY 1 HAVING sum(k) >= 5 AND length(word) >= 6),
l AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM l a JOIN l b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT w.word, w.n, l.word, l.n FROM w JOIN l ON w.word = l.rest UNION SELECT l.word, l.n, w.word, w.n FROM w JOIN l ON w.word = l.rest),
b AS (SELECT word, count(*) AS n_near FROM p GROUP BY word),
f AS (SELECT word, n, other AS form, m AS form_n FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
g AS (SELECT word, form, form_n FROM f WHERE form_n >= 5 * n),
c AS (SELECT word, form AS root FROM g UNION ALL SELECT c.word, g.form FROM c JOIN g ON g.word = c.root),
e AS (SELECT word, root FROM c WHERE root NOT IN (SELECT word FROM g))
SELECT w.word, g.form, coalesce(e.root, w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near, g.form_n FROM w LEFT JOIN b USING (word) LEFT JOIN g USING (word) LEFT JOIN e USING (word)
"""
