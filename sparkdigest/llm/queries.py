"""The queries opN_<name> of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdigest.llm import conversations, html, neighbours, packing, pii, quality, sharding, simhash, spelling, substrings, tokens, topk, toxicity
from sparkdigest.llm.common import table


#: Bytes of text in a shard at most.
SHARD_BYTES = 16 << 20


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    said = lambda *kinds: F.array_join(F.transform(F.concat(*kinds), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(said(*pii.PATTERNS), 256).alias("base_sha256"), said(*pii.PATTERNS, "terms").alias("spans"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


SQL: dict[str, str] = {}

#: Words of a text, in order.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL["op2_substring_dedup"] = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
grams AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM grams) WHERE doc_id > m),
gone AS (SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM again) GROUP BY doc_id),
marked AS (SELECT w.doc_id, words, coalesce(places, []) AS places FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(words) AS n_words, len(places) AS n_removed,
  sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(places, i)), ' ')) AS kept_sha256
FROM marked"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    found = quality.judge(table(spark, sf_dir, "documents"), trusted)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

SQL["op6_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


#: Table of CRC-32 (reflected polynomial 0xEDB88320), made from its rule, for SQL without that function.
_CRC = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS steps)"""


def _crc32(codes: str) -> str:
    """CRC-32 of a list of byte values, in a query that has the table crc."""
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


#: Bytes of a text of letters up to U+00FF.
_BYTES = """flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))"""
SQL["op11_spelling_variants"] = rf"""
WITH RECURSIVE {_CRC},
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
small AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32(_BYTES.format("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h FROM small, crc),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS (SELECT word, n, length(word) AS len, i, left(word, i) AS head, substr(word, i + 2) AS tail FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.len = b.len AND a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.head || a.tail = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.head || a.tail = b.word),
near AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM pairs GROUP BY word),
best AS (SELECT pairs.word, any_value(n_near) AS n_near, any_value(most) AS most, min(other) AS other FROM pairs JOIN near ON near.word = pairs.word AND most = other_n GROUP BY pairs.word),
forms AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN other END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n
  FROM words LEFT JOIN best ON best.word = words.word),
ways AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT ways.word, forms.word, forms.form FROM ways JOIN forms ON ways.next = forms.word)
SELECT forms.word, forms.form, ways.at AS root, n, n_near, form_n FROM forms JOIN ways ON ways.word = forms.word AND ways.next IS NULL"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audited(table(spark, sf_dir, "conversations"))


def _edited(was: str, cost: str, edit: str, told: str = "[]", when: str = "true") -> str:
    """A state's best after one more edit, in SQL."""
    return f"CASE WHEN {was} IS NOT NULL AND {when} THEN {{'cost': {was}.cost + {cost}, 'audit': {was}.audit || '{edit}', 'told': {was}.told || {told}}} END"


def _stays(was: str, role: str) -> str:
    """The same for a turn that is kept or gets another role."""
    own = _edited(was, "more", "K", "[role || ':' || text]", f"free AND initial = '{role[0]}'")
    return own + ", " + _edited(was, "more + 1", "R", f"['{role}:' || text]", f"free AND initial <> '{role[0]}'")


SQL["op12_conversation_repair"] = rf"""
WITH RECURSIVE {_CRC},
marked AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(unicode(x) AS BIGINT))")} % 20 AS d
  FROM conversations, crc),
rows AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM marked WHERE d <> 0),
placed AS (SELECT conv_id, turn, role, text, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM rows),
faults AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM placed),
steps AS (SELECT conv_id, i, role, text, initial, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS free, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM faults),
fold AS (
  SELECT conv_id, 0 AS i, {{'cost': 0, 'audit': '', 'told': CAST([] AS VARCHAR[])}} AS s0, CAST(NULL AS STRUCT(cost INTEGER, audit VARCHAR, told VARCHAR[])) AS s1,
    CAST(NULL AS STRUCT(cost INTEGER, audit VARCHAR, told VARCHAR[])) AS s2, CAST(NULL AS STRUCT(cost INTEGER, audit VARCHAR, told VARCHAR[])) AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, CAST(i AS INTEGER), {_edited("s0", "2", "D")}, least({_edited("s1", "2", "D")}, {_edited("s0", "more", "K", "[role || ':' || text]", "free AND initial = 's'")}),
    least({_edited("s2", "2", "D")}, {_stays("s0", "user")}, {_stays("s1", "user")}, {_stays("t3", "user")}),
    least({_edited("s3", "2", "D")}, {_stays("t2", "assistant")})
  FROM (SELECT *, least(s3, {_edited("t2", "5", "I", "['assistant:']")}) AS t3
    FROM (SELECT steps.*, s0, s1, s2, s3, least(s2, {", ".join(_edited(x, "5", "I", "['user:']") for x in ("s0", "s1", "s3"))}) AS t2
      FROM fold JOIN steps ON steps.conv_id IS NOT DISTINCT FROM fold.conv_id AND steps.i = fold.i + 1))),
best AS (SELECT conv_id, arg_max(least(s0, s3), i) AS b FROM fold GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(b.cost AS BIGINT) AS cost, b.audit AS audit, sha256(array_to_string(b.told, chr(10))) AS repaired_sha256
FROM best LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM best.conv_id"""


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_copies(table(spark, sf_dir, "embeddings"))


SQL["op13_embedding_near_dedup"] = """
WITH RECURSIVE usable AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm
  FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN counted ON counted.a = e.vec_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
