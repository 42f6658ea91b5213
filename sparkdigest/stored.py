"""Queries of the operators over stored tables, with their SQL; the driver's tables stand in for documents, states and deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdigest.functions import language
from sparkdigest.operators import store
from sparkdigest.session import scratch
from sparkdigest.sources import articles, chunk_sink, tables
from sparkdigest.streaming import state as streaming
from sparkdigest.plans import calls
from sparkdigest.queries import NOW, query, read


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: three states, attempts, a time of change."""
    state = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "processed").otherwise("discovered")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_id"),
        F.col("o_custkey").cast("string").alias("source_id"),
        state.alias("state"),
        (F.col("o_orderkey") % 4).alias("attempt_count"),
        F.when(F.col("o_orderstatus") == "F", "FETCH_FAILED").alias("last_error_code"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"),
    )


_D = """d AS (SELECT o_orderkey AS document_id, CAST(o_custkey AS VARCHAR) AS source_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'processed' ELSE 'discovered' END AS state,
  o_orderkey % 4 AS attempt_count, CASE WHEN o_orderstatus = 'F' THEN 'FETCH_FAILED' END AS last_error_code, o_orderdate AS changed FROM orders)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("long").alias("item_id"), F.col("l_partkey").cast("long").alias("part"))


@query(f"""WITH {_D} SELECT l_orderkey AS document_id, CAST(l_linenumber AS BIGINT) AS item_id, CAST(l_partkey AS BIGINT) AS part, state, CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey % 500 END AS feed_rank
FROM lineitem JOIN d ON l_orderkey = document_id WHERE l_orderkey % 3 = 0 ORDER BY changed DESC, document_id, item_id LIMIT 500""")
def items_with_state(spark, sf_dir):
    docs = _orders(spark, sf_dir)
    feed = docs.where("document_id % 2 = 0").select("document_id", (F.col("document_id") % 500).alias("feed_rank"), F.lit("other").alias("state"), F.lit(NOW).cast("timestamp").alias("published_at"))
    found = store.with_document(_lines(spark, sf_dir), docs, feed, docs.where("document_id % 3 = 0"), 500)
    return found.select("document_id", "item_id", "part", "state", "feed_rank")


@query(f"""WITH {_D} SELECT document_id, state, 'm' || document_id AS message_id FROM d WHERE document_id % 5 = 0""")
def mail_documents(spark, sf_dir):
    docs = _orders(spark, sf_dir)
    state = docs.select("document_id", F.concat(F.lit("m"), "document_id").alias("message_id"))
    return store.by_external(docs, state, state.where("document_id % 5 = 0").select("message_id"), "message_id").select("document_id", "state", "message_id")


@query(f"""WITH {_D} SELECT document_id, document_id % 500 AS feed_rank FROM d WHERE state = 'failed' AND length(source_id) < 3 ORDER BY changed, document_id LIMIT 200""")
def failed_documents(spark, sf_dir):
    docs = _orders(spark, sf_dir)
    # the state has a time and a state of its own, which must not decide
    feed = docs.select("document_id", (F.col("document_id") % 500).alias("feed_rank"), F.lit(NOW).cast("timestamp").alias("updated_at"), F.lit("fetched").alias("state"))
    return store.failed_first(docs, feed, 200, F.length("source_id") < 3).select("document_id", "feed_rank")


@query(f"""WITH {_D} SELECT document_id, 'm' || document_id AS message_id, state FROM d WHERE state IN ('processed', 'failed')""")
def labels_to_follow(spark, sf_dir):
    docs = _orders(spark, sf_dir)
    return store.to_label(docs, docs.select("document_id", F.concat(F.lit("m"), "document_id").alias("message_id")))


@query("""WITH x AS (SELECT o_orderkey AS digest_id, o_custkey % 10 AS k, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'delivered' END AS state, o_orderkey % 3 = 0 AS retired, o_clerk FROM (SELECT *, o_orderpriority AS o_clerk FROM orders))
SELECT digest_id, 'd' || k AS destination_key, state, o_clerk AS content FROM x WHERE k IN (1, 2, 3) AND state IN ('pending', 'failed') AND NOT retired""")
def deliveries_to_send(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    state = F.when(key % 4 == 0, "pending").when(key % 4 == 1, "failed").otherwise("delivered")
    deliveries = o.select(key.alias("digest_id"), F.concat(F.lit("d"), F.col("o_custkey") % 10).alias("destination_key"), state.alias("state"), F.when(key % 3 == 0, F.lit(NOW)).alias("retired_at"))
    wanted = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "destination_key string")
    return store.open_deliveries(deliveries, o.select(key.alias("digest_id"), F.col("o_orderpriority").alias("content")), wanted).select("digest_id", "destination_key", "state", "content")


@query(f"""WITH {_D} SELECT document_id, CASE WHEN document_id % 7 = 0 THEN 'failed' ELSE state END AS state, attempt_count + CASE WHEN document_id % 7 = 0 THEN 1 ELSE 0 END AS attempt_count,
  CASE WHEN document_id % 7 = 0 THEN 'TIMEOUT' ELSE last_error_code END AS last_error_code FROM d""")
def fail_documents(spark, sf_dir):
    docs = _orders(spark, sf_dir)
    bad = docs.where("document_id % 7 = 0").select("document_id", F.lit("TIMEOUT").alias("error"))
    return store.fail(docs, bad, F.lit(NOW).cast("timestamp")).select("document_id", "state", "attempt_count", "last_error_code")


_OUTCOME = "CASE WHEN document_id % 3 = 0 THEN 'ok' WHEN document_id % 3 = 1 THEN 'bad' END"


def _resolved(spark, sf_dir):
    docs = _orders(spark, sf_dir).withColumns({"content_basis": F.lit("metadata"), "content_sha256": F.lit(None).cast("string"), "content_characters": F.lit(0)})
    none = F.lit(None).cast("timestamp")
    state = docs.select("document_id", F.lit(None).cast("string").alias("final_url"), F.lit("new").alias("fetch_status"), none.alias("fetched_at"), none.alias("updated_at"))
    good = F.col("document_id") % 3 == 0
    outcomes = docs.where("document_id % 3 < 2").select("document_id", F.when(good, F.concat(F.lit("text "), "document_id")).alias("text"), F.when(good, "article").alias("basis"), F.when(good, F.concat(F.lit("https://a.example/"), "document_id")).alias("final_url"), F.when(~good, "HTTP_ERROR").alias("error"), F.lit(1).alias("seq"))
    # half of them have had the contrary outcome before, some twice
    twice = F.explode(F.array_repeat(F.lit(0), (F.col("document_id") % 3 + 1).cast("int"))).alias("seq")
    earlier = outcomes.where("document_id % 2 = 0").select("document_id", F.when(~good, "older").alias("text"), F.when(~good, "older").alias("basis"), F.when(~good, "older").alias("final_url"), F.when(good, "OLDER").alias("error"), twice)
    return store.resolve(docs, state, outcomes.unionByName(earlier), F.lit(NOW).cast("timestamp"), order="seq")


@query(f"""WITH {_D}, o AS (SELECT *, {_OUTCOME} AS o FROM d)
SELECT document_id, CASE o WHEN 'ok' THEN 'discovered' WHEN 'bad' THEN 'failed' ELSE state END AS state, attempt_count + CASE WHEN o = 'bad' THEN 1 ELSE 0 END AS attempt_count,
  CASE o WHEN 'ok' THEN NULL WHEN 'bad' THEN 'HTTP_ERROR' ELSE last_error_code END AS last_error_code, CASE WHEN o = 'ok' THEN 'article' ELSE 'metadata' END AS content_basis,
  CASE WHEN o = 'ok' THEN sha256('text ' || document_id) END AS content_sha256, CASE WHEN o = 'ok' THEN length('text ' || document_id) ELSE 0 END AS content_characters FROM o""")
def resolved_documents(spark, sf_dir):
    return _resolved(spark, sf_dir)[0].select("document_id", "state", "attempt_count", "last_error_code", "content_basis", "content_sha256", F.col("content_characters").cast("long").alias("content_characters"))


@query(f"""WITH {_D} SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'https://a.example/' || document_id END AS final_url, CASE document_id % 3 WHEN 0 THEN 'fetched' WHEN 1 THEN 'HTTP_ERROR' ELSE 'new' END AS fetch_status, document_id % 3 < 2 AS touched FROM d""")
def resolved_states(spark, sf_dir):
    return _resolved(spark, sf_dir)[1].select("document_id", "final_url", "fetch_status", F.col("updated_at").isNotNull().alias("touched"))


def _agenda(spark, sf_dir, force):
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    sent = F.lit("2024-01-01 00:00:00").cast("timestamp")
    none = F.lit(None)
    stored = c.where("c_custkey % 3 < 2").select(key.cast("string").alias("agenda_day"), F.lit("old").alias("content"), F.when(key % 3 == 0, "delivered").otherwise("failed").alias("state"), F.when(key % 3 == 0, '["1"]').alias("message_ids"), F.when(key % 3 == 0, sent).alias("delivered_at"), F.when(key % 3 == 1, "X").alias("last_error_code"), sent.alias("created_at"), sent.alias("updated_at"))
    # each wish comes after an older one of the same day
    wishes = F.explode(F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(x).alias("content")) for k, x in enumerate(("older", "new"))])).alias("w")
    new = c.where("c_custkey % 2 = 0").select(key.cast("string").alias("agenda_day"), none.cast("string").alias("other"), wishes).select("agenda_day", "other", "w.*")
    return store.agenda_after(stored, new, ["agenda_day"], F.lit(NOW).cast("timestamp"), force, order="seq").select("agenda_day", "content", "state", "message_ids", "last_error_code")


_AGENDA = """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS agenda_day, c_custkey % 3 AS k, c_custkey % 2 = 0 AS wanted FROM customer WHERE c_custkey % 3 < 2 OR c_custkey % 2 = 0)
SELECT agenda_day, CASE WHEN {new} THEN 'new' ELSE 'old' END AS content, CASE WHEN {new} THEN 'pending' WHEN k = 0 THEN 'delivered' ELSE 'failed' END AS state,
  CASE WHEN NOT ({new}) AND k = 0 THEN '["1"]' END AS message_ids, CASE WHEN NOT ({new}) AND k = 1 THEN 'X' END AS last_error_code FROM c"""


@query(_AGENDA.format(new="k = 2"))
def agenda_inserted(spark, sf_dir):
    return _agenda(spark, sf_dir, False)


@query(_AGENDA.format(new="k = 2 OR wanted"))
def agenda_forced(spark, sf_dir):
    return _agenda(spark, sf_dir, True)


def _attempts(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    key = F.col("event_id")
    state = F.when(key % 4 == 0, "pending").when(key % 4 == 1, "failed").when(key % 4 == 2, "delivered").otherwise("cancelled")
    stored = e.where("event_id % 5 < 4").select(key.alias("attempt"), F.col("event_type").alias("content"), state.alias("state"), (key % 3).cast("int").alias("progress"), F.when(key % 4 == 1, "X").alias("last_error_code"))
    # a third of the wishes come after another one for the same attempt
    wishes = F.filter(F.array(F.struct(F.lit(0).alias("seq"), F.lit("older").alias("content")), F.struct(F.lit(1).alias("seq"), F.when(key % 2 == 0, "moved").otherwise(F.col("event_type")).alias("content"))), lambda w: (w["seq"] == 1) | (key % 3 == 0))
    wanted = e.where("event_id % 5 > 0").select(key.alias("attempt"), F.explode(wishes).alias("w")).select("attempt", "w.*")
    deliveries = stored.select("attempt", F.lit("d").alias("destination"), F.lit("sent").alias("state"))
    return store.attempts_after(stored, wanted, deliveries, ["attempt"], ["content"], destinations=["d", "e", "d"], order="seq")


_A = """WITH e AS (SELECT event_id AS attempt, event_type, ['pending', 'failed', 'delivered', 'cancelled'][event_id % 4 + 1] AS s, event_id % 5 < 4 AS stored, event_id % 5 > 0 AS wanted, event_id % 2 = 0 AS moved FROM events),
a AS (SELECT *, stored AND wanted AND moved AND s IN ('pending', 'failed') AS again FROM e WHERE stored OR wanted)"""


@query(_A + """ SELECT attempt, CASE WHEN again OR NOT stored AND moved THEN 'moved' ELSE event_type END AS content, CASE WHEN again OR NOT stored THEN 'pending' ELSE s END AS state,
  CAST(CASE WHEN again OR NOT stored THEN 0 ELSE attempt % 3 END AS INTEGER) AS progress, CASE WHEN stored AND NOT again AND s = 'failed' THEN 'X' END AS last_error_code, NOT stored AS created FROM a""")
def attempts_synced(spark, sf_dir):
    return _attempts(spark, sf_dir).attempts.drop("reset")


@query(_A + """ SELECT attempt, 'd' AS destination, 'sent' AS state FROM a WHERE stored AND NOT again
UNION ALL SELECT attempt, 'd', 'pending' FROM a WHERE wanted AND (again OR NOT stored) UNION ALL SELECT attempt, 'e', 'pending' FROM a WHERE wanted""")
def deliveries_kept(spark, sf_dir):
    return _attempts(spark, sf_dir).deliveries


@query(_A + " SELECT count(*) FILTER (NOT stored) AS created FROM a")
def attempts_created(spark, sf_dir):
    found = _attempts(spark, sf_dir)
    return found.attempts.agg(found.n_created.alias("created"))


@query("""WITH t AS (SELECT event_id, [200, 429, 503, 404, 201, 401, 403][event_id % 7 + 1] AS status, event_id % 4 AS attempt, event_id % 2 = 0 AS bot, value - 50 AS asked, event_id % 3 = 0 AS named FROM events),
a AS (SELECT *, CASE WHEN status < 400 THEN 'done' WHEN (status = 429 OR status >= 500) AND attempt < 3 THEN 'retry' ELSE 'fail' END AS action FROM t)
SELECT event_id, action, CAST(CASE WHEN action <> 'retry' THEN 0 WHEN status = 429 AND named THEN CASE WHEN asked < 0 THEN 0 WHEN asked > 30 THEN 30 ELSE asked END WHEN status = 429 THEN 1 ELSE 2 ** attempt END AS DOUBLE) AS wait,
  CASE WHEN action = 'fail' THEN CASE WHEN status = 429 THEN 'DISCORD_RATE_LIMITED' WHEN bot AND status = 401 THEN 'DISCORD_BOT_UNAUTHORIZED' WHEN bot AND status = 403 THEN 'DISCORD_BOT_FORBIDDEN'
    WHEN bot AND status = 404 THEN 'DISCORD_BOT_CHANNEL_NOT_FOUND' ELSE 'DISCORD_DELIVERY_FAILED' END END AS error FROM a""")
def send_retries(spark, sf_dir):
    key = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, [200, 429, 503, 404, 201, 401, 403])), (key % 7 + 1).cast("int"))
    transport = F.when(key % 2 == 0, "bot").otherwise("webhook")
    found = store.next_try(status, key % 4, F.when(key % 3 == 0, F.col("value") - 50), transport)
    return read(spark, sf_dir, "events").select("event_id", found.alias("t")).select("event_id", "t.*")


@query("""WITH t AS (SELECT l_orderkey AS k, l_linenumber AS c, (l_partkey + l_linenumber) % 6 AS m FROM lineitem), l AS (SELECT k, c, max(m) AS m FROM t GROUP BY ALL),
r AS (SELECT k, c, row_number() OVER (PARTITION BY k ORDER BY c) AS r FROM l WHERE m < 4), n AS (SELECT l.k, (SELECT count(*) FROM r WHERE r.k = l.k AND r.c = r.r) AS n_sent FROM l GROUP BY l.k)
SELECT n.k, n_sent, CASE l.m WHEN 4 THEN 'DISCORD_DELIVERY_FAILED' WHEN 5 THEN 'DISCORD_RATE_LIMITED' END AS error FROM n LEFT JOIN l ON l.k = n.k AND l.c = n_sent + 1 AND l.m >= 4""")
def chunks_sent(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    m = (F.col("l_partkey") + F.col("l_linenumber")) % 6
    status = F.when(m == 4, 502).when(m == 5, 429).otherwise(200)
    tries = line.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("chunk_no"), m.alias("attempt"), status.alias("status"))
    return store.sent_progress(tries, ["k"])


@query("""SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 100""")
def filtered_top(spark, sf_dir):
    return store.first_matching(read(spark, sf_dir, "events"), F.col("event_type") == "error", 100, F.desc("ts"), F.col("event_id")).select("event_id", "event_type")


@query("""SELECT 'n' || n_nationkey AS id, n_name AS name, NULL AS region FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, r_regionkey FROM region""")
def concatenated_sources(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return store.concatenated(n, read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("region")))


@query("SELECT DISTINCT event_type, user_id FROM events")
def message_union(spark, sf_dir):
    return store.message_sets(read(spark, sf_dir, "events"), ["event_type"], "user_id")


@query("SELECT doc_id, array_to_string(string_split(text, ' ')[1:5], ' ') AS first_words FROM documents")
def bounded_lists(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(store.bounded_list(F.split("text", " "), 5), " ").alias("first_words"))


@query("SELECT event_id, ts - INTERVAL 1 DAY AS since FROM events")
def period_start(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", store.one_day_before(F.col("ts")).alias("since"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN NOT contains(url, '1') WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS allowed FROM (SELECT page_id, 'https://s.example/p' || page_id AS url FROM pages)""")
def robots_checked(spark, sf_dir):
    key = F.col("page_id")
    every, other = "User-agent: *\nDisallow: /", "User-agent: *\nDisallow: /none"
    pages = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://s.example/p"), key).alias("url"))
    text = F.when(key % 4 == 0, F.when(F.contains("url", F.lit("1")), every).otherwise(other)).when(key % 4 == 1, every).when(key % 4 == 2, "no rules").otherwise(every)
    status = F.when(key % 4 == 1, 404).otherwise(200)
    return pages.select("page_id", store.robots_allow("reader")(status, text, F.col("url")).alias("allowed"))


# ---- tables and deliveries that outlive a run -------------------------------------------------------------------


def _ledger(spark, sf_dir):
    """A change log of orders in three commits, compacted between the second and the third: their prices, halves of those with
    an even key, and zero for multiples of five; and the number of the second commit."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    log = tables.ChangeLog(spark, scratch(spark, "ledger"), "k long, price double", ["k"])
    log.append(orders)
    backup = log.append(orders.where("k % 2 = 0").withColumn("price", F.col("price") / 2))
    log.compact()
    log.append(orders.where("k % 5 = 0").withColumn("price", F.lit(0.0)))
    return log, backup


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN o_totalprice / 2 ELSE o_totalprice END AS price FROM orders")
def log_now(spark, sf_dir):
    return _ledger(spark, sf_dir)[0].rows()


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 2 ELSE o_totalprice END AS price FROM orders")
def log_as_of_a_snapshot(spark, sf_dir):
    log, backup = _ledger(spark, sf_dir)
    return log.rows(backup)


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN -1 WHEN o_orderkey % 2 = 0 THEN o_totalprice / 2 ELSE o_totalprice END AS price FROM orders")
def log_restored(spark, sf_dir):
    log, backup = _ledger(spark, sf_dir)
    log.reset()
    log.restore(backup)
    log.append(log.rows().where("k % 7 = 0").withColumn("price", F.lit(-1.0)))
    return log.rows()


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 4 AS n, c_custkey % 3 AS bad, c_custkey % 5 AS kind FROM customer)
SELECT 'c' || k AS delivery_id, run, CAST(n AS INTEGER) AS n_chunks, CAST(CASE WHEN run = 1 OR bad >= n THEN n ELSE bad END AS INTEGER) AS n_sent,
  CASE WHEN run = 0 AND bad < n THEN CASE kind WHEN 0 THEN 'DISCORD_RATE_LIMITED' WHEN 1 THEN 'DISCORD_BOT_FORBIDDEN' ELSE 'DISCORD_DELIVERY_FAILED' END END AS error
FROM c, (SELECT unnest([0, 1]) AS run)""")
def chunks_delivered(spark, sf_dir):
    """Messages to customers go out twice: on the first run chunk `bad` is refused, the second one goes on there. Chunks that were
    taken would be lost if they were asked for again."""
    chunk_sink.register(spark)
    path, key = scratch(spark, "deliveries").removeprefix("file:"), F.col("c_custkey")
    refused = F.element_at(F.array(*map(F.lit, ["429:99", "403", "502", "none", "lost"])), (key % 5 + 1).cast("int"))
    runs = []
    for run in (0, 1):
        answer = lambda k, run=run: F.when(k < key % 3, "lost" if run else "429:0 200").when((k == key % 3) & F.lit(run == 0), refused).otherwise("200")
        chunks = F.transform(F.slice(F.array(*map(F.lit, range(3))), F.lit(1), (key % 4).cast("int")), lambda k: F.concat(k.cast("string"), F.lit("|"), answer(k)))
        rows = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), key).alias("delivery_id"), F.lit("d").alias("destination"), F.when(key % 5 == 1, "bot").otherwise("webhook").alias("transport"), chunks.alias("chunks"))
        chunk_sink.dealt(rows).write.format("chunks").mode("append").option("path", path).option("waitScale", "0").save()
        runs.append(chunk_sink.log(spark, path))
    first = runs[0].select("delivery_id", F.lit(0).alias("run"), "n_chunks", "n_sent", "error")
    names = runs[0].select(F.input_file_name().alias("file")).distinct()
    later = runs[1].withColumn("file", F.input_file_name()).join(names, "file", "left_anti")
    return first.unionByName(later.select("delivery_id", F.lit(1).alias("run"), "n_chunks", "n_sent", "error"))


# ---- languages --------------------------------------------------------------------------------------------------

_GRAM = "((CAST(unicode(g[1:1]) AS BIGINT) * 131 + CASE WHEN length(g) > 1 THEN unicode(g[2:2]) ELSE 0 END) * 131 + CASE WHEN length(g) > 2 THEN unicode(g[3:3]) ELSE 0 END) % 4093"


@query(rf"""WITH w AS (SELECT doc_id, lang, doc_id % 5 = 0 AS held_out, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+')) AS w FROM documents),
g AS (SELECT doc_id, lang, held_out, left('^' || w, 3) AS g FROM w UNION ALL SELECT doc_id, lang, held_out, right(w || '$', 3) FROM w),
f AS (SELECT doc_id, lang, held_out, {_GRAM} AS b FROM g),
n AS (SELECT lang, b, count(*) AS n FROM f WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL), t AS (SELECT lang, sum(n) AS total FROM n GROUP BY lang),
e AS (SELECT t.lang, e.b, ln((coalesce(n, 0) + 0.5) / (total + 0.5 * 4093)) AS weight FROM t CROSS JOIN (SELECT unnest(range(4093)) AS b) e LEFT JOIN n ON n.lang = t.lang AND n.b = e.b),
s AS (SELECT doc_id, e.lang, sum(weight) AS s FROM (SELECT doc_id, b FROM f) f JOIN e USING (b) GROUP BY ALL),
r AS (SELECT doc_id, lang AS detected, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS r FROM s)
SELECT documents.doc_id, lang, documents.doc_id % 5 = 0 AS held_out, detected FROM documents LEFT JOIN r ON r.doc_id = documents.doc_id AND r = 1""")
def language_detected(spark, sf_dir):
    """Profiles of four fifths of the documents, applied to all of them."""
    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.col("doc_id") % 5 == 0)
    found = language.detected(docs, language.profiles(docs.where(~F.col("held_out"))))
    return found.select("doc_id", "lang", "held_out", "detected")


# ---- checkpoints of an older schema -----------------------------------------------------------------------------


def _adopted(spark, sf_dir):
    """Orders as digests with a checkpoint of their own, to a, b, a destination that has gone, or none; a fifth has deliveries."""
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "delivered").otherwise("pending")
    digests = read(spark, sf_dir, "orders").select(k.alias("digest_id"), state.alias("state"), F.concat(F.lit('["'), k, F.lit('"]')).alias("message_ids"), F.element_at(F.array(*map(F.lit, ["a", "b", "gone", None])), (k % 4 + 1).cast("int")).alias("destination_key"), F.when(F.col("o_orderstatus") == "F", "X").alias("last_error_code"))
    stored = digests.where("digest_id % 5 = 0").select("digest_id", F.lit("a").alias("destination_key"), F.lit("delivered").alias("state"), F.lit("[]").alias("message_ids"), F.lit(None).cast("string").alias("last_error_code"), F.lit(None).cast("timestamp").alias("retired_at"))
    return store.adopted(digests, stored, ["a", "b"], "digest_id")


_ADOPTED = """WITH o AS (SELECT o_orderkey AS digest_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'delivered' ELSE 'pending' END AS state, ['a', 'b', 'gone', NULL][o_orderkey % 4 + 1] AS own, o_orderkey % 5 = 0 AS there FROM orders)"""


@query(_ADOPTED + """ SELECT digest_id, d AS destination_key, CASE WHEN d = own THEN state ELSE 'pending' END AS state, CASE WHEN d = own THEN '["' || digest_id || '"]' END AS message_ids,
  CASE WHEN d = own AND state = 'failed' THEN 'X' END AS last_error_code FROM o, (VALUES ('a'), ('b')) t(d) WHERE NOT there UNION ALL SELECT digest_id, 'a', 'delivered', '[]', NULL FROM o WHERE there""")
def deliveries_adopted(spark, sf_dir):
    return _adopted(spark, sf_dir)[1].drop("retired_at")


@query(_ADOPTED + " SELECT digest_id, CASE WHEN there THEN 'delivered' WHEN own IN ('a', 'b') AND state = 'failed' THEN 'failed' ELSE 'pending' END AS state FROM o")
def digests_after_adoption(spark, sf_dir):
    return _adopted(spark, sf_dir)[0].select("digest_id", "state")


# ---- the web and models -----------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT page_id, ['shut', 'half', 'open'][page_id % 3 + 1] AS h, page_id % 8 AS moves, ['ok', 'pdf', 'late', 'silent', '503'][page_id % 5 + 1] AS answer FROM pages),
u AS (SELECT *, 'https://' || h || page_id % 4 || '.example/' AS root, answer || '/' || page_id AS rest FROM p),
e AS (SELECT *, CASE WHEN page_id % 17 = 0 THEN 'ARTICLE_URL_BLOCKED' WHEN h = 'shut' THEN 'ARTICLE_ROBOTS_DENIED' WHEN moves > 5 THEN 'ARTICLE_REDIRECT_BLOCKED' WHEN h = 'half' AND answer = 'pdf' THEN 'ARTICLE_ROBOTS_DENIED'
  ELSE ['', 'ARTICLE_CONTENT_TYPE_UNSUPPORTED', 'ARTICLE_FETCH_DEADLINE_EXCEEDED', 'ARTICLE_FETCH_TIMEOUT', 'ARTICLE_FETCH_FAILED'][page_id % 5 + 1] END AS error FROM u)
SELECT CASE WHEN page_id % 17 = 0 THEN 'ftp://x.example/' || page_id ELSE root || moves || '/' || rest END AS url, CASE WHEN error = '' THEN root || '0/' || rest END AS final_url,
  CAST(CASE WHEN page_id % 17 = 0 OR h = 'shut' THEN 0 WHEN moves > 5 THEN 6 ELSE moves END AS INTEGER) AS hops, nullif(error, '') AS error FROM e""")
def articles_fetched(spark, sf_dir):
    """Links made of pages' numbers, to a web that answers by their paths."""
    k = F.col("page_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    link = F.concat(F.lit("https://"), pick(["shut", "half", "open"], 3), k % 4, F.lit(".example/"), k % 8, F.lit("/"), pick(["ok", "pdf", "late", "silent", "503"], 5), F.lit("/"), k)
    urls = read(spark, sf_dir, "pages").select(F.when(k % 17 == 0, F.concat(F.lit("ftp://x.example/"), k)).otherwise(link).alias("url"))
    return articles.articles(urls, articles.ScriptedWeb, "reader").select("url", "final_url", "hops", "error")


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}\n ]', '', 'g') AS t FROM documents),
l AS (SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')[1:10] AS lines FROM d),
e AS (SELECT doc_id, len(lines) AS n, length(t) > 1500 OR len(list_filter(lines, lambda x: length(x) > 200)) > 0 AS again, len(list_filter(lines, lambda x: length(x) > 200)) > 0 AS bad FROM l)
SELECT doc_id, CASE WHEN again AND bad THEN 'TITLE_LENGTH' END AS error, CAST(CASE WHEN again THEN 2 ELSE 1 END AS INTEGER) AS calls, CASE WHEN NOT (again AND bad) THEN n END AS n_items FROM e""")
def messages_extracted(spark, sf_dir):
    """Documents as messages to a model that says too much at first: long texts and lines go round again, long lines fail twice."""
    prompt = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}\n ]", "")
    found = calls.extracted(read(spark, sf_dir, "documents"), "doc_id", prompt, calls.lines_model)
    return found.select("doc_id", "error", "calls", F.when(F.col("items").isNotNull(), F.size("items")).cast("long").alias("n_items"))


# ---- state that lives in streams, as of an instant --------------------------------------------------------------

_KINDS = ["planned", "planned", "failed", "failed", "sent", "cancelled", "other"]


@query("""WITH RECURSIVE e AS (SELECT user_id || '-' || day(ts) AS attempt, ts AS "at", event_id AS seq, ['planned', 'planned', 'failed', 'failed', 'sent', 'cancelled', 'other'][event_id % 7 + 1] AS kind,
    CASE WHEN event_id % 11 > 0 THEN ts + to_hours(CAST(event_id % 5 AS BIGINT)) END AS start FROM events WHERE ts <= TIMESTAMP '2024-01-25 12:00:00'),
n AS (SELECT *, row_number() OVER (PARTITION BY attempt ORDER BY "at", seq) AS i FROM e),
f AS (SELECT DISTINCT attempt, CAST(0 AS BIGINT) AS i, CAST(NULL AS TIMESTAMP) AS "at", CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS state, 0 AS tries, CAST(NULL AS TIMESTAMP) AS start, CAST(NULL AS TIMESTAMP) AS ended, 0 AS ended_tries, false AS changed FROM e
  UNION ALL SELECT attempt, i, "at", seq, CASE WHEN plan THEN 'pending' WHEN step THEN CASE kind WHEN 'sent' THEN 'delivered' ELSE kind END ELSE now END, CASE WHEN plan THEN 0 WHEN step AND kind = 'failed' THEN tries + 1 ELSE tries END,
    CASE WHEN plan THEN new_start ELSE start END, CASE WHEN over THEN start END, tries, plan OR step
  FROM (SELECT *, coalesce(kind = 'planned' AND new_start IS NOT NULL AND (now IS NULL OR now IN ('pending', 'failed') AND start <> new_start), false) AS plan, coalesce(kind IN ('sent', 'failed', 'cancelled') AND now IN ('pending', 'failed'), false) AS step
    FROM (SELECT f.attempt, n.i, n."at", n.seq, n.kind, n.start AS new_start, f.start, f.tries, coalesce(f.state IN ('pending', 'failed') AND n."at" >= f.start, false) AS over, CASE WHEN f.state IN ('pending', 'failed') AND n."at" >= f.start THEN 'expired' ELSE f.state END AS now
      FROM f JOIN n ON n.attempt = f.attempt AND n.i = f.i + 1))),
z AS (SELECT attempt, arg_max(state, i) AS state, arg_max(tries, i) AS tries, arg_max(start, i) AS start FROM f WHERE i > 0 GROUP BY attempt)
SELECT attempt, epoch_us("at") AS "at", seq, state, tries FROM f WHERE changed UNION ALL SELECT attempt, epoch_us(ended), -1, 'expired', ended_tries FROM f WHERE ended IS NOT NULL
UNION ALL SELECT attempt, epoch_us(start), -1, 'expired', tries FROM z WHERE state IN ('pending', 'failed') AND start <= TIMESTAMP '2024-01-25 12:00:00'""")
def attempts_over_time(spark, sf_dir):
    """Events of a user on a day as those of an attempt."""
    k, at = F.col("event_id"), F.col("ts").cast("timestamp")
    start = F.when(k % 11 > 0, at + F.make_dt_interval(hours=k % 5))
    rows = read(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", F.day("ts")).alias("attempt"), at.alias("at"), k.alias("seq"), F.element_at(F.array(*map(F.lit, _KINDS)), (k % 7 + 1).cast("int")).alias("kind"), (start - F.expr("INTERVAL 5 MINUTES")).alias("reminder_at"), start.alias("start"))
    found = streaming.attempt_transitions(rows, F.lit("2024-01-25 12:00:00").cast("timestamp"))
    return found.withColumn("at", F.unix_micros("at"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS h, ts AS "at", user_id % 3 > 0 AS good, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT h, i, "at", "at" + CASE WHEN good THEN INTERVAL 36 HOUR ELSE INTERVAL 5 HOUR END AS ends, false AS served FROM e WHERE i = 1
  UNION ALL SELECT e.h, e.i, e."at", CASE WHEN f.ends > e."at" THEN f.ends ELSE e."at" + CASE WHEN good THEN INTERVAL 36 HOUR ELSE INTERVAL 5 HOUR END END, f.ends > e."at" FROM f JOIN e ON e.h = f.h AND e.i = f.i + 1)
SELECT CAST(h AS VARCHAR) AS url_hash, epoch_us("at") AS "at", served FROM f""")
def links_served(spark, sf_dir):
    """Events of a user as requests for one link, which two users in three can be given."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url_hash"), F.when(F.col("user_id") % 3 > 0, "good").otherwise("bad").alias("url"), F.col("ts").cast("timestamp").alias("at"))
    return streaming.served_from_cache(rows, F.col("url") == "good", 36 * 3600, 5 * 3600).withColumn("at", F.unix_micros("at"))
