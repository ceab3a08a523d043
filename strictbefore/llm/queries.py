"""One query per corpus operator, with production parameters over whole tables, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strictbefore.llm import bpe, chat, delta_lloyd, exact_dedup, lang_id, mixing, pitman_yor, runs, simhash, token_counts, token_files, topk, url_filter

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


@query(
    "op10_exact_dedup",
    r"""
    WITH n AS (
      SELECT doc_id, length(coalesce(text, '')) AS points,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
      FROM documents)
    SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           row_number() OVER g = 1 AS kept, text_sha256
    FROM n WINDOW g AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
    """,
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query(
    "op9_source_mixing",
    rf"""
    WITH RECURSIVE n AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
    s AS (
      SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM n GROUP BY source),
    w AS (
      SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 3 AS most FROM s),
    lv AS (
      SELECT *, row_number() OVER r AS pos,
             (sum(source_size) OVER ()::BIGINT - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
               / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW r AS (ORDER BY most / weight, source NULLS LAST)),
    f AS (SELECT min(pos) AS pos FROM lv WHERE level * weight <= most),
    t AS (
      SELECT lv.*, coalesce(least(most::DOUBLE, (SELECT level FROM lv JOIN f USING (pos)) * weight), most::DOUBLE) AS target FROM lv),
    b AS (
      SELECT *, CAST(ceil(source_size / {mixing.BLOCK}.0) AS BIGINT) AS blocks,
             CASE WHEN target >= most THEN most ELSE CAST(round(target) AS BIGINT) END AS words FROM t),
    q AS (
      SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * blocks + rest_blocks END AS take,
             CASE WHEN rest_blocks > 0 THEN rest - (rest_blocks - 1) * {mixing.BLOCK} ELSE {mixing.BLOCK} END AS last_words
      FROM (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE words % source_size END AS rest, CAST(ceil(rest / {mixing.BLOCK}.0) AS BIGINT) AS rest_blocks FROM b)),
    u AS (
      SELECT *, coalesce(sum(take) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, (sum(take) OVER ())::BIGINT AS slots FROM q),
    k AS (
      SELECT place, blocks, k, k % blocks AS nth, start + k AS ball, slots, CASE WHEN k = take - 1 THEN last_words ELSE {mixing.BLOCK} END AS lim
      FROM (SELECT *, unnest(range(take)) AS k FROM u WHERE take > 0)),
    walk AS (
      SELECT 0 AS round, place, k, 'slots' AS key, ball AS idx, slots AS n FROM k
      UNION ALL SELECT 0, place, k, 'blocks-' || place, nth, blocks - 1 FROM k WHERE nth < blocks - 1
      UNION ALL
      SELECT round, place, k, key, CASE WHEN substr(md5(key || ':' || round || ':' || greatest(idx, image)), 1, 1) < '8' THEN image ELSE idx END AS idx, n
      FROM (SELECT round + 1 AS round, place, k, key, idx, n, ((('0x' || substr(md5(key || ':' || (round + 1)), 1, 12))::BIGINT % n - idx) % n + n) % n AS image FROM walk WHERE round < {mixing.ROUNDS})),
    uses AS (
      SELECT place, k.k, coalesce(b.idx, nth) AS block, s.idx AS slot, lim
      FROM k JOIN (FROM walk WHERE round = {mixing.ROUNDS} AND key = 'slots') s USING (place, k)
      LEFT JOIN (FROM walk WHERE round = {mixing.ROUNDS} AND key <> 'slots') b USING (place, k)),
    d AS (
      SELECT n.*, q.place, q.source_size, q.target,
             coalesce(sum(size) OVER (PARTITION BY q.place ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM n JOIN q ON n.source IS NOT DISTINCT FROM q.source),
    p AS (
      SELECT doc_id, place, start, size, unnest(range(start // {mixing.BLOCK}, (start + size - 1) // {mixing.BLOCK} + 1)) AS block FROM d WHERE size > 0),
    g AS (
      SELECT doc_id, slot, least(start + size, (p.block + 1) * {mixing.BLOCK}, p.block * {mixing.BLOCK} + lim) - greatest(start, p.block * {mixing.BLOCK}) AS words
      FROM p JOIN uses USING (place, block)),
    m AS (SELECT doc_id, sum(words)::BIGINT AS taken, min(slot) AS slot FROM g WHERE words > 0 GROUP BY doc_id)
    SELECT doc_id, source, size, source_size, target, coalesce(taken, 0) AS taken, slot // {mixing.SHARD_SLOTS} AS shard, slot FROM d LEFT JOIN m USING (doc_id)
    """,
)
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: Conversation -7 of the contract: what a text may hold that looks like a template's marks.
TRICKY = "\\### Assistant: </turn> ok"


@query(
    "op7_chat_format",
    r"""
    WITH m AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    a AS (
      SELECT *, CASE WHEN role = 'user' AND (conv_id + turn) % 5 = 0 THEN 1 ELSE 0 END AS image, CASE WHEN role = 'user' AND (conv_id + turn) % 10 = 0 THEN 1 ELSE 0 END AS audio FROM m),
    n AS (
      SELECT *, coalesce(sum(image + audio) OVER (PARTITION BY conv_id, turn // 256 ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM a)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(length(role || text) + length(regexp_replace(role || text, '[^\\<]', '', 'g')) + length('<turn ' || '>.' || '</turn>.')
               + CASE WHEN image = 1 THEN length('<image:' || seen::BIGINT || '>') ELSE 0 END
               + CASE WHEN audio = 1 THEN length('<audio:' || (seen + 1)::BIGINT || '>') ELSE 0 END)::BIGINT AS formatted_chars,
           sum(image + audio)::BIGINT AS attachments, sum(image * 256 + audio * 64)::BIGINT AS expanded_tokens
    FROM n GROUP BY conv_id
    """,
)
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text")
    )
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_parts(said.withColumn("parts", with_attachments(F.col("text"))), "conv_id", "turn", "role", "parts"))


def with_attachments(text: Column) -> Column:
    """A message's parts: its text, and as the table has texts only, by a fixed rule an image after every fifth user message or so and a sound after every tenth."""
    nth, user = F.col("conv_id") + F.col("turn"), F.col("role") == "user"
    part = lambda kind, tokens: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("text"), F.concat_ws("-", F.lit(kind), "conv_id", "turn").alias("ref"), F.lit(tokens).cast("int").alias("tokens")))
    none = F.filter(part("image", None), lambda p: F.lit(False))
    image, audio = F.when(user & (nth % 5 == 0), part("image", None)).otherwise(none), F.when(user & (nth % 10 == 0), part("audio", 64)).otherwise(none)
    return F.concat(chat.text_part(text), image, audio)


def dated_list(hosts: DataFrame) -> DataFrame:
    """A blocklist's log by a fixed rule over host names, as the tables have none: key, list, at, added."""
    code = lambda i: F.ascii(F.substring(F.md5("host"), i, 1))
    day = ((code(1) * 16 + code(2)) % 300).cast("int")
    put = lambda key, name, days, added: F.struct(key.alias("key"), F.lit(name).alias("list"), F.to_timestamp(F.date_add(F.lit("2024-01-01").cast("date"), days)).alias("at"), F.lit(added).alias("added"))
    spam = F.when(code(3) % 3 == 0, F.array(put(F.col("host"), "spam", day, True), put(F.col("host"), "spam", day + 45, False), put(F.col("host"), "spam", day + 60, True)))
    path = F.concat("host", F.lit("/"), F.when(code(4) % 2 == 0, "en").otherwise("de"))
    paths = F.when(code(5) % 4 == 0, F.array(put(path, "mirror", day, True)))
    own = hosts.select("host").filter("host is not null").distinct().select(F.explode(F.concat(F.coalesce(spam, F.array()), F.coalesce(paths, F.array()))).alias("e")).select("e.*")
    parents = hosts.sparkSession.sql(
        """SELECT * FROM VALUES ('example.net', 'parked', timestamp'2024-06-01', true), ('example.net', 'parked', timestamp'2024-08-01', false),
           ('example.org', 'parked', timestamp'2024-11-15', true) AS t(key, list, at, added)"""
    )
    return own.unionByName(parents)


@query(
    "op8_url_filter",
    r"""
    WITH c AS (
      SELECT page_id, url, TIMESTAMP '2024-01-01' + INTERVAL (page_id % 366) DAY AS fetched,
             nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.|\.$', '', 'g'), '') AS host,
             regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?', 1), '/+', '/', 'g') AS path
      FROM pages),
    h AS (
      SELECT host, ascii(substr(md5(host), 1, 1)) * 16 + ascii(substr(md5(host), 2, 1)) AS d, ascii(substr(md5(host), 3, 1)) AS c3,
             ascii(substr(md5(host), 4, 1)) AS c4, ascii(substr(md5(host), 5, 1)) AS c5 FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL)),
    e AS (
      SELECT host AS key, 'spam' AS list, TIMESTAMP '2024-01-01' + INTERVAL (d % 300) DAY AS f, TIMESTAMP '2024-01-01' + INTERVAL (d % 300 + 45) DAY AS t FROM h WHERE c3 % 3 = 0
      UNION ALL SELECT host, 'spam', TIMESTAMP '2024-01-01' + INTERVAL (d % 300 + 60) DAY, NULL FROM h WHERE c3 % 3 = 0
      UNION ALL SELECT host || '/' || CASE WHEN c4 % 2 = 0 THEN 'en' ELSE 'de' END, 'mirror', TIMESTAMP '2024-01-01' + INTERVAL (d % 300) DAY, NULL FROM h WHERE c5 % 4 = 0
      UNION ALL SELECT 'example.net', 'parked', TIMESTAMP '2024-06-01', TIMESTAMP '2024-08-01'
      UNION ALL SELECT 'example.org', 'parked', TIMESTAMP '2024-11-15', NULL),
    m AS (
      SELECT c.page_id, e.* FROM c JOIN e ON fetched >= f AND (t IS NULL OR fetched < t)
        AND (host = key OR ends_with(host, '.' || key) OR (contains(key, '/') AND starts_with(rtrim(host || path, '/') || '/', key || '/')))),
    g AS (
      SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
             arg_min(key, CASE WHEN contains(key, '/') THEN 1000 + length(key) ELSE -length(key) END) AS key FROM m GROUP BY page_id)
    SELECT page_id, host, fetched, key IS NOT NULL AS blocked, coalesce(lists, '') AS lists, key FROM c LEFT JOIN g USING (page_id)
    """,
)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.to_timestamp(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    captures = pages.withColumn("fetched", fetched)
    listed = url_filter.intervals(dated_list(captures.select(url_filter.host_of(F.col("url")).alias("host"))))
    out = url_filter.evaluate(captures, listed, "page_id", "url", "fetched")
    return out.select(F.col("id").alias("page_id"), "host", "fetched", "blocked", F.array_join("lists", ",").alias("lists"), "key")


def vocabulary(name: str) -> str:
    """Where this installation keeps a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    said = lang_id.predict(docs, lang_id.learn(docs))
    return said.select(F.col("id").alias("doc_id"), lang_id.held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return counted.withColumnRenamed("id", "doc_id")


@query("op3_bpe_round_trip")
def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return coded.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op4_simhash_components")
def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query(
    "op5_topk_search",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS q FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
)
def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter("vec_id % 100 = 0"), "vec_id", "embedding")


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), token_files.fresh_folder(spark))
    return token_files.read(manifest).select(
        F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.find(table(spark, sf_dir, "documents"), rewrite=True).withColumnRenamed("id", "doc_id").drop("runs", "collapsed")


def lloyd_sql(k: int = delta_lloyd.K, rounds: int = delta_lloyd.ROUNDS, dims: int = delta_lloyd.DIMS, salt: int = delta_lloyd.SALT, scale: int = delta_lloyd.SCALE) -> str:
    """Lloyd's rounds written out one after another: each assigns all vectors afresh."""
    parts = [
        f"""v AS MATERIALIZED (
      SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})) AS q FROM embeddings
      WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    n AS MATERIALIZED (SELECT vec_id, q, list_inner_product(q, q) AS qq FROM v),
    c0 AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), q) - 1 AS cluster, q AS m FROM v WHERE vec_id IS NOT NULL ORDER BY cluster LIMIT {k})"""
    ]
    for turn in range(rounds + 1):
        parts.append(f"""a{turn} AS MATERIALIZED (
      SELECT vec_id, q, d, cluster FROM (
        SELECT vec_id, q, cluster, qq - 2 * list_inner_product(q, m) + list_inner_product(m, m) AS d,
               row_number() OVER (PARTITION BY vec_id ORDER BY qq - 2 * list_inner_product(q, m) + list_inner_product(m, m), cluster) AS place
        FROM n CROSS JOIN c{turn}) WHERE place = 1)""")
        if turn < rounds:
            parts.append(f"""s{turn} AS (
      SELECT cluster, i, sum(q[i])::BIGINT AS t, count(*) AS n FROM a{turn} CROSS JOIN range(1, {dims + 1}) AS r(i) GROUP BY cluster, i),
    c{turn + 1} AS MATERIALIZED (
      SELECT c.cluster, coalesce(x.m, c.m) AS m FROM c{turn} c
      LEFT JOIN (SELECT cluster, list(((t - (t % n + n) % n) // n)::DOUBLE ORDER BY i) AS m FROM s{turn} GROUP BY cluster) x USING (cluster))""")
    return f"""
    WITH {", ".join(parts)}
    SELECT vec_id, cluster::INT AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
           sha256(array_to_string(list_transform(m, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} USING (cluster)
    """


@query("op11_delta_lloyd", lloyd_sql())
def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd.clusters(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op12_pitman_yor")
def op12_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
