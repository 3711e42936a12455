"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrid.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowgrid.llm import secrets

    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowgrid.llm import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def capture_list(pages: DataFrame) -> DataFrame:
    """Dated list events for the pages' own hosts and directories, by fixed rules over an md5.

    The test tables hold no lists: this one gives a third of the hosts and of the first directories an
    entry at some day of 2024, and takes half of those off again some days later.
    """
    from flowgrid.llm import urlfilter

    host = urlfilter.host_of(F.col("url"))
    first = F.regexp_extract(urlfilter.path_of(F.col("url")), "^(/[^/]+/)", 1)
    named = pages.select(F.lit("domain").alias("kind"), host.alias("pattern")).distinct().unionByName(
        pages.where(first != "").select(F.lit("prefix").alias("kind"), F.concat(host, first).alias("pattern")).distinct()
    )
    digit = lambda k, n: F.conv(F.substring(F.md5(F.concat("kind", F.lit(":"), "pattern")), k, n), 16, 10).cast("int")
    add = named.where((F.col("pattern") != "") & (digit(1, 2) % 3 == 0)).select(
        "kind", "pattern", F.when(digit(3, 1) < 8, "adult").otherwise("malware").alias("category"), digit(4, 2).alias("on"), digit(6, 2).alias("for")
    )
    start = F.date_add(F.lit("2024-01-01").cast("date"), F.col("on"))
    added = add.select("kind", "pattern", "category", F.lit("add").alias("action"), start.alias("day"))
    gone = add.where(F.col("for") % 2 == 0).select("kind", "pattern", "category", F.lit("remove").alias("action"), F.date_add(start, F.col("for") + 1).alias("day"))
    return added.unionByName(gone)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no fetch day; page_id gives one of 2024."""
    from flowgrid.llm import urlfilter

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    return urlfilter.evaluate(pages.withColumn("day", day), capture_list(pages))


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS DATE) AS day,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
         regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '^(.*/)', 1) AS dir
  FROM pages),
named AS (
  SELECT DISTINCT 'domain' AS kind, host AS pattern FROM p
  UNION SELECT DISTINCT 'prefix', host || regexp_extract(dir, '^(/[^/]+/)', 1) FROM p WHERE regexp_extract(dir, '^(/[^/]+/)', 1) <> ''),
h AS (SELECT *, md5(kind || ':' || pattern) AS m FROM named WHERE pattern <> ''),
e AS (
  SELECT kind, pattern, CASE WHEN CAST('0x' || substr(m, 3, 1) AS INTEGER) < 8 THEN 'adult' ELSE 'malware' END AS category,
         CAST(DATE '2024-01-01' + CAST('0x' || substr(m, 4, 2) AS INTEGER) AS DATE) AS starts, CAST('0x' || substr(m, 6, 2) AS INTEGER) AS n
  FROM h WHERE CAST('0x' || substr(m, 1, 2) AS INTEGER) % 3 = 0),
valid AS (SELECT kind, pattern, category, starts, CASE WHEN n % 2 = 0 THEN CAST(starts + n + 1 AS DATE) END AS ends FROM e),
labels AS (SELECT page_id, host, dir, day, string_split(host, '.') AS l, string_split(dir, '/') AS d FROM p WHERE host <> ''),
keys AS (
  SELECT page_id, day, 'domain' AS kind, array_to_string(l[i:], '.') AS pattern
  FROM (SELECT *, unnest(range(1, greatest(len(l) - 1, 1) + 1)) AS i FROM labels)
  UNION ALL
  SELECT page_id, day, 'prefix', host || array_to_string(d[1:i], '/') || '/'
  FROM (SELECT *, unnest(range(1, len(d))) AS i FROM labels WHERE dir <> '')),
hits AS (
  SELECT k.page_id, k.kind, k.pattern, v.category,
         row_number() OVER (PARTITION BY k.page_id ORDER BY length(k.pattern) DESC, k.kind DESC, k.pattern DESC) AS r
  FROM keys k JOIN valid v ON k.kind = v.kind AND k.pattern = v.pattern AND v.starts <= k.day AND (v.ends IS NULL OR k.day < v.ends))
SELECT p.page_id, p.url, p.day, x.kind IS NOT NULL AS blocked, x.category, x.kind AS list_kind, x.pattern AS list_pattern
FROM p LEFT JOIN (SELECT * FROM hits WHERE r = 1) x ON p.page_id = x.page_id
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowgrid.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("position", F.round("position", 9))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS k FROM s),
w AS (SELECT *, k + 1 AS weight, CASE k WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS slope, source_size * 3 AS cap FROM n),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
       / CAST(sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
f AS (SELECT *, first_value(CASE WHEN level * weight < cap THEN level END IGNORE NULLS) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS free FROM l),
t AS (SELECT source, source_size, slope, coalesce(free * weight, CAST(cap AS DOUBLE)) AS target FROM f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, CAST(floor(t.target) AS BIGINT) AS words,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, words // greatest(source_size, 1) AS passes, place / greatest(target, 1.0) AS c, slope / 2 AS a, 1 - slope / 2 AS b FROM p),
r AS (SELECT *, CAST(passes * size + least(greatest(words - passes * source_size - place, 0), size) AS BIGINT) AS taken FROM q)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(least(greatest(CASE WHEN a <> 0 THEN (sqrt(greatest(b * b + 4 * a * c, 0)) - b) / (2 * a) ELSE c END, 0), 1), 9) + 0.0 END AS position FROM r
"""


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowgrid.llm import html_extract

    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowgrid.llm import line_dedup

    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowgrid.llm import quality

    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "common_distance")})


def _op7_sql() -> str:
    from flowgrid.llm import quality

    words = r"'[^\x20\x09-\x0D]+'"
    count = lambda chars: f"length(regexp_replace(x, '[^{chars}]+', '', 'g'))"
    names = [*quality.CLASSES, "symbol", "space", "other"]
    classes = ", ".join(f"{count(c)} AS {k}" for k, c in ((k, c.replace("'", "''")) for k, c in quality.CLASSES.items()))
    part = lambda p, q: f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END)"
    by_class = " + ".join(part(f"(m.{k} / CAST(greatest(m.n_chars, 1) AS DOUBLE))", f"(m.r_{k} / CAST(m.r_total AS DOUBLE))") for k in names)
    sums = ', '.join(f'sum({k}) AS {k}' for k in names)
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS x FROM documents),
b AS (SELECT doc_id, lang, x, regexp_extract_all(x, {words}) AS w, length(x) AS n_chars, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  {count(quality.SYMBOLS)} AS n_symbols, {classes} FROM t),
m AS (SELECT *, n_symbols AS symbol, n_chars - word_chars AS space, word_chars - n_symbols - {' - '.join(quality.CLASSES)} AS other FROM b),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS c, w[i + 2] AS e FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM m)),
again AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, c, e) AS n FROM g) WHERE n > 1) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS l FROM m) WHERE regexp_matches(l, {words}) GROUP BY doc_id),
d AS (SELECT m.*, len(m.w) AS n_words, coalesce(dup.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, len(m.w) < 50 OR 100 * coalesce(again.n, 0) > 50 * len(m.w) AS base_failed
  FROM m LEFT JOIN again ON again.doc_id = m.doc_id LEFT JOIN dup ON dup.doc_id = m.doc_id),
good AS (SELECT * FROM d WHERE NOT base_failed AND n_chars >= 200),
refs AS (SELECT lang, {sums}, sum(n_chars) AS total FROM good WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 20),
whole AS (SELECT {sums}, sum(n_chars) AS total FROM good HAVING count(*) > 0),
v AS (SELECT doc_id, lang, n_chars, unnest(regexp_extract_all(lower(x), '\p{{L}}+')) AS v FROM m WHERE lang IS NOT NULL),
vc AS (SELECT lang, v, count(*) AS n FROM v WHERE n_chars >= 200 GROUP BY ALL),
cr AS (SELECT lang, v, n / CAST(total AS DOUBLE) AS q FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, v) AS r, sum(n) OVER (PARTITION BY lang) AS total FROM vc) WHERE r <= {quality.TOP}),
ct AS (SELECT lang, sum(q) AS q FROM cr GROUP BY lang),
n AS (SELECT doc_id, lang, count(*) AS total FROM v GROUP BY ALL),
cp AS (SELECT n.doc_id, v.v, any_value(cr.q) AS q, count(*) / CAST(any_value(n.total) AS DOUBLE) AS p FROM v JOIN n ON n.doc_id = v.doc_id JOIN cr ON cr.lang = v.lang AND cr.v = v.v GROUP BY ALL),
cs AS (SELECT doc_id, sum({part('p', 'q')} - q) AS there, sum(p) AS p FROM cp GROUP BY doc_id),
co AS (SELECT n.doc_id, n.total, coalesce(cs.there, 0) + ct.q AS there, 1 - coalesce(cs.p, 0) AS p, 1 - ct.q AS q FROM n JOIN ct ON ct.lang = n.lang LEFT JOIN cs ON cs.doc_id = n.doc_id),
cd AS (SELECT doc_id, total, sqrt(greatest((there + {part('p', 'q')}) / 2, 0)) AS far FROM co),
k AS (SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN n_chars >= 200 AND m.r_total IS NOT NULL THEN sqrt(greatest(({by_class}) / 2, 0)) END AS class_distance, CASE WHEN cd.total >= 50 AND own IS NOT NULL THEN cd.far END AS common_distance
  FROM (SELECT d.*, refs.lang AS own, {', '.join(f'CASE WHEN refs.lang IS NULL THEN whole.{k} ELSE refs.{k} END AS r_{k}' for k in [*names, 'total'])} FROM d LEFT JOIN refs ON refs.lang = d.lang LEFT JOIN whole ON TRUE) m
  LEFT JOIN cd ON cd.doc_id = m.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(class_distance, 6) AS class_distance, round(common_distance, 6) AS common_distance,
  NOT base_failed AND NOT (coalesce(class_distance, 0) > 0.25 OR coalesce(common_distance, 0) > 0.5) AS kept FROM k
"""


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowgrid.llm import topk

    return topk.search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowgrid.llm import neardup

    return neardup.find(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * i >= 80 * (u.n + v.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.doc_id),
m AS (SELECT doc_id, min(r) AS component_id FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = w.doc_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN m ON m.doc_id = w.doc_id
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowgrid.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_id": op2_language_id,
    "op3_url_filter": op3_url_filter,
    "op4_mixing": op4_mixing,
    "op5_main_text": op5_main_text,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_exact_topk": op8_exact_topk,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {
    "op3_url_filter": OP3_SQL,
    "op4_mixing": OP4_SQL,
    "op7_quality_rules": _op7_sql(),
    "op8_exact_topk": OP8_SQL,
    "op9_near_duplicates": OP9_SQL,
}
