"""Queries over documents, pages, labels and events: sniffing, dispatch, runs, change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kilnwork.functions import names
from kilnwork.operators import keyed, ordered, resolve
from kilnwork.plans.registry import query, table

_SNIFF = """CASE WHEN starts_with(ltrim(substr({0}, 1, 16)), '<svg') OR starts_with(ltrim(substr({0}, 1, 16)), '<?xml') THEN 'svg'
    WHEN starts_with(lower(ltrim(substr({0}, 1, 16))), '<!doctype') THEN 'html' WHEN starts_with({0}, '%PDF') THEN 'pdf'
    WHEN starts_with(ltrim(substr({0}, 1, 16)), '{{') OR starts_with(ltrim(substr({0}, 1, 16)), '[') THEN 'json' ELSE 'text' END"""
_ALL = "SELECT html AS payload FROM pages UNION ALL SELECT text FROM documents"


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "html").toDF("payload").unionAll(table(spark, sf_dir, "documents", "text").toDF("payload"))


@query("sniff_kind", f"SELECT kind, count(*) AS n FROM (SELECT {_SNIFF.format('payload')} AS kind FROM ({_ALL})) GROUP BY kind")
def sniff_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payloads(spark, sf_dir).select(names.sniff(F.col("payload")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


_DISPATCH = """CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, 'icense') THEN 'licence'
    WHEN contains(text, '***') THEN 'signs' WHEN text = upper(text) THEN 'upper' WHEN contains(text, '@') THEN 'address'
    WHEN contains(text, chr(10)) THEN 'lines' ELSE 'line' END"""


@query("dispatch_kind", f"SELECT kind, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT {_DISPATCH} AS kind, n_chars FROM documents) GROUP BY kind")
def dispatch_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    kind = (
        F.when(text.isNull() | (text == ""), "empty").when(text.contains(" | "), "table").when(text.contains("icense"), "licence").when(text.contains("***"), "signs")
        .when(text == F.upper(text), "upper").when(text.contains("@"), "address").when(text.contains("\n"), "lines").otherwise("line")
    )
    return table(spark, sf_dir, "documents", "text", "n_chars").select(kind.alias("kind"), "n_chars").groupBy("kind").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("guard_consistent", "SELECT source, count(*) FILTER (WHERE n_chars = length(text)) AS consistent, count(*) AS n FROM documents GROUP BY source")
def guard_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "source", "text", "n_chars").groupBy("source").agg(F.count_if(F.col("n_chars") == F.char_length("text")).alias("consistent"), F.count("*").alias("n"))


@query("first_wins_dedup", "SELECT md5(text) AS key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("key"), "doc_id", "source")
    return keyed.first_wins(docs, ["key"], [F.col("doc_id")])


@query("last_wins_dedup", "SELECT md5(text) AS key, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY text")
def last_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("key"), "doc_id", "source")
    return keyed.last_wins(docs, ["key"], [F.col("doc_id")])


@query("row_dedup_offset", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS points_to FROM documents")
def row_dedup_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content"))
    first = docs.groupBy("content").agg(F.min("doc_id").alias("points_to"))
    return docs.join(first, "content").select("doc_id", "points_to")


@query(
    "hash_change_detect",
    """SELECT o.doc_id, CASE WHEN c.doc_id IS NULL THEN 'missing' WHEN c.body = o.text THEN 'same' ELSE 'changed' END AS status
       FROM documents o LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(text) ELSE text END AS body FROM documents WHERE doc_id % 7 <> 0) c USING (doc_id)""",
)
def hash_change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    edited = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text")))
    return resolve.changed(docs, edited, "doc_id", "text").select("doc_id", "status")


@query(
    "topk_smallest_per_kind",
    "SELECT lang, source, doc_id, n_chars, rn FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS rn FROM documents WHERE regexp_matches(source, '^src1([^0-9]|$)')) WHERE rn <= 3",
)
def topk_smallest_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("lang", "source").orderBy("n_chars", "doc_id")).cast("long")
    return table(spark, sf_dir, "documents").where(F.col("source").rlike("^src1([^0-9]|$)")).select("lang", "source", "doc_id", "n_chars", rn.alias("rn")).where("rn <= 3")


@query(
    "diverse_sample",
    """WITH small AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS nth FROM documents QUALIFY nth <= 10),
       ranked AS (SELECT *, row_number() OVER (ORDER BY n_chars, doc_id) AS pos FROM small),
       held AS (SELECT *, CASE WHEN pos <= 5 THEN 0 WHEN nth = 1 THEN 1 ELSE 2 END AS pass FROM ranked)
       SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (ORDER BY pass, pos) AS taken FROM held) WHERE taken <= 10""",
)
def diverse_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents: the five smallest, then the smallest of unseen sources, then the next smallest."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy("n_chars", "doc_id"))
    small = table(spark, sf_dir, "documents", "doc_id", "source", "n_chars").withColumn("nth", nth).where("nth <= 10")
    five = small.orderBy("n_chars", "doc_id").limit(5).select("doc_id", F.lit(0).alias("pass"))
    ranked = small.join(F.broadcast(five), "doc_id", "left").withColumn("pass", F.coalesce("pass", F.when(F.col("nth") == 1, 1).otherwise(2)))
    return ranked.orderBy("pass", "n_chars", "doc_id").limit(10).select("doc_id", "source", "n_chars")


_EXT = "regexp_extract({0}, '\\.([^./]*)$', 1)"


@query(
    "replace_extension",
    f"""SELECT page_id, CASE WHEN lower({_EXT.format('path')}) = 'html' THEN path WHEN {_EXT.format('path')} <> '' THEN regexp_replace(path, '\\.[^./]*$', '') || '.html' ELSE path || '.html' END AS named
        FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages)""",
)
def replace_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("path"))
    return pages.select("page_id", names.with_extension(F.col("path"), "html").alias("named"))


@query(
    "path_parse",
    "SELECT page_id, split_part(rest, '/', 1) AS host, split_part(rest, '/', 2) AS folder, regexp_extract(rest, '([^/]*)$', 1) AS leaf FROM (SELECT page_id, regexp_replace(split_part(url, '://', 2), '[?#].*$', '') AS rest FROM pages)",
)
def path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.regexp_replace(F.split_part("url", F.lit("://"), F.lit(2)), "[?#].*$", "")
    pages = table(spark, sf_dir, "pages").select("page_id", rest.alias("rest"))
    part = lambda n: F.split_part("rest", F.lit("/"), F.lit(n))
    return pages.select("page_id", part(1).alias("host"), part(2).alias("folder"), F.regexp_extract("rest", "([^/]*)$", 1).alias("leaf"))


@query(
    "take_until",
    """SELECT doc_id, len(kept) AS n_kept, array_to_string(kept, ' ') AS kept FROM (SELECT doc_id, CASE WHEN list_position(w, 'the') > 0 THEN w[1:list_position(w, 'the') - 1] ELSE w END AS kept
       FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))""",
)
def take_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = keyed.take_until(F.col("w"), F.lit("the"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    return docs.select("doc_id", kept.alias("k")).select("doc_id", F.size("k").cast("long").alias("n_kept"), F.array_join("k", " ").alias("kept"))


@query(
    "permissive_skip",
    "SELECT good IS NOT NULL AS decoded, count(*) AS n, coalesce(sum(good), 0)::BIGINT AS total FROM (SELECT TRY_CAST(regexp_extract(url, '/([0-9a-z]+)[^/]*$', 1) AS BIGINT) AS good FROM pages) GROUP BY 1",
)
def permissive_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that don't decode are dropped from the total and counted."""
    good = F.regexp_extract("url", "/([0-9a-z]+)[^/]*$", 1).try_cast("long")
    return table(spark, sf_dir, "pages").select(good.alias("good")).groupBy(F.col("good").isNotNull().alias("decoded")).agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("total"))


@query("base64_roundtrip", "SELECT doc_id, replace(to_base64(encode(source)), chr(10), '') AS coded, decode(from_base64(to_base64(encode(source)))) = source AS same FROM documents")
def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.base64(F.col("source").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", coded.alias("coded"), (F.unbase64(coded).cast("string") == F.col("source")).alias("same"))


@query("hex_roundtrip", "SELECT doc_id, lower(hex(encode(lang))) AS coded, decode(unhex(hex(encode(lang)))) = lang AS same FROM documents")
def hex_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.lower(F.hex(F.col("lang").cast("binary")))
    return table(spark, sf_dir, "documents").select("doc_id", coded.alias("coded"), (names.checked_hex(coded).cast("string") == F.col("lang")).alias("same"))


@query("record_tags", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN page_id WHEN 1 THEN page_id % 65536 END AS tag FROM pages")
def record_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags from hexadecimal text, with and without 0x; text that is none gives null."""
    k, digits = F.col("page_id"), F.hex("page_id")
    text = F.when(k % 4 == 0, F.concat(F.lit("0x"), F.lower(digits))).when(k % 4 == 1, F.lpad(F.hex(k % 65536), 8, "0")).when(k % 4 == 2, F.concat(digits, F.lit("g"))).otherwise("")
    return table(spark, sf_dir, "pages", "page_id").select("page_id", names.tag_of(text).alias("tag"))


@query("order_fingerprint", "SELECT lang, substr(sha256(string_agg(source, '|' ORDER BY source)), 1, 32) AS fingerprint FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang")
def order_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same 32 hexadecimal digits for the same set of names, whatever their order."""
    every = F.array_sort(F.collect_set("source"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.substring(F.sha2(F.array_join(every, "|"), 256), 1, 32).alias("fingerprint"))


_RUNS_SQL = """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
    g AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, event_type ORDER BY pos) AS island FROM e),
    r AS (SELECT user_id, event_type AS value, min(pos) AS first, count(*) AS n FROM g GROUP BY user_id, event_type, island)"""


def _event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.runs(table(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")


@query("rle_runs", _RUNS_SQL + " SELECT user_id, value, first, n FROM r")
def rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_runs(spark, sf_dir).select("user_id", "value", "first", "n")


@query(
    "rle_tokens",
    _RUNS_SQL + """, m AS (SELECT *, CASE WHEN n = 1 AND lag(n) OVER (PARTITION BY user_id ORDER BY first) = 1 THEN 0 ELSE 1 END AS fresh FROM r),
    t AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY first) AS token FROM m)
    SELECT user_id, CASE WHEN max(t.n) > 1 THEN 'fill' ELSE 'literal' END AS kind, min(first) AS first, sum(t.n)::BIGINT AS n FROM t GROUP BY user_id, token""",
)
def rle_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.run_tokens(_event_runs(spark, sf_dir), ["user_id"]).select("user_id", "kind", "first", "n")


@query(
    "rle_tokens_cut",
    _RUNS_SQL + """, m AS (SELECT *, CASE WHEN n = 1 AND lag(n) OVER (PARTITION BY user_id ORDER BY first) = 1 THEN 0 ELSE 1 END AS fresh FROM r),
    t AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY first) AS token FROM m),
    w AS (SELECT user_id, token, CASE WHEN max(t.n) > 1 THEN 'fill' ELSE 'literal' END AS kind, min(first) AS first, sum(t.n)::BIGINT AS n FROM t GROUP BY user_id, token)
    SELECT user_id, kind, first + 2 * k AS first, least(2, n - 2 * k) AS n FROM w, LATERAL (SELECT unnest(range((n - 1) // 2 + 1)) AS k)""",
)
def rle_tokens_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens over the limit of a count are cut, and no element is lost."""
    return ordered.run_tokens(_event_runs(spark, sf_dir), ["user_id"], limit=2).select("user_id", "kind", "first", "n")


@query("rle_expand", "SELECT user_id, event_type AS value, count(*) AS n FROM events GROUP BY ALL")
def rle_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs expanded to their elements again, counted against the events themselves."""
    return ordered.expand(_event_runs(spark, sf_dir), ["user_id", "value"]).groupBy("user_id", "value").agg(F.count("*").alias("n"))


@query("json_props", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events", "event_type", "props").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("to_json_roundtrip", "SELECT event_id, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS doc, user_id AS again FROM events")
def to_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.to_json(F.struct("event_type", "user_id"))
    return table(spark, sf_dir, "events").select("event_id", doc.alias("doc"), F.from_json(doc, "event_type string, user_id long")["user_id"].alias("again"))


_MERGE = "FROM documents d LEFT JOIN (SELECT doc_id, quality FROM labels WHERE toxic = 0) l USING (doc_id)"


@query("upsert_merge", f"SELECT doc_id, CASE WHEN l.quality IS NULL THEN d.lang ELSE 'q' || l.quality END AS lang, l.quality IS NOT NULL AS replaced {_MERGE}")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang"))
    return resolve.upsert(table(spark, sf_dir, "documents", "doc_id", "lang"), changes, "doc_id", "lang")


@query(
    "merge_report",
    "SELECT count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS landed, count(*) FILTER (WHERE d.doc_id IS NULL) AS missed, count(*) FILTER (WHERE l.doc_id IS NULL) AS untouched FROM documents d FULL JOIN (SELECT doc_id + 50 AS doc_id FROM labels) l ON d.doc_id = l.doc_id",
)
def merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landings, entries that matched nothing, and rows nothing was offered for."""
    base = table(spark, sf_dir, "documents", "doc_id").withColumn("base", F.lit(1))
    offered = table(spark, sf_dir, "labels").select((F.col("doc_id") + 50).alias("doc_id"), F.lit(1).alias("offer"))
    both = base.join(offered, "doc_id", "full_outer")
    return both.agg(F.count_if(F.expr("base = 1 and offer = 1")).alias("landed"), F.count_if(F.expr("base is null")).alias("missed"), F.count_if(F.expr("offer is null")).alias("untouched"))


@query(
    "outcome_classify",
    f"SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN l.quality IS NULL THEN 'not_offered' WHEN d.lang <> 'en' THEN 'not_editable' WHEN d.n_chars > 5000 THEN 'size_mismatch' WHEN d.source = 'src0' THEN 'shared' ELSE 'installed' END AS outcome {_MERGE}) GROUP BY outcome",
)
def outcome_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id", "quality")
    rows = table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars").join(offers, "doc_id", "left")
    outcome = F.when(F.col("quality").isNull(), "not_offered").when(F.col("lang") != "en", "not_editable").when(F.col("n_chars") > 5000, "size_mismatch").when(F.col("source") == "src0", "shared").otherwise("installed")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(
    "full_outer_diff",
    "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'added' WHEN l.doc_id IS NULL THEN 'removed' ELSE 'both' END AS side FROM documents d FULL JOIN (SELECT doc_id + 50 AS doc_id FROM labels) l ON d.doc_id = l.doc_id",
)
def full_outer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "documents", "doc_id").withColumn("a", F.lit(1))
    after = table(spark, sf_dir, "labels").select((F.col("doc_id") + 50).alias("doc_id"), F.lit(1).alias("b"))
    return before.join(after, "doc_id", "full_outer").select("doc_id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("both").alias("side"))


@query(
    "census_equal",
    "SELECT count(*) FILTER (WHERE a.n IS DISTINCT FROM b.n) AS differing, count(*) AS kinds FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) a FULL JOIN (SELECT lang, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang) b ON a.lang = b.lang",
)
def census_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang")
    a = docs.groupBy("lang").agg(F.count("*").alias("a"))
    b = docs.join(table(spark, sf_dir, "labels", "doc_id"), "doc_id").groupBy("lang").agg(F.count("*").alias("b"))
    return a.join(b, "lang", "full_outer").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"), F.count("*").alias("kinds"))


@query(
    "diff_summary",
    "SELECT source, count(*) FILTER (WHERE l.quality = 0) AS differing, count(*) AS total, max(abs(d.n_chars - 1000)) AS peak FROM documents d JOIN labels l USING (doc_id) GROUP BY source",
)
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents", "doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id")
    out = rows.groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("differing"), F.count("*").alias("total"), F.max(F.abs(F.col("n_chars") - 1000)).alias("peak"))
    return out.orderBy(F.desc("differing"), "source")
