"""Queries over region, nation, customer, supplier, part and orders: links, resolution, ids, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kilnwork.functions import names
from kilnwork.operators import keyed, resolve
from kilnwork.plans.registry import query, table

_ATTRS = ["region", "nation", "segment"]


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer")


@query("link_left_join", "SELECT o_orderkey, c_name AS target FROM orders LEFT JOIN customer ON o_custkey + 100 = c_custkey")
def link_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 100).alias("key"))
    targets = _customers(spark, sf_dir).select(F.col("c_custkey").alias("key"), F.col("c_name").alias("target"))
    return resolve.link_join(links, targets, ["key"]).select("o_orderkey", "target")


@query("link_required_join", "SELECT s_suppkey, n_name AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def link_required_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("key"))
    targets = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("target"))
    return resolve.required_join(links, targets, ["key"]).select("s_suppkey", "target")


_FALLBACK = """WITH f AS (SELECT n_name AS name, n_nationkey AS id FROM nation UNION ALL SELECT r_name, 1000 + r_regionkey FROM region),
    p AS (SELECT name, s_suppkey AS target FROM f JOIN supplier ON s_nationkey = id AND s_acctbal > 8000),
    b AS (SELECT n_name AS name, c_custkey AS target FROM nation JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9800)"""


@query("fallback_resolution", _FALLBACK + " SELECT name, target, 'primary' AS via FROM p UNION ALL SELECT b.name, target, 'fallback' FROM b WHERE name NOT IN (SELECT name FROM p)")
def fallback_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names resolve by identifier to suppliers, and those without one to customers."""
    nation = table(spark, sf_dir, "nation")
    wanted = nation.select(F.col("n_name").alias("name")).unionAll(table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 8000")
    primary = nation.join(rich, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), F.col("s_suppkey").alias("target"))
    other = _customers(spark, sf_dir).where("c_acctbal > 9800")
    fallback = nation.join(other, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), F.col("c_custkey").alias("target"))
    return resolve.resolve(wanted, primary, fallback, "name")


@query("containment_join", "SELECT n_name, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE (n_regionkey % 2 = 0 AND c_mktsegment = 'BUILDING') OR n_regionkey % 2 = 1")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose attributes are all in a key; the identifier narrows the pairs first."""
    even = F.col("n_regionkey") % 2 == 0
    wanted = F.when(even, F.create_map(F.lit("nation"), F.col("n_nationkey").cast("string"), F.lit("segment"), F.lit("BUILDING"))).otherwise(F.create_map(F.lit("nation"), F.col("n_nationkey").cast("string")))
    facets = table(spark, sf_dir, "nation").select("n_name", "n_nationkey", wanted.alias("attributes"))
    keys = _customers(spark, sf_dir).select("c_custkey", "c_nationkey", F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.col("c_mktsegment")).alias("key"))
    return facets.join(keys, F.col("n_nationkey") == F.col("c_nationkey")).where(resolve.contains_all(F.col("attributes"), F.col("key"))).select("n_name", "c_custkey")


@query("composite_key_join", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND CAST(floor(c_acctbal / 100) AS BIGINT) = CAST(floor(s_acctbal / 100) AS BIGINT)")
def composite_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _customers(spark, sf_dir).select("c_custkey", F.col("c_nationkey").alias("w"), F.floor(F.col("c_acctbal") / 100).alias("h"))
    right = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("w"), F.floor(F.col("s_acctbal") / 100).alias("h"))
    return left.join(right, ["w", "h"]).select("c_custkey", "s_suppkey")


@query("dangling_reference", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)")
def dangling_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") * 2).alias("key"))
    return resolve.unmatched(links, _customers(spark, sf_dir).select(F.col("c_custkey").alias("key")), "key").select("o_orderkey", "o_custkey")


@query("unmatched_names", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def unmatched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return resolve.unmatched(_customers(spark, sf_dir).select("c_custkey"), orders, "c_custkey")


@query("reachability_semi", "SELECT c_custkey FROM customer WHERE c_acctbal > 9500 UNION SELECT o_custkey + 1 FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9500)")
def reachability_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _customers(spark, sf_dir)
    links = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_custkey") + 1).alias("atlas"))
    return resolve.reachable(customers.select("c_custkey"), customers.where("c_acctbal > 9500").select("c_custkey"), "c_custkey", links, "o_custkey", "atlas")


@query("union_distinct", "SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_regionkey + 100 FROM nation")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _customers(spark, sf_dir).select(F.col("c_nationkey").alias("id"))
    b = table(spark, sf_dir, "supplier").select("s_nationkey")
    return a.unionAll(b).unionAll(table(spark, sf_dir, "nation").select(F.col("n_regionkey") + 100)).distinct()


@query("symdiff", "(SELECT *, 'left' AS side FROM (SELECT o_custkey AS id FROM orders WHERE o_orderkey % 3 = 0 EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1)) UNION ALL (SELECT *, 'right' FROM (SELECT o_custkey AS id FROM orders WHERE o_orderkey % 3 = 1 EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0))")
def symdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    side = lambda k: orders.where(F.col("o_orderkey") % 3 == k).select(F.col("o_custkey").alias("id"))
    return resolve.symmetric_difference(side(0), side(1))


_GAPS = "SELECT o_custkey AS k FROM orders WHERE o_custkey % 13 <> 5"


@query("fresh_id_mex", f"SELECT min(k) AS free_id FROM (SELECT k + 1 AS k FROM ({_GAPS}) UNION SELECT 1) WHERE k NOT IN (SELECT k FROM ({_GAPS}))")
def fresh_id_mex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.smallest_free_id(table(spark, sf_dir, "orders").where("o_custkey % 13 <> 5"), "o_custkey")


@query("next_id_max", "SELECT CASE WHEN max(c_custkey) + 1 <= 65535 THEN max(c_custkey) + 1 END AS next_id FROM customer")
def next_id_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.next_id(_customers(spark, sf_dir), "c_custkey")


@query("clone_subtree", "SELECT c_custkey, c_nationkey, c_name FROM customer UNION ALL SELECT c_custkey + 1000000, 99, replace(c_name, 'Customer', 'Copy') FROM customer WHERE c_nationkey = 7")
def clone_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of one identifier again under a fresh one, with their names rewritten."""
    rows = _customers(spark, sf_dir).select("c_custkey", "c_nationkey", "c_name")
    clones = rows.where("c_nationkey = 7").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit(99).alias("c_nationkey"), F.replace("c_name", F.lit("Customer"), F.lit("Copy")).alias("c_name"))
    return rows.unionByName(clones)


@query(
    "insert_missing",
    """WITH base AS (SELECT n_name AS name, n_nationkey::BIGINT AS identifier FROM nation), new AS (SELECT DISTINCT p_type AS name FROM part UNION SELECT n_name FROM nation)
       SELECT name, identifier FROM base UNION ALL SELECT name, (SELECT max(identifier) FROM base) + row_number() OVER (ORDER BY name) FROM new WHERE name NOT IN (SELECT name FROM base)""",
)
def insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("identifier"))
    offered = table(spark, sf_dir, "part").select(F.col("p_type").alias("name")).unionAll(base.select("name"))
    return resolve.insert_missing(base, offered, "name", "identifier")


@query("insert_admissible", "SELECT p_type, p_type NOT IN (SELECT n_name FROM nation) AND p_type NOT IN (SELECT c_mktsegment FROM customer) AND contains(p_type, 'STEEL') AS admissible FROM part GROUP BY p_type")
def insert_admissible(spark: SparkSession, sf_dir: str) -> DataFrame:
    offered = table(spark, sf_dir, "part").select("p_type").distinct()
    taken = table(spark, sf_dir, "nation").select(F.col("n_name").alias("p_type")).unionAll(_customers(spark, sf_dir).select("c_mktsegment")).distinct().withColumn("taken", F.lit(True))
    return offered.join(taken, "p_type", "left").select("p_type", (F.col("taken").isNull() & F.col("p_type").contains("STEEL")).alias("admissible"))


@query("preflight_check", "SELECT p_brand, count(*) AS n FROM part WHERE p_size = 10 GROUP BY p_brand")
def preflight_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fails before any other work if no size matches."""
    fits = table(spark, sf_dir, "part").where("p_size = 10")
    if fits.isEmpty():
        raise ValueError("no part of that size")
    return fits.groupBy("p_brand").agg(F.count("*").alias("n"))


@query("assert_any", "SELECT count(*) AS landed FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000")
def assert_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error if nothing landed."""
    rich = _customers(spark, sf_dir).where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    landed = table(spark, sf_dir, "orders").join(rich, "o_custkey").agg(F.count("*").alias("landed"))
    return landed.select(F.when(F.col("landed") == 0, F.raise_error(F.lit("nothing replaced")).cast("long")).otherwise(F.col("landed")).alias("landed"))


@query("append_rows", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _customers(spark, sf_dir).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")))


@query("override_union", "SELECT c_custkey AS tag, 'customer' AS origin FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE NOT (s_suppkey % 2 = 0 AND s_suppkey IN (SELECT c_custkey FROM customer))")
def override_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known tags first; extras only where their tag was not emitted."""
    emitted = _customers(spark, sf_dir).where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("tag"), F.lit("customer").alias("origin"))
    extras = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tag"), F.lit("supplier").alias("origin"))
    return emitted.unionAll(extras.join(emitted.select("tag"), "tag", "left_anti"))


@query("declared_vs_actual", "SELECT n_nationkey, n_regionkey * 10 AS declared, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS actual, n_regionkey * 10 = (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS agrees FROM nation")
def declared_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("actual"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") * 10).alias("declared")).join(actual, "n_nationkey", "left")
    got = F.coalesce("actual", F.lit(0).cast("long"))
    return rows.select("n_nationkey", "declared", got.alias("actual"), (F.col("declared") == got).alias("agrees"))


@query("multi_key_sort", "SELECT c_mktsegment, c_nationkey, c_custkey FROM customer ORDER BY c_mktsegment, c_nationkey, c_custkey")
def multi_key_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select("c_mktsegment", "c_nationkey", "c_custkey").orderBy("c_mktsegment", "c_nationkey", "c_custkey")


@query("scan_ordered", "SELECT hex(encode(n_name)) AS key, n_nationkey FROM nation ORDER BY encode(n_name)")
def scan_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In order of the key's bytes, unsigned."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").cast("binary").alias("bytes"), "n_nationkey").orderBy("bytes")
    return rows.select(F.hex("bytes").alias("key"), "n_nationkey")


@query("header_only_projection", "SELECT c_custkey, c_name FROM customer")
def header_only_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns; the scan reads no others."""
    return _customers(spark, sf_dir).select("c_custkey", "c_name")


@query("distinct_sizes_per_name", "SELECT p_brand, p_size, min(p_partkey) AS seen FROM part GROUP BY p_brand, p_size")
def distinct_sizes_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sizes of each name with the ordinal that shows them first."""
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("seen"))


@query("list_distinct_sorted", "SELECT p_brand, string_agg(p_size::VARCHAR, ', ' ORDER BY p_size) AS sizes FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY p_brand")
def list_distinct_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.array_sort(F.collect_set("p_size"))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(sizes.cast("array<string>"), ", ").alias("sizes"))


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse keys of three attributes; 0 means absent."""
    values = [F.col("n_regionkey"), F.col("n_nationkey"), (F.col("n_nationkey") % 3).cast("int")]
    return table(spark, sf_dir, "nation").select("n_nationkey", keyed.sparse_from_dense(_ATTRS, values).alias("key"))


@query("sparse_from_dense", "SELECT * FROM (SELECT n_nationkey, unnest(['region', 'nation', 'segment']) AS attr, unnest([n_regionkey, n_nationkey, (n_nationkey % 3)::INTEGER]) AS value FROM nation) WHERE value <> 0")
def sparse_from_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir).select("n_nationkey", F.explode("key").alias("attr", "value"))


@query("dense_from_sparse", "SELECT n_nationkey, (n_nationkey % 3)::INTEGER || ',' || n_regionkey || ',0' AS dense FROM nation")
def dense_from_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = keyed.dense_from_sparse(F.col("key"), ["segment", "region", "scale"])
    return _keys(spark, sf_dir).select("n_nationkey", F.array_join(dense.cast("array<string>"), ",").alias("dense"))


@query("zero_default", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal) AS BIGINT) END, 0) AS id FROM customer")
def zero_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.when(F.col("c_acctbal") >= 0, F.floor("c_acctbal"))
    return _customers(spark, sf_dir).select("c_custkey", F.coalesce(short, F.lit(0)).alias("id"))


@query("coalesce_declared_derived", "SELECT p_partkey, coalesce(CASE WHEN p_size % 5 = 0 THEN p_size * 8 END, ((p_size * 4 + 31) // 32) * 32)::BIGINT AS stride FROM part")
def coalesce_declared_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kilnwork.functions.pixels import round_up

    declared = F.when(F.col("p_size") % 5 == 0, (F.col("p_size") * 8).cast("long"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(declared, round_up(F.col("p_size") * 4, 32)).alias("stride"))


@query("first_match", "SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(spark, sf_dir).where("c_acctbal > 5000").select("c_nationkey", "c_custkey")
    return keyed.first_wins(rows, ["c_nationkey"], [F.col("c_custkey")])


@query("first_match_in_array", "SELECT c_custkey, list_filter(string_split(c_name, '#'), lambda x: length(x) > 3)[1] AS found FROM customer")
def first_match_in_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.get(F.filter(F.split("c_name", "#"), lambda x: F.length(x) > 3), 0)
    return _customers(spark, sf_dir).select("c_custkey", found.alias("found"))


@query("array_sort_append", "SELECT n_regionkey, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) || ',0' AS pairs FROM nation GROUP BY n_regionkey")
def array_sort_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in order, and a terminator."""
    ids = F.concat(F.array_sort(F.collect_list("n_nationkey")), F.array(F.lit(0)))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(ids.cast("array<string>"), ",").alias("pairs"))


@query("explode_left_join_missing", "SELECT n_nationkey, slot, r_name FROM (SELECT n_nationkey, unnest([n_regionkey, n_regionkey + 3]) AS slot FROM nation) LEFT JOIN region ON slot = r_regionkey")
def explode_left_join_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptor slots and the files they name; missing files give nulls."""
    slots = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(F.col("n_regionkey"), F.col("n_regionkey") + 3)).alias("slot"))
    return slots.join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "slot"), "slot", "left").select("n_nationkey", "slot", "r_name")


@query(
    "pack_pipeline",
    """WITH f AS (SELECT p_partkey, p_type || CASE WHEN p_size % 3 = 0 THEN '' ELSE '@' || p_size % 3 || 'x' END AS file, p_size FROM part),
       s AS (SELECT regexp_replace(file, '@[123]x$', '') AS asset, coalesce(TRY_CAST(nullif(regexp_extract(file, '@([123])x$', 1), '') AS INTEGER), 1) AS scale, p_partkey, p_size FROM f),
       u AS (SELECT asset, scale, min(p_partkey) AS p_partkey, arg_min(p_size, p_partkey) AS p_size FROM s GROUP BY asset, scale),
       i AS (SELECT asset, row_number() OVER (ORDER BY asset) AS id FROM (SELECT DISTINCT asset FROM u))
       SELECT asset, id, scale, p_partkey, p_size FROM u JOIN i USING (asset)""",
)
def pack_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to assets: parse names, keep the first of each asset and scale, number the assets."""
    rest = (F.col("p_size") % 3).cast("string")
    files = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat("p_type", F.when(rest == "0", "").otherwise(F.concat(F.lit("@"), rest, F.lit("x")))).alias("file"))
    base, scale = names.scale_suffix(F.col("file"))
    kept = keyed.first_wins(files.select(base.alias("asset"), scale.alias("scale"), "p_partkey", "p_size"), ["asset", "scale"], [F.col("p_partkey")])
    return kept.join(keyed.dense_ids(kept, "asset"), "asset").select("asset", "id", "scale", "p_partkey", "p_size")
