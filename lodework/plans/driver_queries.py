"""The driver's queries: every relational operator of the archive index on a table of the same shape, beside its SQL.

orders stand for entries (o_orderkey the id, o_orderstatus the type, o_orderpriority the container) and lineitem for
chunks (l_orderkey the id, l_linenumber the place, l_returnflag the name, l_linestatus the variant)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify
from ..functions import columns as C
from ..operators import relational as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("SELECT o_orderstatus AS type, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1")
def stats_type(spark, sf):
    return R.histogram(t(spark, sf, "orders").select(F.col("o_orderstatus").alias("type")), "type")


@query("SELECT o_orderpriority AS container, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderpriority <> '' GROUP BY 1")
def stats_container(spark, sf):
    return R.histogram(t(spark, sf, "orders").select(F.col("o_orderpriority").alias("container")), "container", non_empty=True)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def stats_flags(spark, sf):
    return R.histogram(t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT count(*) AS total, count_if(l_returnflag <> 'N' AND l_linestatus = 'F') AS false_compressed, count_if(l_discount > 0.08) AS errors FROM lineitem")
def stats_conditional(spark, sf):
    return t(spark, sf, "lineitem").agg(
        F.count("*").alias("total"), F.count_if((F.col("l_returnflag") != "N") & (F.col("l_linestatus") == "F")).alias("false_compressed"), F.count_if(F.col("l_discount") > 0.08).alias("errors")
    )


@query(
    """SELECT o.o_orderkey, o.o_orderstatus, o.o_orderpriority, string_agg(l.l_linenumber || ':' || l.l_partkey || ':' || l.l_returnflag, ';' ORDER BY l.l_linenumber, l.l_partkey, l.l_returnflag) AS chunks
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderkey = 7 GROUP BY 1, 2, 3"""
)
def entry_lookup(spark, sf):
    one = t(spark, sf, "orders").where("o_orderkey = 7").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    label = F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), "l_returnflag")
    kids = R.children(t(spark, sf, "lineitem").where("l_orderkey = 7"), "l_orderkey", ["l_linenumber", "l_partkey", "l_returnflag"], label, "chunks")
    return one.join(kids, one.o_orderkey == kids.l_orderkey, "left").drop("l_orderkey")


@query(
    """SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_totalprice > 1000) AS total
FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_totalprice > 1000 ORDER BY o_orderkey LIMIT 50 OFFSET 10"""
)
def entry_filter_page(spark, sf):
    found = R.optional_filter(t(spark, sf, "orders"), {"o_orderstatus": "O", "o_orderpriority": "1-URGENT", "o_custkey": None}, where=[F.col("o_totalprice") > 1000])
    rows = R.page(found.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"), ["o_orderkey"], 50, 10)
    return rows.join(found.agg(F.count("*").alias("total")), how="left")


@query(
    """SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey, l_linestatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'
ORDER BY o_orderkey, l_linenumber, l_partkey, o_orderstatus, l_linestatus LIMIT 100 OFFSET 20"""
)
def find_chunk(spark, sf):
    lines = t(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    both = lines.join(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderkey") == F.col("l_orderkey"))
    return R.page(both.drop("l_orderkey"), ["o_orderkey", "l_linenumber", "l_partkey", "o_orderstatus", "l_linestatus"], 100, 20)


@query("SELECT count(*) AS total FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
def find_chunk_total(spark, sf):
    lines = t(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return lines.join(t(spark, sf, "orders").select("o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).agg(F.count("*").alias("total"))


@query("SELECT l_returnflag, l_linestatus, o_orderstatus, o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3, 4")
def chunk_variants(spark, sf):
    # Counts combine before the join's shuffle moves them: each order's lines collapse to at most six rows first.
    lines = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("k"))
    both = lines.join(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), F.col("o_orderkey") == F.col("l_orderkey"))
    keys = ["l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority"]
    return both.groupBy(*keys).agg(F.sum("k").alias("n")).orderBy(F.desc("n"), *keys)


@query(
    """SELECT 'lang' AS kind, v FROM (SELECT DISTINCT lang AS v FROM documents WHERE lang IS NOT NULL AND lang <> '')
UNION ALL SELECT 'source', v FROM (SELECT DISTINCT source AS v FROM documents WHERE source IS NOT NULL AND source <> '')"""
)
def distinct_values(spark, sf):
    d = t(spark, sf, "documents")
    one = lambda c: R.distinct_values(d, c).select(F.lit(c).alias("kind"), F.col(c).alias("v"))
    return one("lang").unionAll(one("source"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48) AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 300")
def semi_by_child(spark, sf):
    kids = t(spark, sf, "lineitem").where("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.page(t(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus").join(kids, "o_orderkey", "left_semi"), ["o_orderkey"], 300)


@query(
    """WITH n AS (SELECT o_orderkey, concat_ws('|', o_orderkey, o_custkey, o_orderstatus) AS fp FROM orders),
b AS (SELECT o_orderkey, concat_ws('|', o_orderkey, o_custkey + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END, o_orderstatus) AS fp FROM orders WHERE o_orderkey % 13 <> 0)
SELECT o_orderkey, fp FROM n WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.o_orderkey = n.o_orderkey AND b.fp = n.fp)"""
)
def changed_rows(spark, sf):
    o = t(spark, sf, "orders")
    now = o.select("o_orderkey", R.fingerprint("o_orderkey", "o_custkey", "o_orderstatus").alias("fp"))
    old = o.where("o_orderkey % 13 <> 0").withColumn("o_custkey", F.col("o_custkey") + F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0))
    return R.changed(now, old.select("o_orderkey", R.fingerprint("o_orderkey", "o_custkey", "o_orderstatus").alias("fp")), "o_orderkey", "fp")


@query("SELECT 12 AS q, c_custkey FROM customer WHERE contains(c_custkey::VARCHAR, '12') UNION ALL SELECT 0, c_custkey FROM customer")
def id_substring(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey")
    return c.where(R.id_contains("c_custkey", 12)).select(F.lit(12).alias("q"), "c_custkey").unionAll(c.where(R.id_contains("c_custkey", 0)).select(F.lit(0).alias("q"), "c_custkey"))


@query(
    """SELECT s_nationkey, array_to_string(list_sort(list(s_suppkey))[1:8], ',') || CASE WHEN count(*) > 8 THEN ',...' ELSE '' END AS ids, count(*) AS n FROM supplier GROUP BY 1"""
)
def id_inversion(spark, sf):
    return R.invert(t(spark, sf, "supplier"), "s_nationkey", "s_suppkey", "v").select("s_nationkey", R.first_n(F.col("v")).alias("ids"), F.size("v").cast("long").alias("n"))


@query("SELECT c_custkey, coalesce(n_nationkey, -1) AS nation, coalesce(n_name, '') AS name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON n_nationkey = c_nationkey")
def left_default(spark, sf):
    some = t(spark, sf, "nation").where("n_nationkey % 2 = 0")
    got = t(spark, sf, "customer").select("c_custkey", "c_nationkey").join(some, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return got.select("c_custkey", F.coalesce("n_nationkey", F.lit(-1)).alias("nation"), F.coalesce("n_name", F.lit("")).alias("name"))


@query(
    """WITH s(b, z, v) AS (VALUES ('Brand#11', 10, 'own10'), ('Brand#22', 20, 'own20')), g(z, v) AS (VALUES (10, 'all10'), (30, 'all30'), (20, 'all20'))
SELECT p_partkey, coalesce(s.v, g.v, CASE WHEN p_size % 10 = 0 THEN '?v' || p_size END, '') AS variant FROM part LEFT JOIN s ON s.b = p_brand AND s.z = p_size LEFT JOIN g ON g.z = p_size"""
)
def two_level_lookup(spark, sf):
    own = spark.createDataFrame([("Brand#11", 10, "own10"), ("Brand#22", 20, "own20")], "p_brand string, p_size int, own string")
    every = spark.createDataFrame([(10, "all10"), (30, "all30"), (20, "all20")], "p_size int, every string")
    p = t(spark, sf, "part").select("p_partkey", "p_brand", "p_size").join(F.broadcast(own), ["p_brand", "p_size"], "left").join(F.broadcast(every), "p_size", "left")
    return p.select("p_partkey", R.two_level(F.col("own"), F.col("every"), F.col("p_size") % 10 == 0, F.col("p_size")).alias("variant"))


@query("SELECT p_brand, p_partkey, p_size, prev_key, prev_size FROM (SELECT *, lag(p_partkey) OVER w AS prev_key, lag(p_size) OVER w AS prev_size FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)) WHERE p_size = 2 * prev_size")
def adjacent_pairs(spark, sf):
    return R.adjacent_double(t(spark, sf, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", "p_partkey", "p_size")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def argmax_first(spark, sf):
    return R.arg_max_first(t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey")


@query(
    """WITH m AS (SELECT l_suppkey, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS med FROM lineitem GROUP BY 1)
SELECT l.l_suppkey, med, sum(CASE WHEN l_quantity > 1.8 * med THEN med ELSE l_quantity END) AS clamped FROM lineitem l JOIN m USING (l_suppkey) GROUP BY 1, 2"""
)
def upper_median_clamp(spark, sf):
    med = R.upper_median(t(spark, sf, "lineitem"), "l_suppkey", "l_quantity", "med")
    clamped = F.when(F.col("l_quantity") > 1.8 * F.col("med"), F.col("med")).otherwise(F.col("l_quantity")) * F.col("k")
    return med.groupBy("l_suppkey", "med").agg(F.sum(clamped).alias("clamped"))


@query(
    """SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round((min(l_extendedprice) + max(l_extendedprice)) / 2, 2) AS mid, round(avg(l_quantity), 6) AS mean,
count(DISTINCT l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY 1"""
)
def bounds(spark, sf):
    p = F.col("l_extendedprice")
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.min(p).alias("lo"), F.max(p).alias("hi"), F.round((F.min(p) + F.max(p)) / 2, 2).alias("mid"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.count_distinct("l_partkey").alias("parts"), F.count("*").alias("n")
    )


@query("SELECT label, round(sqrt(avg(x * x)), 4) AS rms, round(max(abs(x)), 4) AS worst, count(*) AS matched FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def rms_error(spark, sf):
    x = t(spark, sf, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    return x.groupBy("label").agg(F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 4).alias("rms"), F.round(F.max(F.abs("x")), 4).alias("worst"), F.count("*").alias("matched"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_seen(spark, sf):
    return R.first_seen(t(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query("SELECT user_id, arg_max(value, event_id) AS last_value FROM events GROUP BY 1")
def last_wins(spark, sf):
    return R.last_wins(t(spark, sf, "events"), "user_id", "value", "event_id", "last_value")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 = 3 AND o_totalprice >= 2000 ORDER BY o_orderkey LIMIT 40")
def step_scan(spark, sf):
    rows = R.step_scan(t(spark, sf, "orders").select("o_orderkey", "o_totalprice").where("o_totalprice >= 2000"), "o_orderkey", 7, 3)
    return R.page(rows, ["o_orderkey"], 40)


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 4 ORDER BY n_chars DESC, doc_id LIMIT 25")
def topk(spark, sf):
    return R.page(t(spark, sf, "documents").where("n_chars >= 4").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 25)


@query("SELECT d.doc_id, substr(d.text, 1, 40) AS head, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE contains(d.text, 'The') ORDER BY d.doc_id LIMIT 30 OFFSET 5")
def text_contains_page(spark, sf):
    d = t(spark, sf, "documents").where(F.contains("text", F.lit("The"))).select("doc_id", F.substring("text", 1, 40).alias("head"))
    return R.page(d.join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id"), ["doc_id"], 30, 5)


@query("SELECT e.event_id, e.event_id // 1024 AS file, e.event_id % 1024 AS row, d.lang FROM events e JOIN documents d ON d.doc_id = e.event_id // 1024")
def divmod_join(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.expr("event_id div 1024").alias("file"), F.expr("pmod(event_id, 1024)").alias("row"))
    return e.join(t(spark, sf, "documents").select(F.col("doc_id").alias("file"), "lang"), "file")


#: First bytes, and what the index calls a blob that begins with them.
MAGICS = (("5046", "packfile"), ("41544558", "texture"), ("43544558", "texture"), ("43545458", "binary"), ("44445320", "dds"), ("73747273", "strs"), ("52494646", "riff"), ("89504E47", "png"), ("FFD8", "jpeg"), ("4D5A", "exe"), ("61736E64", "asnd"), ("00", "binary"), ("4D", "binary"))


@query(
    f"""WITH m(k, type) AS (VALUES {", ".join(f"({k}, '{kind}')" for k, (_, kind) in enumerate(MAGICS))})
SELECT p_partkey, CASE WHEN p_size = 50 THEN 'empty' ELSE type END AS type FROM part JOIN m ON k = p_partkey % {len(MAGICS)}"""
)
def magic_sniff(spark, sf):
    """The index's classifier on blobs that begin with each magic; where p_size is 50, on blobs too short for one."""
    first = F.element_at(F.array(*[F.unhex(F.lit(m)) for m, _ in MAGICS]), (F.col("p_partkey") % len(MAGICS) + 1).cast("int"))
    blob = F.when(F.col("p_size") == 50, F.unhex(F.lit("504600"))).otherwise(F.concat(first, F.col("p_name").cast("binary"), F.col("p_type").cast("binary")))
    return t(spark, sf, "part").select("p_partkey", classify.index_type(blob).alias("type"))


@query(
    """SELECT c_custkey, (c_custkey - 1) % 65280 + 256 AS low, (c_custkey - 1) // 65280 + 256 AS high, c_custkey AS back FROM (SELECT c_custkey * 97 + 1 AS c_custkey FROM customer)"""
)
def fileref_decode(spark, sf):
    c = t(spark, sf, "customer").select((F.col("c_custkey") * 97 + 1).alias("c_custkey"))
    low, high = C.fileref_words(F.col("c_custkey"))
    return c.select("c_custkey", low.alias("low"), high.alias("high")).withColumn("back", C.fileref(F.col("low"), F.col("high")))


@query(
    """WITH v(b, name, size, o) AS (VALUES (1,'position',12,1),(2,'weights',4,2),(4,'groups',4,3),(8,'normal',12,4),(16,'color',4,5),(32,'tangent',12,6),(64,'bitangent',12,7),(128,'tangent_frame',12,8))
SELECT p_partkey, coalesce(string_agg(name, ',' ORDER BY o), '') AS labels, coalesce(sum(size), 0)::INTEGER AS stride FROM part LEFT JOIN v ON (p_partkey % 256)::INTEGER & b <> 0 GROUP BY 1"""
)
def fvf_labels(spark, sf):
    m = (F.col("p_partkey") % 256).cast("int")
    return t(spark, sf, "part").select("p_partkey", C.vertex_labels(m).alias("labels"), C.vertex_stride(m).alias("stride"))


@query(
    r"""WITH b AS (SELECT doc_id, encode(text) AS b FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, o, b[o + 1:o + 16] AS b FROM (SELECT doc_id, b, unnest(range(0, octet_length(b), 16)) AS o FROM b))
SELECT doc_id, o::BIGINT AS at, printf('0x%08X', o) AS offset_hex, hex(b) AS hex,
replace(replace(replace(regexp_replace(b::VARCHAR, '\\x([0189A-F][0-9A-F]|7F)', '.', 'g'), '\x22', '"'), '\x27', ''''), '\x5C', '\') AS ascii FROM r"""
)
def hex_rows(spark, sf):
    """Whole texts in rows of 16 bytes."""
    d = t(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("b"))
    at = F.sequence(F.lit(0), F.octet_length("b") - 1, F.lit(16))
    rows = d.where(F.octet_length("b") > 0).select("doc_id", "b", F.explode(at).alias("o")).select("doc_id", "o", F.substring(F.col("b"), F.col("o") + 1, F.lit(16)).alias("b"))
    shown = F.regexp_replace(F.decode("b", "ISO-8859-1"), r"[^\x20-\x7E]", ".")
    return rows.select("doc_id", F.col("o").cast("long").alias("at"), C.hex32(F.col("o")).alias("offset_hex"), F.hex("b").alias("hex"), shown.alias("ascii"))


@query("SELECT event_type, count(*) AS total, array_to_string(list_sort(list(event_id))[1:3], ',') AS examples FROM events GROUP BY 1")
def grouped_examples(spark, sf):
    # The three smallest ids need no list of a whole group: rank within a limit, then join the counts in one pass.
    e = t(spark, sf, "events").select("event_type", "event_id")
    few = e.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))).where("r <= 3")
    few = few.groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("examples"))
    return e.groupBy("event_type").agg(F.count("*").alias("total")).join(few, "event_type")


@query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE s_suppkey = 5")
def tagged_union(spark, sf):
    c = t(spark, sf, "customer").where("c_custkey = 5").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return c.unionAll(t(spark, sf, "supplier").where("s_suppkey = 5").select(F.lit("supplier"), "s_suppkey", "s_name"))


@query("SELECT d.doc_id, lower(d.source) AS name, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE lower(d.source) NOT IN ('src0', 'src7')")
def const_bind(spark, sf):
    skip = spark.createDataFrame([("src0",), ("src7",)], "name string")
    d = t(spark, sf, "documents").select("doc_id", F.lower("source").alias("name")).join(F.broadcast(skip), "name", "left_anti")
    return d.join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "name", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("SELECT string_agg(k || '=' || v, ';' ORDER BY k) AS meta FROM (SELECT r_name AS k, r_regionkey::VARCHAR AS v FROM region)")
def meta_pivot(spark, sf):
    m = t(spark, sf, "region").agg(F.map_from_entries(F.collect_list(F.struct("r_name", F.col("r_regionkey").cast("string")))).alias("m"))
    return m.select(F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), F.element_at("m", k))), ";").alias("meta"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag || ' v' || l_linenumber || CASE WHEN l_linestatus = 'O' THEN ' ' || l_linestatus ELSE '' END AS label FROM lineitem")
def chunk_labels(spark, sf):
    line = t(spark, sf, "lineitem")
    return line.select("l_orderkey", "l_linenumber", "l_partkey", C.chunk_label(F.col("l_returnflag"), F.col("l_linenumber"), F.when(F.col("l_linestatus") == "O", F.col("l_linestatus"))).alias("label"))


@query("SELECT doc_id, round(length(regexp_replace(text, '[^ -~]', '', 'g')) / length(text)::DOUBLE, 6) AS share FROM documents WHERE length(text) > 0")
def printable_score(spark, sf):
    d = t(spark, sf, "documents").where(F.length("text") > 0)
    return d.select("doc_id", F.round(C.printable_share(F.col("text")), 6).alias("share"))


@query(
    """WITH b AS (SELECT p_size AS token, max(p_partkey) AS bone FROM part WHERE p_size % 3 <> 0 GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(bone, -1) AS bone FROM lineitem LEFT JOIN b ON token = l_quantity::INTEGER"""
)
def bind_last(spark, sf):
    """A binding's token to the last bone that has it, -1 where none has."""
    bones = R.last_wins(t(spark, sf, "part").where("p_size % 3 <> 0").withColumnRenamed("p_size", "token"), "token", "p_partkey", "p_partkey", "bone")
    line = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("token"))
    return line.join(bones, "token", "left").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("bone", F.lit(-1)).alias("bone"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey * 10 < 500 + 300 AND l_orderkey * 10 + l_linenumber > 500")
def byte_range(spark, sf):
    """Rows whose [start, start + length) meets a range."""
    start, end = F.col("l_orderkey") * 10, F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return t(spark, sf, "lineitem").where((start < 800) & (end > 500)).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    """SELECT user_id, string_agg(ref::VARCHAR, ',' ORDER BY first) AS refs FROM (
SELECT user_id, event_id % 97 AS ref, min(event_id) AS first FROM events WHERE event_id % 97 > 4 AND event_id % 97 < 60 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY first) <= 5) GROUP BY 1"""
)
def reference_list(spark, sf):
    """References in a range, each once in the order first seen, five at most."""
    e = t(spark, sf, "events").select("user_id", (F.col("event_id") % 97).alias("ref"), "event_id").where("ref > 4 AND ref < 60")
    seen = e.groupBy("user_id", "ref").agg(F.min("event_id").alias("first"))
    few = seen.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("first"))).where("r <= 5")
    refs = F.transform(F.array_sort(F.collect_list(F.struct("first", "ref"))), lambda x: x["ref"].cast("string"))
    return few.groupBy("user_id").agg(F.array_join(refs, ",").alias("refs"))


@query(
    """WITH v AS (SELECT unnest([l_orderkey % 50, l_partkey % 50, l_suppkey % 50]) AS vertex, l_quantity AS nx, l_linenumber AS ny FROM lineitem)
SELECT vertex, sum(nx) AS nx, sum(ny)::BIGINT AS ny FROM v GROUP BY 1"""
)
def vertex_normals(spark, sf):
    """Face vectors summed at each face's three corners; partial sums combine before the shuffle."""
    line = t(spark, sf, "lineitem")
    corners = F.explode(F.array(*[F.col(c) % 50 for c in ("l_orderkey", "l_partkey", "l_suppkey")]))
    return line.select(corners.alias("vertex"), "l_quantity", "l_linenumber").groupBy("vertex").agg(F.sum("l_quantity").alias("nx"), F.sum("l_linenumber").cast("long").alias("ny"))


@query(
    """SELECT c.c_custkey, coalesce(o.n, 0) AS n_files, coalesce(p.p_name, '') AS name FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey
LEFT JOIN part p ON p_partkey = c_custkey - 1"""
)
def display_join(spark, sf):
    """A list by id with what stands at index id - 1 and with counts, empty where there is nothing."""
    n = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    p = t(spark, sf, "part").select((F.col("p_partkey") + 1).alias("c_custkey"), "p_name")
    c = t(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").join(p, "c_custkey", "left")
    return c.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_files"), F.coalesce("p_name", F.lit("")).alias("name"))


@query("SELECT s_suppkey, s_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey > 5 ORDER BY coalesce(n_nationkey, 0) DESC, s_suppkey LIMIT 40")
def column_sort(spark, sf):
    """Sorted by a column that may be missing, which counts as 0, ties by id."""
    n = t(spark, sf, "nation").where("n_nationkey > 5").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(1).alias("known"))
    j = t(spark, sf, "supplier").join(n, "s_nationkey", "left")
    return j.orderBy(F.desc(F.when(F.col("known") == 1, F.col("s_nationkey")).otherwise(0)), "s_suppkey").limit(40).select("s_suppkey", "s_name")


@query("SELECT p_partkey, p_brand, d.n AS parts FROM part JOIN (SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1) d ON b = p_brand WHERE p_size = 7")
def placements(spark, sf):
    """Placements joined to their model, which is made once for each distinct one."""
    p = t(spark, sf, "part")
    return p.where("p_size = 7").select("p_partkey", "p_brand").join(p.groupBy("p_brand").agg(F.count("*").alias("parts")), "p_brand")


@query("SELECT page_id, instr(html, '<article>') - 1 AS at, length(html) AS n FROM pages WHERE length(html) >= 2000 AND page_id % 3 = 1 AND contains(html, '<article>') ORDER BY page_id LIMIT 20")
def content_scan(spark, sf):
    """A scan of contents: the size first, then each third row, then a search for bytes."""
    p = R.step_scan(t(spark, sf, "pages").where(F.length("html") >= 2000), "page_id", 3, 1)
    hits = p.select("page_id", (F.locate("<article>", F.col("html")) - 1).alias("at"), F.length("html").alias("n")).where("at >= 0")
    return R.page(hits, ["page_id"], 20)
