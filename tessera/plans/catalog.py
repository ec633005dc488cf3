"""Registered queries of the engine's kernels over the relational tables, each with the same question in SQL.

The kernels were made for facts about source files; here they run over whole tables of
another kind, so that an independent engine can check them. Queries over parsed source
are in ``tessera.plans.source_catalog``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import columns as X
from tessera.operators import graphs, relations, similarity
from tessera.plans import panel, source_catalog

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NLOC = X.TIERS["nloc"]


@_query("""
SELECT lang, count(*) FILTER (n_chars <= 250) AS low, count(*) FILTER (n_chars > 250 AND n_chars <= 500) AS moderate,
       count(*) FILTER (n_chars > 500 AND n_chars <= 1000) AS high, count(*) FILTER (n_chars > 1000) AS very_high,
       CASE max(CASE WHEN n_chars <= 250 THEN 0 WHEN n_chars <= 500 THEN 1 WHEN n_chars <= 1000 THEN 2 WHEN n_chars IS NOT NULL THEN 3 END)
            WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' WHEN 2 THEN 'high' WHEN 3 THEN 'very_high' END AS worst
FROM documents GROUP BY lang""")
def a5_tier_hist_docs_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(*X.histogram(F.col("n_chars"), _NLOC), X.worst_tier(F.col("n_chars"), _NLOC).alias("worst"))


@_query("SELECT l_returnflag, CAST(quantile_disc(l_quantity, 0.95) AS BIGINT) AS p95 FROM lineitem GROUP BY l_returnflag")
def a3_p95_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(X.nearest_rank("l_quantity").alias("p95"))


@_query("""
SELECT source, count(*) AS documents, round(coalesce(avg(n_chars), 0), 6) AS mean_chars,
       max(n_chars) FILTER (lang = 'en') AS max_english, round(sum(CASE WHEN lang = 'en' THEN n_chars ELSE 0 END) / sum(n_chars), 6) AS english_share,
       CAST(quantile_disc(n_chars, 0.95) AS BIGINT) AS p95_chars
FROM documents GROUP BY source""")
def a2_panel_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n = _table(spark, sf_dir, "documents"), F.col("n_chars")
    english = F.col("lang") == "en"
    return docs.groupBy("source").agg(
        F.count("*").alias("documents"), F.round(X.mean(n), 6).alias("mean_chars"), F.max(F.when(english, n)).alias("max_english"),
        F.round(X.ratio(F.sum(F.when(english, n).otherwise(0)), F.sum(n)), 6).alias("english_share"), X.nearest_rank("n_chars").alias("p95_chars"),
    )


@_query("""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
     r AS (SELECT *, row_number() OVER (ORDER BY n) AS k FROM s)
SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS total, arg_min(source, {'n': -n, 's': source}) AS largest,
       round(max(n) / sum(n), 9) AS max_share, round(2 * sum(k * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 9) AS gini FROM r""")
def a18_gini_docs_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    got = relations.concentration(sizes, "source", "n")
    return got.withColumn("max_share", F.round("max_share", 9)).withColumn("gini", F.round("gini", 9))


@_query(r"""SELECT doc_id, len(regexp_extract_all(text, '[^\x00-\x7F]+')) AS runs FROM documents WHERE regexp_matches(text, '[^\x00-\x7F]')""")
def slp050_non_ascii_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.regexp_count("text", F.lit(r"[^\x00-\x7F]+")).cast("long").alias("runs")).where("runs > 0")


@_query(r"""
SELECT doc_id, loc FROM (SELECT doc_id, len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN 1 ELSE 0 END AS loc FROM documents)
WHERE loc > 40""")
def slp080_oversized_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(X.lines(F.col("text"))).cast("long").alias("loc")).where("loc > 40")


_BARE = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
_STATEMENTS = ", ".join(f"'{w}'" for w in X.STATEMENT_WORDS)


@_query(rf"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_BARE}), lambda x: x <> '' AND x[1] <> '#') AS code FROM documents),
     p AS (SELECT doc_id, len(code) AS code_lines, len(list_filter(code, lambda x: NOT regexp_matches(x, '[=(){{}}\[\]:;@%<>/\\|*+~`"]')
                  AND len(regexp_split_to_array(x, '\s+')) >= 4 AND regexp_split_to_array(x, '\s+')[1] NOT IN ({_STATEMENTS}))) AS prose_lines FROM l)
SELECT doc_id, code_lines, prose_lines, round(CASE WHEN code_lines = 0 THEN 0 ELSE prose_lines / code_lines END, 6) AS ratio FROM p""")
def x10_prose_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that read as prose, of those that are neither blank nor a comment."""
    docs = _table(spark, sf_dir, "documents")
    code = docs.select("doc_id", F.filter(F.split("text", "\n"), X.is_code_line).alias("code"))
    counted = code.select("doc_id", F.size("code").cast("long").alias("code_lines"), F.size(F.filter("code", X.is_prose_line)).cast("long").alias("prose_lines"))
    return counted.withColumn("ratio", F.round(X.ratio(F.col("prose_lines"), F.col("code_lines")), 6))


@_query(rf"""
WITH l AS (SELECT page_id, string_split(replace(html, '>', '>' || chr(10)), chr(10)) AS ls FROM pages),
     x AS (SELECT page_id, unnest(range(1, len(ls) + 1)) AS line, unnest(list_transform(ls, lambda x: {_BARE})) AS s FROM l),
     k AS (SELECT page_id, line, CASE WHEN starts_with(s, '```') OR starts_with(s, '~~~') THEN 'fence' WHEN left(s, 7) IN ('<<<<<<<', '>>>>>>>', '|||||||') THEN 'conflict'
                  WHEN s LIKE '<%>' AND len(s) >= 3 AND regexp_matches(s[2], '[/A-Za-z]') AND regexp_matches(s[2:], '[A-Za-z]') THEN 'tag' END AS kind FROM x)
SELECT page_id, min(line) AS line, arg_min(kind, line) AS kind FROM k WHERE kind IS NOT NULL GROUP BY page_id""")
def slp220_artifact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each page that is a leftover, with a line feed after every tag of the page."""
    pages = _table(spark, sf_dir, "pages")
    rows = F.transform(F.split(F.replace("html", F.lit(">"), F.lit(">\n")), "\n"), lambda x, i: F.struct((i + 1).cast("long").alias("line"), X.artifact(x).alias("kind")))
    first = F.get(F.filter(rows, lambda r: r["kind"].isNotNull()), F.lit(0))
    return pages.select("page_id", first.alias("f")).where("f is not null").select("page_id", "f.*")


_STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_CONTENT = rf"list_distinct(list_filter(regexp_split_to_array(translate({{0}}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{{{L}}}}\p{{{{N}}}}]+'), lambda x: strlen(x) >= 2 AND x NOT IN ({_STOPS})))"


@_query(rf"""
WITH w AS (SELECT doc_id, {_CONTENT.format("split_part(text, chr(10), 1)")} AS a, {_CONTENT.format("text[strpos(text || chr(10), chr(10)) + 1:]")} AS b FROM documents)
SELECT doc_id, len(a) AS words, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(a) END, 6) AS overlap FROM w""")
def x1_content_word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of the first line's content words the rest of the document has."""
    docs = _table(spark, sf_dir, "documents")
    lines = F.split("text", "\n", 2)
    words = docs.select("doc_id", X.content_words(lines[0]).alias("a"), X.content_words(F.coalesce(F.get(lines, F.lit(1)), F.lit(""))).alias("b"))
    return words.select("doc_id", F.size("a").cast("long").alias("words"), F.round(X.overlap_ratio(F.col("a"), F.col("b")), 6).alias("overlap"))


@_query(r"""
SELECT name, CAST(list_sum(list_transform(list_filter(string_split(name, '_'), lambda x: x <> ''), lambda x: 1 + len(regexp_extract_all(x, '[a-z][A-Z]')))) AS INTEGER) AS words
FROM (SELECT DISTINCT event_type AS name FROM events UNION SELECT DISTINCT p_name FROM part)""")
def slp060_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).union(_table(spark, sf_dir, "part").select("p_name")).distinct()
    return names.select("name", X.identifier_words(F.col("name")).alias("words"))


@_query(r"""
SELECT regexp_replace(url, '/?[^/]*$', '') AS directory, count(*) AS files, min(url) AS first_file FROM pages GROUP BY 1 HAVING count(*) > 1""")
def slp090_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.crowded_directories(_table(spark, sf_dir, "pages"), 1, "url")


_SHINGLES = r"""
t AS (SELECT text, min(doc_id) AS id, list(doc_id) AS ids FROM documents GROUP BY text),
w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM t),
s AS (SELECT id, list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) AS sh FROM w WHERE len(ws) >= 4),
u AS (SELECT id, unnest(sh) AS g FROM s),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM u x JOIN u y ON x.g = y.g AND x.id < y.id GROUP BY ALL HAVING count(*) >= 2),
near AS (SELECT a, b, n / (len(p.sh) + len(q.sh) - n) AS j FROM c JOIN s p ON p.id = a JOIN s q ON q.id = b WHERE n / (len(p.sh) + len(q.sh) - n) >= 0.85),
same AS (SELECT id AS a, id AS b, 1.0 AS j FROM s),
pairs AS (SELECT least(x, y) AS a, greatest(x, y) AS b, j FROM (
            SELECT unnest(p.ids) AS x, q.ids AS ys, j FROM (SELECT * FROM near UNION ALL SELECT * FROM same) n JOIN t p ON p.id = n.a JOIN t q ON q.id = n.b)
          , unnest(ys) AS v(y) WHERE x <> y)
"""


@_query(f"WITH {_SHINGLES} SELECT DISTINCT a, b, round(j, 6) AS similarity FROM pairs")
def j1_clone_pairs_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents of Jaccard similarity 0.85 or more over shingles of four words."""
    pairs = similarity.text_pairs(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


@_query(f"""
WITH {_SHINGLES}, twice AS (SELECT DISTINCT a AS member, b AS partner, j FROM pairs UNION SELECT b, a, j FROM pairs)
SELECT member, min(partner) AS partner, CAST(round(100 * arg_min(j, partner)) AS BIGINT) AS percent FROM twice GROUP BY member""")
def j3_lowest_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.lowest(similarity.text_lowest(_table(spark, sf_dir, "documents"), "doc_id", "text"))


@_query(f"""
WITH RECURSIVE {_SHINGLES}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
SELECT node, min(other) AS component FROM r GROUP BY node""")
def g5_clone_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.connected_components(similarity.text_links(_table(spark, sf_dir, "documents"), "doc_id", "text"))


@_query("""
SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)""")
def j6_ghost_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return relations.unreferenced(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), used, on="p_partkey")


@_query("""
SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders)
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def j7_guarded_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return relations.unreferenced_if_any(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), urgent, orders, on="c_custkey")


@_query("""
SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM nation
WHERE n_nationkey < 5 AND (n_nationkey = s_nationkey OR n_nationkey = (s_nationkey + 7) % 25))""")
def j8_candidate_any_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers none of whose two candidate nations is known."""
    known = _table(spark, sf_dir, "nation").where("n_nationkey < 5").select("n_nationkey")
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return relations.without_match(supplier, F.array("s_nationkey", F.expr("(s_nationkey + 7) % 25")), known, ["s_suppkey"], "n_nationkey").select("s_suppkey")


def _nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from suppliers' to customers' nations that have more line items than the supplier's nation has with a nation on average, by a fiftieth or more."""
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    supplier = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    customer = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    joined = line.join(orders, "l_orderkey").join(supplier, "l_suppkey").join(customer, "o_custkey")
    pairs = joined.groupBy("src", "dst").agg(F.count("*").alias("n")).withColumn("mean", F.avg("n").over(Window.partitionBy("src")))
    return pairs.where((F.col("n") >= 1.02 * F.col("mean")) & (F.col("src") != F.col("dst"))).drop("mean")


_EDGES = """p AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
e AS (SELECT src, dst, n FROM (SELECT *, avg(n) OVER (PARTITION BY src) AS mean FROM p) WHERE n >= 1.02::DOUBLE * mean AND src <> dst)"""


@_query(f"""
WITH {_EDGES}, n AS (SELECT src AS node, dst AS other, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, src, 0, 1 FROM e)
SELECT node, count(DISTINCT other) FILTER (o = 1) AS fan_out, count(DISTINCT other) FILTER (i = 1) AS fan_in, count(DISTINCT other) AS cbo_modified FROM n GROUP BY node""")
def j13_fan_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.degrees(_nation_edges(spark, sf_dir))


@_query("""
SELECT l_suppkey, count(*) AS sites FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size >= 40) GROUP BY l_suppkey""")
def j15_nosi_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A semi join that keeps multiplicity."""
    large = _table(spark, sf_dir, "part").where("p_size >= 40").select(F.col("p_partkey").alias("l_partkey"))
    line = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    return relations.known_uses(line, large, ["l_suppkey"], "l_partkey", "sites")


@_query(f"""
WITH {_EDGES}, m AS (SELECT n_nationkey, n_regionkey AS package FROM nation),
x AS (SELECT DISTINCT a.package AS p, b.package AS q FROM e JOIN m a ON a.n_nationkey = src JOIN m b ON b.n_nationkey = dst WHERE a.package <> b.package),
r AS (SELECT package, count(*) AS modules, (SELECT count(*) FROM x WHERE p = package) AS ce, (SELECT count(*) FROM x WHERE q = package) AS ca,
             count(*) FILTER (n_nationkey % 3 = 0) AS abstract_classes FROM m GROUP BY package)
SELECT package, modules, ce, ca, abstract_classes, round(CASE WHEN ce + ca = 0 THEN 0 ELSE ce / (ce + ca) END, 6) AS instability, round(abstract_classes / modules, 6) AS abstractness,
       round(abs(abstract_classes / modules + CASE WHEN ce + ca = 0 THEN 0 ELSE ce / (ce + ca) END - 1), 6) AS distance FROM r""")
def a16_package_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = _table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("module"), F.col("n_regionkey").alias("package"), F.lit(1).alias("loc"), F.lit(1).alias("classes"),
        F.when(F.col("n_nationkey") % 3 == 0, 1).otherwise(0).alias("abstract"),
    )
    edges = _nation_edges(spark, sf_dir)
    modules = modules.withColumn("package", F.col("package").cast("string"))
    rows = relations.package_rows(modules, edges)
    rounded = [F.round(c, 6).alias(c) for c in ("instability", "abstractness", "distance")]
    return rows.select(F.col("package").cast("int").alias("package"), "modules", "ce", "ca", F.col("abstract_classes").cast("long").alias("abstract_classes"), *rounded)


@_query(f"""
WITH RECURSIVE {_EDGES}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst),
m AS (SELECT a.src AS node, a.dst AS other FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst),
c AS (SELECT node, least(node, min(other)) AS component FROM m GROUP BY node)
SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM c""")
def g1_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.strongly_connected(_nation_edges(spark, sf_dir))


@_query(f"""
WITH RECURSIVE {_EDGES}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst)
SELECT (SELECT count(*) FROM nation) AS nodes, count(*) + (SELECT count(*) FROM nation) AS reachable_pairs,
       round((count(*) + (SELECT count(*) FROM nation)) / power((SELECT count(*) FROM nation), 2), 9) AS propagation_cost FROM r WHERE src <> dst""")
def g3_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return graphs.propagation_cost(nodes, _nation_edges(spark, sf_dir)).withColumn("propagation_cost", F.round("propagation_cost", 9))


@_query(f"""
WITH {_EDGES}, x AS (SELECT a.n_regionkey AS p, b.n_regionkey AS q FROM e JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst),
d AS (SELECT c, count(*) AS d FROM (SELECT p AS c FROM x UNION ALL SELECT q FROM x) GROUP BY c)
SELECT coalesce(round((SELECT count(*) FROM x WHERE p = q) / (SELECT count(*) FROM x) - sum(d * d) / (4.0 * power((SELECT count(*) FROM x), 2)), 9), 0) AS q_declared FROM d""")
def g4_declared_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
    return graphs.declared_modularity(members, _nation_edges(spark, sf_dir)).select(F.round("q_declared", 9).alias("q_declared"))


@_query("""
WITH RECURSIVE d AS (SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_partkey // 2 NOT IN (SELECT p_partkey FROM part) OR p_partkey // 2 = p_partkey
UNION ALL SELECT p_partkey, depth + 1 FROM part JOIN d ON p_partkey // 2 = d.node AND p_partkey <> d.node)
SELECT node, CAST(max(depth) AS BIGINT) AS depth FROM d GROUP BY node""")
def g6_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of parts in the tree in which part k hangs below part k / 2."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.expr("p_partkey div 2").alias("parent"))
    return graphs.longest_path(part.withColumn("parent", F.when(F.col("parent") != F.col("node"), F.col("parent"))))


@_query("""
SELECT event_type, count(*) FILTER (value > 50) AS above, round(count(*) FILTER (value > 50) / nullif(count(*) FILTER (value <= 1), 0), 6) AS ratio FROM events GROUP BY event_type""")
def a15_null_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    got = events.groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("above"), F.count_if(F.col("value") <= 1).alias("low"))
    return got.select("event_type", "above", F.round(X.open_ratio(F.col("above"), F.col("low")), 6).alias("ratio"))


@_query("""
WITH f AS (SELECT doc_id AS path, CAST(n_chars % 7 AS INTEGER) AS line, CASE WHEN n_chars % 2 = 0 THEN 'A1' ELSE 'B2' END AS code FROM documents)
SELECT * FROM f WHERE line <> 0 AND NOT (line = 1 AND code = 'A1')""")
def j16_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by document, of which some lines are silenced as a whole and some for one code."""
    docs = _table(spark, sf_dir, "documents")
    findings = docs.select(F.col("doc_id").alias("path"), (F.col("n_chars") % 7).cast("int").alias("line"), F.when(F.col("n_chars") % 2 == 0, "A1").otherwise("B2").alias("code"))
    every = docs.select(F.col("doc_id").alias("path"))
    directives = every.select("path", F.lit(0).alias("line"), F.lit(None).cast("array<string>").alias("codes")).union(every.select("path", F.lit(1), F.array(F.lit("A1"))))
    return relations.unsuppressed(findings, directives).select("path", "line", "code")


@_query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1""")
def o5_first_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.first_writer(_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@_query("""
WITH r AS (SELECT l_returnflag || l_linestatus AS profile, CAST(max(l_quantity) AS DOUBLE) AS quantity_max, avg(l_discount) AS discount_avg FROM lineitem GROUP BY 1),
     v AS (SELECT profile, 'quantity_max' AS metric, quantity_max AS value, 49.5 AS ceiling FROM r UNION ALL SELECT profile, 'discount_avg', discount_avg, 0.9 FROM r)
SELECT profile, metric, round(value, 6) AS value, CAST(ceiling AS DOUBLE) AS ceiling FROM v WHERE value > ceiling""")
def o7_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a panel by return flag and status is above its ceiling."""
    line = _table(spark, sf_dir, "lineitem")
    rows = line.groupBy(F.concat("l_returnflag", "l_linestatus").alias("profile")).agg(F.max("l_quantity").alias("quantity_max"), F.avg("l_discount").alias("discount_avg"))
    return panel.gates(rows, {"quantity_max": 49.5, "discount_avg": 0.9}).withColumn("value", F.round("value", 6))


@_query("""
SELECT src, dst, bool_or(late) AS late, bool_or(large) AS large FROM (SELECT l_suppkey AS src, l_partkey AS dst, l_shipdate >= TIMESTAMP '1998-01-01' AS late, l_quantity > 40 AS large FROM lineitem)
WHERE src <> dst GROUP BY src, dst""")
def a23_edge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem")
    edges = line.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp")).alias("late"), (F.col("l_quantity") > 40).alias("large"))
    return relations.merge_edges(edges, ["late", "large"])


@_query("SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '[-_.]+', '-', 'g'), '^-|-$', '', 'g') AS name FROM pages")
def x6_normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", X.normalise_distribution(F.col("url")).alias("name"))


@_query("SELECT DISTINCT CASE WHEN value IS NULL THEN '' ELSE lower(event_type) END AS name FROM events ORDER BY 1")
def o1_sorted_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return events.select(F.when(F.col("value").isNull(), "").otherwise(F.lower("event_type")).alias("name")).distinct().orderBy("name")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _queries | source_catalog.queries()


def oracle_sql() -> dict[str, str]:
    return _sql | source_catalog.oracle_sql()


