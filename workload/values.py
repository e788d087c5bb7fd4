"""Functions, aggregates, ordering and paging."""

from pyspark.sql import functions as F

from quadloom import functions as fn
from quadloom import operators as op
from quadloom.fixtures import COMMENT, EX, LABEL, entity, iso_time
from quadloom.operators.modifiers import row_index
from quadloom.plans.model import unique_names
from quadloom.terms import (
    RDF_TYPE, XSD, XSD_DATETIME, Iri, Var, double_of, iri_term, literal_term, value_of, values,
)

from .graph import ex
from .registry import CUST, DOC, ORD, PART, iri, one_graph, query

V, C = Var, F.col
A = Iri(RDF_TYPE)


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- terms
@query("term_tests", f"""
    WITH v AS (SELECT c_name AS value, false AS i, '{XSD}string' AS dt FROM customer
      UNION ALL SELECT c_mktsegment, false, '{XSD}string' FROM customer
      UNION ALL SELECT CAST(c_acctbal AS VARCHAR), false, '{XSD}double' FROM customer
      UNION ALL SELECT 'mailto:c' || c_custkey || '@example.org', true, NULL FROM customer
      UNION ALL SELECT {iri('nation', 'c_nationkey')}, true, NULL FROM customer)
    SELECT value, i AS is_iri, NOT i AS is_literal, false AS is_blank, NOT i AND dt LIKE '%double' IS TRUE AS is_numeric,
      dt AS datatype, CASE WHEN NOT i THEN '' END AS lang FROM v""")
def term_tests(spark, sf):
    g = one_graph(spark, sf, "customer").filter(~C("p").isin(RDF_TYPE, EX + "hasCustomer"))
    b = op.pattern(g, V("c"), V("p"), V("v"))
    v = C("v")
    return b.select(
        fn.str_(v)["value"].alias("value"), fn.is_iri(v).alias("is_iri"), fn.is_literal(v).alias("is_literal"),
        fn.is_blank(v).alias("is_blank"), fn.is_numeric(v).alias("is_numeric"),
        fn.datatype(v)["value"].alias("datatype"), fn.lang(v)["value"].alias("lang"))


@query("term_constructors", f"""
    SELECT c_name AS name, 'http://x/' || c_name AS iri, c_name || '^^{XSD}token' AS typed, c_name || '@fr' AS tagged,
      true AS same, false AS other FROM customer""")
def term_constructors(spark, sf):
    b = op.pattern(one_graph(spark, sf, "customer"), V("c"), ex("name"), V("name"))
    n = C("name")
    typed, tagged = fn.strdt(n, XSD + "token"), fn.strlang(n, "FR")
    return b.select(
        value_of("name"), fn.iri(fn.concat("http://x/", n))["value"].alias("iri"),
        F.concat(typed["value"], F.lit("^^"), typed["dt"]).alias("typed"),
        F.concat(tagged["value"], F.lit("@"), tagged["lang"]).alias("tagged"),
        fn.same_term(n, fn.str_(n)).alias("same"), fn.same_term(n, tagged).alias("other"))


@query("string_functions", """
    SELECT c_name AS name, lower(c_name) AS lc, upper(c_mktsegment || 'x') AS uc, length(c_name) AS n, substr(c_name, 3, 4) AS sub,
      substr(c_name, 10) AS rest, c_name || '/' || c_mktsegment AS joined, contains(c_name, '12') AS has, starts_with(c_name, 'Cust') AS starts,
      ends_with(c_name, '7') AS ends, CASE WHEN contains(c_name, '#') THEN split_part(c_name, '#', 1) ELSE '' END AS before,
      '' AS before_miss, split_part(c_name, '#', 2) AS after, regexp_matches(c_mktsegment, '(?i)^b.*g$') AS rx,
      regexp_replace(c_name, '0+', '0', 'g') AS repl, replace(c_name, '#', '%23') AS enc FROM customer""")
def string_functions(spark, sf):
    g = one_graph(spark, sf, "customer")
    b = op.star(g, {"name": EX + "name", "seg": EX + "segment"}, functional=("name", "seg"))
    n, s = C("name"), C("seg")

    def t(x, name):
        return x["value"].alias(name)
    return b.select(
        value_of("name"), t(fn.lcase(n), "lc"), t(fn.ucase(fn.concat(s, "x")), "uc"), fn.strlen(n).alias("n"),
        t(fn.substr(n, 3, 4), "sub"), t(fn.substr(n, 10), "rest"), t(fn.concat(n, "/", s), "joined"),
        fn.contains(n, "12").alias("has"), fn.strstarts(n, "Cust").alias("starts"), fn.strends(n, "7").alias("ends"),
        t(fn.strbefore(n, "#"), "before"), t(fn.strbefore(n, "~"), "before_miss"), t(fn.strafter(n, "#"), "after"),
        fn.regex(s, "^B.*g$", "i").alias("rx"), t(fn.replace(n, "0+", "0"), "repl"), t(fn.encode_for_uri(n), "enc"))


@query("language_functions", f"""
    SELECT {DOC} AS doc, d.lang, d.lang = 'en' AS english, true AS tagged, length(d.text) AS n,
      upper(d.lang) || d.lang AS kept FROM documents d""")
def language_functions(spark, sf):
    b = op.pattern(one_graph(spark, sf, "documents"), V("doc"), Iri(COMMENT), V("text"))
    t = C("text")
    start = fn.substr(t, 1, 1)
    return b.select(
        value_of("doc"), fn.lang(t)["value"].alias("lang"), fn.lang_matches(fn.lang(t), "EN").alias("english"),
        fn.lang_matches(fn.lang(t), "*").alias("tagged"), fn.strlen(t).alias("n"),
        F.concat(F.upper(start["lang"]), fn.ucase(t)["lang"]).alias("kept"))


@query("numeric_functions", f"""
    SELECT {CUST} AS c, abs(c_acctbal) AS a, ceil(c_acctbal) AS up, floor(c_acctbal) AS down,
      floor(c_acctbal + 0.5) AS nearest FROM customer""")
def numeric_functions(spark, sf):
    b = op.pattern(one_graph(spark, sf, "customer"), V("c"), ex("balance"), V("v"))
    v = C("v")

    def d(x, name):
        return fn.number(x, "double").alias(name)
    return b.select(value_of("c"), d(fn.abs_(v), "a"), d(fn.ceil(v), "up"), d(fn.floor(v), "down"), d(fn.round_(v), "nearest"))


@query("arithmetic", f"""
    SELECT {PART} AS part, CAST(p_size + 7 AS BIGINT) AS plus, CAST(p_size - 30 AS BIGINT) AS minus,
      CAST(p_size * p_size AS BIGINT) AS square, round(p_size / 3, 6) AS third, CAST(NULL AS DOUBLE) AS by_zero,
      '{XSD}integer' AS whole, '{XSD}decimal' AS exact, CAST(NULL AS DOUBLE) AS bad FROM part""")
def arithmetic(spark, sf):
    b = op.star(one_graph(spark, sf, "part"), {"size": EX + "size", "brand": EX + "brand"}, subject="part",
                functional=("size", "brand"))
    s = C("size")
    third = fn.divide(s, 3)
    return b.select(
        value_of("part"), fn.number(fn.add(s, 7)).alias("plus"), fn.number(fn.subtract(s, 30)).alias("minus"),
        fn.number(fn.multiply(s, s)).alias("square"), F.round(fn.number(third, "double"), 6).alias("third"),
        fn.number(fn.divide(s, 0), "double").alias("by_zero"), fn.add(s, 7)["dt"].alias("whole"), third["dt"].alias("exact"),
        fn.number(fn.add(C("brand"), 1), "double").alias("bad"))


@query("compare_numbers", f"""
    SELECT {PART} AS part, p_size < 9 AS less, p_size = 10 AS ten, p_size IN (1, 25, 50) AS listed,
      p_size NOT IN (1, 25, 50) AS unlisted FROM part""")
def compare_numbers(spark, sf):
    b = op.pattern(one_graph(spark, sf, "part"), V("part"), ex("size"), V("s"))
    s = C("s")
    # by value, not by text: "9" is not less than "10" as text
    return b.select(value_of("part"), fn.lt(s, 9).alias("less"), fn.eq(s, 10.0).alias("ten"),
                    fn.in_(s, [1, 25, 50]).alias("listed"), fn.not_in(s, [1, 25, 50]).alias("unlisted"))


@query("compare_dates", f"""
    SELECT {ORD} AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-06-15'""")
def compare_dates(spark, sf):
    b = op.pattern(one_graph(spark, sf, "orders"), V("o"), ex("date"), V("d"))
    lo = literal_term("1996-01-01T02:00:00+02:00", XSD_DATETIME)  # midnight in UTC
    hi = literal_term("1997-06-15T00:00:00Z", XSD_DATETIME)
    return values(op.where(b, fn.ge(C("d"), lo) & fn.lt(C("d"), hi)), "o")


@query("date_functions", """
    SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi,
      CAST(date_part('microseconds', ts) / 1000000.0 AS DOUBLE) AS s, 'Z' AS tz, 'PT0S' AS zone FROM events""")
def date_functions(spark, sf):
    b = table(spark, sf, "events").select("event_id", literal_term(iso_time(C("ts")), XSD_DATETIME).alias("t"))
    t = C("t")
    return b.select("event_id", fn.year(t).alias("y"), fn.month(t).alias("m"), fn.day(t).alias("d"),
                    fn.hours(t).alias("h"), fn.minutes(t).alias("mi"), fn.seconds(t).cast("double").alias("s"),
                    fn.tz(t).alias("tz"), fn.timezone(t)["value"].alias("zone"))


@query("hash_functions", "SELECT c_name AS name, md5(c_name) AS m, sha1(c_name) AS s, sha256(c_name) AS t FROM customer")
def hash_functions(spark, sf):
    b = op.pattern(one_graph(spark, sf, "customer"), V("c"), ex("name"), V("name"))
    n = C("name")
    return b.select(value_of("name"), fn.md5(n)["value"].alias("m"), fn.sha1(n)["value"].alias("s"),
                    fn.sha256(n)["value"].alias("t"))


@query("logic_functions", f"""
    SELECT {DOC} AS doc, CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'poor' END AS word,
      coalesce(CAST(l.quality AS VARCHAR), 'none') AS q, l.quality = 1 OR d.source = 'web' AS either,
      l.quality = 1 AND d.source = 'web' AS both, l.quality IS NOT NULL AS bound
    FROM documents d LEFT JOIN labels l USING (doc_id)""")
def logic_functions(spark, sf):
    g = one_graph(spark, sf, "documents", "labels")
    b = op.optional(op.pattern(g, V("doc"), ex("source"), V("source")), op.pattern(g, V("doc"), ex("quality"), V("q")))
    good, web = fn.eq(C("q"), 1), fn.eq(C("source"), "web")
    return b.select(
        value_of("doc"), fn.if_(good, literal_term("good"), literal_term("poor"))["value"].alias("word"),
        fn.coalesce(C("q"), literal_term("none"))["value"].alias("q"), (good | web).alias("either"),
        (good & web).alias("both"), fn.bound(C("q")).alias("bound"))


# ---------------------------------------------------------------- names and lines
@query("slug_names", """
    SELECT p_partkey AS key, CASE WHEN s = '' THEN 'query' ELSE s END AS slug FROM (SELECT p_partkey,
      trim(regexp_replace(lower('  ' || p_brand || ' / ' || p_type || '! '), '[^a-z0-9_-]+', '_', 'g'), '_') AS s FROM part)""")
def slug_names(spark, sf):
    p = table(spark, sf, "part")
    text = F.concat(F.lit("  "), C("p_brand"), F.lit(" / "), C("p_type"), F.lit("! "))
    return p.select(C("p_partkey").alias("key"), fn.slug(text).alias("slug"))


@query("unique_part_names", """
    SELECT p_partkey AS key, p_name || CASE WHEN n = 0 THEN '' ELSE '_' || n END AS name FROM (
      SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS n FROM part)""")
def unique_part_names(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return unique_names(p, "p_name", "p_partkey").select(C("p_partkey").alias("key"), "name")


@query("normalized_keys", "SELECT p_partkey AS key, p_type AS name FROM part")
def normalized_keys(spark, sf):
    p = table(spark, sf, "part")
    mark = F.element_at(F.array(*[F.lit(x) for x in ("", "+", "*", "?", "{0,2}", "+{1,3}")]),
                        (C("p_partkey") % 6 + 1).cast("int"))
    return p.select(C("p_partkey").alias("key"), fn.normalize_key(
        F.concat(F.lit(" "), C("p_type"), mark, F.lit(" "))).alias("name"))


@query("key_value_lines", """
    SELECT event_id, 'svc-' || user_id AS service, event_type AS event, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS runtime_ms,
      'no such ' || event_type || ' file' AS error FROM events""")
def key_value_lines(spark, sf):
    e = table(spark, sf, "events")
    line = F.concat(F.lit("service=svc-"), C("user_id").cast("string"), F.lit(" event="), C("event_type"),
                    F.lit(" error=no such "), C("event_type"), F.lit(" file runtime_ms="), F.floor("value").cast("string"))
    kv = fn.key_values(line)
    return e.select("event_id", *[kv[k].alias(k) for k in ("service", "event", "runtime_ms", "error")])


# ---------------------------------------------------------------- aggregates
@query("triple_count", "SELECT 7 * count(*) + count(*) FILTER (WHERE c_acctbal >= 0) AS count FROM customer")
def triple_count(spark, sf):
    return op.triple_count(one_graph(spark, sf, "customer"))


@query("triple_count_empty", "SELECT 0 AS count")
def triple_count_empty(spark, sf):
    return op.triple_count(one_graph(spark, sf, "customer").filter(C("p") == EX + "nothing"))


@query("count_distinct_members", """
    SELECT n_name AS label, count(DISTINCT c_custkey) AS members FROM nation JOIN customer ON c_nationkey = n_nationkey
    WHERE c_acctbal >= 0 GROUP BY n_name ORDER BY members DESC, label LIMIT 20""")
def count_distinct_members(spark, sf):
    g = one_graph(spark, sf, "nation", "customer")
    b = op.bgp(g, [(V("n"), A, ex("Nation")), (V("n"), Iri(LABEL), V("label")), (V("n"), ex("hasCustomer"), V("m"))])
    counted = op.group(b, ["label"], members=op.count_distinct("m"))
    return op.top_k(counted, [op.desc("members"), "label"], 20).select(value_of("label"), "members")


@query("count_distinct_parts", f"""
    SELECT s_name AS name, count(DISTINCT l_partkey) AS parts FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""")
def count_distinct_parts(spark, sf):
    g = one_graph(spark, sf, "supplier", "lineitem")
    b = op.star(g, {"name": EX + "name", "part": EX + "supplies"}, functional=("name",))
    return op.group(b, ["name"], parts=op.count_distinct("part")).select(value_of("name"), "parts")


@query("count_distinct_approx", "SELECT count(DISTINCT l_partkey) AS parts, true AS close FROM lineitem")
def count_distinct_approx(spark, sf):
    b = op.pattern(one_graph(spark, sf, "lineitem"), V("s"), ex("supplies"), V("part"))
    both = op.group(b, [], parts=op.count_distinct("part"), guess=op.count_distinct("part", approx=True))
    # six times the relative standard deviation asked for
    return both.select("parts", (F.abs(C("guess") - C("parts")) <= 0.12 * C("parts")).alias("close"))


@query("count_min_max_sample", """
    SELECT c_mktsegment AS segment, count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high, min(c_name) AS first,
      c_mktsegment AS sample FROM customer GROUP BY 1""")
def count_min_max_sample(spark, sf):
    b = op.star(one_graph(spark, sf, "customer"), {"segment": EX + "segment", "b": EX + "balance", "name": EX + "name"},
                functional=("segment", "b", "name"))
    g = op.group(b, ["segment"], n=op.count("b"), low=op.minimum("b"), high=op.maximum("b"), first=op.minimum("name"),
                 sample=op.sample("segment"))
    return g.select(value_of("segment"), "n", fn.number(C("low"), "double").alias("low"),
                    fn.number(C("high"), "double").alias("high"), value_of("first"), value_of("sample"))


@query("sum_and_average", f"""
    SELECT c_name AS name, round(sum(o_totalprice), 2) AS total, count(*) AS n, true AS mean_fits, '{XSD}double' AS dt
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name""")
def sum_and_average(spark, sf):
    g = one_graph(spark, sf, "orders", "customer")
    b = op.bgp(g, [(V("o"), ex("customer"), V("c")), (V("o"), ex("total"), V("t")), (V("c"), ex("name"), V("name"))])
    s = op.group(b, ["c", "name"], total=op.sum_term("t"), mean=op.avg_term("t"), n=op.count("t"))
    total, mean = (fn.number(C(c), "double") for c in ("total", "mean"))
    # a mean may lie on a rounding border: it is compared with the sum instead of rounded
    return s.select(value_of("name"), F.round(total, 2).alias("total"), "n",
                    (F.abs(mean * C("n") - total) < 1e-4).alias("mean_fits"), C("total")["dt"].alias("dt"))


@query("sum_of_integers", f"""
    SELECT p_brand AS brand, CAST(sum(p_size) AS BIGINT) AS total, '{XSD}integer' AS dt, round(avg(p_size), 6) AS mean,
      '{XSD}decimal' AS mean_dt FROM part GROUP BY 1""")
def sum_of_integers(spark, sf):
    b = op.star(one_graph(spark, sf, "part"), {"brand": EX + "brand", "n": EX + "size"}, functional=("brand", "n"))
    g = op.group(b, ["brand"], total=op.sum_term("n"), mean=op.avg_term("n"))
    return g.select(value_of("brand"), fn.number(C("total")).alias("total"), C("total")["dt"].alias("dt"),
                    F.round(fn.number(C("mean"), "double"), 6).alias("mean"), C("mean")["dt"].alias("mean_dt"))


@query("sum_with_bad_values", f"""
    SELECT p, CASE WHEN p = '{EX}size' THEN s END AS total FROM (SELECT '{EX}size' AS p, CAST(sum(p_size) AS BIGINT) AS s
    FROM part UNION ALL SELECT '{EX}brand', NULL UNION ALL SELECT '{EX}name', NULL UNION ALL SELECT '{EX}type', NULL)""")
def sum_with_bad_values(spark, sf):
    g = one_graph(spark, sf, "part").filter(~C("p").isin(RDF_TYPE, EX + "broader"))
    s = op.group(op.pattern(g, V("part"), V("p"), V("v")), ["p"], total=op.sum_term("v"))
    return s.select(value_of("p"), fn.number(C("total")).alias("total"))


@query("sum_of_nothing", f"SELECT 0 AS total, '{XSD}integer' AS dt, 0 AS mean, '' AS joined")
def sum_of_nothing(spark, sf):
    b = op.pattern(one_graph(spark, sf, "part"), V("x"), ex("nothing"), V("v"))
    s = op.group(b, [], total=op.sum_term("v"), mean=op.avg_term("v"), joined=op.group_concat("v"))
    return s.select(fn.number(C("total")).alias("total"), C("total")["dt"].alias("dt"), fn.number(C("mean")).alias("mean"), "joined")


@query("group_concat_nations", """
    SELECT r_name AS region, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM region
    JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def group_concat_nations(spark, sf):
    g = one_graph(spark, sf, "region", "nation")
    b = op.bgp(g, [(V("r"), A, ex("Region")), (V("r"), Iri(LABEL), V("region")), (V("n"), ex("region"), V("r")),
                   (V("n"), Iri(LABEL), V("nation"))])
    return op.group(b, ["region"], nations=op.group_concat("nation", ", ")).select(value_of("region"), "nations")


@query("group_concat_distinct", """
    SELECT p_brand AS brand, string_agg(DISTINCT p_type, ' ' ORDER BY p_type) AS types FROM part GROUP BY 1""")
def group_concat_distinct(spark, sf):
    b = op.star(one_graph(spark, sf, "part"), {"brand": EX + "brand", "type": EX + "type"}, functional=("brand", "type"))
    return op.group(b, ["brand"], types=op.group_concat("type", distinct=True)).select(value_of("brand"), "types")


@query("having_large_nations", f"""
    SELECT {iri('nation', 'c_nationkey')} AS nation, count(*) AS n FROM customer GROUP BY c_nationkey
    HAVING count(*) > (SELECT count(*) / 25.0 FROM customer)""")
def having_large_nations(spark, sf):
    b = op.pattern(one_graph(spark, sf, "customer"), V("c"), ex("nation"), V("nation"))
    mean = b.agg(F.count("*") / 25.0).scalar()
    return op.having(op.group(b, ["nation"], n=op.count("c")), C("n") > mean).select(value_of("nation"), "n")


def _plain(sql):
    return f"regexp_replace(rtrim(CAST({sql} AS VARCHAR), '0'), '[.]$', '.0')"


@query("small_decimals", f"""
    WITH p AS (SELECT {PART} AS part, CAST(p_partkey AS DECIMAL(18,0)) AS k, CAST(p_size AS DECIMAL(18,0)) AS z FROM part)
    SELECT part, {_plain("CAST((k + z) * 0.00000000000001 AS DECIMAL(30,14))")} AS total,
      {_plain("CAST(k * z * 0.000000000000000001 AS DECIMAL(38,18))")} AS product, k < z AS less FROM p""")
def small_decimals(spark, sf):
    """Keys and sizes as numbers far below one: sums, products and comparisons lose no digit."""
    p = table(spark, sf, "part")

    def tiny(c, shift):
        return literal_term(F.concat(F.lit("0."), F.lpad(C(c).cast("string"), shift, "0")), XSD + "decimal")
    a, b = tiny("p_partkey", 14), tiny("p_size", 14)
    small, less = fn.multiply(tiny("p_partkey", 9), tiny("p_size", 9)), fn.lt(a, b)
    return p.select(entity("part", C("p_partkey")).alias("part"), fn.add(a, b)["value"].alias("total"),
                    small["value"].alias("product"), less.alias("less"))


# ---------------------------------------------------------------- order, limit, pages
@query("order_of_mixed_terms", f"""
    WITH v AS (SELECT {ORD} AS o, 1 AS kind, 0 AS class, NULL AS num, NULL AS ts, {iri('customer', 'o_custkey')} AS value FROM orders
      UNION ALL SELECT {ORD}, 1, 0, NULL, NULL, '{EX}Order' FROM orders
      UNION ALL SELECT {ORD}, 2, 0, NULL, NULL, o_orderstatus FROM orders
      UNION ALL SELECT {ORD}, 2, 0, NULL, NULL, o_orderpriority FROM orders
      UNION ALL SELECT {ORD}, 2, 2, NULL, o_orderdate, NULL FROM orders
      UNION ALL SELECT {ORD}, 2, 3, o_totalprice, NULL, NULL FROM orders)
    SELECT o, kind, round(num, 2) AS num,
      row_number() OVER (ORDER BY kind, class, ts NULLS FIRST, num NULLS FIRST, value NULLS FIRST, o) - 1 AS pos FROM v""")
def order_of_mixed_terms(spark, sf):
    b = op.pattern(one_graph(spark, sf, "orders"), V("o"), V("p"), V("v")).select("v", "o")
    placed = row_index(b, ["v", "o"], out="pos")
    return placed.select(value_of("o"), C("v")["kind"].alias("kind"), F.round(double_of(C("v")), 2).alias("num"), "pos")


@query("order_of_dates", f"""
    WITH d AS (SELECT {ORD} AS o, o_orderkey % 3 AS zone, o_orderdate + to_seconds(o_orderkey % 50000) AS ts FROM orders),
    w AS (SELECT o, ts, CASE zone WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
        WHEN 1 THEN strftime(ts + INTERVAL 300 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:00'
        ELSE strftime(ts - INTERVAL 210 MINUTE, '%Y-%m-%dT%H:%M:%S') || '-03:30' END AS date FROM d)
    SELECT o, date, row_number() OVER (ORDER BY ts, date, o) - 1 AS pos FROM w""")
def order_of_dates(spark, sf):
    """Times written in three zones, in the order of their instants."""
    key = C("o_orderkey")
    at = C("o_orderdate").cast("timestamp") + F.make_interval(secs=(key % 50000))
    zone = [(0, "Z"), (300, "+05:00"), (-210, "-03:30")]
    text = [F.concat(F.date_format(at + F.make_interval(mins=F.lit(m)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(z)) for m, z in zone]
    written = F.element_at(F.array(*text), (key % 3 + 1).cast("int"))
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(
        literal_term(written, XSD_DATETIME).alias("date"), iri_term(entity("order", key)).alias("o"))
    return values(row_index(orders, ["date", "o"], out="pos").withColumn("pos", F.struct(C("pos").alias("value")))
                  ).withColumn("pos", C("pos").cast("long"))


@query("top_orders", f"""
    SELECT {ORD} AS o, o_totalprice AS total FROM orders ORDER BY o_totalprice DESC, o LIMIT 50""")
def top_orders(spark, sf):
    b = op.pattern(one_graph(spark, sf, "orders"), V("o"), ex("total"), V("t"))
    return op.top_k(b, [op.desc("t"), "o"], 50).select(value_of("o"), fn.number(C("t"), "double").alias("total"))


@query("top_names", f"SELECT {CUST} AS c, c_name AS name FROM customer ORDER BY name LIMIT 20")
def top_names(spark, sf):
    b = op.pattern(one_graph(spark, sf, "customer"), V("c"), ex("name"), V("name"))
    return values(op.top_k(b, ["name"], 20))


@query("limit_count", "SELECT least(count(*), 10) AS n FROM customer")
def limit_count(spark, sf):
    b = op.pattern(one_graph(spark, sf, "customer"), V("c"), ex("name"), V("name"))
    return op.limit(b, 10).agg(F.count("*").alias("n"))


@query("slice_customers", "SELECT c_name AS name FROM customer ORDER BY c_name LIMIT 25 OFFSET 40")
def slice_customers(spark, sf):
    b = op.pattern(one_graph(spark, sf, "customer"), V("c"), ex("name"), V("name")).select("name")
    return values(op.slice_rows(b, ["name"], 40, 25))


@query("capped_orders", f"SELECT {ORD} AS o FROM orders ORDER BY o LIMIT 10000")
def capped_orders(spark, sf):
    b = op.pattern(one_graph(spark, sf, "orders"), V("o"), ex("status"), V("status")).select("o")
    return values(op.cap(op.order(b, "o"), 10_000, 1_000_000))


@query("pages_of_orders", f"""
    SELECT o, status, CAST(floor((row_number() OVER (ORDER BY status DESC, o) - 1) / 700) AS BIGINT) AS page
    FROM (SELECT {ORD} AS o, o_orderstatus AS status FROM orders)""")
def pages_of_orders(spark, sf):
    b = op.pattern(one_graph(spark, sf, "orders"), V("o"), ex("status"), V("status"))
    return op.paginate(b, [op.desc("status"), "o"], 700, unique_rows=True).select(value_of("o"), value_of("status"), "page")


@query("pages_with_equal_rows", """
    SELECT status, page, count(*) AS n FROM (SELECT o_orderstatus AS status,
      CAST(floor((row_number() OVER (ORDER BY o_orderstatus) - 1) / 1000) AS BIGINT) AS page FROM orders) GROUP BY 1, 2""")
def pages_with_equal_rows(spark, sf):
    b = op.pattern(one_graph(spark, sf, "orders"), V("o"), ex("status"), V("status")).select("status")
    return op.paginate(b, ["status"], 1000).groupBy(value_of("status"), "page").agg(F.count("*").alias("n"))


@query("distinct_values", "SELECT DISTINCT p_brand AS brand, p_type AS type FROM part")
def distinct_values(spark, sf):
    b = op.star(one_graph(spark, sf, "part"), {"brand": EX + "brand", "type": EX + "type"}, functional=("brand", "type"))
    return values(op.distinct(op.project(b, ["brand", "type"])))
