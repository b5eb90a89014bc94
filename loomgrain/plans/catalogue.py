"""Registered queries: every relational operator of the analyser on the star-schema and text tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrain.operators import graph, joins, ngrams
from loomgrain.operators.shared import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SIZE, CAP = 50, 30  # tokens of a window, members of a bucket that window_collisions reports


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


_TOKENS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
_WINDOWS = f"""
    tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
    pos AS (SELECT doc_id, t, unnest(range(0, len(t) - {SIZE} + 1)) AS start FROM tok WHERE len(t) >= {SIZE}),
    win AS (SELECT doc_id, start, array_to_string(t[start + 1 : start + {SIZE}], ' ') AS h FROM pos),
    bucket AS (SELECT *, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id, start) AS r FROM win),
    member AS (SELECT doc_id, start, h, r FROM bucket WHERE n > 1),
    pair AS (SELECT f.doc_id AS a, m.doc_id AS b, f.start AS a_start, m.start AS b_start
             FROM member m JOIN member f ON f.h = m.h AND f.r = 1
             WHERE m.r > 1 AND (f.doc_id <> m.doc_id OR m.start - f.start >= {SIZE})),
    island AS (SELECT *, b_start - a_start AS d, a_start - row_number() OVER (PARTITION BY a, b, b_start - a_start ORDER BY a_start) AS g FROM pair),
    match AS (SELECT a, b, min(a_start) AS a_start, min(b_start) AS b_start, count(*) + {SIZE - 1} AS len FROM island GROUP BY a, b, d, g)"""


def _document_windows(t) -> DataFrame:
    return settled(ngrams.windows(t("documents").select("doc_id", ngrams.words(F.col("text")).alias("t")), "doc_id", "t", SIZE))


def _matches(t) -> DataFrame:
    pairs = ngrams.star_pairs(_document_windows(t), "doc_id", SIZE)
    return ngrams.maximal_matches(pairs.where("a <> b or a_start <> b_start"), SIZE)


@_query("SELECT min(doc_id) AS primary_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) >= 2")
def exact_duplicate_groups(t):
    return t("documents").groupBy("text").agg(F.min("doc_id").alias("primary_id"), F.count("*").alias("n")).where("n >= 2").drop("text")


_SHAPE = "regexp_replace(regexp_replace(regexp_replace(text, '[0-9]+', '0', 'g'), '[A-Za-z]+', 'a', 'g'), '[ \\t\\r\\n]+', ' ', 'g')"


@_query(f"SELECT min(doc_id) AS primary_id, count(*) AS n, count(DISTINCT source) AS n_sources FROM documents GROUP BY {_SHAPE} HAVING count(*) >= 2 AND count(DISTINCT source) >= 2")
def normalized_shape_groups(t):
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[0-9]+", "0"), "[A-Za-z]+", "a"), "[ \\t\\r\\n]+", " ")
    groups = t("documents").groupBy(shape.alias("shape")).agg(F.min("doc_id").alias("primary_id"), F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"))
    return groups.where("n >= 2 and n_sources >= 2").drop("shape")


@_query(f"SELECT item_id, CAST(s AS INTEGER) AS start, array_to_string(w[s + 1 : s + 8], ' ') AS gram FROM (SELECT item_id, w, unnest(range(0, len(w) - 7)) AS s FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark) WHERE len(w) >= 8)")
def token_windows(t):
    rows = t("benchmark").select("item_id", ngrams.words(F.col("text")).alias("w")).where("size(w) >= 8")
    starts = rows.select("item_id", "w", F.explode(F.expr("sequence(0, size(w) - 8)")).alias("start"))
    return starts.select("item_id", "start", F.expr("array_join(slice(w, start + 1, 8), ' ')").alias("gram"))


@_query(f"WITH {_WINDOWS} SELECT doc_id, CAST(start AS INTEGER) AS start, n, CAST(r AS INTEGER) AS r FROM bucket WHERE n > 1 AND r <= {CAP}")
def window_collisions(t):
    wins = _document_windows(t)
    sizes = settled(wins.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1"))
    rank = F.row_number().over(Window.partitionBy("h", "g").orderBy("doc_id", "start"))
    return wins.join(sizes, ["h", "g"]).withColumn("r", rank).where(F.col("r") <= CAP).drop("h", "g")


@_query(f"WITH {_WINDOWS} SELECT a, b, CAST(a_start AS INTEGER) AS a_start, CAST(b_start AS INTEGER) AS b_start, len FROM match")
def maximal_matches(t):
    return _matches(t)


@_query(f"""WITH RECURSIVE {_WINDOWS},
    edge AS (SELECT DISTINCT a, b FROM match WHERE a <> b),
    twoway AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
    walk(n, m) AS (SELECT a, a FROM twoway UNION SELECT w.n, e.b FROM walk w JOIN twoway e ON e.a = w.m),
    comp AS (SELECT n, min(m) AS c FROM walk GROUP BY n)
    SELECT c.c AS primary_id, count(DISTINCT c.n) AS n_members, max(x.len) AS max_len FROM comp c JOIN match x ON x.a <> x.b AND (x.a = c.n OR x.b = c.n) GROUP BY c.c""")
def duplicate_clusters(t):
    found = settled(_matches(t).where("a <> b"))
    comp = graph.connected_components(found.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    longest = found.select(F.col("a").alias("node"), "len").union(found.select("b", "len")).groupBy("node").agg(F.max("len").alias("len"))
    return comp.join(longest, "node").groupBy(F.col("component").alias("primary_id")).agg(F.count("*").alias("n_members"), F.max("len").alias("max_len"))


@_query(f"""WITH w AS (SELECT conv_id, turn, {_TOKENS} AS w FROM conversations),
    p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    z AS (SELECT conv_id, turn, least(len(x), len(y)) AS n, list_filter(list_zip(x, y), lambda q: q[1] = q[2]) AS same FROM p)
    SELECT conv_id, turn, round(CASE WHEN n > 0 THEN CAST(len(same) AS DOUBLE) / n END, 9) AS ratio FROM z""")
def identity_ratio(t):
    rows = t("conversations").select("conv_id", "turn", ngrams.words(F.col("text")).alias("w"))
    following = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return rows.join(following, ["conv_id", "turn"]).select("conv_id", "turn", F.round(ngrams.identity_ratio(F.col("w"), F.col("v")), 9).alias("ratio"))


def _grams(column: str, n: int) -> str:
    return f"unnest(list_transform(range(0, len(w) - {n - 1}), lambda i: array_to_string(w[i + 1 : i + {n}], ' ')))"


@_query(f"""WITH b AS (SELECT DISTINCT {_grams('w', 13)} AS g FROM (SELECT {_TOKENS} AS w FROM benchmark) WHERE len(w) >= 13),
    d AS (SELECT doc_id, {_grams('w', 13)} AS g FROM (SELECT doc_id, {_TOKENS} AS w FROM documents) WHERE len(w) >= 13)
    SELECT doc_id, count(*) AS n_windows FROM d WHERE g IN (SELECT g FROM b) GROUP BY doc_id""")
def benchmark_contamination(t):
    def wins(name, key):
        return ngrams.windows(t(name).select(key, ngrams.words(F.col("text")).alias("w")), key, "w", 13)

    known = settled(wins("benchmark", "item_id").select("h", "g").distinct())
    return wins("documents", "doc_id").join(known, ["h", "g"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_windows"))


_MARKERS = "@generated|auto-generated|autogenerated|do not edit|do not modify|licensed under|all rights reserved"


@_query(f"""SELECT 'documents' AS kind, doc_id AS id FROM documents WHERE regexp_matches(lower(substr(text, 1, 500)), '{_MARKERS}')
    UNION ALL SELECT 'pages', page_id FROM pages WHERE regexp_matches(lower(substr(html, 1, 500)), '{_MARKERS}')""")
def generated_marker_filter(t):
    def marked(name, key, column):
        return t(name).where(F.lower(F.substring(column, 1, 500)).rlike(_MARKERS)).select(F.lit(name).alias("kind"), F.col(key).alias("id"))

    return marked("documents", "doc_id", "text").unionByName(marked("pages", "page_id", "html"))


@_query("""SELECT page_id, regexp_matches(url, '(?i)(^|/)(tests?|e2e|generated|gen|docs?|blog)(/|$)') AS by_dir,
    regexp_matches(url, '[.](html?|php|aspx?)$') AS by_name, regexp_matches(url, '[?#]') AS has_query FROM pages""")
def path_predicate_filter(t):
    return t("pages").select("page_id", F.col("url").rlike("(?i)(^|/)(tests?|e2e|generated|gen|docs?|blog)(/|$)").alias("by_dir"), F.col("url").rlike("[.](html?|php|aspx?)$").alias("by_name"), F.col("url").rlike("[?#]").alias("has_query"))


@_query("SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity >= 45 AND l.l_returnflag = 'R')")
def dead_parts(t):
    live = t("lineitem").where("l_quantity >= 45 and l_returnflag = 'R'").select("l_partkey")
    return t("part").join(live, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@_query("""WITH u AS (SELECT l.l_suppkey, s.s_nationkey = c.c_nationkey AS home FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
      JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE l.l_quantity >= 50 AND l.l_discount >= 0.09)
    SELECT l_suppkey, count(*) AS n, bool_or(home) AS any_home, bool_and(home) AS only_home FROM u GROUP BY l_suppkey""")
def local_only_suppliers(t):
    uses = t("lineitem").where("l_quantity >= 50 and l_discount >= 0.09").select("l_orderkey", "l_suppkey")
    rows = uses.join(t("orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    home = F.col("s_nationkey") == F.col("c_nationkey")
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.bool_or(home).alias("any_home"), F.bool_and(home).alias("only_home"))


@_query("""WITH consumed AS (SELECT n_regionkey AS region, CASE WHEN n_nationkey % 7 = 0 THEN '*' ELSE n_name END AS symbol FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 7 = 0)
    SELECT n_nationkey, n_name FROM nation n WHERE EXISTS (SELECT 1 FROM consumed c WHERE c.region = n.n_regionkey AND (c.symbol = n.n_name OR c.symbol = '*'))""")
def consumed_wildcard(t):
    nation = t("nation")
    consumed = nation.where("n_nationkey % 3 = 0 or n_nationkey % 7 = 0").select(F.col("n_regionkey").alias("region"), F.when(F.col("n_nationkey") % 7 == 0, "*").otherwise(F.col("n_name")).alias("symbol"))
    whole = consumed.where("symbol = '*'").select("region")
    by_star = nation.join(whole, nation["n_regionkey"] == whole["region"], "left_semi")
    by_name = nation.join(consumed, (nation["n_regionkey"] == consumed["region"]) & (nation["n_name"] == consumed["symbol"]), "left_semi")
    return by_star.union(by_name).distinct().select("n_nationkey", "n_name")


_DIRS = "array_to_string((string_split(url, '/'))[1:{n}], '/')"


@_query("""WITH owners AS (SELECT DISTINCT array_to_string((string_split(url, '/'))[1:3], '/') AS dir FROM pages
      UNION SELECT DISTINCT array_to_string((string_split(url, '/'))[1:4], '/') FROM pages WHERE page_id % 2 = 0),
    m AS (SELECT p.page_id, o.dir, row_number() OVER (PARTITION BY p.page_id ORDER BY length(o.dir) DESC) AS r
      FROM pages p JOIN owners o ON p.url = o.dir OR starts_with(p.url, o.dir || '/'))
    SELECT page_id, dir AS owner FROM m WHERE r = 1""")
def owner_longest_prefix(t):
    pages = t("pages").select("page_id", "url")
    short = pages.selectExpr("array_join(slice(split(url, '/'), 1, 3), '/') AS dir")
    deep = pages.where("page_id % 2 = 0").selectExpr("array_join(slice(split(url, '/'), 1, 4), '/') AS dir")
    return joins.longest_prefix(pages, "url", short.union(deep), "dir").where("owner is not null").select("page_id", "owner")


@_query("""WITH p AS (SELECT DISTINCT url, string_split(url, '/') AS s FROM pages), k AS (SELECT url, s, unnest(range(1, len(s) + 1)) AS n FROM p),
    tails AS (SELECT url, array_to_string(s[len(s) - n + 1 : len(s)], '/') AS tail FROM k)
    SELECT tail, min(url) AS url FROM tails GROUP BY tail HAVING count(*) = 1""")
def suffix_alias_match(t):
    return joins.unique_suffixes(t("pages"), "url").where("n = 1").select("tail", "url")


@_query("""WITH c AS (SELECT page_id, url, unnest([url || '/index.html', url || '.html', regexp_replace(url, '[0-9]+$', ''), regexp_replace(url, '/[^/]*$', ''), url]) AS cand, unnest([0, 1, 2, 3, 4]) AS pos FROM pages),
    r AS (SELECT c.page_id, c.cand, row_number() OVER (PARTITION BY c.page_id ORDER BY c.pos) AS r FROM c WHERE c.cand IN (SELECT url FROM pages))
    SELECT page_id, cand AS resolved FROM r WHERE r = 1""")
def candidate_resolution(t):
    u = F.col("url")
    tries = F.array(F.concat(u, F.lit("/index.html")), F.concat(u, F.lit(".html")), F.regexp_replace(u, "[0-9]+$", ""), F.regexp_replace(u, "/[^/]*$", ""), u)
    return joins.first_candidate(t("pages"), "page_id", tries, t("pages"), "url")


@_query("""SELECT e.event_id, (SELECT max(r.event_id) FROM events r WHERE r.user_id = e.user_id AND r.event_type = 'error' AND r.ts = m.matched) AS last_error_id
    FROM events e LEFT JOIN LATERAL (SELECT max(x.ts) AS matched FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.ts <= e.ts AND x.ts >= e.ts - INTERVAL 1 HOUR) m ON true
    WHERE e.event_type = 'purchase'""")
def asof_last_error(t):
    events = t("events").select("event_id", "user_id", "ts", "event_type")
    errors = events.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    near = F.col("matched") >= F.col("ts") - F.expr("INTERVAL 1 HOUR")
    return joins.backward_asof(bought, errors, ["user_id"], "ts", "error_id", near, F.date_trunc("day", "ts")).select("event_id", F.col("last_error_id"))


@_query("""WITH l AS (SELECT l_orderkey, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY l_orderkey),
    x AS (SELECT o.o_custkey, o.o_orderdate <= l.hi AND o.o_orderdate + INTERVAL 60 DAY >= l.lo AS hit FROM orders o JOIN l ON l.l_orderkey = o.o_orderkey)
    SELECT o_custkey, bool_and(hit) AS all_overlap, count(*) AS n FROM x GROUP BY o_custkey""")
def interval_overlap(t):
    ship = t("lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))
    hit = (F.col("o_orderdate") <= F.col("hi")) & (F.col("o_orderdate") + F.expr("INTERVAL 60 DAY") >= F.col("lo"))
    rows = t("orders").join(ship, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_custkey").agg(F.bool_and(hit).alias("all_overlap"), F.count("*").alias("n"))


@_query("""SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_quantity >= 10) AND count(DISTINCT l_partkey) = count(*)""")
def all_members_division(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.bool_and(F.col("l_quantity") >= 10).alias("every"), F.count_distinct("l_partkey").alias("d")).where("every and d = n").select("l_orderkey", "n")


@_query("""WITH b AS (SELECT p_partkey, p_type, p_size, regexp_extract(p_brand, '^(.*?)[0-9]+$', 1) AS base, p_brand FROM part),
    c AS (SELECT *, count(*) OVER (PARTITION BY p_type, p_size, base) AS partners FROM b)
    SELECT p_type, p_size, count(*) AS n FROM c WHERE partners < 2 OR base = '' GROUP BY p_type, p_size""")
def version_partner_exclusion(t):
    rows = t("part").select("p_type", "p_size", F.regexp_extract("p_brand", "^(.*?)[0-9]+$", 1).alias("base"))
    partners = F.count("*").over(Window.partitionBy("p_type", "p_size", "base"))
    return rows.withColumn("partners", partners).where("partners < 2 or base = ''").groupBy("p_type", "p_size").agg(F.count("*").alias("n"))


@_query("""SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_hit, count(*) AS n FROM orders GROUP BY o_custkey
    HAVING count(*) FILTER (WHERE o_orderstatus = 'F') >= 2 AND count(*) FILTER (WHERE o_orderstatus = 'F') >= 0.5 * count(*)""")
def wrapper_ratio(t):
    return t("orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_hit"), F.count("*").alias("n")).where("n_hit >= 2 and n_hit >= 0.5 * n")


@_query("SELECT l_suppkey, least(0.9, min(l_discount)) AS least_score, round(avg(l_discount), 9) AS mean_score FROM lineitem GROUP BY l_suppkey")
def min_avg_confidence(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.least(F.lit(0.9), F.min("l_discount")).alias("least_score"), F.round(F.avg("l_discount"), 9).alias("mean_score"))


_EDGES = """edge AS (SELECT DISTINCT c.c_nationkey AS src, s.s_nationkey AS dst FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
      JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
      WHERE l.l_quantity >= 50 AND l.l_discount >= 0.09 AND l.l_returnflag = 'R')"""


def _edges(t) -> DataFrame:
    uses = t("lineitem").where("l_quantity >= 50 and l_discount >= 0.09 and l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
    rows = uses.join(t("orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    return rows.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


def _roots(t) -> DataFrame:
    return t("nation").where("n_nationkey % 10 = 0").select(F.col("n_nationkey").alias("node"))


_REACH = f"WITH RECURSIVE {_EDGES}, reach(node) AS (SELECT n_nationkey FROM nation WHERE n_nationkey % 10 = 0 UNION SELECT e.dst FROM reach r JOIN edge e ON e.src = r.node)"


@_query(f"{_REACH} SELECT node FROM reach")
def reachability(t):
    return graph.reachable(_edges(t), _roots(t)).select("node")


@_query(f"{_REACH} SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT node FROM reach)")
def orphans(t):
    seen = graph.reachable(_edges(t), _roots(t))
    return t("nation").join(seen, F.col("n_nationkey") == F.col("node"), "left_anti").select("n_nationkey", "n_name")


@_query(f"""WITH RECURSIVE {_EDGES}, succ AS (SELECT src, min(dst) AS dst FROM edge WHERE src <> dst GROUP BY src),
    walk(node, cur, path) AS (SELECT src, src, [src] FROM succ UNION ALL SELECT w.node, s.dst, list_append(w.path, s.dst) FROM walk w JOIN succ s ON s.src = w.cur WHERE NOT list_contains(w.path, s.dst))
    SELECT node, CAST(max(len(path)) AS INTEGER) AS n FROM walk WHERE cur IN (SELECT src FROM succ) GROUP BY node""")
def chain_walk(t):
    succ = _edges(t).where("src <> dst").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("next"))
    return graph.chains(succ).select("node", F.size("path").alias("n"))


@_query("""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id, href""")
def html_link_extract(t):
    links = t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@_query("SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY event_type, k")
def json_props(t):
    return t("events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@_query("""SELECT event_id, event_type FROM events e WHERE event_type <> 'error' AND NOT EXISTS (
    SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND date_trunc('day', x.ts) = date_trunc('day', e.ts))""")
def rollup_anti(t):
    events = t("events").withColumn("day", F.date_trunc("day", "ts"))
    consumed = events.where("event_type = 'error'").select("user_id", "day").distinct()
    return events.where("event_type <> 'error'").join(consumed, ["user_id", "day"], "left_anti").select("event_id", "event_type")


@_query("""WITH s AS (SELECT d.doc_id, least(1.0, greatest(0.0, CASE WHEN d.n_chars >= 1000 THEN 1.0 ELSE 0.6 END - 0.15 + CASE WHEN l.quality = 1 THEN 0.05 ELSE 0.0 END - CASE WHEN d.n_chars < 75 THEN 0.15 ELSE 0.0 END)) AS confidence
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id) SELECT doc_id, CAST(round(confidence, 9) AS DOUBLE) AS confidence FROM s WHERE confidence >= 0.7""")
def confidence_floor(t):
    n = F.col("n_chars")
    score = F.when(n >= 1000, 1.0).otherwise(0.6) - 0.15 + F.when(F.col("quality") == 1, 0.05).otherwise(0.0) - F.when(n < 75, 0.15).otherwise(0.0)
    rows = t("documents").select("doc_id", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id")
    return rows.select("doc_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 9).alias("confidence")).where("confidence >= 0.7")


@_query("""SELECT event_id, CAST(CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS INTEGER) AS rank FROM events ORDER BY user_id, rank, ts, event_id""")
def kind_rank_sort(t):
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "click", 3).otherwise(4)
    return t("events").withColumn("rank", rank).orderBy("user_id", "rank", "ts", "event_id").select("event_id", "rank")


@_query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
    SELECT doc_id FROM r WHERE i % greatest(1, n // 12) = 0 AND i // greatest(1, n // 12) < 12""")
def systematic_sample(t):
    from loomgrain.operators.sampling import every_nth

    return every_nth(t("documents").select("doc_id"), "doc_id", 12)


@_query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, kind")
def count_by_kind(t):
    return t("events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


@_query("""SELECT module, n, round(100.0 * n / sum(n) OVER (), 9) AS pct FROM (SELECT l_returnflag || l_linestatus AS module, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC LIMIT 20""")
def top_modules_pct(t):
    sums = t("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("module")).agg(F.sum("l_quantity").cast("bigint").alias("n"))
    whole = sums.agg(F.sum("n").alias("total"))
    return sums.crossJoin(F.broadcast(whole)).select("module", "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 9).alias("pct")).orderBy(F.desc("n")).limit(20)


@_query("SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def set_intersect(t):
    return t("customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k")).intersect(t("orders").where("o_totalprice > 200000").select("o_custkey"))


@_query("SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def set_except(t):
    return t("customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k")).subtract(t("orders").where("o_totalprice > 200000").select("o_custkey"))


@_query("""WITH o AS (SELECT o_custkey AS k, count(*) AS n_orders FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), e AS (SELECT user_id AS k, count(*) AS n_events FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT coalesce(o.k, e.k) AS k, CASE WHEN o.k IS NULL THEN 'only-right' WHEN e.k IS NULL THEN 'only-left' ELSE 'shared' END AS side, n_orders, n_events FROM o FULL JOIN e ON o.k = e.k""")
def report_full_outer(t):
    o = t("orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("lk")).agg(F.count("*").alias("n_orders"))
    e = t("events").where("event_type = 'error'").groupBy(F.col("user_id").alias("rk")).agg(F.count("*").alias("n_events"))
    side = F.when(F.col("lk").isNull(), "only-right").when(F.col("rk").isNull(), "only-left").otherwise("shared")
    return o.join(e, F.col("lk") == F.col("rk"), "full").select(F.coalesce("lk", "rk").alias("k"), side.alias("side"), "n_orders", "n_events")


@_query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0 UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
def entry_union(t):
    a = t("customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return a.union(t("supplier").where("s_acctbal < 0").select("s_nationkey")).union(t("nation").where("n_regionkey = 2").select("n_nationkey")).distinct()
