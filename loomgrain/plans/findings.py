"""Detectors and insights: DataFrames of facts in, one schema of findings out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.frontend.facts import relation
from loomgrain.operators import graph, ngrams
from loomgrain.operators.shared import settled, side_by_side
from loomgrain.plans import conventions as rules
from loomgrain.plans.links import Links

LOCATION = "struct<file:string,line:int,column:int,endLine:int>"
FINDING = {
    "kind": "string", "confidence": "double", "location": LOCATION, "symbol": "string", "symbolKind": "string", "exported": "boolean", "localUses": "int", "outerName": "string", "innerCall": "string",
    "predicateName": "string", "collapsesTo": "string", "primary": LOCATION, "matches": f"array<{LOCATION}>", "similarity": "double", "preview": "string", "primaryName": "string", "matchNames": "array<string>",
    "fieldCount": "int", "functionName": "string", "swallowsAll": "boolean", "rethrowsOnly": "boolean", "file": "string", "deadSymbols": "array<struct<symbol:string,line:int>>", "primarySymbol": "string",
    "matchSymbols": "array<string>", "wrapperCount": "int", "totalExports": "int", "chain": f"array<struct<location:{LOCATION},name:string>>", "terminalCall": "string", "folder": "string", "files": "array<string>", "scaffold": "string",
}
DETECTORS = ("duplicates", "dead-code", "empty-wrappers", "ai-signatures", "code-smells")
WINDOW, MAX_LINES, BUCKET_CAP, MIN_NODES = 50, 5000, 30, 20


def finding(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    given = {"kind": F.lit(kind), **columns}
    return df.select(*[(given[n].cast(t) if n in given else F.lit(None).cast(t)).alias(n) for n, t in FINDING.items()])


def spot(file: Column, line: Column, col: Column | None = None, end: Column | None = None) -> Column:
    return F.struct(file.alias("file"), line.cast("int").alias("line"), (F.lit(1) if col is None else col).cast("int").alias("column"), (F.lit(None) if end is None else end).cast("int").alias("endLine")).cast(LOCATION)


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def dead_code(decls: DataFrame, links: Links, allow_js: bool, consumed: DataFrame) -> DataFrame:
    """Declarations that nothing refers to, and exports that only their own file uses.

    ``decls`` are those of production files; ``consumed(symbol)`` is used from outside, ``*`` meaning all.
    """
    at = decls.join(links.entries, "rel", "left_anti").where(~F.col("symbol").startswith("_") & ~F.col("decorated"))
    if not allow_js:
        at = at.where(~F.col("rel").rlike(r"(?i)\.[mc]?jsx?$"))
    at = at.join(links.template_refs.where("symbol is not null"), ["rel", "symbol"], "left_anti")
    first = at.groupBy("rel", "symbol").agg(F.min("ord").alias("ord"))
    at = at.join(first, ["rel", "symbol", "ord"], "left_semi")
    every = relation_of(links, "decls").select("rel", "symbol", "exported", "is_default")
    cross = links.references(every).union(links.alias_references(every)).distinct()
    if not consumed.where("symbol = '*'").isEmpty():
        return finding(at.limit(0), "dead-code")
    at = at.join(cross, ["rel", "symbol"], "left_anti").join(consumed, "symbol", "left_anti")
    where = spot(F.col("file"), F.col("line"), F.col("col"))
    framework = F.when(F.col("rel").rlike(rules.FRAMEWORK_FILE), 0.4).otherwise(0.0)
    default = F.when(F.col("is_default"), 0.2).otherwise(0.0)
    common = {"location": where, "symbol": F.col("symbol"), "symbolKind": F.col("symbol_kind")}
    dead = at.where("local_uses = 0")
    dead = finding(dead, "dead-code", confidence=clamp(F.lit(0.9) - default - framework + F.when(F.col("exported"), 0.0).otherwise(0.05)), exported=F.col("exported"), **common)
    local = at.where(F.col("exported") & (F.col("local_uses") > 0) & ~F.col("rel").rlike(rules.PUBLICATION))
    local = finding(local, "unused-export", confidence=clamp(F.lit(0.75) - default - framework), localUses=F.col("local_uses"), **common)
    return dead.unionByName(local)


def relation_of(links: Links, name: str) -> DataFrame:
    return relation(links.facts, name)


def empty_wrappers(functions: DataFrame) -> DataFrame:
    hits = functions.where(F.col("wrapper_call").isNotNull() & ~F.col("rel").rlike(rules.PUBLICATION) & ~rules.framework_function())
    return finding(hits, "empty-wrapper", confidence=F.col("wrapper_score"), location=spot(F.col("file"), F.col("line"), F.col("col")), outerName=F.col("name"), innerCall=F.col("wrapper_call"))


def type_predicates(functions: DataFrame) -> DataFrame:
    hits = functions.where("collapses_to is not null")
    return finding(hits, "useless-type-predicate", confidence=F.lit(0.9), location=spot(F.col("file"), F.col("line"), F.col("col")), predicateName=F.col("name"), collapsesTo=F.col("collapses_to"))


def same_shapes(types: DataFrame) -> DataFrame:
    """Types with one canonical member list and two names at least; version partners (V1, V2) don't count as names."""
    base = F.regexp_extract("name", r"^(.+?)(?:V|_v|Version)\d+$", 1)
    keyed = types.withColumn("key", F.array_join("members", "\n")).withColumn("base", base)
    partners = F.count("*").over(Window.partitionBy("key", "base"))
    kept = keyed.withColumn("n", partners).where("base = '' or n < 2").withColumn("layered", F.col("rel").rlike(rules.LAYERED).cast("int"))
    one = F.struct("rel", "ord", spot(F.col("file"), F.col("line"), F.col("col")).alias("loc"), "name")
    groups = kept.groupBy("key").agg(F.sort_array(F.collect_list(one)).alias("g"), F.count_distinct("name").alias("names"), F.sum("layered").alias("layered"), F.first(F.size("members")).alias("fields"))
    score = clamp(F.lit(0.8) - F.when(F.col("layered") >= 2, 0.2).otherwise(0.0) + F.least(F.lit(0.025) * (F.col("fields") - 3), F.lit(0.1)))
    rest = F.slice("g", F.lit(2), F.size("g"))
    return finding(groups.where("size(g) >= 2 and names >= 2"), "same-shape-types", confidence=score, primary=F.col("g")[0]["loc"], matches=F.transform(rest, lambda x: x["loc"]), primaryName=F.col("g")[0]["name"], matchNames=F.transform(rest, lambda x: x["name"]), fieldCount=F.col("fields"))


def useless_async(functions: DataFrame) -> DataFrame:
    hits = functions.where(F.col("idle_async") & ~F.col("rel").rlike(rules.PUBLICATION) & ~F.col("rel").rlike(rules.MIGRATIONS) & ~rules.framework_function())
    return finding(hits, "useless-async", confidence=F.lit(0.8), location=spot(F.col("file"), F.col("line"), F.col("col")), functionName=F.col("name"))


def empty_catches(catches: DataFrame) -> DataFrame:
    hits = catches.where(~F.col("rel").rlike(rules.PUBLICATION))
    score = F.when(F.col("rethrows_only"), 0.8).when(F.col("swallows_all"), 0.85).otherwise(0.75)
    return finding(hits, "empty-catch", confidence=score, location=spot(F.col("file"), F.col("line"), F.col("col")), swallowsAll=F.col("swallows_all"), rethrowsOnly=F.col("rethrows_only"))


def _base(rel: str) -> Column:
    return F.regexp_extract(rel, r"([^/]*)$", 1)


def duplicates(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Token windows that repeat inside function bodies, and functions of one shape under several names."""
    small = files.where(F.size(F.split("text", "\n")) <= MAX_LINES).select("rel")
    rows = facts.join(small, "rel", "left_semi").where(F.size("tokens") >= WINDOW)
    rows = settled(rows.select("file", "rel", "tokens", "functions", "lists", F.transform("tokens", lambda t: t["norm"]).alias("norm")))
    pairs = ngrams.star_pairs(settled(ngrams.windows(rows, "rel", "norm", WINDOW)), "rel", WINDOW, BUCKET_CAP)
    both_or_neither = lambda p: F.col("a").rlike(p) & F.col("b").rlike(p)
    allowed = ~both_or_neither(rules.I18N) & ((F.col("a") == F.col("b")) | ~(both_or_neither(rules.PUBLICATION) | both_or_neither(rules.MIGRATIONS) | (_base("a") == _base("b"))))
    runs = ngrams.maximal_matches(pairs.where(allowed), WINDOW).where((F.col("a") != F.col("b")) | (F.col("b_start") - F.col("a_start") - F.col("len") >= WINDOW))
    side = rows.select("rel", "file", "tokens", "functions", "lists")
    m = runs.join(side.toDF("a", "a_file", "a_tok", "a_fun", "a_lists"), "a").join(side.toDF("b", "b_file", "b_tok", "b_fun", "b_lists"), "b")

    def body(s: str) -> Column:
        """The innermost block body that holds the middle token."""
        mid = F.col(f"{s}_tok")[(F.col(f"{s}_start") + F.floor(F.col("len") / 2)).cast("int")]["pos"]
        inside = F.filter(F.col(f"{s}_fun"), lambda f: f["body_start"].isNotNull() & (f["body_start"] <= mid) & (mid < f["body_end"]))
        return F.array_max(F.transform(inside, lambda f: F.struct(f["body_start"].alias("s"), f["body_end"].alias("e"))))

    m = m.withColumn("a_body", body("a")).withColumn("b_body", body("b")).where("a_body is not null and b_body is not null")

    def outside(s: str) -> tuple[Column, Column]:
        part = F.slice(F.col(f"{s}_tok"), (F.col(f"{s}_start") + 1).cast("int"), F.col("len").cast("int"))
        return F.size(F.filter(part, lambda t: t["pos"] < F.col(f"{s}_body.s"))), F.size(F.filter(part, lambda t: t["pos"] >= F.col(f"{s}_body.e")))

    (a_head, a_tail), (b_head, b_tail) = outside("a"), outside("b")
    m = m.withColumn("head", F.greatest(a_head, b_head)).withColumn("tail", F.greatest(a_tail, b_tail)).withColumn("n", (F.col("len") - F.col("head") - F.col("tail")).cast("int")).where(F.col("n") >= WINDOW)

    def run_of(s: str) -> Column:
        return F.slice(F.col(f"{s}_tok"), (F.col(f"{s}_start") + F.col("head") + 1).cast("int"), F.col("n"))

    m = m.withColumn("x", run_of("a")).withColumn("y", run_of("b"))
    half = F.floor(F.col("n") / 2).cast("int")
    ax, by = F.col("x")[half]["pos"], F.col("y")[half]["pos"]
    holds = lambda n: (n["start_pos"] <= ax) & (ax < n["end_pos"]) & (n["start_pos"] <= by) & (by < n["end_pos"])
    shared_list = F.array_max(F.transform(F.filter("a_lists", holds), lambda n: n["start_pos"]))
    shared_fun = F.array_max(F.transform(F.filter("a_fun", holds), lambda n: n["start_pos"]))
    m = m.where(~((F.col("a") == F.col("b")) & F.coalesce(shared_list > F.coalesce(shared_fun, F.lit(-1)), F.lit(False))))
    similarity = ngrams.identity_ratio(F.transform("x", lambda t: t["text"]), F.transform("y", lambda t: t["text"]))
    m = m.withColumn("similarity", similarity)
    score = clamp(F.col("similarity") - 0.15 + F.when(F.col("a") != F.col("b"), 0.05).otherwise(0.0) - F.when(F.col("n") < 75, 0.15).otherwise(0.0))
    words = F.array_join(F.transform(F.slice("x", 1, 10), lambda t: t["text"]), " ")
    preview = F.when(F.length(words) > 80, F.concat(F.substring(words, 1, 77), F.lit("..."))).otherwise(words)
    loc = lambda s, x: spot(F.col(f"{s}_file"), F.col(x)[0]["line"], None, F.element_at(x, -1)["line"])
    m = settled(m.select("similarity", score.alias("confidence"), "n", preview.alias("preview"), loc("a", "x").alias("l"), loc("b", "y").alias("r")))
    windows = _clusters(m)
    return windows.unionByName(_structural(rows.select("file", "rel", "functions"), windows))


def _clusters(m: DataFrame) -> DataFrame:
    """Matches that share a place are one finding, headed by the longest."""
    node = lambda c: F.concat_ws(":", f"{c}.file", f"{c}.line")
    m = m.withColumn("u", node("l")).withColumn("v", node("r"))
    comp = graph.connected_components(m.select(F.col("u").alias("src"), F.col("v").alias("dst")))
    joined = m.join(comp, m["u"] == comp["node"])
    order = F.struct(F.col("n").alias("n"), F.struct((-F.col("l.line")).alias("k"), "l", "r", "preview").alias("head"))
    groups = joined.groupBy("component").agg(F.max(order).alias("best"), F.array_union(F.collect_set("l"), F.collect_set("r")).alias("all"), F.max("similarity").alias("similarity"), F.max("confidence").alias("confidence"))
    head = F.col("best.head.l")
    base = lambda f: F.element_at(F.split(f, "/"), -1)
    keep = lambda x: ~((x["file"] == head["file"]) & (x["line"] == head["line"])) & ~((x["file"] != head["file"]) & (base(x["file"]) == base(head["file"])))
    first_of_line = F.filter(F.array_sort("all"), keep)
    first_of_line = F.filter(first_of_line, lambda x, i: ~F.exists(F.slice(first_of_line, 1, i), lambda y: (y["file"] == x["file"]) & (y["line"] == x["line"])))
    groups = groups.withColumn("matches", first_of_line).where("size(matches) > 0")
    return finding(groups, "duplicate", confidence=F.col("confidence"), primary=head, matches=F.col("matches"), similarity=F.col("similarity"), preview=F.col("best.head.preview"))


def _structural(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Named functions with blocks of one shape; gone if a window finding overlaps every one of them."""
    f = rows.select("file", "rel", F.explode("functions").alias("f")).where(F.col("f.form").isin("FunctionDeclaration", "MethodDeclaration", "ArrowFunction", "FunctionExpression") & (F.col("f.n_nodes") >= MIN_NODES) & F.col("f.name").isNotNull())
    spans = windows.select(F.explode(F.concat(F.array("primary"), "matches")).alias("w")).select(F.col("w.file").alias("w_file"), F.col("w.line").alias("w_a"), F.col("w.endLine").alias("w_b"))
    overlap = (F.col("file") == F.col("w_file")) & (F.col("w_a") <= F.col("f.body_end_line")) & (F.col("w_b") >= F.col("f.body_line"))
    covered = f.join(spans, overlap, "left_semi").select("file", F.col("f.ord").alias("c_ord"), F.lit(True).alias("covered"))
    marked = f.withColumn("c_ord", F.col("f.ord")).join(covered, ["file", "c_ord"], "left")
    one = F.struct("rel", F.col("f.ord").alias("ord"), spot(F.col("file"), F.col("f.line"), None, F.col("f.body_end_line")).alias("loc"), F.col("f.name").alias("name"))
    every = lambda p: F.bool_and(F.col("rel").rlike(p))
    groups = marked.groupBy("f.shape").agg(
        F.sort_array(F.collect_list(one)).alias("g"), F.count_distinct("f.name").alias("names"), F.min("f.n_nodes").alias("nodes"), (every(rules.I18N) | every(rules.PUBLICATION) | every(rules.MIGRATIONS)).alias("quiet"),
        F.count_distinct(_base("rel")).alias("bases"), F.count_distinct("rel").alias("files"), F.bool_and(F.coalesce("covered", F.lit(False))).alias("covered"),
    )
    groups = groups.where("size(g) >= 2 and names >= 2 and not quiet and not covered and not (bases = 1 and files > 1)")
    bonus = F.least(F.lit(0.05), (F.col("nodes") - MIN_NODES) / MIN_NODES * 0.03)
    preview = F.concat(F.array_join(F.transform("g", lambda x: x["name"]), ", "), F.lit(" — same AST shape ("), F.col("nodes"), F.lit(" nodes)"))
    return finding(groups, "duplicate", confidence=clamp(F.lit(0.7) + F.when(F.size("g") >= 3, 0.05).otherwise(0.0) + bonus), primary=F.col("g")[0]["loc"], matches=F.transform(F.slice("g", F.lit(2), F.size("g")), lambda x: x["loc"]), similarity=F.lit(1.0), preview=preview)


# insights over issues that carry an ``id``


def insights(issues: DataFrame, links: Links, monorepo: bool) -> tuple[DataFrame, DataFrame]:
    """``(insights, consumed(id))``; insights don't exclude one another's inputs."""
    dead, wrappers, dups = (issues.where(F.col("kind") == k) for k in ("dead-code", "empty-wrapper", "duplicate"))
    found, consumed = [], []
    each = (lambda: _orphans(dead, links, monorepo), lambda: _wrapper_chains(dead, wrappers), lambda: _dead_duplicates(dead, dups), lambda: _over_abstraction(wrappers), lambda: _wrapper_files(wrappers, links))
    for ins, ids in side_by_side(*each):
        found.append(ins)
        if ids is not None:
            consumed.append(ids.select("id"))
    out, used = found[0], consumed[0]
    for f in found[1:]:
        out = out.unionByName(f)
    for c in consumed[1:]:
        used = used.union(c)
    return out, used.distinct()


def _orphans(dead: DataFrame, links: Links, monorepo: bool) -> tuple[DataFrame, DataFrame]:
    lost = settled(links.unreachable().join(links.files.select("rel", "file"), "rel").withColumn("folder", F.regexp_extract("rel", r"^(.*)/[^/]*$", 1)))
    ui = lost.where(F.col("folder").rlike(rules.SCAFFOLD_DIR))
    big = ui.groupBy("folder").agg(F.sort_array(F.collect_list("file")).alias("files")).where("size(files) >= 3")
    scaffold = finding(big, "scaffold-folder", confidence=F.lit(0.8), folder=F.col("folder"), files=F.col("files"), scaffold=F.lit("shadcn-ui"))
    single = lost.join(big, "folder", "left_anti").where(~F.col("rel").rlike(rules.ORPHAN_SKIP))
    if monorepo:
        single = single.limit(0)
    d = dead.select("id", F.col("location.file").alias("file"), F.struct("symbol", F.col("location.line").alias("line")).alias("s"), "confidence").join(single.select("file"), "file", "left_semi")
    per = d.groupBy("file").agg(F.min("confidence").alias("c"), F.sort_array(F.collect_list(F.struct(F.col("s.line").alias("l"), "s"))).alias("s"))
    rows = single.join(per, "file", "left")
    symbols = F.coalesce(F.transform("s", lambda x: x["s"]), F.array().cast(FINDING["deadSymbols"]))
    orphan = finding(rows, "orphaned-file", confidence=F.least(F.lit(0.9), F.coalesce("c", F.lit(0.9))), file=F.col("file"), deadSymbols=symbols)
    return orphan.unionByName(scaffold), d


def _wrapper_chains(dead: DataFrame, wrappers: DataFrame) -> tuple[DataFrame, DataFrame]:
    last = Window.partitionBy("location.file", "symbol").orderBy(F.desc("location.line"))
    d = dead.withColumn("_r", F.row_number().over(last)).where("_r = 1").select(F.col("location.file").alias("f"), F.col("symbol").alias("s"), F.col("confidence").alias("dc"), F.col("id").alias("did"))
    j = settled(wrappers.join(d, (F.col("location.file") == F.col("f")) & (F.col("outerName") == F.col("s"))))
    out = finding(j, "dead-wrapper-chain", confidence=F.least("confidence", "dc"), location=F.col("location"), outerName=F.col("outerName"), innerCall=F.col("innerCall"))
    return out, j.select("id").union(j.select(F.col("did")))


def _dead_duplicates(dead: DataFrame, dups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Duplicates whose every place lies in a dead declaration of its own: the latest one at most 200 lines above."""
    places = dups.select("id", "confidence", "similarity", "primary", "matches", F.posexplode(F.concat(F.array("primary"), "matches")).alias("p", "loc"))
    d = dead.select(F.col("location.file").alias("f"), F.col("location.line").alias("l"), F.col("symbol").alias("s"), F.col("confidence").alias("dc"), F.col("id").alias("did"))
    near = (F.col("loc.file") == F.col("f")) & (F.col("l") <= F.col("loc.line")) & (F.col("loc.line") - F.col("l") <= 200)
    hit = places.join(d, near, "left").groupBy("id", "p").agg(F.max(F.struct("l", "s", "dc", "did")).alias("d"), F.first("confidence").alias("confidence"), F.first("similarity").alias("similarity"), F.first("primary").alias("primary"), F.first("matches").alias("matches"))
    hit = hit.withColumn("d", F.when(F.col("d.did").isNotNull(), F.col("d")))
    groups = hit.groupBy("id").agg(F.count("*").alias("n"), F.count("d").alias("hits"), F.count_distinct("d.did").alias("different"), F.min("d.dc").alias("dc"), F.first("confidence").alias("confidence"), F.first("similarity").alias("similarity"), F.first("primary").alias("primary"), F.first("matches").alias("matches"), F.sort_array(F.collect_list(F.struct("p", "d.s", "d.did"))).alias("g"))
    whole = settled(groups.where("hits = n and different = n"))
    names = F.transform("g", lambda x: x["s"])
    out = finding(whole, "dead-duplicate-pair", confidence=F.least("confidence", "dc"), primary=F.col("primary"), matches=F.col("matches"), similarity=F.col("similarity"), primarySymbol=names[0], matchSymbols=F.slice(names, F.lit(2), F.size(names)))
    return out, whole.select("id").union(whole.select(F.explode(F.transform("g", lambda x: x["did"]))))


def _over_abstraction(wrappers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains of three wrappers of one file or more that end in a plain call; of two that overlap, the earlier in order."""
    w = settled(wrappers.select("id", "location", F.col("location.file").alias("f"), "outerName", "innerCall", F.regexp_extract("innerCall", r"^([A-Za-z_$][\w$]*)\(", 1).alias("callee")))
    by_name = w.groupBy("f", "outerName").agg(F.max_by("id", F.struct("location.line", "location.column")).alias("next"))
    succ = w.select(F.col("id").alias("node"), "f", "callee").join(by_name, (by_name["outerName"] == F.col("callee")) & (w["f"] == by_name["f"]), "left").select("node", "next")
    paths = settled(graph.chains(succ).where("size(path) >= 3"))
    order = w.select(F.col("id").alias("m"), F.struct("location.line", "location.column").alias("o"), "f")
    heads = paths.join(order, F.col("node") == F.col("m")).select("node", "path", "o")
    members = heads.select(F.col("node").alias("head"), F.col("o").alias("ho"), F.explode("path").alias("x"))
    kept = heads.join(members, (F.col("x") == F.col("node")) & (F.col("ho") < F.col("o")), "left_anti")
    link = w.select(F.col("id").alias("x"), F.struct("location", F.col("outerName").alias("name")).alias("link"), "innerCall", "callee")
    each = kept.select("node", F.posexplode("path").alias("p", "x")).join(link, "x")
    groups = each.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("p", "link"))).alias("g"), F.max(F.struct("p", "innerCall", "callee")).alias("last"))
    groups = settled(groups.where("last.callee <> ''"))
    score = F.least(F.lit(0.95), F.lit(0.85) + F.lit(0.03) * (F.size("g") - 3))
    out = finding(groups, "over-abstraction-chain", confidence=score, chain=F.transform("g", lambda x: x["link"]), terminalCall=F.col("last.innerCall"))
    return out, kept.join(groups, "node", "left_semi").select(F.explode("path").alias("id"))


def _wrapper_files(wrappers: DataFrame, links: Links) -> tuple[DataFrame, DataFrame]:
    listed = relation_of(links, "exports").groupBy("file").agg(F.count("*").alias("e"))
    own = relation_of(links, "decls").where("exported").groupBy("file").agg(F.count("*").alias("d"))
    named = relation_of(links, "exports").where("form = 'named' and spec is null").groupBy("file").agg(F.count("*").alias("twice"))
    total = listed.join(own, "file", "full").join(named, "file", "left").select("file", (F.coalesce("e", F.lit(0)) + F.coalesce("d", F.lit(0)) - F.coalesce("twice", F.lit(0))).alias("total"))
    per = wrappers.groupBy(F.col("location.file").alias("file")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    hit = settled(per.join(total, "file").where("n >= 2 and total > 0 and n <= total and n / total >= 0.5"))
    out = finding(hit, "wrapper-only-file", confidence=F.col("c"), file=F.col("file"), wrapperCount=F.col("n"), totalExports=F.col("total"))
    return out, wrappers.join(hit.select(F.col("file").alias("_f")), F.col("location.file") == F.col("_f"), "left_semi").select("id")
