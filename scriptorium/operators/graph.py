"""A property graph as node and edge tables: idempotent upserts, resolution, paths and checks.

An upsert is a full outer join of what is stored with a de-duplicated batch; the
result replaces the table.  Applying the same batch twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.plans.scratch import stored


def upsert_best(old: DataFrame, new: DataFrame, keys: Sequence[str], score: str, payload: Sequence[str]) -> DataFrame:
    """One row per key with the greatest score and the payload that came with it; the stored row wins ties."""
    both = old.select(*keys, score, *payload).withColumn("_new", F.lit(0)).unionByName(new.select(*keys, score, *payload).withColumn("_new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max(F.struct(F.col(score), (-F.col("_new")).alias("first"), *payload)).alias("b"))
    return best.select(*keys, F.col(f"b.{score}").alias(score), *[F.col(f"b.{c}").alias(c) for c in payload])


def upsert_fill(old: DataFrame, new: DataFrame, keys: Sequence[str], overwrite: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Full outer join on the keys: ``overwrite`` columns take the new value if there is one, ``keep`` columns only if the old is null or ''."""
    joined = old.alias("o").join(new.alias("n"), list(keys), "full_outer")
    blank = {c: F.col(f"o.{c}").isNull() | (F.col(f"o.{c}").cast("string") == "") for c in keep}
    return joined.select(
        *keys,
        *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in overwrite],
        *[F.when(blank[c], F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))).otherwise(F.col(f"o.{c}")).alias(c) for c in keep],
    )


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def resolve(refs: DataFrame, papers: DataFrame) -> DataFrame:
    """(ref_id, target, confidence): by document id (1.0), doi (1.0), title and year with null as 0 (0.8), else a stub (0.6).

    refs: ref_id, doc_id, doi, title, year; papers: id, doi, title, year.  The
    paper side is de-duplicated to its least id per key, so a match is one row.
    """
    by_doi = papers.where("doi is not null").groupBy("doi").agg(F.min("id").alias("doi_hit"))
    by_title = papers.groupBy("title", F.coalesce("year", F.lit(0)).alias("y")).agg(F.min("id").alias("title_hit"))
    found = (
        refs.withColumn("y", F.coalesce("year", F.lit(0)))
        .join(papers.select(F.col("id").alias("doc_id"), F.col("id").alias("id_hit")), "doc_id", "left")
        .join(by_doi, "doi", "left")
        .join(by_title, ["title", "y"], "left")
    )
    stub = F.concat(F.lit("stub:"), F.md5(F.concat_ws("|", F.coalesce("title", F.lit("")), F.col("y").cast("string"))))
    hit = F.coalesce("id_hit", "doi_hit", "title_hit").cast("string")
    confidence = F.when(F.coalesce("id_hit", "doi_hit").isNotNull(), 1.0).when(F.col("title_hit").isNotNull(), 0.8).otherwise(0.6)
    return found.select("ref_id", F.coalesce(hit, stub).alias("target"), confidence.alias("confidence"))


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, hop): every node a directed walk of 1..depth edges reaches, at each hop once."""
    step = starts.select("start", F.col("start").alias("node"))
    out = None
    for hop in range(1, depth + 1):
        step = step.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("start", F.col("dst").alias("node")).distinct()
        here = step.withColumn("hop", F.lit(hop))
        out = here if out is None else out.unionByName(here)
    return out


def reject_cycles(stored_edges: DataFrame, new: DataFrame, depth: int = 3) -> DataFrame:
    """The new edges whose target does not already reach their source within ``depth`` hops; self-edges go too."""
    new = new.where("src <> dst")
    back = reach(stored_edges, new.select(F.col("dst").alias("start")).distinct(), depth).select(F.col("start").alias("dst"), F.col("node").alias("src")).distinct()
    return new.join(back, ["src", "dst"], "left_anti")


def hierarchy_scores(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(start, node, score): 1 / (hop + 1) for each hop up and down at which a node is met."""
    up = reach(edges, starts, depth)
    down = reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts, depth)
    return up.unionByName(down).groupBy("start", "node").agg(F.sum(1 / (F.col("hop") + 1)).alias("score"))


#: Papers of a target that travel in one row, and sources whose pairs one task adds up.
POSTINGS, SOURCES = 1_000, 400


def source_parts(sources: DataFrame) -> int:
    """How many partitions the pairs of so many sources take: a task's share does not grow with the input."""
    return max(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sources.count() // SOURCES))


def postings(edges: DataFrame, *columns: str) -> DataFrame:
    """(target, papers, one array for each of ``columns``): the papers of a target in order, at most POSTINGS a row."""
    place = F.row_number().over(Window.partitionBy("target").orderBy("paper")) - 1
    rows = edges.withColumn("_block", F.floor(place / POSTINGS)).groupBy("target", "_block").agg(F.collect_list(F.struct("paper", *columns)).alias("rows"))
    return rows.select("target", F.col("rows.paper").alias("papers"), *[F.col(f"rows.{c}").alias(c) for c in columns])


def met_by_source(mine: DataFrame, blocks: DataFrame, parts: int) -> DataFrame:
    """(src, other, columns of both): each row of mine (src, target, ...) with each other paper of its target's ``blocks`` (:func:`postings`).

    The arrays are dealt by the source before they are opened, so a pair is not
    shuffled as a row of its own, here or when a source's pairs are grouped.
    """
    own, theirs = [c for c in mine.columns if c not in ("src", "target")], [c for c in blocks.columns if c not in ("target", "papers")]
    dealt = mine.join(blocks, "target").select("src", *own, "papers", *theirs).repartition(parts, "src")
    opened = dealt.select("src", *own, F.inline(F.arrays_zip("papers", *theirs)))
    return opened.select("src", F.col("papers").alias("other"), *own, *theirs).where("src <> other")


def hierarchy_signal(uses: DataFrame, edges: DataFrame, sources: DataFrame, depth: int = 2, *, others: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(src, other, raw): papers on concepts that ``edges`` (src, dst) lead to from a source's concepts, or from which they are led to.

    uses: paper, target.  A hop counts 1 / (hop + 1), once for each other paper and direction; only papers of ``others`` (other), if given.
    """
    mine = uses.join(sources.select(F.col("src").alias("paper")), "paper", "left_semi").select(F.col("paper").alias("src"), F.col("target").alias("start"))
    starts = stored(mine.select("start").distinct(), "hierarchy_starts")
    led = None
    for way, rows in enumerate((edges, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))):
        bit = F.expr(f"shiftleft(1L, cast(hop AS int) - 1 + {way * depth})")
        found = mine.join(reach(rows, starts, depth), "start").select("src", F.col("node").alias("target"), bit.alias("met"))
        led = found if led is None else led.unionByName(found)
    led = led.groupBy("src", "target").agg(F.bit_or("met").alias("met"))
    kept = uses if others is None else uses.join(others.select(F.col("other").alias("paper")), "paper", "left_semi")
    pairs = met_by_source(led, postings(kept.select("paper", "target")), parts or source_parts(sources))
    hops = [F.when(F.col("met").bitwiseAND(1 << (way * depth + hop - 1)) != 0, 1 / (hop + 1)).otherwise(0.0) for way in (0, 1) for hop in range(1, depth + 1)]
    return pairs.groupBy("src", "other").agg(F.bit_or("met").alias("met")).select("src", "other", reduce(lambda x, y: x + y, hops).alias("raw"))


def evidence_weight(kind: Column) -> Column:
    return F.when(kind == "benchmark", 1.3).when(kind.isin("dataset", "corpus"), 1.0).when(kind.isin("survey", "census"), 0.8).otherwise(0.7)


# Section of a graph fact -> what its score gains; the first prefix that fits.
SECTION_BOOST = {
    "method": 0.15, "methodology": 0.15, "approach": 0.12, "experiment": 0.10, "evaluation": 0.10, "result": 0.08, "discussion": 0.07, "abstract": 0.05, "conclusion": 0.05,
    "introduction": 0.02, "background": 0.02,
}


def section_boost(section: Column) -> Column:
    low = F.trim(F.lower(F.coalesce(section, F.lit(""))))
    out = F.lit(0.0)
    for prefix in reversed(SECTION_BOOST):
        out = F.when(low.startswith(prefix), SECTION_BOOST[prefix]).otherwise(out)
    return out


def chunk_score(base: Column, name: Column, keywords: Column, section: Column, aliases: Column | None = None) -> Column:
    """A graph fact's score: its own, 0.05 for each keyword in its name or aliases (0.20 at most), and its section's; at most 1."""
    text = F.lower(name) if aliases is None else F.concat_ws(" ", F.lower(name), F.transform(aliases, F.lower))
    found = F.size(F.filter(keywords, lambda w: F.contains(text, F.lower(w))))
    return F.least(F.lit(1.0), base + F.least(F.lit(0.2), 0.05 * found) + section_boost(section))


def merge_nodes(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Nodes by ``key``: what is stored stays as it is, a new key gets the batch's first row by ``order``."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").select(*old.columns)
    return insert_absent(old, first, [key])


def merge_edges(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges by ``keys``: a batch overwrites the properties of the edges that it has (one row a key)."""
    return new.select(*old.columns).unionByName(old.join(new.select(*keys), list(keys), "left_anti"))


def neighbourhood(edges: DataFrame, node: Column, limit: int = 200) -> DataFrame:
    """(src, dst, kind) around one node, in a total order, at most ``limit``."""
    return edges.where((F.col("src") == node) | (F.col("dst") == node)).dropDuplicates(["src", "dst", "kind"]).orderBy("kind", "src", "dst").limit(limit)


#: Candidates of a group that one task folds at most; more are first thinned by rounds of joins.
FOLD_MOST = 10_000


def accept_in_order(candidates: DataFrame) -> DataFrame:
    """Parent edges accepted by confidence (then names) so that no cycle arises, per ``group``.

    candidates: group, src, dst, confidence.  A group's candidates are those of
    one paper, a handful; they are folded in one task each.  Only edges inside a
    cycle of the group's graph depend on the order: a group over FOLD_MOST first
    sets aside, by rounds of joins, the edges whose end no edge leaves or whose
    start no edge reaches, until what is left can be folded or no edge goes.
    """
    import pandas as pd

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["confidence", "src", "dst"], ascending=[False, True, True])
        after: dict = {}
        keep = []
        for row in frame.itertuples(index=False):
            todo, seen = [row.dst], set()
            while todo:
                at = todo.pop()
                if at == row.src:
                    break
                if at not in seen:
                    seen.add(at)
                    todo += after.get(at, [])
            else:
                after.setdefault(row.src, []).append(row.dst)
                keep.append(True)
                continue
            keep.append(False)
        return frame[keep]

    free = None
    left = candidates
    while True:
        sizes = stored(left.groupBy("group").count().where(F.col("count") > FOLD_MOST), "large_groups")
        if sizes.isEmpty():
            break
        large = left.join(sizes.select("group"), "group", "left_semi")
        inner = large.join(large.select("group", F.col("src").alias("dst")).distinct(), ["group", "dst"], "left_semi").join(large.select("group", F.col("dst").alias("src")).distinct(), ["group", "src"], "left_semi")
        inner = stored(inner.select(*candidates.columns), "inner_edges")
        gone = large.count() - inner.count()
        if not gone:
            raise ValueError("a group has more candidates in cycles than one task may fold")
        outer = stored(large.join(inner.select("group", "src", "dst").distinct(), ["group", "src", "dst"], "left_anti").select(*candidates.columns), "free_edges")
        free = outer if free is None else free.unionByName(outer)
        left = left.join(sizes.select("group"), "group", "left_anti").select(*candidates.columns).unionByName(inner)
    folded = left.groupBy("group").applyInPandas(fold, candidates.schema)
    return folded if free is None else folded.unionByName(free)


def degree_health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges, isolated_share, avg_degree, healthy): fewer than 30 % isolated and more than one edge each on average."""
    degree = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("d"))
    d = F.coalesce("d", F.lit(0))
    row = nodes.join(degree, "id", "left").agg(F.count("*").alias("nodes"), F.sum(d).alias("ends"), F.avg((d == 0).cast("int")).alias("isolated_share"), F.avg(d).alias("avg_degree"))
    return row.select("nodes", (F.col("ends") / 2).cast("long").alias("edges"), F.round("isolated_share", 6).alias("isolated_share"), F.round("avg_degree", 6).alias("avg_degree"), ((F.col("isolated_share") < 0.3) & (F.col("avg_degree") > 1)).alias("healthy"))


def paper_edges(docs: DataFrame, citations: DataFrame) -> DataFrame:
    """(rel, src, dst) of papers (paper, author, place, venue, topics array) and their citations (src, dst named): one row per relation."""
    def edge(rows: DataFrame, rel: str, src: Column, dst: Column) -> DataFrame:
        return rows.select(F.lit(rel).alias("rel"), src.alias("src"), dst.alias("dst"))

    def named(mark: str, c: str) -> Column:
        return F.concat(F.lit(mark), F.col(c).cast("string"))

    parts = [
        edge(docs.where("author is not null").select("author", "paper").distinct(), "WROTE", named("a", "author"), named("p", "paper")),
        edge(docs.where("author is not null and place is not null").select("author", "place").distinct(), "AFFILIATED_WITH", named("a", "author"), named("i", "place")),
        edge(docs.where("venue is not null").select("paper", "venue").distinct(), "PUBLISHED_AT", named("p", "paper"), named("v", "venue")),
        edge(docs.select("paper", F.explode("topics").alias("topic")).distinct(), "HAS_TOPIC", named("p", "paper"), named("t", "topic")),
        edge(citations.distinct(), "CITES", named("p", "src"), F.col("dst").cast("string")),
    ]
    return reduce(DataFrame.unionByName, parts)


# Kinds of nodes and edges of a built graph.
NODE_KINDS = ("Paper", "Author", "Institution", "Venue", "Topic", "Concept", "Evidence", "Metric", "Finding", "Chunk")
EDGE_KINDS = ("WROTE", "AFFILIATED_WITH", "PUBLISHED_AT", "HAS_TOPIC", "CITES", "USES_CONCEPT", "EVALUATES_ON", "ACHIEVES_METRIC", "HAS_FINDING", "BASED_ON", "EXTENDS", "SUPPORTS", "CONTRADICTS", "SIMILAR_TO", "HAS_CHUNK")


#: Nodes whose edges one task counts.
NODES = 200_000


def assertions(nodes: DataFrame, edges: DataFrame, concepts: DataFrame, findings: DataFrame, docs: DataFrame, calls: DataFrame) -> DataFrame:
    """(assertion, value, passed): fifteen checks of a graph (nodes id, kind, stub; edges src, dst, kind), its documents and model calls (phase, success)."""
    # nodes and the ends of edges meet in one sum for each id, dealt by it into as many partitions as the nodes ask for: no edge is sorted;
    # what a row says are the bits of one number
    whole = F.when(F.col("src").isNotNull() & F.col("dst").isNotNull(), 4).otherwise(0)
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), (whole + 1).alias("bits")), F.struct(F.col("dst").alias("id"), (whole + 2).alias("bits")))).alias("e")).select("e.*").where("id is not null")
    other_kind, full_paper = F.when(~F.col("kind").isin(*NODE_KINDS), 16).otherwise(0), F.when((F.col("kind") == "Paper") & ~F.col("stub"), 32).otherwise(0)
    rows = nodes.select("id", (other_kind + full_paper + 8).alias("bits")).unionByName(ends)
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // NODES))
    says = lambda mask: F.count_if(F.col("bits").bitwiseAND(mask) == mask)
    per_id = rows.repartition(parts, "id").groupBy("id").agg(
        says(8).alias("n"), (says(1) + says(2)).alias("d"), says(1).alias("from"), says(5).alias("whole_from"), says(6).alias("whole_to"), says(16).alias("other_kinds"), says(32).alias("full_papers"),
    )
    per_id = stored(per_id, "graph_ids")
    n, lost = F.sum("n"), F.col("n") == 0
    per_node = per_id.agg(
        F.coalesce(n, F.lit(0)).cast("double").alias("nodes"), (F.sum(F.when(F.col("d") == 0, F.col("n")).otherwise(0)) / n).alias("isolated"), (F.sum(F.col("n") * F.col("d")) / n).alias("degree"),
        F.coalesce(F.sum("other_kinds"), F.lit(0)).cast("double").alias("node_types"), F.coalesce(F.sum(F.when(F.col("from") == 0, F.col("full_papers")).otherwise(0)), F.lit(0)).cast("double").alias("papers_without_edges"),
        F.coalesce(F.sum(F.when(lost, F.col("whole_from") + F.col("whole_to"))), F.lit(0)).alias("lost_ends"),
    )
    # an edge with two unknown ends was counted twice
    unknown = per_id.where(lost & (F.col("whole_from") + F.col("whole_to") > 0)).select("id")
    twice = edges.join(unknown.withColumnRenamed("id", "src"), "src", "left_semi").join(unknown.withColumnRenamed("id", "dst"), "dst", "left_semi").agg(F.count("*").alias("twice"))
    of = lambda kind: F.count_if(F.col("kind") == kind).cast("double")
    per_edge = edges.agg(F.count("*").cast("double").alias("edges"), F.count_if(F.col("src").isNotNull() & F.col("dst").isNotNull()).alias("whole"), F.count_if(~F.col("kind").isin(*EDGE_KINDS)).cast("double").alias("edge_types"), of("USES_CONCEPT").alias("uses_concept"), of("CITES").alias("cites"))
    conflicts = nodes.groupBy("id").agg(F.count_distinct("kind").alias("k")).agg(F.count_if(F.col("k") > 1).cast("double").alias("type_conflicts"))
    ok = F.col("success").cast("int")
    per_call = calls.agg((1 - F.avg(ok)).alias("error_rate"), F.avg(F.when(F.col("phase") == "extract", ok)).alias("parse_rate"))
    sizes = docs.agg(F.count("*").alias("docs"))
    row = reduce(lambda x, y: x.join(F.broadcast(y)), [twice, per_edge, conflicts, per_call, sizes, concepts.agg(F.count("*").alias("c")), findings.agg(F.count("*").alias("f"))], per_node)  # single rows
    row = row.withColumns({"consistency": (F.col("whole") - F.col("lost_ends") + F.col("twice")) / F.col("edges"), "concepts_per_doc": F.col("c") / F.col("docs"), "findings_per_doc": F.col("f") / F.col("docs")})
    limits = {
        "nodes": F.col("nodes") > 0, "edges": F.col("edges") > 0, "isolated": F.col("isolated") < 0.3, "consistency": F.col("consistency") >= 0.99, "degree": F.col("degree") > 1, "type_conflicts": F.col("type_conflicts") == 0,
        "papers_without_edges": F.col("papers_without_edges") == 0, "edge_types": F.col("edge_types") == 0, "node_types": F.col("node_types") == 0, "error_rate": F.col("error_rate") < 0.2,
        "concepts_per_doc": F.col("concepts_per_doc") >= 1, "findings_per_doc": F.col("findings_per_doc") >= 1, "uses_concept": F.col("uses_concept") > 0, "cites": F.col("cites") > 0, "parse_rate": F.coalesce(F.col("parse_rate"), F.lit(1.0)) >= 0.8,
    }
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("assertion"), F.round(F.col(n), 6).alias("value"), ok_.alias("passed")) for n, ok_ in limits.items()]))
    return row.select(one.alias("r")).select("r.*")


def co_occurrence(edges: DataFrame, sources: DataFrame, weight: Column, *, others: DataFrame | None = None, shared: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """(src, other, raw): papers that share a target with a source paper; edges (paper, target, ...), ``weight`` per shared edge pair.

    The source side's columns are prefixed ``a_``; columns that follow from the
    target (``shared``) are there only.  The shuffle is on the target and only
    sources' targets take part, and only papers of ``others`` (other), if given.
    """
    mine = edges.join(sources.select(F.col("src").alias("paper")), "paper", "left_semi")
    mine = mine.select(F.col("paper").alias("src"), "target", *[F.col(c).alias(f"a_{c}") for c in edges.columns if c not in ("paper", "target")])
    kept = edges.drop(*shared)
    if others is not None:
        kept = kept.join(others.select(F.col("other").alias("paper")), "paper", "left_semi")
    blocks = postings(kept, *[c for c in kept.columns if c not in ("paper", "target")])
    pairs = met_by_source(mine, blocks, parts or source_parts(sources))
    return pairs.groupBy("src", "other").agg(F.sum(weight).alias("raw"))


def recommend(signals: DataFrame, weights: dict[str, float], k: int = 20, least: float = 0.05) -> DataFrame:
    """(src, other, score, rank) from (src, other, signal, raw): each signal divided by its source's maximum, weighted, summed.

    Rows that are dealt by the source already are not dealt again.
    """
    wide = signals.groupBy("src", "other").agg(*[F.sum(F.when(F.col("signal") == n, F.col("raw"))).alias(f"_{i}") for i, n in enumerate(weights)])
    parts = []
    for i, w in enumerate(weights.values()):
        top = F.max(f"_{i}").over(Window.partitionBy("src"))
        parts.append(F.when(top > 0, F.coalesce(F.col(f"_{i}"), F.lit(0.0)) / top).otherwise(0.0) * w)
    score = F.round(reduce(lambda x, y: x + y, parts) / sum(weights.values()), 6)
    scores = wide.select("src", "other", score.alias("score")).where((F.col("score") >= least) & (F.col("src") != F.col("other")))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "other"))).where(F.col("rank") <= k)


def resolve_entities(names: DataFrame) -> DataFrame:
    """(id, canonical): names with the same key, and those linked through aliases, get their least id.

    names: id, name, aliases array<string>; links run over the keys, so the
    closure is a connected-components problem.
    """
    from scriptorium.plans.components import connected_components

    keyed = names.select("id", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).select("id", F.transform(F.array("n"), lambda n: F.lower(F.regexp_replace(n, r"[-_\s]", "")))[0].alias("k")).where("k <> ''").distinct()
    least = keyed.groupBy("k").agg(F.min("id").alias("least"))
    links = stored(keyed.join(least, "k").where("id <> least").select("id", "least").distinct(), "entity_links")
    found = connected_components(links, "id", "least")
    return names.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("canonical"))
