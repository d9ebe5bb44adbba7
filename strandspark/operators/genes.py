"""Genes, orthologs, domain rates, feature tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import STRETCH, carried_scan, checkpoint


def ortholog_pairs(genes_a: DataFrame, orth: DataFrame, genes_b: DataFrame, first_only: bool = False) -> DataFrame:
    """a_key, b_key, name: genes of two species by ortholog keys (key1, key2); first_only: one partner each, the least key."""
    b = genes_b.select(F.col("key").alias("b_key"), "name")
    if first_only:
        # partners are few beside the pairs, so the least one is found before the other species is joined
        partner = orth.join(b, F.col("b_key") == F.col("key2")).groupBy("key1").agg(F.min(F.struct("b_key", "name")).alias("p"))
        found = genes_a.select(F.col("key").alias("a_key")).distinct().join(partner, F.col("a_key") == F.col("key1"))
        return found.select("a_key", "p.b_key", "p.name")
    pairs = genes_a.select(F.col("key").alias("a_key")).join(orth, F.col("a_key") == F.col("key1")).join(b, F.col("b_key") == F.col("key2"))
    return pairs.select("a_key", "b_key", "name")


#: Parts that an orthogroup's genes are dealt to, and the most genes of a part that travel as one row; a fourth for the second species, since all pairs of two packs are made at once.
PARTS, PACK = 32, 128


def orthogroup_pairs(genes_a: DataFrame, genes_b: DataFrame, group: str, first_only: bool = False) -> DataFrame:
    """As ortholog_pairs, where orthologs are the genes of one group (a column of both sides; null: none), so that no table of all pairs goes through a shuffle.

    A group's genes of the first species are dealt to PARTS tasks, those of the second are copied to each, both packed; first_only looks up one row a group. Pairs
    come in runs of one b_key, over the same few a_key again and again, which columnar files hold in a fraction of the bytes. The number of
    partitions is set, since few rows make many pairs.
    """
    a = genes_a.where(F.col(group).isNotNull()).select(F.col("key").alias("a_key"), F.col(group).alias("_g")).where("a_key is not null")
    b = genes_b.where(F.col(group).isNotNull()).select(F.col("key").alias("b_key"), "name", F.col(group).alias("_g")).where("b_key is not null")
    if first_only:
        least = b.groupBy("_g").agg(F.min(F.struct("b_key", "name")).alias("p"))
        found = a.join(least, "_g").groupBy("a_key").agg(F.min("p").alias("p"))
        return found.select("a_key", "p.b_key", "p.name")
    session = a.sparkSession
    n = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    part = lambda key: F.pmod(F.xxhash64(key), F.lit(PARTS))
    x = _packed(a.withColumn("_part", part("a_key")).repartition(n, "_g", "_part"), ["a_key"], "_a", PACK)
    y = _packed(b.withColumn("_part", part("b_key")), ["b_key", "name"], "_b", max(1, PACK // 4)).drop("_part")
    y = y.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    # the filter isn't compiled into the join's loop, so the join hands on one pair of packs after the other and keeps no pairs of genes
    packs = x.join(y.hint("merge"), ["_g", "_part"]).select("_a", F.filter("_b", lambda r: r["b_key"].isNotNull()).alias("_b"))
    return packs.select("_a", F.inline("_b")).select(F.inline("_a"), "b_key", "name")


def _packed(genes: DataFrame, columns: list[str], name: str, size: int) -> DataFrame:
    """_g, _part, name: up to size genes of a part as an array of structs of columns, by the first one."""
    rank = F.row_number().over(Window.partitionBy("_g", "_part").orderBy(columns[0]))
    blocks = genes.withColumn("_block", F.floor((rank - 1) / size)).groupBy("_g", "_part", "_block")
    return blocks.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name)).drop("_block")


def ortholog_table(claims: DataFrame, genes: DataFrame) -> DataFrame:
    """key1, key2: claims (key1, fbid, chr, s, e) matched to genes (key, fbid, chr, s, e) by id, else by the same place; unmatched ones go."""
    by_id = genes.select(F.col("fbid").alias("_id"), F.col("key").alias("_by_id"))
    by_place = genes.select(F.col("chr").alias("_c"), F.col("s").alias("_s"), F.col("e").alias("_e"), F.col("key").alias("_by_place"))
    out = claims.join(by_id, claims.fbid == F.col("_id"), "left").join(
        by_place, (claims.chr == F.col("_c")) & (claims.s == F.col("_s")) & (claims.e == F.col("_e")), "left"
    )
    return out.select("key1", F.coalesce("_by_id", "_by_place").alias("key2")).where("key2 is not null").distinct()


def paired_peaks(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_pid, b_pid, gene, kind: peaks of two species with a gene in common; rows are (pid, side, gene), side us or ds.

    Of the four ways (us-us, us-ds, ds-us, ds-ds) the first that holds counts, one gene each.
    """
    pairs = a.select(F.col("pid").alias("a_pid"), F.col("side").alias("_sa"), "gene").join(
        b.select(F.col("pid").alias("b_pid"), F.col("side").alias("_sb"), "gene"), "gene"
    )
    order = F.when(F.col("_sa") == "us", 0).otherwise(2) + F.when(F.col("_sb") == "us", 0).otherwise(1)
    best = pairs.groupBy("a_pid", "b_pid").agg(F.min(F.struct(order.alias("o"), "gene", F.concat_ws("-", "_sa", "_sb").alias("kind"))).alias("p"))
    return best.select("a_pid", "b_pid", "p.gene", "p.kind")


def _followed(labels: DataFrame) -> DataFrame:
    """labels (node, to), where to is less than node, followed until they lead to nodes without a label."""
    while True:
        onward = labels.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
        longer = checkpoint(labels.join(onward, F.col("to") == F.col("_n"), "left").select("node", F.coalesce("_t", "to").alias("to"), F.col("_t").isNotNull().alias("_more")))
        labels = longer.select("node", "to")
        if not longer.where("_more").take(1):
            return labels


def _relabelled(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """rows with the labels of a column's nodes in place of those that have one."""
    onward = labels.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
    return rows.join(onward, F.col(column) == F.col("_n"), "left").withColumn(column, F.coalesce("_t", column)).drop("_n", "_t")


def gene_clusters(pairs: DataFrame) -> DataFrame:
    """pid, cluster: peaks connected through shared genes, named by the least pid; pairs are (pid, gene). Rows without a pid take no part, a peak without genes is its own cluster.

    A gene is named by its least peak, a peak by the least name of its genes, to which its genes' other names are linked. Linked names then take on the least that they lead to, until no
    link is left: pairs are shuffled once by gene and once by peak, and only links between different names go on. Within two rounds, names still linked halve at least.
    """
    pairs = pairs.where("pid is not null").select("pid", "gene")
    names = pairs.groupBy("gene").agg(F.min("pid").alias("a")).where("gene is not null")
    named = pairs.join(names, "gene", "left").select("pid", F.coalesce("a", "pid").alias("a"))
    named = checkpoint(named.withColumn("b", F.min("a").over(Window.partitionBy("pid"))))
    # each peak has a row whose name is its least one
    members = named.where("a = b").select("pid", F.col("b").alias("cluster")).distinct()
    links = named.where("a != b").select("a", "b")
    found = None  # where each name leads to
    while links.take(1):
        labels = _followed(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")))
        found = labels if found is None else checkpoint(_relabelled(found, "to", labels).unionByName(labels))
        both = _relabelled(_relabelled(links, "a", labels), "b", labels).where("a != b")
        links = checkpoint(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return members if found is None else _relabelled(members, "cluster", found).select("pid", "cluster")


def cluster_counts(a: DataFrame, b: DataFrame, key: str = "gene") -> DataFrame:
    """One row: keys of both, of a only, of b only."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full").agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"),
        F.count_if(F.col("_b").isNull()).alias("only_a"),
        F.count_if(F.col("_a").isNull()).alias("only_b"),
    )


def family_medians(rates: DataFrame, by: list[str], least: float | None = 0.0) -> DataFrame:
    """by, n, median: exact medians; least: only medians of that or more, NaN not."""
    out = rates.groupBy(*by).agg(F.count("*").alias("n"), F.median("rate").alias("median"))
    return out if least is None else out.where((F.col("median") >= least) & ~F.isnan("median"))


def median_matrix(rates: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """row, a median column for each value (-1 without rates), total; rows by total are up to the caller."""
    out = rates.groupBy(row).pivot(column, values).agg(F.median("rate"))
    names = [c for c in out.columns if c != row]
    out = out.select(row, *[F.coalesce(F.col(f"`{c}`"), F.lit(-1.0)).alias(c) for c in names])
    total = F.col(f"`{names[0]}`")
    for c in names[1:]:
        total = total + F.col(f"`{c}`")
    return out.withColumn("total", total)


def rate_histogram(rates: DataFrame, low: float, high: float, bins: int, value: str = "rate") -> DataFrame:
    """bin from 1, n: equal widths, the last bin closed; values outside are left out."""
    at = F.least(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins).cast("long"))
    return rates.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def mean_ratio(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mean of |a / b| over rows with b other than 0."""
    return rows.where(F.col(b) != 0).agg(F.avg(F.abs(F.col(a) / F.col(b))).alias("mean"))


def latex_rows(matrix: DataFrame, row: str, names: list[str], digits: int = 2) -> DataFrame:
    """text: the row's name and its values with so many decimals, by '&', then a backslash."""
    values = [F.format_string(f"%.{digits}f", F.col(f"`{n}`")) for n in names]
    return matrix.select(F.concat(F.concat_ws("&", F.col(row).cast("string"), *values), F.lit("\\")).alias("text"))


def features_of_type(features: DataFrame, kind: str) -> DataFrame:
    return features.where(F.col("type") == kind)


def features_in(features: DataFrame, start: int, end: int) -> DataFrame:
    """Features wholly inside."""
    return features.where((F.col("start") >= start) & (F.col("end") <= end))


def features_above(features: DataFrame, score: float, tag: str = "score") -> DataFrame:
    return features.where(F.element_at("tags", tag).cast("double") >= score)


def best_feature(features: DataFrame, by: list[str], tag: str) -> DataFrame:
    """The feature of the greatest tag in each group, of equal ones the first by start."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.element_at("tags", tag).cast("double").desc_nulls_last(), "start", "end"))
    return features.withColumn("_r", rank).where("_r = 1").drop("_r")


def with_tag(features: DataFrame, name: str, value: Column) -> DataFrame:
    """features with a tag set; an older value of that name is replaced."""
    kept = F.map_filter("tags", lambda k, _: k != name)
    return features.withColumn("tags", F.map_concat(kept, F.create_map(F.lit(name), value.cast("string"))))


def checked_parent(features: DataFrame, seq: Column, length: int) -> DataFrame:
    """features with seq; fails where its length differs."""
    return features.withColumn("seq", F.when(F.assert_true(F.length(seq) == length, "the parent sequence has another length").isNull(), seq))


def feature_text() -> Column:
    """type|start:|end:|tags:(k:v),... of a feature's columns, tags in the order of their names."""
    entries = F.array_sort(F.map_entries("tags"))
    tags = F.array_join(F.transform(entries, lambda x: F.concat(F.lit("("), x["key"], F.lit(":"), x["value"], F.lit(")"))), ",")
    return F.concat(F.col("type"), F.lit("|start:"), F.col("start").cast("string"), F.lit("|end:"), F.col("end").cast("string"), F.lit("|tags:"), tags)


def gene_lanes(genes: DataFrame, step: float = 0.11, stretch: int = STRETCH) -> DataFrame:
    """gid, lane: a gene's lane lies step above that of the last gene placed before it that overlaps it, ends included; a scan that carries the genes still open."""
    import pandas as pd

    def fold(rows: pd.DataFrame, state: list | None, last: bool) -> tuple[pd.DataFrame, list]:
        chrom, placed = state or [None, []]
        out = []
        for c, s, e, gid in zip(*(rows[x].tolist() for x in ("chr", "s", "e", "gid")), strict=True):
            # starts only rise: the others reach no later gene
            placed = [p for p in placed if p[0] >= s] if c == chrom else []
            chrom = c
            placed.append([e, placed[-1][1] + step if placed else 0.0])
            out.append((gid, placed[-1][1]))
        return pd.DataFrame(out, columns=["gid", "lane"]), [chrom, placed]

    rows = genes.select("chr", "s", "e", "gid").where("chr is not null and gid is not null and s is not null and e is not null")
    return carried_scan(rows, ["chr", "s", "e", "gid"], fold, f"gid {dict(genes.dtypes)['gid']}, lane double", stretch)


def species_subsets(spark, species: list[str]) -> DataFrame:
    """subset: sorted names of each subset of one species or more, comma-joined. Up to 20 species."""
    if len(species) > 20:
        raise ValueError("over 20 species have over a million subsets")
    names = F.array(*[F.lit(s) for s in sorted(species)])
    picked = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(len(species) - 1)), lambda i: F.call_function("getbit", F.col("id"), i) == 1),
        lambda i: F.get(names, i),
    )
    return spark.range(1, 1 << len(species)).select(F.array_join(picked, ",").alias("subset"))


def pruned_trees(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """subset, node, parent, length: the tree (node, parent, length; the root has no parent) cut to each subset's leaves, without inner nodes of one child.

    leaves: subset, node. Where a node of one child goes, its length is added to the child's, so that lengths from the root to the leaves stay; the topmost node that is left is the root and
    keeps what lies above it. Both the marking of ancestors and the passing over of nodes are pointer doubling: as many rounds as the logarithm of the depth.
    """
    tree = checkpoint(nodes.select("node", "parent", F.coalesce("length", F.lit(0.0)).alias("length")).distinct())
    marked = checkpoint(leaves.select("subset", "node").distinct().join(tree.select("node"), "node", "left_semi").select("subset", "node"))
    # marked rises by leaps of 1, 2, 4, ... ancestors
    leap = tree.where("parent is not null").select("node", F.col("parent").alias("to"))
    while leap.take(1):
        up = marked.join(leap, "node").select("subset", F.col("to").alias("node"))
        marked = checkpoint(marked.unionByName(up).distinct())
        leap = checkpoint(leap.join(leap.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")))
    edges = marked.join(tree, "node")
    children = edges.where("parent is not null").groupBy("subset", F.col("parent").alias("node")).agg(F.count("*").alias("n"))
    asked = leaves.select("subset", "node").distinct().withColumn("leaf", F.lit(True))
    known = edges.join(children, ["subset", "node"], "left").join(asked, ["subset", "node"], "left")
    # kept: asked for, or where branches meet
    state = checkpoint(
        known.select(
            "subset",
            "node",
            F.col("parent").alias("to"),
            "length",
            (F.coalesce("leaf", F.lit(False)) | (F.coalesce("n", F.lit(0)) > 1)).alias("kept"),
        ),
    )
    while True:
        over = state.where("not kept").select("subset", F.col("node").alias("to"), F.col("to").alias("far"), F.col("length").alias("more"))
        found = state.join(over.withColumn("passed", F.lit(True)), ["subset", "to"], "left")
        passed = F.coalesce("passed", F.lit(False))
        new = checkpoint(
            found.select(
                "subset",
                "node",
                F.when(passed, F.col("far")).otherwise(F.col("to")).alias("to"),
                F.when(passed, F.col("length") + F.col("more")).otherwise(F.col("length")).alias("length"),
                "kept",
                passed.alias("passed"),
            ),
        )
        state = new.drop("passed")
        if not new.where("passed").take(1):
            return state.where("kept").select("subset", "node", F.col("to").alias("parent"), "length")
