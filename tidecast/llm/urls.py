"""URL filter: a rule list, and a tree of path templates per host that learns from labelled urls.

Column functions only. A path is read as segments; digits, hexadecimal names and long mixed names become
shapes. Per host the tree is built from the root: where a node has many different children and none of
them is common, its children become one wildcard. From the leaves up, sibling branches that lead to the same
shapes and whose labelled shares do not differ by more than chance are merged. Then purity flows down: the
labelled share of bad urls of a node is smoothed towards that of its parent, that of a host's root towards the
share of all hosts with the same templates, and theirs towards the share of all labelled urls. So a branch
without labels has the purity of what is above it. A template is rejected if its purity is high and its
host has enough labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import stored

# Fixed values: (host, start of the path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

DEPTH = 4  # levels of single segments; all segments below are one more level, told apart as a whole
SALTS = 8


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for own_host, own_path, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        named = F.struct(F.lit(own_host + own_path).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, named).otherwise(best)
    return best


def shape(segment: Column) -> Column:
    """A segment without what varies from page to page; a file ending stays."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z]{2,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{2,5}$", "")
    kind = (
        F.when(stem.rlike(r"^[0-9]+$"), F.lit("<n>"))
        .when(stem.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("<hex>"))
        .when((F.length(stem) >= 12) & stem.rlike(r"[0-9]"), F.lit("<mixed>"))
        .otherwise(stem)
    )
    return F.concat(kind, ending)


def segments(path: Column) -> Column:
    """Shapes of the first `DEPTH` segments, and of all others as one; a path without segments has none."""
    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape)
    rest = F.array_join(F.slice(parts, DEPTH + 1, F.greatest(F.size(parts), F.lit(1))), "/")
    more = F.when(F.size(parts) > DEPTH, F.array(rest)).otherwise(F.array().cast("array<string>"))
    closed = F.when(F.size(parts) > 0, F.array(F.when(path.endswith("/"), F.lit("<dir>")).otherwise(F.lit("<end>"))))
    return F.concat(F.slice(parts, 1, DEPTH), more, F.coalesce(closed, F.array().cast("array<string>")))


def name(parts: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def generalised(branches: DataFrame, least_children: int, common: float) -> DataFrame:
    """Wildcards for variable children, from the root down. `branches`: host, parts, rows, labels.

    One aggregation per level over branches, which are already counted per shape, so a host's urls are never
    gathered.
    """
    for level in range(DEPTH + 1):
        child = F.get("parts", F.lit(level))
        nodes = branches.withColumns({"parent": name(F.slice("parts", 1, level)), "child": child}).where("child IS NOT NULL")
        children = nodes.groupBy("host", "parent", "child").agg(F.sum("rows").alias("rows"))
        wild = children.groupBy("host", "parent").agg(
            F.count("*").alias("n"), F.max("rows").alias("most"), F.sum("rows").alias("all")
        ).where((F.col("n") >= least_children) & (F.col("most") <= common * F.col("all"))).select("host", "parent")
        keyed = branches.withColumn("parent", name(F.slice("parts", 1, level)))
        marked = keyed.join(wild.withColumn("wild", F.lit(True)), ["host", "parent"], "left")
        parts = F.when(
            F.col("wild") & child.isNotNull() & (child != "<dir>") & (child != "<end>"),
            F.concat(F.slice("parts", 1, level), F.array(F.lit("*")), F.slice("parts", level + 2, DEPTH + 2)),
        ).otherwise(F.col("parts"))
        branches = marked.select("host", "shapes", parts.alias("parts"), "rows", "labelled", "bad")
    return branches


def merged(branches: DataFrame, level: int, worst_z: float) -> DataFrame:
    """Merge siblings of a level with the same set of continuations and alike labelled shares.

    Branches are pooled within a quarter of the labelled share, and those that lie too far from their pool
    stay apart. Branches without labels merge with each other.
    """
    own, parent = F.get("parts", F.lit(level)), name(F.slice("parts", 1, level))
    tails = branches.withColumns({"parent": parent, "own": own, "tail": name(F.slice("parts", level + 2, DEPTH + 2))})
    distinct = tails.where("own IS NOT NULL").groupBy("host", "parent", "own", "tail").agg(
        F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    sides = distinct.groupBy("host", "parent", "own").agg(
        F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.bit_xor(F.xxhash64("tail")).alias("profile"))
    band = F.when(F.col("labelled") > 0, F.floor(4 * F.col("bad") / F.col("labelled") + 0.5)).otherwise(F.lit(-1))
    sides, alone = sides.withColumn("band", band), ["host", "parent", "profile", "band"]
    pool = sides.groupBy(*alone).agg(
        F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"), F.count("*").alias("siblings")
    )
    share = (F.col("all_bad") + 0.5) / (F.col("all_labelled") + 1)
    mine = F.when(F.col("labelled") > 0, F.col("bad") / F.col("labelled")).otherwise(share)
    z = F.abs(mine - share) / F.sqrt(share * (1 - share) / F.greatest(F.col("labelled"), F.lit(1)))
    alike = sides.join(pool, alone).where((F.col("siblings") > 1) & (z <= worst_z)).select(
        "host", "parent", "own", F.concat(F.lit("<group "), F.hex("profile"), F.lit(" "), F.col("band"), F.lit(">")).alias("group_name"))
    joined = tails.join(alike, ["host", "parent", "own"], "left")
    parts = F.when(F.col("group_name").isNotNull(), F.concat(
        F.slice("parts", 1, level), F.array("group_name"), F.slice("parts", level + 2, DEPTH + 2))).otherwise(F.col("parts"))
    return joined.select("host", "shapes", parts.alias("parts"), "rows", "labelled", "bad")


def with_purity(named: DataFrame, prior: float, strength: float) -> DataFrame:
    """Templates (host, template, parts, labelled, bad) with `purity` and the labels of their host.

    One aggregation per level over templates; a node's share is smoothed towards the node above it. A node
    with the same labels as the one above, such as an only child, adds nothing: labels count once.
    """
    def smoothed(bad: str, labelled: str, towards: Column) -> Column:
        return (F.col(bad) + strength * towards) / (F.col(labelled) + strength)

    sums = [F.sum("labelled").alias("n"), F.sum("bad").alias("b")]
    hosts = named.groupBy("host").agg(*sums, F.bit_xor(F.xxhash64("template")).alias("profile"))
    alike = hosts.groupBy("profile").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
    roots = hosts.join(alike, "profile").select(
        "host", F.col("n").alias("host_labels"), F.col("n").alias("above"), smoothed("b", "n", smoothed("all_b", "all_n", F.lit(prior))).alias("purity"))
    made = named.join(roots, "host")
    for level in range(1, DEPTH + 3):
        made = made.withColumn("prefix", name(F.slice("parts", 1, level)))
        nodes = made.where(F.size("parts") >= level).groupBy("host", "prefix").agg(*sums)
        fewer = (F.size("parts") >= level) & (F.col("n") < F.col("above"))
        made = made.join(nodes, ["host", "prefix"], "left").withColumns({
            "purity": F.when(fewer, smoothed("b", "n", F.col("purity"))).otherwise(F.col("purity")),
            "above": F.when(fewer, F.col("n")).otherwise(F.col("above")),
        }).drop("n", "b", "prefix")
        if level % 3 == 0:
            made = stored(made)  # small tables; shorter plans
    return made


def templates(
    urls: DataFrame, least_children: int = 24, common: float = 0.2, worst_z: float = 1.96,
    strength: float = 4.0, least_labels: int = 5, worst_share: float = 0.8,
) -> DataFrame:
    """(host, shapes, template, labelled, bad, purity, rejected) for every shape of urls (host, shapes, bad).

    `bad` is 1 or 0 for labelled urls and null for the others.
    """
    counted = urls.groupBy("host", "shapes").agg(
        F.count("*").alias("rows"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    grouped = stored(generalised(stored(counted.withColumn("parts", F.col("shapes"))), least_children, common))
    for level in range(DEPTH, -1, -1):
        grouped = merged(grouped, level, worst_z)
        if level % 2 == 0:
            grouped = stored(grouped)
    known = grouped.agg(F.sum("labelled").alias("n"), F.sum("bad").alias("bad")).first()
    prior = ((known.bad or 0) + 0.5) / ((known.n or 0) + 1.0)
    named = grouped.withColumn("template", name(F.col("parts")))
    judged = named.groupBy("host", "template").agg(
        F.first("parts").alias("parts"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    judged = with_purity(stored(judged), prior, strength).withColumn(
        "rejected", (F.col("host_labels") >= least_labels) & (F.col("purity") >= worst_share)
    ).drop("parts", "above")
    return named.select("host", "shapes", "template").join(judged, ["host", "template"])


def judge(pages: DataFrame, id_column: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, template) for every row.

    The rules' own verdicts are the labels that the tree learns from. A url's verdict is its rule's; without
    a rule it is `block` if its template is rejected, else `allow`. Null urls and urls without `://` have an
    empty host and path. Repeated rows are judged each and count each; other columns are ignored; an empty
    table gives no rows.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    parsed = pages.select(id_column, host.alias("host"), path.alias("path"))
    found = parsed.withColumn("base", ruled(F.col("host"), F.col("path"), rules)).withColumn("shapes", segments(F.col("path")))
    bad = F.when(F.col("base.verdict").isNotNull(), (F.col("base.verdict") == "block").cast("long"))
    tree = templates(found.select("host", "shapes", bad.alias("bad")))
    # a host and shape may hold a large share of all rows: its rows are dealt over several keys
    salted = found.withColumn("salt", F.pmod(F.xxhash64(id_column), F.lit(SALTS)))
    copies = tree.select("host", "shapes", "template", "rejected").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = salted.join(copies, ["host", "shapes", "salt"], "left")
    verdict = F.coalesce(F.col("base.verdict"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select(id_column, "host", "path", F.col("base.rule").alias("rule"), verdict.alias("verdict"), "template")
