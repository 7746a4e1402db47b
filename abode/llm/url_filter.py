"""URL filter: a path-template tree per host with labelled purity.

1. A url gives a host and a path.  Explicit rules (host suffix + path prefix)
   decide first; the longest rule wins.
2. Per host, paths grow a template tree level by level: a segment with digits
   is generalised at once, any other position becomes a wildcard when its
   distinct values are many for the rows it holds.  Segments past ``LEVELS``
   are levels too, generalised in one round together.
3. Statistically similar sibling branches merge, at every level: a template's
   siblings differ in one segment; where its labelled share agrees with that of
   the rest of their pool (two-proportion z), it takes the pool's counts.  The
   deepest such level counts.
4. Shares of bad labels are smoothed down the tree: all labels are the prior
   of the host, the host of its pools and branches, these of the template.  A
   template without labels of its own so has the share of what is around it.
5. A template is rejected when its share is high, and also the share of the
   narrowest group around it (itself, a branch above, its pool, its host) that
   has ``MIN_LABELS`` labels.  Where even the host has fewer, it is allowed.

All of it is DataFrame work: urls are first summed up to distinct (host, path)
with label counts, so a hot host is pre-aggregated; every later table is one
row per template.  No user functions.

Defined results: a null url, or one without ``://``, has an empty host and
path, no rule, and is judged by the (labelled) template of empty hosts; repeated
rows are judged each; null page ids are kept; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abode.llm.common import written

LEVELS = 6
PRIOR_WEIGHT = 4.0
REJECT = 0.7
MIN_LABELS = 8
MERGE_Z = 1.96


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` (allow or block) for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    after = F.substr(url, F.instr(url, "://") + F.lit(3))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    after = F.substr(url, F.instr(url, "://") + F.lit(3))
    path = F.regexp_extract(after, r"^[^/?#]*(/[^?#]*)", 1)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, path).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # a later, longer rule wraps the earlier ones
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def fixed_form(segment: Column) -> Column:
    """A segment with its digit runs generalised."""
    return F.regexp_replace(segment, r"[0-9]+", "{n}")


def templates(paths: DataFrame, levels: int = LEVELS) -> DataFrame:
    """host, path -> template: two small aggregates and a join per level.

    ``paths`` has one row per (host, path) with its number of rows.  Each level
    is written, as both the next counts and the next paths read it; what lies
    past ``levels`` takes one more round, however deep it is."""
    cut = F.split(F.substr(F.col("path"), F.lit(2)), "/")
    depth = paths.agg(F.max(F.size(cut)).alias("d")).first()["d"] or 0
    tree = paths.select("host", "path", "n", F.transform(cut, fixed_form).alias("seg"), F.lit("").alias("tpl"))
    for d in range(min(depth, levels)):
        tree = written(tree, f"paths-{d}")
        seg = F.get("seg", F.lit(d))
        node = (tree.where(seg.isNotNull()).groupBy("host", "tpl", seg.alias("s")).agg(F.sum("n").alias("n"))
                .groupBy("host", "tpl").agg(F.count("*").alias("kinds"), F.sum("n").alias("rows")))
        wild = node.where("kinds >= 10 and kinds > sqrt(rows)").select(F.col("host").alias("h"), F.col("tpl").alias("at"))
        step = F.when(F.col("h").isNotNull() & (seg != ""), F.lit("*")).otherwise(seg)
        tree = (tree.join(wild, (F.col("host") == F.col("h")) & (F.col("tpl") == F.col("at")), "left")
                .select("host", "path", "n", "seg",
                        F.when(seg.isNull(), F.col("tpl")).otherwise(F.concat("tpl", F.lit("/"), step)).alias("tpl")))
    if depth > levels:
        tree = written(tree, "paths-deep")
        return tree.where(F.size("seg") <= levels).select("host", "path", F.col("tpl").alias("template")).unionByName(deep_templates(tree, levels))
    return tree.select("host", "path", F.col("tpl").alias("template"))


def deep_templates(tree: DataFrame, levels: int) -> DataFrame:
    """host, path -> template of the paths with more than ``levels`` segments:
    all further positions at once.  A position is told by the template before
    ``levels`` and the fixed forms of the segments since, so one below a
    wildcard is counted for each value of the wildcard alone."""
    rest = F.slice("seg", F.lit(levels + 1), F.size("seg"))
    steps = (tree.where(F.size("seg") > levels).select("host", "path", "n", "tpl", rest.alias("rest"))
             .select("host", "path", "n", "tpl", F.inline(F.transform("rest", lambda s, i: F.struct(
                 i.alias("pos"), s.alias("s"), F.md5(F.array_join(F.slice("rest", F.lit(1), i), "/")).alias("at"))))))
    place = ["host", "tpl", "pos", "at"]
    steps = written(steps, "steps")
    node = steps.groupBy(*place, "s").agg(F.sum("n").alias("n")).groupBy(*place).agg(F.count("*").alias("kinds"), F.sum("n").alias("rows"))
    wild = node.where("kinds >= 10 and kinds > sqrt(rows)").select(*place, F.lit(True).alias("wild"))
    step = F.when(F.col("wild") & (F.col("s") != ""), F.lit("*")).otherwise(F.col("s"))
    found = steps.join(wild, place, "left").groupBy("host", "path", "tpl").agg(F.array_sort(F.collect_list(F.struct("pos", step.alias("s")))).alias("rest"))
    return found.select("host", "path", F.concat("tpl", F.lit("/"), F.array_join("rest.s", "/")).alias("template"))


def groups_of(template: Column) -> Column:
    """array<struct<rank, before, tail>>: the groups that a template is judged
    with, widest first: its host, and at each level its siblings' pool and its
    branch.  Rank 2 d holds all below the first d - 1 segments, 2 d + 1 is the
    pool of level d: the same segments ``before`` and the same ``tail`` after any d-th."""
    cut = F.split(template, "/")  # the first part is always empty
    level = F.sequence(F.lit(1), F.greatest(F.size(cut) - 1, F.lit(1)))

    def before(d: Column) -> Column:
        return F.array_join(F.slice(cut, F.lit(1), d), "/")

    branch = F.transform(level, lambda d: F.struct((2 * d).alias("rank"), before(d).alias("before"), F.lit("").alias("tail")))
    pool = F.transform(level, lambda d: F.struct(
        (2 * d + 1).alias("rank"), before(d).alias("before"), F.array_join(F.transform(F.slice(cut, d + 2, F.size(cut)), lambda x: F.concat(F.lit("/"), x)), "").alias("tail")))
    return F.array_sort(F.concat(branch, pool))


def purity(leaves: DataFrame) -> DataFrame:
    """host, template -> labels, bad_share, support, support_share: similar
    siblings merged, then smoothed down the tree.

    ``support`` counts the labels of the narrowest group around the template
    (itself, its branches, its pool, its host) that has ``MIN_LABELS``, else 0."""
    t = leaves.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("labels", "bad")])
    total = leaves.agg(F.sum("labels").alias("al"), F.sum("bad").alias("ab")).first()  # two sums
    prior = (total["ab"] or 0) / max(total["al"] or 0, 1)
    key = ["host", "rank", "before", "tail"]
    member = t.select("host", "template", "labels", "bad", F.inline(groups_of(F.col("template"))))
    group = member.groupBy(*key).agg(F.sum("labels").alias("gl"), F.sum("bad").alias("gb"))
    around = (member.join(group, key).groupBy("host", "template", "labels", "bad")
              .agg(F.array_sort(F.collect_list(F.struct("rank", "gl", "gb"))).alias("groups")))

    def alike(g: Column) -> Column:
        """Whether the template's share agrees with that of the pool's rest; without labels there is nothing to compare."""
        rest, p = g["gl"] - F.col("labels"), g["gb"] / F.greatest(g["gl"], F.lit(1))
        apart = F.abs(F.col("bad") / F.greatest(F.col("labels"), F.lit(1)) - (g["gb"] - F.col("bad")) / F.greatest(rest, F.lit(1)))
        se = F.sqrt(F.greatest(p * (1 - p), F.lit(1e-4)) * (1 / F.greatest(F.col("labels"), F.lit(1)) + 1 / F.greatest(rest, F.lit(1))))
        return (g["rank"] % 2 == 1) & (F.col("labels") > 0) & (rest > 0) & (apart <= MERGE_Z * se)

    pool = F.try_element_at(F.filter("groups", alike), F.lit(-1))
    own = F.struct(F.coalesce(pool["gl"], F.col("labels")).alias("gl"), F.coalesce(pool["gb"], F.col("bad")).alias("gb"))

    def down(at: Column, g: Column) -> Column:
        share = (g["gb"] + PRIOR_WEIGHT * at["share"]) / (g["gl"] + PRIOR_WEIGHT)
        firm = g["gl"] >= MIN_LABELS
        return F.struct(share.alias("share"), F.when(firm, g["gl"]).otherwise(at["support"]).alias("support"),
                        F.when(firm, share).otherwise(at["support_share"]).alias("support_share"))

    start = F.struct(F.lit(float(prior)).alias("share"), F.lit(0).cast("long").alias("support"), F.lit(0.0).alias("support_share"))
    got = around.select("host", "template", own.alias("own"), F.aggregate("groups", start, down).alias("above"))
    got = got.select("host", "template", F.col("own.gl").alias("labels"), down(F.col("above"), F.col("own")).alias("x"))
    return got.select("host", "template", "labels", F.col("x.share").alias("bad_share"), "x.support", "x.support_share")


def url_filter(pages: DataFrame, labels: DataFrame | None = None, rules: tuple[UrlRule, ...] = RULES,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, template_labels, bad_share, support for each row of ``pages``.

    ``labels`` (page_id, bad) marks known pages.  Without it the rules' own
    verdicts are the labels: a page that a rule blocks is bad, one that a rule
    allows is good.  Hosts with fewer than ``MIN_LABELS`` labels allow."""
    url = F.col(url_col).cast("string")
    src = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    src = src.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    if labels is None:
        marked = src.withColumn("bad", (F.col("hit.verdict") == "block").cast("long"))
    else:
        known = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("long")).alias("bad"))
        marked = src.join(known, "page_id", "left")
    paths = marked.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("bad").alias("labels"),
                                               F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    paths = written(paths, "paths")
    tpl = templates(paths.select("host", "path", "n"))
    leaves = written(paths.join(tpl, ["host", "path"]), "leaves").select("host", "path", "template", "labels", "bad")
    judged = leaves.select("host", "path", "template").join(purity(leaves), ["host", "template"])
    rejected = (F.col("support") > 0) & (F.least("bad_share", "support_share") >= REJECT)
    verdict = F.coalesce(F.col("hit.verdict"), F.when(rejected, F.lit("block")).otherwise(F.lit("allow")))
    return (src.join(judged, ["host", "path"], "left")
            .select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"),
                    "template", F.coalesce("labels", F.lit(0)).alias("template_labels"), "bad_share", "support"))
