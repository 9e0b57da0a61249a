"""URL filter: rules by host and path, and behind them a tree of path templates per host, rejected by labelled purity.

Rules decide what they fit (the longest wins); what they decide also labels pages for the rest. A path's segments become a
template: runs of digits are generalised by their form, and, level by level from the root, a segment that holds less than
LEAST_SHARE of its branch (or fewer than LEAST_PAGES pages) becomes the wildcard `*`. So a branch has at most
1 / LEAST_SHARE named children and a wildcard, whatever the number of pages. From the leaves up, children of a branch whose
distributions of what follows (next segment or end, with the pages' labels) do not differ by more than Hoeffding's bound are
merged into one, the larger first. A template is rejected where (unwanted + PRIOR) / (labelled + 2 PRIOR) reaches PURITY;
without labels that is one half, so unknown templates pass.

Pages are counted by (host, generalised path) before anything is joined, so that a hot host is summed where it is read; the
tree's tables are written once a level, which keeps each plan short. Only children of one branch meet in a group, a bounded
number of rows. Segments beyond MAX_LEVELS share one wildcard `**`; this is part of what a template is, no row is lost.

Null url, or one without `://`: host and path are empty, no rule fits, and all such pages share the empty template. Empty
paths have the empty template of their host. Very long urls are read whole. Rules of equal length: the first one listed wins.
Repeated rows are pages of their own. Null page_id is kept. An empty table gives an empty result. Other columns are not read
and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.shared import cut_lineage

LEAST_SHARE, LEAST_PAGES = 0.02, 5
MAX_LEVELS = 12
#: Risk of Hoeffding's bound; weight of the smoothing and the purity from which a template is rejected.
RISK, PRIOR, PURITY = 0.05, 2, 0.9
ANY, REST = "*", "**"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


# The rules of the registered query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A[^?#]*", 0)
    return pages.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path})


def longest_rule(rules: Sequence[Rule]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits `host` and `path`, or null. The rules are a short list of constants."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host) + len(r.path)):  # later ones win, so of equal ones the first listed goes last
        own = (F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))
        found = F.when(own & F.startswith("path", F.lit(r.path)), F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def segments() -> Column:
    """The path's segments, runs of digits as `<n>`; what lies beyond MAX_LEVELS as one wildcard."""
    flat = F.regexp_replace(F.regexp_replace("path", r"\A/", ""), "[0-9]+", "<n>")
    parts = F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, "/"))
    return F.when(F.size(parts) > MAX_LEVELS, F.concat(F.slice(parts, 1, MAX_LEVELS - 1), F.array(F.lit(REST)))).otherwise(parts)


def path_templates(paths: DataFrame) -> DataFrame:
    """host, segs, tmpl of rows (host, segs, n): rare segments become wildcards, a level at a time."""
    deepest = paths.agg(F.max(F.size("segs"))).first()[0] or 0
    tree = paths.withColumn("tmpl", F.array().cast("array<string>"))
    for d in range(deepest):
        tree = cut_lineage(tree)
        seg = F.get("segs", F.lit(d))
        child = tree.where(F.size("segs") > d).groupBy("host", "tmpl", seg.alias("seg")).agg(F.sum("n").alias("c"))
        parent = child.groupBy("host", "tmpl").agg(F.sum("c").alias("total"))
        named = child.where(F.col("c") >= LEAST_PAGES).join(parent, ["host", "tmpl"]).where(F.col("c") >= LEAST_SHARE * F.col("total"))
        joined = tree.withColumn("seg", seg).join(named.select("host", "tmpl", "seg", F.lit(True).alias("named")), ["host", "tmpl", "seg"], "left")
        step = F.array(F.when(F.col("named"), F.col("seg")).otherwise(ANY))
        tree = joined.select("host", "segs", "n", "unwanted", "wanted", F.when(F.size("segs") > d, F.concat("tmpl", step)).otherwise(F.col("tmpl")).alias("tmpl"))
    return cut_lineage(tree)


def _similar(a: dict, b: dict) -> bool:
    """Whether no outcome's share differs by more than Hoeffding's bound for both samples."""
    na, nb = sum(a.values()), sum(b.values())
    bound = math.sqrt(0.5 * math.log(2 / RISK)) * (na**-0.5 + nb**-0.5)
    return all(abs(a.get(k, 0) / na - b.get(k, 0) / nb) <= bound for k in a.keys() | b.keys())


def merged_children(rows: pd.DataFrame) -> pd.DataFrame:
    """Names of the merged children of one branch; rows: name, next, unwanted, wanted, n."""
    outcomes: dict[str, dict] = {}
    for name, following, unwanted, wanted, n in rows[["name", "next", "unwanted", "wanted", "n"]].itertuples(index=False):
        of = outcomes.setdefault(name, {})
        for label, k in (("unwanted", unwanted), ("wanted", wanted), ("none", n - unwanted - wanted)):
            if k:
                of[following, label] = of.get((following, label), 0) + k
    groups: list[tuple[list[str], dict]] = []
    for name in sorted(outcomes, key=lambda x: (-sum(outcomes[x].values()), x)):
        home = next((g for g in groups if _similar(g[1], outcomes[name])), None)
        if home is None:
            groups.append(([name], dict(outcomes[name])))
        else:
            home[0].append(name)
            for k, v in outcomes[name].items():
                home[1][k] = home[1].get(k, 0) + v
    first = rows.iloc[0]
    return pd.DataFrame([(first["host"], first["parent"], name, "|".join(sorted(names))) for names, _ in groups for name in names], columns=["host", "parent", "name", "merged"])


def merged_templates(leaves: DataFrame) -> DataFrame:
    """Add `merged`, the template after similar branches became one, to rows (host, tmpl, n, unwanted, wanted)."""
    deepest = leaves.agg(F.max(F.size("tmpl"))).first()[0] or 0
    out = leaves.withColumn("merged", F.col("tmpl"))
    for d in reversed(range(deepest)):
        out = cut_lineage(out)
        parent, name = F.slice("tmpl", 1, d), F.get("tmpl", F.lit(d))  # above d nothing is merged yet
        below = out.where(F.size("tmpl") > d).groupBy("host", parent.alias("parent"), name.alias("name"), F.get("merged", F.lit(d + 1)).alias("next"))
        sums = below.agg(*(F.sum(c).alias(c) for c in ("n", "unwanted", "wanted")))
        several = sums.groupBy("host", "parent").agg((F.min("name") < F.max("name")).alias("several")).where("several").select("host", "parent")
        schema = "host string, parent array<string>, name string, merged string"
        names = sums.join(several, ["host", "parent"]).groupBy("host", "parent").applyInPandas(merged_children, schema).withColumnRenamed("merged", "joint")
        placed = out.withColumns({"parent": parent, "name": name}).join(names, ["host", "parent", "name"], "left")
        before, after = F.slice("merged", 1, d), F.slice("merged", d + 2, MAX_LEVELS)
        whole = F.when(F.col("joint").isNotNull(), F.concat(before, F.array("joint"), after)).otherwise(F.col("merged"))
        out = placed.select("host", "tmpl", "n", "unwanted", "wanted", whole.alias("merged"))
    return out


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, label: str | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page.

    label: a boolean column, true for unwanted pages and null for unlabelled ones, that counts where no rule fits.
    """
    given = F.lit(None).cast("boolean") if label is None else F.col(f"`{label}`")
    flat = with_parts(pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), given.alias("given")))
    ruled = flat.withColumn("rule", longest_rule(rules)).select("page_id", "host", "path", "rule", "given", segments().alias("segs"))
    unwanted = F.coalesce(F.col("rule.verdict") == "block", F.col("given"))
    counts = [F.count("*").alias("n"), F.count_if(unwanted).alias("unwanted"), F.count_if(~unwanted).alias("wanted")]
    tree = path_templates(ruled.groupBy("host", "segs").agg(*counts))
    leaves = merged_templates(tree.groupBy("host", "tmpl").agg(*(F.sum(c).alias(c) for c in ("n", "unwanted", "wanted"))))
    leaves = cut_lineage(leaves)
    sums = leaves.groupBy("host", "merged").agg(F.sum("unwanted").alias("u"), F.sum("wanted").alias("w"))
    pure = sums.select("host", "merged", ((F.col("u") + PRIOR) / (F.col("u") + F.col("w") + 2 * PRIOR)).alias("purity"))
    judged = leaves.select("host", "tmpl", "merged").join(pure, ["host", "merged"])
    by_path = tree.select("host", "segs", "tmpl").join(judged, ["host", "tmpl"]).select("host", "segs", F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "purity")
    verdict = F.coalesce("rule.verdict", F.when(F.col("purity") >= PURITY, "block").otherwise("allow"))
    return ruled.join(by_path, ["host", "segs"], "left").select("page_id", "host", "path", F.col("rule.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
