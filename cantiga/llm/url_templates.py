"""Path-template tree: URL verdicts from labelled purity, DataFrame functions only.

Per host, paths form a tree of segments.  From the root down, a branch whose
labels do not differ from its siblings' (two-proportion z test on the raw
segments), or that too few URLs have, is merged into ``*``.  This goes on level
by level until no node is left whose labels could be split.  A template is
rejected when its smoothed share of good labels is below a threshold; the
smoothing goes towards its host, and a host's towards all hosts.  Explicit
rules come first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantiga.llm.common import Stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TreeSettings:
    #: Segments of a path that stand in its template also where they are ``*``.  Further down only
    #: what is kept apart does, with what lies above it; the rest is ``**``.
    levels: int = 3
    #: A segment can be kept apart when so many URLs of its node have it.
    least_rows: int = 5
    #: A branch is kept apart when its labels differ from its siblings' by so many standard errors.
    z: float = 1.96
    #: Labels that the smoothing adds.
    weight: float = 10.0
    #: Templates with a smaller share of good labels are rejected.
    purity: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for text without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    return F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def _rule_match(rules: list[Rule], field: str) -> Column:
    """The field of the longest rule that fits; equal lengths: the first in text order."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, field))).otherwise(out)
    return out


def _open_nodes(paths: DataFrame, s: TreeSettings) -> DataFrame:
    """Nodes that can split here or further down: labels of one kind never differ, nor does a part of them."""
    nodes = paths.groupBy("host", "node").agg(F.sum("n").alias("all_n"), F.sum("good").alias("all_g"), F.sum("labelled").alias("all_l"))
    return nodes.where((F.col("all_n") > s.least_rows) & (F.col("all_g") > 0) & (F.col("all_l") > F.col("all_g")))


def _apart(paths: DataFrame, nodes: DataFrame, s: TreeSettings) -> DataFrame:
    """The branches that differ from their siblings."""
    branch = paths.where(~F.col("segment").isin("*", "**")).groupBy("host", "node", "segment").agg(F.sum("n").alias("n"), F.sum("good").alias("g"), F.sum("labelled").alias("l"))
    branch = branch.where((F.col("n") >= s.least_rows) & (F.col("l") > 0))
    rate, rest = F.col("g") / F.col("l"), (F.col("all_g") - F.col("g")) / (F.col("all_l") - F.col("l"))
    # One good and one bad label more keep the variance off zero.
    pooled = (F.col("all_g") + 1.0) / (F.col("all_l") + 2.0)
    error = F.sqrt(pooled * (1.0 - pooled) * (1.0 / F.col("l") + 1.0 / (F.col("all_l") - F.col("l"))))
    tested = branch.join(nodes, ["host", "node"]).where(F.col("all_l") > F.col("l")).where(F.abs(rate - rest) >= s.z * error)
    return tested.select("host", "node", "segment", F.lit(True).alias("apart"))


def _templates(stored: Stored, paths: DataFrame, s: TreeSettings) -> DataFrame:
    """The template of each host and path, with its counts of labels."""
    # ``last`` is the place of the last segment kept apart.
    active = paths.select("*", F.filter(F.split("path", "/"), lambda x: x != "").alias("parts"), F.lit("").alias("node"), F.lit(0).alias("last"))
    done, level = [], 0
    while True:
        below = active.where(F.size("parts") > level).withColumn("segment", F.try_element_at("parts", F.lit(level + 1)))
        nodes = stored.keep(_open_nodes(below, s))
        if nodes.isEmpty():
            done.append(active)
            break
        done.append(active.where(F.size("parts") <= level))
        apart = stored.keep(_apart(below, nodes, s))
        named = below.join(nodes.select("host", "node", F.lit(True).alias("open")), ["host", "node"], "left").join(apart, ["host", "node", "segment"], "left")
        name = F.concat("node", F.lit("/"), F.when(F.col("apart"), F.col("segment")).otherwise("*"))
        moved = stored.keep(
            named.select(
                *paths.columns, "parts", F.when(F.col("open"), name).otherwise(F.col("node")).alias("node"),
                F.when(F.col("apart"), level + 1).otherwise(F.col("last")).alias("last"), F.coalesce("open", F.lit(False)).alias("open"),
            )
        )
        done.append(moved.where(~F.col("open")).drop("open"))
        active, level = moved.where("open").drop("open"), level + 1
    settled = done[0]
    for frame in done[1:]:
        settled = settled.unionByName(frame)
    tokens = F.filter(F.split("node", "/"), lambda x: x != "")
    full = F.concat(tokens, F.array_repeat(F.lit("*"), (F.size("parts") - F.size(tokens)).cast("int")))
    shown = F.greatest("last", F.least(F.size("parts"), F.lit(s.levels)))
    deeper = F.when(F.size("parts") > shown, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>"))
    return settled.select("host", "path", F.concat(F.lit("/"), F.array_join(F.concat(F.slice(full, F.lit(1), shown), deeper), "/")).alias("template"), "good", "labelled")


def judge_urls(urls: DataFrame, labels: DataFrame, rules: list[Rule], settings: TreeSettings = TreeSettings()) -> DataFrame:
    """A verdict for every row of ``urls`` (``id``, ``url``).

    ``labels`` has ``id`` and ``good`` (0 or 1); an id labelled more than once counts
    with its lowest label, null labels and ids do not count.  Returns id, host,
    path, rule (null if none fits), verdict, template and purity.  Repeated rows
    stay and count each; other columns are ignored; no labels at all allow
    everything; an empty table gives no rows.
    """
    s = settings
    stored = Stored(urls.sparkSession, "templates")
    known = labels.where(F.col("good").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.min(F.col("good").cast("int")).alias("good"))
    host, path = host_and_path(F.col("url"))
    parted = urls.select("id", host.alias("host"), path.alias("path"))
    rows = stored.keep(parted.join(known, "id", "left"))
    paths = stored.keep(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count("good").alias("labelled")))
    named = stored.keep(_templates(stored, paths, s))
    of_template = stored.keep(named.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled")))
    of_all = of_template.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("labelled"), F.lit(0))).first()
    prior = (of_all[0] + 1.0) / (of_all[1] + 2.0)
    hosts = of_template.groupBy("host").agg(((F.sum("good") + s.weight * prior) / (F.sum("labelled") + s.weight)).alias("host_rate"))
    purity = (F.col("good") + s.weight * F.col("host_rate")) / (F.col("labelled") + s.weight)
    pure = of_template.join(hosts, "host").select("host", "template", purity.alias("purity"))
    of_path = stored.keep(named.select("host", "path", "template").join(pure, ["host", "template"]))
    verdict = F.coalesce(_rule_match(rules, "verdict"), F.when(F.col("purity") < s.purity, "block").otherwise("allow"))
    return rows.join(of_path, ["host", "path"]).select("id", "host", "path", _rule_match(rules, "text").alias("rule"), verdict.alias("verdict"), "template", "purity")
