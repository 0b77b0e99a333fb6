"""URL filters by link-graph propagation.

Trust starts at seed hosts and follows links (personalised PageRank); distrust starts at blocked hosts and follows links
backwards, to those that link to them. Both move over the edges between different hosts, weighted by numbers of links, until
they change little. A host is rejected if its distrust reaches a threshold and outweighs its trust.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, functions as F

from lexigrove.llm.common import Shared, fresh

DAMPING = 0.85
#: The summed change that ends the steps.
TOLERANCE = 1e-6
#: Distrust of a rejected host, as a multiple of what each host would have if it were spread evenly.
THRESHOLD = 1.0
_HREF = r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)"


def host(url: Column) -> Column:
    """Lower-case host of an absolute or protocol-relative URL, without user, port and final dot; null if there is none."""
    h = F.rtrim(F.lower(F.regexp_extract(F.trim(url), _HOST, 1)), F.lit("."))
    return F.when(h != "", h)


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): links from each host to each, those within a host too. Relative links lead to the page's own host; links of other kinds (mailto:, javascript:, fragments alone) lead nowhere."""
    own = pages.select(host(F.col(f"`{url}`")).alias("src"), F.explode(F.regexp_extract_all(F.col(f"`{html}`"), F.lit(_HREF), F.lit(1))).alias("href")).where("src is not null")
    link = F.replace(F.col("href"), F.lit("&amp;"), F.lit("&"))
    dst = F.when(link.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//"), host(link)).when(~link.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:|#)"), F.col("src"))
    return own.select("src", dst.alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))


def domains(host_name: Column) -> Column:
    """The host and the domains that it lies below, the longest first."""
    labels = F.split(host_name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def seeds(hosts: DataFrame, trusted: list[str] | DataFrame, blocked: list[str] | DataFrame) -> DataFrame:
    """(host, t, d) of the hosts that are listed or lie below a listed one; t and d are 1 for those trusted and blocked, else 0.

    Lists can be DataFrames of one column of names, of any length: they are joined with each host's domains. The longest
    listed domain decides; one that is on both lists is blocked.
    """
    spark, parts = hosts.sparkSession, []
    for names, kind in ((trusted, 0), (blocked, 1)):
        names = spark.createDataFrame([(n,) for n in names], "name string") if isinstance(names, list) else names.toDF("name")
        parts.append(names.select(F.trim(F.lower("name"), F.lit(" .")).alias("domain"), F.lit(kind).alias("kind")))
    listed = parts[0].unionByName(parts[1]).where("domain is not null and domain <> ''").groupBy("domain").agg(F.max("kind").alias("kind"))
    each = hosts.select("host", F.explode(domains(F.col("host"))).alias("domain"))
    found = each.join(listed, "domain").groupBy("host").agg(F.max_by("kind", F.length("domain")).alias("kind"))
    return found.select("host", (1.0 - F.col("kind")).alias("t"), F.col("kind").cast("double").alias("d"))


def most_steps(damping: float = DAMPING, tolerance: float = TOLERANCE) -> int:
    """Steps after which the summed change is within the tolerance on any graph: it is 4 at most and each step leaves no more than damping times as much."""
    return math.ceil(math.log(tolerance / 4) / math.log(damping)) + 1 if 0 < damping < 1 else 2


def propagate(edges: DataFrame, hosts: DataFrame, trusted: list[str] | DataFrame, blocked: list[str] | DataFrame, damping: float = DAMPING, steps: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of the hosts and of all that edges name; each of the two sums to 1, or to 0 without a seed.

    Seeds are those of ``seeds``. Links within a host don't count. What reaches a host that leads no further goes back to the
    seeds. Each step is one job, whose table is written to the shared folder, so that plans stay small and a lost executor
    costs one step; what the next step needs of it is summed up while it is written. Steps go on until the summed change is
    within the tolerance, which any graph reaches in ``most_steps``; with fewer ``steps`` given, scores that haven't settled
    are an error.
    """
    shared = Shared(edges.sparkSession)
    links, _ = shared.write(edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("n").cast("double").alias("n")))
    names = hosts.select("host").unionByName(edges.select(F.col("src").alias("host"))).unionByName(edges.select(F.col("dst").alias("host"))).where("host is not null").distinct()
    out_sum = links.groupBy("src").agg(F.sum("n").alias("out")).withColumnRenamed("src", "host")
    in_sum = links.groupBy("dst").agg(F.sum("n").alias("in")).withColumnRenamed("dst", "host")
    known, _ = shared.write(names)
    marked = known.join(seeds(known, trusted, blocked), "host", "left").join(out_sum, "host", "left").join(in_sum, "host", "left")
    base, _ = shared.write(marked.na.fill(0.0, ["t", "d", "out", "in"]))
    totals = base.agg(F.sum("t"), F.sum("d")).first()
    share_t, share_d = (F.col(c) / F.lit(x or 1.0) for c, x in zip("td", totals))
    start = base.select("host", share_t.alias("t"), share_d.alias("d"), "out", "in", share_t.alias("trust"), share_d.alias("distrust"), F.lit(0.0).alias("change"))

    def write(table: DataFrame) -> tuple[DataFrame, str, float, float, float]:
        seen = Observation()
        sums = [F.sum(F.when(F.col("out") == 0, F.col("trust"))).alias("t"), F.sum(F.when(F.col("in") == 0, F.col("distrust"))).alias("d"), F.sum("change").alias("change")]
        out, path = shared.write(table.observe(seen, *sums))
        return out, path, *(seen.get[c] or 0.0 for c in ("t", "d", "change"))

    now, path, lost_t, lost_d, _ = write(start)
    for _ in range(most_steps(damping, tolerance) if steps is None else steps):
        forward = links.join(now.select(F.col("host").alias("src"), "trust", "out"), "src").select(F.col("dst").alias("host"), (F.col("trust") * F.col("n") / F.col("out")).alias("a"), F.lit(0.0).alias("b"))
        backward = links.join(now.select(F.col("host").alias("dst"), "distrust", "in"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("a"), (F.col("distrust") * F.col("n") / F.col("in")).alias("b"))
        moved = forward.unionByName(backward).groupBy("host").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        trust = (1 - damping) * F.col("t") + damping * (F.coalesce("a", F.lit(0.0)) + lost_t * F.col("t"))
        distrust = (1 - damping) * F.col("d") + damping * (F.coalesce("b", F.lit(0.0)) + lost_d * F.col("d"))
        change = F.abs(trust - F.col("trust")) + F.abs(distrust - F.col("distrust"))
        new, new_path, lost_t, lost_d, moved_by = write(now.join(moved, "host", "left").select("host", "t", "d", "out", "in", trust.alias("trust"), distrust.alias("distrust"), change.alias("change")))
        shared.drop(path)
        now, path = new, new_path
        if moved_by <= tolerance:
            shared.only(path)
            return now.select("host", "trust", "distrust")
    raise RuntimeError("trust and distrust have not settled")


def filter_hosts(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """scores with ``rejected``: distrust is threshold times an even share or more, and above the trust, so that equal ones aren't rejected."""
    n = scores.count()
    return scores.withColumn("rejected", (F.col("distrust") >= threshold / max(n, 1)) & (F.col("distrust") > F.col("trust")))


def filter_urls(pages: DataFrame, trusted: list[str] | DataFrame, blocked: list[str] | DataFrame, url: str = "url", html: str = "html", threshold: float = THRESHOLD, damping: float = DAMPING, steps: int | None = None) -> DataFrame:
    """pages with ``host``, ``trust``, ``distrust`` and ``rejected``.

    Pages whose URL is null or has no host have nulls there and aren't rejected; null or empty HTML has no links. Without
    seeds nothing is rejected. Every row is kept, repeated ones too, and each counts its links. An empty table stays empty.
    The new names get underscores appended while a column has them.
    """
    scores = filter_hosts(propagate(host_edges(pages, url, html), pages.select(host(F.col(f"`{url}`")).alias("host")), trusted, blocked, damping, steps), threshold)
    new = {c: fresh(pages, c) for c in ("host", "trust", "distrust", "rejected")}
    scores = scores.withColumnsRenamed(new)
    own = pages.withColumn(new["host"], host(F.col(f"`{url}`")))
    out = own.join(scores, new["host"], "left")
    return out.select(*(F.col(f"`{c}`") for c in pages.columns), new["host"], new["trust"], new["distrust"], F.coalesce(F.col(new["rejected"]), F.lit(False)).alias(new["rejected"]))
