"""URL filters by trust and distrust propagated over the graph of hosts."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, shared_dir, written

DAMPING = 0.85
TOLERANCE = 0.01  # of the seeds' mass, what the rounds may leave on its way
ROUNDS_PER_TABLE = 4
MARGIN = 0.1  # of the mean score of a host
_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
_LINK = r"""\b(?:href|src)\s{0,8}=\s{0,8}["']?\s{0,8}((?:[a-z][a-z0-9+.-]{0,15}:)?//[^\s"'<>]+)"""
_MENTION = r"((?:[a-z0-9-]{1,63}\.)+(?:xn--[a-z0-9-]{1,59}|[a-z]{2,24}))"  # bounded labels keep the search linear in any text


def rounds_for(damping: float, tolerance: float = TOLERANCE) -> int:
    """The rounds after which at most ``tolerance`` of the seeds' mass has not arrived; what is left shrinks by ``damping`` a round."""
    return max(1, math.ceil(math.log(tolerance) / math.log(damping)))


def host_of(url: Column) -> Column:
    """The host of an absolute URL, in lower case; null if there is none."""
    host = F.regexp_extract(F.lower(url.cast("string")), _HOST, 1)
    return F.when(host != "", host)


def _site(suffixes: tuple[str, ...]) -> str:
    shared = "".join(s.replace(".", r"\.") + "|" for s in suffixes)
    return rf"([^.]+\.(?:{shared}[^.0-9][^.]*))$"


def site_of(host: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """The name under which a host is registered: one label and its suffix; null for addresses and names without a dot.

    ``suffixes`` are those of several labels, under which each name is another's: entries of the public-suffix list.
    """
    site = F.regexp_extract(host, _site(suffixes), 1)
    return F.when(site != "", site)


def host_edges(pages: DataFrame, seeds: DataFrame | None = None, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """``(src, dst, n)``: on how many pages of host src a link to, or mention of, the host dst stands.

    The host of an href or src value is a host whether crawled or not, and may be an address or any name that ``host_of`` takes.
    A mention in text counts if it names a crawled host or one of ``seeds(host)``; other words with dots need not be hosts.
    Relative links and a host's mentions of itself are no edges. Pages with a null url or html give none. A crawled host and its
    site are joined by an edge either way, which counts as one page.
    """
    own = pages.select(host_of(F.col("url")).alias("src"), F.lower(F.col("html").cast("string")).alias("html"))
    address = lambda u: host_of(F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u))
    links = F.filter(F.transform(F.regexp_extract_all("html", F.lit(_LINK), 1), address), lambda h: h.isNotNull())
    found = own.where("src is not null").select("src", links.alias("links"), F.regexp_extract_all("html", F.lit(_MENTION), 1).alias("words"))
    named = found.select("src", "links", F.explode(F.array_union("links", "words")).alias("dst")).where("src <> dst")
    counted = named.groupBy("src", "dst").agg(F.count("*").alias("n"), F.count_if(F.array_contains("links", F.col("dst"))).alias("linked"))
    crawled = own.where("src is not null").select(F.col("src").alias("dst")).distinct()
    hosts = crawled if seeds is None else crawled.unionByName(seeds.where("host is not null").select(F.col("host").alias("dst")))
    known = hosts.distinct().withColumn("known", F.lit(True))
    edges = counted.join(known, "dst", "left").select("src", "dst", F.when(F.col("known"), F.col("n")).otherwise(F.col("linked")).alias("n"))
    kin = crawled.select(F.col("dst").alias("host"), site_of(F.col("dst"), suffixes).alias("site")).where("host <> site")
    kin = kin.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("site").alias("dst")), F.struct(F.col("site").alias("src"), F.col("host").alias("dst")))).alias("e")).select("e.*", F.lit(1).cast("bigint").alias("n"))
    return edges.where("n > 0").unionByName(kin).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, trusted: DataFrame, blocked: DataFrame, work: str, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """``(host, trust, distrust)`` of every host that either reaches, from ``edges(src, dst, n)`` and seeds ``(host)``.

    Trust is PageRank personalised to the trusted seeds, along edges in proportion to n. Distrust is the same
    from the blocked seeds on reversed edges: who links to a blocked host is suspect. Mass at a host without edges goes back to the
    seeds: that only multiplies all scores of its kind, so it is done once, at the end. Scores are in units of a seed: those of a kind sum
    to the number of its seeds, so that they don't shrink as seeds or hosts grow in number. Null and repeated seeds count once or not at all.
    Without ``rounds`` there are as many as ``rounds_for`` says.
    """
    spark = edges.sparkSession
    rounds = rounds or rounds_for(damping)
    both = edges.select(F.lit(0).alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    degree = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    shares = both.join(degree, ["kind", "src"]).select("kind", "src", "dst", (F.lit(damping) * F.col("n") / F.col("total")).alias("share"))
    # laid out once by source, as each round's scores are, so that rounds don't shuffle edges
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = written(shares, f"{work}/shares").repartition(partitions, "kind", "src").persist(StorageLevel.MEMORY_AND_DISK)
    seeds = [table.select("host").where("host is not null").distinct().select(F.lit(kind).alias("kind"), "host", F.lit(1.0).alias("score")) for kind, table in enumerate((trusted, blocked))]
    first = written(seeds[0].unionByName(seeds[1]), f"{work}/seeds")
    start = first.select("kind", "host", (F.col("score") * (1 - damping)).alias("score"))
    scores, last = first, None
    for step in range(rounds):
        sent = scores.withColumnRenamed("host", "src").join(shares, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share")).alias("score"))
        scores = sent.unionByName(start).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if step % ROUNDS_PER_TABLE == ROUNDS_PER_TABLE - 1 or step == rounds - 1:
            path = f"{work}/scores{step}"
            scores = written(scores, path)
            if last:
                remove(spark, last)
            last = path
    shares.unpersist()
    whole = scores.groupBy("kind").agg(F.sum("score").alias("mass")).join(first.groupBy("kind").agg(F.count("*").alias("seeds")), "kind")
    scores = scores.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("score") / F.col("mass") * F.col("seeds")).alias("score"))  # two rows
    column = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    return scores.groupBy("host").agg(column(0).alias("trust"), column(1).alias("distrust"))


def mean_distrust(edges: DataFrame, trusted: DataFrame, blocked: DataFrame) -> float:
    """The mean distrust, in units of a seed, over all hosts of the graph and all seeds."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("host"))
    hosts = ends.unionByName(trusted.select("host")).unionByName(blocked.select("host")).where("host is not null").distinct().count()
    return blocked.where("host is not null").select("host").distinct().count() / max(1, hosts)


def filter_urls(pages: DataFrame, trusted: DataFrame, blocked: DataFrame, margin: float = MARGIN, damping: float = DAMPING, rounds: int | None = None, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """``(page_id, url, host, trust, distrust, is_kept)``, one row per row of ``pages``.

    A host is rejected if it is blocked itself, or if its distrust exceeds its trust by more than ``margin`` times the mean distrust of
    a host, which is the same test in a graph of any size; all pages of a host share its fate. The verdict takes scores as they are;
    the columns show them to 6 places, in units of a seed. A url without a host, null included, has null scores and is rejected. Null and
    repeated page ids pass through; an empty table gives no rows; empty seeds give zero scores. Extra columns are ignored.
    """
    work = shared_dir(pages.sparkSession)
    trusted, blocked = (written(table.select("host").where("host is not null").distinct(), f"{work}/{name}") for table, name in ((trusted, "trusted"), (blocked, "blocked")))
    edges = written(host_edges(pages, trusted.unionByName(blocked), suffixes), f"{work}/edges")
    least = margin * mean_distrust(edges, trusted, blocked)
    scores = propagate(edges, trusted, blocked, work, damping, rounds)
    listed = blocked.withColumn("blocked", F.lit(True))
    verdict = scores.join(listed, "host", "full_outer").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
    verdict = written(verdict, f"{work}/verdict")  # its true size decides how it is joined
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host")).join(verdict, "host", "left")
    named = F.col("host").isNotNull()
    trust, distrust = (F.when(named, F.round(F.coalesce(c, F.lit(0.0)), 6)) for c in ("trust", "distrust"))
    keep = named & ~F.coalesce("blocked", F.lit(False)) & (F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)) <= least)
    return rows.select("page_id", "url", "host", trust.alias("trust"), distrust.alias("distrust"), keep.alias("is_kept"))


def seed_sites(pages: DataFrame, predicate: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """``(host)``: the sites of the crawled hosts that a predicate over ``host`` picks."""
    return pages.select(site_of(host_of(F.col("url")), suffixes).alias("host")).where("host is not null").distinct().where(predicate)


def duckdb_sql(trusted: str, blocked: str, margin: float = MARGIN, damping: float = DAMPING, rounds: int | None = None, suffixes: tuple[str, ...] = ()) -> str:
    """The same in DuckDB's SQL, of seeds that ``seed_sites`` picks; ``trusted`` and ``blocked`` are predicates over ``host``."""
    rounds = rounds or rounds_for(damping)
    link = _LINK.replace("'", "''")
    steps = ["s0 as materialized (select kind, host, 1.0::double as score from seeds)"]
    for k in range(1, rounds + 1):
        steps.append(f"s{k} as materialized (select kind, host, sum(score) as score from (select e.kind, e.dst as host, s.score * e.share as score from s{k - 1} s join shares e on s.kind = e.kind and s.host = e.src union all select kind, host, 1 - {damping} from seeds) group by kind, host)")
    return f"""
with p as materialized (select row_number() over () as k, page_id, url, nullif(regexp_extract(lower(url), '{_HOST}', 1), '') as host, lower(html) as html from pages),
crawled as materialized (select distinct host, nullif(regexp_extract(host, '{_site(suffixes)}', 1), '') as site from p where host is not null),
sites as (select distinct site as host from crawled where site is not null),
seeds as materialized (select 0 as kind, host from sites where {trusted} union all select 1, host from sites where {blocked}),
links as (select distinct k, host as src, nullif(regexp_extract(case when u like '//%' then 'http:' || u else u end, '{_HOST}', 1), '') as dst from (select k, host, unnest(regexp_extract_all(html, '{link}', 1)) as u from p where host is not null)),
words as (select distinct k, host as src, unnest(regexp_extract_all(html, '{_MENTION}', 1)) as dst from p where host is not null),
named as (select k, src, dst from links where dst is not null union select k, src, dst from words where dst in (select host from crawled union all select host from seeds)),
kin as (select host as src, site as dst from crawled where host <> site union all select site, host from crawled where host <> site),
edges as materialized (select src, dst, count(*) as n from (select src, dst from named where src <> dst union all select src, dst from kin) group by src, dst),
both_ways as materialized (select 0 as kind, src, dst, n from edges union all select 1, dst, src, n from edges),
shares as materialized (select kind, src, dst, {damping} * n / sum(n) over (partition by kind, src) as share from both_ways),
{", ".join(steps)},
sizes as (select s.kind, count(*) as n, any_value(t.mass) as mass from seeds s join (select kind, sum(score) as mass from s{rounds} group by kind) t on s.kind = t.kind group by s.kind),
scores as materialized (select host, coalesce(sum(score / mass * n) filter (s.kind = 0), 0) as trust, coalesce(sum(score / mass * n) filter (s.kind = 1), 0) as distrust from s{rounds} s join sizes z on s.kind = z.kind group by host),
least as (select {margin} * (select count(*) from seeds where kind = 1) / greatest(1, (select count(*) from (select src from edges union select dst from edges union select host from seeds))) as least)
select p.page_id, p.url, p.host, case when p.host is not null then round(coalesce(trust, 0), 6) end as trust, case when p.host is not null then round(coalesce(distrust, 0), 6) end as distrust,
p.host is not null and p.host not in (select host from seeds where kind = 1) and coalesce(distrust, 0) - coalesce(trust, 0) <= least as is_kept
from p cross join least left join scores s on p.host = s.host"""
