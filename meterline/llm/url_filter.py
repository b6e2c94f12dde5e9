"""URL allow and block rules by a sort-merge range join, in SQL functions only.

A host is keyed by its labels in reverse ("www.example.com" becomes
"com.example.www."), so a rule host and all its subdomains are one interval
of keys; a path prefix likewise is one interval of paths.  Intervals of
either kind are nested or disjoint.

:func:`sweep` merges interval ends and probe keys in one sorted order and
keeps a stack: the running depth (+1 at a start, -1 at an end) and, per depth,
the last start seen.  The rows are range-partitioned; the depth and stack
with which a partition begins come from a table of one row per partition.

The sweep runs twice: over the distinct hosts (which rule hosts are active),
then over (rule host, path) for the distinct addresses under an active rule
host (the deepest active path rule).  Of the rules found the longest wins.
Hosts and addresses are made distinct first, so a host or page that holds a
third of the rows is one probe; joins back to rows are left to AQE, which
splits hot keys.

Defined cases: null addresses and those without "://" have empty host and
path and match no rule.  Rules with a null host or path are ignored, of equal
rules the one with the smallest verdict counts.  Extra columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterline.llm.common import fresh, lower_ascii, stored

RULE_SCHEMA = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _after(prefix: Column) -> Column:
    """Above every UTF-8 string that starts with ``prefix``, below the others."""
    return F.concat(prefix.cast("binary"), F.unhex(F.lit("FF")))


def sweep(rules: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (grp, key) with ``stack``, the (grp, prefix) rules whose
    prefix ``key`` starts with, outermost first; probes without any are left
    out.  Both inputs hold distinct rows; keys are strings."""
    rule = F.struct("grp", "prefix")
    key = F.col("prefix").cast("binary")
    no_rule = F.lit(None).cast("struct<grp:string,prefix:string>")
    events = rules.select(F.col("grp").alias("g"), key.alias("k"), F.lit(0).alias("kind"), F.lit(1).alias("step"), rule.alias("rule")) \
        .unionByName(rules.select(F.col("grp").alias("g"), _after(F.col("prefix")).alias("k"), F.lit(0).alias("kind"),
                                  F.lit(-1).alias("step"), rule.alias("rule"))) \
        .unionByName(probes.select(F.col("grp").alias("g"), F.col("key").cast("binary").alias("k"), F.lit(1).alias("kind"),
                                   F.lit(0).alias("step"), no_rule.alias("rule")))
    rows = stored(events.repartitionByRange("g", "k", "kind").withColumn("part", F.spark_partition_id()), "sweep")
    here = Window.partitionBy("part").orderBy("g", "k", "kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    zero = F.lit(0).cast("long")
    entry = rows.groupBy("part").agg(F.sum("step").alias("net")) \
        .select("part", F.coalesce(F.sum("net").over(before), zero).alias("base"))
    deep = rows.join(F.broadcast(entry), "part").withColumn("depth", F.col("base") + F.sum("step").over(here)).drop("base")
    deep = stored(deep, "sweep-depth")
    levels = deep.agg(F.max("depth")).first()[0] or 0  # nesting of the rules
    if not levels:
        return probes.where("false").withColumn("stack", F.array().cast("array<struct<grp:string,prefix:string>>"))

    def pushed(d: int) -> Column:
        return F.when((F.col("step") == 1) & (F.col("depth") == d), F.col("rule"))

    order = F.struct("g", "k", "kind")
    tails = deep.groupBy("part").agg(*[F.max_by(pushed(d), F.when(pushed(d).isNotNull(), order)).alias(f"t{d}")
                                       for d in range(1, levels + 1)])
    tails = tails.select("part", *[F.last(f"t{d}", True).over(before).alias(f"t{d}") for d in range(1, levels + 1)])
    stack = F.array(*[F.coalesce(F.last(pushed(d), True).over(here), F.col(f"t{d}")) for d in range(1, levels + 1)])
    done = deep.join(F.broadcast(tails), "part").withColumn("stack", stack)
    return done.where((F.col("kind") == 1) & (F.col("depth") > 0)).select(
        F.col("g").alias("grp"), F.col("k").cast("string").alias("key"),
        F.slice("stack", F.lit(1), F.col("depth").cast("int")).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow",
          names: tuple[str, str, str, str] = ("host", "path", "rule", "verdict")) -> DataFrame:
    """``pages`` with host, path, the rule that decides (host + path, null if
    none) and the verdict.  Columns of ``pages`` that have one of ``names``
    are replaced.  The longest rule wins; of equally long ones the longer host."""
    h, p = fresh(pages, "__host", "__path")
    rules = stored(rules.where("host is not null and path is not null").groupBy("host", "path")
                   .agg(F.min("verdict").alias("verdict")), "url-rules")
    rows = pages.withColumns({h: host_of(F.col(f"`{url_col}`")), p: path_of(F.col(f"`{url_col}`"))})
    addresses = stored(rows.where(F.col(h) != "").select(F.col(h).alias("h"), F.col(p).alias("p")).distinct(), "addresses")

    one = F.lit("")
    by_host = sweep(rules.select(one.alias("grp"), host_key(F.col("host")).alias("prefix")).distinct(),
                    addresses.select("h").distinct().select(one.alias("grp"), host_key(F.col("h")).alias("key")))
    active = by_host.select(F.col("key").alias("hk"), F.explode("stack.prefix").alias("rk"))
    under = addresses.withColumn("hk", host_key(F.col("h"))).join(active, "hk")
    probes = under.select(F.col("rk").alias("grp"), F.col("p").alias("key")).distinct()
    found = sweep(rules.select(host_key(F.col("host")).alias("grp"), F.col("path").alias("prefix")), probes)
    # the deepest active path rule; a stack left open by another host is none
    top = found.select("grp", "key", F.try_element_at("stack", F.lit(-1)).alias("r")).where(F.col("r.grp") == F.col("grp"))
    decided = top.select("grp", "key", F.col("r.prefix").alias("prefix")).join(
        rules.select(host_key(F.col("host")).alias("grp"), F.col("path").alias("prefix"), "host", "verdict"),
        ["grp", "prefix"])
    text = F.concat("host", "prefix")
    best = under.select("h", "p", F.col("rk").alias("grp"), F.col("p").alias("key")).join(decided, ["grp", "key"]) \
        .groupBy("h", "p").agg(F.max(F.struct(F.length(text).alias("n"), F.length("host").alias("m"),
                                              text.alias("rule"), F.col("verdict").alias("verdict"))).alias("b"))
    bh, bp, br, bv = fresh(rows, "__bh", "__bp", "__br", "__bv")
    best = stored(best.select(F.col("h").alias(bh), F.col("p").alias(bp), F.col("b.rule").alias(br),
                              F.col("b.verdict").alias(bv)), "url-verdicts")
    out = rows.join(best, (F.col(h) == F.col(bh)) & (F.col(p) == F.col(bp)), "left")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in names]
    return out.select(*kept, F.col(h).alias(names[0]), F.col(p).alias(names[1]), F.col(br).alias(names[2]),
                      F.coalesce(F.col(bv), F.lit(default)).alias(names[3]))
