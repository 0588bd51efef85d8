"""URL filter: rules first; for all other pages a list of canonical URLs, of which a blocked Bloom filter passes the possible hits to an exact join.

The filter is a table of blocks of 512 bits, of which there are enough for 16 bits a URL. A page looks into one block. Up to ``MOST_BLOCKS`` blocks (4 MB) the filter is broadcast;
for longer lists it is joined by block, so it never fills up.
Only columns and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswright.session import written

#: ``(host, path, verdict)``; the longest that fits decides.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
MOST_BLOCKS = 1 << 16
PROBES = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"://([^/?#]*)([^?#]*)"
_TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without user, usual port and ``www.``, path without a closing slash, sorted query without tracking parameters; null for what has no ``://``. Percent escapes
    are left as they are."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(_TRACKING)))
    asked = F.array_join(kept, "&")
    site = F.regexp_replace(host(url), "^[^@]*@", "")
    port = F.when(url.rlike("^[Hh][Tt][Tt][Pp][Ss]:"), ":443").otherwise(":80")
    site = F.when(F.endswith(site, port), F.substring(site, F.lit(1), F.length(site) - F.length(port))).otherwise(site)
    site = F.regexp_replace(site, r"^www\.", "")
    return F.when(F.contains(url, F.lit("://")), F.concat(site, F.regexp_replace(path(url), "/+$", ""), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise("")))


def _rule(rules: tuple, of: Column, at: Column) -> tuple[Column, Column]:
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for site, start, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):
        fits = ((of == site) | of.endswith("." + site)) & at.startswith(start)
        name, verdict = F.when(fits, site + start).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _bits(url: Column) -> Column:
    """Which ``(word, bit)`` pairs of its block a URL sets."""
    h = F.xxhash64(url, F.lit(1))
    return F.array(*[F.struct(F.shiftrightunsigned(h, 9 * i).bitwiseAND(7).cast("int").alias("word"), F.shiftrightunsigned(h, 9 * i + 3).bitwiseAND(63).cast("int").alias("bit")) for i in range(PROBES)])


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """``block, words``: a row for each block with members, of ``listed.canonical``."""
    one = listed.select(F.pmod(F.xxhash64("canonical"), F.lit(blocks)).alias("block"), F.explode(_bits(F.col("canonical"))).alias("at")).select("block", "at.*")
    words = [F.bit_or(F.when(F.col("word") == w, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(8)]
    return one.groupBy("block").agg(*words).select("block", F.array(*[f"w{w}" for w in range(8)]).alias("words"))


def judged(pages: DataFrame, listed: DataFrame, rules: tuple = RULES) -> DataFrame:
    """One row per page row: ``page_id, host, path, rule, verdict, canonical, listed``.

    ``listed`` has the URLs to block in its column ``url``; they are made canonical here. ``rules`` are a short fixed list (they become one CASE);
    they go before the list. A page that no rule fits is blocked if its canonical URL is on the list, else allowed. Null URLs and those without
    ``://`` have an empty host and path, fit no rule, are on no list and are allowed. Repeated pages and list entries, null ids, an empty list and extra
    columns don't matter; no pages give no rows. Long URLs are judged whole.
    """
    url = F.col("url")
    pages = pages.select("page_id", "url").select("page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical"))
    name, verdict = _rule(rules, F.col("host"), F.col("path"))
    pages = pages.withColumn("rule", name).withColumn("ruled", verdict)
    listed = written(listed.select(canonical(url).alias("canonical")).where("canonical IS NOT NULL").distinct(), "listed")
    blocks = 64
    n = listed.count()
    while blocks * 512 < 16 * n:
        blocks *= 2
    filter_ = bloom_blocks(listed, blocks)
    if blocks <= MOST_BLOCKS:
        filter_ = F.broadcast(filter_)
    probed = pages.withColumn("block", F.pmod(F.xxhash64("canonical"), F.lit(blocks))).join(filter_, "block", "left")
    hit = F.forall(_bits(F.col("canonical")), lambda p: F.expr("words")[p["word"]].isNotNull() & (F.call_function("shiftrightunsigned", F.expr("words")[p["word"]], p["bit"]).bitwiseAND(1) == 1))
    probed = probed.withColumn("possible", F.col("canonical").isNotNull() & F.col("ruled").isNull() & F.coalesce(hit, F.lit(False))).drop("block", "words")
    sure = listed.withColumn("listed", F.lit(True))
    out = probed.where("possible").join(sure, "canonical", "left").unionByName(probed.where("NOT possible").withColumn("listed", F.lit(None).cast("boolean")))
    on_list = F.coalesce("listed", F.lit(False))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(on_list, "block").otherwise("allow")).alias("verdict"), "canonical", on_list.alias("listed"))


def repeated(pages: DataFrame) -> DataFrame:
    """A list for ``judged``: the URLs of which the crawl holds several rows under one canonical form (such addresses are mostly feeds and traps)."""
    return pages.select(canonical(F.col("url")).alias("c")).where("c IS NOT NULL").groupBy("c").count().where("count > 1").select(F.concat(F.lit("http://"), "c").alias("url"))
