"""URL rules: normal form, blocked extensions, robots rules, percent encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: endings of addresses that are not crawled
EXTENSIONS = (
    ".gif .gifv .mp4 .webm .mkv .flv .vob .ogv .ogg .avi .mts .m2ts .ts .mov .qt .wmv .yuv .rm .rmvb .asf .amv .m4p .m4v .mpg .mp2 .mpeg .mpe .mpv .m2v .svi .3gp .3g2 .mxf .roq .nsv .f4v "
    ".png .jpg .webp .tiff .psd .raw .bmp .heif .indd .jp2 .svg .ai .eps .pdf .ppt"
).split()


def normalize(url: Column) -> Column:
    """Runs of slashes become one; the scheme becomes http; one slash at the end goes; lower case. Null stays null."""
    single = F.regexp_replace(url, "/{2,}", "/")
    bare = F.regexp_replace(single, "^https?:/", "")
    return F.lower(F.regexp_replace(F.concat(F.lit("http://"), bare), "/$", ""))


def is_blocked(url: Column) -> Column:
    """Whether the address ends, by case, with a blocked extension."""
    return url.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in EXTENSIONS) + ")$")


def path(url: Column) -> Column:
    """The path of an absolute address; empty if it has none."""
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def root(url: Column) -> Column:
    """Scheme and host."""
    return F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(root, prefix) that ``robots`` (root, text) forbids.

    Of the groups that begin with a user-agent line, the first one for exactly ``agent``
    counts, up to the next user-agent line. Comments and spaces go, case is folded, one
    slash at the end of a value goes, empty values forbid nothing.
    """
    lines = robots.select("root", F.posexplode(F.split("text", "\r?\n|\r")).alias("at", "line"))
    lines = lines.withColumn("line", F.lower(F.replace(F.regexp_replace("line", "#.*$", ""), F.lit(" "), F.lit(""))))
    agents = lines.where("line like 'user-agent:%'").select("root", "at", F.substring("line", 12, 1000).alias("agent"))
    begin = agents.where(F.col("agent") == agent).groupBy("root").agg(F.min("at").alias("begin"))
    end = agents.join(begin, "root").where("at > begin").groupBy("root").agg(F.min("at").alias("end"))
    group = lines.join(begin, "root").join(end, "root", "left").where("at > begin and (end is null or at < end) and line like 'disallow:%'")
    value = F.regexp_replace(F.substring("line", 10, 10_000), "/$", "")
    return group.where(F.length("line") > 9).select("root", F.concat("root", value).alias("prefix")).distinct()


def allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The addresses that no rule of their own root forbids: an anti join on the root, so hosts meet their rules only."""
    rules = rules.select(F.col("root").alias("_root"), F.col("prefix").alias("_prefix"))
    return urls.join(rules, (root(urls[url]) == F.col("_root")) & urls[url].startswith(F.col("_prefix")), "left_anti")


def encode(value: Column) -> Column:
    return F.url_encode(value)
