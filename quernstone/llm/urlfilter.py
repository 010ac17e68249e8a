"""URL filters: host-suffix and path-prefix expressions met by hash, in DataFrame functions alone.

A rule is a host, a start of a path and a verdict.  It fits its host and all subdomains where the
URL's path starts with the rule's.  Each URL is expanded into its expressions, a suffix of the host
(whole labels) before a start of the path, and these join the rules on the first hexadecimal digits
of their SHA-256.  What meets is confirmed by the full digest, and of the rules that are left the
longest wins: by code points of host and path, then of the host.  A verdict is ``allow`` or
``block``; of equal rules with opposite ones ``block`` wins.  A URL that no rule fits gets the
verdict ``otherwise``.

Only the shapes that rules have are expanded: pairs of a number of labels and a length of path.
Any expression of another shape can't equal a rule, so none is lost, and a URL has as many
expressions as the rules have shapes that fit into it, whatever their number.

Up to ``BROADCAST_RULES`` rules, counted first, are sent to the URLs.  More meet them by a shuffle:
first only rules whose digits occur among the URLs' distinct ones stay; where these are still too
many, each takes a copy for each of ``SALTS`` groups of rows, so that the expressions of a host with
a third of all rows are dealt to as many tasks.  Both ways a row's matches are reduced to the
longest before the shuffle that brings them together, which moves hosts and paths only.

Cases: a null URL or one without ``://`` has an empty host and path, which no rule fits.  The host
keeps a port and a user name as they stand; of its letters A to Z alone become small.  URLs of any
length are judged whole.  Repeated rows are judged one by one and null ids are kept.  Rules with a
null or empty host, a null path or another verdict fit nothing; repeated rules count once.  An
empty table gives an empty result, and without rules all get ``otherwise``.  Columns other than the
id and the URL are not read.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits that expressions and rules are joined on.
DIGITS = 8
#: Rules that are sent to every task, and copies of each where there are more.
BROADCAST_RULES, SALTS = 100_000, 16
ALLOW, BLOCK = "allow", "block"


def host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z made small."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_rows(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows of a list of rules."""
    rows = json.dumps([{"host": h, "path": p, "verdict": v} for h, p, v in rules])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<host:string,path:string,verdict:string>>")))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = ALLOW, id_col: str = "page_id", url_col: str = "url", broadcast_rules: int = BROADCAST_RULES, salts: int = SALTS) -> DataFrame:
    """page_id, host, path, rule (host and path of the one that decides, or null) and verdict of every row."""
    usable = rules.where((F.length("host") > 0) & F.col("path").isNotNull() & F.col("verdict").isin(ALLOW, BLOCK)).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels, chars = F.size(F.split("host", r"\.")), F.length("path")
    n, shapes = usable.agg(F.count(F.lit(1)), F.collect_set(F.struct(labels.alias("labels"), chars.alias("chars")))).first()
    whole = F.sha2(F.concat_ws("\0", "host", "path"), 256)
    # one number, whose order is precedence; with the URL it says which rule it is
    place = (F.length("host") + F.length("path")) * F.lit(1 << 32) + F.length("host") * 2 + (F.col("verdict") == BLOCK).cast("int")
    known = usable.select(F.substring(whole, 1, DIGITS).alias("digits"), whole.alias("known_digest"), place.alias("known"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("row", F.monotonically_increasing_id())
    spread = rows.select("*", F.explode_outer(expressions(F.col("host"), F.col("path"), [tuple(s) for s in shapes])).alias("expression"))
    spread = spread.withColumn("digest", F.sha2("expression", 256)).withColumn("digits", F.substring("digest", 1, DIGITS)).drop("expression")
    on = ["digits"]
    if n > broadcast_rules:
        known = known.join(spread.select("digits").distinct(), "digits", "left_semi")
        known = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        spread = spread.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
        on = ["digits", "salt"]
    else:
        known = F.broadcast(known)
    met = spread.join(known, on, "left")
    confirmed = F.when(F.col("digest") == F.col("known_digest"), F.col("known"))
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(confirmed).alias("best"))
    total, own = F.shiftright("best", 32).cast("int"), F.shiftright(F.col("best").bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int")
    rule = F.concat(F.substring("host", F.length("host") - own + 1, own), F.substring("path", F.lit(1), total - own))
    verdict = F.when(F.col("best").isNull(), otherwise).when(F.col("best") % 2 == 1, BLOCK).otherwise(ALLOW)
    return best.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Array of the expressions of a URL that have one of ``shapes``, (labels, characters of path)."""
    some = F.from_json(F.lit(json.dumps([{"labels": a, "chars": b} for a, b in sorted(shapes)])), "array<struct<labels:int,chars:int>>")
    labels = F.split(host, r"\.")
    fits = F.filter(some, lambda s: (s["labels"] <= F.size(labels)) & (s["chars"] <= F.length(path)))
    return F.transform(fits, lambda s: F.concat_ws("\0", F.array_join(F.slice(labels, -s["labels"], s["labels"]), "."), F.substring(path, F.lit(1), s["chars"])))
