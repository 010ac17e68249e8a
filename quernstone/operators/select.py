"""Independent observations: greedy selection in order, under several keys at once.

A row is accepted when, for every key it has, fewer than the key's limit of earlier accepted rows
share it.  A rejected row registers nothing, so 'first of each key' windows are wrong.  The
selection runs in rounds, each a written table: a row is accepted when fewer than the limit of
earlier rows *still possible* share each of its keys, and rejected once that many earlier
*accepted* rows do.  The earliest undecided row is decided in every round, so it ends, and any
number of rows of one key costs no single task: ranks come from windows with a group limit, which
every task applies before the shuffle.  A round reads the rows that are still undecided, with their
keys in an array, and the keys of accepted rows, at most the limit of each; what is decided moves no
more.  Once no more than ``FOLD_ROWS`` keys of undecided rows are left, a fold in order settles them
in one task; it also reads at most the limit of accepted rows for each of those keys.  Verdicts and
reasons come from the accepted rows' keys in one last pass.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import tables


#: Keys of undecided rows that one task settles.
FOLD_ROWS = 200_000
#: Rows of a written table that are sent to every task.
SENT = 1_000_000


@dataclass(frozen=True)
class Key:
    """Rows that share ``column`` (a string, or an array of them) conflict beyond ``limit``."""

    reason: str
    column: Column
    limit: int = 1


#: A record's own keys, in the order in which they are reported.
def observation_keys(max_per_author: int = 2) -> list[Key]:
    return [
        Key("duplicate_document_id", F.col("document_id")),
        Key("duplicate_source_url", F.col("source_url")),
        Key("duplicate_text", F.col("text_fingerprint")),
        Key("duplicate_thread", F.concat_ws("\0", "source", "thread_id")),
        Key("author_quota_exceeded", F.concat_ws("\0", "source", "author_hash"), max_per_author),
    ]


def notice_keys(max_per_buyer: int = 2) -> list[Key]:
    return [Key("duplicate_notice", F.col("notice_id")), Key("duplicate_procedure", F.col("procedure_id")), Key("buyer_limit_reached", F.col("buyer_ids"), max_per_buyer)]


def select(rows: DataFrame, order: Column, keys: list[Key], quota: int | None = None, before: DataFrame | None = None, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """``rows`` with ``accepted`` and ``reason``.

    ``order`` must tell all rows apart.  With a ``quota`` the rows after the one that fills it are
    unprocessed: accepted is null.  ``before`` holds (key, ord) of rows accepted earlier.
    """
    spark = rows.sparkSession
    placed = tables.written(rows.withColumn("_ord", order.cast("bigint")), "selection")
    keyed = placed.select("_ord", F.concat(*[_held(placed, n, key) for n, key in enumerate(keys)]).alias("_keys")).where(F.size("_keys") > 0)
    top = max(k.limit for k in keys)
    prior = before if before is not None else spark.createDataFrame([], "rule int, limit int, key string, _ord bigint")
    left, taken = keyed, prior.select("rule", "limit", "key", "_ord")
    while True:
        n = left.agg(F.coalesce(F.sum(F.size("_keys")), F.lit(0))).first()[0]
        if not n:
            break
        folded = n <= fold_rows
        accepted = tables.written(_folded(_keys_of(left), taken) if folded else _ready(left, taken, top), "selection-accepted")
        new = tables.written(taken.unionByName(_keys_of(_joined(left, accepted, ["_ord"], "left_semi")).drop("n_keys")), "selection-taken")
        tables.drop(taken)
        taken = new
        if folded:
            break
        decided = accepted.unionByName(_out(left, taken, top).select("_ord").distinct())
        rest = tables.written(left.join(decided, "_ord", "left_anti"), "selection-left")
        for done in (left, accepted):
            tables.drop(done)
        left = rest
    # every rejected row, and no accepted one, comes after the row that filled one of its keys
    broken = tables.written(_out(keyed, taken, top).groupBy("_ord").agg(F.min("rule").alias("rule")), "selection-broken")
    tables.drop(taken)
    cut = None
    if quota is not None:
        last = placed.select("_ord").join(broken, "_ord", "left_anti").orderBy("_ord").limit(quota).agg(F.max("_ord").alias("cut"), F.count(F.lit(1)).alias("n")).first()
        cut = last["cut"] if last["n"] == quota else None
    reasons = F.element_at(F.array(*[F.lit(k.reason) for k in keys]), F.col("rule") + 1)
    result = placed.join(broken.select("_ord", reasons.alias("reason")), "_ord", "left").withColumn("accepted", F.col("reason").isNull())
    if cut is not None:
        late = F.col("_ord") > cut
        result = result.withColumn("accepted", F.when(~late, F.col("accepted"))).withColumn("reason", F.when(~late, F.col("reason")))
    return result.select(*[c for c in placed.columns if c != "_ord"], "reason", "accepted")


def _joined(rows: DataFrame, others: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join; a written table of few rows is sent to every task."""
    return rows.join(F.broadcast(others) if others.count() <= SENT else others, on, how)


def _keys_of(left: DataFrame) -> DataFrame:
    return left.select("_ord", F.size("_keys").alias("n_keys"), F.inline("_keys"))


def _ranked(held: DataFrame, top: int) -> DataFrame:
    """The first rows of each key, up to its limit, with their ranks."""
    rank = F.row_number().over(Window.partitionBy("rule", "key").orderBy("_ord"))
    return held.withColumn("rank", rank).where((F.col("rank") <= top) & (F.col("rank") <= F.col("limit")))


def _ready(left: DataFrame, taken: DataFrame, top: int) -> DataFrame:
    """(_ord) of the undecided rows that are among the first possible ones of each of their keys."""
    early = _ranked(_keys_of(left).unionByName(taken.withColumn("n_keys", F.lit(0))), top).where("n_keys > 0")
    return early.groupBy("_ord", "n_keys").agg(F.count(F.lit(1)).alias("n_early")).where("n_early = n_keys").select("_ord")


def _out(left: DataFrame, taken: DataFrame, top: int) -> DataFrame:
    """(_ord, rule) of rows that come after the one that filled a key of theirs."""
    full = tables.written(_ranked(taken, top).where(F.col("rank") == F.col("limit")).select("rule", "key", F.col("_ord").alias("full_at")), "selection-full")
    return _joined(_keys_of(left).select("_ord", "rule", "key"), full, ["rule", "key"], "inner").where("full_at < _ord").select("_ord", "rule")


def _folded(undecided: DataFrame, taken: DataFrame) -> DataFrame:
    """(_ord) of the undecided rows that a fold in order accepts."""
    relevant = taken.join(undecided.select("rule", "key").distinct(), ["rule", "key"], "left_semi").withColumn("state", F.lit(1))
    rows = undecided.drop("n_keys").withColumn("state", F.lit(0)).unionByName(relevant).withColumn("_all", F.lit(0))

    def fold(part):
        counts: dict[tuple, int] = {}
        orders = []
        part = part.sort_values(["_ord", "state"], kind="stable")
        for (ord_, decided), group in itertools.groupby(zip(part["_ord"], part["state"], part["rule"], part["limit"], part["key"]), lambda r: r[:2]):
            held = [((rule, key), limit) for _, _, rule, limit, key in group]
            accept = bool(decided) or all(counts.get(k, 0) < limit for k, limit in held)
            if accept:
                for k, _ in held:
                    counts[k] = counts.get(k, 0) + 1
                if not decided:
                    orders.append(ord_)
        return pd.DataFrame({"_ord": orders})

    return rows.groupBy("_all").applyInPandas(fold, "_ord bigint")


def _held(rows: DataFrame, n: int, key: Key) -> Column:
    """Array of (rule, limit, key): the distinct values that a row holds of one key."""
    several = rows.select(key.column.alias("x")).schema[0].dataType.typeName() == "array"
    whole = F.coalesce(key.column, F.array().cast("array<string>")) if several else F.array(key.column)
    values = F.array_distinct(F.filter(whole, lambda v: v.isNotNull()))
    return F.transform(values, lambda v: F.struct(F.lit(n).alias("rule"), F.lit(key.limit).alias("limit"), v.cast("string").alias("key")))


def accepted_keys(selected: DataFrame, keys: list[Key]) -> DataFrame:
    """Keys that accepted rows hold, as ``before`` of a later selection: they come before all its rows."""
    parts = [_held(selected, n, key) for n, key in enumerate(keys)]
    return selected.where("accepted").select(F.inline(F.concat(*parts))).withColumn("_ord", F.lit(-(2**62)).cast("bigint"))


def select_strata(rows: DataFrame, stratum: str, quotas: dict[str, int], order: Column, keys: list[Key]) -> DataFrame:
    """Strata one after another, each with its quota, under keys they share.

    A row after a stratum's cut is unprocessed and so blocks nothing later.
    """
    out, before = None, None
    for name, quota in quotas.items():
        part = tables.written(select(rows.where(F.col(stratum) == name), order, keys, quota, before), "stratum")
        new = accepted_keys(part, keys)
        before = new if before is None else before.unionByName(new)
        out = part if out is None else out.unionByName(part)
    return out


def segment_counters(selected: DataFrame, *by: str) -> DataFrame:
    """fetched, processed, accepted and rejected of each segment."""
    return selected.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fetched"), F.count("accepted").alias("processed"), F.count_if(F.coalesce("accepted", F.lit(False))).alias("accepted"), F.count_if(~F.coalesce("accepted", F.lit(True))).alias("rejected")
    )
