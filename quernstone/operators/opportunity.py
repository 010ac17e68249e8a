"""Evidence to opportunity cards: independence groups, gates, value, ranking, audit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import documents, tables
from ..functions import rules
from ..functions.ids import score
from ..schemas import SPENDING_KINDS

#: Rows and values of a chunk of vectors, rows of one product, pairs decided at once.
CHUNK, CHUNK_VALUES, STRIP, PRODUCTS = 16_384, 1 << 22, 128, 32_768


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the non-root nodes of edges (a, b): the least node each is connected to.

    A node whose only link is to a lesser one is a leaf: it decides no root, so it takes its
    neighbour's at the end and only the other links go round.  Each round hooks every node to the
    least neighbour of its root's and halves paths; a written table ends each round, and the one
    before is deleted.  Rounds end when the count and a sum of hashes of the links stay as they are.
    """

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    whole = tables.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    ends = whole.select(F.col("a").alias("leaf"), F.col("b").alias("low")).unionByName(whole.select(F.col("b").alias("leaf"), F.lit(None).cast(whole.schema["b"].dataType).alias("low")))
    leaves = tables.written(ends.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.first("low", ignorenulls=True).alias("low")).where("n = 1 AND low IS NOT NULL").select("leaf", "low"), "leaves")
    links = tables.written(whole.join(leaves, F.col("a") == F.col("leaf"), "left_anti"), "links")
    tables.drop(whole)
    before = sign(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        new = tables.written(small.select("a", F.col("low").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("low").alias("b"))).where("a <> b").distinct(), "links")
        tables.drop(links)
        links, after = new, sign(new)
        if after == before:
            break
        before = after
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(leaves.join(roots, F.col("low") == F.col("node"), "left").select(F.col("leaf").alias("node"), F.coalesce("root", "low").alias("root")))


def independence_groups(evidence: DataFrame, id_col: str, keys: dict[str, Column], bursts: tuple[str, str, str] | None = None, more: DataFrame | None = None) -> DataFrame:
    """``evidence`` with group_id, the least id it is connected to: by a shared key, a burst, or a link of ``more``.

    A key may be an array, such as the events that a row speaks of: each of its values links.  A key
    links each row to its least row, so a frequent key gives as many links as it has rows.
    ``bursts`` (community, time, gap) is as in ``burst_links``; ``more`` has links (a, b), as from
    ``near_text_links``.  A row without an id has a null group; rows that share an id share a group.
    Columns may have any name; one called group_id is replaced.
    """
    links = [] if more is None else [more.select("a", "b")]
    # written once: keys may be costly, and each is read twice
    narrow = tables.written(evidence.select(F.col(id_col).alias("a"), *[column.alias(f"k{n}") for n, column in enumerate(keys.values())]).where("a IS NOT NULL"), "evidence-keys")
    for n in range(len(keys)):
        several = narrow.schema[f"k{n}"].dataType.typeName() == "array"
        rows = narrow.select("a", (F.explode(f"k{n}") if several else F.col(f"k{n}")).alias("k")).where("k IS NOT NULL")
        links.append(rows.join(rows.groupBy("k").agg(F.min("a").alias("b")), "k").select("a", "b"))
    if bursts:
        links.append(burst_links(evidence, id_col, *bursts))
    if not links:
        raise ValueError("nothing that could link rows")
    edges = links[0]
    for part in links[1:]:
        edges = edges.unionByName(part)
    roots = components(edges)
    others = [c for c in evidence.columns if c != "group_id"]
    held = evidence.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(id_col).alias("id"))
    return held.join(roots, F.col("id") == F.col("node"), "left").select("row.*", F.coalesce("root", "id").alias("group_id"))


def burst_links(rows: DataFrame, id_col: str, community: str, ts: str, gap: str) -> DataFrame:
    """Links (a, b) that connect the rows of a community that follow each other within ``gap``.

    Time is cut into buckets as long as the gap.  All rows of a bucket are connected, so each is
    linked to the bucket's least id; and a bucket is connected to the next one, if at all, by its
    last row and that one's first.  Buckets are aggregated before they are shuffled and meet by an
    equi-join, so no task holds a community.  A null community is none; rows without a time or id
    have no link.  ``gap`` is a positive interval of days or less, as text.
    """
    length = F.unix_micros(F.lit("1970-01-01").cast("timestamp") + F.expr(f"INTERVAL {gap}"))
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    known = rows.select(F.col(id_col).alias("a"), F.col(community).alias("community"), at.alias("at")).where("a IS NOT NULL AND community IS NOT NULL AND at IS NOT NULL")
    known = known.withColumn("bucket", F.floor((F.col("at") - F.pmod("at", length)) / length + 0.5).cast("bigint"))
    buckets = known.groupBy("community", "bucket").agg(F.min("a").alias("b"), F.min("at").alias("first"), F.max("at").alias("last"))
    within = known.join(buckets.select("community", "bucket", "b"), ["community", "bucket"]).select("a", "b")
    after = buckets.select("community", (F.col("bucket") - 1).alias("bucket"), F.col("b").alias("a"), "first")
    across = buckets.select("community", "bucket", "b", "last").join(after, ["community", "bucket"]).where(F.col("first") - F.col("last") <= length).select("a", "b")
    return within.unionByName(across)


def similarity_links(vectors: DataFrame, id_col: str, vector_col: str, least: float, spanning: bool = False, chunk: int = CHUNK) -> DataFrame:
    """All pairs (a, b), a > b, of vectors with a cosine of ``least`` or more, and their greatest cosine.

    With ``spanning`` only pairs that connect the same rows, without cosines: each row to the least
    it is connected to in its chunk, and between two chunks one pair for each two groups they join,
    so that a group of like vectors gives no square of links.  Chunks of vectors meet once each;
    single-precision products, whose error is bounded, leave the pairs that double precision
    decides.  A vector that is null, zero, or holds a null or non-finite component takes no part;
    vectors of different lengths have no link.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    id_type = vectors.schema[id_col].dataType.simpleString()
    value = "float" if kind == "float" else "double"
    x = F.transform(F.col(vector_col), lambda e: e.cast(value))
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(x, lambda e: e != 0)
    rows = vectors.where(sound & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), x.alias("v"))
    parts = max(1, -(-rows.count() // chunk))
    packed = rows.repartition(parts, F.xxhash64("id")).mapInArrow(_packed(chunk, least, spanning, value), f"width int, ids array<{id_type}>, matrix binary, roots binary")
    chunks = tables.written(packed.withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    # every chunk meets itself and, going round, half of the others of its width: one row a pair
    order = Window.partitionBy("width").orderBy("chunk")
    places = chunks.select("width", "chunk").withColumn("n", F.count("*").over(Window.partitionBy("width"))).withColumn("at", F.row_number().over(order) - 1)
    ahead = places.select("width", "n", F.col("chunk").alias("left"), "at", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 2).cast("int"))).alias("step"))
    ahead = ahead.where((F.col("step") * 2 < F.col("n")) | (F.col("at") * 2 < F.col("n"))).withColumn("at", (F.col("at") + F.col("step")) % F.col("n"))
    pairs = ahead.join(places.select("width", "at", F.col("chunk").alias("right")), ["width", "at"]).select("left", "right")
    right = chunks.select(F.col("chunk").alias("right"), F.col("ids").alias("ids_b"), F.col("matrix").alias("matrix_b"), F.col("roots").alias("roots_b"))
    left = chunks.select(F.col("chunk").alias("left"), "width", F.col("ids").alias("ids_a"), F.col("matrix").alias("matrix_a"), F.col("roots").alias("roots_a"))
    met = pairs.join(right, "right").join(left, "left").select("width", (F.col("left") == F.col("right")).alias("own"), "ids_a", "matrix_a", "roots_a", "ids_b", "matrix_b", "roots_b")
    found = met.mapInArrow(_linked(least, spanning, value), f"a {id_type}, b {id_type}, cosine double")
    return found.select("a", "b").distinct() if spanning else found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def _packed(rows: int, least: float, spanning: bool, kind: str):
    """Rows of a partition, by id, as matrices of at most ``rows`` rows and ``CHUNK_VALUES`` values; roots are places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def matrix(width: int) -> pa.RecordBatch:
            part = sorted(held.pop(width), key=lambda row: row[0])
            raw = np.array([v for _, v in part]).astype("<f4" if kind == "float" else "<f8").tobytes()
            root = np.arange(len(part))
            if spanning:
                x = _unit(raw, width, kind)
                for i, j, _ in _strips(x, x, least, True, True):
                    _hook(root, i, j)
            columns = [pa.array([width], pa.int32()), pa.array([[i for i, _ in part]], pa.list_(batch.column(0).type)), pa.array([raw], pa.binary()), pa.array([root.astype("<i4").tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["width", "ids", "matrix", "roots"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = held.setdefault(len(v), [])
                part.append((i, v.values.to_numpy()))
                if len(part) >= rows or len(part) * len(v) >= CHUNK_VALUES:
                    yield matrix(len(v))
        for width in list(held):
            yield matrix(width)

    return run


def _unit(raw: bytes, width: int, kind: str) -> np.ndarray:
    x = np.frombuffer(raw, "<f4" if kind == "float" else "<f8").reshape(-1, width).astype(float)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])  # squares of any finite value fit
    return x / np.sqrt((x * x).sum(1))[:, None]


def _strips(x: np.ndarray, y: np.ndarray, least: float, own: bool, sure_too: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Places (i, j) of the linked rows of x and y, with cosines unless ``sure_too``; in one chunk, i > j."""
    slack = (x.shape[1] + 8) * 2.0**-23  # twice the error of single-precision products of unit vectors
    x4, y4 = x.astype("f4"), y.astype("f4")
    for at in range(0, len(x), STRIP):
        near = x4[at : at + STRIP] @ y4.T
        i, j = np.nonzero(near >= least - slack)
        if own:
            i, j = i[i + at > j], j[i + at > j]
        sure = near[i, j] >= least + slack
        i = i + at
        if sure_too:
            yield i[sure], j[sure], None
            i, j = i[~sure], j[~sure]
        for k in range(0, len(i), PRODUCTS):
            a, b = i[k : k + PRODUCTS], j[k : k + PRODUCTS]
            cosine = (x[a] * y[b]).sum(1)
            on = cosine >= least
            yield a[on], b[on], cosine[on]


def _hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Connect places a and b in ``root``, every place's least connected one."""
    while True:
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
        if not len(a):
            return
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root[:] = root[root]


def _linked(least: float, spanning: bool, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, own, ids_a, raw_a, roots_a, ids_b, raw_b, roots_b in zip(*batch.columns):
                ids_a, ids_b = ids_a.values, ids_b.values
                left = np.frombuffer(roots_a.as_py(), "<i4").astype(np.int64)
                if own.as_py() and spanning:  # its groups are known
                    linked = np.flatnonzero(left != np.arange(len(left)))
                    yield _pairs(ids_a, linked, left[linked], np.zeros(len(linked)))
                    continue
                x, y = (_unit(raw.as_py(), width.as_py(), kind) for raw in (raw_a, raw_b))
                ids = pa.concat_arrays([ids_a, ids_b])
                order = np.asarray(pc.sort_indices(ids)).astype(np.int64)
                rank = np.empty(len(ids), np.int64)
                rank[order] = np.arange(len(ids))
                ids = ids.take(pa.array(order))
                if spanning:
                    place = np.concatenate([left, np.frombuffer(roots_b.as_py(), "<i4").astype(np.int64) + len(x)])
                    root = np.arange(len(ids))
                    for i, j, _ in _strips(x, y, least, False, True):
                        _hook(root, rank[place[i]], rank[place[j + len(x)]])
                    linked = np.flatnonzero(root != np.arange(len(root)))
                    yield _pairs(ids, linked, root[linked], np.zeros(len(linked)))
                    continue
                for i, j, cosine in _strips(x, y, least, own.as_py(), False):
                    a, b = rank[i], rank[j + len(x)]
                    yield _pairs(ids, np.maximum(a, b), np.minimum(a, b), cosine)

    return run


def _pairs(ids: pa.Array, a: np.ndarray, b: np.ndarray, cosine: np.ndarray) -> pa.RecordBatch:
    first, second = ids.take(pa.array(a)), ids.take(pa.array(b))
    found = pa.RecordBatch.from_arrays([first, second, pa.array(cosine)], names=["a", "b", "cosine"])
    return found.filter(pc.not_equal(first, second))  # rows of one id have no link


def evidence_gate(evidence: DataFrame, assessments: DataFrame, by: str, as_of: Column) -> DataFrame:
    """Whether each cluster's evidence suffices: authors, groups, recent rows, kinds, links, and the assessment of what speaks against it.

    ``assessments`` has the cluster and ``counter_status``; a cluster without one is not assessed, and
    so not backed.  Links are the distinct sources of what supports the cluster.
    """
    recent = (F.col("published_at") > as_of - F.expr("INTERVAL 90 DAYS")) & (F.col("published_at") <= as_of)
    n = evidence.groupBy(by).agg(
        F.count_distinct("author_hash").alias("n_authors"), F.count_distinct("evidence_group_id").alias("n_groups"), F.count_if(recent).alias("n_recent"), F.count_if(F.col("kind") == "loss").alias("n_loss"),
        F.count_if(F.col("kind").isin(*SPENDING_KINDS)).alias("n_money"), F.count_distinct(F.when(F.col("kind") != "counter", F.col("source_url"))).alias("n_links"),
    )
    n = n.join(assessments.select(by, "counter_status"), by, "left").withColumn("counter_status", F.coalesce("counter_status", F.lit("NOT_ASSESSED")))
    enough = [(F.col(c) >= least) for c, least in (("n_authors", 5), ("n_groups", 3), ("n_recent", 10), ("n_loss", 2), ("n_money", 2), ("n_links", 3))]
    backed = F.col("counter_status") == "NONE_CRITICAL"
    for x in enough:
        backed = backed & x
    return n.withColumn("evidence_backed", backed)


def actionability_gate(cards: DataFrame) -> DataFrame:
    """``cards`` (counts and verdicts) with actionable."""
    return cards.withColumn(
        "actionable",
        (F.col("n_alternatives") >= 1) & (F.col("n_solutions") >= 1) & (F.col("n_channels") >= 1) & (F.col("productizable") == "PRODUCTIZABLE") & (F.col("n_blockers") == 0) & (F.col("regulation") == "NONE_FOUND") & (F.col("n_gaps") >= 2),
    )


def review_value(money: Column, loss: Column, gap: Column, growth: Column, diversity: Column, penalty: Column) -> Column:
    """Weighted value from 0 to 100, less penalties."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), money * 0.30 + loss * 0.25 + gap * 0.20 + growth * 0.15 + diversity * 0.10 - penalty))


def growth(rows: DataFrame, by: str, ts: str, start: str, middle: str, end: str) -> DataFrame:
    """Growth between two periods: known, unknown without history, or excluded without any row."""
    g = rows.groupBy(by).agg(F.count_if((F.col(ts) >= start) & (F.col(ts) < middle)).alias("n_before"), F.count_if((F.col(ts) >= middle) & (F.col(ts) < end)).alias("n_after"))
    status = F.when(F.col("n_before") + F.col("n_after") == 0, "EXCLUDED").when(F.col("n_before") == 0, "UNKNOWN").otherwise("KNOWN")
    return g.withColumn("growth_status", status).withColumn("growth", F.when(status == "KNOWN", (F.col("n_after") - F.col("n_before")) / F.col("n_before")))


def audit_sample(cards: DataFrame, seed: int, top: int = 20, boundary: int = 5, random: int = 5, card: str = "card_id", value: str = "review_value", stratum: str = "stratum") -> DataFrame:
    """The best cards, those just below, and a seeded draw from the rest over their strata."""
    place = F.row_number().over(Window.orderBy(F.col(value).desc(), card))
    best = cards.withColumn("place", place).where(F.col("place") <= top + boundary).withColumn("reason", F.when(F.col("place") <= top, "top").otherwise("boundary"))
    rest = cards.join(best.select(card), card, "left_anti").withColumn("_draw", score(seed, "audit", F.col(stratum).cast("string"), F.col(card).cast("string")))
    rest = rest.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy("_draw", card))).where(F.col("_n") <= random)
    drawn = rest.orderBy("_n", "_draw", card).limit(random).withColumn("reason", F.lit("random")).withColumn("place", F.lit(None).cast("int"))
    return best.select(card, value, stratum, "place", "reason").unionByName(drawn.select(card, value, stratum, "place", "reason"))


def audit_metrics(audited: DataFrame) -> DataFrame:
    """Precision, boundary and merge error, median minutes, and whether all meet their targets."""
    n = audited.agg(
        F.avg(F.when(F.col("predicted"), F.col("correct").cast("int"))).alias("positive_precision"), F.avg(F.when(F.col("boundary"), (~F.col("correct")).cast("int"))).alias("boundary_error"), F.avg(F.when(F.col("merged"), (~F.col("correct")).cast("int"))).alias("merge_error"),
        F.median("minutes").alias("median_minutes"),
    )
    return n.withColumn("passed", F.coalesce((F.col("positive_precision") >= 0.8) & (F.col("boundary_error") <= 0.3) & (F.col("merge_error") <= 0.1) & (F.col("median_minutes") <= 5), F.lit(False)))


def card_errors(json: str) -> Column:
    """What is wrong with a card, a JSON column by name: its fields, its evidence by kind, and what its states ask for."""
    return rules.errors(json, documents.CARD)
