"""Join shapes: lookups, diffs between versions, matching by containment, overlap and nearness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_by_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the last in ``order``, as a map built row by row would keep it.

    One aggregation that combines map-side, so a hot key sends one row per task. Null keys form a key.
    """
    others = [c for c in rows.columns if c not in keys]
    latest = F.max_by(F.struct(*others), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return rows.groupBy(*keys).agg(latest.alias("row")).select(*keys, *[F.col("row")[c].alias(c) for c in others])


def look_up(rows: DataFrame, key: Column, dimension: DataFrame, dimension_key: str, prefix: str) -> DataFrame:
    """Left outer lookup in a dimension with unique keys; its columns get ``prefix``, so names can't clash.

    Spark broadcasts the dimension if its size allows it, otherwise both sides are shuffled on the key.
    """
    named = dimension.select(*[F.col(c).alias(prefix + c) for c in dimension.columns])
    return rows.join(named, key == F.col(prefix + dimension_key), "left")


def identified(rows: DataFrame, key: str, answers: DataFrame, answer_key: str, identity: str, localized: DataFrame | None = None, name: str = "title") -> DataFrame:
    """Answers of a lookup service joined to the rows that asked, checked for identity.

    ``answers`` has the id asked for in ``answer_key`` and the id that the answer itself states in ``identity``; an answer about
    somebody else counts as none. ``localized`` has the same columns in another language; its ``name`` comes as local_name, null
    where it states another id. One row for each of ``rows``; of repeated answers the least name counts.
    """
    def told(df: DataFrame, out: str) -> DataFrame:
        good = df.where(F.col(answer_key).isNotNull() & F.col(answer_key).eqNullSafe(F.col(identity)))
        return good.groupBy(F.col(answer_key).alias("_asked")).agg(F.min(name).alias(out))

    met = rows.join(told(answers, "name"), F.col(key) == F.col("_asked"), "left").drop("_asked")
    if localized is None:
        return met
    return met.join(told(localized, "local_name"), F.col(key) == F.col("_asked"), "left").drop("_asked")


def flag_known(rows: DataFrame, key: str, known: DataFrame, known_key: str, flag: str) -> DataFrame:
    """Rows with a boolean that tells whether their key is among ``known``; no row is multiplied."""
    keys = known.select(F.col(known_key).alias("_known")).where("_known is not null").distinct()
    return rows.join(keys, F.col(key) == F.col("_known"), "left").withColumn(flag, F.col("_known").isNotNull()).drop("_known")


def changed_fields(left: str, right: str, fields: Sequence[str]) -> Column:
    """Sorted names of the fields in which the structs ``left`` and ``right`` differ; null is a value."""
    return F.array_sort(F.array_compact(F.array(*[
        F.when(~F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")), F.lit(f)) for f in fields
    ])))


def version_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Full outer diff of two versions with unique keys: key, change, changed_fields.

    Both versions are tagged, united and grouped by key, which needs one shuffle and no join.
    """
    tagged = old.select(F.col(key).alias("key"), F.struct(*fields).alias("old"), F.lit(None).cast(_struct(new, fields)).alias("new")).unionByName(
        new.select(F.col(key).alias("key"), F.lit(None).cast(_struct(old, fields)).alias("old"), F.struct(*fields).alias("new"))
    )
    both = tagged.groupBy("key").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    names = F.when(change == "changed", changed_fields("old", "new", fields)).otherwise(F.array().cast("array<string>"))
    return both.select("key", change.alias("change"), names.alias("changed_fields")).where("change != 'changed' or size(changed_fields) > 0")


def _struct(df: DataFrame, fields: Sequence[str]):
    return df.select(F.struct(*fields).alias("s")).schema["s"].dataType


def match_all(left: DataFrame, right: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """Groups of ``left`` with the number of rows that have no null-safe equal in ``right``, and a verdict."""
    found = right.select(*[F.col(k).alias(f"r_{k}") for k in keys]).distinct().withColumn("hit", F.lit(1))
    on = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
    return (
        left.join(found, on, "left").groupBy(group)
        .agg(F.count_if(F.col("hit").isNull()).alias("unmatched"), F.count("*").alias("claims"))
        .withColumn("accepted", F.col("unmatched") == 0)
    )


def nearest_before(events: DataFrame, key: str, at: Column, is_base: Column, is_probe: Column, id_column: str, within: int, block: int) -> DataFrame:
    """As-of join: for each probe the latest base event of the same key at or before it, within ``within`` units.

    Returns probe id and base id (null if there is none). Time is cut into blocks of ``block`` units, at
    least ``within``; a base event is also sent to the next block, so a probe finds its match in its own
    block and a hot key is spread over as many groups as it has blocks.
    """
    if block < within:
        raise ValueError("a block must be at least as long as the tolerance")
    slim = events.select(F.col(key).alias("key"), at.alias("at"), F.col(id_column).alias("id"), is_base.alias("base"), is_probe.alias("probe"))
    here = F.floor(F.col("at") / block)
    blocks = F.when(F.col("base"), F.array(here, here + 1)).otherwise(F.array(here))
    sent = slim.where("(base or probe) and key is not null").withColumn("here", here).withColumn("block", F.explode(blocks))
    order = Window.partitionBy("key", "block").orderBy("at", F.col("probe").cast("int"), "id")
    base = F.when(F.col("base"), F.struct("at", "id"))
    seen = F.last(base, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        sent.withColumn("seen", seen).where("probe and block = here")
        .select(F.col("id").alias("probe_id"), F.when(F.col("at") - F.col("seen.at") <= within, F.col("seen.id")).alias("base_id"))
    )


def overlap_score(a: Column, b: Column) -> Column:
    """3 if all words of ``a`` are in ``b``, 2 from half of them on (rounded up), 1 for any, else 0."""
    shared, needed = F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a))
    return (
        F.when((needed > 0) & (shared == needed), 3)
        .when((needed > 0) & (shared >= F.greatest(F.lit(1), F.floor((needed + 1) / 2))), 2)
        .when(shared > 0, 1).otherwise(0)
    )


def shared_words(left: DataFrame, left_key: Sequence[str], left_words: Column, right: DataFrame, right_key: Sequence[str], right_words: Column) -> DataFrame:
    """Pairs that share a word, with the score of :func:`overlap_score` of the left one's words in the right one's.

    A join on the words and a count for each pair: what shares no word is never compared. Words must be distinct
    within a row. Rows without words give no pairs.
    """
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left_key], F.size(left_words).alias("_n"), F.explode(left_words).alias("_w"))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right_key], F.explode(right_words).alias("_w"))
    keys = [*(f"l_{c}" for c in left_key), *(f"r_{c}" for c in right_key)]
    counted = a.join(b, "_w").groupBy(*keys, "_n").agg(F.count("*").alias("_shared"))
    score = F.when(F.col("_shared") == F.col("_n"), 3).when(F.col("_shared") >= F.greatest(F.lit(1), F.floor((F.col("_n") + 1) / 2)), 2).otherwise(1)
    return counted.select(*[F.col(f"l_{c}").alias(c) for c in left_key], *[F.col(f"r_{c}").alias(c) for c in right_key], score.alias("score"))


def contained(rows: DataFrame, text: str, phrases: DataFrame, phrase: str, most_characters: int = 16_000_000) -> DataFrame:
    """The rows' other columns with ``phrase`` for each distinct phrase that their text contains.

    One pass of a multi-pattern automaton over each text finds all phrases at once, whatever their number. Phrases are
    cut by hash into as many parts of about ``most_characters`` as they need, each of them an automaton of bounded size that goes to the
    executors; usually that is one. Null texts and null or empty phrases give nothing.
    """
    kept = phrases.select(F.col(phrase).alias("p")).where("p is not null and p != ''").distinct()
    size = kept.agg(F.coalesce(F.sum(F.length("p")), F.lit(0))).first()[0]
    parts = int(size // most_characters) + 1
    others = [c for c in rows.columns if c != text]
    slim = rows.where(F.col(text).isNotNull()).select(*others, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in others), "phrase string"])
    out = None
    for part in range(parts):
        some = kept.where(F.pmod(F.xxhash64("p"), F.lit(parts)) == part).toPandas()["p"].tolist()
        found = slim.mapInArrow(_finder(rows.sparkSession.sparkContext.broadcast(some), len(others)), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _finder(shared, others: int):
    def run(batches):
        import ahocorasick
        import pyarrow as pa

        found = ahocorasick.Automaton()
        for p in shared.value:
            found.add_word(p, p)
        if shared.value:
            found.make_automaton()
        for batch in batches:
            at, hits = [], []
            for i, t in enumerate(batch.column(others).to_pylist() if shared.value else ()):
                here = {p for _, p in found.iter(t)}
                at += [i] * len(here)
                hits += here
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:others], pa.array(hits, pa.string())], names=[*batch.schema.names[:others], "phrase"])

    return run


def keep_existing(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Insert-or-ignore: incoming rows whose key is new, beside all rows of the table."""
    return table.unionByName(incoming.join(table.select(key).distinct(), key, "left_anti"))


def replace_existing(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Insert-or-replace: rows of the table whose key doesn't come in, beside all incoming rows."""
    return table.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)
