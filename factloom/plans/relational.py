"""Queries for projections, joins, sets, windows and orderings over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import joins as J
from factloom.operators import ordering as O
from factloom.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
SELECT o_orderkey, o_orderdate, c_name, n_name, r_name, coalesce(nullif(trim(c_mktsegment), ''), 'NONE') AS segment
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def watchlist_left_joins(spark: SparkSession, d: str) -> DataFrame:
    """Multi-way left outer lookup."""
    out = J.look_up(table(spark, d, "orders"), F.col("o_custkey"), table(spark, d, "customer"), "c_custkey", "")
    out = J.look_up(out, F.col("c_nationkey"), table(spark, d, "nation"), "n_nationkey", "")
    out = J.look_up(out, F.col("n_regionkey"), table(spark, d, "region"), "r_regionkey", "")
    return out.select("o_orderkey", "o_orderdate", "c_name", "n_name", "r_name", F.coalesce(F.nullif(F.trim("c_mktsegment"), F.lit("")), F.lit("NONE")).alias("segment"))


@query("SELECT p_partkey, p_name, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') AS returned FROM part")
def flag_returned_parts(spark: SparkSession, d: str) -> DataFrame:
    """Left join with an existence flag."""
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return J.flag_known(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", returned, "l_partkey", "returned")


_VERSION = "SELECT tmdbId, nextSeasonNumber, upper(regexp_replace(status, '^\\s+|\\s+$', '', 'g')) AS status, releaseDate, releaseYear FROM official_series_data WHERE tmdbId IS NOT NULL AND snapshot_id = (SELECT {}(snapshot_id) FROM official_series_data) QUALIFY row_number() OVER (PARTITION BY tmdbId ORDER BY lastChecked DESC NULLS LAST, row_id DESC) = 1"


@query(f"""
WITH o AS ({_VERSION.format('min')}), n AS ({_VERSION.format('max')})
SELECT coalesce(o.tmdbId, n.tmdbId) AS tmdbId, CASE WHEN o.tmdbId IS NULL THEN 'added' WHEN n.tmdbId IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN o.tmdbId IS NULL OR n.tmdbId IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.nextSeasonNumber IS DISTINCT FROM n.nextSeasonNumber THEN 'nextSeasonNumber' END, CASE WHEN o.releaseDate IS DISTINCT FROM n.releaseDate THEN 'releaseDate' END, CASE WHEN o.releaseYear IS DISTINCT FROM n.releaseYear THEN 'releaseYear' END, CASE WHEN o.status IS DISTINCT FROM n.status THEN 'status' END) END AS changed_fields
FROM o FULL JOIN n ON o.tmdbId = n.tmdbId
WHERE o.tmdbId IS NULL OR n.tmdbId IS NULL OR (o.nextSeasonNumber, o.status, o.releaseDate, o.releaseYear) IS DISTINCT FROM (n.nextSeasonNumber, n.status, n.releaseDate, n.releaseYear)""")
def full_outer_diff(spark: SparkSession, d: str) -> DataFrame:
    """First against last snapshot: ids added, removed or changed, and in which fields."""
    fields = ["nextSeasonNumber", "status", "releaseDate", "releaseYear"]
    rows = table(spark, d, "official_series_data").where("tmdbId is not null").withColumn("status", F.upper(F.regexp_replace("status", r"^\s+|\s+$", "")))
    ends = F.broadcast(table(spark, d, "official_series_data").agg(F.min("snapshot_id").alias("first"), F.max("snapshot_id").alias("last")))
    both = rows.join(ends, F.col("snapshot_id").isin(F.col("first"), F.col("last")))
    old, new = (J.last_by_key(both.where(f"snapshot_id = {s}").select("tmdbId", "lastChecked", "row_id", *fields), ["tmdbId"], [F.col("lastChecked"), F.col("row_id")]) for s in ("first", "last"))
    diff = J.version_diff(old, new, "tmdbId", fields)
    return diff.select(F.col("key").alias("tmdbId"), "change", F.array_join("changed_fields", ",").alias("changed_fields"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_customers_with_finished_orders(spark: SparkSession, d: str) -> DataFrame:
    finished = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return table(spark, d, "customer").join(finished, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""
WITH e AS (SELECT * FROM hbo_production_evidence), c AS (SELECT DISTINCT new.tmdbId AS tmdbId, new.status AS status, new.nextSeasonNumber AS nextSeasonNumber, new.releaseDate AS releaseDate FROM changes WHERE new IS NOT NULL)
SELECT route, count(*) AS claims, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.tmdbId IS NOT DISTINCT FROM e.tmdbId AND c.status IS NOT DISTINCT FROM e.status AND c.nextSeasonNumber IS NOT DISTINCT FROM e.nextSeasonNumber AND c.releaseDate IS NOT DISTINCT FROM e.releaseDate)) AS unmatched,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.tmdbId IS NOT DISTINCT FROM e.tmdbId AND c.status IS NOT DISTINCT FROM e.status AND c.nextSeasonNumber IS NOT DISTINCT FROM e.nextSeasonNumber AND c.releaseDate IS NOT DISTINCT FROM e.releaseDate)) = 0 AS accepted
FROM e GROUP BY route""")
def replay_match_nullsafe(spark: SparkSession, d: str) -> DataFrame:
    """Composite null-safe match in which every claim of a group must be found again."""
    keys = ["tmdbId", "status", "nextSeasonNumber", "releaseDate"]
    records = table(spark, d, "changes").where("new is not null").select("new.*")
    return J.match_all(table(spark, d, "hbo_production_evidence"), records, keys, "route")


@query("""
WITH s AS (SELECT lower(a) AS alias, min(tmdbId) AS tmdbId FROM (SELECT tmdbId, unnest(aliases) AS a FROM sources) GROUP BY 1)
SELECT alias, s.tmdbId AS tmdbId, count(doc_id) AS documents FROM s LEFT JOIN documents ON contains(lower(text), alias) GROUP BY ALL""")
def alias_containment(spark: SparkSession, d: str) -> DataFrame:
    """Alias in text, however many aliases there are: one automaton over all of them, hits counted for each."""
    owners = table(spark, d, "sources").select(F.explode(F.transform("aliases", F.lower)).alias("alias"), "tmdbId").groupBy("alias").agg(F.min("tmdbId").alias("tmdbId"))
    lowered = table(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    hits = J.contained(lowered, "t", owners, "alias").groupBy(F.col("phrase").alias("hit")).agg(F.count("*").alias("n"))
    return owners.join(hits, F.col("alias") == F.col("hit"), "left").select("alias", "tmdbId", F.coalesce("n", F.lit(0)).alias("documents"))


@query("""
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events),
p AS (SELECT * FROM e WHERE event_type = 'purchase'), v AS (SELECT * FROM e WHERE event_type = 'view')
SELECT p.event_id AS purchase_id, arg_max(v.event_id, (v.t, v.event_id)) AS view_id
FROM p LEFT JOIN v ON v.user_id = p.user_id AND v.t <= p.t AND v.t >= p.t - 3600000000 GROUP BY p.event_id""")
def nearest_view_of_purchase(spark: SparkSession, d: str) -> DataFrame:
    """As-of join: each purchase with the user's latest view in the hour before."""
    e = table(spark, d, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    near = J.nearest_before(e, "user_id", micros, F.col("event_type") == "view", F.col("event_type") == "purchase", "event_id", 3_600_000_000, 6 * 3_600_000_000)
    return near.select(F.col("probe_id").alias("purchase_id"), F.col("base_id").alias("view_id"))


@query("""
WITH p AS (SELECT p_partkey, p_brand, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part), b AS (SELECT p_brand, arg_min(w, p_partkey) AS a FROM p GROUP BY p_brand)
SELECT p_partkey, CASE WHEN len(list_intersect(w, a)) = len(w) THEN 3 WHEN len(list_intersect(w, a)) >= greatest(1, (len(w) + 1) // 2) THEN 2 WHEN len(list_intersect(w, a)) > 0 THEN 1 ELSE 0 END AS score FROM p JOIN b USING (p_brand)""")
def token_overlap_score(spark: SparkSession, d: str) -> DataFrame:
    """Word overlap of each part's name with the name of its brand's first part."""
    parts = table(spark, d, "part").select("p_partkey", "p_brand", F.array_distinct(F.split(F.lower("p_name"), " ")).alias("w"))
    first = parts.groupBy(F.col("p_brand").alias("b")).agg(F.min_by("w", "p_partkey").alias("a"))
    return parts.join(first, F.col("p_brand") == F.col("b")).select("p_partkey", J.overlap_score(F.col("w"), F.col("a")).alias("score"))


@query("""
WITH o AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), n AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01')
SELECT o_orderkey, o_orderdate FROM o UNION ALL SELECT o_orderkey, o_orderdate FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)""")
def upsert_ignore(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return J.keep_existing(o.where("o_orderdate < '1998-01-01'"), o.where("o_orderdate >= '1997-07-01'"), "o_orderkey")


@query("""
WITH o AS (SELECT o_orderkey, 'old' AS version FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), n AS (SELECT o_orderkey, 'new' AS version FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01')
SELECT * FROM n UNION ALL SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)""")
def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    old = o.where("o_orderdate < '1998-01-01'").select("o_orderkey", F.lit("old").alias("version"))
    new = o.where("o_orderdate >= '1997-07-01'").select("o_orderkey", F.lit("new").alias("version"))
    return J.replace_existing(old, new, "o_orderkey")


@query("""
SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, n_priorities > 1 AS conflict FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END DESC, o_orderdate DESC, o_totalprice DESC, o_orderkey DESC) AS rn, (SELECT count(DISTINCT o_orderpriority) FROM orders x WHERE x.o_custkey = o.o_custkey) AS n_priorities FROM orders o) WHERE rn = 1""")
def canonical_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The strongest row of each key in a total order, with a conflict flag, in one aggregation."""
    o = table(spark, d, "orders").withColumn("rank", F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0))
    by = F.struct("rank", "o_orderdate", "o_totalprice", "o_orderkey")
    best = F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"), by)
    return o.groupBy("o_custkey").agg(best.alias("r"), (F.size(F.collect_set("o_orderpriority")) > 1).alias("conflict")).select("o_custkey", "r.*", "conflict")


@query("""
SELECT l_orderkey, first(l_linenumber ORDER BY l_linenumber) AS first_line, arg_min(l_shipdate, (l_linenumber, l_shipdate)) FILTER (WHERE l_returnflag = 'R') AS first_returned_ship
FROM lineitem GROUP BY l_orderkey""")
def first_with_condition(spark: SparkSession, d: str) -> DataFrame:
    """First row and first row with a condition within a key, by explicit ordinal."""
    returned = F.when(F.col("l_returnflag") == "R", F.struct("l_linenumber", "l_shipdate"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first_line"), F.min(returned)["l_shipdate"].alias("first_returned_ship"))


@query("""
WITH m AS (SELECT *, max(lastChecked) OVER (PARTITION BY tmdbId ORDER BY deliveredAt, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM official_series_data WHERE tmdbId IS NOT NULL AND lastChecked IS NOT NULL)
SELECT row_id, CASE WHEN seen IS NULL OR lastChecked > seen THEN 'NEWER' WHEN lastChecked = seen THEN 'SAME' ELSE 'OLDER' END AS verdict FROM m""")
def version_gate(spark: SparkSession, d: str) -> DataFrame:
    """Each delivery against the newest that came before for its series."""
    rows = table(spark, d, "official_series_data").where("tmdbId is not null and lastChecked is not null").withColumn("arrival", F.struct("deliveredAt", "row_id"))
    return O.version_gate(rows, "tmdbId", "arrival", "lastChecked", F.date_trunc("month", "deliveredAt")).select("row_id", "verdict")


@query("""
WITH i AS (SELECT tmdbId, row_number() OVER (ORDER BY tmdbId) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT tmdbId FROM monitored_changes WHERE tmdbId IS NOT NULL))
SELECT tmdbId, turn FROM (SELECT tmdbId, ((idx - (739000 * 3) % n) % n + n) % n AS turn FROM i) WHERE turn < 20""")
def daily_rotation(spark: SparkSession, d: str) -> DataFrame:
    """The 20 ids whose turn it is on day 739000, with a stride of 3 a day."""
    return O.rotation(table(spark, d, "monitored_changes"), "tmdbId", 739_000, 3, 20)


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rolling_hour_count(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return O.rolling_count(e, "user_id", F.unix_micros(F.col("ts").cast("timestamp")), 3_600_000_000).select("event_id", "in_window")


@query("""
SELECT event_id FROM (SELECT event_id, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS nxt FROM events) WHERE nxt IS NULL OR nxt - t > 60000000""")
def debounced_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return O.settled(e, "user_id", F.col("t"), "event_id", 60_000_000).select("event_id")


@query("SELECT o_orderkey, o_orderdate, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_custkey, o_orderkey LIMIT 3")
def due_top_three(spark: SparkSession, d: str) -> DataFrame:
    """Fair top-k of the due rows; Spark keeps k rows per task and merges them."""
    return table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_custkey", "o_orderkey").limit(3).select("o_orderkey", "o_orderdate", "o_custkey")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity) AS place FROM lineitem) WHERE place <= 3")
def top_three_per_group(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")]
    return O.top_per_group(table(spark, d, "lineitem"), "l_suppkey", order, 3).select("l_suppkey", "l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"))


@query("""
WITH u AS (SELECT row_id, unnest(knownUrlOracle) AS url, generate_subscripts(knownUrlOracle, 1) AS pos, 0 AS src FROM hbo_max_qualification_cases UNION ALL
  SELECT row_id, unnest(aliases), generate_subscripts(aliases, 1), 1 FROM hbo_max_qualification_cases),
f AS (SELECT row_id, url, min(src * 100000 + pos) AS place FROM u WHERE url IS NOT NULL GROUP BY ALL)
SELECT row_id, array_to_string(list_slice(list(url ORDER BY place), 1, 3), '|') AS first_three FROM f GROUP BY row_id""")
def ordered_distinct_cap(spark: SparkSession, d: str) -> DataFrame:
    """Union of two candidate lists, distinct in order of first appearance, the first three kept."""
    both = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("knownUrlOracle", "aliases")])
    kept = F.slice(F.array_distinct(F.array_compact(both)), 1, 3)
    return table(spark, d, "hbo_max_qualification_cases").select("row_id", F.array_join(kept, "|").alias("first_three")).where("first_three != ''")


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").subtract(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("""
WITH a AS (SELECT DISTINCT tmdbId FROM monitored_changes WHERE tmdbId IS NOT NULL), b AS (SELECT DISTINCT tmdbId FROM official_series_data WHERE tmdbId IS NOT NULL)
SELECT coalesce(a.tmdbId, b.tmdbId) AS tmdbId, a.tmdbId IS NOT NULL AS in_monitored FROM a FULL JOIN b ON a.tmdbId = b.tmdbId WHERE a.tmdbId IS NULL OR b.tmdbId IS NULL""")
def symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "monitored_changes").select("tmdbId", F.lit(1).alias("side"))
    b = table(spark, d, "official_series_data").select("tmdbId", F.lit(2).alias("side"))
    sides = a.unionByName(b).where("tmdbId is not null").groupBy("tmdbId").agg(F.bit_or("side").alias("sides"))
    return sides.where("sides != 3").select("tmdbId", (F.col("sides") == 1).alias("in_monitored"))


@query("SELECT DISTINCT tmdbId FROM monitored_changes WHERE tmdbId IS NOT NULL AND tmdbId NOT IN (SELECT tmdbId FROM series_metadata UNION SELECT tmdbId FROM sources)")
def subset_violations(spark: SparkSession, d: str) -> DataFrame:
    """Ids used but registered nowhere; empty if the subset rule holds."""
    known = table(spark, d, "series_metadata").select("tmdbId").unionByName(table(spark, d, "sources").select("tmdbId"))
    return table(spark, d, "monitored_changes").select("tmdbId").where("tmdbId is not null").distinct().join(known, "tmdbId", "left_anti")


@query("""
SELECT row_id, array_to_string(list_sort(list_distinct(rawNetworkLabels)), '|') AS labels, len(list_distinct(rawNetworkLabels)) = 1 AS single_label FROM hbo_production_evidence WHERE rawNetworkLabels IS NOT NULL""")
def array_set_functions(spark: SparkSession, d: str) -> DataFrame:
    labels = F.array_sort(F.array_distinct("rawNetworkLabels"))
    return table(spark, d, "hbo_production_evidence").where("rawNetworkLabels is not null").select("row_id", F.array_join(labels, "|").alias("labels"), (F.size(F.array_compact(labels)) == 1).alias("single_label"))


@query("""
SELECT tmdbId, nextSeasonNumber, status, releaseDate FROM official_series_data WHERE releaseDate > DATE '2026-08-01' QUALIFY row_number() OVER (PARTITION BY tmdbId ORDER BY snapshot_id DESC, lastChecked DESC NULLS LAST, row_id DESC) = 1""")
def upcoming(spark: SparkSession, d: str) -> DataFrame:
    """Latest dated row of each series after a fixed day."""
    later = table(spark, d, "official_series_data").where("releaseDate > date'2026-08-01'")
    order = [F.col("snapshot_id"), F.col("lastChecked"), F.col("row_id")]
    return O.strongest(later, "tmdbId", order).select("tmdbId", "nextSeasonNumber", "status", "releaseDate")


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(value, 0.0) AS value FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50""")
def json_projection(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").select("event_id", parsed.alias("k"), F.coalesce("value", F.lit(0.0)).alias("value")).where("k >= 50")


@query("""
SELECT id, coalesce(nullif(trim(title), ''), nullif(trim(originalTitle), ''), '?') AS name, coalesce(year, CAST(substr(firstAirDate, 1, 4) AS INTEGER)) AS year FROM series_metadata""")
def coalesced_entities(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "series_metadata")
    named = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("originalTitle"), F.lit("")), F.lit("?"))
    return m.select("id", named.alias("name"), F.coalesce("year", F.substring("firstAirDate", 1, 4).try_cast("int")).alias("year"))


@query("""
WITH o AS (SELECT id, tmdbId, overview FROM series_metadata), l AS (SELECT tmdbId, max(title) AS t FROM official_series_data WHERE tmdbId IS NOT NULL GROUP BY tmdbId)
SELECT id, coalesce(overview, t) AS overview FROM o LEFT JOIN l USING (tmdbId)""")
def update_from_map(spark: SparkSession, d: str) -> DataFrame:
    """Backfill of a column from a keyed source."""
    titles = table(spark, d, "official_series_data").where("tmdbId is not null").groupBy("tmdbId").agg(F.max("title").alias("t"))
    return table(spark, d, "series_metadata").join(titles, "tmdbId", "left").select("id", F.coalesce("overview", "t").alias("overview"))


@query("""
SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[\\n.!?]+'), lambda x: regexp_replace(x, '^ +| +$', '', 'g')), lambda x: x <> '')) AS sentences FROM documents WHERE text IS NOT NULL""")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("sentences"))
