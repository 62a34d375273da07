"""Reports and settings: nested JSON flattened, settings parsed and overlaid, flags, and tables as text,
with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinesieve.operators import boards as B
from kinesieve.plans.sequences import S, events
from kinesieve.sources.tables import table

REPORT = "quality struct<hf:double,high:double,windows:array<struct<t:bigint,px:double>>>, checks map<string,struct<value:double,pass:boolean>>, label string"
STAGES = {"read": "Reading", "meas": "Measuring", "pack": "Packing"}


def reports(spark, sf_dir):
    """A JSON report of every event; its quality has one of two names, and errors have none."""
    df = events(spark, sf_dir)
    name = F.when(F.col("event_type") == "click", "high").otherwise("hf")
    value = F.round(F.col("value"), 4).cast("string")
    checks = F.concat(F.lit(', "checks": {"size": {"value": '), value, F.lit(', "pass": '), (F.col("value") < 80).cast("string"), F.lit('}, "kind": {"pass": '), (F.col("event_type") != "view").cast("string"), F.lit("}}"))
    windows = F.concat(F.lit('"windows": [{"t": '), F.pmod("event_id", F.lit(60)).cast("string"), F.lit(', "px": 1.5}, {"t": '), F.pmod("event_id", F.lit(7)).cast("string"), F.lit(', "px": 0.25}]'))
    quality = F.concat(F.lit('"quality": {"'), name, F.lit('": '), value, F.lit(", "), windows, F.lit("}"))
    text = F.when(F.col("event_type") == "error", '{"label": "none"}').otherwise(F.concat(F.lit("{"), quality, checks, F.lit("}")))
    return df.filter("value IS NOT NULL").select("event_id", "event_type", text.alias("report"))


def report_fields(spark, sf_dir):
    """The report's quality under either name, its failed checks and the worst of its windows."""
    df = reports(spark, sf_dir).withColumn("r", F.from_json("report", REPORT))
    failed = F.array_sort(F.map_keys(F.map_filter("r.checks", lambda _, c: ~c["pass"])))
    worst = F.array_max(F.transform("r.quality.windows", lambda w: F.struct(w.px.alias("px"), (-w.t).alias("t"))))
    return df.select(
        "event_id", F.coalesce("r.quality.hf", "r.quality.high").alias("hf"), F.coalesce(F.array_join(failed, ","), F.lit("")).alias("failed"),
        worst.px.alias("worst_px"), (-worst.t).cast("double").alias("worst_t"), F.coalesce("r.label", F.lit("measured")).alias("label"),
    )


def report_windows(spark, sf_dir):
    """The windows of the reports as rows."""
    df = reports(spark, sf_dir).withColumn("r", F.from_json("report", REPORT))
    return df.select("event_id", F.posexplode("r.quality.windows").alias("position", "w")).select("event_id", "position", F.col("w.t").alias("t"), F.col("w.px").alias("px"))


def settings_parsed(spark, sf_dir):
    """Settings written as name=value, numbers among them as numbers; a part's own overlay the defaults."""
    text = F.concat(F.lit("size="), F.col("p_size").cast("string"), F.lit(";type="), F.col("p_type"), F.when(F.pmod("p_partkey", F.lit(3)) == 0, ";rate=0.5").otherwise(""))
    given = F.str_to_map(text, F.lit(";"), F.lit("="))
    base = F.create_map(F.lit("rate"), F.lit("1"), F.lit("lens"), F.lit("wide"))
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(F.col("given"), k))
    df = table(spark, sf_dir, "part").select("p_partkey", given.alias("given"))
    df = df.select("p_partkey", F.explode(F.map_concat("given", kept)).alias("name", "value"))
    return df.select("p_partkey", "name", "value", F.expr("try_cast(value AS double)").alias("number"))


def part_rules(spark, sf_dir):
    """Flags of a part as bits, what they say, and what rules it out."""
    flags = F.pmod("p_partkey", F.lit(16)).cast("int")
    listed = F.exists(F.array(F.lit("MEDIUM"), F.lit("PROMO")), lambda s: F.col("p_type").contains(s))
    why = B.reasons({"small and filled": (F.col("p_size") < 10) & (flags.bitwiseAND(1) > 0), "listed": listed & (F.col("p_size") > 40), "both modes": flags.bitwiseAND(6) == 6})
    return table(spark, sf_dir, "part").select("p_partkey", (flags.bitwiseAND(1) > 0).alias("has_fill"), F.array_join(why, ",").alias("why"))


def stage_names(spark, sf_dir):
    """What an event's stage is called: by its first letters, else itself with a capital."""
    stage = F.when(F.col("event_type") == "purchase", "pack_files").when(F.col("event_type") == "click", "measure").otherwise(F.concat(F.col("event_type"), F.lit("_step")))
    known = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])
    named = F.coalesce(F.try_element_at(known, F.substring(stage, 1, 4)), F.initcap(F.substring_index(stage, "_", 1)))
    return events(spark, sf_dir).select(stage.alias("stage"), named.alias("name")).groupBy("stage", "name").agg(F.count("*").alias("n"))


def table_lines(spark, sf_dir):
    """Suppliers by nation as lines of a Markdown table, and the number read back from each line."""
    df = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    df = df.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))
    line = F.format_string("| %s | %d | %.2f |", "n_name", "n", "total")
    return df.select(line.alias("line")).select("line", F.regexp_extract("line", r"\| (\d+) \|", 1).cast("int").alias("read"))


R = f"""{S}, r AS (SELECT event_id, event_type, round(value, 4) AS v, value FROM s WHERE value IS NOT NULL)"""
SQL = {
    "report_fields": f"""WITH {R} SELECT event_id, CASE WHEN event_type <> 'error' THEN v END AS hf,
 CASE WHEN event_type = 'error' THEN '' ELSE concat_ws(',', CASE WHEN event_type = 'view' THEN 'kind' END, CASE WHEN NOT value < 80 THEN 'size' END) END AS failed,
 CASE WHEN event_type <> 'error' THEN 1.5::DOUBLE END AS worst_px, CASE WHEN event_type <> 'error' THEN CAST(event_id % 60 AS DOUBLE) END AS worst_t, CASE WHEN event_type = 'error' THEN 'none' ELSE 'measured' END AS label FROM r""",
    "report_windows": f"""WITH {R} SELECT event_id, CAST(0 AS INTEGER) AS position, event_id % 60 AS t, 1.5::DOUBLE AS px FROM r WHERE event_type <> 'error'
 UNION ALL SELECT event_id, CAST(1 AS INTEGER), event_id % 7, 0.25::DOUBLE FROM r WHERE event_type <> 'error'""",
    "settings_parsed": """WITH g AS (SELECT p_partkey, 'size' AS name, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part
 UNION ALL SELECT p_partkey, 'rate', CASE WHEN p_partkey % 3 = 0 THEN '0.5' ELSE '1' END FROM part UNION ALL SELECT p_partkey, 'lens', 'wide' FROM part)
SELECT p_partkey, name, value, TRY_CAST(value AS DOUBLE) AS number FROM g""",
    "part_rules": """WITH f AS (SELECT *, CAST(p_partkey % 16 AS INTEGER) AS flags FROM part)
SELECT p_partkey, flags & 1 > 0 AS has_fill, concat_ws(',', CASE WHEN p_size < 10 AND flags & 1 > 0 THEN 'small and filled' END,
 CASE WHEN (contains(p_type, 'MEDIUM') OR contains(p_type, 'PROMO')) AND p_size > 40 THEN 'listed' END, CASE WHEN flags & 6 = 6 THEN 'both modes' END) AS why FROM f""",
    "stage_names": f"""WITH {S} SELECT CASE event_type WHEN 'purchase' THEN 'pack_files' WHEN 'click' THEN 'measure' ELSE event_type || '_step' END AS stage,
 CASE event_type WHEN 'purchase' THEN 'Packing' WHEN 'click' THEN 'Measuring' ELSE upper(event_type[1]) || event_type[2:] END AS name, count(*) AS n FROM s GROUP BY 1, 2""",
    "table_lines": """WITH g AS (SELECT n_name, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT printf('| %s | %d | %.2f |', n_name, n, total) AS line, CAST(n AS INTEGER) AS read FROM g""",
}
QUERIES = {name: globals()[name] for name in SQL}
