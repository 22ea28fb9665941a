"""Queries of records, joins, scalars, news and text checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import asof as j
from ..operators import news as nw
from ..operators import textqa as qa
from ..session import shared_path
from ..sources import records as rec
from ..sources.tables import finite, with_period_index
from . import oracle as o
from ..sources.keyed_store import KeyedStore
from ..sources.snapshots import net_revisions, read_snapshots
from .registry import Panels, query

c = F.col
AS_OF = "2001-11-01"


def _day(text: str):
    return F.to_date(F.lit(text))


@query("SELECT symbol, stmt, item, period_end, value, dense_rank() OVER (PARTITION BY symbol, stmt ORDER BY period_end DESC) - 1 AS i FROM statements")
def s4_read_statements(t: Panels) -> DataFrame:
    return with_period_index(t.statements)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def s5_read_snapshot(t: Panels) -> DataFrame:
    rows = t.table("events").select("event_id", F.from_json("props", "k bigint").alias("payload"))
    return rows.select("event_id", c("payload.k").alias("k"))


# Fields by path: null where the path is missing or holds something of another type.
_NUM = lambda path, kind="DOUBLE": f"CASE WHEN json_type(j, '{path}') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(json_extract_string(j, '{path}') AS {kind}) END"
_EPS = lambda p, k: f"coalesce(CAST(json_extract_string(j, '$.analyst.eps_revisions.\"{p}\".{k}') AS INT), 0)"


@query(
    f"""WITH s AS (SELECT id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM snapshots),
    f AS (SELECT id, CASE WHEN json_type(j, '$.info.sector') = 'VARCHAR' THEN json_extract_string(j, '$.info.sector') END AS sector, {_NUM('$.info.beta')} AS beta, {_NUM('$.info.currentPrice')} AS price, {_NUM('$.info.sharesOutstanding', 'BIGINT')} AS shares,
      {_NUM('$.analyst.targets.mean')} AS target_mean, {_NUM('$.analyst.targets.high')} AS target_high, {_NUM('$.analyst.updown.up', 'INT')} AS up, {_NUM('$.analyst.updown.down', 'INT')} AS down,
      {_NUM('$.analyst.growth.0y')} AS growth_0y, TRY_CAST(json_extract_string(j, '$.analyst.calendar[0]') AS DATE) AS earnings_date, {_NUM('$.info.other.x[1]', 'INT')} AS other,
      json_type(j, '$.analyst.eps_revisions') = 'OBJECT' AS has, {_EPS('0q', 'up')} + {_EPS('+1y', 'up')} AS u, {_EPS('0q', 'down')} + {_EPS('+1y', 'down')} AS d FROM s)
    SELECT id, sector, beta, price, shares, target_mean, target_high, up, down, growth_0y, earnings_date, other, CASE WHEN has AND u + d > 0 THEN CAST(u - d AS DOUBLE) / (u + d) END AS net_revisions FROM f"""
)
def s5_nested_snapshot(t: Panels) -> DataFrame:
    rows = read_snapshots(t.snapshots)
    return rows.select(
        "id", "sector", "beta", "price", "shares", "target_mean", "target_high", c("updown.up").alias("up"), c("updown.down").alias("down"), F.try_element_at("growth", F.lit("0y")).alias("growth_0y"),
        "earnings_date", F.try_variant_get("rest", "$.info.other.x[1]", "int").alias("other"), net_revisions(c("eps_revisions")).alias("net_revisions"),
    )


@query("SELECT id, symbol, title, source, published, relevance, sentiment, impact, event FROM news")
def s6_read_news(t: Panels) -> DataFrame:
    return t.news


@query("SELECT strftime(created, '%Y-%m') AS run_month, count(*) AS n, max(horizon) AS last_horizon FROM runs GROUP BY 1")
def s7_append_runs(t: Panels) -> DataFrame:
    path = shared_path(t.spark, "runs")
    rec.append_runs(t.runs, path)
    kinds = "run_month string, result string"  # a month is no date
    return t.spark.read.schema(kinds).parquet(path).groupBy("run_month").agg(F.count(F.lit(1)).alias("n"), F.max(F.get_json_object("result", "$.horizon")).alias("last_horizon"))


@query("SELECT id, symbol, created, horizon, verdict, score, confidence, CAST(score AS VARCHAR) IS NOT NULL AS has_score FROM runs WHERE symbol = 'AF' ORDER BY created DESC, id DESC LIMIT 50")
def s8_list_runs(t: Panels) -> DataFrame:
    runs = t.runs.withColumn("result", F.to_json(F.struct("score", "horizon")))
    rows = rec.list_runs(runs, "AF", 50, {"score_text": "$.score"})
    return rows.withColumn("has_score", c("score_text").isNotNull()).drop("score_text")


def _runs_store(t: Panels) -> KeyedStore:
    """All runs in a keyed store of their own."""
    store = KeyedStore(t.spark, shared_path(t.spark, "runs"), ["id"], parts=16)
    store.upsert(t.runs)
    return store


@query("SELECT * FROM runs WHERE id = 77")
def s9_get_run(t: Panels) -> DataFrame:
    return _runs_store(t).get(77)


DELTA = "SELECT id, symbol, created, horizon, 'hold' AS verdict, score, confidence FROM runs WHERE id % 10 = 0"


@query(f"SELECT * FROM runs WHERE id % 10 <> 0 UNION ALL SELECT * FROM ({DELTA})")
def s10_upsert(t: Panels) -> DataFrame:
    store = _runs_store(t)
    store.upsert(t.runs.where("id % 10 = 0").withColumn("verdict", F.lit("hold")))
    return store.read()


@query("SELECT * FROM runs WHERE id % 7 <> 3")
def s11_delete_keys(t: Panels) -> DataFrame:
    store = _runs_store(t)
    store.delete(t.runs.where("id % 7 = 3").select("id"))
    return store.read()


@query("SELECT event_type AS key, max_by(event_id, ts) AS payload, max(ts) AS fetched_at FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 432000 SECOND GROUP BY 1")
def s12_fresh_snapshots(t: Panels) -> DataFrame:
    rows = t.table("events").select(c("event_type").alias("key"), c("event_id").alias("payload"), c("ts").cast("timestamp").alias("fetched_at"))
    return rec.fresh(rows, F.expr("timestamp '2024-01-10 00:00:00'"), 432000)


@query("SELECT event_id, event_type AS key, ts AS fetched_at FROM events WHERE ts >= TIMESTAMP '2024-02-05 00:00:00' - INTERVAL 30 DAY")
def s12_expire_snapshots(t: Panels) -> DataFrame:
    rows = t.table("events").select("event_id", c("event_type").alias("key"), c("ts").cast("timestamp").alias("fetched_at"))
    store = KeyedStore(t.spark, shared_path(t.spark, "snapshots"), ["event_id"], parts=16)
    store.upsert(rows)
    store.expire(~rec.is_kept(F.expr("timestamp '2024-02-05 00:00:00'")))
    return store.read()


@query("SELECT id, horizon, score FROM runs ORDER BY id DESC LIMIT 20")
def s13_weights_history(t: Panels) -> DataFrame:
    return rec.newest(t.runs, 20).select("id", "horizon", "score")


@query("SELECT id, symbol, created, horizon FROM runs WHERE created < DATE '1998-06-01' - 30")
def s14_matured_runs(t: Panels) -> DataFrame:
    return rec.matured(t.runs, _day("1998-06-01")).select("id", "symbol", "created", "horizon")


@query("SELECT CAST(min(created) AS VARCHAR) AS start, CAST(max(created) AS VARCHAR) AS \"end\", array_to_string(list_sort(list(DISTINCT horizon)), ',') AS horizons, count(*) AS n FROM runs")
def s15_write_report(t: Panels) -> DataFrame:
    path = shared_path(t.spark, "report")
    report = t.runs.agg(F.min("created").alias("start"), F.max("created").alias("end"), F.array_sort(F.collect_set("horizon")).alias("horizons"), F.count(F.lit(1)).alias("n"))
    rec.write_report(report, path)
    return t.spark.read.schema("start string, end string, horizons array<string>, n long").json(path).withColumn("horizons", F.array_join("horizons", ","))


@query(
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r, count(*) OVER (PARTITION BY symbol) AS k FROM bars)
    SELECT symbol, date, close FROM n WHERE NOT (r = 1 AND date = DATE '2001-06-06' AND k > 300)"""
)
def p1_drop_partial_bar(t: Panels) -> DataFrame:
    from ..operators.cleaning import drop_partial_bar

    return drop_partial_bar(t.bars, F.expr("timestamp '2001-06-06 15:00:00'")).select("symbol", "date", "close")


@query("SELECT id, title, regexp_matches(upper(trim(title)), '^[A-Z0-9][A-Z0-9.\\-^=]{0,14}$') AS ok, regexp_matches(upper(trim(symbol)), '^[A-Z0-9][A-Z0-9.\\-^=]{0,14}$') AS symbol_ok FROM news")
def p2_valid_symbol(t: Panels) -> DataFrame:
    return t.news.select("id", "title", sc.valid_symbol(c("title")).alias("ok"), sc.valid_symbol(c("symbol")).alias("symbol_ok"))


@query("SELECT c_custkey AS id, c_mktsegment AS kind FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey % 3 < 2 AND lower(c_name) LIKE '%er#0000000%' AND c_name NOT LIKE '%.%' ORDER BY c_custkey LIMIT 8")
def p3_search_symbols(t: Panels) -> DataFrame:
    from ..operators.cleaning import search_directory

    place = F.element_at(F.array(F.lit("NMS"), F.lit("NYQ"), F.lit("LSE")), (c("c_nationkey") % 3 + 1).cast("int"))
    rows = t.table("customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"), c("c_mktsegment").alias("kind"), place.alias("exchange"))
    return search_directory(rows, " er#0000000 ", "name", "kind", ["BUILDING", "MACHINERY"], "exchange", "id", 8).select("id", "kind")


# Phrases of holder notices and quote pages, as the rule states them.
_HOLDER = (
    r"\b(acquired|purchased|bought|sold|sells|buys)\b by\b"
    r"|\b(grows|reduces|trims|boosts|lifts|raises|cuts|lowers|increases|decreases|sells|buys|acquires|takes)\b (its |a |new )?(stake|position|holdings|shares)\b"
    r"|\bshares (acquired|purchased|bought|sold)\b|\bposition (lifted|raised|lowered|trimmed|cut)\b"
)
_FIRM = r"\b(llc|l\.p\.|advisors?|advisory|management|wealth|planning|counsel|financial|capital|partners|investments?|trust|securities|asset)\b"
_QUOTE_PAGE = "stock price,? (news|quote)|price, news, quote|stock quote|company overview"


def _junk(x: str) -> str:
    match = lambda p: f"regexp_matches({x}, '{p}', 'i')"
    return f"({match(_QUOTE_PAGE)} OR ({match(_HOLDER)} AND {match(_FIRM)}))"


TITLED = "concat(CASE id % 4 WHEN 0 THEN 'Shares sold by Alpha Capital LLC ' WHEN 1 THEN 'Acme stock price, news ' WHEN 2 THEN 'Berkshire sells its stake ' ELSE '' END, title)"


@query(f"SELECT id, {_junk(TITLED)} AS junk FROM news")
def p4_junk_headlines(t: Panels) -> DataFrame:
    head = F.element_at(F.array(F.lit("Shares sold by Alpha Capital LLC "), F.lit("Acme stock price, news "), F.lit("Berkshire sells its stake "), F.lit("")), (c("id") % 4 + 1).cast("int"))
    return t.news.select("id", sc.is_junk(F.concat(head, c("title"))).alias("junk"))


@query(
    """WITH b AS (SELECT symbol, date, close, row_number() OVER w - 1 AS i, round(lag(high) OVER w, 2) AS up, round(lag(low) OVER w, 2) AS down FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))
    SELECT symbol, date, close, CASE WHEN i % 3 = 2 THEN true WHEN up IS NULL THEN NULL WHEN i % 3 = 0 THEN up > close ELSE up > close AND down < close END AS ok FROM b"""
)
def p8_trigger_direction(t: Panels) -> DataFrame:
    """Triggers at the high and low of the day before, which the close may have passed already."""
    w = Window.partitionBy("symbol").orderBy("date")
    rows = t.bars.select("symbol", "date", "close", (F.row_number().over(w) - 1).alias("i"), F.format_string("%.2f", F.lag("high").over(w)).alias("up"), F.format_string("%.2f", F.lag("low").over(w)).alias("down"), F.lag("high").over(w).isNotNull().alias("able"))
    both = F.concat(F.lit("closes above $"), c("up"), F.lit(", or falls below $"), c("down"))
    text = F.when(c("i") % 3 == 2, "guidance is raised").when(c("able"), F.when(c("i") % 3 == 0, F.concat(F.lit("closes above $"), c("up"))).otherwise(both))
    return rows.select("symbol", "date", "close", qa.trigger_ok(text, c("close")).alias("ok"))


@query(
    """WITH r AS (SELECT id, horizon, round(confidence + 1e-9, 1) AS told, [confidence, abs(score), CAST(id AS DOUBLE), CAST(id % 3 AS DOUBLE)] AS facts FROM runs)
    SELECT id, horizon, len(list_filter(facts, lambda f: round_even(f * 10, 0) = round_even(told * 10, 0))) > 0 AND id % 4 = id % 3 AS ok FROM r"""
)
def p9_grounded_numbers(t: Panels) -> DataFrame:
    """A confidence told to one decimal, a count, and a multiple that is right for some runs only."""
    text = F.concat(F.lit("confidence "), F.format_string("%.1f", c("confidence") + 1e-9), F.lit(" over "), c("id").cast("string"), F.lit(" runs at "), (c("id") % 4).cast("string"), F.lit("x sales"))
    facts = F.array(c("confidence"), F.abs("score"), c("id").cast("double"), (c("id") % 3).cast("double"))
    return t.runs.select("id", "horizon", qa.grounded(text, facts, F.array((c("id") % 3).cast("double"))).alias("ok"))


@query(
    """WITH r AS (SELECT id, verdict, ['buy', 'hold', 'sell'][id % 3 + 1] AS v, ['BUY', 'Hold', 'sell'][id // 3 % 3 + 1] AS w, id % 5 <> 0 AS plain FROM runs),
    k AS (SELECT *, v = verdict OR lower(w) = verdict OR plain AS left_over FROM r)
    SELECT id, array_to_string(list_filter([CASE WHEN v = verdict OR NOT left_over THEN concat('The ', v, ' verdict holds.') END, CASE WHEN lower(w) = verdict OR NOT left_over THEN concat('A ', w, ' signal came!') END, CASE WHEN plain THEN 'Prices rise.' END], lambda x: x IS NOT NULL), ' ') AS summary FROM k"""
)
def p10_tidy_sentences(t: Panels) -> DataFrame:
    """Two sentences about verdicts, right or wrong by run, and one about none."""
    one = F.element_at(F.array(F.lit("buy"), F.lit("hold"), F.lit("sell")), (c("id") % 3 + 1).cast("int"))
    two = F.element_at(F.array(F.lit("BUY"), F.lit("Hold"), F.lit("sell")), (F.floor(c("id") / 3) % 3 + 1).cast("int"))
    text = F.concat(F.lit("The "), one, F.lit(" verdict holds. A "), two, F.lit(" signal came!"), F.when(c("id") % 5 != 0, " Prices rise.").otherwise(""))
    return t.runs.select("id", qa.tidy_sentences(text, c("verdict")).alias("summary"))


@query(
    """SELECT b.symbol, b.date, coalesce(s.value, (SELECT max_by(value, date) FROM series WHERE series_id = 'Y13W')) AS rate
    FROM bars b ASOF LEFT JOIN (SELECT * FROM series WHERE series_id = 'Y13W') s ON b.date >= s.date"""
)
def j1_align_rate(t: Panels) -> DataFrame:
    return j.align_rate(t.bars.select("symbol", "date"), t.series.where("series_id = 'Y13W'"))


DUE = "CASE horizon WHEN 'short' THEN 30 WHEN 'mid' THEN 91 ELSE 365 END"
RUNS_DUE = f"SELECT *, CAST(created + {DUE} AS DATE) AS due FROM runs"


@query(f"SELECT r.id, r.symbol, r.due, b.close AS end_price FROM ({RUNS_DUE}) r ASOF LEFT JOIN bars b ON r.symbol = b.symbol AND r.due <= b.date")
def j2_price_on(t: Panels) -> DataFrame:
    runs = t.runs.select("id", "symbol", sc.due_date(c("created"), c("horizon")).alias("due"))
    return j.price_on(runs, t.bars, "due")


@query(
    f"""WITH s AS (SELECT date, value AS idx, avg(value) OVER (ORDER BY date ROWS 199 PRECEDING) AS avg200 FROM series WHERE series_id = 'INDEX')
    SELECT b.symbol, b.date, s.idx, s.avg200 FROM (SELECT symbol, date FROM (SELECT *, row_number() {o.OVER} - 1 AS i FROM bars) WHERE i >= 504 AND (i - 504) % 21 = 0) b ASOF LEFT JOIN s ON b.date >= s.date"""
)
def j3_asof_panel(t: Panels) -> DataFrame:
    w = Window.orderBy("date").rowsBetween(-199, 0)
    s = t.series.where("series_id = 'INDEX'").select("date", F.struct(c("value").alias("idx"), F.avg("value").over(w).alias("avg200")).alias("s"))
    rows = t.bars.select("symbol", "date", (F.row_number().over(Window.partitionBy("symbol").orderBy("date")) - 1).alias("i"))
    rows = rows.where("i >= 504 and (i - 504) % 21 = 0").select("symbol", "date")
    return j.asof(rows, s, [], "date", "s").select("symbol", "date", "s.idx", "s.avg200")


JOINED = f"""SELECT b.symbol, b.date, b.r, x.x FROM (SELECT symbol, date, close / lag(close) {o.OVER} - 1 AS r FROM bars) b
    JOIN (SELECT date, value / lag(value) OVER (ORDER BY date) - 1 AS x FROM series WHERE series_id = 'INDEX') x ON b.date = x.date WHERE b.r IS NOT NULL AND x.x IS NOT NULL"""


@query(JOINED)
def j4_join_returns(t: Panels) -> DataFrame:
    from ..operators.risk import join_returns

    return join_returns(t.bars, t.series.where("series_id = 'INDEX'"))


WATCH = "SELECT DISTINCT symbol, horizon FROM runs"
STATUS = f"""WITH w AS ({WATCH}), n AS (SELECT *, row_number() OVER (PARTITION BY symbol, horizon ORDER BY created DESC, id DESC) AS k FROM runs)
    SELECT w.symbol, w.horizon, a.verdict AS last_verdict, b.verdict AS prev_verdict, a.created AS last_created, b.created AS prev_created, a.score AS last_score, b.score AS prev_score
    FROM w LEFT JOIN n a ON a.symbol = w.symbol AND a.horizon = w.horizon AND a.k = 1 LEFT JOIN n b ON b.symbol = w.symbol AND b.horizon = w.horizon AND b.k = 2"""


def _watch(t: Panels) -> DataFrame:
    return t.runs.select("symbol", "horizon").distinct()


@query(STATUS)
def j5_watch_status(t: Panels) -> DataFrame:
    return rec.watch_status(_watch(t), t.runs)


@query(f"SELECT *, coalesce(last_verdict <> prev_verdict, false) AS changed FROM ({STATUS})")
def w20_verdict_changed(t: Panels) -> DataFrame:
    return rec.verdict_changed(rec.watch_status(_watch(t), t.runs))


@query(f"SELECT w.symbol, w.horizon, max(r.created) AS last_created FROM ({WATCH}) w LEFT JOIN runs r ON r.symbol = w.symbol AND r.horizon = w.horizon GROUP BY 1, 2 HAVING max(r.created) IS NULL OR max(r.created) < DATE '2001-12-31'")
def j6_autorun_due(t: Panels) -> DataFrame:
    return rec.autorun_due(_watch(t), t.runs, _day("2001-12-31"))


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j7_attach_labels(t: Panels) -> DataFrame:
    return nw.attach_labels(t.table("documents").select("doc_id", "source"), t.table("labels"), "doc_id")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'XLRE' WHEN 'MACHINERY' THEN 'XLI' WHEN 'AUTOMOBILE' THEN 'XLY' WHEN 'HOUSEHOLD' THEN 'XLP' END AS etf FROM customer")
def j8_sector_etf(t: Panels) -> DataFrame:
    from ..operators.cleaning import sector_etf

    names = {"BUILDING": "Real Estate", "MACHINERY": "Industrials", "AUTOMOBILE": "Consumer Cyclical", "HOUSEHOLD": "Consumer Defensive"}
    return t.table("customer").select("c_custkey", sector_etf(sc.by_horizon(names, c("c_mktsegment"))).alias("etf"))


@query("SELECT b.symbol, g.strategy, g.variant, count(*) AS bars FROM bars b CROSS JOIN (VALUES ('sma_cross', 4), ('macd', 3), ('rsi_cross', 2), ('bollinger', 2), ('obv', 3), ('combined', 2), ('donchian', 2), ('ts_momentum', 3), ('trend_filter', 3), ('rsi2', 3), ('vol_breakout', 3)) k(strategy, n), LATERAL (SELECT k.strategy, unnest(range(k.n)) AS variant) g GROUP BY 1, 2, 3")
def j9_variant_grid(t: Panels) -> DataFrame:
    from ..operators.strategies import strategy_grid

    grid = strategy_grid(t.spark).select("strategy", "variant")  # a few dozen rows
    return t.bars.select("symbol").crossJoin(F.broadcast(grid)).groupBy("symbol", "strategy", "variant").agg(F.count(F.lit(1)).alias("bars"))


@query("SELECT symbol, max_by(close, date) AS last_close FROM bars WHERE symbol IN (SELECT symbol FROM runs WHERE verdict = 'buy') GROUP BY 1")
def j11_last_closes(t: Panels) -> DataFrame:
    return j.last_closes(t.bars, t.runs.where("verdict = 'buy'"))


@query("SELECT id, symbol, created, horizon, verdict, score, confidence FROM (SELECT *, lag(created) OVER (PARTITION BY symbol, horizon ORDER BY created, id) AS p FROM runs) WHERE created - p <= 0")
def j12_repeated_runs(t: Panels) -> DataFrame:
    return rec.repeated_runs(t.runs)


@query(
    """SELECT symbol, count(*) FILTER (impact = 'low') AS low, count(*) FILTER (impact = 'medium') AS medium, count(*) FILTER (impact = 'high') AS high
    FROM news WHERE published > DATE '2001-10-25' - 90 AND published <= DATE '2001-10-25' GROUP BY 1"""
)
def a1_change_counts(t: Panels) -> DataFrame:
    from ..operators.cleaning import recent_counts

    return recent_counts(t.news, "symbol", "impact", ["low", "medium", "high"], "published", _day("2001-10-25"), 90)


@query("SELECT id, symbol, impact, published, row_number() OVER (PARTITION BY symbol ORDER BY published DESC, id) AS rank FROM news QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY published DESC, id) <= 8")
def a1_newest_changes(t: Panels) -> DataFrame:
    from ..operators.cleaning import newest_changes

    return newest_changes(t.news.select("id", "symbol", "impact", "published"), "symbol", "published", "id")


def _evaluated() -> str:
    hit = "CASE verdict WHEN 'buy' THEN ret > 0.02 WHEN 'sell' THEN ret < -0.02 ELSE abs(ret) <= 0.05 END"
    return f"""WITH r AS ({RUNS_DUE}), p AS (SELECT r.*, b.close AS price FROM r ASOF LEFT JOIN bars b ON r.symbol = b.symbol AND r.created >= b.date),
    e AS (SELECT p.*, b.close AS later FROM p ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.due <= b.date),
    l AS (SELECT symbol, max_by(close, date) AS newest FROM bars GROUP BY 1),
    x AS (SELECT e.*, due <= DATE '2001-06-01' AS evaluated, coalesce(CASE WHEN due <= DATE '2001-06-01' THEN later END, newest) / price - 1 AS ret FROM e JOIN l ON e.symbol = l.symbol WHERE price IS NOT NULL)
    SELECT id, symbol, horizon, verdict, due, evaluated, ret, CASE WHEN evaluated THEN {hit} END AS hit FROM x"""


@query(_evaluated())
def e1_evaluate_runs(t: Panels) -> DataFrame:
    from ..operators.track import evaluate_runs, with_price

    return evaluate_runs(with_price(t.runs, t.bars), t.bars, _day("2001-06-01"))


@query(f"SELECT coalesce(verdict, 'all') AS verdict, count(*) AS n, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(ret) AS avg_return FROM ({_evaluated()}) WHERE hit IS NOT NULL GROUP BY GROUPING SETS ((verdict), ())")
def a12_track_record(t: Panels) -> DataFrame:
    from ..operators.track import evaluate_runs, track_record, with_price

    return track_record(evaluate_runs(with_price(t.runs, t.bars), t.bars, _day("2001-06-01")))


@query("SELECT symbol, event, count(*) AS n, count(*) FILTER (sentiment > 0.15) AS positive, count(*) FILTER (sentiment < -0.15) AS negative FROM news WHERE sentiment IS NOT NULL AND relevance >= 0.5 GROUP BY 1, 2")
def a13_news_counts(t: Panels) -> DataFrame:
    return nw.news_counts(t.news)


@query("SELECT horizon, count(DISTINCT (symbol, (created - DATE '1970-01-01' + 719163) // CASE horizon WHEN 'short' THEN 30 WHEN 'mid' THEN 91 ELSE 365 END)) AS n_eff FROM runs GROUP BY 1")
def a14_independent_samples(t: Panels) -> DataFrame:
    from ..operators.tuning import n_eff

    return n_eff(t.runs.withColumnRenamed("created", "date"))


UNI = "SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key FROM news"
DEDUP = f"SELECT * FROM ({UNI}) WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY symbol, key ORDER BY published DESC, id) = 1"


@query(f"SELECT id, symbol, key FROM ({DEDUP})")
def u1_dedup_news(t: Panels) -> DataFrame:
    return nw.dedup_news(t.news.where("id % 2 = 0"), t.news.where("id % 2 = 1")).select("id", "symbol", "key")


@query(f"SELECT id, symbol, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY published DESC, id) AS r FROM (SELECT * FROM ({UNI}) WHERE key <> '' AND NOT {_junk('title')} QUALIFY row_number() OVER (PARTITION BY symbol, key ORDER BY published DESC, id) = 1)) WHERE r <= 40")
def t1_latest_news(t: Panels) -> DataFrame:
    return nw.latest_news(t.news).select("id", "symbol", "rank")


WEIGHT = "relevance * CASE impact WHEN 'low' THEN 0.3 WHEN 'medium' THEN 1.0 ELSE 2.0 END * exp(-greatest(DATE '2001-11-01' - published, 0) / 7) * CASE WHEN event = 'price_move' THEN 0.3 ELSE 1 END"
WEIGHED = f"SELECT *, greatest(DATE '2001-11-01' - published, 0) AS age, {WEIGHT} AS weight FROM news WHERE sentiment IS NOT NULL"


@query(f"SELECT id, symbol, age, weight FROM ({WEIGHED})")
def f9_label_weight(t: Panels) -> DataFrame:
    return nw.with_weight(t.news, _day(AS_OF)).select("id", "symbol", "age", "weight")


@query(f"SELECT id, symbol, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(sentiment * weight) DESC, id) AS r FROM ({WEIGHED})) WHERE r <= 5")
def t2_news_drivers(t: Panels) -> DataFrame:
    return nw.news_drivers(t.news, _day(AS_OF)).select("id", "symbol", "rank")


@query(
    f"""WITH g AS (SELECT symbol, count(*) AS labelled, sum(weight) AS total, sum(sentiment * weight) / sum(weight) AS s,
      sum(sentiment * weight) FILTER (age <= 7) / sum(weight) FILTER (age <= 7) AS recent_7d, sum(sentiment * weight) FILTER (age > 7) / sum(weight) FILTER (age > 7) AS older FROM ({WEIGHED}) GROUP BY 1)
    SELECT symbol, labelled, total >= 0.05 AS available, CASE WHEN total >= 0.05 THEN s ELSE 0 END AS score, CASE WHEN total >= 0.05 THEN 1 - exp(-total / 2.5) ELSE 0 END AS confidence, recent_7d, older FROM g"""
)
def n1_news_score(t: Panels) -> DataFrame:
    return nw.news_score(t.news, _day(AS_OF))


@query("SELECT id, symbol, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY published DESC, id) AS r FROM news WHERE coalesce(relevance, 1) >= 0.5) WHERE r <= 15")
def t10_top_news(t: Panels) -> DataFrame:
    return nw.top_news(t.news).select("id", "symbol", "rank")


@query("SELECT event_id, CASE WHEN isfinite(x) THEN x END AS value FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'nan'::DOUBLE WHEN event_id % 5 = 1 THEN 'inf'::DOUBLE ELSE value END AS x FROM events)")
def f1_finite_or_null(t: Panels) -> DataFrame:
    x = F.when(c("event_id") % 5 == 0, F.lit(float("nan"))).when(c("event_id") % 5 == 1, F.lit(float("inf"))).otherwise(c("value"))
    return t.table("events").select("event_id", finite(x).alias("value"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE score / (id % 4) END AS r, greatest(-0.5, least(0.5, score)) AS clipped FROM runs")
def f2_ratio_clip(t: Panels) -> DataFrame:
    return t.runs.select("id", sc.ratio(c("score"), c("id") % 4).alias("r"), sc.clip(c("score"), -0.5, 0.5).alias("clipped"))


@query("SELECT id, CASE WHEN confidence >= 0.8 THEN 1.0 WHEN confidence >= 0.4 THEN 0.5 WHEN confidence >= 0.1 THEN -0.1 ELSE -1.0 END AS score FROM runs")
def f3_band_score(t: Panels) -> DataFrame:
    return t.runs.select("id", sc.band(c("confidence"), [(0.8, 1), (0.4, 0.5), (0.1, -0.1)], -1).alias("score"))


@query("SELECT id, CASE WHEN score >= 0.4 THEN 'A' WHEN score >= 0.15 THEN 'B' WHEN score > -0.15 THEN 'C' WHEN score > -0.4 THEN 'D' ELSE 'F' END AS grade FROM runs")
def f4_letter_grade(t: Panels) -> DataFrame:
    return t.runs.select("id", sc.letter(c("score")).alias("grade"))


@query("SELECT id, CASE verdict WHEN 'buy' THEN score > 0.02 WHEN 'sell' THEN score < -0.02 ELSE abs(score) <= 0.05 END AS hit FROM runs")
def f5_hit_rule(t: Panels) -> DataFrame:
    return t.runs.select("id", sc.is_hit(c("verdict"), c("score")).alias("hit"))


@query("SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key FROM news")
def f6_normal_title(t: Panels) -> DataFrame:
    return t.news.select("id", sc.normal_title(c("title")).alias("key"))


# Legal suffixes.
_LEGAL = r",?\s+(inc\.?|incorporated|corporation|corp\.?|co\.?|ltd\.?|plc|holdings?|group|company|n\.v\.|s\.a\.|ag|se)$"


def _suffix(x: str) -> str:
    return f"regexp_replace(trim({x}), '{_LEGAL}', '', 'i')"


NAMED = "concat(c_name, CASE c_custkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Holdings Ltd.' WHEN 2 THEN ' Group Company plc' ELSE '' END)"


@query(f"SELECT c_custkey, coalesce(nullif(trim(replace({_suffix(_suffix(_suffix(NAMED)))}, '\"', '')), ''), 'X') AS name FROM customer")
def f7_company_name(t: Panels) -> DataFrame:
    tail = F.element_at(F.array(F.lit(", Inc."), F.lit(" Holdings Ltd."), F.lit(" Group Company plc"), F.lit("")), (c("c_custkey") % 4 + 1).cast("int"))
    return t.table("customer").select("c_custkey", sc.company_name(F.concat("c_name", tail), F.lit("X")).alias("name"))


@query("SELECT id, left(sha1(concat(symbol, '|', trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')))), 16) AS article FROM news")
def f8_article_id(t: Panels) -> DataFrame:
    return t.news.select("id", sc.article_id(c("symbol"), sc.normal_title(c("title"))).alias("article"))


@query("SELECT id, greatest(0, least(1, coalesce(relevance, 2))) AS relevance, CASE WHEN sentiment IS NOT NULL THEN greatest(-1, least(1, 3 * sentiment)) END AS sentiment, CASE WHEN impact = 'high' THEN 'low' ELSE impact END AS impact, CASE WHEN event = 'legal' THEN 'other' ELSE event END AS event FROM news")
def f10_clean_label(t: Panels) -> DataFrame:
    impact, event = F.when(c("impact") == "high", "huge").otherwise(c("impact")), F.when(c("event") == "legal", "lawsuit").otherwise(c("event"))
    return t.news.select("id", *sc.clean_label(F.coalesce("relevance", F.lit(2.0)), c("sentiment") * 3, impact, event))


@query("SELECT date, pow(1 + value / 100, 1.0 / 252) - 1 AS rate FROM series WHERE series_id = 'Y10'")
def f11_daily_rate(t: Panels) -> DataFrame:
    return t.series.where("series_id = 'Y10'").select("date", sc.daily_rate(c("value") / 100).alias("rate"))


@query("SELECT id, greatest(1, CAST(round_even(CASE horizon WHEN 'short' THEN 21 WHEN 'mid' THEN 63 ELSE 252 END * (CASE WHEN id % 2 = 0 THEN 252 ELSE 365 END) / 252, 0) AS INT)) AS bars FROM runs")
def f12_horizon_bars(t: Panels) -> DataFrame:
    ppy = F.when(c("id") % 2 == 0, 252).otherwise(365)
    return t.runs.select("id", sc.scaled_bars(sc.by_horizon(sc.HORIZON_BARS, c("horizon")), ppy).alias("bars"))


def _first(x: str, month: int, sunday: int) -> str:
    """The first (0) or second (1) Sunday of a month of x's year."""
    d = f"make_date(year({x}), {month}, 1)"
    return f"({d} + CAST((7 - isodow({d})) % 7 + 7 * {sunday} AS INT))"


def _slot_sql(step: int) -> str:
    over = "CASE isodow(d) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END"
    move = f"CASE WHEN l {'<' if step < 0 else '>='} CAST(l AS DATE) + INTERVAL '16:40:00' THEN {step} ELSE 0 END"
    ends = f"d - ({over})" if step < 0 else f"d + CASE WHEN {over} > 0 THEN 3 - ({over}) ELSE 0 END"
    return f"(SELECT CAST({ends} AS DATE) + INTERVAL '16:40:00' FROM (SELECT CAST(l AS DATE) + CAST({move} AS INT) AS d))"


# New York is four hours behind UTC from the second Sunday of March, 7:00 UTC, to the first of November, 6:00 UTC, else five.
@query(
    f"""WITH z AS (SELECT event_id, ts - CASE WHEN ts >= {_first("ts", 3, 1)} + INTERVAL 7 HOUR AND ts < {_first("ts", 11, 0)} + INTERVAL 6 HOUR THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS l FROM events)
    SELECT event_id, {_slot_sql(-1)} AS before, {_slot_sql(1)} AS after FROM z"""
)
def f13_autorun_slot(t: Panels) -> DataFrame:
    return t.table("events").select("event_id", sc.slot(c("ts"), -1).alias("before"), sc.slot(c("ts"), 1).alias("after"))


@query(f"SELECT id, CAST(created + {DUE} AS DATE) AS due FROM runs")
def f14_due_date(t: Panels) -> DataFrame:
    return t.runs.select("id", sc.due_date(c("created"), c("horizon")).alias("due"))


@query("SELECT id, title AS clean FROM (SELECT id, trim(title) AS title FROM news)")
def f16_strip_source(t: Panels) -> DataFrame:
    rows = t.news.select("id", "source", F.concat(F.trim("title"), F.lit(" - "), c("source")).alias("title"))
    return rows.select("id", sc.strip_source(c("title"), c("source")).alias("clean"))


@query("SELECT id, CASE WHEN score >= 0.15 THEN 'positive' WHEN score <= -0.15 THEN 'negative' ELSE 'mixed' END AS word FROM runs")
def f17_signal_word(t: Panels) -> DataFrame:
    return t.runs.select("id", sc.signal_word(c("score")).alias("word"))


@query("SELECT id, created - DATE '1998-01-01' AS days FROM runs")
def f18_days_until(t: Panels) -> DataFrame:
    return t.runs.select("id", sc.days_until(c("created"), F.expr("timestamp '1998-01-01 12:00:00'")).alias("days"))
