"""Scans, nested documents, snapshots, streams, feature and overlay queries."""

from pyspark.sql import functions as F

from slatewise.functions.names import LIVE_FEATURES, feature_group_of
from slatewise.operators import context, features, history, market, scoring, snapshots
from slatewise.plans.context_queries import CANONICAL_FIELDS, EDGES
from slatewise.plans.history_queries import doubles, feature_names, features_sql, logit_sql
from slatewise.plans.ledger_queries import JOINED
from slatewise.plans.market_queries import PRICED, QKEY, VALUE_COLUMNS, valued_sql
from slatewise.plans.pitching_queries import FLAG_SQL, _raw_plays
from slatewise.plans import shared
from slatewise.plans.registry import query
from slatewise.session import work_path
from slatewise.sources import documents, files
from slatewise.sources.adapters import GAME_FIELDS
from slatewise.streaming import quotes as streams

# ---- scans ------------------------------------------------------------------------------------


@query("scan_team_logs", "log_date:s team:s opponent:s teamruns:d teamstarter:s rundifferential:d", "=> select * from team_logs")
def scan_team_logs(t):
    path = work_path(t.spark, "team_logs")
    t.team_logs.select("log_date", "team", "opponent", "teamruns", "teamstarter", "rundifferential").write.csv(path, header=True)
    return files.scan_team_logs(t.spark, path)


@query(
    "scan_quotes_file",
    "source:s game_pk:s away_team:s home_team:s away_odds:s home_odds:s",
    """=> select 'csv' as source, nullif(trim(game_pk), '') as game_pk, nullif(trim(away_team), '') as away_team, nullif(trim(home_team), '') as home_team, nullif(trim(away_odds), '') as away_odds, nullif(trim(home_odds), '') as home_odds from entries
    union all select 'document', nullif(trim(game_pk), ''), nullif(trim(away_team), ''), nullif(trim(home_team), ''), nullif(trim(away_odds), ''), nullif(trim(home_odds), '') from entries""",
)
def scan_quotes_file(t):
    columns = [c.split()[0] for c in files.QUOTE_ROW_SCHEMA.split(", ")]
    rows = t.entries.select(*columns)
    csv, document = work_path(t.spark, "entries-csv"), work_path(t.spark, "entries-json")
    rows.write.csv(csv, header=True)
    rows.select(F.array(F.struct(*columns)).alias("moneylines")).write.json(document)
    read = [files.scan_quotes_file(t.spark, p, k, lines=True).withColumn("source", F.lit(k)) for p, k in ((csv, "csv"), (document, "document"))]
    tidy = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    return read[0].unionByName(read[1]).select("source", *[tidy(c) for c in ("game_pk", "away_team", "home_team", "away_odds", "home_odds")])


@query(
    "scan_event_log",
    "stream:i sequence:i event_type:s payload:s event_sha256:s recorded_second:i",
    "=> select stream, sequence, event_type, payload, event_sha256, epoch(recorded_at) as recorded_second from evidence",
)
def scan_event_log(t):
    path = work_path(t.spark, "events")
    t.evidence.write.json(path)
    return files.scan_event_log(t.spark, path).withColumn("recorded_second", F.unix_timestamp(F.col("recorded_at").cast("timestamp")))


@query(
    "scan_snapshot_tree",
    "kind:s identity:s payload:s from_tree:b",
    "=> select kind, identity, raw_payload as payload, true as from_tree from starter_captures where kind = 'starter_stats'",
)
def scan_snapshot_tree(t):
    root = work_path(t.spark, "snapshots")
    rows = t.starter_captures.select(
        "side", F.lit(1).alias("schema_version"), "kind", F.col("captured_at").cast("string").alias("captured_at"), F.lit("stats").alias("source"), "identity", F.col("raw_payload").alias("payload")
    )
    rows.write.partitionBy("side").json(root)
    scanned = files.scan_snapshot_tree(t.spark, root, "starter_stats", lines=True)
    return scanned.withColumn("from_tree", F.contains("file_path", F.lit("side=")))



@query(
    "scan_play_by_play",
    "event_id:i outs_pre:i outs_post:i runs:i k:i single:i br1_pre:i",
    f"""f as (select event_id, {FLAG_SQL}, event_id % 3 as outs_pre, event_id % 5 as outs_post, event_id % 4 as runs, user_id, event_type from events)
    => select event_id, outs_pre, outs_post, runs, case when f_k then 1 end as k, case when f_single then 1 end as single, case when (event_id + 1) % 3 = 0 then user_id end as br1_pre from f where event_type <> 'error' and event_type <> 'signup'""",
)
def scan_play_by_play(t):
    path = work_path(t.spark, "plays")
    extra = t.raw("events").select("event_id", "event_type", (F.col("event_id") % 4).alias("runs"), "props")
    rows = _raw_plays(t).join(extra, "event_id").withColumns(
        {"gametype": F.when(F.col("event_type") == "error", "exhibition").otherwise("regular"), "pa": F.when(F.col("event_type") == "signup", 0).otherwise(1)}
    )
    rows.write.csv(path, header=True)
    return files.scan_play_by_play(t.spark, path)


@query(
    "write_report_tables",
    "table:s rows:i",
    """=> select 'predictions' as "table", count(*) as rows from predictions union all select 'score_cells', count(distinct game_pk) from draws union all select 'current_quotes', (select count(distinct """ + QKEY + ") from quotes)",
)
def write_report_tables(t):
    folder = work_path(t.spark, "report")
    parts = [("predictions", t.predictions, "csv"), ("score_cells", shared.score_cells(t), "parquet"), ("current_quotes", market.current_quotes(t.quotes), "json")]
    counts = []
    for name, table, fmt in parts:
        files.write_report_tables({name: table}, folder, fmt)
        read = t.spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).load(f"{folder}/{name}")
        counts.append(read.agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name)))
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


SNAPPED = ["game_pk", "side", "pitcher_id", "raw_payload"]
GAMES_A_SLICE = 100_000


@query(
    "snapshot_append",
    "snapshot_sha256:s game_pk:i side:s pitcher_id:i",
    "=> select distinct sha256('game_pk=' || game_pk || '|side=' || side || '|pitcher_id=' || pitcher_id || '|raw_payload=' || raw_payload) as snapshot_sha256, game_pk, side, pitcher_id from starter_captures where captured_at <= scheduled_start",
)
def snapshot_append(t):
    path = work_path(t.spark, "starter-snapshots")
    span = F.floor(F.col("game_pk") / GAMES_A_SLICE)
    for side in ("side = 'away'", "true", "side = 'home'"):  # overlapping deliveries add nothing twice
        files.snapshot_append(t.spark, path, t.starter_captures.filter(side), SNAPPED, by=span)
    return files.read_snapshots(t.spark, path)


@query(
    "pregame_field_overlay",
    "game_pk:i home_starter_fip:d away_starter_fip:d overlay:s",
    """s as (select case when priority <> '4-NOT SPECIFIED' then c.game_pk end as game_pk, c.game_date || ':' || c.away_team || '@' || c.home_team as nk, x.home_lineup_ops as hf, x.away_lineup_ops as af, c.game_pk as cap from contests c join contexts x using (game_pk) where feed_status <> 'O'),
    a as (select game_pk, arg_max(row(hf, af), cap) as v from s where game_pk is not null group by game_pk), b as (select nk, arg_max(row(hf, af), cap) as v from s where game_pk is null group by nk)
    => select c.game_pk, coalesce(case when a.v is not null then a.v[1] else b.v[1] end, home_starter_fip) as home_starter_fip, coalesce(case when a.v is not null then a.v[2] else b.v[2] end, away_starter_fip) as away_starter_fip,
       case when a.game_pk is not null then 'GAME_PK' when b.nk is not null then 'NATURAL_KEY' else 'NONE' end as overlay from contexts c left join a using (game_pk) left join b on b.nk = c.game_date || ':' || c.away_team || '@' || c.home_team""",
)
def pregame_field_overlay(t):
    values = t.contexts.select("game_pk", F.col("home_lineup_ops").alias("home_starter_fip"), F.col("away_lineup_ops").alias("away_starter_fip"))
    source = t.contests.filter("feed_status <> 'O'").join(values, "game_pk")
    natural = F.concat(F.col("game_date").cast("string"), F.lit(":"), F.col("away_team"), F.lit("@"), F.col("home_team"))
    snaps = source.select(
        F.when(F.col("priority") != "4-NOT SPECIFIED", F.col("game_pk")).alias("game_pk"), natural.alias("natural_key"), F.col("game_pk").alias("captured_at"), "home_starter_fip", "away_starter_fip"
    )
    rows = t.contexts.select("game_pk", "game_date", "away_team", "home_team", "home_starter_fip", "away_starter_fip")
    return files.pregame_field_overlay(rows, snaps, ["home_starter_fip", "away_starter_fip"])


# ---- nested documents -------------------------------------------------------------------------


def _schedule_docs(t):
    s = t.schedule
    team = lambda side: F.struct(
        F.struct(F.lit(1).alias("id"), F.col(f"{side}_team").alias("name"), F.col(f"{side}_team").alias("abbreviation")).alias("team"),
        F.col(f"{side}_runs").alias("score"), F.struct(F.lit(1).alias("id"), F.col(f"{side}_starter").alias("fullName")).alias("probablePitcher"),
    )
    game = F.struct(
        F.col("game_pk").alias("gamePk"), F.when(F.col("feed_status") != "P", F.col("game_date").cast("string")).alias("officialDate"), F.col("start_ts").cast("string").alias("gameDate"),
        F.lit("N").alias("doubleHeader"), F.struct(F.col("status_abstract").alias("abstractGameState"), F.col("status_detailed").alias("detailedState")).alias("status"),
        F.struct(F.lit(7).alias("id"), F.concat(F.lit("Park "), F.col("home_team")).alias("name")).alias("venue"), F.struct(team("away").alias("away"), team("home").alias("home")).alias("teams"),
    )
    empty = F.filter(F.array(game), lambda g: F.lit(False))
    bucket = F.date_add("game_date", F.when(F.col("feed_status") == "F", 1).otherwise(0)).cast("string")
    dates = F.array(F.struct(F.lit("2000-01-01").alias("date"), empty.alias("games")), F.struct(bucket.alias("date"), F.array(game).alias("games")))
    return s.select(F.to_json(F.struct(dates.alias("dates"))).alias("payload"))


@query(
    "flatten_schedule",
    "game_pk:i official_date:s status_abstract:s status_detailed:s venue_name:s away_team:s home_team:s away_score:i home_score:i away_pitcher:s home_pitcher:s",
    "=> select *, game_date as official_date, 'Park ' || home_team as venue_name, away_runs as away_score, home_runs as home_score, away_starter as away_pitcher, home_starter as home_pitcher from schedule",
)
def flatten_schedule(t):
    return documents.flatten_schedule(_schedule_docs(t))


BOX = """one as (select * from appearances qualify row_number() over (partition by game_pk, team, pitcher_id order by is_starter desc) = 1),
pl as (select o.*, c.feed_status, row_number() over (partition by game_pk, team order by case when c.feed_status = 'O' then 0 else o.pitcher_id end, case when o.is_starter = 1 then 0 else 1 end, outs desc, pitcher_id) - 1 as place from one o join contests c using (game_pk))"""


@query(
    "flatten_boxscore",
    "game_pk:i game_date:s team:s pitcher_id:i place:i is_starter:b outs:i pitches:i strikeouts:i walks:i home_runs:i batters_faced:i",
    f"{BOX} => select game_pk, game_date, team, pitcher_id, place, place = 0 as is_starter, outs, pitches, strikeouts, walks, home_runs, batters_faced from pl",
)
def flatten_boxscore(t):
    one = t.appearances.groupBy("game_pk", "game_date", "team", "pitcher_id").agg(
        F.max_by(F.struct("is_starter", "outs", "pitches", "strikeouts", "walks", "home_runs", "batters_faced"), "is_starter").alias("a")
    )
    ip = F.concat(F.floor(F.col("a.outs") / 3).cast("string"), F.lit("."), (F.col("a.outs") % 3).cast("string"))
    line = F.create_map(
        *[x for key, c in (
            ("inningsPitched", ip), ("numberOfPitches", F.col("a.pitches").cast("string")), ("strikeOuts", F.col("a.strikeouts").cast("string")), ("baseOnBalls", F.col("a.walks").cast("string")),
            ("homeRuns", F.col("a.home_runs").cast("string")), ("battersFaced", F.col("a.batters_faced").cast("string")), ("gamesStarted", F.col("a.is_starter").cast("string")),
        ) for x in (F.lit(key), c)]
    )
    player = F.struct(F.concat(F.lit("ID"), F.col("pitcher_id").cast("string")).alias("key"), F.struct(F.struct(F.col("pitcher_id").alias("id")).alias("person"), F.struct(line.alias("pitching")).alias("stats")).alias("value"))
    sides = one.groupBy("game_pk", "game_date", "team").agg(F.map_from_entries(F.collect_list(player)).alias("players"), F.sort_array(F.collect_list("pitcher_id")).alias("pitchers"))
    games = t.contests.select("game_pk", "game_date", "feed_status", "away_team", "home_team")
    box = lambda s: F.struct(F.when(F.col("feed_status") != "O", F.col(f"{s}.pitchers")).alias("pitchers"), F.col(f"{s}.players").alias("players")).alias(s)
    for s in ("away", "home"):
        games = games.join(sides.select("game_pk", F.col("team").alias(f"{s}_team"), F.struct("pitchers", "players").alias(s)), ["game_pk", f"{s}_team"], "left")
    feed = F.struct(
        F.struct(F.struct(F.col("game_pk").alias("pk")).alias("game"), F.struct(F.col("game_date").cast("string").alias("officialDate")).alias("datetime"),
                 F.struct(*[F.struct(F.col(f"{s}_team").alias("abbreviation")).alias(s) for s in ("away", "home")]).alias("teams")).alias("gameData"),
        F.struct(F.struct(F.struct(box("away"), box("home")).alias("teams")).alias("boxscore")).alias("liveData"),
    )
    return documents.flatten_boxscore(games.select(F.to_json(feed).alias("payload")))


def _provider_events(t):
    q = t.quotes.filter("market_type <> 'team_total'")
    key = F.when(F.col("market_type") == "moneyline", "h2h").when(F.col("market_type") == "run_line", "spreads").otherwise("totals")
    outcome = F.struct(F.initcap("selection").alias("name"), (F.col("american_odds") + 0.25).alias("price"), F.col("line").alias("point"))
    noise = F.struct(F.lit("Nobody").alias("name"), F.lit(150.0).alias("price"), F.lit(1.0).alias("point"))
    bad = F.struct(F.col("home_team").alias("name"), F.lit(50.0).alias("price"), F.lit(1.0).alias("point"))
    markets = F.array(F.struct(key.alias("key"), F.array(outcome, noise, bad).alias("outcomes")), F.struct(F.lit("outrights").alias("key"), F.array(outcome).alias("outcomes")))
    book = F.struct(F.lower("sportsbook").alias("key"), F.col("sportsbook").alias("title"), F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_update"), markets.alias("markets"))
    return q.select(F.to_json(F.struct(F.concat(F.lit("e"), F.col("game_pk").cast("string")).alias("id"), "away_team", "home_team", F.array(book).alias("bookmakers"))).alias("payload"))


@query(
    "provider_quotes_flatten",
    "quote_key:s game_pk:i sportsbook:s market_type:s selection:s line:d american_odds:i",
    f"""q as (select * from quotes where market_type <> 'team_total')
    => select {QKEY} as quote_key, game_pk, sportsbook, market_type, selection, line, american_odds from q qualify row_number() over (partition by {QKEY} order by captured_at desc, american_odds desc) = 1""",
)
def provider_quotes_flatten(t):
    matches = t.contests.select(F.concat(F.lit("e"), F.col("game_pk").cast("string")).alias("event_id"), "game_pk", "away_team", "home_team")
    return documents.provider_quotes_flatten(_provider_events(t), matches)


@query(
    "team_name_normalise",
    "game_pk:i typed:s normalised:s team_code:s",
    """n as (select game_pk, cast(substr(home_team, 2) as int) as k, home_team, feed_status, priority from contests),
    y as (select game_pk, k, home_team, case when priority = '1-URGENT' then ' Nation & ' || k || '. ' when priority = '2-HIGH' then 'NATION_' || k when priority = '3-MEDIUM' then lower(home_team) when priority = '4-NOT SPECIFIED' then 'Nation' || k else home_team || ' ' end as typed from n)
    => select game_pk, typed, trim(regexp_replace(replace(lower(typed), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) as normalised, case when typed like '%&%' or typed like 'NATION%' or upper(trim(typed)) = home_team then home_team end as team_code from y""",
)
def team_name_normalise(t):
    k = F.col("home_team").substr(2, 2).cast("int").cast("string")
    p = F.col("priority")
    typed = (
        F.when(p == "1-URGENT", F.concat(F.lit(" Nation & "), k, F.lit(". ")))
        .when(p == "2-HIGH", F.concat(F.lit("NATION_"), k))
        .when(p == "3-MEDIUM", F.lower("home_team"))
        .when(p == "4-NOT SPECIFIED", F.concat(F.lit("Nation"), k))
        .otherwise(F.concat("home_team", F.lit(" ")))
    )
    number = F.col("n_nationkey").cast("string")
    code = F.concat(F.lit("T"), F.lpad(number, 2, "0"))
    spellings = F.array(F.concat(F.lit("nation "), number), F.concat(F.lit("nation and "), number))
    aliases = t.raw("nation").select(F.explode(spellings).alias("alias"), code.alias("code"))
    return features.team_name_normalise(t.contests.select("game_pk", typed.alias("typed")), "typed", aliases)


# ---- captures ---------------------------------------------------------------------------------

ISSUE_SQL = """
chk as (select *, kind <> 'starter_stats' as b_kind, captured_at > scheduled_start as b_post, identity <> game_pk || ':' || side || ':' || pitcher_id as b_id, game_pk % 37 = 0 as b_hash, pitcher_id % 23 = 0 as b_metric from starter_captures),
ok as (select *, not (b_kind or b_post or b_id or b_hash or b_metric) as valid from chk)
"""


@query(
    "starter_snapshot_audit",
    "snapshots:i valid_snapshots:i complete_games:i partial_games:i kind_issues:i post_start_issues:i side_issues:i identity_issues:i raw_hash_issues:i metric_issues:i status:s",
    ISSUE_SQL
    + """, g as (select game_pk, max(case when valid and side = 'away' then 1 else 0 end) + max(case when valid and side = 'home' then 1 else 0 end) as s from ok group by game_pk)
    => select count(*) as snapshots, count(*) filter (where valid) as valid_snapshots, (select count(*) from g where s = 2) as complete_games, (select count(*) from g where s = 1) as partial_games, count(*) filter (where b_kind) as kind_issues,
       count(*) filter (where b_post) as post_start_issues, 0 as side_issues, count(*) filter (where b_id) as identity_issues, count(*) filter (where b_hash) as raw_hash_issues, count(*) filter (where b_metric) as metric_issues, 'FAIL' as status from ok""",
)
def starter_snapshot_audit(t):
    return snapshots.starter_snapshot_audit(t.starter_captures)


@query(
    "starter_identity_changes",
    "game_pk:i side:s pitcher_ids:s captures:i",
    ISSUE_SQL
    + """, f as (select game_pk, side, pitcher_id, min(captured_at) as c, count(*) as n from ok where valid group by all)
    => select game_pk, side, string_agg(cast(pitcher_id as varchar), '>' order by c, pitcher_id) as pitcher_ids, sum(n) as captures from f group by game_pk, side having count(*) > 1""",
)
def starter_identity_changes(t):
    return documents.starter_identity_changes(snapshots.starter_snapshot_issues(t.starter_captures).filter("size(issues) = 0"))


# ---- features ---------------------------------------------------------------------------------


def live_sql(name: str) -> str:
    if name in CANONICAL_FIELDS:
        return f"(away_{name} - home_{name}) * case when away_team < home_team then 1 else -1 end"
    if name in GAME_FIELDS:
        return name
    return "case when lineups_confirmed then 1.0 else 0.0 end" if name == "lineup_confirmed" else "cast(null as double)"


PAIRS = "raw_live as (select game_pk, " + ", ".join(f"{live_sql(n)} as {n}" for n in LIVE_FEATURES) + " from contexts)"


def _pairs(t):
    return features.missingness_pairs(context.context_diffs_canonical(t.contexts, CANONICAL_FIELDS, GAME_FIELDS))


@query(
    "missingness_pairs",
    "game_pk:i " + doubles([f"live_{n}" for n in LIVE_FEATURES] + [f"missing_{n}" for n in LIVE_FEATURES]),
    f"{PAIRS} => select game_pk, " + ", ".join(f"coalesce({n}, 0) as live_{n}, case when {n} is null then 1.0 else 0.0 end as missing_{n}" for n in LIVE_FEATURES) + " from raw_live",
)
def missingness_pairs(t):
    return _pairs(t)


def status_sql(name: str) -> str:
    trained = f"count({name}) >= 100 and count(distinct {name}) >= 2 and var_pop({name}) > 0"
    other = "ACTIVE_DIRECT_PROXY" if name in features.SCORE_PROXIES else "CAPTURED_PENDING_ADAPTIVE_AUTHORITY" if name in features.OVERLAY_RELATED else "CAPTURE_ONLY"
    return f"case when {trained} then 'ACTIVE_TRAINED' else '{other}' end"


AUTHORITY = " union all ".join(
    f"select '{n}' as feature, '{feature_group_of('live_' + n)}' as feature_group, count(*) as historical_rows, count({n}) as observed_rows, count({n}) / count(*) as coverage, count(distinct {n}) as unique_values, "
    f"case when count({n}) >= 2 then var_pop({n}) end as variance, {status_sql(n)} as status from raw_live"
    for n in LIVE_FEATURES
)


@query(
    "feature_authority",
    "feature:s feature_group:s historical_rows:i observed_rows:i coverage:d unique_values:i variance:d status:s status_count:i",
    f"{PAIRS}, a as ({AUTHORITY}) => select *, count(*) over (partition by status) as status_count from a",
)
def feature_authority(t):
    return features.feature_authority(_pairs(t))


CONTRACT = {"windows": (3, 10, 20), "momentum": True, "last_game": False}
KEPT = features.contract_columns(feature_names(), **CONTRACT)


@query("feature_contract_project", "game_pk:i " + doubles(KEPT), f"{features_sql()} => select * from features")
def feature_contract_project(t):
    rows = shared.matchups(t).select("game_pk", *feature_names())
    return features.feature_contract_project(rows, **CONTRACT)


@query(
    "feature_catalog",
    "feature:s feature_group:s observed_rows:i mean:d",
    f"{features_sql()}, u as ("
    + " union all ".join(f"select '{n}' as feature, '{feature_group_of(n)}' as feature_group, count({n}) as observed_rows, avg({n}) as mean from features" for n in feature_names())
    + ") => select * from u",
)
def feature_catalog(t):
    return features.feature_catalog(shared.matchups(t), feature_names())


SENSITIVE = list(scoring.PRIOR_WEIGHTS)
GROUPS = sorted({feature_group_of(c) for c in SENSITIVE})


def neutral_sql(group: str) -> str:
    weights = {(f"m_{c}" if feature_group_of(c) == group else c): w for c, w in scoring.PRIOR_WEIGHTS.items()}
    return f"{logit_sql(scoring.PRIOR_WEIGHTS)} - {logit_sql(weights)} as sensitivity_{group}"


@query(
    "group_sensitivity",
    "game_pk:i probability:d " + doubles(f"sensitivity_{g}" for g in GROUPS) + " top_supporting_group:s top_opposing_group:s",
    f"{features_sql()}, md as (select "
    + ", ".join(f"median({c}) as m_{c}" for c in SENSITIVE)
    + f" from features), s as (select game_pk, {logit_sql(scoring.PRIOR_WEIGHTS)} as probability, "
    + ", ".join(neutral_sql(g) for g in GROUPS)
    + " from features, md), l as (select game_pk, g, o, round(case when probability >= 0.5 then v else -v end, 12) as v from ("
    + " union all ".join(f"select game_pk, probability, '{g}' as g, {features.GROUP_ORDER.index(g)} as o, sensitivity_{g} as v from s" for g in GROUPS)
    + ") x), b as (select game_pk, (list(g order by v desc, o) filter (where v > 0))[1] as top_supporting_group, (list(g order by v, o) filter (where v < 0))[1] as top_opposing_group from l group by game_pk) => select * from s join b using (game_pk)",
)
def group_sensitivity(t):
    rows = shared.matchups(t).select("game_pk", *SENSITIVE)

    def score(column):
        z = sum((column(c) * w for c, w in scoring.PRIOR_WEIGHTS.items()), F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-F.least(F.lit(8.0), F.greatest(F.lit(-8.0), z))))

    return features.group_sensitivity(rows, score, SENSITIVE)


@query(
    "registry_check",
    "games:i complete:i missing:i unexpected:i",
    """v as (select game_pk, case when component = 'lightgbm' and game_pk % 31 = 5 then 'unknown_model' else component end as component from components where not (component = 'catboost' and game_pk % 50 = 3)
      union all select game_pk, component from components where component = 'logistic' and game_pk % 41 = 0),
    g as (select game_pk, count(*) as n, count(distinct component) filter (where component <> 'unknown_model') as d, count(*) filter (where component = 'unknown_model') as u from v group by game_pk)
    => select count(*) as games, count(*) filter (where n = 7 and d = 7) as complete, sum(7 - d) as missing, sum(u) as unexpected from g""",
)
def registry_check(t):
    """Votes as they come: some lack a component, some carry an unknown or a repeated one."""
    votes, game, name = t.components, F.col("game_pk"), F.col("component")
    renamed = F.when((name == "lightgbm") & (game % 31 == 5), "unknown_model").otherwise(name)
    kept = votes.where(~((name == "catboost") & (game % 50 == 3))).withColumn("component", renamed)
    return features.registry_check(kept.unionByName(votes.where((name == "logistic") & (game % 41 == 0))))


@query(
    "overlay_training_frame",
    "game_pk:i base_home_probability:d home_won:i base_home_logit:d " + doubles(context.CONTEXT_FEATURES),
    f"{JOINED}, {EDGES} => select j.game_pk, home_probability as base_home_probability, home_won, ln(home_probability / (1 - home_probability)) as base_home_logit, edges.* exclude (game_pk) from joined j join edges using (game_pk)",
)
def overlay_training_frame(t):
    return overlay_frame(t)


def overlay_frame(t):
    edges = context.context_edges_home(t.contexts)
    payloads = edges.select("game_pk", F.to_json(F.struct(*context.CONTEXT_FEATURES)).alias("context_features"))
    return snapshots.overlay_training_frame(t.ledger, payloads)


# ---- streams ----------------------------------------------------------------------------------


STREAM_BATCHES = 4


def files_per_batch(files: int) -> int:
    """Eight files, or so many that the feed takes :data:`STREAM_BATCHES` batches: each scans its whole stored side."""
    return max(8, -(-files // STREAM_BATCHES))


def _stream(t, name, run, *args, **kwargs):
    feed = streams.read_feed(t.spark, t.path("quote_feed"), files_per_batch(len(t.quote_feed.inputFiles())))
    return run(t.spark, feed, *args, work_path(t.spark, name), work_path(t.spark, f"{name}-checkpoint"), **kwargs)


def _delivered(t, name, run):
    """The result of a stream after every delivery; its state and watermark last from one to the next."""
    feed, out, checkpoint = work_path(t.spark, f"{name}-feed"), work_path(t.spark, name), work_path(t.spark, f"{name}-checkpoint")
    rows = None
    for delivery in range(t.quote_deliveries.agg(F.max("delivery")).first()[0] + 1):
        t.quote_deliveries.where(F.col("delivery") == delivery).drop("delivery").write.mode("append").parquet(feed)
        rows = run(t.spark, streams.read_feed(t.spark, feed, files_per_batch=None), out, checkpoint)
    return rows


@query(
    "stream_quote_history",
    "game_pk:i sportsbook:s market_type:s selection:s line:d american_odds:i captured_second:i",
    f"d as (select distinct {QKEY} as qk, * exclude (delivery) from quote_deliveries) => select *, epoch(captured_at) as captured_second from d",
)
def stream_quote_history(t):
    rows = _delivered(t, "quote-history", streams.stream_quote_history)
    return rows.withColumn("captured_second", F.unix_timestamp(F.col("captured_at").cast("timestamp")))


# what a delivery finds: the watermark, a week behind the newest time of the earlier ones
WATERMARKS = """lateness as (select interval 7 day as late),
    marks as (select delivery, max(max({at})) over (order by delivery rows between unbounded preceding and 1 preceding) - any_value(late) as mark from {rows}, lateness group by delivery),
    final as (select max({at}) - any_value(late) as mark from {rows}, lateness)"""


@query(
    "stream_current_quotes",
    "quote_key:s american_odds:i captured_second:i is_open:b",
    f"""d as (select {QKEY} as quote_key, *, cast(event_date as timestamp) + interval 1 day as closes from quote_deliveries where captured_at <= cast(event_date as timestamp) + interval 1 day),
    {WATERMARKS.format(at="closes", rows="d")},
    kept as (select d.* from d join marks using (delivery) where marks.mark is null or closes > marks.mark)
    => select quote_key, american_odds, epoch(captured_at) as captured_second, closes > final.mark as is_open from kept cross join final
       qualify row_number() over (partition by quote_key order by captured_at desc, american_odds desc) = 1""",
)
def stream_current_quotes(t):
    rows = _delivered(t, "current-quotes", streams.stream_current_quotes)
    return rows.withColumn("captured_second", F.unix_timestamp("captured_at"))


@query(
    "stream_reprice",
    "game_pk:i sportsbook:s market_type:s selection:s team:s line:d american_odds:i win_probability:d push_probability:d " + VALUE_COLUMNS,
    f"{PRICED}, {valued_sql('priced', 0.0)} => select * from valued union all select * from valued where sportsbook = 'B0'",
)
def stream_reprice(t):
    cells = shared.score_cells(t)
    return _stream(t, "reprice", streams.stream_reprice, cells)


@query(
    "stream_line_moves",
    "quote_key:s day:s open_odds:i close_odds:i low_odds:i high_odds:i quotes:i",
    f"""d as (select {QKEY} as quote_key, captured_at, american_odds, delivery, date_trunc('day', captured_at) + interval 1 day as day_end from quote_deliveries where captured_at is not null),
    {WATERMARKS.format(at="captured_at", rows="d")},
    kept as (select d.* from d join marks using (delivery) where marks.mark is null or day_end > marks.mark)
    => select quote_key, strftime(day_end - interval 1 day, '%Y-%m-%d') as day, arg_min(american_odds, row(captured_at, american_odds)) as open_odds, arg_max(american_odds, row(captured_at, american_odds)) as close_odds,
       min(american_odds) as low_odds, max(american_odds) as high_odds, count(*) as quotes from kept cross join final where day_end <= final.mark group by quote_key, day_end""",
)
def stream_line_moves(t):
    rows = _delivered(t, "line-moves", streams.stream_line_moves)
    return rows.withColumn("day", F.date_format("day", "yyyy-MM-dd"))
