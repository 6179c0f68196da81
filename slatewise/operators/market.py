"""Quotes: validation, current state, pricing against score draws, valuation and ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions import odds
from slatewise.operators.positions import position
from slatewise.operators.scores import CELLS, score_cells

# Market types and total selections
MARKET_TYPES = ("moneyline", "run_line", "game_total", "team_total")
TOTAL_SIDES = ("OVER", "UNDER")
MARKET_KEY = ("game_pk", "market_type", "selection", "line", "team")


def market_key() -> Column:
    """One text key per outcome; NULL line and team take part in it."""
    return F.concat_ws(
        "|", F.col("game_pk").cast("string"), "market_type", "selection",
        F.coalesce(F.col("line").cast("decimal(12,2)").cast("string"), F.lit("-")), F.coalesce("team", F.lit("-")),
    )


def quote_key() -> Column:
    return F.concat_ws("|", F.lower("sportsbook"), market_key())


def quote_validate(raw: DataFrame) -> DataFrame:
    """Canonical quotes with the first broken rule in ``reason`` (NULL when valid)."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    kind, side = F.lower(F.trim("market_type")), F.upper(F.trim("selection"))
    team = F.when(blank(F.col("team")), None).otherwise(F.upper(F.trim("team")))
    over_under = side.isin(*TOTAL_SIDES)
    no_line = F.col("line").isNull() | F.isnan("line") | (F.abs("line") == float("inf"))
    has_zone = F.col("captured_at").rlike(r"(Z|[+-]\d{2}:\d{2})$")
    reason = (
        F.when(~kind.isin(*MARKET_TYPES), "unknown_market_type")
        .when(F.col("game_pk") <= 0, "game_pk_not_positive")
        .when(blank(F.col("sportsbook")), "sportsbook_missing")
        .when(blank(F.col("selection")), "selection_missing")
        .when((F.col("american_odds") == 0) | (F.abs("american_odds") < 100), "invalid_american_odds")
        .when((kind == "moneyline") & F.col("line").isNotNull(), "moneyline_with_line")
        .when((kind == "moneyline") & team.isNotNull() & (team != side), "moneyline_team_mismatch")
        .when((kind != "moneyline") & no_line, "line_missing")
        .when((kind == "run_line") & over_under, "run_line_needs_team")
        .when(kind.isin("game_total", "team_total") & ~over_under, "total_needs_over_under")
        .when((kind == "game_total") & team.isNotNull(), "game_total_with_team")
        .when((kind == "team_total") & team.isNull(), "team_total_needs_team")
        .when(~has_zone, "timestamp_without_zone")
    )
    return raw.withColumns(
        {
            "reason": reason,
            "market_type": kind,
            "sportsbook": F.trim("sportsbook"),
            "selection": side,
            "team": team,
            "captured_at": F.try_to_timestamp("captured_at"),
        }
    )


def moneyline_validate(entries: DataFrame) -> DataFrame:
    """Typed price rows with status INCLUDED, SKIPPED or ERROR and the first error.

    Columns: row_id, include, game_date, game_pk (text), away_team, home_team, away_odds,
    home_odds, odds_format.  Duplicate checks count rows of a key, by aggregation and a join
    back on the duplicated keys only.
    """
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    flag = F.lower(text("include"))
    off, on = flag.isin(*odds.INCLUDE_NO), flag.isin(*odds.INCLUDE_YES) | (flag == "")
    no_away, no_home = text("away_odds") == "", text("home_odds") == ""
    pk_number = F.trim("game_pk").try_cast("double")
    rows = entries.withColumns(
        {
            "day": F.trim("game_date").try_cast("date"),
            "away": F.upper(text("away_team")),
            "home": F.upper(text("home_team")),
            "away_price": odds.parse_odds(F.col("away_odds"), F.col("odds_format")),
            "home_price": odds.parse_odds(F.col("home_odds"), F.col("odds_format")),
            "pk": F.when(pk_number == F.floor(pk_number), pk_number.cast("long")),
        }
    )
    first_error = (
        F.when(~on & ~off, "invalid_include")
        .when(off | (no_away & no_home), None)
        .when(no_away | no_home, "both_prices_required")
        .when((text("game_date") == "") | (F.col("away") == "") | (F.col("home") == ""), "date_and_teams_required")
        .when(F.col("day").isNull(), "invalid_game_date")
        .when(F.col("away_price").isNull() | F.col("home_price").isNull(), "invalid_odds")
        .when((text("game_pk") != "") & F.col("pk").isNull(), "game_pk_not_integer")
        .when(F.col("pk") <= 0, "game_pk_not_positive")
    )
    rows = rows.withColumns({"error": first_error, "skipped": (off & ~on) | (on & no_away & no_home)})
    active = F.col("error").isNull() & ~F.col("skipped")
    key = F.when(active, F.coalesce(F.concat(F.lit("pk:"), F.col("pk").cast("string")), F.concat_ws("|", F.col("day").cast("string"), "away", "home")))
    rows = rows.withColumn("entry_key", key)
    repeated = rows.filter("entry_key is not null").groupBy("entry_key").agg(F.count(F.lit(1)).alias("uses"), F.min("row_id").alias("first_row")).filter("uses > 1")
    rows = rows.join(repeated, "entry_key", "left")
    duplicate = active & F.col("first_row").isNotNull() & (F.col("row_id") != F.col("first_row"))
    error = F.when(duplicate, F.when(F.col("pk").isNotNull(), "duplicate_game_pk").otherwise("duplicate_matchup")).otherwise(F.col("error"))
    status = F.when(error.isNotNull(), "ERROR").when(F.col("skipped"), "SKIPPED").otherwise("INCLUDED")
    return rows.select("row_id", status.alias("status"), error.alias("error"), "day", "away", "home", "pk", "away_price", "home_price")


def latest_per_key(rows: DataFrame, keys: Sequence[str | Column], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The latest row per key by ``order``; partial aggregation keeps one row per key and task."""
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_latest"))
    names = [k for k in picked.columns if k != "_latest"]
    return picked.select(*names, *[F.col(f"_latest.{v}").alias(v) for v in values if v not in names])


QUOTE_VALUES = ("game_pk", "sportsbook", "market_type", "selection", "team", "line", "american_odds", "captured_at", "event_date", "home_team", "away_team")


def current_quotes(quotes: DataFrame) -> DataFrame:
    """Latest quote per quote key; equal times resolve to the higher odds."""
    return latest_per_key(quotes, [quote_key().alias("quote_key")], ["captured_at", "american_odds"], QUOTE_VALUES)


def active_sportsbooks(quotes: DataFrame) -> DataFrame:
    return current_quotes(quotes).select("sportsbook").distinct()


def provider_snapshot_diff(previous: DataFrame, incoming: DataFrame, replace_games: DataFrame) -> DataFrame:
    """Status of every current quote after a provider snapshot.

    Quotes of games outside ``replace_games`` (game_pk) stay PRESERVED; inside, a quote is
    ADDED, REMOVED, REPRICED or UNCHANGED.
    """
    old = previous.select(quote_key().alias("quote_key"), "game_pk", "sportsbook", F.col("american_odds").alias("old_odds"))
    new = incoming.select(quote_key().alias("quote_key"), F.col("game_pk").alias("new_pk"), F.col("sportsbook").alias("new_book"), F.col("american_odds").alias("new_odds"))
    marked = replace_games.select("game_pk").distinct().withColumn("replaced", F.lit(True))
    both = old.join(new, "quote_key", "full_outer").select(
        "quote_key", F.coalesce("game_pk", "new_pk").alias("game_pk"), F.coalesce("sportsbook", "new_book").alias("sportsbook"), "old_odds", "new_odds"
    )
    status = (
        F.when(F.col("new_odds").isNull(), F.when(F.col("replaced"), "REMOVED").otherwise("PRESERVED"))
        .when(F.col("old_odds").isNull(), "ADDED")
        .when(F.col("old_odds") != F.col("new_odds"), "REPRICED")
        .otherwise("UNCHANGED")
    )
    rows = both.join(marked, "game_pk", "left").withColumn("status", status)
    active = F.when(F.col("status") == "REMOVED", None).when(F.col("status") == "PRESERVED", F.col("old_odds")).otherwise(F.col("new_odds"))
    return rows.select("quote_key", "game_pk", "sportsbook", "old_odds", "new_odds", "status", active.alias("active_odds"))


def price_quotes_from_draws(quotes: DataFrame, draws: DataFrame, authoritative: DataFrame | None = None) -> DataFrame:
    """Win and push probability of every quote that has draws; see :func:`price_quotes`."""
    return price_quotes(quotes, score_cells(draws), authoritative)


def price_quotes(quotes: DataFrame, cells: DataFrame, authoritative: DataFrame | None = None) -> DataFrame:
    """Win and push probability of every quote whose game has score cells.

    Each outcome is a linear margin of the two scores: the quote wins where it is positive and
    pushes at zero.  Moneylines take ``authoritative`` (game_pk, home_win_probability) where given, else wins plus half the ties.
    """
    market_type, side_home, is_over = F.col("market_type"), F.col("selection") == F.col("home_team"), F.col("selection") == "OVER"
    two_way, whole = market_type.isin("moneyline", "run_line"), market_type == "game_total"
    team = lambda side: (F.col("team") == F.col(f"{side}_team")).cast("double")
    away_weight = F.when(two_way, F.when(side_home, -1.0).otherwise(1.0)).when(whole, 1.0).otherwise(team("away"))
    home_weight = F.when(two_way, F.when(side_home, 1.0).otherwise(-1.0)).when(whole, 1.0).otherwise(team("home"))
    sign = F.when(two_way | is_over, 1.0).otherwise(-1.0)
    shift = F.when(market_type == "moneyline", 0.0).when(market_type == "run_line", F.col("line")).otherwise(-F.col("line"))
    rows = quotes.withColumns({"_away": away_weight * sign, "_home": home_weight * sign, "_shift": shift * sign})
    joined = rows.join(cells, "game_pk").withColumn("cells", F.arrays_zip(*CELLS))  # three plain arrays travel, not structs

    def add(acc: Column, cell: Column) -> Column:
        margin = F.col("_away") * cell["away_runs"] + F.col("_home") * cell["home_runs"] + F.col("_shift")
        return acc + F.when(margin > 0, 2 * cell["n"]).when(margin == 0, cell["n"]).otherwise(0)

    zero = F.lit(0).cast("long")
    margin_of = lambda c: F.col("_away") * c["away_runs"] + F.col("_home") * c["home_runs"] + F.col("_shift")
    ties = F.aggregate("cells", zero, lambda acc, c: acc + F.when(margin_of(c) == 0, c["n"]).otherwise(0))
    # a win counts twice and a push once, so one pass gives the moneyline share directly
    priced = joined.withColumns({"_points": F.aggregate("cells", zero, add), "_ties": F.when(market_type != "moneyline", ties).otherwise(0)})
    win = (F.col("_points") - F.col("_ties")) / (2.0 * F.col("draws"))
    if authoritative is not None:
        priced = priced.join(authoritative.select("game_pk", "home_win_probability"), "game_pk", "left")
        p = F.when(side_home, F.col("home_win_probability")).otherwise(1.0 - F.col("home_win_probability"))
        win = F.when(market_type == "moneyline", F.coalesce(p, win)).otherwise(win)
    return priced.select(*quotes.columns, win.alias("win_probability"), (F.col("_ties") / F.col("draws")).alias("push_probability"))


def quote_snapshot_join(quotes: DataFrame, draws: DataFrame) -> DataFrame:
    """Latest quotes of games that hold a score distribution, with its draw count."""
    counted = draws.groupBy("game_pk").agg(F.count(F.lit(1)).alias("draws"))
    return current_quotes(quotes).join(counted, "game_pk")


def value_quotes(priced: DataFrame, required_roi: float = odds.MINIMUM_ROI, buffer: float = 0.0) -> DataFrame:
    """Edge, ROI, fair and playable prices and status of priced quotes.

    ``fresh`` and ``conflict`` columns are optional; the buffer lowers the win probability.
    """
    push, price = F.col("push_probability"), F.col("american_odds")
    win = F.greatest(F.lit(0.0), F.col("win_probability") - buffer)
    win = F.least(win, 1.0 - push)
    fresh = F.col("fresh") if "fresh" in priced.columns else F.lit(True)
    conflict = F.col("conflict") if "conflict" in priced.columns else F.lit(False)
    rows = priced.withColumn("conservative_probability", win)
    win = F.col("conservative_probability")
    rows = rows.withColumns({"expected_roi": odds.expected_roi(win, push, price), "break_even": odds.break_even(push, price)})
    status = (
        F.when(~fresh, "PASS_STALE")
        .when(conflict, "PASS_CONFLICT")
        .when(F.col("expected_roi") >= required_roi, "PLAY")
        .when(F.col("expected_roi") > 0, "MARGINAL")
        .otherwise("NO_EDGE")
    )
    return rows.withColumns(
        {
            "probability_edge": win - F.col("break_even"),
            "fair_odds": odds.price_at(win, push, 0.0),
            "playable_through": odds.price_at(win, push, required_roi),
            "status": status,
        }
    )


def line_frontier(draws: DataFrame, lines: Sequence[float], required_roi: float = odds.MINIMUM_ROI) -> DataFrame:
    """Win, push, fair and playable price of OVER and UNDER at each line, per game.

    All lines are conditional counts of one aggregation; no draw is repeated per line.
    """
    total = F.col("away_runs") + F.col("home_runs")
    entry = lambda line: F.struct(
        F.lit(line).alias("line"), F.count_if(total > line).alias("over"), F.count_if(total == line).alias("push"), F.count_if(total < line).alias("under")
    )
    counted = draws.groupBy("game_pk").agg(F.count(F.lit(1)).alias("n"), F.array(*[entry(float(x)) for x in lines]).alias("points"))
    flat = counted.select("game_pk", "n", F.inline("points"))
    sides = F.array(*[F.struct(F.lit(s).alias("selection"), (F.col(s.lower()) / F.col("n")).alias("win_probability")) for s in TOTAL_SIDES])
    rows = flat.select("game_pk", "line", (F.col("push") / F.col("n")).alias("push_probability"), F.inline(sides))
    win, push = F.col("win_probability"), F.col("push_probability")
    return rows.withColumns({"fair_odds": odds.price_at(win, push, 0.0), "playable_through": odds.price_at(win, push, required_roi)})


def score_summary(draws: DataFrame) -> DataFrame:
    """Win, tie, shutout, blow-out and one-run rates with mean and median runs per game.

    Rates are one partial aggregation over the draws; medians come from the value counts.
    """
    a, h = F.col("away_runs"), F.col("home_runs")
    rate = lambda c: F.avg(c.cast("int"))
    rates = draws.groupBy("game_pk").agg(
        rate(a > h).alias("away_win"), rate(h > a).alias("home_win"), rate(a == h).alias("tie"), F.avg(a).alias("mean_away"), F.avg(h).alias("mean_home"),
        rate((a == 0) | (h == 0)).alias("shutout"), rate((a >= 10) | (h >= 10)).alias("team_ten_plus"), rate(a + h >= 15).alias("fifteen_plus"),
        rate(F.abs(a - h) >= 5).alias("margin_five_plus"), rate(F.abs(a - h) == 1).alias("one_run"),
    )
    sides = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_runs").alias("value")) for k in ("away", "home")])
    counts = draws.select("game_pk", F.inline(sides)).groupBy("game_pk", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy("game_pk", "kind")  # as many rows as a side has distinct scores
    ranked = counts.withColumns({"upto": F.sum("n").over(one.orderBy("value")), "total": F.sum("n").over(one)})
    covers = lambda place: (F.col("upto") - F.col("n") < place) & (F.col("upto") >= place)
    middle = lambda kind, place: F.max(F.when((F.col("kind") == kind) & covers(place), F.col("value")))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    medians = ranked.groupBy("game_pk").agg(*[((middle(k, low) + middle(k, high)) / 2).alias(f"median_{k}") for k in ("away", "home")])
    return rates.join(medians, "game_pk")


def best_quote_per_market(rows: DataFrame, allowed_books: Sequence[str] = ()) -> DataFrame:
    """Best price per outcome across books; equal prices resolve to the first book by name, +100 and -100 of one book to +100."""
    if allowed_books:
        rows = rows.filter(F.lower("sportsbook").isin(*[b.lower() for b in allowed_books]))
    price = odds.american_to_decimal(F.col("american_odds"))
    best = rows.groupBy(market_key().alias("market_key")).agg(F.min_by(F.struct(*rows.columns), F.struct(-price, "sportsbook", -F.col("american_odds"))).alias("q"))
    return best.select("market_key", "q.*")


def best_priced(quotes: DataFrame, cells: DataFrame) -> DataFrame:
    """The best quote per outcome, priced, with its ``market_key``; the rank functions take it as it is.

    An outcome's quotes share game and probability, so the best are chosen before they are priced.
    """
    return price_quotes(best_quote_per_market(quotes), cells)


def _best(priced: DataFrame) -> DataFrame:
    return priced if "market_key" in priced.columns else best_quote_per_market(priced)


def rank_high_probability(priced: DataFrame, top_n: int | None = None) -> DataFrame:
    """Outcomes by win probability regardless of price, best display price each."""
    best = _best(priced)
    ordered = best.orderBy(F.desc("win_probability"), F.asc("push_probability"), F.desc("game_pk"), F.desc("market_key"))
    return ordered if top_n is None else ordered.limit(top_n)


def rank_best_value(priced: DataFrame, top_n: int = 5, sportsbook: str | None = None, include_marginal: bool = False, required_roi: float = odds.MINIMUM_ROI) -> DataFrame:
    """The top-n values at one book, or at the best available price per outcome."""
    rows = _best(priced) if sportsbook is None else priced.filter(F.lower("sportsbook") == sportsbook.lower()).withColumn("market_key", market_key())
    kept = value_quotes(rows, required_roi).filter(F.col("status").isin("PLAY", *(["MARGINAL"] if include_marginal else [])))
    return kept.orderBy(
        F.desc("expected_roi"), F.desc("probability_edge"), F.desc("conservative_probability"), F.desc("game_pk"), F.desc("market_key")
    ).limit(top_n)


def model_only_probabilities(draws: DataFrame) -> DataFrame:
    """Both sides of every stored distribution, ranked by probability without any price."""
    per_game = draws.groupBy("game_pk", "away_team", "home_team").agg(
        F.avg(F.when(F.col("away_runs") > F.col("home_runs"), 1.0).when(F.col("away_runs") == F.col("home_runs"), 0.5).otherwise(0.0)).alias("away_p")
    )
    sides = F.array(
        F.struct(F.col("away_team").alias("selection"), F.col("away_p").alias("win_probability")),
        F.struct(F.col("home_team").alias("selection"), (1.0 - F.col("away_p")).alias("win_probability")),
    )
    rows = per_game.select("game_pk", F.inline(sides))
    order = [F.desc("win_probability"), F.desc("game_pk"), F.desc("selection")]
    return position(rows, [], order, "rank")


def parlay_pairs(picks: DataFrame, top_n: int) -> DataFrame:
    """Two-leg combinations of each slate's top picks under independence.

    ``picks`` has slate, rank, pick_probability, pick_odds; a slate contributes at most
    ``top_n`` picks, so a slate's list of legs and its pairs are bounded by that setting.
    """
    legs = picks.filter(F.col("rank") <= top_n).groupBy("slate").agg(
        F.sort_array(F.collect_list(F.struct("rank", "game_pk", "pick_probability", "pick_odds"))).alias("legs")
    )
    first = legs.select("slate", "legs", F.explode("legs").alias("l"))
    pairs = first.select("slate", "l", F.explode(F.filter("legs", lambda r: r["rank"] > F.col("l.rank"))).alias("r"))
    price = odds.american_to_decimal(F.col("l.pick_odds")) * odds.american_to_decimal(F.col("r.pick_odds"))
    joint = F.col("l.pick_probability") * F.col("r.pick_probability")
    rows = pairs.select(
        "slate", F.col("l.game_pk").alias("first_game"), F.col("r.game_pk").alias("second_game"),
        odds.decimal_to_american(price).alias("combined_odds"), joint.alias("joint_probability"),
    )
    implied = odds.implied_probability(F.col("combined_odds"))
    return rows.withColumns({"break_even_probability": implied, "edge": F.col("joint_probability") - implied})


def two_way_probabilities(rows: DataFrame, away: str = "away_odds", home: str = "home_odds") -> DataFrame:
    return rows.withColumns({"away_no_vig": odds.no_vig(F.col(away), F.col(home)), "home_no_vig": odds.no_vig(F.col(home), F.col(away))})
